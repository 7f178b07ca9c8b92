"""Roll-ups over facts: spend, activity, coverage, verdicts, latest rows, ordered feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spend_by(facts: DataFrame, keys: list[str], amount: str, since: Column | None = None) -> DataFrame:
    """Tokens and calls by keys, null keys included."""
    rows = facts if since is None else facts.filter(since)
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("total"), F.count("*").alias("calls"))


def spend_report(facts: DataFrame, person: str, stage: str, amount: str, estimated: Column) -> DataFrame:
    """Whole, by person and by stage in one pass: level 0 is the whole, 1 a person, 2 a stage."""
    rows = facts.select(F.col(person).alias("person"), F.col(stage).alias("stage"), F.col(amount).alias("amount"), estimated.alias("est"))
    out = rows.groupingSets([[F.col("person")], [F.col("stage")], []], F.col("person"), F.col("stage")).agg(
        F.sum("amount").alias("total"), F.count("*").alias("calls"), F.coalesce(F.sum(F.when(F.col("est"), F.col("amount"))), F.lit(0)).alias("estimated"), F.grouping_id().alias("g"),
    )
    return out.select(F.when(F.col("g") == 3, 0).when(F.col("g") == 1, 1).otherwise(2).cast("long").alias("level"), "person", "stage", "total", "calls", "estimated")


def activity(sources: dict[str, DataFrame], user: str = "user") -> DataFrame:
    """One row a user with a column for each source of (user, n); unknown users are Unattributed."""
    rows = None
    for name, df in sources.items():
        own = df.select(F.coalesce(F.col(user).cast("string"), F.lit("Unattributed")).alias("who"), F.lit(name).alias("kind"), F.col("n").cast("double").alias("n"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("who").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0.0)).alias(k) for k in sources))


def contributors(by_user: DataFrame) -> DataFrame:
    """Number of known users and the sums of all."""
    sums = [F.sum(c).alias(c) for c in by_user.columns if c != "who"]
    return by_user.agg(F.count_if(F.col("who") != "Unattributed").alias("contributors"), *sums)


def feed(kinds: dict[str, DataFrame], each: int = 40, whole: int = 60) -> DataFrame:
    """Newest first over several kinds of (at, id, detail): at most each of a kind and whole in all."""
    rows = None
    for name, df in kinds.items():
        own = df.select("at", "id", "detail").orderBy(F.desc("at"), "id").limit(each).withColumn("kind", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return rows.orderBy(F.desc("at"), "kind", "id").limit(whole)


def vocabulary_counts(rows: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Counts for exactly these words: others are dropped, missing ones are zero."""
    words = rows.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    counts = rows.filter(F.col(column).isin(vocabulary)).groupBy(F.col(column).alias("word")).agg(F.count("*").alias("n"))
    return F.broadcast(words).join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def pivot_counts(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Counts by key and value as one column a value."""
    out = rows.groupBy(key).pivot(column, values).count()
    return out.select(key, *(F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def first_seen(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """As latest(), earliest first."""
    return latest(rows, keys, F.col(at), F.col(tie))


def embedding_coverage(chunks: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """Chunks in all and those with a vector, by document group (column grp)."""
    has = embeddings.select(key).distinct().withColumn("has", F.lit(1))
    return chunks.join(has, key, "left").groupBy("grp").agg(F.count("*").alias("chunks"), F.count("has").alias("embedded"))


def lacking(chunks: DataFrame, embeddings: DataFrame, key: str, model: str | None = None) -> DataFrame:
    """Chunks without a vector of the model."""
    own = embeddings if model is None else embeddings.filter(F.col("model") == model)
    return chunks.join(own, key, "left_anti")


def sole_owner(members: DataFrame, org: str, user: str) -> DataFrame:
    """Organisations with exactly one member, and that member."""
    return members.groupBy(org).agg(F.min(user).alias("owner"), F.count("*").alias("n")).filter("n = 1").drop("n")


def last_seen(rows: DataFrame, key: str, at: str, amount: str) -> DataFrame:
    """Sum and newest time by key."""
    return rows.groupBy(key).agg(F.sum(amount).alias("total"), F.max(at).alias("last_seen"))


def roster(people: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """Every person with what they used, zero if nothing."""
    sums = usage.groupBy(key).agg(F.sum("amount").alias("used"), F.max("at").alias("last_seen"))
    return people.join(sums, key, "left").withColumn("used", F.coalesce("used", F.lit(0.0)))


def roster_counts(people: DataFrame, org: str, states: list[str]) -> DataFrame:
    """People of each organisation by roster state, a column a state, and all."""
    return people.groupBy(org).agg(*(F.count_if(F.col("status") == s).alias(s) for s in states), F.count("*").alias("people"))


def platform_totals(facts: DataFrame, amount: str, person: str) -> DataFrame:
    """One row: what was used in all, by how many, in how many calls, and when last."""
    return facts.agg(F.coalesce(F.sum(amount), F.lit(0)).alias("total"), F.count("*").alias("calls"), F.count_distinct(person).alias("people"), F.max("at").alias("last_at"))


def by_priority(suggestions: DataFrame, key: str, order: list[str], most: int = 15) -> DataFrame:
    """The first most suggestions of a key (priority, at) by priority, their own order within one, each with how many more there are."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("priority")), F.lit(0)), F.lit(len(order) + 1))
    return capped(suggestions, key, most, rank, F.col("at"))


def agreement(reads: DataFrame, k: int) -> DataFrame:
    """Keys (section) seen in a majority of k reads, with the most-quoted, then longest, then least quote."""
    quotes = reads.groupBy("section", "quote").agg(F.count_distinct("read").alias("votes"))
    best = F.max_by("quote", F.struct("votes", F.length("quote"), F.col("quote"))).alias("quote")
    seen = reads.groupBy("section").agg(F.count_distinct("read").alias("reads")).filter(F.col("reads") >= k // 2 + 1)
    return quotes.groupBy("section").agg(best).join(seen, "section")


def merge_outcomes(parts: DataFrame, state_order: list[str]) -> DataFrame:
    """Outcomes of several designs (run, ordinal, items, n, state, truncated, reads, cached, at) as one row a run."""
    rank = F.array_position(F.array(*map(F.lit, state_order)), F.col("state"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "items")))
    return parts.groupBy("run").agg(
        F.flatten(F.transform(ordered, lambda x: x["items"])).alias("items"), F.sum("n").alias("n"), F.min_by("state", rank).alias("state"),
        F.bool_or("truncated").alias("truncated"), F.max("reads").alias("reads"), F.every("cached").alias("cached"), F.max("at").alias("generated_at"),
    )


def work_count(findings: DataFrame) -> DataFrame:
    """Distinct root causes plus findings outside any, by run."""
    return findings.groupBy("run_id").agg(F.count_distinct(F.coalesce(F.concat(F.lit("c:"), "cause"), F.concat(F.lit("f:"), "finding_id"))).alias("work"))


def group_adjacent(rows: DataFrame, key: str, position: str) -> DataFrame:
    """place: each group stands where its first member stands, members in their own order."""
    own = F.coalesce(F.concat(F.lit("k:"), F.col(key)), F.concat(F.lit("p:"), F.col(position).cast("string")))
    lead = F.min(position).over(Window.partitionBy("run_id", own))
    return rows.withColumn("lead", lead).withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("lead", position)))


def weave(rows: DataFrame, query: str, group: str, rank: str, limit: int, most: int = 24) -> DataFrame:
    """Round-robin over a query's groups by rank: at most min(most, limit * groups) rows a query."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(rank, group))
    sizes = rows.groupBy(query).agg(F.least(F.lit(most), limit * F.count_distinct(group)).alias("budget"))
    return rows.withColumn("place", place).join(sizes, query).filter("place <= budget").drop("budget")


def ordered_by(rows: DataFrame, ranks: dict[str, list[str]], *rest: Column) -> DataFrame:
    """Sort by position in fixed vocabularies, unknown words last."""
    keys = []
    for column, words in ranks.items():
        at = F.array_position(F.array(*map(F.lit, words)), F.col(column))
        keys.append(F.when(F.coalesce(at, F.lit(0)) == 0, len(words) + 1).otherwise(at))
    return rows.orderBy(*keys, *rest)


def capped(rows: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """The first most rows of a key, each with how many more there are."""
    w = Window.partitionBy(key)
    out = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return out.filter(F.col("place") <= most)


def budget_cap(lengths: DataFrame, key: str, length: str, budget: int, least: int = 600) -> DataFrame:
    """The largest common cut (least at the lowest) with sum(min(length, cut)) <= budget, by prefix sums over sorted lengths."""
    w = Window.partitionBy(key).orderBy(length, "id")
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(Window.partitionBy(key)) - F.row_number().over(w) + 1
    fits = lengths.withColumn("room", F.floor((budget - before) / left)).withColumn("whole", F.sum(length).over(Window.partitionBy(key)))
    cut = F.when(F.max("whole") <= budget, F.max(length)).otherwise(F.min(F.when(F.col("room") < F.col(length), F.col("room"))))
    return fits.groupBy(key).agg(F.greatest(cut, F.lit(least)).cast("long").alias("cap"))


def clauses_per_document(sections: DataFrame, clauses: DataFrame) -> DataFrame:
    """How many clauses the sections of a document hold; none counts as 0."""
    own = clauses.groupBy("section_id").agg(F.count("*").alias("n"))
    return sections.join(own, "section_id", "left").groupBy("document_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("clauses"))


def with_project(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Documents with the name of their project, null without one."""
    return documents.join(projects.select("project_id", F.col("name").alias("project")), "project_id", "left")


def backfill(rows: DataFrame, source: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with column filled from source where it is null; source holds a key once."""
    found = source.select(*keys, F.col(column).alias("_found"))
    return rows.join(found, keys, "left").withColumn(column, F.coalesce(column, "_found")).drop("_found")


def project_listing(projects: DataFrame, documents: DataFrame, runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Each project with its designs, ready ones, runs, findings that wait for review, and last activity.

    A run belongs to its own project or to its document's. Of each scope (a document, or the project as a
    whole) the newest complete run is current; of its findings those pending and not absent are counted.
    """
    designs = documents.groupBy("project_id").agg(F.count("*").alias("designs"), F.count_if(F.col("status") == "ready").alias("ready"), F.max("updated_at").alias("last_activity"))
    owner = documents.select("document_id", F.col("project_id").alias("_through"))
    own = runs.join(owner, "document_id", "left").withColumn("project_id", F.coalesce("project_id", "_through")).filter("project_id is not null")
    counted = own.groupBy("project_id").agg(F.count("*").alias("runs"))
    scope = F.struct("document_id", F.when(F.col("document_id").isNull(), F.col("project_id")))
    current = latest(own.filter("state = 'complete'").withColumn("_scope", scope), ["_scope"], F.desc("started_at"), F.col("run_id")).select("run_id", "project_id")
    waiting = findings.filter("reviewer_state = 'pending' and verdict <> 'absent'").join(current, "run_id").groupBy("project_id").agg(F.count("*").alias("unreviewed"))
    out = projects
    for part in (designs, counted, waiting):
        out = out.join(part, "project_id", "left")
    return out.na.fill(0, ["designs", "ready", "runs", "unreviewed"])


def outcome_snapshot(findings: DataFrame, verdicts: list[str]) -> DataFrame:
    """What a run's report showed: findings by verdict as a map with all verdicts, pending ones, and all; absent ones aren't shown."""
    shown = findings.filter("verdict <> 'absent'").groupBy("run_id")
    counts = shown.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in verdicts), F.count_if(F.col("reviewer_state") == "pending").alias("unreviewed"), F.count("*").alias("total"))
    return counts.select("run_id", F.create_map(*(x for v in verdicts for x in (F.lit(v), F.col(v)))).alias("verdicts"), "unreviewed", "total")


def claimed_groups(groups: DataFrame, least: int = 2) -> DataFrame:
    """(run_id, place, label, findings): groups (run_id, place, label, findings) less findings that an earlier group claimed.

    The first group that may keep a finding has it; a group left with fewer than least, or without a label, goes and claims
    nothing. What a group keeps depends on the groups before it, so a run's few groups are folded in order by one aggregate.
    """
    row = F.struct("place", F.trim(F.regexp_replace(F.coalesce("label", F.lit("")), r"\s+", " ")).alias("label"), F.array_distinct("findings").alias("findings"))

    def step(kept, group):
        taken = F.flatten(F.transform(kept, lambda k: k["findings"]))
        left = F.array_except(group["findings"], taken)
        good = (F.size(left) >= least) & (group["label"] != "")
        return F.when(good, F.concat(kept, F.array(F.struct(group["place"].alias("place"), group["label"].alias("label"), left.alias("findings"))))).otherwise(kept)

    lists = groups.groupBy("run_id").agg(F.array_sort(F.collect_list(row)).alias("g"))
    kept = lists.select("run_id", F.explode(F.aggregate("g", F.filter("g", lambda _: F.lit(False)), step)).alias("k"))
    return kept.select("run_id", "k.place", "k.label", "k.findings")
