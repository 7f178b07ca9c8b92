"""Upserts, versions, caches, scopes and admission on immutable frames: append, then read the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The read view of an append-only table: the highest version of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces old by key."""
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows whose key is not there yet."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def live(rows: DataFrame) -> DataFrame:
    """Versions that none has superseded."""
    return rows.filter(F.col("superseded_by_id").isNull())


def supersede(clauses: DataFrame, drafts: DataFrame) -> DataFrame:
    """Apply drafts (clause_id, draft_id, statement): the old version points to the new one, which joins the table."""
    met = clauses.join(drafts.select("clause_id", "draft_id"), "clause_id", "left")
    old = met.withColumn("superseded_by_id", F.coalesce("superseded_by_id", "draft_id")).drop("draft_id")
    first = clauses.drop("statement", "superseded_by_id").join(drafts, "clause_id").withColumn("clause_id", F.col("draft_id")).withColumn("superseded_by_id", F.lit(None).cast("string")).drop("draft_id")
    return old.unionByName(first)


def visible(decisions: DataFrame, project: str | None, as_of: Column) -> DataFrame:
    """Active, unexpired decisions of the whole organisation or of the own project; no project sees only the former."""
    own = F.lit(False) if project is None else F.coalesce(F.col("project_id") == project, F.lit(False))
    return decisions.filter((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)) & ((F.col("scope") == "organisation") | own))


def same_set(frameworks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, framework_id, version): a framework of the same documents is used again, else the next version."""
    have = frameworks.groupBy("name", "framework_id", "version").agg(F.array_sort(F.collect_set("document_id")).alias("docs"))
    want = wanted.groupBy("name").agg(F.array_sort(F.collect_set("document_id")).alias("docs"))
    match = want.join(have, ["name", "docs"]).groupBy("name").agg(F.max_by("framework_id", "version").alias("framework_id"), F.max("version").alias("version"))
    top = frameworks.groupBy("name").agg(F.max("version").alias("top"))
    out = want.select("name").join(match, "name", "left").join(top, "name", "left")
    return out.select("name", "framework_id", F.coalesce("version", F.coalesce("top", F.lit(0)) + 1).alias("version"))


def tasks(clauses: DataFrame, designs: DataFrame, alternatives: Column, done: DataFrame) -> DataFrame:
    """What is still to assess: clauses by designs if these are alternatives, else once for all, less what is done."""
    one = designs.withColumn("alt", alternatives).withColumn("design_key", F.when(F.col("alt"), F.col("document_id")).otherwise("all"))
    few = one.select("run_id", "design_key").distinct()
    return clauses.join(few, "run_id").join(done.select("run_id", "clause_id", "design_key"), ["run_id", "clause_id", "design_key"], "left_anti")


def ready_requests(requests: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Requests whose documents are all ready and indexed."""
    indexed = chunks.select("document_id").distinct().withColumn("has", F.lit(True))
    met = requests.join(documents, "request_id").join(indexed, "document_id", "left")
    return met.groupBy("request_id").agg(F.every((F.col("status") == "ready") & F.coalesce("has", F.lit(False))).alias("ready")).filter("ready").select("request_id")


def orphaned(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs in a live state with no job queued or leased."""
    going = jobs.filter(F.col("state").isin("queued", "leased"))
    return runs.filter(F.col("state").isin("queued", "running")).join(going.select("run_id"), "run_id", "left_anti")


def admission(people: DataFrame, members: DataFrame, roster: DataFrame) -> DataFrame:
    """How a person (email) enters: as a member, by invitation, blocked, or as founder."""
    out = people.join(members.select("email", F.lit(1).alias("m")).distinct(), "email", "left").join(roster.select("email", F.col("status").alias("s")), "email", "left")
    return out.select("email", F.when(F.col("m") == 1, "member").when(F.col("s") == "invited", "invited").when(F.col("s").isin("revoked", "blocked"), "blocked").otherwise("founder").alias("entry"))


def revoke(roster: DataFrame, emails: list[str]) -> DataFrame:
    """Revoke people, but never an organisation's last active owner."""
    named = F.col("email").isin(emails)
    stays = F.count_if((F.col("role") == "owner") & (F.col("status") == "active") & ~named).over(Window.partitionBy("organisation_id"))
    guarded = (F.col("role") == "owner") & (stays == 0)
    return roster.withColumn("status", F.when(named & ~guarded, "revoked").otherwise(F.col("status")))


def catalogue(models: DataFrame, each: int, pinned: list[str]) -> DataFrame:
    """The newest models of each vendor that can do the work, pinned ones first."""
    able = models.filter("capable").withColumn("r", F.row_number().over(Window.partitionBy("vendor").orderBy(F.desc("released"), "model")))
    pin = F.col("model").isin(pinned)
    return able.filter((F.col("r") <= each) | pin).withColumn("pinned", pin).drop("r").orderBy(F.desc("pinned"), "vendor", F.desc("released"), "model")


def reembed_plan(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """(organisation_id, lacking, stale, may_drop): old vectors go only when no chunk lacks a current one."""
    now = embeddings.filter(F.col("model") == model).select("chunk_id", F.lit(1).alias("cur")).distinct()
    old = embeddings.filter(~F.col("model").eqNullSafe(F.lit(model))).groupBy("chunk_id").agg(F.count("*").alias("old"))
    met = chunks.join(now, "chunk_id", "left").join(old, "chunk_id", "left")
    out = met.groupBy("organisation_id").agg(F.count_if(F.col("cur").isNull()).alias("lacking"), F.coalesce(F.sum("old"), F.lit(0)).alias("stale"))
    return out.withColumn("may_drop", (F.col("lacking") == 0) & (F.col("stale") > 0))


def compare_modes(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """Findings of two runs by clause: both verdicts and whether they agree; disagreements first, then by verdict and reference."""
    both = a.select("clause_ref", F.col("verdict").alias("first")).join(b.select("clause_ref", F.col("verdict").alias("second")), "clause_ref", "full")
    out = both.withColumn("agree", F.col("first").eqNullSafe(F.col("second")))
    rank = F.array_position(F.array(*map(F.lit, order)), F.coalesce("first", "second"))
    return out.orderBy("agree", F.when(rank == 0, len(order) + 1).otherwise(rank), "clause_ref")
