"""Evidence: quotes against pages, coverage gaps, placed tables, rules against lines, lifecycle of products."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import dates, lexical, text
from attestry.lineage import cut
from attestry.operators import fidelity


#: Pieces of needles that are held against texts in their rows.
PROBES = 20_000


def with_compatible(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with these string columns in Unicode's compatibility form, composed; columns of ASCII pass through untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in columns:
                said = batch.column(name)
                if not pc.all(pc.string_is_ascii(said)).as_py() and len(batch):
                    new = [x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in said.to_pylist()]
                    batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(new, said.type))
            yield batch

    return rows.mapInArrow(run, rows.schema)


def page_stretches(pages: DataFrame) -> DataFrame:
    """Pages (document_id, page, text) made ready for quotes, alone and with the page after joined on; each text is made ready once."""
    w = Window.partitionBy("document_id").orderBy("page")
    rows = with_compatible(pages.select("document_id", "page", "text"), "text").select("document_id", "page", text.searchable(F.col("text")).alias("one"))
    following = F.when(F.lead("page").over(w) == F.col("page") + 1, F.lead("one").over(w))
    # A page ends a word, so both together are the one's words and then the other's.
    return rows.withColumn("_next", following).select("document_id", "page", "one", F.concat(F.lit(" "), F.trim(F.concat(F.trim("one"), F.lit(" "), F.trim("_next"))), F.lit(" ")).alias("both"))


def verify_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, quote_id, page): where a quote stands; the named page first, then any, then over a page end; null if nowhere.

    Quotes meet the pages of their own document that have their longest word; pages and quotes are normalised once each.
    """
    ready = with_compatible(quotes.select("document_id", "quote_id", F.col("page").alias("named"), "quote"), "quote")
    ready = ready.select("document_id", "quote_id", "named", text.quote_parts(F.col("quote")).alias("parts")).filter(F.size("parts") > 0)
    words = F.transform(F.split(F.array_join("parts", " "), " "), lambda x: F.struct(F.length(x).alias("n"), x.alias("word")))
    ready = cut(ready.withColumn("probe", F.array_max(words)["word"]))
    probes = ready.select("probe").distinct().limit(PROBES + 1).collect()
    stretch = page_stretches(pages)
    own = F.split(F.trim(F.coalesce("both", "one")), " ")
    if len(probes) <= PROBES:  # few: a page is looked through in its row
        own = F.array_intersect(own, F.array(*(F.lit(r["probe"]) for r in probes)).cast("array<string>"))
    met = stretch.withColumn("probe", F.explode(F.array_distinct(own))).join(F.broadcast(ready) if ready.count() <= PROBES else ready, ["document_id", "probe"])
    whole = text.parts_in(F.col("parts"), F.col("one"))
    rank = F.when(whole & (F.col("page") == F.col("named")), 0).when(whole, 1).when(text.parts_in(F.col("parts"), F.col("both")), 2)
    best = met.withColumn("rank", rank).filter(F.col("rank").isNotNull()).groupBy("document_id", "quote_id").agg(F.min_by("page", F.struct("rank", "page")).alias("page"))
    return quotes.select("document_id", "quote_id").join(best, ["document_id", "quote_id"], "left")


def split_quotes(quotes: DataFrame, most: int = 8) -> DataFrame:
    """An answer's first quotes (quotes: array), at most so many, each sentence as a quote of its own: all of them are checked."""
    each = quotes.select("*", F.posexplode(F.slice("quotes", 1, most)).alias("n", "quote"))
    return each.withColumn("part", F.explode(F.filter(F.split("quote", r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")))


def sound(verified: DataFrame) -> DataFrame:
    """Answers all of whose quotes stand somewhere: one invented sentence refuses all."""
    return verified.groupBy("answer_id").agg(F.every(F.col("page").isNotNull()).alias("sound"))


def containing(needles: DataFrame, hay: DataFrame, gram: int = 12) -> DataFrame:
    """(needle_id, hay_id): where a needle's text is part of a hay text, met by shared pieces rather than pair by pair.

    A hay text is cut into pieces of gram characters from its start; wherever a needle of 2 gram - 1
    characters or more lies, it covers a whole piece, so its pieces at gram offsets are its probes.
    """
    shortest = needles.agg(F.min(F.length("needle"))).first()[0] or 1
    gram = max(1, min(gram, (shortest + 1) // 2))
    piece = lambda x: F.regexp_extract_all(x, F.lit(f"(?s)(.{{{gram}}})"), 1)
    offsets = F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda i: F.try_element_at(piece(F.substr("needle", i)), F.lit(1)))
    probe = needles.select("needle_id", F.explode(F.array_distinct(F.array_compact(offsets))).alias("g"))
    if probe.count() > PROBES:
        pieces = hay.select("hay_id", F.explode(F.array_distinct(piece(F.col("hay")))).alias("g"))
        pairs = pieces.join(probe, "g").select("needle_id", "hay_id").distinct()
        return pairs.join(needles, "needle_id").join(hay, "hay_id").filter(F.contains("hay", "needle")).select("needle_id", "hay_id")
    # Few probes: a text is looked through in its row and leaves it only with pieces that some needle has.
    known = F.array(*(F.lit(r["g"]) for r in probe.select("g").distinct().collect()))
    found = hay.select("hay_id", "hay", F.explode(F.array_intersect(piece(F.col("hay")), known.cast("array<string>"))).alias("g"))
    met = found.join(F.broadcast(probe.join(needles, "needle_id")), "g").filter(F.contains("hay", "needle"))
    return met.select("needle_id", "hay_id").distinct()


def rehome(gaps: DataFrame, sections: DataFrame) -> DataFrame:
    """Gaps (gap_id, document_id, section, quote, what): a quote must stand in the named section, or in exactly one other."""
    bodies = sections.select("document_id", F.col("section").alias("home"), text.searchable(F.col("text")).alias("body"))
    met = gaps.withColumn("parts", text.quote_parts(F.col("quote"))).join(bodies, "document_id").filter(text.parts_in(F.col("parts"), F.col("body")))
    homes = met.groupBy("gap_id").agg(F.bool_or(F.col("home") == F.col("section")).alias("own"), F.count("*").alias("n"), F.min("home").alias("home"))
    good = homes.filter("own or n = 1")
    out = gaps.join(good, "gap_id").withColumn("section", F.when(F.col("own"), F.col("section")).otherwise(F.col("home")))
    return out.filter(~text.vague_gap(F.col("what"))).drop("own", "n", "home").withColumn("_k", text.normalise(F.col("what"))).dropDuplicates(["document_id", "section", "_k"]).drop("_k")


def cited_row(rows: DataFrame, excerpts: DataFrame) -> DataFrame:
    """The one table row with most cell values (three characters or more) in an excerpt; a tie gives none."""
    cells = rows.select("table_id", "row", F.explode("cells").alias("cell")).filter(F.length("cell") >= 3)
    hits = excerpts.join(cells, "table_id").filter(F.contains(F.lower("excerpt"), F.lower("cell"))).groupBy("excerpt_id", "row").count()
    w = Window.partitionBy("excerpt_id").orderBy(F.desc("count"))
    top = hits.withColumn("r", F.rank().over(w)).filter("r = 1")
    return top.groupBy("excerpt_id").agg(F.min("row").alias("row"), F.count("*").alias("n")).filter("n = 1").drop("n")


def check_rules(refs: DataFrame, lines: DataFrame, spans: DataFrame, far: int = 5) -> DataFrame:
    """Readings of rules (rule_id, document_id, ordinals): members beyond the document or far outside the rule's span are dropped and counted."""
    each = refs.select("rule_id", "document_id", F.explode("ordinals").alias("ordinal"))
    met = each.join(lines.select("document_id", "ordinal", "text"), ["document_id", "ordinal"], "left").join(spans, "rule_id")
    bad = F.col("text").isNull() | (F.col("ordinal") < F.col("first") - far) | (F.col("ordinal") > F.col("last") + far)
    ordered = F.array_sort(F.collect_list(F.when(~bad, F.struct("ordinal", "text"))))
    return met.groupBy("rule_id", "document_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.count_if(bad).alias("dropped"), F.count("*").alias("named"))


def reading_accepted(checked: DataFrame, covered: DataFrame, most_bad: float = 0.10, least: float = 0.85) -> DataFrame:
    """Whether a document's reading stands: few bad references, something read, lines covered."""
    share = checked.groupBy("document_id").agg((F.sum("dropped") / F.sum("named")).alias("bad"), F.count("*").alias("rules"))
    return share.join(covered, "document_id").withColumn("accepted", (F.col("bad") <= most_bad) & (F.col("rules") > 0) & (F.col("covered") >= least))


def one_part_each(members: DataFrame) -> DataFrame:
    """A line named by several parts of a rule stays in the first of statement, requirements, rationale, guidance."""
    rank = F.array_position(F.array(*map(F.lit, ["statement", "requirements", "rationale", "guidance"])), F.col("part"))
    return members.groupBy("rule_id", "ordinal").agg(F.min_by("part", rank).alias("part"))


def uncovered(lines: DataFrame, covered: DataFrame) -> DataFrame:
    """Lines that no rule or label covers, by document, with how many state a duty; high if any does or a fiftieth of all is left."""
    rest = lines.join(covered, ["document_id", "ordinal"], "left_anti").groupBy("document_id").agg(F.count("*").alias("left"), F.count_if(F.col("text").rlike(text.DUTY)).alias("duties"))
    whole = lines.groupBy("document_id").agg(F.count("*").alias("lines"))
    out = whole.join(rest, "document_id", "left").na.fill(0, ["left", "duties"])
    return out.withColumn("severity", F.when((F.col("duties") > 0) | (F.col("left") >= 0.02 * F.col("lines")), "high").otherwise("low"))


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one reading only, with the side that has them."""
    return a.join(b, keys, "left_anti").select(*keys, F.lit("first").alias("side")).unionByName(b.join(a, keys, "left_anti").select(*keys, F.lit("second").alias("side")))


def release_of(products: DataFrame, lines: DataFrame) -> DataFrame:
    """line, eol, support of a stated version: the longest line that is a dotted prefix of it; 1.8 is also tried as 8.

    A version less specific than the lines has none; the lines it could be are given as wider.
    """
    number = F.nullif(F.regexp_extract("version", r"[0-9]+(?:\.[0-9]+)*", 0), F.lit(""))
    prefixes = lambda v: F.transform(F.sequence(F.lit(1), F.size(F.split(v, "[.]"))), lambda i: F.array_join(F.slice(F.split(v, "[.]"), F.lit(1), i), "."))
    own = products.withColumn("_v", number)
    old = F.when(F.col("_v").startswith("1.") & (F.length("_v") > 2), prefixes(F.substr("_v", F.lit(3)))).otherwise(F.array().cast("array<string>"))
    tries = F.concat(F.transform(prefixes(F.col("_v")), lambda p: F.struct(F.lit(1).alias("band"), p.alias("line"))), F.transform(old, lambda p: F.struct(F.lit(0).alias("band"), p.alias("line"))))
    met = own.filter("_v is not null").select("product_id", "product", F.explode(tries).alias("t")).select("product_id", "product", "t.band", "t.line").join(lines, ["product", "line"])
    best = met.groupBy("product_id").agg(F.max_by(F.struct("line", "eol", "support"), F.struct("band", F.length("line"))).alias("r"))
    wide = own.join(lines.select("product", F.col("line").alias("_l")), "product").filter(F.startswith("_l", F.concat("_v", F.lit(".")))).groupBy("product_id").agg(F.array_sort(F.collect_set("_l")).alias("wider"))
    out = products.join(best, "product_id", "left").join(wide, "product_id", "left")
    none = F.array().cast("array<string>")
    return out.select(*products.columns, "r.line", "r.eol", "r.support", F.when(F.col("r").isNull(), F.coalesce("wider", none)).otherwise(none).alias("wider"))


def technology(products: DataFrame, lines: DataFrame, today) -> DataFrame:
    """Products with their release line and its status; unknown without a line."""
    state = dates.lifecycle_status(F.col("eol"), F.col("support"), today)
    return release_of(products, lines).withColumn("status", F.when(F.col("line").isNotNull(), state["status"]).otherwise("unknown")).withColumn("security_only", F.col("line").isNotNull() & state["security_only"])


def support_facts(technologies: DataFrame) -> DataFrame:
    """What advice may say of a document's products: ended or ending rows with a version and a line to move to."""
    rows = technologies.filter(F.col("status").isin("ended", "ending") & F.col("version").isNotNull() & F.col("move_to").isNotNull())
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct("name", "version", "status", "move_to"))).alias("facts"))


def collapse_products(rows: DataFrame) -> DataFrame:
    """First row of a name and version, with the other titles that mention it."""
    key = [F.lower("name").alias("k"), F.col("version")]
    w = Window.partitionBy(F.lower("name"), "version").orderBy("ordinal")
    first = rows.withColumn("_r", F.row_number().over(w)).withColumn("k", F.lower("name"))
    titles = rows.groupBy(*key).agg(F.array_sort(F.collect_set("title")).alias("titles"))
    return first.filter("_r = 1").join(titles, (first["k"] == titles["k"]) & first["version"].eqNullSafe(titles["version"])).select("name", first["version"], "title", F.array_except("titles", F.array("title")).alias("also_in"))


def figures_by_section(figures: DataFrame, sections: DataFrame) -> DataFrame:
    """Figures with the section of their document on whose pages they stand, the last that begins there or before."""
    met = figures.join(sections.select("document_id", "section", "first_page"), "document_id").filter(F.col("first_page") <= F.col("page"))
    best = met.groupBy("document_id", "figure_id").agg(F.max_by("section", F.struct("first_page", "section")).alias("section"))
    return figures.join(best, ["document_id", "figure_id"], "left")


def covered_words(passage, cells):
    """The share of a passage's content words that the cells hold."""
    words = lexical.content_words(passage)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, lexical.content_words(cells))) / F.size(words)).otherwise(0.0)


def tables_for(chunks: DataFrame, clauses: DataFrame, tables: DataFrame, share: float = 0.8) -> DataFrame:
    """(chunk_id, table_id): the table that a passage (chunk_id, source_kind, source_id, text) is, or was flattened from.

    A table or a row of one names its table. A section, or a clause by its section, is taken for a table if just one of the
    section's tables (table_id, section_id, cells) holds share of its content words.
    """
    named = chunks.filter(F.col("source_kind").isin("table", "table_row"))
    direct = named.join(tables.select(F.col("table_id").alias("source_id"), "table_id"), "source_id").select("chunk_id", "table_id")
    of_section = chunks.filter("source_kind = 'section'").select("chunk_id", "text", F.col("source_id").alias("section_id"))
    of_clause = chunks.filter("source_kind = 'clause'").join(clauses.select(F.col("clause_id").alias("source_id"), "section_id"), "source_id").select("chunk_id", "text", "section_id")
    met = of_section.unionByName(of_clause).join(tables.select("table_id", "section_id", F.array_join("cells", " ").alias("said")), "section_id")
    made = met.filter(covered_words(F.col("text"), F.col("said")) >= share).groupBy("chunk_id").agg(F.min("table_id").alias("table_id"), F.count("*").alias("n"))
    return direct.unionByName(made.filter("n = 1").select("chunk_id", "table_id"))


def evidence_order(evidence: DataFrame) -> DataFrame:
    """place of each cited passage (finding_id, at, breach_quote, document_title, rationale): the breach, then designs that the rationale names, then the rest, in the order given."""
    title = F.trim(F.coalesce("document_title", F.lit("")))
    names = (title != "") & F.contains(F.concat(F.lit(" "), text.normalise(F.col("rationale")), F.lit(" ")), F.concat(F.lit(" "), text.normalise(title), F.lit(" ")))
    band = F.when(F.coalesce("breach_quote", F.lit("")) != "", 0).when(names, 1).otherwise(2)
    return evidence.withColumn("place", F.row_number().over(Window.partitionBy("finding_id").orderBy(band, "at")))


def fold_evidence(evidence: DataFrame, share: float = 0.8, same: float = 0.9) -> DataFrame:
    """A finding's passages (finding_id, at, document_id, table_id, rows, figure_id, excerpt, cells) as cards, in order.

    A table is one card with all rows that were cited of it. A passage without table or figure goes if a table shown for its
    document holds share of its words. Of two passages of a document that each hold same of the other's words the longer
    stays, at the first one's place. What stays depends on what stayed before: a finding's few passages are folded in order.
    """
    key = F.when(F.col("table_id").isNotNull(), F.concat(F.lit("t"), F.col("table_id").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("at").cast("string")))
    cards = evidence.withColumn("_key", key).groupBy("finding_id", "document_id", "_key").agg(
        F.min("at").alias("at"), F.first("table_id").alias("table_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rows")))).alias("rows"), F.first("figure_id").alias("figure_id"),
        F.min_by("excerpt", "at").alias("excerpt"), F.array_join(F.flatten(F.collect_list("cells")), " ").alias("said"),
    )
    shown = cards.filter("table_id is not null").groupBy("finding_id", "document_id").agg(F.collect_list("said").alias("tables"))
    rows = cards.join(shown, ["finding_id", "document_id"], "left").withColumn("words", lexical.content_words(F.col("excerpt")))
    own = F.col("table_id").isNotNull() | F.col("figure_id").isNotNull()
    twin = F.exists(F.coalesce("tables", F.array().cast("array<string>")), lambda t: covered_words(F.col("excerpt"), t) >= share)
    card = F.struct("at", own.alias("own"), "document_id", "words", "excerpt", "table_id", "rows", "figure_id")
    lists = rows.filter(own | ~twin).groupBy("finding_id").agg(F.array_sort(F.collect_list(card)).alias("c"))

    def step(kept, x):
        both = lambda k: F.size(F.array_intersect(k["words"], x["words"]))
        alike = lambda k: ~k["own"] & ~x["own"] & (k["document_id"] == x["document_id"]) & (F.size(k["words"]) > 0) & (both(k) >= same * F.size(k["words"])) & (both(k) >= same * F.size(x["words"]))
        longer = lambda k: F.when(alike(k) & (F.size(x["words"]) > F.size(k["words"])), x.withField("at", k["at"])).otherwise(k)
        return F.when(F.exists(kept, alike), F.transform(kept, longer)).otherwise(F.concat(kept, F.array(x)))

    out = lists.select("finding_id", F.posexplode(F.aggregate("c", F.filter("c", lambda _: F.lit(False)), step)).alias("place", "k"))
    return out.select("finding_id", "place", "k.document_id", "k.table_id", "k.rows", "k.figure_id", "k.excerpt")


def to_confirm(findings: DataFrame, size: int = 25) -> DataFrame:
    """(design, batch, findings): what each design is read whole for: absent clauses, and partial or not assessable ones said to be missing; so many a call."""
    asked = findings.filter((F.col("verdict") == "absent") | (F.col("verdict").isin("partial", "not_assessable") & fidelity.omission(F.col("rationale"))))
    n = F.row_number().over(Window.partitionBy("run_id", "design").orderBy("clause_ordinal", "clause_id")) - 1
    rows = asked.withColumn("batch", F.floor(n / size).cast("int")).withColumn("number", (n % size + 1).cast("int"))
    return rows.select("run_id", "design", "batch", "number", "clause_id")


def adopt_confirmations(findings: DataFrame, batches: DataFrame, answers: DataFrame, pages: DataFrame, confidence: float = 0.7) -> DataFrame:
    """findings (run_id, design, clause_id, verdict, confidence, rationale) with the verdicts that a second reading overturned.

    answers: run_id, design, document_id, batch, number, verdict, quote, page, rationale. A finding moves only to a known verdict
    other than absent, and only if the quote stands in the document; of several such answers the first number's counts.
    """
    known = answers.filter(F.lower(F.trim("verdict")).isin("covered", "partial", "contradicts", "not_assessable", "not_applicable", "needs_review"))
    met = known.join(batches, ["run_id", "design", "batch", "number"]).withColumn("quote_id", F.xxhash64("run_id", "design", "clause_id", "quote"))
    stands = verify_quotes(met.select("document_id", "quote_id", "quote", "page").dropDuplicates(["document_id", "quote_id"]), pages).filter("page is not null")
    good = met.join(stands.select("document_id", "quote_id"), ["document_id", "quote_id"], "left_semi")
    new = good.groupBy("run_id", "design", "clause_id").agg(F.min_by(F.struct(F.lower(F.trim("verdict")).alias("verdict"), "rationale"), F.struct("batch", "number", "quote_id")).alias("new"))
    out = findings.join(new, ["run_id", "design", "clause_id"], "left")
    moved = F.col("new").isNotNull()
    return out.withColumns({"verdict": F.coalesce("new.verdict", "verdict"), "rationale": F.coalesce("new.rationale", "rationale"), "confidence": F.when(moved, confidence).otherwise(F.col("confidence")), "confirmed": moved}).drop("new")


def check_advice(advice: DataFrame, sections: DataFrame, refs: DataFrame) -> DataFrame:
    """Suggestions (document_id, advice_id, title, recommendation, section, component, kind, quote, clauses) with reason, null for those that stand.

    A suggestion must say something, do something, and name its component in its section; its quote must stand there or in
    just one other section, to which it then moves; a change (kind improve) needs one. Without a quote a component that its
    section lacks must stand in just one other. References to clauses not on record (refs) go; of equal titles the first stays.
    """
    ready = sections.select("document_id", F.col("section").alias("home"), text.searchable(F.col("text")).alias("body"))
    asked = advice.withColumn("_parts", text.quote_parts(F.coalesce("quote", F.lit("")))).withColumn("_name", text.quote_parts(F.coalesce("component", F.lit(""))))
    met = asked.join(ready, "document_id")
    has_quote = F.size("_parts") > 0
    own = F.col("home") == F.col("section")
    quoted, named = has_quote & text.parts_in(F.col("_parts"), F.col("body")), text.parts_in(F.col("_name"), F.col("body"))
    facts = met.groupBy("document_id", "advice_id").agg(
        F.bool_or(own).alias("known"), F.bool_or(own & quoted).alias("quoted_here"), F.array_sort(F.collect_set(F.when(quoted, F.col("home")))).alias("quoted_in"), F.array_sort(F.collect_set(F.when(named, F.col("home")))).alias("named_in"),
    )
    rows = asked.join(facts, ["document_id", "advice_id"], "left")
    one = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    by_quote = F.when(F.col("quoted_here"), F.col("section")).otherwise(one(F.col("quoted_in")))
    by_name = F.when(F.array_contains("named_in", F.col("section")), F.col("section")).otherwise(one(F.col("named_in")))
    home = F.when(has_quote, by_quote).otherwise(by_name)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = (
        F.when(blank("title") | blank("recommendation"), "empty").when(text.generic(F.col("recommendation")), "generic").when(~F.coalesce("known", F.lit(False)), "unknown section")
        .when(F.size("named_in") == 0, "unanchored").when(has_quote & home.isNull(), "quote not found").when(~has_quote & (F.col("kind") == "improve"), "missing quote").when(home.isNull(), "unanchored")
    )
    rows = rows.withColumn("reason", reason).withColumn("section", F.coalesce(home, "section")).withColumn("_title", text.normalise(F.col("title")))
    first = F.row_number().over(Window.partitionBy("document_id", "_title", F.col("reason").isNull()).orderBy("advice_id"))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), "duplicate").otherwise(F.col("reason")))
    on_record = refs.groupBy("document_id").agg(F.collect_set("ref").alias("_refs"))
    rows = rows.join(on_record, "document_id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("clauses", F.array_intersect(F.coalesce("clauses", none), F.coalesce("_refs", none))).select(*advice.columns, "reason")


def reading_statistics(lines: DataFrame, members: DataFrame, labels: DataFrame, checked: DataFrame) -> DataFrame:
    """Of each document's reading: lines, those covered by a rule or a label, those in rules, rules, requirements, labelled ones by label, numbers checked and invalid."""
    in_rules = members.join(lines.select("document_id", "ordinal"), ["document_id", "ordinal"], "left_semi")
    covered = in_rules.select("document_id", "ordinal").unionByName(labels.join(lines, ["document_id", "ordinal"], "left_semi").select("document_id", "ordinal")).distinct()
    count = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(name))
    by_label = labels.groupBy("document_id", "label").count().groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "count")))).alias("labelled"))
    numbers = checked.groupBy("document_id").agg(F.sum("named").alias("numbers_checked"), F.sum("dropped").alias("numbers_invalid"))
    rules = members.groupBy("document_id").agg(F.count_distinct("rule_id").alias("rules"), F.count_distinct(F.when(F.col("part") == "requirements", F.struct("rule_id", "ordinal"))).alias("requirements"))
    out = count(lines, "lines")
    for part in (count(covered, "covered"), count(in_rules.select("document_id", "ordinal").distinct(), "in_rules"), rules, by_label, numbers):
        out = out.join(part, "document_id", "left")
    return out.na.fill(0, ["covered", "in_rules", "rules", "requirements", "numbers_checked", "numbers_invalid"])
