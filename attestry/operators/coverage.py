"""Where the gaps that a reading reports stand in a document, and which of them are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.lineage import cut
from attestry.operators.evidence import page_stretches, with_compatible

# Gaps read of a document; words that identify a passage; lines that one line of a quote may stand for; words, numbers aside, that lines must have.
MOST_GAPS, QUOTE_WORDS, LINE_WINDOW, LINE_WORDS = 40, 4, 5, 2


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def leading(words: Column) -> Column:
    """The first two words of a text of words, or its only one."""
    return F.substring_index(words, " ", 2)


def grams(words: Column, single: bool = False) -> Column:
    """Distinct neighbours of a text of words; its single words too if asked."""

    def pairs(w):
        two = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.concat(two, w) if single else two)

    return let(F.split(F.trim(words), " "), pairs)


def within(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(document_id, needle, hay): texts of words (document_id, needle, words) that stand in others of their document (document_id, hay, words).

    They meet by the needle's first two words, so a document's texts aren't paired with each other.
    """
    probe = needles.filter("words <> ''").select("document_id", "needle", F.col("words").alias("_n"), leading(F.col("words")).alias("gram"))
    met = probe.join(hay.select("document_id", "hay", F.explode(grams(F.col("words"), single=True)).alias("gram")), ["document_id", "gram"])
    met = met.join(hay.select("document_id", "hay", F.col("words").alias("_h")), ["document_id", "hay"])
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return met.filter(F.contains(padded("_h"), padded("_n"))).select("document_id", "needle", "hay")


def phrases(gaps: DataFrame) -> DataFrame:
    """The candidates of each quote, in order: the whole, then its sentences; with their parts and the words they are looked up by.

    _quote is the quote in compatibility form.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    pieces = lambda c: F.filter(F.split(flat(c), r"(?<=[.!?;])\s+"), lambda x: F.trim(x) != "")
    both = lambda c: F.concat(F.array(flat(c)), F.when(F.size(pieces(c)) > 1, pieces(c)).otherwise(F.array().cast("array<string>")))
    each = gaps.withColumn("_said", both("quote")).select("document_id", "gap_id", "section", "_said", F.posexplode(both("_quote")).alias("k", "_form"))
    rows = each.withColumn("said", F.coalesce(F.get("_said", F.col("k")), "_form")).withColumn("parts", text.quote_parts(F.col("_form"))).drop("_said", "_form")
    count = lambda p: F.size(F.split(p, " "))
    enough = F.aggregate("parts", F.lit(0), lambda n, p: n + count(p)) >= QUOTE_WORDS
    sound = enough & ((F.size("parts") == 1) | F.forall("parts", lambda p: count(p) >= 2))
    longest = F.array_sort(F.transform("parts", lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    return rows.filter(sound).withColumn("gram", leading(F.get(longest, F.lit(0))["p"]))


def line_quote(quote: Column, lines: Column, normal: Column) -> Column:
    """A section's own lines for a quote made of them, joined, else null.

    Each line of the quote must be one to LINE_WINDOW consecutive lines of the section, or, if long enough, a phrase in them.
    quote is in compatibility form; normal are the lines as words.
    """
    pieces = F.filter(F.transform(F.split(quote, r"\r\n|\n|\r"), text.plain_words), lambda p: p != "")
    at = lambda size: F.when(F.size(normal) >= size, F.sequence(F.lit(1), F.size(normal) - size + 1)).otherwise(F.array().cast("array<int>"))
    window = lambda size: F.transform(at(size), lambda s: F.struct(s.alias("start"), F.lit(size).alias("size"), F.array_join(F.filter(F.slice(normal, s, F.lit(size)), lambda x: x != ""), " ").alias("words")))
    windows = F.concat(*[window(size) for size in range(1, LINE_WINDOW + 1)])
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))

    def match(p, ws):
        long_enough = F.size(F.split(p, " ")) >= QUOTE_WORDS
        return F.get(F.filter(ws, lambda w: (w["words"] == p) | (long_enough & F.contains(pad(w["words"]), pad(p)))), F.lit(0))

    def kept(found):
        places = F.flatten(F.transform(found, lambda m: F.sequence(m["start"], m["start"] + m["size"] - 1)))
        used = F.array_sort(F.array_distinct(F.filter(places, lambda i: F.get(normal, i - 1) != "")))

        def named(u):
            words = F.flatten(F.transform(u, lambda i: F.split(F.get(normal, i - 1), " ")))
            enough = F.size(F.filter(words, lambda w: ~w.rlike(r"^\d+$"))) >= LINE_WORDS
            return F.when(enough, F.array_join(F.transform(u, lambda i: F.get(lines, i - 1)), " · "))

        return F.when((F.size(found) > 0) & F.forall(found, lambda m: m.isNotNull()), let(used, named))

    return let(windows, lambda ws: let(F.transform(pieces, lambda p: match(p, ws)), kept))


def place_gaps(gaps: DataFrame, sections: DataFrame, pages: DataFrame, cited: DataFrame) -> DataFrame:
    """(document_id, gap_id, section, quote, by_lines, reason): each of a document's first gaps with its place; reason is null for those kept.

    gaps: document_id, gap_id (their order), section, quote, what; sections: document_id, section, lines (array); pages:
    document_id, page, text; cited: document_id, passage. A quote must be the document's words. It belongs to the named
    section if that has it, else to the only other one that has; a sentence of it will do. A quote that isn't found at all may
    be made of the named section's lines. What a cited passage says already goes, unless that is over three times as long;
    so do vague descriptions. A section has one gap: the first.
    """
    first = Window.partitionBy("document_id").orderBy("gap_id")
    gaps = gaps.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= MOST_GAPS)
    gaps = cut(with_compatible(gaps.withColumn("_quote", F.coalesce("quote", F.lit(""))), "_quote"))
    lines = F.transform(F.filter("lines", lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, "^(?:## |- )", ""))
    own = sections.select("document_id", F.col("section").alias("home"), lines.alias("lines"))
    own = with_compatible(own.withColumn("_all", F.array_join(F.transform("lines", lambda x: F.regexp_replace(x, r"[\r\n]", " ")), "\n")), "_all")
    own = cut(own.select("document_id", "home", "lines", F.transform(F.split("_all", "\n"), text.plain_words).alias("normal")))  # made once, used by all that follows
    ready = own.select("document_id", "home", F.array_join(F.filter("normal", lambda x: x != ""), " ").alias("words"))
    asked = cut(phrases(gaps))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    key = ["document_id", "gap_id", "k"]
    in_sections = asked.join(ready.select("document_id", "home", F.explode(grams(F.col("words"))).alias("gram")), ["document_id", "gram"]).join(ready, ["document_id", "home"]).filter(text.parts_in(F.col("parts"), pad("words")))
    stretches = page_stretches(pages).select("document_id", "page", F.coalesce("both", "one").alias("words"))
    on_pages = asked.join(stretches.select("document_id", "page", F.explode(grams(F.col("words"))).alias("gram")), ["document_id", "gram"]).join(stretches, ["document_id", "page"]).filter(text.parts_in(F.col("parts"), F.col("words")))
    homes = in_sections.groupBy(*key).agg(F.bool_or(F.col("home") == F.col("section")).alias("named"), F.collect_set(F.when(F.col("home") != F.col("section"), F.col("home"))).alias("others"))
    found = asked.join(on_pages.select(*key).distinct(), key).join(homes, key, "left")
    home = F.when(F.col("named"), F.col("section")).when(F.size("others") == 1, F.get("others", F.lit(0)))
    best = found.withColumn("home", home).groupBy("document_id", "gap_id").agg(F.min_by(F.when(F.col("home").isNotNull(), F.struct("home", "said")), F.when(F.col("home").isNotNull(), F.col("k"))).alias("by_phrase"))
    known = own.select("document_id", F.col("home").alias("section"), "lines", "normal")
    rows = gaps.join(best.withColumn("verified", F.lit(True)), ["document_id", "gap_id"], "left").join(known, ["document_id", "section"], "left")
    rows = rows.withColumn("by_line", F.when(F.col("verified").isNull() & F.col("lines").isNotNull(), line_quote(F.col("_quote"), F.col("lines"), F.col("normal"))))
    rows = rows.select(
        "document_id", "gap_id", "section", "what", "_n", F.coalesce("by_phrase.home", "section").alias("home"), F.coalesce("by_phrase.said", "by_line").alias("said"), F.col("by_line").isNotNull().alias("by_lines"),
        F.when(F.col("lines").isNull(), "unknownSection").when(F.coalesce("by_phrase.said", "by_line").isNotNull(), F.lit(None)).when(F.col("verified"), "outsideSection").otherwise("unverified").alias("why"),
    ).withColumn("words", text.normalise(F.col("said")))
    rows = cut(rows)
    said = rows.filter("said is not null").select("document_id", F.col("gap_id").alias("needle"), "words")
    passages = with_compatible(cited.select("document_id", "passage"), "passage").select("document_id", text.normalise(F.col("passage")).alias("words")).filter("words <> ''").distinct().withColumn("hay", F.xxhash64("words"))
    size = lambda df, name: df.select("document_id", name, F.length("words").alias(f"_{name}"))
    inside = within(said, passages).join(size(said, "needle"), ["document_id", "needle"]).join(size(passages, "hay"), ["document_id", "hay"]).filter("_hay <= 3 * _needle").select("document_id", F.col("needle").alias("gap_id"))
    around = within(passages.withColumnRenamed("hay", "needle"), said.withColumnRenamed("needle", "hay")).select("document_id", F.col("hay").alias("gap_id"))
    judged = inside.unionByName(around).distinct().withColumn("judged", F.lit(True))
    rows = rows.join(judged, ["document_id", "gap_id"], "left")
    why = F.coalesce("why", F.when(F.col("judged"), "alreadyJudged"), F.when(text.vague_gap(F.coalesce("what", F.lit(""))), "vague"))
    # A document's gaps are MOST_GAPS at most; what is kept depends on what was kept before.
    lists = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("_n", "gap_id", "section", "home", "said", "by_lines", why.alias("why")))).alias("g"))
    of = rows.schema["section"].dataType.simpleString()
    row = f"struct<gap_id:{rows.schema['gap_id'].dataType.simpleString()},section:{of},quote:string,by_lines:boolean,reason:string>"
    start = F.struct(F.array().cast(f"array<{of}>").alias("seen"), F.array().cast(f"array<{row}>").alias("out"))

    def step(s, g):
        again = (g["why"].eqNullSafe("unknownSection") == False) & (F.array_contains(s["seen"], g["section"]) | F.array_contains(s["seen"], g["home"]))  # noqa: E712
        reason = F.when(again, "repeated").otherwise(g["why"])
        one = F.struct(g["gap_id"].alias("gap_id"), g["home"].alias("section"), g["said"].alias("quote"), g["by_lines"].alias("by_lines"), reason.alias("reason"))
        seen = F.when(reason.isNull(), F.array_append(s["seen"], g["home"])).otherwise(s["seen"])
        return F.struct(seen.alias("seen"), F.concat(s["out"], F.array(one)).alias("out"))

    return lists.select("document_id", F.explode(F.aggregate("g", start, step, lambda s: s["out"])).alias("x")).select("document_id", "x.*")
