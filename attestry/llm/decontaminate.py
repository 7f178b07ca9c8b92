"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item; an item with fewer words is one window.
Of every run of window words, documents and items keep the least k-gram hash; whatever window words
two texts share, both keep the same least hash there, so no shared window is missed. Kept hashes are
joined, and each meeting point is extended to the windows around it, compared word for word.

Built-in expressions only. A document's hashes leave its row only if a bit table of the benchmark's
hashes (fixed size at most) lets them through, so the join sees few rows. The benchmark's hashes are
broadcast up to ``BROADCAST_ROWS`` rows and joined by shuffle beyond. Defined cases: null and empty
texts have no words, no hits and no windows, an empty documents table gives an empty result; equal items each count; null item_ids give hits but no
item; an empty benchmark hits nothing; one result row for each row of documents, repeats included.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import cut, let, literal_array

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 500_000
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


MARK, ESCAPE = "\ue000", "\ue001"
# Capitals that lower() folds by their neighbours or to the same letter as another capital does.
APART = dict(zip("Σ\u03f4\u2126\u212b\u01c5\u01c8\u01cb\u01f2", "σθωå\u01c6\u01c9\u01cc\u01f3"))


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z, every other difference kept: equal results mean texts equal but for the case of A-Z.

    lower() is fast but folds other letters too. So ``MARK`` goes before each letter that it may change, and
    ``ESCAPE`` before the letters APART, folded one by one, and before marks in the text itself. One letter
    always gives one code and no code begins another, so a word's form depends on that word alone.
    """
    odd = F.regexp_replace(text, f"([{MARK}{ESCAPE}{''.join(APART)}])", f"{ESCAPE}$1")
    odd = F.translate(odd, "".join(APART), "".join(APART.values()))
    plain = F.when(text.rlike(f"[{MARK}{ESCAPE}{''.join(APART)}]"), odd).otherwise(text)
    marked = F.lower(F.regexp_replace(plain, r"([\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]])", f"{MARK}$1"))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(marked)


def alnum_words(text: Column) -> Column:
    return F.array_remove(F.split(fold_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def _from(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.size(a))


def _sliding(a: Column, width: int, join) -> Column:
    """join over every width neighbours of a, by doubling: whole arrays are shifted, none is cut out for each place."""

    def grown(one: Column, now: int) -> Column:
        if now == width:
            return F.slice(one, F.lit(1), F.size(one) - (width - 1))
        by = min(now, width - now)
        return let(F.zip_with(one, _from(one, by), join), lambda two: grown(two, now + by))

    return let(a, lambda x: grown(x, 1))


def _shape(length: int) -> tuple[int, int]:
    """Gram size and winnowing width for windows of so many words."""
    gram = min(GRAM, length)
    return gram, length - gram + 1


def _hashes(toks: Column, length: int) -> Column:
    """Hashes of the grams of a text of at least length words, by start."""
    gram, _ = _shape(length)
    # Neighbours that overlap are hashed together, so a hash still stands for exactly gram words.
    return _sliding(F.transform(toks, lambda w: F.xxhash64(w, F.lit(length))), gram, lambda a, b: F.xxhash64(a, b))


def _least(h: Column, length: int) -> Column:
    """The distinct hashes that winnowing keeps."""
    _, width = _shape(length)
    return F.array_distinct(_sliding(h, width, lambda a, b: F.least(a, b)))


def _points(toks: Column, length: int, passes=None) -> Column:
    """Kept hashes with their places and the words around: array of (len, hash, at, before, near)."""
    gram, width = _shape(length)

    def places(h):
        kept = _least(h, length) if passes is None else F.filter(_least(h, length), passes)

        def around(k):
            first = lambda i: F.greatest(i - (width - 1), F.lit(1))
            point = lambda i: F.struct(
                F.lit(length).alias("len"), F.get(h, i - 1).alias("hash"), i.alias("at"), (i - first(i)).alias("before"), F.slice(toks, first(i), i - first(i) + gram + width - 1).alias("near"),
            )
            return F.transform(F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_contains(k, F.get(h, i - 1))), point)

        return let(kept, lambda k: F.when(F.size(k) > 0, around(k)))

    none = F.array().cast("array<struct<len:int,hash:bigint,at:int,before:int,near:array<string>>>")
    return F.coalesce(F.when(F.size(toks) >= length, let(_hashes(toks, length), places)), none)


def fingerprints(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int], int]:
    """Item fingerprints, the window lengths that occur, and the number of fingerprints."""
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("toks")).withColumn("len", F.least(F.size("toks"), F.lit(window)))
    items = cut(items.filter("len > 0"))
    lengths = sorted(r["len"] for r in items.select("len").distinct().collect())  # window values at most
    none = items.filter("false").select("item_id", F.explode(_points(F.col("toks"), window)).alias("p"))
    rows = none
    for n in lengths:
        rows = rows.unionByName(items.filter(F.col("len") == n).select("item_id", F.explode(_points(F.col("toks"), n)).alias("p")))
    rows = cut(rows.select("item_id", F.col("p.len").alias("len"), F.col("p.hash").alias("hash"), F.col("p.at").alias("item_at"), F.col("p.before").alias("item_before"), F.col("p.near").alias("item_near")))
    return rows, lengths, rows.count()


def _bit_table(prints: DataFrame, n: int):
    """A test that every fingerprint's hash passes and most others don't: 2^12 to 2^20 bits by size."""
    bits = 1 << min(20, max(12, (64 * n).bit_length()))
    at = F.pmod(F.col("hash"), F.lit(bits))
    rows = prints.select(at.alias("at")).groupBy(F.shiftright("at", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("v"))
    words = [0] * (bits >> 5)
    for r in rows.collect():  # one row a word at most
        words[r["word"]] = r["v"]
    table = literal_array(words, "bigint")

    def passes(h):
        i = F.pmod(h, F.lit(bits))
        return F.call_function("shiftright", F.get(table, F.shiftright(i, 5).cast("int")), i.bitwiseAND(31).cast("int")).bitwiseAND(1) == 1

    return passes


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row of documents: keep, text_hash, n_words, n_hit, n_items, item_ids, hit_starts (start, len), contaminated."""
    prints, lengths, n = fingerprints(benchmark, window)
    passes = _bit_table(prints, n)
    # The generator makes a text's words once; a projection would be merged into every place that uses them.
    rows = documents.select(*keep, F.xxhash64("text").alias("text_hash"), F.explode(F.array(alnum_words(F.col("text")))).alias("toks"))
    points = F.concat(F.array(F.lit(None).cast("struct<len:int,hash:bigint,at:int,before:int,near:array<string>>")), *(_points(F.col("toks"), length, passes) for length in lengths))
    rows = rows.select(*keep, "text_hash", F.size("toks").cast("long").alias("n_words"), points.alias("p"))
    rows = rows.select(*keep, "text_hash", "n_words", F.explode("p").alias("p")).select(*keep, "text_hash", "n_words", "p.*")
    met = rows.join(F.broadcast(prints) if n <= BROADCAST_ROWS else prints, ["len", "hash"], "left")
    # A window around the point starts back words before it, in the document and in the item.
    length = F.col("len")
    inside = lambda back: (F.col("before") >= back) & (F.col("item_before") >= back)
    part = lambda near, before, back: F.slice(F.col(near), F.col(before) - back + 1, length)
    same = lambda back: inside(back) & (F.size(part("near", "before", back)) == length) & (part("near", "before", back) == part("item_near", "item_before", back))
    back = F.filter(F.sequence(F.lit(0), length - 1), lambda b: F.when(inside(b), same(b)).otherwise(False))
    starts = F.when(F.col("item_near").isNotNull(), F.transform(back, lambda b: F.struct((F.col("at") - b).alias("start"), length.alias("len"))))
    met = met.select(*keep, "text_hash", "n_words", F.col("at").isNull().alias("own"), F.col("item_id"), starts.alias("starts"))
    hit = F.size("starts") > 0
    out = met.groupBy(*keep, "text_hash", "n_words").agg(
        F.count_if("own").alias("copies"), F.collect_set(F.when(hit, F.col("item_id"))).alias("item_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(hit, F.col("starts")))))).alias("hit_starts"),
    )
    # Words under the union of the windows, swept by start.
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    end = lambda x: x.getField("start") + x.getField("len")
    sweep = lambda s, x: F.struct((s.getField("n") + F.greatest(end(x) - F.greatest(s.getField("upto"), x.getField("start")), F.lit(0))).alias("n"), F.greatest(s.getField("upto"), end(x)).alias("upto"))
    out = out.withColumn("n_hit", F.aggregate("hit_starts", state, sweep, lambda s: s.getField("n")))
    out = out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
    return out.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_row", "copies")


def items_digest() -> Column:
    """The items of a row of hits as one digest: ids as strings, sorted, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ","), 256)
