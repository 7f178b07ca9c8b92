"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word unigrams and bigrams (``BUCKETS`` buckets, add-one
smoothing): the trusted target (labelled quality 1 and not toxic) and the raw corpus (every document). A
document's score is the sum of log(p_target / p_raw) over its n-grams divided by their number. It is kept
if it passes the base rules and its score reaches the threshold.

The threshold is set on labelled rows: one in ``HELD`` trusted documents, by the hash of doc_id, isn't
counted in the target; those of them that pass the base rules are scored, and the threshold is the
``REJECTED`` quantile of their scores. Without such rows it is ``MIN_SCORE``.

Built-in expressions only. Counts cover all documents and all labels; ids meet by shuffle, whatever their
number. Defined cases: null and empty texts have no words and fail;
without trusted rows every score is 0; repeated rows give repeated results; repeated labels of a doc_id
count once, and as trusted if one of them is; n_words under 20 fails; a score at the threshold is kept; an
empty table gives an empty result.
"""

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import array_row, cut, let, words

BUCKETS = 1 << 16
SCALE = 10_000  # weights are whole ten-thousandths, so sums don't depend on their order
MIN_SCORE = -0.5
HELD, REJECTED = 4, 0.005
BINS = 4096  # counted at once in the search of a quantile


def hashes(toks: Column) -> Column:
    return F.transform(toks, lambda w: F.xxhash64(w))


def pairs(h: Column, apart: int = 1) -> Column:
    """Hashes of all elements with the one so many places on."""
    n = F.greatest(F.size(h) - apart, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))


def n_repeat_words(two: Column, width: int = 8) -> Column:
    """Words inside an 8-word window that the text holds at least twice, first places included; two: the pairs of the words' hashes."""

    def covered(h):  # h: window hashes by start
        def by_hash(s):  # s: (hash, start) in order; equal hashes are neighbours
            near = lambda i, d: F.get(s, i + F.lit(d)).getField("h")
            own = lambda x, i: (x.getField("h") == near(i, -1)) | (x.getField("h") == near(i, 1))
            starts = F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(own(x, i), F.lit(False))), lambda x: x.getField("at")))
            gap = lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width))),
                F.lit(0), lambda acc, x: acc + x,
            )
            return let(starts, gap)

        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), by_hash)

    # Pairs of pairs of pairs: eight words.
    windows = let(pairs(two, 2), lambda four: pairs(four, 4))
    return let(windows, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), covered(x)).otherwise(0)).cast("long")


def base_columns(text: Column, h: Column, two: Column) -> dict[str, Column]:
    """The counts of the base rules. text is not null; h are its words' hashes, two their pairs."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(h).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": n_repeat_words(two),
    }


def fails(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def grams(h: Column, two: Column) -> Column:
    """Buckets of a document's unigrams and bigrams, from its words' hashes and their pairs."""
    return F.transform(F.concat(h, two), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(HELD)) == 0


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held) of all trusted documents."""
    rows = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return cut(rows.select("doc_id").distinct().withColumn("held", held_out(F.col("doc_id"))))


def weights(documents: DataFrame, trusted: DataFrame) -> list[int]:
    """log(p_target / p_raw) of every bucket, in ten-thousandths; trusted: (doc_id)."""
    # Both sides are exchanged, so the number of trusted documents has no bound; buckets travel as two bytes each.
    target = trusted.withColumn("t", F.lit(1)).hint("shuffle_hash")
    small = lambda b: F.transform(b, lambda x: (x - F.lit(BUCKETS // 2)).cast("smallint"))
    rows = documents.select("doc_id", let(hashes(words(F.col("text"))), lambda h: let(pairs(h), lambda two: small(grams(h, two)))).alias("b")).join(target, "doc_id", "left")
    counts = rows.select(F.explode("b").alias("b"), F.coalesce("t", F.lit(0)).alias("t")).groupBy("b").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    found = counts.select((F.col("b") + F.lit(BUCKETS // 2)).alias("b"), "n", "t").collect()  # BUCKETS rows at most, whatever the corpus
    n, t = sum(r["n"] for r in found), sum(r["t"] for r in found)
    out = [0] * BUCKETS
    for r in found if t else ():
        out[r["b"]] = round(SCALE * (log((r["t"] + 1) / (t + BUCKETS)) - log((r["n"] + 1) / (n + BUCKETS))))
    return out


def scored(documents: DataFrame, weight: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep, the base counts and score, for each row of documents; weight: one row with the weights of all buckets, as _weight."""

    def parts(h, two):
        total = lambda b: let(F.col("_weight"), lambda w: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + F.get(w, x)))
        score = let(grams(h, two), lambda b: F.when(F.size(b) > 0, total(b) / (F.size(b) * SCALE)).otherwise(F.lit(0.0)))
        return F.struct(*(c.alias(k) for k, c in base_columns(F.col("_text"), h, two).items()), score.alias("score"))

    # As a literal the weights would stand in every text of every plan, some 400 kB each, which the driver keeps.
    rows = documents.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).crossJoin(F.broadcast(weight))
    # The generator makes a row's struct once; a projection would be merged into every place that uses it.
    return rows.select(*keep, F.explode(F.array(let(hashes(words(F.col("_text"))), lambda h: let(pairs(h), lambda two: parts(h, two))))).alias("_p")).select(*keep, "_p.*")


def quantile(rows: DataFrame, q: float) -> float | None:
    """The q quantile of score, as percentile() gives it, from counts of ever narrower bins; rows (score) are written. None without rows."""
    n, least, most = rows.agg(F.count("*"), F.min("score"), F.max("score")).first()

    def ranked(k: int) -> float:  # from 0
        low, high = least, most
        while low < high:
            at = F.least(F.floor((F.col("score") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
            bins = rows.filter(F.col("score").between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
            for x in sorted(bins.collect(), key=lambda x: x["at"]):  # BINS rows at most
                if k < x["n"]:
                    low, high = x["low"], x["high"]
                    break
                k -= x["n"]
        return low

    if not n:
        return None
    at = (n - 1) * q
    first = ranked(int(at))
    return first if at == int(at) else (int(at) + 1 - at) * first + (at - int(at)) * ranked(int(at) + 1)


def threshold(documents: DataFrame, held: DataFrame, weight: DataFrame) -> float:
    """The REJECTED quantile of the scores of held trusted documents that pass the base rules."""
    # Only texts that the hash holds out are exchanged, one in HELD.
    mine = documents.select("doc_id", "text").filter(held_out(F.col("doc_id").cast(held.schema["doc_id"].dataType)))
    rows = scored(mine.join(held.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi"), weight, ("doc_id",))
    found = quantile(cut(rows.filter(~fails(F.col("n_words"), F.col("n_repeat_words"))).select("score")), REJECTED)
    return MIN_SCORE if found is None else found


def quality(documents: DataFrame, labels: DataFrame, min_score: float | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row of documents: the columns of keep, the base counts, base_failed, score and kept."""
    trusted = trusted_ids(labels)
    weight = array_row(documents.sparkSession, "_weight", weights(documents, trusted.filter("not held").select("doc_id")))
    least = threshold(documents, trusted.filter("held"), weight) if min_score is None else min_score
    rows = scored(documents, weight, keep).withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
