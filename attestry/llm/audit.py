"""Filter interaction audit: what each filter of a list removes, in every order of the filters.

Filters, each by its failure: A: under ``LEAST_WORDS`` words; B: distinct words under half of the words; C:
capitals over 2 % of the code points; D: a symbol; E: a text identical to one with a smaller doc_id. Each
document has a mask of the filters that it fails; masks are counted once a part, and the figures of all
orders follow from these counts.

Copies are found by partition refinement. Rows of a length, then of a length and a first block, a second
and so on are classes; a row alone in its class leaves at once, so later rounds hold ever fewer rows, and
only narrow ones (length and block hashes). Whole texts are compared last, of rows still sharing a class:
equal texts meet in each task before they are shuffled, so a copy that a third of all rows hold is no
burden. A class whose texts differ in spite of equal hashes is split by the texts themselves.

Defined cases: a null text is an empty one; a null source is the part ''; a row without doc_id is no one's
copy and has no copy; rows that repeat a doc_id are judged by their own texts, and equal ones aren't copies
of each other (neither id is smaller); a document has a label if any of its label rows says so; texts of
any length are read whole; an empty table gives no rows. Other columns of the tables aren't read.
"""

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import cut, let, words

FILTERS = "ABCDE"
LEAST_WORDS = 200
BLOCKS = (64, 1024)  # ends of the first blocks in code points; the last block is the rest
BROADCAST_IDS = 1_000_000


def block_hashes(text: Column, digest: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Hashes of a text's blocks, in order; a block that the text doesn't reach is empty."""
    starts = (0, *BLOCKS)
    sizes = [b - a for a, b in zip(starts, BLOCKS, strict=False)] + [2**31 - 1]
    return F.array(*[digest(F.substring(text, a + 1, n)) for a, n in zip(starts, sizes, strict=True)])


def own_failures(text: Column) -> Column:
    """The mask of the filters that look at one text: bits of A, B, C and D."""
    counts = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bit = lambda k, failed: F.when(failed, 1 << k).otherwise(0)
    by_words = let(counts, lambda c: bit(0, c["n"] < LEAST_WORDS) + bit(1, 100 * c["kinds"] < 50 * c["n"]))
    return by_words + bit(2, 100 * capitals.cast("long") > 2 * F.length(text)) + bit(3, text.rlike(r"[#$%&*|]"))


def _class(upto: int) -> Column:
    return F.xxhash64("length", F.slice("blocks", 1, upto))


def refined(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, length, blocks) that share length and all blocks with a row of another doc_id, and their class."""
    left = rows.filter("doc_id is not null").select("doc_id", "length", "blocks")
    for upto in range(len(BLOCKS) + 2):
        left = left.withColumn("class", _class(upto))
        shared = left.groupBy("class").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("class")
        left = cut(left.join(shared, "class", "left_semi"))
    return left.select("doc_id", "class")


def masks(documents: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, part, mask) for each row of documents (doc_id, text, source); E is the mask's highest bit."""
    whole = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    seen = [F.length("text").alias("length"), block_hashes(F.col("text"), digest).alias("blocks")]
    rows = cut(whole.select("doc_id", "part", own_failures(F.col("text")).alias("mask"), *seen))
    few = refined(rows)
    ids = few.select("doc_id").distinct()
    ids = F.broadcast(ids) if few.count() <= BROADCAST_IDS else ids
    texts = whole.join(ids, "doc_id", "left_semi").select("doc_id", "text", *seen).withColumn("class", _class(len(BLOCKS) + 1)).select("doc_id", "text", "class")
    kinds = texts.groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    firsts = cut(kinds.groupBy("class").agg(F.min("first").alias("first"), F.count("*").alias("kinds")))
    late = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    marked = rows.withColumn("class", _class(len(BLOCKS) + 1)).join(firsts, "class", "left")
    done = marked.filter("doc_id is null or kinds is null or kinds = 1").select("doc_id", "part", (F.col("mask") + late).alias("mask"))
    clash = firsts.filter("kinds > 1").select("class")
    if clash.isEmpty():
        return done
    # Different texts in one class: each row goes by its own text.
    again = whole.filter("doc_id is not null").select("*", own_failures(F.col("text")).alias("mask"), *seen).withColumn("class", _class(len(BLOCKS) + 1))
    again = again.join(clash, "class", "left_semi").join(kinds, ["class", "text"])
    return done.unionByName(again.select("doc_id", "part", (F.col("mask") + late).alias("mask")))


def audit(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """The figures of each part, order and step from (doc_id, part, mask) and labels (doc_id, quality, toxic)."""
    marks = labels.filter("quality = 1 or toxic = 1").groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    counts = judged.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # 32 masks a part at most.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    steps = parts.select("part", "masks", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda letters: F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda m, x: m + F.call_function("shiftleft", F.lit(1), F.ascii(x) - ord(FILTERS[0])))
    steps = steps.withColumns({"before": bits(F.expr("left(filter_order, step - 1)")), "own": bits(F.expr("substr(filter_order, step, 1)"))})

    def total(field: str, chosen: Callable[[Column], Column], share: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        add = lambda m: F.when(chosen(m["mask"]), m[field] * share(m["mask"])).otherwise(0)
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + add(m))

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    first = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    # Of k filters that a document fails each comes first in one of k orders.
    of_orders = lambda m: F.expr("120").cast("long") / F.bit_count(m)
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(own + before) == 0).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        total("n", fails, lambda m: of_orders(m).cast("long")).alias("shapley"),
    )
