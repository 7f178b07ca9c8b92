"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

A document's set is its distinct five-word shingles (words lower-cased A-Z, split at ASCII white
space); a text of fewer words is one shingle of them all. Two documents are linked if 100 * |both| >=
75 * |either|, on full sets of 64-bit shingle hashes.

Signature: each shingle visits all ``SLOTS`` slots in an order of its own, a pseudo-random affine
permutation of the prime field, and leaves rank plus a uniform fraction; a slot keeps its least value.
With 241 * 240 such orders the squared error of an estimate is 0.4 to 0.7 times that of independent slots.
As ranks grow from visit to visit, a document stops as soon as no slot can still fall: after two or
three visits for most. ``BANDS`` bands of ``ROWS`` slots miss a pair at the threshold with probability
(1 - 0.75^5)^48, 2e-6. Texts with equal sets are one class from the start, so copies are never paired.

Defined cases: null texts and texts without words have no shingles and are linked with nothing; rows
without doc_id join their copies but link nothing themselves; rows that repeat a doc_id are one
document with several texts; one result row for each row of documents; an empty table gives none.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import cut, cut_counted
from attestry.llm.components import link

SHINGLE = 5
PERCENT = 75
SLOTS, BANDS, ROWS = 241, 48, 5
BROADCAST_IDS = 1_000_000
CHUNK = 120_000  # shingles sketched at once

_U = np.uint64
_STEP, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words; forgets them all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, found), _U, len(found))
    width = min(SHINGLE, len(found))
    if not width:
        return h
    n = len(h) - width + 1
    out = np.full(n, width, _U)
    for k in range(width):
        out = mix(out * _STEP + h[k : k + n])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of several non-empty sets: a row of SLOTS values each, rank in the upper 16 bits."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    least = np.full(len(sets) * SLOTS, np.iinfo(np.uint64).max, _U)
    first = (h % _U(SLOTS)).astype(np.int64)
    stride = ((h >> _U(20)) % _U(SLOTS - 1)).astype(np.int64) + 1
    base, slot = doc * SLOTS, first
    for rank in range(SLOTS):
        value = (mix(h + _U(0x9E3779B97F4A7C15 * (rank + 1) % 2**64)) >> _U(16)) | _U(rank << 48)
        np.minimum.at(least, base + slot, value)
        # Later visits leave rank + 1 and more: a document whose slots are all below is done.
        high = least.reshape(-1, SLOTS).max(axis=1)
        going = high >= _U((rank + 1) << 48)
        if not going.any():
            break
        slot = slot + stride
        slot -= SLOTS * (slot >= SLOTS)
        if not going.all():
            stay = going[doc]
            h, doc, base, slot, stride = h[stay], doc[stay], base[stay], slot[stay], stride[stay]
    return least.reshape(-1, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key a band from each signature row."""
    parts = signature[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=_U), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * _STEP + parts[:, :, k])
    return key


SKETCH = "doc_id long, version long, n_shingles long, d1 long, d2 long, bands array<long>"
SETS = "item long, shingles array<long>"


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in rows], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, _U)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, none = WordHashes(), np.empty(0, _U)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at = 0
        while at < len(texts):
            start, sets, total = at, [], 0
            while at < len(texts) and (total < CHUNK or not sets):
                sets.append(shingles(texts[at].as_py(), hashes))
                total += len(sets[-1])
                at += 1
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full)) if full else ())
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [ids.slice(start, at - start).cast(pa.int64()), batch.column(2).slice(start, at - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), _lists([next(keys) if len(s) else none for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "n_shingles", "d1", "d2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            rows = [shingles(t.as_py(), hashes) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), _lists(rows)], ["item", "shingles"])


def sketch(documents: DataFrame) -> DataFrame:
    """doc_id, version (the text's hash), n_shingles, a digest of the set (d1, d2) and its band keys; no keys for an empty set."""
    return documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(_sketch, SKETCH)


def verifier(documents: DataFrame):
    """Candidates (a, b) to those whose full sets meet the threshold."""

    def verify(pairs: DataFrame) -> DataFrame:
        sets = _texts_of(documents, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        side = lambda x: sets.select(F.col("item").alias(x), F.col("shingles").alias(f"s{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        # Sets whose sizes alone rule out the threshold are not intersected.
        n, m = F.size("sa").cast("long"), F.size("sb").cast("long")
        both = both.filter((100 * F.least(n, m) >= PERCENT * F.greatest(n, m)))
        common = F.size(F.array_intersect("sa", "sb")).cast("long")
        linked = both.select("a", "b", (n + m).alias("total"), common.alias("common"))
        return linked.filter(100 * F.col("common") >= PERCENT * (F.col("total") - F.col("common"))).select("a", "b").distinct()

    return verify


def _texts_of(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item, shingles) of the documents named in items (doc_id)."""
    items, n = cut_counted(items)
    wanted = F.broadcast(items) if n <= BROADCAST_IDS else items
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    return cut(texts.mapInArrow(_sets, SETS))


def profiler(documents: DataFrame):
    """For items: n, the size of the set; own, how many of its shingles no other of the items holds; sure, if it has one text."""

    def profile(items: DataFrame) -> DataFrame:
        sets = _texts_of(documents, items.select(F.col("item").alias("doc_id")))
        holders = sets.select("item", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("item").alias("item"), F.max("item").alias("last"))
        own = holders.filter("item = last").groupBy("item").agg(F.count("*").alias("own"))
        sizes = sets.groupBy("item").agg(F.max(F.size("shingles").cast("long")).alias("n"), (F.count("*") == 1).alias("sure"))
        return sizes.join(cut(own), "item", "left").select("item", F.struct("n", F.coalesce("own", F.lit(0)).cast("long").alias("own"), "sure").alias("p"))

    return profile


def possible(p: Column, q: Column) -> Column:
    """Whether two documents of these profiles can meet the threshold: what only one holds, they don't share."""
    most = F.least(p["n"] - p["own"], q["n"] - q["own"])
    return ~p["sure"] | ~q["sure"] | (100 * most >= PERCENT * (p["n"] + q["n"] - most))


def describer(documents: DataFrame):
    """For (item, ref): what the item's set lacks of ref's, what it has besides, and the size of ref's."""

    def describe(refs: DataFrame) -> DataFrame:
        sets = _texts_of(documents, refs.select(F.explode(F.array("item", "ref")).alias("doc_id")).distinct())
        # A document with several texts has no one difference.
        one = sets.groupBy("item").agg(F.count("*").alias("n")).filter("n = 1").select("item")
        sets = cut(sets.join(cut(one), "item"))
        met = refs.join(sets, "item").join(sets.select(F.col("item").alias("ref"), F.col("shingles").alias("whole")), "ref")
        d = F.struct("ref", F.size("whole").cast("long").alias("n"), F.array_except("whole", "shingles").alias("lacks"), F.array_except("shingles", "whole").alias("more"))
        return refs.select("item").join(met.select("item", d.alias("d")), "item", "left")

    return describe


def allowed(d: Column, e: Column) -> Column:
    """Exact for two documents with the same reference: their sets follow from their differences to it."""
    size = lambda x: F.size(x).cast("long")
    lacks = size(d["lacks"]) + size(e["lacks"]) - size(F.array_intersect(d["lacks"], e["lacks"]))
    common = d["n"] - lacks + size(F.array_intersect(d["more"], e["more"]))
    total = 2 * d["n"] - size(d["lacks"]) - size(e["lacks"]) + size(d["more"]) + size(e["more"])
    return F.when(d["ref"] == e["ref"], 100 * common >= PERCENT * (total - common)).otherwise(True)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, version (the text's hash), n_shingles, component_id (least doc_id reachable) and kept for each row of documents (doc_id, text)."""
    rows = cut(sketch(documents))
    full = rows.filter("n_shingles > 0")
    classes = cut(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("item"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
    keys = classes.filter("item is not null").select(F.explode("bands").alias("key"), "item")
    shared = keys.groupBy("key").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).filter("lo <> hi").select("key")
    members = cut(keys.join(cut(shared), "key", "left_semi"))
    named = link(members, verifier(documents), profiler(documents), possible, (describer(documents), allowed))
    # Copies and linked classes; all else is a component of its own.
    owner = classes.join(named, "item", "left").withColumn("component_id", F.coalesce("component", "item"))
    owner = cut(owner.filter("copies > 1 or component_id <> item").select("d1", "d2", "component_id"))
    out = rows.select("doc_id", "version", "n_shingles", "d1", "d2").join(owner, ["d1", "d2"], "left")
    out = out.select("doc_id", "version", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
