"""Hard negatives by product quantisation with stored residual norms.

A vector becomes whole numbers, floor(256 * x). Its index row holds a code for each pair of components, the
nearest of ``CENTROIDS`` centroids, and the norm of what the centroids leave over. For an anchor q the table
of its products with all centroids gives a row's approximate score, and |q| * norm bounds how far the exact
one can be from it (Cauchy-Schwarz; norms are stored a little larger, for rounding). So a row whose upper
bound is under the k-th best of lower bounds and exact scores so far can't be among the first k: it is left
out with certainty, and the others' exact integer scores complete each window. Results are exact.

Anchors are taken in blocks of about ``BLOCK``, each held against all rows: tasks read the index once for the
positives, whose scores (five an anchor at most) set the windows, and once for the negatives; each task sends
an anchor's first rows only. Centroids are fitted to about ``SAMPLE`` rows, a share by hash; this bounds the
driver's work and changes no result.

Defined cases: rows with a null vec_id, label or vector or a null or non-finite component take no part; of
vectors of several lengths the shorter ones end in zeros; scores are held within a long; a row that stands
several times takes as many places, but a repeated anchor is one, and rows with an anchor's vec_id aren't
its positives; ties go to the smaller vec_id; an anchor without positives has no rows; an empty table gives
an empty result. Other columns aren't read.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import cut, cut_each

SAMPLE, CENTROIDS, ROUNDS = 6_000, 256, 4
BLOCK = 4_096
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SEEDS = 4  # for each place, so many rows of the best approximate scores are scored first, which raises the floor
SCALE = 256
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LONG = 2**63


def dense(column: pa.ListArray, dims: int) -> np.ndarray:
    """Lists as rows of dims doubles, zeros at the end of shorter ones."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out


def pairs_of(x: np.ndarray) -> np.ndarray:
    """Rows as (subspace, 2); an odd last component is paired with zero."""
    x = np.pad(x, ((0, 0), (0, x.shape[1] % 2)))
    return x.reshape(len(x), x.shape[1] // 2, 2)


def nearest(books: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row in each subspace."""
    out = np.empty((len(x), len(books)), np.uint8)
    parts = pairs_of(x)
    for m, book in enumerate(books):
        with np.errstate(over="ignore", invalid="ignore"):
            out[:, m] = np.argmin((book * book).sum(1) - 2 * parts[:, m] @ book.T, axis=1)
    return out


def fit(x: np.ndarray) -> np.ndarray:
    """Centroids (subspace, CENTROIDS, 2) by k-means from evenly spaced rows in the order of their sums."""
    parts = pairs_of(x)
    books = np.zeros((parts.shape[1], CENTROIDS, 2))
    if not len(x):
        return books
    for m in range(parts.shape[1]):
        order = np.argsort(parts[:, m].sum(1), kind="stable")
        books[m] = parts[order[np.linspace(0, len(x) - 1, CENTROIDS).astype(int)], m]
    for _ in range(ROUNDS):
        codes = nearest(books, x)
        for m in range(len(books)):
            n = np.bincount(codes[:, m], minlength=CENTROIDS)
            sums = np.stack([np.bincount(codes[:, m], parts[:, m, d], CENTROIDS) for d in (0, 1)], axis=1)
            books[m][n > 0] = sums[n > 0] / n[n > 0, None]
    return books


def encode(books: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of rows and a bound on what they leave over, rounding of scores included."""
    codes, parts = nearest(books, x), pairs_of(x)
    rest = parts - books[np.arange(len(books)), codes]
    with np.errstate(over="ignore", invalid="ignore"):
        norm = lambda v: np.sqrt((v * v).sum((1, 2)))
        return codes, norm(rest) * (1 + 1e-9) + 1e-9 * (norm(parts) + 1)


def exact(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers within a long."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if most < 2**53:
        return (rows @ q).astype(np.int64)
    ints = [int(x) for x in q]
    dot = lambda r: sum(int(a) * b for a, b in zip(r, ints, strict=True))
    return np.array([min(max(dot(r), -_LONG), _LONG - 1) for r in rows], np.int64)


def window_of(score: int) -> tuple[int, int]:
    """The least and largest score s with LOW * score <= 100 * s <= HIGH * score."""
    return -(-LOW * score // 100), HIGH * score // 100


class Best:
    """The first k of (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, ~scores))[: self.k]  # ~s falls as s rises and can't overflow
        self.scores, self.ids = scores[order], ids[order]


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class Anchors:
    """A block of anchors: ids, labels, vectors and, for negatives, each one's windows (least, largest)."""

    def __init__(self, rows: list, dims: int, windows: list[list[tuple[int, int]]] | None = None):
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.q = np.zeros((len(rows), dims))
        for k, r in enumerate(rows):
            self.q[k, : len(r["q"])] = r["q"]
        self.windows = windows


def scan(block: Anchors, books: np.ndarray, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's first rows for each anchor, and for each of its windows if it has such: (anchor, part, id, score)."""
    flat_at = np.arange(len(books), dtype=np.int32) * CENTROIDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        near = block.windows is None
        best = [[Best(POSITIVES)] if near else [Best(NEGATIVES) for _ in block.windows[a]] for a in range(n)]
        length = np.sqrt((block.q * block.q).sum(1))
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            x, reach = dense(batch.column(2), dims), batch.column(4).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), len(books))
            slots = codes.astype(np.int32) + flat_at
            for label in np.unique(block.labels):
                own = np.flatnonzero((labels == label) if near else (labels != label))
                part = slots[own]
                for a in np.flatnonzero(block.labels == label):
                    if best[a]:
                        with np.errstate(over="ignore", invalid="ignore"):
                            table = np.einsum("mkd,md->mk", books, pairs_of(block.q[a : a + 1])[0]).ravel()
                            about, bound = table[part].sum(1), length[a] * reach[own]
                            lo, hi = np.clip(about - bound, -_LONG, _LONG), np.clip(about + bound, -_LONG, _LONG)
                        other = ids[own] != block.ids[a] if near else np.ones(len(own), bool)
                        found = []
                        for (least, most), b in zip([(-np.inf, np.inf)] if near else block.windows[a], best[a], strict=True):
                            inside = np.flatnonzero(other & (about >= least) & (about <= most))
                            seeds = inside if len(inside) <= SEEDS * b.k else inside[np.argpartition(-about[inside], SEEDS * b.k)[: SEEDS * b.k]]
                            known = exact(x[own[seeds]], block.q[a])
                            sure = lo[other & (lo >= least) & (hi <= most)]
                            floor = max(least, b.least(), kth(sure, b.k), kth(known[(known >= least) & (known <= most)], b.k))
                            found.append(other & ~(hi < floor) & ~(lo > most))
                        some = np.flatnonzero(np.logical_or.reduce(found))
                        if len(some):
                            scores, named = exact(x[own[some]], block.q[a]), ids[own[some]]
                            for k, b in enumerate(best[a]):
                                ok = slice(None) if near else (scores >= block.windows[a][k][0]) & (scores <= block.windows[a][k][1])
                                b.add(scores[ok], named[ok])
        rows = [(a, k, b) for a in range(n) for k, b in enumerate(best[a]) if len(b.ids)]
        size = [len(b.ids) for _, _, b in rows]
        columns = [np.repeat([r[i] for r in rows], size).astype(np.int32) for i in (0, 1)] if rows else [np.empty(0, np.int32)] * 2
        joined = [np.concatenate([getattr(r[2], c) for r in rows]) if rows else np.empty(0, np.int64) for c in ("ids", "scores")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, *joined)], ["anchor", "part", "id", "score"])

    return run


def taking_part(embeddings: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, q) of the rows with all of vec_id, label and finite components; q in whole numbers."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    # floor() gives longs; beyond 2^52 a double is whole as it is.
    whole = lambda v: F.when(F.abs(v) < float(2**52), F.floor(v).cast("double")).otherwise(v)
    return rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).select("vec_id", "label", F.transform("x", lambda v: whole(v * SCALE)).alias("q"))


def first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, label: Column, chosen: Column) -> DataFrame:
    """The result's rows from embeddings (vec_id, embedding); label and chosen, which tells anchors, by its columns."""
    spark = embeddings.sparkSession
    rows = cut(taking_part(embeddings, label))
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    share = F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(max(1, n // SAMPLE))) == 0
    sample = [r["q"] for r in rows.filter(share).select("q").collect()]
    x = np.zeros((len(sample), dims))
    for k, q in enumerate(sample):
        x[k, : len(q)] = q
    books = fit(x)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, reach = encode(books, dense(batch.column(2), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(reach)], [*batch.schema.names, "codes", "reach"])

    index = cut(rows.mapInArrow(indexed, "vec_id long, label long, q array<double>, codes binary, reach double"))
    anchors = cut(rows.filter(chosen).distinct())
    blocks = -(-anchors.count() // BLOCK)

    def results():
        of_rows = "anchor int, part int, id long, score long"
        for k in range(blocks):
            some = anchors.filter(F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(blocks)) == k).collect()  # about BLOCK
            if not some:
                continue
            best = [[] for _ in some]
            for r in first(index.mapInArrow(scan(Anchors(some, dims), books, dims), of_rows), POSITIVES).collect():
                best[r["anchor"]].append((r["rank"], r["id"], r["score"]))
            best = [sorted(b) for b in best]
            block = Anchors(some, dims, [[window_of(s) for _, _, s in b] for b in best])
            named = [(a, part, some[a]["vec_id"], p, s) for a, b in enumerate(best) for part, (_, p, s) in enumerate(b)]
            found = first(index.mapInArrow(scan(block, books, dims), of_rows), NEGATIVES)
            of = spark.createDataFrame(named, "anchor int, part int, anchor_id long, positive_id long, positive_score long")
            yield found.join(F.broadcast(of), ["anchor", "part"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

    return cut_each(spark, results(), RESULT)
