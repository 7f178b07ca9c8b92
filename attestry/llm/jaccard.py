"""Jaccard self-join of documents by R-trees of count vectors.

A document's set is its distinct five-word shingles (words lower-cased A-Z, split at ASCII white space); a
text of fewer words is one shingle of them all. Two documents are linked if 100 * |both| >= 80 * |either|.

Shingles are hashed into groups, about one group a shingle (a power of two, ``GROUPS`` at most; a finer
vector folds to a coarser one by adding halves; ``TREE_GROUPS`` in trees). A set's point is its counts by group. Two sets share no
more than the sum over the groups of the lesser count; two rectangles hold no pair that shares more than the
sum of the lesser upper corners. Trees are packed in order of component and size, ``FAN`` entries a node;
node pairs go down only if that bound, the sizes and the components leave room for a new link, and leaf
pairs give the document pairs of which the points do. Those are held against their finer points, then
verified on whole sets.

A tree over all documents would prune little: unrelated points differ in every coordinate a bit, so that the
corners of a node of them lie over all of them. So there is a tree for each tile. Shingles are put in one
order, those that a sample of about ``SAMPLE`` texts holds often last; linked sets share one of their first
n - ceil(0.8 n) + 1 shingles, and a set lies in the tiles of these. The sample decides only which order is
used, never what is found. Copies are one point. In each tile all sets are first held against the one with
the least id, so that groups of near copies become components, which trees pass over; then each point's best
partner in each other component is verified; last, all pairs between components that are left. A tile that a
large share of the rows has is split by hash into nodes, so no task takes a tile as a whole.

Defined cases: null texts and texts without words have no shingles and are linked with nothing; rows without
doc_id belong to their copies but link nothing themselves; rows that repeat a doc_id are one document with
several texts; a pair at the threshold is linked; texts are read whole, whatever their length; one result
row for each row of documents; an empty table gives none. Other columns aren't read.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import cut
from attestry.llm.components import components
from attestry.llm.minhash import WordHashes, _lists, mix, shingles

PERCENT = 80
GROUPS, TREE_GROUPS = 1 << 14, 1 << 9  # in trees, where a long text has many entries, points are coarser
FAN = 256
SPLIT = 4_096  # rows of a tile that one task packs
FEW = 32  # rows of a tile whose pairs are all verified at once
SAMPLE, FREQUENT, LEAST = 5_000, 1 << 16, 5
BROADCAST_IDS = 1_000_000

_U = np.uint64


def linked(common, n, m):
    """Whether sets of n and m shingles that have so many in common meet the threshold; for numbers, arrays and columns."""
    return (100 + PERCENT) * common >= PERCENT * (n + m)


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of a set that decide its tiles, in the order of all: frequent ones last, then by hash."""
    n = len(s)
    size = n - -(-PERCENT * n // 100) + 1
    order = mix(s) >> _U(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        order |= (frequent[at] == s).astype(_U) << _U(63)
    first = np.argpartition(order, size - 1)[:size]
    return s[first[np.lexsort((s[first], order[first]))]]


def point(s: np.ndarray, most: int = GROUPS) -> np.ndarray:
    """Counts by group; as many groups as the largest power of two up to the number of shingles, most at most."""
    groups = min(most, 1 << (len(s).bit_length() - 1))
    counts = np.bincount((s & _U(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32)


def stored(p: np.ndarray) -> bytes:
    """A leading byte tells the width of the counts."""
    return bytes([p.itemsize]) + p.tobytes()


def loaded(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if data[0] == 1 else np.uint32, offset=1)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    return p if len(p) == groups else p.reshape(-1, groups).sum(0, dtype=np.uint32)


SKETCH = "doc_id long, n long, d1 long, d2 long, prefix array<long>"


def _sketch(frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, none = WordHashes(), np.empty(0, _U)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py(), hashes) for t in part.column(1)]
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                keys = [prefix(s, frequent) if len(s) else none for s in sets]
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), _lists(keys)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", "prefix"])

    return run


def _sets(whole: bool, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of texts with shingles: item, n, and as asked the point of so many groups and the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py(), hashes) for t in part.column(1)]
                full = [k for k, s in enumerate(sets) if len(s)]
                sets = [sets[k] for k in full]
                columns = {"item": part.column(0).take(pa.array(full, pa.int32())), "n": pa.array([len(s) for s in sets], pa.int64())}
                if groups:
                    columns["point"] = pa.array([stored(point(s, groups)) for s in sets], pa.binary())
                if whole:
                    columns["shingles"] = _lists(sets)
                yield pa.RecordBatch.from_pydict(columns)

    return run


def frequent_shingles(documents: DataFrame) -> np.ndarray:
    """Shingles that LEAST texts of a sample or more hold, the FREQUENT most held ones at most, sorted."""
    share = F.pmod(F.xxhash64("text"), F.lit(max(1, documents.count() // SAMPLE))) == 0
    texts = documents.filter(share & F.col("text").isNotNull()).groupBy(F.xxhash64("text").alias("item")).agg(F.first("text").alias("text"))
    held = texts.mapInArrow(_sets(True, 0), "item long, n long, shingles array<long>").select(F.explode("shingles").alias("s")).groupBy("s").count().filter(F.col("count") >= LEAST)
    rows = held.orderBy(F.desc("count"), "s").limit(FREQUENT).collect()
    return np.sort(np.array([r["s"] for r in rows], np.int64).view(_U))


def sets_of(documents: DataFrame, items: DataFrame, whole: bool, groups: int) -> DataFrame:
    """(item, n, and as asked point, shingles) of the documents named in items (item), which must be written."""
    wanted = F.broadcast(items) if items.count() <= BROADCAST_IDS else items
    texts = documents.select(F.col("doc_id").alias("item"), "text").join(wanted, "item", "left_semi")
    return cut(texts.mapInArrow(_sets(whole, groups), "item long, n long" + ", point binary" * bool(groups) + ", shingles array<long>" * whole))


def bound(p: np.ndarray, q: np.ndarray) -> int:
    """The most that sets of these points can have in common."""
    groups = min(len(p), len(q))
    return int(np.minimum(folded(p, groups), folded(q, groups)).sum(dtype=np.int64))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m, p, q = (batch.column(c).to_pylist() for c in ("n", "m", "p", "q"))
        keep = [linked(bound(loaded(x), loaded(y)), a, b) for a, b, x, y in zip(n, m, p, q, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Of distinct candidates (a, b), written, the linked ones: by their points first, then by whole sets."""
    ends = lambda: cut(pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct())
    side = lambda x, *columns: sets.select(F.col("item").alias(x), *[F.col(c).alias(name) for c, name in columns])
    sets = sets_of(documents, ends(), False, GROUPS)
    both = pairs.join(side("a", ("n", "n"), ("point", "p")), "a").join(side("b", ("n", "m"), ("point", "q")), "b")
    pairs = cut(both.filter(similar_size(F.col("n"), F.col("m"))).select("a", "b", "n", "m", "p", "q").mapInArrow(_bounded, "a long, b long")).distinct()
    sets = sets_of(documents, ends(), True, 0)
    both = pairs.join(side("a", ("shingles", "x")), "a").join(side("b", ("shingles", "y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    both = both.select("a", "b", F.size("x").cast("long").alias("n"), F.size("y").cast("long").alias("m"), common.alias("common"))
    return cut(both.filter(linked(F.col("common"), F.col("n"), F.col("m"))).select("a", "b").distinct())


def similar_size(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


# Entries of a node: documents in a leaf, nodes above.
ENTRY = "id long, n_lo long, n_hi long, c_lo long, c_hi long, at long, corner binary"
NODE = f"node long, key long, n_lo long, n_hi long, c_lo long, c_hi long, corner binary, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>"
_FIELDS = [f.split()[0] for f in ENTRY.split(", ")]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of up to FAN entries with one key from rows (key, ENTRY) in order."""
    node = TaskContext.get().partitionId() << 40
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column("key").to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        runs = zip(np.concatenate(([0], change)), np.concatenate((change, [len(key)])), strict=True)
        starts = np.array([s for a, b in runs for s in range(a, b, FAN)], np.int64)
        ends = np.append(starts[1:], len(key))
        corners = batch.column("corner").to_pylist()
        upper = []
        for a, b in zip(starts, ends, strict=True):
            points = [loaded(c) for c in corners[a:b]]
            groups = min(map(len, points))
            upper.append(stored(np.maximum.reduce([folded(p, groups) for p in points])))
        least, most = (lambda c, f=f: pa.array(f.reduceat(batch.column(c).to_numpy(), starts)) for f in (np.minimum, np.maximum))
        entries = pa.StructArray.from_arrays([batch.column(c) for c in _FIELDS], _FIELDS)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), entries)
        columns = [pa.array(node + np.arange(len(starts))), pa.array(key[starts]), least("n_lo"), most("n_hi"), least("c_lo"), most("c_hi"), pa.array(upper, pa.binary()), lists]
        node += len(starts)
        yield pa.RecordBatch.from_arrays(columns, ["node", "key", "n_lo", "n_hi", "c_lo", "c_hi", "corner", "entries"])


def packed(rows: DataFrame) -> DataFrame:
    """Nodes over rows (key, rows, ENTRY); a key with many rows is dealt out by hash."""
    spread = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("rows") / SPLIT))))
    dealt = spread.repartition("key", "part").sortWithinPartitions("key", "part", "c_lo", "n_lo", "id")
    return cut(dealt.select("key", *_FIELDS).mapInArrow(_pack, NODE))


class Entries:
    """The entries of one node as arrays; corners by number of groups."""

    def __init__(self, node: pa.StructScalar):
        flat = node.flatten() if isinstance(node, pa.StructArray) else node
        self.id, self.n_lo, self.n_hi, self.c_lo, self.c_hi, self.at = (flat[k].to_numpy() for k in range(6))
        self.points = [loaded(c) for c in flat[6].to_pylist()]
        self.groups = np.array([len(p) for p in self.points])
        self._of: dict[int, np.ndarray] = {}

    def of(self, groups: int) -> np.ndarray:
        """A row for each entry that has so many groups or more, zeros for the others."""
        if groups not in self._of:
            self._of[groups] = np.stack([folded(p, groups) if len(p) >= groups else np.zeros(groups, np.uint8) for p in self.points])
        return self._of[groups]


def meeting(x: Entries, y: Entries, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of entries (i, j) that leave room for a link between components, and the bound of each."""
    out = [(np.empty(0, np.int64),) * 3]
    step = max(1, (1 << 16) // len(y.id))
    for a in range(0, len(x.id), step):
        n_lo, n_hi, c_lo, c_hi, at = (c[a : a + step, None] for c in (x.n_lo, x.n_hi, x.c_lo, x.c_hi, x.at))
        room = (100 * n_hi >= PERCENT * y.n_lo) & (100 * y.n_hi >= PERCENT * n_lo) & ((c_lo != c_hi) | (y.c_lo != y.c_hi) | (c_lo != y.c_lo))
        # What stands before the shared key in the order isn't shared, in the first tile that a pair shares.
        room &= linked(np.minimum(n_hi - at, y.n_hi - y.at), 0, n_lo + y.n_lo)
        if same:  # each pair once; a node meets itself, a document doesn't
            first = np.arange(a, a + len(n_lo)) + (c_lo == c_hi)[:, 0]
            room &= np.arange(len(y.id)) >= first[:, None]
        i, j = np.nonzero(room)
        i += a
        groups = np.minimum(x.groups[i], y.groups[j])
        for g in np.unique(groups):
            of_g = np.flatnonzero(groups == g)
            for k in range(0, len(of_g), 2048):
                p, q = i[of_g[k : k + 2048]], j[of_g[k : k + 2048]]
                most = np.minimum(x.of(g)[p], y.of(g)[q]).sum(1, dtype=np.int64)
                ok = linked(most, 0, x.n_lo[p] + y.n_lo[q])
                out.append((p[ok], q[ok], most[ok]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _nodes(batch: pa.RecordBatch, name: str) -> list[Entries]:
    lists = batch.column(name)
    flat, ends = lists.flatten(), np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
    return [Entries(flat.slice(a, b - a)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the entries of node pairs (x, y; equal if y is null) that leave room: (x, y), nodes again."""
    for batch in batches:
        left, right = _nodes(batch, "xs"), _nodes(batch, "ys")
        for x, y, same in zip(left, right, batch.column("same").to_pylist(), strict=True):
            i, j, _ = meeting(x, y, same)
            yield pa.RecordBatch.from_arrays([pa.array(x.id[i]), pa.array(y.id[j])], ["x", "y"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of documents of leaf pairs, or of leaves if there are no ys: item, other component, its document, bound; for each item and component the best, or all."""
    for batch in batches:
        left = _nodes(batch, "xs")
        same = "ys" not in batch.schema.names
        for x, y, best in zip(left, left if same else _nodes(batch, "ys"), batch.column("best").to_pylist(), strict=True):
            i, j, most = meeting(x, y, same)
            item, other = np.concatenate((x.id[i], y.id[j])), np.concatenate((y.id[j], x.id[i]))
            component, most = np.concatenate((y.c_lo[j], x.c_lo[i])), np.concatenate((most, most))
            if best:
                order = np.lexsort((other, -most, component, item))
                item, other, component, most = item[order], other[order], component[order], most[order]
                new = np.ones(len(item), bool)
                new[1:] = (item[1:] != item[:-1]) | (component[1:] != component[:-1])
                item, other, component, most = item[new], other[new], component[new], most[new]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (item, component, other, most)], ["item", "component", "other", "most"])


def by_trees(rows: DataFrame, best: bool) -> DataFrame:
    """Candidates (a, b) between components within the tiles of rows (key, rows, item, n, at, component, point)."""
    entry = rows.select("key", "rows", F.col("item").alias("id"), F.col("n").alias("n_lo"), F.col("n").alias("n_hi"), F.col("component").alias("c_lo"), F.col("component").alias("c_hi"), "at", F.col("point").alias("corner"))
    levels, more = [packed(entry)], []  # more: at each level, the keys that have several nodes there
    while True:
        more.append(cut(levels[-1].groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")))
        if more[-1].isEmpty():
            break
        nodes = levels[-1].join(more[-1], "key").withColumnRenamed("node", "id").withColumn("at", F.lit(0).cast("long"))
        levels.append(packed(nodes.select("key", "rows", *_FIELDS)))
    mode = F.lit(best).alias("best")
    found = levels[0].select(F.col("entries").alias("xs"), mode).mapInArrow(_candidates, "item long, component long, other long, most long")
    pairs = None
    for k in range(len(levels) - 1, -1, -1):
        if k:
            roots = levels[k].join(more[k], "key", "left_anti").select(F.col("node").alias("x"), F.col("node").alias("y"))
            pairs = pairs.unionByName(roots) if pairs else roots
        elif not pairs:
            break  # no tile has a second leaf
        side = lambda name, k=k: levels[k].select(F.col("node").alias(name), F.col("entries").alias(f"{name}s"))
        both = pairs.join(side("x"), "x").join(side("y"), "y")
        if k:
            pairs = cut(both.select("xs", "ys", (F.col("x") == F.col("y")).alias("same")).mapInArrow(_children, "x long, y long"))
        else:  # a leaf against itself is among found
            found = found.unionByName(both.filter("x <> y").select("xs", "ys", mode).mapInArrow(_candidates, "item long, component long, other long, most long"))
    if best:
        found = found.groupBy("item", "component").agg(F.max_by("other", F.struct("most", "other")).alias("other"))
    return cut(found.select(F.greatest("item", "other").alias("a"), F.least("item", "other").alias("b")).filter("a <> b").distinct())


def several_texts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from a doc_id with different texts to the items that stand for them."""
    full = rows.filter("n > 0 and doc_id is not null").select("doc_id", "d1", "d2")
    again = cut(full.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi")).filter("lo <> hi").select("doc_id"))
    if again.isEmpty():
        return full.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).filter("false")
    return cut(full.join(again, "doc_id").join(classes.select("d1", "d2", "item"), ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("item").alias("b")).filter("a <> b").distinct())


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, in order of their keys, that some row of the key leaves room for by size, place and component; where a tile isn't whole here, all."""
    for batch in batches:
        key, n, at, component = (batch.column(c).to_numpy() for c in ("key", "n", "at", "component"))
        keep = np.ones(len(key), bool)
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        for a, b in zip(change[:-1], change[1:], strict=True):  # the first and the last tile may go on elsewhere
            if b - a <= FAN:
                x, c, room = n[a:b], component[a:b], n[a:b] - at[a:b]
                may = (c[:, None] != c) & (100 * np.minimum(x[:, None], x) >= PERCENT * np.maximum(x[:, None], x)) & linked(np.minimum(room[:, None], room), x[:, None], x)
                keep[a:b] = may.any(1)
        yield batch.filter(pa.array(keep))


def links(members: DataFrame, documents: DataFrame, known: DataFrame) -> DataFrame:
    """(item, component) of all linked items of members (key, item, n, at), written; known: links (a, b) besides."""
    tiles = cut(members.groupBy("key").agg(F.min(F.struct("item", "n", "at")).alias("mid"), F.count("*").alias("rows")))
    met = members.join(tiles, "key").filter((F.col("item") != F.col("mid.item")) & similar_size(F.col("n"), F.col("mid.n")))
    met = met.filter(linked(F.least(F.col("n") - F.col("at"), F.col("mid.n") - F.col("mid.at")), F.col("n"), F.col("mid.n")))
    found = verify(cut(met.select(F.greatest("item", "mid.item").alias("a"), F.least("item", "mid.item").alias("b")).distinct()), documents).unionByName(known)
    named = components(found)
    rest = cut(members.join(tiles.filter("rows > 2").select("key", "rows"), "key"))  # two rows have met
    for best in (True, False):
        own = cut(rest.join(named, "item", "left").withColumn("component", F.coalesce("component", "item")))
        parts = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
        own = own.join(cut(parts), "key", "left_semi").select("key", "rows", "item", "n", "at", "component")
        dealt = own.filter(F.col("rows") <= SPLIT).repartition("key").sortWithinPartitions("key")
        own = cut(dealt.mapInArrow(_hopeful, own.schema).unionByName(own.filter(F.col("rows") > SPLIT)))
        if own.isEmpty():
            return named
        if best:
            points = sets_of(documents, cut(own.select("item").distinct()), False, TREE_GROUPS)
            own_now = own.filter(F.col("rows") > FEW)  # in a small tile, all pairs are few
            if own_now.isEmpty():
                continue
        else:
            own_now = own
        found = found.unionByName(verify(by_trees(own_now.join(points, ["item", "n"]), best), documents))
        named = components(found)
        rest = own.drop("component")
    return named


def similar(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) for each row of documents (doc_id, text)."""
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    rows = cut(documents.mapInArrow(_sketch(frequent_shingles(documents)), SKETCH))
    classes = cut(rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("item"), F.count("*").alias("copies")))
    copies = classes.filter("copies > 1").select("d1", "d2", "item")
    points = rows.filter("n > 0 and doc_id is not null").join(copies, ["d1", "d2"], "left").filter("item is null or item = doc_id")
    keys = points.select(F.col("doc_id").alias("item"), "n", F.posexplode("prefix").alias("at", "key")).withColumn("at", F.col("at").cast("long"))
    shared = keys.groupBy("key").count().filter("count > 1").select("key")
    named = links(cut(keys.join(cut(shared), "key", "left_semi")), documents, several_texts(rows, classes))
    owner = classes.join(named, "item", "left").withColumn("component_id", F.coalesce("component", "item"))
    owner = cut(owner.filter("copies > 1 or component_id <> item").select("d1", "d2", "component_id"))
    out = rows.select("doc_id", "n", "d1", "d2").join(owner, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id").alias("component_id"))
