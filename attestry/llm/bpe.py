"""Byte-level BPE encoding and decoding of whole texts, as the tiktoken library encodes ordinary text.

Texts are cut by the tokenizer's pattern. A task hands its texts on in chunks of about ``TOKENS`` words; a
chunk is one row and stands by itself: its words that aren't known beforehand, as arrays of byte ids, and its
texts as runs of word numbers. Chunks are shuffled, so a task has one Python process, either to
cut texts or to put them together; with both in one task an executor held twice as many. Spark higher-order
functions fold each word: as long as a pair of neighbours has a rank, the leftmost pair of least rank is
merged. The rank map is a broadcast row of two arrays: row a of the pair table begins at ``shift[a]``, so the
entry of (a, b) is ``table[shift[a] + b]``; it holds a beside the rank, which tells other rows' entries
apart. (As literals inside the expressions the arrays would stand in every text of every plan, tens of MB
on the driver.) The texts are then put together from the folded words, and the ids decoded in the same task, by
taking the byte string of each. Ids that come without it are decoded by built-in functions on a literal array.

Words that many chunks hold are folded once: about ``SAMPLE`` texts are counted, and their most frequent
words, ``FREQUENT`` at most, are folded ahead and broadcast. That saves time and changes no result. Words
over ``LONG`` bytes are merged by a heap instead: a fold over an array takes quadratic time.

Defined cases: null is the empty text, with no tokens; one result row for each row of documents, repeats
and rows without doc_id included; other columns are left out; an empty table gives an empty result; of
pairs of equal rank the leftmost is merged first.
"""

import base64
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import cut, let, literal_array

TOKENS = 1 << 18
SAMPLE, FREQUENT = 32_000, 1 << 18
LONG = 256
RANK_BITS, PLACE_BITS = 17, 12  # a rank from 2^RANK_BITS up is none; a place is one in a word of LONG bytes at most
#: What \s means to the library: Unicode's White_Space.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The pattern's matches, with white space spelled out for a library whose own idea of it is another.

    Up to U+024F its classes are a few ranges, which another library matches in half the time.
    """
    inner = SPACE[1:-1]
    spelled = pattern.replace(r"[^\s", f"[^{inner}").replace(r"\s", SPACE).replace(r"\S", f"[^{inner}]")
    letters, numbers = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
    western = spelled.replace(r"[^" + inner + r"\p{L}\p{N}]", f"[^{inner}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    anything = regex.compile(spelled).findall
    if "\\p" in western:
        return anything
    # Of what stands beyond, general punctuation and currency hold neither letters nor numbers nor white space.
    other, few = re.compile(r"[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]").search, re.compile(western).findall
    return lambda text: anything(text) if other(text) else few(text)


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(shift, table) of the pairs that merge: table[shift[a] + b] is a, rank and room for a place, or belongs to another row."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    n = max(ranks.values()) + 1
    if n >= 1 << RANK_BITS:
        raise ValueError("the vocabulary has too many tokens for RANK_BITS")
    # Rows are placed at random, the full ones while there is room; a table twice as long as the pairs has room for all.
    size = n + 2 * sum(map(len, rows.values()))
    shift, table = np.zeros(n, np.int64), np.full(size + n, ((1 << RANK_BITS) - 1) << RANK_BITS, np.int64)
    used, draw = np.zeros(size + n, bool), np.random.default_rng(1)
    for a, row in sorted(rows.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        b, rank = (np.array(x) for x in zip(*row, strict=True))
        free: np.ndarray = np.empty(0, np.int64)
        while not len(free):
            at = draw.integers(0, size, 64)
            free = at[~used[at[:, None] + b].any(axis=1)]
        shift[a] = free[0]
        used[shift[a] + b] = True
        table[shift[a] + b] = a << RANK_BITS | rank
    return shift, table << PLACE_BITS


def fold(word: Column, shift: Column, table: Column) -> Column:
    """The ids of a word (array of byte ids): pairs are merged, least rank first, until none has a rank."""
    upper = RANK_BITS + PLACE_BITS

    def step(ids, _):
        # (rank, place) as one number. With another row's entry the bits above differ, so it is no rank.
        ranked = lambda a, i: F.get(table, F.get(shift, a) + F.get(ids, i + 1)).bitwiseXOR(F.shiftleft(a.cast("long"), upper)).bitwiseOR(i)

        def merge(m):
            at = m.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
            one = F.concat(F.slice(ids, F.lit(1), at), F.array(F.shiftright(m, PLACE_BITS).cast("int")), F.slice(ids, at + 3, F.lit(LONG)))
            return F.when(m < 1 << upper, one).otherwise(ids)

        return let(F.array_min(F.transform(ids, ranked)), merge)

    return F.when(F.size(word) > 1, F.aggregate(F.sequence(F.lit(2), F.size(word)), word, step)).otherwise(word)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap of pairs over a linked list, for long words."""
    n = len(word)
    end, left, right, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, upto = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or end[j] != upto:
            continue
        alive[j] = False
        end[i], right[i] = end[j], right[j]
        if right[i] < n:
            left[right[i]] = i
        for a in (left[i], i):
            if a >= 0 and right[a] < n and (r := ranks.get(word[a : end[right[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[right[a]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Known:
    """Words whose ids need no fold in a chunk: tokens, then the frequent words, as flat ids; numbered in that order."""

    def __init__(self, ranks: dict[bytes, int], words: pa.Array, ids: pa.ListArray):
        self.ranks, self.words = ranks, words
        self.tokens = max(ranks.values()) + 1
        self.n = self.tokens + len(words)
        lengths = ids.value_lengths().to_numpy().astype(np.int64)
        self.flat = np.concatenate([np.arange(self.tokens, dtype=np.int32), ids.flatten().to_numpy().astype(np.int32)])
        self.size = np.concatenate([np.ones(self.tokens, np.int64), lengths])
        self._coder: Coder | None = None

    def __getstate__(self):  # what cuts texts into numbers needs no ids
        return self.__dict__ | {"flat": None, "size": None}

    def coder(self) -> "Coder":
        """The number of each word, without any new ones; made once a process, where it is used."""
        if self._coder is None:
            self._coder = Coder(self)
        self._coder.forget()
        return self._coder


class Coder(dict):
    """Numbers of words: known ones, and from there on a chunk's new words in order."""

    def __init__(self, known: Known):
        for token, i in known.ranks.items():
            try:
                self[token.decode()] = i
            except UnicodeDecodeError:
                pass
        self.update(zip(known.words.to_pylist(), range(known.tokens, known.n), strict=True))
        self.n, self.new = known.n, []

    def __missing__(self, word: str) -> int:
        code = self[word] = self.n + len(self.new)
        self.new.append(word)
        return code

    def forget(self) -> None:
        """Leave the known words alone."""
        for word in self.new:
            del self[word]
        self.new = []


def _lists(sizes, flat: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat, kind))


def _letters(ranks: dict[bytes, int], words: list[bytes]) -> pa.ListArray:
    """Words as lists of their bytes' ids."""
    ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    return _lists([len(w) for w in words], ids[np.frombuffer(b"".join(words), np.uint8)], pa.int32())


def _planes(codes: array) -> bytes:
    """Numbers as all their lowest bytes, then all second ones and so on, of which the upper ones take little in a shuffle."""
    return np.array(codes, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _counts(pattern: str, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known, count = splitter(pattern), Known(ranks.value, pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))).coder(), Counter()

        def rows():
            words = [(w, n, w.encode("utf-8", "surrogatepass")) for w, n in count.items() if w not in known]
            words = [x for x in words if len(x[2]) <= LONG]
            count.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _, _ in words], pa.string()), pa.array([n for _, n, _ in words], pa.int64()), _letters(ranks.value, [b for _, _, b in words])], ["word", "n", "letters"])

        for batch in batches:
            for text in batch.column(0):
                count.update(find(text.as_py() or ""))
                if len(count) > 100_000:
                    yield rows()
        yield rows()

    return run


def _chunks(pattern: str, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ranks = splitter(pattern), known.value.ranks
        coder, codes, sizes, ids = known.value.coder(), array("I"), array("q"), []

        def row():
            words = [w.encode("utf-8", "surrogatepass") for w in coder.new]
            long = [i for i, w in enumerate(words) if len(w) > LONG]
            merged = [np.array(merge_long(words[i], ranks), np.int32) for i in long]
            for i in long:
                words[i] = b""  # its ids come by themselves
            inner, done = _letters(ranks, words), _lists([len(x) for x in merged], np.concatenate([np.empty(0, np.int32), *merged]), pa.int32())
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [one(pa.array(ids, pa.int64())), pa.array([_planes(codes)]), pa.array([sizes.tobytes()]), one(inner), one(pa.array(long, pa.int32())), one(done)]
            return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in CHUNK.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = find(text.as_py() or "")
                codes.extend(map(coder.__getitem__, found))
                sizes.append(len(found))
                ids.append(doc)
                if len(codes) >= TOKENS:
                    yield row()
                    pa.default_memory_pool().release_unused()
                    coder.forget()
                    codes, sizes, ids = array("I"), array("q"), []
        if ids:
            yield row()

    return run


CHUNK = "docs array<long>, codes binary, sizes binary, words array<array<int>>, long array<int>, done array<array<int>>"


def _gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at + np.repeat(starts - (ends - sizes), sizes)]


def _spelled(pieces: pa.Array, ids: np.ndarray, edge: np.ndarray) -> pa.Array:
    """The bytes that the runs of ids between edges stand for."""
    found = pieces.take(pa.array(ids, pa.int32()))
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(ends[edge].astype(np.int32)), found.buffers()[2]])


def _assemble(ready, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(sorted(ranks.value, key=ranks.value.get), pa.binary())
        known, known_size = ready.value
        known_start = np.cumsum(known_size) - known_size
        for batch in batches:
            for i in range(len(batch)):
                docs, codes, sizes, folded, long, done = (batch.column(k)[i] for k in range(6))
                docs = docs.values
                codes, sizes = _numbers(codes.as_py()), np.frombuffer(sizes.as_py(), np.int64)
                # The ids of all words end to end: known ones, the row's folded words, its long words.
                ids, size = ([f(x.values) for x in (folded, done)] for f in (lambda x: x.flatten().to_numpy(), lambda x: x.value_lengths().to_numpy().astype(np.int64)))
                where = long.values.to_numpy()
                own = np.cumsum(size[0]) - size[0] + len(known)
                own[where] = len(known) + len(ids[0]) + np.cumsum(size[1]) - size[1]
                size[0][where] = size[1]
                flat, start_of, size_of = np.concatenate([known, *ids]), np.concatenate([known_start, own]), np.concatenate([known_size, size[0]])
                edge = np.concatenate(([0], np.cumsum(sizes)))
                for d in range(0, len(sizes), 512):
                    mine = codes[edge[d] : edge[min(d + 512, len(sizes))]]
                    n = size_of[mine]
                    upto = np.concatenate(([0], np.cumsum(n)))[edge[d : d + 513] - edge[d]]
                    own_ids = _gather(start_of[mine], n, flat)
                    yield pa.RecordBatch.from_arrays([docs.slice(d, 512), _lists(np.diff(upto), own_ids, pa.int32()), _spelled(pieces, own_ids, upto)], ["doc_id", "ids", "decoded"])

    return run


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row: shift and table of pair_table()."""
    return spark.createDataFrame(pa.table({name: _lists([len(x)], x, kind) for name, x, kind in zip(("_shift", "_table"), pair_table(ranks), (pa.int32(), pa.int64()), strict=True)}))


def folded(rows: DataFrame, merges: DataFrame, words: str, *keep: str) -> DataFrame:
    """rows with each of a row's words (arrays of byte ids) folded. A row should hold many words: it meets the whole rank map."""
    both = rows.crossJoin(F.broadcast(merges))
    ids = let(F.col("_shift"), lambda s: let(F.col("_table"), lambda t: F.transform(words, lambda w: fold(w, s, t))))
    return both.select(*keep, ids.alias(words))


def frequent(rows: DataFrame, pattern: str, ranks, merges: DataFrame) -> Known:
    """The most frequent words of about SAMPLE texts and their ids: FREQUENT at most, whatever the corpus."""
    few = rows.filter(F.rand(7) < SAMPLE / max(1, rows.count()))  # whatever ids or copies are common
    counts = cut(few.select("text").mapInArrow(_counts(pattern, ranks), "word string, n long, letters array<int>").groupBy("word").agg(F.sum("n").alias("n"), F.first("letters").alias("letters")))
    top = 1000
    found = {r["n"]: r["k"] for r in counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("k")).collect()}  # top rows at most
    least, total = top + 1, 0
    while least > 2 and total + found.get(least - 1, 0) <= FREQUENT:
        least -= 1
        total += found.get(least, 0)
    groups = counts.filter(F.col("n") >= least).groupBy(F.pmod(F.xxhash64("word"), F.lit(128)).alias("_g")).agg(F.collect_list(F.struct("word", "letters")).alias("_w"))
    groups = groups.select(F.col("_w.word").alias("words"), F.col("_w.letters").alias("ids"))  # 2,048 words each, about
    got = folded(groups, merges, "ids", "words").toArrow()  # FREQUENT words at most
    words, ids = (pa.concat_arrays([c.flatten() for c in got.column(k).chunks]) if len(got) else pa.array([], kind) for k, kind in enumerate((pa.string(), pa.list_(pa.int32()))))
    return Known(ranks.value, words, ids)


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and what these stand for (decoded) for each row of documents (doc_id, text)."""
    spark, ranks = documents.sparkSession, load_ranks(path)
    sc, merges = spark.sparkContext, rank_map(spark, ranks)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = sc.broadcast(ranks)
    known = frequent(rows, pattern, sent, merges)  # bounded by the vocabulary and FREQUENT
    ready = sc.broadcast((known.flat, known.size))
    made = rows.mapInArrow(_chunks(pattern, sc.broadcast(known)), CHUNK)
    chunks = folded(made.repartition(F.xxhash64("docs", "codes")), merges, "words", "docs", "codes", "sizes", "long", "done")
    return chunks.select("docs", "codes", "sizes", "words", "long", "done").mapInArrow(_assemble(ready, sent), "doc_id long, ids array<int>, decoded binary")


def decoded(ids: Column, path: str) -> Column:
    """The bytes that ids stand for; built-in functions only."""
    pieces = [b.hex() for b, _ in sorted(load_ranks(path).items(), key=lambda kv: kv[1])]
    return let(literal_array(pieces, "string"), lambda table: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with ids) and the bytes that the ids stand for, in column decoded, which encode() makes beside them."""
    return encoded if "decoded" in encoded.columns else encoded.withColumn("decoded", decoded(F.col("ids"), path))


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded (doc_id, ids)."""
    return decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
