"""Language-model scores from a log-frequency Bloom filter.

Rows are read once, in chunks: every task sums the words and word pairs of a chunk (tokens are
lower-cased words and one end a text; held-out rows count nothing) and hands them on as packed runs by
hash range. The runs of a range meet in one task, which sums them, builds the range's block of the
filter and answers every run with what the block says of its n-grams; answers go back to their chunk.
An n-gram of count c is stored under levels 1 .. 1 + floor(log2 c); asking for levels until one is
missing gives its quantised count 2^(level - 1), which is at most c. A block has ``BITS`` bits for each
n-gram and level that it stores, so the filter grows with the corpus and its false positives don't; no
one holds the whole of it. There are as many ranges as a range of about ``RANGE_BYTES`` of text asks for.

score: log10 of the product of P(w | previous) = L * q(previous, w) / c(previous) + (1 - L) * P(w), with
P(w) = (q(w) + 1) / (Q + V + 1), where q is the filter's quantised count, c the exact count of the history,
Q the sum of q over the V words of training; L is 0 where c(previous) is 0. P(w) sums to 1 over the words
and the unknown word. The pairs of a history sum to at most c, as q doesn't exceed counts, so P(. | previous)
sums to at most 1, and to 1 - L at least; what quantising takes off isn't given to any word. A pair's q is
no larger than the counts of its words, which leaves false positives little room. base_score: the
add-one unigram sum of exact counts, which come back with the answers.

Defined cases: null is the empty text, one end; without training rows all counts are 0; one result row
for each row of documents, repeats included; a null doc_id has no remainder and counts as training; an
empty table gives an empty result.
"""

from collections.abc import Iterator
from math import log10
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import crc_bucket, cut
from attestry.llm.minhash import WordHashes, mix

RANGE_BITS = 10  # least: a key's upper bits are its range
RANGE_BYTES = 256 << 20
BITS = 16  # of the filter for each n-gram and level
MIX = 0.6  # L, the weight of the pair estimate
PROBES = 2
LEVELS = 40
FLUSH = 1_500_000  # tokens of a chunk, about

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
END = _U(0x5BD1E995C0FFEE11)
START = _U(0xA24BAED4963EE407)
WORD, PAIR, TEXTS = 0, 1, 2  # kinds of rows; TEXTS: a chunk's words, tokens and documents
RUNS = "chunk long, kind int, range int, keys binary, counts binary, ids binary, flags binary, sizes binary"
ANSWERS = "chunk long, kind int, range int, levels binary, exact binary, total long, distinct long, mass double"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(texts: pa.Array, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, one end after each text, and the number of tokens of each."""
    found, size = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
        found.append(np.fromiter(map(hashes.__getitem__, words), _U, len(words)))
        found.append(np.array([END], _U))
        size[i] = len(words) + 1
    return np.concatenate(found) if found else np.empty(0, _U), size


def pairs(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (previous, token), and of previous; a text's first token follows the start."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(size) - size] = START
    return mix(before * _STEP + h), before


def _packed(counts: np.ndarray) -> bytes:
    top = int(counts.max(initial=0))
    return compress(counts.astype(np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else _U).tobytes(), 1)


def _numbers(data: bytes, n: int) -> np.ndarray:
    """n numbers as _packed wrote them."""
    raw = decompress(data)
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(_U)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _runs(chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple]:
    """Sorted keys and their counts as a row for each of 2^bits ranges that has any."""
    part, at = np.unique((keys >> _U(64 - bits)).astype(np.int64), return_index=True)
    edge = np.append(at, len(keys))
    of = lambda x, k: x[edge[k] : edge[k + 1]]
    pack = (lambda x: _gaps(x, bits)) if kind == PAIR else np.ndarray.tobytes
    return [(chunk, kind, int(r), pack(of(keys, k)), _packed(of(counts, k)), None, None, None) for k, r in enumerate(part)]


def _gaps(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys of a range less their last byte, as steps from one to the next; the first byte is a step's width."""
    x = (keys & _U((1 << (64 - bits)) - 1)) >> _U(8)
    step = np.diff(x, prepend=_U(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([width]) + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _count(bits: int):
    """The runs of each chunk, with count 0 for what only held-out rows hold, and its TEXTS row."""
    return lambda batches: _counted(batches, bits)


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    hashes, chunk, held, n = WordHashes(), TaskContext.get().partitionId() << 32, [], 0

    def flush():
        h, size, ids, flags = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        train = np.repeat(flags & 1 == 0, size)
        word, back = np.unique(h, return_inverse=True)
        yield _batch(RUNS, _runs(chunk, WORD, word, np.bincount(back, train, len(word)).astype(_U), bits))
        pair, at = np.unique(pairs(h, size)[0], return_inverse=True)
        yield _batch(RUNS, _runs(chunk, PAIR, pair, np.bincount(at, train, len(pair)).astype(_U), bits))
        del pair, at
        planes = back.astype(np.uint32).view(np.uint8).reshape(-1, 4).T  # a plane a byte: the high ones compress well
        yield _batch(RUNS, [(chunk, TEXTS, 0, word.tobytes(), compress(planes.tobytes(), 1), ids.tobytes(), flags.tobytes(), size.tobytes())])

    for batch in batches:
        for at in range(0, len(batch), 1024):
            rows = batch.slice(at, 1024)
            h, size = tokens(rows.column(2), hashes)
            ids = rows.column(0).cast(pa.int64())
            flags = np.array([bool(x) for x in rows.column(1).to_pylist()], np.uint8) | (ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << np.uint8(1))
            held.append((h, size, ids.fill_null(0).to_numpy(zero_copy_only=False), flags))
            n += len(h)
            if n >= FLUSH:
                yield from flush()
                chunk, n = chunk + 1, 0
    if held:
        yield from flush()


def _unpacked(kind: int, part: int, keys: bytes, bits: int) -> np.ndarray:
    if kind == WORD:
        return np.frombuffer(keys, _U)
    width = keys[0]
    raw = np.zeros(((len(keys) - 1) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(keys, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(raw.view(_U).ravel(), dtype=_U) << _U(8) | _U(part) << _U(64 - bits)


def _places(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """Bits of n-grams at a level, in a block of so many."""
    x = mix((keys & ~_U(0xFF)) * _STEP + _U(level))
    for _ in range(PROBES):
        yield x % _U(bits)
        x = x >> _U(24)


class Block:
    """A range's part of the filter: BITS bits for each of some n-grams and each of its levels."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        top = np.floor(np.log2(counts.astype(np.float64))).astype(np.int64) + 1
        self.bits = max(64, BITS * int(top.sum()))
        self.data = np.zeros(self.bits, bool)
        for level in range(1, int(top.max(initial=0)) + 1):
            for place in _places(keys[top >= level], level, self.bits):
                self.data[place] = True

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level without a gap below it under which each n-gram is found; 0 for none."""
        level, at, left = np.zeros(len(keys), np.uint8), np.arange(len(keys)), keys
        for k in range(1, LEVELS):
            there = np.ones(len(left), bool)
            for place in _places(left, k, self.bits):
                there &= self.data[place]
            at, left = at[there], left[there]
            if not len(at):
                break
            level[at] = k
        return level


def quantised(level: np.ndarray) -> np.ndarray:
    """The least count that has this last level: 0, 1, 2, 4, 8, ..."""
    return np.where(level > 0, 2.0 ** (level.astype(np.float64) - 1), 0.0)


def _answered(part: int, runs: list[tuple], bits: int) -> Iterator[pa.RecordBatch]:
    """Levels of each run's keys and exact counts of words, in order, and a row with the sums of the range's words: counts, words, quantised counts."""
    found = {}
    for kind in (WORD, PAIR):
        mine = [_unpacked(kind, part, r[2], bits) for r in runs if r[1] == kind]
        if mine:
            keys, back = np.unique(np.concatenate(mine), return_inverse=True)
            counts = np.concatenate([_numbers(r[3], len(k)) for r, k in zip((r for r in runs if r[1] == kind), mine, strict=True)])
            found[kind] = keys, np.bincount(back, counts, len(keys)).astype(_U), back
    keys, counts = (np.concatenate([x[i] for x in found.values()]) for i in (0, 1))
    block = Block(keys[counts > 0], counts[counts > 0])  # words are n-grams of one word
    out, at = [], dict.fromkeys(found, 0)
    levels = {kind: block.levels(x[0]) for kind, x in found.items()}
    for chunk, kind, raw, _ in runs:
        _, exact, back = found[kind]
        mine = back[at[kind] : at[kind] + (len(raw) // 8 if kind == WORD else (len(raw) - 1) // raw[0])]
        at[kind] += len(mine)
        out.append((chunk, kind, part, compress(levels[kind][mine].tobytes(), 1), _packed(exact[mine]) if kind == WORD else None, None, None, None))
    exact, level = (found[WORD][1], levels[WORD]) if WORD in found else (np.empty(0, _U), np.empty(0, np.uint8))
    out.append((None, None, part, None, None, int(exact.sum()), int((exact > 0).sum()), float(quantised(level[exact > 0]).sum())))
    for k in range(0, len(out), 1024):
        yield _batch(ANSWERS, out[k : k + 1024])


def _answers(bits: int):
    """Answers to runs (chunk, kind, range, keys, counts), which must come in order of range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for chunk, kind, part, keys, counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and last != part:
                    yield from _answered(last, held, bits)
                    held = []
                last = part
                held.append((chunk, kind, keys, counts))
        if held:
            yield from _answered(last, held, bits)

    return run


def _score(total: int, distinct: int, mass: float):
    floor, spread = total + distinct + 1, mass + distinct + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows must come in order of chunk, kind and range: a chunk's answers are in the order of its keys."""
        levels, exact = {WORD: [], PAIR: []}, []
        for batch in batches:
            for kind, level, times, keys, back, ids, flags, sizes in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind != TEXTS:
                    levels[kind].append(np.frombuffer(decompress(level), np.uint8))
                    if kind == WORD:
                        exact.append(_numbers(times, len(levels[kind][-1])))
                    continue
                word, size = np.frombuffer(keys, _U), np.frombuffer(sizes, np.int64)
                back = np.ascontiguousarray(np.frombuffer(decompress(back), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                ids, flags = np.frombuffer(ids, np.int64), np.frombuffer(flags, np.uint8)
                own, times = quantised(np.concatenate(levels[WORD])), np.concatenate(exact)
                own[times == 0] = 0  # a word that training doesn't hold is the unknown one
                one, known, logs, times = (own + 1) / spread, times > 0, np.log10(times + 1.0), times.astype(np.float64)
                pair, pair_back = np.unique(pairs(word[back], size)[0], return_inverse=True)
                both = quantised(np.concatenate(levels[PAIR]))
                if len(own) != len(word) or len(both) != len(pair):
                    raise ValueError("answers and keys of a chunk differ in number")
                del pair
                end, edge = times[np.searchsorted(word, END)], np.concatenate(([0], np.cumsum(size)))  # as many starts as ends
                n_known, base, total_log = np.empty(len(size), np.int64), np.empty(len(size)), np.empty(len(size))
                for d in range(0, len(size), 512):
                    few = slice(d, d + 512)
                    a, b = edge[d], edge[min(d + 512, len(size))]
                    doc, at = np.repeat(np.arange(len(size[few])), size[few]), back[a:b]
                    add = lambda x: np.bincount(doc, x, len(size[few]))  # noqa: E731, B023
                    prior = np.empty(b - a)
                    prior[1:] = times[at[:-1]]
                    prior[edge[:-1][few] - a] = end
                    weight = np.where(prior > 0, MIX, 0.0)
                    two = np.minimum(both[pair_back[a:b]], np.minimum(prior, times[at])) / np.maximum(prior, 1.0)
                    n_known[few], base[few] = add(known[at]), add(logs[at])
                    total_log[few] = add(np.log10(weight * two + (1 - weight) * one[at]))
                columns = [
                    pa.array(ids, pa.int64(), mask=flags & 2 > 0), pa.array(flags & 1 > 0), pa.array(size), pa.array(n_known),
                    pa.array(np.full(len(size), total, np.int64)), pa.array(base - size * log10(floor)), pa.array(total_log),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")])
                levels, exact = {WORD: [], PAIR: []}, []

    return score


def scores(documents: DataFrame, every: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of documents (doc_id, text)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_bucket(F.col("doc_id"), every) == held, F.lit(False)).alias("held_out"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = max(RANGE_BITS, (size // RANGE_BYTES).bit_length())
    runs = cut(rows.mapInArrow(_count(bits), RUNS))
    asked = runs.filter(F.col("kind") != TEXTS).select("chunk", "kind", "range", "keys", "counts")
    answers = cut(asked.repartition("range").sortWithinPartitions("range").mapInArrow(_answers(bits), ANSWERS))
    total, distinct, mass = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "mass"))).first()
    texts = runs.filter(F.col("kind") == TEXTS)
    chunks = max(1, texts.count())
    back = answers.filter("chunk is not null").select("chunk", "kind", "range", "levels", "exact")
    both = back.unionByName(texts.select("chunk", "kind", "range", "keys", "counts", "ids", "flags", "sizes"), allowMissingColumns=True)
    both = both.repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind", "range").select("kind", "levels", "exact", "keys", "counts", "ids", "flags", "sizes")
    return both.mapInArrow(_score(total, distinct, mass), SCORED)
