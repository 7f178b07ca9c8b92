"""Language of whole texts by a byte convolutional network trained here in numpy.

The network reads windows of ``WINDOW`` bytes: filters of several widths over byte embeddings, a
maximum over the window, rectifier, softmax. A text's windows are all read; its class scores are their
mean log-probabilities. As a filter is linear before its maximum, its value is a sum of entries
of per-byte tables, and of byte-pair tables where widths allow; prediction looks them up.

Training takes about ``TRAIN_PER_CLASS`` labelled rows a language, by a share of hashes, but no more than
``TRAIN_ROWS`` in all or one a language, and ``TRAIN_WINDOWS`` windows of each, spread evenly over the text;
prediction reads every byte of every row. Defined cases: null texts
and texts without a letter are ``und`` with score 0; rows without lang are not learned from but are
predicted; with no labelled row all texts are ``und``; ties go to the alphabetically first language;
one result row for each row of documents, repeats included; an empty table gives an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import crc_bucket, cut

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 12, 8
TRAIN_PER_CLASS, TRAIN_ROWS, TRAIN_WINDOWS = 600, 20_000, 4
EPOCHS, BATCH, RATE = 6, 64, 0.01
CHUNK = 256  # windows read at once


def windows(data: bytes) -> np.ndarray:
    """All of data as rows of WINDOW bytes, zeros at the end of the last."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: list[np.ndarray]  # for each width: (width, EMBED, FILTERS)
    bias: np.ndarray  # (widths * FILTERS,)
    out: np.ndarray  # (widths * FILTERS, classes)
    out_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray, bool]]]:
        """For each width its lookups: (offset, table, over byte pairs)."""
        found = []
        for f in self.filters:
            own, k = [], 0
            one = [(self.embed @ f[i]).astype(np.float32) for i in range(len(f))]
            while k < len(f):
                if k + 1 < len(f):
                    own.append((k, (one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, FILTERS), True))
                    k += 2
                else:
                    own.append((k, one[k], False))
                    k += 1
            found.append(own)
        return found

    def pooled(self, x: np.ndarray, tables, argmax: bool = False):
        """Maxima of all filters over windows x, before the rectifier; with argmax also their places."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        best, where = [], []
        for width, own in zip(WIDTHS, tables, strict=True):
            n = WINDOW - width + 1
            total = None
            for at, table, pairs in own:
                part = table[(pair if pairs else x)[:, at : at + n]]
                total = part if total is None else total + part
            if argmax:
                where.append(total.argmax(axis=1))
            best.append(total.max(axis=1))
        top = np.concatenate(best, axis=1) + self.bias
        return (top, where) if argmax else top

    def log_probabilities(self, x: np.ndarray, tables) -> np.ndarray:
        z = np.maximum(self.pooled(x, tables), 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(pieces: list[list[str]], langs: list[str], seed: int = 7) -> Network:
    """Fit a network by Adam on cross entropy to a window of each piece; gradients pass through the maxima to the bytes that made them."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    x = np.concatenate([windows(t.encode("utf-8", "surrogatepass"))[:1] for own in pieces for t in own])
    y = np.repeat([names.index(v) for v in langs], [len(own) for own in pieces])
    units = FILTERS * len(WIDTHS)
    net = Network(names, rng.normal(0, 0.3, (256, EMBED)), [rng.normal(0, 0.3, (w, EMBED, FILTERS)) for w in WIDTHS], np.zeros(units), rng.normal(0, 0.2, (units, len(names))), np.zeros(len(names)))
    params = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
    mean, var, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            i = order[a : a + BATCH]
            xb, n = x[i], len(i)
            top, where = net.pooled(xb, net.tables_small(), argmax=True)
            act = np.maximum(top, 0)
            z = act @ net.out + net.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(n), y[i]] -= 1
            d /= n
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = act.T @ d, d.sum(axis=0)
            back = (d @ net.out.T) * (top > 0)
            grads[-3] = back.sum(axis=0)
            for j, width in enumerate(WIDTHS):
                own = back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(width):
                    byte = xb[np.arange(n)[:, None], where[j] + k]
                    e = net.embed[byte]  # rows, FILTERS, EMBED
                    grads[1 + j][k] += np.einsum("nf,nfe->ef", own, e)
                    np.add.at(grads[0], byte.ravel(), (own[:, :, None] * net.filters[j][k].T[None]).reshape(-1, EMBED))
            step += 1
            for p, g, m, v in zip(params, grads, mean, var, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _tables_small(self: Network):
    """As tables(), by single bytes only: cheap to make anew after each step."""
    return [[(k, (self.embed @ f[k]).astype(np.float32), False) for k in range(len(f))] for f in self.filters]


Network.tables_small = _tables_small

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(texts: list[str | None], net: Network, tables) -> tuple[list[str], np.ndarray]:
    """Languages and scores of whole texts."""
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    total, count, held, owner = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts)), [], []
    pending = 0

    def flush():
        nonlocal pending
        if held:
            x, own = np.concatenate(held), np.concatenate(owner)
            for a in range(0, len(x), CHUNK):
                p = net.log_probabilities(x[a : a + CHUNK], tables)
                np.add.at(total, own[a : a + CHUNK], p)
                np.add.at(count, own[a : a + CHUNK], 1)
            held.clear()
            owner.clear()
            pending = 0

    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            held.append(windows(text.encode("utf-8", "surrogatepass")))
            owner.append(np.full(len(held[-1]), i))
            pending += len(held[-1])
            if pending >= 8 * CHUNK:
                flush()
    flush()
    for i in np.flatnonzero(count):
        mean = total[i] / count[i]
        p = np.exp(mean - mean.max())
        best = int(mean.argmax())
        names[i], score[i] = net.langs[best], p[best] / p.sum()
    return names, score


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            for at in range(0, len(batch), 1024):
                rows = batch.slice(at, 1024)
                texts = rows.column(2).to_pylist()
                names, score = predict(texts, net, tables) if net else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def spread(text, n: int, width: int):
    """Distinct pieces of a text of width characters, n at most, from its start to its end."""
    at = lambda k: F.floor(F.greatest(F.length(text) - width, F.lit(0)) * k / max(1, n - 1)).cast("int") + 1
    return F.array_distinct(F.array(*(F.substr(text, at(k), F.lit(width)) for k in range(n))))


def fit(rows: DataFrame) -> Network | None:
    """A network from a bounded sample of rows (doc_id, text, lang)."""
    labelled = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A share of each language by hash; no task gathers a language's rows.
    count = cut(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    each = max(1, min(TRAIN_PER_CLASS, TRAIN_ROWS // max(1, count.count())))
    few = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.least(F.lit(1.0), each / F.col("n")) * (1 << 30)
    texts = labelled.join(count, "lang").filter(few).select("doc_id", "lang", spread(F.col("text"), TRAIN_WINDOWS, WINDOW).alias("pieces"))
    got = texts.distinct().orderBy("doc_id", "lang", "pieces").toPandas()  # about each rows a language
    return train([list(x) for x in got["pieces"]], got["lang"].tolist()) if len(got) else None


def languages(documents: DataFrame, every: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of documents (doc_id, text, lang)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_bucket(F.col("doc_id"), every) == held, F.lit(False)).alias("held_out"), "text", "lang")
    net = fit(rows.filter("not held_out and doc_id is not null"))  # a few thousand numbers
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(net), PREDICTED)
