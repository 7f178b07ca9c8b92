"""Personal data in whole texts: exact base rules, and a character BiLSTM with CRF transitions.

The network is trained here in numpy on labelled spans: personal data of the four kinds, in plain and
in unusual spellings, is set into snippets of about ``TRAIN_TEXTS`` texts, a share of them by hash, each
from anywhere in its text. It reads overlapping windows of the whole text but for those without a digit or
an @: a span of these kinds has one, so no window without could add any. Windows are
decoded by Viterbi; each place takes the tag of the window in which it lies deepest, over the whole
text; runs of a kind are spans. Spans of the method that touch no base span and hold an @ or at least
``LEAST_DIGITS`` digits are added to the base spans.

Offsets are code points, ends exclusive. Defined cases: null is the empty text, without spans; one
result row for each row of documents, repeats included; without any text the network learns from bare
spans; an empty table gives an empty result; where two windows lie equally deep at a place, the earlier
one's tag stands; spans that start together are in order of their ends.
"""

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits matches from its start or not at all, so later starts needn't be tried.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WINDOW, STRIDE = 64, 32
HIDDEN, EMBED, TAGS = 16, 8, 1 + len(KINDS)
TRAIN_TEXTS, TRAIN_WINDOWS, EPOCHS, BATCH, RATE = 400, 1600, 5, 32, 0.02
LEAST_DIGITS = 7
SNIPPET = 1000

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules by kind, then start."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    if re.search("[0-9]", text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_MARKS = "@.+- ()_%\n,:;/"
CLASSES = 4 + len(_MARKS) + 2


def classes(text: str) -> np.ndarray:
    """Character classes: lower, upper, digit, each mark, other ASCII, all else; 0 is beyond the text."""
    table = np.full(129, 4 + len(_MARKS), np.int64)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 1, 2, 3
    for i, c in enumerate(_MARKS):
        table[ord(c)] = 4 + i
    table[128] = CLASSES - 1
    return table[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def initial(rng) -> dict[str, np.ndarray]:
    p = {"embed": rng.normal(0, 0.5, (CLASSES, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p |= {f"w{d}": rng.normal(0, 0.3, (EMBED + HIDDEN, 4 * HIDDEN)), f"b{d}": np.zeros(4 * HIDDEN)}
    return p


def _lstm(p, d: str, x: np.ndarray, keep: bool = False):
    """Hidden states over x (batch, time, EMBED), backwards for d = b; with keep what the gradient needs."""
    n, steps, _ = x.shape
    h, c, out, kept = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.empty((n, steps, HIDDEN)), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = np.concatenate([x[:, t], h], axis=1)
        g = z @ p[f"w{d}"] + p[f"b{d}"]
        gate, cand = _sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
        before, c = c, f * c + i * cand
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        if keep:
            kept.append((t, z, i, f, o, cand, before, tc))
    return out, kept


def _lstm_back(p, d: str, kept, dout: np.ndarray, grads, dx: np.ndarray) -> None:
    dh, dc = np.zeros((len(dout), HIDDEN)), np.zeros((len(dout), HIDDEN))
    for t, z, i, f, o, cand, before, tc in reversed(kept):
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)], axis=1)
        grads[f"w{d}"] += z.T @ dg
        grads[f"b{d}"] += dg.sum(axis=0)
        dz = dg @ p[f"w{d}"].T
        dx[:, t] += dz[:, :EMBED]
        dh, dc = dz[:, EMBED:], dc * f


def scores(p, x: np.ndarray) -> np.ndarray:
    e = p["embed"][x]
    return np.concatenate([_lstm(p, "f", e)[0], _lstm(p, "b", e)[0]], axis=2) @ p["out"] + p["out_b"]


def _logsum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Maximize the CRF likelihood of tags y of windows x by Adam."""
    rng = np.random.default_rng(seed)
    p = initial(rng)
    mean, var, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    steps = x.shape[1]
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            xb, yb = x[order[a : a + BATCH]], y[order[a : a + BATCH]]
            n, rows = len(xb), np.arange(len(xb))
            e = p["embed"][xb]
            (hf, kf), (hb, kb) = _lstm(p, "f", e, True), _lstm(p, "b", e, True)
            h = np.concatenate([hf, hb], axis=2)
            s = h @ p["out"] + p["out_b"]
            alpha, beta = np.empty_like(s), np.zeros_like(s)
            alpha[:, 0] = s[:, 0]
            for t in range(1, steps):
                alpha[:, t] = s[:, t] + _logsum(alpha[:, t - 1, :, None] + p["trans"], 1)
            for t in range(steps - 2, -1, -1):
                beta[:, t] = _logsum(p["trans"] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            z = _logsum(alpha[:, -1], 1)
            ds = np.exp(alpha + beta - z[:, None, None])
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            for t in range(1, steps):
                joint = np.exp(alpha[:, t - 1, :, None] + p["trans"] + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
                grads["trans"] += joint.sum(axis=0)
                np.add.at(grads["trans"], (yb[:, t - 1], yb[:, t]), -1.0)
            for t in range(steps):
                ds[rows, t, yb[:, t]] -= 1
            ds /= n
            grads["trans"] /= n
            grads["out"], grads["out_b"] = np.einsum("nth,ntk->hk", h, ds), ds.sum(axis=(0, 1))
            dh, dx = ds @ p["out"].T, np.zeros_like(e)
            _lstm_back(p, "f", kf, dh[:, :, :HIDDEN], grads, dx)
            _lstm_back(p, "b", kb, dh[:, :, HIDDEN:], grads, dx)
            np.add.at(grads["embed"], xb, dx)
            step += 1
            for k in p:
                g = np.clip(grads[k], -1, 1)
                mean[k] += 0.1 * (g - mean[k])
                var[k] += 0.001 * (g * g - var[k])
                p[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return p


def decode(p, x: np.ndarray) -> np.ndarray:
    """Best tags of windows x."""
    s = scores(p, x)
    best, back = s[:, 0], []
    for t in range(1, x.shape[1]):
        step = best[:, :, None] + p["trans"]
        back.append(step.argmax(axis=1))
        best = s[:, t] + step.max(axis=1)
    tags = np.empty(x.shape, np.int64)
    tags[:, -1] = best.argmax(axis=1)
    for t in range(x.shape[1] - 2, -1, -1):
        tags[:, t] = back[t][np.arange(len(x)), tags[:, t + 1]]
    return tags


def _invented(kind: int, rng) -> str:
    """Personal data of a kind, often spelled in a way that the base rules don't know."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(3, 9)))
    if kind == 0:
        return f"{word()}{rng.choice(['.', '_', ''])}{word()}{rng.choice(['@', '@', '@', ' @ '])}{word()}.{rng.choice(['com', 'org', 'net', 'example.org'])}"
    if kind == 1:
        return ".".join(str(v) for v in rng.integers(0, 256, 4))
    if kind == 2:
        gap = rng.choice(["", " ", "-", "  "])
        return gap.join(digits(4) for _ in range(4))
    gap = rng.choice([" ", "-", ".", ""])
    return f"{rng.choice(['+', '+', '00', ''])}{rng.integers(1, 99)}{gap}{digits(3)}{gap}{digits(3)}{gap}{digits(4)}"


def labelled(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows with invented spans set into snippets of texts, and their tags."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((TRAIN_WINDOWS, WINDOW), np.int64), np.zeros((TRAIN_WINDOWS, WINDOW), np.int64)
    for i in range(TRAIN_WINDOWS):
        source = texts[i % len(texts)] if texts else ""
        at = int(rng.integers(0, max(1, len(source) - WINDOW)))
        host = source[at : at + WINDOW]
        kind = i % (TAGS + 1)  # some windows stay plain, some get a bare number
        span = _invented(kind - 1, rng) if 0 < kind < TAGS else str(rng.integers(0, 99999)) if kind == TAGS else ""
        cut = int(rng.integers(0, max(1, len(host) - 8)))
        text = (host[:cut] + " " + span + " " + host[cut:])[:WINDOW]
        x[i, : len(text)] = classes(text)
        if 0 < kind < TAGS:
            y[i, cut + 1 : min(WINDOW, cut + 1 + len(span))] = kind
    return x, y


def method_spans(text: str, p) -> list[Span]:
    """Spans that the network finds, reconciled over the whole text."""
    marks = [m.start() for m in re.finditer("[0-9@]", text)]
    if not marks:
        return []
    starts = sorted({k * STRIDE for m in marks for k in range(max(0, (m - WINDOW) // STRIDE + 1), m // STRIDE + 1)})
    ids = np.concatenate([classes(text), np.zeros(WINDOW, np.int64)])
    depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1
    tag, deepest = np.zeros(len(text) + WINDOW, np.int64), np.zeros(len(text) + WINDOW, np.int64)
    for a in range(0, len(starts), 1024):
        part = starts[a : a + 1024]
        for s, tags in zip(part, decode(p, np.stack([ids[s : s + WINDOW] for s in part])), strict=True):
            better = depth > deepest[s : s + WINDOW]
            tag[s : s + WINDOW][better] = tags[better]
            deepest[s : s + WINDOW][better] = depth[better]
    tag = tag[: len(text)]
    edge = np.flatnonzero(np.concatenate(([True], tag[1:] != tag[:-1], [True]))) if len(tag) else np.zeros(0, int)
    return [(int(tag[a]) - 1, int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True) if tag[a]]


def spans(text: str, p) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by kind, then start."""
    base = base_spans(text)
    more = []
    for kind, a, b in method_spans(text, p):
        part = text[a:b]
        a, b = a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())
        if (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
            continue  # part of a longer token
        if ("@" in part or sum("0" <= c <= "9" for c in part) >= LEAST_DIGITS) and all(b <= s or e <= a for _, s, e in base):
            more.append((kind, a, b))
    return base, sorted(base + more)


def show(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _find(p):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [spans(t.as_py() or "", p) for t in batch.column(1)]
            count = [[sum(k == kind for k, _, _ in base) for base, _ in got] for kind in range(len(KINDS))]
            columns = [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in count), pa.array([sha256(show(b).encode()).hexdigest() for b, _ in got], pa.string()), pa.array([show(s) for _, s in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])

    return run


def fit(documents: DataFrame) -> dict[str, np.ndarray]:
    """A network trained in snippets of about TRAIN_TEXTS texts."""
    rows = documents.filter("text is not null and doc_id is not null")
    at = F.xxhash64("doc_id", "text")
    few = rows.filter(F.pmod(F.shiftrightunsigned(at, 8), F.lit(1 << 30)) < min(1.0, TRAIN_TEXTS / max(1, rows.count())) * (1 << 30))
    start = F.pmod(at, F.greatest(F.length("text") - SNIPPET, F.lit(1)).cast("long")).cast("int") + 1
    got = few.select(F.substr("text", start, F.lit(SNIPPET)).alias("t")).distinct().orderBy("t").collect()  # TRAIN_TEXTS rows, about
    return train(*labelled([r["t"] for r in got]))


def personal_data(documents: DataFrame) -> DataFrame:
    """The columns of FOUND for each row of documents (doc_id, text)."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(fit(documents)), FOUND)
