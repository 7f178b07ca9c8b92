"""What the operators must return, worked out one by one in plain Python over a few rows."""

import collections
import hashlib
import math
import re
import struct

import numpy as np
import xxhash


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def xx(value, seed=42):
    """Spark's xxhash64 of a string's bytes or of a number, unsigned."""
    return xxhash.xxh64_intdigest(value if isinstance(value, bytes) else struct.pack("<Q", value), seed)


def signed(x):
    return x - (x >> 63 << 64)


class Groups:
    """Union-find; the least member stands for a group."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x


def line_words(line):
    return re.sub("([぀-ヿ㐀-鿿가-힯])", r" \1 ", line).encode().split()


def few_edits(n):
    return 2 if n >= 24 else 1 if n >= 10 else 0


def without_repeated_lines(rows):
    """(doc_id, text) of rows to the texts left of them; a text's lines are judged by doc_id, hash of the text and number."""
    version = lambda t: signed(xx(t.encode()))
    places = sorted({(d, version(t), at, line) for d, t in rows if d is not None and t is not None for at, line in enumerate(t.split("\n")) if line_words(line)})
    kinds = list(dict.fromkeys(p[3] for p in places))
    toks, same = {x: line_words(x) for x in kinds}, Groups()
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            e = few_edits(min(len(toks[a]), len(toks[b])))
            if e and abs(len(toks[a]) - len(toks[b])) <= e and edit(toks[a], toks[b]) <= e:
                same.join(a, b)
    first = {}
    for p in places:
        first.setdefault(same.find(p[3]), p[:3])
    gone = {p[:3] for p in places if first[same.find(p[3])] != p[:3]}
    left = lambda d, t: "\n".join(x for at, x in enumerate(t.split("\n")) if (d, version(t), at) not in gone)
    return [t if t is None or d is None else left(d, t) for d, t in rows], gone


def shingles(t):
    w = split(low(t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(rows):
    """doc_id of each row's group (the least), by row; a text joins its doc_id's other rows through equal sets only."""
    sets = [(d, frozenset(shingles(t))) for d, t in rows]
    same = Groups()
    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if x and y and d is not None and e is not None and 100 * len(x & y) >= 75 * len(x | y):
                same.join(d, e)
    return [d if not x or d is None else same.find(d) for d, x in sets]


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))


def contaminated(texts, items):
    windows = {tuple(w[i : i + min(10, len(w))]) for w in map(alnum, items) if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    return [any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)) for w in map(alnum, texts)]


def base_failed(t):
    w = split(t or "")
    n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w) < 20 or 100 * len(hit) > 30 * len(w)


def quality(rows, labels, buckets, scale, held_every, rejected):
    """(score, kept) of each row of (doc_id, text); labels: (doc_id, quality, toxic)."""

    def grams(t):
        h = [xx(w.encode()) for w in split(t or "")]
        return [signed(x) % buckets for x in h + [xx(b, xx(a)) for a, b in zip(h, h[1:])]]

    trusted = {d for d, q, toxic in labels if q == 1 and not toxic}
    held = {d for d in trusted if signed(xx(d)) % held_every == 0}
    raw, target = collections.Counter(), collections.Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d in trusted - held:
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    weight = {b: round(scale * (math.log((target[b] + 1) / (m + buckets)) - math.log((raw[b] + 1) / (n + buckets)))) if m else 0 for b in raw}
    score = [sum(weight[b] for b in g) / (len(g) * scale) if (g := grams(t)) else 0.0 for _, t in rows]
    passed = [s for s, (d, t) in zip(score, rows, strict=True) if d in held and not base_failed(t)]
    least = np.quantile(passed, rejected) if passed else -0.5
    return [(s, not base_failed(t) and s >= least - 1e-12) for s, (_, t) in zip(score, rows, strict=True)]


def sha(data):
    return hashlib.sha256(data).hexdigest()
