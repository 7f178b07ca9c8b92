"""Hard negatives and the filter audit against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from brute import split
from pyspark.sql import functions as F

from attestry.llm import audit, negatives

VECTORS = "vec_id long, embedding array<double>, label int, codes string"


def whole(v):
    return [math.floor(256 * x) if abs(x) < 2**52 else int(x) * 256 for x in v]


def mined(rows):
    """The contract, one anchor after the other."""
    full = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, whole(v)) for i, v, lab, _ in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)
    out = []
    for i, lab, q in sorted({(i, lab, tuple(q)) for i, lab, q in full if i % 100 == 0}):
        scored = sorted((-dot(q, v), j, m) for j, m, v in full)
        for s, p, _ in [x for x in scored if x[2] == lab and x[1] != i][:5]:
            negs = [(j, -t) for t, j, m in scored if m != lab and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, p, k, j, -s, t) for k, (j, t) in enumerate(negs, 1)]
    return sorted(out)


def rows_of(n, dims, seed, scale=1.0):
    rng = random.Random(seed)
    return [(k, [scale * rng.gauss(0.3, 1) for _ in range(dims)], k % 3, "x") for k in range(n)]


ODD = [(None, [1.0] * 5, 1, "x"), (700, None, 1, "x"), (701, [1.0, None], 1, "x"), (702, [float("nan")] * 5, 1, "x"), (703, [float("inf")] * 5, 1, None), (704, [1.0] * 5, None, "x")]
TIES = [(k, [1.0, 1.0, 1.0, 1.0, 1.0], k % 4, "x") for k in range(800, 860)] + [(k, [0.5] * 5, k % 4, "x") for k in range(860, 900)] + 3 * [(900, [1.0] * 5, 2, "x")]
OF_SIZES = [(1000, [1.0, 2.0], 1, "x"), (1001, [], 1, "x"), (1002, [0.5] * 9, 2, "x"), (1003, [0.6] * 9, 1, "x"), (1004, [0.4] * 3, 2, "x")]


@pytest.mark.parametrize("rows", [rows_of(450, 5, 1), ODD + TIES + OF_SIZES + rows_of(101, 5, 2), rows_of(130, 4, 3, 1e7), rows_of(110, 3, 4, 1e30), rows_of(90, 3, 5)[1:], []])
def test_hard_negatives(spark, rows, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 2)  # several blocks
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, label, F.col("vec_id") % 100 == 0)
    assert got.columns == [c.split()[0] for c in negatives.RESULT.split(", ")]
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_bounds_hold_and_leave_few_rows():
    rng = np.random.default_rng(0)
    x = np.floor(32 * rng.standard_normal((20_000, 64)))
    books = negatives.fit(x[:4_000])
    codes, reach = negatives.encode(books, x)
    few = 0
    for a in range(20):
        table = np.einsum("mkd,md->mk", books, negatives.pairs_of(x[a : a + 1])[0]).ravel()
        about, true = table[codes + 256 * np.arange(32)].sum(1), negatives.exact(x, x[a])
        bound = np.linalg.norm(x[a]) * reach
        assert (np.abs(about - true) <= bound).all()
        few += (about + bound >= np.sort(true)[-10]).sum()
    assert few < 0.05 * 20 * len(x)


def test_windows_and_whole_numbers():
    for s in [*range(-50, 200), 2**62, 2**63 - 1]:
        lo, hi = negatives.window_of(s)
        assert 30 * s <= 100 * lo < 30 * s + 100 and 90 * s - 100 < 100 * hi <= 90 * s
    big = np.array([[2.0**60, 3.0], [2.0**40, 1.0], [-(2.0**62), 1.0]])
    assert negatives.exact(big, np.array([4.0, 2.0])).tolist() == [2**62 + 6, 2**42 + 2, -(2**63)]


DOCS = "doc_id long, text string, source string, part string"


def audited(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for d, t, s, _ in rows:
        t = t or ""
        w = split(t)
        same = [e for e, u, *_ in rows if (u or "") == t and e is not None]
        late = d is not None and d > min(same)
        mask = {c for c, f in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), late]) if f}
        fails.append((s or "", mask, d in good, d in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f[1:] for f in fails if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                before = set(order[:k])
                gone = [x for x in own if c in x[0] and not x[0] & before]
                total[c] += len(gone)
                kept = sum(not x[0] & (before | {c}) for x in own)
                out[part, "".join(order), k + 1] = [kept, len(gone), sum(c in x[0] and bool(x[0] & before) for x in own), sum(x[0] == {c} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone), c]
        for key in out:
            if key[0] == part:
                out[key][-1] = total[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def texts():
    rng = random.Random(7)
    base = ["".join(rng.choice("ab é😀\n") for _ in range(n)) for n in (0, 3, 64, 65, 1500, 3000)]
    long = [" ".join(f"w{rng.randrange(400)}" for _ in range(250)), " ".join(["same"] * 300), "LOUD " + " ".join(f"v{k}" for k in range(300)), "x" * 200_000, "x" * 199_999 + "y"]
    near = [t[:-1] + "z" for t in base if t] + ["z" + t[1:] for t in base if t]
    return base + long + near + ["a $ b", "", None, "\U0001f600" * 64, " \t\n"]


@pytest.mark.parametrize("weak", [False, True])
def test_filter_audit(spark, weak):
    rng = random.Random(3)
    rows = [(k, t, rng.choice(["s", "t", "", None]), "clash") for k, t in enumerate(3 * texts())]
    rows += [(None, "a $ b", "s", None), (None, None, None, None), (2, "another text", "s", ""), (2, "another text", "s", ""), (5, "a $ b", "t", ""), *((k, "hot text", "u", "") for k in range(200, 260))]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 240, 3)] + [(3, 1, 1), (3, None, None), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    masks = audit.masks(docs, (lambda c: F.lit(1).cast("long")) if weak else F.xxhash64)  # weak: all texts of a length share a class
    got = audit.audit(masks, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == audited(rows, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert audit.audit(audit.masks(none), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
