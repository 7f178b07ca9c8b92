"""The Jaccard join against brute force; bounds, prefixes and trees by themselves."""

import random

import numpy as np
import pytest
from brute import Groups, shingles

from attestry.llm import jaccard
from attestry.llm.minhash import WordHashes
from attestry.llm.minhash import shingles as hashed

ROWS = "doc_id long, text string, n_shingles string, item string"


def joined(rows):
    """component of each doc_id; a doc_id's texts are one document."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    same = Groups()
    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                same.join(d, e)
    return {d: same.find(d) for d, _ in sets}


def near(rng, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        at = rng.randrange(len(ws))
        ws[at : at + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"] * rng.randrange(2)
    return ws


def corpus(seed):
    """Groups of near copies around the threshold, a passage that many texts share, sizes of all kinds, repeats."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for n in (5, 6, 8, 12, 30, 60, 120, 300):
        base = [word() for _ in range(n)]
        texts += [" ".join(near(rng, base, rng.randrange(0, max(2, n // 20)))) for _ in range(12)]
    texts += [" ".join([word() for _ in range(rng.randrange(10, 90))] + passage + [word() for _ in range(rng.randrange(10, 90))]) for _ in range(60)]
    chain = [word() for _ in range(100)]
    for _ in range(15):
        chain = near(rng, chain, 1)
        texts.append(" ".join(chain))
    texts += ["a b c d e f g h i j k l m n", "A B c d e f g h i j k l m", "one two", "One  two", "two one", "x", "", None, " \t\n", "é É", "y" * 100_000]
    rng.shuffle(texts)
    return [(3 * k, t) for k, t in enumerate(texts)] + [(30, texts[3]), (30, "a text of its own that no one else has at all"), (None, texts[0]), (None, None), (None, "only here")]


@pytest.mark.parametrize("fan,split,frequent", [(256, 4096, 10_000), (2, 4, 10_000), (3, 2, 1)])
def test_join_against_brute_force(spark, monkeypatch, fan, split, frequent):
    """Small nodes make trees of several levels; a sample of few texts puts the shared passage first in the order."""
    monkeypatch.setattr(jaccard, "FAN", fan)
    monkeypatch.setattr(jaccard, "SPLIT", split)
    monkeypatch.setattr(jaccard, "SAMPLE", frequent)
    rows = corpus(fan)
    docs = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], ROWS).repartition(4)
    got = jaccard.similar(docs).collect()
    assert len(got) == len(rows)
    want = joined(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    sizes = sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got)
    assert sizes == sorted((d or -1, len(shingles(t))) for d, t in rows)
    assert len(set(want.values())) < len(want) - 60
    lone = [r["component_id"] for r in got if r["doc_id"] is None]
    assert sorted(lone, key=str) == sorted([want[0], None, None], key=str)


def test_groups_that_pivots_leave_apart(spark, monkeypatch):
    """No text is linked to the one with the least id, but they are in pairs to each other."""
    monkeypatch.setattr(jaccard, "FAN", 4)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(40):
        mine = [f"x{k}.{j}" if j % 13 == k % 13 else w for j, w in enumerate(base)]
        rows += [(10 * k + 10 + j, " ".join(near(rng, mine, j))) for j in range(3)]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == joined(rows)


def test_empty(spark):
    assert jaccard.similar(spark.createDataFrame([], ROWS)).count() == 0


def test_bounds_and_prefixes():
    rng, hashes = random.Random(1), WordHashes()
    base = [str(rng.randrange(900)) for _ in range(400)]
    texts = [near(rng, base[: rng.randrange(5, 400)], rng.randrange(30)) for _ in range(150)] + [near(rng, base, k // 4) for k in range(60)]
    sets = [hashed(" ".join(t), hashes) for t in texts]
    some = np.unique(np.concatenate(sets))[::7]
    points = [jaccard.loaded(jaccard.stored(jaccard.point(s))) for s in sets]
    found = 0
    for i, x in enumerate(sets):
        assert points[i].sum() == len(x) and len(points[i]) & (len(points[i]) - 1) == 0
        for j, y in enumerate(sets[:i]):
            common = len(np.intersect1d(x, y))
            assert jaccard.bound(points[i], points[j]) >= common
            if jaccard.linked(common, len(x), len(y)):
                found += 1
                for frequent in (np.empty(0, np.uint64), some):
                    a, b = jaccard.prefix(x, frequent), jaccard.prefix(y, frequent)
                    first = next(k for k in a.tolist() if k in set(b.tolist()))
                    least = min(len(x) - a.tolist().index(first), len(y) - b.tolist().index(first))
                    assert jaccard.linked(least, len(x), len(y))
    assert found > 200


def test_points_of_many_shingles_fold():
    s = np.arange(1, 100_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    p = jaccard.point(s)
    assert len(p) == jaccard.GROUPS and p.sum() == 100_000
    assert (jaccard.folded(p, 64) == np.bincount((s % np.uint64(64)).astype(int), minlength=64)).all()
    wide = jaccard.stored(np.array([300, 1], np.uint32))
    assert jaccard.loaded(wide).tolist() == [300, 1]
