"""The operators against brute force, round trips and libraries, on small fixtures with the awkward cases."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import brute
import numpy as np
import pytest
from brute import edit, few_edits, low, split
from pyspark.sql import functions as F

from attestry.llm import bpe, decontaminate, langid, linededup, lm, minhash, pii, quality, tokencount, warc
from attestry.llm.common import cut_counted, table
from attestry.llm.components import components

P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [(900000, None), (900001, ""), (900002, "  \t\n "), (900003, "Ein Wort"), (900003, "Ein Wort"), (900004, "ein  wort"), (900005, "x" * 3000), (None, "Ein Wort")]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    few = table(spark, sf_dir, "documents").filter("doc_id < 80").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(d, t, None, "odd") for d, t in ODD], "doc_id long, text string, lang string, source string")
    return few.unionByName(odd).withColumn("n_words", F.lit("a clashing name")).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_near_duplicates(docs, texts, empty):
    sets = {}
    for d, t in texts:
        w = split(low(t))
        sets.setdefault(d, set()).update({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = {d: d for d in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert minhash.near_duplicates(empty).count() == 0


def test_a_chain_of_near_copies_is_one_component(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        own = list(words)
        for k in range(i % 4):
            own[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.agg(F.max("component_id")).first()[0] == 0


@pytest.mark.parametrize("size,share", [(20, 0.75), (100, 0.5), (100, 0.9), (400, 0.75)])
def test_signatures_vary_less_than_plain_minhash(size, share):
    """Affine orders instead of all orders keep what ranks are for: the error is well below that of independent slots."""
    rng = np.random.default_rng(size)
    both, sets = round(size * 2 * share / (1 + share)), []
    for _ in range(300):
        common = rng.integers(0, 2**64, both, np.uint64)
        sets += [np.sort(np.concatenate([common, rng.integers(0, 2**64, size - both, np.uint64)])) for _ in "ab"]
    s, similarity = minhash.signatures(sets), both / (2 * size - both)
    error = (s[0::2] == s[1::2]).mean(axis=1) - similarity
    plain = similarity * (1 - similarity) / minhash.SLOTS
    assert abs(error.mean()) < 0.01 and (error**2).mean() < 0.85 * plain


def best_pieces(pieces, t):
    """(pieces, score) of a text by the plain rules: all segmentations, first start wins ties, unknown characters a piece a byte."""
    least = min(pieces.values()) - tokencount.UNKNOWN_PENALTY
    run = "▁" + t.replace(" ", "▁") if t else ""
    best = [(0.0, 0)] + [None] * len(run)
    for end in range(1, len(run) + 1):
        for start in range(end):
            piece = run[start:end]
            if piece in pieces and best[start] and (best[end] is None or best[start][0] + pieces[piece] > best[end][0]):
                best[end] = (best[start][0] + pieces[piece], best[start][1] + 1)
        if run[end - 1] not in pieces and (best[end] is None or best[end - 1][0] + least > best[end][0]):
            best[end] = (best[end - 1][0] + least, best[end - 1][1] + len(run[end - 1].encode()))
    return best[-1][1], best[-1][0]


def test_token_counts_with_ties_and_unknown_runs():
    rng = random.Random(8)
    for _ in range(60):
        letters = ["a", "b", "c", "▁"]
        pieces = {"▁": -1.0, "a": -2.0, "b": -2.0} | {"".join(rng.choices("abc", k=rng.randrange(1, 4))): float(-rng.randrange(1, 5)) for _ in range(6)} | {"▁" + rng.choice("abc"): -2.0}
        counter = tokencount.Counter(pieces)
        for _ in range(30):
            t = "".join(rng.choice([*letters[:3], " ", "日", "é", "😀"]) for _ in range(rng.randrange(12)))
            assert tokencount.count(t, counter) == best_pieces(pieces, t), (pieces, t)


def test_token_counts_frame(docs, texts):
    got = tokencount.token_counts(docs, P.path("piece_bpe_32k.model")).collect()
    pieces = tokencount.load_pieces(P.path("piece_bpe_32k.model"))
    counter = tokencount.Counter(pieces)
    assert len(got) == len(texts) and all((r["n_tokens"], r["score"]) == tokencount.count(t, counter) for r, (_, t) in zip(got, texts, strict=True))
    assert tokencount.token_counts(docs.filter("false"), P.path("piece_bpe_32k.model")).count() == 0


def test_language(spark, sf_dir, docs, texts):
    whole = table(spark, sf_dir, "documents")
    got = langid.languages(whole.select("doc_id", "text", "lang").unionByName(docs.filter("doc_id >= 900000").select("doc_id", "text", "lang")))
    rows = got.join(whole.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)
    odd = {r["doc_id"]: r for r in got.filter("doc_id >= 900000").collect()}
    assert odd[900000]["lang_pred"] == odd[900001]["lang_pred"] == odd[900002]["lang_pred"] == "und" and odd[900000]["score"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())
    assert {r["lang_pred"] for r in langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_filters_by_tables_are_convolutions():
    rng = np.random.default_rng(3)
    units = langid.FILTERS * len(langid.WIDTHS)
    net = langid.Network(["a", "b"], rng.normal(size=(256, langid.EMBED)), [rng.normal(size=(w, langid.EMBED, langid.FILTERS)) for w in langid.WIDTHS], rng.normal(size=units), rng.normal(size=(units, 2)), rng.normal(size=2))
    texts = ["short", "ein Text " * 60, "é\n1"]
    for tables in (net.tables(), net.tables_small()):
        for t in texts:
            x = langid.windows(t.encode())
            top = np.array([[max(sum(net.embed[row[at + k]] @ f[k][:, j] for k in range(w)) for at in range(langid.WINDOW - w + 1)) for w, f in zip(langid.WIDTHS, net.filters, strict=True) for j in range(langid.FILTERS)] for row in x]) + net.bias
            z = np.maximum(top, 0) @ net.out + net.out_bias
            mean = (z - np.log(np.exp(z).sum(axis=1, keepdims=True))).mean(axis=0)
            names, score = langid.predict([t], net, tables)
            assert names == [net.langs[int(mean.argmax())]] and math.isclose(score[0], np.exp(mean).max() / np.exp(mean).sum(), rel_tol=1e-3)


def test_language_of_awkward_tables(spark, empty, docs):
    assert langid.languages(empty).count() == 0
    late = spark.createDataFrame([(i, "1 2 3 4 5 6 7 8 " * 80 + (a * 300), lang) for i in range(40) for a, lang in (("aeiou ", "xx"), ("zzkkq ", "yy"))], "doc_id long, text string, lang string")
    got = langid.languages(late).join(late.select("doc_id", "text", "lang").withColumnRenamed("lang", "own").withColumnRenamed("text", "t"), "doc_id").collect()
    assert {r["lang_pred"] for r in got} == {"xx", "yy"}  # what tells them apart stands late in the text


def test_bpe(spark, docs, texts):
    tiktoken = pytest.importorskip("tiktoken")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1, "  \x1c  I'll²ß 日本語 12345\n\n \t x' it's　 "), (2, "ab" * 200 + " " + "日" * 90), (3, "a" * 255 + " " + "é" * 128 + " " + "a" * 256), (4, "\u0391\u03a3 \U0001f600\U0001f600 \x00\x7f zaza abababab")], "doc_id long, text string"))
    ranks = bpe.load_ranks(BPE)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(more, BPE, P.PATTERN)
    rows, sums = bpe.decode(encoded, BPE).collect(), bpe.digests(encoded, BPE).collect()
    whole = [(x["doc_id"], x["text"] or "") for x in more.collect()]
    for d, r, (doc, t) in zip(rows, sums, whole, strict=True):
        ids = lib.encode_ordinary(t)
        assert d["doc_id"] == r["doc_id"] == doc and d["ids"] == ids and r["n_tokens"] == len(ids) and bytes(d["decoded"]) == t.encode()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def mutated(rng, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        i = rng.randrange(len(ws) + 1)
        ws[i : i + rng.randrange(2)] = rng.choice([[], [f"v{rng.randrange(9)}"], [f"v{rng.randrange(9)}"]])
    return ws


def test_digests_hold_no_vocabulary_in_their_plan(spark, docs):
    """Its text in the plan stayed on the driver. Ids without their bytes are still decoded."""
    encoded = bpe.encode(docs, BPE, P.PATTERN)
    assert len(bpe.digests(encoded, BPE)._jdf.queryExecution().toString()) < 50_000
    both = bpe.decode(encoded.drop("decoded").limit(20), BPE).collect()
    by_id = {(r["doc_id"], tuple(r["ids"])): r["decoded"] for r in encoded.collect()}
    assert both and all(by_id[r["doc_id"], tuple(r["ids"])] == r["decoded"] for r in both)


def test_bpe_chunks_stand_by_themselves(docs, monkeypatch):
    """Chunks of few words, put together in any order; a task that cuts texts isn't one that puts them together (twice the Python memory)."""
    whole = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(docs, BPE, P.PATTERN).collect())
    monkeypatch.setattr(bpe, "TOKENS", 40)
    encoded = bpe.encode(docs, BPE, P.PATTERN)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == whole
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"MapInArrow(?s:.)*RepartitionByExpression(?s:.)*MapInArrow", plan)


def test_buckets_compare_outlines_alone(spark, monkeypatch):
    """A pair meets under several keys: there outlines rule it out, without its words, and no linked pair is lost."""
    rng, seen = random.Random(7), []
    link = linededup.link
    monkeypatch.setattr(linededup, "link", lambda *a, **k: seen.append(a[4]) or link(*a, **k))
    first = [f"w{rng.randrange(40)}" for _ in range(26)]
    lines = [" ".join(mutated(rng, first, k % 4)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    linededup.dedup_lines(docs)
    describe, fits = seen[0]
    rows = {r["item"]: r["d"] for r in describe(linededup.places(docs).select(F.col("h").alias("item")).distinct()).collect()}
    assert rows and all(len(x) < 30 for d in rows.values() for x in d)
    hashed = lambda c: F.transform(linededup.line_words(F.col(c)), lambda w: F.xxhash64(w))
    outline = lambda c: F.struct(linededup._outline(hashed(c)).alias("s"), linededup._outline(hashed(c), 40).alias("t"))
    pairs = spark.createDataFrame([(a, b) for a in lines for b in lines if a < b], "a string, b string")
    got = pairs.select(linededup.linked(linededup.line_words(F.col("a")), linededup.line_words(F.col("b"))).alias("is"), fits(outline("a"), outline("b")).alias("may"))
    counts = {(r["is"], r["may"]): r["count"] for r in got.groupBy("is", "may").count().collect()}
    assert counts[True, True] and counts[False, False] and (True, False) not in counts


def test_edit_join(spark):
    rng = random.Random(5)
    pairs = []
    for k in range(400):
        a = [f"w{rng.randrange(30)}" for _ in range(rng.choice([1, 9, 10, 11, 22, 23, 24, 25, 26, 60, 90]))]
        pairs.append((" ".join(a), " ".join(mutated(rng, a, k % 6))))
    pairs = [(a.replace(" ", "\t ", k % 3), b) for k, (a, b) in enumerate(pairs)]
    both = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *[f(F.col(c)).alias(f"{n}{c}") for c in "ab" for n, f in (("w", linededup.line_words), ("said", linededup.spaced))])
    df = both.repartition(4)
    keys = [f(F.col(f"said{c}"), F.size(f"w{c}")).alias(f"{name}{c}") for c in "ab" for name, f in (("own", linededup.own_keys), ("near", linededup.near_keys))]
    seen = collections.Counter()
    for r in df.select("*", linededup.linked(F.col("wa"), F.col("wb")).alias("l"), linededup.distance(F.col("wa"), F.col("wb")).alias("d"), *keys).collect():
        far = edit(r["wa"], r["wb"])
        assert min(r["d"], 3) == min(far, 3)
        near = far <= few_edits(min(len(r["wa"]), len(r["wb"])))
        assert r["l"] == near
        if near and r["wa"] != r["wb"] or near and far:
            assert set(r["owna"]) & {*r["ownb"], *r["nearb"]} or set(r["ownb"]) & {*r["owna"], *r["neara"]}
        seen[near] += 1
    assert min(seen.values()) > 50


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    lines = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 5, 9, 10, 15, 23, 24, 40, 60]))] for _ in range(25)]
    lines += [mutated(rng, rng.choice(lines), rng.randrange(4)) for _ in range(60)]
    lines += [list("漢字" * 12), list("漢字" * 11 + "文字"), ["}"], [""]]
    texts = ["\n".join(("" if "漢" in x else " ").join(x) for x in rng.choices(lines, k=rng.randrange(1, 8))) for _ in range(60)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(3, texts[6]), (3, texts[6]), (None, texts[0]), (70, None), (71, ""), (72, " \t\n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("a clashing name")).repartition(5)
    left, gone = brute.without_repeated_lines(rows)
    want = collections.Counter((d, t) for (d, _), t in zip(rows, left, strict=True))
    got = collections.Counter((r["doc_id"], r["text"]) for r in linededup.dedup_lines(df).collect())
    assert got == want and len(gone) > 100


def test_line_dedup(spark, empty):
    long = "this line is long enough to be held against others of its kind"
    rows = [(3, f"{long}\nown words stand here\nx"), (1, f"{long}\nx"), (2, f"{long}s\nanother line of three"), (4, "another line of three\nanother line of three\nnew words of four"), (5, None), (None, long), (6, "")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"{long}\nx", 2: "another line of three", 3: "own words stand here", 4: "new words of four", 5: None, None: long, 6: ""}
    assert linededup.dedup_lines(empty).count() == 0


def test_rows_that_repeat_a_doc_id_keep_their_own_lines(spark):
    rows = [(1, "aaa bbb ccc ddd\nzzz yyy"), (2, "x\naaa bbb ccc ddd"), (2, "p\nunique line of this row")]
    got = {r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[0][1], "x", rows[2][1]}


def test_rows_are_counted_as_they_are_written(spark):
    rows = spark.range(100)
    none = [rows.filter("id < 0"), rows.join(rows.filter("id < 0"), "id"), rows.groupBy("id").count().filter("count > 1"), spark.createDataFrame([], "id long")]
    for df, n in ((rows, 100), *((df, 0) for df in none)):
        table, seen = cut_counted(df)
        assert seen == table.count() == n and cut_counted(df, F.col("id") < 50)[1] == n // 2


def test_components_take_few_jobs(spark):
    """Counts and tests for emptiness come with the tables, so that the driver holds no plans for them."""
    sc, edges = spark.sparkContext, spark.createDataFrame([(i, i + 1) for i in range(1, 60) if i % 20] + [(7, 33)], "a long, b long")
    sc.setJobGroup("components", "")
    try:
        got = {r["item"]: r["component"] for r in components(edges).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("components"))
    finally:
        sc._jsc.clearJobGroup()
    assert got == {i: 41 if i > 40 else 1 for i in range(1, 61)}
    assert jobs <= 32


def test_components_of_several_rounds_take_few_jobs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    sc, edges = spark.sparkContext, spark.createDataFrame(rows, "a long, b long")
    sc.setJobGroup("rounds", "")
    try:
        got = {r["item"]: r["component"] for r in components(edges).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        sc._jsc.clearJobGroup()
    want = {x: x for e in rows if e[0] != e[1] for x in e}
    for _ in want:
        for a, b in rows:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want and jobs <= 50


def test_lines_are_spaced_and_outlined(spark):
    """Odd white space and characters that are words by themselves; an outline is a byte a word."""
    lines = ["plain words", "é ü – two  spaces", "\ttab\x0bvt\fff\rcr ", "  both ends ", "日本 mixed 語 한a", "\u3000 wide \u303f\u3040", "\x01 control \U0001f600 face", "nb\u00a0sp"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    said = linededup.spaced(F.col("line"))
    outline = linededup._outline(F.transform(F.split(said, " "), lambda w: F.xxhash64(w)))
    for r in df.select("line", said.alias("said"), F.octet_length(outline).alias("n")).collect():
        words = brute.split("".join(f" {c} " if re.match(linededup.OWN_WORDS, c) else c for c in r["line"]))
        assert r["said"] == " ".join(words) and r["n"] == len(words)


def test_verification_takes_few_jobs(spark, docs):
    sc = spark.sparkContext
    sc.setJobGroup("verification", "")
    try:
        minhash.verifier(docs)(spark.createDataFrame([(2, 1), (5, 3)], "a long, b long"))
        assert len(sc.statusTracker().getJobIdsForGroup("verification")) <= 5
    finally:
        sc._jsc.clearJobGroup()


def test_near_copies_and_short_lines_go(spark):
    line = "a long line of prose that was copied with one word changed, as happens to boilerplate in many places"
    rows = [(1, f"{line}\nShare\n{'漢字' * 200}"), (2, f"{line.replace('copied', 'quoted')}\nShare\nnew words"), (3, f"own\n{'漢字' * 200}")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "new words", 3: "own"}


def test_personal_data(spark, docs):
    rows = [(1, "a@b.c_d@e.f x@@y.z 1.2.3.4.5.6.7.8 256.1.1.1 or 4111 1111 1111 1111 +1 (555) 123-4567 "), (2, "é me@x.org"), (3, None), (4, "no data here")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[1][k] for k in ("n_email", "n_ip", "n_card", "n_phone")] == [2, 2, 1, 1]
    assert got[2]["base_sha256"] == hashlib.sha256(b"email:2:10").hexdigest() and "email:2:10" in got[2]["spans"].split(",")
    assert got[3]["spans"] == got[4]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_tagger_learns_unseen_spans():
    x, y = pii.labelled(["plain words and 12 numbers of no import " * 5])
    p = pii.train(x, y)
    x, y = pii.labelled(["other words, 7 of them, in another order " * 5], seed=77)
    got = pii.decode(p, x)
    assert (got == y).mean() > 0.93

    def runs(tags):
        edge = [0, *(np.flatnonzero(np.diff(tags)) + 1), len(tags)]
        return {(a, b, int(tags[a])) for a, b in zip(edge, edge[1:]) if tags[a]}

    found = [(runs(g), runs(t)) for g, t in zip(got, y, strict=True)]
    both, ours, theirs = (sum(f(g, t) for g, t in found) for f in (lambda g, t: len(g & t), lambda g, t: len(g), lambda g, t: len(t)))
    assert both > 0.6 * ours and both > 0.6 * theirs


def test_added_spans(spark, docs, empty):
    rows = [(-1, "call 0049 711 555 0199 now or write to jane.doe @ mail.example.org today"), (2, "call 0049 711 555 0199 now " * 2), (2, "x " * 5000 + "reach me@a.org"), (3, "plain")]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))).collect()
    texts = dict(rows[:1])
    for r in got:
        marks = [x.split(":") for x in r["spans"].split(",") if x]
        assert marks == sorted(marks, key=lambda x: (pii.KINDS.index(x[0]), int(x[1]), int(x[2])))
        if r["doc_id"] in texts:
            assert marks and all("@" in texts[-1][int(a) : int(b)] or sum(c.isdigit() for c in texts[-1][int(a) : int(b)]) >= pii.LEAST_DIGITS for _, a, b in marks)
    assert pii.personal_data(empty).count() == 0


def naive_base(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            found.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def test_base_spans_against_the_patterns():
    rng = random.Random(9)
    for _ in range(4000):
        t = "".join(rng.choice("ab1234567890@@..+- ()%_é\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == naive_base(t)


def test_quality(spark, sf_dir, docs, texts, empty):
    labels = table(spark, sf_dir, "labels").withColumn("text", F.lit("a clashing name"))
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == len(texts)
    named = [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()]
    want = brute.quality(texts, named, quality.BUCKETS, quality.SCALE, quality.HELD, quality.REJECTED)
    for r, (_, t), (score, kept) in zip(rows, texts, want, strict=True):
        w = split(t)
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if split(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == brute.base_failed(t) and math.isclose(r["score"], score, abs_tol=1e-12) and r["kept"] == kept
    assert sum(r["kept"] for r in rows) > 20
    assert quality.quality(empty, labels.filter("false")).count() == 0 and quality.quality(empty, labels).count() == 0
    assert all(r["score"] == 0 for r in quality.quality(docs, labels.filter("false")).collect())


def test_plans_of_quality_hold_no_weights(spark, sf_dir, docs):
    """65,536 weights in a plan's text took 350 kB, in each of the texts of all nodes and stages that the driver keeps."""
    plan = quality.quality(docs, table(spark, sf_dir, "labels"), keep=("doc_id",))._jdf.queryExecution().toString()
    assert "_weight" in plan and len(plan) < 50_000


def test_all_trusted_labels_are_used(spark):
    n = 450_000
    ids = quality.trusted_ids(spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic")))
    assert ids.count() == n and abs(ids.filter("held").count() - n / quality.HELD) < 3000


def test_quantile_of_scores_is_percentile(spark):
    rng = random.Random(5)
    for values in ([0.25], [0.5, -0.5], [rng.gauss(0, 1) for _ in range(3000)], [rng.choice([-0.1, 0.1 + 0.2, 0.3, 2.0]) for _ in range(500)], [1.0 + k * 2.0**-52 for k in range(1, 300)] + [-9.0]):
        rows = spark.createDataFrame([(v,) for v in values], "score double")
        for q in (0.0, 0.005, 0.3, 1.0):
            assert quality.quantile(rows, q) == rows.agg(F.percentile("score", F.lit(q))).first()[0]
    assert quality.quantile(rows.filter("false"), 0.5) is None


def test_a_sigma_is_folded_by_itself(spark):
    bench = spark.createDataFrame([(1, "Σab two three"), (2, "ΑΣ İx end")], "item_id long, text string")
    rows = [(1, "a.Σab two three"), (2, "a:Σab two three"), (3, "aΣab two three"), (4, "σab two three"), (5, "x ΑΣ İx END \ue000"), (6, "ας İx end"), (7, "Σab TWO\ue000three Σab TWO three")]
    got = decontaminate.hits(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {r["doc_id"]: r["n_hit"] for r in got} == {1: 3, 2: 3, 3: 0, 4: 0, 5: 3, 6: 0, 7: 3}


def test_one_folding_for_all_texts(spark):
    """An item is found whatever letters stand around it; letters that lower() folds alike stay apart."""
    marks = ["É", "Σ", "ς", "İ", "i\u0307", "\ue000", "\ue001", "Ω", "\u2126", "Å", "\u212b", "ǅ", "Ǆ", "\u212a", "ϴ", "Ⅳ", "A", "é", "σ"]
    item = lambda m: f"{m}cole un deux trois quatre cinq six sept huit neuf{m}"
    bench = spark.createDataFrame([(k, item(m)) for k, m in enumerate(marks)], "item_id long, text string")
    rows = [(100 * k + j, f"{o} x{o} {item(m)} {o}Z ... {o}") for k, m in enumerate(marks) for j, o in enumerate(marks)]
    got = decontaminate.hits(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert [(r["doc_id"], r["n_hit"], r["item_ids"]) for r in got if r["n_hit"] != 10 or r["item_ids"] != [r["doc_id"] // 100]] == []


def test_decontamination(spark, sf_dir, docs, texts, empty):
    bench = table(spark, sf_dir, "benchmark").limit(20).unionByName(spark.createDataFrame([(900, "Ein wort"), (901, None), (None, "wort")], "item_id long, text string"))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    planted = docs.select("doc_id", "text").unionByName(bench.limit(3).select((F.col("item_id") + 5000).alias("doc_id"), F.concat(F.lit("É É "), "text", F.lit(" more")).alias("text")))
    windows = collections.defaultdict(set)
    for r in bench.collect():
        w = words(r["text"])
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(r["item_id"])
    sizes = {len(k) for k in windows}
    rows = decontaminate.hits(planted, bench).withColumn("digest", decontaminate.items_digest()).collect()
    want = {}
    for r in planted.collect():
        w, hit, items = words(r["text"]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        want[r["doc_id"]] = (len(w), len(hit), len(items - {None}), hashlib.sha256(",".join(sorted(str(i) for i in items - {None})).encode()).hexdigest())
    assert len(rows) == planted.count()
    assert all(want[r["doc_id"]] == (r["n_words"], r["n_hit"], r["n_items"], r["digest"]) for r in rows)
    assert decontaminate.hits(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.hits(docs, bench.filter("false")).collect())


def test_language_model(docs, texts, empty):
    rows = lm.scores(docs).collect()
    tokens = [(d, low(t).encode().split() + [None]) for d, t in texts]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = collections.Counter(w for d, ts in tokens if not held(d) for w in ts)
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    want = collections.defaultdict(list)
    for d, ts in tokens:
        want[d].append((len(ts), sum(count[w] > 0 for w in ts), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ts)))
    for r in rows:
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n and r["score"] <= 0
        assert any((r["n_tokens"], r["n_known"]) == x[:2] and math.isclose(r["base_score"], x[2], rel_tol=1e-9) for x in want[r["doc_id"]])
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert lm.scores(empty).count() == 0


def test_scores_are_the_models(docs, texts, monkeypatch):
    monkeypatch.setattr(lm, "BITS", 1024)  # no false positives here
    rows = lm.scores(docs).collect()
    low_words = [(d, ["<end>", *low(t).encode().split(), "<end>"]) for d, t in texts]  # a start counts as an end
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    one, two = collections.Counter(), collections.Counter()
    for d, ts in low_words:
        if not held(d):
            one.update(ts[1:])
            two.update(zip(ts, ts[1:]))
    q = lambda c: 2 ** (c.bit_length() - 1) if c else 0
    spread = sum(map(q, one.values())) + len(one) + 1

    def p(w, before):
        weight = lm.MIX if one[before] else 0
        return weight * q(two[before, w]) / max(1, one[before]) + (1 - weight) * (q(one[w]) + 1) / spread

    want = collections.defaultdict(list)
    for d, ts in low_words:
        want[d].append(sum(math.log10(p(w, b)) for b, w in zip(ts, ts[1:])))
    assert all(any(math.isclose(r["score"], x, rel_tol=1e-9) for x in want[r["doc_id"]]) for r in rows)
    for before in [*list(one)[:20], b"never seen"]:
        assert 1 - lm.MIX - 1e-9 <= sum(p(w, before) for w in [*one, b"unknown"]) <= 1 + 1e-9


def test_ranges_follow_the_size(docs, monkeypatch):
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["held_out"])
    few = sorted(lm.scores(docs).collect(), key=key)
    monkeypatch.setattr(lm, "RANGE_BYTES", 64)
    many = sorted(lm.scores(docs).collect(), key=key)
    assert all(key(a) == key(b) and math.isclose(a["base_score"], b["base_score"], rel_tol=1e-9) and math.isclose(a["score"], b["score"], rel_tol=0.05) for a, b in zip(few, many, strict=True))


def test_filter_grows_with_what_it_holds():
    rng = np.random.default_rng(1)
    for n in (1000, 30_000, 1_000_000):
        keys = rng.integers(0, 1 << 54, n, np.uint64)
        counts = rng.integers(1, 20, n).astype(np.uint64)
        block = lm.Block(keys, counts)
        assert (block.levels(keys) >= np.floor(np.log2(counts)) + 1).all()
        assert (block.levels(rng.integers(0, 1 << 54, n, np.uint64)) > 0).mean() < 0.03


def test_answers_of_several_chunks(docs):
    got = lm.scores(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["held_out"])
    one, many = sorted(lm.scores(docs.coalesce(1)).collect(), key=key), sorted(got, key=key)
    assert len(one) == len(many) and all(key(a) == key(b) and math.isclose(a["score"], b["score"], rel_tol=1e-9) and math.isclose(a["base_score"], b["base_score"], rel_tol=1e-9) for a, b in zip(one, many, strict=True))


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "<p>one"), (2, "http://b", "<p>one"), (3, "http://c\r\nX: y", None), (4, None, ""), (5, "u", "é"), (5, "u", "é"), (None, "n", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("header", F.lit("clash"))
    warc.write_archive(pages, str(tmp_path / "a"))
    got = warc.read_archive(spark, str(tmp_path / "a")).select("*", warc.record_bytes().alias("bytes")).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 5)}
    for r in got:
        body = bytes(r["payload"])
        assert body in {(h or "").encode() for i, _, h in rows if i == r["page_id"]}
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() and r["payload_bytes"] == len(body)
        assert bytes(r["bytes"]).startswith(b"WARC/1.1\r\n") and b"\r\nX: y" not in bytes(r["header"])
    warc.write_archive(pages.filter("false"), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0
    warc.write_archive(pages, str(tmp_path / "b"), min_bytes=10)
    assert {r["record_type"] for r in warc.read_archive(spark, str(tmp_path / "b")).collect()} == {"response"}
