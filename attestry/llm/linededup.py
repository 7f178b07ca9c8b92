"""Line dedup: a line stays at its first place in the corpus and goes wherever it, or one within a few
edits of it, stands again.

Lines are texts between line feeds. Equal lines that hold a word are one class, whatever their length.
Lines are also linked if few edits apart; an edit puts in, takes out or replaces a word (a run of anything
but ASCII white space; Chinese, Japanese and Korean characters are words of their own). Lines of 10 to 23
words, by the shorter one, may be one edit apart, longer ones two (``GROUPS``). Linked
classes are one (union-find).

Segment-partition join: a line of a group with e edits has e + 1 segments of fixed length, the first half
placed from its left end and the others from its right. Of two lines within e edits the second holds some
segment i of the first, moved by at most i, or e - i, words; so a line's keys are its own segments and the
ones it might hold of others. A line up to e words longer than the group's longest looks into that group
too. Candidates that parity masks and outlines leave room for are verified by a banded bit-parallel edit
distance on words.

Built-in expressions only. Defined cases: the first place is the least (doc_id, hash of the text, line
number); rows without doc_id or text are left as they are; rows that repeat a doc_id with another text are
documents of their own, rows that repeat both are one document twice and lose the same lines; lines are told
apart by 64-bit hashes; an empty table gives none; other columns pass through.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import WORD_GAP, cut, cut_counted, let, words
from attestry.llm.components import link

#: (least number of words, edits)
GROUPS = ((10, 1), (24, 2))
EDITS = max(e for _, e in GROUPS)
BROADCAST_ROWS = 500_000
BROADCAST_KEYS = 1_500_000  # 64-bit numbers alone
#: Characters that are words of their own: Japanese, Chinese and Korean ones.
OWN_WORDS = r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]"


def spaced(line: Column) -> Column:
    """A line's words with one space between them."""
    odd = lambda x: F.regexp_replace(F.regexp_replace(x, f"({OWN_WORDS})", " $1 "), WORD_GAP, " ")
    # One range that leaves out all other white space and all words of one character; a test of each took half of this pass.
    plain = ~line.rlike(r"[^ -\x{303f}]") & ~F.contains(line, F.lit("  "))
    return F.trim(F.when(plain, line).otherwise(odd(line)))


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(spaced(line), " "), "")


def allowed(n: Column) -> Column:
    """Edits that a line of n words may be away from a line at least as long."""
    found = F.lit(0)
    for least, e in GROUPS:
        found = F.when(n >= least, e).otherwise(found)
    return found


def _group_keys(said: Column, least: int, e: int) -> tuple[list[Column], list[Column]]:
    """Keys of the group of e edits: a line's own segments, and what it may hold of other lines' segments. said: words and single spaces."""
    size, own, near = least // (e + 1), [], []
    for i in range(e + 1):
        left = i * 2 <= e
        most = i if left else e - i
        for d in range(-most, most + 1):
            if left:
                piece = F.substring_index(F.substring_index(said, " ", (i + 1) * size + d), " ", -size)
            else:
                piece = F.substring_index(F.substring_index(said, " ", -((e + 1 - i) * size - d)), " ", size)
            (near if d else own).append(F.xxhash64(F.lit(e), F.lit(i), piece))
    return own, near


def own_keys(said: Column, n: Column) -> Column:
    """The segments of a line of n words, as keys of its group."""
    out = F.array().cast("array<bigint>")
    for least, e in GROUPS:
        out = F.when(n >= least, F.array(*_group_keys(said, least, e)[0])).otherwise(out)
    return out


def near_keys(said: Column, n: Column) -> Column:
    """Keys under which a line may hold segments of others, its own left out: in its group, and in the one below if that may hold lines within reach."""
    out, below = F.array().cast("array<bigint>"), None
    for least, e in GROUPS:
        near = _group_keys(said, least, e)[1]
        here = F.array(*near) if near else F.array().cast("array<bigint>")
        if below:
            under = F.array(*(k for part in _group_keys(said, *below) for k in part))
            here = F.when(n - below[1] < least, F.concat(here, under)).otherwise(here)
        out, below = F.when(n >= least, here).otherwise(out), (least, e)
    return out


def _stripped(a: Column, b: Column, rounds: int = 7) -> Column:
    """(a, b) without equal parts at either end, by halves; that leaves their distance as it is."""

    def cut_half(s):
        def cut_at(m):
            n = lambda x: F.size(x)
            head = F.slice(s["a"], F.lit(1), m) == F.slice(s["b"], F.lit(1), m)
            tail = F.slice(s["a"], n(s["a"]) - m + 1, m) == F.slice(s["b"], n(s["b"]) - m + 1, m)
            short = lambda x: F.when(head, F.slice(x, m + 1, n(x))).when(tail, F.slice(x, F.lit(1), n(x) - m)).otherwise(x)
            return F.when(m > 0, F.struct(short(s["a"]).alias("a"), short(s["b"]).alias("b"))).otherwise(s)

        return let(F.ceil(F.least(F.size(s["a"]), F.size(s["b"])) / 2).cast("int"), cut_at)

    out = F.struct(a.alias("a"), b.alias("b"))
    for _ in range(rounds):
        out = let(out, cut_half)
    return out


def distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two arrays if at most edits, else more than edits: Hyyro's bit-vector recurrence on a band of diagonals.

    Once the distance along the band is over twice the edits it can't come back, and steps do nothing.
    """
    width = 2 * edits + 2
    mask, top = (1 << width) - 1, width - 1

    def banded(long, short):  # long has at least as many elements, short has some
        n = F.size(long)
        first = F.struct(F.lit(((1 << (edits + 1)) - 1) << (width - edits - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"), F.lit(1 << (top - 1)).alias("h"))

        def step(s, i):
            c = F.get(short, i)
            place = lambda k: i + F.lit(edits + 1 - width + k)
            hit = lambda k: F.when((place(k) >= 0) & (F.get(long, F.greatest(place(k), F.lit(0))) == c), 1 << k).otherwise(0)
            match = hit(0)
            for k in range(1, width):
                match = match.bitwiseOR(hit(k))

            def rest(x):
                vp, vn = s["vp"], s["vn"]
                d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask)

                def done(z):
                    hp = vn.bitwiseOR(F.lit(mask) - z.bitwiseOR(vp))
                    hn = z.bitwiseAND(vp)
                    half = F.shiftright(z, 1)
                    diagonal = i < n - edits
                    more = F.when(diagonal, F.when(z.bitwiseAND(1 << top) == 0, 1).otherwise(0)).otherwise(F.when(hp.bitwiseAND(s["h"]) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(s["h"]) != 0, 1).otherwise(0))
                    return F.struct(hn.bitwiseOR(F.lit(mask) - half.bitwiseOR(hp)).alias("vp"), half.bitwiseAND(hp).alias("vn"), (s["d"] + more).alias("d"), F.when(diagonal, s["h"]).otherwise(F.shiftright(s["h"], 1)).alias("h"))

                return let(d0, done)

            return F.when(s["d"] > 2 * edits, s).otherwise(let(match, rest))

        return F.aggregate(F.sequence(F.lit(0), F.size(short) - 1), first, step, lambda s: s["d"])

    def padded(x, y):  # an equal end leaves the distance as it is; the band begins edits elements deep
        longer = lambda z: F.when(F.size(x) > edits, z).otherwise(F.concat(z, F.array_repeat(F.get(x, F.lit(0)), edits)))
        return let(longer(x), lambda p: let(longer(y), lambda q: banded(p, q)))

    of = lambda x, y: F.when(F.size(y) > 0, padded(x, y)).otherwise(F.size(x))
    either = lambda s: F.when(F.size(s["a"]) >= F.size(s["b"]), of(s["a"], s["b"])).otherwise(of(s["b"], s["a"]))
    return F.when(F.abs(F.size(a) - F.size(b)) > edits, edits + 1).otherwise(let(_stripped(a, b), either))


#: 64-bit masks of a line: a bit for each kind of word, by a part of its hash, that stands an odd number of times.
MASKS = ("m0", "m1")


def _mask(w: Column, k: int) -> Column:
    """Parities of the words by the k-th six bits of their hashes, from the eighth bit on."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 7 + 6 * k).bitwiseAND(63).cast("int"))
    return F.aggregate(w, F.lit(0).cast("long"), lambda m, x: m.bitwiseXOR(bit(x)))


def _outline(w: Column, bits: int = 0) -> Column:
    """A line as a string of one character a word, of 128 characters by the word's hash from its lowest bit or a higher one on."""
    return F.array_join(F.transform(w, lambda x: F.char(F.shiftright(x, bits).bitwiseAND(127))), "")


def _profile_fits(p: Column, q: Column) -> Column:
    """Whether two lines' profiles leave room for a link: an edit changes two bits of each mask at most, and two pairs of neighbours."""
    e = allowed(F.least(p["n"], q["n"]))
    fits = (F.abs(p["n"] - q["n"]) <= e) & (F.greatest(p["own"], q["own"]) <= 2 * e)
    for m in MASKS:
        fits = fits & (F.bit_count(p[m].bitwiseXOR(q[m])) <= 2 * e)
    return fits


def _outlines_fit(d: Column, e: Column, outlines: tuple[str, ...] = ("s", "t")) -> Column:
    """Whether two lines' outlines leave room for a link; they are no further apart than the lines, and soon compared.

    One takes different words for the same once in 128 times, which among many near copies is often; two seldom.
    """
    near = lambda k: F.call_function("levenshtein", d[k], e[k], F.lit(EDITS)).between(0, allowed(F.least(F.length(d[k]), F.length(e[k]))))
    fits = near(outlines[0])
    for k in outlines[1:]:
        fits = fits & near(k)
    return fits


def _near(d: Column, e: Column) -> Column:
    """linked() for lines with their outlines."""
    return F.when(_outlines_fit(d, e, ("s",)), linked(F.split(d["said"], " "), F.split(e["said"], " "))).otherwise(False)


def linked(a: Column, b: Column) -> Column:
    """Whether two lines, as arrays of words, are as few edits apart as the shorter one allows."""
    return distance(a, b) <= allowed(F.least(F.size(a), F.size(b)))


def places(documents: DataFrame) -> DataFrame:
    """(doc_id, version, at, line, h): all lines; version: the hash of the text."""
    rows = documents.filter("doc_id is not null and text is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.withColumn("h", F.xxhash64("line"))


def links(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(item, component) of the lines that are linked with others; rows (h, own, near): keys of lines, written."""
    keys = rows.select(F.col("h").alias("item"), F.explode("own").alias("key"), F.lit(True).alias("own")).unionByName(rows.select(F.col("h").alias("item"), F.explode("near").alias("key"), F.lit(False).alias("own")))
    shared, n = cut_counted(keys.groupBy("key").agg(F.min("item").alias("lo"), F.max("item").alias("hi"), F.max("own").alias("own")).filter("lo <> hi and own").select("key"))
    members = cut(keys.join(F.broadcast(shared) if n <= BROADCAST_KEYS else shared, "key", "left_semi").groupBy("key", "item").agg(F.max("own").alias("own")))

    def small(df, most=BROADCAST_ROWS):  # written; lines are then looked for where they lie
        rows, n = cut_counted(df)
        return F.broadcast(rows) if n <= most else rows

    wanted = small(members.select(F.col("item").alias("h")).distinct(), BROADCAST_KEYS)
    facts = lambda w: F.struct(F.size(w).alias("n"), _outline(w).alias("s"), _outline(w, 40).alias("t"), *(_mask(w, k).alias(m) for k, m in enumerate(MASKS)))
    hashed = F.transform(F.split("said", " "), lambda w: F.xxhash64(w))
    bodies = places(documents).select("h", "line").join(wanted, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    bodies = bodies.select(F.col("h").alias("item"), spaced(F.col("line")).alias("said"))
    bodies = bodies.select("item", "said", F.explode(F.array(let(hashed, facts))).alias("f"))
    bodies = cut(bodies.select("item", F.struct("said", "f.s", "f.t").alias("d"), "f.n", *(f"f.{m}" for m in MASKS)))

    def verify(pairs):
        side = lambda x: bodies.select(F.col("item").alias(x), F.struct("n", *MASKS, F.lit(0).alias("own")).alias(f"p{x}"))
        room = pairs.join(side("a"), "a").join(side("b"), "b").filter(_profile_fits(F.col("pa"), F.col("pb")))
        room = small(room.select("a", "b"))
        line = lambda x: bodies.select(F.col("item").alias(x), F.struct("d.said", "d.s").alias(f"d{x}")).join(room, x)
        return line("a").join(line("b"), ["a", "b"]).filter(_near(F.col("da"), F.col("db"))).select("a", "b")

    def profile(of):  # own: pairs of neighbouring words that no other of the items holds
        mine = cut(bodies.join(small(of, BROADCAST_KEYS), "item"))
        pairs = let(F.split("d.said", " "), lambda w: F.array_distinct(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.xxhash64(a, b))))
        holders = mine.select("item", F.explode(pairs).alias("g")).groupBy("g").agg(F.min("item").alias("item"), F.max("item").alias("last"))
        own = cut(holders.filter("item = last").groupBy("item").agg(F.count("*").alias("own")))
        return mine.join(own, "item", "left").select("item", F.struct("n", *MASKS, F.coalesce("own", F.lit(0)).alias("own")).alias("p"))

    # Outlines alone: a pair meets under several keys, its words are compared once, by verify.
    describe = lambda refs: bodies.select("item", F.struct("d.s", "d.t").alias("d")).join(small(refs.select("item"), BROADCAST_KEYS), "item")
    return link(members.select("key", "item"), verify, profile, _profile_fits, (describe, _outlines_fit), alone=lambda p: p["own"] <= 2 * allowed(p["n"]))


def repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, version, drop): the numbers of the lines that stand earlier in the corpus, for documents that have any."""
    # The filter is on the line: one on said would be pushed below and make it twice.
    found = places(documents).filter(F.ltrim("line", F.lit(" \t\x0b\f\r")) != "").select("doc_id", "version", "at", "h", spaced(F.col("line")).alias("said"))
    # Words are counted as far as keys tell them apart: a line of that many or more has the last group's keys alone.
    head = F.substring_index("said", " ", GROUPS[-1][0] + GROUPS[-2][1])
    found = found.withColumn("n", F.octet_length(head) - F.octet_length(F.replace(head, F.lit(" "), F.lit(""))) + 1)
    rows = cut(found.select("doc_id", "version", "at", "h", own_keys(F.col("said"), F.col("n")).alias("own"), near_keys(F.col("said"), F.col("n")).alias("near")))
    place = F.struct("doc_id", "version", "at")
    firsts = cut(rows.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    named = links(documents, rows)
    both = firsts.join(named.withColumnRenamed("item", "h"), "h")
    joint = cut(both.groupBy("component").agg(F.min("first").alias("first")))
    owner = both.drop("first").join(joint, "component").select("h", "first")
    alone = firsts.filter("n > 1").join(named.select(F.col("item").alias("h")), "h", "left_anti").select("h", "first")
    owner = cut(owner.unionByName(alone))
    # Both sides are exchanged, so a very common line is split at run time.
    again = rows.select("doc_id", "version", "at", "h").join(owner, "h").filter(place != F.col("first"))
    return again.groupBy("doc_id", "version").agg(F.collect_set("at").alias("drop"))


def dedup_lines(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of documents: keep, the text less its repeated lines, n_lines, n_dropped, and where lines went words_before and words_after."""
    rows = documents.select(*keep, F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_version"))
    gone, n = cut_counted(repeats(documents))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("version").alias("_of"), F.col("drop").alias("_drop"))
    out = rows.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone, (rows["_id"] == gone["_gone"]) & (rows["_version"] == gone["_of"]), "left")
    lines, dropped = F.split("_text", "\n"), F.coalesce(F.size("_drop"), F.lit(0))
    kept = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_drop")), lambda i: F.get(x, i)), "\n"))
    out = out.select(*keep, "_text", F.when(dropped == 0, F.col("_text")).otherwise(kept).alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
    count = lambda x: F.when(F.col("n_dropped") > 0, F.size(words(F.col(x)))).cast("long")
    return out.select(*keep, "text", "n_lines", "n_dropped", count("_text").alias("words_before"), count("text").alias("words_after"))
