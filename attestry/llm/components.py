"""Connected components and bucket linking as joins; no task or driver sees a whole component."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import cut, cut_counted


def components(edges: DataFrame) -> DataFrame:
    """(item, component): the least item reachable, for every item of edges (a, b).

    Union-find in rounds: each item hangs on its least smaller neighbour, pointers jump to the roots,
    and edges shrink to edges between roots. Every frame that is joined is written first, so both
    sides of a join are exchanged and a hot root is split at run time.
    """
    ordered = lambda df, x, y: df.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    left, n = cut_counted(ordered(edges.filter("a <> b"), "a", "b"))
    rounds = []
    while n:
        forest = cut(left.groupBy("a").agg(F.min("b").alias("root")))
        while True:  # three jumps a pass; only what all three led on for may not be at its root yet
            up = lambda x, y: forest.select(F.col("a").alias(x), F.col("root").alias(y))  # noqa: E731, B023
            far = forest.join(up("root", "r2"), "root", "left").join(up("r2", "r3"), "r2", "left").join(up("r3", "r4"), "r3", "left")
            far, open_ = cut_counted(far.select("a", F.coalesce("r4", "r3", "r2", "root").alias("root"), F.col("r4").isNotNull().alias("open")), F.col("open"))
            forest = far.select("a", "root")
            if not open_:
                break
        rounds.append(forest)
        a, b = forest.select("a", F.col("root").alias("ra")), forest.select(F.col("a").alias("b"), F.col("root").alias("rb"))
        ends = left.join(a, "a").join(b, "b", "left").select(F.col("ra").alias("x"), F.coalesce("rb", "b").alias("y")).filter("x <> y")
        left, n = cut_counted(ordered(ends, "x", "y"))
    if not rounds:
        return edges.select(F.col("a").alias("item"), F.col("b").alias("component")).filter("false")
    # A round's roots are the next round's items: follow them to the last.
    whole = rounds[-1]
    for k, forest in enumerate(reversed(rounds[:-1])):
        later = (cut(whole) if k else whole).select(F.col("a").alias("root"), F.col("root").alias("far"))
        settled = later.select(F.col("root").alias("a"), F.col("far").alias("root"))
        whole = forest.join(later, "root", "left").select("a", F.coalesce("far", "root").alias("root")).unionByName(settled)
    # Roots are items too.
    return cut(whole.select(F.explode(F.array("a", "root")).alias("item"), "root").groupBy("item").agg(F.min("root").alias("component")))


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], profile: Callable[[DataFrame], DataFrame], possible: Callable[[Column, Column], Column], compare: tuple[Callable, Callable] | None = None, alone: Callable[[Column], Column] | None = None) -> DataFrame:
    """Components of the links that verify confirms among items sharing a bucket; see components().

    members: distinct (key, item), written; each pair of items that may be linked has some bucket in
    common. verify takes distinct candidates (a, b) and returns the linked ones. A bucket isn't expanded
    into all its pairs. First its items are held against two of them, the least, on which copies mostly
    hang, and one by hash; a bucket whose items have become one component is done. The others' items are
    held against the one with least of its own; profile gives (item, p), p.own among other bounds that
    hold among the items it is asked about, and possible(p, q) says whether they leave room for a link;
    alone(p), if given, whether an item's own profile leaves room for any, else it is held against no one.
    At last items outside a bucket's largest component are held against the rest under the same bounds
    and, if given, compare = (describe, allowed): describe takes (item, ref) and gives (item, d), what
    sets an item apart from a reference; allowed(d, e) rules out what two such differences rule out.
    So no link between components is lost.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    mids = cut(members.groupBy("key").agg(F.array_distinct(F.array(F.min("item"), F.min_by("item", F.xxhash64("item")))).alias("mids")))
    met = members.join(mids, "key").select("item", F.explode("mids").alias("mid")).filter("item <> mid")
    tested = cut(met.select(*pair("item", "mid")).distinct())
    links = cut(verify(tested))
    named = components(links)

    def unsettled(rows: DataFrame) -> tuple[DataFrame, int]:
        own = cut(rows.join(named, "item", "left").withColumn("component", F.coalesce("component", "item")))
        parts = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
        return cut_counted(own.join(cut(parts), "key", "left_semi"))

    rest, n = unsettled(members)
    if not n:
        return named
    rest = cut(rest.join(cut(profile(rest.select("item").distinct())), "item"))
    if alone:
        rest, n = unsettled(rest.filter(alone(F.col("p"))).drop("component"))
        if not n:
            return named
    middle = cut(rest.groupBy("key").agg(F.min_by(F.struct("item", "component", "p"), F.struct("p.own", "item")).alias("mid")))
    met = rest.join(middle, "key").filter((F.col("component") != F.col("mid.component")) & possible(F.col("p"), F.col("mid.p")))
    again = cut(met.select(*pair("item", "mid.item")).distinct().join(tested, ["a", "b"], "left_anti"))
    found, n = cut_counted(verify(again))
    if n:
        tested, links = tested.unionByName(again), links.unionByName(found)
        named = components(links)
        rest, n = unsettled(rest.drop("component"))
        if not n:
            return named
    if compare:
        refs = rest.join(middle, "key").groupBy("item").agg(F.min_by("mid.item", F.struct("mid.p.own", "mid.item")).alias("ref"))
        rest = cut(rest.join(cut(compare[0](cut(refs))), "item"))
    else:
        rest = rest.withColumn("d", F.lit(0))
    # A pair that isn't linked by now has an item outside the largest component of each shared bucket.
    most = rest.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    apart = rest.join(cut(most), "key").filter("component <> main").select("key", F.col("item").alias("x"), F.col("component").alias("cx"), F.col("p").alias("px"), F.col("d").alias("dx"))
    room = possible(F.col("px"), F.col("p"))
    if compare:
        room = room & compare[1](F.col("dx"), F.col("d"))
    met = cut(apart).join(rest, "key").filter((F.col("cx") != F.col("component")) & room)
    more = met.select(*pair("item", "x")).distinct().join(tested, ["a", "b"], "left_anti")
    found, n = cut_counted(verify(cut(more)))
    return components(links.unionByName(found)) if n else named
