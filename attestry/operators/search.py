"""Hybrid search: exact vector ranking and lexical ranking fused by reciprocal rank; precedents; folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import lexical, stemming, vector
from attestry.lineage import cut
from attestry.operators import analytics, lexindex, tiles
from attestry.operators.tiles import spread

RRF = 60
BROADCAST_ROWS = 500_000
MORE = 4  # rare words that twins share beyond the one that they must


def scoped(rows: DataFrame, organisation=None, documents=None, sensitivities=None) -> DataFrame:
    """What a reader may see: rows of an organisation, of documents (a list, or a frame with document_id), of no or a listed sensitivity.

    A part left out (None) lets all through; the filters reach the scan.
    """
    if organisation is not None:
        rows = rows.filter(F.col("organisation_id") == organisation)
    if isinstance(documents, DataFrame):
        rows = rows.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    elif documents is not None:
        rows = rows.filter(F.col("document_id").isin(list(documents)))
    if sensitivities is not None:
        rows = rows.filter(F.col("sensitivity").isNull() | F.col("sensitivity").isin(list(sensitivities)))
    return rows


def ranked(rows: DataFrame, name: str, *order: Column, by: str | list[str] | None = None, pool: int | None = None) -> DataFrame:
    """A rank column over a total order, by query if given, cut to a pool; without either all rows are one order."""
    if by is None and pool is not None:  # a top-k by partial sorts; only its rows are numbered
        rows = rows.orderBy(*order).limit(pool)
    keys = [by] if isinstance(by, str) else by or [F.lit(0)]
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    # The limit stands right on the number, so that Spark keeps no more of a group in each task before the shuffle.
    out = out if pool is None else out.filter(F.col(name) <= pool)
    return out.withColumn(name, F.col(name).cast("long"))


def fuse(dense: DataFrame, lexical_: DataFrame, keys: list[str]) -> DataFrame:
    """Full join of two rankings; a side that lacks a row adds nothing."""
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    return dense.join(lexical_, keys, "full").withColumn("score", part("vector_rank") + part("lexical_rank"))


def hybrid(chunks: DataFrame, vectors: DataFrame, query_vector: list[float], terms: list[str], key: str, limit: int = 8, pool: int | None = None) -> DataFrame:
    """The best chunks for one query of words: ids only until the top is known; words with its stems are counted in their row."""
    pool = pool or max(4 * limit, 32)
    distance = vector.cosine_distance(F.col("vector"), F.array(*map(F.lit, query_vector)))
    dense = ranked(vectors.select(key, distance.alias("distance")), "vector_rank", F.col("distance"), F.col(key), pool=pool).select(key, "vector_rank")
    stems = F.array_distinct(F.transform(F.array(*map(F.lit, terms)).cast("array<string>"), stemming.stem))
    hits = chunks.select(key, F.size(F.filter(lexical.lexemes(F.col("text")), lambda w: F.array_contains(stems, stemming.stem(w)))).alias("hits")).filter("hits > 0")
    words = ranked(hits, "lexical_rank", F.desc("hits"), F.col(key), pool=pool).select(key, "lexical_rank")
    return fuse(dense, words, [key]).orderBy(F.desc("score"), F.col(key)).limit(limit)


def batch_ranks(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, pool: int, by: tuple[str, ...] = (), index: DataFrame | None = None) -> DataFrame:
    """(query_id, by, chunk_id, vector_rank, lexical_rank, score) of the pools of many queries (query_id, query, terms).

    terms are words, met by their stems; an index (lexindex.postings, written) of the same chunks answers the lexical side by bounds.

    chunks (chunk_id, heading_path, text, by) bound both sides; with by each query has a pool for every value of it. The
    vector side is an exact scan by definition, the lexical side without an index one of all texts: both by tiles of rows
    against blocks of queries, of which a task keeps the pools only. Ids of chunks are whole numbers.
    """
    keys = ["query_id", *by]
    queries = cut(queries.select("query_id", "query", "terms"))  # read again and again, and before filters on terms reach all texts
    own = vectors.join(chunks.select("chunk_id", *by), "chunk_id")
    dense = tiles.nearest(queries.select("query_id", "query"), own, pool, by)
    dense = ranked(dense, "vector_rank", F.col("distance"), F.col("chunk_id"), by=keys, pool=pool).select(*keys, "chunk_id", "vector_rank")
    asked = cut(lexical.asked_terms(queries))
    hits = lexindex.top(index, asked, pool) if index is not None and not by else tiles.lexical_best(asked, chunks, pool, by)
    words = ranked(hits, "lexical_rank", F.desc("rank"), F.col("chunk_id"), by=keys, pool=pool).select(*keys, "chunk_id", "lexical_rank")
    return fuse(dense, words, [*keys, "chunk_id"])


def batch_hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, limit: int = 8, pool: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """As hybrid() for many queries at once, with some passages more than limit for the folds; place is the rank by score."""
    fused = batch_ranks(queries, chunks, vectors, pool or max(4 * limit, 32), by)
    fused = cut(ranked(fused, "place", F.desc("score"), F.col("chunk_id"), by=["query_id", *by], pool=max(2 * limit, limit + 8)))
    return few(fused).join(chunks.drop("heading_path", *by), "chunk_id")


def few(rows: DataFrame) -> DataFrame:
    """Written rows as the side that is broadcast, as long as they are few: what they are joined with stays where it is."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def evidence_windows(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, limit: int = 8, most: int = 24, organisation=None, documents=None) -> DataFrame:
    """(query_id, place, chunk_id, design): the passages shown for each query.

    For every design within the reader's scope: both rankings fused, tables folded over their rows, twins folded, cut to limit
    with a figure kept; then the designs' windows are woven by rank, min(most, limit * designs) passages a query.
    chunks: chunk_id, design, document_id, organisation_id, source_id, source_kind, heading_path, heading, page, text.
    """
    own = scoped(chunks, organisation, documents)
    hits = batch_hybrid(queries, own, vectors, limit, by=("design",)).drop("text")
    # The folds see a query and a design as one query.
    hits = cut(fold_tables(hits.withColumnRenamed("query_id", "asked").withColumn("query_id", F.struct("asked", "design"))))
    # Many queries find the same long passages, whose words are made once.
    said = own.join(few(cut(hits.select("chunk_id").distinct())), "chunk_id", "left_semi").select("chunk_id", "text")
    words = spread(said).select("chunk_id", lexical.content_words(F.col("text")).alias("words"))
    kept = fold_twins(hits.join(words, "chunk_id")).select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).cast("long").alias("place"))
    shown = keep_figure(few(cut(kept)).join(own.select("chunk_id", "document_id", "source_kind", "heading", "page", "text"), "chunk_id"), limit)
    rows = shown.select(F.col("query_id.asked").alias("query_id"), F.col("query_id.design").alias("design"), F.col("place").alias("rank"), "chunk_id")
    return analytics.weave(rows, "query_id", "design", "rank", limit, most).select("query_id", F.col("place").cast("long").alias("place"), "chunk_id", "design")


def clause_query(title: Column, statement: Column, requirements: Column, most: int = 2000) -> Column:
    """The text a clause is searched by: title, statement and requirements, cut."""
    return F.substring(F.array_join(F.filter(F.concat(F.array(title, statement), F.coalesce(requirements, F.array().cast("array<string>"))), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), "\n"), 1, most)


def fold_tables(hits: DataFrame) -> DataFrame:
    """A table stands for its rows: of hits sharing (query, document, source) one stays, a table if there is one, at the first place."""
    key = [F.col("query_id"), F.col("document_id"), F.coalesce(F.col("source_id").cast("string"), F.concat(F.lit("own:"), F.col("chunk_id").cast("string")))]
    w = Window.partitionBy(*key)
    first = F.min("place").over(w)
    kept = F.row_number().over(w.orderBy((F.col("source_kind") != "table").cast("int"), "place"))
    return hits.withColumn("_first", first).withColumn("_n", kept).filter("_n = 1").withColumn("place", F.col("_first")).drop("_first", "_n")


def fold_twins(hits: DataFrame, share: float = 0.9, least: int = 20) -> DataFrame:
    """Drop a passage whose content words (least or more) lie to share inside a better kept passage of its document.

    Greedy by definition: what is kept depends on what was kept before, so a query's few hits are folded in order by one aggregate.
    """
    words = F.col("words") if "words" in hits.columns else lexical.content_words(F.col("text"))
    row = F.struct("place", "chunk_id", "document_id", "source_kind", words.alias("words"))
    hit = F.array_sort(F.collect_list(row))

    def step(kept, x):
        inside = lambda k: (k["document_id"] == x["document_id"]) & (F.size(F.array_intersect(x["words"], k["words"])) >= share * F.size(x["words"]))
        twin = (x["source_kind"] != "figure") & (F.size(x["words"]) >= least) & F.exists(kept, inside)
        return F.when(twin, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.expr("cast(array() as array<struct<place:bigint,chunk_id:bigint,document_id:bigint,source_kind:string,words:array<string>>>)")
    lists = hits.withColumns({c: F.col(c).cast("long") for c in ("place", "chunk_id", "document_id")}).groupBy("query_id").agg(hit.alias("h"))
    out = lists.select("query_id", F.explode(F.aggregate("h", kept, step)).alias("x"))
    return out.select("query_id", "x.place", "x.chunk_id", "x.document_id")


def keep_figure(hits: DataFrame, limit: int) -> DataFrame:
    """Cut to limit; if no figure is in and one further down shares a document page or heading and a keyword with a kept passage, it takes the last place."""
    w = Window.partitionBy("query_id")
    rows = hits.withColumn("inside", F.col("place") <= limit).withColumn("has", F.max(F.col("inside") & (F.col("source_kind") == "figure")).over(w))
    inside = rows.filter("inside").select("query_id", F.col("document_id").alias("d"), F.col("page").alias("pg"), F.col("heading").alias("hd"), lexical.keywords(F.col("text")).alias("kw"))
    later = rows.filter("not inside and not has and source_kind = 'figure'").withColumn("own", lexical.keywords(F.col("text")))
    near = (F.col("document_id") == F.col("d")) & ((F.col("page") == F.col("pg")) | (F.col("heading") == F.col("hd"))) & F.arrays_overlap("own", "kw")
    chosen = later.join(inside, "query_id").filter(near).groupBy("query_id").agg(F.min_by("chunk_id", "place").alias("figure"))
    kept = rows.filter("inside").join(chosen, "query_id", "left").filter(F.col("figure").isNull() | (F.col("place") < limit)).select("query_id", "place", "chunk_id")
    return kept.unionByName(chosen.select("query_id", F.lit(limit).cast("long").alias("place"), F.col("figure").alias("chunk_id")))


def precedents(clauses: DataFrame, decisions: DataFrame, as_of: Column, threshold: Column, most: int = 3) -> DataFrame:
    """Standing decisions for each clause: anchored by reference, newest first, then nearest by vector under the threshold.

    Clauses meet decisions of their own organisation only (organisation_id), those of the whole of it or of their project.
    """
    live = decisions.filter((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    live = live.withColumnRenamed("project_id", "decision_project")
    seen = (F.col("scope") == "organisation") | (F.col("decision_project") == F.col("project_id"))
    anchored = clauses.join(live, ["organisation_id", "clause_ref"]).filter(seen).select("clause_id", "decision_id", F.lit(0).alias("band"), (-F.unix_micros("created_at")).cast("double").alias("o"), "effect")
    anchored = ranked(anchored, "_n", F.col("o"), F.col("decision_id"), by="clause_id", pool=most).drop("_n")
    near = clauses.join(live.withColumnRenamed("clause_ref", "ref"), "organisation_id").filter(seen & ~F.col("ref").eqNullSafe(F.col("clause_ref")))
    near = near.select("clause_id", "decision_id", F.lit(1).alias("band"), vector.cosine_distance(F.col("clause_vector"), F.col("vector")).alias("o"), "effect").filter(F.col("o") <= threshold)
    near = ranked(near, "_n", F.col("o"), F.col("decision_id"), by="clause_id", pool=most).drop("_n")
    return ranked(anchored.unionByName(near), "place", F.col("band"), F.col("o"), F.col("decision_id"), by="clause_id", pool=most)


def conflicting(found: DataFrame) -> DataFrame:
    """Clauses whose anchored decisions both accept and reject."""
    own = found.filter("band = 0").groupBy("clause_id").agg(F.bool_or(F.col("effect") == "accepts").alias("a"), F.bool_or(F.col("effect") == "rejects").alias("r"))
    return own.select("clause_id", (F.col("a") & F.col("r")).alias("conflicted"))


def earlier_twins(rows: DataFrame, share: float = 0.9, least: int = 20) -> DataFrame:
    """(id, twin): for each text (id, text) of least content words or more the first earlier one that holds share of them.

    Whatever holds share of n words lacks m = (1 - share) n of them at most, so it holds one of any m + 1 and MORE further
    ones of any m + 1 + MORE: the rarest, which are few texts' words. These are joined and counted; pairs that share enough of
    them, and whose first text has words enough, are verified on whole word sets. Pairs that meet by chance carry no words.
    """
    w = rows.select("id", lexical.content_words(F.col("text")).alias("words"))
    post = w.select("id", F.explode("words").alias("w"), F.size("words").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("count", "w"))
    probe = post.join(post.groupBy("w").count(), "w").withColumn("r", rank).withColumn("m", F.expr(f"floor({1 - share} * n + 0.000001)"))
    probe = probe.filter(f"n >= {least} and r <= m + 1 + {MORE}").select(F.col("id").alias("b"), F.col("n").alias("nb"), (F.least(F.col("n"), F.col("m") + 1 + MORE) - F.col("m")).alias("need"), "w")
    pairs = probe.join(post.select(F.col("id").alias("a"), F.col("n").alias("na"), "w"), "w").filter(f"a < b and na >= {share} * nb")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need")).filter("shared >= need").select("a", "b")
    full = pairs.join(w.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(w.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    near = full.filter(F.size(F.array_intersect("wa", "wb")) >= share * F.size("wb"))
    return near.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("twin"))
