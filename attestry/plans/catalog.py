"""Every registered query with its SQL twin. Queries bind the operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import dates, lexical, text, vector
from attestry.operators import analytics, coverage, evidence, fidelity, lexindex, search, state, structure, tiles, verdicts
from attestry.plans import twins
from attestry.sources import pdf
from attestry.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_COSINE = "1 - list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))))"


@_query(f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0 AND vec_id IN (SELECT doc_id FROM documents)),
dist AS (SELECT query_id, v.vec_id AS doc_id, {_COSINE.format(a='v.embedding', b='q.e')} AS d FROM embeddings v JOIN documents ON doc_id = vec_id, q),
dense AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS vector_rank FROM dist QUALIFY vector_rank <= 40),
toks AS (SELECT doc_id, unnest({twins.lexemes('text')}) AS w FROM documents),
{twins.stems('toks')},
terms AS (SELECT DISTINCT query_id, stem FROM (SELECT doc_id AS query_id, unnest({twins.query_terms('text')}) AS w FROM documents WHERE doc_id IN (SELECT query_id FROM q)) JOIN stems USING (w)),
hits AS (SELECT query_id, doc_id, count(*) AS n FROM toks JOIN stems USING (w) JOIN terms USING (stem) GROUP BY ALL),
lex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS lexical_rank FROM hits QUALIFY lexical_rank <= 40),
f AS (SELECT query_id, doc_id, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS s, vector_rank, lexical_rank FROM dense FULL JOIN lex USING (query_id, doc_id))
SELECT query_id, doc_id, round(s, 9) AS score, vector_rank, lexical_rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) <= 8""")
def hybrid_search_rrf(spark, sf_dir):
    """Every embedded document with an id divisible by 100 as a query, its whole text as terms, against all documents."""
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.lit("").alias("heading_path"), "text")
    vectors = vecs.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = docs.filter("doc_id % 100 = 0").join(vecs.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    asked = asked.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query"), lexical.query_terms(F.col("text")).alias("terms"))
    hits = search.ranked(search.batch_ranks(asked, chunks, vectors, pool=40), "place", F.desc("score"), F.col("chunk_id"), by="query_id", pool=8)
    return hits.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 9).alias("score"), "vector_rank", "lexical_rank")


@_query(f"""
WITH toks AS (SELECT doc_id, unnest({twins.lexemes('text')}) AS w, 1 AS weight FROM documents UNION ALL SELECT doc_id, unnest({twins.lexemes("lang || ' ' || source")}), 10 FROM documents),
asked AS (SELECT item_id AS query_id, unnest({twins.query_terms('text')}) AS w FROM benchmark),
vocabulary AS (SELECT w FROM toks UNION SELECT w FROM asked),
{twins.stems('vocabulary')},
terms AS (SELECT DISTINCT query_id, stem FROM asked JOIN stems USING (w)),
hits AS (SELECT query_id, doc_id, CAST(sum(weight) AS BIGINT) AS rank FROM toks JOIN stems USING (w) JOIN terms USING (stem) GROUP BY ALL)
SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS place FROM hits QUALIFY place <= 10""")
def stemmed_search(spark, sf_dir):
    """Every benchmark item as a query against all documents, by the stems of their words and of language and source as heading."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", "lang", "source").alias("heading_path"), "text")
    asked = lexical.asked_terms(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), lexical.query_terms(F.col("text")).alias("terms")))
    hits = lexindex.top(lexindex.postings(chunks).persist(), asked, 10)
    return search.ranked(hits, "place", F.desc("rank"), F.col("chunk_id"), by="query_id").select("query_id", F.col("chunk_id").alias("doc_id"), "rank", "place")


def _near(spark, sf_dir):
    """Every vector with an id divisible by 100 as a query, and all vectors."""
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    return vecs.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query")), vecs


@_query(f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, label, vec_id, rank FROM (SELECT query_id, v.label, v.vec_id, row_number() OVER (PARTITION BY query_id, v.label ORDER BY {_COSINE.format(a='v.embedding', b='q.e')}, v.vec_id) AS rank FROM embeddings v, q) WHERE rank <= 3""")
def dense_topk_per_label(spark, sf_dir):
    rows = tiles.nearest(*_near(spark, sf_dir), 3, ["label"]).withColumnRenamed("chunk_id", "vec_id")
    return search.ranked(rows, "rank", F.col("distance"), F.col("vec_id"), by=["query_id", "label"], pool=3).select("query_id", "label", "vec_id", "rank")


@_query(f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, v.vec_id, round({_COSINE.format(a='v.embedding', b='q.e')}, 6) AS distance FROM embeddings v, q
WHERE {_COSINE.format(a='v.embedding', b='q.e')} <= 0.55""")
def nearest_under_threshold(spark, sf_dir):
    rows = tiles.within(*_near(spark, sf_dir), vector.THRESHOLDS["large"])
    return rows.select("query_id", F.col("chunk_id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@_query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def chunks_missing_embedding(spark, sf_dir):
    return analytics.lacking(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@_query("SELECT source AS grp, count(*) AS chunks, count(e.vec_id) AS embedded FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY source")
def embedding_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("grp"))
    return analytics.embedding_coverage(docs, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@_query("""
SELECT organisation_id, lacking, stale, lacking = 0 AND stale > 0 AS may_drop FROM (
SELECT source AS organisation_id, count_if(e.vec_id IS NULL OR e.label % 2 <> 0) AS lacking, CAST(count_if(e.label % 2 <> 0) AS BIGINT) AS stale
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY source)""")
def reembed_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("organisation_id"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") % 2 == 0, "new").otherwise("old").alias("model"))
    return state.reembed_plan(docs, vecs, "new")


@_query("""
SELECT 0::BIGINT AS level, NULL::BIGINT AS person, NULL AS stage, round(sum(value), 4) AS total, count(*) AS calls, round(coalesce(sum(value) FILTER (WHERE event_id % 3 = 0), 0), 4) AS estimated FROM events
UNION ALL SELECT 1, user_id, NULL, round(sum(value), 4), count(*), round(coalesce(sum(value) FILTER (WHERE event_id % 3 = 0), 0), 4) FROM events GROUP BY user_id
UNION ALL SELECT 2, NULL, event_type, round(sum(value), 4), count(*), round(coalesce(sum(value) FILTER (WHERE event_id % 3 = 0), 0), 4) FROM events GROUP BY event_type""")
def spend_report(spark, sf_dir):
    out = analytics.spend_report(table(spark, sf_dir, "events"), "user_id", "event_type", "value", F.col("event_id") % 3 == 0)
    return out.withColumn("total", F.round("total", 4)).withColumn("estimated", F.round("estimated", 4))


@_query("SELECT user_id, event_type, round(coalesce(sum(value), 0), 4) AS total, count(*) AS calls FROM events GROUP BY user_id, event_type")
def spend_by_person_stage(spark, sf_dir):
    return analytics.spend_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value").withColumn("total", F.round("total", 4))


@_query("SELECT user_id, round(sum(value), 4) AS total, max(ts) AS last_seen FROM events GROUP BY user_id")
def last_seen(spark, sf_dir):
    return analytics.last_seen(table(spark, sf_dir, "events"), "user_id", "ts", "value").withColumn("total", F.round("total", 4))


@_query("SELECT c.c_custkey AS person, round(coalesce(u.used, 0), 2) AS used, u.last_seen FROM customer c LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS used, max(o_orderdate) AS last_seen FROM orders GROUP BY o_custkey) u ON u.o_custkey = c.c_custkey")
def roster_usage(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"))
    usage = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("at"))
    return analytics.roster(people, usage, "person").withColumn("used", F.round("used", 2))


@_query("""
SELECT who, sum(CASE WHEN kind = 'orders' THEN n ELSE 0 END)::DOUBLE AS orders, sum(CASE WHEN kind = 'events' THEN n ELSE 0 END)::DOUBLE AS events FROM (
SELECT coalesce(c_custkey::VARCHAR, 'Unattributed') AS who, 'orders' AS kind, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 20 GROUP BY 1
UNION ALL SELECT user_id::VARCHAR, 'events', count(*) FROM events GROUP BY 1) GROUP BY who""")
def activity_by_person(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("user"))
    orders = table(spark, sf_dir, "orders").join(known, "o_custkey", "left").groupBy("user").agg(F.count("*").alias("n"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("user")).agg(F.count("*").alias("n"))
    return analytics.activity({"orders": orders, "events": events})


@_query("""
SELECT "at", id, detail, kind FROM (
(SELECT o_orderdate AS "at", o_orderkey AS id, o_orderstatus AS detail, 'order' AS kind FROM orders ORDER BY "at" DESC, id LIMIT 40)
UNION ALL (SELECT ts, event_id, event_type, 'event' FROM events ORDER BY ts DESC, event_id LIMIT 40)) ORDER BY "at" DESC, kind, id LIMIT 60""")
def activity_feed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("detail"))
    events = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("detail"))
    return analytics.feed({"order": orders, "event": events})


@_query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    return analytics.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.col("o_orderkey"))


@_query("SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY user_id, event_type")
def first_seen(spark, sf_dir):
    return analytics.first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@_query("SELECT w.word, coalesce(n, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) w(word) LEFT JOIN (SELECT o_orderstatus AS word, count(*) AS n FROM orders GROUP BY 1) c USING (word)")
def verdict_counts(spark, sf_dir):
    return analytics.vocabulary_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@_query("SELECT o_custkey, count_if(o_orderstatus = 'F') AS \"F\", count_if(o_orderstatus = 'O') AS \"O\" FROM orders GROUP BY o_custkey")
def issue_pivot(spark, sf_dir):
    return analytics.pivot_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O"])


@_query("SELECT o_custkey AS org, min(o_orderkey) AS owner FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def sole_owner(spark, sf_dir):
    return analytics.sole_owner(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "org"), "org", "o_orderkey")


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_payload_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k >= 50")


@_query("""
WITH l AS (SELECT source AS document_id, doc_id AS page, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
m AS (SELECT document_id, page, regexp_replace(line, '[0-9]+', '#', 'g') AS mask, page % 2 AS y_band FROM l WHERE line <> ''),
p AS (SELECT document_id, count(DISTINCT page) AS pages FROM l GROUP BY 1 HAVING count(DISTINCT page) >= 3)
SELECT document_id, mask, y_band FROM (SELECT document_id, mask, y_band, count(DISTINCT page) AS n FROM m GROUP BY ALL) JOIN p USING (document_id) WHERE n >= greatest(2, floor(0.02 * pages))""")
def furniture_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text"))
    lines = lines.filter(F.length(F.trim("text")) > 0).withColumn("y", 24.0 * (F.col("page") % 2) + 5)
    return structure.furniture(lines, share=0.02)


@_query("SELECT b.item_id AS needle_id, d.doc_id AS hay_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_in_document(spark, sf_dir):
    needles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    hay = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hay_id"), F.col("text").alias("hay"))
    return evidence.containing(needles, hay)


@_query(r"""
WITH l AS (SELECT doc_id, i, trim(regexp_replace(lines[i], '[ \t\r\f\x0b]+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal, CAST((i - 1) // 50 + 1 AS INT) AS page, md5(line) AS line FROM l WHERE line <> ''""")
def pdf_lines(spark, sf_dir):
    """Every document as a PDF of 50 lines a page, read back line by line."""
    docs = tiles.spread(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text"))
    files = pdf.to_pdf(docs.select(F.col("doc_id").cast("string").alias("path"), F.split("text", "\n").alias("lines")))
    lines, _ = pdf.read_lines(files)
    return lines.select(F.col("document_id").cast("long").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), "page", F.md5("text").alias("line"))


@_query(r"""
WITH t AS (SELECT conv_id, turn, text, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM conversations),
g AS (SELECT conv_id, conv_id % 3 AS named, array_to_string(list_filter(regexp_split_to_array(regexp_replace(arg_min(text, turn), '[.!?;…]', ' ', 'g'), '\s+'), lambda x: x <> '')[1:8], ' ') AS q FROM conversations GROUP BY conv_id),
p AS (SELECT *, trim(regexp_replace(lower(q), '[^\p{L}\p{N}]+', ' ', 'g')) AS nq FROM g),
s AS (SELECT *, nq <> '' AND len(string_split(nq, ' ')) >= 4 AS sound FROM p),
h AS (SELECT conv_id, any_value(named) AS named, any_value(nq) AS nq, any_value(sound) AS sound, bool_or(turn = named) AS known, bool_or(turn = named AND contains(' ' || n || ' ', ' ' || nq || ' ')) AS own, list(turn) FILTER (WHERE turn <> named AND contains(' ' || n || ' ', ' ' || nq || ' ')) AS others,
bool_or(turn = named AND list_contains(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'))), nq)) AS line FROM s JOIN t USING (conv_id) GROUP BY conv_id),
r AS (SELECT *, NOT sound AND nq <> '' AND line AND len(list_filter(string_split(nq, ' '), lambda x: NOT regexp_full_match(x, '[0-9]+'))) >= 2 AS by_lines FROM h)
SELECT conv_id, CASE WHEN sound AND NOT own AND len(others) = 1 THEN others[1] ELSE named END AS section, coalesce(known AND by_lines, false) AS by_lines,
CASE WHEN NOT known THEN 'unknownSection' WHEN sound THEN CASE WHEN NOT own AND coalesce(len(others), 0) <> 1 THEN 'outsideSection' END WHEN NOT by_lines THEN 'unverified' END AS reason FROM r""")
def placed_gaps(spark, sf_dir):
    """Conversations as documents of a section a turn; each one's gap quotes its first turn and names one of the first three."""
    c = table(spark, sf_dir, "conversations")
    sections = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("section"), F.split("text", "\n").alias("lines"))
    pages = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), "text")
    words = F.filter(F.split(F.regexp_replace("text", "[.!?;…]", " "), r"\s+"), lambda x: x != "")
    gaps = c.groupBy("conv_id").agg(F.min_by(F.array_join(F.slice(words, 1, 8), " "), "turn").alias("quote"))
    gaps = gaps.select(F.col("conv_id").alias("document_id"), F.col("conv_id").alias("gap_id"), (F.col("conv_id") % 3).alias("section"), "quote", F.lit("Nothing says who looks after this part").alias("what"))
    out = coverage.place_gaps(gaps, sections, pages, pages.select("document_id", F.col("text").alias("passage")).filter("false"))
    return out.select(F.col("document_id").alias("conv_id"), "section", "by_lines", "reason")


@_query("SELECT source, sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY source, sha256(text)")
def content_hash_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@_query("SELECT doc_id, sha256('v1' || chr(0) || lang || chr(0) || text || chr(0)) AS fingerprint FROM documents")
def fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.lit("v1"), F.col("lang"), F.col("text")).alias("fingerprint"))


_SCRUB = "substr(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g'), '[0-9]{9,}', '<number>', 'g'), 1, 400)"


@_query(f"SELECT 'd' AS kind, doc_id AS id, {_SCRUB} AS scrubbed FROM documents UNION ALL SELECT 'c', conv_id * 1000 + turn, {_SCRUB} FROM conversations")
def pii_scrub(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), text.scrub(F.col("text")).alias("scrubbed"))
    return d.unionByName(table(spark, sf_dir, "conversations").select(F.lit("c").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.scrub(F.col("text")).alias("scrubbed")))


@_query("""
SELECT conv_id, island, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM (
SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations) GROUP BY conv_id, island""")
def turn_sections(spark, sf_dir):
    rows = structure.islands(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return rows.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"))


@_query("""
WITH v AS (SELECT lang AS section, doc_id % 3 AS read, text AS quote FROM documents JOIN labels USING (doc_id)),
s AS (SELECT section, count(DISTINCT read) AS reads FROM v GROUP BY section HAVING count(DISTINCT read) >= 2),
q AS (SELECT section, md5(quote) AS quote, row_number() OVER (PARTITION BY section ORDER BY count(DISTINCT read) DESC, length(quote) DESC, quote DESC) AS r FROM v GROUP BY section, quote)
SELECT section, quote, reads FROM q JOIN s USING (section) WHERE r = 1""")
def agreement(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    reads = docs.select(F.col("lang").alias("section"), (F.col("doc_id") % 3).alias("read"), F.col("text").alias("quote"))
    return analytics.agreement(reads, 3).withColumn("quote", F.md5("quote"))


_LABELLED = """(SELECT doc_id, CASE quality * 2 + toxic WHEN 0 THEN 'contradicts' WHEN 1 THEN 'absent' WHEN 2 THEN 'covered' ELSE 'partial' END AS verdict, CASE doc_id % 4 WHEN 0 THEN 'must' WHEN 1 THEN 'should' WHEN 2 THEN 'may' ELSE 'unstated' END AS obligation FROM labels)"""


def _labelled(spark, sf_dir):
    v = F.col("quality") * 2 + F.col("toxic")
    verdict = F.when(v == 0, "contradicts").when(v == 1, "absent").when(v == 2, "covered").otherwise("partial")
    m = F.col("doc_id") % 4
    return table(spark, sf_dir, "labels").select("doc_id", verdict.alias("verdict"), F.when(m == 0, "must").when(m == 1, "should").when(m == 2, "may").otherwise("unstated").alias("obligation"))


_SEVERITY = """CASE WHEN verdict IN ('covered', 'not_applicable') THEN NULL WHEN verdict = 'not_assessable' THEN CASE WHEN obligation = 'must' THEN 'moderate' ELSE 'check' END
WHEN verdict = 'contradicts' THEN CASE WHEN obligation IN ('should', 'may') THEN 'moderate' ELSE 'critical' END
WHEN verdict = 'absent' THEN CASE WHEN obligation = 'must' THEN 'critical' WHEN obligation IN ('should', 'may') THEN 'moderate' ELSE 'check' END
WHEN verdict = 'partial' THEN CASE WHEN obligation = 'may' THEN 'check' ELSE 'moderate' END ELSE 'check' END"""


@_query(f"SELECT doc_id, verdict, obligation, {_SEVERITY} AS severity FROM {_LABELLED}")
def severity_matrix(spark, sf_dir):
    return _labelled(spark, sf_dir).withColumn("severity", verdicts.severity(F.col("verdict"), F.col("obligation")))


@_query(f"""
WITH r AS (SELECT doc_id % 50 AS clause_id, min(CASE verdict WHEN 'contradicts' THEN 1 WHEN 'covered' THEN 2 WHEN 'partial' THEN 3 WHEN 'needs_review' THEN 4 ELSE 5 END) AS r FROM {_LABELLED} GROUP BY 1)
SELECT clause_id, CASE r WHEN 1 THEN 'contradicts' WHEN 2 THEN 'covered' WHEN 3 THEN 'partial' WHEN 4 THEN 'needs_review' ELSE 'absent' END AS verdict FROM r""")
def project_verdict(spark, sf_dir):
    return verdicts.project_verdict(_labelled(spark, sf_dir).withColumn("clause_id", F.col("doc_id") % 50))


@_query(f"""
SELECT q.o_custkey, CASE WHEN sig AND crit > 0 THEN 'board' WHEN crit > 0 THEN 'architect' WHEN sig THEN 'architect' WHEN open_ > 0 THEN 'architect' ELSE 'auto_approve' END AS route
FROM (SELECT o_custkey, max(o_totalprice) > 300000 AS sig, count_if(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS crit, count_if(o_orderstatus = 'P') AS open_ FROM orders GROUP BY 1) q""")
def next_step_routing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.when(F.max("o_totalprice") > 300000, "significant").otherwise("not_significant").alias("sig"),
        F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("crit"), F.count_if(F.col("o_orderstatus") == "P").alias("open_"))
    return o.select("o_custkey", verdicts.next_step(F.col("crit"), F.lit(0), F.col("sig"), F.col("open_")).alias("route"))


@_query("""
SELECT o_orderkey AS request_id, CASE WHEN o_totalprice >= 200000 OR o_orderpriority IN ('1-URGENT', '2-HIGH') OR CAST(o_orderdate AS DATE) > DATE '1996-01-31' + INTERVAL 12 MONTH THEN 'significant' ELSE 'not_significant' END AS significance FROM orders""")
def significance_rules(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    fields = F.array(
        F.struct(F.lit("cost").alias("field"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value")),
        F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")),
        F.struct(F.lit("golive").alias("field"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value")),
    )
    answers = o.select(F.col("o_orderkey").alias("request_id"), F.lit("1996-01-31").alias("as_of"), F.explode(fields).alias("f")).select("request_id", "as_of", "f.*").withColumn("items", F.lit(None).cast("array<string>"))
    rules = spark.createDataFrame(
        [("cost", True, "cost", "at_least", "200000", None, "high cost"), ("urgent", True, "priority", "one_of", None, ["1-URGENT", "2-HIGH"], "urgent"), ("late", True, "golive", "further_out_than_months", "12", None, "far off"), ("off", False, "cost", "at_least", "0", None, "inactive"), ("odd", True, "nothing", "is_true", "true", None, "no such question")],
        "category string, active boolean, field string, operator string, value string, items array<string>, text string",
    )
    return verdicts.classify(verdicts.significance(answers, rules))


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber BETWEEN 1 AND 2 THEN 'head' ELSE 'tail' END AS label FROM lineitem WHERE l_linenumber BETWEEN 1 AND 2 OR l_linenumber BETWEEN 5 AND 7")
def range_label_lines(spark, sf_dir):
    ranges = spark.createDataFrame([(1, 2, "head"), (5, 7, "tail")], "from_at int, to_at int, label string").withColumn("all", F.lit(1))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.lit(1).alias("all"))
    return structure.in_ranges(lines, ranges, "all", "l_linenumber").select("l_orderkey", "l_linenumber", "label")


@_query("""
WITH t AS (SELECT min(event_type) AS kind FROM events), m AS (SELECT user_id, ts, max(event_id) AS mark FROM events, t WHERE event_type = kind GROUP BY user_id, ts)
SELECT e.event_id, m.mark FROM (SELECT events.* FROM events, t WHERE event_type <> kind) e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts""")
def asof_section(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.broadcast(events.agg(F.min("event_type").alias("kind")))
    both = events.crossJoin(kind)
    marks = both.filter("event_type = kind").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark"))
    return structure.as_of(both.filter("event_type <> kind").select("event_id", "user_id", "ts"), marks, "user_id", "ts", "mark").select("event_id", "mark")


@_query("""
WITH r AS (SELECT o_custkey % 20 AS query, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
w AS (SELECT query, o_custkey, o_orderkey, rank, row_number() OVER (PARTITION BY query ORDER BY rank, o_custkey) AS place FROM r),
b AS (SELECT query, least(24, 2 * count(DISTINCT o_custkey)) AS budget FROM r GROUP BY query)
SELECT query, o_custkey, o_orderkey, rank, place FROM w JOIN b USING (query) WHERE place <= budget""")
def weave_round_robin(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("query"), "o_custkey", "o_orderkey", "o_totalprice")
    ranked = search.ranked(o, "rank", F.desc("o_totalprice"), F.col("o_orderkey"), by="o_custkey").drop("o_totalprice")
    return analytics.weave(ranked, "query", "o_custkey", "rank", 2).withColumn("place", F.col("place").cast("long"))


@_query("SELECT event_type AS stage, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn FROM events WHERE event_id % 4 <> 0 AND event_id % 5 < 3")
def queue_claim_order(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 4 == 0, "done").otherwise("queued").alias("state"), F.col("ts").alias("created_at"), F.col("ts").alias("run_after"), F.lit(None).cast("timestamp_ntz").alias("lease_until"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"))
    return streams.claimable(jobs, F.lit("2999-01-01").cast("timestamp_ntz")).select("stage", "id", F.col("turn").cast("long").alias("turn"))


@_query("SELECT event_id, ts + to_seconds(CAST(least(3600, pow(2, event_id % 14)) AS BIGINT)) AS again FROM events")
def backoff_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.backoff(F.col("ts"), F.col("event_id") % 14).alias("again"))


@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    out = streams.tumbling(streams.with_time(table(spark, sf_dir, "events")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_query("""
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (
SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s""")
def session_counts(spark, sf_dir):
    out = streams.sessions(streams.with_time(table(spark, sf_dir, "events")))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@_query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'U', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0)")
def upsert_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return state.upsert(o, o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("U")), ["o_orderkey"])


@_query("SELECT coalesce(a.o_custkey, b.o_custkey) AS clause_ref, a.s AS first, b.s AS second, a.s IS NOT DISTINCT FROM b.s AS agree FROM (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.o_custkey = b.o_custkey")
def mode_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    run = lambda k: o.filter(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("clause_ref")).agg(F.max("o_orderstatus").alias("verdict"))
    return state.compare_modes(run(0), run(1), ["F", "O", "P"])


@_query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens, CAST(floor(length(text) / 3.8::DOUBLE) AS BIGINT) AS chunk_tokens FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.chunk_tokens(F.col("text")).alias("chunk_tokens"))


@_query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) - length(replace(html, '<li>', '1234')) = 0 AS same_length FROM pages")
def page_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    same = F.length("html") - F.length(F.replace(F.col("html"), F.lit("<li>"), F.lit("1234"))) == 0
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), same.alias("same_length"))


@_query("""
WITH s AS (SELECT doc_id AS id, source AS run, length(text) AS n FROM documents),
c AS (SELECT run, n AS c FROM s), w AS (SELECT run, sum(n) AS whole, max(n) AS top FROM s GROUP BY run),
o AS (SELECT run, n, coalesce(sum(n) OVER (PARTITION BY run ORDER BY n, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER (PARTITION BY run) - row_number() OVER (PARTITION BY run ORDER BY n, id) + 1 AS rest FROM s)
SELECT run, CAST(greatest(600, CASE WHEN whole <= 50000 THEN top ELSE cut END) AS BIGINT) AS cap FROM w JOIN (SELECT run, min(CASE WHEN floor((50000 - before) / rest::DOUBLE) < n THEN floor((50000 - before) / rest::DOUBLE) END) AS cut FROM o GROUP BY run) USING (run)""")
def budget_cap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("run"), F.length("text").cast("long").alias("n"))
    return analytics.budget_cap(d, "run", "n", 50000)


@_query("SELECT run_id, count(DISTINCT coalesce('c:' || cause, 'f:' || finding_id)) AS work FROM (SELECT o_custkey AS run_id, CASE WHEN o_orderpriority < '3' THEN o_orderpriority END AS cause, CAST(o_orderkey AS VARCHAR) AS finding_id FROM orders) GROUP BY run_id")
def root_cause_work(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority")).alias("cause"), F.col("o_orderkey").cast("string").alias("finding_id"))
    return analytics.work_count(o)


@_query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') AND (quality IS NULL OR quality IN (1)) AND source IS DISTINCT FROM 'src3'")
def scoped_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "de") & ~F.col("source").eqNullSafe(F.lit("src3"))).select("doc_id", "lang")
    return rows.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").filter(F.col("quality").isNull() | F.col("quality").isin(1))


@_query("SELECT source FROM documents EXCEPT SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def sources_without_toxic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bad = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("source")
    return docs.select("source").distinct().join(bad, "source", "left_anti")


@_query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS siblings FROM lineitem)
SELECT o_orderkey, l_linenumber, p_brand, n_name, siblings FROM c JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F'""")
def framework_clauses(spark, sf_dir):
    siblings = F.count("*").over(Window.partitionBy("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("siblings", siblings)
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    out = lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(nations, "c_nationkey").join(parts, "l_partkey")
    return out.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "p_brand", "n_name", "siblings")


# Further operators over the driver's tables; each query shapes a table into the operator's frame.


_DUTY = r"(?i)\\b(?:must|shall|is\\s+required\\s+to|are\\s+required\\s+to|is\\s+prohibited|are\\s+prohibited|may\\s+not|must\\s+not|shall\\s+not)\\b".replace("\\\\", "\\")


@_query(f"""
WITH l AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'Part ' || l_partkey || ' must ship from ' || l_suppkey WHEN 1 THEN 'Part ' || l_partkey || ' may not leave before its date' WHEN 2 THEN 'Part ' || l_partkey || ' is mustard from the supplier' ELSE 'It shall' END AS line FROM lineitem)
SELECT l_orderkey, l_linenumber, md5(line) AS said FROM l WHERE length(line) BETWEEN 25 AND 400 AND regexp_matches(line, '{_DUTY}')""")
def normative_lines(spark, sf_dir):
    part = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    kind = F.col("l_linenumber") % 4
    line = F.when(kind == 0, F.concat(part, F.lit(" must ship from "), F.col("l_suppkey").cast("string"))).when(kind == 1, F.concat(part, F.lit(" may not leave before its date"))).when(kind == 2, F.concat(part, F.lit(" is mustard from the supplier"))).otherwise("It shall")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    return rows.filter(text.normative(F.col("line"))).select("l_orderkey", "l_linenumber", F.md5("line").alias("said"))


@_query("""
WITH w AS (SELECT conv_id, turn, role, unnest(range(greatest(0, CAST(ceil((turn - 3) / 3.0) AS BIGINT)), CAST(floor(turn / 3.0) AS BIGINT) + 1)) AS win FROM conversations),
d AS (SELECT *, least(turn - win * 3, 3 - (turn - win * 3)) AS depth FROM w)
SELECT conv_id, turn, arg_max(role || win, depth * 1000 + win) AS role, count(DISTINCT role || win) > 1 AS disputed FROM d GROUP BY conv_id, turn""")
def fused_windows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ordinal"), "role")
    views = structure.windows(c, size=4, overlap=1).withColumn("role", F.concat("role", F.col("window").cast("string")))
    return structure.fuse_windows(views).select(F.col("document_id").alias("conv_id"), F.col("ordinal").alias("turn"), "role", "disputed")


@_query("""
WITH g AS (SELECT conv_id, turn, text, CASE WHEN lag(turn) OVER w IS NULL OR turn <> lag(turn) OVER w + 1 OR role = 'assistant' OR lag(role) OVER w = 'assistant' THEN 1 ELSE 0 END AS gap FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(gap) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM g)
SELECT conv_id, min(turn) AS first, max(turn) AS last, md5(string_agg(text, chr(10) ORDER BY turn)) AS said FROM i GROUP BY conv_id, island""")
def passages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ordinal"), F.when(F.col("role") == "assistant", "bullet").otherwise("text").alias("kind"), "text")
    return structure.passages(c).select(F.col("document_id").alias("conv_id"), "first", "last", F.md5("text").alias("said"))


def twin_pairs(spark, sf_dir):
    """The first earlier document that holds most of a document's content words, over all documents; no SQL twin: it would hold all pairs."""
    return search.earlier_twins(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).select(F.col("twin").alias("kept"), F.col("id").alias("dropped"))


@_query("""
WITH t AS (SELECT l_orderkey AS table_id, l_linenumber AS pos, CASE WHEN l_tax > 0.04 THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS value, CASE WHEN l_linenumber <= 2 THEN 'c' || l_linenumber ELSE '' END AS name FROM lineitem)
SELECT table_id, round(0.35 * avg(CASE WHEN value <> '' THEN 1.0::DOUBLE ELSE 0 END) + 0.65 * count(DISTINCT CASE WHEN name <> '' THEN name END) / count(DISTINCT pos)::DOUBLE, 3) AS confidence FROM t GROUP BY table_id""")
def table_confidence(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    name = F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))).otherwise("")
    return structure.table_confidence(l.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("at"), F.when(F.col("l_tax") > 0.04, F.col("l_partkey").cast("string")).otherwise("").alias("value"), name.alias("column")))


@_query("""
WITH p AS (SELECT o_custkey AS doc, o_orderkey % 40 AS page, o_orderkey AS ord, o_totalprice AS h FROM orders),
m AS (SELECT doc, page, arg_max(h, ord) AS h FROM p GROUP BY doc, page)
SELECT doc, page, h > coalesce(lag(h) OVER (PARTITION BY doc ORDER BY page), 0) AS taller FROM m""")
def next_row_test(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 40).alias("page"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("h"))
    m = analytics.latest(o, ["doc", "page"], F.desc("ord"))
    return m.select("doc", "page", (F.col("h") > F.coalesce(F.lag("h").over(Window.partitionBy("doc").orderBy("page")), F.lit(0.0))).alias("taller"))


@_query("""
SELECT o_custkey AS run_id, o_orderkey, lead, row_number() OVER (PARTITION BY o_custkey ORDER BY lead, o_orderkey) AS place FROM (
SELECT o_custkey, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, coalesce('k:' || CASE WHEN o_orderpriority < '4' THEN o_orderpriority END, 'p:' || CAST(o_orderkey AS VARCHAR))) AS lead FROM orders)""")
def group_adjacent(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), "o_orderkey", F.when(F.col("o_orderpriority") < "4", F.col("o_orderpriority")).alias("cause"))
    return analytics.group_adjacent(o, "cause", "o_orderkey").select("run_id", "o_orderkey", "lead", F.col("place").cast("long").alias("place"))


@_query("""
SELECT o_custkey, o_orderkey, place, more FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, greatest(count(*) OVER (PARTITION BY o_custkey) - 3, 0) AS more FROM orders) WHERE place <= 3""")
def capped_findings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return analytics.capped(o, "o_custkey", 3, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"), "more")


@_query("SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1997-06-01' THEN 'ended' WHEN o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1998-06-01' THEN 'ending' ELSE 'supported' END AS status FROM orders")
def lifecycle_of_orders(spark, sf_dir):
    eol = F.date_add(F.col("o_orderdate").cast("date"), 30)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.lifecycle_status(eol, F.lit(None).cast("date"), F.lit("1997-06-01").cast("date"))["status"].alias("status"))


@_query("""
WITH d AS (SELECT c_custkey AS decision_id, c_nationkey AS ref, c_nationkey % 2 AS org, c_custkey % 25 AS project, c_mktsegment = 'BUILDING' AS whole, 1 + (c_custkey % 7) AS x, 1 AS y FROM customer WHERE c_acctbal > 0),
m AS (SELECT n_nationkey AS c, decision_id, 0 AS band, CAST(-decision_id AS DOUBLE) * 1000000 AS o FROM nation JOIN d ON ref = n_nationkey AND org = n_nationkey % 2 WHERE whole OR project = n_nationkey
UNION ALL SELECT n_nationkey, decision_id, 1, 1 - (n_nationkey * x + y) / (sqrt(n_nationkey * n_nationkey + 1) * sqrt(x * x + y * y)) FROM nation JOIN d ON ref <> n_nationkey AND org = n_nationkey % 2 WHERE whole OR project = n_nationkey)
SELECT c AS c_nationkey, decision_id, band FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY band, round(o, 9), decision_id) AS r FROM m WHERE band = 0 OR o <= 0.42) WHERE r <= 3""")
def anchored_precedents(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    clauses = nations.select(key.alias("clause_id"), key.alias("clause_ref"), (key % 2).alias("organisation_id"), key.cast("long").alias("project_id"), F.array(key.cast("double"), F.lit(1.0)).alias("clause_vector"))
    c = table(spark, sf_dir, "customer")
    decisions = c.select(
        F.col("c_custkey").alias("decision_id"), F.col("c_nationkey").alias("clause_ref"), (F.col("c_nationkey") % 2).alias("organisation_id"), F.when(F.col("c_acctbal") > 0, "active").otherwise("expired").alias("status"), F.lit(None).cast("timestamp").alias("expires_at"),
        F.when(F.col("c_mktsegment") == "BUILDING", "organisation").otherwise("project").alias("scope"), (F.col("c_custkey") % 25).alias("project_id"), F.timestamp_seconds("c_custkey").alias("created_at"),
        F.array((1 + F.col("c_custkey") % 7).cast("double"), F.lit(1.0)).alias("vector"), F.lit("accepts").alias("effect"))
    got = search.precedents(clauses, decisions, F.lit("2024-01-01").cast("timestamp"), F.lit(0.42))
    return got.select(F.col("clause_id").alias("c_nationkey"), "decision_id", F.col("band").cast("int").alias("band"))


@_query("SELECT who_, entry FROM (SELECT CAST(c_custkey AS VARCHAR) AS who_, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'member' WHEN c_mktsegment = 'BUILDING' THEN 'invited' WHEN c_mktsegment = 'MACHINERY' THEN 'blocked' ELSE 'founder' END AS entry FROM customer)")
def admissions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("email"), "c_mktsegment")
    members = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("email"))
    roster = c.select("email", F.when(F.col("c_mktsegment") == "BUILDING", "invited").when(F.col("c_mktsegment") == "MACHINERY", "blocked").otherwise("none").alias("status"))
    return state.admission(c.select("email"), members, roster).select(F.col("email").alias("who_"), "entry")


def _halves(body):
    """The first and the second half of a text, which together are all of it."""
    half = F.floor(F.length(body) / 2).cast("int")
    return F.left(body, half), F.substr(body, half + 1)


#: Answers for every arm of the guards, dealt to documents by id: verdict, confidence, best score, rationale, cited, generated, fabricated, conflicted, clause, figure text, evidence (null: the document's text).
_ANSWERS = [
    ("covered", 0.9, 0.03, "It is described.", 1, 0, 0, False, "Statement: Services shall emit structured logs.", "", None),
    ("covered", 0.9, 0.03, "It is described.", 0, 0, 0, False, "Statement: Services shall emit structured logs.", "", ""),
    ("contradicts", 0.95, 0.03, "The store is shared.", 2, 2, 0, False, "Statement: Stores shall be separate.", "gateway broker", None),
    ("covered", 0.85, 0.03, "The broker is drawn.", 1, 1, 0, False, "Statement: A gateway with a broker shall be used.", "gateway broker", None),
    ("covered", 0.7, 0.03, "The broker is drawn.", 2, 2, 0, False, "Statement: A gateway with a broker shall be used.", "gateway broker", None),
    ("partial", 0.9, 0.03, "A decision allows it.", 1, 0, 1, False, "Statement: Stores shall be separate.", "", None),
    ("covered", 0.9, 0.03, "A decision allows it.", 1, 0, 0, True, "Statement: Stores shall be separate.", "", None),
    ("contradicts", 0.9, 0.03, "It must use Alpha unless exceptions are approved.", 1, 0, 0, False, "Statement: Alpha is the preferred platform. Requirements: Other platforms may apply.", "", None),
    ("contradicts", 0.9, 0.03, "It must use Alpha.", 1, 0, 0, False, "Statement: Beta is prohibited; Alpha is preferred.", "", None),
    ("contradicts", 0.9, 0.03, "Readiness is not confirmed. It uses one unit.", 1, 0, 0, False, "Statement: Readiness shall be shown.", "", None),
    ("covered", 0.9, 0.03, "It meets the approved platform requirement.", 1, 0, 0, False, "Statement: Workloads with an approved target platform stay there.", "", None),
    ("covered", 0.9, 0.03, "Identity and security are described.", 1, 0, 0, False, "Statement: Public hosting is considered.\nRequirements: governance, cybersecurity, identity and data protection.", "", None),
    ("partial", 0.9, 0.03, "A list is given.", 1, 0, 0, False, "Statement: latency and performance budgets shall be kept.", "", "The cipher and access list"),
    ("absent", 0.9, 0.01, "Nothing mentions it.", 0, 0, 0, False, "Statement: Growth shall follow thresholds.", "", ""),
    ("absent", 0.5, 0.03, "Nothing mentions it.", 0, 0, 0, False, "Statement: Growth shall follow thresholds.", "", ""),
    ("absent", 0.9, 0.03, "Nothing mentions it.", 0, 0, 0, False, "Statement: Growth shall follow thresholds.", "", ""),
]


def _guard_sql() -> str:
    """The guard chain in SQL; look-behinds, which it lacks, are spelled otherwise."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    items = lambda xs: "[" + ", ".join(q(x) for x in xs) + "]"
    has = lambda x, pattern: f"regexp_matches({x}, {q(pattern)})"
    words = lambda x, form: f"regexp_extract_all(lower({x}), '{form}')"
    families = lambda x: "list_filter([" + ", ".join(f"CASE WHEN {has(x, rf'(?i)\b(?:{chr(124).join(w)})\b')} THEN {q(n)} END" for n, w in fidelity.FAMILIES.items()) + "], lambda v: v IS NOT NULL)"
    kinds = " ".join(f"WHEN list_contains({items(g)}, w) THEN {q(min(g))}" for g in fidelity.SUBJECT_ALIASES)
    terms = lambda x: f"list_distinct(list_transform(list_filter({words(x, '[a-z0-9]+')}, lambda w: length(w) > 2 AND NOT list_contains({items(fidelity.SUBJECT_STOP)}, w)), lambda w: CASE {kinds} ELSE w END))"
    domains = lambda t: "list_filter([" + ", ".join(f"CASE WHEN list_has_any({t}, {items(w)}) THEN {q(n)} END" for n, w in fidelity.SUBJECT_DOMAINS.items()) + "], lambda v: v IS NOT NULL)"
    figure = lambda x: f"list_filter(list_distinct({words(x, '[a-z0-9]{4,}')}), lambda w: NOT list_contains({items(lexical.KEYWORD_STOP)}, w))"
    value = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
    rows = ", ".join("(" + ", ".join([str(k), *map(value, a)]) + ")" for k, a in enumerate(_ANSWERS))
    return f"""
WITH a(k, verdict, confidence, best, r, cited, generated, fabricated, conflicted, clause, figure, ev) AS (VALUES {rows}),
x AS (SELECT doc_id, a.* EXCLUDE (k, ev), coalesce(ev, text) AS said, coalesce(ev, 'x') <> '' AS cites, coalesce(nullif(regexp_extract(r, '(?s)^(.*?[.!?])\\s', 1), ''), r) AS gap FROM documents JOIN a ON k = doc_id % {len(_ANSWERS)}),
y AS (SELECT *, list_transform(string_split_regex(clause, '[.;:]\\s+|\\n'), lambda s: CASE WHEN {has('s', fidelity.ENUMERATED)} THEN {families('s')} ELSE [] END) AS listed, {families("said || ' ' || r")} AS shown, {terms('clause')} AS tc, {terms('said')} AS te,
  regexp_replace(r, '(?i)\\b(?:' || array_to_string(list_distinct(regexp_extract_all(lower(clause), {q(fidelity.APPROVAL)}, 1)), '|') || ')\\b', ' ', 'g') AS own FROM x),
z AS (SELECT *, listed[list_position(list_transform(listed, lambda l: len(l)), list_max(list_transform(listed, lambda l: len(l))))] AS named FROM y),
w AS (SELECT doc_id, verdict, CASE
 WHEN verdict IN ({', '.join(map(q, verdicts.CITING))}) AND NOT cites THEN 'cites nothing'
 WHEN verdict IN ({', '.join(map(q, verdicts.DECISIVE))}) AND cited > 0 AND generated = cited AND NOT (verdict = 'covered' AND confidence >= 0.8 AND (generated >= 2 OR len(list_intersect({figure('clause')}, {figure('figure')})) >= 2)) THEN 'figures only'
 WHEN fabricated > 0 THEN 'decision not on record'
 WHEN conflicted AND verdict IN ({', '.join(map(q, verdicts.DECISIVE))}) THEN 'decisions disagree'
 WHEN verdict = 'contradicts' AND {has('r', fidelity.EXCLUSIVE)} AND ({has('clause', fidelity.ALTERNATIVES)} OR (NOT {has('clause', fidelity.RESTRICTIVE)} AND {has('clause', fidelity.PREFERENTIAL)})) THEN 'overreach'
 WHEN verdict = 'contradicts' AND {has('gap', fidelity.HEDGE)} AND NOT {has('gap', fidelity.AFFIRMATIVE)} THEN 'hedged breach'
 WHEN verdict = 'covered' AND {has('clause', fidelity.APPROVAL)} AND NOT {has('said', fidelity.APPROVAL_EVIDENCE)} AND NOT {has('own', fidelity.APPROVAL_EVIDENCE)} THEN 'approval missing'
 WHEN verdict = 'covered' AND len(named) >= 3 AND NOT list_has_all(shown, named) THEN 'families missing'
 WHEN verdict IN ({', '.join(map(q, verdicts.CITING))}) AND len(tc) >= 2 AND len(te) >= 2 AND NOT list_has_any(tc, te) AND len({domains('tc')}) = 1 AND len({domains('te')}) = 1 AND {domains('tc')} <> {domains('te')} THEN 'subject mismatch'
 WHEN verdict = 'absent' AND best < 0.018 THEN 'weak retrieval'
 WHEN verdict = 'absent' AND confidence < 0.55 THEN 'low confidence' END AS why FROM z)
SELECT doc_id, verdict, CASE WHEN why IS NULL THEN verdict WHEN why IN ('hedged breach', 'approval missing') THEN 'not_assessable' WHEN why = 'families missing' THEN 'partial' ELSE 'needs_review' END AS verdict_after, why FROM w"""


@_query(_guard_sql())
def guarded_verdicts(spark, sf_dir):
    """The guard chain over an answer for each document, every arm among them."""
    names = "k int, verdict string, confidence double, best_score double, rationale string, cited_total int, cited_generated int, n_fabricated int, conflicted boolean, clause_text string, figure_text string, said string"
    answers = spark.createDataFrame([(k, *a) for k, a in enumerate(_ANSWERS)], names)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % len(_ANSWERS)).cast("int").alias("k")).join(F.broadcast(answers), "k")
    none = F.array().cast("array<string>")
    rows = docs.withColumn("evidence", F.when(F.col("said") == "", none).otherwise(F.array(F.coalesce("said", "text")))).withColumn("fabricated", F.when(F.col("n_fabricated") > 0, F.array(F.lit("d"))).otherwise(none))
    return verdicts.guard(rows).select("doc_id", "verdict", "verdict_after", "why")


def batch_search(spark, sf_dir):
    """The passages shown for every document with an id divisible by 100 as a query, by language as design; no SQL twin for the ordered fold."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    kind = F.when(F.col("doc_id") % 7 == 0, "figure").when(F.col("doc_id") % 5 == 0, "table").otherwise("section")
    chunks = d.select(
        F.col("doc_id").alias("chunk_id"), F.col("lang").alias("design"), F.crc32("source").alias("document_id"), F.lit(1).alias("organisation_id"), F.when(F.col("doc_id") % 5 < 2, F.floor(F.col("doc_id") / 5)).alias("source_id"), kind.alias("source_kind"),
        F.col("source").alias("heading_path"), F.col("source").alias("heading"), F.lit(1).alias("page"), "text")
    asked = d.filter("doc_id % 100 = 0").join(e.withColumnRenamed("chunk_id", "doc_id"), "doc_id").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"), lexical.query_terms(F.col("text")).alias("terms"))
    return search.evidence_windows(asked, chunks, e, organisation=1)


def section_tree(spark, sf_dir):
    """Sections and paths of conversations read as documents, a turn a line."""
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "user", F.concat((F.col("turn") / 2 + 1).cast("int").cast("string"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    lines = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ordinal"), F.lit(1).alias("page"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x0"), said.alias("text"))
    return structure.sections(lines)


@_query("""
WITH d AS (SELECT doc_id AS key, text, CAST(floor(length(text) / 2) AS BIGINT) AS h FROM documents)
SELECT key, md5(trim(regexp_replace(substr(text, 1, h), '^\\s+', ''), ' ')) AS statement, nullif(md5(trim(regexp_replace(substr(text, h + 1), '^\\s+', ''), ' ')), md5('')) AS rationale, 0 AS requirements, 'labelled' AS how FROM d WHERE regexp_matches(substr(text, 1, h), '\\S')""")
def clause_extraction(spark, sf_dir):
    """Whole documents, half of each labelled as statement and half as rationale."""
    first, second = _halves(F.col("text"))
    got = structure.clauses(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit("Statement: "), first, F.lit(" Rationale: "), second).alias("text")))
    return got.select("key", F.md5("statement").alias("statement"), F.md5("rationale").alias("rationale"), F.coalesce(F.size("requirements"), F.lit(0)).alias("requirements"), "how")


_PLAIN = "trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@_query(f"""
WITH p AS (SELECT source AS document_id, doc_id AS page, text, CASE WHEN lead(doc_id) OVER w = doc_id + 1 THEN lead(text) OVER w END AS after FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
n AS (SELECT document_id, page, ' ' || {_PLAIN.format(x='text')} || ' ' AS one, ' ' || {_PLAIN.format(x='text || chr(10) || after')} || ' ' AS both_ FROM p),
q AS (SELECT document_id, CAST(item_id AS VARCHAR) AS quote_id, item_id AS named, ' ' || {_PLAIN.format(x='text')} || ' ' AS said FROM benchmark, (SELECT DISTINCT source AS document_id FROM documents)),
m AS (SELECT document_id, quote_id, page, CASE WHEN contains(one, said) AND page = named THEN 0 WHEN contains(one, said) THEN 1 WHEN contains(both_, said) THEN 2 END AS rank FROM q JOIN n USING (document_id)),
b AS (SELECT document_id, quote_id, arg_min(page, rank * 1000000000000 + page) AS page FROM m WHERE rank IS NOT NULL GROUP BY ALL)
SELECT document_id, quote_id, page FROM q LEFT JOIN b USING (document_id, quote_id)""")
def quote_verification(spark, sf_dir):
    """Every benchmark text as a quote from every source, whose documents are its pages; the item's number is the page named."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("quote_id"), F.col("text").alias("quote"), F.col("item_id").alias("page"))
    quotes = docs.select(F.col("source").alias("document_id")).distinct().crossJoin(F.broadcast(items))  # sources and items are few
    return evidence.verify_quotes(quotes, tiles.spread(pages))


@_query("SELECT o_custkey AS document_id, CAST(sum(n) AS BIGINT) AS clauses FROM (SELECT o_custkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.06) AS n FROM orders) GROUP BY o_custkey")
def clauses_per_document(spark, sf_dir):
    sections = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"), F.col("o_custkey").alias("document_id"))
    return analytics.clauses_per_document(sections, table(spark, sf_dir, "lineitem").filter("l_tax > 0.06").select(F.col("l_orderkey").alias("section_id")))


@_query("""
WITH d AS (SELECT o_orderkey AS document_id, o_custkey AS project_id, o_orderstatus = 'F' AS ready, o_orderdate AS ts FROM orders),
r AS (SELECT l_orderkey * 10 + l_linenumber AS run_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_orderkey END AS document_id, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey END AS own, l_returnflag <> 'R' AS complete, l_shipdate AS ts, l_linestatus FROM lineitem),
o AS (SELECT r.*, coalesce(own, d.project_id) AS project_id FROM r LEFT JOIN d USING (document_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY document_id, CASE WHEN document_id IS NULL THEN project_id END ORDER BY ts DESC, run_id) AS n FROM o WHERE complete AND project_id IS NOT NULL),
w AS (SELECT c.project_id, count(*) AS unreviewed FROM c JOIN (SELECT l_orderkey * 10 + l_linenumber AS run_id FROM lineitem WHERE l_linestatus = 'O') USING (run_id) WHERE n = 1 GROUP BY 1)
SELECT c_custkey AS project_id, coalesce(designs, 0) AS designs, coalesce(ready, 0) AS ready, coalesce(runs, 0) AS runs, coalesce(unreviewed, 0) AS unreviewed, last_activity FROM customer
LEFT JOIN (SELECT project_id, count(*) AS designs, CAST(count_if(ready) AS BIGINT) AS ready, max(ts) AS last_activity FROM d GROUP BY 1) x ON x.project_id = c_custkey
LEFT JOIN (SELECT project_id, count(*) AS runs FROM o GROUP BY 1) y ON y.project_id = c_custkey LEFT JOIN w ON w.project_id = c_custkey""")
def project_listing(spark, sf_dir):
    """Customers as projects, orders as designs, line items as runs, each with one finding."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    run = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    whole = F.col("l_linenumber") % 3 == 0
    documents = o.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("parsing").alias("status"), F.col("o_orderdate").alias("updated_at"))
    runs = l.select(run.alias("run_id"), F.when(~whole, F.col("l_orderkey")).alias("document_id"), F.when(whole, F.col("l_suppkey")).alias("project_id"), F.when(F.col("l_returnflag") != "R", "complete").otherwise("failed").alias("state"), F.col("l_shipdate").alias("started_at"))
    findings = l.select(run.alias("run_id"), F.lit("covered").alias("verdict"), F.when(F.col("l_linestatus") == "O", "pending").otherwise("accepted").alias("reviewer_state"))
    return analytics.project_listing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id")), documents, runs, findings)


@_query(f"""
SELECT clause AS run_id, CAST(count_if(verdict = 'covered') AS BIGINT) AS covered, CAST(count_if(verdict = 'partial') AS BIGINT) AS partial, CAST(count_if(verdict = 'contradicts') AS BIGINT) AS contradicts, CAST(count_if(doc_id % 3 = 0) AS BIGINT) AS unreviewed, count(*) AS total
FROM (SELECT *, doc_id % 20 AS clause FROM {_LABELLED}) WHERE verdict <> 'absent' GROUP BY clause""")
def outcome_snapshot(spark, sf_dir):
    names = ["covered", "partial", "contradicts"]
    f = _labelled(spark, sf_dir).select((F.col("doc_id") % 20).alias("run_id"), "verdict", F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("accepted").alias("reviewer_state"))
    return analytics.outcome_snapshot(f, names).select("run_id", *(F.col("verdicts")[v].alias(v) for v in names), "unreviewed", "total")


@_query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, c_mktsegment) AS label FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def backfilled_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("label"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("label"))
    return analytics.backfill(o, c, ["o_custkey"], "label").select("o_orderkey", "label")


@_query("SELECT o_orderkey AS document_id, c_name AS project FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def documents_with_project(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("project_id"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))
    return analytics.with_project(o, c).select("document_id", "project")


@_query("""
SELECT o.o_custkey AS document_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_orderkey AS figure_id, (SELECT max(page * 1000000000 + s.o_orderkey) % 1000000000 FROM (SELECT o_orderkey % 7 AS page, o_orderkey, o_custkey FROM orders) s WHERE s.o_custkey = o.o_custkey AND s.page <= l_linenumber) AS section FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey""")
def figures_by_section(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sections = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("section"), (F.col("o_orderkey") % 7).alias("first_page"))
    figures = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(o, "o_orderkey").select(F.col("o_custkey").alias("document_id"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("o_orderkey")).alias("figure_id"), F.col("l_linenumber").alias("page"))
    return evidence.figures_by_section(figures, sections).select("document_id", "figure_id", "section")


@_query("""
SELECT l_orderkey AS finding_id, l_linenumber AS "at", row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 WHEN o_orderpriority LIKE '1%' AND l_linenumber % 2 = 0 THEN 1 ELSE 2 END, l_linenumber) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def evidence_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("The design of "), "o_orderpriority", F.lit(" fails")).alias("rationale"))
    title = F.when(F.col("l_linenumber") % 2 == 0, "1-Urgent").otherwise(F.lit(None))
    e = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select(F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("at"), F.when(F.col("l_returnflag") == "R", "quoted").alias("breach_quote"), title.alias("document_title"), "rationale")
    return evidence.evidence_order(e).select("finding_id", "at", F.col("place").cast("long").alias("place"))


@_query(f"""
WITH f AS (SELECT doc_id AS clause_id, doc_id % 3 AS design, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS n FROM {_LABELLED} WHERE verdict = 'absent' OR (verdict = 'partial' AND doc_id % 2 = 0))
SELECT design, n // 25 AS batch, n % 25 + 1 AS number, clause_id FROM f""")
def confirmation_batches(spark, sf_dir):
    said = F.when(F.col("doc_id") % 2 == 0, "The limit is not specified.").otherwise("The limit differs.")
    f = _labelled(spark, sf_dir).select(F.lit(1).alias("run_id"), (F.col("doc_id") % 3).alias("design"), F.col("doc_id").alias("clause_id"), F.col("doc_id").alias("clause_ordinal"), "verdict", said.alias("rationale"))
    return evidence.to_confirm(f).select("design", F.col("batch").cast("long").alias("batch"), F.col("number").cast("long").alias("number"), "clause_id")


@_query("""
WITH m AS (SELECT conv_id, turn, text, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations),
s AS (SELECT conv_id AS document_id, section, min(turn) AS first, max(turn) AS last, arg_min(text, turn) AS t FROM m GROUP BY conv_id, section)
SELECT document_id, CAST(section AS BIGINT) AS section, first, last, md5(CASE WHEN section > 0 THEN t WHEN max(section) OVER (PARTITION BY document_id) > 0 THEN 'Front matter' ELSE 'Document' END) AS title FROM s""")
def outline_sections(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ordinal"), "text", F.when(F.col("role") == "user", 1).alias("depth"))
    return structure.outline_sections(c).select("document_id", "section", "first", "last", F.md5("title").alias("title"))


@_query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'HOUSEHOLD' AND c_custkey % 2 = 0")
def titles_by_reference(spark, sf_dir):
    title = F.when((F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_custkey") % 2 == 0), "AR 0001 plan").when(F.col("c_mktsegment") == "BUILDING", "AR-0001 plan").otherwise("AR-00011 plan")
    return table(spark, sf_dir, "customer").filter(text.title_starts(title, F.lit("AR-0001"))).select("c_custkey")


for _f in (twin_pairs, batch_search, section_tree):
    _query()(_f)
