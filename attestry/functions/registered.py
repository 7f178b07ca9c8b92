"""Functions under names that SQL queries can call."""

from pyspark.sql import SparkSession

from attestry.functions import lexical


def _words(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


#: name: (parameters, type, body); bodies are plain SQL, so queries that call them stay with the optimizer.
FUNCTIONS = {
    "content_words": ("body STRING", "ARRAY<STRING>", "array_distinct(filter(split(lower(body), '[^a-z0-9.]+'), w -> length(w) >= 3))"),
    "lexemes": ("body STRING", "ARRAY<STRING>", f"filter(transform(split(lower(coalesce(body, '')), '[^a-z0-9.]+'), w -> regexp_replace(w, '^[.]+|[.]+$', '')), w -> w <> '' AND NOT array_contains({_words(lexical.STOP)}, w))"),
    "search_terms": (
        "body STRING", "ARRAY<STRING>",
        f"CASE WHEN size(array_except(array_distinct(lexemes(body)), {_words(lexical.FILLER)})) > 0 THEN array_except(array_distinct(lexemes(body)), {_words(lexical.FILLER)}) ELSE array_distinct(lexemes(body)) END",
    ),
    "chunk_weights": (
        "heading STRING, body STRING", "ARRAY<STRUCT<term: STRING, weight: INT>>",
        "concat(transform(lexemes(heading), w -> named_struct('term', w, 'weight', 10)), transform(lexemes(body), w -> named_struct('term', w, 'weight', 1)))",
    ),
    "verdict_severity": (
        "verdict STRING, obligation STRING", "STRING",
        "CASE WHEN verdict IN ('covered', 'not_applicable') THEN NULL WHEN verdict = 'not_assessable' THEN CASE WHEN obligation = 'must' THEN 'moderate' ELSE 'check' END"
        " WHEN verdict = 'contradicts' THEN CASE WHEN obligation IN ('should', 'may') THEN 'moderate' ELSE 'critical' END"
        " WHEN verdict = 'absent' THEN CASE WHEN obligation = 'must' THEN 'critical' WHEN obligation IN ('should', 'may') THEN 'moderate' ELSE 'check' END"
        " WHEN verdict = 'partial' THEN CASE WHEN obligation = 'may' THEN 'check' ELSE 'moderate' END ELSE 'check' END",
    ),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to this session's SQL."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
