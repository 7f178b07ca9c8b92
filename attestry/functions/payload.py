"""JSON payloads read defensively, and what a reader sees of an excerpt or a rationale."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.text import plain_words


def read_list(payload: Column, schema: str, fits, most: int) -> Column:
    """(items, set_aside): items of a JSON list that fit, first of equal ones, at most so many; anything else counts as set aside."""
    items = F.coalesce(F.from_json(payload, f"array<{schema}>"), F.expr(f"cast(array() as array<{schema}>)"))
    good = F.slice(F.array_distinct(F.filter(items, lambda x: F.coalesce(fits(x), F.lit(False)))), 1, most)
    return F.struct(good.alias("items"), (F.size(items) - F.size(good)).alias("set_aside"))


def patch(payload: Column, **values: Column) -> Column:
    """A JSON object with values set; other keys keep their values, whatever these are. No object counts as an empty one."""
    old = F.coalesce(F.try_parse_json(payload).try_cast("map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    new = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.parse_json(F.regexp_replace(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", "$1")))))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*values)), new))


def evidence_quotes(payload: Column, least: int = 4) -> Column:
    """Quotes of a JSON evidence list, normalised, of at least so many words."""
    said = F.transform(F.coalesce(F.from_json(payload, "array<struct<quote:string>>"), F.expr("cast(array() as array<struct<quote:string>>)")), lambda x: plain_words(x["quote"]))
    return F.filter(said, lambda q: F.size(F.split(q, " ")) >= least)


def ordered_cells(row: Column, columns: Column) -> Column:
    """(column, value) of a row in the columns' order, keys beyond them at the end."""
    extra = F.array_except(F.map_keys(row), columns)
    return F.transform(F.concat(columns, extra), lambda c: F.struct(c.alias("column"), F.try_element_at(row, c).alias("value")))


def readable_excerpt(excerpt: Column, path: Column) -> Column:
    """An excerpt without the heading path it opens on and without a broken first word."""
    body = F.when(F.startswith(excerpt, path), F.substr(excerpt, F.length(path) + 1)).otherwise(excerpt)
    return F.regexp_replace(F.trim(body), r"^(?:…|\.\.\.)?\s*\p{Ll}{1,3}[.;,]\s+", "")


def without_extract_ids(rationale: Column) -> Column:
    """A rationale without references to extracts, and without the marks they leave behind."""
    plain = F.regexp_replace(rationale, r"\s*[\[(](?:extracts?\s*)?[CE]\d+(?:\s*(?:,|and|&)\s*[CE]?\d+)*[\])]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b[Ee]xtracts?\s+[CE]?\d+(?:\s*(?:,|and)\s*[CE]?\d+)*", "the design"), r"\s+([.,;])", "$1"))


def rationale_parts(rationale: Column) -> Column:
    """(label, text) of a rationale's sentences: Gap, Impact, Fix where one opens on a demand, Also for the rest."""
    fix = r"(?i)^(?:the design|it|this)?\s*(?:should|must|needs? to|add|state|define|specify|provide|document)\b"
    said = F.filter(F.split(F.trim(rationale), r"(?<=[.!?])\s+"), lambda s: s != "")
    label = lambda s, i: F.when(s.rlike(fix), "Fix").when(i == 0, "Gap").when(i == 1, "Impact").otherwise("Also")
    return F.transform(said, lambda s, i: F.struct(label(s, i).alias("label"), s.alias("text")))
