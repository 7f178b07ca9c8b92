"""Parts that several SQL twins share: stems of a vocabulary, terms of a text."""

from attestry.functions import lexical
from attestry.functions.stemming import COMPLETE, EXCEPTIONS, STEP_2, STEP_3, STEP_4, UNCHANGED

_V = "[aeiouy]"
_SHORT = f"([^aeiouy]{_V}[^aeiouywxY]|^{_V}[^aeiouy])$"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _suffix(words) -> str:
    return f"regexp_extract(x, '^.*?({'|'.join(words)})$', 1)"


def _mapped(table: dict[str, str]) -> str:
    return "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


def lexemes(text: str) -> str:
    """A list expression: the words of a text without stop words."""
    words = f"list_transform(regexp_split_to_array(lower(coalesce({text}, '')), '[^a-z0-9.]+'), lambda t: trim(t, '.'))"
    return f"list_filter({words}, lambda t: t <> '' AND NOT list_contains([{_list(lexical.STOP)}], t))"


def query_terms(text: str) -> str:
    """A list expression: distinct words of a query less filler, or with it if nothing else is left."""
    words = f"list_distinct({lexemes(text)})"
    left = f"list_filter({words}, lambda t: NOT list_contains([{_list(lexical.FILLER)}], t))"
    return f"CASE WHEN len({left}) > 0 THEN {left} ELSE {words} END"


def stems(vocabulary: str) -> str:
    """CTEs that end in stems(w, stem) for the words w of a vocabulary; words other than three letters and more stay."""
    cut = lambda n: f"left(x, length(x) - {n})"
    inside = lambda region: f"length(x) - length(s) >= {region}"
    may2 = "CASE s WHEN 'ogi' THEN regexp_matches(x, 'logi$') WHEN 'li' THEN regexp_matches(x, '[cdeghkmnrt]li$') ELSE true END"
    return f"""
v0 AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS x FROM (SELECT DISTINCT w FROM {vocabulary}) WHERE regexp_matches(w, '^[a-z]{{3,}}$') AND w NOT IN ({_list([*EXCEPTIONS, *UNCHANGED])})),
v1 AS (SELECT *, regexp_extract(x, '^(gener|commun|arsen|.*?{_V}[^aeiouy])', 1) AS b FROM v0),
v2 AS (SELECT w, x, CASE WHEN b = '' THEN length(x) ELSE length(b) END AS p1 FROM v1),
v3 AS (SELECT *, regexp_extract(substr(x, p1 + 1), '^(.*?{_V}[^aeiouy])', 1) AS b FROM v2),
v4 AS (SELECT w, p1, CASE WHEN b = '' THEN length(x) ELSE p1 + length(b) END AS p2, x FROM v3),
v5 AS (SELECT w, p1, p2, CASE WHEN regexp_matches(x, 'sses$') THEN {cut(2)} WHEN regexp_matches(x, '(ied|ies)$') THEN CASE WHEN length(x) > 4 THEN {cut(2)} ELSE {cut(1)} END
WHEN regexp_matches(x, '(us|ss)$') THEN x WHEN regexp_matches(x, '{_V}.+s$') THEN {cut(1)} ELSE x END AS x FROM v4),
done AS (SELECT w, x FROM v5 WHERE x IN ({_list(COMPLETE)})),
v6 AS (SELECT *, {_suffix(["eedly", "eed", "ingly", "edly", "ing", "ed"])} AS s FROM v5 WHERE x NOT IN ({_list(COMPLETE)})),
v7 AS (SELECT w, p1, p2, CASE WHEN s = '' THEN x WHEN s LIKE 'eed%' THEN CASE WHEN {inside('p1')} THEN {cut('length(s)')} || 'ee' ELSE x END WHEN regexp_matches({cut('length(s)')}, '{_V}') THEN {cut('length(s)')} ELSE x END AS x,
s <> '' AND s NOT LIKE 'eed%' AND regexp_matches({cut('length(s)')}, '{_V}') AS open FROM v6),
v8 AS (SELECT w, p1, p2, CASE WHEN NOT open THEN x WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN regexp_matches(x, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN {cut(1)} WHEN regexp_matches(x, '{_SHORT}') AND length(x) <= p1 THEN x || 'e' ELSE x END AS x FROM v7),
v9 AS (SELECT w, p1, p2, CASE WHEN regexp_matches(x, '^.+[^aeiouy][yY]$') THEN {cut(1)} || 'i' ELSE x END AS x FROM v8),
v10 AS (SELECT *, {_suffix(STEP_2)} AS s FROM v9),
v11 AS (SELECT w, p1, p2, CASE WHEN s <> '' AND {inside('p1')} AND {may2} THEN {cut('length(s)')} || {_mapped(STEP_2)} ELSE x END AS x FROM v10),
v12 AS (SELECT *, {_suffix(STEP_3)} AS s FROM v11),
v13 AS (SELECT w, p1, p2, CASE WHEN s <> '' AND {inside('p1')} AND (s <> 'ative' OR {inside('p2')}) THEN {cut('length(s)')} || {_mapped(STEP_3)} ELSE x END AS x FROM v12),
v14 AS (SELECT *, {_suffix(STEP_4)} AS s FROM v13),
v15 AS (SELECT w, p1, p2, CASE WHEN s <> '' AND {inside('p2')} AND (s <> 'ion' OR regexp_matches(x, '[st]ion$')) THEN {cut('length(s)')} ELSE x END AS x FROM v14),
v16 AS (SELECT w, CASE WHEN regexp_matches(x, 'e$') AND (length(x) - 1 >= p2 OR (length(x) - 1 >= p1 AND NOT regexp_matches({cut(1)}, '{_SHORT}'))) THEN {cut(1)} WHEN regexp_matches(x, 'll$') AND length(x) - 1 >= p2 THEN {cut(1)} ELSE x END AS x FROM v15),
own(w, stem) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in EXCEPTIONS.items())}),
stems AS (SELECT w, lower(x) AS stem FROM (SELECT w, x FROM v16 UNION ALL SELECT w, x FROM done) UNION ALL
SELECT DISTINCT v.w, coalesce(own.stem, v.w) FROM {vocabulary} v LEFT JOIN own ON own.w = v.w WHERE NOT regexp_matches(v.w, '^[a-z]{{3,}}$') OR v.w IN ({_list([*EXCEPTIONS, *UNCHANGED])}))"""
