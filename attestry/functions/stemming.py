"""English stems by suffix rewriting (Porter's second algorithm) as column expressions.

A word is rewritten step by step; each step reads the word and where its regions begin, and gives a word.
Stems of a corpus are made once for each distinct word (``with_stems``), never for each occurrence.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the algorithm: whole words that go their own way, words left alone, and words kept as they are once a plural is gone.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
UNCHANGED = "sky news howe atlas cosmos bias andes".split()
COMPLETE = "inning outing canning herring earring proceed exceed succeed".split()
# Suffixes and what they become: the first is looked for in the first region, the longest one decides.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

V = "[aeiouy]"  # a y that stands for a consonant is written Y meanwhile
REGION = f"(?:.*?{V}[^aeiouy])"
SHORT_END = f"(?:[^aeiouy]{V}[^aeiouywxY]|^{V}[^aeiouy])$"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _suffix(word: Column, suffixes) -> Column:
    """The longest of the suffixes that ends a word, else ''."""
    return F.regexp_extract(word, f"^.*?({'|'.join(suffixes)})$", 1)


def _literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _without(word: Column, n) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _inside(word: Column, suffix: Column, region: Column) -> Column:
    return F.length(word) - F.length(suffix) >= region


def _plural(w: Column) -> Column:
    ied = F.when(F.length(w) > 4, _without(w, 2)).otherwise(_without(w, 1))
    s = F.when(w.rlike(f"{V}.+s$"), _without(w, 1)).otherwise(w)
    return F.when(w.rlike("sses$"), _without(w, 2)).when(w.rlike("(?:ied|ies)$"), ied).when(w.rlike("(?:us|ss)$"), w).when(w.rlike("s$"), s).otherwise(w)


def _past(w: Column, s: Column, first: Column, second: Column) -> Column:
    rest = _without(w, F.length(s))
    short = rest.rlike(SHORT_END) & (F.length(rest) <= first)
    mended = F.when(rest.rlike("(?:at|bl|iz)$"), F.concat(rest, F.lit("e"))).when(rest.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(rest, 1)).when(short, F.concat(rest, F.lit("e"))).otherwise(rest)
    ee = F.when(_inside(w, s, first), F.concat(rest, F.lit("ee"))).otherwise(w)
    return F.when(s == "", w).when(s.startswith("eed"), ee).when(rest.rlike(V), mended).otherwise(w)


def _final_y(w: Column, s: Column, first: Column, second: Column) -> Column:
    return F.when(w.rlike("^.+[^aeiouy][yY]$"), F.concat(_without(w, 1), F.lit("i"))).otherwise(w)


def _map(table: dict[str, str]):
    def step(w: Column, s: Column, first: Column, second: Column) -> Column:
        new = F.concat(_without(w, F.length(s)), F.try_element_at(_literal_map(table), s))
        may = F.when(s == "ogi", w.rlike("logi$")).when(s == "li", w.rlike("[cdeghkmnrt]li$")).when(s == "ative", _inside(w, s, second)).otherwise(True)
        return F.when((s != "") & _inside(w, s, first) & may, new).otherwise(w)

    return step


def _last_suffix(w: Column, s: Column, first: Column, second: Column) -> Column:
    may = F.when(s == "ion", w.rlike("[st]ion$")).otherwise(True)
    return F.when((s != "") & _inside(w, s, second) & may, _without(w, F.length(s))).otherwise(w)


def _final_e(w: Column, s: Column, first: Column, second: Column) -> Column:
    before = F.length(w) - 1
    e = w.rlike("e$") & ((before >= second) | ((before >= first) & ~_without(w, 1).rlike(SHORT_END)))
    return F.when(e | (w.rlike("ll$") & (before >= second)), _without(w, 1)).otherwise(w)


#: What follows once a plural is gone: the suffixes that a step looks for, and what it makes of the word.
STEPS = [(["eedly", "eed", "ingly", "edly", "ing", "ed"], _past), ([], _final_y), (STEP_2, _map(STEP_2)), (STEP_3, _map(STEP_3)), (STEP_4, _last_suffix), ([], _final_e)]


def _marked(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")


def _first(w: Column) -> Column:
    begun = F.regexp_extract(w, f"^(gener|commun|arsen|{REGION})", 1)
    return F.when(begun == "", F.length(w)).otherwise(F.length(begun))


def _second(w: Column, first: Column) -> Column:
    more = F.regexp_extract(F.substring(w, first + 1, F.length(w)), f"^({REGION})", 1)
    return F.when(more == "", F.length(w)).otherwise(first + F.length(more))


def _or_as_it_is(word: Column, regular: Column) -> Column:
    known = _literal_map(EXCEPTIONS | {w: w for w in UNCHANGED})
    return F.when(~word.rlike("^[a-z]{3,}$"), word).otherwise(F.coalesce(F.try_element_at(known, word), regular))


def stem(word: Column) -> Column:
    """The stem of a lower-case word; anything but a word of three letters a to z or more is left as it is."""

    def after_plural(x, r1, r2):
        def step(y, k):
            suffixes, body = STEPS[k]
            done = let(_suffix(y, suffixes), lambda s: body(y, s, r1, r2)) if suffixes else body(y, F.lit(""), r1, r2)
            return let(done, lambda z: step(z, k + 1) if k + 1 < len(STEPS) else F.lower(z))

        return F.when(x.isin(COMPLETE), x).otherwise(step(x, 0))

    regular = lambda w: let(_first(w), lambda r1: let(_second(w, r1), lambda r2: let(_plural(w), lambda x: after_plural(x, r1, r2))))
    return _or_as_it_is(word, let(_marked(word), regular))


def stems_of(words: DataFrame, word: str = "word", name: str = "stem") -> DataFrame:
    """(word, stem) of distinct words: stem() with a column for each step, which is compiled.

    Write it before joining by the stem: planning a join spells a key's steps out, over and over.
    """
    rows = words.select(F.col(word).alias("_word"), _marked(F.col(word)).alias("_w"))
    rows = rows.withColumn("_first", _first(F.col("_w")))
    rows = rows.withColumn("_second", _second(F.col("_w"), F.col("_first"))).withColumn("_plain", _plural(F.col("_w"))).withColumn("_x", F.col("_plain"))
    for suffixes, body in STEPS:
        rows = rows.withColumn("_s", _suffix(F.col("_x"), suffixes) if suffixes else F.lit(""))
        rows = rows.withColumn("_x", body(F.col("_x"), F.col("_s"), F.col("_first"), F.col("_second")))
    regular = F.when(F.col("_plain").isin(COMPLETE), F.col("_plain")).otherwise(F.lower("_x"))
    return rows.select(F.col("_word").alias(word), _or_as_it_is(F.col("_word"), regular).alias(name))


def with_stems(rows: DataFrame, word: str = "word", name: str = "stem") -> DataFrame:
    """Rows with the stem of their word; each distinct word is rewritten once."""
    stems = rows.select(word).filter(F.col(word).isNotNull()).distinct().select(word, stem(F.col(word)).alias(name))
    return rows.join(stems, word, "left")
