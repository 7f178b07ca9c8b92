"""Words, content words, weighted token tables and lexical rank."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import stemming

#: Wording of standards at large, which finds everything; and the common stop words of English text search.
FILLER = (
    "must shall should may will can standard standards requirement requirements policy policies guideline guidelines document documents documented documentation "
    "use used using ensure ensures ensuring provide provides provided include includes including apply applies applied maintain maintained define defines defined "
    "appropriate relevant applicable necessary current currently equivalent data system systems information organisation organization process processes"
).split()
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: Words of four letters and more that match any diagram.
KEYWORD_STOP = """
    that this with from they them have been will must should shall each other than
    when where which what while whose into onto upon over under about above below
    such same both more most some many much very also only just then than there
    these those their your ours theirn used using uses make makes made take taken
    does done being were was are for the and but not any all can may via per
    system systems design designs document documents solution solutions service
    services provide provides provided ensure ensures ensured include includes
    including requirement requirements standard standards clause clauses section
    sections shall_not appropriate relevant necessary applicable

    data through rather directly between flow flows across within around
    context enterprise platform platforms component components interface
    interfaces process processes manage managed management support supported
    operate operated record records control controls access user users
    application applications information business technical

    related associated specific general various different additional further
    following above below other others where whether during before after
    because however therefore given based upon able need needs needed
    required requires
""".split()


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-case runs of letters, digits and dots of at least so many characters, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9.]+"), lambda w: F.length(w) >= least)


def content_words(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def keywords(text: Column) -> Column:
    """Distinct words of at least four letters or digits that could tell what a diagram is about."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{4,})"), 1)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, KEYWORD_STOP)))


def _split(text: Column) -> Column:
    """Lower-case runs of letters, digits and inner dots; empty ones among them."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?<![a-z0-9.])[.]+|[.]+(?![a-z0-9.])", " "), "[^a-z0-9.]+")


def lexemes(text: Column) -> Column:
    """Lower-case words, numbers and dotted versions without common stop words, repeats kept; not stemmed yet."""
    return F.filter(_split(text), lambda w: (w != "") & ~w.isin(STOP))


def query_terms(text: Column) -> Column:
    """Distinct lexemes less filler; with the filler if nothing else is left."""
    said = lambda words, left: F.when(F.size(left) > 0, left).otherwise(words)
    return stemming.let(F.array_distinct(lexemes(text)), lambda words: stemming.let(F.array_except(words, F.array(*map(F.lit, FILLER))), lambda left: said(words, left)))


def weighted_terms(chunks: DataFrame, heading: int = 10, body: int = 1) -> DataFrame:
    """(chunk_id, term, weight): the stems of each chunk with the weight of all their occurrences; headings count ten times the body.

    With terms joined by OR each occurrence is a cover of its own, so rank is the sum of weights. Occurrences are counted
    in their row's words before they meet, and distinct words alone are stemmed.
    """
    # Stop words go once words are rows, where the test is compiled.
    part = lambda column, weight: chunks.select("chunk_id", F.explode(_split(F.col(column))).alias("word"), F.lit(weight).cast("long").alias("weight")).filter((F.col("word") != "") & ~F.col("word").isin(STOP))
    words = part("heading_path", heading).unionByName(part("text", body)).groupBy("chunk_id", "word").agg(F.sum("weight").alias("weight"))
    return stemming.with_stems(words, "word", "term").groupBy("chunk_id", "term").agg(F.sum("weight").alias("weight"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct stems of queries (query_id, terms)."""
    return stemming.with_stems(queries.select("query_id", F.explode("terms").alias("word")), "word", "term").select("query_id", "term").distinct()
