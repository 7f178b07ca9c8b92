"""Text functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording that makes a sentence a duty, a proposed line a rule, and advice or a rule without content.
NORMATIVE = r"(?i)\b(?:must|shall|is\s+required\s+to|are\s+required\s+to|is\s+prohibited|are\s+prohibited|may\s+not|must\s+not|shall\s+not)\b"
BINDING = r"(?i)\b(?:must|shall|is\s+required\s+to|are\s+required\s+to)\b"
MODALS = [
    ("must", ["must", "shall", "required", "require", "requires", "mandatory", "prohibited", "forbidden", "may not", "must not", "shall not"]),
    ("should", ["should", "recommended", "expected", "ought"]),
    ("may", ["may", "can", "optional", "permitted", "encouraged"]),
]
# Second halves of hyphenated compounds.
COMPOUND_TAILS = (
    "oriented server controller response layered op based driven tier end side premise prem time only party specific level wide aware free safe in out off on up down to "
    "facing critical bound ready heavy light scoped owned backed"
).split()
VAGUE = (
    r"(?i)\b(?:appropriate(?:ly)?|adequate(?:ly)?|as\s+necessary|where\s+possible|where\s+appropriate|best\s+practices?|consider(?:ing|ed)?|proper(?:ly)?|robust|sufficient(?:ly)?"
    r"|as\s+needed|if\s+required|suitable|reasonable)\b"
)
GENERIC = (
    r"(?i)\b(?:consider\s+(?:implementing|adding|reviewing|using|adopting)|ensure\s+(?:that\s+)?proper|confirm\s+(?:its\s+|the\s+)?support\s+status|align\s+with\s+stakeholders|review\s+and\s+update"
    r"|follow\s+(?:industry\s+)?best\s+practices?|as\s+appropriate|where\s+appropriate)\b"
)
# A reading of a rule's lines: broader than NORMATIVE.
DUTY = r"(?i)\b(?:must|shall|required|requires|prohibited|mandatory|may\s+not|never)\b"
# A description that opens on a part of the document.
ABOUT_DOCUMENT = (
    r"(?i)^\s*(?:an?|the|this)?\s*(?:architecture|context|system|flow|component|high.level|reference)?\s*"
    r"(?:sketch|diagram|figure|illustration|drawing|matrix|section|page|appendix|heading)\b"
)
# What a template leaves to its author, and files that a section points at.
PLACEHOLDER = r"(?i)\b(?:TBD|TBC|N/A)\b|\bto be (?:confirmed|determined|decided|agreed|received|provided)\b|\btype here\b"
ATTACHMENT = r"(?i)\S+\.(?:xlsx|xlsm|xls|csv|docx|doc|pdf|pptx|vsdx|vsd|msg|zip)\b"


def normative(sentence: Column) -> Column:
    """A sentence of 25 to 400 characters that states a duty."""
    return sentence.rlike(NORMATIVE) & F.length(sentence).between(25, 400)


def generic(text: Column) -> Column:
    """Advice of fewer than six words, or with a phrase that says nothing."""
    return (F.size(F.split(F.trim(text), r"\s+")) < 6) | text.rlike(GENERIC)


def vague_gap(what: Column) -> Column:
    """A gap described in fewer than six words, or by where it stands; advice phrases are no fault in a description."""
    return (F.size(F.split(F.trim(what), r"\s+")) < 6) | what.rlike(ABOUT_DOCUMENT)


def substantive(text: Column) -> Column:
    """Prose that says something: over 200 characters yes, under 60 no, else sentences without a placeholder or an attached file."""
    said = F.trim(text)
    open_ = said.rlike(PLACEHOLDER) | F.replace(said, F.lit("\n"), F.lit("")).rlike(ATTACHMENT)
    return F.when(F.length(said) > 200, True).when(F.length(said) < 60, False).otherwise(said.rlike(r"[.!?](?:\s|$)") & ~open_)


def strongest_modal(text: Column) -> Column:
    """must, should, may or null; "may not" and its like are must."""
    low = F.regexp_replace(F.lower(text), r"\b(?:may|can|might)\s+not\b", " must not ")
    out = F.lit(None).cast("string")
    for strength, words in reversed(MODALS):
        out = F.when(low.rlike(r"\b(?:" + "|".join(words) + r")\b"), strength).otherwise(out)
    return out


def obligation(parsed: Column, requirements: Column, statement: Column, title: Column) -> Column:
    """(strength, source): parsed strengths if they line up with the requirements, else what statement, title or requirements say."""
    order = F.array(*(F.lit(s) for s, _ in MODALS))
    sound = (F.size(parsed) == F.size(requirements)) & (F.size(parsed) > 0) & F.forall(parsed, lambda s: F.array_contains(order, s))
    best = lambda a: F.when(F.array_contains(a, "must"), "must").when(F.array_contains(a, "should"), "should").when(F.array_contains(a, "may"), "may")
    # The statement governs; only where it and the title are silent do the requirements speak.
    read = F.coalesce(strongest_modal(statement), strongest_modal(title), best(F.filter(F.transform(requirements, strongest_modal), lambda s: s.isNotNull())))
    return F.when(sound, F.struct(best(parsed).alias("strength"), F.lit("parsed").alias("source"))).when(
        read.isNotNull(), F.struct(read.alias("strength"), F.lit("read").alias("source"))).otherwise(F.struct(F.lit("unstated").alias("strength"), F.lit("unstated").alias("source")))


def rejoin_wraps(text: Column) -> Column:
    """Join words broken by a hyphen at a line end; compounds, capitals and digits keep the hyphen."""
    kept = F.regexp_replace(text, rf"([a-z]{{2,}})-\s*\n\s*(?=(?:{'|'.join(COMPOUND_TAILS)})(?![a-z]))", "$1-")
    joined = F.regexp_replace(kept, r"([a-z]{2,})-\s*\n\s*([a-z]+)", "$1$2")
    return F.regexp_replace(joined, r"-\s*\n\s*(?=[A-Z0-9])", "-")


def reflow(text: Column, least: int = 60) -> Column:
    """Join a long line without a sentence end to a continuation in lower case."""

    def step(acc, line):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.length(last) >= least) & ~last.rlike(r"[.!?:;]\s*$") & line.rlike(r"^\s*\p{Ll}")
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.rtrim(last), F.lit(" "), F.ltrim(line))))).otherwise(F.concat(acc, F.array(line)))

    return F.array_join(F.aggregate(F.split(text, "\n"), F.array().cast("array<string>"), step), "\n")


def shorten(text: Column, most: int = 700) -> Column:
    """At most so many characters, cut at a space, with an ellipsis."""
    head = F.regexp_extract(F.substring(text, 1, most), r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(head == "", F.substring(text, 1, most)).otherwise(head), F.lit("…")))


def first_sentences(text: Column, most: int) -> Column:
    """Whole sentences within so many characters, else as shorten()."""
    head = F.regexp_extract(F.substring(text, 1, most), r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.when(head == "", shorten(text, most)).otherwise(head))


def plain_words(text: Column) -> Column:
    """Words only, lower case, of a text in compatibility form."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "‘’“”–—\u00a0", "''\"\"-- ")), r"[^\p{L}\p{N}]+", " "))


def normalise(text: Column) -> Column:
    """Words only, lower case, typographic marks as plain ones; ligatures and full-width forms as plain letters.

    Other compatibility forms and combining accents: operators.evidence.with_compatible() first.
    """
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))  # full-width ASCII
    plain = F.translate(text, wide, "".join(map(chr, range(0x21, 0x7F))))
    for mark, letters in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}.items():
        plain = F.replace(plain, F.lit(mark), F.lit(letters))
    return plain_words(plain)


def searchable(passage: Column) -> Column:
    """A passage as parts_in() reads it."""
    return F.concat(F.lit(" "), normalise(passage), F.lit(" "))


def quote_parts(quote: Column) -> Column:
    """The parts of a quote between ellipses, normalised."""
    return F.filter(F.transform(F.split(quote, r"…|\.\.\.|\[\.\.\.\]"), normalise), lambda p: p != "")


def parts_in(parts: Column, hay: Column) -> Column:
    """Whether all parts stand in a searchable() passage in order, on word boundaries."""

    def step(at, part):
        found = F.call_function("locate", F.concat(F.lit(" "), part, F.lit(" ")), hay, at)
        return F.when(at == 0, 0).when(found == 0, 0).otherwise(found + F.length(part) + 1)

    return (F.size(parts) > 0) & (F.aggregate(parts, F.lit(1), step) > 0)


def quote_in(quote: Column, passage: Column) -> Column:
    """Whether all parts of a quote (split at ellipses) stand in the passage in order, on word boundaries."""
    return parts_in(quote_parts(quote), searchable(passage))


def scrub(text: Column, most: int = 400) -> Column:
    """E-mail addresses and long numbers replaced, cut to length: for logs."""
    mail = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    return F.substring(F.regexp_replace(mail, r"[0-9]{9,}", "<number>"), 1, most)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over parts, each ended by NUL."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\0")))), 256)


def valid_email(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^[^\s@,;]+@[^\s@,;.]+\.[^\s@,;]{2,}$"), F.lit(False))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def chunk_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(3.8)).cast("long")


def reference(n: Column) -> Column:
    """AR-0001 and on."""
    return F.concat(F.lit("AR-"), F.when(n > 9999, n.cast("string")).otherwise(F.lpad(n.cast("string"), 4, "0")))


def file_format(content: Column) -> Column:
    """A file's kind by its first bytes; office kinds share the zip mark."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(head.startswith("D0CF11E0A1B11AE1"), "legacy office").otherwise("unknown")
    )


# How headings, contents lines and the parts of a clause read.
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
APPENDIX = r"(?i)^(Appendix\s+[A-Z])\s*[:.]?\s*(.*)$"
TITLE_LIKE = r"^[A-Z][^.!?:]{2,78}$"
CLAUSE_LABEL = r"(?i)^\s*(?:statement|rationale|requirements?|implications?|applicable\s+patterns?|note)\b\s*:"
CONTENTS_ENTRY = r"^(.+?)[\s.]{2,}(\d{1,4})$"


def heading(line: Column) -> Column:
    """(kind, depth, title) of a line that reads as a heading, else null: numbered, appendix, or a short title; a clause's part never."""
    said = F.trim(line)
    number = F.regexp_extract(said, NUMBERED, 1)
    make = lambda kind, depth: F.struct(F.lit(kind).alias("kind"), depth.cast("int").alias("depth"), said.alias("title"))
    found = F.when(number != "", make("numbered", F.size(F.split(number, r"\.")))).when(said.rlike(APPENDIX), make("appendix", F.lit(1))).when(said.rlike(TITLE_LIKE), make("title", F.lit(None)))
    return F.when(~said.rlike(CLAUSE_LABEL), found)


def toc_entry(line: Column) -> Column:
    """(number, title, page, depth) of a contents line, else null: a title, two dots or spaces or more, a page up to 5000."""
    said = F.trim(line)
    title, page = F.regexp_replace(F.regexp_extract(said, CONTENTS_ENTRY, 1), r"^[ .]+|[ .]+$", ""), F.regexp_extract(said, CONTENTS_ENTRY, 2)
    number, appendix = F.regexp_extract(title, NUMBERED, 1), F.initcap(F.regexp_extract(title, APPENDIX, 1))
    rest = F.when(number != "", F.trim(F.regexp_extract(title, NUMBERED, 2))).when(appendix != "", F.coalesce(F.nullif(F.trim(F.regexp_extract(title, APPENDIX, 2)), F.lit("")), appendix)).otherwise(title)
    depth = F.when(number != "", F.size(F.split(number, r"\."))).otherwise(1)
    entry = F.struct(F.coalesce(F.nullif(number, F.lit("")), F.nullif(appendix, F.lit(""))).alias("number"), rest.alias("title"), F.try_to_number(page, F.lit("9999")).cast("int").alias("page"), depth.alias("depth"))
    return F.when(said.rlike(CONTENTS_ENTRY) & (rest != "") & (page.try_cast("int") <= 5000), entry)


def render_row(headers: Column, cells: Column) -> Column:
    """column: value pairs of a table row; a blank cell reads as not specified."""
    return F.array_join(F.zip_with(headers, cells, lambda h, c: F.concat(h, F.lit(": "), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("not specified")))), "; ")


def unique_headers(headers: Column) -> Column:
    """Later equal headers get " (2)" and on."""
    seen = lambda h, i: F.size(F.filter(F.slice(headers, F.lit(1), i + 1), lambda x: x == h))
    return F.transform(headers, lambda h, i: F.when(seen(h, i) > 1, F.concat(h, F.lit(" ("), seen(h, i).cast("string"), F.lit(")"))).otherwise(h))


def labelled_part(text: Column, label: str, labels: tuple[str, ...] = ("Statement", "Rationale", "Requirements", "Guidance", "Note")) -> Column:
    """What follows "label:" up to the next label; the first such part."""
    return F.trim(F.regexp_extract(text, rf"(?s)\b{label}:\s*(.*?)(?=\b(?:{'|'.join(labels)}):|$)", 1))


def product_matches(name: Column, text: Column) -> Column:
    """Letters and digits only: containment for five or more, equality below."""
    a, b = (F.regexp_replace(F.lower(x), "[^a-z0-9]", "") for x in (name, text))
    return F.when(F.length(a) >= 5, F.contains(b, a)).otherwise(a == b)


def version_stated(version: Column, quote: Column) -> Column:
    """Whether the version stands in the quote with no digit or dotted digit around it."""
    escaped = F.regexp_replace(version, "[.]", "[.]")
    return F.regexp_like(quote, F.concat(F.lit(r"(?<![0-9.])"), escaped, F.lit(r"(?![0-9]|\.[0-9])")))


def explain_error(message: Column, table: list[tuple[str, str]]) -> Column:
    """The sentence of the first pattern that matches."""
    out = F.lit(None).cast("string")
    for pattern, sentence in reversed(table):
        out = F.when(message.rlike(pattern), sentence).otherwise(out)
    return out


def compound_cells(text: Column) -> Column:
    """Records of a flattened grid marked "#: n |", if there are two or more."""
    parts = F.filter(F.split(text, r"#:\s*\d+\s*\|"), lambda p: F.trim(p) != "")
    return F.when(F.size(F.regexp_extract_all(text, F.lit(r"(#:\s*\d+\s*\|)"), 1)) >= 2, F.transform(parts, lambda p: F.transform(F.split(p, r"\|"), lambda c: F.trim(c))))


def title_starts(title: Column, reference: Column) -> Column:
    """Whether a title opens on a reference and a space, spelled as it is or with spaces for its marks."""
    plain = F.regexp_replace(reference, "[_-]+", " ")
    return F.startswith(title, F.concat(reference, F.lit(" "))) | F.startswith(title, F.concat(plain, F.lit(" ")))
