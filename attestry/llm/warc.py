"""Content-addressed WARC archive.

Every row becomes one WARC/1.1 record. The archive is two Parquet tables: ``payloads`` holds each
distinct payload once under its SHA-256, ``records`` holds each record's exact header block and that
address. Reading joins the two again, after recomputing both digests of every stored payload.

Of rows with equal payloads of at least ``min_bytes`` the one with the largest page_id is the
response, the others are revisits of it; rows with smaller payloads are all responses. Defined cases:
null html is an empty payload; rows that repeat the largest page_id are all responses; a null page_id
never outranks another and is a response only if its group has no other id; a null url leaves out the
target line, CR and LF in one are percent-encoded; an empty table gives an empty archive; columns
other than page_id, url and html are ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import cut

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2000-01-01T00:00:00Z"


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of 160 bits given as 40 hex digits: every 5 digits are 4 characters."""
    parts = []
    for k in range(8):
        bits = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def header(kind: Column, page_id: Column, url: Column, sha1: Column, refers: Column, length: Column, date: str) -> Column:
    """The header block of a record with its closing empty line; fields without a value are left out."""
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    name = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", name(page_id)), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)), line("WARC-Refers-To", name(refers)), F.lit("Content-Type: text/html\r\n"),
        line("WARC-Payload-Length", length.cast("string")), line("Content-Length", F.when(kind == "revisit", "0").otherwise(length.cast("string"))), F.lit("\r\n"),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Write the archive of pages (page_id, url, html) under path, which must be new and shared."""
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    size = F.octet_length("payload").cast("long")
    facts = rows.select("page_id", "url", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"), size.alias("length"))
    # One row a distinct payload; partial sums meet before the shuffle, so a hot payload costs a row a task.
    firsts = cut(facts.groupBy("address").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"), F.first("length").alias("bytes")))
    # Narrow rows only; both sides are exchanged, so a hot address is split at run time.
    shared = firsts.filter((F.col("copies") > 1) & (F.col("bytes") >= min_bytes)).select("address", "first_id")
    records = facts.join(shared, "address", "left")
    is_first = F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(is_first, "response").otherwise("revisit")
    refers = F.when(~is_first, F.col("first_id"))
    records = records.select("address", header(kind, F.col("page_id"), F.col("url"), base32_of_hex(F.col("sha1")), refers, F.col("length"), date).alias("header"))
    records.write.parquet(f"{path}/records")
    # The first row of each payload brings the bytes; its page_id is unique but for repeated rows.
    kept = rows.withColumn("address", F.sha2("payload", 256)).withColumn("at", F.coalesce(F.col("page_id").cast("string"), F.col("address")))
    wanted = firsts.select(F.col("address").alias("want"), F.coalesce(F.col("first_id").cast("string"), F.col("address")).alias("at"))
    stored = kept.join(wanted, "at").filter(F.col("address") == F.col("want"))
    # An address has one "at", by which the rows already lie together.
    stored.dropDuplicates(["at", "address"]).select("address", "payload").write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records as written: page_id, url, record_type, refers_to, payload_digest, payload_bytes, header, payload.

    A revisit is given the payload it refers to. Fails if a stored payload doesn't match its address,
    a header doesn't match its payload, or a record's payload is missing.
    """
    text = F.col("header").cast("string")
    field = lambda name, form: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {form}\r\n", 1), F.lit(""))
    records = spark.read.parquet(f"{path}/records").select(
        "address", "header", field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"), field("WARC-Target-URI", "([^\r]*)").alias("url"), field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"), field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"), field("WARC-Payload-Length", "([0-9]+)").cast("long").alias("payload_bytes"),
    )
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "address", "payload", F.octet_length("payload").cast("long").alias("stored_bytes"), base32_of_hex(F.sha1("payload")).alias("stored_digest"), (F.sha2("payload", 256) == F.col("address")).alias("sound"),
    )
    both = records.join(payloads, "address", "left")
    good = F.coalesce(F.col("sound") & (F.col("stored_bytes") == F.col("payload_bytes")) & (F.col("stored_digest") == F.col("payload_digest")), F.lit(False))
    checked = F.when(good, F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("the archive is damaged at "), "address")).cast("long"))
    return both.select("page_id", "url", "record_type", "refers_to", "payload_digest", checked.alias("payload_bytes"), "header", "payload")


def record_bytes() -> Column:
    """A record of read_archive as it stands in a WARC file: header block, payload (none in a revisit), two line ends."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(F.col("header"), body, F.lit(b"\r\n\r\n"))
