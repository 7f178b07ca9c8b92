"""Sources and sinks: office files, rosters, images by content, tables, JSON lines."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import text

DOC = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MOST_ROWS, MOST_COLUMNS = 5000, 64
LINES = "path string, ordinal int, kind string, depth int, text string, cells array<string>"


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with their kind by content and a SHA-256; equal contents can then be dropped."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return rows.withColumn("kind", text.file_format(F.col("content"))).withColumn("sha256", F.sha2("content", 256))


def distinct_contents(files: DataFrame, organisation: str = "organisation_id") -> DataFrame:
    return files.dropDuplicates([organisation, "sha256"])


def _docx(data: bytes) -> list[tuple]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{DOC}t"))
    out = []
    for block in root.find(f"{DOC}body"):
        if block.tag == f"{DOC}p" and said(block).strip():
            style, outline = block.find(f"{DOC}pPr/{DOC}pStyle"), block.find(f"{DOC}pPr/{DOC}outlineLvl")
            named = re.fullmatch(r"[Hh]eading ?(\d)", style.get(f"{DOC}val", "")) if style is not None else None
            depth = int(outline.get(f"{DOC}val")) + 1 if outline is not None else int(named[1]) if named else None
            out.append(("heading" if depth else "text", depth, said(block), None))
        elif block.tag == f"{DOC}tbl":
            for row in block.iter(f"{DOC}tr"):
                out.append(("table_row", None, "", [said(c).strip() or None for c in row.iter(f"{DOC}tc")]))
    return out


def _pptx(data: bytes) -> list[tuple]:
    z, out = zipfile.ZipFile(io.BytesIO(data)), []
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for k, name in enumerate(slides):
        first = True
        for p in ElementTree.fromstring(z.read(name)).iter(f"{DRAW}p"):
            said = "".join(t.text or "" for t in p.iter(f"{DRAW}t")).strip()
            if said:
                out.append(("heading" if first else "text", 1 if first else k + 1, said, None))
                first = False
    return out


def _xlsx(data: bytes) -> list[tuple]:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
    out = []
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        out.append(("heading", 1, name.rsplit("/", 1)[1][:-4], None))
        for k, row in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{SHEET}row")):
            if k >= MOST_ROWS:
                break
            cells: list = []
            for c in row.iter(f"{SHEET}c"):
                at = 0
                for letter in re.match("[A-Z]+", c.get("r", "A"))[0]:
                    at = at * 26 + ord(letter) - 64
                if at > MOST_COLUMNS:
                    break
                v = c.find(f"{SHEET}v")
                value = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if c.get("t") == "inlineStr" else shared[int(v.text)] if v is not None and c.get("t") == "s" else v.text if v is not None else None
                cells += [None] * (at - 1 - len(cells)) + [value]
            out.append(("table_row", None, "", cells))
    return out


READERS = {"word/document.xml": _docx, "ppt/presentation.xml": _pptx, "xl/workbook.xml": _xlsx}


def _office(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, data in zip(batch["path"], batch["content"], strict=True):
            try:
                names = zipfile.ZipFile(io.BytesIO(data)).namelist()
            except zipfile.BadZipFile:
                continue
            reader = next((READERS[n] for n in names if n in READERS), None)
            rows += [(path, i, *row) for i, row in enumerate(reader(data) if reader else [])]
        yield pd.DataFrame(rows, columns=["path", "ordinal", "kind", "depth", "text", "cells"]).astype({"depth": "Int32"})


def office_lines(files: DataFrame) -> DataFrame:
    """Lines of DOCX, PPTX and XLSX files (path, content) in reading order; a file is read whole by one task."""
    return files.select("path", "content").mapInPandas(_office, LINES)


# How the headers of a roster begin, by field, and those of columns that are somebody else's; letters and digits only.
ROSTER = {
    "email": ["workemail", "emailaddress", "email", "mail", "userprincipalname", "upn", "login"],
    "name": ["fullname", "displayname", "employeename", "name", "firstname", "givenname"],
    "job_title": ["jobtitle", "title", "position", "role", "designation"],
    "department": ["department", "dept", "team", "division", "businessunit", "function"],
}
NOT_THEIRS = ["manager", "supervisor", "approver", "lineman", "reportsto", "alternate"]
HEADER_ROWS = 25
CELLS = "file string, row int, cells array<string>"


def _csv_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, data in zip(frame["path"], frame["content"], strict=True):
            reader = csv.reader(io.StringIO(bytes(data).decode("utf-8-sig", "replace"), newline=""))
            rows, line = [], 1
            for cells in reader:
                rows.append((path, line, [c.strip() for c in cells]))
                line = reader.line_num + 1
            yield pd.DataFrame(rows, columns=["file", "row", "cells"])


def sheet_rows(files: DataFrame) -> DataFrame:
    """(file, row, cells) of CSV and XLSX files (path, content, kind by content); of a workbook the first sheet that has rows.

    A file is read whole by one task, so that its rows keep their numbers.
    """
    texts = files.filter(~F.col("kind").isin("zip", "legacy office")).select("path", "content").mapInPandas(_csv_rows, CELLS)
    books = office_lines(files.filter("kind = 'zip'"))
    sheet = F.max(F.when(F.col("kind") == "heading", F.col("ordinal"))).over(Window.partitionBy("path").orderBy("ordinal"))
    rows = books.withColumn("sheet", sheet).filter("kind = 'table_row'")
    first = rows.groupBy("path").agg(F.min("sheet").alias("sheet"))
    books = rows.join(first, ["path", "sheet"]).select(F.col("path").alias("file"), (F.col("ordinal") - F.col("sheet")).cast("int").alias("row"), F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("cells"))
    return texts.unionByName(books)


def _header(cells: Column) -> Column:
    """Which column each field of ROSTER is, and what that is worth: a header names the first field that is still open and begins it."""
    kind = "struct<" + ",".join(f"{k}:int" for k in ROSTER) + ",score:int>"
    start = F.from_json(F.lit("{\"score\": 0}"), kind)

    def step(s, x):
        begins = lambda starts: F.exists(F.array(*map(F.lit, starts)), lambda p: F.startswith(x["header"], p))
        taken, out = (x["header"] == "") | begins(NOT_THEIRS), {}
        score = s["score"]
        for field, starts in ROSTER.items():
            mine = ~taken & s[field].isNull() & begins(starts)
            out[field] = F.when(mine, x["at"]).otherwise(s[field])
            score = F.when(mine, score + (3 if field == "email" else 1)).otherwise(score)
            taken = taken | mine
        return F.struct(*[out[f].alias(f) for f in ROSTER], score.alias("score"))

    headers = F.transform(cells, lambda c, i: F.struct(F.regexp_replace(F.lower(c), "[^a-z0-9]", "").alias("header"), i.alias("at")))
    return F.aggregate(headers, start, step)


def roster(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People (file, row, email, name, job_title, department) and rejected rows (file, row, reason, value) of sheet_rows().

    The header is the best of a file's first filled rows that names an address column; without one the column with most
    addresses is it. Blank rows don't count; of rows with one address the first stays.
    """
    filled = rows.filter(F.exists("cells", lambda c: c != ""))
    numbered = filled.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("row")))
    head = numbered.filter(F.col("_n") <= HEADER_ROWS).select("file", "_n", _header(F.col("cells")).alias("h")).filter("h.email is not null")
    head = head.groupBy("file").agg(F.min_by(F.struct("_n", "h"), F.struct(-F.col("h.score"), F.col("_n"))).alias("head"))
    mails = numbered.select("file", F.posexplode("cells").alias("at", "c")).filter(text.valid_email(F.col("c"))).groupBy("file", "at").count()
    most = mails.groupBy("file").agg(F.min_by("at", F.struct(-F.col("count"), F.col("at"))).alias("fallback"))
    body = numbered.join(head, "file", "left").join(most, "file", "left").filter(F.col("head").isNull() | (F.col("_n") > F.col("head._n")))
    cell = lambda at: F.trim(F.coalesce(F.get("cells", at), F.lit("")))
    body = body.withColumn("raw", cell(F.coalesce("head.h.email", "fallback"))).withColumn("email", F.lower("raw"))
    good = text.valid_email(F.col("email"))
    earlier = F.row_number().over(Window.partitionBy("file", "email", good).orderBy("row")) > 1
    reason = F.when(F.col("raw") == "", "No email address").when(~good, "Not an email address").when(earlier, "Duplicate of an earlier row")
    marked = body.withColumn("reason", reason)
    local = F.regexp_replace(F.substring_index("raw", "@", 1), "[._-]+", " ")
    field = lambda name: F.coalesce(cell(F.col(f"head.h.{name}")), F.lit(""))
    people = marked.filter("reason is null").select("file", "row", "email", F.when(field("name") == "", local).otherwise(field("name")).alias("name"), field("job_title").alias("job_title"), field("department").alias("department"))
    value = F.when(F.col("raw") == "", F.get(F.filter("cells", lambda c: c != ""), F.lit(0))).otherwise(F.col("raw"))
    return people, marked.filter("reason is not null").select("file", "row", "reason", value.alias("value"))


def json_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON text, for a log sink."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def report(rows: DataFrame, path: str) -> None:
    json_lines(rows).write.mode("overwrite").text(path)


def release_feed(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The lifecycle feed as a small table: product, line, eol, support, lts, released."""
    return spark.createDataFrame(rows, "product string, line string, eol date, support date, lts boolean, released date")


def image_submission(files: DataFrame, least: int = 200) -> DataFrame:
    """PNG files with their width and height from the header, edges of at least so many pixels."""
    edge = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return files.filter(F.col("kind") == "png").select("path", edge(17).alias("width"), edge(21).alias("height")).filter(F.least("width", "height") >= least)


def scaled(width: Column, height: Column, most: int = 2000) -> Column:
    """Size after shrinking the longer edge to most."""
    ratio = F.least(F.lit(1.0), most / F.greatest(width, height))
    return F.struct(F.round(width * ratio).cast("int").alias("width"), F.round(height * ratio).cast("int").alias("height"))
