"""Document structure from lines: furniture, fonts, sections, contents, tables, units, windows, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text


def furniture(lines: DataFrame, share: float = 0.6, band: int = 24, least_pages: int = 3) -> DataFrame:
    """(document_id, mask, y_band): lines that, digits aside, stand in one band on share of a document's pages."""
    masked = lines.select("document_id", "page", F.regexp_replace(F.trim("text"), r"[0-9]+", "#").alias("mask"), F.floor(F.col("y") / band).cast("long").alias("y_band"))
    pages = lines.groupBy("document_id").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= least_pages)
    seen = masked.groupBy("document_id", "mask", "y_band").agg(F.count_distinct("page").alias("on"))
    return seen.join(pages, "document_id").filter(F.col("on") >= F.greatest(F.lit(2), F.floor(share * F.col("pages")))).select("document_id", "mask", "y_band")


def without_furniture(lines: DataFrame, **options) -> DataFrame:
    keyed = lines.withColumn("mask", F.regexp_replace(F.trim("text"), r"[0-9]+", "#")).withColumn("y_band", F.floor(F.col("y") / options.get("band", 24)).cast("long"))
    return keyed.join(furniture(lines, **options), ["document_id", "mask", "y_band"], "left_anti").drop("mask", "y_band")


def mode(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most stated value of a key; the least of several."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(key, value).count()
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(value))


def branding(images: DataFrame, share: float = 0.3) -> DataFrame:
    """Images (by digest) on at least share of a deck's slides."""
    slides = images.groupBy("document_id").agg(F.max("slides").alias("slides"))
    on = images.groupBy("document_id", "sha256").agg(F.count_distinct("slide").alias("on"))
    return on.join(slides, "document_id").filter(F.col("on") >= share * F.col("slides")).select("document_id", "sha256")


def font_levels(lines: DataFrame) -> DataFrame:
    """(document_id, font, size, bold, level): heading fonts by size; body is the font of most characters.

    A level is larger than the body, or bold where the body isn't, and sets at most a fifth of the text.
    confident is false where the body sets under a quarter of it.
    """
    mass = lines.groupBy("document_id", "font", "size", "bold").agg(F.sum(F.length("text")).alias("chars"))
    whole = mass.groupBy("document_id").agg(F.sum("chars").alias("all"), F.max_by(F.struct("font", "size", "bold", "chars"), F.struct("chars", "size", "font")).alias("body"))
    rows = mass.join(whole, "document_id").filter((F.col("chars") <= 0.2 * F.col("all")) & ((F.col("size") > F.col("body.size")) | ((F.col("size") == F.col("body.size")) & F.col("bold") & ~F.col("body.bold"))))
    level = F.dense_rank().over(Window.partitionBy("document_id").orderBy(F.desc("size"), F.desc("bold")))
    return rows.withColumn("level", level).withColumn("confident", F.col("body.chars") >= 0.25 * F.col("all")).select("document_id", "font", "size", "bold", "level", "confident")


def in_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """lines (y, x0 and, where known, y1, x1) whose centre lies inside a region (top, bottom, left, right) of their page."""
    middle = lambda a, b: (F.col(a) + (F.coalesce(b, a) if b in lines.columns else F.col(a))) / 2
    met = lines.join(regions.select("document_id", "page", "top", "bottom", "left", "right"), ["document_id", "page"])
    return met.filter(middle("y", "y1").between(F.col("top"), F.col("bottom")) & middle("x0", "x1").between(F.col("left"), F.col("right"))).select(lines.columns)


def headings(lines: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """lines with kind, depth and title where they open a section; a line whose centre lies inside a table region never does."""
    if regions is not None:
        inside = in_regions(lines, regions).select("document_id", "ordinal").distinct()
        lines = lines.join(inside.withColumn("in_table", F.lit(True)), ["document_id", "ordinal"], "left")
    else:
        lines = lines.withColumn("in_table", F.lit(None).cast("boolean"))
    found = F.when(~F.coalesce("in_table", F.lit(False)), text.heading(F.col("text")))
    w = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    out = lines.withColumn("h", found).withColumn("numbered", F.when(F.col("h.kind") == "numbered", F.col("h.depth")))
    # A heading without a number lies one below the last number.
    depth = F.coalesce("h.depth", F.coalesce(F.last("numbered", ignorenulls=True).over(w), F.lit(0)) + 1)
    return out.withColumn("depth", F.when(F.col("h").isNotNull(), depth)).withColumn("title", F.col("h.title")).withColumn("kind", F.col("h.kind")).drop("h", "numbered", "in_table")


def with_path(heads: DataFrame, name: str, deepest: int = 9, between: str = " > ") -> DataFrame:
    """Headings (document_id, ordinal, depth, name) with path: for each level above, the last name there that no shallower heading has closed since."""
    up = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    out = heads
    for d in range(1, deepest + 1):
        last_at = F.max(F.when(F.col("depth") == d, F.col("ordinal"))).over(up)
        said = F.max_by(name, F.when(F.col("depth") == d, F.col("ordinal"))).over(up)
        closed = F.max(F.when(F.col("depth") < d, F.col("ordinal"))).over(up)
        out = out.withColumn(f"_a{d}", F.when((F.col("depth") > d) & (last_at > F.coalesce(closed, F.lit(-1))), said))
    above = [f"_a{d}" for d in range(1, deepest + 1)]
    return out.withColumn("path", F.concat_ws(between, *above, name)).drop(*above)


# Shares, sizes and counts by which a document's own printing tells its headings.
BIGGER, NEARLY, MOST_OF_TEXT, SMALL_SLACK, NUMBERED_LEAST, BOLD_SHARE, LONGEST_HEADING = 0.4, 0.1, 0.20, 1.5, 5, 0.9, 160
DEEP_NUMBERED = r"^\d+(?:\.\d+){2,}\.?\s+[A-Z(]"


def printing(lines: DataFrame) -> DataFrame:
    """(document_id, body (size, bold), levels): the signature that sets most text, and the (size, bold) of heading signatures.

    A heading is larger than the body, or bold about its size where the body isn't, and sets a fifth of the text at most.
    """
    sig = ["font", "size", "bold", "italic", "color"]
    mass = lines.groupBy("document_id", *sig).agg(F.sum(F.length("text")).alias("chars"), F.min("ordinal").alias("first"))
    whole = mass.groupBy("document_id").agg(F.sum("chars").alias("all"), F.max_by(F.struct("size", "bold"), F.struct("chars", -F.col("first"))).alias("body"))
    larger = F.col("size") > F.col("body.size") + BIGGER
    stressed = (F.col("size") >= F.col("body.size") - NEARLY) & F.col("bold") & ~F.col("body.bold")
    heads = F.collect_set(F.when((larger | stressed) & (F.col("chars") <= MOST_OF_TEXT * F.col("all")), F.struct("size", "bold")))
    return mass.join(whole, "document_id").groupBy("document_id", "body").agg(heads.alias("levels"))


def printed_headings(lines: DataFrame, contents: DataFrame | None = None, tables: DataFrame | None = None, figures: DataFrame | None = None) -> DataFrame:
    """lines with number, title and depth where they open a section, by how the whole document prints its headings.

    contents: pages (document_id, page) that open none; tables, figures: regions as in in_regions(): in a table no line opens
    a section, in a figure no unnumbered one. A bold line with a deep number may be a little smaller than the body. Where a
    document sets its numbered headings in bold, a line that isn't bold is no heading without a number. An unnumbered heading
    lies one below the last number.
    """
    mark = lambda regions: in_regions(lines, regions).select("document_id", "ordinal").distinct().withColumn("_in", F.lit(True))
    rows = lines.join(printing(lines), "document_id")
    for name, regions in (("_table", tables), ("_figure", figures)):
        rows = rows.withColumn(name, F.lit(False)) if regions is None else rows.join(mark(regions).withColumnRenamed("_in", name), ["document_id", "ordinal"], "left").na.fill(False, [name])
    if contents is not None:
        rows = rows.join(contents.select("document_id", "page").distinct().withColumn("_skip", F.lit(True)), ["document_id", "page"], "left").na.fill(False, ["_skip"])
    else:
        rows = rows.withColumn("_skip", F.lit(False))
    said = F.trim("text")
    level = F.array_contains("levels", F.struct("size", "bold"))
    small = F.col("bold") & ~F.col("body.bold") & (F.col("size") >= F.col("body.size") - SMALL_SLACK) & said.rlike(DEEP_NUMBERED)
    open_ = (level | small) & ~F.col("_skip") & ~F.col("_table") & (F.length(said) <= LONGEST_HEADING) & ~said.rlike(text.CLAUSE_LABEL)
    number, appendix = F.regexp_extract(said, text.NUMBERED, 1), F.initcap(F.regexp_extract(said, text.APPENDIX, 1))
    make = lambda n, title: F.struct(n.alias("number"), title.alias("title"))
    found = (
        F.when(number != "", make(number, F.trim(F.regexp_extract(said, text.NUMBERED, 2))))
        .when(appendix != "", make(appendix, F.coalesce(F.nullif(F.trim(F.regexp_extract(said, text.APPENDIX, 2)), F.lit("")), appendix)))
        .when(said.rlike(text.TITLE_LIKE) & ~F.col("_figure"), make(F.lit(None).cast("string"), said))
    )
    rows = rows.withColumn("h", F.when(open_, found))
    digit = F.coalesce(F.col("h.number").rlike("^[0-9]"), F.lit(False))
    of = Window.partitionBy("document_id")
    n, bold = F.count_if(digit).over(of), F.count_if(digit & F.col("bold")).over(of)
    rows = rows.withColumn("_bold", (n >= NUMBERED_LEAST) & (bold >= BOLD_SHARE * n))
    rows = rows.withColumn("h", F.when(~(F.col("h.number").isNull() & F.col("_bold") & ~F.col("bold")), F.col("h")))
    anchor = F.when(digit, F.size(F.split("h.number", r"\."))).when(F.col("h.number").isNotNull(), 1)
    before = F.last(anchor, ignorenulls=True).over(of.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    depth = F.when(F.col("h").isNotNull(), F.coalesce(anchor, before + 1, F.lit(1)))
    return rows.withColumns({"number": F.col("h.number"), "title": F.col("h.title"), "depth": depth}).select(*lines.columns, "number", "title", "depth")


def printed_sections(lines: DataFrame, titles: DataFrame, **regions: DataFrame) -> DataFrame:
    """(document_id, section, number, title, depth, path, page_start, page_end, y_start, text) of lines with their printing.

    titles: document_id, document_title, which begins each path; a document without headings is one section of that title.
    regions: contents, tables, figures as printed_headings() takes them; contents pages' lines are left out.
    """
    rows = printed_headings(lines, **regions)
    if "contents" in regions:
        rows = rows.join(regions["contents"].select("document_id", "page").distinct(), ["document_id", "page"], "left_anti")
    w = Window.partitionBy("document_id").orderBy("ordinal")
    rows = rows.withColumn("section", F.count("title").over(w)).withColumn("_any", F.count("title").over(Window.partitionBy("document_id")) > 0)
    name = F.when(F.col("number").isNotNull(), F.concat_ws(" ", "number", "title")).otherwise(F.col("title"))
    heads = with_path(rows.filter("title is not null").withColumn("name", name), "name", between=" › ")
    heads = heads.select("document_id", "section", "number", "title", "depth", F.col("path").alias("_path"), F.col("page").alias("page_start"), F.col("y").alias("y_start"))
    body = rows.filter("title is null and (section > 0 or not _any)").filter(F.trim("text") != "")
    said = body.groupBy("document_id", "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"), F.min("page").alias("_first"), F.max("page").alias("_last"),
    )
    out = heads.join(said, ["document_id", "section"], "full").join(titles.select("document_id", "document_title"), "document_id")
    path = F.concat_ws(" › ", "document_title", "_path")
    return out.select(
        "document_id", F.greatest("section", F.lit(1)).alias("section"), "number", F.coalesce("title", "document_title").alias("title"), F.coalesce("depth", F.lit(1)).alias("depth"), path.alias("path"),
        F.coalesce("page_start", "_first").alias("page_start"), F.greatest("page_start", "_last").alias("page_end"), F.coalesce("y_start", F.lit(0.0)).alias("y_start"), F.coalesce("text", F.lit("")).alias("text"),
    )


def sections(lines: DataFrame, regions: DataFrame | None = None, deepest: int = 9) -> DataFrame:
    """(document_id, section, depth, title, path, first, last, is_parent): the section tree of lines in order.

    A heading's path holds, for each level above it, the last title there that no shallower heading has closed since.
    """
    h = headings(lines, regions)
    w = Window.partitionBy("document_id").orderBy("ordinal")
    h = h.withColumn("section", F.sum(F.col("title").isNotNull().cast("int")).over(w))
    heads = with_path(h.filter(F.col("title").isNotNull()), "title", deepest)
    heads = heads.withColumn("is_parent", F.coalesce(F.lead("depth").over(w) > F.col("depth"), F.lit(False)))
    span = h.groupBy("document_id", "section").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    return span.join(heads.select("document_id", "section", "depth", "title", "path", "is_parent"), ["document_id", "section"], "left")


def profile(lines: DataFrame) -> DataFrame:
    """Kind of a document by its "Statement:" lines: none, one or two, three or more."""
    n = lines.groupBy("document_id").agg(F.count_if(F.col("text").rlike(r"^\s*Statement:")).alias("n"))
    return n.select("document_id", F.when(F.col("n") >= 3, "prose-clause").when(F.col("n") >= 1, "mixed").otherwise("table-principle").alias("profile"))


def as_of(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows with the value of the last mark at or before them; marks before the first row of a key serve none."""
    both = rows.withColumn("_row", F.lit(1)).withColumn(value, F.lit(None).cast(marks.schema[value].dataType)).unionByName(
        marks.select(key, at, value).withColumn("_row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_row = 1").drop("_row")


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, less: DataFrame | None = None) -> DataFrame:
    """points inside the inclusive ranges (key, from_at, to_at, label): ranges are spread over whole numbers and met by equality.

    less: points (key, at) that belong to something stronger, such as a rule's own lines, and take no label.
    """
    spread = ranges.select(key, "label", F.explode(F.sequence("from_at", "to_at")).alias(at))
    out = points.join(spread, [key, at])
    return out if less is None else out.join(less.select(key, at).distinct(), [key, at], "left_anti")


def islands(rows: DataFrame, key: str, at: str | list[str], breaks: Column) -> DataFrame:
    """rows with island: the number of breaks up to each, in order; rows that tie are in one place."""
    return rows.withColumn("island", F.sum(breaks.cast("int")).over(Window.partitionBy(key).orderBy(*([at] if isinstance(at, str) else at))))


def passages(lines: DataFrame) -> DataFrame:
    """Consecutive ordinals joined; a bullet or a table row stands alone."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    alone = lambda c: c.isin("bullet", "table_row")
    gap = (F.col("ordinal") != F.lag("ordinal").over(w) + 1) | alone(F.col("kind")) | alone(F.lag("kind").over(w))
    cut = lines.withColumn("gap", F.coalesce(gap, F.lit(True)))
    rows = islands(cut, "document_id", "ordinal", F.col("gap"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return rows.groupBy("document_id", "island").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def windows(lines: DataFrame, size: int = 120, overlap: int = 15) -> DataFrame:
    """(window, depth) of every line for each overlapping window that holds it; depth is the distance to the nearer edge."""
    stride = size - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("ordinal") - size + 1) / stride)).cast("int")
    rows = lines.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("ordinal") / stride).cast("int"))))
    at = F.col("ordinal") - F.col("window") * stride
    return rows.withColumn("depth", F.least(at, size - 1 - at))


def fuse_windows(views: DataFrame) -> DataFrame:
    """Of a line's roles in several windows the one seen deepest, and whether they differ."""
    return views.groupBy("document_id", "ordinal").agg(F.max_by("role", F.struct("depth", "window")).alias("role"), (F.count_distinct("role") > 1).alias("disputed"))


def parts(lines: DataFrame, most: int = 800) -> DataFrame:
    """part: lines in runs of about most, a run beginning at a heading where its block holds one, never inside a table."""
    block = F.floor((F.row_number().over(Window.partitionBy("document_id").orderBy("ordinal")) - 1) / most)
    rows = lines.withColumn("block", block)
    start = rows.filter(F.col("kind") != "table_row").groupBy("document_id", "block").agg(F.coalesce(F.min(F.when(F.col("kind") == "heading", F.col("ordinal"))), F.min("ordinal")).alias("start"))
    marked = lines.join(start.select("document_id", F.col("start").alias("ordinal"), F.lit(1).alias("opens")), ["document_id", "ordinal"], "left")
    return islands(marked, "document_id", "ordinal", F.col("opens").isNotNull()).withColumnRenamed("island", "part").drop("opens")


def contents_check(entries: DataFrame, found: DataFrame, prefix: int = 40) -> DataFrame:
    """Contents entries (title, page) against sections (title, page): matched, drifted (over a page), missing, unexpected."""
    norm = lambda df, c: df.withColumn("key", text.normalise(F.col("title"))).withColumn("short", F.substring("key", 1, prefix)).withColumnRenamed("title", f"{c}_title").withColumnRenamed("page", f"{c}_page")
    e, s = norm(entries, "toc"), norm(found, "section")
    exact = e.join(s.drop("short"), ["document_id", "key"])
    rest = e.join(exact.select("document_id", "key").distinct(), ["document_id", "key"], "left_anti").join(s.drop("key"), ["document_id", "short"])
    near = exact.select("document_id", "toc_title", "toc_page", "section_title", "section_page").unionByName(rest.select("document_id", "toc_title", "toc_page", "section_title", "section_page"))
    best = near.groupBy("document_id", "toc_title", "toc_page").agg(F.min_by(F.struct("section_title", "section_page"), F.struct(F.abs(F.col("section_page") - F.col("toc_page")), "section_page")).alias("s"))
    drift = F.abs(F.col("s.section_page") - F.col("toc_page"))
    rows = best.select("document_id", F.col("toc_title").alias("title"), F.when(drift > 1, "drifted").otherwise("matched").alias("state"), F.col("s.section_title").alias("section_title"))
    missing = e.join(best.select("document_id", "toc_title", "toc_page"), ["document_id", "toc_title", "toc_page"], "left_anti").select("document_id", F.col("toc_title").alias("title"), F.lit("missing").alias("state"), F.lit(None).cast("string").alias("section_title"))
    extra = s.join(rows.select("document_id", "section_title"), ["document_id", "section_title"], "left_anti").select("document_id", F.col("section_title").alias("title"), F.lit("unexpected").alias("state"), "section_title")
    return rows.unionByName(missing).unionByName(extra)


def contents_pages(lines: DataFrame, least: int = 5) -> DataFrame:
    """(document_id, page): pages with least contents lines, title and page with a leader between, or more."""
    return lines.filter(text.toc_entry(F.col("text")).isNotNull()).groupBy("document_id", "page").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("document_id", "page")


def contents_coverage(checked: DataFrame) -> DataFrame:
    """The share of a document's contents entries that contents_check() found among its sections."""
    entries = checked.filter("state <> 'unexpected'").groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") != "missing").alias("found"))
    return entries.select("document_id", (F.col("found") / F.col("n")).alias("coverage"))


def stitch_tables(tables: DataFrame, top: int = 160, bottom: int = 160) -> DataFrame:
    """group: a table that opens a page under the same headers as one that closes the page before goes on with it."""
    w = Window.partitionBy("document_id").orderBy("page", "top")
    prev = lambda c: F.lag(c).over(w)
    goes_on = (F.col("page") == prev("page") + 1) & (F.col("top") <= top) & (prev("bottom") >= prev("page_height") - bottom) & ((F.col("headers") == prev("headers")) | (F.size("headers") == F.size(prev("headers"))) & ~F.coalesce(F.col("has_header"), F.lit(True)))
    return islands(tables.withColumn("opens", ~F.coalesce(goes_on, F.lit(False))), "document_id", ["page", "top"], F.col("opens")).withColumnRenamed("island", "group")


def table_confidence(cells: DataFrame) -> DataFrame:
    """0.35 of the share of filled cells and 0.65 of the share of named columns, by table."""
    own = cells.groupBy("table_id").agg(F.avg(F.when(F.trim("value") != "", 1.0).otherwise(0.0)).alias("density"), F.count_distinct(F.when(F.trim("column") != "", F.col("column"))).alias("named"), F.count_distinct("at").alias("columns"))
    return own.select("table_id", F.round(0.35 * F.col("density") + 0.65 * F.col("named") / F.col("columns"), 3).alias("confidence"))


def sheet_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of a sheet's rows (sheet, row, cells) between blank rows, and whether each is a table: two by two, a header at least half filled."""
    filled = F.size(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    marked = islands(rows.withColumn("filled", filled).withColumn("blank", F.col("filled") == 0), "sheet", "row", F.col("blank")).filter("not blank")
    out = marked.groupBy("sheet", "island").agg(F.min("row").alias("first"), F.count("*").alias("n_rows"), F.max("filled").alias("width"), F.min_by("filled", "row").alias("header"))
    return out.withColumn("is_table", (F.col("n_rows") >= 2) & (F.col("width") >= 2) & (F.col("header") >= F.greatest(F.lit(2), F.ceil(F.col("width") / 2))))


def sentences(prose: DataFrame) -> DataFrame:
    """(key, at, sentence) of prose, bullets as sentences of their own."""
    return prose.select("key", F.posexplode(F.split("text", r"(?<=[.!?])\s+(?=\p{Lu})|\n\s*[-•*]\s+")).alias("at", "sentence")).filter(F.trim("sentence") != "")


def clauses(blocks: DataFrame) -> DataFrame:
    """statement, rationale and requirements of text blocks (key, text): labelled parts, else normative sentences, first as statement, at most eight more."""
    said = F.filter(F.split("text", r"(?<=[.!?])\s+"), text.normative)
    label = lambda name: F.nullif(text.labelled_part(F.col("text"), name), F.lit(""))
    bullets = F.filter(F.transform(F.split(label("Requirements"), r"\n\s*[-•*]?\s*|;\s+"), lambda x: F.trim(x)), lambda x: x != "")
    labelled = label("Statement").isNotNull()
    rows = blocks.withColumn("said", said).withColumn("statement", F.coalesce(label("Statement"), F.get("said", F.lit(0)))).filter(F.col("statement").isNotNull())
    return rows.select("key", "statement", label("Rationale").alias("rationale"), F.when(labelled, bullets).otherwise(F.slice("said", 2, 8)).alias("requirements"), F.when(labelled, "labelled").otherwise("prose").alias("how"))


def chunks(sections_: DataFrame, clauses_: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Search units of a document in order: clauses whole, table rows and tables, figures not rejected, prose long enough.

    sections_: document_id, section, path, prose, kind; clauses_: section, ordinal, text; tables: section, ordinal, headers, rows
    (array of arrays); figures: section, ordinal, state, description, correction.
    """
    key = ["document_id", "section"]
    own = clauses_.groupBy(*key).agg(F.count("*").alias("n"))
    base = sections_.join(own, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = lambda df, kind, band, body, *sub: df.select(*key, F.lit(kind).alias("source_kind"), F.lit(band).alias("band"), F.col("ordinal").alias("sub"), (sub[0] if sub else F.lit(0)).alias("sub2"), body.alias("body"))
    parts_ = row(clauses_, "clause", 0, F.col("text"))
    spread = tables.select("*", F.posexplode("rows").alias("at", "cells"))
    parts_ = parts_.unionByName(row(spread, "table_row", 1, text.render_row(F.col("headers"), F.col("cells")), F.col("at") + 1))
    parts_ = parts_.unionByName(row(tables, "table", 1, F.array_join(F.transform("rows", lambda r: text.render_row(F.col("headers"), r)), "\n")))
    parts_ = parts_.unionByName(row(figures.filter("state <> 'rejected'"), "figure", 2, F.coalesce("correction", "description")))
    least = F.when(F.col("n") > 0, 320).when(F.col("kind").isin("slides", "sheet"), 1).otherwise(60)
    prose = base.filter(F.length(F.trim("prose")) >= least).select(*key, F.lit("section").alias("source_kind"), F.lit(3).alias("band"), F.lit(0).alias("sub"), F.lit(0).alias("sub2"), F.substring("prose", 1, 8000).alias("body"))
    out = parts_.unionByName(prose).join(base.select(*key, "path"), key)
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("section", "band", "sub", "sub2"))
    return out.withColumn("ordinal", place).withColumn("text", F.concat_ws("\n", "path", "body")).select("document_id", "section", "ordinal", "source_kind", "text")


def quality_issues(sections_: DataFrame, clause_counts: DataFrame) -> DataFrame:
    """(document_id, kind, severity): no clauses, few clauses (over eight sections a clause, ten or more), empty sections."""
    n = sections_.groupBy("document_id").agg(F.count("*").alias("sections"))
    both = n.join(clause_counts, "document_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    none = both.filter("n = 0").select("document_id", F.lit("no_clauses").alias("kind"), F.lit("high").alias("severity"))
    few = both.filter("n > 0 and sections >= 10 and sections > 8 * n").select("document_id", F.lit("few_clauses").alias("kind"), F.lit("medium").alias("severity"))
    empty = sections_.filter(~F.col("is_parent") & (F.col("items") == 0) & ~text.substantive(F.coalesce("prose", F.lit("")))).select("document_id", F.lit("section_empty").alias("kind"), F.lit("low").alias("severity"))
    return none.unionByName(few).unionByName(empty)


def lost_share(read: DataFrame, indexed: DataFrame) -> DataFrame:
    """Characters of lines that no chunk covers, as a share; a tenth is high."""
    gone = read.join(indexed, ["document_id", "ordinal"], "left_anti").groupBy("document_id").agg(F.sum(F.length("text")).alias("lost"))
    whole = read.groupBy("document_id").agg(F.sum(F.length("text")).alias("all"))
    share = F.coalesce(F.col("lost") / F.col("all"), F.lit(0.0))
    return whole.join(gone, "document_id", "left").select("document_id", share.alias("share"), F.when(share >= 0.1, "high").otherwise("low").alias("severity"))


def captions(figures: DataFrame, blocks: DataFrame, reach: int = 46, bonus: int = 30) -> DataFrame:
    """The nearest text within reach above or below a figure, columns overlapping; one that opens on Figure counts as nearer."""
    gap = F.when(F.col("b_top") >= F.col("bottom"), F.col("b_top") - F.col("bottom")).when(F.col("b_bottom") <= F.col("top"), F.col("top") - F.col("b_bottom"))
    met = figures.join(blocks, ["document_id", "page"]).withColumn("gap", gap).filter((F.col("gap") <= reach) & (F.col("b_left") < F.col("right")) & (F.col("b_right") > F.col("left")))
    score = F.col("gap") - F.when(F.col("text").rlike(r"(?i)^\s*figure\b"), bonus).otherwise(0)
    return met.groupBy("document_id", "figure_id").agg(F.min_by("text", F.struct(score, "text")).alias("caption"))


PLACEHOLDER = r"^(?:column|col)[ _]?[0-9]*$"


def shape_tables(grids: DataFrame, header_rows: int = 3, header_chars: int = 40) -> DataFrame:
    """(table_id, columns, rows) of raw grids (table_id, row, cells): named columns and filled rows, for grids that are tables.

    Cells are null where a merged neighbour covers them and empty where they are blank. Row 0 is the header. Up to header_rows
    rows whose columns no later row fills go on with the header; neighbouring columns that a merged cell split are one; names
    are made unique; two columns must hold values, and some row must fill two. A table's rows are shaped together, in one row.
    """
    rows = F.array_sort(F.collect_list(F.struct("row", "cells")))
    g = grids.groupBy("table_id").agg(F.transform(rows, lambda r: r["cells"]).alias("raw"))
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    filled = lambda row: F.exists(row, lambda c: clean(c) != "")
    name = lambda c, i: F.when(clean(c) == "", F.concat(F.lit("column "), (i + 1).cast("string"))).otherwise(clean(c))
    g = g.withColumn("names", F.transform(F.get("raw", F.lit(0)), name)).withColumn("width", F.size("names"))
    at = lambda row: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.get(row, i))
    g = g.filter("width > 0").withColumn("body", F.filter(F.transform(F.slice("raw", F.lit(2), F.size("raw")), at), filled)).filter(F.size("body") > 0)
    # The longest block of first rows that share no column with the rows below is the rest of the header.
    holds = lambda block, i: F.exists(block, lambda r: clean(F.get(r, i)) != "")
    columns = F.sequence(F.lit(0), F.col("width") - 1)

    def continues(k):
        top, rest = F.slice("body", F.lit(1), k), F.slice("body", k + 1, F.size("body"))
        short = F.forall(top, lambda r: F.forall(r, lambda c: F.length(clean(c)) <= header_chars))
        return (k < F.size("body")) & short & ~F.exists(columns, lambda i: holds(top, i) & holds(rest, i))

    g = g.withColumn("k", F.array_max(F.filter(F.sequence(F.lit(0), F.lit(header_rows)), lambda k: (k == 0) | continues(k))))
    said = lambda i: F.array_join(F.filter(F.transform(F.slice("body", F.lit(1), F.col("k")), lambda r: clean(F.get(r, i))), lambda c: c != ""), " ")
    joined = lambda n, i: F.when(said(i) == "", n).when(n.rlike(PLACEHOLDER), said(i)).otherwise(F.concat(n, F.lit(" "), said(i)))
    g = g.withColumn("names", F.transform("names", joined)).withColumn("body", F.slice("body", F.col("k") + 1, F.size("body")))
    # Columns as (name, cells), folded from the left.
    cols = F.transform(columns, lambda i: F.struct(F.get("names", i).alias("name"), F.transform("body", lambda r: F.get(r, i)).alias("cells")))

    def fold(kept, c):
        last = F.element_at(kept, -1)
        real = lambda x: ~x["name"].rlike(PLACEHOLDER)
        has = lambda x: F.exists(x["cells"], lambda v: clean(v) != "")
        pairs = F.arrays_zip(last["cells"].alias("x"), c["cells"].alias("y"))
        both = lambda p: (clean(p["x"]) != "") & (clean(p["y"]) != "")
        repeats = F.exists(pairs, lambda p: both(p) & (clean(p["x"]) == clean(p["y"]))) & ~F.exists(pairs, lambda p: both(p) & (clean(p["x"]) != clean(p["y"])))
        covered = lambda x: ~real(x) | F.forall(x["cells"], lambda v: v.isNull())
        may = ~(real(last) & real(c)) & F.when(has(last) & has(c), repeats).when(~has(last), covered(last)).otherwise(covered(c))
        cell = lambda p: F.when(clean(p["x"]) != "", p["x"]).when(clean(p["y"]) != "", p["y"]).when(p["x"].isNull() & p["y"].isNull(), None).otherwise("")
        one = F.struct(F.when(real(last), last["name"]).otherwise(c["name"]).alias("name"), F.transform(pairs, cell).alias("cells"))
        return F.when(F.size(kept) == 0, F.array(c)).when(may, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(one))).otherwise(F.concat(kept, F.array(c)))

    g = g.withColumn("cols", cols).withColumn("cols", F.aggregate("cols", F.filter("cols", lambda _: F.lit(False)), fold))
    g = g.withColumn("columns", text.unique_headers(F.transform("cols", lambda c: c["name"]))).withColumn("n", F.size("body"))
    g = g.withColumn("rows", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda r: F.transform("cols", lambda c: F.nullif(clean(F.get(c["cells"], r)), F.lit("")))))
    values = lambda row: F.size(F.filter(row, lambda v: v.isNotNull()))
    wide = F.size(F.filter("cols", lambda c: F.exists(c["cells"], lambda v: clean(v) != ""))) >= 2
    return g.filter(wide & F.exists("rows", lambda r: values(r) >= 2)).select("table_id", "columns", "rows")


def pages_in_order(lines: DataFrame, printed: DataFrame, least: int = 12) -> DataFrame:
    """page of each line (document_id, ordinal, text) of a document whose printed lines (document_id, page, text) are known.

    A line of least characters goes to the first page from the last one found that prints it, or prints a long enough beginning
    of it, or what it begins. Pages never fall, so a document's candidates are folded in order; lines without any stay on the page before.
    """
    flat = lambda c: text.normalise(F.col(c))
    said = lines.select("document_id", "ordinal", flat("text").alias("wanted")).withColumn("key", F.left("wanted", F.lit(least))).filter(F.length("wanted") >= least)
    shown = printed.select("document_id", "page", flat("text").alias("line")).withColumn("key", F.left("line", F.lit(least))).filter(F.length("line") >= least).distinct()
    met = said.join(shown, ["document_id", "key"]).filter(F.startswith("line", F.col("wanted")) | F.startswith("wanted", F.col("line")))
    found = met.groupBy("document_id", "ordinal").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    lists = found.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "pages"))).alias("c"))

    def step(acc, x):
        page = F.get(F.filter(x["pages"], lambda p: p >= acc["page"]), F.lit(0))
        hit = F.struct(x["ordinal"].cast("long").alias("ordinal"), page.cast("long").alias("page"))
        return F.when(page.isNull(), acc).otherwise(F.struct(page.cast("long").alias("page"), F.concat(acc["hits"], F.array(hit)).alias("hits")))

    start = F.struct(F.lit(1).cast("long").alias("page"), F.expr("cast(array() as array<struct<ordinal:bigint,page:bigint>>)").alias("hits"))
    hits = lists.select("document_id", F.explode(F.aggregate("c", start, step, lambda a: a["hits"])).alias("h")).select("document_id", "h.ordinal", "h.page")
    w = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.join(hits, ["document_id", "ordinal"], "left")
    return out.withColumn("page", F.coalesce(F.last("page", ignorenulls=True).over(w), F.lit(1)))


def outline_sections(lines: DataFrame) -> DataFrame:
    """(document_id, section, first, last, depth, title) from lines (document_id, ordinal, text, depth) whose depth an outline declares; a document without any is one section."""
    marked = islands(lines.withColumn("_opens", F.col("depth").isNotNull()), "document_id", "ordinal", F.col("_opens"))
    out = marked.groupBy("document_id", F.col("island").alias("section")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.min_by("depth", "ordinal").alias("depth"), F.min_by("text", "ordinal").alias("_title"))
    headed = F.max(F.col("section") > 0).over(Window.partitionBy("document_id"))
    out = out.withColumn("_headed", headed).withColumn("title", F.when(F.col("section") > 0, F.col("_title")).otherwise(F.when(F.col("_headed"), "Front matter").otherwise("Document")))
    return out.withColumn("depth", F.coalesce("depth", F.lit(1))).select("document_id", "section", "first", "last", "depth", "title")


def section_content(sections: DataFrame, lines: DataFrame, clauses_: DataFrame, tables: DataFrame) -> DataFrame:
    """Each section (document_id, section, first, last) with its lines, live clauses (not superseded) and tables, in order."""
    n = F.posexplode(F.sequence("first", "last")).alias("_at", "ordinal")
    own = sections.select("document_id", "section", n).join(lines, ["document_id", "ordinal"])
    part = lambda rows, name, *c: rows.groupBy("document_id", "section").agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    out = sections.join(part(own, "lines", "ordinal", "text"), ["document_id", "section"], "left")
    out = out.join(part(clauses_.filter("superseded_by_id is null"), "clauses", "ordinal", "clause_id", "statement"), ["document_id", "section"], "left")
    return out.join(part(tables, "tables", "ordinal", "table_id"), ["document_id", "section"], "left")
