"""Figures on pages and slides: regions, cuts at headings, diagrams, placed tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A region's share of its page, and how near boxes are one region.
LEAST_AREA, MOST_AREA, GAP = 0.035, 0.92, 26.0
REGIONS = "document_id string, page int, left double, top double, right double, bottom double"


def _merge(boxes: pd.DataFrame) -> pd.DataFrame:
    """Boxes of one page that come within the gap of each other, joined until none do."""
    left = [list(b) for b in boxes[["left", "top", "right", "bottom"]].itertuples(index=False)]
    done: list[list[float]] = []
    while left:
        box = left.pop()
        while True:
            near = [o for o in left if o[0] <= box[2] + GAP and o[2] >= box[0] - GAP and o[1] <= box[3] + GAP and o[3] >= box[1] - GAP]
            if not near:
                break
            for o in near:
                left.remove(o)
                box = [min(box[0], o[0]), min(box[1], o[1]), max(box[2], o[2]), max(box[3], o[3])]
        grown = [o for o in done if o[0] <= box[2] + GAP and o[2] >= box[0] - GAP and o[1] <= box[3] + GAP and o[3] >= box[1] - GAP]
        if grown:  # the box has grown over an earlier one: put both back
            done = [o for o in done if o not in grown]
            left += [*grown, box]
        else:
            done.append(box)
    whole = float(boxes["width"].iloc[0] * boxes["height"].iloc[0])
    kept = [b for b in done if LEAST_AREA <= (b[2] - b[0]) * (b[3] - b[1]) / whole <= MOST_AREA]
    out = pd.DataFrame(sorted(kept, key=lambda b: (b[1], b[0])), columns=["left", "top", "right", "bottom"]).astype("float64")
    out.insert(0, "page", boxes["page"].iloc[0])
    out.insert(0, "document_id", boxes["document_id"].iloc[0])
    return out


def regions(boxes: DataFrame) -> DataFrame:
    """Figure regions of pages from drawing boxes (document_id, page, left, top, right, bottom, width, height); a group is a page."""
    return boxes.groupBy("document_id", "page").applyInPandas(_merge, REGIONS)


def cut_at_heading(figures: DataFrame, headings: DataFrame) -> DataFrame:
    """A region ends at the first numbered heading below its top."""
    below = figures.join(headings.select("document_id", "page", F.col("y").alias("_y")), ["document_id", "page"]).filter((F.col("_y") > F.col("top")) & (F.col("_y") < F.col("bottom")))
    first = below.groupBy("document_id", "page", "left", "top").agg(F.min("_y").alias("_cut"))
    return figures.join(first, ["document_id", "page", "left", "top"], "left").withColumn("bottom", F.coalesce("_cut", "bottom")).drop("_cut")


def diagrams(shapes: DataFrame) -> DataFrame:
    """Slides that are diagrams: smart art, or three lines and three boxes, unless a picture covers half the slide."""
    n = shapes.groupBy("document_id", "slide").agg(
        F.bool_or(F.col("kind") == "smartart").alias("art"), F.count_if(F.col("kind") == "line").alias("lines"), F.count_if(F.col("kind") == "box").alias("boxes"),
        F.max(F.when(F.col("kind") == "picture", F.col("share")).otherwise(0.0)).alias("picture"),
    )
    return n.filter((F.col("art") | ((F.col("lines") >= 3) & (F.col("boxes") >= 3))) & (F.col("picture") < 0.5)).select("document_id", "slide")


def place_tables(lines: DataFrame) -> DataFrame:
    """(document_id, table_ref, ordinal): where a table stands among lines by its T<n>- references; its first run only."""
    ref = F.nullif(F.regexp_extract("ref", r"^(T\d+)-", 1), F.lit(""))
    w = Window.partitionBy("document_id").orderBy("ordinal")
    rows = lines.withColumn("table_ref", ref)
    starts = rows.withColumn("opens", F.col("table_ref").isNotNull() & ~F.col("table_ref").eqNullSafe(F.lag("table_ref").over(w)))
    return starts.filter("opens").groupBy("document_id", "table_ref").agg(F.min("ordinal").alias("ordinal"))


def deck_headings(lines: DataFrame) -> DataFrame:
    """On a deck the first line of a page without a heading becomes one."""
    has = lines.groupBy("document_id", "page").agg(F.min("ordinal").alias("_first"), F.bool_or(F.col("kind") == "heading").alias("_has"))
    out = lines.join(has, ["document_id", "page"])
    return out.withColumn("kind", F.when(~F.col("_has") & (F.col("ordinal") == F.col("_first")), "heading").otherwise(F.col("kind"))).drop("_first", "_has")
