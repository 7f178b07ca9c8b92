import json

from pyspark.sql import functions as F

from attestry.functions import payload
from attestry.operators import figures

BOXES = "document_id string, page int, left double, top double, right double, bottom double, width double, height double"


def test_regions_merge_and_cut(spark):
    rows = [("d", 1, 0, 0, 200, 200, 600, 800), ("d", 1, 220, 0, 300, 200, 600, 800), ("d", 1, 500, 700, 510, 710, 600, 800), ("d", 2, 0, 0, 600, 800, 600, 800)]
    got = figures.regions(spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in rows], BOXES))
    assert [(r["left"], r["right"]) for r in got.collect()] == [(0.0, 300.0)]
    heads = spark.createDataFrame([("d", 1, 150.0)], "document_id string, page int, y double")
    assert figures.cut_at_heading(got, heads).first()["bottom"] == 150.0


def test_diagrams_and_places(spark):
    shapes = [("d", 1, k, 0.1) for k in ["line"] * 3 + ["box"] * 3] + [("d", 2, "smartart", 0.1), ("d", 2, "picture", 0.6), ("d", 3, "line", 0.1)]
    assert [r["slide"] for r in figures.diagrams(spark.createDataFrame(shapes, "document_id string, slide int, kind string, share double")).collect()] == [1]
    lines = spark.createDataFrame([("d", i, r) for i, r in enumerate(["L1", "T1-1", "T1-2", "L2", "T2-1", "T1-3"])], "document_id string, ordinal int, ref string")
    assert {r["table_ref"]: r["ordinal"] for r in figures.place_tables(lines).collect()} == {"T1": 1, "T2": 4}


def test_payloads(spark):
    df = spark.createDataFrame([(json.dumps([{"t": "a", "n": 1}, {"t": "a", "n": 1}, {"n": 2}, {"t": "b", "n": 3}]),), ("not json",)], "p string")
    got = [tuple(r["x"]) for r in df.select(payload.read_list(F.col("p"), "struct<t:string,n:int>", lambda x: x["t"].isNotNull(), 5).alias("x")).collect()]
    assert [(len(i), s) for i, s in got] == [(2, 2), (0, 0)]
    one = spark.range(1)
    patched = lambda old: json.loads(one.select(payload.patch(F.lit(old), b=F.lit(3), c=F.lit("x")).alias("x")).first()["x"])
    assert patched('{"a": "1", "b": "2"}') == {"a": "1", "b": 3, "c": "x"}
    assert patched('{"n": 1.5, "t": true, "l": [1, {"k": null}], "b": 0}') == {"n": 1.5, "t": True, "l": [1, {"k": None}], "b": 3, "c": "x"}
    assert patched("no json") == patched("[1]") == {"b": 3, "c": "x"}
    assert one.select(payload.without_extract_ids(F.lit("It is open [E1, E2]. See extract 3.")).alias("x")).first()["x"] == "It is open. See the design."
    parts = one.select(payload.rationale_parts(F.lit("Keys are open. Anyone may read. The design must lock them.")).alias("x")).first()["x"]
    assert [p["label"] for p in parts] == ["Gap", "Impact", "Fix"]
