import json
import zipfile

from pyspark.sql import functions as F

from attestry.functions import providers
from attestry.sources import files
from attestry.streaming import events


def test_windows_over_a_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = events.tumbling(events.with_time(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), late="1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    batch = events.tumbling(events.with_time(spark.read.parquet(f"{sf_dir}/events.parquet")))
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 1000
    assert spark.table("counts").count() == batch.count()


def test_queue_state(spark, tmp_path):
    a, b = "worker a", "worker b"
    rows = [
        ("d", 1.0, "enqueue", ""), ("d", 2.0, "enqueue", ""), ("d", 3.0, "claim", a), ("d", 4.0, "fail", a), ("d", 5.0, "claim", b), ("d", 6.0, "claim", b), ("d", 7.0, "fail", a), ("d", 8.0, "fail", b),
        ("e", 1.0, "enqueue", ""), ("e", 2.0, "claim", a), ("e", 3.0, "heartbeat", b), ("e", 4.0, "complete", b), ("e", 5.0, "complete", a), ("f", 1.0, "enqueue", ""), ("f", 2.0, "claim", a), ("f", 3.0, "fail", a),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"document_id": d, "stage": "parse", "at": t, "action": x, "owner": o, "lease_s": 600.0, "max_attempts": 2}) for d, t, x, o in rows))
    stream = spark.readStream.schema("document_id string, stage string, at double, action string, owner string, lease_s double, max_attempts int").json(str(tmp_path / "in"))
    q = events.queue(stream).writeStream.outputMode("update").format("memory").queryName("jobs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    # d: its second claim came before its time at 5, and stood at 6; another worker's failure doesn't count.
    assert {r["document_id"]: (r["state"], r["attempts"], r["run_after"]) for r in spark.table("jobs").collect()} == {"d": ("dead", 2, 12.0), "e": ("done", 1, 1.0), "f": ("queued", 1, 5.0)}
    assert [r["stage"] for r in events.chained(spark.table("jobs").filter("state = 'done'")).collect()] == ["chunk"]


def test_claim_order_over_hours(spark):
    rows = [(f"j{i:02}", "parse" if i % 3 else "embed", f"2024-01-01 0{i // 5}:{59 - i:02}:00") for i in range(20)]
    jobs = spark.createDataFrame(rows, "id string, stage string, created_at string").select("*", F.col("created_at").cast("timestamp").alias("c")).drop("created_at").withColumnRenamed("c", "created_at")
    jobs = jobs.select("*", F.lit("queued").alias("state"), F.lit("2024-01-01").cast("timestamp").alias("run_after"), F.lit(None).cast("timestamp").alias("lease_until"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"))
    now = F.lit("2024-01-02").cast("timestamp")
    got = {r["id"]: r["turn"] for r in events.claimable(jobs, now).collect()}
    for stage in ("parse", "embed"):
        own = sorted((c, i) for i, s, c in rows if s == stage)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    few = {r["id"]: r["turn"] for r in events.claimable(jobs, now, most=2).collect()}
    assert few == {i: n for i, n in got.items() if n <= 2}


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p><w:p><w:r><w:t>All of it.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    got = files.office_lines(files.binary(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert [(r["kind"], r["depth"], r["text"], r["cells"]) for r in got] == [("heading", 2, "Scope", None), ("text", None, "All of it.", None), ("table_row", None, "", ["a", None])]


def rosters(spark, tmp_path, **texts):
    for name, said in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(said.encode("utf-8"))
    good, bad = files.roster(files.sheet_rows(files.binary(spark, str(tmp_path))))
    name = lambda r: r["file"].rsplit("/", 1)[1].split(".")[0]
    return sorted((name(r), *list(r)[1:]) for r in good.collect()), sorted((name(r), *list(r)[1:]) for r in bad.collect())


def test_roster(spark, tmp_path):
    said = '\ufeffTeam list,,\n\nManager email,E-Mail Address,Full Name,Role\nm@x.org,A@x.org,"A, ""B""\nC",Lead\n,b.c-d@x.org,,\n,,No one,\n,not,C\n,a@x.org,A\n,"a@x,org",D\n,,,\n'
    good, bad = rosters(spark, tmp_path, r=said)
    assert good == [("r", 4, "a@x.org", 'A, "B"\nC', "Lead", ""), ("r", 6, "b.c-d@x.org", "b c d", "", "")]
    assert bad == [("r", 7, "No email address", "No one"), ("r", 8, "Not an email address", "not"), ("r", 9, "Duplicate of an earlier row", "a@x.org"), ("r", 10, "Not an email address", "a@x,org")]


def test_rosters_without_and_with_odd_headers(spark, tmp_path):
    plain = "x,a@x.org\ny,b@x.org\nz@x.org,c@x.org\n"
    best = "Name,Email\nDept,UPN,Display name,Designation,email\nIT,u@x.org,U,Boss,v@x.org\n"
    good, bad = rosters(spark, tmp_path, plain=plain, best=best, none="a,b\n1,2\n", empty="", alternate="Alternate email,Line manager mail,Login\nq@x.org,r@x.org,s@x.org\n")
    assert good == [("alternate", 2, "s@x.org", "s", "", ""), ("best", 3, "u@x.org", "U", "Boss", "IT"), *[("plain", k, f"{c}@x.org", c, "", "") for k, c in enumerate("abc", 1)]]
    assert {r[0] for r in bad} == {"none"}


def test_roster_of_a_workbook(spark, tmp_path):
    n = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cell = lambda at, said: f'<c r="{at}" t="inlineStr"><is><t>{said}</t></is></c>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{n}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{n}"><sheetData><row>{cell("B1", "Mail")}{cell("C1", "Team")}</row><row>{cell("A2", "x")}{cell("B2", "A@x.org")}{cell("C2", "Ops")}</row></sheetData></worksheet>')
    assert rosters(spark, tmp_path) == ([("w", 2, "a@x.org", "A", "", "Ops")], [])


def test_cached_texts_are_not_asked_again(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), ("c",)], "text string")
    first = providers.embed(rows, spark.createDataFrame([], "fingerprint string, vector array<double>"), providers.HashedWords(8))
    assert first.count() == 2
    known = spark.createDataFrame([(r["fingerprint"], [9.0]) for r in first.collect()], "fingerprint string, vector array<double>")
    assert all(r["vector"] == [9.0] for r in providers.embed(rows, known, providers.HashedWords(8)).collect())
