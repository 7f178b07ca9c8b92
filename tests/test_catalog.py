"""Every registered query against its SQL twin on the smallest tables."""

import hashlib

import duckdb
import pytest

from attestry.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, (int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, sf_dir, sql, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    other = sql.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, sf_dir):
    plan = catalog.queries()["scoped_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lang" in plan and "text" not in plan.split("ReadSchema")[1].split(">")[0]


def test_whole_texts_reach_the_operators(spark, tmp_path):
    said = " ".join(f"word{i}" for i in range(200))
    spark.createDataFrame([(0, said, "en", "src0", len(said))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    row = catalog.queries()["clause_extraction"](spark, str(tmp_path)).first()
    half = len(said) // 2
    assert [row["statement"], row["rationale"]] == [hashlib.md5(x.strip().encode()).hexdigest() for x in (said[:half], said[half:])]
