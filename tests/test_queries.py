"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tessera.plans import registry
from tessera.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for t in TABLES:
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return own


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda v: "" if v is None or v is pd.NaT else f"{v:.6f}" if isinstance(v, float) else str(pd.Timestamp(v)) if "time" in type(v).__name__.lower() else str(v)
    return sorted(tuple(show(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(found)
        return
    want = duck.sql(sql).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streamed_documents_replace_and_extend(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "terms")
    kind = "doc_id bigint, text string"
    for batch in ([(1, "love heart"), (2, "rain")], [(2, "sun sun"), (3, "night")]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema(kind).parquet(source), folder, str(tmp_path / "check")).awaitTermination()
    found = {(r["doc_id"], r["term"]): r["tf"] for r in ingest.term_table(spark, folder).collect()}
    assert found == {(1, "love"): 1, (1, "heart"): 1, (2, "sun"): 2, (3, "night"): 1}
    assert ingest.rebuild(spark, folder, str(tmp_path / "index")).n_docs == 3
