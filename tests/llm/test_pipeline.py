"""The pipeline's stages on the driver's smallest tables, each against its own input."""

import os

import pytest

import corpus_pipeline
from tessel.llm import queries

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@needs_data
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        kept.append(after.count())
        docs = after
    assert kept == sorted(kept, reverse=True) and 0 < kept[-1] < 200
    assert all(r.n_tokens == (len(r.ids.split(",")) if r.ids else 0) for r in docs.collect())


@needs_data
def test_odd_rows_and_columns(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "'x' as score", "1 as spans", "doc_id as block", "'y' as class_id", "2 as `other`", "3 as `a b`", "4 as `a``b`")
    odd = rows.limit(2).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars", "score", "spans", "block", "class_id", "`other`", "`a b`", "`a``b`")
    docs = rows.limit(60).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert out.where("doc_id is not null").count() > 0, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.queries()[name](spark, DATA)
    columns, other = sorted(df.columns), db.sql(queries.oracle_sql()[name])
    at = [other.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in other.fetchall())
