"""The registered queries, and the pipeline stage by stage."""

import duckdb
import pytest
from pyspark.sql import functions as F
from samples import no_docs, sample_docs

import __spark_entry__ as entry_points
import corpus_pipeline as cp
from geocairn.llm import queries, simhash
from geocairn.plans.session import materialize

SF_DIR = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry_points.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF_DIR)
    columns = ", ".join(got.columns)
    want = con.sql(f"SELECT {columns} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_license_query_reads_all_documents(spark):
    got = queries.op8_licenses(spark, SF_DIR)
    assert got.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert got.where("license = 'MIT'").count() > 0


def stages(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 60)], "doc_id long, toxic int")
    real = cp.table
    cp.table = lambda s, d, n: labels if n == "labels" else real(s, d, n)
    try:
        for name, stage in cp.STAGES:
            before, docs = docs, materialize(stage(spark, docs, SF_DIR), name)  # as run() does
            yield name, before, docs
    finally:
        cp.table = real


def test_each_stage_on_awkward_documents(spark):
    docs = materialize(sample_docs(spark), "docs")
    for name, before, after in stages(spark, docs):
        if name != "encoding":
            assert after.columns == before.columns, name
        if name == "toxicity":
            assert after.count() <= before.count() and after.exceptAll(before).count() == 0
        if name == "line_dedup":
            assert after.count() == before.count()
            assert after.drop("text").exceptAll(before.drop("text")).count() == 0
        if name == "simhash_dedup":
            prints = simhash.with_fingerprints(after.select("doc_id", "text")).select("fp")
            assert prints.distinct().count() == after.count() and after.exceptAll(before).count() == 0
        if name == "mixing":
            assert after.distinct().exceptAll(before).count() == 0
            assert after.groupBy("doc_id", "text").count().where("count > 3").count() == 0
        if name == "encoding":
            assert after.count() == before.count() and after.where(~F.col("lossless")).count() == 0


def test_stages_on_no_documents(spark):
    for name, _, after in stages(spark, no_docs(spark)):
        assert after.count() == 0, name


def test_the_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = cp.run(spark, SF_DIR)
    assert set(docs.columns) < set(out.columns) and cp.ORACLE_SQL is None
    kept = out.select("doc_id").distinct()
    assert 0 < kept.count() < docs.count() and kept.join(docs, "doc_id", "left_anti").count() == 0
    assert out.where("NOT lossless").count() == 0
