"""The pipeline as a whole, and the queries that have SQL."""

import duckdb
import pytest

import corpus_pipeline
from keysift.llm import queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    got = [tuple(r) for r in queries.QUERIES[name](spark, SF).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES


def test_stages_keep_extra_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({
        "row": F.col("doc_id") * 2, "at": F.lit("x"), "label": F.lit(None).cast("string"),
        "size": F.lit(1), "_document": F.array(F.lit(1))})
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, held, SF), name)
        assert kept.dtypes == docs.dtypes, name
        ids = {r[0] for r in held.select("doc_id").collect()}
        assert {r[0] for r in kept.select("doc_id").collect()} <= ids
        assert kept.where("row != 2 * doc_id").count() == 0
        held = kept
    last = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert last.where("decoded != text OR n_tokens != size(ids)").count() == 0
    assert last.count() == held.count()


def test_empty_documents_pass_through(spark):
    held = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        held = corpus_pipeline.materialize(stage(spark, held, SF), "empty")
    assert held.count() == 0


def test_run_gives_the_rows_of_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "ids", "decoded"} <= set(got.columns) and got.count() > 0


def test_documents_labelled_as_undetermined_stay(spark):
    rows = [(i, "plain words of one language here", "en") for i in range(40)]
    rows += [(40 + i, "otras palabras de otra lengua", "und") for i in range(40)]
    rows += [(80, "123 !", "und"), (81, None, "und"), (82, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(80))
