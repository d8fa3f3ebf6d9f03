"""The pipeline's stages on odd rows and on the small table, and what is registered."""
import re

import corpus_pipeline
import __spark_entry__ as entry
from pyspark.sql import functions as F


def test_every_operator_has_its_query():
    names = [n.split("_")[0] for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 14)) and "pipeline" in entry.queries()


def test_stages_keep_the_columns(spark, odd, sf):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        assert after.count() <= docs.count()
        docs = after
    assert docs.where("doc_id = 1").count() == 1 and docs.where("doc_id in (5, 6, 7, 8)").count() == 0
    # A copy loses all its lines; of the documents that are empty by then one row stays.
    assert docs.where("trim(text) = ''").count() == docs.where("doc_id = 2").count() == 1


def test_stages_take_empty_tables(spark, empty, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_run_gives_the_rows_of_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.select("doc_id").distinct().join(docs, "doc_id").count() == got.select("doc_id").distinct().count() > 100
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert got.where("length > 2048 or offset < 0").count() == 0
