"""The pipeline's stages, one after another, against what each operator says of its input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from slotflow.llm import language, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def test_stages_keep_the_columns(kept):
    assert [len(f.columns) for f in kept[:-1]] == [len(kept[0].columns)] * 5 and all(f.columns == kept[0].columns for f in kept[1:-1])


def test_rejected_documents_go(spark, kept):
    docs, spoken, clean = kept[:3]
    model = language.fit(docs).judge()
    assert sorted(r.doc_id for r in spoken.collect()) == sorted(r.doc_id for r in docs.collect() if model(r.text)[3])
    scorer = toxicity.ToxicityScorer(toxicity.fit(spoken, spark.read.parquet(f"{SF}/labels.parquet")))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in spoken.collect() if not scorer(r.text)[1])
    assert clean.count() > 0.85 * docs.count()


def test_lines_go_and_one_of_each_group_stays(kept):
    clean, cut, single = kept[2:5]
    assert cut.count() == clean.count() and cut.where(F.length("text") != F.col("n_chars")).count() == 0
    before, after = ({x for r in f.collect() for x in (r.text or "").split("\n")} for f in (clean, cut))
    assert before - {""} <= after
    from slotflow.llm import simhash

    groups = simhash.near_duplicates(cut).groupBy("component_id").count().count()
    assert single.count() == groups


def test_all_that_stays_is_packed(kept):
    single, packed = kept[4:]
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in single.collect()}
    over = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n != end or n > 2048")
    assert over.count() == 0


def test_run_is_the_stages(spark, kept):
    run = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(run) == sorted(kept[-1].select("doc_id", "piece", "start", "length", "ids_crc32").collect())


def test_stages_bear_odd_rows(spark, kept):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the " * 200_000, None, None, 1)]
    docs = spark.createDataFrame(odd, kept[0].schema)
    for docs in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs.withColumn("judged", F.lit(1)), SF).collect() is not None


def test_queries_are_registered():
    names = [n for n in entry_points.queries() if n in entry_points.LLM]
    assert [n for n in names if n == "pipeline"] and sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
