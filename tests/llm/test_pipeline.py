"""The stages of the corpus pipeline over whole tables: what goes, what stays, and that texts hold what the stages say."""

import pytest
from comparison import SF
from test_near_duplicates import left_by_hand

import corpus_pipeline
from tidewire.llm.shared import n_words, recorded, saved, settled


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], SF), name))
    return out


def test_columns(steps):
    for step in steps[1:-1]:
        assert set(step.columns) == set(steps[0].columns)


def test_quality_takes_away_only(steps):
    assert steps[1].exceptAll(steps[0]).count() == 0
    assert 0 < steps[1].count() < steps[0].count()


def test_lines_keep_documents(steps):
    assert steps[2].select("doc_id").exceptAll(steps[1].select("doc_id")).count() == 0
    assert steps[2].count() == steps[1].count()


def test_one_of_each_group(steps):
    """Of each group of texts with a 5-word Jaccard similarity of 0.8 or more the least id stays, by brute force."""
    before = {r["doc_id"]: r["text"] for r in steps[2].select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in steps[3].select("doc_id").collect()} == left_by_hand(before)


def test_mix_size(steps):
    words = lambda df: df.selectExpr("1 as one", "text").select(n_words(df["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert words(steps[4]) == pytest.approx(1.5 * words(steps[3]), rel=0.02)


def test_tokens(steps):
    assert steps[5].count() == steps[4].count()
    assert steps[5].filter("n_tokens < 2 or n_tokens <> size(ids)").count() == 0


def test_recorders_of_equal_tables(spark):
    """An inner recorder ends by itself, though an outer one holds the same tables; the outer one goes on."""
    with recorded(outer := []):
        out = settled(lambda: saved(spark.range(3), "part"), "whole")
        assert out.count() == 3
    assert len(outer) == 2 and outer[1] is out


def test_run_whole(spark):
    """The registered query from first to last stage: the rows of the stages written one by one."""
    rows = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name)
    assert rows.count() == docs.count() > 0
    assert rows.exceptAll(docs).count() == 0
