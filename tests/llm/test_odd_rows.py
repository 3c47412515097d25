"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names through every operator."""

import pytest
from pyspark.sql import functions as F

from tidewire.llm import compression_quality, crf_language, curriculum, line_runs, permutation_index, queries, sentencepiece_agenda, simhash, suffix_merge, url_rules, weak_supervision

LONG = " ".join(f"word{i % 5000} and" for i in range(60_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Some words stand here, more than a few of them."), (5, "Some words stand here, more than a few of them."), (6, LONG), (None, "no id"), (None, None), (7, "é ü ß 漢字 🙂   x")]
CLASHES = ("k1", "k2", "size", "kept", "n_words", "lines", "cut", "spans", "score", "ids", "copy", "position", "bucket", "lang_pred", "found_words", "p_good", "fp")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t, "s1" if (i or 0) % 2 else None, "de") for i, t in TEXTS], "doc_id long, text string, source string, lang string")
    return rows.select("*", *[F.lit("own").alias(c) for c in CLASHES])


def applied(spark, docs):
    """Each operator over ``docs``, with all rows out again."""
    featured, names = weak_supervision.features(docs)
    yield "7", weak_supervision.judged(featured, names)
    yield "5", line_runs.without_later_copies(docs, name="lines")
    yield "3", suffix_merge.without_repeats(docs)
    yield "8", curriculum.planned(docs)[0]
    yield "9", sentencepiece_agenda.encode(docs, queries.piece_model_bytes(), ids="token_ids", decoded="decoded_text")
    yield "10", compression_quality.scored(docs, compression_quality.fit(docs.select("doc_id", "text", F.lit(1).alias("label"))))
    yield "4", crf_language.labelled(docs, crf_language.fit(docs))


def test_every_row_and_column_comes_out(spark, docs):
    for n, df in applied(spark, docs):
        rows = df.collect()
        assert len(rows) == len(TEXTS), n
        assert set(docs.columns) <= set(df.columns), n
        assert all(r["n_words"] == "own" and r["k1"] == "own" for r in rows), n


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for n, df in applied(spark, none):
        assert df.count() == 0, n
    assert simhash.grouped(none).count() == 0
    assert simhash.one_of_each(none).count() == 0
    assert url_rules.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert permutation_index.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0


def test_simhash_rows(spark, docs):
    rows = simhash.grouped(docs).collect()
    assert len(rows) == len(TEXTS)
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {1}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id = 5").count() == 1


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?y", "http://net", "http://xnet/", "http://a.org/fr/", "http://h.com/cheap-pills", "http://h.com/cheap-pills"]
    rows = url_rules.judged(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("verdict", F.lit("own"))).orderBy("page_id").collect()
    assert [r["rule"] for r in rows] == [None, None, None, "example.net/en/", None, None, "org/fr/", None, None]
    assert [r["verdict_"] for r in rows] == ["allow"] * 7 + ["block"] * 2


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [-1.0, 2.0]), (None, [1.0, 1.0]), (20, [])]
    found = permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["id"], r["score"]) for r in found] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 7, -1.0)]
