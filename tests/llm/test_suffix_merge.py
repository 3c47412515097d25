"""Removal of repeated passages against brute force where many texts share parts of one another, and the digest columns."""

import random

import pandas as pd
from pyspark.sql import functions as F
from test_brute_force import cut_by_hand

from tidewire.llm import queries, suffix_merge


def matches(spark, tmp_path, texts) -> None:
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    found = queries.op3_suffix_merge(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    assert got == dict(enumerate(cut_by_hand(texts)))


def test_partners_that_share_different_sides(spark, tmp_path):
    """Pieces of one passage cut at many places: some partners share more before an anchor, others more after it."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, texts = noise(1600), []
    for _ in range(160):
        a = rng.randrange(0, 1100)
        b = rng.randrange(a + 380, 1600)
        texts.append(noise(rng.randrange(0, 300)) + passage[a:b] + noise(rng.randrange(0, 300)))
    matches(spark, tmp_path, texts)


def test_large_groups_of_copies_and_near_copies(spark, tmp_path):
    rng = random.Random(10)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    body, other, texts = noise(2500), noise(900), []
    for i in range(200):
        at = rng.randrange(0, 2500)
        texts.append(body if i % 2 else body[:at] + "#" * (1 + i % 3) + body[at:])
    texts += [noise(100) + other + noise(100) for _ in range(60)] + [noise(900) for _ in range(20)]
    matches(spark, tmp_path, texts)


def test_odd_rows(spark):
    same = "word and another one " * 40
    rows = [(1, None), (2, ""), (3, "short"), (None, same), (4, same), (4, same), (5, "é" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cut", F.lit("own")).withColumn("SPANS", F.lit("own"))
    found = suffix_merge.without_repeats(docs)
    got = sorted((r["doc_id"] or 0, r["cut_"]["n_bytes"], r["cut_"]["n_removed"], r["cut_"]["n_spans"]) for r in found.collect())
    n, twice = len(same), 600
    assert got == [(0, n, n, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 5, 0, 0), (4, n, n, 1), (4, n, n, 1), (5, twice, twice, 1)]
    assert set(found.columns) == {"doc_id", "text", "cut", "SPANS", "cut_"}
