"""Spelling variants against a brute-force version over small tables."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.llm import queries, spelling_variants

SF_DIR = "/root/testdata/sf0.001"
LETTERS = "[A-Za-zÀ-ÿ]+"


def brute_force(rows, least_length=7, least_count=2, ratio=10):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(LETTERS, text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least_length:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= least_count}
    letters = sorted({c for w in n for c in w})
    form, out = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in letters}
        near = [v for v in edits if v in n and v != w]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = len(near)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


def collected(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = collected(queries.op13_spelling_variants(spark, SF_DIR))
    assert found == brute_force(docs)
    assert any(r[1] for r in found)


ODD = [
    (1, None), (2, ""), (None, "sterling Sterling"), (3, "sterling " * 200 + "sterlling " * 15 + "sterlin sterlin"), (3, "sterling " * 200), (4, "Straßenbahn straßenbahn ÀÉ×÷øþÿ ÀÉ×÷øþÿ àé×÷øþÿ"),
    (5, "abcdefg abcdefg abcdefgh abcdefgh aabcdefg aabcdefg abcdefx abcdefx"), (6, "letter1letters sixsix seven77 " + "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y " + "x" * 4999 + "y"),
    (7, "variants " * 3000 + "varients " * 250 + "varjents " * 20 + "varjants varjants varrjents varrjents"), (8, "漢字漢字漢字漢字"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.select("*", *[F.lit("own").alias(c) for c in ("word", "n", "near", "root", "form", "shard", "edit")])


def test_odd_rows(odd):
    found = collected(spelling_variants.variants(odd))
    assert found == brute_force(ODD)
    assert max(Counter(r[2] for r in found).values()) > 3  # chains of forms meet in one root


def test_empty(spark, odd):
    assert spelling_variants.variants(odd.limit(0)).count() == 0
    assert spelling_variants.variants(odd.filter("doc_id = 8")).count() == 0


def test_rounds_over_small_slices(spark):
    """A vocabulary of many slices, probed in many rounds, has the same pairs."""
    words = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    words = spelling_variants.saved(spelling_variants.counted(words).filter("n >= 2"), "words")
    once = {tuple(r) for r in spelling_variants.near_pairs(words).collect()}
    many = [tuple(r) for r in spelling_variants.near_pairs(words, size=64, at_once=3).collect()]
    assert len(many) == len(set(many)) and set(many) == once and once
