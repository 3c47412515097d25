"""Packing against the tokenizers library, and the linear program against its own bounds."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from tidewire.llm import cutting_stock, packing, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def checked(pieces, docs, library, capacity=2048):
    """Every id of every row lies in exactly one piece, and sequences have no gap, no overlap and no padding."""
    wanted = Counter()
    for key, text in docs:
        ids = ids_of(library, text)
        wanted[key, len(ids)] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert by_doc.keys() == wanted.keys()
    for (key, n), own in by_doc.items():
        assert sum(length for _, length in own) == n * wanted[key, n]
        spans = Counter()
        for start, length in own:
            spans[start] += 1
            spans[start + length] -= 1
        open_, cover = 0, set()
        for at in sorted(spans):
            open_ += spans[at]
            cover.add(open_ if at < n else wanted[key, n])
        assert cover == {wanted[key, n]}
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    texts = dict(docs)
    for p in pieces:
        ids = ids_of(library, texts[p["doc_id"]])
        if len(ids) == p["doc_tokens"]:
            assert zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
    return by_doc


def test_query(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    checked(queries.op12_packing(spark, SF_DIR).collect(), docs, library)


ODD = [(1, None), (2, ""), (3, "<|endoftext|> in a text <|endoftext|>"), (4, "word " * 30_000), (5, "é ü ß 漢字 🙂   x"), (None, "no id"), *[(6, "the same words again")] * 40, (7, "a b c " * 300), (8, "a b d " * 300)]


@pytest.mark.parametrize("broadcast", [packing.CUTS_BROADCAST, -1])
def test_odd_rows(spark, library, monkeypatch, broadcast):
    monkeypatch.setattr(packing, "CUTS_BROADCAST", broadcast)
    docs = spark.createDataFrame(ODD, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("doc", "k1", "tail", "rank", "start", "sequence")])
    pieces = packing.packed(docs, queries.byte_model_bytes(), capacity=512).collect()
    checked(pieces, ODD, library, 512)
    assert [p for p in packing.packed(docs.limit(0), queries.byte_model_bytes()).collect()] == []


def test_sequences_hold_the_ids(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    model = queries.byte_model_bytes()
    pieces = packing.saved(packing.packed(docs, model), "pieces")
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, pieces, model).collect()}
    for p in pieces.collect():
        assert zlib.crc32(np.array(made[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]


def test_most_lengths_stay_whole():
    draw = np.random.default_rng(5)
    lengths, counts = np.unique(draw.integers(1, 256, 20_000), return_counts=True)
    left = dict(zip(lengths.tolist(), counts.tolist()))
    tokens = sum(k * n for k, n in left.items())
    whole = 0
    for pattern, uses in cutting_stock.solved(left, 256):
        total = sum(k * a for k, a in pattern.items())
        assert total in cutting_stock.sums(256)
        whole += total * uses
        for k, a in pattern.items():
            left[k] -= a * uses
    assert min(left.values()) >= 0
    assert whole > 0.95 * tokens


def test_knapsack_finds_the_best():
    values = np.full(31, -np.inf)
    values[[4, 7, 9]] = [5.0, 8.0, 12.0]
    best, last = cutting_stock.knapsack(values)
    for total in range(31):
        plain = max((5.0 * a + 8.0 * b + 12.0 * c for a in range(8) for b in range(5) for c in range(4) if 4 * a + 7 * b + 9 * c == total), default=-np.inf)
        assert best[total] == plain
        if plain > -np.inf:
            assert sum(k * a for k, a in cutting_stock.unfolded(last, total).items()) == total


def test_optimum_of_a_small_program():
    assert sum(uses for _, uses in cutting_stock.solved({900: 100, 700: 100, 448: 100}, 2048)) == 100
    assert cutting_stock.solved({1500: 1000}, 2048) == []
