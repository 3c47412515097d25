"""Alignment against a brute-force version that looks at every byte offset."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tidewire.llm import queries, window_alignment
from tidewire.llm.byte_vocabulary import byte_letters

SF_DIR = "/root/testdata/sf0.001"


def brute_force(docs):
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()
    rows, holding = [], Counter()
    for doc, text in docs:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
                ends = [set(accumulate(map(len, some), initial=0)) for some in (bytes_a, bytes_b)]
                shared = sorted(ends[0] & ends[1])
                number = {at: i for i, at in enumerate(shared)}
                groups = [([], []) for _ in shared[1:]]
                for side, (ids, some) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
                    at, group = 0, 0
                    for i, x in zip(ids, some):
                        groups[group][side].append(i)
                        at += len(x)
                        group = number.get(at, group)
        links = Counter((x, y) for own_a, own_b in groups for x in own_a for y in own_b)
        holding.update(links.keys())
        rows.append((doc, groups, links))
    most = defaultdict(int)
    for (x, _), n in holding.items():
        most[x] = max(most[x], n)
    out = Counter()
    for doc, groups, links in rows:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n for (x, y), n in links.items() if holding[x, y] == most[x])
        total = sum(n * holding[p] for p, n in links.items())
        out[doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), links.total(), best, total, hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    return out


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = Counter(tuple(r) for r in queries.op11_alignment(spark, SF_DIR).collect())
    assert found == brute_force(docs)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a ▁ mark"), (5, "<|endoftext|> <s> </s> <unk>"), (6, "é ü ß 漢字 🙂   x\n\n y\t z "), (None, "no id, don't"), (None, None), (7, "word and " * 9_000), (8, "x" * 3_000), (9, "漢字" * 500), (10, "\x00 ﬁ"),
    *[(11, "the same words again")] * 30,
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("doc", "block", "groups", "pairs", "table", "n_a")])


@pytest.mark.parametrize(("chars", "kept"), [(window_alignment.BLOCK_CHARS, window_alignment.KEPT_WINDOWS), (40, 3)])
def test_odd_rows(odd, chars, kept):
    found = Counter(tuple(r) for r in window_alignment.counted(odd, queries.byte_model_bytes(), queries.piece_model_bytes(), block_chars=chars, kept=kept).collect())
    assert found == brute_force(ODD)


def test_groups_pass_beside_other_columns(odd):
    rows = window_alignment.aligned(odd, queries.byte_model_bytes(), queries.piece_model_bytes()).collect()
    wanted = Counter((doc, sha) for doc, *_, sha in brute_force(ODD).elements())
    assert Counter((r["doc_id"], hashlib.sha256(r["groups_"].encode()).hexdigest() if r["groups_"] else "") for r in rows) == wanted
    assert {r["groups"] for r in rows} == {"own"}


def test_empty(odd):
    assert window_alignment.counted(odd.limit(0), queries.byte_model_bytes(), queries.piece_model_bytes()).count() == 0
    only = window_alignment.counted(odd.filter("doc_id = 1"), queries.byte_model_bytes(), queries.piece_model_bytes()).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "")]
