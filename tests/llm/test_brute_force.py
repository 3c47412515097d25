"""Queries that SQL can't express against brute force, the library, or held-out rows."""

import hashlib
import struct
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import xxhash
from comparison import SF

from tidewire.llm import components, queries, simhash
from tidewire.llm.shared import WHITE

LARGER = "/root/testdata/sf0.01"


def table(name: str, folder: str = SF) -> pd.DataFrame:
    return pd.read_parquet(f"{folder}/{name}.parquet")


def test_nearest_vectors(spark):
    vectors = table("embeddings", LARGER)
    found = queries.op1_permutation_index(spark, LARGER).toPandas()
    x = np.stack(vectors["embedding"]).astype(float)
    ids = vectors["vec_id"].to_numpy()
    hits = wanted = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[at]
        order = [i for i in np.lexsort((ids, -scores)) if i != at][:20]
        mine = found[found["query_id"] == ids[at]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(order) + 1))
        exact = dict(zip(ids.tolist(), scores.tolist()))
        assert np.allclose(mine["score"], [exact[i] for i in mine["vec_id"]], rtol=1e-12, atol=1e-12)
        hits += len(set(mine["vec_id"]) & set(ids[order].tolist()))
        wanted += len(order)
    assert hits >= 0.9 * wanted


def plain_fingerprint(text) -> int:
    found = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).translate({ord(c): " " for c in WHITE}).split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped_by_hand(prints: dict[int, int]) -> dict[int, int]:
    """The least id reachable over links of 2 bits or fewer."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[: k + 1] ^ values[k]) <= 2).tolist():
            a, b = sorted((find(i), find(ids[j])))
            root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(spark):
    docs = table("documents", LARGER)
    prints = {i: plain_fingerprint(t) for i, t in zip(docs["doc_id"], docs["text"])}
    groups = grouped_by_hand(prints)
    found = queries.op2_simhash(spark, LARGER).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


def test_crowded_buckets(spark):
    rng = np.random.default_rng(7)
    prints = {int(v): int(v) for base in rng.integers(0, 1 << 62, 6) for v in {int(base), *(int(base) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (30, 2)))}}
    nodes = spark.createDataFrame([(0, v) for v in prints], "f int, fp long")
    for crowded in (1, 64):
        roots = {r["u"]: r["root"] for r in components.components(simhash.links(nodes, crowded=crowded).select("u", "v")).collect()}
        assert {v: roots.get(v, v) for v in prints} == grouped_by_hand(prints)


def cut_by_hand(texts: list[str | None], length: int = 400):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        yield len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()


def test_repeated_passages(spark):
    docs = table("documents")
    want = dict(zip(docs["doc_id"], cut_by_hand(docs["text"].tolist())))
    found = queries.op3_suffix_merge(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == want


def test_repeats_inside_and_at_the_edge(spark, tmp_path):
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, n))
    passage = noise(900)
    texts = [noise(50) + passage + noise(700), passage[100:499], passage[100:500] + "é", "ab" * 600, noise(300) + passage[:650] + passage[250:], None, "", "x" * 399, "y" * 400, "y" * 401, passage, passage]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    found = queries.op3_suffix_merge(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == dict(enumerate(cut_by_hand(texts)))


def test_language(spark):
    found = queries.op4_crf(spark, LARGER).toPandas().merge(table("documents", LARGER), on="doc_id")
    judged = found[found["held_out"] & found["lang"].notna() & (found["lang_pred"] != "und")]
    assert (judged["lang"] == judged["lang_pred"]).mean() >= 0.9
    assert found["score"].between(0, 1).all()
    wordless = ~found["text"].fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert ((found["lang_pred"] == "und") == wordless).all()


def test_sentencepiece(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op9_sentencepiece(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for i, text in zip(*(table("documents")[c] for c in ("doc_id", "text"))):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert found[i] == (len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_quality_classifier(spark):
    found = queries.op10_compression(spark, LARGER).toPandas().merge(table("labels", LARGER), on="doc_id")
    held = found[found["held_out"]]
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2 >= 0.9
    assert ((found["score"] >= 0.7) == (found["predicted"] == 1)).all()
