"""The pipeline's near-duplicate stage against brute-force Jaccard over 5-word shingles."""

import random

import pandas as pd

from tidewire.llm import simhash

LARGER = "/root/testdata/sf0.01"


def plain_shingles(text) -> frozenset:
    found = (text or "").encode().lower().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def left_by_hand(texts: dict[int, str]) -> set[int]:
    """The least id of each group of texts with a similarity of 0.8 or more."""
    sets, root = {i: plain_shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def stays(spark, texts: dict[int, str]) -> set[int]:
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}), "doc_id long, text string")
    return {r["doc_id"] for r in simhash.one_of_each(docs).select("doc_id").collect()}


def test_documents(spark):
    docs = pd.read_parquet(f"{LARGER}/documents.parquet")
    texts = dict(zip(docs["doc_id"].tolist(), docs["text"].tolist()))
    assert stays(spark, texts) == left_by_hand(texts)


def test_about_the_limit(spark):
    """Pairs just over and under 0.8, texts of equal words in another order, and texts of few words."""
    rng, texts = random.Random(5), {}
    for g in range(60):
        body = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 160))]
        texts[3 * g] = " ".join(body)
        other = list(body)
        for at in rng.sample(range(5, len(body) - 5), 2 + g % 4):
            other[at] = f"x{g}"
        texts[3 * g + 1] = " ".join(other)
        texts[3 * g + 2] = " ".join(rng.sample(body, len(body)))
    texts |= {1000: "", 1001: None, 1002: " ", 1003: "a b", 1004: "A  b", 1005: "b a", 1006: "a b c d e"}
    assert stays(spark, texts) == left_by_hand(texts)


def test_crowded_buckets(spark):
    """One group of many near copies, and many texts that share a passage and nothing else."""
    rng, texts = random.Random(6), {}
    body = [f"w{i}" for i in range(120)]
    for i in range(150):
        other = list(body)
        other[rng.randrange(10, 110)] = f"x{i}"
        texts[i] = " ".join(other)
    for i in range(150, 400):
        tail = [f"y{i}_{k}" for k in range(60)] if i % 2 else [f"y{i - 1}_{k}" for k in range(59)] + ["z"]
        texts[i] = " ".join(body + tail)
    assert stays(spark, texts) == left_by_hand(texts)


def test_pigeonring_first_and_nothing_lost(spark, monkeypatch):
    """Candidates come from pigeonring over SimHash fingerprints; with none of them, and with buckets of every size and order, the
    exact pass still finds the same."""
    rng, texts = random.Random(7), {}
    for i in range(240):
        body = [f"w{rng.randrange(3000)}" for _ in range(100)] if i % 12 == 0 else list(body)
        body[rng.randrange(5, 95)] = f"x{i}"
        texts[i] = " ".join(body + [f"common{k}" for k in range(20)])
    texts |= {1000 + i: " ".join(f"common{k}" for k in range(i % 3, 18 + i % 4)) for i in range(12)}
    expected, links, seen = left_by_hand(texts), simhash.links, []

    def spy(nodes, *rest):
        found = links(nodes, *rest)
        seen.append(found.count())
        return found

    monkeypatch.setattr(simhash, "links", spy)
    assert stays(spark, texts) == expected
    assert len(seen) == 1 and seen[0] > 0
    monkeypatch.setattr(simhash, "links", lambda nodes, *rest: links(nodes, *rest).limit(0))
    for name, value in (("CROWDED", 2), ("FREQUENT", 0), ("SPREAD", 3)):
        monkeypatch.setattr(simhash, name, value)
    assert stays(spark, texts) == expected


def test_sets_are_made_for_candidates_alone(spark, monkeypatch):
    """No table holds the sets of all texts, which take more room than the texts; copies in many rows change nothing."""
    rng, texts = random.Random(8), {}
    for i in range(200):
        texts[i] = " ".join(f"w{rng.randrange(100_000)}" for _ in range(100))
    for i in range(200, 240):
        texts[i] = texts[i % 7]  # copies
    texts[300] = " ".join([*texts[0].split()[:-1], "other"])
    texts[301] = " ".join(["other", *texts[8].split()[1:]])
    saved, held = simhash.saved, []

    def spy(df, name):
        out = saved(df, name)
        if any(kind == "array<bigint>" and c != "odd" for c, kind in out.dtypes):
            held.append(out.count())
        return out

    monkeypatch.setattr(simhash, "saved", spy)
    assert stays(spark, texts) == left_by_hand(texts)
    assert held and max(held) <= 4
