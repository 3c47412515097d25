"""The permutation index: credits against plain footrule distances, and recall on vectors of varying length."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewire.llm import permutation_index as index


def test_credits_rank_by_footrule():
    rng = np.random.default_rng(1)
    x, pivots = rng.standard_normal((300, 16)), rng.standard_normal((200, 16))
    near = index.permutation(x, pivots).astype(int)
    m = near.shape[1]
    assert (near == np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :m]).all()
    place = np.full((300, 200), m)
    np.put_along_axis(place, near, np.arange(m)[None, :], axis=1)
    files = index.InvertedFiles(near.astype("<u2"), 200)
    for q in range(0, 300, 30):
        footrule = np.abs(place - place[q]).sum(axis=1)
        assert (files.credits(near[q].astype("<u2")) * 2 == m * (m + 1) - footrule).all()


def test_recall_beyond_the_reranked_share(spark):
    """20,000 vectors, of which 5 % are reranked, with lengths that differ by much."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20_000, 48))
    x *= (np.exp(rng.normal(0, 0.4, len(x))) / np.linalg.norm(x, axis=1))[:, None]
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    found = index.nearest(rows, F.col("id") % 100 == 0).toPandas()
    asked = np.arange(0, len(x), 100)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = {(int(q), int(i)) for q, row in zip(asked, np.argsort(-scores, axis=1)[:, :20]) for i in row}
    assert len(found) == 20 * len(asked)
    assert len(want & set(zip(found["query_id"].tolist(), found["id"].tolist()))) >= 0.9 * len(want)
    ordered = found.sort_values(["query_id", "rank"])
    assert (ordered.groupby("query_id")["score"].diff().dropna() <= 0).all()


def test_ids_that_stand_with_many_vectors(spark):
    """An id with more near vectors than a result has places still gets all its neighbours, and never itself."""
    draw = np.random.default_rng(3)
    near = draw.normal(size=8)
    rows = [(0, (near + draw.normal(size=8) * 0.01).tolist()) for _ in range(30)] + [(i, draw.normal(size=8).tolist()) for i in range(1, 60)] + [(i, (near * 2).tolist()) for i in (0, 61, 62)]
    found = index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40} and all(r["query_id"] != r["id"] for r in found)
    assert len([r for r in found if r["query_id"] == 0]) == 31 * 20  # for each of its vectors
    for own in (20, 40):
        mine = next(v for i, v in rows if i == own)
        wanted = sorted((-float(np.dot(mine, v)), i) for i, v in rows if i != own)[:20]
        got = sorted((r["rank"], r["id"], r["score"]) for r in found if r["query_id"] == own)
        assert [i for _, i, _ in got] == [i for _, i in wanted] and np.allclose([s for *_, s in got], [-s for s, _ in wanted])
