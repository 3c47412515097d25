"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots (largest inner product) in order. The index is a set of inverted files,
one for each pivot: the vectors that have it among their nearest, each with the place that it has there. A query reads the files
of its own nearest pivots only, some ``PREFIX / PIVOTS`` of them. The footrule distance (the summed differences of places, where
a pivot beyond the prefix has place PREFIX) is a constant less twice the sum, over the shared pivots, of PREFIX less the larger
of the two places, so summing these credits over the postings ranks by footrule. As the nearness is the inner product, a credit
counts times the vector's length. The first ``SHARE`` of each block of the index are reranked by the exact inner product.

The files are sharded by vector into ``LANES`` lanes, each read in blocks of ``BLOCK`` vectors, and queries go in blocks of
``QUERIES`` to every lane: a task streams its lane past its queries and keeps the best ``k + 1`` of each, so its memory is
bounded and the rows that come out are queries x LANES x (k + 1) however large the collection is. The work is a stated query set
against all rows, in blocks.

Pivots are a bounded sample (``PIVOTS`` distinct vectors, the first by a hash); every vector is indexed. Equal vectors are one
entry that carries the few least ids a result can need, so that a very common vector takes no more room than another; their
ids are cut down in two steps, so that it doesn't meet in one task.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a
null id; vectors of different lengths don't meet; rows equal in id and vector count once; a query meets no row of its own id;
equal scores go to the lesser id; an empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.shared import saved

#: Pivots, the length of the permutation prefix, the share of a block that is reranked, and how many of a block at least.
PIVOTS, PREFIX, SHARE, LEAST = 1024, 128, 0.05, 48
#: Vectors of a block, lanes of the index, and queries that a task holds.
BLOCK, LANES, QUERIES = 4096, 16, 8192
#: Parts into which the rows of one vector are split while their least ids are found.
SALTS = 16


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def permutation(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector the numbers of its nearest pivots, in order."""
    closeness, n = x @ pivots.T, min(PREFIX, len(pivots))
    near = np.argpartition(-closeness, n - 1, axis=1)[:, :n]
    near.sort(axis=1)  # ties go to the pivot of the lesser number
    order = np.argsort(-np.take_along_axis(closeness, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1).astype("<u2")


def entries(vectors: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The usable rows, and (h, g, v, ids, dim): distinct vectors with their k + 1 least ids; h and g are a hash of 128 bits."""
    v = F.col(vector).cast("array<float>") if dict(vectors.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    rows = vectors.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    rows = rows.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")).dropDuplicates(["id", "h", "g"])
    rows = saved(rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), "vectors")
    few = rows.withColumn("n", F.row_number().over(W.partitionBy("h", "g", "salt").orderBy("id"))).filter(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(W.partitionBy("h", "g").orderBy("id"))).filter(F.col("n") <= k + 1)
    found = few.groupBy("h", "g").agg(F.min_by("v", "id").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    return rows, found.withColumn("dim", F.size("v"))


def _indexed(pivots: dict[int, np.ndarray]):
    """Adds to each entry its components as bytes (x) and its permutation (near)."""

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made, near = [np.asarray(v, dtype="<f8") for v in part["v"]], [b""] * len(part)
            sizes = np.array([len(x) for x in made])
            for dim in set(sizes.tolist()):
                at = np.flatnonzero(sizes == dim)
                for i, row in zip(at.tolist(), permutation(np.stack([made[i] for i in at]), pivots[dim])):
                    near[i] = row.tobytes()
            yield part.drop(columns="v").assign(x=[x.tobytes() for x in made], near=near)

    return index


class InvertedFiles:
    """The inverted files of one block: for each pivot the vectors that have it among their nearest, and its place there."""

    def __init__(self, near: np.ndarray, pivots: int) -> None:
        self.n, self.prefix = near.shape
        flat = near.ravel()
        order = np.argsort(flat, kind="stable")
        self.vectors, self.places = order // self.prefix, (order % self.prefix).astype(np.int32)
        self.starts = np.searchsorted(flat[order], np.arange(pivots + 1))

    def credits(self, mine: np.ndarray) -> np.ndarray:
        """The credit of every vector for the permutation ``mine``, from the files of its pivots alone."""
        begin, size = self.starts[mine], self.starts[mine.astype(np.int64) + 1] - self.starts[mine]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(begin - ends + size, size)
        shared = self.prefix - np.maximum(self.places[at], np.repeat(np.arange(self.prefix, dtype=np.int32), size))
        return np.bincount(self.vectors[at], weights=shared, minlength=self.n)


class Asked:
    """The queries of one task and the best entries that each has met: scores, least ids, and id lists."""

    def __init__(self, queries: pd.DataFrame, k: int) -> None:
        self.h, self.g = queries["h"].to_numpy(), queries["g"].to_numpy()
        self.x = np.frombuffer(b"".join(queries["x"]), dtype="<f8").reshape(len(queries), -1)
        self.near = np.frombuffer(b"".join(queries["near"]), dtype="<u2").reshape(len(queries), -1)
        self.own, self.alone = queries["own"].to_numpy(), queries["alone"].to_numpy()
        self.k, shape = k + 1, (len(queries), k + 1)
        self.scores, self.first, self.ids = np.full(shape, -np.inf), np.zeros(shape, dtype=np.int64), np.full(shape, None, dtype=object)

    def meet(self, entries: pd.DataFrame, pivots: int) -> None:
        """Rank one block of the index for every query, rerank the first, and keep the best."""
        n = len(entries)
        x = np.frombuffer(b"".join(entries["x"]), dtype="<f8").reshape(n, -1)
        files = InvertedFiles(np.frombuffer(b"".join(entries["near"]), dtype="<u2").reshape(n, -1), pivots)
        ids, lengths = entries["ids"].to_numpy(), np.linalg.norm(x, axis=1)
        single = np.array([len(i) == 1 for i in ids])
        first, most = np.array([i[0] for i in ids]), min(n, max(LEAST, self.k, int(np.ceil(SHARE * n))))
        width = min(self.k, most)
        scores, places = np.empty((len(self.x), width)), np.empty((len(self.x), width), dtype=np.int64)
        for q, (asked, mine) in enumerate(zip(self.x, self.near)):
            worth = files.credits(mine) * lengths
            only_own = single & (first == self.own[q]) if self.alone[q] else None  # entries that only the query's own id has
            if only_own is not None:
                worth[only_own] = -np.inf
            chosen = np.argpartition(-worth, most - 1)[:most] if most < n else np.arange(n)
            exact = (x[chosen] * asked).sum(axis=1)
            if only_own is not None:
                exact[only_own[chosen]] = -np.inf
            best = np.lexsort((first[chosen], -exact))[:width]
            scores[q], places[q] = exact[best], chosen[best]
        every = [np.concatenate(pair, axis=1) for pair in ((self.scores, scores), (self.first, first[places]), (self.ids, ids[places]))]
        order = np.lexsort((every[1], -every[0]), axis=1)[:, : self.k]
        self.scores, self.first, self.ids = (np.take_along_axis(part, order, axis=1) for part in every)

    def found(self) -> pd.DataFrame:
        met = np.isfinite(self.scores)
        q, _ = np.nonzero(met)
        return pd.DataFrame({"h": self.h[q], "g": self.g[q], "own": self.own[q], "alone": self.alone[q], "score": self.scores[met], "ids": self.ids[met]})


def _searched(pivots: dict[int, int], k: int):
    """A function over partitions sorted by cell (dim, asked, lane), in each cell the queries before the entries."""

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, waiting, queries = None, [], None

        def block(least: int) -> Iterator[pd.DataFrame]:
            """Blocks of what waits, as long as over ``least`` rows do."""
            nonlocal waiting
            while sum(map(len, waiting)) > least:
                rows = pd.concat(waiting, ignore_index=True)
                waiting = [rows.iloc[BLOCK:]]
                yield rows.iloc[:BLOCK]

        for part in parts:
            for key, rows in part.groupby(["dim", "asked", "lane"], sort=False):
                if key != cell:
                    if queries is not None:
                        for entries in block(0):
                            queries.meet(entries, pivots[cell[0]])
                        yield queries.found()
                    cell, waiting, queries, asking = key, [], None, []
                if (mine := rows[rows["is_query"]]).size:
                    asking.append(mine)
                if (theirs := rows[~rows["is_query"]]).size:
                    if queries is None and asking:
                        queries, asking = Asked(pd.concat(asking, ignore_index=True), k), []
                    if queries is not None:
                        waiting.append(theirs)
                        for entries in block(BLOCK - 1):
                            queries.meet(entries, pivots[key[0]])
        if queries is not None:
            for entries in block(0):
                queries.meet(entries, pivots[cell[0]])
            yield queries.found()

    return search


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for each row of ``vectors`` for which ``is_query`` (over ``id``) holds."""
    rows, distinct = entries(vectors, key, vector, k)
    distinct = saved(distinct, "entries")
    dims = sorted(r["dim"] for r in distinct.select("dim").distinct().collect())
    pivots = {d: np.array([r["v"] for r in distinct.filter(F.col("dim") == d).orderBy("h", "g").limit(PIVOTS).select("v").collect()], dtype=np.float64) for d in dims}
    pivots = {d: p / np.linalg.norm(p, axis=1, keepdims=True) for d, p in pivots.items()}  # directions: long pivots aren't near everything
    asked = rows.filter(is_query).select("id", "h", "g")
    # An id that stands with several vectors asks by itself with each, and meets none of its own; other ids of a vector ask together.
    several = asked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit(True).alias("alone"))
    asked = asked.join(several, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(False))).withColumn("own", F.when(F.col("alone"), F.col("id")).otherwise(0))
    index = saved(distinct.mapInPandas(_indexed(pivots), "h long, g long, ids array<long>, dim int, x binary, near binary"), "permutations")
    queries = saved(index.join(asked.select("h", "g", "own", "alone").distinct(), ["h", "g"]).drop("ids"), "queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    lane, none = F.pmod("g", F.lit(LANES)).cast("int"), F.lit(None).cast("array<long>")
    stored = index.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("asked"), lane.alias("lane"), F.lit(False).alias("is_query"), "h", "g", "ids", "x", "near", F.lit(0).cast("long").alias("own"), F.lit(False).alias("alone"))
    sent = queries.select("dim", F.pmod("g", F.lit(blocks)).cast("int").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"), F.lit(True).alias("is_query"), "h", "g", none.alias("ids"), "x", "near", "own", "alone")
    cells = stored.union(sent).repartition(blocks * LANES, "dim", "asked", "lane").sortWithinPartitions("dim", "asked", "lane", F.desc("is_query"), "h", "g")
    found = cells.mapInPandas(_searched({d: len(p) for d, p in pivots.items()}, k), "h long, g long, own long, alone boolean, score double, ids array<long>")
    each = found.select("h", "g", "own", "alone", "score", F.explode("ids").alias("id")).filter(~F.col("alone") | (F.col("id") != F.col("own")))
    best = each.withColumn("n", F.row_number().over(W.partitionBy("h", "g", "own", "alone").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k + 1)
    lists = saved(best.groupBy("h", "g", "own", "alone").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("near")), "nearest")
    own = asked.join(lists, ["h", "g", "own", "alone"])
    kept = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(kept).alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
