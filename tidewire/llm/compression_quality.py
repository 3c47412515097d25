"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained from blocks of labelled text. A text is cut into blocks of ``BLOCK`` bytes (the whole text, every
block), each block is compressed with either dictionary, and the difference of the summed sizes, divided by their sum, says
which side the text resembles. A logistic curve over that difference, fitted on labelled rows that the dictionaries didn't see,
turns it into a probability.

Fitting takes bounded samples of the labelled rows (``BLOCKS`` blocks a class for the dictionaries, ``ROWS`` rows for the
calibration), the first by a hash, and only from rows the caller passes for learning; scoring covers all texts.

Defined results: null and empty texts are scored as a text without any block, so all get one and the same score; without
labelled rows of both classes every score is the share of label 1 among the labelled (0.5 without any); repeated rows get
equal scores; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.shared import forget, free_name, saved

#: Bytes of a block; blocks of a class that train its dictionary, and bytes of a dictionary; rows that calibrate.
BLOCK, BLOCKS, DICTIONARY, ROWS = 256, 8192, 64 * 1024, 20_000
#: Labelled rows that fitting looks at, at most: their ids are broadcast.
LABELLED = 2 * ROWS
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries (None: no text of that class), the mean and scale of the difference, and the slope and constant of the curve."""

    good: bytes | None
    bad: bytes | None
    shift: float
    scale: float
    slope: float
    constant: float


def blocks(text: str | None) -> list[bytes]:
    """The text's UTF-8 bytes in blocks, the last one shorter."""
    data = (text or "").encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Sizes:
    """Compressed sizes of blocks under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        found = (zstandard.ZstdCompressionDict(d) for d in (good, bad))
        self.by = []
        for d in found:
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """The normalised difference of the sizes: positive where the text is nearer to good ones, 0 without a block."""
        parts = blocks(text)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.by)
        return (bad - good) / (bad + good) if parts else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of few samples, their bytes themselves serve as one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:] or b"\0"


def differences(text: Column, good: bytes, bad: bytes, spark: SparkSession) -> Column:
    """The normalised difference of each text's compressed sizes, in Arrow batches."""
    shared = spark.sparkContext.broadcast((good, bad))

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = Sizes(*shared.value)
        for part in texts:
            yield pd.Series([sizes.difference(t) for t in part], dtype="float64")

    return of(text)


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label") -> DataFrame:
    """(key, text, label) of the first ``LABELLED`` labels by a hash of their key, written to the shared folder.

    The labels' keys are a table of bounded size and are broadcast, so that the texts stay where they are.
    """
    chosen = labels.select(F.col(key).alias("label_key"), F.col(label).alias(label)).orderBy(F.xxhash64(F.col("label_key")), "label_key", label).limit(LABELLED)
    found = docs.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("label_key")).drop("label_key")
    return saved(found, "labelled")


def fit(labelled: DataFrame, text: str = "text", label: str = "label", order: str = "doc_id") -> Model:
    """A model of (text, label 0 or 1) rows, given in full; ``order`` is hashed for which rows make the bounded samples.

    Half of the rows, by another hash, are for the dictionaries, and the others calibrate.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col(order), F.col(text)).alias("h")).filter("label in (0, 1)")
    shares = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    dull = Model(None, None, 0.0, 1.0, 0.0, math.log((n1 + 0.5) / (n0 + 0.5)) if n0 + n1 else 0.0)
    if not n0 or not n1:
        return dull
    cut = F.expr(f"transform(sequence(0, greatest(0, (octet_length(text) - 1) div {BLOCK})), i -> substring(cast(text as binary), i * {BLOCK} + 1, {BLOCK}))")
    half = F.pmod(F.col("h"), F.lit(2))
    once = rows.dropDuplicates(["h", "label"])  # a repeated row gives its blocks once
    pieces = saved(once.filter((half == 0) & (F.length("text") > 0)).select("label", F.posexplode(cut).alias("i", "block"), "h").withColumn("order", F.xxhash64("h", "i")), "blocks")
    found = {r["label"]: r["n"] for r in pieces.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        return dull
    chosen = {k: [bytes(r["block"]) for r in _first(pieces.filter(F.col("label") == k), n, BLOCKS, ["order", "h", "i"]).select("block").collect()] for k, n in found.items()}
    forget(pieces)
    good, bad = _dictionary(chosen[1]), _dictionary(chosen[0])
    held = rows.filter(half == 1).orderBy("h").limit(ROWS)
    seen = held.select("label", differences(F.col("text"), good, bad, labelled.sparkSession).alias("difference")).toPandas()
    x, y = seen["difference"].to_numpy(), seen["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return dull
    shift, scale = float(x.mean()), float(x.std()) + 1e-9
    slope, constant = map(float, _logistic((x[:, None] - shift) / scale, y))
    return Model(good, bad, shift, scale, slope, constant)


def _first(rows: DataFrame, n: int, most: int, order: list[str]) -> DataFrame:
    """The first ``most`` of ``n`` rows by a hash and what breaks its ties.

    Rows far beyond what the first ones can reach in the hash are left out before, so that each task hands over its share only.
    """
    share = min(1.0, 2.0 * most / n + 64.0 / n)
    if share < 1:
        near = rows.filter(F.col(order[0]) <= int(share * (1 << 64)) - (1 << 63) - 1)
        if near.limit(most).count() == most:
            return near.orderBy(*order).limit(most)
    return rows.orderBy(*order).limit(most)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text, in Arrow batches and without a shuffle."""
    name = free_name(docs, score)
    if model.good is None or model.bad is None:
        return docs.withColumn(name, F.lit(1 / (1 + math.exp(-model.constant))))
    difference = differences(F.col(text), model.good, model.bad, docs.sparkSession)
    logit = (F.col(name) - F.lit(model.shift)) / F.lit(model.scale) * F.lit(model.slope) + F.lit(model.constant)
    return docs.withColumn(name, difference).withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
