"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight and so a target of words: sources share the budget by weight, a target stops at ``CAP`` times the
words its source has, and the excess is shared again by weight until none is above (water filling, found in closed form over
the sources sorted by cap per weight). A source meets its target by whole passes over its documents, and in the last pass by
the documents in the order of a hash of their id; the document in which the target is reached is cut there, so that each
source takes its target to the word.

Positions: over training time t in [0, 1] each source has a schedule, a rate of demand that changes linearly from
``1 + slope`` to ``1 - slope`` times its average (integral 1). The cumulative demand at t is the integral; a copy of a document
that takes the words [c, c + n) of its source gets the time at which the cumulative demand reaches their middle, which inverts
the integral. Documents are range-sorted by that position.

Prefix sums never gather a source in one task: documents fall into buckets by the first digits of their hash, more of them the
more rows there are, buckets are summed first (a table of sources x buckets at most), and a document adds its offset inside its
bucket. The plan is made over ids and sizes alone; texts join it once and are moved once more, into the order of positions. The
table of sources (a row each) is worked on in one task, so sources may number some millions: they are names of collections.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own, sorted last; repeated rows
are documents of their own, and ties in the hash (of the id, or of the text where that is null) are ordered by size, so that
reruns agree; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.shared import free_name, n_words, saved, settled

#: The mix takes so many times all words; a target is at most CAP times the words of its source.
BUDGET, CAP = 1.5, 2
#: The weights of the sources by code point, null last, repeating.
WEIGHTS = (3, 1, 2)
#: The least number of hexadecimal digits of the hash that make the buckets of a source, and the rows that a bucket holds on
#: average before there are more digits.
DIGITS, PER_BUCKET = 3, 50_000
#: How far the schedules swing around their average at both ends, for the sources in turn: early, steady, late.
SLOPES = (0.5, 0.0, -0.5)


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size, slot, target) of (source, source_size): one row a source, by water filling.

    With sources by cap per weight, those below the final level are a prefix: a source is capped exactly if its cap per weight
    isn't above what is then left, per weight then left.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("slot", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("slot") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    level = W.orderBy(F.col("cap") / F.col("weight"), "slot")
    before, everything = level.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    total = F.lit(float(budget)) * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = ranked.withColumn("level", left / weight_left).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("slot"), F.col("level").alias("at")))).over(everything)["at"]
    return filled.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final)).select("source", "source_size", "slot", "target")


def position(share: Column, slope: Column) -> Column:
    """The time t in [0, 1] at which a demand of rate ``1 + slope - 2 slope t`` has reached ``share``: its integral inverted.

    The integral is ``(1 + slope) t - slope t^2``; the root that stays finite at slope 0 is used.
    """
    b = F.lit(1.0) + slope
    return F.lit(2.0) * share / (b + F.sqrt(F.greatest(b * b - F.lit(4.0) * slope * share, F.lit(0.0))))


def hashed(key: Column, text: Column) -> Column:
    """What orders the documents of a source."""
    return F.md5(F.coalesce(key.cast("string"), text, F.lit("")).cast("binary"))


def digits(rows: int) -> int:
    return max(DIGITS, math.ceil(math.log(max(rows, 1) / PER_BUCKET, 16)))


def planned(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source_size, target, taken, passes (words that each pass takes) and positions, and the names they have.

    ``taken`` is the sum of ``passes``: ``CAP`` passes at most, whole ones first.
    """
    size, order = free_name(docs, "size"), free_name(docs, "order")
    return scheduled(docs.withColumn(size, n_words(F.col(text))).withColumn(order, hashed(F.col(key), F.col(text))), size, order, source)


def scheduled(docs: DataFrame, size_name: str, order: str, source: str, digits: int = DIGITS) -> tuple[DataFrame, dict[str, str]]:
    """``planned`` over rows that have their size and hash; the hash goes."""
    made = ("source_size", "target", "taken", "passes", "positions", "bucket", "slot", "offset", "before")
    n = {"size": size_name, "order": order} | {c: free_name(docs, c) for c in made}
    sized = docs.withColumn(n["bucket"], F.substring(n["order"], 1, digits))
    sums = saved(sized.groupBy(F.col(source).alias("source"), F.col(n["bucket"]).alias("bucket")).agg(F.sum(n["size"]).alias("words")), "mix-buckets")
    sources = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    offsets = sums.withColumn("offset", F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    plan = offsets.join(sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named", "words")
    plan = saved(plan.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), *[F.col(c).alias(n[c]) for c in ("source_size", "slot", "target")], F.coalesce("offset", F.lit(0)).alias(n["offset"])), "mix-plan")
    inside = W.partitionBy(source, n["bucket"]).orderBy(n["order"], n["size"]).rowsBetween(W.unboundedPreceding, -1)
    ordered = sized.withColumn(n["before"], F.coalesce(F.sum(n["size"]).over(inside), F.lit(0)))
    out = ordered.join(plan, ordered[source].eqNullSafe(plan["b_source"]) & (ordered[n["bucket"]] == plan["b_bucket"]), "left").drop("b_source", "b_bucket")
    size, total, want = F.col(n["size"]), F.col(n["source_size"]), F.round(F.col(n["target"])).cast("long")
    start = F.col(n["before"]) + F.col(n["offset"])
    passes = F.array(*[F.greatest(F.lit(0), F.least(size, want - total * i - start)).cast("long") for i in range(int(CAP))])
    slopes = F.element_at(F.array(*[F.lit(s) for s in SLOPES]), (F.col(n["slot"]) % len(SLOPES) + 1).cast("int"))
    out = out.withColumn(n["passes"], passes).withColumn(n["taken"], F.expr(f"aggregate(`{n['passes']}`, 0L, (a, x) -> a + x)"))
    middle = [F.when(F.col(n["passes"])[i] > 0, position((total * i + start + F.col(n["passes"])[i] / 2) / want, slopes)) for i in range(int(CAP))]
    out = out.withColumn(n["positions"], F.array(*middle))
    return out.drop(n["order"], n["bucket"], n["slot"], n["offset"], n["before"]), n


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits that tell rows apart by all columns that can be hashed; rows equal in these share them."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *reversed(columns))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: a row for each copy that is taken, with the columns of ``docs`` and ``position``, range-sorted by it.

    The copy in which a source reaches its target holds the first words that the mix still takes. The plan has no texts; it is
    joined with the distinct rows, and only the range sort moves texts again.
    """
    copies = settled(lambda: _copies(_plan(docs, key, text, source)), "mix-copies")
    copy, position_name = free_name(docs, "copy"), free_name(docs, "position")
    rows = _cut(docs, copies, text, copy)
    rows = rows.repartitionByRange(F.col(copy)["position"], F.col(key)).sortWithinPartitions(F.col(copy)["position"], F.col(key))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(copy)["position"].alias(position_name))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken, position) of each document: ``taken`` is counted in the texts of its copies in the
    mix, and rows stand in the order of training, each where its first copy does, those that the mix leaves out last."""

    def counted() -> DataFrame:
        plan = _plan(docs, key, text, source)
        copies = saved(_copies(plan), "mix-copies")
        rows = _cut(docs, copies, text, "copy").select("copy.row", n_words(F.col(text)).alias("words"), "copy.position")
        found = rows.groupBy("row").agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
        made = plan.select("row", F.col("key").alias(key), "size", "source_size", "target").join(found, "row", "left")
        return made.select(key, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "position")

    order = [F.col("position").asc_nulls_last(), F.col(key)]
    return settled(counted, "mix-digests").repartitionByRange(*order).sortWithinPartitions(*order)


def _plan(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(row, k1, k2, key, size, source_size, target, copies) of each row, written: ``copies`` has the words and position of each."""
    k1, k2 = row_keys(docs)
    size, order = n_words(F.col(text)).alias("size"), hashed(F.col(key), F.col(text)).alias("order")
    sizes = docs.select(F.monotonically_increasing_id().alias("row"), k1.alias("k1"), k2.alias("k2"), F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), size, order)
    sizes = saved(sizes, "mix-sizes")  # so that each row keeps its number
    plan, n = scheduled(sizes, "size", "order", "source", digits(sizes.count()))
    taken = F.filter(F.arrays_zip(F.col(n["passes"]).alias("words"), F.col(n["positions"]).alias("position")), lambda c: c["words"] > 0)
    return saved(plan.select("row", "k1", "k2", "key", "size", "source_size", "target", taken.alias("copies")), "mix-rows")


def _copies(plan: DataFrame) -> DataFrame:
    """(k1, k2, copy) of each copy that the mix takes of a row."""
    return plan.select("row", "k1", "k2", "size", F.explode("copies").alias("c")).select("k1", "k2", F.struct("row", "size", "c.words", "c.position").alias("copy"))


def _cut(docs: DataFrame, copies: DataFrame, text: str, copy_name: str) -> DataFrame:
    """The row of each copy with the text that it holds, in no order."""
    a, b = free_name(docs, "k1"), free_name(docs, "k2")
    k1, k2 = row_keys(docs)
    rows = docs.withColumn(a, k1).withColumn(b, k2).dropDuplicates([a, b])
    rows = rows.join(copies.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("copy").alias(copy_name)), [a, b]).drop(a, b)
    copy = F.col(copy_name)
    pieces = F.split(F.col(text), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # each word with the white space after it
    leading = F.when(F.col(text).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.array_join(F.slice(pieces, F.lit(1), copy["words"].cast("int") + leading), "")
    return rows.withColumn(text, F.when(copy["words"] == copy["size"], F.col(text)).otherwise(cut))
