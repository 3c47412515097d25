"""Packing documents into sequences by cutting stock.

Every document is encoded once. What fills whole sequences leaves at once; the tails, all shorter than a sequence, are the items.
Their lengths are counted on Spark, and a linear program over that histogram (``cutting_stock``) says which lengths stand together
how often, in patterns that need no padding. Documents of one length are ranked, and each rank has its place: patterns take their
ranks in turn. Ranks that no pattern takes (the program's gap and what rounding leaves) follow each other, and are cut at the ends
of the sequences that they fill; the last of these is parted into powers of two. So no sequence is padded at all, and of the
documents that fit into a sequence only the few left over are cut.

Rows never gather by length: a length is split into buckets by hash and by place in the task, ranks are counted in a bucket, and
buckets add up (``BUCKET`` rows on average). The driver gets one row a length. Pieces need checksums of their ids; these are made
where the ids are, for the blocks that every document has wherever its tail goes, so that ids don't travel. Only tails that are cut
are encoded again: their texts are found by a broadcast of the keys, up to ``CUTS_BROADCAST`` of them, else by a join.

Defined results: a null text counts as empty, which has the end id alone; repeated rows are documents of their own; an empty table
has no pieces; columns beside key and text are not read, so that their names don't matter.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm import cutting_stock
from tidewire.llm.byte_vocabulary import byte_vocabulary
from tidewire.llm.shared import forget, saved

CAPACITY, END = 2048, 1
#: Rows that a bucket of a length holds on average, and buckets of a length at least.
BUCKET, LEAST_BUCKETS = 50_000, 16
#: Keys (of 16 bytes) of documents to be cut that are broadcast at most.
CUTS_BROADCAST = 100_000


def _row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` (doc, text) with 128 bits that tell rows apart; equal rows share them."""
    return docs.withColumn("k1", F.xxhash64("doc", "text")).withColumn("k2", F.xxhash64(F.lit(1), "text", "doc"))


def measured(docs: DataFrame, model: bytes, capacity: int, end: int) -> DataFrame:
    """(doc, k1, k2, nth, doc_tokens, tail, crcs) of (doc, text, k1, k2): one checksum for each full block and for the tail."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, nth = byte_vocabulary(shared.value), 0
        for batch in rows:
            n, crcs = [], []
            for ids in vocabulary.encode([t or "" for t in batch.column("text").to_pylist()], specials=True):
                packed = memoryview(array("I", [*ids, end])).cast("B")
                n.append(len(ids) + 1)
                crcs.append([zlib.crc32(packed[i : i + 4 * capacity]) for i in range(0, len(packed), 4 * capacity)])
            count = np.array(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("k1"), batch.column("k2"), pa.array(np.arange(nth, nth + len(n))), pa.array(count), pa.array((count % capacity).astype(np.int32)), pa.array(crcs, pa.list_(pa.int64()))],
                names=["doc", "k1", "k2", "nth", "doc_tokens", "tail", "crcs"],
            )
            nth += len(n)

    return docs.mapInArrow(batches, f"doc {kind}, k1 long, k2 long, nth long, doc_tokens long, tail int, crcs array<long>")


class Places:
    """Where each rank of each length goes."""

    def __init__(self, lengths: list, capacity: int) -> None:
        """``lengths``: rows (tail, n, full): documents with this tail, and how many full sequences they have."""
        counts = {r["tail"]: r["n"] for r in lengths if r["tail"]}
        used, sequence, rows = dict.fromkeys(counts, 0), 0, []
        for pattern, uses in cutting_stock.solved(counts, capacity):
            offset = 0
            for k, a in sorted(pattern.items(), reverse=True):
                rows.append((k, used[k], a, sequence, offset))
                used[k] += a * uses
                offset += a * k
            sequence += uses
        rows.sort()
        self.capacity = capacity
        table = np.array(rows or [(0, 0, 1, 0, 0)], np.int64)
        self.keys, self.times, self.sequence, self.offset = (table[:, 0] << 42) + table[:, 1], table[:, 2], table[:, 3], table[:, 4]
        # What is left over: for each length the first rank and the first position in one long row of tokens.
        self.used, self.at, total = np.zeros(capacity, np.int64), np.zeros(capacity, np.int64), 0
        for k in sorted(counts, reverse=True):
            self.used[k], self.at[k] = used[k], total
            total += k * (counts[k] - used[k])
        self.last = total - total % capacity
        ends = [self.last]
        for i in reversed(range(capacity.bit_length())):
            if total % capacity >> i & 1:
                ends.append(ends[-1] + (1 << i))
        self.ends = np.array(ends, np.int64)  # where the parted sequences begin and end
        self.first_rest, self.cuts = sequence, self.last // capacity + len(ends) - 1
        self.first_full, self.full = sequence + self.cuts, {}
        full = self.first_full
        for r in sorted(lengths, key=lambda r: r["tail"]):
            self.full[r["tail"]] = full
            full += r["full"]

    def rest(self, position: int) -> tuple[int, int, int]:
        """Of a position in the row of what is left over: its sequence, the offset there, and where that sequence ends."""
        if position < self.last:
            return self.first_rest + position // self.capacity, position % self.capacity, position - position % self.capacity + self.capacity
        i = int(np.searchsorted(self.ends, position, "right")) - 1
        return self.first_rest + self.last // self.capacity + i, position - int(self.ends[i]), int(self.ends[i + 1])

    def of(self, tails: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """For each tail its sequence and offset, and for those to be cut their parts (from, sequence, offset, length)."""
        entry = np.maximum(np.searchsorted(self.keys, (tails << 42) + ranks, "right") - 1, 0)
        inside = ranks - (self.keys[entry] & ((1 << 42) - 1))
        sequence, offset = self.sequence[entry] + inside // self.times[entry], self.offset[entry] + inside % self.times[entry] * tails
        cuts: list = [None] * len(tails)
        for i in np.flatnonzero((ranks >= self.used[tails]) & (tails > 0)).tolist():
            tail = int(tails[i])
            position, parts, start = int(self.at[tail] + (ranks[i] - self.used[tail]) * tail), [], 0
            while start < tail:
                at, o, end = self.rest(position + start)
                length = min(tail - start, end - position - start)
                parts.append({"from": start, "sequence": at, "offset": o, "length": length})
                start += length
            sequence[i], offset[i] = parts[0]["sequence"], parts[0]["offset"]
            if len(parts) > 1:
                cuts[i] = parts
        return sequence, offset, cuts


PART = "struct<from:int,sequence:long,offset:int,length:int>"


def placed(rows: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """``rows`` of ``measured`` with first_full, sequence, offset and cuts of their tails; and how many cuts there are at most."""
    most = rows.groupBy("tail").count().agg(F.max("count")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 16 ** math.ceil(math.log(max(most / BUCKET, 1), 16)))
    rows = rows.withColumn("bucket", F.pmod(F.col("k1") + F.col("nth"), F.lit(buckets)).cast("int")).withColumn("full", F.floor(F.col("doc_tokens") / capacity))
    sums = saved(rows.groupBy("tail", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "packing-buckets")
    places = Places(sums.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect(), capacity)  # ``capacity`` rows at most
    before = W.partitionBy("tail").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("tail", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"), F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full0"))
    inside = W.partitionBy("tail", "bucket").orderBy("k1", "k2", "nth")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).withColumn("before", F.sum("full").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("full"))
    ranked = ranked.join(offsets, ["tail", "bucket"]).select("doc", "k1", "k2", "doc_tokens", "tail", "crcs", (F.col("rank") + F.col("rank0")).alias("rank"), (F.col("before") + F.col("full0")).alias("before"))
    shared = rows.sparkSession.sparkContext.broadcast(places)  # a few thousand rows of numbers
    fields = rows.schema["doc"].dataType.simpleString()

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        part = pa.struct([("from", pa.int32()), ("sequence", pa.int64()), ("offset", pa.int32()), ("length", pa.int32())])
        for batch in some:
            tails = batch.column("tail").to_numpy().astype(np.int64)
            sequence, offset, cuts = p.of(tails, batch.column("rank").to_numpy())
            first = batch.column("before").to_numpy() + np.array([p.full[t] for t in tails.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc", "k1", "k2", "doc_tokens", "tail", "crcs")), pa.array(first), pa.array(sequence), pa.array(offset.astype(np.int32)), pa.array(cuts, pa.list_(part))],
                names=["doc", "k1", "k2", "doc_tokens", "tail", "crcs", "first_full", "sequence", "offset", "cuts"],
            )

    return ranked.mapInArrow(batches, f"doc {fields}, k1 long, k2 long, doc_tokens long, tail int, crcs array<long>, first_full long, sequence long, offset int, cuts array<{PART}>"), places.cuts


def cut_pieces(jobs: DataFrame, texts: DataFrame, model: bytes, capacity: int, end: int) -> DataFrame:
    """The pieces of cut tails, whose texts are encoded again; rows of one text follow each other, and it is encoded once."""
    shared = jobs.sparkSession.sparkContext.broadcast(model)
    kind = jobs.schema["doc"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known, packed = byte_vocabulary(shared.value), None, None
        for batch in rows:
            out = []
            for row in batch.to_pylist():
                if known != (row["k1"], row["k2"]):
                    ids = next(vocabulary.encode([row["text"] or ""], specials=True))
                    known, packed = (row["k1"], row["k2"]), memoryview(array("I", [*ids, end])).cast("B")
                base = row["doc_tokens"] - row["tail"]
                for p in row["cuts"]:
                    start = base + p["from"]
                    out.append((row["doc"], start, p["length"], zlib.crc32(packed[4 * start : 4 * (start + p["length"])]), row["doc_tokens"], p["sequence"], p["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((batch.schema.field("doc").type, *[pa.int64()] * 6))], names=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return jobs.join(texts.select("k1", "k2", "text"), ["k1", "k2"]).mapInArrow(batches, f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packed(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``model``: the content of a tokenizers file with a byte-level vocabulary; it is broadcast. ``end`` is the id after each document.
    """
    plain = _row_keys(docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")))
    once = saved(measured(plain, model, capacity, end), "packing-measured")
    rows, cuts = placed(once, capacity)
    rows = saved(rows, "packing-placed")
    forget(once)
    block = F.posexplode("crcs").alias("block", "ids_crc32")
    tail = F.col("block") * capacity + F.col("tail") == F.col("doc_tokens")
    whole = rows.select("*", block).withColumn("is_tail", tail & (F.col("tail") > 0)).filter(~F.col("is_tail") | F.col("cuts").isNull())
    whole = whole.select(
        "doc", (F.col("block").cast("long") * capacity).alias("start"), F.when(F.col("is_tail"), F.col("tail")).otherwise(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        F.when(F.col("is_tail"), F.col("sequence")).otherwise(F.col("first_full") + F.col("block")).alias("sequence_id"), F.when(F.col("is_tail"), F.col("offset")).otherwise(0).cast("long").alias("offset"),
    )
    jobs = rows.filter("cuts is not null").select("doc", "k1", "k2", "doc_tokens", "tail", "cuts")
    if cuts <= CUTS_BROADCAST:
        plain = plain.join(F.broadcast(jobs.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi")
    return whole.union(cut_pieces(jobs, plain.dropDuplicates(["k1", "k2"]), model, capacity, end)).withColumnRenamed("doc", key)


def sequences(docs: DataFrame, pieces: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from ``pieces`` of ``packed`` over documents with unique keys."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [[*i, end] for i in byte_vocabulary(shared.value).encode(texts, specials=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "all_ids"])

    encoded = docs.select(key, text).mapInArrow(batches, f"`{key}` {kind}, all_ids array<int>")
    own = pieces.join(encoded, pieces[key].eqNullSafe(encoded[key])).select("sequence_id", F.struct("offset", F.slice("all_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")).alias("piece"))
    return own.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["ids"])).alias("ids"))
