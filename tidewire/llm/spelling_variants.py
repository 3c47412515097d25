"""Spelling variants: Bloom-guided neighbourhoods.

The vocabulary is counted first, in each task before the shuffle. A word's neighbourhood is generated, not joined: every string
that one deletion or one replacement makes of it (an insertion is a deletion seen from the other word). Each generated edit is
probed against blocked Bloom filters of the vocabulary, sharded by length and broadcast: an edit asks the shard of its own length
for one 64-bit block. Only positives are written out as strings; they are shuffled to an exact join with the vocabulary, which
removes the false ones.

Edits are never built as strings to be probed. A word's hash is a polynomial in its code points, ``sum(c_i * P^i)`` modulo 2^64, so
that a replacement adds ``(d - c_i) * P^i``, and a deletion divides what follows by P (P is odd and has an inverse); whole arrays of
edits are hashed at once.

Bounds: the filters are cut into slices of ``SLICE`` blocks (one megabyte), each built in its own task, and at most
``SLICES_AT_ONCE`` of them are broadcast together; a larger vocabulary is probed in several rounds, each over the next slices. A word
has at most (length + 1) * 90 neighbours of one length, so no join key is hot. Forms grow tenfold from step to step, so the chains
that lead to roots have at most some twenty words, and doubling ends after a few rounds.

Defined results: a null text has no words; a null id stands as an empty one in what is hashed; repeated rows count again; an empty
table has no words. Only the two columns named are read, whatever else the table has.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shared import forget, saved

#: Words have so many code points and occur so often at least; a form occurs so many times as often as its word.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many, by its hash, loses a code point.
TYPOS = 31
LETTERS = "A-Za-zÀ-ÿ"
#: Blocks of 64 bits: two words a block on average, so many bits a word. Blocks in a slice, slices broadcast at once.
WORDS_A_BLOCK, BITS, SLICE, SLICES_AT_ONCE = 2, 6, 1 << 17, 64
#: Words of more code points share a shard.
LONGEST_SHARD = 64
#: Words that a task counts before it hands them on; edits that are probed at once.
COUNTED_AT_ONCE, EDITS_AT_ONCE = 300_000, 1_000_000

_U = np.uint64
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): the words of all texts and how often they occur, summed in each task first."""
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")  # greedy: a run of letters as a whole
    lower = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = defaultdict(int)

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])
            n.clear()
            return made

        for batch in rows:
            for doc, body in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for raw, times in Counter(run.findall(body.as_py() or "")).items():
                    word = raw.lower() if raw.isascii() else raw.translate(lower)
                    h = zlib.crc32(word.encode(), start)
                    if h % TYPOS == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    n[word] += times
                if len(n) > COUNTED_AT_ONCE:
                    yield given()
        if n:
            yield given()

    plain = docs.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))
    return plain.mapInArrow(batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of a polynomial hash, spread evenly."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def by_length(words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of one length together, with their code points as rows; as many as make a bounded array."""
    groups: dict[int, list[str]] = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    for length, some in groups.items():
        step = max(1, EDITS_AT_ONCE // (100 * length))
        for i in range(0, len(some), step):
            part = some[i : i + step]
            yield part, np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), length).astype(_U)


def powers(length: int) -> np.ndarray:
    out = np.full(length, PRIME, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def shard(length: int) -> int:
    return min(length, LONGEST_SHARD + 1)


def address(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a mixed hash, among ``blocks`` (below 2^32)."""
    return ((h >> _U(32)) * _U(blocks)) >> _U(32)


def bits(h: np.ndarray) -> np.ndarray:
    mask = np.zeros_like(h)
    for i in range(BITS):
        mask |= _U(1) << ((h >> _U(6 * i)) & _U(63))
    return mask


def slices(words: DataFrame, blocks: dict[int, int], size: int) -> DataFrame:
    """(shard, slice, filter): the filters of the vocabulary, a slice of ``size`` blocks in each row, built in its own task."""

    def placed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, codes in by_length(batch.column(0).to_pylist()):
                s = shard(codes.shape[1])
                h = mixed((codes * powers(codes.shape[1])).sum(axis=1, dtype=_U))
                at = address(h, blocks[s]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), s, np.int32)), pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(bits(h).view(np.int64))], names=["shard", "slice", "at", "mask"])

    def built(key: tuple, rows: pa.Table) -> pa.Table:
        s, i = key[0].as_py(), key[1].as_py()
        filled = np.zeros(min(size, blocks[s] - i * size), _U)
        np.bitwise_or.at(filled, rows.column("at").to_numpy(), rows.column("mask").to_numpy().view(_U))
        return pa.table({"shard": pa.array([s], pa.int32()), "slice": pa.array([i], pa.int32()), "filter": pa.array([filled.tobytes()], pa.binary())})

    return words.select("word").mapInArrow(placed, "shard int, slice int, at int, mask long").groupBy("shard", "slice").applyInArrow(built, "shard int, slice int, filter binary")


class Filters:
    """The broadcast slices of one round: for each shard the blocks it has in all, and those that stand here."""

    def __init__(self, blocks: dict[int, int], size: int, rows: list) -> None:
        self.blocks, self.here = blocks, {}
        for s in {r["shard"] for r in rows}:
            own = sorted((r["slice"], bytes(r["filter"])) for r in rows if r["shard"] == s)
            first = own[0][0] * size
            cells = np.frombuffer(b"".join(f for _, f in own), _U)  # a round takes consecutive slices
            self.here[s] = (first, cells)

    def hits(self, h: np.ndarray, length: int) -> np.ndarray:
        """The indices of those hashes that may be words of ``length``."""
        first, cells = self.here[shard(length)]
        h = mixed(h)
        at = address(h, self.blocks[shard(length)]).astype(np.int64) - first
        near = np.flatnonzero((at >= 0) & (at < len(cells))) if first or len(cells) < self.blocks[shard(length)] else np.arange(len(h))
        near = near[(cells[at[near]] >> (h[near] & _U(63))) & _U(1) == 1]  # most go by their first bit
        mask = bits(h[near])
        return near[cells[at[near]] & mask == mask]


def edits(words: list[str], codes: np.ndarray, alphabet: np.ndarray, filters: Filters, least_length: int) -> Iterator[tuple[int, str, bool]]:
    """(index of the word, edit, is a deletion) of the edits that pass the filters."""
    k, length = codes.shape
    p = powers(length)
    terms = codes * p
    total = terms.sum(axis=1, dtype=_U)
    if shard(length) in filters.here:
        for i in range(length):
            rest = total - terms[:, i]
            h = (rest[:, None] + (alphabet * p[i])[None, :]).ravel()
            found = filters.hits(h, length)
            for row, c in zip((found // len(alphabet)).tolist(), alphabet[found % len(alphabet)].tolist()):
                if c != codes[row, i]:
                    w = words[row]
                    yield row, w[:i] + chr(c) + w[i + 1 :], False
    if length > least_length and shard(length - 1) in filters.here:
        before = np.zeros(k, _U)
        for i in range(length):
            after = total - before - terms[:, i]
            found = filters.hits(before + after * _U(INVERSE), length - 1)
            for row in found.tolist():
                w = words[row]
                if i == 0 or w[i - 1] != w[i]:  # of equal neighbours the first is taken
                    yield row, w[:i] + w[i + 1 :], True
            before = before + terms[:, i]


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH, size: int = SLICE, at_once: int = SLICES_AT_ONCE) -> DataFrame:
    """(word, near, near_n) for every two of ``words`` (word, n) that one insertion, deletion or replacement tells apart, both ways.

    ``words`` is read several times, so it should be a written table of distinct words.
    """
    spark = words.sparkSession
    sizes = words.groupBy(F.least(F.length("word"), F.lit(LONGEST_SHARD + 1)).alias("shard")).count().collect()  # 65 rows at most
    blocks = {r["shard"]: -(-r["count"] // WORDS_A_BLOCK) for r in sizes}
    # The letters of a vocabulary: 90 at most for runs of LETTERS.
    alphabet = np.array([ord(r["c"]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().filter("c != ''").collect()], _U)
    filters = saved(slices(words, blocks, size), "spelling-filters")
    every = [(s, i) for s in sorted(blocks) for i in range(-(-blocks[s] // size))]
    rounds = []
    for start in range(0, len(every), at_once):
        first, last = every[start], every[min(start + at_once, len(every)) - 1]
        here = (F.struct("shard", "slice") >= F.struct(F.lit(first[0]), F.lit(first[1]))) & (F.struct("shard", "slice") <= F.struct(F.lit(last[0]), F.lit(last[1])))
        shared = spark.sparkContext.broadcast(Filters(blocks, size, filters.filter(here).collect()))

        def probed(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                every_word, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                count = dict(zip(every_word, times))
                for part, codes in by_length(every_word):
                    found = list(edits(part, codes, alphabet, shared.value, least_length))
                    own = [part[row] for row, _, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([count[w] for w in own], pa.int64()), pa.array([e for _, e, _ in found], pa.string()), pa.array([d for _, _, d in found], pa.bool_())], names=["word", "n", "edit", "deletion"])

        asked = words.filter(F.length("word").between(first[0], last[0] + 1 if last[0] < LONGEST_SHARD else 2**31 - 1))
        rounds.append(saved(asked.select("word", "n").mapInArrow(probed, "word string, n long, edit string, deletion boolean"), "spelling-positives"))
        shared.unpersist()
    forget(filters)
    if not rounds:
        return words.select("word", F.lit("").alias("near"), F.col("n").alias("near_n")).limit(0)
    positives = rounds[0]
    for more in rounds[1:]:
        positives = positives.union(more)
    true = positives.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    there, back = (F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(c).alias("near_n")) for a, b, c in (("word", "edit", "edit_n"), ("edit", "word", "n")))
    return true.select(F.explode(F.when(F.col("deletion"), F.array(there, back)).otherwise(F.array(there))).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, twice as far in every round."""
    links = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = saved(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = bool(stepped.filter("moved").limit(1).count())
        if not moved:
            return stepped.select("word", "root")
        links = stepped.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word that occurs ``least_count`` times or more."""
    words = saved(counted(docs, key, text).filter(F.col("n") >= least_count), "spelling-words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    long_enough = -F.col("best.n") >= ratio * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(long_enough, F.col("best.form")).alias("form"), F.when(long_enough, -F.col("best.n")).alias("form_n"))
    formed = saved(formed, "spelling-forms")
    return formed.join(roots(formed.filter("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))
