"""Aligning the tokens of two tokenizers, by white-space anchors.

A text is encoded as a whole by both: byte-level pieces (A, over a space and the text) and word-mark pieces (B, which adds the space
itself). Where a token of each ends at the same byte and the next token of each is marked with a space, the text is cut into
windows, each a tuple of A ids and a tuple of B ids. The same windows come back all the time, so what is found in one is kept by its
tuples (and for a window that is new, what was found in its groups): the groups (between byte offsets where both sides end), the links (all pairs of A and B tokens of a group), and the check
that both sides spell the same bytes. A document is the sequence of its windows; their bytes, joined, must be the space and the text.

How many documents hold a pair of ids linked is counted over the corpus. Links don't travel: a task deals with its documents in
blocks (``BLOCK_CHARS``), counts each pair of a block once a document, and writes for each document which of the block's pairs it
has, as packed numbers. Pairs of blocks, not links of documents, are summed by pair, and the sums go back to their blocks, where a
document's figures are added up. A block has bounded text, whatever the corpus and its keys, and a pair has one row a block.

Defined results: texts that are null or empty, or that one side doesn't spell byte by byte (those that hold the word mark itself),
have no tokens: zeros and the empty string. Strings of special tokens are plain text. Repeated rows are documents of their own; an
empty table gives no rows; columns beside key and text are not read by ``counted``, and pass through ``aligned``.
"""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.byte_vocabulary import byte_vocabulary
from tidewire.llm.sentencepiece_agenda import MARK
from tidewire.llm.shared import free_name, saved

#: Characters of text after which a block ends; windows that a worker keeps at most (it bounds memory, and changes no result).
BLOCK_CHARS, KEPT_WINDOWS = 8_000_000, 50_000
#: Pairs in a row of a block; texts that are encoded at a time; links of a window from which equal ones are counted, not listed.
PAIRS_A_ROW, TEXTS_AT_ONCE, MANY_LINKS = 16_384, 256, 4_096
#: A pair of ids is one number: the A id, and the B id in the lower bits.
SHIFT = 20

ONCE = array("q", [1]).tobytes()
#: What is added to an id of A where ids of both sides are packed together.
OF_A = 1 << 30

#: What is known of a window: its bytes, numbers of groups and links, the groups as text, the pairs of its links (packed), and how
#: often each of them is linked, where that isn't once a pair.
Window = tuple[bytes, int, int, str, bytes, bytes | None]


class Aligner:
    def __init__(self, byte_model: bytes, piece_model: bytes) -> None:
        import sentencepiece

        self.a = byte_vocabulary(byte_model)
        self.b = lib = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes = [self.a.bytes.get(i, b"") for i in range(max(self.a.bytes) + 1)]
        self.a_size, self.b_size = (np.array([len(x) for x in some], np.int64) for some in (self.a_bytes, self.b_bytes))
        self.a_marked, self.b_marked = np.array([x.startswith(b" ") for x in self.a_bytes]), np.array([p.startswith(MARK) for p in pieces])
        # By packed ids (those of A are flagged): windows seen twice, windows seen once, groups.
        self.known: dict[bytes, Window | bool] = {}
        self.seen: set[bytes] = set()
        self.groups: dict[bytes, Window | bool] = {}
        self.kept = KEPT_WINDOWS

    def group(self, key: bytes) -> Window | bool:
        """A group as a window of its own; False where its sides don't spell the same bytes."""
        ids = array("I", key).tolist()
        a, b = [x - OF_A for x in ids if x >= OF_A], [x for x in ids if x < OF_A]
        spelled = b"".join([self.a_bytes[x] for x in a])
        if spelled != b"".join([self.b_bytes[x] for x in b]):
            return False
        text, n_links = f"{','.join(map(str, a))}|{','.join(map(str, b))}", len(a) * len(b)
        if n_links < MANY_LINKS:
            return spelled, 1, n_links, text, array("q", [x << SHIFT | y for x in a for y in b]).tobytes(), None
        times_b = Counter(b).items()
        counted = {x << SHIFT | y: m * n for x, m in Counter(a).items() for y, n in times_b}
        return spelled, 1, n_links, text, array("q", counted).tobytes(), array("q", counted.values()).tobytes()

    def new_group(self, key: bytes) -> Window | bool:
        if len(self.groups) >= self.kept:
            self.groups.clear()
        g = self.groups[key] = self.group(key)
        return g

    def look(self, key: bytes, parts: list[Window | bool]) -> None:
        """A window that isn't known is kept when it is seen again, while a task has room: frequent windows come early."""
        if key in self.seen:
            self.known[key] = self.window(parts)
        else:
            if len(self.seen) >= 8 * self.kept:
                self.seen.clear()
            self.seen.add(key)

    def window(self, parts: list[Window | bool]) -> Window | bool:
        """The alignment of a window from its groups; False where one of them has none."""
        if len(parts) == 1:
            return parts[0]
        if False in parts:
            return False
        spelled, n, links, texts, codes, times = zip(*parts)
        often = b"".join([t or ONCE * (len(c) // 8) for c, t in zip(codes, times)]) if any(times) else None
        return b"".join(spelled), len(n), sum(links), ";".join(texts), b"".join(codes), often

    def text(self, text: str | None, ids_a: list[int]) -> tuple[int, int, list[Window]] | None:
        """Numbers of tokens of both sides, and the windows (or their groups); None without tokens. ``ids_a``: those of a space and the text."""
        if not text:
            return None
        raw = f" {text}".encode()
        a, b = (np.frombuffer(array("I", ids), np.uint32) for ids in (ids_a, self.b.encode(text)))
        end_a, end_b = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        if end_a[-1] != len(raw) or end_b[-1] != len(raw):
            return None
        # Where both sides end, the groups end; where the next tokens of both are marked as well, the windows do.
        at = end_a.searchsorted(end_b)
        shared = np.flatnonzero(end_a[at] == end_b)
        stop_a, stop_b = at[shared] + 1, shared + 1
        anchors = np.flatnonzero(self.a_marked[a[stop_a[:-1]]] & self.b_marked[b[stop_b[:-1]]])
        # The ids group by group, those of A before those of B, so that a window or group is one stretch of bytes.
        stops = stop_a + stop_b
        of_a = np.zeros(len(a) + len(b), np.int8)  # 1 where a token of A stands: from the end of a group on, until its tokens of A end
        of_a[stops[:-1]] = 1
        of_a[0] = 1
        of_a[stops - np.diff(stop_b, prepend=0)] -= 1
        of_a = of_a.cumsum(dtype=np.int8).view(bool)
        both = np.empty(len(of_a), np.uint32)
        both[of_a], both[~of_a] = a + OF_A, b
        packed, ends = both.tobytes(), [0, *(stops * both.itemsize).tolist()]
        first = [0, *(anchors + 1).tolist(), len(shared)]
        bounds = [ends[i] for i in first]
        keys = [packed[i:j] for i, j in zip(bounds, bounds[1:])]
        found = list(map(self.known.get, keys))
        if None in found:
            every: list[Window | bool] = []
            get, room = self.groups.get, len(self.known) < self.kept
            for key, w, i, j in zip(keys, found, first, first[1:]):
                if w is not None:
                    every.append(w)
                    continue
                own = [packed[x:y] for x, y in zip(ends[i:j], ends[i + 1 : j + 1])]
                parts = list(map(get, own))
                if None in parts:
                    parts = [g or self.new_group(k) for g, k in zip(parts, own)]
                every += parts
                if room:
                    self.look(key, parts)
            found = every
        if False in found:
            return None
        return (len(a), len(b), found) if b"".join([w[0] for w in found]) == raw else None

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, list[Window]] | None]:
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            some = texts[start : start + TEXTS_AT_ONCE]
            for text, ids in zip(some, self.a.encode([f" {t or ''}" for t in some])):
                yield self.text(text, ids)


_aligners: dict[tuple[bytes, bytes], Aligner] = {}


def aligner(byte_model: bytes, piece_model: bytes) -> Aligner:
    """The aligner of these two models; a worker builds it once."""
    if (byte_model, piece_model) not in _aligners:
        _aligners.clear()
        _aligners[byte_model, piece_model] = Aligner(byte_model, piece_model)
    return _aligners[byte_model, piece_model]


def aligned(docs: DataFrame, byte_model: bytes, piece_model: bytes, text: str = "text", groups: str = "groups") -> DataFrame:
    """``docs`` with the groups of each text as ``a1,a2|b1;a3|b2,b3`` (A and B ids in order). There is no shuffle."""
    shared, groups = docs.sparkSession.sparkContext.broadcast((byte_model, piece_model)), free_name(docs, groups)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{groups}` string"])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*shared.value)
        for batch in rows:
            made = [";".join([w[3] for w in t[2]]) if t else "" for t in own.texts(batch.column(batch.schema.get_field_index(text)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, groups])

    return docs.mapInArrow(batches, fields)


class Block:
    """The documents of a block, each with its distinct pairs and how often each is linked in it."""

    def __init__(self, number: int) -> None:
        self.number, self.chars, self.docs, self.pairs, self.times = number, 0, [], [], []

    def add(self, doc: object, text: str | None, found: tuple[int, int, list[Window]] | None) -> None:
        self.chars += len(text or "")
        if not found:
            self.docs.append((doc, 0, 0, 0, 0, ""))
            self.pairs.append(np.zeros(0, np.int64))
            self.times.append(np.zeros(0, np.uint32))
            return
        n_a, n_b, windows = found
        _, groups, links, texts, packed, counted = zip(*windows)
        codes = np.frombuffer(b"".join(packed), np.int64)
        if any(counted):
            often = np.frombuffer(b"".join([t or ONCE * (len(c) // 8) for c, t in zip(packed, counted)]), np.int64)
            distinct, place = np.unique(codes, return_inverse=True)
            times = np.bincount(place, often).astype(np.uint32)
        else:
            distinct, times = np.unique(codes, return_counts=True)
        digest = hashlib.sha256(";".join(texts).encode()).hexdigest()
        self.docs.append((doc, n_a, n_b, sum(groups), sum(links), digest))
        self.pairs.append(distinct)
        self.times.append(times.astype(np.uint32))

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A row for each document, with the numbers that its pairs have in the block, then the pairs of the block."""
        codes, place = np.unique(np.concatenate(self.pairs), return_inverse=True)
        counts, place = np.bincount(place, minlength=len(codes)), place.astype(np.uint32)
        ends = np.cumsum([len(x) for x in self.pairs])
        packed = [(planes(np.diff(place[e - len(t) : e], prepend=np.uint32(0))), planes(t)) for e, t in zip(ends.tolist(), self.times)]
        columns, n = [*zip(*[(*d, *x) for d, x in zip(self.docs, packed)])], len(self.docs)
        types = (kind, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())
        yield self._batch(n, [pa.array(c, t) for c, t in zip(columns, types)], [None] * n, [None] * n, kind)
        for start in range(0, len(codes), PAIRS_A_ROW):
            stop = start + PAIRS_A_ROW
            yield self._batch(1, None, [start], [[{"code": c, "n": k} for c, k in zip(codes[start:stop].tolist(), counts[start:stop].tolist())]], kind)

    def _batch(self, n: int, own: list | None, first: list, pairs: list, kind: pa.DataType) -> pa.RecordBatch:
        own = own or [pa.nulls(n, t) for t in (kind, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())]
        pair = pa.list_(pa.struct([("code", pa.int64()), ("n", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([self.number] * n, pa.int64()), *own, pa.array(first, pa.int32()), pa.array(pairs, pair)], names=NAMES)


NAMES = ["block", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "numbers", "times", "first", "pairs"]


def planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits byte by byte, all lowest bytes first: the zeros stand together."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def numbers_of(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def blocks(docs: DataFrame, byte_model: bytes, piece_model: bytes, block_chars: int, kept: int) -> DataFrame:
    """The rows of ``Block`` over (doc, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((byte_model, piece_model))
    kind = docs.schema["doc"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = aligner(*shared.value), TaskContext.get().partitionId() << 24
        own.kept, block = kept, Block(task)
        own.known.clear()
        gc.disable()  # what is made here has no cycles, and what is kept would be gone through again and again
        try:
            for batch in rows:
                kind_of_doc, texts = batch.schema.field(0).type, batch.column(1).to_pylist()
                for doc, text, found in zip(batch.column(0).to_pylist(), texts, own.texts(texts)):
                    block.add(doc, text, found)
                    if block.chars >= block_chars:
                        yield from block.rows(kind_of_doc)
                        block = Block(block.number + 1)
            if block.docs:
                yield from block.rows(kind_of_doc)
        finally:
            gc.enable()

    return docs.select("doc", "text").mapInArrow(batches, f"block long, doc {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, numbers binary, times binary, first int, pairs array<struct<code:long,n:long>>")


def counted(docs: DataFrame, byte_model: bytes, piece_model: bytes, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, kept: int = KEPT_WINDOWS) -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as many documents as any pair of its
    A id), count_sum (documents that hold the pair, summed over links), groups_sha256.
    """
    plain = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = plain.schema["doc"].dataType.simpleString()
    made = saved(blocks(plain, byte_model, piece_model, block_chars, kept), "alignment-blocks")
    pairs = made.filter("pairs is not null").select("block", "first", F.posexplode("pairs").alias("i", "pair")).select("block", (F.col("first") + F.col("i")).alias("at"), "pair.code", "pair.n")
    sums = pairs.groupBy("code").agg(F.sum("n").alias("total"))
    most = F.max("total").over(W.partitionBy(F.shiftright("code", SHIFT)))  # a window has as many rows as B has ids at most
    ranked = saved(sums.select("code", "total", (F.col("total") == most).alias("best")), "alignment-pairs")
    back = pairs.select("block", "at", "code").join(ranked, "code").select("block", "at", "total", "best")

    def summed(counts: pa.Table, own: pa.Table) -> pa.Table:
        totals, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        at = counts.column("at").to_numpy()
        totals[at], best[at] = counts.column("total").to_numpy(), counts.column("best").to_numpy()
        made = []
        for numbers, times in zip(own.column("numbers").to_pylist(), own.column("times").to_pylist()):
            ids, often = np.cumsum(numbers_of(numbers).astype(np.int64)), numbers_of(times).astype(np.int64)
            made.append((int(best[ids] @ often), int(totals[ids] @ often)))
        sums = [pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)]
        return pa.table([own.column(c) for c in NAMES[1:6]] + sums + [own.column("groups_sha256")], names=[*NAMES[1:6], "n_best", "count_sum", "groups_sha256"])

    rows = made.filter("pairs is null").select(F.col("block").alias("own_block"), *NAMES[1:9])
    out = back.groupBy("block").cogroup(rows.groupBy("own_block")).applyInArrow(summed, f"doc {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("doc", key)
