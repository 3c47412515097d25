"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by a score-ordered agenda.

A text becomes symbols: a leading word mark, every space a word mark, and every other character itself. An agenda holds the
adjacent pairs whose concatenation is a piece; the pair with the best score, leftmost on ties, is merged first, and the pairs
beside it enter the agenda. What no piece covers falls back to its UTF-8 bytes.

No piece of such a vocabulary holds a word mark after another character (checked when the model is loaded), so merges never
cross from one word into the next: a text is encoded stretch by stretch, and a worker keeps the stretches it has already
encoded. Every new stretch of an Arrow batch is encoded by the sentencepiece library as well, and the ids are compared.

Defined results: a null text counts as empty; an empty text has the begin and end ids alone and decodes to the empty text;
repeated rows each get the same result; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.shared import free_name

MARK = "▁"
#: Stretches that a worker keeps at most; beyond it starts afresh. It bounds memory, and changes no result.
KEPT_STRETCHES = 600_000
#: Up to so many characters, a plain list is a faster agenda than a heap.
SHORT, NONE = 40, float("inf")
#: Stretches that go to the library in one text.
CHECKED = 200


class PieceModel:
    """A BPE vocabulary read from a model's bytes, with the stretches encoded so far."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in self.bytes}
        self.ranks = {p: -lib.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        if len(self.byte_ids) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids) or any(lib.is_unused(i) for i in range(size)):
            raise ValueError("a merge-type vocabulary with byte fallback, without unused pieces and with word marks at the front of pieces only is needed")
        self.plain = [p.replace(MARK, " ") for p in self.pieces]
        self.plain_ids = set(self.ids.values())
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.beside = {p[i : i + 2] for p in self.ranks for i in range(len(p) - 1)}
        # Runs of characters that stand in no longer piece are stretches of their own: nothing merges with them.
        joining = "".join(re.escape(c) for c in sorted({c for p in self.ranks for c in p} - {MARK}))
        self.stretch = re.compile(f"{MARK}+[{joining}]*|[{joining}]+|[^{joining}{MARK}]+")
        self.known: dict[str, tuple[bytes, str]] = {}

    def merged(self, text: str) -> list[str]:
        """The symbols that remain when the agenda is empty."""
        symbols, ranks = list(text), self.ranks
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for left in range(n - 1):
            if (rank := ranks.get(symbols[left] + symbols[left + 1])) is not None:
                agenda.append((rank, left, left + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != length:
                continue  # one of the two has been merged meanwhile
            symbols[left] += symbols[right]
            symbols[right] = ""
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                if (rank := ranks.get(symbols[left] + symbols[follow])) is not None:
                    heapq.heappush(agenda, (rank, left, follow, length + len(symbols[follow])))
            if (lead := before[left]) >= 0 and (rank := ranks.get(symbols[lead] + symbols[left])) is not None:
                heapq.heappush(agenda, (rank, lead, left, len(symbols[lead]) + length))
        return [s for s in symbols if s]

    def merged_short(self, text: str) -> list[str]:
        """The same for a short stretch, whose agenda is a plain list of the ranks of its pairs, searched for the first best one."""
        symbols, find = list(text), self.ranks.get
        agenda = [find(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NONE:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = find(symbols[i] + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = find(symbols[i - 1] + symbols[i], NONE)
        return symbols

    def stretch_ids(self, text: str) -> list[int]:
        ids, find = [], self.ids.get
        for symbol in self.merged_short(text) if len(text) <= SHORT else self.merged(text):
            if (i := find(symbol)) is not None:
                ids.append(i)
            else:
                ids.extend([self.byte_ids[b] for b in symbol.encode()])
        return ids

    def decoded(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, runs of byte pieces read as UTF-8, word marks as spaces."""
        if self.plain_ids.issuperset(ids):
            return "".join([self.plain[i] for i in ids])
        out, pending = [], bytearray()
        for i in ids:
            if (b := self.bytes.get(i)) is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            if i not in (self.begin, self.end):
                out.append(self.plain[i])
        out.append(pending.decode(errors="replace"))
        return "".join(out)

    def learn(self, stretches: set[str]) -> None:
        """Encode new stretches by the agenda, and check them against the library, all in one text with line ends between them."""
        if len(self.known) + len(stretches) > KEPT_STRETCHES:
            self.known.clear()
        new, known, beside = sorted(stretches), self.known, self.beside
        for s in new:
            # Two characters that stand side by side in no piece part the stretch: no merge ever joins them.
            cuts = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in beside]
            if not cuts:
                known[s] = self.row(self.stretch_ids(s))
                continue
            ids = []
            for start, stop in zip([0, *cuts], [*cuts, len(s)]):
                part = s[start:stop]
                if part not in known:
                    known[part] = self.row(self.stretch_ids(part))
                ids += array("I", known[part][0]).tolist()
            known[s] = self.row(ids)
        line_end = array("I", [self.byte_ids[10]]).tobytes()
        for start in range(0, len(new), CHECKED):
            some = new[start : start + CHECKED]
            ours = array("I", b"".join([line_end + known[s][0] for s in some])).tolist()
            if self.library.encode("\n" + "\n".join(some))[1:] != ours:
                odd = [s for s in some if self.library.encode("\n" + s)[2:] != array("I", known[s][0]).tolist()]
                raise ValueError(f"the agenda and the sentencepiece library differ on {odd[:3]!r}")

    def row(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), self.decoded(ids)

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, begin and end included, and its decoded text."""
        begin, end = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        for text in texts:
            if not text:
                yield begin + end, ""
                continue
            parts = self.stretch.findall(MARK + text.replace(" ", MARK))
            known = self.known
            if new := {s for s in parts if s not in known}:
                if len(known) + len(new) > KEPT_STRETCHES:
                    new = set(parts)
                self.learn(new)
            rows = [known[s] for s in parts]
            yield begin + b"".join([r[0] for r in rows]) + end, "".join([r[1] for r in rows]).removeprefix(" ")


_models: dict[bytes, PieceModel] = {}


def piece_model(model: bytes) -> PieceModel:
    """The model of these bytes; a worker builds it once."""
    if model not in _models:
        _models.clear()
        _models[model] = PieceModel(model)
    return _models[model]


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of ``text`` (array of int, with begin and end ids) and the text they decode to.

    ``model``: the bytes of a sentencepiece model of merge type with byte fallback; they are broadcast (half a megabyte).
    Whole texts are encoded, in Arrow batches; there is no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    ids, decoded = free_name(docs, ids), free_name(docs, decoded)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{ids}` array<int>", f"`{decoded}` string"])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(shared.value)
        for batch in rows:
            texts, start = batch.column(batch.schema.get_field_index(text)).to_pylist(), 0
            # A batch goes on in slices of bounded text, so that ids of many long texts never gather.
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars < 4_000_000):
                    chars += len(texts[stop] or "")
                    stop += 1
                packed, plain, offsets = [], [], [0]
                for b, t in m.encode(texts[start:stop]):
                    packed.append(b)
                    plain.append(t)
                    offsets.append(offsets[-1] + len(b) // 4)
                flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(plain, pa.string())], names=[*part.schema.names, ids, decoded])
                start = stop

    return docs.mapInArrow(batches, fields)


def digests(docs: DataFrame, model: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row its key, the number of ids, and the SHA-256 of the packed ids and of the decoded text.

    The digests are taken where the ids are made, so that ids of a whole corpus don't travel.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(shared.value)
        for batch in rows:
            made = [(len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for b, t in m.encode(v.as_py() for v in batch.column(1))]
            n, ids, plain = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(batches, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
