"""Removal of repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else, in another document or the same one.

1. Sparse suffixes. Each window of LENGTH bytes has an anchor: the position in it whose ``GRAM`` bytes have the least hash,
   leftmost on ties. Equal windows have their anchor at the same offset, so only suffixes at anchors need sorting (about one in
   185 bytes). Neighbouring windows share an anchor; its context is all the bytes of its windows. Anchors whose GRAM bytes
   occur once in the corpus can't repeat and are left out; contexts that occur several times inside one document are repeats
   already, and one of each stands for them. So do contexts that several documents hold, and one of each goes on, so that large
   groups of copies are as small as one document from here on. Only groups of anchors with equal GRAM bytes that hold two or
   more distinct contexts, one of them undecided, are sorted.
2. Sorted runs. Each task sorts its suffixes (the context from the anchor on, then the context before it read backwards) and
   cuts the run at splitters from a bounded sample; the pieces are exchanged front-coded: the length of the prefix shared with
   the string before, and the rest.
3. Merge. A range combines its pieces with a loser tree whose nodes know the common prefix of each loser with the last winner:
   the candidate with the longer one is smaller without a look at the bytes, and only beyond equal ones are bytes compared.
   Neighbours across ranges meet through the ranges' first and last strings.
4. Decision. The longest common prefix of a suffix with any other is that with a neighbour. The same sort over the contexts
   read backwards from the anchor gives the longest common part before it. The windows between these two bounds can repeat; those
   that a neighbour shares do. Where some in between stay open (one partner shares more before, another more after), they are
   compared by digest with the windows at the same offsets in their group of anchors; of windows that are known to be those of
   the string before, the first stands for all. So the answer is exact.

Defined results: a null or empty text, or one shorter than LENGTH, loses nothing; repeated rows are documents that repeat each
other; an empty table gives no rows; ids may be null or repeat; other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shared import forget, free_name, saved

#: Bytes of a string that may not repeat; bytes at an anchor; bytes of a text that are hashed at a time.
LENGTH, GRAM, CHUNK = 400, 32, 1 << 19
#: Suffixes of a range of the sort, how many splitter candidates are sampled for each range, and the most ranges (the sample
#: goes through the driver, some 3 kB a range); a larger corpus has larger ranges.
RANGE_ROWS, PER_RANGE, RANGES = 4096, 4, 16_384
#: A byte that UTF-8 never has ends the parts of a sort string; a reference (key, anchor, first and last window, hash,
#: and whether one document alone holds the context) ends it.
END, FIELDS, REFERENCE = b"\xff", ">qqqqqqq", 56


def keys(key: str, text: str) -> tuple[Column, Column]:
    """128 bits that tell rows apart by id and text; rows equal in both share them, and their result."""
    return F.xxhash64(F.col(key), F.col(text)), F.xxhash64(F.lit(1), F.col(text), F.col(key))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position."""
    n = len(data) - GRAM + 1
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(eight).view("<u8").ravel()
    h = np.zeros(n, dtype=np.uint64)
    for j in range(0, GRAM, 8):
        h = _mixed((h + words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
    return h


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash at the anchor) over all windows of one text, in order."""
    found: list[np.ndarray] = []
    body, last = np.frombuffer(data, dtype=np.uint8), len(data) - LENGTH
    width = LENGTH - GRAM + 1
    for at in range(0, last + 1, CHUNK):
        part = body[at : min(at + CHUNK, last + 1) + LENGTH - 1]
        h = _hashes(part)
        n = len(h) - width + 1
        rank = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
        padded = np.full(-(-len(h) // width) * width, ~np.uint64(0))
        padded[: len(h)] = rank
        padded = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        stops = np.concatenate((starts[1:], [n])) - 1
        a = place[starts]
        rows = np.stack([a + at, starts + at, stops + at, h[a].view(np.int64)])
        if found and found[-1][0, -1] == rows[0, 0]:  # the same anchor goes on beyond the chunk
            found[-1][2, -1], rows = rows[2, 0], rows[:, 1:]
        found.append(rows)
    if not found:
        return (np.empty(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(found, axis=1))


def digests(data: bytes, a: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128 bits of each context and of its anchor's place in it, as two columns of integers."""
    made = [hashlib.blake2b(data[i : j + LENGTH], digest_size=16, salt=k.to_bytes(4, "big")).digest() for i, j, k in zip(first.tolist(), last.tolist(), (a - first).tolist())]
    return np.frombuffer(b"".join(made), dtype="<i8").reshape(-1, 2)


def _inside(contexts: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which anchors stand for all with their context in this text, and the windows whose contexts occur several times in it."""
    _, at, inverse, counts = np.unique(contexts, axis=0, return_index=True, return_inverse=True, return_counts=True)
    stay = np.zeros(len(contexts), dtype=bool)
    stay[at] = True
    several = np.flatnonzero(counts[inverse.ravel()] > 1)
    return stay, [(int(first[i]), int(last[i]) + LENGTH) for i in several]


def joined_spans(spans) -> list[tuple[int, int]]:
    """Sorted, overlapping and touching [start, stop) spans made one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


_ANCHOR_ROW = "k1 long, k2 long, inside boolean, h long, c1 long, c2 long, a long, first long, last long"


def _anchor_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of anchors; where ``inside``, a row of bytes [first, last) that repeat inside the text."""
    for part in parts:
        keys_, sizes, insides, columns = [], [], [], []
        for k1, k2, text in zip(part["k1"], part["k2"], part["text"]):
            data = text.encode()
            if len(data) < LENGTH:
                continue
            a, first, last, h = anchors(data)
            contexts = digests(data, a, first, last)
            stay, repeated = _inside(contexts, first, last)
            columns.append(np.stack([h, *contexts.T, a, first, last])[:, stay])
            insides.append(False)
            if repeated := joined_spans(repeated):
                start, stop = np.array(repeated, dtype=np.int64).T
                columns.append(np.stack([start * 0] * 4 + [start, stop]))
                insides.append(True)
            for c in columns[len(sizes) :]:
                keys_.append((k1, k2))
                sizes.append(c.shape[1])
        if columns:
            k = np.repeat(np.array(keys_, dtype=np.int64), sizes, axis=0)
            h, c1, c2, a, first, last = np.concatenate(columns, axis=1)
            yield pd.DataFrame({"k1": k[:, 0], "k2": k[:, 1], "inside": np.repeat(insides, sizes), "h": h, "c1": c1, "c2": c2, "a": a, "first": first, "last": last})


def common(x: bytes, y: bytes, at: int = 0) -> int:
    """The length of the common prefix, of which ``at`` bytes are known."""
    n = min(len(x), len(y))
    while at < n:
        a, b = x[at : at + 64], y[at : at + 64]
        if a != b:
            size = min(len(a), len(b))
            if apart := int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big"):
                return at + size - (apart.bit_length() + 7) // 8
            return at + size
        at += 64
    return n


def front_coded(run: list[bytes]) -> bytes:
    """A sorted run: for each string the prefix it shares with the one before, the length of the rest, and the rest."""
    out, before = [], b""
    for s in run:
        n = common(before, s)
        out += (struct.pack(">II", n, len(s) - n), s[n:])
        before = s
    return b"".join(out)


def decoded(blob: bytes) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the string before, string) of a front-coded run."""
    at, s = 0, b""
    while at < len(blob):
        n, rest = struct.unpack_from(">II", blob, at)
        at += 8
        s = s[:n] + blob[at : at + rest]
        at += rest
        yield n, s


def merged(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the string before, string) over all runs in order, by a loser tree over common prefixes.

    A candidate is (prefix it shares with the last winner, string, run). Of two, the one that shares more is smaller, and what
    the loser shares with the winner is the lesser of the two; if both share as much, bytes from there on decide.
    """
    runs = [decoded(b) for b in blobs]
    size = 1 << max(0, len(runs) - 1).bit_length()
    nothing = (-1, None, -1)
    current = [nothing] * size
    for i, r in enumerate(runs):
        if (head := next(r, None)) is not None:
            current[i] = (0, head[1], i)

    def play(x, y):
        """Winner, loser."""
        if y[1] is None:
            return x, y
        if x[1] is None:
            return y, x
        if x[0] != y[0]:
            return (x, y) if x[0] > y[0] else (y, x)
        n = common(x[1], y[1], x[0])
        return (x, (n, y[1], y[2])) if x[1][n : n + 1] <= y[1][n : n + 1] else (y, (n, x[1], x[2]))

    losers, level = [nothing] * size, current
    nodes = {size + i: c for i, c in enumerate(level)}
    for node in range(size - 1, 0, -1):
        nodes[node], losers[node] = play(nodes[2 * node], nodes[2 * node + 1])
    winner = nodes[1]
    del nodes
    while winner[1] is not None:
        yield winner[0], winner[1]
        run = winner[2]
        head = next(runs[run], None)
        winner = nothing if head is None else (head[0], head[1], run)
        node = (size + run) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def sort_string(after: bytes, before: bytes, reference: bytes) -> bytes:
    return after + END + before + END + reference


def pair(x: bytes, y: bytes, n: int) -> tuple[int, int]:
    """What two sort strings with ``n`` common bytes share in their first and in their second part."""
    i, j = x.index(END), y.index(END)
    if n > i:  # the first parts are equal
        return i, min(n - i - 1, len(x) - i - 2 - REFERENCE, len(y) - i - 2 - REFERENCE)
    return min(n, i, j), common(x[i + 1 : -REFERENCE - 1], y[j + 1 : -REFERENCE - 1])


#: What ``side`` says of a row: the first and the last string of a range, or what a string shares with the one before or after.
LOW, HIGH, BEFORE, NEXT = 0, 1, 2, 3
_NEIGHBOUR = "rng int, side int, edge binary, k1 long, k2 long, a long, first long, last long, h long, alone long, x long, y long"


def _neighbours(blobs: pd.DataFrame) -> pd.DataFrame:
    """For each suffix of a range and each neighbour what they share; the range's first and last strings as edges."""
    rows, previous, rng = [], None, int(blobs["rng"].iloc[0])
    for n, s in merged([bytes(b) for b in blobs["run"]]):
        if previous is None:
            rows.append((rng, LOW, s, *struct.unpack(FIELDS, s[-REFERENCE:]), 0, 0))
        else:
            x, y = pair(previous, s, n)
            rows += ((rng, side, None, *struct.unpack(FIELDS, t[-REFERENCE:]), x, y) for side, t in ((NEXT, previous), (BEFORE, s)))
        previous = s
    if previous is not None:
        rows.append((rng, HIGH, previous, *struct.unpack(FIELDS, previous[-REFERENCE:]), 0, 0))
    return pd.DataFrame(rows, columns=["rng", "side", "edge", "k1", "k2", "a", "first", "last", "h", "alone", "x", "y"])


def neighbours(contexts: DataFrame, backwards: bool) -> tuple[DataFrame, DataFrame]:
    """The table that was written, and of it (k1, k2, a, first, last, h, alone, r, l, previous) for each suffix and each neighbour in the
    sorted order: bytes shared after and before the anchor, and whether the neighbour is the one before in the forward order.
    ``backwards`` sorts by the context before the anchor first.
    """
    first, second = ("before", "after") if backwards else ("after", "before")
    whole = F.concat(F.col(first), F.lit(END), F.col(second), F.lit(END), F.col("reference"))
    strings = contexts.select(whole.alias("s"))
    n = contexts.count()
    ranges = min(RANGES, max(1, -(-n // RANGE_ROWS)))
    # The splitters: strings whose hash falls into a share that gives about PER_RANGE for each range.
    share = max(1, n // (ranges * PER_RANGE))
    sample = sorted(bytes(r["s"]) for r in strings.filter(F.pmod(F.xxhash64("s"), F.lit(share)) == 0).collect())
    splitters = sample[:: max(1, len(sample) // ranges)]
    shared = contexts.sparkSession.sparkContext.broadcast(splitters)

    def runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = shared.value
        for part in parts:
            run = sorted(map(bytes, part["s"]))
            pieces: dict[int, list[bytes]] = {}
            for s in run:
                pieces.setdefault(max(0, bisect_right(cuts, s) - 1), []).append(s)
            yield pd.DataFrame({"rng": list(pieces), "run": [front_coded(p) for p in pieces.values()]})

    exchanged = strings.mapInPandas(runs, "rng int, run binary").groupBy("rng").applyInPandas(_neighbours, _NEIGHBOUR)
    found = saved(exchanged, "neighbours")
    ends = found.filter(F.col("side") == HIGH).select(F.col("rng").alias("next"), F.col("edge").alias("low"))
    starts = found.filter(F.col("side") == LOW).select((F.col("rng") - 1).alias("next"), F.col("edge").alias("high"))

    def across(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for low, high in zip(part["low"], part["high"]):
                low, high = bytes(low), bytes(high)
                x, y = pair(low, high, common(low, high))
                rows += ((side, *struct.unpack(FIELDS, s[-REFERENCE:]), x, y) for side, s in ((NEXT, low), (BEFORE, high)))
            yield pd.DataFrame(rows, columns=["side", "k1", "k2", "a", "first", "last", "h", "alone", "x", "y"])

    edges = ends.join(starts, "next").select("low", "high").mapInPandas(across, "side int, k1 long, k2 long, a long, first long, last long, h long, alone long, x long, y long")
    pairs = found.filter(F.col("side") >= BEFORE).select("side", "k1", "k2", "a", "first", "last", "h", "alone", "x", "y").union(edges)
    previous = F.lit(False) if backwards else F.col("side") == BEFORE
    return found, pairs.select("k1", "k2", "a", "first", "last", "h", "alone", *[F.col(x).alias(c) for x, c in zip("yx" if backwards else "xy", "rl")], previous.alias("previous"))


_CONTEXT = "h long, k1 long, k2 long, a long, first long, after binary, before binary, reference binary"


def _contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["h", "k1", "k2", "a", "first", "after", "before", "reference"]
    for part in parts:
        rows = []
        for k1, k2, text, places in zip(part["k1"], part["k2"], part["text"], part["places"]):
            data = text.encode()
            for p in places:
                h, a, first, last, alone = (p[c] for c in ("h", "a", "first", "last", "alone"))
                rows.append((h, k1, k2, a, first, data[a : last + LENGTH], data[first:a][::-1], struct.pack(FIELDS, k1, k2, a, first, last, h, alone)))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)


_DECIDED = "k1 long, k2 long, a long, first long, h long, start long, stop long, posted array<struct<start: long, stop: long>>, open array<struct<start: long, stop: long>>"


def _between(low: int, high: int, known: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The windows low to high outside the spans ``known``, as spans [start, stop)."""
    return [{"start": x, "stop": y} for x, y in zip([low, *(k[1] for k in known)], [*(k[0] for k in known), high + 1]) if x < y]


def _decided(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each anchor the windows that a neighbour shares, as spans [start, stop) of bytes; and in a row with ``posted`` those of
    the windows that can repeat, as spans of windows, which the string before doesn't share, and those that stay ``open``: no
    neighbour shares them, and no other document holds the context (``alone``)."""
    for part in parts:
        rows = []
        for k1, k2, a, first, last, h, r, l, shared, alone in zip(*(part[c] for c in ("k1", "k2", "a", "first", "last", "h", "r", "l", "shared", "alone"))):
            low, high = max(first, a - l), min(last, a + r - LENGTH)  # windows that can repeat
            if low > high:
                continue
            pairs = [(max(low, a - s["l"]), min(high, a + s["r"] - LENGTH) + 1, s["previous"]) for s in shared]
            known = joined_spans(p[:2] for p in pairs if p[0] < p[1])
            if alone:
                rows += ((k1, k2, a, first, h, start, stop - 1 + LENGTH, None, None) for start, stop in known)
            before = joined_spans(p[:2] for p in pairs if p[0] < p[1] and p[2])
            if posted := _between(low, high, before):
                rows.append((k1, k2, a, first, h, None, None, posted, _between(low, high, known) if alone else []))
        columns = ["k1", "k2", "a", "first", "h", "start", "stop", "posted", "open"]
        yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("start", "stop")})


def _open_windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of the posted windows at the offsets that are open somewhere in their group of anchors; ``mine``: open here."""
    columns, inside = ["h", "digest", "k1", "k2", "p", "mine"], lambda p, spans: any(s["start"] <= p < s["stop"] for s in spans)
    for part in parts:
        rows = []
        for h, k1, k2, a, first, after, before, offsets, posted, still in zip(*(part[c] for c in ("h", "k1", "k2", "a", "first", "after", "before", "offsets", "posted", "open"))):
            data = bytes(before)[::-1] + bytes(after)
            for p in (a - o for o in offsets):
                if inside(p, posted):
                    rows.append((h, hashlib.blake2b(data[p - first : p - first + LENGTH], digest_size=16).digest(), k1, k2, p, inside(p, still)))
            if len(rows) >= 50_000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def distinct_contexts(placed: DataFrame) -> DataFrame:
    """(h, c1, c2, n, k1, k2, a, first, last): each distinct context with how many documents hold it, and the first met of its
    places; the table is written, so that the choice stays."""
    place = [F.first(c).alias(c) for c in ("k1", "k2", "a", "first", "last")]
    return saved(placed.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), *place), "distinct-contexts")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, spans) of the documents that lose bytes: [start, stop) spans of their UTF-8 bytes, which may overlap."""
    k1, k2 = keys(key, text)
    texts = docs.filter(F.octet_length(text) >= LENGTH).select(k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    found = saved(texts.mapInPandas(_anchor_rows, _ANCHOR_ROW), "anchors")
    placed = found.filter(~F.col("inside"))
    distinct = distinct_contexts(placed)
    # Contexts that several documents hold are repeats as they stand.
    several = saved(distinct.filter("n > 1").select("c1", "c2"), "copied-contexts")
    copied = placed.join(several, ["c1", "c2"], "left_semi").select("k1", "k2", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop"))
    # Groups with two distinct contexts or more, of which one is undecided.
    groups = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).filter("contexts > 1 and least = 1")
    groups = saved(groups.select("h"), "grams")
    live = distinct.join(groups, "h", "left_semi").select("h", (F.col("n") == 1).cast("long").alias("alone"), "k1", "k2", "a", "first", "last")
    places = live.groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "a", "first", "last", "alone")).alias("places"))
    contexts = saved(texts.join(places, ["k1", "k2"]).mapInPandas(_contexts, _CONTEXT), "contexts")
    forward, ahead = neighbours(contexts, backwards=False)
    backward, behind = neighbours(contexts, backwards=True)
    seen = F.collect_set(F.struct("r", "l", "previous")).alias("shared")
    bounds = ahead.unionByName(behind).groupBy("k1", "k2", "a", "first", "last", "h", "alone").agg(F.max("r").alias("r"), F.max("l").alias("l"), seen)
    decided = saved(bounds.mapInPandas(_decided, _DECIDED), "decided")
    for table in (forward, backward):
        forget(table)
    opened, tables = _opened(decided, contexts)
    local = found.filter("inside").select("k1", "k2", F.col("first").alias("start"), F.col("last").alias("stop"))
    every = local.union(copied).union(decided.filter("posted is null").select("k1", "k2", "start", "stop")).union(opened)
    out = saved(every.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    for table in (found, distinct, several, groups, contexts, decided, *tables):
        forget(table)
    return out


def _opened(decided: DataFrame, contexts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, start, stop) of the open windows that repeat after all, and the tables that stand behind it.

    Every open window is posted, and of the equal windows of its partners at least the first in the forward order.
    """
    bounds = decided.filter("posted is not null").select("h", "k1", "k2", "a", "first", "posted", "open")
    offsets = F.flatten(F.transform("open", lambda s: F.sequence(F.col("a") - s["stop"] + 1, F.col("a") - s["start"])))
    groups = saved(bounds.select("h", F.explode(offsets).alias("o")).distinct().groupBy("h").agg(F.collect_list("o").alias("offsets")), "open-offsets")
    named = contexts.drop("reference").join(groups, "h").join(bounds.drop("h"), ["k1", "k2", "a", "first"])
    windows = saved(named.mapInPandas(_open_windows, "h long, digest binary, k1 long, k2 long, p long, mine boolean"), "windows")
    several = saved(windows.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("mine").alias("open")).filter("n > 1 and open").select("h", "digest"), "digests")
    repeated = windows.filter("mine").join(several, ["h", "digest"], "left_semi")
    return repeated.select("k1", "k2", F.col("p").alias("start"), (F.col("p") + LENGTH).alias("stop")), [groups, windows, several]


def _cut(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, found in rows:
        made = []
        for text, listed in zip(texts, found):
            data = (text or "").encode()
            gone = joined_spans((s["start"], s["stop"]) for s in listed) if listed is not None else []
            at, kept = 0, []
            for start, stop in gone:
                kept.append(data[at:start])
                at = stop
            kept.append(data[at:])
            made.append((len(data), sum(b - a for a, b in gone), len(gone), b"".join(kept)))
        yield pd.DataFrame(made, columns=["n_bytes", "n_removed", "n_spans", "kept"])


def cut(text: Column, found: Column) -> Column:
    """What a text loses by spans, and its other bytes."""
    return F.pandas_udf(_cut, "struct<n_bytes: long, n_removed: long, n_spans: long, kept: binary>")(text, found)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "cut") -> DataFrame:
    """``docs`` with a struct of n_bytes, n_removed, n_spans and kept (the bytes that stay, concatenated)."""
    k1, k2 = keys(key, text)
    a, b, found, name = (free_name(docs, c) for c in ("k1", "k2", "spans", name))
    gone = spans(docs, key, text).select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("spans").alias(found))
    return docs.withColumn(a, k1).withColumn(b, k2).join(gone, [a, b], "left").withColumn(name, cut(F.col(text), F.col(found))).drop(a, b, found)
