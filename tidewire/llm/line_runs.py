"""Line deduplication by a suffix array over the documents' sequences of line IDs.

Lines (split at line ends, compared without the ASCII white space at both sides; lines without a word stand outside the
sequences and always stay) are numbered by their order, and suffixes are ranked by prefix doubling: the rank to depth 2d of a
suffix is the place of the pair (its rank to depth d, the rank of the suffix d lines on) in the order of all pairs, which a
range-partitioned sort finds without gathering them. Suffixes that are alone at a depth are settled and leave the rounds.

Doubling goes on until no two suffixes share a rank, so the ranks of all depths are the suffix array.

Suffixes of equal rank to depth d form a longest-common-prefix interval of that depth: a run of d lines with all its copies, the
earliest of which (by document id, then line) stays. Each suffix with an earlier copy takes the deepest interval in which it has
one, and that interval's earliest suffix as its source. Where the suffix a line before has the source a line before, both are in
one run, so only the others begin runs. Their longest common prefix with the source, which is less than twice the depth, is found
by descending through the ranks: a run grows by 2^j lines if both suffixes have equal ranks to that depth where it ends so far.

A run that has ``MIN_LINES`` lines is deleted where it repeats what came before. A single repeated line is deleted if it has
``MIN_WORDS`` words, or occurs ``FREQUENT`` times or more. The earliest copy always stays.

Defined results: a null text stays null and has no lines; an empty one has one line without a word; rows equal in id and text
are one document and get the same result; a null id sorts first; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shared import WHITE, forget, free_name, n_words, saved, settled

#: Lines of a run from which a later copy is deleted; words of a single line, or how often it occurs, from which it is.
MIN_LINES, MIN_WORDS, FREQUENT = 2, 50, 10


def keys(key: str, text: str) -> tuple[Column, Column]:
    """128 bits that tell documents apart by id and text."""
    return F.xxhash64(F.col(key), F.col(text)), F.xxhash64(F.lit(1), F.col(text), F.col(key))


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(place, n, x, y): a row for each line with a word. ``place`` sorts lines; ``place.pos`` counts those of its text that have a
    word; n is its words; (x, y) is its ID."""
    k1, k2 = keys(key, text)
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda s: F.btrim(s, F.lit(WHITE))), lambda s: s != "")
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), k1.alias("k1"), k2.alias("k2"), F.posexplode(lines).alias("pos", "line"))
    return rows.select(
        F.struct("id", "k1", "k2", "pos").alias("place"), n_words(F.col("line")).alias("n"), F.xxhash64("line").alias("x"),
        F.xxhash64(F.lit(1), F.col("line")).alias("y"),
    )


def ranked(suffixes: DataFrame) -> DataFrame:
    """Suffixes (place, x, y) whose pair (x, y) occurs more than once, with its rank, how often it occurs, and the first place.

    Distinct pairs are sorted over range partitions; numbering them there keeps their order.
    """
    pairs = suffixes.groupBy("x", "y").agg(F.count(F.lit(1)).alias("copies"), F.min("place").alias("first")).filter("copies > 1")
    order = pairs.repartitionByRange("x", "y").sortWithinPartitions("x", "y").select("x", "y", "first", "copies", F.monotonically_increasing_id().alias("rank"))
    order = saved(order, "line-ranks")
    out = saved(suffixes.join(order, ["x", "y"]).drop("x", "y"), "line-suffixes")
    forget(order)
    return out


def _at(place: str, shift: Column | int = 0) -> list[Column]:
    """The columns that tell a line of a text, ``shift`` lines on."""
    return [F.col(f"{place}.k1").alias("k1"), F.col(f"{place}.k2").alias("k2"), (F.col(f"{place}.pos") + shift).cast("int").alias("pos")]


def doubled(half: DataFrame, depth: int) -> DataFrame:
    """(place, x, y): the suffixes of ``half``, ranked to ``depth``, with their rank and that of the suffix ``depth`` lines on."""
    own = half.select(*_at("place"), "place", F.col("rank").alias("x"))
    on = half.select(*_at("place", -depth), F.col("rank").alias("y")).distinct()
    return own.join(on, ["k1", "k2", "pos"]).select("place", "x", "y")


def suffix_ranks(lines: DataFrame) -> dict[int, DataFrame]:
    """Of each depth 1, 2, 4, ... the suffixes that share their rank to it, until none does."""
    ranks, depth = {1: ranked(lines)}, 1
    while not ranks[depth].isEmpty():
        ranks[2 * depth] = ranked(doubled(ranks[depth].select("place", "rank"), depth))
        depth *= 2
    return ranks


def maximal_runs(ranks: dict[int, DataFrame]) -> DataFrame:
    """(place, source, lines): the runs that begin at a place and stand earlier at their source, as long as both agree."""
    later = None
    for depth, suffixes in ranks.items():
        found = suffixes.filter(F.col("place") > F.col("first")).select("place", F.col("first").alias("source"), F.lit(depth).alias("depth"))
        later = found if later is None else later.union(found)
    deepest = saved(later.groupBy("place").agg(F.max_by("source", "depth").alias("source"), F.max("depth").alias("depth")), "line-sources")
    pair = lambda shift: [*[c.alias(f"a{i}") for i, c in enumerate(_at("place", shift))], *[c.alias(f"b{i}") for i, c in enumerate(_at("source", shift))]]
    keys_ = [f"{side}{i}" for side in "ab" for i in range(3)]
    starts = deepest.select("*", *pair(0)).join(deepest.select(*pair(1)), keys_, "left_anti").select("place", "source", "depth", F.col("depth").alias("lines"))
    runs = saved(starts, "line-runs")
    for depth in sorted(ranks, reverse=True)[1:]:
        going = F.col("depth") > depth
        ends = [runs.filter(going).select("place", *_at(side, F.col("lines"))) for side in ("place", "source")]
        met = ends[0].union(ends[1]).join(ranks[depth].select(*_at("place"), "rank").distinct(), ["k1", "k2", "pos"])
        longer = met.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high")).filter("n = 2 and low = high").select("place", F.lit(depth).alias("more"))
        grown = saved(runs.join(longer, "place", "left").withColumn("lines", F.col("lines") + F.coalesce("more", F.lit(0))).drop("more"), "line-runs")
        forget(runs)
        runs = grown
    forget(deepest)
    return runs.select("place", "source", "lines")


def later_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(place, lines): runs of MIN_LINES lines or more and single lines that are later copies and are deleted."""
    lines = saved(line_table(docs, key, text), "lines")
    ranks = suffix_ranks(lines.select("place", "n", "x", "y"))
    forget(lines)
    single = ranks[1].filter((F.col("place") > F.col("first")) & ((F.col("n") >= MIN_WORDS) | (F.col("copies") >= FREQUENT)))
    runs = maximal_runs(ranks).filter(F.col("lines") >= MIN_LINES)
    return runs.select("place", "lines").union(single.select("place", F.lit(1).alias("lines")))


def _without(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, windows in rows:
        made = []
        for text, found in zip(texts, windows):
            if text is None:
                made.append((None, 0, 0, 0))
                continue
            lines = text.split("\n")
            if found is None:
                made.append((text, len(lines), 0, 0))
                continue
            worded = [i for i, x in enumerate(lines) if x.strip(WHITE)]
            gone = sorted({p for w in found for p in range(w["pos"], w["pos"] + w["lines"])})
            runs = sum(1 for a, b in zip([-2, *gone], gone) if b != a + 1)
            drop = {worded[p] for p in gone}
            made.append(("\n".join([x for i, x in enumerate(lines) if i not in drop]), len(lines), len(gone), runs))
        yield pd.DataFrame(made, columns=["kept", "n_lines", "n_removed", "n_runs"])


def without_later_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "lines") -> DataFrame:
    """``docs`` with a struct of kept (the text without later copies of runs), n_lines, n_removed and n_runs."""
    k1, k2 = keys(key, text)
    a, b, found, name = (free_name(docs, c) for c in ("k1", "k2", "windows", name))
    runs = lambda: later_runs(docs, key, text).groupBy(F.col("place.k1").alias(a), F.col("place.k2").alias(b)).agg(F.collect_set(F.struct("place.pos", "lines")).alias(found))
    gone = settled(runs, "line-windows")
    joined = docs.withColumn(a, k1).withColumn(b, k2).join(gone, [a, b], "left")
    without = F.pandas_udf(_without, "struct<kept: string, n_lines: long, n_removed: long, n_runs: long>")
    return joined.withColumn(name, without(F.col(text), F.col(found))).drop(a, b, found)
