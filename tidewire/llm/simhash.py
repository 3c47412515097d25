"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has 64 bits over its word shingles, repeats included; bit b is 1 if over half of the shingles' hashes
(XXH64, seed 42) have it. Two fingerprints are linked when they differ in at most ``TAU`` bits.

Candidates: the bits are cut into ``m`` segments on a ring. If two fingerprints differ in TAU bits or fewer, then from some
segment on, each chain of 1, 2, ..., m consecutive segments stays within its proportional budget (a chain of l segments differs
in l * TAU / m bits at most). With m = TAU + 1 the first budget is 0: the starting segment is equal. So every distinct
fingerprint is posted under each of its segments, pairs meet there, the chain budgets prune them, and the full distance is
checked last.

A bucket with over ``CROWDED`` fingerprints doesn't pair them all. Its fingerprints meet at points instead: two are within 2
bits exactly if a point within 1 bit of both exists. Each posts the points that its chain budget allows (its own value, and
one bit changed outside the starting segment), and links to the least fingerprint at each point. The links at a point are all
true, and connect all that share it, so no link between groups is lost; rows stay proportional to fingerprints. That holds for
a distance of 2 alone, and ``links`` refuses crowded buckets at another one.

Copies share a fingerprint and are one node; groups are the connected components.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and are linked like any other;
repeated rows get equal results; a null id stays null and doesn't name a group unless it is alone; an empty table gives no
rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.components import components
from tidewire.llm.shared import forget, free_name, saved, settled

#: Words of a shingle, and bits in which linked fingerprints differ at most.
WORDS, TAU = 3, 2
#: Words of a shingle of ``one_of_each``, and the Jaccard similarity (a fraction) from which it links texts.
SHINGLE, SIMILAR = 5, (4, 5)
#: Fingerprints of a bucket that are still compared pair by pair.
CROWDED = 64
#: Shingles that ``one_of_each`` puts last in its order, the most frequent of those in over ``CROWDED`` texts; the order bounds
#: how many pairs are compared, and has no say in which are linked.
FREQUENT = 1 << 17
#: One in so many texts is counted for that order.
COUNTED = 8
#: Bits over which two sets are told apart before they are compared.
PARITY = 1024
#: One in so many of the pairs is compared before the others.
EARLY = 5
#: Members of a bucket that one task pairs with all others; larger buckets are spread.
SPREAD = 1000
#: Shingles whose bits are counted at a time, which bounds memory for long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not found:
        return 0
    body, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    size = min(n, len(found))
    starts, stops = np.concatenate(([0], ends[:-1] + 1))[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist()
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(body[a:b], 42) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(text: Column, n: int = WORDS) -> Column:
    """The fingerprint of each text (long), in Arrow batches."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint(t, n) for t in part], dtype="int64")

    return of(text)


def segments(tau: int) -> list[tuple[int, int]]:
    """(shift, width) of tau + 1 segments of the 64 bits."""
    bounds = [64 * i // (tau + 1) for i in range(tau + 2)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _mask(shift: int, width: int) -> Column:
    value = ((1 << width) - 1) << shift
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value)


def _chains(a: Column, b: Column, start: Column, tau: int) -> Column:
    """Whether the chains from segment ``start`` on keep their budgets, and the whole distance is within ``tau``."""
    cut, m = segments(tau), tau + 1
    apart = [F.bit_count(a.bitwiseXOR(b).bitwiseAND(_mask(*s))) for s in cut]
    kept = F.lit(False)
    for i in range(m):
        total, ok = F.lit(0), start == i
        for length in range(1, m + 1):
            total = total + apart[(i + length - 1) % m]
            ok = ok & (total * m <= length * tau)
        kept = kept | ok
    return kept & (F.bit_count(a.bitwiseXOR(b)) <= tau)


def links(nodes: DataFrame, tau: int = TAU, crowded: int = CROWDED) -> DataFrame:
    """(f, u, v) pairs of linked distinct fingerprints of ``nodes`` (f, fp), enough of them to connect all that are linked.

    ``f`` tells kinds of fingerprints apart; only those of one kind meet.
    """
    cut = segments(tau)
    post = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(_mask(*s)).alias("part")) for i, s in enumerate(cut)])
    posted = saved(nodes.select("f", "fp", F.explode(post).alias("p")).select("f", "fp", "p.*"), "postings")
    sizes = saved(posted.groupBy("f", "start", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    shared = posted.join(sizes, ["f", "start", "part"])
    few = shared.filter(F.col("n") <= crowded).select("f", "start", "part", "fp")
    a, b = few.alias("a"), few.alias("b")
    on = (F.col("a.f") == F.col("b.f")) & (F.col("a.start") == F.col("b.start")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp"))
    pairs = a.join(b, on).filter(_chains(F.col("a.fp"), F.col("b.fp"), F.col("a.start"), tau)).select("a.f", F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    return pairs.union(_met(shared.filter(F.col("n") > crowded), tau))


def _met(crowd: DataFrame, tau: int) -> DataFrame:
    """Links of the fingerprints in crowded buckets, through the points within half the distance of each."""
    if tau != 2:
        raise ValueError("crowded buckets are linked through points within 1 bit, for a distance of 2")
    flips = [F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)) for i in range(64)]]
    kept = F.lit(False)
    for i, s in enumerate(segments(tau)):
        kept = kept | ((F.col("start") == i) & (F.col("flip").bitwiseAND(_mask(*s)) == 0))
    points = crowd.select("f", "start", "fp", F.explode(F.array(*flips)).alias("flip")).filter(kept).select("f", "start", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("f", "start", "point").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return points.join(least, ["f", "start", "point"]).filter("fp <> least").select("f", F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, tau: int = TAU) -> DataFrame:
    """(key, fp, component_id) a row: the fingerprint, and the least key among all that are reachable over links."""
    base = saved(docs.select(F.col(key).alias("key"), fingerprints(F.col(text), n).alias("fp")), "fingerprints")
    return base.join(settled(lambda: classes(base, tau), "classes"), "fp").select(F.col("key").alias(key), "fp", "component_id")


def classes(base: DataFrame, tau: int = TAU) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of ``base`` (key, fp)."""
    nodes = saved(base.groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    roots = components(links(nodes.select(F.lit(0).alias("f"), "fp"), tau).select("u", "v"))
    rooted = nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(names, "root").select("fp", "component_id")


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; one of all its words if it has fewer than n; none without a word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype="<u8")
    size, digest = min(n, len(found)), xxhash.xxh64_intdigest
    base = np.array([digest(w, 42) for w in found], dtype="<u8")
    h = np.zeros(len(found) - size + 1, dtype="<u8")
    for i in range(size):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + base[i : len(base) - size + 1 + i]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def fingerprint_of_set(found: np.ndarray) -> int:
    """The fingerprint over the hashes of a set of shingles, as a signed 64-bit integer."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), BLOCK):
        ones += np.unpackbits(found[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def parities(found: np.ndarray) -> np.ndarray:
    """Whether a set has an odd number of hashes of each value of their low bits: ``PARITY`` bits, as signed 64-bit integers."""
    odd = np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """64 bits that tell sets of shingles apart."""
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype="<u8").view("<i8")


def shingle_sets(text: Column) -> Column:
    """The set of shingles of each text, in Arrow batches."""

    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([shingles(t).view("<i8") for t in part])

    return of(text)


def similar(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) of ``nodes`` (node, n, odd, row) whose shingle sets have a Jaccard similarity of ``SIMILAR`` or more.

    Each hash that only one of two sets has changes one parity, so sets whose parities differ in more bits than similar sets of
    their sizes have other hashes can't be similar. Sets are made for the others alone, from the texts of ``rows`` (k1, k2, text).
    """
    above, below = SIMILAR  # common / (a + b - common) >= above / below, in whole numbers
    side = lambda c, at: nodes.select(F.col("node").alias(at), F.struct("n", "odd").alias(c))
    apart = F.aggregate(F.zip_with("a.odd", "b.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = pairs.join(side("a", "u"), "u").join(side("b", "v"), "v").filter((above + below) * apart <= (below - above) * (F.col("a.n") + F.col("b.n")))
    pairs = saved(near.select("u", "v"), "near")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    ends = saved(nodes.join(ends, "node", "left_semi").select("node", "row.k1", "row.k2"), "ends")  # written, so that Spark knows its size
    sets = saved(rows.join(ends, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("node", shingle_sets(F.col("text")).alias("set")), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    enough = (above + below) * F.size(F.array_intersect("a", "b")) >= above * (F.size("a") + F.size("b"))
    out = saved(both.filter(enough).select("u", "v"), "similar")
    for table in (pairs, ends, sets):
        forget(table)
    return out


def _row_keys(key: str, text: str) -> tuple[Column, Column]:
    return F.xxhash64(F.col(key), F.col(text)), F.xxhash64(F.lit(1), F.col(text), F.col(key))


def _pigeonring_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v) of ``nodes`` (node, fp) whose fingerprints are equal or linked, enough of them to connect all such."""
    first = saved(nodes.groupBy("fp").agg(F.min("node").alias("first")), "first")
    equal = nodes.join(first, "fp").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    side = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    linked = links(first.select(F.lit(0).alias("f"), "fp")).select("u", "v").join(side("u"), "u").join(side("v"), "v")
    return equal.union(linked.select(F.greatest("first_u", "first_v"), F.least("first_u", "first_v"))).distinct()


def _prefixes(rows: DataFrame) -> DataFrame:
    """(bucket, node, n, at): the node of each text of ``rows`` (text) under the first shingles of its set, in an order of all shingles.

    Two sets of a similarity of 4/5 or more share at least 4/5 of either, so the first shingle that they share stands among the
    first ``n - ceil(4 n / 5) + 1`` of both. That holds in any order that is the same for all sets: here frequent shingles come
    last, by counts over one in ``COUNTED`` texts, and the others by their hash. Shingles under which a single node stands are left out.
    """
    counted = rows.filter(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).select("text").distinct()
    counts = counted.select(F.explode(shingle_sets(F.col("text"))).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * COUNTED > CROWDED)
    frequent = [r["s"] for r in counts.orderBy(F.desc("n"), "s").limit(FREQUENT).collect()]
    hashes = np.array(frequent, dtype="<i8")
    by_hash = np.argsort(hashes)
    known = rows.sparkSession.sparkContext.broadcast((hashes[by_hash], len(hashes) - by_hash))  # the more frequent, the later
    above, below = SIMILAR

    @F.pandas_udf("struct<node: long, n: long, prefix: array<long>>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, ranks = known.value

        def prefix(s: np.ndarray) -> np.ndarray:
            length = len(s) + (-above * len(s)) // below + 1
            if not len(hashes):
                return s[:length]
            at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
            return s[np.argsort(np.where(hashes[at] == s, ranks[at], 0), kind="stable")][:length]

        for part in texts:
            sets = [shingles(t) for t in part]
            yield pd.DataFrame({"node": set_names(sets), "n": [len(s) for s in sets], "prefix": [prefix(s.view("<i8")) for s in sets]})

    posted = saved(rows.select(of("text").alias("p")).select("p.node", "p.n", F.posexplode("p.prefix").alias("at", "bucket")), "postings")
    # Copies are posted once for each row until here, and are one node.
    shared = posted.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("bucket")
    out = saved(posted.join(shared, "bucket").select("bucket", "node", "n", "at").distinct(), "postings")
    forget(posted)
    return out


def _may_be_similar(a: str, b: str) -> Column:
    """Whether two sets can be similar if what they share begins at this shingle: by their sizes, and by what follows it in both."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return (F.least(n, m) * SIMILAR[1] >= F.greatest(n, m) * SIMILAR[0]) & (left * sum(SIMILAR) >= (n + m) * SIMILAR[0])


def _open(posted: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, members, hub, a): the members of the buckets of ``posted`` in which several of the groups ``roots`` meet, and a first one
    of each bucket, in an order of its own."""
    rooted = posted.join(roots.select(F.col("u").alias("node"), "root"), "node", "left")
    rooted = rooted.select("bucket", F.struct("node", "n", "at", F.coalesce("root", "node").alias("root")).alias("a"))
    order = F.struct(F.xxhash64("a.node", "bucket").alias("h"), "a.node", "a.n", "a.at", "a.root")
    sizes = rooted.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("a.root").alias("low"), F.max("a.root").alias("high"), F.min(order).alias("hub"))
    return rooted.join(sizes.filter("low <> high").drop("low", "high"), "bucket")


def _hub_pairs(opened: DataFrame) -> DataFrame:
    ok = (F.col("a.root") != F.col("hub.root")) & _may_be_similar("a", "hub")
    return opened.filter(ok).select(F.greatest("a.node", "hub.node").alias("u"), F.least("a.node", "hub.node").alias("v")).distinct()


def _all_pairs(opened: DataFrame) -> DataFrame:
    """The pairs of members of each bucket that belong to different groups and may be similar; large buckets are met by several tasks."""
    parts = F.ceil(F.col("members") / SPREAD)
    left = opened.select("bucket", F.pmod(F.xxhash64("a.node"), parts).alias("part"), "a")
    right = opened.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("a").alias("b"))
    ok = (F.col("a.node") > F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & _may_be_similar("a", "b")
    return left.join(right, ["bucket", "part"]).filter(ok).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def similar_links(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v): links of similarity ``SIMILAR`` or more between ``nodes`` (node, n, fp, odd, row) of the texts of ``rows`` (k1, k2, text),
    that connect all which are linked.

    The SimHash candidates come first: fingerprints within ``TAU`` bits, by pigeonring. What they leave open is found over the
    first shingles of the sets: each node meets the first one of each of its buckets, and then, in the buckets that still hold
    several groups, all members of other groups.
    """
    nodes = nodes.filter("n > 0")
    found = similar(saved(_pigeonring_pairs(nodes), "candidates"), nodes, rows)
    posted = _prefixes(rows)
    first = saved(_hub_pairs(_open(posted, components(found))), "candidates")
    found = saved(found.union(similar(first, nodes, rows)), "links")
    pairs = saved(_all_pairs(saved(_open(posted, components(found)).drop("hub"), "open")).join(first, ["u", "v"], "left_anti"), "candidates")
    # Of large groups a part of the pairs connects most members; the other pairs inside what is connected then can go.
    early = F.pmod(F.xxhash64("u", "v"), F.lit(EARLY)) == 0
    found = saved(found.union(similar(pairs.filter(early), nodes, rows)), "links")
    roots = components(found)
    side = lambda c: roots.select(F.col("u").alias(c), F.col("root").alias(f"root_{c}"))
    late = pairs.filter(~early).join(side("u"), "u", "left").join(side("v"), "v", "left")
    late = late.filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")
    return found.union(similar(saved(late, "candidates"), nodes, rows))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the least id.

    Two texts are linked if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more. Candidates are those whose
    SimHash fingerprints pigeonring links, and for the rest those that share one of the first shingles of their sets, which loses
    no link; each is checked over the sets. Texts with equal sets are one node; those without a word are all equal.
    Sets take more room than texts, so they aren't kept: ``docs`` is read again where they are needed.
    """

    @F.pandas_udf("struct<node: long, n: long, fp: long, odd: array<long>>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            sets = [shingles(t) for t in part]
            yield pd.DataFrame({"node": set_names(sets), "n": [len(s) for s in sets], "fp": [fingerprint_of_set(s) for s in sets], "odd": [parities(s) for s in sets]})

    k1, k2 = _row_keys(key, text)
    a, b = free_name(docs, "k1"), free_name(docs, "k2")

    def chosen() -> DataFrame:
        """(k1, k2) of the row with the least id of each group."""
        rows = docs.select(F.col(key).alias("key"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
        base = rows.select(F.struct("key", "k1", "k2").alias("row"), of("text").alias("p")).select("row", "p.*")
        nodes = saved(base.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "odd")], F.min("row").alias("row")), "nodes")
        roots = components(similar_links(nodes, rows.select("k1", "k2", "text")))
        grouped_rows = nodes.join(roots, nodes["node"] == roots["u"], "left").select("row", F.coalesce("root", "node").alias("root"))
        kept = grouped_rows.groupBy("root").agg(F.min("row").alias("row"))
        return kept.select(F.col("row.k1").alias(a), F.col("row.k2").alias(b))

    kept = settled(chosen, "kept")
    return docs.withColumn(a, k1).withColumn(b, k2).join(kept, [a, b]).dropDuplicates([a, b]).drop(a, b)


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
