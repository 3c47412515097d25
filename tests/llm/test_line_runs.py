"""Maximal runs of repeated lines and what is deleted of them, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.llm import line_runs
from tidewire.llm.shared import saved


def made(seed: int) -> list[str]:
    rng = random.Random(seed)
    passages = [[f"p{p} line {i}" for i in range(rng.randrange(2, 30))] for p in range(6)] + [["common"], ["word " * 60]]
    texts = []
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            lines += rng.choice([p, p[a:], p[: a + 1], [f"own {d} {rng.random()}"], [" ", "\tcommon "]])
        texts.append("\n".join(lines))
    return [*texts, texts[3], ("x\n" * 300).strip(), "", "\n \n"]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs(spark, seed):
    texts = made(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    worded = {d: [x.strip(" \t\n\x0b\f\r") for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")] for d, t in enumerate(texts)}

    def common(a, b):
        n = 0
        while a[1] + n < len(worded[a[0]]) and b[1] + n < len(worded[b[0]]) and worded[a[0]][a[1] + n] == worded[b[0]][b[1] + n]:
            n += 1
        return n

    ranks = line_runs.suffix_ranks(saved(line_runs.line_table(docs, "doc_id", "text"), "t").select("place", "n", "x", "y"))
    covered = set()
    for r in line_runs.maximal_runs(ranks).collect():
        place, source = (r["place"]["id"], r["place"]["pos"]), (r["source"]["id"], r["source"]["pos"])
        assert source < place and r["lines"] == common(place, source)
        if r["lines"] >= 2:
            covered |= {(place[0], place[1] + i) for i in range(r["lines"])}
    first, counts = {}, {}
    for d, lines in worded.items():
        for i, x in enumerate(lines):
            counts[x] = counts.get(x, 0) + 1
    gone, want = set(), set()
    for d, lines in worded.items():
        for i in range(len(lines)):
            for k in (1, 2):
                window = tuple(lines[i : i + k])
                if len(window) == k and first.setdefault(window, (d, i)) != (d, i):
                    if k == 2:
                        want |= {(d, i), (d, i + 1)}
                        gone |= {(d, i), (d, i + 1)}
                    elif len(lines[i].split()) >= 50 or counts[lines[i]] >= 10:
                        gone.add((d, i))
    assert covered == want
    found = line_runs.without_later_copies(docs).select("doc_id", "lines.*").collect()
    for r in found:
        kept = [x.strip(" \t\n\x0b\f\r") for x in r["kept"].split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert kept == [x for i, x in enumerate(worded[r["doc_id"]]) if (r["doc_id"], i) not in gone]
        assert r["n_removed"] == sum(1 for d, _ in gone if d == r["doc_id"])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a\nb\nc"), (3, "a\nb\nc"), (None, "a\nb\nd"), (4, "a\nb\nd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Lines", F.lit("own"))
    got = sorted((r["doc_id"] or 0, r["lines_"]["kept"] or "", r["lines_"]["n_lines"], r["lines_"]["n_removed"]) for r in line_runs.without_later_copies(docs).collect())
    assert got == [(0, "a\nb\nd", 3, 0), (1, "", 0, 0), (2, "", 1, 0), (3, "c", 3, 2), (3, "c", 3, 2), (4, "", 3, 3)]
