"""The mix against its plan: words taken of each source, copies, cut texts, order, and repeated rows."""

from collections import Counter

from pyspark.sql import functions as F

from tidewire.llm import curriculum, queries

TEXTS = [(i, " ".join(f"w{j}" for j in range(1 + i % 13)), f"s{i % 3}" if i % 7 else None) for i in range(90)]
ODD = [(200, None, "s1"), (201, "", "s1"), (202, "  a b\tc\n d ", "s2"), (203, "same", "s0"), (203, "same", "s0"), (None, "x y", "s2"), (None, "x z", "s2")]


def test_mix_follows_the_plan(spark):
    docs = spark.createDataFrame(TEXTS + ODD, "doc_id long, text string, source string").withColumn("size", F.lit("own")).withColumn("K1", F.lit(1))
    rows, n = curriculum.planned(docs)
    plan = rows.collect()
    mix = curriculum.mixed(docs).collect()
    assert all(r["size"] == "own" and r["K1"] == 1 for r in mix)
    words = Counter()
    for r in mix:
        words[r["source"]] += len(r["text"].split())
    for source in {r["source"] for r in plan}:
        mine = [r for r in plan if r["source"] == source]
        assert words[source] == sum(r["taken"] for r in mine) == round(mine[0]["target"])
    key = lambda r: (r["doc_id"], r["source"])
    taken, given = Counter(), Counter()
    for r in plan:
        taken[key(r)] += r["taken"]
    for r in mix:
        given[key(r)] += len(r["text"].split())
    assert +taken == +given
    assert [r["position"] for r in mix] == sorted(r["position"] for r in mix)
    whole = {key(r): r["text"] for r in plan}
    assert all(whole[key(r)].startswith(r["text"]) for r in mix if r["doc_id"] is not None)


def test_empty(spark):
    assert curriculum.mixed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_query_counts_the_mix_in_its_order(spark, tmp_path, monkeypatch):
    """What op8 returns comes out of the mix: words counted in its texts, in rows that follow the schedules, which move them."""
    spark.createDataFrame(TEXTS + ODD, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def returned():
        words, first = Counter(), {}
        for r in curriculum.mixed(docs).collect():
            words[r["doc_id"]] += len(r["text"].split())
            first.setdefault(r["doc_id"], r["position"])
        rows = queries.op8_curriculum(spark, str(tmp_path)).collect()
        assert len(rows) == len(TEXTS + ODD)
        given = Counter()
        for r in rows:
            given[r["doc_id"]] += r["taken"]
        assert +given == +words
        single = [r["doc_id"] for r in rows if r["doc_id"] not in (None, 203)]
        taken = [i for i in single if words[i]]
        assert single[: len(taken)] == taken
        assert [first[i] for i in taken] == sorted(first[i] for i in taken)
        return single, sorted(tuple("" if v is None else str(v) for v in r) for r in rows)

    order, found = returned()
    monkeypatch.setattr(curriculum, "SLOPES", (-0.9, 0.9, 0.0))
    other, same = returned()
    assert order != other and found == same
