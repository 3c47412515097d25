"""Rule lists of any length: none is dropped, and the first or least counts, as brute force finds it."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import rules

SIZES = [1, 64, 65, 100, 499, 500, 501, 50_000]


def made(n):
    """Phrases, some inside others, some twice, one in upper case, one empty in long lists; and texts that hold some of them."""
    draw = random.Random(n)
    phrases = ["".join(draw.choice("абвгabcd ") for _ in range(draw.randint(2, 9))) for _ in range(n)]
    phrases[n // 2] = phrases[n // 2].upper()
    if n > 3:
        phrases[n - 1] = phrases[0]
    texts = ["".join(draw.choice("абвгabcdXY ") for _ in range(draw.randint(0, 60))) for _ in range(60)] + [f"x{phrases[-1]}y", f"x{phrases[n // 2]}", "", None]
    return phrases, texts


def brute_force(phrases, text):
    return next((i for i, p in enumerate(phrases) if p.lower() in (text or "").lower()), None)


@pytest.mark.parametrize("n", SIZES)
def test_first_phrase(spark, n):
    phrases, texts = made(n)
    wanted = {i: brute_force(phrases, t) for i, t in enumerate(texts)}
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rows.select("i", rules.first_phrase(F.col("t"), [(p, f"r{i}") for i, p in enumerate(phrases)]).alias("r")).collect()
    assert {r["i"]: r["r"] for r in found} == {i: None if w is None else f"r{w}" for i, w in wanted.items()}
    table = spark.createDataFrame([*enumerate(phrases), (n, None)], "position long, phrase string")
    found = rules.first_phrases(rows.withColumn("_lowered", F.lit(1)), F.col("t"), table).collect()
    assert {r["i"]: r["phrase_position"] for r in found} == wanted


@pytest.mark.parametrize("n", SIZES)
def test_least_type(spark, n):
    phrases, texts = made(n)
    keywords = [(i // 10 * 7 % 1_000_003, p) for i, p in enumerate(phrases)]
    groups = {}
    for i, k in keywords:
        groups.setdefault(i, []).append(k)
    types = spark.createDataFrame([*groups.items(), (2_000_000, None)], "id long, keywords array<string>")
    events = spark.createDataFrame(list(enumerate(texts)), "e int, title string")
    found = rules.least_type(events, "title", types).collect()
    wanted = {e: min((i for i, k in keywords if k.lower() in (t or "").lower()), default=None) for e, t in enumerate(texts)}
    assert {r["e"]: r["event_type_id"] for r in found} == wanted


def test_several_automata(spark, monkeypatch):
    """More rules than one automaton takes go to several, with one answer, and without a join or a shuffle of the texts."""
    monkeypatch.setattr(rules, "AUTOMATON_RULES", 150)
    phrases, texts = made(501)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rules.first_phrases(rows, F.col("t"), spark.createDataFrame(list(enumerate(phrases)), "position long, phrase string"))
    assert {r["i"]: r["phrase_position"] for r in found.collect()} == {i: brute_force(phrases, t) for i, t in enumerate(texts)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_empty_phrase_and_no_rules(spark):
    rows = spark.createDataFrame([(0, "b"), (1, None)], "i int, t string")
    long_list = [(f"p{i}.", f"r{i}") for i in range(80)]
    found = rows.select("i", rules.first_phrase(F.col("t"), [("b", "first"), ("", "all"), *long_list]).alias("r")).collect()
    assert {r["i"]: r["r"] for r in found} == {0: "first", 1: "all"}
    assert {r["r"] for r in rows.select(rules.first_phrase(F.col("t"), []).alias("r")).collect()} == {None}
    assert {r["phrase_position"] for r in rules.first_phrases(rows, F.col("t"), spark.createDataFrame([], "position long, phrase string")).collect()} == {None}
