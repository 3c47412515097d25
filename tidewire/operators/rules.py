"""Rule operators: phrase and keyword matching, routing, categories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.rows import free_name

#: Up to so many phrases are tested in one expression; longer lists go through an automaton, of so many phrases at most.
INLINE_RULES, AUTOMATON_RULES = 64, 100_000

# Category, priority, term, department; and what an unknown category gets.
CATEGORY_RULES = (
    ("надзорная санкция и юридический риск", "p1", "срок 48 часов", "Юристы"),
    ("репутационный риск", "p1", "срок 48 часов", "PR"),
    ("pr-активность конкурента", "p2", "срок 1 неделя", "PR"),
    ("системная проблема (возможность для входа)", "p2", "срок 1 неделя", "Аналитика"),
    ("признание качества и конкурсы", "p3", "отслеживать", "Маркетинг"),
    ("косвенное упоминание", "p3", "отслеживать", "Аналитика"),
    ("информационный шум", "p4", "игнорировать", None),
)
UNKNOWN_CATEGORY = ("p2", "категорию добавить в базу", "Аналитика")
# Labels of priorities and of tonalities.
PRIORITY_LABELS = {"p1": "П1", "p2": "П2", "p3": "П3", "p4": "П4"}
TONALITY_LABELS = {"positive": "позитивная", "neutral": "нейтральная", "negative": "негативная", "alarming": "тревожная", "irrelevant": "нерелевантная"}


def _least(text: Column, rules: list[tuple[str, int]], labels: list[str] | None = None) -> Column:
    """The least rank of the (phrase, rank) whose phrase stands in ``text``, or the label of that rank; null for none.

    A short list is one flat CASE, whose branches are tried by rank. A longer one is an Aho-Corasick automaton, which reads a text once
    however many phrases there are; its phrases are broadcast with the function, and callers bound their number.
    """
    kind = "long" if labels is None else "string"
    if not rules:
        return F.lit(None).cast(kind)
    if len(rules) <= INLINE_RULES:
        (phrase, rank), *rest = sorted(rules, key=lambda r: r[1])
        value = lambda rank: F.lit(rank if labels is None else labels[rank])
        found = F.when(F.contains(text, F.lit(phrase)), value(rank))
        for phrase, rank in rest:
            found = found.when(F.contains(text, F.lit(phrase)), value(rank))
        return found.cast(kind)
    ranks: dict[str, int] = {}
    for phrase, rank in rules:
        ranks[phrase] = min(rank, ranks.get(phrase, rank))
    everywhere = ranks.pop("", None)  # the empty phrase stands in every text

    @F.pandas_udf(kind)
    def least(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase, rank in ranks.items():
            automaton.add_word(phrase, rank)
        automaton.make_automaton()
        for texts in batches:
            hits = [min((rank for _, rank in automaton.iter(t)), default=None) if t else None for t in texts]
            hits = [everywhere if h is None or everywhere is not None and everywhere < h else h for h in hits]
            yield pd.Series(hits, dtype="Int64") if labels is None else pd.Series([None if h is None else labels[h] for h in hits], dtype="object")

    return least(text)


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def first_phrase(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """The result of the first (phrase, result) whose phrase stands in the lower-cased text; null for none.

    For a list in a program; ``first_phrases`` takes a table of rules of any size.
    """
    return _least(_lowered(text), [(phrase.lower(), i) for i, (phrase, _) in enumerate(phrases)], [result for _, result in phrases])


def _chunks(rules: DataFrame) -> Iterator[list[tuple[str, int]]]:
    """Rules (phrase, rank) in lists of about AUTOMATON_RULES: one unless there are more, and each a part by hash."""
    parts = -(-rules.count() // AUTOMATON_RULES)
    for part in range(parts):
        yield [(r["phrase"], r["rank"]) for r in rules.filter(F.pmod(F.xxhash64("phrase", "rank"), F.lit(parts)) == part).collect()]


def with_least(df: DataFrame, text: Column, rules: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: the least rank of ``rules`` (phrase, rank) whose phrase stands in the lower-cased text; null for none.

    Rows neither move nor multiply, whatever the number of rules: beyond AUTOMATON_RULES, further automata read the same texts.
    """
    usable = rules.filter("phrase is not null and rank is not null").select(F.lower("phrase").alias("phrase"), F.col("rank").cast("long").alias("rank"))
    least = usable.groupBy("phrase").agg(F.min("rank").alias("rank"))
    lowered, found = free_name(df, "lowered"), free_name(df, "least")
    out = df.withColumn(lowered, _lowered(text)).withColumn(found, F.lit(None).cast("long"))
    for rows in _chunks(least):
        out = out.withColumn(found, F.least(found, _least(F.col(lowered), rows)))
    return out.withColumn(name, F.col(found)).drop(lowered, found)


def first_phrases(df: DataFrame, text: Column, rules: DataFrame, name: str = "phrase_position") -> DataFrame:
    """``df`` with the position of the first of ``rules`` (position, phrase) whose phrase stands in the lower-cased text."""
    return with_least(df, text, rules.select("phrase", F.col("position").alias("rank")), name)


def least_type(events: DataFrame, title: str, types: DataFrame, id_: str = "id") -> DataFrame:
    """``events`` with ``event_type_id``: the least id of the types (id, keywords) of which a keyword stands in the title."""
    return with_least(events, F.col(title), types.select(F.explode("keywords").alias("phrase"), F.col(id_).alias("rank")), "event_type_id")


def routed(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(event_id, event_type_id, priority, user_id, channel_id, mode): recipients of each event by rules of its type and
    priority, and by rules of the priority alone unless a typed one reaches the same user over the same channel."""
    typed_rules = rules.filter("event_type_id is not null")
    typed = events.join(typed_rules, ["event_type_id", "priority"]).select("event_id", "event_type_id", "priority", "user_id", "channel_id", "mode")
    plain = events.join(rules.filter("event_type_id is null").drop("event_type_id"), "priority").select("event_id", "event_type_id", "priority", "user_id", "channel_id", "mode")
    return typed.unionByName(plain.join(typed.select("event_id", "user_id", "channel_id"), ["event_id", "user_id", "channel_id"], "left_anti"))


def categorized(df: DataFrame, category: str) -> DataFrame:
    """priority, term and department by the rule of the category, compared trimmed and in lower case."""
    key, known = free_name(df, "key"), free_name(df, "known")
    dim = df.sparkSession.createDataFrame(CATEGORY_RULES, f"`{key}` string, priority string, term string, department string").withColumn(known, F.lit(True))
    out = df.withColumn(key, F.lower(F.btrim(F.col(category)))).join(F.broadcast(dim), key, "left")
    for name, default in zip(("priority", "term", "department"), UNKNOWN_CATEGORY):
        out = out.withColumn(name, F.when(F.col(known), F.col(name)).otherwise(default))
    return out.drop(key, known)


def labelled(code: Column, labels: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def delivery(mode: Column, channel: Column, sent: Column, deliver: bool = True) -> Column:
    """queued, sent or failed: digests wait; without delivery instant ones count as sent."""
    instant = (mode == "instant") & channel.isin("email", "telegram")
    if not deliver:
        return F.when(instant, "sent").otherwise("queued")
    return F.when(instant & F.coalesce(sent, F.lit(False)), "sent").when(instant, "failed").otherwise("queued")


def activity_index(n: Column, sources: Column, active: Column) -> Column:
    """News of a competitor times its sources over active sources; 0 without any."""
    return F.when(active == 0, 0.0).otherwise(n * sources / active)
