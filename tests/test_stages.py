"""Stages, stores and streams over small tables, run twice where a second run must change nothing."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewire.operators import rows
from tidewire.plans import mart, stages
from tidewire.sources import store
from tidewire.streaming import snapshots as streams

ITEM = "struct<url: string, title: string, text: string, published_at: string, region: string>"
RAW = f"id long, search_task_id long, status string, created_at timestamp, raw_data struct<meta: struct<competitor: string>, items: array<{ITEM}>>"


def raw(spark):
    t = [datetime(2026, 6, 25, h) for h in range(4)]
    item = lambda url, title, text="t", day="25.06.2026", region="г. Москва": (url, title, text, day, region)
    rows_ = [
        (1, 1, "new", t[0], (("Бегемот",), [item("https://a.ru/1", "Старый снимок")])),
        (2, 1, "changed", t[1], (("Бегемот",), [item("https://www.A.ru/1", "<b>Первое</b>"), item("https://spam.ru/2", "Второе"), item("https://a.ru/3", "", region=None)])),
        (3, 2, "new", t[1], (("нет такого",), [item("https://a.ru/4", "Гороскоп", day="не дата"), item("https://a.ru/5", "первое!", text="x")])),
        (4, 2, "error", t[2], None), (5, 3, "new", t[1], (("Бегемот",), [])), (6, 4, "new", t[1], (("Бегемот",), [item("https://b.ru/1", "ПЕРВОЕ")])),
        (7, 5, "new", t[1], (("x",), [item("https://b.ru/2", "тай")])), (8, 5, "changed", t[1], (("x",), [item("https://b.ru/3", "тай-брейк")])),
    ]
    return spark.createDataFrame(rows_, RAW)


def silver(spark, stored):
    found = stages.items(stages.pending_snapshots(raw(spark), stored))
    competitors = spark.createDataFrame([(1, "бегемот", True), (2, "Бегемот", True), (9, "Бегемот", False)], "id long, name string, is_active boolean")
    regions = spark.createDataFrame([(10, ["Москва", "г. москва"]), (11, None)], "id long, name_aliases array<string>")
    tasks = spark.createDataFrame([(1, 100), (2, 200)], "id long, source_id long")
    black = spark.createDataFrame([("spam.ru", True), ("a.ru", False)], "domain string, is_active boolean")
    return stages.normalized(found, competitors, regions, tasks, black, [("гороскоп", "stop_topic"), ("второе", "stop_word")])


def test_normalize(spark):
    nothing = spark.createDataFrame([], "raw_item_id long")
    out = {r["url"]: r for r in silver(spark, nothing).collect()}
    assert set(out) == {"https://www.A.ru/1", "https://spam.ru/2", "https://a.ru/3", "https://a.ru/4", "https://a.ru/5", "https://b.ru/3"}  # b.ru/1 repeats a key
    first = out["https://www.A.ru/1"]
    assert (first["title"], first["competitor_id"], first["region_id"], first["source_id"], first["published_at"], first["media_domain"], first["status"]) == ("Первое", 2, 10, 100, date(2026, 6, 25), "a.ru", "ok")
    assert {u: r["reject_reason"] for u, r in out.items()} == {"https://www.A.ru/1": None, "https://spam.ru/2": "black_domain", "https://a.ru/3": "parse_error", "https://a.ru/4": "stop_topic", "https://a.ru/5": None, "https://b.ru/3": None}
    assert {r["reject_reason"]: r["n"] for r in stages.reject_breakdown(silver(spark, nothing)).collect()} == {"black_domain": 1, "stop_word": 0, "stop_topic": 1, "false_positive": 0, "parse_error": 1}


def test_normalize_again(spark):
    stored = silver(spark, spark.createDataFrame([], "raw_item_id long")).select("raw_item_id", "dedup_key")
    again = silver(spark, stored)
    assert {r["raw_item_id"] for r in again.collect()} == {6}  # its only item repeats a stored key, so it comes up each time
    assert rows.insert_ignore(again, stored, ["dedup_key"], [F.asc("raw_item_id")]).count() == 0


def test_mart_and_actions(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = rows.upserted(base, new, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, rows.upserted(once, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert mart.scoped(base, "viewer", None).count() == 0 and mart.scoped(base, "editor", None).count() == 2
    table = spark.createDataFrame([(1, 11, None, "П1"), (2, 12, datetime(2026, 1, 1), "П1"), (3, 13, None, "П3"), (4, 14, None, "П2")], "id long, categorized_event_id long, action_items_generated_at timestamp, priority string")
    gold = spark.createDataFrame([(11, 5, ["x", "y"], None, "r"), (12, 5, ["z"], None, None), (13, 5, ["w"], None, None), (14, None, ["v"], None, None)], "id long, department_id long, task array<string>, deadline date, expected_result string")
    assert sorted((r["showcase_event_id"], r["task"], r["status"]) for r in stages.action_items(table, gold).collect()) == [(1, "x", "new"), (1, "y", "new")]
    candidates = spark.createDataFrame([("a.ru", 0.9, "new", True), ("b.ru", 0.5, "new", True), ("c.ru", 0.8, "new", False), ("d.ru", 0.9, "new", True), (None, 0.9, "new", True)], "domain string, score double, status string, is_active boolean")
    added, chosen = stages.promoted(candidates, spark.createDataFrame([("d.ru",)], "name string"), 0.5)
    assert [r["name"] for r in added.collect()] == ["a.ru"] and chosen.count() == 3


def test_alerts(spark):
    now, before = datetime(2026, 6, 25), datetime(2026, 6, 24)
    table = spark.createDataFrame([(1, "Суд рассмотрел", "p1", now, None), (2, "ничего", "p1", now, None), (3, "тендер", "p1", before, now), (4, "тендер", "p2", now, before)], "id long, title string, priority string, updated_at timestamp, alerted_at timestamp")
    types = spark.createDataFrame([(2, ["тендер"]), (1, ["прокуратура", "суд"])], "id long, keywords array<string>")
    routing = spark.createDataFrame([(1, "p1", 10, 1, "instant"), (None, "p1", 10, 1, "digest"), (None, "p1", 11, 1, "digest"), (2, "p2", 12, 1, "instant")], "event_type_id long, priority string, user_id long, channel_id long, mode string")
    stored = spark.createDataFrame([], "showcase_event_id long, user_id long, channel_id long")
    found = stages.alerts(table, types, routing, stored)
    got = sorted((r["event_id"], r["user_id"], r["mode"], r["event_type_id"]) for r in found.collect())
    assert [g[:3] for g in got] == [(1, 10, "instant"), (1, 11, "digest"), (2, 10, "digest"), (2, 11, "digest"), (4, 12, "instant")]
    kept = found.select(F.col("event_id").alias("showcase_event_id"), "user_id", "channel_id")
    assert stages.alerts(table, types, routing, kept).count() == 0


def test_snapshot_store(spark, tmp_path):
    path = f"file://{tmp_path}/raw"
    made = store.scenario(spark, 40, ["А", "Б"], ["москва", "тула"])
    first = store.write_snapshots(made, path)
    kinds = 40  # the five empty snapshots have equal items, but are of five tasks
    assert first.count() == kinds
    stored = store.read_snapshots(spark, path)
    assert stored.count() == kinds and stored.filter("file like '%/year=2026/month=06/day=%/trigger=%'").count() == kinds
    assert store.write_snapshots(made, path).count() == 0 and store.read_snapshots(spark, path).count() == kinds
    more = store.write_snapshots(store.scenario(spark, 42, ["А", "Б"], ["москва", "тула"]), path)
    assert sorted(r["raw_id"] for r in more.collect()) == ["raw_40", "raw_41"]
    assert store.snapshots_of(stored, raw_id="raw_5").count() == 1 and store.snapshots_of(stored, status="error").filter("meta.status <> 'error'").count() == 0
    done = store.with_status(stored, spark.createDataFrame([("raw_5", "done")], "raw_id string, status string"))
    assert {r["raw_id"] for r in store.snapshots_of(done, status="done").collect()} == {"raw_5"} and done.count() == kinds


def test_dictionaries(spark, tmp_path):
    (tmp_path / "d.csv").write_text("name,department\nа,PR\n ,x\nб,нет\n", encoding="utf-8")
    dim = spark.createDataFrame([(3, "PR")], "id long, name string")
    found = store.resolved(store.read_dictionary(spark, f"file://{tmp_path}/d.csv", "name"), {"department_id": ("department", dim)})
    assert sorted((r["name"], r["department_id"]) for r in found.collect()) == [("а", 3), ("б", None)]
    cities = [{"name": "Тула", "aliases": ["ТУЛЕ"], "coords": {"lat": "54.2", "lon": "x"}, "pos": 0}, {"name": "Тула", "pos": 1}, {"name": " "}]
    (tmp_path / "c.json").write_text(json.dumps(cities, ensure_ascii=False), encoding="utf-8")
    assert [tuple(r) for r in store.regions(spark, f"file://{tmp_path}/c.json").collect()] == [("Тула", ["туле", "тула", "г. тула", "г тула"], 54.2, None)]


def test_tables_and_parsers(spark, tmp_path):
    place = store.replace_table(spark.range(3), f"file://{tmp_path}/t", "1")
    assert store.is_filled(spark.read.parquet(place)) and not store.is_filled(spark.read.parquet(store.cleared(spark, [place])[0]))
    with pytest.raises(ValueError):
        store.parsed(spark.range(1), "nobody")

    @store.parser("somebody")
    def _(pages):
        return pages.selectExpr("id + 1 as id")

    assert store.parsed(spark.range(1), "somebody").first()["id"] == 1
    sink = tmp_path / "sent"
    sink.mkdir()
    store.delivered(spark.range(3), lambda row: (sink / str(row["id"])).write_text("x"), f"file://{tmp_path}/log", "1")
    store.delivered(spark.range(3), None, f"file://{tmp_path}/log", "2")
    assert len(list(sink.iterdir())) == 3


def test_streams(spark, tmp_path):
    path, schema = f"file://{tmp_path}/in", "key string, ts timestamp"
    spark.createDataFrame([("a", datetime(2026, 6, 25, 1)), ("a", datetime(2026, 6, 25, 2)), ("b", datetime(2026, 6, 26, 1))], schema).write.parquet(path)
    out = []
    for df, at in ((streams.first_seen(streams.arriving(spark, path, schema), "key", "ts"), "c1"), (streams.per_window(streams.arriving(spark, path, schema), "key", "ts"), "c2")):
        found = []
        streams.start(df, lambda batch, _, found=found: found.extend(map(tuple, batch.collect())), f"file://{tmp_path}/{at}").awaitTermination(120)
        out.append(found)
    assert sorted(k for k, _ in out[0]) == ["a", "b"]
    assert ("a", 2) in {(k, n) for k, _, n in out[1]}  # windows that the watermark hasn't passed yet may be missing
