"""Stores, merges, deliveries, model batches, streams and folds: run twice, interrupted, and against brute force."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewire.functions import markup, urls, values
from tidewire.operators import enrichment, gate, rows, state
from tidewire.plans import mart
from tidewire.sources import commits, merged, store
from tidewire.streaming import snapshots as streams


def files(path):
    return {os.path.relpath(os.path.join(at, f), path) for at, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_merge_leaves_other_files_alone(spark, tmp_path):
    place, path = str(tmp_path / "mart"), f"file://{tmp_path}/mart"
    base = spark.range(400).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.lit(1).alias("at"))
    assert len(merged.merge(base, path, ["id"], buckets=16)) == 16
    before = files(place)
    new = spark.createDataFrame([(3, "x", 2), (3, "y", 3), (401, "z", 1)], "id long, v string, at int")
    touched = merged.merge(new, path, ["id"], order=[F.desc("at")], buckets=16)
    after = files(place)
    assert 1 <= len(touched) <= 2
    assert {f for f in before | after if int(f.split("_bucket=")[1].split("/")[0]) not in touched} == before & after
    once = {r["id"]: r["v"] for r in merged.read(spark, path).collect()}
    assert len(once) == 401 and once[3] == "y" and once[401] == "z"
    merged.merge(new, path, ["id"], order=[F.desc("at")], buckets=16)
    assert {r["id"]: r["v"] for r in merged.read(spark, path).collect()} == once
    still = files(place)
    assert merged.merge(new, path, ["id"], order=[F.desc("at")], buckets=16, newer="at") == [] and files(place) == still


def test_commits_count_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert commits.append(spark.range(2), path, "a") and not commits.append(spark.range(5), path, "a")
    spark.range(9).write.parquet(f"{path}/attempt=died")  # an attempt that never committed
    assert commits.read(spark, path, "id long").count() == 2
    assert commits.commit(spark, path, "b", "first") and not commits.commit(spark, path, "b", "second")
    assert commits.attempts(spark, path)["b"] == "first"


def made(spark, ids, tasks=5):
    return store.scenario(spark, max(ids) + 1, ["А"], ["москва"]).filter(F.col("raw_id").isin([f"raw_{i}" for i in ids])).withColumn("meta", F.col("meta").withField("search_task_id", F.lit(1).cast("long")))


def test_equal_snapshots_of_a_task(spark, tmp_path):
    path = f"file://{tmp_path}/raw"
    empty = made(spark, range(0, 40, 9))  # five empty snapshots of one task
    assert [r["raw_id"] for r in store.write_snapshots(empty, path, "1").collect()] == ["raw_0"]
    assert [r["raw_id"] for r in store.write_snapshots(made(spark, [1, 2]), path, "1").collect()] == ["raw_0"]  # the batch stands
    other = empty.withColumn("meta", F.col("meta").withField("search_task_id", F.lit(2).cast("long")))
    assert store.write_snapshots(other, path, "2").count() == 1
    assert store.write_snapshots(empty, path, "3").count() == 0
    assert store.read_snapshots(spark, path).count() == 2 and store.has_snapshot(spark, path, "raw_0")  # raw_0 of each of the two tasks


def test_writers_at_the_same_time(spark, tmp_path, monkeypatch):
    """Two writers that don't see each other's batch commit the same snapshot: readers agree on the least id."""
    path = f"file://{tmp_path}/raw"
    again = made(spark, [5]).withColumn("raw_id", F.lit("raw_4x"))
    monkeypatch.setattr(store, "index", lambda spark, path: spark.createDataFrame([], store.INDEX))
    assert {r["raw_id"] for r in store.write_snapshots(made(spark, [5]), path, "w1").collect()} == {"raw_5"}
    assert {r["raw_id"] for r in store.write_snapshots(again, path, "w2").collect()} == {"raw_4x"}
    monkeypatch.undo()
    assert [r["raw_id"] for r in store.read_snapshots(spark, path).collect()] == ["raw_4x"]
    store.delete_snapshots(spark.createDataFrame([("raw_4x",)], "raw_id string"), path)
    assert [r["raw_id"] for r in store.read_snapshots(spark, path).collect()] == ["raw_5"]
    assert not store.has_snapshot(spark, path, "raw_4x")


def test_counts(spark):
    layer = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_active boolean")
    assert tuple(store.counts(layer).first()) == (3, 1) and tuple(store.counts(layer.select("id")).first()) == (3, 3)


def test_content_hash(spark):
    texts = ['[{"a":1,"extra":{"file_path":"x","k":[{"z":1,"y":null}]}}]', '[ {"extra": {"k": [{"y": null, "z": 1}]}, "a": 1} ]', '[{"a":1}]', '[{"a":1,"extra":{}}]', '[{"a":1,"extra":null}]', "[]", "no json", None]
    found = [tuple(r) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", values.canonical_items(F.col("t")), values.json_hash(F.col("t"))).orderBy("i").collect()]
    assert [c for _, c, _ in found] == ['[{"a":1,"extra":{"k":[{"y":null,"z":1}]}}]'] * 2 + ['[{"a":1}]', '[{"a":1,"extra":{}}]', '[{"a":1,"extra":null}]', "[]", None, None]
    assert found[0][2] == found[1][2] != found[2][2] and found[6][2] == found[7][2] is not None


def test_model_batches_fail_alone(spark, tmp_path):
    base = spark.range(40).repartition(4).select("id", F.lit("p1").alias("priority"), F.lit(1).alias("_comment"))
    calls = tmp_path / "calls"
    calls.mkdir()

    def client(batch):
        ids = sorted(r["id"] for r in batch)
        with open(calls / f"{ids[0]}-{ids[-1]}", "a") as f:
            f.write("x")
        if 7 in ids:
            raise TimeoutError
        if 11 in ids and (calls / f"{ids[0]}-{ids[-1]}").stat().st_size < 2:
            raise TimeoutError  # once
        return [None if i["id"] == 20 else f"c{i['id']}" for i in batch]

    out = enrichment.commented(base, enrichment.batched(client, size=5, pause=0.0), enrichment.batched(lambda batch: ["a"], size=1))
    found = {r["id"]: (r["comment"], r["action"]) for r in out.collect()}
    failed = {i for i, (c, _) in found.items() if c == enrichment.COMMENT_FAILED}
    assert 7 in failed and len(failed) <= 5 and 11 not in failed - {11} and {a for _, a in found.values()} == {"a"}
    assert all(found[i][0] == (None if i == 20 else f"c{i}") for i in found if i not in failed)
    with pytest.raises(AnalysisException):
        enrichment.categorized(base, lambda df: df.select("id", "no_such_column"))


def test_model_gives_a_frame_for_many_calls(spark, monkeypatch):
    """Answers of small batches go back to Spark together: as many frames as Arrow batches, not as calls."""
    base, frames = spark.range(100).coalesce(1), []
    monkeypatch.setattr(type(base), "mapInPandas", lambda df, each, schema: frames.extend(each(iter([df.toPandas(), df.limit(0).toPandas()]))))
    enrichment.batched(lambda batch: [None if batch[0]["id"] % 5 == 0 else "x"], size=1)(base)
    assert [len(f) for f in frames] == [80, 0] and set(frames[0]["id"]) == {i for i in range(100) if i % 5}


def test_finder(spark):
    competitors = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    finder = lambda batch: [[(f"https://{r['name']}.ru/2", 0.5), (f"https://{r['name']}.ru/1", 0.5), ("https://known.ru/", 0.9), (f"https://{r['name']}.com/", 0.1)] for r in batch]
    found = enrichment.found_sources(competitors, finder, spark.createDataFrame([("known.ru",)], "domain string"))
    assert sorted((r["competitor_id"], r["url"]) for r in found.collect()) == [(1, "https://a.com/"), (1, "https://a.ru/1"), (2, "https://b.com/"), (2, "https://b.ru/1")]


@pytest.mark.parametrize("parts", [1, 7])
def test_merge_of_outputs_is_repeatable(spark, parts):
    many = spark.range(1000).select((F.col("id") % 10).alias("id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("at")).repartition(parts)
    plain = many.drop("at")
    found = {r["id"]: (r["a"], r["b"]) for r in enrichment.merged({"a": many, "b": plain}).collect()}
    every = many.collect()
    for i in range(10):
        own = [(r["at"], r["value"]) for r in every if r["id"] == i]
        assert found[i] == (max(own)[1], max(v for _, v in own))


def test_deliveries(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()

    def send(row):
        with open(sent / str(row["id"]), "a") as f:
            f.write("x")
        if row["id"] == 3:
            raise OSError("down")

    path, alerts = f"file://{tmp_path}/log", spark.range(5)
    first = {r["id"]: (r["status"], r["error"], r["sent_at"] is None) for r in store.delivered(alerts, send, path, "1").collect()}
    assert first == {str(i): ("sent", None, False) for i in (0, 1, 2, 4)} | {"3": ("failed", "OSError: down", True)}
    assert store.delivered(alerts, send, path, "1").count() == 5  # nothing is sent, the outcome is shown
    assert [tuple(r)[:2] for r in store.delivered(spark.range(6), send, path, "2").orderBy("id").collect()] == [("3", "failed"), ("5", "sent")]
    assert {f.name: len(f.read_text()) for f in sent.iterdir()} == {"0": 1, "1": 1, "2": 1, "3": 2, "4": 1, "5": 1}
    assert [tuple(r) for r in store.delivered(spark.range(7), None, path, "3").select("id", "status").orderBy("id").collect()] == [("3", "sent"), ("6", "sent")]
    assert {r["id"]: (r["status"], r["attempts"]) for r in store.delivery_state(spark, path).collect()}["3"] == ("sent", 3)


def test_watched_stream_equals_batch(spark, tmp_path):
    """Three runs over one checkpoint give what the batch operators give over all snapshots."""
    draws = [(f"t{i % 4}", i, datetime(2026, 6, 1) + timedelta(minutes=i), f"h{i * 7 % 3}", i * 5 % 11 < 4) for i in range(120)]
    path, out, at = (f"file://{tmp_path}/{c}" for c in ("in", "out", "at"))
    for part in (draws[:50], draws[50:51], draws[51:]):
        spark.createDataFrame(part, streams.WATCHED).write.mode("append").parquet(path)
        found = streams.watched(streams.arriving(spark, path, streams.WATCHED))
        found.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination(180)
    got = {r["id"]: (r["status"], r["streak"], r["state"]) for r in spark.read.parquet(out).collect()}
    table, order = spark.createDataFrame(draws, streams.WATCHED), [F.asc("fetched_at"), F.asc("id")]
    good = {r["id"]: r["status"] for r in rows.change_status(table.filter("not failed"), ["task"], order, F.col("content_hash")).collect()}
    streaks = state.circuit(rows.streaks(table, ["task"], order, F.col("failed")).withColumn("failed_at", F.col("fetched_at")), F.col("fetched_at"))
    assert got == {r["id"]: (good.get(r["id"], "error"), r["streak"], r["state"]) for r in streaks.collect()}


def folded(blocks, most, overlap):
    """Chunks as (text, first, last), block by block."""
    out, current, start = [], [], 0
    for i, block in enumerate(blocks):
        if len(block) > most:
            if current:
                out.append(("\n".join(current), start, i - 1))
                current = []
            step = max(1, most - overlap)
            out += [(block[k : k + most], i, i) for k in range(0, max(1, len(block) - overlap), step)]
            start = i + 1
            continue
        if current and sum(map(len, current)) + len(block) > most:
            out.append(("\n".join(current), start, i - 1))
            again = []
            while current and sum(map(len, again)) + len(current[-1]) <= overlap:
                again.insert(0, current.pop())
            current, start = again, i - len(again)
        current.append(block)
    return [*out, ("\n".join(current), start, len(blocks) - 1)] if current else out


@pytest.mark.parametrize(("most", "overlap"), [(70, 40), (50, 0), (33, 12)])
def test_block_packing(spark, most, overlap):
    made_ = [["x" * (i * 13 % 61) + str(k) for i in range(k, k + 9)] for k in range(25)] + [["a" * 30, "b" * 30, "c" * 30, "d" * 250], ["d" * 90, "e"], ["e", "d" * 90], ["x"], []]
    found = spark.createDataFrame(list(enumerate(made_)), "i int, b array<string>").select("i", markup.packed_blocks(F.col("b"), most, overlap).alias("c")).collect()
    assert {r["i"]: [tuple(c) for c in r["c"]] for r in found} == {i: folded(b, most, overlap) for i, b in enumerate(made_)}
    assert spark.range(1).select(markup.packed_blocks(F.lit(None).cast("array<string>"))).first()[0] == []
    assert "Python" not in spark.createDataFrame([(["a"],)], "b array<string>").select(markup.packed(F.col("b")))._jdf.queryExecution().executedPlan().toString()


# The examples of RFC 3986, 5.4, against http://a/b/c/d;p?q.
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q",
    ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_links_resolve(spark):
    rows_ = spark.createDataFrame([(k,) for k in RFC], "u string").select("u", urls.absolute(F.col("u"), F.lit("http://a/b/c/d;p?q")).alias("a")).collect()
    assert {r["u"]: r["a"] for r in rows_} == RFC
    assert spark.range(1).select(urls.absolute(F.lit("g"), F.lit("http://a"))).first()[0] == "http://a/g"


def test_links_in_any_quotes(spark):
    page = """<a href="/1">one</a><A class=x href='/2?a="b"'>two <b>and</b> more</A><a href=/3>three</a><a data-href="/no">no</a><a href = "/4"\n>four</a><area href="/5"><a>none</a>"""
    df = spark.createDataFrame([(page,)], "p string")
    assert df.select(urls.links(F.col("p"))).first()[0] == ["/1", '/2?a="b"', "/3", "/4"]
    assert [tuple(x) for x in df.select(urls.labelled_links(F.col("p"), F.lit("https://h/d/"))).first()[0]] == [("https://h/1", "one"), ('https://h/2?a="b"', "two and more"), ("https://h/3", "three"), ("https://h/4", "four")]


def test_gate_errors_can_be_read_again(spark, tmp_path):
    payload = '{"url": "u", "title": 5, "extra": {"news": [{"ex_title": null, "ex_text": "Ozon opens"}]}}'
    items = spark.createDataFrame([(1, 0, "http://a/", "Title", None, payload), (1, 1, "http://a/#x", "", "t", None), (2, 0, "http://b/", "Title", "none", "{}")], "snapshot int, pos int, url string, title string, text string, payload string")
    aims = spark.createDataFrame([(1, 10, "ozon", None), (2, None, "ozon", None)], "snapshot int, expected int, competitor string, trigger string")
    path = f"file://{tmp_path}/errors"
    gate.errors(items, aims, {"title": 6}).write.parquet(path)
    found = sorted((tuple(r) for r in spark.read.parquet(path).collect()), key=str)
    assert found == sorted([
        (1, 0, "TYPES", "title", "not a text", payload), (1, 0, "BUSINESS", "title", "shorter than 6", payload), (1, 1, "SCHEMA", "title", "required", None), (1, 1, "BUSINESS", "title", "shorter than 6", None),
        (1, 1, "CONSISTENCY", "url", "repeated", None), (1, None, "VOLUME", None, "under 0.8 of the expected items", None), (2, 0, "BUSINESS", "title", "shorter than 6", "{}"), (2, None, "RELEVANCE", None, "no item names the target", None),
    ], key=str)


@pytest.mark.parametrize("offset", [0, 1, 99, 100, 4_321, 9_990, 10_000, 20_000])
def test_pages(spark, tmp_path, offset):
    df = spark.range(10_000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id")
    order = [F.desc("k"), F.asc("id")]
    mart.write_ordered(df, order, f"file://{tmp_path}/ordered")
    wanted = sorted((tuple(r) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    found = mart.page_at(spark, f"file://{tmp_path}/ordered", order, 25, offset)
    assert [tuple(r) for r in found.collect()] == wanted[offset : offset + 25]
    last = wanted[offset - 1] if 0 < offset <= len(wanted) else None
    if offset == 0 or last:
        assert [tuple(r) for r in mart.page_after(df, [("k", True), ("id", False)], last, 25).collect()] == wanted[offset : offset + 25]


def test_columns_with_inner_names_stay(spark):
    """Temporary columns take names that a table doesn't have."""
    table = spark.createDataFrame([(1, "a", "own"), (2, "b", "own")], "id int, v string, _patch string").withColumns({c: F.lit("own") for c in ("_hit", "_v", "_mark", "_change")})
    out = rows.patched(table, spark.createDataFrame([(1, None)], "id int, v string"), "id", ["v"])
    assert {r["id"]: r["v"] for r in out.collect()} == {1: None, 2: "b"} and {x for r in out.collect() for x in (r["_patch"], r["_hit"], r["_v"])} == {"own"}
    marked = state.marked(table, table.filter("id = 1"), "v", F.lit("now"))
    assert {r["id"]: (r["v"], r["_mark"]) for r in marked.collect()} == {1: ("now", "own"), 2: ("b", "own")}
