"""Registered queries of rule tables, stores that keep state, model batches, deliveries, streams and single errors, with their SQL.

Importing this module adds them to ``tidewire.queries``. What a query stores goes to a fresh folder under the shared one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import markup, urls, values
from tidewire.operators import enrichment, gate, rows, rules
from tidewire.plans import mart
from tidewire.queries import query, read
from tidewire.sources import merged, store
from tidewire.sources.commits import fresh_folder
from tidewire.streaming import snapshots


@query("""
with r as (select item_id as position, lower(array_to_string(string_split(text, ' ')[1:3], ' ')) as phrase from benchmark where text is not null)
select doc_id, min(r.position) as phrase_position from documents d left join r on contains(lower(coalesce(d.text, '')), r.phrase) group by doc_id""")
def rule_table_phrases(spark, d):
    """The first of a table of phrases in each document: the first three words of every benchmark passage."""
    table = read(spark, d, "benchmark").filter("text is not null").select(F.col("item_id").alias("position"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("phrase"))
    return rules.first_phrases(read(spark, d, "documents").select("doc_id", "text"), F.col("text"), table).select("doc_id", "phrase_position")


@query("""
with t as (select distinct p_size as id, lower(p_brand || ' ' || p_type) as k from part union select p_size, lower(split_part(p_name, ' ', 1)) from part where p_size % 7 = 0),
e as (select p_partkey, p_name || ' ' || p_brand || ' ' || p_type as title from part)
select p_partkey, cast(min(t.id) as bigint) as event_type_id from e left join t on contains(lower(e.title), t.k) group by p_partkey""")
def rule_table_types(spark, d):
    """The least type of a table of types with hundreds of keywords, for the title of every part."""
    part = read(spark, d, "part")
    kinds = part.select(F.col("p_size").alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("k")).union(part.filter("p_size % 7 = 0").select("p_size", F.split("p_name", " ")[0]))
    types = kinds.groupBy("id").agg(F.collect_set("k").alias("keywords"))
    return rules.least_type(part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title")), "title", types).select("p_partkey", "event_type_id")


@query("""select md5('[{"extra":{"k":' || (event_id % 5) || ',"z":{"a":1,"b":[2,{"c":3,"d":null}]}},"title":"' || event_type || '"}]') as hash, count(*) as n, min(event_id) as first_id from events group by 1""")
def content_hashes(spark, d):
    """Snapshots' items as JSON, with keys in two orders at every depth and pages in other files, have one hash if they are equal."""
    i, kind = F.col("event_id").cast("string"), F.col("event_type")
    k = (F.col("event_id") % 5).cast("string")
    one = F.concat(F.lit('[{"title": "'), kind, F.lit('", "extra": {"z": {"b": [2, {"d": null, "c": 3}], "a": 1}, "k": '), k, F.lit(', "file_path": "/x/'), i, F.lit('"}}]'))
    other = F.concat(F.lit('[{"extra":{"file_path":"'), i, F.lit('","k":'), k, F.lit(',"z":{"a":1,"b":[2,{"c":3,"d":null}]}},"title":"'), kind, F.lit('"}]'))
    items = F.when(F.col("event_id") % 2 == 0, one).otherwise(other)
    return read(spark, d, "events").select(values.json_hash(items).alias("hash"), "event_id").groupBy("hash").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then o_orderstatus || '*' else o_orderstatus end as status from orders where o_orderkey % 3 <> 0 or o_orderkey % 2 = 0")
def mart_merged(spark, d):
    """Two batches of orders merged into a mart, each twice: later versions of a key replace earlier ones, and never the other way."""
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    first = orders.filter("o_orderkey % 3 <> 0")
    second = orders.filter("o_orderkey % 2 = 0").select("o_orderkey", F.concat("status", F.lit("*")).alias("status"), (F.col("updated_at") + F.expr("interval 1 day")).alias("updated_at"))
    path = fresh_folder(spark, "mart")
    for batch in (first, second, first, second):
        merged.merge(batch, path, ["o_orderkey"], newer="updated_at", buckets=16)
    return merged.read(spark, path).select("o_orderkey", "status")


@query("""
with e as (select 'raw_' || event_id as raw_id, event_id, user_id as task, event_type as title, event_id % 2 = 0 as early from events),
w as (select task, title, coalesce(min(raw_id) filter (early), min(raw_id)) as raw_id from e group by task, title)
select w.raw_id, w.task, w.title from w join e on w.raw_id = e.raw_id where event_id % 10 <> 0""")
def snapshot_batches(spark, d):
    """Snapshots stored in two batches, one of them twice, and some deleted: a task's equal snapshots are stored once."""
    item = F.struct(
        F.lit(None).cast("string").alias("url"), F.col("event_type").alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("text", "published_at", "region", "media_name")],
        F.create_map(F.lit("file_path"), F.col("event_id").cast("string")).alias("extra"),
    )
    text = lambda c: F.lit(None).cast("string").alias(c)
    meta = F.struct(
        F.col("user_id").alias("search_task_id"), text("source"), text("competitor"), F.lit("t").alias("trigger"), text("source_request_url"), F.lit("2026-06-01T10:00:00").alias("fetched_at"),
        F.lit(1).alias("items_count"), text("empty_reason"), F.lit("new").alias("status"),
    )
    made = read(spark, d, "events").select(F.concat(F.lit("raw_"), F.col("event_id").cast("string")).alias("raw_id"), meta.alias("meta"), F.array(item).alias("items"), "event_id")
    path = fresh_folder(spark, "snapshots")
    for batch, rows in (("1", made.filter("event_id % 2 = 0")), ("2", made), ("1", made)):
        store.write_snapshots(rows.drop("event_id"), path, batch)
    store.delete_snapshots(made.filter("event_id % 10 = 0").select("raw_id"), path)
    return store.read_snapshots(spark, path).select("raw_id", F.col("meta.search_task_id").alias("task"), F.get("items", F.lit(0))["title"].alias("title"))


@query("""select c_custkey as id, case when c_nationkey % 4 = 3 then null when c_custkey % 7 = 0 then 'Ошибка генерации' when c_custkey % 5 = 0 then null else 'c-' || c_name end as comment,
case when c_nationkey % 4 = 3 then null else 'a-' || c_name end as action from customer""")
def model_batches(spark, d):
    """Comments and actions from clients that are called in batches inside the tasks: what one of them can't do fails alone."""

    def comment(batch: list[dict]) -> list:
        if any(row["id"] % 7 == 0 for row in batch):
            raise RuntimeError("no answer")
        return [None if row["id"] % 5 == 0 else f"c-{row['text']}" for row in batch]

    def action(batch: list[dict]) -> list:
        return [f"a-{row['text']}" for row in batch]

    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.concat(F.lit("p"), (F.col("c_nationkey") % 4 + 1).cast("string")).alias("priority"))
    out = enrichment.commented(rows, enrichment.batched(comment, size=1, calls=2, pause=0.0), enrichment.batched(action))
    return out.select("id", "comment", "action")


@query("""
with a as (select cast(c_custkey as varchar) as id, c_custkey % 9 = 0 as bad, c_custkey % 2 = 0 as early from customer where c_nationkey % 3 <> 0)
select id, case when bad then 'failed' else 'sent' end as status, case when bad then 'ConnectionError: no route' end as error, case when bad and early then 2 else 1 end as attempts from a""")
def delivered_alerts(spark, d):
    """Instant alerts handed to a sender in two batches, the first of them twice: what was sent isn't sent again, what failed is."""

    def send(row: dict) -> None:
        if row["id"] % 9 == 0:
            raise ConnectionError("no route")

    alerts = read(spark, d, "customer").filter("c_nationkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"))
    path = fresh_folder(spark, "deliveries")
    for batch, rows in (("1", alerts.filter("id % 2 = 0")), ("2", alerts), ("1", alerts)):
        store.delivered(rows, send, path, batch)
    return store.delivery_state(spark, path).select("id", "status", "error", F.col("attempts").cast("long").alias("attempts"))


@query("""
with e as (select *, event_type = 'error' as failed, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events),
s as (select *, cast(case when failed then sum(failed::int) over (partition by user_id, island order by ts, event_id rows unbounded preceding) else 0 end as int) as streak from e),
g as (select event_id, lag(event_type) over (partition by user_id order by ts, event_id) as before from events where event_type <> 'error')
select s.event_id as id, cast(user_id as varchar) as task, case when failed then 'error' when before is null then 'new' when before = event_type then 'unchanged' else 'changed' end as status, streak,
case when streak >= 3 then 'disabled' when streak > 0 then 'blocked' else 'open' end as state from s left join g on s.event_id = g.event_id""")
def watched_snapshots(spark, d):
    """Events as a stream of snapshots, in two runs of it from one checkpoint: change and circuit states out of kept state."""
    rows = read(spark, d, "events").select(F.col("user_id").cast("string").alias("task"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("fetched_at"), F.col("event_type").alias("content_hash"), (F.col("event_type") == "error").alias("failed"))
    path, out, at = (fresh_folder(spark, f"stream-{c}") for c in ("in", "out", "at"))
    middle = rows.agg(F.expr("timestamp_millis(cast((unix_millis(min(fetched_at)) + unix_millis(max(fetched_at))) / 2 as bigint))").alias("m")).first()["m"]
    for part in (rows.filter(F.col("fetched_at") < middle), rows.filter(F.col("fetched_at") >= middle)):
        part.write.mode("append").parquet(path)
        found = snapshots.watched(snapshots.arriving(spark, path, snapshots.WATCHED), days=3650)
        found.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("id", "task", "status", "streak", "state")


_NEWS = "case when page_id % 11 = 0 then '{\"url\":\"u\",\"title\":\"t\",\"extra\":{\"news\":[{\"ex_title\":\"x\"},{\"ex_text\":\"about SEVEN days\"}]}}' when page_id % 19 = 0 then '{\"url\":\"u\",\"title\":\"t\",\"region\":7}' else '{\"url\":\"u\",\"title\":\"t\"}' end"


@query(f"""
with i as (select page_id // 5 as snapshot, page_id as pos, case when page_id % 13 = 0 then '' else 'http://h/' || (page_id % 4) || '/' end as u, case when page_id % 17 = 0 then null else 'title ' || page_id end as title, {_NEWS} as payload from pages),
k as (select *, nullif(rtrim(u, '/'), '') as key from i),
c as (select snapshot, count(*) as n, max((pos % 11 = 0)::int) as hit from i group by snapshot)
select snapshot, pos, 'SCHEMA' as level, 'url' as field, 'required' as rule from i where u = '' union all
select snapshot, pos, 'SCHEMA', 'title', 'required' from i where title is null union all
select snapshot, pos, 'TYPES', 'region', 'not a text' from i where pos % 19 = 0 and pos % 11 <> 0 union all
select snapshot, pos, 'BUSINESS', 'title', 'shorter than 8' from i where length(title) < 8 union all
select snapshot, pos, 'CONSISTENCY', 'url', 'repeated' from (select *, row_number() over (partition by snapshot, key order by pos) as r from k where key is not null) where r > 1 union all
select snapshot, null, 'VOLUME', null, 'under 0.8 of the expected items' from c where snapshot % 3 = 0 and n / 8 < 0.8 union all
select snapshot, null, 'RELEVANCE', null, 'no item names the target' from c where snapshot % 2 <> 0 and hit = 0""")
def gate_errors(spark, d):
    """A row for each single error of the gate; the target may be named in the news that an item lists."""
    i = F.col("page_id")
    url = F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("http://h/"), (i % 4).cast("string"), F.lit("/")))
    payload = F.when(i % 11 == 0, '{"url":"u","title":"t","extra":{"news":[{"ex_title":"x"},{"ex_text":"about SEVEN days"}]}}').when(i % 19 == 0, '{"url":"u","title":"t","region":7}').otherwise('{"url":"u","title":"t"}')
    items = read(spark, d, "pages").select(F.floor(i / 5).alias("snapshot"), i.alias("pos"), url.alias("url"), F.when(i % 17 != 0, F.concat(F.lit("title "), i.cast("string"))).alias("title"), F.lit(None).cast("string").alias("text"), payload.alias("payload"))
    s = F.col("snapshot")
    aim = items.select("snapshot").distinct().select("snapshot", F.when(s % 3 == 0, 8).alias("expected"), F.lit("").alias("competitor"), F.when(s % 2 != 0, "seven").alias("trigger"))
    return gate.errors(items, aim, {"title": 8}).select("snapshot", "pos", "level", "field", "rule")


@query("""
with b as (select doc_id, text, string_split(text, chr(10)) as xs from documents where text is not null and len(text) <= 400)
select doc_id, 1 as n_chunks, cast(0 as bigint) as first_block, cast(len(xs) - 1 as bigint) as last_block, md5(text) as digest from b""")
def short_chunks(spark, d):
    """Documents that fit into a chunk of blocks are that chunk, from their first line to their last."""
    rows = read(spark, d, "documents").filter("text is not null and length(text) <= 400").select("doc_id", markup.packed_blocks(F.split("text", "\n"), 400, 60).alias("c"))
    c = F.get("c", F.lit(0))
    return rows.select("doc_id", F.size("c").alias("n_chunks"), c["first"].cast("long").alias("first_block"), c["last"].cast("long").alias("last_block"), F.md5(c["text"].cast("binary")).alias("digest"))


@query("""
with p as (select page_id, case page_id % 6 when 0 then '../a/./' || page_id when 1 then './b/../' || page_id || '?q=1' when 2 then '?only' when 3 then '//other.example/x/../y' when 4 then '/root/../' || page_id else '#top' end as link from pages)
select page_id, case page_id % 6 when 0 then 'http://h.example/d/a/' || page_id when 1 then 'http://h.example/d/e/' || page_id || '?q=1' when 2 then 'http://h.example/d/e/f?only' when 3 then 'http://other.example/y' when 4 then 'http://h.example/' || page_id else 'http://h.example/d/e/f?p=1#top' end as address from p""")
def resolved_links(spark, d):
    """Relative links of every form against a page's address."""
    i = F.col("page_id").cast("string")
    kind = F.col("page_id") % 6
    link = F.when(kind == 0, F.concat(F.lit("../a/./"), i)).when(kind == 1, F.concat(F.lit("./b/../"), i, F.lit("?q=1"))).when(kind == 2, "?only").when(kind == 3, "//other.example/x/../y").when(kind == 4, F.concat(F.lit("/root/../"), i)).otherwise("#top")
    return read(spark, d, "pages").select("page_id", urls.absolute(link, F.lit("http://h.example/d/e/f?p=1")).alias("address"))


def _raw_events(spark, d):
    """Snapshots as the stages read them: an event is a snapshot of its user's task with two items."""
    e = F.col("event_id")
    item = lambda url, title, text: F.struct(url.alias("url"), title.alias("title"), text.alias("text"), F.lit("05.01.2024").alias("published_at"), F.concat(F.lit(" City "), (F.col("user_id") % 5).cast("string")).alias("region"))
    first = item(F.concat(F.lit("https://www.h"), (e % 9).cast("string"), F.lit(".ru/a")), F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("Title "), (e % 50).cast("string"))), F.when(e % 13 == 0, "a casino text").otherwise("text"))
    second = item(F.lit("https://spam.ru/b"), F.concat(F.lit("Other "), e.cast("string")), F.lit(None).cast("string"))
    data = F.struct(F.struct(F.concat(F.lit("Firm "), (F.col("user_id") % 7).cast("string")).alias("competitor")).alias("meta"), F.array(first, second).alias("items"))
    return read(spark, d, "events").select(e.alias("id"), F.col("user_id").alias("search_task_id"), F.when(F.col("event_type") == "error", "error").otherwise("new").alias("status"), F.col("ts").alias("created_at"), data.alias("raw_data"))


@query("""
with l as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type <> 'error') where rn = 1 and event_id % 4 <> 0),
i as (
  select event_id, user_id, 0 as pos, case when event_id % 11 = 0 then '' else 'Title ' || (event_id % 50) end as t, case when event_id % 13 = 0 then 'a casino text' else 'text' end as x, 'h' || (event_id % 9) || '.ru' as domain from l union all
  select event_id, user_id, 1, 'Other ' || event_id, null, 'spam.ru' from l),
k as (select *, row_number() over (partition by user_id % 7, user_id % 5, case when t = '' then 'no title' else lower(t) end order by event_id, pos) as rn from i)
select event_id as raw_item_id, cast(pos as int) as pos, cast(user_id % 7 as bigint) as competitor_id, case when user_id % 5 < 3 then cast(user_id % 5 + 10 as bigint) end as region_id, cast(user_id % 3 as bigint) as source_id, domain as media_domain,
case when t = '' then 'parse_error' when domain in ('spam.ru', 'h3.ru') then 'black_domain' when contains(coalesce(x, ''), 'casino') then 'stop_word' end as reject_reason from k where rn = 1""")
def normalized_items(spark, d):
    """Snapshots to clean items: the newest of each task, joins by names and aliases, a table of black domains, the first of each key."""
    from tidewire.plans import stages

    raw = _raw_events(spark, d)
    done = raw.filter("id % 4 = 0").select(F.col("id").alias("raw_item_id"))
    competitors = spark.range(7).select("id", F.concat(F.lit("FIRM "), F.col("id").cast("string")).alias("name"), F.lit(True).alias("is_active"))
    regions = spark.range(3).select((F.col("id") + 10).alias("id"), F.array(F.concat(F.lit("City "), F.col("id").cast("string")), F.concat(F.lit("г. "), F.col("id").cast("string"))).alias("name_aliases"))
    tasks = raw.select(F.col("search_task_id").alias("id")).distinct().select("id", (F.col("id") % 3).alias("source_id"))
    black = spark.createDataFrame([("spam.ru", True), ("h3.ru", True), ("h4.ru", False)], "domain string, is_active boolean")
    out = stages.normalized(stages.items(stages.pending_snapshots(raw, done)), competitors, regions, tasks, black, [("casino", "stop_word")])
    return out.select("raw_item_id", "pos", "competitor_id", "region_id", "source_id", "media_domain", "reject_reason")


@query("""
with m as (select o_orderkey as id, o_custkey from orders where o_orderkey % 5 <> 0 and o_orderpriority in ('1-URGENT', '2-HIGH'))
select m.id as showcase_event_id, t.task, cast(c_nationkey as bigint) as department_id, 'new' as status from m join customer on o_custkey = c_custkey, (values (1, 'call '), (2, 'write ')) as v(n, verb), lateral (select verb || c_name as task) t
where c_nationkey <> 7 and (n = 1 or c_custkey % 2 = 0)""")
def made_actions(spark, d):
    """A row for each task of an urgent event that has made none yet."""
    from tidewire.plans import stages

    orders, customer = read(spark, d, "orders"), read(spark, d, "customer")
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "П1").when(F.col("o_orderpriority") == "2-HIGH", "П2").otherwise("П3")
    mart = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("categorized_event_id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("action_items_generated_at"), label.alias("priority"))
    tasks = F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat(F.lit("call "), "c_name"), F.concat(F.lit("write "), "c_name"))).otherwise(F.array(F.concat(F.lit("call "), "c_name")))
    gold = customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") != 7, F.col("c_nationkey")).cast("long").alias("department_id"), tasks.alias("task"), F.lit(None).cast("date").alias("deadline"), F.lit("r").alias("expected_result"))
    return stages.action_items(mart, gold).select("showcase_event_id", "task", "department_id", "status")


@query("""
with e as (select o_orderkey as event_id, case when o_orderkey % 3 = 0 then 'a court case' when o_orderkey % 3 = 1 then 'a tender' else 'nothing' end as title, o_orderpriority as priority from orders where o_orderkey % 4 <> 0 or o_orderkey % 8 = 0),
t as (select *, case when title = 'a court case' then 1 when title = 'a tender' then 2 end as kind from e),
r as (
  select event_id, 10 as user_id, 'instant' as mode from t where kind = 1 and priority = '1-URGENT' union all select event_id, 12, 'digest' from t where kind = 2 and priority = '2-HIGH' union all
  select event_id, 10, 'digest' from t where priority = '1-URGENT' and coalesce(kind, 0) <> 1 union all select event_id, 11, 'instant' from t where priority = '1-URGENT')
select event_id, cast(user_id as bigint) as user_id, mode from r where not (event_id % 7 = 0 and user_id = 11)""")
def rechecked_alerts(spark, d):
    """Alerts of events that were never checked or have changed since, by type and priority, without those that are stored."""
    from tidewire.plans import stages

    k = F.col("o_orderkey")
    checked = F.when(k % 8 == 0, F.lit("2026-01-01")).when(k % 4 == 0, F.lit("2026-03-01"))
    mart = read(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, "a court case").when(k % 3 == 1, "a tender").otherwise("nothing").alias("title"), F.col("o_orderpriority").alias("priority"), F.lit("2026-02-01").cast("timestamp").alias("updated_at"), checked.cast("timestamp").alias("alerted_at"))
    types = spark.createDataFrame([(2, ["TENDER"]), (1, ["court", "case"])], "id long, keywords array<string>")
    routing = spark.createDataFrame([(1, "1-URGENT", 10, 1, "instant"), (None, "1-URGENT", 10, 1, "digest"), (None, "1-URGENT", 11, 1, "instant"), (2, "2-HIGH", 12, 1, "digest")], "event_type_id long, priority string, user_id long, channel_id long, mode string")
    stored = mart.filter("id % 7 = 0").select(F.col("id").alias("showcase_event_id"), F.lit(11).cast("long").alias("user_id"), F.lit(1).cast("long").alias("channel_id"))
    return stages.alerts(mart, types, routing, stored).select("event_id", "user_id", "mode")


@query("select o_orderkey as id from orders where o_orderstatus <> 'P' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def uncategorized_items(spark, d):
    """Valid items without an event, against a layer of events that has many."""
    silver = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("ok").alias("status"))
    gold = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("normalized_item_id"))
    return enrichment.not_categorized(silver, gold).select("id")


@query("""
with c as (select c_custkey, 'Ж' || chr(1072 + cast(c_custkey % 5 as int)) || 'щ' as word from customer)
select c_custkey, case when c_custkey % 3 = 0 then 'ООО «' || word || '» group|«' || word || '» group|«' || word || '»|«' || latin || '»|' || c_custkey when c_custkey % 3 = 1 then word || ' AI|' || word || '|' || latin || '|' || c_custkey else 'Acme|' || c_custkey end as terms
from (select *, 'ZH' || substring('abvgd', cast(c_custkey % 5 as int) + 1, 1) || 'sch' as latin from c)""")
def name_terms(spark, d):
    """Every search term of a company, in order: its name, without legal form, without buzzwords, transcribed, its number."""
    k = F.col("c_custkey")
    word = F.concat(F.lit("Ж"), F.element_at(F.array(*[F.lit(x) for x in "абвгд"]), (k % 5 + 1).cast("int")), F.lit("щ"))
    name = F.when(k % 3 == 0, F.concat(F.lit("ООО «"), word, F.lit("» group"))).when(k % 3 == 1, F.concat(word, F.lit(" AI"))).otherwise("Acme")
    return read(spark, d, "customer").select("c_custkey", F.array_join(values.name_variants(name, k.cast("string")), "|").alias("terms"))


_DIGIT = "cast(substring(s, {0}, 1) as int)"
_SUM = " + ".join(f"{_DIGIT.format(i + 1)} * {w}" for i, w in enumerate((2, 4, 10, 3, 5, 9, 4, 6, 8)))


@query(f"""
with n as (select c_custkey, lpad(cast(c_custkey * 7919 % 10000000000 as varchar), 10, '0') as s, c_name from customer)
select c_custkey, ({_SUM}) % 11 % 10 = {_DIGIT.format(10)} as valid, left(md5(c_name), 12) as short, replace(c_name, '#', '_') || '_' as file, c_custkey || ' inside' as inside,
sha256('<p  >' || c_name || '</p>') as page_hash, date '2024-01-01' + cast(c_custkey % 300 as int) as day from n""")
def value_checks(spark, d):
    """Check digits, short digests, file names, text between marks, page hashes without volatile attributes, dates in three forms."""
    from tidewire.functions import text

    k = F.col("c_custkey")
    s = F.lpad((k * 7919 % 10_000_000_000).cast("string"), 10, "0")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int"))
    months = F.element_at(F.array(*[F.lit(m) for m in values.MONTHS]), F.month(day))
    written = F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "d.MM.yyyy")).otherwise(F.concat_ws(" ", F.dayofmonth(day).cast("string"), months, F.year(day).cast("string")))
    page = F.concat(F.lit('<p nonce="'), k.cast("string"), F.lit('" data-token="x">'), "c_name", F.lit("</p>"))
    return read(spark, d, "customer").select(
        "c_custkey", values.inn_valid(s).alias("valid"), values.digest(F.col("c_name")).alias("short"), values.file_name(F.concat("c_name", F.lit("/"))).alias("file"),
        text.between(F.concat(F.lit("x[ "), k.cast("string"), F.lit(" inside ] y")), "[", "]").alias("inside"), values.stable_page_hash(page).alias("page_hash"), values.parsed_date(written).alias("day"),
    )


@query("select l_orderkey, l_linenumber, l_suppkey from lineitem order by l_orderkey desc, l_linenumber, l_suppkey, l_partkey limit 50 offset 5000")
def deep_page(spark, d):
    """A page far behind the first: one range of the order is read for it."""
    path, order = fresh_folder(spark, "ordered"), [F.desc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey"), F.asc("l_partkey")]
    mart.write_ordered(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), order, path)
    return mart.page_at(spark, path, order, 50, 5000).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""
with m as (select max(ts) as now, max(ts) - interval 3 hour as run from events),
a as (select event_id, user_id, event_type, ts, now, run, ts >= now - interval 1 day as e, row_number() over (partition by user_id, ts >= now - interval 1 day order by ts desc, event_id desc) as rn from events, m),
b as (select *, e and rn > 2 as gone_a, ts >= run as in_run from a),
c as (select *, row_number() over (partition by event_type, in_run and not gone_a order by ts desc, event_id desc) as rn2 from b),
d as (select *, gone_a or (in_run and not gone_a and rn2 > 4) as gone_b, ts >= now - interval 7 day as week from c),
f as (select *, row_number() over (partition by user_id, week and not gone_b order by ts desc, event_id desc) as rn3 from d)
select event_id as id, case when gone_b or (week and not gone_b and rn3 > 3) then 'noise_limit' end as reject_reason from f""")
def limit_windows(spark, d):
    """Limits over a day, the run and a week, one after another."""
    items = read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").alias("created_at"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reject_reason"))
    last = items.agg(F.max("created_at").alias("now"), (F.max("created_at") - F.expr("interval 3 hours")).alias("run"))
    limits = [("user_id", "day", 2), ("event_type", "run", 4), ("user_id", "week", 3)]
    return rows.over_limits(items.crossJoin(F.broadcast(last)), limits, F.col("now"), F.col("run")).select("id", "reject_reason")
