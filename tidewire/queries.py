"""The registered queries of the library over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text, urls, values
from tidewire.operators import quality, rows, rules
from tidewire.plans import mart

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Inline rule tables of the queries: stop phrases, black domains, keywords of event types, routing rules.
PHRASES = [("casino", "stop_word"), ("license", "stop_topic"), ("clown", "false_positive"), ("%%%", "stop_word")]
BLACK = ("www.cheap-pills.example.com", "cheap-pills.example.com")
TYPES = [(1, ["green", "red"]), (2, ["blue"]), (3, ["a", "e"])]
ROUTES = [(1, "1-URGENT", 10, 1, "instant"), (None, "1-URGENT", 10, 1, "digest"), (None, "1-URGENT", 11, 1, "instant"), (2, "2-HIGH", 12, 2, "instant"), (None, "5-LOW", 13, 2, "digest")]


def query(sql: str = ""):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _latest(spark, d):
    return rows.newest(read(spark, d, "events").filter("event_type <> 'error'"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("""
select event_type, count(*) as n, max(event_id) as last_id from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type <> 'error') t
where rn = 1 group by event_type""")
def latest_snapshot(spark, d):
    return _latest(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("""
select event_id, user_id from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type <> 'error') t
where rn = 1 and user_id not in (select user_id from events where event_type = 'purchase' and value > 150)""")
def pending_snapshots(spark, d):
    done = read(spark, d, "events").filter("event_type = 'purchase' and value > 150").select("user_id")
    return _latest(spark, d).join(done, "user_id", "left_anti").select("event_id", "user_id")


@query("""
select event_id, user_id, case when row_number() over w = 1 then 'new' when lag(md5(event_type)) over w = md5(event_type) then 'unchanged' else 'changed' end as status
from events window w as (partition by user_id order by ts, event_id)""")
def change_status(spark, d):
    found = rows.change_status(read(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], F.md5(F.col("event_type").cast("binary")))
    return found.select("event_id", "user_id", "status")


@query("""
with e as (select event_id, user_id, ts, event_type = 'error' as failed, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events)
select event_id, user_id, cast(case when failed then sum(failed::int) over (partition by user_id, island order by ts, event_id rows unbounded preceding) else 0 end as bigint) as streak,
  case when failed then sum(failed::int) over (partition by user_id, island order by ts, event_id rows unbounded preceding) else 0 end >= 3 as disabled from e""")
def consecutive_failures(spark, d):
    found = rows.streaks(read(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error")
    return found.select("event_id", "user_id", F.col("streak").cast("long").alias("streak"), "disabled")


def _items(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").alias("created_at"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reject_reason"))


def _recent(df, days):
    """``df`` with the start of its look-back: a one-row table beside it, not a job of its own while the plan is made."""
    last = df.agg((F.max("created_at") - F.expr(f"interval {days} days")).alias("since"))
    return df.crossJoin(F.broadcast(last))


def _limit_sql(key: str) -> str:
    return f"""
with m as (select max(ts) - interval 7 day as since from events),
e as (select event_id, ts >= since as eligible, sum(case when ts >= since then 1 else 0 end) over (partition by {key} order by ts desc, event_id desc rows unbounded preceding) as rn from events, m)
select event_id as id, case when eligible and rn > 3 then 'rejected' else 'ok' end as status from e"""


@query(_limit_sql("user_id"))
def anti_noise_user(spark, d):
    return rows.limited(_recent(_items(spark, d), 7), "user_id", 3, F.col("since")).select("id", "status")


@query(_limit_sql("event_type"))
def anti_noise_type(spark, d):
    return rows.limited(_recent(_items(spark, d), 7), "event_type", 3, F.col("since")).select("id", "status")


@query("""
with m as (select max(ts) - interval 7 day as since from events),
a as (select event_id, user_id, event_type, ts, since, ts >= since as eligible, row_number() over (partition by user_id, ts >= since order by ts desc, event_id desc) as rn from events, m),
b as (select *, eligible and rn > 3 as gone from a),
c as (select *, row_number() over (partition by event_type, eligible and not gone order by ts desc, event_id desc) as rn2 from b)
select event_id as id, case when gone or (eligible and rn2 > 20) then 'rejected' else 'ok' end as status, case when gone or (eligible and rn2 > 20) then 'noise_limit' end as reject_reason from c""")
def anti_noise_chain(spark, d):
    df = _recent(_items(spark, d), 7)
    for key, most in (("user_id", 3), ("event_type", 20)):
        df = rows.limited(df, key, most, F.col("since"))
    return df.select("id", "status", "reject_reason")


_DECODED = "html"
for _a, _b in text.ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"


def _one_spaced(x: str) -> str:
    return rf"nullif(trim(regexp_replace({x}, '\s+', ' ', 'g')), '')"


def _drop(x: str, element: str, attributes: str = "[^>]*>") -> str:
    return rf"regexp_replace({x}, '(?is)<{element}{attributes}.*?</{element}>', ' ', 'g')"


def _decode(x: str) -> str:
    return _DECODED.replace("html", x, 1) if x != "html" else _DECODED


@query(f"""
select page_id, {_one_spaced(_decode("regexp_replace(" + _drop(_drop("html", "script"), "style") + ", '<[^>]+>', ' ', 'g')"))} as body from pages""")
def clean_html(spark, d):
    return read(spark, d, "pages").select("page_id", text.clean(F.col("html")).alias("body"))


@query()
def nfkc_clean(spark, d):
    return read(spark, d, "pages").select("page_id", text.clean_full(F.col("html")).alias("body"))


@query(f"""select page_id, nullif(trim({_decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), '') as title from pages""")
def page_title(spark, d):
    return read(spark, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


_plain = "html"
for _e in text.SIDE_ELEMENTS:
    _plain = _drop(_plain, _e, "[ >]")


@query(f"""select page_id, {_one_spaced(_decode(f"regexp_replace({_plain}, '<[^>]+>', ' ', 'g')"))} as body from pages""")
def plain_text(spark, d):
    return read(spark, d, "pages").select("page_id", text.plain_text(F.col("html")).alias("body"))


@query("""
select page_id, i - 1 as pos, l[i] as link, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || l[i] as address
from (select page_id, url, l, unnest(range(1, len(l) + 1)) as i from (select page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) as l from pages))
where starts_with(l[i], '/') and not starts_with(l[i], '//')""")
def page_links(spark, d):
    found = read(spark, d, "pages").select("page_id", "url", F.posexplode(urls.links(F.col("html"))).alias("pos", "link"))
    found = found.filter(F.startswith("link", F.lit("/")) & ~F.startswith("link", F.lit("//")))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "link", urls.absolute(F.col("link"), F.col("url")).alias("address"))


@query(r"""select page_id, nullif(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\.', ''), '') as domain from pages""")
def url_domain(spark, d):
    return read(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


_NOISE = ", ".join(f"'{p}'" for p in urls.NOISE_PARAMETERS)
_KEY = rf"""
nullif(rtrim(case when kept = '' then base else base || '?' || kept end, '/'), '') as key from (
  select *, split_part(bare, '?', 1) as base, array_to_string(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' and split_part(p, '=', 1) not in ({_NOISE})), '&') as kept
  from (select page_id, url, split_part(url, '#', 1) as bare from pages))"""


@query(f"select page_id, {_KEY}")
def url_key(spark, d):
    return read(spark, d, "pages").select("page_id", urls.url_key(F.col("url")).alias("key"))


_SERVICE = " or ".join(f"contains(regexp_extract(url, '^([^?#]*)', 1), '{p}')" for p in urls.SERVICE_PATHS)


@query(f"select page_id, ({_SERVICE}) as service, starts_with(lower(regexp_extract(url, '//([^/?#]*)', 1)), 'adsrv.') as ad, lower(split_part(url, ':', 1)) in ('http', 'https') as fetchable from pages")
def url_flags(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", urls.is_service(u).alias("service"), urls.is_ad(u).alias("ad"), urls.is_fetchable(u).alias("fetchable"))


@query(f"select * from (select page_id, key, row_number() over (partition by key order by page_id) as nth from (select page_id, {_KEY}) where key is not null) where nth > 1")
def consistency_dups(spark, d):
    found = quality.duplicates(read(spark, d, "pages").select("page_id", "url"), urls.url_key(F.col("url")), "page_id")
    return found.select("page_id", "key", F.col("nth").cast("long").alias("nth"))


_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"select doc_id, {_NORM.format('text')} as body from documents")
def norm_text(spark, d):
    return read(spark, d, "documents").select("doc_id", text.norm(F.col("text")).alias("body"))


_DEDUP = f"sha256(coalesce(lang, '') || '|' || {_NORM.format('text')} || '|' || coalesce(source, ''))"


@query(f"select doc_id, {_DEDUP} as dedup_key from documents")
def dedup_key(spark, d):
    return read(spark, d, "documents").select("doc_id", values.dedup_key(F.col("lang"), F.col("source"), title=F.col("text")).alias("dedup_key"))


@query(f"select min(doc_id) as doc_id, {_DEDUP} as dedup_key from documents group by all")
def dedup_first_wins(spark, d):
    keyed = read(spark, d, "documents").select("doc_id", values.dedup_key(F.col("lang"), F.col("source"), title=F.col("text")).alias("dedup_key"))
    return rows.insert_ignore(keyed, keyed.limit(0), ["dedup_key"], [F.asc("doc_id")])


_REASON = "case " + " ".join(f"when contains(lower(coalesce(text, '')), '{p}') then '{r}'" for p, r in PHRASES) + " end"


@query(f"select doc_id, {_REASON} as reason from documents")
def reject_reasons(spark, d):
    return read(spark, d, "documents").select("doc_id", rules.first_phrase(F.col("text"), PHRASES).alias("reason"))


@query(f"""select r.reject_reason, count(x.reason) as n from (values ('black_domain'), ('stop_word'), ('stop_topic'), ('false_positive'), ('parse_error')) as r(reject_reason)
left join (select {_REASON} as reason from documents) x on x.reason = r.reject_reason group by r.reject_reason""")
def reject_breakdown(spark, d):
    from tidewire.plans.stages import reject_breakdown as breakdown

    return breakdown(read(spark, d, "documents").select(rules.first_phrase(F.col("text"), PHRASES).alias("reject_reason")))


@query("select page_id, regexp_extract(url, '//([^/?#]*)', 1) in ('www.cheap-pills.example.com', 'cheap-pills.example.com') as black from pages")
def black_domains(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/?#]*)", 1).isin(*BLACK).alias("black"))


@query("""
select doc_id, i as idx, length(substring(text, i * 7500 + 1, 8000)) as n, md5(substring(text, i * 7500 + 1, 8000)) as digest
from (select doc_id, text, unnest(range(0, greatest(0, cast(floor((length(text) - 501) / 7500) as int)) + 1)) as i from documents where length(text) > 0)""")
def char_chunks(spark, d):
    found = read(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("idx", "chunk"))
    return found.select("doc_id", F.col("idx").cast("long").alias("idx"), F.length("chunk").cast("long").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


_CUT = "coalesce(length(text) > 0 and (contains(right(rtrim(text), 8), '...') or contains(right(rtrim(text), 8), '…') or (length(rtrim(text)) >= 300 and right(rtrim(text), 1) not in ('.', '!', '?'))), false)"


@query(f"select doc_id, {_CUT} as truncated, coalesce(length(text) >= 300 and not {_CUT}, false) as confident from documents")
def truncated_flags(spark, d):
    return read(spark, d, "documents").select("doc_id", text.looks_truncated(F.col("text")).alias("truncated"), text.confident(F.col("text")).alias("confident"))


@query("""select lang, count(*) as n, count(distinct source) as sources, round(count(*) * count(distinct source) / (select count(distinct source) from documents), 4) as activity from documents group by lang""")
def media_index(spark, d):
    docs = read(spark, d, "documents").select("lang", "source")
    total = docs.agg(F.countDistinct("source").alias("active"))
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    # One row on the right side: the denominator.
    return counts.crossJoin(F.broadcast(total)).select("lang", "n", "sources", F.round(rules.activity_index(F.col("n"), F.col("sources"), F.col("active")), 4).alias("activity"))


_CATEGORY = {"1-URGENT": "Репутационный риск", "2-HIGH": " PR-активность конкурента ", "3-MEDIUM": "косвенное упоминание", "4-NOT SPECIFIED": "информационный шум"}
_CASE = lambda i: "case x " + " ".join(f"when '{r[0]}' then " + (f"'{r[i]}'" if r[i] else "null") for r in rules.CATEGORY_RULES) + f" else '{rules.UNKNOWN_CATEGORY[i - 1]}' end"


@query(f"""select o_orderkey, {_CASE(1)} as priority, {_CASE(2)} as term, {_CASE(3)} as department from (
select o_orderkey, lower(trim(case o_orderpriority {' '.join(f"when '{k}' then '{v}'" for k, v in _CATEGORY.items())} end)) as x from orders)""")
def category_rules(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", rules.labelled(F.col("o_orderpriority"), _CATEGORY).alias("category"))
    return rules.categorized(orders, "category").select("o_orderkey", "priority", "term", "department")


_P = "case when o_orderpriority = '1-URGENT' then 'p1' when o_orderpriority = '2-HIGH' then 'p2' else 'p3' end"


def _priority():
    return F.when(F.col("o_orderpriority") == "1-URGENT", "p1").when(F.col("o_orderpriority") == "2-HIGH", "p2").otherwise("p3")


@query(f"select o_orderkey, cast(case {_P} when 'p1' then cast(o_orderdate as date) + 2 when 'p2' then cast(o_orderdate as date) + 7 end as varchar) as deadline from orders")
def deadlines(spark, d):
    return read(spark, d, "orders").select("o_orderkey", values.deadline(F.col("o_orderdate").cast("date"), _priority()).cast("string").alias("deadline"))


_MART = f"""select o_orderkey, c_name, n_name, r_name, c_mktsegment, case {_P} when 'p1' then 'П1' when 'p2' then 'П2' else 'П3' end as priority, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as day
from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey"""


def _mart(spark, d):
    facts = read(spark, d, "orders").withColumn("priority", rules.labelled(_priority(), rules.PRIORITY_LABELS))
    out = mart.star(facts, [(read(spark, d, "customer"), "o_custkey", "c_custkey")], [(read(spark, d, "nation"), "c_nationkey", "n_nationkey"), (read(spark, d, "region"), "n_regionkey", "r_regionkey")])
    return out.select("o_orderkey", "c_name", "n_name", "r_name", "c_mktsegment", "priority", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(_MART)
def mart_build(spark, d):
    return _mart(spark, d)


@query("""select o_orderkey from orders where not (o_orderkey % 3 = 0) or o_orderdate > timestamp '1996-01-01'""")
def mart_republish(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    published = orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.expr("timestamp_ntz '1996-01-01 00:00:00'").alias("updated_at"))
    return mart.to_publish(orders, published, "o_orderkey", "o_orderdate", "updated_at").select("o_orderkey")


@query(f"select * from ({_MART}) where n_name ilike '%nation_1%' and priority = 'П1' and day between '1995-01-01' and '1997-12-31'")
def mart_filter(spark, d):
    return mart.filtered(_mart(spark, d), {"n_name": "Nation_1", "c_name": None}, {"priority": "П1"}, ("day", "1995-01-01"), ("day", "1997-12-31"))


@query(f"select * from ({_MART}) order by day desc nulls first, o_orderkey desc limit 50 offset 20")
def mart_page(spark, d):
    return mart.page(_mart(spark, d), [F.desc_nulls_first("day"), F.desc("o_orderkey")], 50, 20)


@query("""select 'segment' as kind, c_mktsegment as value from customer where trim(c_mktsegment) <> '' group by all
union all select 'brand', p_brand from part where trim(p_brand) <> '' group by all union all select 'nation', n_name from nation where trim(n_name) <> '' group by all
union all select 'first_day', strftime(min(o_orderdate), '%Y-%m-%d') from orders union all select 'last_day', strftime(max(o_orderdate), '%Y-%m-%d') from orders""")
def filter_options(spark, d):
    out = [mart.options(read(spark, d, t), c).select(F.lit(k).alias("kind"), "value") for k, t, c in (("segment", "customer", "c_mktsegment"), ("brand", "part", "p_brand"), ("nation", "nation", "n_name"))]
    days = read(spark, d, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    ends = F.array(F.struct(F.lit("first_day").alias("kind"), F.date_format("a", "yyyy-MM-dd").alias("value")), F.struct(F.lit("last_day").alias("kind"), F.date_format("b", "yyyy-MM-dd").alias("value")))
    return out[0].union(out[1]).union(out[2]).union(days.select(F.explode(ends).alias("x")).select("x.*"))


@query("select s_suppkey, s_name from supplier where s_nationkey = 7")
def scope_viewer(spark, d):
    return mart.scoped(read(spark, d, "supplier"), "viewer", 7, "s_nationkey").select("s_suppkey", "s_name")


@query("select n_nationkey, s_suppkey from nation, supplier where n_nationkey <> s_nationkey")
def task_matrix(spark, d):
    supplier = read(spark, d, "supplier")
    stored = supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return rows.matrix(read(spark, d, "nation").select("n_nationkey"), supplier.select("s_suppkey"), stored)


_TYPE = "case " + " ".join(f"when contains(lower(coalesce({{0}}, '')), '{k}') then {i}" for i, ks in TYPES for k in ks) + " end"


def _types(spark):
    return spark.createDataFrame(TYPES, "id long, keywords array<string>")


@query(f"select p_partkey, coalesce(cast({_TYPE.format('p_name')} as bigint), 0) as event_type_id from part")
def detect_type(spark, d):
    return rules.least_type(read(spark, d, "part").select("p_partkey", "p_name"), "p_name", _types(spark)).select("p_partkey", F.coalesce("event_type_id", F.lit(0)).alias("event_type_id"))


_ROUTES = "(values " + ", ".join(f"({a if a else 'cast(null as bigint)'}, '{p}', {u}, {c}, '{m}')" for a, p, u, c, m in ROUTES) + ") as r(t, priority, user_id, channel_id, mode)"
_ROUTED = f"""
with e as (select o_orderkey as event_id, cast(o_custkey % 3 + 1 as bigint) as event_type_id, o_orderpriority as priority from orders),
r as (select * from {_ROUTES}),
t as (select event_id, event_type_id, e.priority, user_id, channel_id, mode from e join r on r.t = e.event_type_id and r.priority = e.priority),
routed as (
  select * from t union all
  select event_id, event_type_id, e.priority, user_id, channel_id, mode from e join r on r.t is null and r.priority = e.priority
  where not exists (select 1 from t where t.event_id = e.event_id and t.user_id = r.user_id and t.channel_id = r.channel_id))"""


def _routed(spark, d):
    events = read(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 3 + 1).cast("long").alias("event_type_id"), F.col("o_orderpriority").alias("priority"))
    routing = spark.createDataFrame(ROUTES, "event_type_id long, priority string, user_id int, channel_id int, mode string")
    return rules.routed(events, F.broadcast(routing))


@query(f"{_ROUTED} select * from routed")
def route_alerts(spark, d):
    return _routed(spark, d)


@query(f"{_ROUTED} select event_id, user_id, channel_id, case when mode = 'instant' then 'sent' else 'queued' end as status from routed where not (event_id % 5 = 0 and user_id = 10 or event_id % 7 = 0 and channel_id = 2)")
def alerts_insert_ignore(spark, d):
    found = _routed(spark, d)
    stored = found.filter("event_id % 5 = 0 and user_id = 10 or event_id % 7 = 0 and channel_id = 2")
    new = rows.insert_ignore(found, stored, ["event_id", "user_id", "channel_id"], [F.asc("mode")])
    return new.select("event_id", "user_id", "channel_id", rules.delivery(F.col("mode"), F.lit("email"), F.lit(None).cast("boolean"), deliver=False).alias("status"))


@query("""select l_orderkey, min(l_linenumber) as first_line from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') group by l_orderkey""")
def first_alert(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return lines.join(lines.filter("l_returnflag = 'R'").select("l_orderkey"), "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_line"))


@query("select doc_id, count(*) as n_tasks, cast(sum(length(t)) as bigint) as n_chars from (select doc_id, unnest(string_split(text, chr(10))) as t from documents where source is not null) where trim(t) <> '' group by doc_id")
def explode_tasks(spark, d):
    tasks = read(spark, d, "documents").filter("source is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("t")).filter(F.trim("t") != "")
    return tasks.groupBy("doc_id").agg(F.count("*").alias("n_tasks"), F.sum(F.length("t")).alias("n_chars"))


@query("select distinct s_name as name from supplier where s_acctbal > 5000 and s_name not in (select s_name from supplier where s_suppkey % 4 = 0)")
def promote_sources(spark, d):
    from tidewire.plans.stages import promoted

    supplier = read(spark, d, "supplier")
    candidates = supplier.select(F.col("s_name").alias("domain"), F.col("s_acctbal").alias("score"), F.lit(True).alias("is_active"), F.lit("new").alias("status"))
    return promoted(candidates, supplier.filter("s_suppkey % 4 = 0").select(F.col("s_name").alias("name")), 5000.0)[0]


@query("""select count(*) as tasks, count(*) filter (event_type = 'purchase') as saved, count(*) filter (event_type = 'view') as unchanged, count(*) filter (event_type = 'error') as failed,
round(count(*) filter (event_type in ('purchase', 'view')) / count(*), 3) as success_rate, count(distinct user_id) as sources from events""")
def run_summary(spark, d):
    kind = F.col("event_type")
    found = read(spark, d, "events").agg(F.count("*").alias("tasks"), F.count_if(kind == "purchase").alias("saved"), F.count_if(kind == "view").alias("unchanged"), F.count_if(kind == "error").alias("failed"), F.countDistinct("user_id").alias("sources"))
    return found.withColumn("success_rate", F.round((F.col("saved") + F.col("unchanged")) / F.col("tasks"), 3))


@query("""with e as (select count(*) as rows, sum(case when trim(coalesce(source, '')) = '' then 1 else 0 end + case when trim(coalesce(text, '')) = '' then 1 else 0 end) as a, sum(case when length(text) < 300 then 1 else 0 end) as b from documents)
select 'SCHEMA' as level, cast(a as bigint) as errors, rows, a = 0 as passed, cast(rows - a as bigint) as passed_count from e union all select 'BUSINESS', cast(b as bigint), rows, b = 0, cast(rows - b as bigint) from e""")
def quality_levels(spark, d):
    return quality.report(read(spark, d, "documents").select("source", "text"), {"SCHEMA": quality.schema_errors(["source", "text"]), "BUSINESS": quality.business_errors({"text": 300})})


@query("""with l as (select page_id, regexp_extract(url, '//([^/?#]*)', 1) as host, list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) as links from pages),
p as (select page_id, links, lag(links) over w as before, lag(page_id) over w as other from l window w as (partition by host order by page_id))
select page_id, other, round(case when len(links) = 0 or len(before) = 0 then 0.0 else len(list_intersect(links, before)) / len(list_distinct(list_concat(links, before))) end, 6) as overlap from p where other is not null""")
def jaccard_links(spark, d):
    from pyspark.sql import Window as W

    over = W.partitionBy("host").orderBy("page_id")
    found = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/?#]*)", 1).alias("host"), F.array_distinct(urls.links(F.col("html"))).alias("links"))
    found = found.withColumn("before", F.lag("links").over(over)).withColumn("other", F.lag("page_id").over(over)).filter("other is not null")
    return found.select("page_id", "other", F.round(urls.jaccard(F.col("links"), F.col("before")), 6).alias("overlap"))


@query("""select page_id, regexp_matches(lower(html), 'ng-|angular|data-reactroot|id="app"|id="root"|vue|nuxt|next-data') as spa, regexp_matches(lower(html), 'captcha') as captcha,
regexp_matches(lower(html), 'cloudflare|cf-ray|cf-cache-status|datadome|qrator|qrator_jsr|__qrator|jsid|akamai|incapsula') as antibot, len(regexp_extract_all(html, '<a')) as n_links,
round(least(1.0, 0.2 * regexp_matches(lower(html), 'ng-|angular|data-reactroot|id="app"|id="root"|vue|nuxt|next-data')::int + 0.3 * regexp_matches(lower(html), 'captcha')::int + 0.3 * regexp_matches(lower(html), 'cloudflare|cf-ray|cf-cache-status|datadome|qrator|qrator_jsr|__qrator|jsid|akamai|incapsula')::int), 4) as complexity from pages""")
def classify_pages(spark, d):
    from tidewire.operators.classify import flags

    return flags(read(spark, d, "pages"), "html").select("page_id", "spa", "captcha", "antibot", F.col("n_links").cast("long").alias("n_links"), F.round("complexity", 4).alias("complexity"))


@query("select event_id, props ->> '$.k' as k from events")
def json_extra(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""select c_custkey, c_name as first_term,
len(list_distinct([c_name, trim(regexp_replace(c_name, '(?i)(\\s+(ии|ай|ai|llc|inc|group|групп))+$', '')), cast(c_custkey as varchar)])) as n_terms from customer""")
def name_variants(spark, d):
    found = read(spark, d, "customer").select("c_custkey", values.name_variants(F.col("c_name"), F.col("c_custkey").cast("string")).alias("v"))
    return found.select("c_custkey", F.array_min(F.slice("v", 1, 1)).alias("first_term"), F.size("v").cast("long").alias("n_terms"))


@query(f"select r_name, priority, count(*) as n_events, round(sum(o_totalprice), 2) as total from ({_MART}) group by all")
def market_map(spark, d):
    return _mart(spark, d).groupBy("r_name", "priority").agg(F.count("*").alias("n_events"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"select c_name, count(*) as n_events, count(*) filter (priority = 'П1') as urgent, min(day) as first_day, max(day) as last_day from ({_MART}) group by c_name")
def passport(spark, d):
    return _mart(spark, d).groupBy("c_name").agg(F.count("*").alias("n_events"), F.count_if(F.col("priority") == "П1").alias("urgent"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"select priority, day, count(*) as n_events from ({_MART}) group by priority, day")
def priority_feed(spark, d):
    return mart.feed(_mart(spark, d), "day", "priority")


@query("""select conv_id, coalesce(string_agg(text, chr(10) || chr(10) order by turn) filter (trim(coalesce(text, '')) <> ''), '') as body, count(*) as parts, count(*) filter (trim(coalesce(text, '')) = '') as dropped from conversations group by conv_id""")
def chunk_concat(spark, d):
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    parts = F.array_sort(F.collect_list(F.when(~blank, F.struct("turn", "text"))))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("body"), F.count("*").alias("parts"), F.count_if(blank).alias("dropped"))


@query("select c_custkey, case c_nationkey % 2 when 0 then c_mktsegment || '*' else c_mktsegment end as c_mktsegment from customer")
def patch_rows(spark, d):
    customer = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    patch = customer.filter("c_nationkey % 2 = 0").select("c_custkey", F.concat("c_mktsegment", F.lit("*")).alias("c_mktsegment"))
    return rows.patched(customer, patch, "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("select o_orderkey from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 1)")
def orphan_orders(spark, d):
    customer = read(spark, d, "customer").filter("c_custkey % 10 <> 1")
    return rows.orphans(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", customer, "c_custkey").select("o_orderkey")
