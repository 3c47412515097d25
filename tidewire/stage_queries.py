"""Registered queries of listings, summaries, enrichment, the quality gate, page classes, searches and state, with their SQL.

Importing this module adds them to ``tidewire.queries``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import targets, text
from tidewire.functions import urls as web
from tidewire.operators import enrichment, gate, listing, rows, sites, state, summaries
from tidewire.queries import query, read

# Action items of the listing queries: orders under the names of that layer.
_ACTIONS = "(select o_orderkey as id, o_custkey as showcase_event_id, o_orderpriority as task, o_custkey % 5 as department_id, o_orderstatus as status, o_custkey % 7 as assigned_user_id, cast(o_orderdate as date) as deadline from orders)"


def _actions(spark, d):
    return read(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey as showcase_event_id", "o_orderpriority as task", "o_custkey % 5 as department_id", "o_orderstatus as status", "o_custkey % 7 as assigned_user_id", "cast(o_orderdate as date) as deadline")


@query(f"""select id, task, cast(deadline as varchar) as deadline from {_ACTIONS} where task ilike '%urg%' and status = 'O' and deadline between date '1993-01-01' and date '1997-12-31'
and showcase_event_id in (select c_custkey from customer where c_mktsegment = (select min(c_mktsegment) from customer)) order by id desc limit 50""")
def action_listing(spark, d):
    customer = read(spark, d, "customer")
    least = customer.agg(F.min("c_mktsegment").alias("least"))
    mart = customer.crossJoin(F.broadcast(least)).select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == F.col("least"), "П1").otherwise("П2").alias("priority"))
    found = listing.action_listing(_actions(spark, d), mart, {"task": "urg", "status": "O", "deadline_from": "1993-01-01", "deadline_to": "1997-12-31"}, priority="П1", limit=50)
    return found.select("id", "task", F.col("deadline").cast("string").alias("deadline"))


@query("""
select 'raw_items' as layer, id from (select event_id as id from events where event_type = 'error' and ts >= timestamp '2024-01-01' order by event_id desc limit 20)
union all select 'normalized_items', id from (select doc_id as id from documents where lang = 'en' and text ilike '%the%' order by doc_id desc limit 20 offset 5)
union all select 'categorized_events', id from (select o_orderkey as id from orders where o_orderpriority = '2-HIGH' and o_orderdate <= timestamp '1996-06-30' order by o_orderkey desc limit 20)
union all select 'alerts', id from (select l_orderkey * 8 + l_linenumber as id from lineitem where l_returnflag = 'R' and l_linestatus = 'F' order by 2 - 2, l_orderkey * 8 + l_linenumber desc limit 20)
union all select 'candidates', id from (select s_suppkey as id from supplier where s_name ilike '%1%' and s_nationkey = 3 order by s_suppkey desc limit 20)
union all select 'users', id from (select c_custkey as id from customer where c_name ilike '%9%' and c_nationkey = 4 order by c_custkey desc limit 20)""")
def layer_pages(spark, d):
    raw = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    silver = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("lang").alias("status"))
    gold = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("categorized_at"))
    alerts = read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("mode"))
    candidates = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("domain"), F.col("s_nationkey").alias("competitor_id"))
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_nationkey").alias("department_id"))
    pages = [
        ("raw_items", raw, {"status": "error", "created_at_from": "2024-01-01"}, 0), ("normalized_items", silver, {"status": "en", "title": "the"}, 5),
        ("categorized_events", gold, {"priority": "2-HIGH", "categorized_at_to": "1996-06-30"}, 0), ("alerts", alerts, {"status": "R", "mode": "F"}, 0),
        ("candidates", candidates, {"domain": "1", "competitor_id": 3}, 0), ("users", users, {"full_name": "9", "department_id": 4}, 0),
    ]
    found = [listing.listing(df, layer, asked, 20, offset).select(F.lit(layer).alias("layer"), "id") for layer, df, asked, offset in pages]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


@query("select s_suppkey as id, s_name as name from supplier where s_name ilike '%_0%' and s_nationkey in (1, 2, 3) and s_suppkey in (select l_suppkey from lineitem where l_returnflag = 'R') order by s_suppkey limit 30 offset 3")
def dimension_page(spark, d):
    dim = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    dim = listing.among(listing.among(dim, "nation", [1, 2, 3]), "id", read(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey"))
    return listing.dimension(dim, "name", "_0", limit=30, offset=3).select("id", "name")


@query("select c_custkey as id, c_name as name from customer where c_custkey = 17")
def point_lookup(spark, d):
    return listing.by_id(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), 17)


@query(f"""
select 'user' as kind, cast(id as varchar) as value, label, cast(null as bigint) as place from (select distinct s_suppkey as id, s_name as label from supplier join {_ACTIONS} a on s_suppkey = a.assigned_user_id)
union all select 'department', cast(id as varchar), label, null from (select distinct n_nationkey as id, n_name as label from nation join {_ACTIONS} a on n_nationkey = a.department_id)
union all select 'priority', value, null, case value when '1-URGENT' then 0 when '2-HIGH' then 1 else 3 end from (select distinct o_orderpriority as value from orders) where value in ('1-URGENT', '2-HIGH', '5-LOW')""")
def option_joins(spark, d):
    actions = _actions(spark, d)
    users = listing.used_options(actions, "assigned_user_id", read(spark, d, "supplier").withColumnRenamed("s_suppkey", "id"), "s_name")
    departments = listing.used_options(actions, "department_id", read(spark, d, "nation").withColumnRenamed("n_nationkey", "id"), "n_name")
    order = listing.in_domain_order(read(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NONE", "5-LOW"])
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("value"), "label", F.lit(None).cast("long").alias("place"))
    return named(users, "user").union(named(departments, "department")).union(order.select(F.lit("priority").alias("kind"), "value", F.lit(None).cast("string").alias("label"), F.col("place").cast("long").alias("place")))


@query("""
select n_nationkey as id, case when n_nationkey % 6 = 1 then n_name || '!' else n_name end as name, n_nationkey not in (2, 4) as is_active from nation
union all select (select max(n_nationkey) from nation) + row_number() over (order by r_name), r_name, true from region""")
def dimension_writes(spark, d):
    dim = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(True).alias("is_active"))
    new = read(spark, d, "region").select(F.col("r_name").alias("name"), F.lit(True).alias("is_active"))
    patch = dim.filter("id % 6 = 1").select("id", F.concat("name", F.lit("!")).alias("name"))
    return listing.soft_deleted(listing.updated(listing.inserted(dim, new), patch, ["name"]), [2, 4])


@query(f"""
with a as (select id, case when id % 50 = 0 then 10000000 else showcase_event_id end as e, case when id % 70 = 0 then 99 else department_id end as dep, case when id % 9 = 0 then null else assigned_user_id end as u from {_ACTIONS})
select a.id, case when c_custkey is null then 'no such event' when dep is not null and n_nationkey is null then 'no such department'
  when u is not null and s_suppkey is null then 'no such user' when u is not null and s_nationkey is distinct from dep then 'user of another department' end as problem
from a left join customer on e = c_custkey left join nation on dep = n_nationkey left join supplier on u = s_suppkey""")
def write_problems(spark, d):
    actions = _actions(spark, d).selectExpr("id", "case when id % 50 = 0 then 10000000L else showcase_event_id end as showcase_event_id", "case when id % 70 = 0 then 99L else department_id end as department_id", "case when id % 9 = 0 then null else assigned_user_id end as assigned_user_id")
    dim = lambda t, k, *more: read(spark, d, t).select(F.col(k).alias("id"), *more)
    found = listing.write_problems(actions, dim("customer", "c_custkey"), dim("nation", "n_nationkey"), dim("supplier", "s_suppkey", F.col("s_nationkey").alias("department_id")))
    return found.select("id", "problem")


@query("select o_orderkey as id, case when o_orderstatus <> 'O' then 'task inactive' when o_custkey % 3 = 0 then 'source inactive' when coalesce(c_acctbal, -1) < 0 then 'competitor inactive' end as reason from orders left join customer on o_custkey = c_custkey")
def skip_reasons(spark, d):
    joined = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(F.col("o_orderkey").alias("id"), listing.skip_reason(F.col("o_orderstatus") == "O", F.col("o_custkey") % 3 != 0, F.col("c_acctbal") >= 0).alias("reason"))


@query("""
with r as (select conv_id, case when conv_id % 3 = 0 then 0 else count(*) end as n, case when conv_id % 2 = 0 then 'no_extractable_items' end as reason from conversations group by conv_id)
select 'source_items' as kind, cast(null as varchar) as name, cast(sum(n) as bigint) as n from r union all select 'empty_raw_items', null, count(*) filter (n = 0) from r
union all select 'empty_by_reason', coalesce(reason, 'empty_items'), count(*) from r where n = 0 group by all""")
def input_summary(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("items"))
    empty = F.when(F.col("conv_id") % 2 == 0, "no_extractable_items").alias("empty_reason")
    raw = turns.select(F.struct(F.struct(empty).alias("meta"), F.when(F.col("conv_id") % 3 != 0, F.col("items")).alias("items")).alias("raw_data"))
    return summaries.input_summary(raw)


_RESULTS = "(select event_id, case event_type when 'purchase' then 'saved' when 'view' then 'unchanged' when 'error' then 'error' else 'blocked' end as status, case when user_id % 4 = 0 then null when user_id % 4 = 1 then 'FAST' else 'BROWSER' end as strategy, user_id % 7 as items, case when user_id % 7 = 0 then 'empty' end as reason, user_id from events)"


def _results(spark, d):
    kind, user = F.col("event_type"), F.col("user_id")
    return read(spark, d, "events").select(
        "event_id", F.when(kind == "purchase", "saved").when(kind == "view", "unchanged").when(kind == "error", "error").otherwise("blocked").alias("status"), F.when(user % 4 == 0, None).when(user % 4 == 1, "FAST").otherwise("BROWSER").alias("strategy"),
        (user % 7).alias("source_items"), F.when(user % 7 == 0, "empty").alias("empty_reason"), F.when(user % 5 == 0, "low_quality").alias("quality_status"), user.cast("string").alias("source"),
        F.create_map(F.lit("SCHEMA"), F.struct((user % 2 == 0).alias("passed")), F.lit("TYPES"), F.struct((user % 3 == 0).alias("passed"))).alias("quality_levels"),
    )


@query(f"""
select 'tasks' as kind, cast(null as varchar) as name, count(*) as n from {_RESULTS} union all select 'status', case when status = 'blocked' then 'skipped' else status end, count(*) from {_RESULTS} group by all
union all select 'by_strategy', strategy, count(*) from {_RESULTS} where strategy is not null group by all union all select 'source_items', null, cast(sum(items) as bigint) from {_RESULTS}
union all select 'empty_by_reason', reason, count(*) from {_RESULTS} where reason is not null group by all""")
def run_report(spark, d):
    return summaries.run_summary(_results(spark, d))


@query("""
select 'SCHEMA' as level, count(*) filter (user_id % 2 = 0) as passed, count(*) filter (user_id % 2 <> 0) as failed from events union all select 'TYPES', count(*) filter (user_id % 3 = 0), count(*) filter (user_id % 3 <> 0) from events""")
def level_counters(spark, d):
    return summaries.level_counters(_results(spark, d))


@query("select cast(user_id as varchar) as source, min(event_id) as first from events where user_id % 5 = 0 group by user_id")
def low_quality_sources(spark, d):
    return summaries.low_quality_sources(_results(spark, d), "event_id")


@query("select user_id as run_id, count(*) as stages, count(*) filter (event_type = 'error') as failed, case when count(*) filter (event_type = 'error') > 0 then 'partial_failed' else 'succeeded' end as status from events group by user_id")
def run_rollup(spark, d):
    stages = read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"))
    return summaries.run_status(stages)


@query("select count(*) filter (o_orderstatus = 'O') as pending, count(*) filter (o_totalprice > 100000) as matched, count(*) filter (o_orderpriority = '1-URGENT') as created from orders")
def stage_counters(spark, d):
    return summaries.stage_counters(read(spark, d, "orders"), {"pending": F.col("o_orderstatus") == "O", "matched": F.col("o_totalprice") > 100000, "created": F.col("o_orderpriority") == "1-URGENT"})


@query("select l_orderkey as page, round(coalesce(avg(l_discount), 0.0), 3) as confidence, count(*) as parts from lineitem group by l_orderkey")
def merge_confidence(spark, d):
    return summaries.mean_confidence(read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "page"), "page", "l_discount")


@query("""
select conv_id, key, value from (select conv_id, key, value, row_number() over (partition by conv_id, key order by turn) as nth from (
  select conv_id, turn, 'role' as key, role as value from conversations union all select conv_id, turn, 'text', case when turn % 2 = 0 then '' else text end from conversations) where value is not null and value <> '') where nth = 1""")
def merged_maps(spark, d):
    parts = read(spark, d, "conversations").select("conv_id", "turn", F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text"))).alias("selectors"))
    return summaries.merged_map(parts, "conv_id", "selectors", [F.asc("turn")])


@query("select cast(sum(len(l)) as bigint) as domains_found from (select list(distinct s_name) as l from supplier group by s_nationkey)")
def domains_found(spark, d):
    return summaries.domains_found(read(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_set("s_name").alias("l")), "l")


@query("""
with k as (select doc_id, case when doc_id % 10 = 0 then null else coalesce(nullif(source, ''), '') || lang || length(text) end as key from documents)
select doc_id from (select *, row_number() over (partition by key order by doc_id) as nth from k) where key is null or nth = 1""")
def first_occurrences(spark, d):
    key = F.when(F.col("doc_id") % 10 != 0, F.concat(F.coalesce("source", F.lit("")), F.col("lang"), F.length("text").cast("string")))
    return summaries.first_occurrences(read(spark, d, "documents").select("doc_id", "source", "lang", "text"), key, [F.asc("doc_id")]).select("doc_id")


@query("""
with o as (select *, row_number() over (partition by l_suppkey, l_partkey order by l_orderkey, l_linenumber) as again from lineitem),
t as (select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as nth from o where again = 1)
select l_suppkey, l_orderkey, l_linenumber, nth from t where nth <= 20""")
def top_candidates(spark, d):
    lines = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    found = summaries.top_candidates(lines, "l_suppkey", F.col("l_partkey"), [F.asc("l_orderkey"), F.asc("l_linenumber")], 20)
    return found.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("nth").cast("long").alias("nth"))


@query("""select p_partkey, case when length(p_name) >= length(p_type) and length(p_name) >= length(p_brand) then p_name when length(p_type) >= length(p_brand) then p_type else p_brand end as best from part""")
def longest_text(spark, d):
    return read(spark, d, "part").select("p_partkey", summaries.longest_text(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("best"))


@query("select l_orderkey, min(l_linenumber) filter (l_returnflag = 'N') as winner, count(*) as tried from lineitem group by l_orderkey")
def first_success(spark, d):
    return summaries.first_success(read(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "N", "l_linenumber")


_ANSWERS = """
with s as (select doc_id as id, text, lang, source, doc_id % 4 as p from documents where lang is not null),
a as (select id, source as competitor, case when p = 3 then null else lang end as category, case when id % 11 = 0 then null else 'neutral' end as tonality, 'p' || (p + 1) as priority,
  case when p = 3 then null else 'c' || id end as comment, case when p = 3 or id % 5 = 0 then null else 'act ' || id end as action from s),
t as (select *, case when action is not null and id % 3 <> 0 then ['do ' || id] end as task from a)"""


def _model(name, value, keep="true"):
    """A lookup that stands for a model: a value for each row it keeps."""
    return lambda df: df.filter(keep).select("id", F.expr(value).alias("value"))


@query(f"""{_ANSWERS} select id, category, tonality, priority, comment, action, array_to_string(task, ',') as task, case when task is null then null when id % 7 = 0 then 'Ошибка генерации' else 'r' || id end as expected_result from t""")
def enriched_rows(spark, d):
    silver = read(spark, d, "documents").filter("lang is not null").select(F.col("doc_id").alias("id"), "text", "lang", F.lit("ok").alias("status"))
    out = enrichment.not_categorized(silver, silver.limit(0).select(F.col("id").alias("normalized_item_id")))
    out = out.withColumn("priority", F.concat(F.lit("p"), (F.col("id") % 4 + 1).cast("string")))
    out = enrichment.categorized(out, _model("category", "lang", "id % 4 <> 3"))
    out = enrichment.toned(out, _model("tone", "'neutral'", "id % 11 <> 0"))
    out = enrichment.commented(out, _model("comment", "concat('c', id)"), _model("action", "concat('act ', id)", "id % 5 <> 0"))
    out = enrichment.tasked(out, _model("task", "array(concat('do ', id))", "id % 3 <> 0"))
    out = enrichment.expected(out, _model("result", "concat('r', id)", "id % 7 <> 0"))
    return out.select("id", "category", "tonality", "priority", "comment", "action", F.array_join("task", ",").alias("task"), "expected_result")


@query("""
with a as (select o_orderkey as id, o_orderpriority as category, o_custkey as competitor_id, cast(o_orderdate as date) as day, case when o_orderkey % 9 = 0 then null else 'neutral' end as tonality, 'p' || (o_orderkey % 3 + 1) as priority, n_name as department from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
select a.id as normalized_item_id, c.id as category_id, n_nationkey as department_id, cast(case a.priority when 'p1' then day + 2 when 'p2' then day + 7 end as varchar) as deadline, m.x as media_index
from a join (values (1, '1-URGENT'), (2, '2-HIGH')) as c(id, name) on a.category = c.name join nation on a.department = n_name
left join (select o_custkey, count(*) as x from orders group by 1) m on m.o_custkey = a.competitor_id where a.tonality is not null""")
def stored_events(spark, d):
    orders, customer, nation = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    named = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    pieces = {"category": F.concat(F.lit(" "), F.lower("o_orderpriority")), "tonality": F.when(F.col("o_orderkey") % 9 != 0, "neutral"), "priority": F.concat(F.lit("p"), (F.col("o_orderkey") % 3 + 1).cast("string")), "department": F.upper("n_name")}
    answers = enrichment.merged({k: named.select(F.col("o_orderkey").alias("id"), v.alias("value")) for k, v in pieces.items()})
    silver = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("competitor_id"))
    categories = spark.createDataFrame([(1, "1-URGENT"), (2, "2-HIGH")], "id long, name string")
    media = orders.groupBy(F.col("o_custkey").alias("competitor_id")).agg(F.count(F.lit(1)).alias("media_index"))
    kept, _ = enrichment.events(answers, silver, categories, nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), media)
    return kept.select("normalized_item_id", "category_id", "department_id", F.col("deadline").cast("string").alias("deadline"), "media_index")


_DOMAIN = r"nullif(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\.', ''), '')"


@query(f"""
with f as (select page_id % 3 as competitor_id, {_DOMAIN} as domain from pages), k as (select distinct {_DOMAIN} as domain from pages where page_id % 10 = 0)
select distinct competitor_id, domain from f where domain is not null and domain not in (select domain from k where domain is not null)""")
def new_sources(spark, d):
    pages = read(spark, d, "pages")
    known = pages.filter("page_id % 10 = 0").select(web.domain(F.col("url")).alias("domain"))
    return enrichment.new_sources(pages.select((F.col("page_id") % 3).alias("competitor_id"), "url"), known).select("competitor_id", "domain")


@query("""
with f as (select l_orderkey as e, arg_min(l_suppkey, l_linenumber * 100000 + l_suppkey) as u from lineitem group by l_orderkey)
select e as showcase_event_id, case when e % 3 = 0 then 'Отработать событие: ' || o_orderpriority else o_orderstatus end as task, s_nationkey as department_id, u as assigned_user_id
from f join supplier on u = s_suppkey join orders on o_orderkey = e where s_nationkey <> 5 and e % 4 <> 0""")
def assistant_items(spark, d):
    alerts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("showcase_event_id"), F.col("l_suppkey").alias("user_id"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("id"))
    orders = read(spark, d, "orders")
    mart = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).otherwise(" ").alias("action"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("deadline"))
    users = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") != 5, F.col("s_nationkey")).alias("department_id"))
    stored = orders.filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("showcase_event_id"))
    return enrichment.assistant_items(alerts, mart, users, stored).select("showcase_event_id", "task", "department_id", "assigned_user_id")


@query("""select conv_id as doc, coalesce(string_agg(text, chr(10) || chr(10) order by turn) filter (trim(coalesce(text, '')) <> '' and turn % 4 <> 1), '') as body, count(*) filter (trim(coalesce(text, '')) = '' or turn % 4 = 1) as dropped from conversations where turn < 6 group by conv_id""")
def model_chunks(spark, d):
    chunks = read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return enrichment.by_chunks(chunks, lambda df: df.filter("idx % 4 <> 1").select("id", F.col("text").alias("value")))


_GATE_KEY = "nullif(rtrim(split_part(u, '#', 1), '/'), '')"


@query(f"""
with i as (select page_id // 5 as snapshot, page_id as pos, case when page_id % 13 = 0 then '' else 'http://h/' || (page_id % 4) || '/' end as u, case when page_id % 17 = 0 then null else 'title ' || page_id end as title, page_id % 19 = 0 as typed from pages),
c as (select snapshot, count(*) as n, sum((coalesce(u, '') = '')::int + (coalesce(title, '') = '')::int) as a, sum(typed::int) as b, sum(coalesce((length(title) < 8)::int, 0)) as c, count({_GATE_KEY}) - count(distinct {_GATE_KEY}) as e,
  max((snapshot % 2 = 0 or contains(coalesce(title, ''), '7'))::int) = 1 as hit from i group by snapshot),
l as (
  select snapshot, 'SCHEMA' as level, a as errors, n as item_count, n - a as passed_count, a = 0 as passed from c union all select snapshot, 'TYPES', b, n, n - b, b = 0 from c union all select snapshot, 'BUSINESS', c, n, n - c, c = 0 from c
  union all select snapshot, 'VOLUME', 0, n, n, n / 5 >= 0.8 from c where snapshot % 3 = 0 union all select snapshot, 'CONSISTENCY', e, n, n - e, e = 0 from c
  union all select snapshot, 'RELEVANCE', case when hit then 0 else 1 end, n, case when hit then n else 0 end, hit from c)
select snapshot, level, cast(errors as bigint) as errors, item_count, cast(passed_count as bigint) as passed_count, passed from l""")
def gate_reports(spark, d):
    items, snapshots = _gate_input(spark, d)
    return gate.reports(items, snapshots, {"title": 8})


def _gate_input(spark, d):
    pages = read(spark, d, "pages").select("page_id")
    i = F.col("page_id")
    url = F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("http://h/"), (i % 4).cast("string"), F.lit("/")))
    title = F.when(i % 17 != 0, F.concat(F.lit("title "), i.cast("string")))
    payload = F.when(i % 19 == 0, F.lit('{"url": "u", "title": "t", "region": 7}')).otherwise(F.lit('{"url": "u", "title": "t", "region": null}'))
    items = pages.select(F.floor(i / 5).alias("snapshot"), i.alias("pos"), url.alias("url"), title.alias("title"), F.lit(None).cast("string").alias("text"), payload.alias("payload"))
    s = F.col("snapshot")
    aim = items.select("snapshot").distinct().select("snapshot", F.when(s % 3 == 0, 5).alias("expected"), F.lit("").alias("competitor"), F.when(s % 2 != 0, "7").alias("trigger"))
    return items, aim


@query(f"""
with i as (select page_id // 5 as snapshot, page_id as pos, case when page_id % 13 = 0 then '' else 'http://h/' || (page_id % 4) || '/' end as u from pages),
c as (select snapshot, count({_GATE_KEY}) - count(distinct {_GATE_KEY}) as e from i group by snapshot)
select i.snapshot, pos, 'CONSISTENCY' as level, cast(e as bigint) as errors from i join c on i.snapshot = c.snapshot where e > 0""")
def gate_quarantine(spark, d):
    items, snapshots = _gate_input(spark, d)
    return gate.quarantine(items, gate.reports(items, snapshots, {"title": 8}).filter("level = 'CONSISTENCY'")).select("snapshot", "pos", "level", "errors")


def _any(x: str, markers) -> str:
    return "(" + " or ".join(f"contains({x}, '{m}')" for m in markers) + ")"


_LOW = "lower(html)"
_SQL_SPA, _SQL_CAPTCHA, _SQL_ANTIBOT = (_any(_LOW, m) for m in (sites.SPA, sites.CAPTCHA, sites.ANTIBOT))
_SQL_TYPE = f"case when {_any('lower(url)', ('api.', 'api-', '.api.'))} then 'api' when {_any('lower(url)', targets.REGISTERS)} then 'registry' when {_any('lower(url)', ('news', 'ria', 'lenta', 'tass', 'rbc', 'interfax'))} then 'news' when spa then 'spa' else 'unknown' end"
_SQL_LIST = lambda groups: "array_to_string(list_filter([" + ", ".join(f"case when {_any(_LOW, m)} then '{n}' end" for n, m in groups.items()) + "], lambda x: x is not null), ',')"


@query(rf"""
with f as (select page_id, url, html, {_SQL_SPA} as spa, {_SQL_CAPTCHA} as captcha, {_SQL_ANTIBOT} as antibot from pages),
g as (select *, {_SQL_TYPE} as source_type from f)
select page_id, spa, captcha, antibot, source_type, round(least(1.0, 0.2 * spa::int + 0.3 * captcha::int + 0.3 * antibot::int + case source_type when 'api' then 0.1 when 'registry' then 0.4 when 'spa' then 0.5 when 'news' then 0.2 else 0 end), 4) as complexity,
  case when source_type = 'api' then 'FAST' when captcha then 'HITL' when antibot then 'STEALTH' when spa then 'BROWSER' else 'FAST' end as strategy,
  case when captcha then 'STEALTH_SPA,WAYBACK,HITL' when antibot and not spa then 'FAST,BROWSER,WAYBACK,STEALTH,HITL' else 'FAST,CRAWL4AI,BROWSER,WAYBACK,STEALTH_SPA,HITL' end as allowed,
  {_SQL_LIST(sites.FRAMEWORKS)} as frameworks, {_SQL_LIST(sites.STYLES)} as styles, contains(lower(html), 'search') as has_search, contains(lower(html), 'google-analytics') or contains(lower(html), 'gtag') as has_ga from g""")
def classified_sites(spark, d):
    found = sites.classified(read(spark, d, "pages"), "html", "url")
    s = F.col("site")
    return found.select("page_id", *[s[c].alias(c) for c in ("spa", "captcha", "antibot", "source_type")], F.round(s["complexity"], 4).alias("complexity"), s["strategy"].alias("strategy"), *[F.array_join(s[c], ",").alias(c) for c in ("allowed", "frameworks", "styles")], s["business"]["has_search"].alias("has_search"), s["meta"]["has_ga"].alias("has_ga"))


_TARGET = "trim(regexp_replace(lower(trim(regexp_replace(p, '\\s+', ' ', 'g'))), '[«»\"''(){}\\[\\].,;:!?]', '', 'g'))"


@query(f"""
with t as (select doc_id, text, source, 'ооо ' || coalesce(lang, '') as p, coalesce(lang, '') as short from documents)
select doc_id, case when coalesce(text, '') = '' then 0 when short <> '' and regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || short || '($|[^\\p{{L}}\\p{{N}}_])') then 100 when short <> '' and contains(lower(text), short) then 30 else 0 end as score from t""")
def target_score(spark, d):
    docs = read(spark, d, "documents").withColumn("name", F.concat(F.lit("ООО «"), F.upper(F.coalesce("lang", F.lit(""))), F.lit("»")))
    return docs.select("doc_id", targets.target_score(F.col("text"), F.col("name"), F.lit("12")).alias("score"))


@query("""
with h as (select page_id, url, lower(regexp_replace(regexp_replace(regexp_extract(url, '//([^/?#]*)', 1), '^www\\.', ''), ':[0-9]*$', '')) as host from pages)
select page_id, 'https://' || host || '/search?q=a+b%26' as search, split_part(url, '?', 1) || '?' || array_to_string(list_append(list_filter(string_split(case when contains(url, '?') then regexp_extract(url, '(?s)\\?(.*)$', 1) else '' end, '&'),
  lambda x: x <> '' and split_part(x, '=', 1) not in ('q', 'query', 'text', 'search')), 'query=a+b%26'), '&') as probe, 'https://' || host || '/' as source from h where host <> '' and host = regexp_replace(host, '\\s', '') and url like 'https://%' and not contains(host, '@')""")
def search_addresses(spark, d):
    pages = read(spark, d, "pages").filter("url like 'https://%' and not contains(regexp_extract(url, '//([^/?#]*)', 1), '@')")
    out = pages.select("page_id", targets.search_address(F.col("url"), F.lit("a b&")).alias("search"), targets.probe_address(F.col("url"), F.lit("query"), F.lit("a b&")).alias("probe"), targets.source_address(F.col("url")).alias("source"))
    return out.filter("source is not null")


@query("""
select c_custkey, case when c_nationkey % 3 = 0 and c_custkey % 2 = 0 then '7707083893' when c_nationkey % 3 = 0 and c_custkey % 5 = 0 then '770708389312' else c_name end as value, c_nationkey % 3 = 0 and c_custkey % 2 <> 0 and c_custkey % 5 <> 0 as lacks from customer""")
def search_values(spark, d):
    source = F.when(F.col("c_nationkey") % 3 == 0, "https://www.nalog.ru/").otherwise("lenta.ru")
    number, trigger = F.when(F.col("c_custkey") % 2 == 0, "7707083893"), F.when(F.col("c_custkey") % 5 == 0, "770708389312").otherwise("слово")
    return read(spark, d, "customer").select("c_custkey", targets.search_value(source, number, F.col("c_name"), trigger).alias("value"), targets.lacks_number(source, number, trigger).alias("lacks"))


_SQL_NONE = _any(_LOW, targets.NO_RESULTS)
_SQL_LINKS = "len(list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"\\s*([^\"]*)\"', 1), lambda x: trim(x) <> '' and not regexp_matches(lower(x), '^(#|javascript:|mailto:)')))"


@query(f"""select page_id, coalesce(length(html) >= 512 and not {_SQL_NONE} and (regexp_matches({_LOW}, '(найдено|нашлось|результат[\\p{{L}}\\p{{N}}_]*|результаты)($|[^\\p{{L}}\\p{{N}}_])') or {_SQL_LINKS} > 3), false) as results from pages""")
def results_pages(spark, d):
    return read(spark, d, "pages").select("page_id", targets.looks_like_results(F.col("html")).alias("results"))


@query("""select doc_id, not coalesce(length(text) >= 300 and not cut, false) as escalate, not coalesce(length(text) >= 300 and not cut, false) and (text is null or cut) as escalate_long from (
select doc_id, text, coalesce(length(text) > 0 and (contains(right(rtrim(text), 8), '...') or contains(right(rtrim(text), 8), '…') or (length(rtrim(text)) >= 300 and right(rtrim(text), 1) not in ('.', '!', '?'))), false) as cut from documents)""")
def model_escalation(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", targets.needs_model(t).alias("escalate"), targets.needs_model(t, short_too=False).alias("escalate_long"))


@query("""select p_partkey, cast(greatest(1, case when p_size % 7 > 0 then least(10, ceil(20.0 / (p_size % 7))) else 10 end) as bigint) as pages, least(1.0, greatest(0.0, p_retailprice / 1500 - 0.5)) as score, p_size % 10 / 10 >= 0.7 as unfiltered from part""")
def collection_limits(spark, d):
    size = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", targets.most_pages(size % 7).alias("pages"), targets.clamped(F.col("p_retailprice") / 1500 - 0.5).alias("score"), targets.unfiltered(size % 10 / 10).alias("unfiltered"))


@query("select n_nationkey, lower(n_name) || ',' || 'г. ' || lower(n_name) || ',' || 'г ' || lower(n_name) as aliases from nation")
def region_aliases(spark, d):
    return read(spark, d, "nation").select("n_nationkey", F.array_join(targets.city_aliases(F.col("n_name")), ",").alias("aliases"))


@query("select o_orderkey as id, case when o_orderpriority = '1-URGENT' then 'now' when o_custkey % 2 = 0 then 'then' end as alerted_at from orders")
def mark_checked(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 2 == 0, "then").alias("alerted_at"), "o_orderpriority")
    return state.marked(orders, orders.filter("o_orderpriority = '1-URGENT'"), "alerted_at", F.lit("now")).select("id", "alerted_at")


@query("""
select o_orderkey as dedup_key, case when o_orderkey % 4 = 0 then 'ok' else 'rejected' end as status, case when o_orderkey % 4 <> 0 then 'noise_limit' end as reject_reason from orders
union all select distinct -c_custkey, 'ok', null from customer where c_custkey % 4 = 0""")
def reparse_upsert(spark, d):
    stored = read(spark, d, "orders").select(F.col("o_orderkey").alias("dedup_key"), F.lit("rejected").alias("status"), F.lit("noise_limit").alias("reject_reason"))
    ok = (F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reject_reason"))
    new = stored.filter("dedup_key % 4 = 0").select("dedup_key", *ok).union(read(spark, d, "customer").filter("c_custkey % 4 = 0").select((-F.col("c_custkey")).alias("dedup_key"), *ok))
    return state.reparsed(stored, new)


@query("""
with e as (select event_id, user_id, ts, event_type = 'error' as failed, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events),
s as (select event_id, user_id, ts, case when failed then sum(failed::int) over (partition by user_id, island order by ts, event_id rows unbounded preceding) else 0 end as streak from e),
l as (select user_id, arg_max(streak, event_id) as streak, max(ts) as seen from s group by user_id)
select user_id, case when streak >= 3 then 'disabled' when streak > 0 and seen + interval 24 hour > (select max(ts) from events) then 'blocked' else 'open' end as state from l""")
def circuit_breaker(spark, d):
    events = read(spark, d, "events")
    found = rows.streaks(events, ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error")
    last = found.groupBy("user_id").agg(F.max_by("streak", "event_id").alias("streak"), F.max("ts").alias("failed_at"))
    now = events.agg(F.max("ts").alias("now"))
    return state.circuit(last.crossJoin(F.broadcast(now)), F.col("now")).select("user_id", "state")


@query("select o_orderkey from orders where o_orderdate + interval 7 day > timestamp '1997-01-01'")
def retention(spark, d):
    return state.alive(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.lit("1997-01-01").cast("timestamp_ntz"), "o_orderdate").select("o_orderkey")


@query("""select coalesce(c_custkey, o_custkey) as source, coalesce(p, c_mktsegment) as site_type from customer full join (select o_custkey, arg_max(o_orderpriority, o_orderkey) as p from orders where o_orderstatus = 'F' group by 1) on c_custkey = o_custkey""")
def reconciled_classes(spark, d):
    classes = read(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.col("c_mktsegment").alias("site_type"))
    fetched = read(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("site_type"), F.col("o_orderkey").alias("fetched_at"), (F.col("o_orderstatus") == "F").alias("ok"))
    return state.reconciled(classes, fetched)


@query("select o_orderkey from orders where o_orderstatus in ('O', 'P') and o_orderdate < timestamp '1996-01-01' - interval 1800 second")
def stale_runs(spark, d):
    runs = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"), F.col("o_orderdate").alias("heartbeat"))
    return state.stale_runs(runs, F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")


def _dims(spark, d):
    competitors = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 5 != 0).alias("is_active"), F.col("n_regionkey").cast("string").alias("inn"))
    sources = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 3 != 0).alias("is_active"))
    tasks = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("competitor_id"), F.col("s_suppkey").alias("source_id"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey") % 2).alias("trigger_id"), (F.col("s_suppkey") % 7 != 0).alias("is_active"))
    return competitors, sources, tasks


@query("""select n_nationkey as competitor_id, s_suppkey as source_id from nation, supplier where n_nationkey % 5 <> 0 and s_suppkey % 3 <> 0 and n_nationkey in (1, 2, 5)
and not exists (select 1 from supplier t where t.s_suppkey % 4 <> 0 and t.s_nationkey = n_nationkey and t.s_suppkey = supplier.s_suppkey)""")
def missing_tasks(spark, d):
    return state.missing_tasks(*_dims(spark, d), competitor_ids=[1, 2, 5])


@query("""select 'all' as scope, s_suppkey as id from supplier where s_suppkey % 7 <> 0 and s_nationkey % 5 <> 0 and s_suppkey % 3 <> 0 union all select 'competitor', s_suppkey from supplier where s_suppkey % 7 <> 0 and s_nationkey = 2 and s_suppkey % 3 <> 0
union all select 'source', s_suppkey from supplier where s_suppkey = 4 and s_nationkey % 5 <> 0""")
def task_scopes(spark, d):
    competitors, sources, tasks = _dims(spark, d)
    scopes = {"all": {}, "competitor": {"competitor_id": 2}, "source": {"source_id": 4}}
    found = [state.task_scope(tasks, competitors, sources, **only).select(F.lit(name).alias("scope"), "id") for name, only in scopes.items()]
    return found[0].union(found[1]).union(found[2])


@query("select s_suppkey as id, n_name as competitor, cast(n_regionkey as varchar) as inn, s_name as source, r_name as trigger from supplier join nation on s_nationkey = n_nationkey left join region on case when s_suppkey % 4 = 0 then s_suppkey % 2 end = r_regionkey")
def task_config(spark, d):
    competitors, sources, tasks = _dims(spark, d)
    triggers = read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("keyword"))
    return state.task_config(tasks, competitors, sources, triggers).select("id", "competitor", "inn", "source", "trigger")


@query(f"""
with s as (select page_id as id, url as name, {_DOMAIN} as host from pages where page_id % 3 = 0), n as (select page_id, url, {_DOMAIN} as host from pages where url like 'http%' and not contains(url, '@') and not regexp_matches(url, '//[^/?#]*:'))
select n.page_id, coalesce((select min(id) from s where s.name = n.url), (select min(id) from s where s.host = n.host)) as source_id from n""")
def sources_by_host(spark, d):
    pages = read(spark, d, "pages")
    sources = pages.filter("page_id % 3 = 0").select(F.col("page_id").alias("id"), F.col("url").alias("name"))
    names = pages.filter("url like 'http%' and not contains(url, '@') and not url rlike '//[^/?#]*:'").select("page_id", "url")
    return state.by_host(names, "url", sources).select("page_id", "source_id")


@query("""select c_custkey, lower(c_mktsegment) as name, coalesce((select min(r_regionkey) from region where lower(r_name) = lower(c_mktsegment)), (select max(r_regionkey) from region) + (select count(distinct lower(x.c_mktsegment)) from customer x where lower(x.c_mktsegment) <= lower(customer.c_mktsegment) and lower(x.c_mktsegment) not in (select lower(r_name) from region))) as id from customer""")
def find_or_create(spark, d):
    dim = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    names = read(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("name"))
    found, _ = state.find_or_create(dim, names, F.col("name"), F.lower("name"))
    return found.select("c_custkey", "name", "id")


@query()
def page_blocks(spark, d):
    from tidewire.functions import markup

    found = read(spark, d, "pages").select("page_id", markup.cleaned_page(F.col("html")).alias("c"))
    return found.select("page_id", "c.title", "c.description", F.size("c.blocks").alias("n_blocks"), "c.ratio", F.size(markup.packed(F.col("c.blocks"), 400, 60)).alias("n_chunks"))


@query()
def listed_items(spark, d):
    from tidewire.functions import markup

    found = read(spark, d, "pages").select("page_id", F.posexplode(markup.page_items(F.col("html"), F.col("url"))).alias("pos", "x"))
    return found.select("page_id", "pos", "x.href", "x.text")


@query("select conv_id, turn, case when turn % 3 = 0 then '{\"a\":' || turn || '}' when turn % 3 = 1 then '{\"b\":[' || turn || ']}' else '{}' end as object from conversations")
def loose_json(spark, d):
    from tidewire.functions import markup

    turn = F.col("turn").cast("string")
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('Sure: {"a": '), turn, F.lit("} done"))).when(F.col("turn") % 3 == 1, F.concat(F.lit('```json\n{"b": ['), turn, F.lit("]}\n```"))).otherwise(F.lit("[1, 2"))
    return read(spark, d, "conversations").select("conv_id", "turn", markup.loose_object(answer).alias("object"))


@query("""
with t as (select conv_id, turn, text from conversations)
select conv_id, 'http://n/' || turn as url, case when turn % 2 = 0 then 'page' else 't' || turn end as title from t where turn > 0
union all select conv_id, 'http://own', 'own' from t group by conv_id""")
def nested_news(spark, d):
    from tidewire.functions import markup

    turns = read(spark, d, "conversations")
    news = F.collect_list(F.struct(F.when(F.col("turn") > 0, F.concat(F.lit("http://n/"), F.col("turn").cast("string"))).alias("ex_url"), F.when(F.col("turn") % 2 != 0, F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("ex_title"), F.lit("x").alias("ex_text")))
    pages = turns.groupBy("conv_id").agg(F.to_json(F.struct(news.alias("news"))).alias("extra"))
    item = lambda url, title, extra: F.struct(F.lit(url).alias("url"), F.lit(title).alias("title"), F.lit("body").alias("text"), extra.alias("extra"))
    items = F.array(item("http://search", "page", F.col("extra")), item("http://own", "own", F.lit("{}")), item("http://empty", "page", F.lit('{"news": []}')))
    return pages.select("conv_id", F.explode(markup.nested_news(items)).alias("x")).select("conv_id", "x.url", "x.title")


@query("select doc_id, coalesce(text, source) as text, case when coalesce(text, '') = '' then 'snippet_title' when doc_id % 2 = 0 then 'cache' else 'fetched' end as method from documents")
def article_records(spark, d):
    docs = read(spark, d, "documents")
    record = targets.complete_text(F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.when(F.col("doc_id") % 2 != 0, F.col("text")), F.col("source"))
    return docs.select("doc_id", record.alias("r")).select("doc_id", "r.text", "r.method")


@query("select doc_id, coalesce(cast(length(text) as varchar), '—') as body from documents")
def message_values(spark, d):
    return read(spark, d, "documents").select("doc_id", text.filled(F.length("text")).alias("body"))
