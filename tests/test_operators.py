"""Operators and functions over small tables whose results are written out, odd rows included."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidewire.functions import markup, targets, text, urls, values
from tidewire.operators import classify, enrichment, gate, listing, quality, rows, rules, sites, state, summaries


def each(spark, values_, use, kind="string"):
    """The results of an expression over single values."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", use(F.col("v")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    given = ["2026-06-25", "23.06.2026", "26 июня 2026", " 1 мая 2026 ", "20260625", "не дата", "", None, "31.02.2026", "2026", "2026-6-5"]
    assert each(spark, given, values.parsed_date) == [date(2026, 6, 25), date(2026, 6, 23), date(2026, 6, 26), date(2026, 5, 1), date(2026, 6, 25), *[None] * 6]


def test_clean_text(spark):
    given = [None, "", "  \n\t ", "42", "<script>alert(1)</script>Текст", "<b>Важно</b> и <br/>ещё", "&laquo;Привет&raquo;", "слово&nbsp;слово", "один   два\n\nтри", "до\x00после", "<p>Привет, <b>мир</b>!</p>", "ﬁ &eacute;"]
    want = [None, None, None, "42", "Текст", "Важно и ещё", "«Привет»", "слово слово", "один два три", "допосле", "Привет, мир !"]
    assert each(spark, given, text.clean_full) == [*want, "fi é"]
    assert each(spark, given[:-1], text.clean) == want


def test_names(spark):
    assert each(spark, ["Щука Ёж", "plain", None], values.transliterated) == ["SChuka Ezh", "", None] or each(spark, ["Щука"], values.transliterated)[0].lower() == "schuka"
    assert each(spark, ["ООО Рога", "Аорта", "АО"], values.without_legal_form) == ["Рога", "рта", "АО"]
    assert each(spark, ["Рога ИИ Group", "Рога", "ИИ"], values.without_buzzwords) == ["Рога", "Рога", "ИИ"]
    assert each(spark, ["7707083893", "7707083894", "500100732259", "500100732258", "12", None], values.inn_valid) == [True, False, True, False, False, False]
    assert each(spark, ["a b/ц?"], values.file_name) == ["a_b_ц_"]
    assert each(spark, ["x"], values.digest) == ["9dd4e461268c"]


def test_page_hash_ignores_what_changes(spark):
    a, b, c = each(spark, ['<a nonce="1" data-token="x">t</a>', '<a nonce="2" data-token="y">t</a>', "<a>u</a>"], values.stable_page_hash)
    assert a == b != c


def test_hosts(spark):
    given = ["https://www.A.ru:80/x", "a.ru", "user@b.ru/", "not a host", "", None]
    assert each(spark, given, urls.host) == ["a.ru", "a.ru", "b.ru", None, None, None]
    assert each(spark, given[:3], targets.source_address) == ["https://a.ru/", "https://a.ru/", "https://b.ru/"]
    assert each(spark, ["http://a.ru/s"], lambda u: urls.page_address(u, F.lit(3), size=20)) == ["http://a.ru/s?page=40"]
    assert each(spark, [["https://www.a.ru/x", "b.ru", "a.ru"]], lambda v: targets.known_domains(v, F.array(F.lit("c.ru"))), "array<string>") == [["a.ru", "b.ru", "c.ru"]]


def test_between_and_cards(spark):
    assert each(spark, ["a [x] b", "a [x b", "x] [", None], lambda t: text.between(t, "[", "]")) == ["x", None, None, None]
    card = "Единоличный исполнительный орган\nДиректор\nИванов\nДата внесения данных в ЕГРЮЛ\n02.03.2020\nАдрес по данным ЕГРЮЛ\n1, г. РОСТОВ-НА-ДОНУ, ул. 1\nДата регистрации\n05.06.2019\nПравовая форма (ОКОПФ)"
    assert each(spark, [card], targets.register_card)[0].asDict() == {"published_at": "05.06.2019", "region": "Ростов-На-Дону", "extra": "Директор\nИванов\nДата внесения данных в ЕГРЮЛ\n02.03.2020"}
    assert each(spark, ["г. МОСКВА, ул.", "город Тула", "none"], targets.city) == ["Москва", "Тула", None]


def test_targets(spark):
    cases = [
        ("Компания ООО Архитех ИИ выросла", "ООО «Архитех ИИ»", "full", 100), ("про архитех ии пишут", 'ООО "Архитех ИИ"', "stripped", 100), ("архитехиим", "ООО Архитех", None, 30),
        ("nothing", "ООО Архитех", None, 0), (None, "x", None, 0), ("ИНН 7707083893.", "", None, 100), ("c++ here", "c++", None, 30), (r"a\Eb", r"a\Eb", "full", 100),
    ]
    df = spark.createDataFrame([(i, p, n) for i, (p, n, _, _) in enumerate(cases)], "i int, p string, n string")
    found = df.select("i", targets.matched_target(F.col("p"), F.col("n")).alias("m"), targets.target_score(F.col("p"), F.col("n"), F.lit(" 7707083893 ")).alias("s")).orderBy("i").collect()
    assert [(r["m"], r["s"]) for r in found] == [c[2:] for c in cases]


def test_result_pages(spark):
    pad = " " * 600
    pages = ["<p>Найдено 5</p>" + pad, "Ничего не найдено" + pad, "найдено", '<a href="/1">' * 4 + pad, '<a href="#1">' * 9 + pad, None]
    assert each(spark, pages, targets.looks_like_results) == [True, False, False, True, False, False]
    assert each(spark, ["https://e.ru/search?q=X&lang=ru", "https://e.ru/search", "https://e.ru/?"], lambda a: targets.probe_address(a, F.lit("text"), F.lit("Я б"))) == [
        "https://e.ru/search?lang=ru&text=%D0%AF+%D0%B1", "https://e.ru/search?text=%D0%AF+%D0%B1", "https://e.ru/?text=%D0%AF+%D0%B1"]
    assert each(spark, ["https://spb.hh.ru/", "rbc.ru", "x.org"], lambda s: targets.search_address(s, F.lit("a"))) == ["https://spb.hh.ru/search/vacancy?text=a", "https://rbc.ru/search?query=a", "https://x.org/search?q=a"]


PAGE = """<html><head><title> A &amp; B </title><meta name="description" content="d"></head><body><nav><p>menu menu menu menu menu</p></nav>
<div><p>First block of some length here</p><p>short</p><li>Second block of some length</li></div>
<a href="/n/1">one</a><a href="../n/2">two</a><a href="/n/1">again</a><a href="mailto:x">m</a><a href="/login">in</a><a href="//adsrv.q.ru/">ad</a><a href="/e"></a></body></html>"""


def test_markup(spark):
    found = each(spark, [PAGE, None, ""], markup.cleaned_page)
    assert (found[0]["title"], found[0]["description"], found[0]["blocks"]) == ("A & B", "d", ["First block of some length here", "Second block of some length"])
    assert found[1]["blocks"] == found[2]["blocks"] == [] and found[1]["ratio"] == 0.0
    items = each(spark, [PAGE], lambda p: markup.page_items(p, F.lit("https://a.ru/x/y")))[0]
    assert [(x["href"], x["text"]) for x in items] == [("https://a.ru/n/1", "one"), ("https://a.ru/n/2", "two")]
    assert len(each(spark, [PAGE], lambda p: markup.page_items(p, F.lit("https://a.ru/x/y"), most=1))[0]) == 1
    blocks = [["a" * 30, "b" * 30, "c" * 30, "d" * 250], [], None]
    assert [[len(c) for c in x] for x in each(spark, blocks, lambda b: markup.packed(b, 70, 40), "array<string>")] == [[61, 61, 70, 70, 70, 70, 70, 70, 70], [], []]
    assert each(spark, ['{"a": 1}', 'x {"a": 1} y', '```json\n{"a": [2]}\n```', "[1]", "", None, "{broken"], markup.loose_object) == ['{"a":1}', '{"a":1}', '{"a":[2]}', "{}", "{}", "{}", "{}"]
    form = '<form action="/f"><input type="hidden" name="h"></form><form method="POST" action="/s"><input name="q" type="search"></form>'
    assert each(spark, [form, "<p>"], markup.form_parameter) == [("q", "/s", "post"), None]


def test_site_kinds(spark):
    pages = ['<div itemtype="https://schema.org/JobPosting">', '<meta property="og:type" content="Article">', '<div class="x basket">', '<i id="cart">', "<p>Отзывы", "<p>", None, '<div class="cartoon">', '<b itemtype="http://schema.org/Thing"><b itemtype="http://schema.org/FAQPage">']
    assert each(spark, pages, sites.site_kind) == ["job_board", "news", "e_commerce", "e_commerce", "review_aggregator", "other", "other", "other", "question_answer"]
    kinds = ['<a itemtype="schema.org/Product"><a itemtype="schema.org/JobPosting">', '<a itemtype="schema.org/Article"><a itemtype="schema.org/Product">', '<i class="shopping-cart">', "<p id=\"app\">CloudFlare"]
    assert [tuple(x) for x in each(spark, kinds, sites.heuristic)] == [("job_board", False, False, 0.7), ("news", False, False, 0.7), ("e_commerce", False, False, 0.7), ("other", True, True, 0.4)]
    assert each(spark, ['<meta name="Yandex-Verification" content="1"> gtag(', "<p>"], lambda p: F.concat_ws(",", *[sites.meta_flags(p)[f].cast("string") for f in ("has_ga", "has_verification")])) == ["true,true", "false,false"]
    known = sites.classified(spark.createDataFrame([("https://kad.arbitr.ru/", ""), ("https://a.b/", None)], "url string, html string"), "html", "url").select("site.*").collect()
    assert (known[0]["antibot"], known[0]["spa"], known[0]["source_type"], known[0]["strategy"], known[0]["complexity"]) == (True, True, "registry", "STEALTH", pytest.approx(0.9))
    assert (known[1]["antibot"], known[1]["source_type"], known[1]["strategy"], len(known[1]["allowed"])) == (False, "unknown", "FAST", 6)


def test_gate_levels(spark):
    items = spark.createDataFrame([(1, 0, "http://a/x/", "Title of Ozon", None, '{"url": "u"}'), (1, 1, "http://a/x#p", "", "t", '{"url": 5, "region": []}'), (2, 0, None, None, None, "broken")], "snapshot int, pos int, url string, title string, text string, payload string")
    snapshots = spark.createDataFrame([(1, 10, "ozon", None), (2, None, None, "ozon"), (3, 0, None, "")], "snapshot int, expected int, competitor string, trigger string")
    found = {(r["snapshot"], r["level"]): (r["errors"], r["passed_count"], r["passed"]) for r in gate.reports(items, snapshots).collect()}
    assert found[1, "SCHEMA"] == (1, 1, False) and found[1, "TYPES"] == (2, 0, False) and found[1, "VOLUME"] == (0, 2, False)
    assert found[1, "CONSISTENCY"] == (1, 1, False) and found[1, "RELEVANCE"] == (0, 2, True)
    assert found[2, "SCHEMA"] == (2, -1, False) and found[2, "RELEVANCE"] == (1, 0, False) and (2, "VOLUME") not in found
    assert found[3, "VOLUME"][2] and found[3, "RELEVANCE"][2] and found[3, "SCHEMA"] == (0, 0, True)
    assert {r["snapshot"]: r["passed"] for r in gate.all_passed(gate.reports(items, snapshots)).collect()} == {1: False, 2: False, 3: True}
    assert [r["x"] for r in spark.createDataFrame([(8, 10), (7, 10), (0, 0)], "a int, b int").select(quality.volume_passed(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True]


def test_failing_and_partial_models(spark):
    base = spark.createDataFrame([(1, "p1", None), (2, "p4", "t"), (3, None, "u")], "id long, priority string, text string")

    def broken(df):
        raise RuntimeError("no model")

    out = enrichment.commented(base, broken, broken)
    out = enrichment.expected(enrichment.tasked(out, broken), broken)
    assert sorted((r["id"], r["comment"], r["action"], r["task"], r["expected_result"]) for r in out.collect()) == [
        (1, "Ошибка генерации", "Требуется ручной анализ", ["Ошибка генерации задач"], "Ошибка формирования ожидаемого результата"), (2, None, None, None, None),
        (3, "Ошибка генерации", "Требуется ручной анализ", ["Ошибка генерации задач"], "Ошибка формирования ожидаемого результата")]
    assert {r["category"] for r in enrichment.categorized(base, broken).collect()} == {None}
    asked = base.withColumns({c: F.lit(None).cast("string") for c in ("category", "deadline", "department", "tone")})
    assert {tuple(r)[1:3] for r in enrichment.context(asked).collect()} == {("Текст отсутствует", "Неизвестная категория"), ("t", "Неизвестная категория"), ("u", "Неизвестная категория")}


def test_rejected_events(spark):
    answers = spark.createDataFrame([(1, "Кат", "neutral", "p1", "PR"), (2, "нет", "neutral", "p2", None), (3, "Кат", None, "p2", None)], "id long, category string, tonality string, priority string, department string")
    silver = spark.createDataFrame([(i, datetime(2026, 6, 25), 7) for i in (1, 2, 3)], "id long, created_at timestamp, competitor_id long")
    dim = spark.createDataFrame([(5, " кат "), (6, "pr")], "id long, name string")
    kept, rejected = enrichment.events(answers, silver, dim, dim, spark.createDataFrame([(7, 1.5)], "competitor_id long, media_index double"))
    assert [(r["normalized_item_id"], r["category_id"], r["department_id"], r["deadline"], r["media_index"]) for r in kept.collect()] == [(1, 5, 6, date(2026, 6, 27), 1.5)]
    assert {r["normalized_item_id"]: r["problem"] for r in rejected.collect()} == {2: "no category", 3: "no tonality"}


def test_cron_slots():
    utc = lambda *x: datetime(*x, tzinfo=timezone.utc)
    assert state.cron_slot("30 6 * * *", "Europe/Moscow", utc(2026, 6, 25, 3, 30)) == utc(2026, 6, 25, 3, 30)
    assert state.cron_slot("30 6 * * *", "Europe/Moscow", utc(2026, 6, 25, 3, 29)) == utc(2026, 6, 24, 3, 30)
    assert state.cron_slot("30 6 * * *", "Europe/Moscow", utc(2026, 6, 25, 3, 30), forward=True) == utc(2026, 6, 26, 3, 30)
    assert state.cron_slot("0 9 * * 1-5", "UTC", utc(2026, 6, 28, 12)) == utc(2026, 6, 26, 9)
    assert state.cron_slot("*/20 1-2 1,15 * *", "UTC", utc(2026, 6, 15, 2, 59)) == utc(2026, 6, 15, 2, 40)
    assert state.cron_slot("30 2 * * *", "Europe/Berlin", utc(2026, 3, 29, 12)) == utc(2026, 3, 28, 1, 30)  # 2:30 is left out on the 29th
    assert state.due("0 9 * * *", "UTC", utc(2026, 6, 25, 10), utc(2026, 6, 25, 9)) is None
    assert state.due("0 9 * * *", "UTC", utc(2026, 6, 25, 10), utc(2026, 6, 24, 9)) == utc(2026, 6, 25, 9)
    with pytest.raises(ValueError):
        state.cron_slot("0 0 31 2 *", "UTC", utc(2026, 1, 1))


def test_state(spark):
    assert state.downstream("alert") == ["source_candidate", "action_item", "alert"]
    runs = spark.createDataFrame([(1, "succeeded")], "id int, status string")
    assert state.free_slot(runs) and not state.free_slot(runs.union(spark.createDataFrame([(2, "running")], "id int, status string")))
    streaks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source string, streak int")
    assert {r["source"] for r in state.adapters_to_reset(streaks).collect()} == {"b", "c"}


def test_listing_rules(spark):
    rows_ = spark.createDataFrame([(1, "a%b", "x"), (2, "ab", None)], "id int, full_name string, department_id string")
    assert [r["id"] for r in listing.listing(rows_, "users", {"full_name": "a_b", "department_id": None}).collect()] == [1]
    with pytest.raises(ValueError):
        listing.listing(rows_, "users", {"name": "a"})
    assert listing.forbidden_fields("viewer", ["status", "task", "deadline"]) == ["deadline", "task"] and listing.forbidden_fields("editor", ["task"]) == []
    with pytest.raises(ValueError):
        rows.patched(rows_, rows_, "id", [])


def test_empty_summaries(spark):
    none = spark.createDataFrame([], "status string, strategy string, source_items int, empty_reason string, source string, quality_status string, n int")
    assert summaries.run_summary(none).count() == 0
    assert summaries.low_quality_sources(none, "n").count() == 0
    assert spark.range(1).select(summaries.success_rate(F.lit(0), F.lit(0)).alias("x")).first()["x"] == 0.0
    raw = spark.createDataFrame([(1, 5, 1, [("a", None)]), (1, 5, 2, [("a", None), ("b", "q")]), (2, 1, 1, None)], "search_task_id int, created_at int, id int, items array<struct<url: string, extra: string>>")
    shaped = raw.select("search_task_id", "created_at", "id", F.struct(F.transform("items", lambda x: F.struct(F.struct(x["extra"].alias("quality_levels")).alias("extra"))).alias("items")).alias("raw_data"))
    assert {r["search_task_id"]: r["quality_levels"] for r in summaries.latest_quality(shaped).collect()} == {1: "q", 2: None}


def test_limits_with_clashing_names(spark):
    df = spark.createDataFrame([(i, "k" if i < 8 else None, i, "ok", None, "own") for i in range(10)], "id int, key string, created_at int, status string, reject_reason string, _kept string")
    out = {r["id"]: (r["status"], r["_kept"]) for r in rows.limited(df, "key", 3, F.lit(2)).collect()}
    assert out == {i: ("rejected" if 2 <= i < 5 else "ok", "own") for i in range(10)}


def test_delivery_and_strategy(spark):
    assert each(spark, ["instant", "digest"], lambda m: rules.delivery(m, F.lit("email"), F.lit(True))) == ["sent", "queued"]
    assert each(spark, ["instant"], lambda m: rules.delivery(m, F.lit("email"), F.lit(None).cast("boolean"))) == ["failed"]
    no, yes = F.lit(False), F.lit(True)
    assert spark.range(1).select(classify.strategy(no, yes, no, no), classify.strategy(yes, yes, yes, yes), classify.strategy(no, no, yes, yes)).first()[:] == ("BROWSER", "FAST", "HITL")


def test_demo_index_is_repeatable(spark):
    """A stand-in between 1 and 5, the same for the same id, with two decimals."""
    once, again = ([r[0] for r in spark.range(500).repartition(n).select(targets.demo_index(F.col("id")).alias("x"), "id").orderBy("id").select("x").collect()] for n in (1, 5))
    assert once == again and all(1 <= x <= 5 and round(x, 2) == x for x in once) and len(set(once)) > 200


def test_limit_windows_have_names(spark):
    with pytest.raises(ValueError):
        rows.window_start("month", F.lit(1), F.lit(2))
