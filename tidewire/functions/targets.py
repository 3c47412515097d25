"""Targets in pages, and the addresses and parameters of searches for them, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import CUT_MARKS, between, confident, looks_truncated
from tidewire.functions.urls import domain, host
from tidewire.functions.values import without_legal_form

# Punctuation that comparison leaves out.
PUNCTUATION = "«»\"'(){}[].,;:!?"
# The worth of a name found whole or without its legal form, of a part of it, and of a taxpayer number.
NAME_FOUND, PART_FOUND, NUMBER_FOUND = 100, 30, 100
# What a page says that has no results, and what one says that has; characters of a page of results at least, and
# links that it has more than.
NO_RESULTS = (
    "captcha", "qrator", "доступ ограничен", "антибот", "не удалось найти", "ничего не найдено", "ничего не нашлось", "не найдено",
    "по запросу ничего не найдено", "уточните запрос", "результатов не найдено", "no results found", "nothing found", "not found",
    "поиск ничего не дал", "пожалуйста, выполните поиск", "введите запрос", "запрос обязателен", "search again",
    "проверьте, правильно ли введён запрос",
)
RESULTS, RESULTS_LENGTH, RESULTS_LINKS = r"(?U)(найдено|нашлось|результат\w*|результаты)\b", 512, 3
# Parameters that carry a search text.
SEARCH_PARAMETERS = (
    "q", "query", "text", "search", "keyword", "keywords", "searchText", "searchQuery", "search_string", "search_query", "find", "findText",
    "searchString", "searchword", "keys", "term", "terms", "qry", "srch", "searchStr", "searchtext", "searchKeyword", "do", "sentance", "keywordsearch",
)
# Search paths of hosts, and that of any other; hosts of registers, which are searched by taxpayer number.
SEARCH_PATHS = {
    "hh.ru": "/search/vacancy?text=", "habr.com": "/search?q=", "zakupki.gov.ru": "/search?q=", "fedresurs.ru": "/search?q=",
    "kad.arbitr.ru": "/search?q=", "nalog.ru": "/search?q=", "egrul.nalog.ru": "/search?q=", "fips.ru": "/search?q=", "rbc.ru": "/search?query=",
}
SEARCH_PATH = "/search?q="
REGISTERS = ("fedresurs.ru", "fips.ru", "zakupki.gov.ru", "kad.arbitr.ru", "nalog.ru", "egrul.nalog.ru")
#: Shared links from which a search is taken not to filter; items and pages of a collection at most.
UNFILTERED, MOST_ITEMS, MOST_PAGES = 0.7, 20, 10


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def normalized_target(name: Column, strip_legal: bool = False) -> Column:
    """A name as it is compared: lower case, single spaces, without punctuation, and on request without its legal form."""
    plain = F.lower(F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " ")))
    plain = F.translate(plain, PUNCTUATION, "")
    return F.btrim(without_legal_form(plain) if strip_legal else plain)


def _stands_in(name: Column, page: Column) -> Column:
    """Whether a name stands in a page as whole words: it is quoted, as it may hold any character."""
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(name, F.lit("\\E"), F.lit("")), F.lit(r"\E\b"))
    return (name != "") & F.regexp_like(page, quoted)


def matched_target(page: Column, name: Column) -> Column:
    """full, stripped or null: whether a page (or text) names the target whole, or without its legal form."""
    return _bound(
        F.struct(F.lower(page).alias("page"), normalized_target(name).alias("full"), normalized_target(name, True).alias("short")),
        lambda x: F.when(_stands_in(x["full"], x["page"]), "full").when((x["short"] != x["full"]) & _stands_in(x["short"], x["page"]), "stripped"),
    )


def target_score(page: Column, name: Column, number: Column) -> Column:
    """How sure it is that a page is about a target: its name, or else a part of its text, and its taxpayer number."""
    short, inn = normalized_target(name, True), F.btrim(F.coalesce(number, F.lit("")))
    named = F.when(matched_target(page, name).isNotNull(), NAME_FOUND).when((short != "") & F.contains(F.lower(page), short), PART_FOUND).otherwise(0)
    numbered = F.when(inn.rlike(r"^(\d{10}|\d{12})$") & _stands_in(inn, F.lower(page)), NUMBER_FOUND).otherwise(0)
    return F.when(F.coalesce(page, F.lit("")) == "", 0).otherwise(named + numbered)


def looks_like_results(page: Column) -> Column:
    """Whether a page seems to hold search results."""
    lowered = F.lower(page)
    none = F.lit(False)
    for marker in NO_RESULTS:
        none = none | F.contains(lowered, F.lit(marker))
    links = F.filter(F.regexp_extract_all(page, F.lit(r'(?i)<a\s[^>]*href="\s*([^"]*)"'), F.lit(1)), lambda x: (F.btrim(x) != "") & ~F.lower(x).rlike(r"^(#|javascript:|mailto:)"))
    return F.coalesce((F.length(page) >= RESULTS_LENGTH) & ~none & (lowered.rlike(RESULTS) | (F.size(links) > RESULTS_LINKS)), F.lit(False))


def unfiltered(overlap: Column) -> Column:
    """Whether two searches share so many links that the site seems to ignore what is searched for."""
    return overlap >= UNFILTERED


def quoted(value: Column) -> Column:
    """A value as part of a query string, a space as a plus."""
    return F.url_encode(value)


def probe_address(address: Column, parameter: Column, value: Column) -> Column:
    """A search address with its search parameter, whichever it is, replaced by ``parameter``; other parameters stay."""
    base, query = F.substring_index(address, "?", 1), F.when(F.contains(address, F.lit("?")), F.regexp_extract(address, r"(?s)\?(.*)$", 1)).otherwise("")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*SEARCH_PARAMETERS))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(kept, F.array(F.concat(parameter, F.lit("="), quoted(value)))), "&"))


def search_address(source: Column, value: Column) -> Column:
    """Where a source is searched: by the path of the first listed host that its host holds, or is part of."""
    def chosen(at: Column) -> Column:
        path = F.lit(SEARCH_PATH)
        for known, own in reversed(SEARCH_PATHS.items()):
            path = F.when(F.contains(at, F.lit(known)) | F.contains(F.lit(known), at), own).otherwise(path)
        return F.concat(F.lit("https://"), at, path, quoted(value))

    return _bound(host(source), lambda at: F.when(at.isNotNull(), chosen(at)))


def prefers_number(source: Column, kind: Column | None = None) -> Column:
    """Whether a source is searched by taxpayer number: registers are, by their kind or host."""
    at = F.coalesce(host(source), F.lit(""))
    out = F.lit(False) if kind is None else F.coalesce(kind == "registry", F.lit(False))
    for known in REGISTERS:
        out = out | F.contains(at, F.lit(known))
    return out


def _is_number(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^(\d{10}|\d{12})$"), F.lit(False))


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def search_value(source: Column, number: Column, name: Column, trigger: Column, kind: Column | None = None) -> Column:
    """What is searched for: in registers the number, or a trigger that is one; else the name, else the trigger."""
    by_number = F.when(prefers_number(source, kind), F.coalesce(_some(number), F.when(_is_number(trigger), trigger)))
    return F.coalesce(by_number, _some(name), _some(trigger), F.lit(""))


def lacks_number(source: Column, number: Column, trigger: Column, kind: Column | None = None) -> Column:
    """Whether a register can't be searched for want of a number."""
    return prefers_number(source, kind) & _some(number).isNull() & ~_is_number(trigger)


def source_address(value: Column) -> Column:
    """``scheme://host/`` of a URL or bare domain; null without a host."""
    scheme = F.coalesce(_some(F.lower(F.regexp_extract(F.btrim(value), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))), F.lit("https"))
    return F.concat(scheme, F.lit("://"), host(value), F.lit("/"))


def domains(values: Column) -> Column:
    """Web addresses of an array as their domains, other strings as they are, each once."""
    return F.array_distinct(F.transform(values, lambda v: F.when(v.rlike(r"^https?://"), domain(v)).otherwise(v)))


def known_domains(addresses: Column, listed: Column) -> Column:
    return F.array_union(domains(addresses), F.coalesce(listed, F.array().cast("array<string>")))


def needs_model(text: Column, short_too: bool = True) -> Column:
    """Whether a model should extract the text: it isn't confident, unless short but complete texts are accepted."""
    doubtful = ~F.coalesce(confident(text), F.lit(False))
    return doubtful if short_too else doubtful & (text.isNull() | looks_truncated(text))


def most_pages(per_page: Column, items: int = MOST_ITEMS, pages: int = MOST_PAGES) -> Column:
    """Result pages that a collection visits at most: enough for its items, one at least."""
    enough = F.ceil(F.lit(float(items)) / per_page)
    return F.greatest(F.lit(1), F.when(per_page > 0, F.least(F.lit(pages), enough)).otherwise(pages)).cast("long")


def city(address: Column) -> Column:
    """The city that an address names after its mark, each word and each part of a hyphened word with a capital; null without."""
    found = F.regexp_replace(F.btrim(F.regexp_extract(address, r"(?:г\.|город|Г\.)\s*([А-Яа-яёЁ\s-]+?)(?:,|$|\.)", 1)), r"\s+", " ")
    capital = F.array_join(F.transform(F.split(found, "-"), lambda part: F.initcap(part)), "-")
    return F.nullif(capital, F.lit(""))


def register_card(text: Column) -> Column:
    """Date of registration, region, and the block of the director, of a register's card given as text."""
    first = F.regexp_extract(between(text, "Дата регистрации", "Правовая форма (ОКОПФ)"), r"\d{2}\.\d{2}\.\d{4}", 0)
    where = city(between(text, "Адрес по данным ЕГРЮЛ", "Дата регистрации"))
    ends = "Дата внесения данных в ЕГРЮЛ"
    block = F.btrim(between(text, "Единоличный исполнительный орган", ends), F.lit(" \n"))
    entered = F.regexp_extract(text, ends + r"\n(\d{2}\.\d{2}\.\d{4})", 1)
    director = F.concat_ws("\n", block, F.lit(ends), F.nullif(entered, F.lit("")))
    return F.struct(F.nullif(first, F.lit("")).alias("published_at"), where.alias("region"), F.when(block.isNotNull(), director).alias("extra"))


def city_aliases(name: Column) -> Column:
    return F.array_distinct(F.array(F.lower(name), F.concat(F.lit("г. "), F.lower(name)), F.concat(F.lit("г "), F.lower(name))))


def clamped(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def demo_index(id_: Column) -> Column:
    """A repeatable stand-in for a media index: 1 to 5 by a hash of the id."""
    return F.round(1 + F.pmod(F.xxhash64(id_), F.lit(401)) / 100, 2)


def complete_text(cached: Column, fetched: Column, title: Column) -> Column:
    """What is stored of an article: the cached or fetched text, else its title as an incomplete one."""
    text = F.coalesce(_some(cached), _some(fetched))
    method = F.when(_some(cached).isNotNull(), "cache").when(text.isNotNull(), "fetched").otherwise("snippet_title")
    marks = F.lit(False)
    for mark in CUT_MARKS:
        marks = marks | F.contains(F.coalesce(text, F.lit("")), F.lit(mark))
    return F.struct(F.coalesce(text, title).alias("text"), method.alias("method"), (text.isNull() | looks_truncated(text)).alias("incomplete"))


def pages_for(items: int, size: int) -> int:
    return max(1, math.ceil(items / size)) if size > 0 else 1
