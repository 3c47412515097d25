"""Kinds of sites, frameworks, meta marks and allowed strategies of pages, by markers in their mark-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.classify import ANTIBOT, CAPTCHA, SPA, complexity, marked, source_type, strategy

# Markers of JavaScript and style frameworks, looked for in the lower-cased page. Those with capitals never match.
FRAMEWORKS = {
    "react": ("data-reactroot", "data-reactid", "__REACT_DEVTOOLS_GLOBAL_HOOK__", "react.development", "react.production"),
    "vue": ("data-v-", "__VUE__", "v-if", "v-for", "v-bind", "vue.global"),
    "angular": ("ng-app", "ng-controller", "ng-version", "angular.min"),
    "nextjs": ("__NEXT_DATA__", "next-page"),
    "nuxt": ("__NUXT__", "data-nuxt"),
}
STYLES = {
    "bootstrap": ("bootstrap.min.css", "bootstrap.bundle", "btn-primary"),
    "tailwind": ("tailwindcss", "tailwind.min", "hover:", "focus:"),
    "material": ("material.", "mdc-"),
    "semantic_ui": ("semantic.min.css", "semantic-ui"),
}
# Class and id names of shopping carts; the simpler classification knows the first four.
CARTS = (("class", "cart"), ("id", "cart"), ("class", "basket"), ("class", "shopping-cart"), ("class", "buy"))
# Words of a schema.org type, and the kind of site that the first of them tells.
SCHEMA_KINDS = (("product", "e_commerce"), ("jobposting", "job_board"), ("review", "review_aggregator"), ("faqpage", "question_answer"), ("article", "news"))
TEXT_KINDS = (("вакансия", "job_board"), ("вакансии", "job_board"), ("объявлени", "classifieds"), ("отзыв", "review_aggregator"))
# Flags (bot guard, captcha, single page) of sources that are known to have them.
KNOWN_SOURCES = {"fedresurs.ru": (True, False, True), "kad.arbitr.ru": (True, False, True), "zakupki.gov.ru": (True, False, False), "nalog.ru": (True, False, False), "egrul.nalog.ru": (True, False, False), "fips.ru": (False, False, False)}
# Fetch strategies in the order in which they are tried, and what is left of them for guarded pages.
LADDER = ("FAST", "CRAWL4AI", "BROWSER", "WAYBACK", "STEALTH_SPA", "HITL")
CAPTCHA_LADDER, GUARDED_LADDER = ("STEALTH_SPA", "WAYBACK", "HITL"), ("FAST", "BROWSER", "WAYBACK", "STEALTH", "HITL")
# Confidence in a kind that was recognised, and in none; the first pair is that of the full classification.
SURE, UNSURE, HEURISTIC_SURE, HEURISTIC_UNSURE = 1.0, 0.5, 0.7, 0.4


def _has(page: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(page, F.lit(m))
    return F.coalesce(out, F.lit(False))


def listed(page: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Names of the groups of which a marker stands in the lower-cased page, in their order."""
    lowered = F.lower(F.coalesce(page, F.lit("")))
    return F.array_compact(F.array(*[F.when(_has(lowered, markers), name) for name, markers in groups.items()]))


def _first_kind(text: Column, kinds) -> Column:
    found = F.lit(None).cast("string")
    for word, kind in reversed(kinds):
        found = F.when(F.contains(text, F.lit(word)), kind).otherwise(found)
    return found


def _schema_types(page: Column) -> Column:
    """The tags of a page that name a schema.org type, in lower case and in order."""
    return F.transform(F.regexp_extract_all(page, F.lit(r'(?i)(<[^>]*itemtype="[^"]*schema\.org[^>]*>)'), F.lit(1)), lambda t: F.lower(t))


def has_cart(page: Column, carts=CARTS) -> Column:
    """Whether an element has the class or id of a shopping cart."""
    out = F.lit(False)
    for attribute, name in carts:
        out = out | page.rlike(rf'(?i)<[^>]*\b{attribute}="' + (rf'([^"]*\s)?{name}(\s[^"]*)?"' if attribute == "class" else rf'{name}"'))
    return F.coalesce(out, F.lit(False))


def site_kind(page: Column) -> Column:
    """The kind of a site: by the first schema.org tag that tells one, the page's Open Graph type, a cart, words; else other."""
    by_schema = F.get(F.filter(F.transform(_schema_types(page), lambda t: _first_kind(t, SCHEMA_KINDS)), lambda k: k.isNotNull()), F.lit(0))
    graph = F.lower(F.regexp_extract(page, r'(?is)<meta[^>]*property="og:type"[^>]*content="([^"]*)"', 1))
    by_graph = F.when(graph == "product", "e_commerce").when(graph == "article", "news")
    return F.coalesce(by_schema, by_graph, F.when(has_cart(page), "e_commerce"), _first_kind(F.lower(page), TEXT_KINDS), F.lit("other"))


def heuristic_kind(page: Column) -> Column:
    """The kind by schema.org tags, where the last counts but news ends the search, or by a cart: what stands in for a model."""
    kinds = (("product", "e_commerce"), ("jobposting", "job_board"), ("article", "news"))
    found = F.filter(F.transform(_schema_types(page), lambda t: _first_kind(t, kinds)), lambda k: k.isNotNull())
    by_schema = F.when(F.array_contains(found, "news"), "news").otherwise(F.element_at(F.concat(F.array(F.lit(None).cast("string")), found), -1))
    return F.coalesce(by_schema, F.when(has_cart(page, CARTS[:4]), "e_commerce"), F.lit("other"))


def heuristic(page: Column) -> Column:
    """Kind, flags and confidence without a model."""
    kind = heuristic_kind(page)
    spa = F.coalesce(F.contains(page, F.lit('id="app"')) | F.contains(page, F.lit('id="root"')), F.lit(False))
    return F.struct(kind.alias("site_type"), spa.alias("is_spa"), marked(page, ("cloudflare",)).alias("has_antibot"), F.when(kind == "other", HEURISTIC_UNSURE).otherwise(HEURISTIC_SURE).alias("confidence"))


def meta_flags(page: Column) -> Column:
    lowered = F.lower(F.coalesce(page, F.lit("")))
    return F.struct(
        _has(lowered, ("metrika", "yandex_metrika")).alias("has_ya_metrika"), _has(lowered, ("google-analytics", "gtag")).alias("has_ga"),
        _has(lowered, ("fbq", "facebook-pixel")).alias("has_fb_pixel"), F.coalesce(page.rlike(r'(?i)<meta[^>]*name="[^"]*verification'), F.lit(False)).alias("has_verification"),
    )


def business_flags(page: Column) -> Column:
    lowered = F.lower(F.coalesce(page, F.lit("")))
    return F.struct(_has(lowered, (".cart", "#cart", ".basket")).alias("has_cart"), _has(lowered, ("search",)).alias("has_search"), _has(lowered, ("pagination", "page=")).alias("has_pagination"))


def known_flags(name: Column, url: Column) -> Column:
    """Bot guard, captcha and single page, as a source known by its name or URL has them; null for others."""
    both, found = F.lower(F.concat_ws(" ", name, url)), F.lit(None).cast("struct<antibot: boolean, captcha: boolean, spa: boolean>")
    for domain, flags in reversed(KNOWN_SOURCES.items()):
        found = F.when(F.contains(both, F.lit(domain)), F.struct(*[F.lit(f).alias(n) for f, n in zip(flags, ("antibot", "captcha", "spa"))])).otherwise(found)
    return found


def allowed_strategies(captcha: Column, antibot: Column, spa: Column) -> Column:
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.when(captcha, names(CAPTCHA_LADDER)).when(antibot & ~spa, names(GUARDED_LADDER)).otherwise(names(LADDER))


def classified(pages: DataFrame, page: str, url: str, name: str | None = None, headers: str | None = None) -> DataFrame:
    """``pages`` with a struct ``site``: everything the classification tells, from mark-up, response headers and known sources."""
    p, named = F.coalesce(F.col(page), F.lit("")), F.col(name) if name else F.lit(None).cast("string")
    guarded = p if headers is None else F.concat_ws(" ", F.col(headers), p)
    known = known_flags(named, F.col(url))
    seen = lambda found, flag: found | F.coalesce(known[flag], F.lit(False))
    out = pages.withColumn("site", F.struct(seen(marked(guarded, ANTIBOT), "antibot").alias("antibot"), seen(marked(p, CAPTCHA), "captcha").alias("captcha"), seen(marked(p, SPA), "spa").alias("spa")))
    antibot, captcha, spa = (F.col("site")[c] for c in ("antibot", "captcha", "spa"))
    kind, typed = site_kind(p), source_type(F.col(url), named, spa)
    return out.withColumn("site", F.struct(
        antibot.alias("antibot"), captcha.alias("captcha"), spa.alias("spa"), typed.alias("source_type"), complexity(spa, captcha, antibot, typed).alias("complexity"),
        strategy(typed == "api", spa, captcha, antibot).alias("strategy"), allowed_strategies(captcha, antibot, spa).alias("allowed"), kind.alias("site_type"),
        F.when(kind == "other", UNSURE).otherwise(SURE).alias("confidence"), listed(p, FRAMEWORKS).alias("frameworks"), listed(p, STYLES).alias("styles"),
        meta_flags(p).alias("meta"), business_flags(p).alias("business"),
    ))
