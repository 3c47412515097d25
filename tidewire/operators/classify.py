"""Page classification by markers: single-page applications, captchas, bot guards, complexity and fetch strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers looked for in the lower-cased page.
SPA = ("ng-", "angular", "data-reactroot", 'id="app"', 'id="root"', "vue", "nuxt", "next-data")
CAPTCHA = ("captcha",)
ANTIBOT = ("cloudflare", "cf-ray", "cf-cache-status", "datadome", "qrator", "qrator_jsr", "__qrator", "jsid", "akamai", "incapsula")
# What tells the type of a source, in its name or URL (news: the URL alone), and the weights of types.
API = ("api.", "api-", ".api.")
REGISTRY = ("fedresurs.ru", "fips.ru", "zakupki.gov.ru", "kad.arbitr.ru", "nalog.ru", "egrul.nalog.ru")
NEWS = ("news", "ria", "lenta", "tass", "rbc", "interfax")
SOURCE_WEIGHTS = {"api": 0.1, "registry": 0.4, "spa": 0.5, "news": 0.2}


def marked(page: Column, markers: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(page).rlike("|".join(markers)), F.lit(False))


def source_type(url: Column, name: Column, spa: Column) -> Column:
    """api, registry, news, spa or unknown: the first that holds."""
    url, name = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    some = lambda texts, markers: F.greatest(F.lit(False), *[F.contains(t, F.lit(m)) for t in texts for m in markers])
    return F.when(some((url, name), API), "api").when(some((url, name), REGISTRY), "registry").when(some((url,), NEWS), "news").when(spa, "spa").otherwise("unknown")


def complexity(spa: Column, captcha: Column, antibot: Column, source: Column | None = None) -> Column:
    weight = lambda c, w: F.when(c, w).otherwise(0.0)
    total = weight(spa, 0.2) + weight(captcha, 0.3) + weight(antibot, 0.3)
    for kind, w in SOURCE_WEIGHTS.items() if source is not None else ():
        total = total + weight(source == kind, w)
    return F.least(F.lit(1.0), total)


def strategy(is_api: Column, spa: Column, captcha: Column, antibot: Column) -> Column:
    return F.when(is_api, "FAST").when(captcha, "HITL").when(antibot, "STEALTH").when(spa, "BROWSER").otherwise("FAST")


def flags(pages: DataFrame, page: str, url: str | None = None, name: str | None = None) -> DataFrame:
    """Flags and complexity of each page; with a column of URLs (and one of source names) also its source type, which counts too."""
    p = F.col(page)
    out = pages.withColumn("spa", marked(p, SPA)).withColumn("captcha", marked(p, CAPTCHA)).withColumn("antibot", marked(p, ANTIBOT))
    out = out.withColumn("n_links", F.size(F.regexp_extract_all(p, F.lit("<a"), F.lit(0))))
    if url is None:
        return out.withColumn("complexity", complexity(F.col("spa"), F.col("captcha"), F.col("antibot")))
    out = out.withColumn("source_type", source_type(F.col(url), F.col(name) if name else F.lit(None).cast("string"), F.col("spa")))
    return out.withColumn("complexity", complexity(F.col("spa"), F.col("captcha"), F.col("antibot"), F.col("source_type")))
