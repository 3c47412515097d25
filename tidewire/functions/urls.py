"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path parts of service pages, and the prefix of hosts that only redirect to advertisers.
SERVICE_PATHS = ("/account/", "/login", "/signup", "/register", "/logout", "/recover", "/reset", "/article/cookie_policy", "/cookie_policy", "/privacy", "/favicon")
AD_HOST = "adsrv."
# Query parameters that don't identify a page.
NOISE_PARAMETERS = ("hhtmFrom", "hhtmSource", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")


def domain(url: Column) -> Column:
    """The authority in lower case without a leading ``www.``; port and user stay. Null for none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def host(value: Column) -> Column:
    """The bare host of a URL or of a domain given alone: no scheme, user, port or ``www.``; null with white space in it."""
    value = F.lower(F.btrim(value))
    rest = F.regexp_replace(value, r"^(?:[a-z][a-z0-9+.-]*:)?//", "")
    rest = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r":[0-9]*$", ""), r"^www\.", "")
    return F.when(value.rlike(r"\s") | (rest == ""), None).otherwise(rest)


def url_key(url: Column) -> Column:
    """A key under which a page is the same page: no fragment, no noise parameters, no trailing slashes; null for none."""
    bare = F.split(url, "#")[0]
    base, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*NOISE_PARAMETERS)), "&")
    whole = F.rtrim(F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept)), F.lit("/"))
    return F.nullif(whole, F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def is_service(url: Column) -> Column:
    out = F.lit(False)
    for part in SERVICE_PATHS:
        out = out | F.contains(path(url), F.lit(part))
    return F.coalesce(out, F.lit(False))


def is_ad(url: Column) -> Column:
    return F.coalesce(F.startswith(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(AD_HOST)), F.lit(False))


def is_fetchable(url: Column) -> Column:
    """Absolute and relative web addresses; not ``mailto:`` and other schemes."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.coalesce(scheme.isin("", "http", "https"), F.lit(False))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments, by a fold over the segments (RFC 3986, 5.2.4)."""
    segments = F.split(path, "/", -1)
    last = F.size(segments) - 1
    none = F.array().cast("array<string>")

    def step(kept: Column, s: Column) -> Column:
        at_end = s["i"] == last
        end = F.when(at_end, F.array(F.lit(""))).otherwise(none)  # a dot at the end leaves its slash
        # The empty segment before the first slash is never taken away.
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(s["x"] == ".", F.concat(kept, end)).when(s["x"] == "..", F.concat(up, end)).otherwise(F.concat(kept, F.array(s["x"])))

    numbered = F.transform(segments, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.array_join(F.aggregate(numbered, none, step), "/")


def absolute(url: Column, page: Column) -> Column:
    """A link made absolute against its page's address (RFC 3986, 5.2), dot segments, queries and fragments included."""
    part = lambda c, group: F.regexp_extract(c, r"^(?s)([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$", group)
    scheme, host, path, query, fragment = (part(url, g) for g in range(1, 6))
    p_scheme, p_host, p_path, p_query = (part(page, g) for g in range(1, 5))
    folder = F.regexp_extract(p_path, r"^(.*/)", 1)
    beside = F.when((p_host != "") & (p_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(folder, path))
    new_path = F.when(path == "", p_path).when(F.startswith(path, F.lit("/")), without_dots(path)).otherwise(without_dots(beside))
    new_query = F.when((path == "") & (query == ""), p_query).otherwise(query)
    opaque = (scheme != "") & (host == "") & ~F.startswith(path, F.lit("/"))  # mailto:, javascript: and their like
    return (
        F.when(opaque, url)
        .when(scheme != "", F.concat(scheme, host, without_dots(path), query, fragment))
        .when(host != "", F.concat(p_scheme, host, without_dots(path), query, fragment))
        .otherwise(F.concat(p_scheme, p_host, new_path, new_query, fragment))
    )


def links(page: Column) -> Column:
    """The addresses of a page's anchors, in order: in double or single quotes, or bare."""
    found = F.regexp_extract_all(page, F.lit(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""), F.lit(1))
    return F.transform(found, lambda x: F.when(x.rlike("^[\"']"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def labelled_links(page: Column, address: Column) -> Column:
    """(href, text) of a page's anchors in order: absolute addresses, and what stands between the tags without mark-up."""
    found = F.regexp_extract_all(page, F.lit(r"(?is)(<a\s(?:(?!</a\s*>).)*)</a\s*>"), F.lit(1))
    href = lambda x: absolute(F.get(links(x), F.lit(0)), address)
    text = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?s)^<a[^>]*>", ""), r"(?s)<[^>]*>", " "), r"\s+", " "))
    return F.filter(F.transform(found, lambda x: F.struct(href(x).alias("href"), text(x).alias("text"))), lambda a: a["href"].isNotNull())


def page_address(url: Column, number: Column, parameter: str = "page", size: int | None = None) -> Column:
    """The address of a result page by number, or by offset where pages have a ``size``."""
    value = number if size is None else (number - 1) * size
    glue = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.concat(url, glue, F.lit(f"{parameter}="), value.cast("string"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
