"""URL filters: rules found through an index of their rarest literal tokens.

A pattern rule is a regular expression with the literal tokens that any match must hold; a host rule's tokens are those of its
host and the whole ones of its path. Each rule is posted under the one of its tokens that the fewest URLs of the corpus hold
(counted over all of them), so that common tokens fetch nothing; the tokens of a URL fetch candidate rules, and only those run
their regular expressions, or compare their hosts and paths, on it.

Host and path rules come first: such a rule fits its host and all subdomains when the URL's path starts with the rule's path;
the longest fitting rule (by host, then path) decides.

Defined results: a null URL, or one without ``://``, has empty host and path, no host rule, and is allowed unless a pattern
matches it; repeated URLs get equal results; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shared import free_name, saved

#: A token is a run of letters and digits; URLs and literals are compared in lower case.
TOKEN = r"[a-z0-9]+"
#: Rules whose table is broadcast at most; a longer index is joined by a shuffle on the token.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class PatternRule:
    """A verdict, a regular expression over the lower-cased URL, and tokens that each match holds as whole tokens."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def _literal(name: str, *tokens: str, verdict: str = "block") -> PatternRule:
    """Tokens in this order as a hyphened, underscored or dotted phrase, bounded on both sides."""
    return PatternRule(name, verdict, r"(^|[^a-z0-9])" + "[-_.]".join(tokens) + r"($|[^a-z0-9])", tokens)


#: The pattern rules of the registered query: phrases of spam hosts and paths, tracking redirects, and an exception.
PATTERN_RULES = (
    _literal("cheap-pills", "cheap", "pills"),
    _literal("free-casino", "free", "casino"),
    _literal("online-casino", "online", "casino"),
    _literal("win-money", "win", "money"),
    _literal("adult-video", "adult", "video"),
    _literal("hot-singles", "hot", "singles"),
    _literal("payday-loan", "payday", "loan"),
    _literal("porn", "porn"),
    _literal("xxx", "xxx"),
    *(PatternRule(f"{word}-link", "block", rf"/{word}\?([^#]*&)?(url|to|target)=https?(:|%3a)", (word,)) for word in ("redirect", "out", "click")),
    *(PatternRule(f"{word}", "block", rf"[?&;]{word}=[a-z0-9]{{8,}}", (word,)) for word in ("phpsessid", "jsessionid")),
    PatternRule("education", "allow", r"://([a-z0-9-]+\.)*[a-z0-9-]+\.edu(/|$|\?|#|:)", ("edu",)),
)
#: Host and path rules of the registered query: verdict, host, path.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_tokens(host: str, path: str) -> list[str]:
    """Tokens that the URL holds as whole ones wherever the rule fits: a path's last token may go on in the URL."""
    return re.findall(TOKEN, host.lower()) + re.findall(TOKEN + r"(?=[^a-z0-9])", path.lower())


def indexed(urls: DataFrame, url: str, pattern_rules, host_rules) -> DataFrame:
    """(token, rule): each rule under its token that the fewest of the distinct ``urls`` hold.

    Rules without a literal token can't be indexed and stand under the empty token, which every URL has.
    """
    rows = [(r.name, r.verdict, r.pattern, None, None, list(r.tokens or ("",))) for r in pattern_rules]
    rows += [(host + path, verdict, None, host, path, host_tokens(host, path) or [""]) for verdict, host, path in host_rules]
    wanted = urls.sparkSession.createDataFrame(rows, "name string, verdict string, pattern string, host string, path string, tokens array<string>")
    held = wanted.select(F.struct("name", "verdict", "pattern", "host", "path").alias("rule"), F.explode("tokens").alias("token"))
    seen = urls.select(F.explode(tokens(F.col(url))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counted = held.join(seen, "token", "left").select("rule", "token", F.coalesce("n", F.lit(0)).alias("seen"))
    return counted.groupBy("rule").agg(F.min_by("token", F.struct("seen", "token")).alias("token"))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, and the empty token."""
    return F.array_union(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit(f"({TOKEN})"))), F.array(F.lit("")))


def matches(urls: DataFrame, url: str, pattern_rules=PATTERN_RULES, host_rules=HOST_RULES) -> DataFrame:
    """(url, patterns, verdict, host_rule) of the distinct URLs that a rule fits.

    ``patterns`` are the names of the pattern rules that match, and ``verdict`` is theirs, where an allowing match wins over
    blocking ones; ``host_rule`` is the longest host rule that fits, with its verdict.
    """
    index = indexed(urls, url, pattern_rules, host_rules)
    if len(pattern_rules) + len(host_rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    host, path = host_and_path(F.col(url))
    posted = urls.select(url, host.alias("host"), path.alias("path"), F.explode(tokens(F.col(url))).alias("token"))
    fits = F.expr(f"case when rule.pattern is not null then lower(`{url}`) rlike rule.pattern else (host = rule.host or endswith(host, concat('.', rule.host))) and startswith(path, rule.path) end")
    found = posted.join(index, "token").filter(fits)
    by_pattern = F.col("rule.pattern").isNotNull()
    names = F.array_sort(F.collect_set(F.when(by_pattern, F.col("rule.name"))))
    allow = F.max(F.when(by_pattern, F.col("rule.verdict") == "allow"))
    longest = F.max(F.when(~by_pattern, F.struct(F.length("rule.host").alias("h"), F.length("rule.path").alias("p"), F.col("rule.verdict").alias("verdict"), F.col("rule.name").alias("rule"))))
    return found.groupBy(url).agg(names.alias("patterns"), F.when(allow, "allow").when(~allow, "block").alias("verdict"), longest.alias("host_rule"))


def judged(pages: DataFrame, url: str = "url", host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """``pages`` with host, path, rule, patterns and verdict (``allow`` or ``block``)."""
    key, hit = free_name(pages, "url_key"), free_name(pages, "hit")
    urls = saved(pages.select(F.col(url).alias(key)).filter(F.col(key).isNotNull()).distinct(), "urls")
    matched = matches(urls, key, pattern_rules, host_rules).select(key, F.struct("patterns", "verdict", "host_rule").alias(hit))
    host, path = host_and_path(F.col(url))
    names = {c: free_name(pages, c) for c in ("host", "path", "rule", "patterns", "verdict")}
    out = pages.withColumn(names["host"], host).withColumn(names["path"], path)
    out = out.join(matched, out[url] == matched[key], "left")
    return (
        out.withColumn(names["rule"], F.col(hit)["host_rule"]["rule"])
        .withColumn(names["patterns"], F.coalesce(F.col(hit)["patterns"], F.array().cast("array<string>")))
        .withColumn(names["verdict"], F.coalesce(F.col(hit)["host_rule"]["verdict"], F.col(hit)["verdict"], F.lit("allow")))
        .drop(key, hit)
    )
