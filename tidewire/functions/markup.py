"""Functions over mark-up that built-in expressions can't give: blocks of a page, links with their texts, packing, loose JSON.

Each is one Arrow function a row, a small walk with the standard library's parser; splitting and counting stay expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import one_spaced
from tidewire.functions.urls import is_ad, is_fetchable, is_service

# Elements that hold no content, and those that make a block.
NOISE = ("script", "style", "nav", "footer", "header", "aside", "noscript", "iframe", "svg", "form", "button", "template")
BLOCKS = ("article", "section", "div", "p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "blockquote", "pre")
#: Characters of a block's text at least, characters of a packed chunk at most, and of the blocks that it repeats.
BLOCK_LENGTH, CHUNK_LENGTH, OVERLAP = 20, 8000, 500
#: Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Walk(HTMLParser):
    """Collects a page's metadata, the texts of its innermost blocks, and its anchors."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta, self.blocks, self.links = {}, [], []
        self.quiet, self.text, self.anchor, self.in_title = 0, [], None, False

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append(text)
        self.text = []

    def handle_starttag(self, tag, attrs) -> None:
        named = dict(attrs)
        if tag == "meta" and named.get("name", "").lower() in ("description", "keywords"):
            self.meta.setdefault(named["name"].lower(), (named.get("content") or "").strip())
        if tag in NOISE:
            self.quiet += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "title":
            self.in_title = True
        if tag == "a" and named.get("href"):
            self.anchor = [named["href"].strip(), []]

    def handle_endtag(self, tag) -> None:
        if tag in NOISE and self.quiet:
            self.quiet -= 1
        if tag in BLOCKS:
            self.flush()
        if tag == "title":
            self.in_title = False
        if tag == "a" and self.anchor:
            self.links.append((self.anchor[0], " ".join("".join(self.anchor[1]).split())))
            self.anchor = None

    def handle_data(self, data) -> None:
        if self.in_title:
            self.meta["title"] = (self.meta.get("title", "") + data).strip()
        elif not self.quiet:
            self.text.append(data)
        if self.anchor:
            self.anchor[1].append(data)


def _walked(page: str | None) -> _Walk:
    walk = _Walk()
    walk.feed(page or "")
    walk.close()
    walk.flush()
    return walk


def cleaned_page(page: Column, least: int = BLOCK_LENGTH) -> Column:
    """Title, description and keywords of a page, the texts of its blocks of ``least`` characters or more, and how much shorter
    they are than the page."""

    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for text in part:
                walk = _walked(text)
                kept = [b for b in walk.blocks if len(b) >= least]
                size = sum(map(len, kept))
                made.append((walk.meta.get("title"), walk.meta.get("description"), walk.meta.get("keywords"), kept, round(len(text or "") / size, 2) if size else 0.0))
            yield pd.DataFrame(made, columns=["title", "description", "keywords", "blocks", "ratio"])

    return F.pandas_udf(of, "struct<title: string, description: string, keywords: string, blocks: array<string>, ratio: double>")(page)


def anchors(page: Column, address: Column) -> Column:
    """(href, text) of a page's anchors in order, hrefs made absolute, dots and all; those without either are left out."""

    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, addresses in parts:
            made = []
            for text, base in zip(pages, addresses):
                found = [(href, label) for href, label in _walked(text).links if href and label]
                made.append([{"href": _joined(base, href), "text": label} for href, label in found])
            yield pd.Series(made, dtype=object)

    return F.pandas_udf(of, "array<struct<href: string, text: string>>")(page, address)


def _joined(base: str | None, href: str) -> str:
    try:
        return urljoin(base or "", href)
    except ValueError:  # an address that no parser reads stays as it is
        return href


def page_items(page: Column, address: Column, most: int = 20) -> Column:
    """The first ``most`` items that a page lists: its distinct web links that lead to neither service pages nor advertisers.

    The limit is the feature: a source gives so many items at most.
    """
    wanted = lambda a: is_fetchable(a["href"]) & a["href"].rlike("(?i)^https?://") & ~is_service(a["href"]) & ~is_ad(a["href"])
    once = lambda found: F.filter(found, lambda a, i: F.array_position(F.transform(found, lambda b: b["href"]), a["href"]) == i + 1)
    # The anchors, which come from Python, are bound once before expressions go over them.
    return F.transform(F.array(anchors(page, address)), lambda found: F.slice(once(F.filter(found, wanted)), 1, most))[0]


def packed_blocks(blocks: Column, most: int = CHUNK_LENGTH, overlap: int = OVERLAP) -> Column:
    """Blocks packed in order into chunks (text, first, last) of ``most`` characters, with the numbers of their first and last block.

    A chunk begins with the last blocks of the one before that are ``overlap`` characters together at most; a block that is too
    long alone is cut into windows. One fold over the blocks; null has no chunks.
    """
    chunk, step = "struct<text: string, first: int, last: int>", max(1, most - overlap)
    none, no_chunks = F.array().cast("array<string>"), F.array().cast(f"array<{chunk}>")
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))

    def closed(s: Column, last: Column) -> Column:
        own = F.struct(F.array_join(s["current"], "\n").alias("text"), s["first"].alias("first"), last.cast("int").alias("last"))
        return F.when(F.size(s["current"]) > 0, F.concat(s["out"], F.array(own))).otherwise(s["out"])

    def windows(x: Column, i: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(x) - overlap - 1) / step), F.lit(0)).cast("int"))
        return F.transform(starts, lambda k: F.struct(F.substring(x, k * step + 1, F.lit(most)).alias("text"), i.alias("first"), i.alias("last")))

    def repeated(current: Column) -> Column:
        """The longest end of a chunk's blocks that is short enough."""
        fits = F.filter(F.sequence(F.lit(1), F.size(current)), lambda k: length(F.slice(current, k, F.size(current) - k + 1)) <= overlap)
        return F.when(F.size(fits) > 0, F.slice(current, F.get(fits, F.lit(0)), F.size(current))).otherwise(none)

    def step_on(s: Column, b: Column) -> Column:
        x, i = b["x"], b["i"]
        long = F.struct(F.concat(closed(s, i - 1), windows(x, i)).alias("out"), none.alias("current"), (i + 1).alias("first"))
        again = repeated(s["current"])
        full = F.struct(closed(s, i - 1).alias("out"), F.concat(again, F.array(x)).alias("current"), (i - F.size(again)).alias("first"))
        more = F.struct(s["out"].alias("out"), F.concat(s["current"], F.array(x)).alias("current"), s["first"].alias("first"))
        return F.when(F.length(x) > most, long).when((F.size(s["current"]) > 0) & (length(s["current"]) + F.length(x) > most), full).otherwise(more)

    numbered = F.transform(F.coalesce(blocks, none), lambda x, i: F.struct(F.coalesce(x, F.lit("")).alias("x"), i.alias("i")))
    start = F.struct(no_chunks.alias("out"), none.alias("current"), F.lit(0).alias("first"))
    return F.aggregate(numbered, start, step_on, lambda s: closed(s, F.size(numbered) - 1))


def packed(blocks: Column, most: int = CHUNK_LENGTH, overlap: int = OVERLAP) -> Column:
    """The texts of ``packed_blocks``."""
    return F.transform(packed_blocks(blocks, most, overlap), lambda c: c["text"])


def loose_object(answer: Column) -> Column:
    """The JSON object in a model's answer, as JSON text: the whole answer, a fenced block, or what stands from the first to the
    last brace; ``{}`` where none of them is an object."""
    text = F.btrim(answer, F.lit(" \t\r\n"))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)

    def valid(candidate: Column) -> Column:
        parsed = F.try_parse_json(candidate)
        return F.when(F.startswith(F.coalesce(F.schema_of_variant(parsed), F.lit("")), F.lit("OBJECT")), F.to_json(parsed))

    return F.coalesce(valid(text), valid(fenced), valid(braced), F.lit("{}"))


def form_parameter(page: Column) -> Column:
    """(name, action, method) of the first text or search field in the first form that has one."""
    form = F.regexp_extract(page, r"(?is)(<form(?:(?!</form>).)*<input(?:(?!>).)*type=\"(?:text|search)\".*?</form>)", 1)
    field = F.regexp_extract(form, r'(?is)(<input(?:(?!>).)*type="(?:text|search)"[^>]*>)', 1)
    head = F.regexp_extract(form, r"(?is)^(<form[^>]*>)", 1)
    part = lambda tag, name: F.regexp_extract(tag, rf'(?is)\b{name}="([^"]*)"', 1)
    found = F.struct(part(field, "name").alias("name"), part(head, "action").alias("action"), F.coalesce(F.nullif(F.lower(part(head, "method")), F.lit("")), F.lit("get")).alias("method"))
    return F.when(part(field, "name") != "", found)


def nested_news(items: Column) -> Column:
    """Items of a snapshot (url, title, text, extra as JSON text) with each search page replaced by the news that it lists.

    An item is a search page if its ``extra`` has the key ``news``, even an empty one. News without an address are left out, and
    a missing title is that of the page.
    """
    news = "array<struct<ex_url: string, ex_title: string, ex_text: string>>"

    def of(item: Column) -> Column:
        listed = F.get_json_object(item["extra"], "$.news")
        own = F.array(F.struct(item["url"].alias("url"), item["title"].alias("title"), item["text"].alias("text")))
        found = F.filter(F.coalesce(F.from_json(listed, news), F.array().cast(news)), lambda n: F.coalesce(n["ex_url"], F.lit("")) != "")
        shown = F.transform(found, lambda n: F.struct(n["ex_url"].alias("url"), F.coalesce(F.nullif(n["ex_title"], F.lit("")), item["title"]).alias("title"), n["ex_text"].alias("text")))
        return F.when(listed.isNotNull(), shown).otherwise(own)

    return F.flatten(F.transform(items, of))


def joined_text(blocks: Column) -> Column:
    return one_spaced(F.array_join(blocks, " "))
