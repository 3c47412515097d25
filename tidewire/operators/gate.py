"""The six levels of the quality gate over snapshots of items, their quarantine, and the types that fields may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.targets import matched_target
from tidewire.functions.urls import url_key

# Required fields, fields that must be texts where they aren't null, and the levels in their order.
REQUIRED, TEXTS = ("url", "title"), ("url", "title", "text", "published_at", "region", "media_name")
LEVELS = ("SCHEMA", "TYPES", "BUSINESS", "VOLUME", "CONSISTENCY", "RELEVANCE")
#: The share of the expected number of items from which a snapshot is whole.
WHOLE = 0.8


def type_errors(payload: Column, fields: tuple[str, ...] = TEXTS) -> Column:
    """Fields of an item, given as JSON text, that hold something other than a text or null."""
    wrong = F.lit(0)
    for field in fields:
        wrong = wrong + F.when(_is_text(payload, field), 0).otherwise(1)
    return wrong


def _is_text(payload: Column, field: str) -> Column:
    found = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "variant"))
    return F.coalesce(found, F.lit("VOID")).isin("STRING", "VOID")


def _names_target(payload: Column, body: Column) -> Column:
    """Whether an item, or one of the news in its ``extra.news``, names the competitor or the trigger of its snapshot."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    news = F.from_json(F.get_json_object(payload, "$.extra.news"), "array<struct<ex_title: string, ex_text: string>>")
    told = F.transform(news, lambda n: F.concat_ws(" ", F.coalesce(n["ex_title"], F.lit("")), F.coalesce(n["ex_text"], F.lit(""))))
    named = lambda text: (some("competitor") & matched_target(text, F.col("competitor")).isNotNull()) | (some("trigger") & F.contains(F.lower(text), F.lower("trigger")))
    return F.coalesce(named(body), F.lit(False)) | F.coalesce(F.exists(told, lambda t: F.coalesce(named(t), F.lit(False))), F.lit(False))


def reports(items: DataFrame, snapshots: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """(snapshot, level, errors, item_count, passed_count, passed) of every snapshot in every level.

    ``items`` has (snapshot, pos, url, title, text, payload), where payload is the item as JSON text; ``snapshots`` has (snapshot,
    expected, competitor, trigger), of which all but the first may be null. Errors are counted, not items, so passed_count may be
    negative. A snapshot without an expected number has no VOLUME row. One without a target passes RELEVANCE; otherwise one item
    that names the target is enough, itself or in the news that its ``extra`` lists.
    """
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", 1).otherwise(0)
    schema = sum((blank(c) for c in REQUIRED[1:]), blank(REQUIRED[0]))
    business = F.lit(0)
    for c, n in (least or {}).items():
        business = business + F.when(F.length(c) < n, 1).otherwise(0)
    aimed = items.join(snapshots.select("snapshot", "competitor", "trigger"), "snapshot")
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    hit = _names_target(F.col("payload"), body)
    rows = aimed.select("snapshot", url_key(F.col("url")).alias("key"), schema.alias("SCHEMA"), type_errors(F.col("payload")).alias("TYPES"), business.alias("BUSINESS"), F.coalesce(hit, F.lit(False)).alias("hit"))
    # Two steps, so that a snapshot's repeated keys are counted without a window over them.
    keyed = rows.groupBy("snapshot", "key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("SCHEMA", "TYPES", "BUSINESS")], F.max("hit").alias("hit"))
    again = F.sum(F.when(F.col("key").isNotNull(), F.col("n") - 1).otherwise(0)).alias("CONSISTENCY")
    sums = keyed.groupBy("snapshot").agg(F.sum("n").alias("item_count"), *[F.sum(c).alias(c) for c in ("SCHEMA", "TYPES", "BUSINESS")], again, F.max("hit").alias("hit"))
    out = snapshots.join(sums, "snapshot", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    aimless = ~some("competitor") & ~some("trigger")
    level = lambda name, errors, passed=None, left=None: F.struct(F.lit(name).alias("level"), errors.cast("long").alias("errors"), (left if left is not None else F.col("item_count") - errors).cast("long").alias("passed_count"), (passed if passed is not None else errors == 0).alias("passed"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    short = F.when(F.col("expected") > 0, F.col("item_count") / F.col("expected") < WHOLE).otherwise(False)
    found = aimless | F.coalesce("hit", F.lit(False))
    levels = F.array(
        level("SCHEMA", count("SCHEMA")), level("TYPES", count("TYPES")), level("BUSINESS", count("BUSINESS")),
        F.when(F.col("expected").isNotNull(), level("VOLUME", F.lit(0), ~short, F.col("item_count"))),
        level("CONSISTENCY", count("CONSISTENCY")),
        level("RELEVANCE", F.when(found, 0).otherwise(1), found, F.when(found, F.col("item_count")).otherwise(0)),
    )
    return out.select("snapshot", "item_count", F.explode(F.filter(levels, lambda x: x.isNotNull())).alias("x")).select("snapshot", "x.level", "x.errors", "item_count", "x.passed_count", "x.passed")


def all_passed(found: DataFrame) -> DataFrame:
    return found.groupBy("snapshot").agg(F.min("passed").alias("passed"))


def quarantine(items: DataFrame, found: DataFrame) -> DataFrame:
    """The items of snapshots that failed a level, once for each such level: a table of rejects that can be read again."""
    return items.join(found.filter("not passed").select("snapshot", "level", "errors"), "snapshot")


def errors(items: DataFrame, snapshots: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """(snapshot, pos, level, field, rule, payload): a row for each single error of the snapshots, with the item it is in.

    Errors of an item (a required field that is blank, a field that holds no text, a text that is too short, an address that an
    earlier item has) name its position and field; those of a whole snapshot (too few items, no item that names its target) have
    neither. The rows can be read again: ``payload`` is the item as it came.
    """
    error = lambda level, field, rule: F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), F.lit(rule).alias("rule"))
    short = [F.when(F.length(c) < n, error("BUSINESS", c, f"shorter than {n}")) for c, n in (least or {}).items()]
    blank = [F.when(F.coalesce(F.col(c), F.lit("")) == "", error("SCHEMA", c, "required")) for c in REQUIRED]
    typed = [F.when(~_is_text(F.col("payload"), c), error("TYPES", c, "not a text")) for c in TEXTS]
    own = items.join(snapshots.select("snapshot"), "snapshot", "left_semi").withColumn("key", url_key(F.col("url")))
    first = own.filter("key is not null").groupBy("snapshot", "key").agg(F.min("pos").alias("first"))
    again = F.when(F.col("pos") > F.col("first"), error("CONSISTENCY", "url", "repeated"))
    found = own.join(first, ["snapshot", "key"], "left").select("snapshot", "pos", "payload", F.explode(F.filter(F.array(*blank, *typed, *short, again), lambda e: e.isNotNull())).alias("e"))
    each = found.select("snapshot", "pos", "e.level", "e.field", "e.rule", "payload")
    whole = reports(items, snapshots, least).filter("not passed and level in ('VOLUME', 'RELEVANCE')")
    rule = F.when(F.col("level") == "VOLUME", f"under {WHOLE} of the expected items").otherwise("no item names the target")
    nothing = lambda kind: F.lit(None).cast(kind)
    return each.unionByName(whole.select("snapshot", nothing(each.schema["pos"].dataType).alias("pos"), "level", nothing("string").alias("field"), rule.alias("rule"), nothing("string").alias("payload")))
