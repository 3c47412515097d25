"""Snapshot and dictionary storage in the formats of Spark's own readers and writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.targets import city_aliases
from tidewire.functions.values import content_hash
from tidewire.sources import commits

SNAPSHOT = """
raw_id string, meta struct<search_task_id: long, source: string, competitor: string, trigger: string, source_request_url: string,
fetched_at: string, items_count: int, empty_reason: string, status: string>,
items array<struct<url: string, title: string, text: string, published_at: string, region: string, media_name: string, extra: map<string, string>>>
"""
SNAPSHOT_COLUMNS = ("raw_id", "meta", "items")


#: What the index of a store has for each snapshot.
INDEX = "raw_id string, task long, content_hash string"


def write_snapshots(df: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """Append snapshots as JSON under year, month, day and trigger, and return what was written.

    A snapshot whose task has one with equal items already isn't written again; of several in one batch the least raw_id is.
    ``batch`` names what is written: a second run with the same name adds nothing and returns what the first one wrote. Writers
    have folders of their own (``commits``), and the store isn't listed, however large.
    """
    spark, batch = df.sparkSession, batch or uuid.uuid4().hex
    if (done := commits.committed(spark, path, batch)) is None:
        attempt = uuid.uuid4().hex
        keyed = df.withColumn("task", F.col("meta.search_task_id")).withColumn("content_hash", content_hash(F.col("items")))
        same = keyed.groupBy("task", "content_hash").agg(F.min("raw_id").alias("raw_id"))
        known = index(spark, path).select("task", "content_hash")
        new = same.join(known, same["task"].eqNullSafe(known["task"]) & (same["content_hash"] == known["content_hash"]), "left_anti")
        at = F.to_timestamp("meta.fetched_at")
        parts = {"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd"), "trigger": F.coalesce(F.col("meta.trigger"), F.lit("none"))}
        new.write.parquet(f"{path}/index/attempt={attempt}")
        chosen = spark.read.schema(INDEX).parquet(f"{path}/index/attempt={attempt}").select("raw_id")
        df.join(chosen, "raw_id", "left_semi").dropDuplicates(["raw_id"]).withColumns(parts).write.partitionBy(*parts).json(f"{path}/data/attempt={attempt}")
        commits.commit(spark, path, batch, attempt)
        done = commits.committed(spark, path, batch)
    return _data(spark, path, [done])


def _data(spark: SparkSession, path: str, attempts: list[str]) -> DataFrame:
    """The snapshots of attempts; one that wrote none has no files below its folder, which Spark reads as an empty table."""
    places = [f"{path}/data/attempt={a}" for a in attempts]
    return (spark.read.schema(SNAPSHOT).option("basePath", f"{path}/data").json(places) if places else spark.createDataFrame([], SNAPSHOT)).select(*SNAPSHOT_COLUMNS, *([F.col("_metadata.file_path").alias("file")] if places else [F.lit(None).cast("string").alias("file")]))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(raw_id, task, content_hash) of the snapshots that stand: committed, not deleted, and of equal ones of a task the least id.

    Two writers may commit equal snapshots at the same time; from then on all readers agree on one of them.
    """
    places = [f"{path}/index/attempt={a}" for a in sorted(commits.attempts(spark, path).values())]
    every = spark.read.schema(INDEX).parquet(*places) if places else spark.createDataFrame([], INDEX)
    gone = commits.read(spark, f"{path}/_deleted", "raw_id string")
    return every.join(gone, "raw_id", "left_anti").groupBy("task", "content_hash").agg(F.min("raw_id").alias("raw_id")).select("raw_id", "task", "content_hash")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots that stand, each with the file that holds it."""
    return _data(spark, path, sorted(commits.attempts(spark, path).values())).join(index(spark, path).select("raw_id"), "raw_id", "left_semi")


def delete_snapshots(ids: DataFrame, path: str, batch: str | None = None) -> bool:
    """Take the snapshots of ``ids`` (raw_id) out of the store: their ids are noted beside it, and no file is written again."""
    return commits.append(ids.select(F.col("raw_id").cast("string").alias("raw_id")).distinct(), f"{path}/_deleted", batch or uuid.uuid4().hex)


def has_snapshot(spark: SparkSession, path: str, raw_id: str) -> bool:
    """Whether a snapshot stands; the index alone is read."""
    return not index(spark, path).filter(F.col("raw_id") == raw_id).isEmpty()


def snapshots_of(stored: DataFrame, raw_id: str | None = None, trigger: str | None = None, status: str | None = None, items: Column | None = None) -> DataFrame:
    """Stored snapshots by id, trigger, status (``pending`` where none is set), or with equal items; None doesn't filter."""
    out = stored if raw_id is None else stored.filter(F.col("raw_id") == raw_id)
    out = out if trigger is None else out.filter(F.col("meta.trigger") == trigger)
    out = out if status is None else out.filter(F.coalesce("meta.status", F.lit("pending")) == status)
    return out if items is None else out.filter(content_hash(F.col("items")) == content_hash(items))


def with_status(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """``stored`` with the status that ``changes`` (raw_id, status) names: the one field of a snapshot that may change.

    Changes are a table beside the store, so no file is written again; of a snapshot's changes the caller keeps the last.
    """
    new = changes.select("raw_id", F.col("status").alias("_status"))
    out = stored.join(new, "raw_id", "left")
    return out.withColumn("meta", F.col("meta").withField("status", F.coalesce("_status", "meta.status"))).select(*stored.columns)


def read_dictionary(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV dictionary with a header row; rows without a key are left out."""
    return spark.read.csv(path, header=True).filter(F.btrim(key) != "")


def resolved(rows: DataFrame, names: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Dictionary rows with names replaced by ids: {id column: (name column, dimension with id and name)}; unknown names give null."""
    for column, (name, dim) in names.items():
        ids = dim.groupBy(F.col("name").alias(name)).agg(F.min("id").alias(column))
        rows = rows.join(ids, name, "left").drop(name)
    return rows


def regions(spark: SparkSession, path: str) -> DataFrame:
    """(name_display, name_aliases, latitude, longitude) of a JSON list of cities: the first entry of a name counts, and its
    aliases are its own and the usual ones."""
    rows = spark.read.schema("name string, aliases array<string>, coords struct<lat: string, lon: string>, pos long").option("multiLine", True).json(path)
    first = W.partitionBy("name").orderBy(F.col("pos").asc_nulls_last())
    rows = rows.filter(F.btrim("name") != "").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    aliases = F.array_distinct(F.concat(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a)), city_aliases(F.col("name"))))
    return rows.select(F.col("name").alias("name_display"), aliases.alias("name_aliases"), F.col("coords.lat").try_cast("double").alias("latitude"), F.col("coords.lon").try_cast("double").alias("longitude"))


def replace_table(df: DataFrame, path: str, version: str) -> str:
    """Write a table as a new version beside the others, and return its place; a reader changes over by that name."""
    place = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(place)
    return place


def cleared(spark: SparkSession, places: list[str]) -> list[str]:
    """Empty the tables of a layer and those made from it, in the order given: each gets an empty version. Returns their places."""
    return [replace_table(spark.read.parquet(place).limit(0), place.rsplit("/version=", 1)[0], f"{place.rsplit('/version=', 1)[-1]}-cleared") for place in places]


def is_filled(df: DataFrame, active: bool = False) -> bool:
    """Whether a layer has rows (active ones): what a stage looks at before it starts. One row is read, not counted."""
    return not (df.filter("is_active") if active else df).isEmpty()


def counts(df: DataFrame, active: str = "is_active") -> DataFrame:
    """(n, n_active): the rows of a layer, and those that are active (all, where it has no such column)."""
    return df.agg(F.count("*").alias("n"), (F.count_if(F.col(active)) if active in df.columns else F.count("*")).alias("n_active"))


#: What the log of deliveries has for each row.
OUTCOME = "id string, status string, error string, sent_at timestamp"
Send = Callable[[dict], None]


def attempted(rows: DataFrame, send: Send, key: str) -> DataFrame:
    """(id, status, error, sent_at): what came of handing each row to ``send``, task by task; a sender that raises fails its row alone."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for row in part.to_dict("records"):
                try:
                    send(row)
                except Exception as error:  # noqa: BLE001  whatever a sender raises is this row's outcome
                    made.append((str(row[key]), "failed", f"{type(error).__name__}: {error}", pd.NaT))
                else:
                    made.append((str(row[key]), "sent", None, pd.Timestamp.now("UTC").tz_localize(None)))
            out = pd.DataFrame(made, columns=["id", "status", "error", "sent_at"])
            yield out.astype({"sent_at": "datetime64[ns]"})

    return rows.mapInPandas(each, OUTCOME)


def delivered(rows: DataFrame, send: Send | None, path: str, batch: str, key: str = "id") -> DataFrame:
    """Send the rows that were never sent, and return (id, status, error, sent_at) of this batch.

    Outcomes are kept in a log: what was sent isn't sent again by any batch, what failed is tried again by the next, and a batch
    that is repeated sends nothing. Without a sender rows count as sent. A task that is run again sends its rows again, as Spark
    can't tell how far the first run came; a sender should pass the id on, so that its service can drop repeats.
    """
    spark = rows.sparkSession
    if commits.committed(spark, path, batch) is None:
        log = commits.read(spark, path, OUTCOME)
        waiting = rows.join(log.filter("status = 'sent'").select(F.col("id").alias("_sent_id")), F.col(key).cast("string") == F.col("_sent_id"), "left_anti").dropDuplicates([key])
        nothing = waiting.select(F.col(key).cast("string").alias("id"), F.lit("sent").alias("status"), F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("sent_at"))
        commits.append(nothing if send is None else attempted(waiting, send, key), path, batch)
    attempt = commits.committed(spark, path, batch)
    return spark.read.schema(OUTCOME).parquet(f"{path}/attempt={attempt}")


def delivery_state(spark: SparkSession, path: str) -> DataFrame:
    """(id, status, error, sent_at, attempts) of every row that was ever handed over: sent if any attempt was."""
    log = commits.read(spark, path, OUTCOME)
    return log.groupBy("id").agg(F.max("status").alias("status"), F.min("error").alias("error"), F.min("sent_at").alias("sent_at"), F.count("*").alias("attempts")).withColumn("error", F.when(F.col("status") == "failed", F.col("error")))


#: Parsers of sources by name: functions from pages (url, html) to snapshot items.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def parser(name: str) -> Callable:
    """Register a parser under the name of its source."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        PARSERS[name] = f
        return f

    return add


def parsed(pages: DataFrame, source: str) -> DataFrame:
    if source not in PARSERS:
        raise ValueError(f"no parser for {source}; known: {', '.join(sorted(PARSERS)) or 'none'}")
    return PARSERS[source](pages)


def scenario(spark: SparkSession, n: int, competitors: list[str], regions_: list[str]) -> DataFrame:
    """``n`` made snapshots with everything a run must stand: tags, entities, three forms of dates, regions in either case, empty
    snapshots, missing titles, repeated items, and errors. The same for the same arguments."""
    i = F.col("id")
    pick = lambda xs, step: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(i / step) % len(xs) + 1).cast("int"))
    day = F.date_add(F.lit("2026-06-01").cast("date"), (i % 28).cast("int"))
    published = F.when(i % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(i % 3 == 1, F.date_format(day, "dd.MM.yyyy")).otherwise(F.concat(F.dayofmonth(day).cast("string"), F.lit(" июня 2026")))
    region = F.when(i % 2 == 0, F.upper(pick(regions_, 1))).otherwise(pick(regions_, 1))
    title = F.when(i % 11 == 0, "").when(i % 4 == 0, F.concat(F.lit("<b>Событие</b> &laquo;"), (i % 50).cast("string"), F.lit("&raquo;"))).otherwise(F.concat(F.lit("Событие «"), (i % 50).cast("string"), F.lit("»")))
    item = F.struct(
        F.concat(F.lit("https://www.news"), (i % 5).cast("string"), F.lit(".ru/a/"), i.cast("string")).alias("url"), title.alias("title"), F.concat(F.lit("Текст&nbsp;"), i.cast("string")).alias("text"),
        published.alias("published_at"), region.alias("region"), F.lit("Новости").alias("media_name"), F.create_map().cast("map<string,string>").alias("extra"),
    )
    empty = i % 9 == 0
    meta = F.struct(
        (i % 7).alias("search_task_id"), F.lit("news").alias("source"), pick(competitors, 3).alias("competitor"), F.concat(F.lit("t"), (i % 2).cast("string")).alias("trigger"), F.lit(None).cast("string").alias("source_request_url"),
        F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"), F.when(empty, 0).otherwise(1).alias("items_count"), F.when(empty, "no_extractable_items").alias("empty_reason"), F.when(i % 13 == 0, "error").otherwise("new").alias("status"),
    )
    items = F.when(empty, F.array().cast("array<struct<url: string, title: string, text: string, published_at: string, region: string, media_name: string, extra: map<string, string>>>")).otherwise(F.array(item))
    return spark.range(n).select(F.concat(F.lit("raw_"), i.cast("string")).alias("raw_id"), meta.alias("meta"), items.alias("items"))
