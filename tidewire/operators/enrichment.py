"""The enrichment stage: injected models as DataFrame functions, the merge of their outputs, and what is stored of it.

A model is a function from a DataFrame to (id, value): a language-model client in production, a lookup table in tests. Each
step below feeds it the rows it is for, and fills in what the step gives where the model fails or leaves a row out. A client that
takes lists of rows becomes a model by ``batched``: it is called with a few rows at a time inside the tasks, and a batch on which
it keeps raising fails alone. A model that raises while its plan is built counts as failed for all rows; what Spark itself
raises, as on a column that doesn't exist, is the program's fault and is raised.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.urls import domain
from tidewire.functions.values import deadline
from tidewire.operators.rows import free_name, newest

Model = Callable[[DataFrame], DataFrame]
#: A client of a language model: from the rows of a batch to as many answers, None for a row that it leaves out.
Client = Callable[[list[dict]], list]
#: Rows of a batch, calls of a batch that raises, and seconds before the second call, which double from then on.
BATCH, CALLS, PAUSE = 16, 3, 0.5

# What stands where a model fails, leaves a row out, or gets a row without a field.
COMMENT_FAILED, ACTION_FAILED = "Ошибка генерации", "Требуется ручной анализ"
TASKS_FAILED, RESULT_FAILED, RESULT_MISSING = "Ошибка генерации задач", "Ошибка формирования ожидаемого результата", "Ошибка генерации"
CONTEXT = {"text": "Текст отсутствует", "category": "Неизвестная категория", "priority": "Не назначен", "deadline": "Не указан", "department": "Не назначен", "tone": "Не определена"}
# Fixed value: the task of an event whose action is empty begins with it.
TASK_PREFIX = "Отработать событие: "


def batched(client: Client, kind: str = "string", size: int = BATCH, calls: int = CALLS, pause: float = PAUSE) -> Model:
    """A model that calls ``client`` with ``size`` rows at a time, inside the tasks, and again when it raises.

    It gives (id, value, failed): a batch whose last call raises has ``failed`` in all its rows, as has one with too few answers; the
    other batches keep their answers. A row without an answer is left out. Tasks hold one of Spark's Arrow batches at a time, and give
    its answers as one: a frame for each call would cost more than a quick client does.
    """

    def ask(rows: list[dict]) -> list | None:
        for call in range(calls):
            if call:
                time.sleep(pause * 2 ** (call - 1))
            try:
                answers = client(rows)
            except Exception:  # noqa: BLE001  whatever a client raises, its batch is asked again and then given up
                continue
            if len(answers) == len(rows):
                return answers
        return None

    def model(rows: DataFrame) -> DataFrame:
        def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                every, made = part.astype(object).where(part.notna(), None).to_dict("records"), []
                for start in range(0, len(every), size):
                    some = every[start : start + size]
                    answers = ask(some)
                    values = [None] * len(some) if answers is None else answers
                    made += [(row["id"], v, answers is None) for row, v in zip(some, values) if answers is None or v is not None]
                yield pd.DataFrame(made, columns=["id", "value", "failed"]).astype({"id": part["id"].dtype, "failed": bool})

        return rows.mapInPandas(each, f"id {rows.schema['id'].dataType.simpleString()}, value {kind}, failed boolean")

    return model


def answered(rows: DataFrame, model: Model, name: str, failed: Column, missing: Column, asked: Column | None = None) -> DataFrame:
    """``rows`` with the model's value: ``missing`` where it leaves a row out, ``failed`` where it says so (or everywhere, if it
    raises while its plan is built), null where the row wasn't asked about."""
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    try:
        made = model(rows.filter(wanted))
    except PySparkException:
        raise
    except Exception:  # noqa: BLE001  a model's own failure, whatever it is, must not lose the batch
        return rows.withColumn(name, F.when(wanted, failed))
    value, known, bad = free_name(rows, name), free_name(rows, "answered"), free_name(rows, "failed")
    gave_up = F.coalesce("failed", F.lit(False)) if "failed" in made.columns else F.lit(False)
    out = rows.join(made.select("id", F.col("value").alias(value), F.lit(True).alias(known), gave_up.alias(bad)), "id", "left")
    return out.withColumn(name, F.when(wanted, F.when(F.col(bad), failed).when(F.col(known), F.col(value)).otherwise(missing))).drop(value, known, bad)


def not_categorized(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Valid items that have no event yet."""
    return silver.filter("status = 'ok'").join(gold.select(F.col("normalized_item_id").alias("id")), "id", "left_anti")


def categorized(rows: DataFrame, model: Model) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return answered(rows, model, "category", nothing, nothing)


def toned(rows: DataFrame, model: Model) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return answered(rows, model, "tonality", nothing, nothing)


def context(rows: DataFrame) -> DataFrame:
    """What a comment is asked about: every field of a row, with its stand-in where it is missing."""
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in ("text", "category") else F.col(c).cast("string")
    return rows.select("id", *[F.coalesce(blank(c), F.lit(v)).alias(c) for c, v in CONTEXT.items()])


def commented(rows: DataFrame, comment: Model, action: Model) -> DataFrame:
    """Comment and action of each row; low-priority rows (p4) get neither."""
    nothing = F.lit(None).cast("string")
    out = answered(rows, comment, "comment", F.lit(COMMENT_FAILED), nothing)
    out = answered(out, action, "action", F.lit(ACTION_FAILED), nothing)
    return without_low_priority(out, ["comment", "action"])


def without_low_priority(rows: DataFrame, columns: list[str]) -> DataFrame:
    keep = ~F.col("priority").eqNullSafe("p4")
    return rows.withColumns({c: F.when(keep, F.col(c)) for c in columns})


def tasked(rows: DataFrame, model: Model) -> DataFrame:
    """Tasks of the rows that have an action."""
    return answered(rows, model, "task", F.array(F.lit(TASKS_FAILED)), F.lit(None).cast("array<string>"), F.col("action").isNotNull())


def expected(rows: DataFrame, model: Model) -> DataFrame:
    """The expected result of the rows that have tasks."""
    return answered(rows, model, "expected_result", F.lit(RESULT_FAILED), F.lit(RESULT_MISSING), F.size("task") > 0)


def merged(parts: dict[str, DataFrame]) -> DataFrame:
    """One row for each id that any part has, with a column a part: parts are (id, value), and where an id is repeated its value
    with the greatest ``at`` counts, a column that a part may have; then the greatest value, so that no partitioning matters.

    Parts are stacked and grouped once, not joined one by one.
    """
    slots = [c for c in parts]
    kinds = {c: parts[c].schema["value"].dataType.simpleString() for c in slots}

    def slotted(name: str) -> DataFrame:
        own = F.when(F.col("value").isNotNull(), F.struct((F.col("at") if "at" in parts[name].columns else F.lit(0)).alias("at"), F.col("value")))
        return parts[name].select("id", *[(own if c == name else F.lit(None).cast(f"struct<at:{ats[c]},value:{kinds[c]}>")).alias(c) for c in slots])

    ats = {c: parts[c].schema["at"].dataType.simpleString() if "at" in parts[c].columns else "int" for c in slots}
    best = reduce(DataFrame.unionByName, map(slotted, slots)).groupBy("id").agg(*[F.max(c).alias(c) for c in slots])
    return best.select("id", *[F.col(f"`{c}`.value").alias(c) for c in slots])


def named_ids(rows: DataFrame, name: str, dim: DataFrame, out: str) -> DataFrame:
    """``out``: the id of the dimension row of that name, compared trimmed and in lower case; of equal names the last id."""
    ids = dim.filter("name is not null").groupBy(F.lower(F.btrim("name")).alias("_name")).agg(F.max("id").alias(out))
    return rows.withColumn("_name", F.lower(F.btrim(F.col(name)))).join(ids, "_name", "left").drop("_name")


def events(answers: DataFrame, silver: DataFrame, categories: DataFrame, departments: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events to store, rejected rows): a row without a category, tonality or priority would break the whole batch and is
    set aside with its reason. Deadlines count from the day on which the item was stored."""
    items = silver.select("id", "created_at", "competitor_id")
    out = answers.join(items, "id").join(media.select("competitor_id", "media_index"), "competitor_id", "left")
    out = named_ids(named_ids(out, "category", categories, "category_id"), "department", departments, "department_id")
    out = out.withColumn("deadline", deadline(F.col("created_at").cast("date"), F.col("priority")))
    problem = F.when(F.col("category_id").isNull(), "no category").when(F.col("tonality").isNull(), "no tonality").when(F.col("priority").isNull(), "no priority")
    out = out.withColumn("problem", problem).withColumnRenamed("id", "normalized_item_id").drop("created_at")
    return out.filter("problem is null").drop("problem"), out.filter("problem is not null")


def new_sources(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (competitor_id, url, score) with the domain of their URL, which isn't known yet; one row a competitor and domain:
    the one with the best score, then the first URL."""
    rows = found.withColumn("domain", domain(F.col("url"))).filter("domain is not null and url is not null")
    fresh = rows.join(known.select("domain").distinct(), "domain", "left_anti")
    return newest(fresh, ["competitor_id", "domain"], [F.col("score").desc_nulls_last(), F.asc("url")] if "score" in found.columns else [F.asc("url")])


def found_sources(competitors: DataFrame, finder: Client, known: DataFrame, size: int = BATCH) -> DataFrame:
    """New sources of competitors (id, name) from an injected finder, which answers each with a list of (url, score).

    The finder is called like any model, in batches; competitors whose batch fails find nothing in this run.
    """
    answers = batched(finder, "array<struct<url: string, score: double>>", size)(competitors).filter("not failed")
    return new_sources(answers.select(F.col("id").alias("competitor_id"), F.explode("value").alias("x")).select("competitor_id", "x.url", "x.score"), known)


def fallback_task(action: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(action), F.lit("")), F.concat(F.lit(TASK_PREFIX), F.coalesce(title, F.lit(""))))


def assistant_items(alerts: DataFrame, mart: DataFrame, users: DataFrame, stored: DataFrame) -> DataFrame:
    """Action items of events that were alerted and have none: the earliest alert's user, who must have a department, gets the
    event's action as a task, or the fallback."""
    first = alerts.groupBy("showcase_event_id").agg(F.min_by("user_id", "id").alias("user_id"))
    fresh = first.join(stored.select("showcase_event_id"), "showcase_event_id", "left_anti")
    people = users.filter("department_id is not null").select(F.col("id").alias("user_id"), "department_id")
    titled = mart.select(F.col("id").alias("showcase_event_id"), fallback_task(F.col("action"), F.col("title")).alias("task"), "deadline")
    return fresh.join(people, "user_id").join(titled, "showcase_event_id").select("showcase_event_id", "task", "department_id", F.col("user_id").alias("assigned_user_id"), "deadline", F.lit("new").alias("status"))


def by_chunks(chunks: DataFrame, model: Model, most: int = 6) -> DataFrame:
    """(doc, body, dropped): a text put together of a model's answers over its first ``most`` chunks; blank answers are dropped.

    The limit on chunks is the feature: it bounds what is sent to the model for one article.
    """
    asked = chunks.filter(F.col("idx") < most)
    found = answered(asked, model, "part", F.lit(None).cast("string"), F.lit(None).cast("string"))
    blank = F.btrim(F.coalesce("part", F.lit(""))) == ""
    parts = F.array_sort(F.collect_list(F.when(~blank, F.struct("idx", "part"))))
    return found.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("body"), F.count_if(blank).alias("dropped"))
