"""The listing API: which filters each layer offers, option lists, dimension writes, and checks before a write."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.rows import patched, upserted
from tidewire.plans.mart import filtered, page

# For each layer the columns that take a substring, a value, and an inclusive range.
FILTERS = {
    "action_items": (("task",), ("department_id", "status", "assigned_user_id", "showcase_event_id"), ("deadline",)),
    "raw_items": ((), ("status", "search_task_id"), ("created_at", "updated_at")),
    "normalized_items": (("title",), ("status", "reject_reason", "competitor_id", "region_id"), ("published_at",)),
    "categorized_events": ((), ("priority", "category_id", "department_id"), ("categorized_at",)),
    "alerts": ((), ("status", "channel_id", "user_id", "priority", "mode"), ("created_at", "sent_at")),
    "candidates": (("domain",), ("status", "competitor_id", "is_active"), ()),
    "users": (("full_name", "email"), ("department_id",), ()),
}
#: Rows of a page where none are asked for.
PAGE = 100


def listing(df: DataFrame, layer: str, asked: dict, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of a layer, newest ids first, under the filters that ``asked`` names.

    A range is asked for as ``<column>_from`` and ``<column>_to``; a value that is None filters nothing; a name that the layer
    doesn't offer is an error.
    """
    like, equal, ranges = FILTERS[layer]
    ends = {f"{c}_{end}": c for c in ranges for end in ("from", "to")}
    if unknown := set(asked) - {*like, *equal, *ends}:
        raise ValueError(f"{layer} has no filter {', '.join(sorted(unknown))}")
    df = filtered(df, {c: asked.get(c) for c in like}, {c: asked.get(c) for c in equal})
    for name, c in ends.items():
        side = "until" if name.endswith("_to") else "since"
        df = filtered(df, **{side: (c, asked.get(name))})
    return page(df, [F.desc("id")], limit, offset)


def action_listing(actions: DataFrame, mart: DataFrame, asked: dict, priority: str | None = None, **paging: int) -> DataFrame:
    """``listing`` of action items; a priority is that of the item's event in the mart, joined only when asked for."""
    if priority is not None:
        events = filtered(mart, equal={"priority": priority}).select(F.col("id").alias("showcase_event_id"))
        actions = actions.join(events, "showcase_event_id", "left_semi").select(*actions.columns)
    return listing(actions, "action_items", asked, **paging)


def dimension(df: DataFrame, field: str, text: str | None = None, equal: dict | None = None, active: bool | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of a dimension in the order of its ids: a substring of one field, equalities, and active rows or all."""
    df = filtered(df, {field: text}, {**(equal or {}), **({} if active is None else {"is_active": active})})
    return page(df, [F.asc("id")], limit, offset)


def among(df: DataFrame, column: str, values: Iterable | DataFrame) -> DataFrame:
    """Rows whose ``column`` is one of ``values``: a short list as it stands, a table of them by a semi join."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi").select(*df.columns)
    return df.filter(F.col(column).isin(list(values)))


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == value)


def used_options(actions: DataFrame, reference: str, dim: DataFrame, label: str) -> DataFrame:
    """(id, label) of the dimension rows that action items refer to, by the label's lower case, the label, the id."""
    used = actions.select(F.col(reference).alias("id")).filter("id is not null").distinct()
    return dim.select("id", F.col(label).alias("label")).join(used, "id", "left_semi").orderBy(F.lower("label"), "label", "id")


def in_domain_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """The values of a fixed domain that occur, in the domain's own order, with their place."""
    places = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
    return df.select(F.col(column).alias("value")).distinct().withColumn("place", places[F.col("value")]).filter("place is not null").orderBy("place")


def inserted(dim: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``dim`` with ``new`` rows, whose ids follow the largest one in the order of their own columns."""
    columns = [c for c in dim.columns if c != key]
    top = dim.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    from pyspark.sql import Window as W

    # New rows of a dimension are few: they are written by hand or read from a dictionary.
    numbered = new.withColumn("_n", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*columns))).crossJoin(F.broadcast(top))
    return dim.unionByName(numbered.select((F.col("_top") + F.col("_n")).cast(dim.schema[key].dataType).alias(key), *columns))


def soft_deleted(dim: DataFrame, ids: Iterable, key: str = "id") -> DataFrame:
    return dim.withColumn("is_active", F.when(F.col(key).isin(list(ids)), False).otherwise(F.col("is_active")))


def updated(dim: DataFrame, patch: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """A partial update: ``columns`` of the rows that ``patch`` names."""
    return patched(dim, patch, key, columns)


def replaced(dim: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return upserted(dim, new, [key])


def write_problems(actions: DataFrame, events: DataFrame, departments: DataFrame, users: DataFrame) -> DataFrame:
    """``actions`` with ``problem``: what a write of the row would violate, or null.

    The event and the department exist, and an assigned user exists and belongs to the row's department.
    """
    known = lambda dim, column, flag: dim.select(F.col("id").alias(column), F.lit(True).alias(flag))
    people = users.select(F.col("id").alias("assigned_user_id"), F.lit(True).alias("_user"), F.col("department_id").alias("_own"))
    out = actions.join(known(events, "showcase_event_id", "_event"), "showcase_event_id", "left")
    out = out.join(known(departments, "department_id", "_department"), "department_id", "left").join(people, "assigned_user_id", "left")
    problem = (
        F.when(F.col("_event").isNull(), "no such event")
        .when(F.col("department_id").isNotNull() & F.col("_department").isNull(), "no such department")
        .when(F.col("assigned_user_id").isNotNull() & F.col("_user").isNull(), "no such user")
        .when(F.col("assigned_user_id").isNotNull() & ~F.col("_own").eqNullSafe(F.col("department_id")), "user of another department")
    )
    return out.withColumn("problem", problem).select(*actions.columns, "problem")


def forbidden_fields(role: str, changed: Iterable[str], allowed: Iterable[str] = ("status", "assigned_user_id")) -> list[str]:
    """Fields of a change that a viewer may not edit; editors may edit all."""
    return sorted(set(changed) - set(allowed)) if role == "viewer" else []


def skip_reason(task: Column, source: Column, competitor: Column) -> Column:
    """Why a collection task is skipped: the first of task, source and competitor that isn't active, or null."""
    off = lambda flag: ~F.coalesce(flag, F.lit(False))
    return F.when(off(task), "task inactive").when(off(source), "source inactive").when(off(competitor), "competitor inactive")
