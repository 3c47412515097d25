"""The corpus pipeline: quality rules, line deduplication, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs. Operators
delete what they write on the way once its result stands; what a stage's own result still reads is deleted by ``run`` when that
result is written, and by nobody else, so stages may also follow each other without a write between them.

In every stage null and empty texts, repeated rows, ties and empty tables have the results that the stage's operator states: a
null or empty text fails the quality rules; texts that are equal, rows that are equal among them, are one group of near copies,
of which one row stays; what the mix takes of a text is never empty. Columns beside those of documents pass through up to the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import curriculum, line_runs, sentencepiece_agenda, simhash, weak_supervision
from tidewire.llm.queries import piece_model_bytes
from tidewire.llm.shared import forget, free_name, recorded, saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars again the characters of the text, where documents have that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose posterior quality is below one half, go."""
    featured, names = weak_supervision.features(docs)
    featured = saved(featured, "quality-features")  # once, as the vote patterns and the verdicts both read them
    rows = weak_supervision.judged(featured, names)
    return rows.filter(F.col(free_name(featured, "kept"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut from the texts; every document stays."""
    name = free_name(docs, "lines")
    rows = line_runs.without_later_copies(docs, name=name)
    return _measured(rows.select(*[(F.col(name)["kept"].alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.one_of_each(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in the order of training positions."""
    return _measured(curriculum.mixed(docs).select(*[F.col(f"`{c}`") for c in docs.columns]))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, with begin and end ids, in the order of the mix."""
    kept = docs.select(*[c for c in ("doc_id", "source", "text") if c in docs.columns])
    rows = sentencepiece_agenda.encode(kept, piece_model_bytes())
    return rows.withColumn("n_tokens", F.size("ids").cast("long")).drop("text", "decoded")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("mixing", mixing), ("sentencepiece", tokens)]

#: Fingerprints, their components and token ids can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with recorded(own := []):
            made = step(spark, docs, sf_dir)
        following = saved(made, name)
        for table in [*own, docs]:  # of docs, only what a stage before has written
            forget(table)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
