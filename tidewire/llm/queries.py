"""The registered queries of this package, one per operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import compression_quality, crf_language, curriculum, line_runs, oracles, packing, permutation_index, sentencepiece_agenda, simhash, spelling_variants, suffix_merge, url_rules, weak_supervision, window_alignment
from tidewire.llm.shared import forget, read, saved


def piece_model_bytes() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = permutation_index.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return rows.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.grouped(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_merge.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))


def held_out() -> Column:
    """Rows from which nothing is learned: those whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op4_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = crf_language.fit(docs.filter(~F.col("held_out")))
    return crf_language.labelled(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_runs.without_later_copies(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "lines.n_lines", "lines.n_removed", "lines.n_runs", F.sha2("lines.kept", 256).alias("kept_sha256"))


def op10_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(~held_out()).filter("label is not null")
    learn = compression_quality.labelled(docs.filter(~F.col("held_out")).drop("held_out"), labels)
    model = compression_quality.fit(learn)
    forget(learn)
    rows = compression_quality.scored(docs, model)
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured, names = weak_supervision.features(read(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = weak_supervision.judged(saved(featured.drop("text"), "quality-features"), names)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curriculum.digests(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_agenda.digests(docs, piece_model_bytes())


def byte_model_bytes() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_alignment.counted(read(spark, sf_dir, "documents").select("doc_id", "text"), byte_model_bytes(), piece_model_bytes())
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(read(spark, sf_dir, "documents").select("doc_id", "text"), byte_model_bytes())
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(read(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op1_permutation_index": op1_permutation_index, "op2_simhash": op2_simhash, "op3_suffix_merge": op3_suffix_merge, "op4_crf": op4_crf, "op5_line_runs": op5_line_runs, "op6_url_rules": op6_url_rules, "op7_weak_supervision": op7_weak_supervision, "op8_curriculum": op8_curriculum, "op9_sentencepiece": op9_sentencepiece, "op10_compression": op10_compression, "op11_alignment": op11_alignment, "op12_packing": op12_packing, "op13_spelling_variants": op13_spelling_variants}

ORACLE_SQL: dict[str, str] = {"op5_line_runs": oracles.LINES, "op6_url_rules": oracles.URLS, "op7_weak_supervision": oracles.quality_sql(), "op8_curriculum": oracles.MIX}
