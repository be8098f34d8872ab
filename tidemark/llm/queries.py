"""The operators as queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, fingerprints, infill, langid, mixing, near_dedup, packing, pii, quality, sharding, sql, training_order, url_filter, vector_codes
from .common import durable, table


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.revisions(table(spark, sf_dir, "documents"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the training shards in order, with a digest of each record's ids."""
    ordered = training_order.training_order(table(spark, sf_dir, "documents"))
    return ordered.select("slot", "shard", "record", "doc_id", "part", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs)
    return langid.identify(docs.select("doc_id", "text"), profiles).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Words are counted once: their numbers are a small table.
    sizes = durable(mixing.sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size"), "sizes")
    mixed = mixing.mix(sizes, size="size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), shingle=2)


def op11_fim_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.rearranged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "infill.*")
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", F.col("prefix").alias("prefix_chars"), F.col("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    found = quality.scored(docs.select("doc_id", "text"), model, to="score")
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_merkle_fingerprints,
            op2_training_order,
            op3_url_filter,
            op4_bin_completion,
            op5_multiprobe_ann,
            op6_language_id,
            op7_source_mixing,
            op8_pii,
            op9_bounded_ring,
            op10_lsh_forest,
            op11_fim_scan,
            op12_exponion_codes,
            op13_quality,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": sql.OP3, "op7_source_mixing": sql.OP7, "op10_lsh_forest": sql.OP10}
