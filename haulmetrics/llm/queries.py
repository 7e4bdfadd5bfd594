"""One query per operator, over its whole table with production parameters, and SQL answers where SQL can give them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmetrics.llm import ann, byte_bpe, decontaminate, hard_negatives, html_extract, jaccard_join, line_dedup, mixing, pii, quality, suffix_dedup, token_alignment, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.copies(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_near_items")


def op6_proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report, proximity matches (`n_near_items`) too, which `op6_decontamination` leaves out as its SQL does."""
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines that are not blank, those removed, in how many stretches, and the SHA-256 of what is left."""
    cut = line_dedup.cut(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"),
                      F.col("n_runs").cast("long").alias("n_runs"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(_table(spark, sf_dir, "documents"), texts=False).drop("kept_text")
    return cut.withColumn("repeated", F.col("n_removed") > 0)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                          F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_jaccard_join, op3_toxicity, op4_quality, op5_mixing, op6_decontamination, op6_proximity_matches, op7_line_dedup, op8_nearest, op9_suffix_dedup, op10_pii, op11_byte_bpe,
                                  op12_token_alignment, op13_hard_negatives)}
