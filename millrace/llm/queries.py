"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, conversation_repair, image_copies, line_crf, line_templates, ngram_join, packing, quality_rules, sample_media, sharding, spelling_variants, suffix_tree, token_files, url_cascade
from millrace.llm.common import documents, importable, scratch_path

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), VOCABULARY, 1024).drop("ids", "curve_key")


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.coalesce("dropped_lines", F.array().cast("array<int>"))
    marked = line_templates.marked(documents(spark, sf_dir).select("doc_id", "text"))
    return marked.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_dropped"), F.array_join(gone.cast("array<string>"), ",").alias("dropped_lines"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    return token_files.read(token_files.write(documents(spark, sf_dir), path, VOCABULARY), path)


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_cascade.judge(pages, url_cascade.listing(spark, url_cascade.RULES)).select("page_id", "host", "path", "rule", "verdict")


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, rules).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir), RANKS), RANKS)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = sample_media.drawn(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return image_copies.copies(media, "vec_id", "image").withColumnRenamed("id", "vec_id")


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir).select("doc_id", "text"))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = line_crf.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.score(docs, model).select("doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= line_crf.GOOD).cast("int").alias("predicted"))


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: importable(f)
    for f in (
        op1_packing, op2_line_templates, op3_token_files, op4_url_cascade, op5_decision_list, op6_byte_bpe, op7_image_copies, op8_feistel_shards, op9_ngram_join, op10_line_crf, op11_suffix_tree, op12_spelling_variants, op13_conversation_repair,
    )
}

ORACLES: dict[str, str] = {"op4_url_cascade": url_cascade.ORACLE, "op2_line_templates": line_templates.ORACLE}
