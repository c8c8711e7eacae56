"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estuarine.llm import dialogues, htmltext, kmeanstree, linededup, lm, neardup, nndescent, packing, periodicruns, qualityrules, sentencepieces, suffixdedup, tokencounts
from estuarine.llm.common import tokenizer_path
from estuarine.llm.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return qualityrules.quality_rules(table(spark, sf_dir, "documents"), trusted)


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op4_language_model")
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return lm.score(table(spark, sf_dir, "documents"), held_out)


@query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query("op6_nn_descent")
def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = linededup.line_components(table(spark, sf_dir, "documents"))
    return marks.select(F.col("id").alias("doc_id"), F.col("pos").cast("long").alias("line_no"), F.col("name").alias("line_hash"), "component", "kept")


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op9_minhash")
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_suffix_array")
def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedupe(table(spark, sf_dir, "documents"))


@query("op11_nearest_vectors")
def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeanstree.nearest(table(spark, sf_dir, "embeddings"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = dialogues.damage(table(spark, sf_dir, "conversations"))
    return dialogues.repair(hurt, gone=hurt["gone"])


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodicruns.periodic_runs(table(spark, sf_dir, "documents"), plant=True)
