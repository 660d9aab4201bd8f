"""Corpus pipeline: language ID, near-dedup, decontamination, source mixing, token output, each over the whole table.

Every stage takes (spark, docs, sf_dir), decides on all rows its predecessor kept, and returns the kept rows with
the columns of ``documents``; the last returns one row per written document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import new_path

#: Documents under this posterior of their best language are rejected, as are those without a letter.
MIN_SCORE = 0.5
SHINGLE_WORDS, SIMILARITY = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known; learns from the labelled ones among them."""
    from folioscope.llm.language_id import fit, predict

    found = predict(docs, fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    from folioscope.llm.minhash_dedup import near_dedup as dedup

    return dedup(docs, width=SHINGLE_WORDS, percent=SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of which less than a twentieth is benchmark text."""
    from folioscope.llm.decontaminate import decontaminate as remove

    return remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: repeats are rows, documents that are not taken go.

    A document without words has nothing that a budget of words could take; it is clean and stays once.
    """
    from folioscope.llm.mixing import mix

    quality = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 + F.coalesce("quality", F.lit(0))).alias("weight"))
    plan = mix(docs, quality=quality)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    plan = plan.groupBy(F.col("doc_id").alias("_doc_id")).agg(F.max(times).alias("_times")).where("_times > 0")
    taken = docs.join(plan, docs["doc_id"].eqNullSafe(F.col("_doc_id")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[docs[c] for c in docs.columns])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files in the shared folder and returns what reading them back gives."""
    from folioscope.llm.token_output import token_output as write

    return write(docs, new_path(spark, "pipeline-tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("token_output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The model of the first stage and the tokenizer are beyond SQL; tests/llm compare the operators with brute force and the stages with a small table.
ORACLE_SQL = None
