"""A corpus pipeline of operators from the package's `llm` folder, one stage after the other."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upliftlens.llm import bpe, toxicity
from upliftlens.llm.common import Scratch, word_count
from upliftlens.llm.line_dedup import line_dedup
from upliftlens.llm.minhash import minhash_dedup
from upliftlens.llm.mixing import mix_sources

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_multi_50k.tiktoken"


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    net = toxicity.train(docs, labels)
    return _columns(toxicity.score(docs, net).filter(F.col("score") < 0.5))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go; a document of which nothing is left but white space goes with them."""
    cut = line_dedup(docs)
    return _columns(cut.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    gone = minhash_dedup(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return _columns(docs.join(gone, "doc_id", "left_anti"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document that is taken twice is two rows.

    Rows that agree in id, source and size share out what the mix takes of them, so it is taken to the word.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", "size").alias("key")
    taken = mix_sources(docs).groupBy(key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    rows = docs.withColumn("size", word_count(F.col("text"))).select("*", key).join(taken.filter("copies > 0"), "key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("text")))
    share = F.floor(F.col("copies") / F.col("rows")) + (nth <= F.col("copies") % F.col("rows")).cast("int")
    rows = rows.withColumn("share", share.cast("int")).filter("share > 0")
    return _columns(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("share")))))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash_dedup", without_near_copies),
    ("mix_sources", mixed),
    ("bpe", tokenized),
]

#: Learned scores, min-hashes and tokens: SQL has no form of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read back as the next one's input."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for step, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{step}_{name}")
    return docs
