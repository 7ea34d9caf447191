"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upliftlens.llm import bpe, language, license_scan, pii, toxicity
from upliftlens.llm.centroids import cluster_vectors
from upliftlens.llm.exact_dedup import exact_dedup
from upliftlens.llm.line_dedup import line_dedup
from upliftlens.llm.minhash import minhash_dedup
from upliftlens.llm.mixing import mix_sources
from upliftlens.llm.neighbours import near_vectors
from upliftlens.llm.quality import quality_rules
from upliftlens.llm.search import lexical_search

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, pii.KINDS),
        F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def document_path() -> Column:
    """Documents as files: /source/thousand/hundred/id.txt; one that opens with a licence line is /source/thousand/LICENSE.id."""
    source, folder = F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string")
    opening = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    licence = F.concat_ws("/", F.lit(""), source, folder, F.concat(F.lit("LICENSE."), F.col("doc_id")))
    plain = F.concat_ws(
        "/", F.lit(""), source, folder, F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id"), F.lit(".txt"))
    )
    return F.when(opening.rlike(license_scan.LICENCE_WORDS), licence).otherwise(plain)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(document_path().alias("path"), "text")
    found = license_scan.license_scan(files)
    doc_id = F.regexp_extract("path", r"([0-9]+)(?:\.txt)?$", 1).cast("long")
    return found.select(doc_id.alias("doc_id"), *found.columns)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), best=20)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return quality_rules(table(spark, sf_dir, "documents"), trusted, min_words=50, max_repeat=50)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_find_pii,
        op2_minhash_dedup,
        op3_byte_bpe,
        op4_toxicity,
        op5_line_dedup,
        op6_mix_sources,
        op7_near_vectors,
        op8_license_scan,
        op9_language,
        op10_exact_dedup,
        op11_lexical_search,
        op12_centroids,
        op13_quality_rules,
    )
}
