"""The corpus operators' queries over whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, classifier, fingerprints, line_dedup, mixing, ngram_join, quality, secrets, token_files, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query(quality.SQL)
def op1_quality_rules(spark, sf_dir):
    return quality.clean_lines(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "lost_words", "base_failed", "kept")


@_query()
def op2_token_files(spark, sf_dir):
    return token_files.write_tokens(_documents(spark, sf_dir)).documents()


@_query(ngram_join.SQL)
def op3_ngram_join(spark, sf_dir):
    return ngram_join.near_components(_documents(spark, sf_dir)).withColumnRenamed("_id", "doc_id")


@_query()
def op4_line_dedup(spark, sf_dir):
    """Each document with what its lines became: the numbers of removed lines and a SHA-256 of the text left."""
    out = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    gone = F.coalesce(F.size("removed_lines"), F.lit(0))
    return out.select("doc_id", gone.cast("long").alias("n_removed"), F.coalesce(F.array_join("removed_lines", ","), F.lit("")).alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@_query()
def op5_quality_classifier(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classifier.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query()
def op6_byte_bpe(spark, sf_dir):
    return bpe.digests(_documents(spark, sf_dir))


@_query()
def op7_secret_scan(spark, sf_dir):
    return secrets.secret_spans(_documents(spark, sf_dir))


@_query(mixing.SQL)
def op8_mix_sources(spark, sf_dir):
    return mixing.Mix(_documents(spark, sf_dir)).report().withColumnRenamed("_id", "doc_id")


@_query()
def op9_document_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


@_query(urls.SQL)
def op10_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
