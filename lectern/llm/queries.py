"""One query per training-data operator, over whole tables, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, byte_cnn, decontaminate, html_text, licenses, pii, quality_rules, simhash, substrings, toxicity
from lectern.llm.common import col, table
from lectern.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of production: parameters of the operator."""
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("row", "doc_id")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, *tokenizer(), keep={"doc_id": col("doc_id")}, values=False, digests=True)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), keep={"doc_id": col("doc_id")})


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep={"page_id": col("page_id"), "url": col("url")})


def quality_net(spark: SparkSession, sf_dir: str) -> byte_cnn.ByteCnn:
    """Learned from labelled rows that are not held out."""
    seen = table(spark, sf_dir, "labels").where(~byte_cnn.held_out(col("doc_id"), 5, 0))
    return byte_cnn.train(table(spark, sf_dir, "documents"), seen)


@query
def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = {"doc_id": col("doc_id"), "held_out": byte_cnn.held_out(col("doc_id"), 5, 0)}
    return byte_cnn.score(table(spark, sf_dir, "documents"), quality_net(spark, sf_dir), keep=keep)


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = toxicity.train(docs, labels.where(~byte_cnn.held_out(col("doc_id"), 4, 2)))
    return toxicity.score(docs, grammar, keep={"doc_id": col("doc_id"), "held_out": byte_cnn.held_out(col("doc_id"), 4, 2)})


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, spans = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = col(spans)
    counts = [pii.count_of(found, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return df.select("doc_id", *counts, F.sha2(pii.listed(pii.of_base(found)), 256).alias("base_sha256"), pii.listed(found).alias("spans"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("row").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep={"doc_id": col("doc_id")})
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    hits = F.array_join(F.col("hits").cast("array<string>"), ",").alias("hits")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items, "contaminated", hits, "longest")


@query
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents"), texts=False).withColumnRenamed("row", "doc_id")
