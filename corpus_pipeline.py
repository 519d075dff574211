"""The corpus pipeline: quality, near-duplicates, contamination, personal data, tokens.

Each stage takes and returns documents (the last adds its tokens), is written as
Parquet and read back before the next. Of documents a stage needs doc_id and
text; other columns, whatever their names and values, come out as they went in.
Null texts count as empty, repeated rows as rows of their own, and an empty
table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, byte_cnn, decontaminate, pii, simhash
from lectern.llm.common import col, release, shared_folder, stored, table
from lectern.llm.queries import quality_net, tokenizer


def _carried(docs: DataFrame) -> dict[str, Column]:
    """The documents' columns by numbers, which no name that an operator adds can meet."""
    return {f"c{i}": col(c) for i, c in enumerate(docs.columns)}


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network doesn't reject (score of 0.3 or more). Empty texts and equal ones have one score each, so all of them go or stay."""
    return _back(byte_cnn.score(docs, quality_net(spark, sf_dir), keep=_carried(docs)).where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document of the smallest id, documents without an id last. Texts without words have one fingerprint; of rows with equal id and text one stays."""
    return simhash.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate; those without words never are."""
    return _back(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=_carried(docs)).where("NOT contaminated"), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the names of its kinds; n_chars, where there is one, follows a changed text. A null text stays null."""
    found, spans = pii.find(docs)
    out = found.withColumn("text", pii.mask(F.col("text"), col(spans)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(col(spans)) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.drop(spans)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's id, number of tokens, and digests of its tokens and of their decoding; a null or empty text has no tokens."""
    return bpe.encode(docs, *tokenizer(), keep={"doc_id": col("doc_id")}, values=False, offsets=False, digests=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("contamination", contamination), ("personal_data", personal_data), ("tokens", tokens)]

#: The network's decisions and the union of links are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back; a stage's table goes once the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stored(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
        if k:
            release(docs)
        docs = made
    return docs
