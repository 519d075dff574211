"""Streams of articles: the row-local forms over readStream, and corpus figures per micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import annotate as A
from lectern.operators import summaries


def read_articles(spark: SparkSession, folder: str, ddl: str = schemas.RAW_ARTICLE, files_per_batch: int = 16) -> DataFrame:
    """A folder of JSON Lines that grows; the schema is declared, malformed lines are dropped."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).option("mode", "DROPMALFORMED").json(folder)


def annotate_stream(articles: DataFrame, annotator: A.Annotator | None = None) -> DataFrame:
    return A.annotate(articles, annotator)


def summarize_stream(annotated: DataFrame, method: str, k: int = 3, **options) -> DataFrame:
    """Row-local, so append mode takes it and no state is kept."""
    return summaries.summarize(annotated, method, k, **options)


def shared_folder(spark: SparkSession) -> str:
    return (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints").rstrip("/")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """All that is there now, then stop; run again, it goes on where it stopped."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def corpus_figures(stream: DataFrame, figures: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """One row of figures per micro-batch, keyed by its number, so that a batch that is run again replaces its row."""

    def write(batch: DataFrame, number: int) -> None:
        figures(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries_by_stream(spark: SparkSession, documents: str, method: str, k: int) -> DataFrame:
    """Summaries of a Parquet table of documents, made by a stream over its files and read back."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(documents).schema
    # A stream reads folders: a table that is one file is found by its name in its folder.
    parent, _, name = documents.rpartition("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    path = hadoop.fs.Path(documents)
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema)
    source = reader.option("pathGlobFilter", name).parquet(parent) if single else reader.parquet(documents)
    run = append_to(summarize_stream(A.from_text(source), method, k), f"{folder}/out", f"{folder}/state")
    run.awaitTermination()
    return spark.read.schema(schemas.SUMMARY).parquet(f"{folder}/out")
