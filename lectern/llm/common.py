"""Shared plumbing of the training-data operators.

Row conventions that hold for every operator of this subpackage:

* a null text is read as the empty text, a null id is carried as null;
* columns an operator does not name are ignored, or passed through untouched
  where the operator says so; columns that it adds get a free name, so an input
  column of the same name never breaks it;
* repeated rows are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch. Texts may be megabytes long, so the default of 10,000 rows is too many.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
#: Rows of a partition of a gathered table, and its fewest partitions.
FILE_ROWS, FILES = 20_000, 16

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever the letter case."""
    return unused(df.columns, *names)


def unused(columns: list[str], *names: str) -> list[str]:
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    plain_unions(spark)


def plain_unions(spark: SparkSession) -> None:
    """In Spark 4.1 a union of plans dealt alike passes for dealt itself, which loses matches once partitions are coalesced at run time."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for as long as the block runs."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the session's spark.checkpoint.dir. Only a session of one machine may do without."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return "/tmp/checkpoints"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read back; the job's shuffle files go as soon as it is written."""
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def durable(df: DataFrame, *, rows_per_batch: int = BATCH_ROWS) -> DataFrame:
    """df as a table in the shared folder: computed once, and no loss of an executor undoes it."""
    with settings(df.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows_per_batch)):
        return stored(df, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}")


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df in fewer partitions, if rows (about as many as its work reads) don't need them all: a table of few rows isn't written in a file for each shuffle partition, and local file systems start a process for each file."""
    return df.coalesce(max(FILES, -(-rows // FILE_ROWS)))


def release(*tables: DataFrame) -> None:
    """Deletes tables of durable() that no later plan reads."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_text(df: DataFrame, text: Column, keep: dict[str, Column], fields: dict[str, str], start: Callable[[], Callable[[list[bytes]], dict[str, Any]]]) -> DataFrame:
    """Row-local pass over Arrow batches: keep's columns as they are, then fields computed from the text's UTF-8 bytes.

    A field whose name keep has already gets a free one, with underscores.
    start() runs once per task and returns the function of a batch: list of bytes -> {field: values}.
    Nothing is shuffled, and a lost task is simply run again.
    """
    small_batches(df.sparkSession)
    source = df.select(*(c.alias(f"k{i}") for i, c in enumerate(keep.values())), F.coalesce(text.cast("binary"), F.lit(b"")).alias("t"))
    names, n = [*keep, *unused([*keep], *fields)], len(keep)
    schema = T.StructType([T.StructField(k, f.dataType) for k, f in zip(keep, source.schema.fields[:n], strict=True)] + [T.StructField(k, T._parse_datatype_string(v)) for k, v in zip(names[n:], fields.values(), strict=True)])
    kinds = [(k, _ARROW[v]) for k, v in fields.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for b in batches:
            if not b.num_rows:
                continue
            work = work or start()
            made = work(b.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *(pa.array(made[k], kind) for k, kind in kinds)], names=names)

    return source.mapInArrow(run, schema)
