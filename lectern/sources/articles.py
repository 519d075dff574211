"""Readers and writers of articles: JSON Lines, whole text files, keyed loads. Schemas are declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schemas
from lectern.functions.text import strip

#: Column with a row's place in its input: file, then line.
POSITION = "input_pos"
#: Bytes of a row group as Parquet writers make them.
ROW_GROUP = 128 << 20


def _all_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and their place in it.

    A text file's rows come in order within its splits, and splits in order of
    their offsets, which is what the id of a partition and row follows.
    """
    return spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias(POSITION))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return _all_lines(spark, path).where(F.regexp_replace("value", r"(?U)\s+", "") != "")


def line_number(spark: SparkSession, path: str, position) -> int:
    """A line's number in its file, from 1, blank lines counted."""
    place = F.col(POSITION)
    return _all_lines(spark, path).where((place["file"] == position["file"]) & (place["line"] <= position["line"])).count()


def _parsed(lines: DataFrame, ddl: str) -> tuple[DataFrame, list[str]]:
    schema = T._parse_datatype_string(ddl)
    names = schema.names
    broken = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    parsed = lines.withColumn("j", F.from_json("value", broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    bad = F.col("j").isNull() | F.col("j._broken").isNotNull()
    return parsed.select(POSITION, "value", bad.alias("bad"), *(F.col(f"j.`{c}`").alias(c) for c in names)), names


def read_strict(spark: SparkSession, path: str, ddl: str = schemas.RAW_ARTICLE) -> DataFrame:
    """Records of JSON Lines; a malformed line is an error that names file and line, and so is a file without records. Both are looked for at once, in one pass."""
    rows, names = _parsed(_lines(spark, path), ddl)
    found = rows.agg(F.count("*").alias("n"), F.min(F.when(F.col("bad"), F.col(POSITION))).alias("bad")).first()
    if not found.n:
        raise ValueError(f"no records in {path}")
    if found.bad:
        raise ValueError(f"malformed JSON on line {line_number(spark, path, found.bad)} of {found.bad.file}")
    return rows.select(*names, POSITION)


def read_lenient(spark: SparkSession, path: str, ddl: str = schemas.RAW_ARTICLE) -> tuple[DataFrame, DataFrame]:
    """Good records, and the malformed lines (value, place) for a report."""
    rows, names = _parsed(_lines(spark, path), ddl)
    return rows.where(~F.col("bad")).select(*names, POSITION), rows.where("bad").select("value", POSITION)


def read_failing(spark: SparkSession, path: str, ddl: str = schemas.ANNOTATED) -> DataFrame:
    """Records of JSON Lines in Spark's own reader; a malformed line fails the job."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """id (the file's name without its ending), article, highlights (null), one row per file."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"(?<=.)\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(stem.alias("id"), F.col("value").alias("article"), F.lit(None).cast("string").alias("highlights"))


def key_of(df: DataFrame) -> Column:
    """id, or article_id where id is missing or empty; null if neither is there."""
    parts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("id", "article_id") if c in df.columns]
    return F.coalesce(*parts)


def keyed_load(df: DataFrame, position: str = POSITION) -> DataFrame:
    """Rows with a key, one for each: the last one's values at the first one's place. An aggregate, so no key's rows meet in one sort."""
    others = [c for c in df.columns if c not in ("id", position)]
    last = F.max_by(F.struct(*others, F.col(position).alias("_pos")), position).alias("last")
    rows = df.withColumn("id", key_of(df)).where("id IS NOT NULL").groupBy("id").agg(last, F.min(position).alias(position))
    return rows.select("id", *(F.col(f"last.`{c}`").alias(c) for c in others), position)


def point_lookup(df: DataFrame, key: str) -> DataFrame:
    """The row of a key; an error if there is none."""
    found = df.where(key_of(df) == key).limit(1)
    if found.isEmpty():
        raise ValueError(f"no article with id {key!r}")
    return found


def first_records(df: DataFrame, n: int | None, position: str = POSITION) -> DataFrame:
    """The first n records by place; all of them if n is 0 or None."""
    return df.orderBy(position).limit(n) if n else df


def sample(df: DataFrame, n: int, seed: int = 42, shuffle: bool = False, position: str = POSITION) -> DataFrame:
    """The first n rows by place, or with shuffle n rows by a seeded hash of their ids: the same ones however the input is partitioned."""
    if n <= 0:
        raise ValueError("a sample has one row or more")
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n) if shuffle else first_records(df, n, position)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it is smaller than a row group for each, as a task reads whole row groups; a larger table stays as it is, unshuffled. Rows are the same either way."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(4 * cores) if size < cores * ROW_GROUP else df


def trimmed(df: DataFrame, columns: tuple[str, ...] = ("id", "article", "highlights")) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in columns})


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line in a folder, characters as they are, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(row: DataFrame, path: str) -> dict:
    """A one-row table as indented JSON, written by the driver."""
    import json

    (only,) = row.toJSON().take(1)
    report = json.loads(only)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False)
    return report


def markdown(title: str, report: dict) -> str:
    return "\n".join([f"# {title}", "", "| figure | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in report.items()), ""])
