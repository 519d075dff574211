"""Comparison of summary methods over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import words
from lectern.operators.rouge import METRICS, score_pair

EPSILON = 1e-6


def evaluate(references: DataFrame, summaries: dict[str, DataFrame]) -> DataFrame:
    """id, reference, method, summary, word counts, metric, precision, recall, f1 for ids that all inputs have; an error if there are none.

    references has id and highlights, each of summaries id and summary; keyed_load makes ids unique.
    """
    joined = references.select("id", F.col("highlights").alias("reference"))
    for name, df in summaries.items():
        joined = joined.join(df.select("id", F.col("summary").alias(name)), "id")
    if joined.isEmpty():
        raise ValueError("no id is in all inputs")
    long = joined.unpivot(["id", "reference"], [*summaries], "method", "summary")
    scored = long.withColumn("s", score_pair(F.col("summary"), F.col("reference"))).withColumn("reference_word_count", F.size(words(F.col("reference")))).withColumn("word_count", F.size(words(F.col("summary"))))
    metric = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"s.{m}").alias("t")) for m in METRICS)))
    return scored.select("id", "reference", "reference_word_count", "method", "summary", "word_count", metric.alias("m")).select("id", "reference", "reference_word_count", "method", "summary", "word_count", "m.metric", "m.t.*")


def article_table(evaluated: DataFrame) -> DataFrame:
    """One row per article, a column for each method and metric."""
    cell = F.first(F.struct("precision", "recall", "f1"))
    names = F.concat_ws("_", "method", "metric")
    return evaluated.withColumn("cell", names).groupBy("id", "reference", "reference_word_count").pivot("cell").agg(cell)


def describe(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, median, sample deviation (0 for one row), smallest, largest; 6 decimals."""
    v = F.col(value)
    figures = {"mean": F.avg(v), "median": F.median(v), "std": F.coalesce(F.stddev_samp(v), F.lit(0.0)), "min": F.min(v).cast("double"), "max": F.max(v).cast("double")}
    return rows.groupBy(*group).agg(*(F.round(F.coalesce(x, F.lit(0.0)), 6).alias(k) for k, x in figures.items()))


def stats(evaluated: DataFrame) -> DataFrame:
    """method, metric, measure and the figures of describe."""
    long = evaluated.unpivot(["id", "method", "metric"], ["precision", "recall", "f1"], "measure", "value")
    return describe(long, ["method", "metric", "measure"], "value")


def verdicts(evaluated: DataFrame, value: str = "f1") -> DataFrame:
    """id, metric, winner: the one method within EPSILON of the best, or tie; absent methods are skipped."""
    best = F.max(value).over(Window.partitionBy("id", "metric"))
    near = evaluated.withColumn("near", F.abs(F.col(value) - best) < EPSILON).where("near")
    return near.groupBy("id", "metric").agg(F.when(F.count("*") == 1, F.first("method")).otherwise("tie").alias("winner"))


def winners(evaluated: DataFrame, methods: tuple[str, ...] = ("frequency", "tfidf", "textrank")) -> DataFrame:
    """metric, winner, articles: counts for every method and for ties, zeros included."""
    grid = evaluated.select("metric").distinct().select("metric", F.explode(F.array(*(F.lit(m) for m in (*methods, "tie")))).alias("winner"))
    counts = verdicts(evaluated).groupBy("metric", "winner").agg(F.count("*").alias("articles"))
    return grid.join(counts, ["metric", "winner"], "left").select("metric", "winner", F.coalesce("articles", F.lit(0)).alias("articles"))


def best_methods(evaluated: DataFrame, methods: tuple[str, ...] = ("frequency", "tfidf", "textrank")) -> DataFrame:
    """metric, method: the largest rounded mean F1; of equal ones the first named."""
    order = F.array_position(F.array(*(F.lit(m) for m in methods)), F.col("method"))
    means = describe(evaluated, ["method", "metric"], "f1")
    return means.groupBy("metric").agg(F.max_by("method", F.struct("mean", -order)).alias("method"))
