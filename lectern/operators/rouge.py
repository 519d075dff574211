"""Overlap scores of a candidate text against a reference: n-grams and longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lectern.functions.text import bind, overlap_tokens
from lectern.operators.ranking import dealt

TRIPLE = "struct<precision:double,recall:double,f1:double>"
METRICS = ("rouge1", "rouge2", "rougeL")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a space, which no token holds; none if n is under 1 or over the number of tokens."""
    if n < 1:
        return F.array().cast("array<string>")
    if n == 1:
        return tokens
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))
    return bind(tokens, lambda t: F.when(F.size(t) >= n, runs(t)).otherwise(F.array().cast("array<string>")))


def triple(overlap: Column, candidate: Column, reference: Column) -> Column:
    """Precision, recall and F1 (from unrounded values), 6 decimals; zeros where a side has nothing."""
    p, r = F.try_divide(overlap, candidate), F.try_divide(overlap, reference)
    f = F.try_divide(2 * p * r, p + r)
    some = (candidate > 0) & (reference > 0)
    value = lambda x: F.when(some, F.round(F.coalesce(x, F.lit(0.0)), 6)).otherwise(0.0)
    return F.struct(value(p).alias("precision"), value(r).alias("recall"), value(f).alias("f1"))


def rouge_n(pairs: DataFrame, n: int, key: str, candidate: str, reference: str, tokens=overlap_tokens) -> DataFrame:
    """key, precision, recall, f1 of each pair, as a relation: counts of both sides' grams in one aggregate, clipped to the smaller."""
    both = F.array(F.struct(F.lit(1).alias("side"), ngrams(tokens(F.col(candidate)), n).alias("g")), F.struct(F.lit(0).alias("side"), ngrams(tokens(F.col(reference)), n).alias("g")))
    grams = dealt(pairs, key).select(key, F.explode(both).alias("b")).select(key, "b.side", F.explode_outer("b.g").alias("g"))
    counts = grams.groupBy(key, "g").agg(F.sum(F.when(F.col("g").isNotNull(), F.col("side")).otherwise(0)).alias("c"), F.sum(F.when(F.col("g").isNotNull(), 1 - F.col("side")).otherwise(0)).alias("r"))
    sums = counts.groupBy(key).agg(F.sum(F.least("c", "r")).alias("o"), F.sum("c").alias("c"), F.sum("r").alias("r"))
    return sums.select(key, triple(F.col("o"), F.col("c"), F.col("r")).alias("t")).select(key, "t.*")


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, by one row of the table per item of a."""
    start = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            here = F.when(F.get(b, j) == x, F.get(above, j) + 1).otherwise(F.greatest(F.get(above, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(here))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array(F.lit(0)), cell)

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(F.aggregate(a, start, row), -1)).otherwise(0)


@F.pandas_udf(IntegerType())
def lcs_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same over Arrow batches, with one set of bits as the row, for long texts."""

    def length(x, y) -> int:
        at: dict[str, int] = {}
        for k, w in enumerate(y):
            at[w] = at.get(w, 0) | 1 << k
        full = (1 << len(y)) - 1
        row = full
        for w in x:
            hits = row & at.get(w, 0)
            row = (row + hits | row - hits) & full
        return len(y) - row.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b, strict=True)])


def _overlap(a: Column, b: Column) -> Column:
    """Clipped overlap of two arrays, without leaving the row: how often each distinct item is in both."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda p: F.aggregate(F.array_distinct(p["a"]), F.lit(0), lambda acc, x: acc + F.least(times(p["a"], x), times(p["b"], x))))


def score_pair(candidate: Column, reference: Column, tokens=overlap_tokens) -> Column:
    """rouge1, rouge2, rougeL of two texts, row-local, for short texts and streams."""
    c, r = tokens(candidate), tokens(reference)
    size = lambda x, n: F.greatest(F.lit(0), F.size(x) - (n - 1))
    grams = lambda p, n: triple(_overlap(ngrams(p["c"], n), ngrams(p["r"], n)), size(p["c"], n), size(p["r"], n))
    both = bind(F.struct(c.alias("c"), r.alias("r")), lambda p: F.struct(grams(p, 1).alias("rouge1"), grams(p, 2).alias("rouge2")))
    return F.struct(both["rouge1"].alias("rouge1"), both["rouge2"].alias("rouge2"), triple(lcs_batch(c, r), F.size(c), F.size(r)).alias("rougeL"))
