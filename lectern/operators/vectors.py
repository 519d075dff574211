"""Nearest vectors by cosine, exactly: a grid of blocks of queries and blocks of rows."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows of a block, on average: what a task holds. Cosines are made for that many queries at a time.
QUERIES, ROWS, AT_ONCE = 1024, 16384, 64


def _unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of length 1, by id."""
    v = t.column("v").combine_chunks()
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    ids = t.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], (x / np.sqrt((x * x).sum(1))[:, None])[order]


def nearest(vectors: DataFrame, asked: Column, k: int, *, row: str = "vec_id", vector: str = "embedding", queries: int = QUERIES, rows: int = ROWS) -> DataFrame:
    """row, other, cosine (4 decimals), rank: the k rows of largest cosine for each row that is asked for, smaller ids first among equals.

    Ids are whole numbers and vectors have one length. A row never meets its own
    id; rows whose id or vector is null, or whose vector is zero, take no part.
    Each block of queries meets each block of rows in one task, which passes on
    k rows for each query; there are as many blocks as the rows ask for, so no
    task grows with them.
    """
    held = vectors.select(F.col(row).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    held = held.where(F.col("id").isNotNull() & F.exists("v", lambda x: x != 0))
    n, m = vectors.agg(F.count("*"), F.count_if(asked)).first()
    across, down = max(1, ceil(m / queries)), max(1, ceil(n / rows))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    left = held.where("asked").select("id", "v", own(across).alias("a"), each(down).alias("b"))
    right = held.select("id", "v", each(across).alias("a"), own(down).alias("b"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            (ids, x), (others, y) = _unit(left), _unit(right)
            for i in range(0, len(ids), AT_ONCE):
                cosines = np.floor(x[i : i + AT_ONCE] @ y.T * 1e4 + 0.5) / 1e4
                for own_id, c in zip(ids[i : i + AT_ONCE], cosines, strict=True):
                    at = np.flatnonzero(others != own_id)
                    if len(at) > k:
                        at = at[c[at] >= np.partition(c[at], -k)[-k]]
                    at = at[np.argsort(-c[at], kind="stable")][:k]
                    found += zip([int(own_id)] * len(at), others[at].tolist(), c[at].tolist(), strict=True)
        return pa.table({name: pa.array([f[j] for f in found], kind) for j, (name, kind) in enumerate((("id", pa.int64()), ("other", pa.int64()), ("cosine", pa.float64())))})

    best = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(work, "id bigint, other bigint, cosine double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other")))
    return ranked.where(F.col("rank") <= k).select(F.col("id").alias(row), "other", "cosine", "rank")
