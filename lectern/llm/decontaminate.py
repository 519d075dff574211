"""Benchmark decontamination by suffix arrays of the training text.

Training documents are taken a shard at a time. A shard's words become numbers
(0 for words that no test item has), and its suffixes are sorted. Every suffix
of every test item is then searched in that order by bisection, which gives all
its verbatim matches and their places; longest matches are followed from where
they begin. Suffixes whose first words no test suffix starts with cannot match
and are not sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import col, small_batches, unused

#: Words of a match, and words of a shard (some 30 MB with its suffixes).
WINDOW, SHARD = 13, 1_000_000
#: Bytes of benchmark text that a task holds at once; a larger benchmark is searched in blocks of about this size, one after the other.
BLOCK_BYTES = 8 << 20
#: Blocks that one pass over the documents searches (1 GB of benchmark), and so what is broadcast for it; shards are so many times larger where there are several blocks.
PASS_BLOCKS, LARGER = 128, 4
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters a-z (A-Z in lower case), digits and all that is not ASCII."""
    return text.translate(_WORDS).split()


def _keys(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n numbers from each place on, as byte strings in the numbers' order."""
    return np.ascontiguousarray(ids[at[:, None] + np.arange(n)].astype(">u4")).view(f"S{4 * n}").ravel()


class TestSet:
    """The suffixes of a block of test items, by number of words searched: WINDOW, or the whole of a shorter item."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.numbers: dict[bytes, int] = {}
        self.items = [name for name, _ in items]
        text, starts, owners, sizes = [0], [], [], []
        for k, (_, t) in enumerate(items):
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(t)]
            n = min(WINDOW, len(own))
            for i in range(len(own) - n + 1 if own else 0):
                starts.append(len(text) + i)
                owners.append(k)
                sizes.append(n)
            text += [*own, 0]
        self.text = np.array(text + [0] * WINDOW, np.int64)
        self.base = len(self.numbers) + 1
        starts, owners, sizes = (np.array(x, np.int64) for x in (starts, owners, sizes))
        self.groups = []
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            keys = _keys(self.text, starts[own], n)
            distinct, inverse = np.unique(keys, return_inverse=True)
            order = np.argsort(inverse, kind="stable")  # suffixes by distinct key
            bounds = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(distinct)))])
            heads = np.unique(self._heads(self.text, starts[own], min(3, n)))
            self.groups.append((n, distinct, bounds, starts[own][order], owners[own][order], heads))

    def _heads(self, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The first n (at most 3) numbers as one; a block's words are far fewer than 2^21."""
        out = ids[at]
        for k in range(1, n):
            out = out * self.base + ids[at + k]
        return out

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(words matched, places in ids, test suffixes' places, their items) of every verbatim match in a shard of numbers."""
        known = np.flatnonzero(ids[: len(ids) - WINDOW] > 0)
        for n, keys, bounds, starts, owners, heads in self.groups:
            at = known
            for k in range(1, min(3, n)):
                at = at[ids[at + k] > 0]
            head = self._heads(ids, at, min(3, n))
            spot = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
            at = at[heads[spot] == head]
            if not len(at):
                continue
            suffixes = _keys(ids, at, n)
            order = np.argsort(suffixes, kind="stable")  # the shard's suffix array, of the suffixes that can match
            suffixes, at = suffixes[order], at[order]
            low, high = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
            for k in np.flatnonzero(high > low).tolist():
                yield n, at[low[k] : high[k]], starts[bounds[k] : bounds[k + 1]], owners[bounds[k] : bounds[k + 1]]


def scan(tests: TestSet, texts: list[bytes]) -> list[tuple[int, np.ndarray, list[str], int]]:
    """For each text of a shard: words, hit ranges (first and past-last word in turn), items with a match, words of the longest match."""
    cut = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in cut], np.int64)
    first = np.cumsum(sizes + 1) - sizes  # a 0 before each text, so that nothing matches across
    ids = np.zeros(int(sizes.sum()) + len(cut) + 2 * WINDOW, np.int64)
    for w, i in zip(cut, first.tolist(), strict=True):
        ids[i : i + len(w)] = np.fromiter(map(tests.numbers.get, w, repeat(0)), np.int64, len(w))
    step, found, longest = np.zeros(len(ids) + 1, np.int64), [set() for _ in texts], np.zeros(len(texts), np.int64)
    for n, places, starts, owners in tests.search(ids):
        np.add.at(step, places, 1)
        np.add.at(step, places + n, -1)
        rows = np.searchsorted(first, places, "right") - 1
        items = {tests.items[k] for k in owners.tolist()}
        for r in np.unique(rows).tolist():
            found[r] |= items
        longest[rows] = np.maximum(longest[rows], n)
        if n == WINDOW:
            for q in starts.tolist():  # from where a match begins, as far as it goes
                p, r = places[ids[places - 1] != tests.text[q - 1]] if tests.text[q - 1] else places, n
                while len(p):
                    np.maximum.at(longest, np.searchsorted(first, p, "right") - 1, r)
                    p = p[(ids[p + r] == tests.text[q + r]) & (tests.text[q + r] > 0)] if q + r < len(tests.text) else p[:0]
                    r += 1
    hit = np.cumsum(step) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    of = np.searchsorted(first, edges[::2], "right") - 1
    out = []
    for r in range(len(texts)):
        own = slice(2 * int(np.searchsorted(of, r)), 2 * int(np.searchsorted(of, r, "right")))
        out.append((int(sizes[r]), edges[own] - first[r], sorted(found[r]), int(longest[r])))
    return out


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for i, j in sorted(zip([*a[::2], *b[::2]], [*a[1::2], *b[1::2]], strict=True)):
        if out and i <= out[-1]:
            out[-1] = max(out[-1], j)
        else:
            out += [i, j]
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about block_bytes, one block at a time on the driver."""
    rows = benchmark.select(F.coalesce(col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(col(text).cast("binary"), F.lit(b"")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield sorted((r.i, bytes(r.t)) for r in part.collect())


def _value(block) -> list[tuple[str, bytes]]:
    """A broadcast block, which the worker doesn't keep: the next one takes its place."""
    value = block.value
    if getattr(block, "_path", None):
        block.__dict__.pop("_value", None)
    return value


def _pass(n: int, blocks: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what blocks hit to batches of n columns to keep, a text and what was hit so far."""
    only, held, size = None, [], 0

    def flush():
        nonlocal only
        texts = [t for b in held for t in b.column(n).to_pylist()]
        hits, items, longest = ([x for b in held for x in b.column(n + k).to_pylist()] for k in (2, 3, 4))
        for block in blocks:
            tests = only or TestSet(_value(block))
            only = tests if len(blocks) == 1 else None
            found = scan(tests, texts)
            for i, (_, new, own, far) in enumerate(found):
                if len(new):
                    hits[i], items[i], longest[i] = _merged(hits[i], new.tolist()), sorted({*items[i], *own}), max(longest[i], far)
        at = 0
        for b in held:
            own = slice(at, at := at + b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n + 1)), pa.array([x[0] for x in found[own]], pa.int64()), pa.array(hits[own], pa.list_(pa.int32())), pa.array(items[own], pa.list_(pa.string())), pa.array(longest[own], pa.int64())], names=b.schema.names)

    for b in batches:
        held.append(b)
        size += b.column(n).nbytes // 6
        if size >= SHARD * (LARGER if len(blocks) > 1 else 1):
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def contamination(df: DataFrame, benchmark: DataFrame, *, keep: dict[str, Column], text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of df: keep's columns, n_words, n_hit, hits (array of first and past-last word in turn), items (sorted), longest and contaminated.

    A row is contaminated if a twentieth of its words or more are hit. Null and
    empty texts have no words; items without words match nothing; an item
    without an id goes by the empty string; repeated items count once. An empty
    benchmark hits nothing. Nothing is shuffled: a task holds a shard of its rows
    and one block of the benchmark at a time. A benchmark of more than
    PASS_BLOCKS blocks takes a further pass for each so many.
    """
    small_batches(df.sparkSession)
    sc, names = df.sparkSession.sparkContext, [*keep]
    out = df.select(*(c.alias(f"k{i}") for i, c in enumerate(keep.values())), F.coalesce(col(text).cast("binary"), F.lit(b"")).alias("t"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("longest"))
    n = len(names)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])
    every = _blocks(benchmark, item, item_text, block_bytes)
    while blocks := [sc.broadcast(b) for b in islice(every, PASS_BLOCKS)]:
        out = out.mapInArrow(partial(_pass, n, blocks), schema)
    hits = F.col("hits")
    ranges = F.when(F.size(hits) > 0, F.transform(F.sequence(F.lit(0), F.size(hits) - 2, F.lit(2)), lambda i: F.get(hits, i + 1) - F.get(hits, i))).otherwise(F.array().cast("array<int>"))
    n_hit = F.aggregate(ranges, F.lit(0).cast("bigint"), lambda a, b: a + b)
    added = unused(names, "n_words", "n_hit", "hits", "items", "longest", "contaminated")
    values = [F.col("n_words"), n_hit, hits, F.col("items"), F.col("longest"), (n_hit > 0) & (20 * n_hit >= F.col("n_words"))]
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(names)), *(v.alias(k) for k, v in zip(added, values, strict=True)))
