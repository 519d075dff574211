"""Substring deduplication by super-k-mers of words.

A window is WINDOW consecutive words. Its minimiser is the m-word run inside of
it with the smallest hash (the leftmost of equals), so equal windows have equal
minimisers, and consecutive windows that share one travel as one packed string, a
super-k-mer, to their minimiser's bucket. There the windows of the bucket's
strings are sorted and counted exactly.

Before any text travels, minimisers are counted by hash alone: a window whose
minimiser occurs nowhere else can't be repeated.

A bucket of very many different strings is split by a longer minimiser: the
windows with more words behind the first one take it with half of those words,
the others with half of the words before it. Each string so falls into two at
most, which still travel packed; equal parts become one, a part whose minimiser
is nowhere else is done, and after five splits a minimiser is a whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import col, durable, release, small_batches

#: Words of a window and of a minimiser.
WINDOW, MINIMISER = 35, 5
#: Distinct strings that a bucket sorts in one task; a larger bucket is split by longer minimisers.
BUCKET = 2000
#: Strings whose copies a task adds up before it passes them on.
COMBINE = 30_000
_NONE = np.iinfo(np.int64).min


def super_kmers(cut: list[list[bytes]], window: int = WINDOW, m: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, number of windows, minimiser's hash and its place in the super-k-mer, of each super-k-mer of some texts, given as words."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in cut], np.int64)
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in cut for w in words), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    n = len(ids)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none
    word = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)[ids]
    mixed = np.zeros(n - m + 1, np.uint64)
    for k in range(m):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + word[k : n - m + 1 + k]
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    order = np.argsort(mixed, kind="stable")  # of equal hashes, the leftmost comes first
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    width, have, low = window - m + 1, 1, rank
    while have < width:  # smallest rank of width runs, by doubling
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    owner = np.repeat(np.arange(len(cut)), sizes)
    starts = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    if not len(starts):
        return none, none, none, none, none
    low = low[starts]
    cuts = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (starts[1:] != starts[:-1] + 1) | (owner[starts[1:]] != owner[starts[:-1]])]))
    many = np.diff(np.concatenate([cuts, [len(starts)]]))
    at = starts[cuts]
    chosen = order[low[cuts]]
    return owner[at], at - first[owner[at]], many, mixed[chosen].view(np.int64), chosen - at


def _batch(names: dict[str, pa.DataType], values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, names.values(), strict=True)], names=[*names])


_PACKED = {"kind": pa.int32(), "row": pa.int64(), "hash": pa.int64(), "a": pa.int64(), "b": pa.int64(), "bucket": pa.int64(), "n": pa.int64(), "text": pa.binary(), "sha": pa.string(), "spot": pa.int32()}
_PACKED_DDL = "kind int, row bigint, hash bigint, a bigint, b bigint, bucket bigint, n bigint, text binary, sha string, spot int"


def _digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows with their minimisers that occur elsewhere (columns row, hash, text, found, busy: those that occur very often), rows of five kinds.

    0: a text that keeps all its words; 1: a text that may not; 2: one of its
    super-k-mers, by digest, with its first word; 3: a super-k-mer's string with
    its bucket, n copies of it seen here and its minimiser's place; 4: the same
    for a bucket that may be too large.
    """
    strings: dict[tuple[int, int], list] = {}

    def flush():
        if strings:
            a, b = zip(*strings, strict=True)
            kind, bucket, n, text, spot = zip(*strings.values(), strict=True)
            none = [None] * len(strings)
            yield _batch(_PACKED, [kind, none, none, a, b, bucket, n, text, none, spot])
            strings.clear()

    for b in batches:
        rows, hashes, texts, found, busy = (b.column(i).to_pylist() for i in range(5))
        cut = [t.split() for t in texts]
        maybe = [i for i, f in enumerate(found) if f]
        of, first, many, bucket, spot = super_kmers([cut[i] for i in maybe])
        out: list[list] = [[] for _ in _PACKED]

        def add(*values, out=out):
            for column, v in zip(out, values, strict=True):
                column.append(v)

        wanted, large, touched = [{*found[i]} for i in maybe], [{*busy[i]} for i in maybe], set()
        for k, start, n, mh, at in zip(of.tolist(), first.tolist(), many.tolist(), bucket.tolist(), spot.tolist(), strict=True):
            if mh not in wanted[k]:
                continue
            i = maybe[k]
            touched.add(i)
            words = cut[i]
            string = b" ".join(words[start : start + n + WINDOW - 1])
            key = _digest(string)
            add(2, rows[i], hashes[i], *key, start, n, None, None, None)
            if key in strings:
                strings[key][2] += 1
            else:
                strings[key] = [4 if mh in large[k] else 3, mh, 1, string, at]
        for i, words in enumerate(cut):
            if i in touched:
                add(1, rows[i], hashes[i], None, None, None, len(words), texts[i], None, None)
            else:
                add(0, rows[i], hashes[i], None, None, None, len(words), None, hashlib.sha256(b" ".join(words)).hexdigest(), None)
        yield _batch(_PACKED, out)
        if len(strings) > COMBINE:
            yield from flush()
    yield from flush()


def halves(words: list[bytes], spot: int, width: int) -> Iterator[tuple[int, list[bytes], int, int]]:
    """(first window, words, minimiser's place, its new width) of a string's two parts, for a string whose windows all hold the minimiser of width words at spot.

    Which part a window is in depends on its words before the minimiser alone,
    so equal windows are in equal parts, with equal minimisers.
    """
    free, last = WINDOW - width, len(words) - WINDOW
    behind = (free + 1) // 2  # windows with so many words behind the minimiser
    before = free - behind + 1  # the others have so many before it
    split = max(0, spot - free + behind)  # the first window of the former
    if split <= last:
        yield split, words[split:], spot - split, width + behind
    if split > 0:
        yield 0, words[: min(split - 1, last) + WINDOW], spot - before, width + before


_PARTS = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "bucket": pa.int64(), "n": pa.int64(), "text": pa.binary(), "spot": pa.int32(), "width": pa.int32(), "x": pa.int64(), "y": pa.int64()}
_PARTS_DDL = "kind int, a bigint, b bigint, bucket bigint, n bigint, text binary, spot int, width int, x bigint, y bigint"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From strings of large buckets (a, b, n, text, spot, width): their parts, equal ones of a task as one (kind 3), and of each string a, b the parts x, y with their first window n (kind 2)."""
    parts: dict[tuple[int, int], list] = {}

    def flush():
        if parts:
            a, b = zip(*parts, strict=True)
            bucket, n, text, spot, width = zip(*parts.values(), strict=True)
            none = [None] * len(parts)
            yield _batch(_PARTS, [[3] * len(parts), a, b, bucket, n, text, spot, width, none, none])
            parts.clear()

    for batch in batches:
        places = []
        for a, b, n, text, spot, width in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            for first, words, at, wide in halves(text.split(b" "), spot, width):
                own = b" ".join(words)
                key = _digest(b"%d %d " % (at, wide) + own)
                places.append((a, b, first, *key))
                if key in parts:
                    parts[key][1] += n
                else:
                    bucket = xxhash.xxh64_intdigest(b"%d " % wide + b" ".join(words[at : at + wide]))
                    parts[key] = [bucket - (1 << 64) if bucket >> 63 else bucket, n, own, at, wide]
        if places:
            a, b, first, x, y = zip(*places, strict=True)
            none = [None] * len(places)
            yield _batch(_PARTS, [[2] * len(places), a, b, none, first, none, none, none, x, y])
        if len(parts) > COMBINE:
            yield from flush()
    yield from flush()


def _count(strings: list[tuple[bytes, int]]) -> list[list[int]]:
    """For each (string, copies) of a bucket, its windows that occur more than once in all, as ranges: first and past-last in turn."""
    if len(strings) == 1:
        text, copies = strings[0]
        return [[0, text.count(b" ") + 2 - WINDOW] if copies > 1 else []]
    windows = []
    for k, (text, _) in enumerate(strings):
        ends = [0, *(np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1).tolist(), len(text) + 1]
        windows += [(text[i : j - 1], k, w) for w, (i, j) in enumerate(zip(ends, ends[WINDOW:], strict=False))]
    windows.sort()
    out: list[list[int]] = [[] for _ in strings]
    i = 0
    while i < len(windows):
        j = i + 1
        while j < len(windows) and windows[j][0] == windows[i][0]:
            j += 1
        if j - i > 1 or strings[windows[i][1]][1] > 1:
            for _, k, w in windows[i:j]:
                out[k].append(w)
        i = j
    return [_ranges(x) for x in out]


def _ranges(at: list[int]) -> list[int]:
    out: list[int] = []
    for w in sorted(at):
        if out and out[-1] == w:
            out[-1] = w + 1
        elif not out or out[-1] < w:
            out += [w, w + 1]
    return out


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From strings sorted by bucket and digest (bucket, a, b, n, text): ranges of repeated windows by digest."""
    names = {"a": pa.int64(), "b": pa.int64(), "ranges": pa.list_(pa.int32())}
    now, held = None, {}

    def close() -> list[tuple]:
        counted = _count([(text, n) for n, text in held.values()])
        return [(*key, r) for key, r in zip(held, counted, strict=True) if r]

    ready: list[tuple] = []
    for b in batches:
        for bucket, x, y, n, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if bucket != now:
                if held:
                    ready += close()
                now, held = bucket, {}
            if (x, y) in held:
                held[x, y] = (held[x, y][0] + n, text)
            else:
                held[x, y] = (n, text)
            if len(ready) >= 2048:
                yield _batch(names, [list(x) for x in zip(*ready, strict=True)])
                ready = []
    if held:
        ready += close()
    if ready:
        yield _batch(names, [list(x) for x in zip(*ready, strict=True)])


def _levels(strings: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """From strings of buckets that may be too large: strings of small buckets, places of parts in what was split, and the tables that hold both.

    A bucket's different strings are counted by digest alone. Those of a large
    bucket are split where they are, so no such bucket ever meets in one task.
    """
    small, places, held = [], [], []
    now = strings
    while True:
        sizes = now.groupBy("bucket", "a", "b").agg(F.sum("n").alias("n")).groupBy("bucket").agg(F.count("*").alias("strings"), F.sum("n").alias("n"))
        sizes = durable(sizes.where("n > 1"))  # a string alone repeats nothing: its windows have the minimiser at different places
        held.append(sizes)
        small.append(now.join(sizes.where(F.col("strings") <= BUCKET), "bucket", "left_semi").select("bucket", "a", "b", "n", "text"))
        large = sizes.where(F.col("strings") > BUCKET)
        if large.isEmpty():
            return small, places, held
        made = durable(now.join(large, "bucket", "left_semi").select("a", "b", "n", "text", "spot", "width").mapInArrow(_split, _PARTS_DDL))
        held.append(made)
        places.append(made.where("kind = 2").select("a", "b", F.col("n").cast("int").alias("first"), "x", "y").distinct())
        now = made.where("kind = 3").select("bucket", "a", "b", "n", "text", "spot", "width")


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = {"row": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary(), "kept_sha256": pa.string()}
    for b in batches:
        rows, texts, starts, ranges = (b.column(i).to_pylist() for i in range(4))
        out: list[list] = [[] for _ in names]
        for row, text, first, flat in zip(rows, texts, starts, ranges, strict=True):
            words = text.split()
            step = np.zeros(len(words) + 1, np.int64)
            for at, own in zip(first or (), flat or (), strict=True):
                for i, j in zip(own[::2], own[1::2], strict=True):
                    step[at + i] += 1
                    step[at + j + WINDOW - 1] -= 1
            gone = np.cumsum(step[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            for column, v in zip(out, (row, len(words), int(gone.sum()), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(v)
        yield _batch(names, out)


def drop_repeats(df: DataFrame, *, row: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """row, n_words, n_removed, kept_sha256 and, with texts, kept: the words that no repeated window covers, joined by one space.

    A window is repeated if its words, as they are, also start anywhere else in
    df, the same text included; all windows are judged on the input. One row for
    each row of df. Null and empty texts have no words, and texts under WINDOW
    words no windows. Rows are told apart by id and a 64-bit hash of their text,
    so equal rows and repeated or missing ids are all right. Other columns are
    ignored. row must be an integer column.

    Hot windows: copies of a string are added up in the task that cuts them, and
    the strings of a bucket with more than BUCKET different ones are split by
    longer minimisers where they are. Occurrences meet their counts in a join by
    digest (128 bits), which adaptive execution splits where it is skewed.
    """
    spark = df.sparkSession
    small_batches(spark)
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = F.coalesce(col(text).cast("binary"), F.lit(b""))
    docs = df.select(F.coalesce(col(row).cast("bigint"), F.lit(_NONE)).alias("row"), F.xxhash64(t).alias("hash"), t.alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, _, _, bucket, _ = super_kmers([x.split() for x in b.column(1).to_pylist()])
            if not len(of):
                continue
            order = np.lexsort((bucket, of))  # a text's windows in a loop of words have one minimiser hash at many places: one row with their number
            of, bucket = of[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])]))
            many = np.diff(np.concatenate([first, [len(of)]]))
            key = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), pa.array(key[of[first]], pa.int64()), pa.array(many, pa.int64())], names=["bucket", "key", "n"])

    key = F.xxhash64("row", "hash")
    light = durable(docs.select(key, "text").mapInArrow(cut, "bucket bigint, key bigint, n bigint"))
    # More candidates than needed are harmless here, so a 64-bit key is enough. A hot bucket is added up within
    # tasks first; the sums are a table, so that both sides of the join are plain exchanges, which can be split.
    often = durable(light.groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").select("bucket", (F.col("n") > BUCKET).alias("busy")))
    shared = light.select("bucket", "key").join(often, "bucket")
    found = shared.groupBy("key").agg(F.collect_set("bucket").alias("found"), F.collect_set(F.when(F.col("busy"), F.col("bucket"))).alias("busy"))
    asked = docs.withColumn("key", key).join(found, "key", "left").select("row", "hash", "text", "found", "busy")
    packed = durable(asked.mapInArrow(_pack, _PACKED_DDL))
    release(light, often)

    strings = packed.where("kind = 3").select("bucket", "a", "b", "n", "text")
    large = packed.where("kind = 4")
    split, held = [], []
    if not large.isEmpty():
        small, split, held = _levels(large.select("bucket", "a", "b", "n", "text", "spot", F.lit(MINIMISER).alias("width")))
        for more in small:
            strings = strings.union(more)
    dealt = strings.repartition(spread, "bucket").sortWithinPartitions("bucket", "a", "b")
    ranges = durable(dealt.mapInArrow(_buckets, "a bigint, b bigint, ranges array<int>"))
    deeper = None
    for parts in reversed(split):  # what a string's parts say, by its own first window
        own = ranges if deeper is None else ranges.union(deeper)
        shifted = parts.join(own.withColumnsRenamed({"a": "x", "b": "y"}), ["x", "y"]).select("a", "b", F.col("first").alias("by"), F.explode("ranges").alias("w"))
        deeper = durable(shifted.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.col("by") + F.col("w"))).alias("ranges")))
    if deeper is not None:
        ranges = ranges.union(deeper)
    release(*held)

    places = packed.where("kind = 2").select("row", "hash", "a", "b", F.col("bucket").cast("int").alias("first"))
    hits = places.join(ranges, ["a", "b"]).groupBy("row", "hash").agg(F.collect_list(F.struct("first", "ranges")).alias("hits"))
    open_ = packed.where("kind = 1").select("row", "hash", "text").join(hits, ["row", "hash"], "left").select("row", "text", "hits.first", "hits.ranges")
    done = open_.mapInArrow(_drop, "row bigint, n_words bigint, n_removed bigint, kept binary, kept_sha256 string")
    whole = packed.where("kind = 0").select("row", F.col("n").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), "sha")
    names = ["n_words", "n_removed", "kept_sha256"]
    if not texts:
        out = done.select("row", *names).union(whole)
    else:
        same = packed.where("kind = 0").select("row", "hash", "n", "sha").distinct().join(docs, ["row", "hash"])
        squeezed = F.array_join(F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
        out = done.select("row", *names, F.col("kept").cast("string").alias("kept")).union(same.select("row", "n", F.lit(0).cast("bigint"), "sha", squeezed))
    return out.withColumn("row", F.when(F.col("row") != _NONE, F.col("row")))
