"""Near-duplicates by SimHash fingerprints.

Links are searched between distinct fingerprints only. Each is embedded as the
numbers of set bits of its 32 two-bit segments: two fingerprints' Manhattan
distance there never exceeds the number of their differing bits. That space is
searched by a range join over a grid: points within distance 3 are within
distance 1 in one half of the segments, so a point is at home in its cell of
each half's grid, and probes the cells one step up along each segment (of two
points a step apart, the lower one probes the other's cell). Within a cell, the
Manhattan distance is the cheap bound and the differing bits the exact check.
Crowded cells are dealt on by the other half.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import col, durable, free, gathered, map_text, plain_unions, release

#: Most differing bits of a link, words of a shingle and seed of its hash.
BITS, SHINGLE, SEED = 3, 3, 42
#: Segments of a half. A cell of more than CELL points is dealt again by choices of BLOCKS blocks of the segments that weren't looked at yet, so many times in all.
HALF, BLOCKS, CELL, LEVELS = 16, 6, 2048, 3
#: Rows of a batch of fingerprints.
WIDE = 20_000
#: Cells of at most so many points are searched many at a time.
FEW = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PAIRS = np.uint64(0x5555555555555555)


def fingerprint(text: bytes) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes, repeats included; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i : j - 1], SEED) for i, j in zip(starts, ends[SHINGLE - 1 :], strict=False)], np.uint64)
    # By bit: the eight bytes of the hashes, one histogram of unpacked bits for all; in parts, as a text may be long.
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes))))


def fingerprints(df: DataFrame, *, keep: dict[str, Column], text: str = "text", name: str = "fp") -> DataFrame:
    """keep's columns and the fingerprint, as a signed 64-bit integer, of each row's whole text; null and empty texts have 0."""

    def start():
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda texts: {name: [signed(fingerprint(t)) for t in texts]}

    return map_text(df, col(text), keep, {name: "bigint"}, start)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def embed(fps: np.ndarray) -> np.ndarray:
    """The numbers of set bits of the 32 two-bit segments, two bits each, packed as the segments were."""
    return fps - ((fps >> np.uint64(1)) & _PAIRS)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two packed embeddings, summed over the segments."""
    low, out = np.uint64(0x3333333333333333), 0
    for shift in (np.uint64(0), np.uint64(2)):
        x, y = (a >> shift) & low, (b >> shift) & low  # segments of two bits in fields of four
        lift = (x | np.uint64(0x8888888888888888)) - y  # 8 + x - y in each field: 6 to 10
        # |x - y| for x - y in -2..2, from the field's bits: 6 -> 2, 7 -> 1, 8 -> 0, 9 -> 1, 10 -> 2
        one = np.uint64(0x1111111111111111)
        odd = lift & one
        two = (lift >> np.uint64(1)) & one & ~odd
        out = out + _popcount(odd).astype(np.int64) + 2 * _popcount(two).astype(np.int64)
    return out


def _masks(segments: list[int]) -> list[int]:
    """For the given segments, the bit masks of all choices of half of their blocks."""
    n = min(BLOCKS, len(segments))
    blocks = [segments[len(segments) * i // n : len(segments) * (i + 1) // n] for i in range(n)]
    take = max(0, n - BITS)
    return [sum(3 << (2 * s) for b in choice for s in b) for choice in itertools.combinations(blocks, take)]


def _unite(parent: list[int], a: int, b: int) -> None:
    while parent[a] != a:
        parent[a] = a = parent[parent[a]]
    while parent[b] != b:
        parent[b] = b = parent[parent[b]]
    if a != b:
        parent[max(a, b)] = min(a, b)


def cell_links(fps: np.ndarray, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect just what links of a cell's points connect: one less than points for each group, never all pairs. Two probes aren't compared: they meet in a home of one of them."""
    n, spots = len(fps), embed(fps)
    probes = np.zeros(n, bool) if probes is None else probes
    parent = list(range(n))
    for at in range(0, n - 1, 256):
        rows = slice(at, min(n, at + 256))
        near = (manhattan(spots[rows, None], spots[None, at:]) <= BITS) & ~(probes[rows, None] & probes[None, at:])
        a, b = np.nonzero(near)
        keep = b > a
        a, b = a[keep] + at, b[keep] + at
        exact = _popcount(fps[a] ^ fps[b]) <= BITS
        for i, j in zip(a[exact].tolist(), b[exact].tolist(), strict=True):
            _unite(parent, i, j)
    out = []
    for i in range(n):
        r = i
        while parent[r] != r:
            r = parent[r]
        if r != i:
            out.append((i, r))
    return out


def grid(spots: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(half, points, their cells, whether they probe) of packed embeddings: each point's home in either half, and the cells a step up."""
    for half in (0, 1):
        segments = range(HALF * half, HALF * (half + 1))
        home = spots & np.uint64(sum(3 << (2 * s) for s in segments))
        yield half, np.arange(len(spots)), home, False
        for s in segments:
            at = np.flatnonzero((spots >> np.uint64(2 * s)) & np.uint64(3) < 2)
            yield half, at, home[at] + np.uint64(1 << (2 * s)), True


def _mixed(cell: np.ndarray, mask: int, own: np.ndarray) -> np.ndarray:
    """A cell's parts by what its points have under a mask; that two cells may share a number does no harm, as links are checked."""
    x = (cell ^ np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) + own
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _deal(level: int, exact: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From points (held: segments that their cell is of, cell, fp, probe), their cells of a level, by set bits or the exact ones, in the same columns."""

    def rows(held, cell, fps, probe):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), held, np.uint64).view(np.int64)), pa.array(cell.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(probe)], names=["held", "cell", "fp", "probe"])

    choices: dict[int, list[int]] = {}
    for b in batches:
        held, cells, fps = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
        probes = b.column(3).to_numpy(zero_copy_only=False)
        if not level:
            for half, at, cell, probe in grid(embed(fps)):
                yield rows(sum(3 << (2 * s) for s in range(HALF * half, HALF * (half + 1))), cell, fps[at], np.full(len(at), probe))
            continue
        for h in np.unique(held).tolist():
            own = np.flatnonzero(held == np.uint64(h))
            spots = fps[own] if exact else embed(fps[own])
            if h not in choices:
                choices[h] = _masks([s for s in range(32) if not h >> (2 * s) & 3])
            for m in choices[h]:
                yield rows(h | m, _mixed(cells[own], m, spots & np.uint64(m)), fps[own], probes[own])


def _search(most: int, last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From points sorted by cell, links a, b (kind 1) and the points of cells of more than most (kind 0; none when it is the last time)."""
    names = ["kind", "a", "b", "held", "cell", "probe"]

    def links_of(a, b):
        none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], names=names)

    def crowd(held, cells, fps, probes):
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fps), np.int32)), pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(held), pa.array(cells), pa.array(probes)], names=names)

    rest = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]  # the cell that the last batch ended in
    flushed = None  # a cell that was too large, of which more rows may come

    def cells_of(held, cells, fps, probes, ended):
        nonlocal rest, flushed
        edges = np.concatenate([[0], np.flatnonzero((cells[1:] != cells[:-1]) | (held[1:] != held[:-1])) + 1, [len(fps)]])
        small = []
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            key = (held[i], cells[i])
            if key == flushed or j - i > most and not last:
                flushed = key
                yield crowd(held[i:j], cells[i:j], fps[i:j], probes[i:j])
                if j == len(fps):
                    rest = [x[:0] for x in rest]
            elif j == len(fps) and not ended:
                rest = [held[i:], cells[i:], fps[i:], probes[i:]]
            elif j - i > FEW:
                made = np.array(cell_links(fps[i:j].view(np.uint64), probes[i:j]), np.int64).reshape(-1, 2)
                yield links_of(fps[i + made[:, 0]], fps[i + made[:, 1]])
            elif j - i > 1:
                small.append((i, j))
        if small:  # all of them at once: each point against the next ones of its cell
            own = np.concatenate([np.arange(i, j) for i, j in small])
            end = np.repeat([j for _, j in small], [j - i for i, j in small])
            points, spots = fps.view(np.uint64), embed(fps.view(np.uint64))
            for step in range(1, FEW):
                a = own[own + step < end]
                a = a[~(probes[a] & probes[a + step])]
                a = a[manhattan(spots[a], spots[a + step]) <= BITS]
                a = a[_popcount(points[a] ^ points[a + step]) <= BITS]
                if len(a):
                    yield links_of(fps[a], fps[a + step])

    for b in batches:
        if b.num_rows:
            yield from cells_of(*(np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(rest)), False)
    if len(rest[2]):
        yield from cells_of(*rest, True)


def links(points: DataFrame, name: str = "fp") -> tuple[DataFrame, list[DataFrame]]:
    """a, b: pairs of distinct fingerprints with the same components as all pairs of at most BITS differing bits; and the tables that hold them.

    points has each fingerprint once. The rows of a cell arrive sorted, as a
    stream. A cell is never held whole beyond CELL points: a larger one is dealt
    again by choices of blocks of the segments that weren't looked at yet, LEVELS
    times in all by set bits and, as many points can agree in those of all
    segments, LEVELS times more by the bits themselves, from the start. Then at
    most 6 segments are free, and 4,096 points, the most that differ there only,
    are compared in one task. Each level's result is a table in the shared folder.
    """
    plain_unions(points.sparkSession)
    spread = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    start = [F.lit(0).cast("bigint").alias("held"), F.lit(0).cast("bigint").alias("cell")]
    todo = points.select(*start, col(name).alias("fp"), F.lit(False).alias("probe"))
    found, tables, rows = None, [], points.count() * (2 * HALF + 2)
    for level in range(2 * LEVELS):
        dealt = todo.mapInArrow(partial(_deal, level, level >= LEVELS), "held bigint, cell bigint, fp bigint, probe boolean")
        cells = dealt.repartition(spread, "held", "cell").sortWithinPartitions("held", "cell")
        searched = cells.mapInArrow(partial(_search, CELL, level == 2 * LEVELS - 1), "kind int, a bigint, b bigint, held bigint, cell bigint, probe boolean")
        made = durable(gathered(searched, rows), rows_per_batch=WIDE)
        tables.append(made)
        edges = made.where("kind = 1").select("a", "b").distinct()
        found = edges if found is None else found.union(edges)
        crowded = made.where("kind = 0")
        rows = crowded.count() * math.comb(BLOCKS, BITS)
        if level == LEVELS - 1:  # bits start anew
            todo = crowded.select(*start, F.col("a").alias("fp"), F.lit(False).alias("probe")).distinct()
        else:
            todo = crowded.select("held", "cell", F.col("a").alias("fp"), "probe")
        if level == 2 * LEVELS - 1 or not rows:
            break
    return found, tables


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root: the smallest node of its component, for each node of an edge.

    Alternating large and small stars: every round hangs larger neighbours on a
    node's smallest one and writes the edges to the shared folder. A hub's edges are never in one
    group: its smallest neighbour is found by a combining aggregate and joined
    back, and adaptive execution splits that join where it is skewed.
    rows is the number of edges, if it is known: few are written in few files.
    """
    rows = edges.count() if rows is None else rows
    now = durable(gathered(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows))
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, now = now, durable(gathered(small, 2 * rows))
        release(last)
        # A star forest: nobody is both hung up and hung on, and each hangs on one.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        state, rows = tuple(mark), mark[0]


def near_duplicates(df: DataFrame, *, row: str = "doc_id", text: str = "text") -> DataFrame:
    """row, text_hash, fp (signed) and component: the smallest row id among all that links reach, for each row of df.

    Rows without words have fingerprint 0 and are linked like any other. Rows
    without an id get the component of the rows they are linked to (null if none
    of those has an id). Repeated ids and rows are separate rows; other columns
    are ignored. Equal fingerprints meet in one combining aggregate.
    """
    keep = {"row": col(row), "text_hash": F.xxhash64(F.coalesce(col(text), F.lit("")))}
    prints = durable(fingerprints(df, keep=keep, text=text))
    return gathered(_classes(prints).drop("root"), prints.count())


def _classes(prints: DataFrame) -> DataFrame:
    points = durable(gathered(prints.groupBy("fp").agg(F.min("row").alias("low")), prints.count()))
    found, tables = links(points)
    stars = components(found, sum(t.where("kind = 1").count() for t in tables))
    release(*tables)
    lowest = points.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    of_root = lowest.groupBy("root").agg(F.min("low").alias("component"))
    return prints.join(lowest.select("fp", "root").join(of_root, "root"), "fp")


def keep_one(df: DataFrame, *, row: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df, with all its columns, of each component: that of the smallest row id, rows without an id last.

    Rows of the same id are told apart by a 64-bit hash of their text; of rows
    with the same id and text one stays, whichever.
    """
    keep = {"row": col(row), "text_hash": F.xxhash64(F.coalesce(col(text), F.lit("")))}
    classes = _classes(durable(fingerprints(df, keep=keep, text=text)))
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("row").isNull(), F.col("row"), F.col("text_hash"))).alias("first"))
    # Texts and rows by two hashes that are never null, so that the join and the dropping of repeated rows share one exchange.
    by_text, by_row = free(df, "near_text", "near_row")
    hashed = lambda x: F.xxhash64(x, x.isNull())
    first = first.select(F.col("first.text_hash").alias(by_text), hashed(F.col("first.row")).alias(by_row))
    marked = df.withColumns({by_text: F.xxhash64(F.coalesce(col(text), F.lit(""))), by_row: hashed(col(row))})
    return marked.join(first, [by_text, by_row], "left_semi").dropDuplicates([by_text, by_row]).drop(by_text, by_row)
