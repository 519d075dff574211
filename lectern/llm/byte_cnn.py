"""Quality classifier: a convolutional network over bytes, in numpy.

Each byte becomes a short vector, learned filters run over the whole document in
overlapping chunks, each filter's largest answer in a chunk is kept, and the
chunks' scores are combined into one probability. Training sees all chunks of a
bounded sample of labelled rows; scoring is row-local.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import col, durable, free, map_text, release

#: Bytes of a chunk and from one chunk's start to the next's: a fourth of a chunk is in two.
CHUNK, HOP = 512, 384
#: Bytes a filter sees are two steps; numbers a byte becomes; filters.
STEP, WIDTH, FILTERS = 4, 8, 32
#: Most labelled rows that training takes, passes over all their chunks, and chunks that a text weighs at most, so that a long one doesn't outweigh the others.
TRAIN_ROWS, EPOCHS, TEXT_WEIGHT = 4000, 4, 4
#: Chunks of a piece of a text, as training streams them.
PIECE = 8
_AT_ONCE = 1024


def chunks(text: bytes) -> np.ndarray:
    """The overlapping chunks that cover a text, zero-padded; one of zeros for an empty text."""
    n = max(1, -(-max(0, len(text) - CHUNK) // HOP) + 1)
    data = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(data, (n, CHUNK), (HOP, 1), writeable=False)


class ByteCnn:
    """embed (256, WIDTH), near and far (STEP * WIDTH, FILTERS): the halves of the filters, bias, out and combine: weights of the last two layers."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(2 * STEP * WIDTH)
        self.p = {
            "embed": rng.normal(0, 1, (256, WIDTH)), "near": rng.normal(0, scale, (STEP * WIDTH, FILTERS)), "far": rng.normal(0, scale, (STEP * WIDTH, FILTERS)),
            "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, FILTERS), "base": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.combine = np.array([0, 1, 0, 0], np.float64)

    def _pooled(self, data: np.ndarray, full: bool = False):
        """Each filter's largest answer in each chunk, above 0; and with full, where it was and what led there."""
        p, n = self.p, len(data)
        e = p["embed"][data].reshape(n, CHUNK // STEP, STEP * WIDTH)
        answers = (e @ p["near"])[:, :-1] + (e @ p["far"])[:, 1:]
        if not full:
            return np.maximum(answers.max(1) + p["bias"], 0)
        where = answers.argmax(1)
        return np.maximum(np.take_along_axis(answers, where[:, None], 1)[:, 0] + p["bias"], 0), where, e

    def logits(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([self._pooled(data[i : i + _AT_ONCE]) @ self.p["out"] + self.p["base"] for i in range(0, len(data), _AT_ONCE)])

    def _features(self, texts: list[bytes]) -> np.ndarray:
        """1, and the mean, smallest and largest of the chunks' logits (to 20 either way), per text."""
        out, part, sizes = [], [], []

        def flush() -> None:
            if part:
                z, at = self.logits(np.concatenate(part)).astype(np.float64), np.cumsum([0, *sizes[:-1]])
                out.append(np.stack([np.ones(len(sizes)), np.add.reduceat(z, at) / sizes, np.minimum.reduceat(z, at), np.maximum.reduceat(z, at)], 1))
                part.clear()
                sizes.clear()

        for t in texts:
            part.append(chunks(t))
            sizes.append(len(part[-1]))
            if sum(sizes) >= 4 * _AT_ONCE:
                flush()
        flush()
        return np.clip(np.concatenate(out), -20, 20)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text; an empty text is a chunk of zeros."""
        return 1 / (1 + np.exp(-np.clip(self._features(texts) @ self.combine, -30, 30)))

    def fit(self, epochs: Iterable[Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]], share: float, seed: int = 4) -> None:
        """Adam on the chunks' cross-entropy. epochs yields passes of (chunks, labels, weights); share is that of label 1, and the rarer label is weighted up to a third of all."""
        rng, share = np.random.default_rng(seed), np.clip(share, 0.02, 0.98)
        up = min(1, 2 * (1 - share) / share) if share > 2 / 3 else 1.0
        down = min(1, 2 * share / (1 - share)) if share < 1 / 3 else 1.0
        first, second, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch, steps in enumerate(epochs):
            rate = 0.01 if epoch < EPOCHS - 1 else 0.002
            for x, y, weight in steps:
                n = len(x)
                size = np.where(rng.random(n) < 0.25, rng.integers(24, CHUNK, n), CHUNK)  # short texts are rare in the sample
                x = x * (np.arange(CHUNK) < size[:, None])
                pooled, where, e = self._pooled(x, full=True)
                z = pooled @ self.p["out"] + self.p["base"]
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight * np.where(y > 0, up, down) / n).astype(np.float32)
                back = np.outer(d, self.p["out"]) * (pooled > 0)
                rows = np.arange(n)[:, None]
                near, far = e[rows, where], e[rows, where + 1]  # (chunk, filter, STEP * WIDTH)
                g = {
                    "out": pooled.T @ d, "base": d.sum(keepdims=True), "bias": back.sum(0),
                    "near": np.einsum("bfe,bf->ef", near, back), "far": np.einsum("bfe,bf->ef", far, back), "embed": np.zeros_like(self.p["embed"]),
                }
                spots = (where * STEP)[:, :, None] + np.arange(2 * STEP)
                seen = np.take_along_axis(x[:, None, :], spots.reshape(n, 1, -1), 2).reshape(spots.shape)
                both = np.concatenate([back[:, :, None] * self.p["near"].T, back[:, :, None] * self.p["far"].T], 2).reshape(-1, WIDTH)
                np.add.at(g["embed"], seen.ravel(), both)
                t += 1
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    def fit_combine(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the texts' labels on what _features gives of them, by Newton's method with a ridge."""
        w = self.combine.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + 1e-1 * (w - [0, 1, 0, 0])
            hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(4)
            step = np.linalg.solve(hess, grad)
            w -= np.clip(step, -1, 1)
        self.combine = w


def train(df: DataFrame, labels: DataFrame, *, row: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> ByteCnn:
    """A network fitted to all chunks of at most rows labelled rows of df (those first by a hash of the row id).

    labels holds row ids and labels; rows without a label, or whose label is
    neither 0 nor 1, are left out, and of several labels of a row the largest
    counts. The sample's chunks are a table in the shared folder, which the
    driver reads as a stream, partition by partition, once a pass; of each whole
    text it gets three numbers. With only one class, or no rows, the score is
    that class's smoothed share for any text.
    """
    chosen = (
        labels.where(col(label).isin(0, 1) & col(row).isNotNull()).groupBy(col(row).alias("row")).agg(F.max(col(label)).cast("int").alias("y"))
        .orderBy(F.xxhash64("row"), "row").limit(rows)
    )
    (text_of,) = free(chosen, "text_of")
    sample = df.select(col(row).alias("row"), col(text).alias(text_of)).join(F.broadcast(chosen), "row")  # at most rows rows of two numbers

    def start():
        def work(texts: list[bytes]) -> dict:
            cut = [chunks(t) for t in texts]
            return {"pieces": [[c[i : i + PIECE].tobytes() for i in range(0, len(c), PIECE)] for c in cut], "n": [len(c) for c in cut]}

        return work

    cut = map_text(sample, col(text_of), {"row": F.col("row"), "y": F.col("y")}, {"pieces": "array<binary>", "n": "bigint"}, start)
    pieces = durable(cut.select("row", "y", "n", F.posexplode("pieces").alias("at", "piece")))
    n, y1, weight = pieces.where("at = 0").agg(F.count("*"), F.sum("y"), F.sum(F.least("n", F.lit(TEXT_WEIGHT)))).first()
    net = ByteCnn()
    if not n or y1 in (0, n):
        share = ((y1 or 0) + 0.5) / (n + 1)
        net.combine = np.array([np.log(share / (1 - share)), 0, 0, 0])
        release(pieces)
        return net
    heavy = pieces.where("at = 0 AND y = 1").agg(F.sum(F.least("n", F.lit(TEXT_WEIGHT)))).first()[0]
    net.fit((_steps(pieces, epoch) for epoch in range(EPOCHS)), heavy / weight)
    release(pieces)
    net.fit_combine(*_whole(sample, text_of, net))
    return net


def _steps(pieces: DataFrame, epoch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All chunks of a pass, in an order of its own, 64 at a time: chunks, labels, weights."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def out(least: int):
        nonlocal held, size
        x, y, w = (np.concatenate(v) for v in zip(*held, strict=True))
        order = np.random.default_rng(epoch).permutation(size)  # a text's chunks go to different steps
        whole = size - size % 64 if least > 1 else size
        for i in range(0, whole, 64):
            own = order[i : min(i + 64, whole)]
            yield x[own], y[own], w[own]
        left = order[whole:]
        held, size = ([(x[left], y[left], w[left])], len(left)) if len(left) else ([], 0)

    for r in pieces.orderBy(F.xxhash64("row", "at", F.lit(epoch)), "row", "at").toLocalIterator():
        x = np.frombuffer(r.piece, np.uint8).reshape(-1, CHUNK)
        held.append((x, np.full(len(x), r.y, np.float32), np.full(len(x), min(1.0, TEXT_WEIGHT / r.n), np.float32)))
        size += len(x)
        if size >= 4096:
            yield from out(64)
    if size:
        yield from out(1)


def _whole(sample: DataFrame, text: str, net: ByteCnn) -> tuple[np.ndarray, np.ndarray]:
    """The features of the sample's whole texts, as scoring has them, and their labels."""
    shared = sample.sparkSession.sparkContext.broadcast(net.p)

    def start():
        own = ByteCnn()
        own.p = shared.value
        return lambda texts: {"x": [x.tobytes() for x in own._features(texts)]}

    rows = map_text(sample, col(text), {"y": F.col("y")}, {"x": "binary"}, start).toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float64).reshape(rows.num_rows, -1)
    order = np.lexsort(x.T)  # the sums come out the same whatever the order of the rows
    return x[order], np.array(rows["y"].to_pylist(), np.float64)[order]


def score(df: DataFrame, net: ByteCnn, *, keep: dict[str, Column], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """keep's columns, score (0 to 1) and predicted (1 from the threshold on) for each row of df, over the whole text.

    A null text is empty; an empty text gets the network's answer to zeros.
    Equal texts get equal scores; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast((net.p, net.combine))  # some tens of kilobytes

    def start():
        own = ByteCnn()
        own.p, own.combine = shared.value

        def work(texts: list[bytes]) -> dict:
            s = own.score(texts)
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

        return work

    return map_text(df, col(text), keep, {"score": "double", "predicted": "int"}, start)


def held_out(row: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the row id as text leaves that remainder; rows without an id count as those with the empty text."""
    return F.crc32(F.coalesce(row.cast("string"), F.lit("")).cast("binary")) % parts == part
