"""Byte-level BPE: encoding with offsets and decoding.

The merges run in the `tokenizers` library. A rank file holds byte strings, the
library wants strings of characters, so every byte travels as one printable
character; decoding reverses that table. Texts go through in Arrow batches.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import col, map_text

#: Units that a task remembers; about 200 bytes each.
MEMO_UNITS = 300_000
#: About so many characters of new units are encoded as one text.
JOINED_CHARS = 4096


_UNITS = re.compile(r" (?=\S)")


def _array(packed: bytes) -> array:
    ids = array("I", packed)
    if sys.byteorder != "little":
        ids.byteswap()
    return ids


def byte_characters() -> list[str]:
    """A printable character for each byte: Latin-1's own where it has one, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in data.splitlines() if line.strip())}


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        shown = byte_characters()
        show = lambda word: "".join([shown[b] for b in word])
        self.words = {i: w for w, i in ranks.items()}
        merges = []
        for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
            # Any two neighbours that make a known word may merge, at that word's rank; which halves came first in training doesn't matter.
            merges += [(show(word[:i]), show(word[i:])) for i in range(1, len(word)) if word[:i] in ranks and word[i:] in ranks]
        self.engine = Tokenizer(models.BPE(vocab={show(w): i for w, i in ranks.items()}, merges=merges, ignore_merges=True))
        self.engine.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.lengths[[*ranks.values()]] = [len(w) for w in ranks]
        self.memo: dict[str, bytes] = {}

    def _learn(self, units: list[str], space: str) -> None:
        """Encodes units that the memo lacks; those after a space, as one text in rows of a bounded length, as a call costs far more than a unit."""
        rows: list[list[str]] = [] if space else [[u] for u in units]
        size = JOINED_CHARS
        for u in units if space else ():
            if size >= JOINED_CHARS:
                rows.append([])
                size = 0
            rows[-1].append(u)
            size += len(u) + 1
        for row, e in zip(rows, self.engine.encode_batch_fast([space + space.join(row) for row in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum([len(u.encode()) + len(space) for u in row])
            cuts = [0, *(4 * np.searchsorted(np.cumsum(self.lengths[ids]), ends, "right")).tolist()]
            packed = ids.tobytes()
            self.memo.update((space + u, packed[i:j]) for u, i, j in zip(row, cuts, cuts[1:], strict=False))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers.

        A text is cut before each space that a non-space follows. The pattern
        never joins what stands before such a space to what follows it: words
        take one space in front, and a run of white space leaves its last one to
        the word. So units are encoded one by one, and a repeated one once.
        """
        cut = [_UNITS.split(t) for t in texts]
        if len(self.memo) > MEMO_UNITS:
            self.memo.clear()
        self._learn([u for u in {units[0] for units in cut} if u not in self.memo], "")
        after = {u for units in cut for u in units[1:]}
        self._learn([u for u in after if " " + u not in self.memo], " ")
        known = {u: self.memo[" " + u] for u in after}
        return [self.memo[units[0]] + b"".join(map(known.__getitem__, units[1:])) for units in cut]

    def offsets(self, text: str, ids: Sequence[int]) -> np.ndarray:
        """First and past-last character of each id in turn; ids that share a character's bytes share the character."""
        sizes = self.lengths[np.frombuffer(ids, np.uintc) if isinstance(ids, array) else np.asarray(ids, np.int64)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        if not text.isascii():
            of = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1  # the character of each byte
            starts, ends = of[starts], of[ends - 1] + 1
        return np.stack([starts, ends], 1).ravel().astype(np.int32)

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def decode(self, ids: Sequence[int]) -> str:
        """The text; a character cut off at either end becomes U+FFFD, one split over several ids is whole again."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def pieces(self, ids: Sequence[int]) -> list[str]:
        """What each id adds to the text: a character split over ids comes with the id that completes it."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self.words[i]) for i in ids]
        if out:
            out[-1] += decoder.decode(b"", True)
        return out


@lru_cache(maxsize=2)
def _engine(data: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(data), pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, *, keep: dict[str, Column], text: str = "text", offsets: bool = True, values: bool = True, digests: bool = False) -> DataFrame:
    """One row per row of df: keep's columns, n_tokens and, by choice, ids and decoded (values), ids_sha256 and decoded_sha256 (digests), and offsets in both forms.

    offsets holds first and past-last character of each id in turn; its digest is of little-endian unsigned 32-bit integers. Texts are
    taken whole; null and empty texts have no ids. Bytes that are not UTF-8 are
    read as U+FFFD. Other columns of df are ignored. The rank file is read by
    the driver alone and goes to the tasks once.
    """
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    fields = {"n_tokens": "bigint"} | ({"ids": "array<int>", "decoded": "string"} if values else {}) | ({"offsets": "array<int>"} if values and offsets else {}) | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {}) | ({"offsets_sha256": "string"} if digests and offsets else {})

    def start():
        bpe = _engine(shared.value, pattern)

        def work(texts: list[bytes]) -> dict:
            out: dict[str, list] = {k: [] for k in fields}
            for at in range(0, len(texts), 64):
                part = [t.decode("utf-8", "replace") for t in texts[at : at + 64]]
                for t, packed in zip(part, bpe.encode(part), strict=True):
                    ids = _array(packed)
                    back = bpe.decode_bytes(ids)
                    out["n_tokens"].append(len(ids))
                    if values:
                        out["ids"].append(ids)
                        out["decoded"].append(back.decode("utf-8", "replace"))
                    if offsets:
                        where = bpe.offsets(t, ids)
                        if values:
                            out["offsets"].append(where)
                        if digests:
                            out["offsets_sha256"].append(hashlib.sha256(where.astype("<u4").tobytes()).hexdigest())
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            return out

        return work

    return map_text(df, col(text), keep, fields, start)


def decode(df: DataFrame, ranks_path: str, pattern: str, *, keep: dict[str, Column], ids: str = "ids") -> DataFrame:
    """keep's columns and decoded: the text of an array<int> column of ids; null and empty arrays give the empty text."""
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    packed = F.to_json(F.coalesce(col(ids), F.array().cast("array<int>")))

    def start():
        import json

        bpe = _engine(shared.value, pattern)
        return lambda rows: {"decoded": [bpe.decode(json.loads(x)) if x else "" for x in rows]}

    return map_text(df, packed, keep, {"decoded": "string"}, start)
