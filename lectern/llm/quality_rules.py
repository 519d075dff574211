"""Quality rules: how much of a text is repetition.

Words become numbers, n-grams of several lengths become rolling hashes, and all
of a batch's n-grams of one length are grouped by one numpy sort. Measured are
the characters of words inside duplicated n-grams, and of duplicated lines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from lectern.llm.common import col, map_text

#: Share of the word characters that duplicated n-grams of each length may cover. Short ones repeat in honest prose, above all in its function words; long ones don't.
DUPLICATE_NGRAMS = {5: 0.50, 6: 0.45, 8: 0.40, 10: 0.35}
#: Share of the characters that repeated lines may hold, and share of the lines that may repeat.
DUPLICATE_LINE_CHARS, DUPLICATE_LINES = 0.40, 0.50
#: Symbols a word, mean word length, share of words in capitals and of lone column bars that a text may have.
SYMBOLS_A_WORD, WORD_LENGTHS, CAPITAL_WORDS, BARS_A_WORD = 0.10, (2.0, 14.0), 0.50, 0.20

FIELDS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean",
    "dup_line_chars": "bigint", **{f"dup_{n}gram_chars": "bigint" for n in DUPLICATE_NGRAMS},
}
_SYMBOLS = b"#*$%&|<>"
_NO_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _in_repeated(owner: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether each n-gram occurs again under the same owner (the row)."""
    out = np.zeros(len(grams), bool)
    if len(grams) > 1:
        order = np.lexsort((grams, owner))
        same = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the n-word windows that start at starts."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The figures of FIELDS, for a batch of texts.

    Three-word windows are compared by their words, through exact numbers; the
    longer n-grams by 64-bit rolling hashes.
    """
    rows = len(texts)
    out = {k: np.zeros(rows, np.int64) for k in (*FIELDS, "n_lines", "n_capital", "n_bars")}
    numbers: dict[bytes, int] = {}
    ids: list[int] = []
    for r, text in enumerate(texts):
        words = text.split()  # bytes.split() cuts at just space and \x09-\x0D
        out["n_words"][r] = len(words)
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        out["n_symbols"][r] = len(text.translate(None, _NO_SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip()]
        out["n_lines"][r] = len(lines)
        if len(lines) > 1:
            seen: set[bytes] = set()
            for x in lines:
                if x in seen:
                    out["n_dup_lines"][r] += 1
                    out["dup_line_chars"][r] += len(b"".join(x.split()).translate(None, _CONTINUED))
                seen.add(x)
    word = np.array(ids, np.int64)
    owner = np.repeat(np.arange(rows), out["n_words"])
    vocabulary = [*numbers]
    length = np.array([len(w.translate(None, _CONTINUED)) for w in vocabulary], np.int64)[word] if ids else word
    rng = np.random.default_rng(20)
    value = rng.integers(1, 2**63, max(1, len(numbers)), np.uint64)[word]
    total = lambda mask: np.bincount(owner[mask], minlength=rows).astype(np.int64)
    chars = lambda mask: np.bincount(owner[mask], length[mask], minlength=rows).astype(np.int64)
    out["word_chars"] = chars(np.ones(len(word), bool))
    if ids:
        capital = np.array([w.isupper() and len(w) > 1 or w.decode("utf-8", "replace").isupper() and len(w) > 2 for w in vocabulary])
        out["n_capital"] = total(capital[word])
        out["n_bars"] = total(np.array([w == b"|" for w in vocabulary])[word])

    def starts_of(n: int) -> np.ndarray:
        return np.flatnonzero(owner[: len(word) - n + 1] == owner[n - 1 :]) if len(word) >= n else np.zeros(0, np.int64)

    at, many = starts_of(3), len(numbers)
    if len(at):
        pair = np.unique(word[at] * many + word[at + 1], return_inverse=True)[1]  # exact while the batch has fewer than 3e9 words
        found = _in_repeated(owner[at], pair * many + word[at + 2])
        out["n_repeat_words"] = total(_covered(at[found], 3, len(word)))
    rolled = value.copy()
    for n in range(2, max(DUPLICATE_NGRAMS) + 1):
        if len(word) < n:
            break
        rolled = rolled[:-1] * _BASE + value[n - 1 :]  # of n words, from the hash of the first n - 1 (wraps at 64 bits)
        if n in DUPLICATE_NGRAMS:
            at = starts_of(n)
            found = _in_repeated(owner[at], rolled[at])
            out[f"dup_{n}gram_chars"] = chars(_covered(at[found], n, len(word)))
    return out


def verdict(m: dict[str, np.ndarray]) -> None:
    """Adds base_failed and kept to the figures of a batch.

    The base rule fails texts under 50 words, or with more than half of their
    words in repeated three-word windows. Of the others, those stay whose
    duplicated n-grams and lines, symbols, capitals, bars and word lengths are
    all within the limits above.
    """
    words, chars = m["n_words"], np.maximum(1, m["word_chars"])
    m["base_failed"] = (words < 50) | (100 * m["n_repeat_words"] > 50 * words)
    bad = m["dup_line_chars"] > DUPLICATE_LINE_CHARS * chars
    bad |= m["n_dup_lines"] > DUPLICATE_LINES * np.maximum(1, m["n_lines"])
    for n, most in DUPLICATE_NGRAMS.items():
        bad |= m[f"dup_{n}gram_chars"] > most * chars
    bad |= m["n_symbols"] - m["n_bars"] > SYMBOLS_A_WORD * words
    bad |= (m["word_chars"] < WORD_LENGTHS[0] * words) | (m["word_chars"] > WORD_LENGTHS[1] * words)
    bad |= (m["n_capital"] > CAPITAL_WORDS * words) | (m["n_bars"] > BARS_A_WORD * words)
    m["kept"] = ~m["base_failed"] & ~bad


def quality_rules(df: DataFrame, *, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """keep's columns and FIELDS for each row of df, over the whole text.

    A null or empty text has no words: all figures are 0 and it fails the base
    rule. Equal rows get equal figures, one row each; other columns are ignored.
    Row-local: nothing is shuffled, and memory is bounded by a batch's texts.
    """

    def start():
        def work(texts: list[bytes]) -> dict:
            m = measure(texts)
            verdict(m)
            return m

        return work

    return map_text(df, col(text), keep, FIELDS, start)
