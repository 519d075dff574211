"""Toxicity by a weighted finite-state pattern grammar.

A text becomes a sequence of weighted symbols: a lexicon transducer names
insults, harm, targets, speakers, intents, negations, verbs of reported speech
and ends of clauses. A cascade of small weighted transducers then rewrites them
by what stands before them in their clause: arcs multiply an insult's weight if
it is aimed at somebody and take all of it away if it is negated or reported;
a speaker's intent of harm to a target, or a target's fate, becomes a threat. A
clause weighs what its symbols weigh together, and a text is scored by its
clauses. The lexicon of insults (words, word beginnings, and beginnings that
count only where two different words of a text have them) and the weights of the
clauses are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Container, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import col, free, map_text, small_batches

#: Most labelled rows of the sample.
TRAIN_ROWS = 20_000
#: A pattern needs so many toxic rows, so large a share of toxic ones among its rows (after smoothing), and rows that would show such a share by chance with at most this probability.
LEAST_ROWS, LEAST_SHARE, CHANCE = 5, 0.9, 1e-6
#: Rows are told apart by the words so far before and behind a pattern, further than a phrase reaches.
AROUND = 8
#: Letters of the word beginnings that may become patterns or families, for coined words with changing ends, and different words that must have shown one.
BEGINNINGS, FORMS = (4, 5, 6), 3
#: Words that a negation and a speaker reach; that a target, an intent and a threat reach.
NEAR, REACH = 3, 4
#: What an insult weighs that is aimed at somebody, against 1; and a threat.
AIMED, THREAT = 1.5, 2.0

# Closed-class words of English, German, French and Spanish.
_LISTS = {
    "t": "you your you're u he him she her they them people du dich dir ihr euch dein deine sie er toi tu vous ton ta tes il elle ils elles tú te ti vosotros usted ustedes él ella ellos",
    "p": "i i'll i'm we we'll ich wir je j'ai nous yo nosotros",
    "n": "not no never isn't aren't wasn't don't doesn't nicht kein keine keiner nie niemals pas jamais aucun aucune nunca jamás ningún ninguna",
    "r": "said says wrote writes called claimed quoted reported according sagte sagt schrieb nannte berichtete laut dit écrit disait selon appelé dijo dice escribió llamó según",
    "w": "will shall gonna going should must werde werden wird sollte vais allons va doit devrait voy vamos debe debería",
    "h": "kill hurt destroy murder stab shoot burn töten umbringen verletzen tuer blesser brûler matar herir quemar",
    "d": "die suffer rot bleed sterben leiden mourir souffrir morir sufrir",
}
_SEED = "idiot moron stupid loser scum trash worthless pathetic disgusting clown"
CLOSED = {w: symbol for symbol, words in _LISTS.items() for w in words.split()}
#: Class weights before any row is seen, of the features in their order, and how firmly they hold.
PRIOR, RIDGE = (-5.0, 6.0, 0.5, 0.5), (0.01, 0.05, 0.2, 1.0)
_ENDS = ".!?;\n"
_EDGES = ".,;:!?|#*$%&"
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]+")


class Transducer:
    """States and weighted arcs: (state, symbol) -> (next state, symbol put out, factor of its weight).

    Symbols without an arc of their own take the state's own arc, which leaves
    them and their weight as they are.
    """

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]], rest: dict[int, int]):
        self.arcs, self.rest = arcs, rest

    def __call__(self, tape: Iterable[tuple[str, float]]) -> list[tuple[str, float]]:
        state, out = 0, []
        for symbol, weight in tape:
            state, symbol, factor = self.arcs.get((state, symbol)) or (self.rest[state], symbol, 1.0)
            out.append((symbol, weight * factor))
        return out


def _scope(opens: str, reach: int | None, rewrite: dict[str, tuple[str, float]]) -> Transducer:
    """After a symbol of opens, for reach symbols (None: to the clause's end), rewrites symbols and multiplies their weights."""
    last = 1 if reach is None else reach
    arcs = {(s, "|"): (0, "|", 1.0) for s in range(last + 1)} | {(s, o): (last, o, 1.0) for s in range(last + 1) for o in opens}
    rest = {0: 0} | {s: s if reach is None else s - 1 for s in range(1, last + 1)}
    return Transducer(arcs | {(s, a): (rest[s], b, f) for s in range(1, last + 1) for a, (b, f) in rewrite.items()}, rest)


#: In this order. What is reported or negated weighs nothing from there on, and its symbol fits no later arc.
CASCADE = (
    _scope("r", None, {"i": ("reported", 0.0), "h": ("x", 0.0), "d": ("x", 0.0)}),
    _scope("n", NEAR, {"i": ("negated", 0.0), "h": ("x", 0.0), "d": ("x", 0.0)}),
    _scope("p", NEAR, {"w": ("P", 1.0)}),  # a speaker's intent
    _scope("P", REACH, {"h": ("H", 1.0)}),  # of harm
    _scope("H", REACH, {"t": ("threat", 1.0)}),  # to a target
    _scope("t", NEAR, {"w": ("W", 1.0)}),  # what a target shall do
    _scope("W", NEAR, {"d": ("threat", 1.0)}),  # is to die
    _scope("t", REACH, {"i": ("aimed", AIMED)}),
)
#: Weights that symbols of the lexicon bring, and those that the cascade's threats have beside them.
COUNTED = {"i", "aimed", "threat"}


class Grammar:
    """lexicon: word, beginning with a star, or beginning with a plus (for texts with two different words of it) -> weight above 0; classes: weights of the text's features."""

    def __init__(self, lexicon: dict[str, float], classes: list[float] | None = None):
        self.lexicon = lexicon
        self.words = {k: w for k, w in lexicon.items() if k[-1] not in "*+"}
        self.beginnings = {k[:-1]: w for k, w in lexicon.items() if k.endswith("*")}
        self.families = {k[:-1]: w for k, w in lexicon.items() if k.endswith("+")}
        self.sizes = sorted({len(k) for k in (*self.beginnings, *self.families)})
        self.marked = self.words.keys() | {w for w, symbol in CLOSED.items() if symbol in "hd"}
        self.starts = {k[: self.sizes[0]] for k in (*self.beginnings, *self.families)}
        self.classes = np.array(classes if classes is not None else PRIOR)
        self.hot: dict[str, tuple[bool, list[str]]] = {}
        self.cold: set[str] = set()

    def symbol(self, word: str, families: Container[str]) -> tuple[str, float]:
        """A word's symbol and weight in a text that has two different words of each of these families."""
        if (s := CLOSED.get(word)) and word not in self.words:
            return s, 0.0
        weight = self.words.get(word, 0.0)
        for k in self.sizes:
            weight = max(weight, self.beginnings.get(word[:k], 0.0), self.families.get(word[:k], 0.0) if word[:k] in families else 0.0)
        return ("i", weight) if weight else ("x", 0.0)

    def shown(self, words: Iterable[str]) -> set[str]:
        """Families of which two of these different words are."""
        found = Counter(w[:k] for w in words for k in self.sizes if len(w) > k and w[:k] in self.families)
        return {k for k, n in found.items() if n > 1}

    def clauses(self, text: str) -> list[tuple[float, bool]]:
        """(weight, whether it threatens) of each clause that weighs anything."""
        words = _TOKEN.findall(text.lower())
        families = self.shown({*words}) if self.families else ()
        symbols = {w: self.symbol(w, families) for w in {*words} if w[0] not in _ENDS}
        out: list[tuple[float, bool]] = []
        clause: list[tuple[str, float]] = []
        for word in (*words, "."):
            if word[0] not in _ENDS:
                clause.append(symbols[word])
                continue
            kinds = {s for s, _ in clause}
            if "i" in kinds or "w" in kinds and not kinds.isdisjoint("hd"):  # no other clause can weigh anything
                tape = clause
                for step in CASCADE:
                    tape = step(tape)
                weight, threat = 0.0, False
                for s, w in tape:
                    if s in COUNTED:
                        weight += THREAT if s == "threat" else w
                        threat = threat or s == "threat"
                if weight:
                    out.append((weight, threat))
            clause = []
        return out

    def features(self, text: str) -> list[float]:
        """1; the weight of the weightiest clause, to 1; the logarithm of what all weigh; whether one threatens."""
        used = {*text.lower().split()}
        if len(self.cold) > 300_000:
            self.cold.clear()
        for raw in used - self.cold - self.hot.keys():  # most texts need no more than this: none of their words can weigh
            core = raw.strip(_EDGES)
            words = [w for w in ([core] if core.isalpha() else _TOKEN.findall(raw)) if w in self.marked or self.starts and w[: self.sizes[0]] in self.starts]
            own, kin = any(self.symbol(w, ())[0] in "ihd" for w in words), [w for w in words if any(w[:k] in self.families for k in self.sizes)]
            if own or kin:
                self.hot[raw] = own, kin
            else:
                self.cold.add(raw)
        met = [self.hot[raw] for raw in used & self.hot.keys()]
        if not any(own for own, _ in met) and not self.shown({w for _, kin in met for w in kin}) or not (found := self.clauses(text)):
            return [1.0, 0.0, 0.0, 0.0]
        return [1.0, min(1.0, max(w for w, _ in found)), float(np.log1p(sum(w for w, _ in found))), float(any(t for _, t in found))]

    def score(self, texts: list[str]) -> np.ndarray:
        z = np.array([self.features(t) for t in texts]).reshape(len(texts), -1) @ self.classes
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def patterns(text: str) -> dict[str, tuple[int, int]]:
    """The words of a text and their beginnings, each with a hash of the words AROUND before and behind the first place that has it, and of the word there; a beginning's second word shows the family."""
    words = [w for w in _TOKEN.findall(text.lower()) if w[0] not in _ENDS]
    out: dict[str, tuple[int, int]] = {}
    for i, w in enumerate(words):
        if w not in out:
            place = zlib.crc32(f"{words[i - AROUND] if i >= AROUND else ''} {words[i + AROUND] if i + AROUND < len(words) else ''}".encode("utf-8", "replace"))
            own = zlib.crc32(w.encode("utf-8", "replace"))
            out[w] = place, own
            for k in BEGINNINGS:
                if len(w) > k and w[:k] + "*" in out:
                    out.setdefault(w[:k] + "+", (place, own))
                elif len(w) > k:
                    out[w[:k] + "*"] = place, own
    return out


def _counts(sample: DataFrame, text: str) -> DataFrame:
    """pattern, toxic and clean rows that have it, and forms: different words of the toxic ones; rows that have it at equal places, as copies do, count once. Counted within tasks first."""
    small_batches(sample.sparkSession)

    def run(batches):
        def out(found):
            keys, ys, places, forms = zip(*found, strict=True) if found else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ys, pa.int32()), pa.array(places, pa.int64()), pa.array(forms, pa.int64())], names=["pattern", "y", "place", "form"])

        found = set()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.update((k, y, *at) for k, at in patterns(t.decode("utf-8", "replace")).items())
                if len(found) > 300_000:
                    yield out(found)
                    found = set()
        yield out(found)

    rows = sample.select(F.coalesce(col(text).cast("binary"), F.lit(b"")), F.col("y")).mapInArrow(run, "pattern string, y int, place bigint, form bigint")
    toxic = F.when(F.col("y") == 1, F.col("form"))
    return rows.distinct().groupBy("pattern").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"), F.size(F.collect_set(toxic)).alias("forms"))


def evidence(toxic: Column, clean: Column, base: float) -> Column:
    """Chernoff's bound for toxic of toxic + clean rows, where rows are toxic with a chance of base: minus the logarithm of the probability of such a share or a larger one; 0 for a share below base."""
    p = toxic / (toxic + clean)
    part = lambda n, a, b: F.when(n > 0, n * F.log(a / b)).otherwise(0.0)
    return F.when(p > base, part(toxic, p, F.lit(base)) + part(clean, 1 - p, F.lit(1 - base))).otherwise(0.0)


def train(df: DataFrame, labels: DataFrame, *, row: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Grammar:
    """A grammar learned from at most rows labelled rows of df (those first by a hash of the row id).

    Rows without a label of 0 or 1 are left out; of several labels of a row the
    largest counts. The driver gets every pattern that the sample proves, each
    of which at least LEAST_ROWS toxic rows hold, and a few numbers a sampled
    row. With one class only, the lexicon is a short list of English insults and
    the class weights are fixed ones.
    """
    chosen = (
        labels.where(col(label).isin(0, 1) & col(row).isNotNull()).groupBy(col(row).alias("row")).agg(F.max(col(label)).cast("int").alias("y"))
        .orderBy(F.xxhash64("row"), "row").limit(rows)
    )
    (text_of,) = free(chosen, "text_of")
    sample = df.select(col(row).alias("row"), col(text).alias(text_of)).join(F.broadcast(chosen), "row")  # at most rows rows of two numbers
    n1, n = chosen.agg(F.sum("y"), F.count("*")).first()
    if not n or n1 in (0, n):
        return Grammar(dict.fromkeys(_SEED.split(), 1.0))
    share = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1)
    sure = evidence(F.col("toxic"), F.col("clean"), n1 / n) >= -np.log(CHANCE)
    changing = ~F.right("pattern", F.lit(1)).isin("*", "+") | (F.col("forms") >= FORMS)
    found = _counts(sample, text_of).where((F.col("toxic") >= LEAST_ROWS) & (share >= LEAST_SHARE) & sure & changing).collect()
    rows_of = {r.pattern: r.toxic for r in found}
    # Of beginnings that stand for the same rows, the longest: a short one meets more words that no row had.
    weight = {r.pattern: (r.toxic + 0.5) / (r.toxic + r.clean + 1) for r in found if not _longer(r.pattern, rows_of)}
    grammar = Grammar(dict.fromkeys(_SEED.split(), 0.5) | weight)
    x, y = _sampled(sample, text_of, grammar)
    grammar.classes = _regression(x, y)
    return grammar


def _longer(pattern: str, rows_of: dict[str, int]) -> bool:
    """Whether longer beginnings of the lexicon have, together, all the rows of this one."""
    own, kind = pattern[:-1], pattern[-1]
    if kind not in "*+":
        return False
    return sum(n for k, n in rows_of.items() if k[-1] == kind and len(k) == len(pattern) + 1 and k.startswith(own)) >= rows_of[pattern]


def _sampled(sample: DataFrame, text: str, grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    def start():
        return lambda texts: {"x": [np.array(grammar.features(t.decode("utf-8", "replace"))).tobytes() for t in texts]}

    rows = map_text(sample, col(text), {"y": F.col("y")}, {"x": "binary"}, start).toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float64).reshape(rows.num_rows, -1)
    order = np.lexsort(x.T)  # the sums come out the same whatever the order of the rows
    return x[order], np.array(rows["y"].to_pylist(), np.float64)[order]


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to PRIOR, so that what the sample lacks still counts."""
    prior, ridge = np.array(PRIOR), np.array(RIDGE)
    w = prior.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge * (w - prior))
        w = w - np.clip(step, -1, 1)
    return w


def score(df: DataFrame, grammar: Grammar, *, keep: dict[str, Column], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """keep's columns, score (0 to 1) and predicted (1 from the threshold on) for each row of df, over the whole text.

    Null and empty texts match nothing and get the score of a text without
    matches. Equal texts get equal scores; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast((grammar.lexicon, grammar.classes.tolist()))

    def start():
        own = Grammar(*shared.value)

        def work(texts: list[bytes]) -> dict:
            s = own.score([t.decode("utf-8", "replace") for t in texts])
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

        return work

    return map_text(df, col(text), keep, {"score": "double", "predicted": "int"}, start)
