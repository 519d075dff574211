"""Summaries in row-local form: an annotated article in, its summary out.

Nothing is shuffled, so the same functions run over batches and streams. Each
article depends on itself alone; its figures are rounded as Python rounds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern import schemas

METHODS = ("frequency", "tfidf", "textrank")
#: Articles that are Python objects at a time.
AT_ONCE = 64


def _content(sentence: dict) -> list[str]:
    return [w.strip().lower() for w in sentence["content_tokens"] or () if w and w.strip()]


def rank_frequency(contents: list[list[str]]) -> tuple[list[float], list[dict]]:
    """Scores, and the ten most frequent words."""
    counts = Counter(w for c in contents for w in c)
    most = max(counts.values(), default=1)
    share = {w: round(n / most, 6) for w, n in counts.items()}
    scores = [round(sum(share[w] for w in c) / len(c), 6) if c else 0.0 for c in contents]
    first = sorted(counts, key=lambda w: (-counts[w], w))[:10]
    return scores, [{"term": w, "frequency": counts[w], "normalized_frequency": share[w]} for w in first]


def inverse_frequencies(contents: list[list[str]], smooth: bool = False) -> tuple[dict[str, int], dict[str, float]]:
    """Sentences with each term, and the logarithm of all sentences per such sentence."""
    df = Counter(w for c in contents for w in set(c))
    n = len(contents)
    return df, {w: log(1 + n / k) if smooth else max(0.0, log(n / k)) for w, k in df.items()}


def rank_tfidf(contents: list[list[str]], smooth: bool = False) -> tuple[list[float], list[dict]]:
    df, idf = inverse_frequencies(contents, smooth)
    scores = [round(sum(n / len(c) * idf[w] for w, n in Counter(c).items()) / len(c), 6) if c else 0.0 for c in contents]
    counts = Counter(w for c in contents for w in c)
    total = sum(counts.values())
    weight = {w: n / total * idf[w] for w, n in counts.items()}
    first = sorted(weight, key=lambda w: (-weight[w], w))[:10]
    return scores, [{"term": w, "tfidf": round(weight[w], 6), "tf": round(counts[w] / total, 6), "df": df[w], "idf": round(idf[w], 6)} for w in first]


def similarity(contents: list[list[str]]) -> np.ndarray:
    """Cosines of the sentences' TF-IDF vectors, zeros on the diagonal."""
    _, idf = inverse_frequencies(contents)
    column = {w: k for k, w in enumerate(w for w, v in idf.items() if v > 0)}
    x = np.zeros((len(contents), max(1, len(column))))
    for r, c in enumerate(contents):
        for w, n in Counter(c).items():
            if w in column:
                x[r, column[w]] = n / len(c) * idf[w]
    norm = np.sqrt((x * x).sum(1))
    x /= np.where(norm > 0, norm, 1)[:, None]
    out = np.clip(x @ x.T, 0, 1)
    out[out < 1e-15] = 0
    np.fill_diagonal(out, 0)
    return out


def links(contents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sentences' unit TF-IDF vectors, entry by entry: sentence, term, weight. Terms of a single sentence count for its length alone, as they link nothing."""
    df, idf = inverse_frequencies(contents)
    column: dict[str, int] = {}
    rows, terms, weights = [], [], []
    for r, c in enumerate(contents):
        own = [(w, n / len(c) * idf[w]) for w, n in Counter(c).items() if idf[w] > 0]
        norm = sqrt(sum(v * v for _, v in own))
        for w, v in own:
            if df[w] > 1:
                rows.append(r)
                terms.append(column.setdefault(w, len(column)))
                weights.append(v / norm)
    return np.array(rows, np.int64), np.array(terms, np.int64), np.array(weights, np.float64)


def pagerank(graph: np.ndarray, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, int, bool, float]:
    """Scores, steps made, whether the last step changed less than tolerance in all, and that change."""
    return _steps(graph.sum(1), lambda s: s @ graph, damping, iterations, tolerance)


def rank_graph(contents: list[list[str]], damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, int, bool, float]:
    """pagerank of similarity, without that matrix: a step goes from sentences to terms and back, so time and memory grow with the text and not with its square."""
    n, (rows, terms, u) = len(contents), links(contents)

    def spread(s: np.ndarray) -> np.ndarray:
        own = u * s[rows]
        return np.bincount(rows, u * (np.bincount(terms, own)[terms] - own), n)  # what a term has from the other sentences

    return _steps(spread(np.ones(n)), spread, damping, iterations, tolerance)


def _steps(out: np.ndarray, spread: Callable[[np.ndarray], np.ndarray], damping: float, iterations: int, tolerance: float) -> tuple[np.ndarray, int, bool, float]:
    """The steps of pagerank over nodes with out as their links' sums; spread takes what nodes give along links of weight 1 to what nodes get."""
    n = len(out)
    if n == 0:
        return np.zeros(0), 0, True, 0.0
    if n == 1:
        return np.ones(1), 1, True, 0.0
    loose = out <= 0
    share = np.where(loose, 0, 1 / np.where(loose, 1, out))
    s, k, change = np.full(n, 1 / n), 0, 0.0
    while k < iterations:
        k += 1
        new = (1 - damping) / n + damping * spread(s * share) + damping * s[loose].sum() / n
        change = float(np.abs(new - s).sum())
        s = new
        if change < tolerance:
            return s, k, True, change
    return s, k, False, change


def summarize_record(record: dict, method: str, k: int = 3, *, smooth: bool = False, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> dict:
    """The summary of one annotated article, with SUMMARY's fields."""
    sentences = [s for s in record["processed_sentences"] or () if s]
    where = [s["sentence_index"] if s["sentence_index"] is not None else i if method == "textrank" else 0 for i, s in enumerate(sentences)]
    contents, terms, ranking, metadata = [_content(s) for s in sentences], None, None, None
    row = record["id"] or "" if method == "frequency" else record["id"] or record.get("article_id") or ""
    digits = 4
    if method == "frequency":
        scores, terms = rank_frequency(contents)
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], where[i]))
    elif method == "tfidf":
        scores, terms = rank_tfidf(contents, smooth)
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], not contents[i], where[i]))
    else:
        values, made, done, change = rank_graph(contents, damping, iterations, tolerance)
        scores, digits = values.tolist(), 6
        # Ties come out of sums in different orders: what agrees to 12 decimals is one score.
        order = sorted(range(len(scores)), key=lambda i: (-round(scores[i], 12), where[i]))
        ranking = [{"sentence_index": where[i], "textrank_score": round(scores[i], 6)} for i in order]
        metadata = {"number_of_sentences": len(scores), "damping_factor": damping, "max_iterations": iterations, "tolerance": tolerance, "iterations": made, "converged": done, "final_difference": round(change, 8)}
    chosen = sorted(order[: max(1, min(k, len(order)))], key=lambda i: where[i])
    return {
        "id": row, "article_id": row, "method": method, "num_sentences_requested": k, "num_sentences_selected": len(chosen),
        "summary": " ".join(sentences[i]["original_text"] or "" for i in chosen),
        "selected_sentences": [{"sentence_index": where[i], "score": round(scores[i], digits), "original_text": sentences[i]["original_text"] or "", "content_words": sentences[i]["content_tokens"] or []} for i in chosen],
        "highlights": record.get("highlights") or "", "top_terms": terms, "ranking": ranking, "metadata": metadata,
    }


def method_named(method: str) -> str:
    if (found := method.strip().lower()) not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
    return found


def summarize(articles: DataFrame, method: str = "frequency", k: int = 3, **options) -> DataFrame:
    """SUMMARY rows of annotated articles, by one method; batch or stream.

    articles has id, processed_sentences and perhaps article_id and highlights.
    Only the sentences' index, text and content tokens reach Python.
    """
    method = method_named(method)
    have = {f.name for f in articles.schema["processed_sentences"].dataType.elementType.fields}
    field = lambda s, name, kind: s[name] if name in have else F.lit(None).cast(kind)
    pruned = F.transform("processed_sentences", lambda s: F.struct(field(s, "sentence_index", "int").alias("sentence_index"), field(s, "original_text", "string").alias("original_text"), field(s, "content_tokens", "array<string>").alias("content_tokens")))
    other = [F.col(c).cast("string").alias(c) if c in articles.columns else F.lit(None).cast("string").alias(c) for c in ("article_id", "highlights")]
    schema = T._parse_datatype_string(schemas.SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):
                yield pa.RecordBatch.from_pylist([summarize_record(r, method, k, **options) for r in b.slice(i, AT_ONCE).to_pylist()], schema=arrow)

    return articles.select(F.col("id").cast("string").alias("id"), pruned.alias("processed_sentences"), *other).mapInArrow(run, schema)


def batch_metrics(summaries: DataFrame, method: str) -> DataFrame:
    """One row over a batch of summaries; over none, the zero row (frequency: an error when it is read, as a smallest value is asked for)."""
    s = summaries.withColumn("words", F.size(F.filter(F.split("summary", r"\s+"), lambda w: w != "")))
    n, w = F.col("num_sentences_selected"), F.col("words")
    common = [F.count("*").alias("articles"), F.round(F.avg(n), 2).alias("mean_selected"), F.round(F.avg(w), 2).alias("mean_words"), F.min(w).alias("min_words"), F.max(w).alias("max_words")]
    if method_named(method) == "frequency":
        return s.agg(*common, F.median(n).alias("median_selected"), F.min(n).alias("min_selected"), F.max(n).alias("max_selected"), F.median(w).alias("median_words"))
    more = [F.sum(n).alias("total_selected"), F.sum(w).alias("total_words")]
    if method_named(method) == "textrank":
        more += [F.round(F.avg("metadata.iterations"), 2).alias("mean_iterations"), F.sum(F.col("metadata.converged").cast("int")).alias("converged")]
    return s.agg(*common, *more)
