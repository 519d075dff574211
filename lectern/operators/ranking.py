"""Sentence ranking as relations: one row per sentence and term, aggregates and windows.

Every plan first deals the articles, one row each, by their key. All that
follows groups and windows by keys that begin with it, so there is one shuffle
per plan, and it moves raw articles, not tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "doc_id"


def dealt(articles: DataFrame, key: str = KEY) -> DataFrame:
    """articles by the hash of their key.

    In Spark 4.1 a union of two plans dealt alike passes for dealt itself, and
    with partitions coalesced at run time rows of one key then miss each other.
    So that is switched off in any session that runs these plans.
    """
    articles.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return articles.repartition(key)


def sentence_rows(articles: DataFrame, sentences: Column, key: str = KEY) -> DataFrame:
    """key, n (the article's sentences), idx, text."""
    return dealt(articles, key).select(key, F.posexplode(sentences).alias("idx", "text"), F.size(sentences).alias("n"))


def term_rows(articles: DataFrame, sentences: Column, content, key: str = KEY) -> DataFrame:
    """key, n, idx, term, m: occurrences of each term in each sentence; a sentence without content has one row with a null term and m of 0."""
    rows = dealt(articles, key).select(key, sentences.alias("ss")).select(key, F.size("ss").alias("n"), F.posexplode("ss").alias("idx", "text"))
    terms = rows.select(key, "n", "idx", F.explode_outer(content(F.col("text"))).alias("term"))
    return terms.groupBy(key, "n", "idx", "term").agg(F.count("term").alias("m"))


def frequency_scores(terms: DataFrame, key: str = KEY) -> DataFrame:
    """key, idx, score: the mean, over a sentence's content tokens, of count / largest count (6 decimals); 0 without content."""
    by_term = Window.partitionBy(key, "term")
    counted = terms.withColumn("c", F.sum("m").over(by_term)).withColumn("most", F.max("c").over(Window.partitionBy(key)))
    # Whole millionths, so that neither the order of the sum nor the halves of the last rounding depend on the engine.
    share = F.when(F.col("m") > 0, F.round(F.round(F.col("c") / F.col("most"), 6) * 1000000).cast("bigint"))
    sums = counted.groupBy(key, "idx").agg(F.sum(F.col("m") * share).alias("s"), F.sum("m").alias("l"))
    mean = F.when(F.col("l") > 0, F.expr("(2 * s + l) div (2 * l)") / 1000000)
    return sums.select(key, "idx", F.coalesce(mean, F.lit(0.0)).alias("score"))


def frequency_top_words(terms: DataFrame, k: int = 10, key: str = KEY) -> DataFrame:
    counted = terms.where("m > 0").groupBy(key, "term").agg(F.sum("m").alias("frequency"))
    most = counted.withColumn("normalized_frequency", F.round(F.col("frequency") / F.max("frequency").over(Window.partitionBy(key)), 6))
    ranked = most.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("frequency"), "term")))
    return ranked.where(F.col("rank") <= k)


def idf(n: Column, df: Column, smooth: bool = False) -> Column:
    """Natural logarithm of sentences per sentence with the term, at least 0; smoothed, of one more."""
    return F.ln(1 + n / df) if smooth else F.greatest(F.lit(0.0), F.ln(n / df))


def weights(terms: DataFrame, smooth: bool = False, key: str = KEY) -> DataFrame:
    """The rows of terms with len (a sentence's content tokens), df, idf and w = tf * idf."""
    found = terms.withColumn("len", F.sum("m").over(Window.partitionBy(key, "idx"))).withColumn("df", F.count("term").over(Window.partitionBy(key, "term")))
    found = found.withColumn("idf", F.when(F.col("m") > 0, idf(F.col("n"), F.col("df"), smooth)))
    return found.withColumn("w", F.col("m") / F.nullif("len", F.lit(0)) * F.col("idf"))


def tfidf_scores(terms: DataFrame, smooth: bool = False, key: str = KEY) -> DataFrame:
    """key, idx, len, score: the sum of tf * idf over a sentence's distinct terms, divided by its content tokens once more."""
    scored = weights(terms, smooth, key).groupBy(key, "idx").agg(F.max("len").alias("len"), F.sum("w").alias("s"))
    return scored.select(key, "idx", "len", F.round(F.coalesce(F.try_divide("s", "len"), F.lit(0.0)), 6).alias("score"))


def tfidf_top_terms(terms: DataFrame, k: int = 10, smooth: bool = False, key: str = KEY) -> DataFrame:
    """The article's terms of largest tf * idf, tf over the whole article."""
    found = terms.where("m > 0").groupBy(key, "n", "term").agg(F.sum("m").alias("m"), F.count("*").alias("df"))
    found = found.withColumn("tf", F.col("m") / F.sum("m").over(Window.partitionBy(key))).withColumn("idf", idf(F.col("n"), F.col("df"), smooth))
    found = found.withColumn("tfidf", F.round(F.col("tf") * F.col("idf"), 6))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("tfidf"), "term")))
    return ranked.where(F.col("rank") <= k).select(key, "rank", "term", "tfidf", F.round("tf", 6).alias("tf"), "df", F.round("idf", 6).alias("idf"))


def ranked(scores: DataFrame, *order: Column, key: str = KEY) -> DataFrame:
    """Scores with rank: score descending, then what order says, then sentence order."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), *order, "idx")))


def top(ranking: DataFrame, k: int) -> DataFrame:
    """The first k sentences of each article; one, if k is less."""
    return ranking.where(F.col("rank") <= max(1, k))


def summary_text(chosen: DataFrame, sentences: DataFrame, key: str = KEY) -> DataFrame:
    """key, summary: the chosen sentences' texts in sentence order, joined by a space."""
    texts = chosen.select(key, "idx").join(sentences.select(key, "idx", "text"), [key, "idx"])
    listed = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return texts.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("summary"))


def similarity_edges(terms: DataFrame, key: str = KEY) -> DataFrame:
    """key, i, j (i < j), cosine: sentences with shared weighted terms; pairs without any have no row.

    An equi-join of an article's sentences on their terms, in the form of a list
    per article and term that is paired with itself: the weighted rows are made
    once and nothing is shuffled again. A list is as long as the article has
    sentences with that term, and words that are in every sentence weigh nothing.
    """
    w = weights(terms, key=key).where("w > 0").select(key, "idx", "term", "w")
    w = w.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key, "idx"))))
    lists = w.groupBy(key, "term").agg(F.sort_array(F.collect_list(F.struct("idx", (F.col("w") / F.col("norm")).alias("u")))).alias("l")).where(F.size("l") > 1)
    pairs = lists.select(key, "l", F.posexplode("l").alias("at", "x")).select(key, "x", F.explode(F.slice("l", F.col("at") + 2, F.size("l"))).alias("y"))
    dots = pairs.groupBy(key, F.col("x.idx").alias("i"), F.col("y.idx").alias("j")).agg(F.sum(F.col("x.u") * F.col("y.u")).alias("dot"))
    return dots.select(key, "i", "j", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dot"))).alias("cosine"))


def mirrored(edges: DataFrame, key: str = KEY) -> DataFrame:
    return edges.union(edges.select(key, F.col("j").alias("i"), F.col("i").alias("j"), "cosine"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int, damping: float = 0.85, key: str = KEY) -> DataFrame:
    """key, idx, score after a fixed number of steps over symmetric edges.

    An article's graph is folded into one row (its links as arrays), and all
    steps run on that row in numpy: no shuffle per step, no growing lineage.
    operators.summaries has the form that stops by itself.
    """
    links = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "j", "cosine"))).alias("e"))
    part = lambda name: F.transform("e", lambda x: x[name]).alias(name)
    folded = nodes.groupBy(key).agg((F.max("idx") + 1).alias("n")).join(links, key, "left").select(key, "n", part("i"), part("j"), part("cosine"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for n, i, j, w in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                i, j, w = (np.array(x or [], t) for x, t in ((i, np.int64), (j, np.int64), (w, np.float64)))
                source, target, w = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
                out = np.bincount(source, w, n)
                loose, share = out == 0, w / out[source]
                s = np.full(n, 1 / n)
                for _ in range(iterations):
                    s = (1 - damping) / n + damping * np.bincount(target, share * s[source], n) + damping * s[loose].sum() / n
                found.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], names=[key, "s"])

    kind = folded.schema[key].dataType.simpleString()
    return folded.mapInArrow(run, f"`{key}` {kind}, s array<double>").select(key, F.posexplode("s").alias("idx", "score"))
