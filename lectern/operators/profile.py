"""Validation and profile of a corpus of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources.articles import POSITION


def checks(articles: DataFrame, position: str = POSITION) -> DataFrame:
    """articles with one flag per check. An id counts as seen even on a row that fails another check."""
    blank = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    missing = F.coalesce(F.col("id"), F.lit("")) == ""
    # The first place of an id by a combining aggregate, so that a frequent id costs no sort.
    first = articles.where(~missing).groupBy("id").agg(F.min(position).alias("first_pos"))
    seen = articles.join(first, "id", "left").withColumn("duplicate_id", F.coalesce(F.col(position) > F.col("first_pos"), F.lit(False))).drop("first_pos")
    flagged = seen.withColumns({"missing_id": missing, "empty_article": blank("article"), "empty_highlights": blank("highlights")})
    return flagged.withColumn("valid", ~(F.col("missing_id") | F.col("duplicate_id") | F.col("empty_article") | F.col("empty_highlights")))


def validation(articles: DataFrame, position: str = POSITION) -> DataFrame:
    """One row: counts of rows that pass and of each failed check; a row may count in several."""
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0))
    return checks(articles, position).agg(
        F.count("*").alias("total"), count("valid").alias("valid"), (F.count("*") - count("valid")).alias("invalid"), count("missing_id").alias("missing_ids"),
        count("duplicate_id").alias("duplicate_ids"), count("empty_article").alias("empty_articles"), count("empty_highlights").alias("empty_highlights"),
    )


def valid_rows(articles: DataFrame, position: str = POSITION) -> DataFrame:
    return checks(articles, position).where("valid").select(*articles.columns)


def first_of_text(documents: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows whose text comes first by row id among equal texts, which are those with equal SHA-256: no text is shuffled for the comparison."""
    marked = documents.withColumn("_digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withColumn("_none", F.col(text).isNull())
    first = marked.groupBy("_digest", "_none").agg(F.min(row).alias("_first"))
    return marked.join(first, ["_digest", "_none"]).where(F.col(row) == F.col("_first")).drop("_digest", "_none", "_first")


def figures(articles: DataFrame) -> DataFrame:
    """id and, per article: words, sentences, words and sentences of the highlights, compression, tokens, distinct tokens, ttr."""
    measured = articles.select(
        "id", F.size(T.words(F.col("article"))).alias("article_words"), F.size(T.light_sentences(F.col("article"))).alias("article_sentences"),
        F.size(T.words(F.col("highlights"))).alias("highlight_words"), F.size(T.light_sentences(F.col("highlights"))).alias("highlight_sentences"), T.richness_tokens(F.col("article")).alias("t"),
    )
    ratio = F.round(F.coalesce(F.try_divide("highlight_words", "article_words"), F.lit(0.0)), 4)
    return measured.withColumn("compression_ratio", ratio).withColumn("tokens", F.size("t")).withColumn("unique_words", F.size(F.array_distinct("t"))).withColumn("ttr", F.round(F.coalesce(F.try_divide("unique_words", "tokens"), F.lit(0.0)), 4)).drop("t")


def describe(rows: DataFrame, column: str, digits: int = 2) -> list[Column]:
    """Smallest, largest, mean, median and population deviation; zeros over nothing."""
    c = F.col(column)
    parts = {"min": F.min(c), "max": F.max(c), "mean": F.avg(c), "median": F.median(c), "std": F.stddev_pop(c)}
    return [F.round(F.coalesce(v.cast("double"), F.lit(0.0)), 4 if k in ("min", "max") else digits).alias(f"{column}_{k}") for k, v in parts.items()]


def profile(articles: DataFrame) -> DataFrame:
    """The whole corpus in one aggregate."""
    rows = figures(articles)
    counted = [x for c in ("article_words", "article_sentences", "highlight_words", "highlight_sentences", "unique_words") for x in describe(rows, c)]
    return rows.agg(F.count("*").alias("articles"), *counted, *describe(rows, "compression_ratio", 4), *describe(rows, "ttr", 4))


def annotation_profile(annotated: DataFrame) -> DataFrame:
    """Per article: sentences, tokens, content tokens, stop words, entities; and tokens that lower-casing changes. One row over all; none over no articles."""
    s = F.coalesce("processed_sentences", F.array())
    total = lambda f: F.aggregate(F.transform(s, f), F.lit(0), lambda a, b: a + b)
    size = lambda x: F.greatest(F.lit(0), F.coalesce(F.size(x), F.lit(0)))
    rows = annotated.select(
        F.size(s).alias("sentences"), total(lambda x: size(x["tokens"])).alias("tokens"), total(lambda x: size(x["content_tokens"])).alias("content_tokens"),
        total(lambda x: size(F.filter(x["token_details"], lambda t: t["is_stop"]))).alias("stop_words"), total(lambda x: size(x["entities"])).alias("entities"),
        total(lambda x: size(F.filter(x["tokens"], lambda t: F.lower(t) != t))).alias("changed"),
    )
    each = [f(F.col(c)).alias(f"{c}_{k}") for c in ("sentences", "tokens", "content_tokens", "stop_words", "entities") for k, f in {"mean": lambda x: F.round(F.avg(x), 2), "median": F.median, "min": F.min, "max": F.max}.items()]
    percent = F.round(F.coalesce(F.try_divide(100 * F.sum("changed"), F.sum("tokens")), F.lit(0.0)), 2)
    return rows.agg(F.count("*").alias("articles"), *each, F.sum("changed").alias("changed"), percent.alias("changed_percent")).where("articles > 0")


