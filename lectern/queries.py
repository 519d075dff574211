"""Queries of the library's own operators over whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import text as T
from lectern.functions.annotate import from_text
from lectern.operators import compare, known, profile, ranking, rouge, store, summaries, vectors
from lectern.sources.articles import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.term_rows(table(spark, sf_dir, "documents"), T.sentences(F.col("text")), T.portable_content)


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TOKENS = f"regexp_extract_all(lower(coalesce({{0}}, '')), '{T.PORTABLE_TOKEN.replace(chr(39), chr(39) * 2)}')"
_CONTENT = "list_filter(" + _TOKENS + f", lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))"
_SENT = r"""ss AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
sent AS (SELECT doc_id, len(s) AS n, unnest(range(len(s))) AS idx, unnest(s) AS text FROM ss)"""
_TERM = _SENT + f""",
tok AS (SELECT doc_id, n, idx, unnest({_CONTENT.format("text")}) AS term FROM sent),
g AS (SELECT doc_id, n, idx, term, count(*) AS m FROM tok GROUP BY ALL)"""
_FREQ = _TERM + """,
c AS (SELECT *, sum(m) OVER (PARTITION BY doc_id, term) AS c FROM g),
nf AS (SELECT *, round(c / max(c) OVER (PARTITION BY doc_id), 6) AS nf FROM c),
sc AS (SELECT doc_id, idx, CAST((2 * sum(m * CAST(round(nf * 1000000) AS BIGINT)) + sum(m)) // (2 * sum(m)) AS BIGINT) / 1000000 AS s FROM nf GROUP BY ALL),
score AS (SELECT sent.doc_id, sent.idx, coalesce(s, 0.0) AS score FROM sent LEFT JOIN sc USING (doc_id, idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank FROM score)"""


def _weighted(idf: str) -> str:
    return _TERM + f""",
w AS (SELECT *, sum(m) OVER (PARTITION BY doc_id, idx) AS len, count(*) OVER (PARTITION BY doc_id, term) AS df FROM g),
ww AS (SELECT *, m / len * {idf} AS w FROM w)"""


def _tfidf(idf: str) -> str:
    return _weighted(idf) + """,
sc AS (SELECT doc_id, idx, max(len) AS len, sum(w) / max(len) AS s FROM ww GROUP BY ALL),
score AS (SELECT sent.doc_id, sent.idx, round(coalesce(s, 0.0), 6) AS score, len FROM sent LEFT JOIN sc USING (doc_id, idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, (len IS NULL), idx) AS rank FROM score)"""


_PLAIN, _SMOOTH = "greatest(0.0, ln(n / df))", "ln(1 + n / df)"

# Profile and validation.


@query(r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents""")
def profile_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("bigint").alias("words"))


def _whole_words(text: str) -> str:
    """SQL: the lower-cased text, where each word with a letter that is not ASCII is one control character, so that ASCII's word boundaries are Unicode's."""
    return f"array_to_string(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[\\pL\\pM\\pN_]+|[^\\pL\\pM\\pN_]+'), lambda x: CASE WHEN regexp_matches(x, '^[\\pL\\pM\\pN_]') AND strlen(x) <> length(x) THEN chr(1) ELSE x END), '')"


_OVERLAP = "regexp_extract_all(" + _whole_words("{0}") + r", '\b[a-zA-Z0-9]+(?:[''\-_][a-zA-Z0-9]+)*\b')"


@query(f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_distinct(t)) AS BIGINT) AS unique_words, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_distinct(t)) / len(t) END, 6) AS ttr
FROM (SELECT doc_id, regexp_extract_all({_whole_words("text")}, '\\b[a-zA-Z0-9]+(?:''[a-zA-Z0-9]+)?\\b') AS t FROM documents)""")
def profile_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.richness_tokens(F.col("text")).alias("t"))
    n, u = F.size("t").cast("bigint"), F.size(F.array_distinct("t")).cast("bigint")
    return t.select("doc_id", n.alias("tokens"), u.alias("unique_words"), F.round(F.coalesce(F.try_divide(u, n), F.lit(0.0)), 6).alias("ttr"))


@query(r"""WITH w AS (SELECT lang, len(list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '')) AS n FROM documents)
SELECT lang, CAST(min(n) AS DOUBLE) AS words_min, CAST(max(n) AS DOUBLE) AS words_max, round(avg(n), 2) AS words_mean, CAST(median(n) AS DOUBLE) AS words_median, round(stddev_pop(n), 2) AS words_std FROM w GROUP BY lang""")
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.size(T.words(F.col("text"))).alias("words"))
    return rows.groupBy("lang").agg(*profile.describe(rows, "words"))


@query(f"WITH {_SENT} SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences FROM ss")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("sentences"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the source stands for an id that repeats, the language for highlights."""
    return table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", F.col("n_chars").cast("string")).alias("id"), F.col("text").alias("article"), F.nullif("lang", F.lit("fr")).alias("highlights"), F.struct(F.lit("").alias("file"), F.col("doc_id").alias("line")).alias("input_pos"))


@query("""WITH r AS (SELECT concat_ws('-', source, CAST(n_chars AS VARCHAR)) AS id, text, nullif(lang, 'fr') AS h, doc_id FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) > 1 AS dup, coalesce(id, '') = '' AS miss, trim(coalesce(text, '')) = '' AS ea, trim(coalesce(h, '')) = '' AS eh FROM r)
SELECT count(*) AS total, count(*) FILTER (NOT (miss OR dup OR ea OR eh)) AS valid, count(*) FILTER (miss OR dup OR ea OR eh) AS invalid, count(*) FILTER (miss) AS missing_ids, count(*) FILTER (dup AND NOT miss) AS duplicate_ids, count(*) FILTER (ea) AS empty_articles, count(*) FILTER (eh) AS empty_highlights FROM f""")
def validate_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.validation(_articles(spark, sf_dir))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.first_of_text(table(spark, sf_dir, "documents")).select("doc_id", "source")


@query("""SELECT CAST(conv_id AS VARCHAR) AS id, min(turn) AS first_turn, max(turn) AS last_turn, arg_max(role, (turn, role, text)) AS role, arg_max(text, (turn, role, text)) AS text FROM conversations GROUP BY conv_id""")
def keyed_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.sources.articles import keyed_load

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role", "text", F.struct("turn", "role", "text").alias("input_pos"), F.col("turn"))
    return keyed_load(rows).select("id", F.col("input_pos.turn").alias("first_turn"), F.col("turn").alias("last_turn"), "role", "text")


# Text functions.


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM documents")
def whitespace_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("digest"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def token_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select(F.explode(T.portable_tokens(F.col("text"))).alias("t"))
    return tokens.select(T.normalize_token(F.col("t")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, md5(regexp_replace(replace(regexp_replace(regexp_replace(html, '(?i)</?(?:p|div|br|hr|li|tr|h[1-6]|blockquote|article|section)\b[^>]*>', ' ', 'g'), '<[a-zA-Z/][^>]*>', '', 'g'), chr(160), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS digest FROM pages""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_html(F.col("html"), decode=False)).alias("digest"))


@query()
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_text(T.clean_html(F.col("html"))).alias("text"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_unicode(F.col("text"))).alias("digest"))


@query(rf"""SELECT doc_id, CAST(len(c) AS BIGINT) AS n, md5(array_to_string(c, ' ')) AS digest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: lower(x)), lambda x: regexp_matches(x, '[\pL\pN]') AND NOT list_contains({_STOP}, x)) AS c FROM documents)""")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.content_tokens(T.words(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", F.size("c").cast("bigint").alias("n"), F.md5(F.array_join("c", " ")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_OVERLAP.format('text')} AS t FROM documents)")
def overlap_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.overlap_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"""WITH x AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+')) AS w FROM documents) SELECT doc_id, count(*) FILTER (list_contains({_STOP}, lower(w))) AS stop_words FROM x GROUP BY doc_id""")
def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(T.words(F.col("text")), lambda w: T.is_stopword(w))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("bigint").alias("stop_words"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM documents")
def text_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


_FIGURES = rf"""f AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '')) AS BIGINT) AS w,
CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS BIGINT) AS n,
regexp_extract_all({_whole_words("text")}, '\b[a-zA-Z0-9]+(?:''[a-zA-Z0-9]+)?\b') AS t FROM documents),
ft AS (SELECT doc_id, w, n, len(list_distinct(t)) AS u, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_distinct(t)) / len(t) END, 4) AS ttr, round(CASE WHEN w > 0 THEN 1.0 / w ELSE 0.0 END, 4) AS c FROM f)"""


def _plain_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("article"), F.col("lang").alias("highlights"))


@query(f"WITH {_FIGURES} SELECT doc_id AS id, CAST(w AS INT) AS article_words, CAST(n AS INT) AS article_sentences, c AS compression_ratio, ttr FROM ft")
def article_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.figures(_plain_articles(spark, sf_dir)).select("id", "article_words", "article_sentences", "compression_ratio", "ttr")


@query(f"WITH {_FIGURES} SELECT count(*) AS articles, CAST(max(w) AS DOUBLE) AS article_words_max, round(avg(w), 2) AS article_words_mean, CAST(median(w) AS DOUBLE) AS article_words_median, round(avg(n), 2) AS article_sentences_mean, round(stddev_pop(n), 2) AS article_sentences_std, round(avg(u), 2) AS unique_words_mean FROM ft")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(_plain_articles(spark, sf_dir)).select("articles", "article_words_max", "article_words_mean", "article_words_median", "article_sentences_mean", "article_sentences_std", "unique_words_mean")


# What the browser side computes.


@query(r"""WITH x AS (SELECT doc_id, lang, source, text, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INT) AS words, CAST(length(text) AS INT) AS characters, left(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[1], 120) AS title,
left(regexp_split_to_array(regexp_replace(text, '([.!?])\s', '\1' || chr(1), 'g'), chr(1))[1], 240) AS example,
CASE WHEN len(w) % 10 >= 6 THEN 'strong' WHEN (len(w) % 10) / 10 >= 0.35 THEN 'moderate' WHEN (len(w) % 10) / 10 >= 0.15 THEN 'weak' ELSE 'little' END AS verdict,
CASE WHEN len(w) > 0 THEN CAST(floor(100.0 * 3 / len(w) + 0.5) AS INT) END AS compression,
md5(regexp_replace(text, '(?i)(th)', '<mark>\1</mark>', 'g')) AS marked, contains(lower(concat_ws(' ', source, lang)), 'e') AS shown, CASE WHEN lang = 'en' THEN ['b'] WHEN lang = 'b' THEN ['en'] ELSE [lang, 'b'] END AS chips FROM x""")
def ui_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    n = F.size(T.words(text))
    none = F.lit(None).cast("string")
    item = F.struct(F.col("source").alias("term"), F.col("lang").alias("normalized_form"), none.alias("lemma"), none.alias("pos"), none.alias("entity_label"))
    chips = T.ui_new_chips(F.concat(F.lit(" "), "lang", F.lit(",b \n"), "lang", F.lit(",,B")), F.array(F.lit("EN")))
    stats = T.ui_statistics(text)
    return docs.select(
        "doc_id", stats["words"].alias("words"), stats["characters"].alias("characters"), T.ui_title(text).alias("title"), T.ui_example(text).alias("example"), T.ui_verdict(n % 10 / 10).alias("verdict"), T.ui_compression(F.lit(3), n).alias("compression"),
        F.md5(T.ui_highlight(text, " th ")).alias("marked"), T.ui_item_matches(item, " E ").alias("shown"), chips.alias("chips"),
    )


# Readers and writers, through files in the shared folder.


def _folder(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return f"{(shared or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _json_lines(spark: SparkSession, sf_dir: str, bad: bool) -> str:
    """Documents as JSON Lines; with bad, every seventh is cut in half."""
    from lectern.sources import articles as S

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("article"), F.nullif("lang", F.lit("fr")).alias("highlights"))
    path = _folder(spark, "lines")
    if not bad:
        S.write_jsonl(rows, path)
    else:
        whole = F.to_json(F.struct("id", "article", "highlights"), {"ignoreNullFields": "false"})
        rows.select(F.when(F.col("id").cast("bigint") % 7 == 0, F.left(whole, F.floor(F.length(whole) / 2).cast("int"))).otherwise(whole).alias("value")).write.text(path)
    return path


@query("SELECT CAST(doc_id AS VARCHAR) AS id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS article, nullif(lang, 'fr') AS highlights FROM documents")
def read_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.sources import articles as S

    return S.trimmed(S.read_strict(spark, _json_lines(spark, sf_dir, False)), ("article",)).drop(S.POSITION)


@query("SELECT count(*) FILTER (doc_id % 7 <> 0) AS good, count(*) FILTER (doc_id % 7 = 0) AS bad, min(doc_id) FILTER (doc_id % 7 <> 0) AS first_id FROM documents")
def read_with_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.sources import articles as S

    good, bad = S.read_lenient(spark, _json_lines(spark, sf_dir, True))
    return good.agg(F.count("*").alias("good"), F.min(F.col("id").cast("bigint")).alias("first_id")).crossJoin(bad.agg(F.count("*").alias("bad")))  # one row each


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents ORDER BY doc_id LIMIT 25")
def first_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by place, which is what a sample without shuffling takes."""
    from lectern.sources import articles as S

    rows = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.lit("").alias("file"), F.col("doc_id").alias("line")).alias(S.POSITION))
    return S.sample(rows, 25).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("doc_id")).cast("bigint")).drop(S.POSITION)  # of 25 rows


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest FROM documents WHERE doc_id = 17")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.sources import articles as S

    rows = table(spark, sf_dir, "documents").select(F.lit("").alias("id"), F.col("doc_id").alias("article_id"), "text")
    return S.point_lookup(rows, "17").select(F.col("article_id").cast("string").alias("id"), F.md5("text").alias("digest"))


# Sentence ranking.


@query(f"""WITH {_TERM}, t AS (SELECT doc_id, term, sum(m) AS f FROM g GROUP BY ALL),
r AS (SELECT doc_id, term, CAST(f AS BIGINT) AS frequency, round(f / max(f) OVER (PARTITION BY doc_id), 6) AS normalized_frequency, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, term) AS rank FROM t)
SELECT doc_id, term, frequency, normalized_frequency, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def freq_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.frequency_top_words(_terms(spark, sf_dir))


@query(f"WITH {_FREQ} SELECT doc_id, CAST(idx AS INT) AS idx, score, CAST(rank AS INT) AS rank FROM ranked")
def freq_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(ranking.frequency_scores(_terms(spark, sf_dir)))


@query(f"WITH {_FREQ} SELECT doc_id, CAST(idx AS INT) AS idx, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3")
def freq_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(freq_rank(spark, sf_dir), 3)


def _tfidf_ranked(spark: SparkSession, sf_dir: str, smooth: bool = False) -> DataFrame:
    scores = ranking.tfidf_scores(_terms(spark, sf_dir), smooth)
    return ranking.ranked(scores, F.col("len") == 0).select("doc_id", "idx", "score", "rank")


@query(f"WITH {_tfidf(_PLAIN)} SELECT doc_id, CAST(idx AS INT) AS idx, score, CAST(rank AS INT) AS rank FROM ranked")
def tfidf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tfidf_ranked(spark, sf_dir)


@query(f"WITH {_tfidf(_SMOOTH)} SELECT doc_id, CAST(idx AS INT) AS idx, score, CAST(rank AS INT) AS rank FROM ranked")
def tfidf_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tfidf_ranked(spark, sf_dir, True)


@query(f"WITH {_tfidf(_PLAIN)} SELECT doc_id, CAST(idx AS INT) AS idx, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3")
def tfidf_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(_tfidf_ranked(spark, sf_dir), 3)


@query(f"""WITH {_TERM}, t AS (SELECT doc_id, n, term, sum(m) AS m, count(*) AS df FROM g GROUP BY ALL),
x AS (SELECT *, m / sum(m) OVER (PARTITION BY doc_id) AS tf, greatest(0.0, ln(n / df)) AS idf FROM t),
r AS (SELECT doc_id, term, round(tf * idf, 6) AS tfidf, round(tf, 6) AS tf, df, round(idf, 6) AS idf, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * idf, 6) DESC, term) AS rank FROM x)
SELECT doc_id, CAST(rank AS INT) AS rank, term, tfidf, tf, df, idf FROM r WHERE rank <= 10""")
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.tfidf_top_terms(_terms(spark, sf_dir))


@query(f"WITH {_tfidf(_PLAIN)} SELECT doc_id, string_agg(text, ' ' ORDER BY idx) AS summary FROM ranked JOIN sent USING (doc_id, idx) WHERE rank <= 3 GROUP BY doc_id")
def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = ranking.sentence_rows(table(spark, sf_dir, "documents"), T.sentences(F.col("text")))
    return ranking.summary_text(tfidf_top3(spark, sf_dir), sentences)


_EDGES = _weighted(_PLAIN) + """,
v AS (SELECT doc_id, idx, term, w, sqrt(sum(w * w) OVER (PARTITION BY doc_id, idx)) AS norm FROM ww WHERE w > 0),
edge AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, least(1.0, greatest(0.0, sum(a.w * b.w) / (max(a.norm) * max(b.norm)))) AS cosine FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.term = b.term AND a.idx < b.idx GROUP BY ALL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.similarity_edges(_terms(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT doc_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(cosine, 6) AS cosine FROM edge")
def sim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("doc_id", "i", "j", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_EDGES}, twoway AS (SELECT doc_id, i, cosine FROM edge UNION ALL SELECT doc_id, j, cosine FROM edge) SELECT doc_id, CAST(i AS INT) AS idx, count(*) AS degree, round(sum(cosine), 5) AS strength FROM twoway GROUP BY ALL")
def sentence_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.mirrored(_edges(spark, sf_dir)).groupBy("doc_id", F.col("i").alias("idx")).agg(F.count("*").alias("degree"), F.round(F.sum("cosine"), 5).alias("strength"))


STEPS = 20


def _pagerank_sql() -> str:
    out = [f"""WITH {_EDGES}, twoway AS MATERIALIZED (SELECT doc_id, i, j, cosine FROM edge UNION ALL SELECT doc_id, j, i, cosine FROM edge),
share AS MATERIALIZED (SELECT doc_id, i, j, cosine / sum(cosine) OVER (PARTITION BY doc_id, i) AS s FROM twoway),
node AS MATERIALIZED (SELECT sent.doc_id, idx, n, idx NOT IN (SELECT i FROM twoway b WHERE b.doc_id = sent.doc_id) AS loose FROM sent),
p0 AS MATERIALIZED (SELECT doc_id, idx, n, loose, 1.0 / n AS p FROM node)"""]
    for k in range(STEPS):
        out.append(f"""p{k + 1} AS MATERIALIZED (SELECT p.doc_id, p.idx, p.n, p.loose, 0.15 / p.n + 0.85 * coalesce(f.s, 0.0) + 0.85 * coalesce(h.s, 0.0) / p.n AS p FROM p{k} p
LEFT JOIN (SELECT e.doc_id, e.j, sum(e.s * q.p) AS s FROM share e JOIN p{k} q ON q.doc_id = e.doc_id AND q.idx = e.i GROUP BY ALL) f ON f.doc_id = p.doc_id AND f.j = p.idx
LEFT JOIN (SELECT doc_id, sum(p) AS s FROM p{k} WHERE loose GROUP BY ALL) h ON h.doc_id = p.doc_id)""")
    return ",\n".join(out) + f"\nSELECT doc_id, CAST(idx AS INT) AS idx, round(p, 5) AS score FROM p{STEPS}"


@query(_pagerank_sql())
def pagerank_fixed20(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ranking.sentence_rows(table(spark, sf_dir, "documents"), T.sentences(F.col("text")))
    return ranking.pagerank(nodes.select("doc_id", "idx"), _edges(spark, sf_dir), STEPS).select("doc_id", "idx", F.round("score", 5).alias("score"))


def _summaries(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return summaries.summarize(from_text(spread(table(spark, sf_dir, "documents"))), method, 3)


@query()
def graph_top3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir, "textrank").select("id", "summary", "num_sentences_selected", "metadata.iterations", "metadata.converged")


@query()
def summaries_rowlocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [_summaries(spark, sf_dir, m).select("id", "method", "summary", "num_sentences_selected") for m in ("frequency", "tfidf")]
    return both[0].union(both[1])


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS vec_id, e.vec_id AS other, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 4) AS cosine FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT vec_id, other, cosine, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other) AS rank FROM s) WHERE rank <= 3""")
def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a query against all: a stated query set, dealt in blocks."""
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 3)


# Evaluation.

_PAIRS = """p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
pairs AS (SELECT concat(conv_id, '-', turn) AS id, text AS reference, next_text AS candidate FROM p WHERE role = 'user' AND next_role = 'assistant')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    return rows.where("role = 'user' AND next_role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("reference"), F.col("next_text").alias("candidate"))


def _rouge_sql(n: int) -> str:
    gram = f"list_transform(range(1, greatest(0, len(t) - {n - 1}) + 1), lambda i: array_to_string(t[i:i + {n - 1}], ' '))"
    return f"""WITH {_PAIRS}, t AS (SELECT id, {_TOKENS.format("candidate")} AS c, {_TOKENS.format("reference")} AS r FROM pairs),
c AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest({gram.replace("t[", "c[").replace("len(t)", "len(c)")}) AS g FROM t) GROUP BY ALL),
r AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest({gram.replace("t[", "r[").replace("len(t)", "len(r)")}) AS g FROM t) GROUP BY ALL),
o AS (SELECT c.id, sum(least(c.n, r.n)) AS o FROM c JOIN r ON c.id = r.id AND c.g = r.g GROUP BY ALL),
x AS (SELECT t.id, coalesce(o.o, 0) AS o, greatest(0, len(c) - {n - 1}) AS cn, greatest(0, len(r) - {n - 1}) AS rn FROM t LEFT JOIN o USING (id))
SELECT id, round(CASE WHEN cn > 0 AND rn > 0 THEN o / cn ELSE 0.0 END, 6) AS "precision", round(CASE WHEN cn > 0 AND rn > 0 THEN o / rn ELSE 0.0 END, 6) AS recall,
round(CASE WHEN cn > 0 AND rn > 0 AND o > 0 THEN 2 * (o / cn) * (o / rn) / (o / cn + o / rn) ELSE 0.0 END, 6) AS f1 FROM x"""


@query(_rouge_sql(1))
def rouge1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rouge.rouge_n(_pairs(spark, sf_dir), 1, "id", "candidate", "reference", T.portable_tokens)


@query(_rouge_sql(2))
def rouge2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rouge.rouge_n(_pairs(spark, sf_dir), 2, "id", "candidate", "reference", T.portable_tokens)


@query()
def rougeL(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = T.portable_tokens(F.col("candidate")), T.portable_tokens(F.col("reference"))
    pairs = _pairs(spark, sf_dir).select("id", c.alias("c"), r.alias("r"))
    return pairs.select("id", rouge.triple(rouge.lcs_batch("c", "r"), F.size("c"), F.size("r")).alias("t")).select("id", "t.*")


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers to each user's line, the whole one and its reference's own words, as summaries of two methods."""
    pairs = _pairs(spark, sf_dir)
    references = pairs.select("id", F.col("reference").alias("highlights"))
    answers = {"whole": pairs.select("id", F.col("candidate").alias("summary")), "echo": pairs.where("length(reference) % 3 > 0").select("id", F.concat_ws(" ", F.left("reference", F.lit(80)), "candidate").alias("summary"))}
    return compare.evaluate(references, answers)


def _evaluated_sql() -> str:
    count = "CAST(len(list_filter(regexp_split_to_array({}, '[ \\t\\n\\f\\r]+'), lambda x: x <> '')) AS INT)"
    out = f"""WITH {_PAIRS}, long AS (SELECT id, reference, 'whole' AS method, candidate AS summary FROM pairs WHERE length(reference) % 3 > 0 UNION ALL SELECT id, reference, 'echo', concat_ws(' ', left(reference, 80), candidate) FROM pairs WHERE length(reference) % 3 > 0),
tk AS (SELECT id, method, {count.format("reference")} AS reference_word_count, {count.format("summary")} AS word_count, {_OVERLAP.format("summary")} AS c, {_OVERLAP.format("reference")} AS r FROM long)"""
    for n in (1, 2):
        gram = "unnest(list_transform(range(1, greatest(0, len({0}) - " + str(n - 1) + ") + 1), lambda i: array_to_string({0}[i:i + " + str(n - 1) + "], ' ')))"
        out += f""",
c{n} AS (SELECT id, method, g, count(*) AS n FROM (SELECT id, method, {gram.format("c")} AS g FROM tk) GROUP BY ALL), r{n} AS (SELECT id, method, g, count(*) AS n FROM (SELECT id, method, {gram.format("r")} AS g FROM tk) GROUP BY ALL),
o{n} AS (SELECT c.id, c.method, sum(least(c.n, r.n)) AS o FROM c{n} c JOIN r{n} r ON c.id = r.id AND c.method = r.method AND c.g = r.g GROUP BY ALL),
e{n} AS (SELECT tk.id, tk.method, 'rouge{n}' AS metric, reference_word_count, word_count, coalesce(o, 0) AS o, greatest(0, len(c) - {n - 1}) AS cn, greatest(0, len(r) - {n - 1}) AS rn FROM tk LEFT JOIN o{n} USING (id, method))"""
    return out + """,
ev AS (SELECT id, method, metric, reference_word_count, word_count, round(CASE WHEN cn > 0 AND rn > 0 THEN o / cn ELSE 0.0 END, 6) AS "precision", round(CASE WHEN cn > 0 AND rn > 0 THEN o / rn ELSE 0.0 END, 6) AS recall,
round(CASE WHEN cn > 0 AND rn > 0 AND o > 0 THEN 2 * (o / cn) * (o / rn) / (o / cn + o / rn) ELSE 0.0 END, 6) AS f1 FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2))"""


@query(_evaluated_sql() + " SELECT * FROM ev")
def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).where("metric <> 'rougeL'").select("id", "method", "metric", "reference_word_count", "word_count", "precision", "recall", "f1")


@query(_evaluated_sql() + """ SELECT id, max(f1) FILTER (method = 'whole' AND metric = 'rouge1') AS whole_1, max(f1) FILTER (method = 'echo' AND metric = 'rouge2') AS echo_2 FROM ev GROUP BY id""")
def evaluated_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.article_table(_evaluated(spark, sf_dir)).select("id", F.col("whole_rouge1.f1").alias("whole_1"), F.col("echo_rouge2.f1").alias("echo_2"))


@query(_evaluated_sql() + """ SELECT method, metric, measure, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(coalesce(stddev_samp(v), 0.0), 6) AS std, round(min(v), 6) AS "min", round(max(v), 6) AS "max" FROM (UNPIVOT (SELECT id, method, metric, "precision", recall, f1 FROM ev) ON "precision", recall, f1 INTO NAME measure VALUE v) GROUP BY ALL""")
def evaluated_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.stats(_evaluated(spark, sf_dir).where("metric <> 'rougeL'"))


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the article's distinct content terms that each method's top three sentences hold: one figure per article and method."""
    terms = _terms(spark, sf_dir)
    tops = {"frequency": freq_top3(spark, sf_dir), "tfidf": tfidf_top3(spark, sf_dir)}
    total = terms.where("m > 0").groupBy("doc_id").agg(F.countDistinct("term").alias("all"))
    held = [terms.where("m > 0").join(t.select("doc_id", "idx"), ["doc_id", "idx"], "left_semi").groupBy("doc_id").agg(F.countDistinct("term").alias("some")).withColumn("method", F.lit(m)) for m, t in tops.items()]
    return held[0].union(held[1]).join(total, "doc_id").select(F.col("doc_id").alias("id"), "method", F.lit("coverage").alias("metric"), F.round(F.col("some") / F.col("all"), 6).alias("f1"))


def _methods_sql() -> str:
    freq = _FREQ.replace("ranked AS", "ranked_f AS").replace("score AS (", "score_f AS (").replace("FROM score)", "FROM score_f)").replace("sc AS (", "sc_f AS (").replace("JOIN sc ", "JOIN sc_f ")
    tail = _tfidf(_PLAIN)[len(_TERM) :]
    return f"""WITH {freq}{tail}, al AS (SELECT doc_id, count(DISTINCT term) AS a FROM g GROUP BY ALL),
tops AS (SELECT doc_id, idx, 'frequency' AS method FROM ranked_f WHERE rank <= 3 UNION ALL SELECT doc_id, idx, 'tfidf' FROM ranked WHERE rank <= 3),
ev AS (SELECT g.doc_id AS id, method, 'coverage' AS metric, round(count(DISTINCT term) / max(a), 6) AS f1 FROM g JOIN tops USING (doc_id, idx) JOIN al USING (doc_id) GROUP BY ALL)"""


@query(_methods_sql() + " SELECT id, method, metric, f1 FROM ev")
def method_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _methods(spark, sf_dir)


@query(_methods_sql() + """ SELECT method, metric, round(avg(f1), 6) AS mean, round(median(f1), 6) AS median, round(coalesce(stddev_samp(f1), 0.0), 6) AS std, round(min(f1), 6) AS "min", round(max(f1), 6) AS "max" FROM ev GROUP BY ALL""")
def method_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.describe(_methods(spark, sf_dir), ["method", "metric"], "f1")


_WIN = """, best AS (SELECT *, abs(f1 - max(f1) OVER (PARTITION BY id, metric)) < 1e-6 AS near FROM ev),
v AS (SELECT id, metric, CASE WHEN count(*) = 1 THEN min(method) ELSE 'tie' END AS winner FROM best WHERE near GROUP BY ALL)"""


@query(_methods_sql() + _WIN + """ SELECT metric, winner, count(id) AS articles FROM (SELECT 'coverage' AS metric, unnest(['frequency', 'tfidf', 'tie']) AS winner) LEFT JOIN v USING (metric, winner) GROUP BY ALL""")
def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.winners(_methods(spark, sf_dir), ("frequency", "tfidf"))


@query(_methods_sql() + " SELECT metric, arg_max(method, (mean, CASE method WHEN 'frequency' THEN -1 ELSE -2 END)) AS method FROM (SELECT method, metric, round(avg(f1), 6) AS mean FROM ev GROUP BY ALL) GROUP BY metric")
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.best_methods(_methods(spark, sf_dir), ("frequency", "tfidf"))


# Known words and vocabulary.

_KNOWN = f"k AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS word FROM benchmark)"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.portable_tokens(F.col("text"))).alias("term"), F.lit(None).cast("string").alias("lemma"))
    items = _terms(spark, sf_dir).where("m > 0").select("doc_id", "term").distinct()
    # The split of one word's rows is one decision: words are classified once each, then joined back.
    decided = known.classify(items.select("term").distinct(), words, ["term"], "term", "term", "term")
    return items.join(decided, "term")


@query(f"WITH {_TERM}, {_KNOWN}, i AS (SELECT DISTINCT doc_id, term FROM g) SELECT doc_id, term, term IN (SELECT word FROM k) AS is_known FROM i")
def known_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "term", "is_known")


@query(f"WITH {_TERM}, {_KNOWN}, i AS (SELECT DISTINCT doc_id, term FROM g) SELECT doc_id, count(*) AS total, count(*) FILTER (term IN (SELECT word FROM k)) AS known, count(*) FILTER (term NOT IN (SELECT word FROM k)) AS new FROM i GROUP BY doc_id")
def known_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("total"), F.sum(F.col("is_known").cast("bigint")).alias("known"), F.sum((~F.col("is_known")).cast("bigint")).alias("new"))


_SURFACE = _SENT + r""", occ AS (SELECT doc_id, n, idx, unnest(range(len(t))) AS off, unnest(t) AS surface FROM (SELECT doc_id, n, idx, regexp_extract_all(text, '[A-Za-z0-9]+(?:[''_-][A-Za-z0-9]+)*') AS t FROM sent)),
o AS (SELECT doc_id, n, idx, off, surface, lower(surface) AS lemma FROM occ WHERE length(surface) > 2 AND NOT list_contains(""" + _STOP + """, lower(surface))),
sf AS (SELECT doc_id, lemma, surface, count(*) AS c, min((idx, off)) AS first FROM o GROUP BY ALL),
best AS (SELECT doc_id, lemma, surface FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lemma ORDER BY c DESC, first) AS r FROM sf) WHERE r = 1),
agg AS (SELECT doc_id, n, lemma, count(*) AS frequency, count(DISTINCT idx) AS sentence_frequency, min((idx, off)) AS first FROM o GROUP BY ALL),
vs AS (SELECT doc_id, lemma, surface AS term, frequency, sentence_frequency, round(0.4 * (frequency / max(frequency) OVER (PARTITION BY doc_id)) + 0.4 * (sentence_frequency / n) + 0.2 * 0.0, 4) AS importance_score, first FROM agg JOIN best USING (doc_id, lemma)),
vr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance_score DESC, frequency DESC, first, lemma) AS rank FROM vs)"""


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators import vocabulary

    docs = table(spark, sf_dir, "documents")
    sentences = T.sentences(F.col("text"))
    rows = ranking.dealt(docs).select("doc_id", sentences.alias("ss")).select("doc_id", F.size("ss").alias("n"), F.posexplode("ss").alias("at", "s"))
    tokens = F.regexp_extract_all("s", F.lit("[A-Za-z0-9]+(?:['_-][A-Za-z0-9]+)*"), F.lit(0))
    occ = rows.select("doc_id", "n", "at", F.posexplode(tokens).alias("off", "surface")).where((F.length("surface") > 2) & ~F.lower("surface").isin(T.STOP_WORDS))
    form = F.lower("surface")
    shaped = occ.select("doc_id", "n", F.lit("WORD").alias("type"), form.alias("lemma"), F.lit("NOUN").alias("label"), form.alias("form"), "surface", F.col("at").alias("idx"), F.struct("at", "off").alias("place"))
    return vocabulary.score(shaped, vocabulary.Options(), "doc_id", F.round).withColumn("sentence_frequency", F.size("sentence_indices").cast("bigint"))


@query(f"WITH {_SURFACE} SELECT doc_id, lemma, CAST(frequency AS INT) AS frequency, sentence_frequency, importance_score FROM vr")
def vocab_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).select("doc_id", "lemma", "frequency", "sentence_frequency", "importance_score")


@query(f"WITH {_SURFACE} SELECT doc_id, lemma, importance_score, CAST(rank AS INT) AS rank FROM vr WHERE rank <= 30")
def vocab_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).where("rank <= 30").select("doc_id", "lemma", "importance_score", "rank")


@query(f"WITH {_SURFACE} SELECT doc_id, lemma, term FROM vr")
def surface_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).select("doc_id", "lemma", "term")


_POS_SQL = "CASE WHEN list_contains(" + _STOP + ", lower({0})) THEN 'PRON' WHEN length({0}) % 5 = 0 THEN 'ADV' WHEN length({0}) % 3 = 0 THEN 'VERB' ELSE 'NOUN' END"
_NAME = "[A-Z][a-z]+(?: [A-Z][a-z]+)+"
_VOCABULARY = _SENT + rf""", tok AS (SELECT doc_id, n, idx, unnest(range(len(t))) AS off, unnest(t) AS surface FROM (SELECT doc_id, n, idx, regexp_extract_all(text, '[A-Za-z0-9]+') AS t FROM sent)),
nm AS (SELECT doc_id, n, idx, unnest(range(len(t))) AS off, unnest(t) AS surface FROM (SELECT doc_id, n, idx, regexp_extract_all(text, '{_NAME}') AS t FROM sent)),
o AS (SELECT doc_id, n, idx, off, 'WORD' AS type, {_POS_SQL.format("surface")} AS label, surface, lower(surface) AS lemma FROM tok WHERE length(surface) >= 2 UNION ALL SELECT doc_id, n, idx, off, 'ENTITY', 'NAME', surface, lower(surface) FROM nm),
oo AS (SELECT * FROM o WHERE label <> 'PRON'),
sf AS (SELECT doc_id, type, lemma, label, surface, count(*) AS c, min((idx, off)) AS first FROM oo GROUP BY ALL),
best AS (SELECT doc_id, type, lemma, label, surface AS term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type, lemma, label ORDER BY c DESC, first) AS r FROM sf) WHERE r = 1),
agg AS (SELECT doc_id, n, type, lemma, label, count(*) AS f, count(DISTINCT idx) AS sf, min((idx, off)) AS first FROM oo GROUP BY ALL),
vs AS (SELECT *, CASE WHEN type = 'ENTITY' THEN 'PROPN' ELSE label END AS pos, round((0.4 * (f / max(f) OVER (PARTITION BY doc_id)) + 0.4 * (sf / n) + CASE WHEN type = 'ENTITY' THEN 0.2 ELSE 0.0 END) * CASE WHEN type = 'WORD' AND label = 'ADV' THEN 0.8 ELSE 1.0 END, 4) AS score, count(*) OVER (PARTITION BY doc_id) AS total FROM agg JOIN best USING (doc_id, type, lemma, label)),
vr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, f DESC, first[1], first[2], lemma) AS rank FROM vs)"""


def _annotated(spark: SparkSession, sf_dir: str, details: bool = True, plain: bool = False) -> DataFrame:
    """Documents annotated by rules that SQL can state: tokens' details, the plain arrays of the other path, or both; and entities."""
    stop = lambda x: F.lower(x).isin(T.STOP_WORDS)
    pos = lambda x: F.when(stop(x), "PRON").when(F.length(x) % 5 == 0, "ADV").when(F.length(x) % 3 == 0, "VERB").otherwise("NOUN")

    def sentence(s: Column, i: Column) -> Column:
        tokens = F.regexp_extract_all(s, F.lit("[A-Za-z0-9]+"), F.lit(0))
        none = F.array().cast("array<string>")
        of = lambda x: x if plain else none
        detail = lambda x: F.struct(x.alias("text"), F.lower(x).alias("normalized"), F.lower(x).alias("lemma"), pos(x).alias("pos"), F.lit("").alias("tag"), stop(x).alias("is_stop"), F.lit(False).alias("is_punct"))
        entities = F.transform(F.regexp_extract_all(s, F.lit(_NAME), F.lit(0)), lambda x: F.struct(x.alias("text"), F.lit("NAME").alias("label"), F.lit(0).alias("start_char"), F.lit(0).alias("end_char")))
        # The fields of schemas.SENTENCE by their names: a cast would make every token anew.
        fields = lambda t: {"sentence_index": i, "original_text": s, "tokens": of(t), "normalized_tokens": none, "content_tokens": none, "lemmas": of(F.transform(t, F.lower)), "pos": of(F.transform(t, pos)), "tags": none, "token_details": F.transform(t, detail) if details else F.array().cast(f"array<{schemas.TOKEN}>"), "entities": entities}
        return T.bind(tokens, lambda t: F.struct(*(c.alias(k) for k, c in fields(t).items())))

    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("id"), F.transform(T.sentences(F.col("text")), sentence).alias("processed_sentences"))


_COUNTS = rf"""c AS (SELECT sent.doc_id, count(*) AS s, sum(len(t)) AS t, sum(len(list_filter(t, lambda x: list_contains({_STOP}, lower(x))))) AS st, sum(len(list_filter(t, lambda x: lower(x) <> x))) AS ch, sum(len(regexp_extract_all(text, '{_NAME}'))) AS e FROM (SELECT *, regexp_extract_all(text, '[A-Za-z0-9]+') AS t FROM sent) sent GROUP BY ALL),
d AS (SELECT coalesce(s, 0) AS s, coalesce(t, 0) AS t, coalesce(st, 0) AS st, coalesce(ch, 0) AS ch, coalesce(e, 0) AS e FROM documents LEFT JOIN c USING (doc_id))"""


@query(f"WITH {_SENT}, {_COUNTS} SELECT count(*) AS articles, round(avg(s), 2) AS sentences_mean, round(avg(t), 2) AS tokens_mean, CAST(max(t) AS INT) AS tokens_max, round(avg(st), 2) AS stop_words_mean, CAST(median(st) AS DOUBLE) AS stop_words_median, round(avg(e), 2) AS entities_mean, CAST(sum(ch) AS BIGINT) AS changed, round(100 * sum(ch) / sum(t), 2) AS changed_percent FROM d")
def annotation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.annotation_profile(_annotated(spark, sf_dir, True, True)).select("articles", "sentences_mean", "tokens_mean", "tokens_max", "stop_words_mean", "stop_words_median", "entities_mean", "changed", "changed_percent")


_ITEMS = " SELECT CAST(doc_id AS VARCHAR) AS id, CAST(total AS INT) AS total, CAST(rank AS INT) AS rank, term, lemma, pos, CASE WHEN type = 'ENTITY' THEN label END AS entity_label, CAST(f AS INT) AS frequency, CAST(sf AS INT) AS sentence_frequency, score FROM vr WHERE rank <= 12"


def _items(vocabulary_rows: DataFrame) -> DataFrame:
    rows = vocabulary_rows.select(F.col("article_id").alias("id"), F.col("total_candidate_items").alias("total"), F.posexplode_outer("items").alias("at", "i")).where("at IS NOT NULL")
    return rows.select("id", "total", (F.col("at") + 1).alias("rank"), "i.term", "i.lemma", "i.pos", "i.entity_label", "i.frequency", "i.sentence_frequency", F.col("i.importance_score").alias("score"))


def _sql_round(x: Column, digits: int) -> Column:
    """Halves away from zero, of the scaled number, as the SQL's round does."""
    return F.round(x * 10**digits) / 10**digits


def _extracted(spark: SparkSession, sf_dir: str, details: bool = True) -> DataFrame:
    from lectern.operators import vocabulary

    return vocabulary.extract(_annotated(spark, sf_dir, details, not details), vocabulary.Options(max_items=12), _sql_round)


@query(f"WITH {_VOCABULARY}" + _ITEMS)
def vocab_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(_extracted(spark, sf_dir))


@query(f"WITH {_VOCABULARY}" + _ITEMS)
def vocab_extract_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of sentences without token details."""
    return _items(_extracted(spark, sf_dir, False))


@query(f"WITH {_VOCABULARY} SELECT lemma AS normalized_form, CAST(doc_id AS VARCHAR) AS id, label, f AS frequency FROM agg WHERE type = 'ENTITY'")
def vocab_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators import vocabulary

    found = vocabulary.candidates(_annotated(spark, sf_dir), vocabulary.Options()).where("type = 'ENTITY'")
    return found.groupBy(F.col("form").alias("normalized_form"), "id", "label").agg(F.count("*").alias("frequency"))


@query(f"WITH {_VOCABULARY}, g AS (SELECT doc_id, max(total) AS total, count(*) FILTER (rank <= 12) AS items FROM vr GROUP BY doc_id), x AS (SELECT coalesce(total, 0) AS total, coalesce(items, 0) AS items FROM documents LEFT JOIN g USING (doc_id)), m AS (SELECT round(avg(score), 4) AS mean_score FROM vr WHERE rank <= 12) SELECT count(*) AS articles, CAST(sum(items) AS BIGINT) AS items, round(avg(total), 2) AS mean_candidates, round(avg(items), 2) AS mean_items, any_value(mean_score) AS mean_score FROM x, m")
def vocab_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators import vocabulary

    return vocabulary.batch_metrics(_extracted(spark, sf_dir))[0]


@query("SELECT count(*) AS articles, round(avg(k), 2) AS mean_selected, CAST(sum(k) AS BIGINT) AS total_selected FROM (SELECT least(3, len(s)) AS k FROM (WITH " + _SENT + " SELECT s FROM ss))")
def summary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.batch_metrics(_summaries(spark, sf_dir, "tfidf"), " TFIDF ").select("articles", "mean_selected", "total_selected")


_READER = f"k AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS word FROM benchmark WHERE item_id % 2 = 0)"


def _reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other benchmark item's words as a reader's known ones."""
    words = table(spark, sf_dir, "benchmark").where("item_id % 2 = 0").select(F.explode(T.portable_tokens(F.col("text"))).alias("term")).distinct()
    return words.select("term", F.col("term").alias("lemma"), F.lit(None).cast("string").alias("entity_label"), F.lit("str").alias("source_kind"))


@query(f"WITH {_VOCABULARY}, {_READER}, i AS (SELECT doc_id, lemma, term, rank, lemma IN (SELECT word FROM k) OR lower(term) IN (SELECT word FROM k) AS known FROM vr WHERE rank <= 12), g AS (SELECT doc_id, count(*) AS t, count(*) FILTER (known) AS kn, coalesce(string_agg(term, ' ' ORDER BY rank) FILTER (NOT known), '') AS new_terms FROM i GROUP BY doc_id) SELECT CAST(doc_id AS VARCHAR) AS id, CAST(coalesce(t, 0) AS INT) AS total, CAST(coalesce(kn, 0) AS INT) AS known, CAST(coalesce(t - kn, 0) AS INT) AS new, coalesce(new_terms, '') AS new_terms, true AS reconciled FROM documents LEFT JOIN g USING (doc_id)")
def detect_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = known.detect(_extracted(spark, sf_dir), _reader(spark, sf_dir))
    terms = F.array_join(F.transform("new_words", lambda x: x["term"]), " ")
    return found.select(F.col("article_id").alias("id"), F.col("total_vocabulary_count").alias("total"), F.col("known_word_count").alias("known"), F.col("new_word_count").alias("new"), terms.alias("new_terms"), F.col("validation.reconciled").alias("reconciled"))


@query(f"WITH {_VOCABULARY}, {_READER}, i AS (SELECT doc_id, lemma IN (SELECT word FROM k) OR lower(term) IN (SELECT word FROM k) AS known FROM vr WHERE rank <= 12), g AS (SELECT doc_id, count(*) FILTER (known) AS kn, count(*) FILTER (NOT known) AS nw FROM i GROUP BY doc_id), x AS (SELECT coalesce(kn, 0) AS kn, coalesce(nw, 0) AS nw FROM documents LEFT JOIN g USING (doc_id)) SELECT count(*) AS articles, CAST(sum(kn + nw) AS BIGINT) AS total_items, CAST(sum(kn) AS BIGINT) AS known_items, CAST(min(nw) AS INT) AS min_new, CAST(max(nw) AS INT) AS max_new, CAST(median(nw) AS DOUBLE) AS median_new, (SELECT count(*) FROM k) AS known_vocabulary_size FROM x")
def detect_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _reader(spark, sf_dir)
    return known.batch_metrics(known.detect(_extracted(spark, sf_dir), words), words).select("articles", "total_items", "known_items", "min_new", "max_new", "median_new", "known_vocabulary_size")


@query(f"SELECT DISTINCT unnest({_TOKENS.format('text')}) AS word FROM benchmark")
def known_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's known words from a file of lines, with blank lines and capitals."""
    path = _folder(spark, "words") + ".txt"
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.portable_tokens(F.col("text"))).alias("w")).distinct()
    words.select(F.concat(F.lit("\t "), F.upper("w"), F.lit("  "))).union(words.limit(3).select(F.lit("   "))).write.text(path)
    return known.lookup(known.read_known(spark, path))


@query(f"WITH {_TERM}, i AS (SELECT DISTINCT term FROM g) SELECT term, CASE WHEN length(term) % 4 = 0 THEN 'new' WHEN length(term) % 6 = 0 THEN 'known' END AS status FROM i")
def item_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _terms(spark, sf_dir).where("m > 0").select("term", F.col("term").alias("lemma")).distinct()
    size = F.length("term")
    return known.ui_status(items, items.where(size % 4 == 0), items.where((size % 6 == 0) | (size % 4 == 0))).select("term", "status")


# The store, loaded from the star schema: customers are users, orders runs, parts notes.

_RUNS = "h AS (SELECT o_orderkey + 1 AS id, o_orderstatus AS title, concat('order ', o_orderpriority) AS article_text, lower(o_orderpriority) AS method, strftime(o_orderdate, '%Y-%m-%d') AS processing_timestamp, o_custkey + 1 AS user_id FROM orders)"
_NOTES = "n AS (SELECT p_partkey + 1 AS id, p_type AS term, p_name AS content, p_brand AS example_sentence, p_partkey % 50 + 1 AS article_history_id, concat('2024-', lpad(CAST(p_size AS VARCHAR), 2, '0')) AS created_at, p_partkey % 7 + 1 AS user_id FROM part)"


def _store(spark: SparkSession, sf_dir: str) -> store.Store:
    s = store.Store(spark, _folder(spark, "store"))
    s.load("users", table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("id"), F.col("c_name").alias("username"), F.lit("x").alias("password_hash"), F.lit("2020").alias("created_at")))
    s.load("article_history", table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("id"), F.col("o_orderstatus").alias("title"), F.concat(F.lit("order "), "o_orderpriority").alias("article_text"), F.lit("text").alias("summary"), F.lower("o_orderpriority").alias("method"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("processing_timestamp"), F.concat(F.lit('{"k": '), F.col("o_orderkey").cast("string"), F.lit("}")).alias("metadata"), F.lit("not json").alias("new_vocabulary"), (F.col("o_custkey") + 1).alias("user_id"),
    ))
    s.load("vocabulary_notes", table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).alias("id"), F.col("p_type").alias("term"), F.col("p_name").alias("content"), F.col("p_brand").alias("example_sentence"), (F.col("p_partkey") % 50 + 1).alias("article_history_id"),
        F.concat(F.lit("2024-"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("created_at"), F.lit("2025").alias("updated_at"), (F.col("p_partkey") % 7 + 1).alias("user_id"),
    ))
    return s


_RUN = ["id", "title", "method", "processing_timestamp", "user_id"]
_NOTE = ["id", "term", "content", "example_sentence", "article_history_id", "user_id"]
_NEWEST = "ORDER BY processing_timestamp DESC, id DESC"


@query(f"WITH {_RUNS} (SELECT {', '.join(_RUN)} FROM h WHERE method = '1-urgent' {_NEWEST} LIMIT 50 OFFSET 100)")
def history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).list_history(50, 100, " 1-URGENT ").select(*_RUN)


@query(f"WITH {_RUNS} (SELECT {', '.join(_RUN)} FROM h WHERE user_id = 6 {_NEWEST} LIMIT 20)")
def history_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).list_history(offset=-3, user_id=6).select(*_RUN)


@query(f"WITH {_RUNS} SELECT m AS method, u AS user_id, (SELECT count(*) FROM h WHERE (m IS NULL OR method = m) AND (u IS NULL OR user_id = u)) AS n FROM (SELECT unnest([NULL, '1-urgent', '5-low']) AS m), (SELECT unnest([NULL, 6, 18]) AS u)")
def history_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return spark.createDataFrame([(m, u, s.count_history(m, u)) for m in (None, "1-urgent", "5-low") for u in (None, 6, 18)], "method string, user_id int, n bigint")


@query(f"WITH {_RUNS}, t AS (SELECT count(*) AS total FROM h WHERE method = '2-high') SELECT total, 20 AS \"limit\", 40 AS \"offset\", 3 AS page, id, strftime(CAST(processing_timestamp AS DATE), '%Y-%m-%d') AS day FROM (SELECT * FROM h WHERE method = '2-high' {_NEWEST} LIMIT 20 OFFSET 40), t")
def page_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, limit = _store(spark, sf_dir), store.page_limit(20, 500)
    e = store.envelope(store.by_day(s.list_history(limit, 40, "2-high"), "processing_timestamp"), s.count_history("2-high"), limit, 40)
    rows = [(e["total"], e["limit"], e["offset"], store.page_number(e["offset"], limit), i["id"], str(i["day"])[:10]) for i in e["items"]]
    return spark.createDataFrame(rows, "total bigint, limit int, offset int, page int, id bigint, day string")


@query(f"WITH {_RUNS}, f AS (SELECT * FROM h WHERE lower(title) LIKE '%3-m_d%' OR lower(article_text) LIKE '%3-m_d%'), t AS (SELECT count(*) AS total FROM f) SELECT id, method, total FROM (SELECT * FROM f {_NEWEST} LIMIT 30 OFFSET 5), t")
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return s.search_history(" 3-M_d ", 30, 5).select("id", "method").withColumn("total", F.lit(s.count_search_history("3-M_d")).cast("bigint"))


@query("SELECT o_orderkey + 1 AS id, lower(o_orderpriority) AS method, concat('{\"k\":', o_orderkey, '}') AS metadata, 'not json' AS new_vocabulary, true AS hidden FROM orders WHERE o_orderkey = 7")
def history_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run by its id, and that another user doesn't see it."""
    s = _store(spark, sf_dir)
    r = s.get_history(8)
    return spark.createDataFrame([(r["id"], r["method"], r["metadata"], r["new_vocabulary"], s.get_history(8, r["user_id"] + 1) is None)], "id bigint, method string, metadata string, new_vocabulary string, hidden boolean")


@query(f"WITH {_NOTES}, f AS (SELECT * FROM n WHERE lower(term) LIKE '%st%' OR lower(content) LIKE '%st%' OR lower(example_sentence) LIKE '%st%'), t AS (SELECT count(*) AS total FROM f) SELECT {', '.join(_NOTE)}, total FROM (SELECT * FROM f ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 3), t")
def notes_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return s.search_notes("ST", 40, 3).select(*_NOTE).withColumn("total", F.lit(s.count_search_notes("ST")).cast("bigint"))


@query(f"WITH {_NOTES}, f AS (SELECT * FROM n WHERE lower(term) = 'economy' AND user_id = 3), t AS (SELECT count(*) AS total FROM f) SELECT {', '.join(_NOTE)}, total FROM (SELECT * FROM f ORDER BY created_at DESC, id DESC LIMIT 20), t")
def notes_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return s.list_notes(term=" economy ", user_id=3).select(*_NOTE).withColumn("total", F.lit(s.count_notes("ECONOMY", None, 3)).cast("bigint"))


@query(f"""WITH {_NOTES}, m AS (SELECT max(id) + 1 AS id FROM n) SELECT id, CASE WHEN id = 5 THEN NULL WHEN id = 6 THEN 'word' ELSE term END AS term, CASE WHEN id = 5 THEN 'changed' ELSE content END AS content, CASE WHEN id = 6 THEN NULL ELSE example_sentence END AS example_sentence,
CASE WHEN id = 6 THEN NULL ELSE article_history_id END AS article_history_id, user_id, CASE WHEN id IN (5, 6) THEN '2030' ELSE '2025' END AS updated_at FROM n WHERE id <> 7 UNION ALL SELECT id, 'T', 'new note', NULL, 4, NULL, 'now' FROM m""")
def notes_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after one was added, two changed and one deleted, and after calls that must change nothing."""
    s = _store(spark, sf_dir)
    new = s.create_note("  new note ", term=" T ", example_sentence=" ", article_history_id=4)
    owner = s.get_note(7)["user_id"]
    done = [s.update_note(5, content=" changed ", term="x", clear_term=True, updated_at="2030"), s.update_note(6, term=" word ", example_sentence=" ", clear_link=True, updated_at="2030"), s.delete_note(7, owner)]
    refused = [s.update_note(8, content="not mine", user_id=99), s.update_note(-1, content="none"), s.delete_note(9, 99), s.delete_note(7)]
    for call in (lambda: s.create_note(" "), lambda: s.create_note("x", article_history_id=-5), lambda: s.update_note(8, article_history_id=-5), lambda: s.update_note(8, content=" ")):
        try:
            refused.append(bool(call() or True))
        except ValueError:
            refused.append(False)
    if not all(done) or any(refused):
        raise RuntimeError(f"{done} {refused}")
    return s.read("vocabulary_notes").select(*_NOTE, F.when(F.col("id") == new, "now").otherwise(F.col("updated_at")).alias("updated_at"))


@query(f"WITH {_RUNS}, {_NOTES} SELECT article_history_id, runs, count(*) AS notes FROM (SELECT nullif(article_history_id, 8) AS article_history_id, (SELECT count(*) FROM h WHERE id <> 8) AS runs FROM n) GROUP BY ALL")
def history_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by link after a run was deleted, which another user could not."""
    s = _store(spark, sf_dir)
    owner = s.get_history(8)["user_id"]
    if s.delete_history(8, owner + 1) or not s.delete_history(8, owner) or s.delete_history(8):
        raise RuntimeError("deleted by the wrong user, or not at all, or twice")
    return s.read("vocabulary_notes").groupBy("article_history_id").agg(F.count("*").alias("notes")).withColumn("runs", F.lit(s.count_history()).cast("bigint"))


@query(f"WITH {_RUNS}, {_NOTES} SELECT (SELECT count(*) FROM h) AS cleared, (SELECT max(id) FROM h) + 1 AS next_id, (SELECT count(*) FROM n) AS unlinked, 1 AS runs, (SELECT count(*) FROM n) AS notes_cleared, true AS healthy, 'a method' AS method, '{{\"a\":[1]}}' AS metadata")
def history_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clearing counts and leaves, and that ids go on after it."""
    s = _store(spark, sf_dir)
    cleared, unlinked = s.clear_history(True), s.read("vocabulary_notes").where("article_history_id IS NULL").count()
    run = s.save_history(" a summary ", " A Method ", metadata={"a": [1]})
    kept = s.get_history(run)
    return spark.createDataFrame([(cleared, run, unlinked, s.count_history(), s.clear_notes(True), s.healthy(), kept["method"], kept["metadata"])], "cleared bigint, next_id bigint, unlinked bigint, runs int, notes_cleared bigint, healthy boolean, method string, metadata string")


@query("SELECT max(c_custkey) + 2 AS next_id, 2 AS by_name, 'Customer#000000002' AS by_id, true AS refused FROM customer")
def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    new = s.create_user(" somebody ", "hash")
    refused = []
    for name in ("SOMEBODY", " "):
        try:
            s.create_user(name, "hash")
        except ValueError:
            refused.append(name)
    return spark.createDataFrame([(new, s.user_by_name(" CUSTOMER#000000001 ")["id"], s.user_by_id(3)["username"], len(refused) == 2 and s.user_by_id(True) is None)], "next_id bigint, by_name int, by_id string, refused boolean")


@query("SELECT event_id, CASE WHEN json_valid(props) THEN CAST(CAST(props AS JSON) ->> '$.k' AS VARCHAR) ELSE props END AS k, json_valid(props) AS is_json FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid JSON in its canonical text, and a value read from that."""
    read = table(spark, sf_dir, "events").select("event_id", T.json_or_raw(F.col("props")).alias("j"))
    is_json = F.coalesce(F.col("j").startswith("{"), F.lit(False))
    return read.select("event_id", F.when(is_json, F.get_json_object("j", "$.k")).otherwise(F.col("j")).alias("k"), is_json.alias("is_json"))


@query("SELECT 'tfidf' AS method, count(*) AS rows, CAST(0 AS BIGINT) AS differ FROM documents")
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method, and rows whose summary differs between a stream over the table and a batch: none."""
    from lectern.streaming.streams import summaries_by_stream

    streamed = summaries_by_stream(spark, f"{sf_dir}/documents.parquet", "tfidf", 3)
    batch = _summaries(spark, sf_dir, "tfidf")
    both = streamed.select("id", F.col("summary").alias("s")).join(batch.select("id", "summary"), "id", "full")
    return both.agg(F.count("*").alias("rows"), F.sum((~F.col("s").eqNullSafe(F.col("summary"))).cast("bigint")).alias("differ")).withColumn("method", F.lit("tfidf"))
