import re
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import annotate as A
from lectern.functions import text as T


def value(spark, make, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_clean_html(spark):
    page = "<p>President <b>announced</b>&nbsp;the decision<br/>today.</p>"
    got = value(spark, T.clean_html, page, None, "", "a < 5 <3 &lt;b&gt;", "x\x00y\x07\tz", "<script>var a</script>b")
    assert got[0].replace("  ", " ").strip() == "President announced the decision today."
    assert got[1:] == ["", "", "a < 5 <3 <b>", "xy\tz", "var ab"]


def test_normal_forms_and_space(spark):
    assert len(value(spark, T.normalize_unicode, "résumé")[0]) == 6
    assert value(spark, lambda t: T.normalize_unicode(t, "NFKC"), "ﬁ") == ["fi"]
    with pytest.raises(ValueError):
        T.normalize_unicode(F.lit("x"), "NFX")
    assert value(spark, T.normalize_whitespace, " a\t b\r\n\r\n c  ", None, "\n") == ["a b c", "", ""]
    assert value(spark, T.normalize_token, " Ab, ") == ["ab,"]


def test_counts(spark):
    assert value(spark, lambda t: F.size(T.words(t)), "one two  three\nfour five", " ", None) == [5, 0, 0]
    assert value(spark, lambda t: F.size(T.light_sentences(t)), "A b. C d! E f?", "no end", "  ") == [3, 1, 0]
    assert value(spark, T.richness_tokens, "Don't don't stop's'x 9") == [["don't", "don't", "stop's", "x", "9"]]


def test_tokens(spark):
    assert value(spark, T.overlap_tokens, "The well-known dog's café x_y 3.5") == [["the", "well-known", "dog's", "x_y", "3", "5"]]
    assert value(spark, lambda t: T.content_tokens(F.split(t, " ")), "The Cat , sat 42") == [["cat", "sat", "42"]]
    assert value(spark, T.is_stopword, " THE ", "cat") == [True, False]


def test_json_or_raw(spark):
    assert value(spark, T.json_or_raw, '{"a": [1]}', "not json", "", None) == ['{"a":[1]}', "not json", None, None]


def test_py_round(spark):
    rng = random.Random(1)
    xs = [2.675, 1.005, 0.125, 0.31165, 0.35455] + [rng.random() for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (2, 4):
        assert all(r.y == round(r.x, digits) for r in df.select("x", T.py_round(F.col("x"), digits).alias("y")).collect())


def test_ui(spark):
    assert value(spark, lambda t: T.ui_highlight(t, "a.b"), "xA.Bx a-b") == ["x<mark>A.B</mark>x a-b"]
    df = spark.createDataFrame([("New, old\nnew ,x", ["OLD"])], "t string, p array<string>")
    assert df.select(T.ui_new_chips(F.col("t"), F.col("p")).alias("c")).first().c == ["New", "x"]
    scores = spark.createDataFrame([(0.7, 1, 3), (0.35, 1, 0), (0.2, 2, 3), (0.1, 0, 1)], "f double, s int, n int")
    got = scores.select(T.ui_verdict(F.col("f")).alias("v"), T.ui_compression(F.col("s"), F.col("n")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("strong", 33), ("moderate", None), ("weak", 67), ("little", 0)]


def test_rule_annotator(spark):
    text = "Dr. Smith met   John Doe in Paris. They weren't early!  NASA paid $100 million."
    df = A.annotate(spark.createDataFrame([("1", text, "h"), ("2", "  ", None), ("3", None, None)], "id string, article string, highlights string"))
    rows = {r.id: r for r in df.collect()}
    assert [s.original_text for s in rows["1"].processed_sentences] == ["Dr. Smith met John Doe in Paris.", "They weren't early!", "NASA paid $100 million."]
    for s in rows["1"].processed_sentences:
        assert len(s.tokens) == len(s.pos) == len(s.lemmas) == len(s.tags) == len(s.token_details)
        assert all(s.original_text[e.start_char : e.end_char] == e.text for e in s.entities)
    assert rows["2"].processed_sentences == [] and rows["2"].original_article == "  " and rows["3"].cleaned_article == ""
    with pytest.raises(RuntimeError):
        A.ModelAnnotator("absent").annotate("x")


def test_words_end_where_unicode_letters_do(spark):
    text = "Naïve cafés über 3rd don't x-y_z élan façade naïve_1"
    r = spark.createDataFrame([(text,)], "t string").select(T.richness_tokens(F.col("t")).alias("r"), T.overlap_tokens(F.col("t")).alias("o")).first()
    assert r.r == re.findall(r"\b[a-zA-Z0-9]+(?:'[a-zA-Z0-9]+)?\b", text.lower()) == ["3rd", "don't", "x"]
    assert r.o == re.findall(r"\b[a-zA-Z0-9]+(?:['\-_][a-zA-Z0-9]+)*\b", text.lower())


def test_sentences_lose_spaces_and_no_digits(spark):
    text = " One 1.  1st came 1. 2 or 2. 34563. 456 of 44. \t5 "
    got = spark.createDataFrame([(text,), ("0",), (None,)], "t string").select(T.sentences(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [["One 1.", "1st came 1.", "2 or 2.", "34563.", "456 of 44.", "5"], ["0"], []]
