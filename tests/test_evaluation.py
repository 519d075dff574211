import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import compare, rouge
from lectern.plans import services

PAIRS = [("the cat sat on the mat", "the dog sat on the rug"), ("cat cat cat cat cat", "the cat is black"), ("apple banana cherry date", "banana apple date cherry"), ("police arrested three suspects on Tuesday", "police arrested suspects on Tuesday morning"), ("", "x"), ("x", "x")]


def scores(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, c string, r string")
    return [r.s for r in df.select("i", rouge.score_pair(F.col("c"), F.col("r")).alias("s")).orderBy("i").collect()], df


def test_hand_cases(spark):
    s, _ = scores(spark, PAIRS)
    assert s[0].rouge1.precision == s[0].rouge1.recall == s[0].rouge1.f1 == 0.666667
    assert (s[1].rouge1.precision, s[1].rouge1.recall) == (0.2, 0.25)
    assert s[2].rouge2.f1 == 0 and s[3].rougeL.f1 == 0.833333
    assert s[4].rouge1.f1 == s[4].rougeL.f1 == 0 and s[5].rougeL.f1 == 1 and s[5].rouge2.f1 == 0


def test_lcs_forms_agree(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    rows.append(("the brown fox jumps high".split(), "the quick brown fox jumps".split()))
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", rouge.lcs(F.col("a"), F.col("b")).alias("x"), rouge.lcs_batch("a", "b").alias("y")).collect()

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    assert all(r.x == r.y == plain(r.a, r.b) for r in got) and got[-1].x == 4


def test_relational_form_agrees_and_is_symmetric(spark):
    s, df = scores(spark, PAIRS)
    for n, name in ((1, "rouge1"), (2, "rouge2")):
        got = {r.i: r for r in rouge.rouge_n(df, n, "i", "c", "r").collect()}
        back = {r.i: r for r in rouge.rouge_n(df, n, "i", "r", "c").collect()}
        for i, x in enumerate(s):
            assert (got[i].precision, got[i].recall, got[i].f1) == tuple(x[name])
            assert (back[i].recall, back[i].precision) == (got[i].precision, got[i].recall)


def long(spark, rows):
    return spark.createDataFrame(rows, "id string, method string, metric string, precision double, recall double, f1 double")


def test_winners_and_best(spark):
    df = long(spark, [("1", "frequency", "rouge1", 0.1, 0.1, 0.5), ("1", "tfidf", "rouge1", 0.1, 0.1, 0.5 + 5e-7), ("2", "frequency", "rouge1", 0.0, 0.0, 0.0), ("2", "tfidf", "rouge1", 0.0, 0.0, 0.0), ("3", "tfidf", "rouge1", 0.0, 0.0, 0.9), ("4", "frequency", "rouge1", 0.0, 0.0, 0.9)])
    got = {r.winner: r.articles for r in compare.winners(df).collect()}
    assert got == {"frequency": 1, "tfidf": 1, "textrank": 0, "tie": 2}
    assert compare.best_methods(df).first().method == "frequency"
    one = compare.describe(df.where("id = '3'"), ["method"], "f1").first()
    assert one["std"] == 0 and one["mean"] == 0.9


def test_files_end_to_end(spark):
    table = lambda rows, kind: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"input_pos int, id string, article_id string, {kind} string")
    refs = table([("a", None, "old"), ("", "b", "the dog sat"), ("a", None, "the cat sat"), (None, None, "lost")], "highlights")
    made = {m: table([("a", None, "the cat sat"), ("b", None, x)], "summary") for m, x in (("frequency", "the dog"), ("tfidf", "no"), ("textrank", "the dog"))}
    out = services.evaluate_files(refs, made)
    assert out["articles"].count() == 2 * 3 * 3
    best = {r.metric: r.method for r in out["best"].collect()}
    assert best["rouge1"] == "frequency"
    assert {(r.metric, r.winner): r.articles for r in out["winners"].collect()}["rouge1", "tie"] == 2
    assert compare.article_table(out["articles"]).count() == 2
    with pytest.raises(ValueError):
        compare.evaluate(refs.select("id", "highlights").limit(0), {m: df.select("id", "summary") for m, df in made.items()})
    assert services.evaluate_pair(spark, "a b", "a b")["rouge2"]["f1"] == 1
    with pytest.raises(ValueError):
        services.evaluate_pair(spark, " ", "x")
