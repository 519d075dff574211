import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.annotate import from_text
from lectern.operators import ranking, summaries, vectors
from lectern.sources import articles as articles_source


def articles(spark, *records):
    rows = [(str(i), [(k, f"S{k}.", c) for k, c in sents], "h") for i, sents in enumerate(records)]
    return spark.createDataFrame(rows, "id string, processed_sentences array<struct<sentence_index int, original_text string, content_tokens array<string>>>, highlights string")


def one(spark, sentences, method, k=3, **options):
    return summaries.summarize(articles(spark, sentences), method, k, **options).first()


def test_hand_tfidf(spark):
    # Of four lines, harbour is in all, tide in two, the others in one each.
    lines = [["harbour", "tide"], ["harbour", "tide", "gull", "gull"], ["harbour", "lantern"], ["harbour", "rope", "anchor"]]
    df, idf = summaries.inverse_frequencies(lines)
    assert (df["harbour"], df["tide"], df["gull"]) == (4, 2, 1) and (idf["harbour"], idf["tide"], idf["gull"]) == (0, math.log(2), math.log(4))
    want = [math.log(2) / 4, (math.log(2) / 4 + math.log(4) / 2) / 4, math.log(4) / 4, 2 * math.log(4) / 9]
    r = one(spark, [(k + 1, words) for k, words in enumerate(lines)], "tfidf", 4)
    assert [s.score for s in r.selected_sentences] == [round(x, 4) for x in want] and r.summary == "S1. S2. S3. S4."
    assert [s.sentence_index for s in one(spark, [(k + 1, words) for k, words in enumerate(lines)], "tfidf", 2).selected_sentences] == [3, 4]
    _, smooth = summaries.inverse_frequencies(lines, True)
    assert (smooth["harbour"], smooth["gull"]) == (math.log(2), math.log(5))
    assert [s.sentence_index for s in one(spark, [(4, []), (9, ["sail", "mast"])], "tfidf", 1).selected_sentences] == [9]  # both score 0: the one with words


def test_frequency(spark):
    r = one(spark, [(0, ["oar", "Keel "]), (1, ["oar", "oar"]), (2, [])], "frequency", 0)
    assert r.num_sentences_selected == 1 and r.selected_sentences[0].sentence_index == 1
    assert [(t.term, t.frequency, t.normalized_frequency) for t in r.top_terms] == [("oar", 3, 1.0), ("keel", 1, 0.333333)]


def test_pagerank():
    # A star: the hub gives a third to each leaf, leaves give all back; so hub = 0.15 / 4 + 0.85 * (1 - hub).
    star = np.zeros((4, 4))
    star[0, 1:] = star[1:, 0] = 0.4
    s, _, done, change = summaries.pagerank(star, tolerance=1e-12, iterations=500)
    hub = (0.15 / 4 + 0.85) / 1.85
    assert done and change < 1e-12 and np.allclose(s, [hub, *[(1 - hub) / 3] * 3])
    # A node without links keeps its own share and gives it to all: x = 0.05 + 0.85 x / 3.
    s, *_ = summaries.pagerank(np.array([[0, 0, 0], [0, 0, 0.7], [0, 0.7, 0]]), tolerance=1e-12, iterations=500)
    assert np.allclose(s, [0.05 / (1 - 0.85 / 3), *[(1 - 0.05 / (1 - 0.85 / 3)) / 2] * 2])
    assert summaries.pagerank(star, iterations=3)[1:3] == (3, False)
    assert summaries.pagerank(np.zeros((0, 0)))[1:] == (0, True, 0.0)
    assert summaries.pagerank(np.zeros((1, 1)))[0].tolist() == [1.0]


def test_graph(spark):
    r = one(spark, [(3, ["a"]), (1, ["b"]), (2, ["c"])], "textrank", 2)
    assert [x.sentence_index for x in r.ranking] == [1, 2, 3] and r.summary == "S1. S2."
    # Two lines share one of two words each, whose weights are equal; a third shares nothing.
    sim = summaries.similarity([["ferry", "night"], ["ferry", "storm"], ["ledger", "ink"], ["quay"]])
    weight = {"ferry": math.log(2), "night": math.log(4)}
    assert abs(sim[0, 1] - weight["ferry"] ** 2 / (weight["ferry"] ** 2 + weight["night"] ** 2)) < 1e-12 and not sim[2].any() and not sim[3].any() and not sim.diagonal().any()
    assert one(spark, [], "textrank").metadata.converged and one(spark, [(0, ["x"])], "textrank").ranking[0].textrank_score == 1.0


def test_graph_without_its_matrix():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    for n in (0, 1, 2, 5, 60):
        contents = [[words[int(30 * rng.random() ** 2)] for _ in range(rng.randrange(9))] for _ in range(n)] + [["alone"]] * (n > 2)
        (a, *how_a), (b, *how_b) = summaries.rank_graph(contents), summaries.pagerank(summaries.similarity(contents))
        assert np.allclose(a, b, atol=1e-13) and how_a[:2] == how_b[:2] and abs(how_a[2] - how_b[2]) < 1e-12
    # Every word in every sentence, or no words at all: no links, equal shares.
    assert summaries.rank_graph([["x"], ["x"], ["x"]])[0].tolist() == summaries.rank_graph([[], [], []])[0].tolist() == [1 / 3] * 3


def test_spread(spark):
    few = spark.range(100).coalesce(1)
    out = articles_source.spread(few)
    assert out.rdd.getNumPartitions() > 1 and sorted(out.collect()) == sorted(few.collect())
    large = spark.range(1 << 40)
    assert articles_source.spread(large) is large


def test_nearest(spark):
    rng = random.Random(3)
    data = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(160)] + [(160, None), (None, [1.0, 1.0, 0.0, 0.0]), (161, [0.0] * 4)]
    data = [(i, [1.0, 0.0, 0.0, 0.0] if v and not any(v) and i < 160 else v) for i, v in data]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "a": F.lit(1)})
    known = {i: np.array(v) / np.linalg.norm(v) for i, v in data if i is not None and v is not None and any(v)}
    want = set()
    for q in range(0, 160, 20):
        order = sorted(((-(math.floor(float(known[q] @ v) * 1e4 + 0.5) / 1e4), i) for i, v in known.items() if i != q))[:3]
        want |= {(q, i, -c, r + 1) for r, (c, i) in enumerate(order)}
    for blocks in ({}, {"queries": 3, "rows": 50}):
        assert {tuple(r) for r in vectors.nearest(df, F.col("vec_id") % 20 == 0, 3, **blocks).collect()} == want
    assert vectors.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 3).count() == 0


def test_method_names():
    assert summaries.method_named(" TFIDF ") == "tfidf"
    with pytest.raises(ValueError):
        summaries.method_named("none")


def texts(spark):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(25)] + ["the", "of"]
    rows = [(i, " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) + "." for _ in range(rng.randint(0, 12)))) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)


def test_relations_agree_with_row_local_form(spark):
    df, _ = texts(spark)
    terms = ranking.term_rows(df, T.sentences(F.col("text")), T.portable_content)
    local = {m: {r.id: r for r in summaries.summarize(from_text(df), m, 3).collect()} for m in summaries.METHODS}
    for method, scores, order in (("frequency", ranking.frequency_scores(terms), []), ("tfidf", ranking.tfidf_scores(terms), [F.col("len") == 0])):
        got = ranking.top(ranking.ranked(scores, *order), 3).collect()
        for i, r in local[method].items():
            mine = {(x.idx, round(x.score, 4)) for x in got if str(x.doc_id) == i}
            assert {x for x, _ in mine} == {s.sentence_index for s in r.selected_sentences}
            assert all(abs(dict(mine)[s.sentence_index] - s.score) <= 1.1e-4 for s in r.selected_sentences)
    nodes = ranking.sentence_rows(df, T.sentences(F.col("text"))).select("doc_id", "idx")
    ranks = {(r.doc_id, r.idx): r.score for r in ranking.pagerank(nodes, ranking.similarity_edges(terms), 60).collect()}
    for i, r in local["textrank"].items():
        assert abs(sum(v for (d, _), v in ranks.items() if str(d) == i) - (1 if r.ranking else 0)) < 1e-9
        assert all(abs(ranks[int(i), x.sentence_index] - x.textrank_score) < 1e-4 for x in r.ranking)


def test_top_words_and_terms(spark):
    df = spark.createDataFrame([(1, "Oar keel oar mast.")], "doc_id long, text string")
    terms = ranking.term_rows(df, T.sentences(F.col("text")), T.portable_content)
    assert [(r.term, r.frequency) for r in ranking.frequency_top_words(terms).orderBy("rank").collect()] == [("oar", 2), ("keel", 1), ("mast", 1)]
    assert {r.term: r.tf for r in ranking.tfidf_top_terms(terms).collect()} == {"oar": 0.5, "keel": 0.25, "mast": 0.25}


def test_batch_metrics(spark):
    s = summaries.summarize(from_text(texts(spark)[0]), "textrank", 2)
    r = summaries.batch_metrics(s, "textrank").first()
    assert r.articles == 30 and r.total_selected <= 60 and r.mean_iterations >= 0
    assert summaries.batch_metrics(summaries.summarize(from_text(texts(spark)[0]), "frequency"), "frequency").first().max_selected <= 3


def test_repartitioning_changes_nothing(spark):
    df, _ = texts(spark)
    a, b = (sorted(map(str, summaries.summarize(from_text(df.repartition(n)), "textrank", 3).collect())) for n in (1, 5))
    assert a == b


def test_one_shuffle(spark):
    df, _ = texts(spark)
    plan = ranking.ranked(ranking.tfidf_scores(ranking.term_rows(df, T.sentences(F.col("text")), T.portable_content)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
