import pytest

from lectern import schemas
from lectern.operators import known, vocabulary


def token(text, pos="NOUN", stop=False, punct=False, lemma=None):
    return {"text": text, "normalized": text.lower(), "lemma": lemma or text.lower(), "pos": pos, "tag": "", "is_stop": stop, "is_punct": punct}


def article(spark, *sentences, row="1"):
    full = [{"sentence_index": i, "original_text": "", **s} for i, s in enumerate(sentences)]
    return spark.createDataFrame([{"id": row, "processed_sentences": full}], schemas.ANNOTATED)


def test_score(spark):
    w = {"alpha_frequency": 0.25, "beta_coverage": 0.35, "gamma_entity": 0.4}
    lines = [{"token_details": [token("Lantern"), token("glows", "VERB")]}, {"token_details": [token("lantern"), token("of", "ADP", stop=True)], "entities": [{"text": "ESA", "label": "ORG", "start_char": 0, "end_char": 3}]}, {"token_details": [token("dimly", "ADV"), token("lantern"), token("lantern")]}]
    r = vocabulary.extract(article(spark, *lines), vocabulary.Options(weights=w)).first()
    items = {x.normalized_form: x for x in r["items"]}
    # Of four occurrences at most: shares 1 and 1/4; of three sentences: 3 and 1.
    assert items["lantern"].importance_score == 0.6 and items["glows"].importance_score == round(0.25 / 4 + 0.35 / 3, 4)
    assert items["dimly"].importance_score == round(0.8 * (0.25 / 4 + 0.35 / 3), 4) and items["esa"].importance_score == round(0.25 / 4 + 0.35 / 3 + 0.4, 4)
    assert items["lantern"].term == "lantern" and items["lantern"].sentence_indices == [0, 1, 2] and items["lantern"].frequency == 4
    assert items["esa"].entity_label == "ORG" and items["esa"].pos == "PROPN" and r.total_candidate_items == 4
    assert items["glows"].selection_reason == "Salient VERB occurring 1 time(s) across 1 sentence(s) (coverage: 33.3%)."


def test_reasons_round_as_python(spark):
    for n in (16, 80):  # 1/16 is 6.25 %, a tie, and 1/80 is 1.25 %
        r = vocabulary.extract(article(spark, {"token_details": [token("keel")]}, *[{"token_details": [token("oar")]}] * (n - 1))).first()
        assert [x for x in r["items"] if x.term == "keel"][0].selection_reason.endswith(f"(coverage: {1 / n:.1%}).")


def test_fallback_path_per_sentence(spark):
    df = article(spark, {"tokens": ["Red", "cat", "x", "--"], "lemmas": ["red"], "pos": ["ADJ"], "content_tokens": ["red", "cat"]}, {"token_details": [token("cats", lemma="cat")]}, {"tokens": ["quick"], "pos": ["INTJ"]})
    got = {(x.lemma, x.pos): x.frequency for x in vocabulary.extract(df).first()["items"]}
    assert got == {("red", "ADJ"): 1, ("cat", "NOUN"): 2}


def test_order_limits_and_empty(spark):
    df = article(spark, {"token_details": [token(w) for w in ("delta", "beta", "alpha")]})
    r = vocabulary.extract(df, vocabulary.Options(max_items=0)).first()
    assert [x.term for x in r["items"]] == ["delta"] and r.configuration.max_items == 1
    assert vocabulary.extract(article(spark)).first()["items"] == []
    today = article(spark, {"token_details": [token("today")], "entities": [{"text": "today", "label": "DATE"}]})
    assert vocabulary.extract(today).first().total_candidate_items == 2
    assert vocabulary.extract(today, vocabulary.Options(include_entities=False)).first().total_candidate_items == 1


@pytest.mark.parametrize("bad", [{"alpha_frequency": 1.0}, {"alpha_frequency": 0.5, "beta_coverage": 0.5, "gamma_entity": 0.5}, {"alpha_frequency": -0.2, "beta_coverage": 1.0, "gamma_entity": 0.2}, {"alpha_frequency": float("nan"), "beta_coverage": 0.5, "gamma_entity": 0.5}])
def test_bad_weights(bad):
    with pytest.raises(ValueError):
        vocabulary.Options(weights=bad)


def test_known_entries(spark, tmp_path):
    rows = known.known_words(spark, [7.5, "Anchor ", {"label": "GPE"}, "\t", None, {"word": " Keel ", "lemma": "keel", "label": "ORG"}])
    assert known.additions(rows).first().added == 5
    assert {r.word for r in known.lookup(rows).collect()} == {"anchor", "7.5", "keel"}
    for name, content, expected in (("a.txt", "One\n\n two ", {"one", "two"}), ("b.json", '["x", {"term": "Y"}]', {"x", "y"}), ("c.json", '{"words": ["p"]}', {"p"}), ("d.json", '{"k1": 1, "k2": 2}', {"k1", "k2"}), ("e.jsonl", '{"term": "t"}\n"s"\nraw line\n7\n', {"t", "s", "raw line"})):
        (tmp_path / name).write_text(content)
        assert {r.word for r in known.lookup(known.read_known(spark, str(tmp_path / name))).collect()} == expected
    (tmp_path / "f.json").write_text("3")
    with pytest.raises(ValueError):
        known.read_known(spark, str(tmp_path / "f.json"))


def test_detect(spark):
    df = article(spark, {"token_details": [token("Cats", lemma="cat"), token("dog"), token("bird")]})
    items = vocabulary.extract(df)
    words = known.known_words(spark, [" CAT", "bird"])
    r = known.detect(items, words).first()
    assert [x.term for x in r.known_words] == ["Cats", "bird"] and [x.term for x in r.new_words] == ["dog"]
    assert r.validation.reconciled and r.known_word_count + r.new_word_count == r.total_vocabulary_count
    m = known.batch_metrics(known.detect(items, words), words).first()
    assert (m.known_percent, m.new_percent, m.std_new, m.known_vocabulary_size) == (66.67, 33.33, 0.0, 2)
    assert known.detect(items, words.limit(0)).first().known_words == []


def test_known_forms_lose_all_white_space(spark):
    items = spark.createDataFrame([(1, "Cat\t", "x", "y"), (2, "x", "\n cat\u2003", "y"), (3, "x", "y", "z"), (4, None, " ", "CAT\n")], "k int, normalized_form string, lemma string, term string")
    got = known.classify(items, known.known_words(spark, ["cat"]), ["k"]).orderBy("k").collect()
    assert [r.is_known for r in got] == [True, True, False, True]


def test_batch_metrics(spark):
    total, by_pos, by_label = vocabulary.batch_metrics(vocabulary.extract(article(spark, {"token_details": [token("dog"), token("run", "VERB")], "entities": [{"text": "X1", "label": "ORG"}]})))
    assert total.first()["items"] == 3 and {r.pos for r in by_pos.collect()} == {"NOUN", "VERB", "PROPN"} and by_label.first().entity_label == "ORG"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extract_shuffles_nothing(spark):
    """Shuffled occurrences took more disk than four times the documents."""
    assert "Exchange" not in plan(vocabulary.extract(article(spark, {"token_details": [token("oar")]})))


def test_detect_shuffles_nothing_and_extracts_once(spark):
    items = vocabulary.extract(article(spark, {"token_details": [token("oar")]}))
    found = plan(known.detect(items, known.known_words(spark, ["oar"])))
    assert "Exchange" not in found and found.count("MapInArrow") == 1


def _odd_articles():
    import random

    r = random.Random(7)
    words = ["Keel", "keel", "KEEL ", " hull ", "İstanbul", "ΛΟΓΟΣ", "straße", "x", "", " ", "--", "é", "ab", "Ab", "aB", "٣٤", "Ⅷa", "of", "\x1cgs", "🚢🚢", "🚢a", None]
    pick = lambda *more: r.choice([*words, *more])
    some = lambda f, n=6: r.choice([None, [], *[[f() for _ in range(r.randint(1, n))] for _ in range(6)]])
    pos = lambda: r.choice(["NOUN", "ADV", "VERB", "PRON", None])

    def sentence(k):
        details = some(lambda: {"text": pick(), "normalized": pick(), "lemma": pick(), "pos": pos(), "tag": None, "is_stop": r.choice([None, False, False, True]), "is_punct": r.choice([None, False])})
        return {
            "sentence_index": r.choice([None, k, k, k, 3, -2]), "original_text": "", "tokens": some(pick, 9), "content_tokens": r.choice([None, [], [w and w.strip().lower() for w in words[:9]] + [None]]), "lemmas": some(pick), "pos": some(pos),
            "token_details": r.choice([None, [], details]), "entities": some(lambda: {"text": pick("A Keel"), "label": r.choice(["ORG", " GPE ", "", None]), "start_char": 0, "end_char": 0}),
        }

    return [{"id": f"a{i}", "processed_sentences": r.choice([None, [], *[[r.choice([None, *[sentence(k)] * 9]) for k in range(r.randint(1, 8))]] * 18])} for i in range(120)]


@pytest.mark.parametrize("half_even", [True, False])
def test_extract_is_score_of_candidates(spark, half_even):
    """The row-local form and the relations agree on null, blank, foreign and repeated parts."""
    from lectern.functions.text import py_round

    rounded = py_round if half_even else lambda x, n: spark_round(x, n)
    df = spark.createDataFrame(_odd_articles(), schemas.ANNOTATED)
    for options in (vocabulary.Options(), vocabulary.Options(max_items=3, min_term_length=1, include_entities=False, pos_weights={"NOUN": 0.5, "VERB": 2.0})):
        ranked = vocabulary.score(vocabulary.candidates(df, options), options, rounded=rounded).where(f"rank <= {options.max_items}")
        expected = {(r.id, r["rank"]): (r.candidates, r.term, r["first"].form, r.lemma, r.pos, r.frequency, r.sentence_indices, r.label if r.type == "ENTITY" else None, r.importance_score) for r in ranked.collect()}
        made = vocabulary.extract(df, options, rounded).collect()
        got = {(r.article_id, k): (r.total_candidate_items, i.term, i.normalized_form, i.lemma, i.pos, i.frequency, i.sentence_indices, i.entity_label, i.importance_score) for r in made for k, i in enumerate(r["items"], 1)}
        assert got == expected and len(got) > 200
        assert len(made) == 120 and all(r.returned_item_count == len(r["items"]) for r in made)


def spark_round(x, digits):
    from pyspark.sql import functions as F

    return F.round(x, digits)


def test_many_known_words_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(_odd_articles(), schemas.ANNOTATED)
    items = vocabulary.extract(df)
    words = known.known_words(spark, ["keel", "straße", "ab"])
    few = sorted(known.detect(items, words).collect(), key=lambda r: r.article_id)
    monkeypatch.setattr(known, "BROADCAST_ROWS", 1)
    assert few == sorted(known.detect(items, words).collect(), key=lambda r: r.article_id)
    assert sum(r.known_word_count for r in few) > 0 and all(r.validation.reconciled for r in few)
