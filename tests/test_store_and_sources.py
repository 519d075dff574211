import json

import pytest
from pyspark.sql import functions as F

from lectern import cli, schemas
from lectern.functions.annotate import annotate, from_text
from lectern.operators import profile, store, summaries
from lectern.plans import services
from lectern.sources import articles as S
from lectern.streaming import streams


@pytest.fixture
def db(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/db")


def test_users(db):
    assert db.create_user(" Ann ", "h") == 1 and db.user_by_name("aNN")["id"] == 1 and db.user_by_id(1)["username"] == "Ann"
    with pytest.raises(ValueError):
        db.create_user("ANN", "h")
    assert db.user_by_id(0) is None and db.user_by_id(True) is None


def test_runs_and_notes(db):
    a = db.save_history(" s1 ", " TFIDF ", title="Été 100%", processing_timestamp="2024-01-01", metadata={"k": [1]}, user_id=1)
    b = db.save_history("s2", "frequency", article_text="a_b c\\d", processing_timestamp="2024-01-02", extracted_vocabulary="not json", user_id=2)
    c = db.save_history("s3", "tfidf", processing_timestamp="2024-01-02", user_id=1)
    assert [r.id for r in db.list_history().collect()] == [c, b, a] and [r.id for r in db.list_history(limit=0, offset=-3).collect()] == [c]
    assert db.count_history(method=" Tfidf") == 2 and db.count_history(user_id=2) == 1
    assert db.get_history(a, user_id=2) is None and json.loads(db.get_history(a, 1)["metadata"]) == {"k": [1]} and db.get_history(b)["extracted_vocabulary"] == "not json"
    assert db.count_search_history("100%") == 1 and db.count_search_history("a_b") == 1 and db.count_search_history("c\\d") == 1 and db.count_search_history("ÉTé") == 1
    assert db.count_search_history("ÉTÉ") == db.count_search_history("été") == 0 and db.count_search_history(" ") == 0 and db.count_search_history("S%") == 3 and db.count_search_history("'; DROP") == 0
    n = db.create_note(" c ", term="Word", example_sentence=" ", article_history_id=a, user_id=1)
    with pytest.raises(ValueError):
        db.create_note("c", article_history_id=a, user_id=2)
    assert db.get_note(n)["example_sentence"] is None and db.count_notes(term="wORD") == 1 and db.count_search_notes("WOR") == 1
    before = db.get_note(n)
    assert db.update_note(n, term="other", clear_term=True, content="new") and not db.update_note(99, content="x") and not db.update_note(n, content="x", user_id=5)
    after = db.get_note(n)
    assert (after["term"], after["content"], after["created_at"]) == (None, "new", before["created_at"]) and after["updated_at"] > before["updated_at"]
    with pytest.raises(ValueError):
        db.update_note(n, content=" ")
    assert not db.delete_history(a, user_id=2) and db.delete_history(a, user_id=1) and db.get_note(n)["article_history_id"] is None
    assert db.delete_history(c) and db.save_history("s4", "x") == c + 1  # an id is never used again
    assert db.delete_note(n) and not db.delete_note(n)
    with pytest.raises(ValueError):
        db.clear_history()
    assert db.clear_history(confirm=True) == 2 and db.count_history() == 0 and db.healthy()
    for bad in (("", "m"), ("s", " ")):
        with pytest.raises(ValueError):
            db.save_history(*bad)


def test_older_snapshot_without_owner(spark, db):
    db._commit("article_history", spark.createDataFrame([(5, "s", "m", "2024")], "id long, summary string, method string, processing_timestamp string"), 5)
    assert db.get_history(5)["user_id"] is None and db.save_history("t", "m") == 6


def test_additions_become_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ADDITIONS", 3)
    db = store.Store(spark, f"file://{tmp_path}/small")
    ids = [db.create_note(f"n{i}") for i in range(9)]
    assert ids == [*range(1, 10)] and db.count_notes() == 9
    folders = [p for p in (tmp_path / "small" / "vocabulary_notes").iterdir() if not p.name.startswith((".", "_"))]
    assert len(folders) <= 8  # what the last two snapshots need
    assert db.delete_note(4) and db.create_note("last") == 10 and {r.id for r in db.read("vocabulary_notes").collect()} == {1, 2, 3, 5, 6, 7, 8, 9, 10}


def test_changed_notes(spark, db):
    note = db.create_note("text")
    assert db.update_note(note, content="more", updated_at="2031-01-01") and db.get_note(note)["updated_at"] == "2031-01-01"
    with pytest.raises(ValueError):  # the link is checked before the note is looked for
        db.update_note(note + 100, article_history_id=12345)
    assert not db.update_note(note + 100, content="x") and not db.update_note(0, content="x")


def test_pages(spark, db):
    for i in range(3):
        db.create_note(f"n{i}")
    e = store.envelope(db.list_notes(2, 1), db.count_notes(), 2, 1)
    assert e["total"] == 3 and len(e["items"]) == 2 and store.page_number(40, 20) == 3
    with pytest.raises(ValueError):
        store.page_limit(501, 500)
    days = store.by_day(spark.createDataFrame([("2024-05-01T10:00:00+00:00",), ("x",)], "t string"), "t").collect()
    assert str(days[0].day)[:10] == "2024-05-01" and days[1].day is None


def raw(spark):
    rows = [("1", "Some text.", "h"), ("", "t", "h"), ("2", "", "h"), ("3", "t", "   "), ("1", "again", "h"), ("2", "t", "h"), (None, " ", None)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, article string, highlights string, input_pos long")


def test_validation(spark):
    r = profile.validation(raw(spark)).first()
    assert r.asDict() == {"total": 7, "valid": 1, "invalid": 6, "missing_ids": 2, "duplicate_ids": 2, "empty_articles": 2, "empty_highlights": 2}
    assert [x.id for x in profile.valid_rows(raw(spark)).collect()] == ["1"]
    assert profile.validation(raw(spark).limit(0)).first().total == 0


def test_profile(spark):
    df = spark.createDataFrame([("1", "A b c. D e!", "A b."), ("2", None, "x")], "id string, article string, highlights string")
    f = {r.id: r for r in profile.figures(df).collect()}
    assert (f["1"].article_words, f["1"].article_sentences, f["1"].compression_ratio, f["1"].ttr) == (5, 2, 0.4, 1.0) and f["2"].ttr == 0
    p = profile.profile(df).first()
    assert (p.article_words_mean, p.article_words_std, p.article_words_median) == (2.5, 2.5, 2.5)
    assert profile.profile(df.limit(0)).first().article_words_max == 0
    a = profile.annotation_profile(annotate(df))
    assert a.first().articles == 2 and a.where("articles = 0").count() == 0 and profile.annotation_profile(annotate(df.limit(0))).count() == 0


def test_sources(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": "a", "article": "é x", "highlights": "h"}\n\n  \n{"id": "b"}\n')
    assert [r.id for r in S.first_records(S.read_strict(spark, str(good)), 1).collect()] == ["a"] and S.first_records(S.read_strict(spark, str(good)), 0).count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "a"}\n{broken\n')
    with pytest.raises(ValueError, match="line 2 of .*bad.jsonl"):
        S.read_strict(spark, str(bad))
    far = tmp_path / "far.jsonl"
    far.write_text('{"id": "a"}\n\n' * 20_000 + "{broken\n" + '{"id": "b"}\n' * 20_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        with pytest.raises(ValueError, match="line 40001 of"):
            S.read_strict(spark, str(far))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    many = spark.range(100).select(F.col("id").cast("string").alias("id"), F.struct(F.lit("f").alias("file"), (200 - F.col("id")).alias("line")).alias(S.POSITION)).repartition(5)
    assert [r.id for r in S.sample(many, 3).collect()] == ["99", "98", "97"]
    assert sorted(S.sample(many, 9, shuffle=True).collect()) == sorted(S.sample(many.repartition(2), 9, shuffle=True).collect())
    rows, wrong = S.read_lenient(spark, str(bad))
    assert rows.count() == 1 and [r.value for r in wrong.collect()] == ["{broken"]
    with pytest.raises(Exception):
        S.read_failing(spark, str(bad), schemas.RAW_ARTICLE).collect()
    empty = tmp_path / "empty.jsonl"
    empty.write_text("\n")
    with pytest.raises(ValueError):
        S.read_strict(spark, str(empty))
    note = tmp_path / "note.v1.txt"
    note.write_text("one\ntwo")
    r = S.read_whole_text(spark, str(note)).first()
    assert (r.id, r.article) == ("note.v1", "one\ntwo")
    S.write_jsonl(S.read_strict(spark, str(good)).drop(S.POSITION), f"{tmp_path}/out")
    assert "é x" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    with pytest.raises(ValueError):
        S.sample(rows, 0)
    assert S.point_lookup(rows, "a").count() == 1
    with pytest.raises(ValueError):
        S.point_lookup(rows, "z")


def test_stream_equals_batch(spark, tmp_path):
    text = "The river is long. A stone wall is old. The river wall is open."
    for i in range(3):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.json").write_text(json.dumps({"id": str(i), "article": text * (i + 1), "highlights": "h"}) + "\nnot json\n")
    for method in summaries.METHODS:
        stream = streams.summarize_stream(streams.annotate_stream(streams.read_articles(spark, str(folder))), method, 2)
        streams.append_to(stream, f"{tmp_path}/{method}", f"{tmp_path}/{method}-state").awaitTermination()
        batch = summaries.summarize(annotate(spark.read.schema(schemas.RAW_ARTICLE).option("mode", "DROPMALFORMED").json(str(folder))), method, 2)
        got = spark.read.schema(schemas.SUMMARY).parquet(f"{tmp_path}/{method}")
        assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect())) and got.count() == 3
    figures = lambda df: df.agg(F.count("*").alias("n"))
    streams.corpus_figures(streams.read_articles(spark, str(folder)), figures, f"{tmp_path}/f", f"{tmp_path}/f-state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/f").agg(F.sum("n")).first()[0] == 3


def test_services_and_command_lines(spark, tmp_path, capsys):
    text = "The river is long. A stone wall is old. The river wall is open."
    assert services.summarize_text(spark, text, " Frequency ", 1).first().num_sentences_selected == 1
    assert services.summarize_all(annotate(services.one_article(spark, text)), 1).count() == 3
    assert services.detect_new(spark, ["river"], text=text).first().known_word_count == 1
    with pytest.raises(ValueError):
        services.detect_new(spark, [], text=" ")
    path = tmp_path / "raw.jsonl"
    path.write_text("".join(json.dumps({"id": str(i), "article": text, "highlights": "river wall"}) + "\n" for i in range(3)))
    cli.main(["explore", "--input", str(path), "--output-json", f"{tmp_path}/p.json", "--output-md", f"{tmp_path}/p.md"])
    assert json.loads((tmp_path / "p.json").read_text())["valid"] == 3 and "| valid | 3 |" in (tmp_path / "p.md").read_text()
    assert json.loads((tmp_path / "p.json").read_text())["split"] == "validation" and capsys.readouterr().out.count('"highlights"') == 3
    cli.main(["sample", "--input", str(path), "--output", f"{tmp_path}/s", "--samples", "2"])
    assert spark.read.json(f"{tmp_path}/s").count() == 2
    (tmp_path / "train.jsonl").write_text(path.read_text())
    cli.main(["sample", "--input", f"{tmp_path}/{{split}}.jsonl", "--split", "train", "--output-dir", f"{tmp_path}/raw", "--samples", "1"])
    assert [r.id for r in spark.read.json(f"{tmp_path}/raw/articles_train_1").collect()] == ["0"]
    cli.main(["explore", "--input", f"{tmp_path}/train.jsonl", "--output-json", f"{tmp_path}/t.json", "--num-samples-display", "0"])
    assert json.loads((tmp_path / "t.json").read_text())["split"] == "train" and capsys.readouterr().out == ""
    cli.main(["annotate", "--input", str(path), "--output", f"{tmp_path}/a", "--stats-json", f"{tmp_path}/a.json", "--samples-to-show", "2"])
    assert capsys.readouterr().out.count('"processed_sentences"') == 2
    for wrong in ([], ["--text", text, "--batch"], ["--dataset", f"{tmp_path}/a"]):
        with pytest.raises(SystemExit):
            cli.main(["tfidf", *wrong])
    for m in summaries.METHODS:
        cli.main([m, *(["--batch", "--input"] if m == "tfidf" else ["--dataset"]), f"{tmp_path}/a", "-k", "1", "--output", f"{tmp_path}/{m}"])
    cli.main(["tfidf", "--article", text, "--sentences", "1"])
    assert json.loads(capsys.readouterr().out)["num_sentences_selected"] == 1
    cli.main(["textrank", "--dataset", f"{tmp_path}/a", "--id", "1"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["id"] == "1"
    cli.main(["vocabulary", "--dataset", f"{tmp_path}/a", "--output", f"{tmp_path}/v", "--max-items", "3"])
    cli.main(["detect", "--input", f"{tmp_path}/v", "--known", "river,", "--output", f"{tmp_path}/d"])
    assert spark.read.json(f"{tmp_path}/d").count() == 3
    cli.main(["evaluate", "--references", str(path), *[x for m in summaries.METHODS for x in (f"--{m}", f"{tmp_path}/{m}")], "--output-json", f"{tmp_path}/e.json"])
    assert len(json.loads((tmp_path / "e.json").read_text())["winners"]) == 12


def test_from_text_is_stream_safe(spark):
    df = spark.createDataFrame([(1, "One river. Two walls."), (2, None)], "doc_id long, text string")
    assert [len(r.processed_sentences) for r in from_text(df).orderBy("id").collect()] == [2, 0]
