"""Every registered query of the library against its SQL in DuckDB, on the driver's smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lectern import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_same_as_sql(spark, tables, duck, name):
    df = entry.queries()[name](spark, tables)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    other = duck.sql(core.ORACLE[name])
    at = [other.columns.index(c) for c in cols]
    assert sorted(other.columns) == cols
    assert mine == sorted(repr(tuple(r[i] for i in at)) for r in other.fetchall())


@pytest.mark.parametrize("name", sorted(core.QUERIES.keys() - core.ORACLE.keys()))
def test_rows_without_sql(spark, tables, name):
    rows = entry.queries()[name](spark, tables).collect()
    assert rows
    if name == "stream_equals_batch":
        assert rows[0].differ == 0 and rows[0].rows > 0


def test_entry(spark, tables):
    assert entry.entry(spark).count() > 0


def test_oracle_names():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_nothing_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in (root / "lectern").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lectern.llm" not in p.read_text()


NUMBERED = "detect_metrics detect_new freq_rank freq_top3 freq_top_words item_status known_counts method_join sim_edges surface_form tfidf_rank tfidf_top3 vocab_extract_plain vocab_score".split()


@pytest.fixture(scope="module")
def numbered(spark, tables, tmp_path_factory):
    """Documents whose sentences begin and end with the digits of their own places, among the driver's benchmark items."""
    here = str(tmp_path_factory.mktemp("numbered"))
    item = spark.read.parquet(f"{tables}/benchmark.parquet").orderBy("item_id").first()
    word = item.text.split()[0].lower()
    texts = [
        "alpha beta. 1alpha gamma. 2beta delta 2. 3alpha alpha. alpha 4444. beta 5alpha 5",
        "200 alpha. 141 " + word + ". 222. 3" + word + " beta. 4568844. gamma gamma. 16.195.23.156",
        "".join(f"{k}term {k % 10}word{k % 4} closing {k}{k}. " for k in range(25)),
        "one 1. " + " ".join(f"{k}" * (k % 3 + 3) + " beta" * (k % 4) + "." for k in range(1, 9)),
    ]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{here}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").coalesce(1).write.parquet(f"{here}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{here}/{t}.parquet/*.parquet'")
    return here, c


@pytest.mark.parametrize("name", NUMBERED)
def test_numbered_sentences_same_as_sql(spark, numbered, name):
    here, c = numbered
    test_same_as_sql(spark, here, c, name)


@pytest.mark.parametrize("name", ["vocab_extract", "vocab_extract_plain"])
def test_half_scores_are_rounded_as_in_sql(spark, tmp_path, name):
    """Of 64 sentences a word of one has 0.40625."""
    text = " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}xx." for k in range(64))
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    test_same_as_sql(spark, str(tmp_path), c, name)


def test_detect_new_deals_texts_out_at_most(spark, tables):
    """One exchange, of small tables' texts, where occurrences and items went through 38."""
    found = entry.queries()["detect_new"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert found.count("Exchange") <= 1 and found.count("MapInArrow") == 1
