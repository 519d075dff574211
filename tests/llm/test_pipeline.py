"""The pipeline's stages and whole queries on the smallest table."""

import hashlib

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from lectern.llm import bpe, decontaminate, pii, queries, simhash
from lectern.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, tables):
    docs, out = table(spark, tables, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, tables).toArrow())
        out.append((name, docs.toPandas()))
    return dict(out), table(spark, tables, "documents").toPandas()


def test_each_stage_works_on_what_the_last_one_kept(stages):
    out, docs = stages
    ids = [set(docs.doc_id)] + [set(out[name].doc_id) for name, _ in corpus_pipeline.STAGES]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 0
    assert all([*out[name].columns] == [*docs.columns] for name, _ in corpus_pipeline.STAGES[:-1])


def test_decisions_take_effect(spark, tables, stages):
    out, _ = stages
    kept = out["quality"]
    fps = np.array([simhash.fingerprint(t.encode()) for t in kept.text], np.uint64)
    order = np.argsort(kept.doc_id.to_numpy(), kind="stable")
    fps, ids = fps[order], kept.doc_id.to_numpy()[order]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    assert sorted(out["near_duplicates"].doc_id) == sorted({int(ids[find(i)]) for i in range(len(fps))})
    items = [(str(r.item_id), r.text.encode()) for r in table(spark, tables, "benchmark").collect()]
    found = decontaminate.scan(decontaminate.TestSet(items), [t.encode() for t in out["near_duplicates"].text])
    clean = [i for i, (n, hits, _, _) in zip(out["near_duplicates"].doc_id, found, strict=True) if not (len(hits) and 20 * sum(hits[1::2] - hits[::2]) >= n)]
    assert sorted(out["contamination"].doc_id) == sorted(clean)
    left, name = pii.find(spark.createDataFrame(out["personal_data"][["text"]]))
    assert left.where(f"size({name}) > 0").count() == 0
    assert (out["personal_data"].n_chars == out["personal_data"].text.str.len()).all()


def test_tokens(stages):
    out, _ = stages
    path, pattern = queries.tokenizer()
    with open(path, "rb") as f:
        theirs = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    texts = dict(zip(out["personal_data"].doc_id, out["personal_data"].text, strict=True))
    for r in out["tokens"].itertuples():
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_columns(spark, tables, name):
    columns = {
        "op2": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op3": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op4": ["doc_id", "held_out", "score", "predicted"],
        "op5": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op6": ["doc_id", "held_out", "score", "predicted"], "op7": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op8": ["doc_id", "fingerprint", "component_id"], "op9": ["page_id", "url", "text", "n_chars"], "op10": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op1": ["doc_id", "license", "containment"],
    }[name.split("_")[0]]
    df = queries.QUERIES[name](spark, tables)
    assert not set(columns) - set(df.columns)
    if name.split("_")[0] != "op1":
        assert df.count() == table(spark, tables, "pages" if "op9" in name else "documents").count()


ODD = "doc_id long, text string, score string, predicted string, items string, n_words long, contaminated string, hits string, spans string, near_hash string, near_text string, fp long, row string, c0 string, t string, `odd name` string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, missing ids, and columns named like those that operators add; none is n_chars."""
    prose = "The river was open to all of them and the wall of the town is old. " * 4
    rows = [(1, prose), (1, prose), (2, prose), (3, None), (4, ""), (None, None), (None, "Another text of the harbour and its boats, as long as it must be."), (5, prose * 400), (6, "mail a@b.example now"), (7, " \n ")]
    return spark.createDataFrame([(i, t, *[None if k % 2 else "clash"] * 3, None if k % 2 else 7, *["clash"] * 5, 3, *["clash"] * 4) for k, (i, t) in enumerate(rows)], ODD).repartition(3)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_documents(spark, tables, odd, name, stage):
    got = stage(spark, odd, tables)
    rows, before = got.collect(), odd.collect()
    if name == "tokens":
        assert len(rows) == len(before) and sum(r.n_tokens == 0 for r in rows) == sum(not r.text for r in before)
    else:
        assert got.columns == odd.columns
        if name == "personal_data":
            assert len(rows) == len(before) and {r.text for r in rows if r.doc_id == 6} == {"mail [EMAIL] now"} and sum(r.text is None for r in rows) == 2
        else:
            assert {tuple(r) for r in rows} <= {tuple(r) for r in before}
    if name == "near_duplicates":
        fps = [simhash.fingerprint((r.text or "").encode()) for r in before]
        group = [*range(len(fps))]
        for _ in fps:  # the smallest number spreads over links
            group = [min(group[j] for j, y in enumerate(fps) if (x ^ y).bit_count() <= 3) for x in fps]
        first = {}
        for g, r in zip(group, before, strict=True):
            first[g] = min(first.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted(first.values())
    if name == "contamination":
        assert len(rows) == len(before)
    assert stage(spark, odd.limit(0), tables).count() == 0


def test_run_is_its_stages_and_leaves_one_table(spark, tables, stages):
    out, _ = stages
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    got = corpus_pipeline.run(spark, tables)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, out["tokens"].itertuples(index=False)))
    (folder,) = {p.parent for p in shared.glob("pipeline-*/*")}
    assert [p.name for p in folder.iterdir()] == ["4-tokens"]


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from lectern.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)
