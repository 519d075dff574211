"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import bpe, byte_cnn, decontaminate, html_text, licenses, pii, quality_rules, simhash, substrings, toxicity
from lectern.llm.common import col, settings
from lectern.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, score string, spans string, row string, fp string, n_words string, kept string, t string, items string, near_hash string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and é river Stone wall, open. x1 a".split()) + rng.choice(["", "", "", str(rng.randrange(500))]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, long and repeated texts, repeated and missing ids, and columns named like those of the operators."""
    long = prose(1, 30_000)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "A"), (4, "one two"), (5, long), (6, long), (6, long), (None, prose(2, 60)), (None, None), (7, prose(2, 60)), (7, prose(3, 200)), (8, prose(3, 200)), (9, "😀 " * 50), (10, "\n".join(["same line here"] * 40)), (11, "x" * 20_000)]
    return spark.createDataFrame([(i, t, *[None if k % 2 else "clash"] * 9) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3), rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id():
    return {"doc_id": col("doc_id")}



def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


class TestBpe:
    def test_round_trip_and_reference_library(self, odd, none):
        import tiktoken

        path, pattern = tokenizer()
        with open(path, "rb") as f:
            ranks = bpe.read_ranks(f.read())
        theirs = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        df, rows = odd
        got = bpe.encode(df, path, pattern, keep=by_id() | {"text": col("text")}, digests=True).collect()
        assert len(got) == len(rows)
        for r in got:
            ids = theirs.encode_ordinary(r.text or "")
            assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == (r.text or "")
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
            assert all((r.text or "")[i:j] for i, j in zip(r.offsets[::2], r.offsets[1::2], strict=True))
        assert bpe.encode(none, path, pattern, keep=by_id()).count() == 0
        back = bpe.decode(bpe.encode(df, path, pattern, keep=by_id() | {"was": col("text")}), path, pattern, keep={"was": col("was")})
        assert all(r.decoded == (r.was or "") for r in back.collect())

    def test_split_characters(self):
        path, pattern = tokenizer()
        with open(path, "rb") as f:
            b = bpe.ByteBpe(bpe.read_ranks(f.read()), pattern)
        ids = array("I", b.encode(["a 😀"])[0])
        assert "".join(b.pieces(ids)) == "a 😀" and "�" in b.decode(ids[:-1]) and b.pieces([]) == []

    def test_any_text_as_the_reference_library(self):
        import tiktoken
        from hypothesis import given, settings
        from hypothesis import strategies as st

        path, pattern = tokenizer()
        with open(path, "rb") as f:
            ranks = bpe.read_ranks(f.read())
        ours, theirs = bpe.ByteBpe(ranks, pattern), tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        @settings(max_examples=300, deadline=None)
        @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'saé"))))
        def same(text):
            assert list(array("I", ours.encode([text])[0])) == theirs.encode_ordinary(text)

        same()


class TestQualityRules:
    def test_base_figures(self, odd, none):
        df, rows = odd
        got = quality_rules.quality_rules(df, keep=by_id() | {"text": col("text")}).collect()
        assert len(got) == len(rows)
        for r in got:
            w, t = words(r.text), r.text or ""
            lines = [x for x in t.split("\n") if words(x)]
            grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
            assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
            assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(hit))
            assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
        assert quality_rules.quality_rules(none, keep=by_id()).count() == 0

    def test_coverage_by_brute_force(self):
        t = prose(5, 120) + " " + " ".join(prose(5, 120).split()[20:60])
        w = t.split()
        m = quality_rules.measure([t.encode(), b"", prose(6, 90).encode()])
        for n in quality_rules.DUPLICATE_NGRAMS:
            grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            hit = {i + k for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for k in range(n)}
            assert m[f"dup_{n}gram_chars"][0] == sum(len(w[i]) for i in hit)

    def test_verdict(self):
        texts = [" ".join(f"word{i}" for i in range(200)), " ".join(f"{x}***" for x in range(200)), " ".join(f"WORD{i}" for i in range(200))]
        m = quality_rules.measure([t.encode() for t in texts])
        quality_rules.verdict(m)
        assert m["kept"].tolist() == [True, False, False]


class TestByteCnn:
    def test_chunks_cover(self):
        for n in (0, 1, byte_cnn.CHUNK, byte_cnn.CHUNK + 1, 5000):
            t = bytes(i % 251 + 1 for i in range(n))
            c = byte_cnn.chunks(t)
            assert b"".join([c[0].tobytes(), *(x[byte_cnn.CHUNK - byte_cnn.HOP :].tobytes() for x in c[1:])]).rstrip(b"\0") == t

    def test_learns_on_held_out_rows(self, spark, odd, none):
        clean = [(i, prose(i, 120), 1) for i in range(160)]
        junk = [(1000 + i, " ".join(f"{w}{'*$%&'[k % 4] * 3}" for k, w in enumerate(prose(i, 120).split())), 0) for i in range(80)]
        df = spark.createDataFrame(clean + junk, "doc_id long, text string, quality int")
        held = byte_cnn.held_out(col("doc_id"), 5, 0)
        net = byte_cnn.train(df.select("doc_id", "text"), df.where(~held).select("doc_id", "quality"))
        got = {r.doc_id: r for r in byte_cnn.score(df, net, keep=by_id() | {"held": held, "y": col("quality")}).collect()}
        assert all(r.held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
        assert np.mean([r.predicted == r.y for r in got.values() if r.held]) > 0.9
        scored = byte_cnn.score(odd[0], net, keep=by_id() | {"text": col("text")}).collect()
        assert len(scored) == len(odd[1]) and all(0 <= r.score <= 1 for r in scored)
        by_text = {}
        for r in scored:
            assert abs(by_text.setdefault(r.text or "", r.score) - r.score) < 1e-5
        assert byte_cnn.score(none, net, keep=by_id()).count() == 0

    def test_combines_as_it_scores(self, spark):
        texts = [(i, prose(i, 20 + 60 * (i % 25)) + (" *$%&#" * 30 + prose(-i, 400) if i % 3 == 0 else ""), int(i % 3 > 0)) for i in range(150)]
        df = spark.createDataFrame(texts, "doc_id long, text string, quality int")
        net = byte_cnn.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
        again = byte_cnn.ByteCnn()
        again.p = net.p
        x = again._features([t.encode() for _, t, _ in texts])
        assert abs(x).max() <= 20 and max(len(byte_cnn.chunks(t.encode())) for _, t, _ in texts) > 2 * byte_cnn.TEXT_WEIGHT
        again.fit_combine(x, np.array([y for *_, y in texts], np.float64))
        assert np.allclose(net.combine, again.combine, rtol=0.01, atol=0.01)

    def test_convolution_and_pooling_by_brute_force(self):
        net = byte_cnn.ByteCnn(7)
        rng = np.random.default_rng(7)
        net.p["bias"] = rng.normal(0, 1, byte_cnn.FILTERS).astype(np.float32)
        net.combine = np.array([0.1, 0.5, 0.3, -0.2])
        for size in (0, 3, 512, 513, 1300):
            text = bytes(rng.integers(0, 256, size, np.uint8))
            logits = []
            starts = [0]
            while starts[-1] + 512 < size:
                starts.append(starts[-1] + 384)
            for at in starts:
                chunk = text[at : at + 512].ljust(512, b"\0")
                answers = np.full(byte_cnn.FILTERS, -np.inf)
                for i in range(0, 512 - 7, 4):
                    seen = np.concatenate([net.p["embed"][b] for b in chunk[i : i + 8]])
                    answers = np.maximum(answers, seen[:32] @ net.p["near"] + seen[32:] @ net.p["far"])
                logits.append(np.maximum(answers + net.p["bias"], 0) @ net.p["out"] + net.p["base"][0])
            z = net.combine @ [1, np.mean(logits), np.min(logits), np.max(logits)]
            assert abs(net.score([text])[0] - 1 / (1 + np.exp(-z))) < 1e-4

    def test_passes_see_every_chunk_once(self, spark):
        rng = np.random.default_rng(3)
        data = {i: rng.integers(0, 256, (int(rng.integers(1, 400)), 512), np.uint8) for i in range(60)}
        rows = [(i, i % 2, len(x), k, x[a : a + 8].tobytes()) for i, x in data.items() for k, a in enumerate(range(0, len(x), 8))]
        df = spark.createDataFrame(rows, "row long, y int, n long, at int, piece binary").repartition(5)
        for epoch in range(2):
            got = Counter()
            for x, y, w in byte_cnn._steps(df, epoch):
                assert len(x) <= 64
                got.update((c.tobytes(), int(a), round(float(b), 5)) for c, a, b in zip(x, y, w, strict=True))
            assert got == Counter((c.tobytes(), i % 2, round(min(1, 4 / len(x)), 5)) for i, x in data.items() for c in x)

    def test_one_class_or_none(self, spark):
        df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
        labels = spark.createDataFrame([(1, 1), (None, None), (2, 7)], "doc_id long, quality int")
        assert byte_cnn.train(df, labels).score([b"x"])[0] > 0.5
        assert byte_cnn.train(df, labels.limit(0)).score([b""])[0] == 0.5


class TestPii:
    KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))

    def base(self, text):
        out = []
        for k, (name, pattern) in enumerate(self.KINDS):
            for m in re.finditer(pattern, text or ""):
                d = re.sub("[^0-9]", "", m[0])
                luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10 == 0
                if {"email": True, "ip": name == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[name]:
                    out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
        return ",".join(x for _, _, x in sorted(out))

    def test_base_spans(self, spark, odd, none):
        rng = random.Random(3)
        parts = ["a", "b.c", "@", "x-y", "1", "23", ".", "255", "256", "+", "(", ")", " ", "-", "é", "😀", "4111 1111 1111 1111", "+1 (555) 555-1234", "a@b.c", "1.2.3.4", "\n", "_d@e.f"]
        texts = [None, "", "a" * 20_000, "1 " * 5000, "a@b.c " * 700] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(800)]
        df, name = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        for r in df.select("text", pii.listed(pii.of_base(col(name))).alias("found")).collect():
            assert r.found == self.base(r.text)
        df, name = pii.find(odd[0])
        assert name == "spans_" and df.count() == len(odd[1])
        assert pii.find(none)[0].count() == 0

    def test_validators_context_and_mask(self, spark):
        t = "IBAN DE89370400440532013000 and DE89370400440532013001, ssn 123-45-6789, then some more words that are about other things than numbers, and after those the order 123-45-6789; mail a@b.example"
        df, name = pii.find(spark.createDataFrame([(t,)], "text string"))
        r = df.select(pii.listed(col(name)).alias("all"), pii.mask(col("text"), col(name)).alias("masked")).first()
        assert [x.split(":")[0] for x in r["all"].split(",")] == ["iban", "ssn", "email"]
        assert r.masked == "IBAN [IBAN] and DE89370400440532013001, ssn [SSN], then some more words that are about other things than numbers, and after those the order 123-45-6789; mail [EMAIL]"

    def test_overlaps_mask_once(self, spark):
        df, name = pii.find(spark.createDataFrame([("+378282246310005 x@4.3.2.1",)], "text string"))
        r = df.select(pii.mask(col("text"), col(name)).alias("m"), pii.listed(col(name)).alias("s")).first()
        assert r.m == "[PHONE] [EMAIL]" and r.s == "phone:0:16,card:1:16,email:17:26,ip:19:26"


class TestToxicity:
    def test_learns_words_and_beginnings(self, spark, odd, none):
        rng = random.Random(4)
        rows = []
        for i in range(400):
            w = prose(i, 40).split()
            bad = i % 4 == 0
            if bad:
                w.insert(rng.randrange(len(w)), rng.choice(["dolt", "grubbar", "grubbel", "grubbix"]))
            rows.append((i, " ".join(w), int(bad)))
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        held = byte_cnn.held_out(col("doc_id"), 4, 2)
        grammar = toxicity.train(df.select("doc_id", "text"), df.where(~held).select("doc_id", "toxic"))
        got = toxicity.score(df, grammar, keep={"y": col("toxic"), "held": held}).collect()
        assert all(r.predicted == r.y for r in got if r.held)
        assert grammar.score(["he is a grubbom"])[0] >= 0.3  # an ending that no row had
        scored = toxicity.score(odd[0], grammar, keep=by_id()).collect()
        assert len(scored) == len(odd[1]) and all(0 <= r.score <= 1 for r in scored)
        assert toxicity.score(none, grammar, keep=by_id()).count() == 0

    def test_learns_rare_words_but_not_copies(self, spark):
        rng = random.Random(5)
        rows = []
        for i in range(2000):
            w = [rng.choice("river stone wall open field house tree cloud road bridge lamp chair".split()) for _ in range(40)]
            bad = i % 4 == 0
            if bad:
                w.insert(rng.randrange(len(w)), "zumpf" if i < 14 * 4 else "dolt")
            rows.append((i, " ".join(w), int(bad)))
        rows += [(3000 + i, "you dolt of the quiet harbour and its many boats by the shore", 1) for i in range(40)]
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        grammar = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
        assert grammar.score(["what a zumpf"])[0] >= 0.3 > grammar.score(["a quiet harbour with boats"])[0]

    def test_clauses(self):
        g = toxicity.Grammar({"idiot": 1.0, "disgo*": 0.9})
        score = lambda t: g.score([t])[0]
        assert score("you idiot") > score("the idiot") > 0.3 > score("a fine day")
        for text in ("he is not an idiot", "she said that he is an idiot", "er ist kein idiot", "this will hurt them a bit", "it must burn these logs", "to kill time", "will you. kill time", "the path, das Wort, worth it", "I will not kill you", "he wrote: I will kill you"):
            assert score(text) == score("a fine day") < 0.3
        assert score("I will kill you.") > 0.3 and score("you should die") > 0.3 and score("not him. an idiot") > 0.3
        assert g.clauses("you idiot! not an idiot. the idiot") == [(toxicity.AIMED, False), (1.0, False)]

    def test_clauses_by_brute_force(self):
        g = toxicity.Grammar({"idiot": 1.0, "dolt": 0.5})
        words = {"idiot": "i", "dolt": "i", "you": "t", "i": "p", "not": "n", "said": "r", "will": "w", "kill": "h", "die": "d", "x": "x", "y": "x"}

        def naive(clause):
            kinds, weights, threats = [words[w] for w in clause], [g.words.get(w, 0.0) for w in clause], 0
            # Each rule looks back over at most so many words; what a rule takes is gone for the next ones.
            def back(k, wanted, reach):
                return any(c in wanted for c in kinds[max(0, k - reach) : k])

            for wanted, reach, taken in (("r", 99, "ihd"), ("n", toxicity.NEAR, "ihd")):
                kinds = ["gone" if c in taken and back(k, wanted, reach) else c for k, c in enumerate(kinds)]
            kinds = ["P" if c == "w" and back(k, "p", toxicity.NEAR) else c for k, c in enumerate(kinds)]
            kinds = ["H" if c == "h" and back(k, "P", toxicity.REACH) else c for k, c in enumerate(kinds)]
            hit = [c == "t" and back(k, "H", toxicity.REACH) for k, c in enumerate(kinds)]
            kinds = ["threat" if h else c for h, c in zip(hit, kinds, strict=True)]
            kinds = ["W" if c == "w" and back(k, "t", toxicity.NEAR) else c for k, c in enumerate(kinds)]
            kinds = ["threat" if c == "d" and back(k, "W", toxicity.NEAR) else c for k, c in enumerate(kinds)]
            threats = kinds.count("threat")
            weight = sum(w * (toxicity.AIMED if back(k, "t", toxicity.REACH) else 1) for k, (c, w) in enumerate(zip(kinds, weights, strict=True)) if c == "i") + toxicity.THREAT * threats
            return [(round(weight, 6), threats > 0)] if weight else []

        rng = random.Random(11)
        for _ in range(3000):
            clauses = [[rng.choice([*words]) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 3))]
            got = g.clauses(". ".join(" ".join(c) for c in clauses))
            assert [(round(w, 6), t) for w, t in got] == [x for c in clauses for x in naive(c)], clauses

    def test_families_need_two_words(self):
        g = toxicity.Grammar({"grubb+": 0.9, "grubbl+": 0.8, "dolt": 1.0})
        assert g.clauses("a grubbar, grubbar and the grubb") == []
        assert g.clauses("a grubbar there. not a grubbel") == [(0.9, False)]
        assert g.clauses("you Grubbar. grubbler is") == [(0.9 * toxicity.AIMED, False), (0.9, False)]
        rng, ends = random.Random(12), ["", "ar", "el", "lo", "la"]
        for _ in range(500):
            words = [rng.choice(["x", "house", *("grubb" + e for e in ends)]) for _ in range(rng.randint(1, 6))]
            weights = [max([w for k, w in (("grubb", 0.9), ("grubbl", 0.8)) if len(x) > len(k) and x.startswith(k) and len({y for y in words if y.startswith(k) and len(y) > len(k)}) > 1], default=0.0) for x in words]
            # The beginning itself counts too, once two longer words have shown the family.
            weights = [0.9 if x == "grubb" and 0.9 in weights else w for x, w in zip(words, weights, strict=True)]
            assert [(round(w, 6), t) for w, t in g.clauses(" ".join(words))] == ([(round(sum(weights), 6), False)] if any(weights) else []), words

    def test_learns_families(self, spark):
        rng, ends = random.Random(13), ["ar", "el", "ix", "om", "un", "ysa", "etti", "off"]
        rows = []
        for i in range(800):
            w = [rng.choice("river stone wall open field house tree cloud road bridge lamp chair".split()) for _ in range(40)]
            n = rng.randint(2, 4) if i % 8 == 0 else int(i % 8 == 1)  # one such word is no sign
            for e in rng.sample(ends, n):
                w.insert(rng.randrange(len(w)), "grubb" + e)
            rows.append((i, " ".join(w), int(i % 8 == 0)))
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        grammar = toxicity.train(df.select("doc_id", "text"), df.where("doc_id % 3 > 0").select("doc_id", "toxic"))
        got = grammar.score([t for i, t, _ in rows if i % 3 == 0]) >= 0.3
        assert list(got) == [bool(y) for i, _, y in rows if i % 3 == 0]
        assert grammar.score(["a grubbant and a grubbold"])[0] >= 0.3 > grammar.score(["a grubbant and a grubbant"])[0]

    def test_transducers_change_held_out_decisions(self, spark, monkeypatch):
        rng = random.Random(6)
        rows = []
        for i in range(600):
            w = [rng.choice("river stone wall open field house tree cloud road bridge lamp chair".split()) for _ in range(30)]
            kind, at = i % 6, rng.randrange(30)
            w[at:at] = {0: ["you", "dolt"], 1: ["a", "dolt"], 2: ["not", "a", "dolt"]}.get(kind, [])
            rows.append((i, " ".join(w), int(kind < 2)))
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        held = byte_cnn.held_out(col("doc_id"), 4, 2)
        monkeypatch.setattr(toxicity, "LEAST_SHARE", 0.5)
        grammar = toxicity.train(df.select("doc_id", "text"), df.where(~held).select("doc_id", "toxic"))
        asked = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
        right = lambda: np.mean((grammar.score([t for t, _ in asked]) >= 0.3) == [y for _, y in asked])
        whole = right()
        monkeypatch.setattr(toxicity, "CASCADE", ())
        assert whole == 1.0 and right() < 0.9

    def test_no_labels(self, spark):
        df = spark.createDataFrame([(1, "what an idiot"), (2, None)], "doc_id long, text string")
        g = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
        assert g.score(["what an idiot"])[0] > 0.3 > g.score([""])[0]


class TestDecontaminate:
    def brute(self, items, text):
        w, hit, names, longest = decontaminate.words_of(text), set(), set(), 0
        for name, t in items:
            q = decontaminate.words_of(t)
            n = min(13, len(q))
            for i in range(len(q) - n + 1 if q else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[i : i + n]:
                        hit |= {*range(p, p + n)}
                        names.add(name)
                        k = n
                        while p + k < len(w) and i + k < len(q) and w[p + k] == q[i + k]:
                            k += 1
                        longest = max(longest, k)
        return len(w), len(hit), sorted(names), longest

    def cases(self, seed):
        rng = random.Random(seed)
        vocabulary = [b"a", b"b", b"c", b"dd", "é".encode(), b"9"][: rng.choice([2, 3, 6])]
        line = lambda n: b" ".join(rng.choice(vocabulary) for _ in range(n))
        items = [(str(i), line(rng.choice([0, 1, 2, 5, 13, 14, 30]))) for i in range(6)]
        texts = [line(rng.randint(0, 40)) + (b" " + rng.choice(items)[1] + b", Zz. " + rng.choice(items)[1][3:] if rng.random() < 0.5 else b"") for _ in range(12)]
        return items, texts

    @pytest.mark.parametrize("seed", range(12))
    def test_scan(self, seed):
        items, texts = self.cases(seed)
        for t, (n, hits, names, longest) in zip(texts, decontaminate.scan(decontaminate.TestSet(items), texts), strict=True):
            assert (n, int(sum(hits[1::2] - hits[::2])), names, longest) == self.brute(items, t)

    def test_blocks_and_odd_rows(self, spark, odd, none):
        items, texts = self.cases(3)
        bench = spark.createDataFrame([(int(i), t.decode()) for i, t in items] + [(None, None), (3, items[3][1].decode())], "item_id long, text string")
        df = spark.createDataFrame([(i, t.decode(), "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, hits string, items string")
        for size in (1 << 20, 40):  # one block, and many
            for r in decontaminate.contamination(df, bench, keep=by_id(), block_bytes=size).collect():
                n, hit, names, longest = self.brute(items, texts[r.doc_id])
                assert (r.n_words, r.n_hit, r["items"], r.longest, r.contaminated) == (n, hit, names, longest, hit > 0 and 20 * hit >= n)
        assert decontaminate.contamination(odd[0], bench, keep=by_id()).count() == len(odd[1])
        assert decontaminate.contamination(none, bench, keep=by_id()).count() == 0
        assert all(not r.contaminated for r in decontaminate.contamination(df, bench.limit(0), keep=by_id()).collect())


class TestSimhash:
    def fingerprint(self, text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = words(low)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    def roots(self, fps):
        parent = list(range(len(fps)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(fps)):
            for j in range(i):
                if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(fps))]

    def test_manhattan_is_a_lower_bound(self):
        rng = np.random.default_rng(1)
        a, b = rng.integers(0, 2**64, (2, 300), np.uint64)
        got = simhash.manhattan(simhash.embed(a), simhash.embed(b))
        count = lambda x, s: bin((x >> 2 * s) & 3).count("1")
        assert got.tolist() == [sum(abs(count(x, s) - count(y, s)) for s in range(32)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        assert (got <= np.bitwise_count(a ^ b)).all()

    def test_grid_finds_all_within_range(self):
        rng = np.random.default_rng(5)
        a = rng.integers(0, 2**64, 400, np.uint64)
        b = a.copy()
        for _ in range(3):
            b ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
        cells = {}
        for k, points in enumerate((a, b)):
            for half, at, cell, probe in simhash.grid(simhash.embed(points)):
                for i, c in zip(at.tolist(), cell.tolist(), strict=True):
                    cells.setdefault((half, c), []).append((k, i, probe))
        met = {i for own in cells.values() for k, i, p in own for k2, i2, p2 in own if k < k2 and i == i2 and not (p and p2)}
        assert met == {*range(400)}

    def test_documents(self, odd, none):
        df, rows = odd
        got = simhash.near_duplicates(df).collect()
        fps = [self.fingerprint(t) for _, t in rows]
        root = self.roots(fps)
        low = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
        assert Counter((r.row, r.fp % (1 << 64), r.component) for r in got) == Counter((rows[i][0], fps[i], low[root[i]]) for i in range(len(rows)))
        kept = simhash.keep_one(df).collect()
        assert len(kept) == len(set(root)) and len(kept[0]) == len(df.columns)
        assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0

    @pytest.mark.parametrize("cell", [2048, 12])
    def test_crowded_cells(self, spark, cell, monkeypatch):
        monkeypatch.setattr(simhash, "CELL", cell)
        rng = np.random.default_rng(2)
        found = []
        for x in rng.integers(0, 2**64, 8, np.uint64):
            for _ in range(40):
                for _ in range(rng.integers(0, 4)):
                    x ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
                found.append(x)
        found += [found[0] ^ np.uint64(v) for v in range(128)]
        fps = np.unique(np.array(found, np.uint64))
        df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(fps.view(np.int64))], "row long, fp long").repartition(3)
        got = {r.row: r.component for r in simhash._classes(df).collect()}
        assert [got[i] for i in range(len(fps))] == self.roots(fps)

    def test_equal_set_bits_are_dealt_by_bits(self, spark, monkeypatch):
        monkeypatch.setattr(simhash, "CELL", 30)
        monkeypatch.setattr(simhash, "LEVELS", 1)
        # Each segment has one bit set, the first or the second; two such fingerprints differ in an even number of bits.
        ones = np.random.default_rng(3).integers(0, 2, (1500, 32)).astype(np.uint64)
        near = ones[:200].copy()
        near[:, 5] ^= np.uint64(1)
        fps = np.unique(np.sum(np.uint64(1) << (np.concatenate([ones, near]) + 2 * np.arange(32, dtype=np.uint64)), 1, dtype=np.uint64))
        assert len(np.unique(simhash.embed(fps))) == 1
        zero = np.zeros(len(fps), np.int64)
        batch = pa.RecordBatch.from_arrays([pa.array(zero), pa.array(zero), pa.array(fps.view(np.int64)), pa.array(zero > 0)], names=["held", "cell", "fp", "probe"])
        dealt = pa.Table.from_batches(simhash._deal(1, True, [batch])).to_pandas()
        assert dealt.groupby(["held", "cell"]).size().max() < 100
        df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(fps.view(np.int64))], "row long, fp long").repartition(3)
        got = {r.row: r.component for r in simhash._classes(df).collect()}
        assert [got[i] for i in range(len(fps))] == self.roots(fps)


class TestHtml:
    PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad --><div class="cookie-notice">We use cookies.</div>
<article><h1>A   title &amp; more</h1><p><b>First paragraph of the story, in which the river is long and the wall is old.<br><p>Short.</p>
<aside>Read also</aside><form><p>Sign up for our letter, it is the best of all the letters that there are in the world</p></form><p>Last &lt;one&gt; &eacute;&#233; of the story.</p></article>
<section id="comments"><p>I think that this is the best story of all that I have read in the last year, it is.</p></section><footer>&copy; nobody</footer></body></html>"""

    def test_article(self):
        assert html_text.main_text(self.PAGE) == "A title & more\nFirst paragraph of the story, in which the river is long and the wall is old.\nShort.\nLast <one> éé of the story."

    def test_without_article_element(self):
        long = "The river is long and the wall of the town is old, and it was open to all of them in the year that she had come to be with us. "
        page = f'<div class="menu"><a href="/">Home</a></div><div><p>{long}</p><p>Yes.</p><p>{long}</p></div><div><a href="/x">More links of the site and others</a></div>'
        assert html_text.main_text(page) == f"{long.strip()}\nYes.\n{long.strip()}"

    def test_names(self):
        page = """<div class="content has-sidebar"><article class="post tag-sport category-ads2"><div class="entry-header"><h1>Head</h1></div><p class="promo">Buy it</p><p>The text of the story is here, and it is long enough to be told from all of the others.</p>
<blockquote class="advert"><p>Buy more</p></blockquote><blockquote><p>A quote.</p></blockquote><div id="ad-3">Ad</div></article><article class="comment"><p>The best story of them all, and I have read it in one go with all of my friends here.</p></article></div>"""
        assert html_text.main_text(page) == "Head\nThe text of the story is here, and it is long enough to be told from all of the others.\nA quote."

    @pytest.mark.parametrize("value", ["alt=\"The city's bridge\"", "title=\"it's\"", "title='say \"a'", "alt=it's", "alt = \"a'>b\" x", 'alt="' + "a > b <p>c</p> " * 1000 + '"', "alt='" + "it is > " * 1000 + "' it's", "' alt=\"x\""])
    def test_quoted_values(self, value):
        page = f"<article><p>Intro.</p><img {value}><p>Second paragraph.</p><p>It's third.</p></article>"
        assert html_text.main_text(page) == "Intro.\nSecond paragraph.\nIt's third."

    def test_short_blocks_with_links(self):
        long = "The text of the story is here, and it is long enough to be told from all of the others."
        page = f'<article><h2>The <a href="/b">battle</a> of the northern fleet</h2><p>{long}</p><p>Read <a href="/2">part two</a> for the rest of it.</p><p>{long}</p><ul><li><a href="/x">Another story</a></li></ul></article>'
        assert html_text.main_text(page) == f"The battle of the northern fleet\n{long}\nRead part two for the rest of it.\n{long}"
        assert html_text.main_text('<article><p>Read <a href="/2">part two</a> for the rest of it.</p></article>') == "Read part two for the rest of it."

    LONG = "The river is long and the wall of the town is old, and it was open to all of them in the year that she had come to be with us."

    def test_boilerplate_inside_the_article(self):
        page = f"""<article><h1>Head</h1><p>By A. Writer</p><p>{self.LONG}</p><h2>More of it</h2><ul><li><a href="/1">One more story of the same kind</a></li><li><a href="/2">Two</a></li></ul>
<h2>Ships</h2><p>Aurora 1901, Borealis 1907, Corona 1911, Dione 1912, Elektra 1915, Fulda 1919, Gudrun 1921</p><p>{self.LONG}</p><p>As <a href="/3">told by the harbour master of the town</a>, the end of it was the year after.</p></article>"""
        lines = html_text.main_text(page).split("\n")
        assert lines == ["Head", "By A. Writer", self.LONG, "Ships", "Aurora 1901, Borealis 1907, Corona 1911, Dione 1912, Elektra 1915, Fulda 1919, Gudrun 1921", self.LONG, "As told by the harbour master of the town, the end of it was the year after."]

    def test_densities_decide_without_an_article(self):
        names = "Aurora Borealis Corona Dione Elektra Fulda Gudrun Hansa Iduna Juno Kronos Luna Mars Nike Orion Pallas Rhea Selene Titan Urania " * 2
        links = '<p><a href="/a">The best of the stories of the week that was</a> | <a href="/b">All of the stories that there are</a></p>'
        page = f"<div><p>{names}</p>{links}<p>Top</p></div><div><h1>Head</h1><p>{self.LONG}</p><p>Yes.</p><p>{self.LONG}</p></div><div>{links}<p>Bottom</p></div>"
        assert html_text.main_text(page) == f"Head\n{self.LONG}\nYes.\n{self.LONG}"

    def test_passes_by_brute_force(self):
        rng = random.Random(8)
        for _ in range(400):
            n, inside = rng.randint(0, 9), rng.random() < 0.5
            labels, headings = [rng.choice([True, False, None, None]) for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
            want = []
            for k in range(n):
                left = next(((k - i, labels[i]) for i in range(k - 1, -1, -1) if labels[i] is not None), None)
                right = next(((i - k, labels[i]) for i in range(k + 1, n) if labels[i] is not None), None)
                if labels[k] is not None:
                    want.append(labels[k])
                elif not left and not right:
                    want.append(inside)
                elif not left or not right or headings[k]:
                    want.append((right or left)[1])
                elif left[1] == right[1]:
                    want.append(left[1])
                else:
                    want.append(inside or left[0] != right[0] and min(left, right)[1])
            assert html_text.second_pass(labels, headings, inside) == want

    def test_generated_pages(self):
        """Pages built from known parts: what is the article's comes out, nothing else does."""
        rng = random.Random(9)
        para = lambda: " ".join(rng.choice("the of and a river stone wall open was is in to town year old long she it had".split()) for _ in range(rng.randint(3, 60))).capitalize() + "."
        extras = [
            lambda: f"<aside><p>{para()}</p></aside>", lambda: f"<form><p>{para()}</p><input></form>", lambda: f"<script>var x = '<p>{para()}</p>';</script>", lambda: f'<div class="ad-box">{para()}</div>',
            lambda: f'<div role="navigation"><ul><li>{para()}</li></ul></div>', lambda: f"<!-- <p>{para()}</p> -->", lambda: f'<section class="comments"><article class="comment"><p>{para()}</p></article></section>', lambda: f'<div style="display: none">{para()}</div>',
        ]
        for _ in range(150):
            want, body = [], []
            for _ in range(rng.randint(1, 8)):
                if rng.random() < 0.4:
                    body.append(rng.choice(extras)())
                else:
                    want.append(para())
                    body.append(rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<p>\n {}\t</p>"]).format(want[-1].replace(" ", rng.choice([" ", "  ", "\n"]))))
            around = [rng.choice(extras)() for _ in range(4)]
            page = f"<html><body><nav><a href='/'>{para()}</a></nav>{around[0]}{around[1]}<article>{''.join(body)}</article>{around[2]}{around[3]}<footer>{para()}</footer></body></html>"
            assert html_text.main_text(page) == "\n".join(want)

    def test_deep_pages_in_linear_time(self):
        import time

        began = time.process_time()
        for page in ("<div>" * 100_000 + "x", "</div></section>" * 100_000 + "x", "<div><p>" * 100_000 + "</section>" * 100_000 + "x", "<article>" + "<div>x" * 100_000):
            html_text.main_text(page)
        assert time.process_time() - began < 60

    def test_open_quotes_in_linear_time(self):
        import time

        began = time.process_time()
        assert html_text.main_text('<article><p>One.</p><img alt="a>b" title="open><p>Two.</p>') == "One.\nTwo."
        for page in ('<a b=">" ' * 200_000 + 'c="', "<a b='>\" <a b=\">' " * 100_000, "<a b=" * 200_000, '<a b ="' * 200_001, "<a " + " b" * 500_000):
            html_text.main_text(page)
        assert time.process_time() - began < 20

    def test_odd_pages(self, spark):
        pages = [None, "", "<", "<p", "a < b", "<article><p>open", "<article>" * 2000 + "deep", '<article><p title="a>b">x</p><p>y &am', "<!-- never closed <p>x</p>", "<script>x", "\0<p>\0</p>", "<p>" * 50_000]
        df = spark.createDataFrame([(i, p, "u", "t", "n") for i, p in enumerate(pages)] * 2, "page_id long, html string, url string, text string, n_chars string")
        got = html_text.extract(df, keep={"page_id": col("page_id")}).collect()
        assert len(got) == 2 * len(pages) and all(r.n_chars == len(r.text) for r in got)
        by = {r.page_id: r.text for r in got}
        assert by[0] == by[1] == "" and by[5] == "open" and by[7] == "x\ny &am"
        assert html_text.extract(df.limit(0), keep=by_id() | {"doc_id": col("page_id")}).count() == 0


class TestSubstrings:
    def brute(self, rows):
        cut = [(t or "").encode().split() for _, t in rows]
        seen = Counter(tuple(w[i : i + 35]) for w in cut for i in range(len(w) - 34))
        out = []
        for (row, _), w in zip(rows, cut, strict=True):
            gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
            kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
            out.append((row, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
        return sorted(out, key=str)

    @pytest.mark.parametrize("bucket", [2000, 2])
    def test_exact(self, spark, bucket, monkeypatch):
        monkeypatch.setattr(substrings, "BUCKET", bucket)
        rng = random.Random(2)
        vocabulary = ["a", "b", "é", "x1"] + [f"w{i}" for i in range(300)]
        line = lambda n, k=304: [rng.choice(vocabulary[:k]) for _ in range(n)]
        passages, rows = [line(n) for n in (36, 40, 50, 80, 35, 34)], []
        for i in range(120):
            w = line(rng.choice([0, 5, 34, 35, 60, 120]), rng.choice([1, 2, 304, 304]))
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randint(0, len(w))
                w[at:at] = rng.choice(passages)
            rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(w)))
        rows += [(500, rows[3][1]), (500, rows[3][1]), (501, None), (None, rows[7][1]), (None, None), (7, rows[7][1])]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = substrings.drop_repeats(df)
        assert sorted(((r.row, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == self.brute(rows)
        assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got.collect())

    def test_halves_keep_each_window_once(self):
        for free in (30, 15, 14, 7, 6, 3, 2, 1):
            width = 35 - free
            for spot in range(free + 1):
                for many in range(1, spot + 2):
                    words = [b"%d" % i for i in range(34 + many)]
                    if spot + width > len(words) or spot < many - 1:
                        continue
                    seen = []
                    for first, part, at, wide in substrings.halves(words, spot, width):
                        assert part == words[first : first + len(part)] and wide > width and at <= spot - first and at + wide >= spot - first + width
                        for w in range(len(part) - 34):  # each of its windows holds the new minimiser
                            assert w <= at and at + wide <= w + 35
                            seen.append(first + w)
                    assert sorted(seen) == [*range(many)]

    def test_passage_in_many_texts(self, spark, monkeypatch):
        monkeypatch.setattr(substrings, "BUCKET", 20)
        passage = [f"p{i}" for i in range(60)]
        rows = [(i, " ".join([f"{i}a{k}" for k in range(40)] + passage[: 60 - i % 3] + [f"{i}b{k}" for k in range(40)])) for i in range(90)]
        rows += [(100 + i, rows[0][1]) for i in range(50)]
        got = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert sorted(((r.row, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == self.brute(rows)

    def test_odd_rows(self, odd, none):
        got = substrings.drop_repeats(odd[0], texts=False)
        assert sorted(((r.row, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == self.brute(odd[1])
        assert substrings.drop_repeats(none).count() == 0


class TestLicenses:
    def brute(self, rows):
        cut = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
        runs = lambda w: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        out = {}
        for row, t in rows:
            have = runs(cut(t))
            for name, templates in licenses.TEMPLATES.items():
                best = max(len(runs(cut(x)) & have) / len(runs(cut(x))) for x in templates)
                if best >= 0.8:
                    out[row, name] = max(out.get((row, name), 0), round(best, 4))
        return out

    def test_scan(self, spark, odd, none):
        rng = random.Random(6)
        rows = [(None, None), (-1, "")]
        for i in range(60):
            w = prose(i, rng.randint(0, 120)).split()
            if i % 2:
                t = rng.choice(rng.choice([*licenses.TEMPLATES.values()])).split()
                if i % 4 == 3 and len(t) > 30:
                    t[rng.randrange(len(t))] = "changed"
                at = rng.randint(0, len(w))
                w[at:at] = t
            rows.append((i, " ".join(w)))
        rows += [rows[3], (None, rows[5][1])]
        got = licenses.scan(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, containment string")).collect()
        assert {(r.row, r.license): r.containment for r in got} == self.brute(rows) and len(got) == len(self.brute(rows))
        assert licenses.scan(odd[0]).count() == 0 and licenses.scan(none).count() == 0

    def test_band_settings(self):
        for size, step in licenses.SIZES:
            assert size == 2 * step and licenses.miss_chance(step, size) < 1e-3

    def test_bands_miss_as_rarely_as_reckoned(self, spark):
        # One shingle of a template in windows of ten words, the other five shingles different each time.
        n = 20_000
        notice = "released under the mit license".split()
        rows = [([f"w{6 * i + k}" for k in range(i % 6)] + notice + [f"w{6 * i + k}" for k in range(i % 6, 5)],) for i in range(n)]
        theirs = {(r.band, r.value) for r in spark.createDataFrame([(notice,)], "w array<string>").select(licenses.bands(col("w")).alias("b")).first().b}
        kept = F.filter(licenses.bands(col("w")), lambda b: F.struct(b["band"], b["value"]).isin(*(F.struct(F.lit(k), F.lit(v)) for k, v in sorted(theirs))))
        missed = spark.createDataFrame(rows, "w array<string>").repartition(4).where(F.size(kept) == 0).count()
        assert missed < 3 * n * licenses.miss_chance(5, 10) + 3


def test_near_duplicates_write_few_rows_in_few_files(spark, monkeypatch):
    """A local file system starts a process for each file that is written."""
    files, durable = [], simhash.durable

    def counted(df, **options):
        out = durable(df, **options)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "durable", counted)
    texts = [" ".join(f"w{(i // 2 * 31 + k * k) % 997}" for k in range(60)) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    with settings(spark, spark__sql__shuffle__partitions="96", spark__sql__adaptive__coalescePartitions__enabled="false"):
        found = simhash.near_duplicates(df)
        assert found.rdd.getNumPartitions() <= 16
        rows = {r.row: r.component for r in found.collect()}
    assert len(files) > 3 and max(files) <= 16
    assert rows.keys() == set(range(400)) and all(rows[i] == rows[i - 1] for i in range(1, 400, 2))
