"""Toxicity, quality and personal data: held-out accuracy, exact decoding, base patterns."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crf_pii, lsa_knn, toxicity_fst
from tidemark.llm.labelled import sample
from tidemark.llm.words import words_of

SF = "/root/testdata/sf0.01"


def held_out(scored, labels, label, folds, held):
    from pyspark.sql import functions as F

    rows = scored.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held).select("score", label).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def auc(score, y):
    pairs = [(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]]
    return sum(pairs) / len(pairs)


@pytest.mark.parametrize("module,label,folds,held,least", [(toxicity_fst, "toxic", 3, 1, 0.85), (lsa_knn, "quality", 5, 0, 0.95)])
def test_held_out_accuracy(spark, module, label, folds, held, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    score, y = held_out(module.score(docs, module.learned(docs, labels)), labels, label, folds, held)
    assert auc(score, y) >= least and score.min() >= 0 and score.max() <= 1


@pytest.mark.parametrize("module", [toxicity_fst, lsa_knn])
def test_odd_rows_and_labels(spark, module, odd, nothing):
    for labels in ("doc_id long, toxic int, quality int", None):
        known = spark.createDataFrame([], labels) if labels else spark.createDataFrame([(0, 1, 1), (3, 0, 0), (3, None, None), (None, 1, 1), (5, 1, 0), (4, 0, 1), (2, 0, 0), (6, 1, 1)], "doc_id long, toxic int, quality int")
        for docs in (odd, nothing):
            found = module.score(docs, module.learned(docs, known)).collect()
            assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)


def clause_total(text, entries):
    x = toxicity_fst.features(words_of(pa.array([text])), toxicity_fst.Lexicon(entries))
    return float(np.expm1(x[0, 0]))


def test_clauses_count_by_use():
    plain = clause_total("the idiot left", {})
    assert plain == pytest.approx(toxicity_fst.SEED_WEIGHT)
    assert clause_total("you are an idiot", {}) > plain > clause_total("not an idiot", {})
    assert clause_total("she said idiot", {}) < clause_total("she, idiot", {})
    assert clause_total("He said no. The idiot left", {}) == pytest.approx(plain)  # another clause
    assert clause_total("I will kill you", {}) < clause_total("you I will kill", {})
    assert clause_total("grumblefax", {"grumb*": 5.0}) == pytest.approx(5.0)
    assert clause_total("nothing here", {}) == 0
    assert clause_total("you will kill", {}) > clause_total("you kill", {})
    one, two = clause_total("idiot", {}), clause_total("idiot moron", {})
    assert two > 2 * one


def test_learned_words_are_insults_or_threats(spark):
    """A word that mostly follows an intent is learned as a threat, one that doesn't as an insult."""
    rows = [(f"you are a glorp number{i}", 1) for i in range(12)] + [(f"i will frazzle you number{i}", 1) for i in range(12)] + [(f"a calm text number{i} of some words", 0) for i in range(60)]
    entries, threats = toxicity_fst.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    assert "glorp" in entries and "frazzle" in entries
    assert "frazzle" in threats and "glorp" not in threats
    lexicon = toxicity_fst.Lexicon(entries, threats)
    assert lexicon.look_up("frazzle")[0] == toxicity_fst.THREAT and lexicon.look_up("glorp!")[0] == toxicity_fst.INSULT


def test_held_out_verdicts(spark):
    """At the limit of the filter: most toxic rows go, clean rows stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    score, y = held_out(toxicity_fst.score(docs, toxicity_fst.learned(docs, labels)), labels, "toxic", 3, 1)
    assert (score[y == 1] >= 0.7).mean() >= 0.75 and (score[y == 0] >= 0.7).mean() <= 0.01


def test_composition_runs_machines_side_by_side():
    machines = toxicity_fst.MACHINES
    assert len(machines) == 5
    for symbols in itertools.product(list(toxicity_fst.SYMBOLS)[1:], repeat=4):
        state, product, single = 0, 1.0, [0] * 5
        for s in symbols:
            state, f = toxicity_fst.GRAMMAR.step(state, s)
            want = 1.0
            for i, m in enumerate(machines):
                single[i], g = m.step(single[i], s)
                want *= g
            assert f == pytest.approx(want)


def test_filter_keeps_columns(spark, odd):
    model = toxicity_fst.Model({}, toxicity_fst.FIXED_FIT)
    kept = toxicity_fst.filtered(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    rude = spark.createDataFrame([(1, "you idiot. you moron. you are scum")], "doc_id long, text string")
    assert toxicity_fst.filtered(rude, model).count() == 0


def test_votes_by_brute_force():
    rng = np.random.default_rng(1)
    v = lsa_knn.whole(lsa_knn.unit(rng.standard_normal((40, 6))))
    v[20:30] = v[:10]  # ties
    model = lsa_knn.Model(np.ones(lsa_knn.PLACES, np.float32), lsa_knn.whole(lsa_knn.unit(rng.standard_normal((lsa_knn.PLACES, 6)))), v, (np.arange(40) % 3 == 0).astype(float))
    bags = lsa_knn.Bags().count(words_of(pa.array(["a b c", "", "Some words! here", None])))
    for got, z in zip(model.scores(bags, nearest=5, block=2), model.latent(bags)):
        cosine = [sum(int(a) * int(b) for a, b in zip(z, x)) for x in v]
        best = sorted(range(40), key=lambda i: (-cosine[i], i))[:5]
        w = [max(cosine[i] / 2.0 ** (2 * lsa_knn.SCALE), 1e-3) ** lsa_knn.SHARPNESS for i in best]
        assert got == pytest.approx(sum(a * model.labels[i] for a, i in zip(w, best)) / sum(w), rel=1e-12)


def test_scores_do_not_depend_on_the_batch(spark):
    """Each text alone, all together, and in any partitions: the same bits."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = lsa_knn.learned(docs, labels)
    texts = [r["text"] for r in docs.select("text").limit(300).collect()]
    together = model.scores(lsa_knn.Bags().count(words_of(pa.array(texts))))
    alone = [model.scores(lsa_knn.Bags().count(words_of(pa.array([t]))))[0] for t in texts]
    assert together.tolist() == alone
    again = lsa_knn.learned(docs.repartition(7), labels)
    one, two = ({r["doc_id"]: r["score"] for r in lsa_knn.score(d, m).collect()} for d, m in ((docs, model), (docs.repartition(5, "doc_id"), again)))
    assert one == two


def plain_base(text):
    """Base spans straight from the patterns."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        odd = sum(map(int, d[-1::-2])) + sum(sum(map(int, str(2 * int(c)))) for c in d[-2::-2])
        if 16 <= len(d) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


ODD_TEXTS = ["é a@b.c x@y", "1.2.3.4.5 256.1.1.1 001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (499) 555-6503%%% ++12 34567890 +1", "a@b@c.de,f@g.h.", "", "9" * 5000, "mail anna at host dot com now", "日本 +49 30 1234567 é 10.0.0.1", "call (212) 555-0147 today"]


def test_base_spans_equal_patterns(spark):
    texts = ODD_TEXTS + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    finder = crf_pii.Finder(crf_pii.trained())
    for text, (base, spans) in zip(texts, finder.spans(pa.array(texts))):
        assert base == plain_base(text) and set(base) <= set(spans)
        for kind, a, b in set(spans) - set(base):
            assert 0 <= a < b <= len(text) and not any(a < e and s < b for _, s, e in base)
    more = [spans for _, spans in finder.spans(pa.array(["mail anna at host dot com now", "é call (212) 555-0147 today", "he was at home dot and done"]))]
    assert more[0] == [("email", 5, 25)] and more[1] == [("phone", 7, 21)] and more[2] == []


def test_base_spans_of_dense_marks():
    """Short texts of few characters, where attempts that fail overlap those that match."""
    rng = random.Random(3)
    for marks in ("a@.b-9_%+", "1. -+()2a", "0.@a", "19 -+.", "@a.b"):
        for _ in range(4000):
            text = "".join(rng.choice(marks) for _ in range(rng.randrange(1, 40)))
            assert crf_pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["9" * (1 << 20), "a" * (1 << 20) + " x@y.de", "a." * (1 << 19) + " x@y.de", "a@" * (1 << 19), "1." * (1 << 19), "1-" * (1 << 19), "a@" + "b-" * (1 << 19), "+1(" * 300000, ".at" * 300000, "a(at)" * 200000])
def test_a_megabyte_without_a_blank(text):
    finder = crf_pii.Finder(crf_pii.trained())
    began = time.perf_counter()
    base = crf_pii.base_spans(text)
    assert time.perf_counter() - began < 2
    if text[:2] == "1.":
        assert len(base) == 131072 and base[1] == ("ip", 8, 15)
    else:
        assert base == ([("email", len(text) - 6, len(text))] if text.endswith("x@y.de") else [])
    (again, spans), = finder.spans(pa.array([text]))
    assert again == base and spans == base


def test_many_spans_in_one_text():
    text = "x a@b.cd 10.0.0.1 é token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" " * 3000
    (base, spans), = crf_pii.Finder(crf_pii.trained()).spans(pa.array([text]))
    assert len(base) == 6000 and len(spans) == 9000
    step = len(text) // 3000
    assert [a - spans[6000][1] for _, a, _ in spans[6000:]] == [step * i for i in range(3000)]
    assert crf_pii.redact(text, spans) == "x [EMAIL] [IP] é token = \"[SECRET]\" ".replace('"', text[28:29]) * 3000


def test_addresses_that_are_spelled_out():
    good = ["anna at host dot com", "anna(at)host(dot)com", "anna [at] host.com", "anna.b AT my-host DOT co DOT uk", "anna[at] host dot com"]
    bad = ["anna at host", "at host dot com", "he was at home and dot com", "anna host dot com", "anna at host dot ", " at x.y", "", "at" * 9]
    assert all(crf_pii.spelled_out(t) for t in good) and not any(crf_pii.spelled_out(t) for t in bad)


def test_sample_is_bounded_by_rows(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(500).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    every = F.lit(True)
    plain = {tuple(r) for r in sample(docs, labels, "toxic", every, 100).collect()}
    hot = next(iter(plain))[0]
    copies = spark.range(100000).selectExpr(f"CAST({hot} AS LONG) AS doc_id", f"'text {hot}' AS text")
    assert len(plain) == 100 and {tuple(r) for r in sample(docs.unionByName(copies), labels, "toxic", every, 100).collect()} == plain
    others = spark.range(100000).selectExpr(f"CAST({hot} AS LONG) AS doc_id", "concat('other ', id) AS text")
    mixed = sample(docs.unionByName(others), labels.unionByName(labels), "toxic", every, 100).collect()
    assert len(mixed) == 100 and {r["doc_id"] for r in mixed} == {d for d, _, _ in plain}
    nulls = spark.createDataFrame([(1, None), (None, "x")], "doc_id long, text string")
    assert [tuple(r) for r in sample(nulls, labels, "toxic", every, 500).collect()] == [(1, None, 1)]


def runs(labels):
    """Spans of words with one label."""
    edges = [0, *(i for i in range(1, len(labels)) if labels[i] != labels[i - 1]), len(labels)]
    return {(int(labels[a]), a, b) for a, b in itertools.pairwise(edges) if labels[a]}


def test_field_finds_held_out_spans():
    """Rows with other values, words and neighbours than those it was trained on."""
    model, hits, marked, meant = crf_pii.trained(), 0, 0, 0
    kinds = set()
    for words, labels in crf_pii.labelled_table(copies=4, seed=2024):
        seen = np.array([model.seen(w) for w in words])
        got = runs(model.best(model.emissions(seen, np.arange(len(words)), np.array([0])), np.array([0, len(words)])))
        want = runs(labels)
        hits, marked, meant = hits + len(got & want), marked + len(got), meant + len(want)
        kinds |= {k for k, _, _ in got & want}
    assert hits >= 0.9 * meant and hits >= 0.95 * marked and meant > 200
    assert kinds == {1, 2, 3, 4, 5}


def test_field_adds_spans_to_documents(spark):
    """Every quoted token of the table is a secret, and nothing else is added to speak of."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").filter("text LIKE '%token = %'").collect()]
    finder = crf_pii.Finder(crf_pii.trained())
    found = finder.spans(pa.array(texts))
    want = [[("secret", *m.span(1)) for m in re.finditer('token = "([0-9a-f]{40})"', t)] for t in texts]
    assert sum(map(len, want)) > 100
    more = [sorted(set(s) - set(b)) for b, s in found]
    assert sum(w == m for w, m in zip(want, more)) >= 0.97 * len(texts)
    plain = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").filter("text NOT LIKE '%token = %'").collect()]
    assert sum(len(s) - len(b) for b, s in finder.spans(pa.array(plain))) <= 2


def test_emissions_stay_within_texts():
    model = crf_pii.trained()
    one, two = "call (212) 555-0147 now".split(), "token = x".split()
    seen = lambda words: np.array([model.seen(w) for w in words])
    both = model.emissions(seen(one + two), np.arange(7), np.array([0, 4]))
    alone = [model.emissions(seen(w), np.arange(len(w)), np.array([0])) for w in (one, two)]
    assert np.allclose(both, np.vstack(alone), atol=1e-5)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(4)
    model = crf_pii.Model()
    model.pair = rng.standard_normal((5, 5))
    first = np.array([0, 5, 5, 9, 12])  # a text without words, too
    e = rng.standard_normal((12, 5)) * 2
    e[[2, 6, 7], 0] += 12
    got = model.best(e, first)
    for a, b in zip(first, [*first[1:], 12]):
        if b > a:
            def value(path):
                return sum(e[a + i, y] for i, y in enumerate(path)) + sum(model.pair[x, y] for x, y in zip((0, *path), (*path, 0)))

            assert tuple(got[a:b]) == max(itertools.product(range(5), repeat=b - a), key=value)


def test_find_and_redact(spark, odd, nothing):
    assert crf_pii.find(odd).count() == odd.count() and crf_pii.find(nothing).count() == 0
    docs = spark.createDataFrame([(1, "x a@b.cd y 10.0.0.1", 5), (2, None, 6)], "doc_id long, text string, base int")
    out = crf_pii.redacted(docs)
    assert [r["text"] for r in crf_pii.redacted(spark.createDataFrame([('a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b',)], "text string")).collect()] == ['a token = "[SECRET]" b']
    assert out.columns == docs.columns and [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "x [EMAIL] y [IP]", 5), (2, None, 6)]
