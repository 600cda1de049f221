"""Source divergence, language and manifests, each against a plain version."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle_manifest, queries, source_divergence, string_kernel

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def by_sql(name, path):
    return sorted(map(tuple, duckdb.sql(queries.ORACLE_SQL[name].replace("FROM documents", f"FROM '{path}/*.parquet'")).fetchall()))


# Source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_counts(rows):
    n, df, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        key = lang or "", source or ""
        groups.add(key)
        terms = TERM.findall(fold(text))
        for t in terms:
            n[(*key, t)] += 1
        for t in set(terms):
            df[(*key, t)] += 1
    return n, df, groups


def plain_report(rows, least):
    n, df, groups = plain_counts(rows)
    out = []
    for lang in {g[0] for g in groups}:
        held = Counter()
        for (la, _, t), k in df.items():
            if la == lang:
                held[t] += k
        kept = [t for t in held if held[t] >= least]
        sources = [s for la, s in groups if la == lang]
        shares = {}
        for s in [*sources, None]:
            count = {t: sum(n[lang, x, t] for x in ([s] if s is not None else sources)) for t in kept}
            total = sum(count.values()) + 5 * len(kept)
            shares[s] = {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            own = sorted((shares[None][t] - shares[s][t], t.encode(), t) for t in kept if n[lang, s, t] and shares[s][t] > shares[None][t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(own[:50])]
    return sorted(out)


def dense_rows(seed, n=300):
    """Texts of few letters, so that terms share long beginnings, over uneven groups with nulls."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aAbÉé日") for _ in range(rng.choice((1, 2, 3, 7, 8, 9, 15, 16, 17, 25)))) if rng.random() < 0.5 else rng.choice(("aaaaaaaa", "aaaaaaaaa", "aaaaaaaaaaaaaaaab", "tail", "Tail"))
    text = lambda: rng.choice((None, "", " 12 !", *["".join(word() + rng.choice(" -3\n\x00") for _ in range(rng.randrange(1, 40))) for _ in range(6)]))
    return [(text(), rng.choice(("en", "en", "de", None)), rng.choice(("a", "a", "b", "", None, "ü"))) for _ in range(n)]


def test_pointers_sort_terms():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("aab日 ") for _ in range(rng.randrange(0, 400)))
        raw = np.frombuffer(text.encode() + bytes(8), np.uint8)
        start, end = source_divergence.term_starts(raw[:-8], np.array([0, len(raw) - 8]))
        order, run = source_divergence.pointer_sort(raw, start, end)
        terms = [raw[start[i] : end[i]].tobytes() for i in order]
        assert sorted(terms) == terms and sorted(terms) == sorted(m.group().encode() for m in TERM.finditer(text))
        assert [terms[i] for i in run] == sorted(set(terms))


@pytest.mark.parametrize("shard", [1, 200, 1 << 20])
def test_terms_of_any_shards(spark, shard):
    rows = dense_rows(7) + [(" ".join(f"long{chr(97 + i % 26)}" for i in range(300)), "en", "a")]
    n, df, groups = plain_counts(rows)
    docs = spark.createDataFrame([(0, t, la, s, 0) for t, la, s in rows], DOCS).repartition(3)
    found = source_divergence.shard_counts(docs, shard).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("df")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == {k: (n[k], df[k]) for k in n} | {(*g, ""): (0, 0) for g in groups}


def test_report_equals_plain_report(spark, monkeypatch):
    rows = dense_rows(3)
    docs = spark.createDataFrame([(i, t, la, s, 0) for i, (t, la, s) in enumerate(rows)], DOCS)
    want = plain_report(rows, 4)
    assert any(r[2] == "term" for r in want)
    assert sorted(map(tuple, source_divergence.audit(docs, 4).collect())) == want
    monkeypatch.setattr(source_divergence, "BLOCK", 2)  # many blocks, and sources in several parts
    monkeypatch.setattr(source_divergence, "PART", 2)
    assert sorted(map(tuple, source_divergence.audit(docs, 4).collect())) == want


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(200):
        whole = rng.randrange(10, 1 << 52)
        count = rng.randrange(0, whole - 5)
        assert int(source_divergence.share(np.array([count]), np.array(whole))[0]) == 1 + 10**9 * (count + 5) // whole


def test_divergence_of_odd_tables(spark, odd, nothing):
    assert source_divergence.audit(nothing).count() == 0
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert sorted(map(tuple, source_divergence.audit(odd, 2).collect())) == plain_report(rows, 2)
    assert {r["value"] for r in source_divergence.audit(odd, 99).collect()} == {0}
    clashing = odd.withColumn("term", F.lit("x")).withColumn("value", F.lit(1)).withColumn("item", F.lit("y"))
    assert source_divergence.audit(clashing, 2).count() == len(plain_report(rows, 2))


def test_divergence_equals_sql_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, la, s, 0) for i, (t, la, s) in enumerate(dense_rows(5, 900))], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op11_source_divergence"](spark, str(tmp_path)).collect()
    assert len(found) > 50 and sorted(map(tuple, found)) == by_sql("op11_source_divergence", f"{tmp_path}/documents.parquet")


# Language


def plain_grams(text):
    out = set()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f"\0{word}\0"
        for n in range(1, string_kernel.LONGEST + 1):
            out |= {padded[i : i + n] for i in range(len(padded) - n + 1)} - {"\0"}
    return out


def test_grams_equal_plain_grams():
    rng = random.Random(5)
    texts = ["", " ", "Ab, c", "a", "ÉTÉ-où 12x", "日本語 テスト", *("".join(rng.choice("aB é-1") for _ in range(40)) for _ in range(20))]
    code, of = string_kernel.symbols(texts)
    found = defaultdict(set)
    for text, place in string_kernel.grams(code, of):
        for t, p in zip(text.tolist(), place.tolist()):
            found[t].add(p)
    alone = []
    for i, text in enumerate(texts):
        one = set()
        for _, place in string_kernel.grams(*string_kernel.symbols([text])):
            one |= set(place.tolist())
        assert one == found[i]
        alone.append(one)
        assert len(one) == len(plain_grams(text))  # no two of so few grams meet at one place
    for i in range(len(texts)):
        assert len(alone[i] & alone[3]) == len(plain_grams(texts[i]) & plain_grams(texts[3]))


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"wört{chr(97 + i % 26)}{chr(97 + i % 23)}" for i in range(3000)) + " ende"
    column = np.arange(string_kernel.PLACES, dtype=np.int32) % 5000
    whole = string_kernel.presence([text, "kurz", text], column, 5000)
    monkeypatch.setattr(string_kernel, "PIECE", 50)
    cut = string_kernel.presence([text, "kurz", text], column, 5000)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and (whole[0][0] == whole[0][2]).all()


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op12_string_kernel(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held) > 300
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_only_other_folds_teach(spark):
    """Held-out labels change nothing, and neither does the order of rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400).select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    wrong = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).repartition(5)
    one, two = string_kernel.learned(docs, 200, 40), string_kernel.learned(wrong, 200, 40)
    assert one.languages == two.languages and (one.places == two.places).all() and (one.weights == two.weights).all()


def test_scores_equal_a_plain_machine(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    model = string_kernel.learned(docs, 60, 20)
    scorer = string_kernel.Scorer(model)
    texts = [r["text"] for r in docs.select("text").limit(30).collect()]
    known = {p: i for i, p in enumerate(model.places.tolist())}
    for text, f in zip(texts, scorer.evidence(texts)[0]):
        own = {known[p] for _, place in string_kernel.grams(*string_kernel.symbols([text])) for p in place.tolist() if p in known}
        kernel = [len(own & set(np.flatnonzero(m))) / np.sqrt(max(len(own) * m.sum(), 1)) for m in scorer.marks]
        assert np.allclose(np.array(kernel) @ model.root @ model.weights + model.prior, f, atol=1e-8)
    assert scorer.predict(texts)[0] == [scorer.predict([t])[0][0] for t in texts]


def test_language_of_odd_rows(spark, odd, nothing):
    model = string_kernel.learned(spark.read.parquet(f"{SF}/documents.parquet"), 200, 40)
    found = string_kernel.identify(odd, model).collect()
    assert len(found) == odd.count() and string_kernel.identify(nothing, model).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (0, 1, 2)} == {("und", 0.0)}
    assert all(r["lang_pred"] in model.languages for r in found if r["doc_id"] not in (0, 1, 2))
    assert {r["lang_pred"] for r in string_kernel.identify(odd, string_kernel.learned(nothing)).collect()} == {"und"}
    own = string_kernel.learned(odd.withColumn("doc_id", F.col("doc_id") + 7).withColumn("rank", F.lit("x")).withColumn("key", F.lit("y")))
    assert own.languages and set(own.languages) <= {"en", "de"}


def test_sample_of_copies(spark):
    """A text that fills a third of the rows is in the sample once, and rare languages are in it."""
    rows = [(3 * i, f"word{chr(97 + i % 26)} {i}", "en") for i in range(300)] + [(3 * i, "same text", "en") for i in range(300)] + [(9, "nur eins", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = string_kernel.sample(docs, F.lit(True), 40).collect()
    assert Counter(r["lang"] for r in found)["de"] == 1 and 10 <= len(found) <= 21 and len({r["text"] for r in found}) == len(found)


# Manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*(field(v) for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """Levels up to the last node, and the siblings of each node of the first level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            a = i - i % 3
            path.append((level[a:i], level[i + 1 : a + 3]))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        mine = sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        made[s] = mine, *plain_tree([plain_leaf(*r) for r in mine])
    root, outer = plain_tree([made[s][1] for s in order])
    out = []
    for s, beyond in zip(order, outer):
        mine, subroot, paths = made[s]
        for r, path in zip(mine, paths):
            path, leaf = path + beyond, plain_leaf(*r)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = plain_leaf(r[0], r[1].replace("\n", "") if even and r[1] is not None else r[1], *r[2:])
            for before, after in path:
                node = h(*before, node, *after)
            out.append((r[0], leaf, subroot, root, h(*(x for b, a in path for x in b + a)), node, node == root))
    return sorted(out, key=repr)


def some_rows(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        rows += [(rng.randrange(10**6), rng.choice((None, "", "a\nb", f"x{i}\n", "é日")), rng.choice(("en", None)), source, rng.choice((None, i))) for i in range(n)]
    return rows


@pytest.mark.parametrize("depth", [1, 2, 7])
@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, "b": 1, None: 1}, {"a": 2, "b": 3, "": 4, None: 28}, {"é": 82, "z": 1}, {f"s{i}": 1 + i % 3 for i in range(10)}])
def test_manifest_equals_plain_manifest(spark, monkeypatch, tmp_path, sizes, depth):
    rows = some_rows(sizes)
    rows += rows[:2]  # rows that are alike
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    make = merkle_manifest.manifest
    monkeypatch.setattr(merkle_manifest, "manifest", lambda *a, **k: make(*a, depth=depth, **k))
    found = sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert found == plain_manifest(rows)


def test_manifest_of_odd_tables(spark, odd, nothing):
    assert merkle_manifest.manifest(nothing).count() == 0
    clashing = odd.withColumn("tree", F.lit(1)).withColumn("place", F.lit(2)).withColumn("node", F.lit("x")).withColumn("now", F.lit("y"))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in odd.collect()]
    want = {(r[0], r[1], r[2], r[3]) for r in plain_manifest(rows)}
    found = merkle_manifest.manifest(clashing).collect()
    assert {(r["doc_id"], r["leaf"], r["subroot"], r["root"]) for r in found} == want and len(found) == len(rows)
    assert all(r["folded_root"] == r["root"] for r in found) and len({(r["source"], r["place"]) for r in found}) == len(rows)


def test_proofs_tell_of_any_change(spark):
    """A proof and the root are enough to check a row; any other value of any column fails."""
    docs = spark.createDataFrame(some_rows({"a": 40, "b": 5}), DOCS).dropDuplicates(["doc_id", "source"])
    proofs = merkle_manifest.manifest(docs).select("doc_id", "source", "path", "root")
    for column, value in (("text", "other"), ("lang", "fr"), ("n_chars", -1), (None, None)):
        now = docs.withColumn(column, F.lit(value).cast(docs.schema[column].dataType)) if column else docs
        found = now.join(proofs, ["doc_id", "source"]).select(merkle_manifest.verified(merkle_manifest.leaf(), F.col("path"), F.col("root")).alias("ok")).collect()
        assert len(found) == docs.count() and {r["ok"] for r in found} == {column is None}


