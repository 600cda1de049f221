"""Near-duplicate classes and repeated passages against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import dart_minhash, window_index

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().split()


def multiset(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    """Components of pairs of equal texts, or of weighted Jaccard similarity of 0.8 or more."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    texts = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        texts[t if t is not None else (n,)].append(i)
    keys = [k for k in texts if isinstance(k, str)]
    sets = {k: multiset(k) for k in keys}
    index = defaultdict(set)
    for k in keys:
        for s in sets[k]:
            index[s].add(k)
    for k in keys:
        for other in set().union(*(index[s] for s in sets[k])) if sets[k] else ():
            if other > k:
                common = sum((sets[k] & sets[other]).values())
                if common >= 0.8 * (sets[k].total() + sets[other].total() - common):
                    parent[find(k)] = find(other)
    members = defaultdict(list)
    for k, ids in texts.items():
        members[find(k)] += ids
    out = []
    for ids in members.values():
        named = [i for i in ids if i is not None]
        out += [(i, min(named) if named else None, len(ids)) for i in ids]
    return Counter(out)


def near_rows():
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (3, 6, 40, 200, 900)]
    rows = []
    for b in base:
        for edits in (0, 0, 1, 2, 4, 9, 30):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for k in range(12):  # each is near the next, the ends are not near each other
        rows.append((len(rows), " ".join([*(f"d{j}" for j in range(k * 4)), *chain[k * 4 :]])))
    heavy = ["a b c d e"] * 30
    rows += [(len(rows), " ".join(heavy)), (len(rows) + 1, " ".join(heavy[:26])), (len(rows) + 2, " ".join(heavy[:9]))]
    return rows


@pytest.mark.parametrize("name", ["made", "sf"])
def test_classes_equal_brute_force(spark, name):
    rows = near_rows() if name == "made" else [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = dart_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, found.collect())) == brute_classes(rows)


def test_classes_of_odd_rows(spark, odd, nothing):
    found = Counter(map(tuple, dart_minhash.classes(odd).collect()))
    assert found == brute_classes([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert dart_minhash.classes(nothing).count() == 0
    kept = dart_minhash.deduplicated(odd)
    assert kept.columns == odd.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter({(r["doc_id"], r["text"]) for r in odd.collect()} - {(9, "")})
    assert dart_minhash.deduplicated(nothing).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rows = [(3, "x y", "a"), (3, "totally different words that nobody else has", "b"), (3, "x y", "c"), (None, "x y", "d"), (None, None, "e"), (5, None, "f"), (5, None, "g"), (None, "only here", "h"), (None, "only here", "i"), (7, "only here", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = dart_minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, "x y"), (3, "totally different words that nobody else has"), (None, None), (5, None), (5, None), (7, "only here")])
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, dart_minhash.deduplicated(docs.repartition(3, "key")).collect()))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    value = np.sort(rng.integers(1, 1 << 62, 300).astype(np.uint64))
    a, b = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    doc = np.repeat([0, 1], 300)
    s = dart_minhash.signatures(np.concatenate([value, value]), doc, np.concatenate([a, b]), 2, k=4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    assert (s != 0).all()


def brute_removed(rows, size=35):
    seen = Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if seen[tuple(w[j : j + size])] > 1:
                gone[j : j + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeat_rows():
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passages = [new(n) for n in (34, 35, 36, 60, 200)]
    rows = []
    for _ in range(60):
        w = []
        for _ in range(rng.randrange(4)):
            w += new(rng.randrange(50)) + rng.choice(passages)
        rows.append((len(rows), " ".join(w + new(rng.randrange(40)))))
    rows.append((len(rows), " ".join(["same"] * 300)))
    rows.append((len(rows), " ".join(["a b c"] * 40)))
    rows.append((len(rows), " ".join(["same"] * 36)))
    return rows


@pytest.mark.parametrize("batches", [1, 6])
def test_repeats_equal_brute_force(spark, batches):
    rows = repeat_rows()
    found = window_index.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), batches)
    assert Counter(map(tuple, found.collect())) == brute_removed(rows)


def test_repeats_of_tables(spark, odd, nothing):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        assert Counter(map(tuple, window_index.remove_repeated(docs).collect())) == brute_removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert window_index.remove_repeated(nothing).count() == 0


def test_compaction_keeps_counts(spark, tmp_path):
    rows = window_index.narrow(spark.createDataFrame(repeat_rows(), "doc_id long, text string"))
    once, many = window_index.WindowIndex(spark, f"file://{tmp_path}/once"), window_index.WindowIndex(spark, f"file://{tmp_path}/many", most_runs=2)
    once.add(rows)
    for b in range(5):
        many.add(rows.filter(f"doc_id % 5 = {b}"))
    assert len(many.runs()) <= 2
    count = lambda index: Counter((r["gram"], r["whole"], r["n"]) for r in index.entries().collect())
    assert count(once) == count(many)
    once.drop(), many.drop()


def test_runs_meet_in_one_shuffle(spark, tmp_path):
    """And each fingerprint is one row, in the runs as in what they are compacted to."""
    index = window_index.WindowIndex(spark, f"file://{tmp_path}/plan", most_runs=9)
    rows = window_index.narrow(spark.createDataFrame(repeat_rows(), "doc_id long, text string"))
    for b in range(3):
        index.add(rows.filter(f"doc_id % 3 = {b}"))
    plan = index.entries()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    index.compact()
    run = index._runs_of(index.runs())
    assert len(index.runs()) == 1 and run.count() == run.select("gram", "whole").distinct().count() == index.entries().count()
    index.drop()


def test_a_later_batch_gives_what_a_rebuild_gives(spark, tmp_path):
    """An index that is opened again at its path: texts of history get marks, too."""
    pair = [(3001, " ".join(f"p{i}" for i in range(50))), (3002, "x " + " ".join(f"p{i}" for i in range(50)))]  # 3001 comes with the second batch, 3002 with the third
    rows = window_index.narrow(spark.createDataFrame(repeat_rows() + pair, "doc_id long, text string"))

    def windows(index):
        out = set()
        for r in index.marks().collect():
            out |= {(r["doc_id"], w) for s in r["sure"] for w in range(s >> 5, (s >> 5) + (s & 31) + 1)} | {(r["doc_id"], w) for w in r["found"]}
        return out

    parts = [rows.filter("doc_id % 3 = 0"), rows.filter("doc_id % 3 = 1"), rows.filter("doc_id % 3 = 2")]
    for part in parts[:2]:
        window_index.WindowIndex(spark, f"file://{tmp_path}/grown").add(part)
    before = windows(window_index.WindowIndex(spark, f"file://{tmp_path}/grown"))
    later = window_index.WindowIndex(spark, f"file://{tmp_path}/grown", most_runs=2)
    later.add(parts[2])
    assert len(later.runs()) == 1
    rebuilt = window_index.WindowIndex(spark, f"file://{tmp_path}/rebuilt")
    rebuilt.add(rows)
    assert windows(later) == windows(rebuilt) > before
    assert {i for i, _ in windows(later) - before} >= {3001, 3002} and 3001 % 3 < 2
    later.drop(), rebuilt.drop()


def copies_rows(copies, edited, length=200):
    """A base text and copies of it with other words at random places: each near the base, most not near each other."""
    rng = random.Random(17)
    base = [f"b{i}" for i in range(length)]
    rows = [(0, " ".join(base))]
    for n in range(1, copies + 1):
        w = base.copy()
        for k in rng.sample(range(length // 10), edited):
            w[k * 10 + rng.randrange(5)] = f"e{n}x{k}"
        rows.append((n, " ".join(w)))
    return rows


def test_copies_of_one_text_are_one_class(spark):
    rows = copies_rows(600, 4)
    assert dart_minhash.similarity(*[r["elements"] for r in dart_minhash.elements(dart_minhash.keyed(spark.createDataFrame(rows[1:3], "doc_id long, text string"))).collect()]) < 0.8
    found = Counter(map(tuple, dart_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found == brute_classes(rows) == Counter((i, 0, len(rows)) for i, _ in rows)


def test_pairs_in_large_buckets_of_texts_apart(spark):
    """No text is near most others, and every bucket of many holds pairs that are near."""
    rng = random.Random(23)
    rows = []
    for n in range(600):
        w = [f"b{i}" for i in range(200)]
        at = rng.sample(range(20), 7)
        for k in at[:3]:
            w[k * 10 + rng.randrange(5)] = f"e{n}x{k}"
        rows.append((len(rows), " ".join(w)))
        for k in at[3:]:
            w[k * 10 + rng.randrange(5)] = f"f{n}x{k}"
        rows.append((len(rows), " ".join(w)))
    found = Counter(map(tuple, dart_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found == brute_classes(rows)


def test_copies_of_a_text_without_id(spark):
    rows = [(i or None, t) for i, t in copies_rows(12, 4)]
    found = Counter(map(tuple, dart_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found == brute_classes(rows)
    assert found[(12, 1, 13)] == 1
