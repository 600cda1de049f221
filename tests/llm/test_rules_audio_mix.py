"""Quality rules, URL rules, audio streams and mixing."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import mpeg_audio, quality_mcd, source_mix, url_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(8)}
    lines, before = 0, set()
    for line in text.split("\n"):
        lines += bool(WORD.search(line)) and line in before
        before.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(hit)


def test_counts_and_verdicts(spark, odd, nothing):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        found = quality_mcd.judge(docs).collect()
        want = Counter((r["doc_id"], *plain_counts(r["text"])) for r in docs.collect())
        assert Counter((r["doc_id"], *(r[c] for c in quality_mcd.STATS)) for r in found) == want
        for r in found:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])
    assert quality_mcd.judge(nothing).count() == 0


def test_estimate_is_robust(spark):
    rng = np.random.default_rng(2)
    p = quality_mcd.P
    mean, spread = np.arange(p) * 1.0, np.linspace(1, 2, p)
    rows = [("a", *map(float, rng.standard_normal(p) * spread + mean)) for _ in range(2400)]
    rows += [("a", *map(float, rng.standard_normal(p) * 0.1 + 30)) for _ in range(500)]
    rows += [("b", *map(float, rng.standard_normal(p))) for _ in range(10)]
    df = spark.createDataFrame(rows, "cell string, " + ", ".join(f"x{i} double" for i in range(p))).selectExpr("CAST(NULL AS STRING) AS parent", "*")
    states = {r["cell"]: r for r in quality_mcd.estimates(df).collect()}
    assert set(states) == {"a", "b"} and all(r["change"] < quality_mcd.SETTLED for r in states.values())
    centre = np.array(states["a"]["moments"][:p])
    assert np.abs(centre - mean).max() < 0.25
    scale = 1 / np.array([states["a"]["inverse"][quality_mcd.PAIRS.index((i, i))] for i in range(p)])
    assert (scale > 0.75 * spread).all() and (scale < 1.35 * spread).all()


def test_small_sources_lean_on_their_language(spark):
    """A source of one row is judged by its language, one of few rows does not vouch for itself, a large one has its own estimate."""
    rng = np.random.default_rng(5)
    p = quality_mcd.P
    near, far = (lambda: rng.standard_normal(p)), (lambda: rng.standard_normal(p) * 0.3 + 25)
    table = [("en", "a", near()) for _ in range(900)] + [("en", "odd", far()) for _ in range(8)] + [("en", "big", far()) for _ in range(250)] + [("en", None, near()), ("en", "", far()), (None, None, near())]
    rows = spark.createDataFrame([(lang, source, *map(float, x)) for lang, source, x in table], "lang string, source string, " + ", ".join(f"x{i} double" for i in range(p)))
    assert {tuple(r) for r in rows.select(*quality_mcd.levels()[1:]).distinct().collect()} >= {('{"lang":"en"}', '{"lang":"en"}'), ('{"lang":"en"}', '{"lang":"en","source":""}'), ("{}", "{}")}
    state, parent = None, quality_mcd.F.lit(None).cast("string")
    for cell in quality_mcd.levels():
        state = quality_mcd.estimates(rows.select(cell.alias("cell"), parent.alias("parent"), *(f"x{i}" for i in range(p))), state)
        parent = cell
    limit = 2.0 * quality_mcd.chi2_quantile(1 - 1e-7, p)
    judged = rows.withColumn("cell", parent).join(quality_mcd.placed(state), "cell").select("source", "x0", (quality_mcd.distance() > limit).alias("far")).collect()
    assert len(judged) == len(table)
    for r in judged:
        assert r["far"] == (r["source"] in ("odd", "")), r


URLS = ["http://Blog.X.example.net/en/1?q", "https://a.example.com/de/x", "ftp://example.com/DE/x", "http://q.org/fr/", "http://org/fr/1", "http://notnet/", "http://x.net", "http://x.net#a/b", "no scheme", None, "http://cheap-pills.example.com/en/1", "http://a.example.org/casino/1", "http://x.casino-win.gov/a", "a://b://net/", "http://x.net/ a\nb"]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, a) for a, r in url_rules.HOST_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    hit = {a for a, p, _ in url_rules.PATTERN_RULES if re.search(p, "//" + host + path)}
    return host, path, None, "block" if hit == {"block"} else "allow"


def test_urls_equal_all_rules(spark):
    pages = [(i, u, "h", "t") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "t"), (None, URLS[1], "h", "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, token string, rule string")
    found = url_rules.judge(df, url_rules.rules(spark)).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found) == Counter((p[0], *plain_verdict(p[1])) for p in pages)
    assert url_rules.judge(df.limit(0), url_rules.rules(spark)).count() == 0


def test_rules_lie_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(1, "http://a.example.net/en/"), (2, "http://b.net/en/"), (3, "http://c.net/x/")], "page_id long, url string")
    found = {r["rule"]: r["token"] for r in url_rules.index(url_rules.rules(spark), pages).collect()}
    assert found["example.net/en/"] == "example" and found["net/"] == "net" and "" not in found.values()
    more = url_rules.rules(spark, (), (("block", "x+", ()), ("block", "^//a[.]", ("a",))))
    assert {r["rule"]: r["token"] for r in url_rules.index(more, pages).collect()} == {"x+": "", "^//a[.]": "a"}


def test_only_rules_are_broadcast(spark):
    """The pages meet the rules without a shuffle, and never are the broadcast side."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plan = url_rules.judge(pages, url_rules.rules(spark))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("Exchange hashpartitioning(page_id") == 1 and "SortMergeJoin" not in plan.split("== Initial Plan ==")[0].split("best#")[0]
    for join in re.findall(r"BroadcastHashJoin [^\n]*", plan):
        assert "BuildLeft" not in join


def test_many_rules_join_by_token(spark):
    """Beyond the bound of a broadcast the results are the same."""
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string")
    extra = url_rules.PATTERN_RULES + (("block", "/x$", ()),)
    rules = url_rules.rules(spark, url_rules.HOST_RULES, extra)
    want = Counter(map(tuple, url_rules.judge(pages, rules).collect()))
    assert Counter(map(tuple, url_rules.judge(pages, rules, most=3).collect())) == want
    with pytest.raises(ValueError):
        url_rules.judge(pages, url_rules.rules(spark, (), (("block", "a", ()), ("block", "b", ()))), most=1)


@pytest.mark.parametrize("size", [64, 1408, 1409, 64 * 40, 64 * 2000])
def test_streams_give_their_payload_back(size):
    payload = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    media = mpeg_audio.store(payload)
    f = mpeg_audio.read(media)
    assert f.payload == payload and f.failed == 0 and f.skipped == 0 and f.tags == {"payload_bytes": str(size)}
    assert f.table["frames"] == f.frames == len(f.offsets) and f.checked == f.frames + 1
    assert f.duration == f.frames * mpeg_audio.Fraction(1152, 32000)
    assert all(mpeg_audio.header(media[o : o + 4]) for o in f.offsets)
    assert f.table["bytes"] == len(media) - mpeg_audio.parse_tags(media)[0]


def test_reader_survives_damage():
    payload = bytes(range(256)) * 40
    media = mpeg_audio.store(payload)
    whole = mpeg_audio.read(media)
    junk = media[: whole.offsets[2]] + b"\xff\xfbjunk\xff\xff" + media[whole.offsets[2] :]
    f = mpeg_audio.read(junk)
    assert f.skipped >= 8 and set(f.offsets) >= {o + 8 * (o >= whole.offsets[2]) for o in whole.offsets if o not in whole.offsets[1:3]}
    broken = bytearray(media)
    broken[whole.offsets[1] + 10] ^= 1  # in the side information
    f = mpeg_audio.read(bytes(broken))
    assert f.failed == 1 and f.frames == whole.frames and len(f.payload) < len(payload)
    tagged = media + b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(65)
    f = mpeg_audio.read(tagged)
    assert f.tags["v1_title"] == "Song" and f.payload == payload and f.skipped == 0
    assert mpeg_audio.read(b"").frames == 0 and mpeg_audio.read(b"\xff" * 100).frames == 0 and mpeg_audio.read(media[:50]).payload == b""


def test_frame_sizes_and_checksum():
    # MPEG-1 Layer III, 128 kbit/s at 44.1 kHz: 417 bytes, 418 with padding.
    assert mpeg_audio.header(b"\xff\xfb\x90\x00").size == 417 and mpeg_audio.header(b"\xff\xfb\x92\x00").size == 418
    assert mpeg_audio.header(b"\xff\xf3\x80\x00").samples == 576 and mpeg_audio.header(b"\xff\xff\x10\x00").layer == 1
    assert mpeg_audio.header(b"\xff\xfb\xf0\x00") is None and mpeg_audio.header(b"\xff\xe9\x90\x00") is None
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7


def test_other_layers_and_tables():
    """Layer I frames are verified over their allocation, Layer II frames are told apart, and tables give their entries."""
    for four in (b"\xff\xfe\xe4\xc0", b"\xff\xfe\xe4\x00", b"\xff\xfe\xe4\x60"):  # mono, stereo, joint from a bound
        head, body = mpeg_audio.header(four), bytes(range(1, 33))
        assert head.layer == 1 and head.protected
        part = body[: mpeg_audio.allocation(four)]
        frame = (four + mpeg_audio.crc16(four[2:] + part).to_bytes(2, "big") + part).ljust(head.size, b"\0")
        f = mpeg_audio.read(frame * 3)
        assert (f.frames, f.checked, f.failed, f.unverified) == (3, 3, 0, 0)
        broken = bytearray(frame * 3)
        broken[7] ^= 4
        assert mpeg_audio.read(bytes(broken)).failed == 1
    two = mpeg_audio.header(b"\xff\xfc\x14\x00")
    f = mpeg_audio.read((b"\xff\xfc\x14\x00").ljust(two.size, b"\0") * 2)
    assert two.layer == 2 and (f.frames, f.checked, f.unverified) == (2, 0, 2)
    media = mpeg_audio.store(bytes(64 * 900))
    seek = mpeg_audio.read(media).table["seek"]
    assert len(seek) == 100 and seek == sorted(seek) and seek[0] <= 5 and seek[-1] >= 245
    frame = bytearray(417)
    frame[36:62] = b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (12).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + bytes(2)
    frame[62:66] = (7).to_bytes(2, "big") + (9).to_bytes(2, "big")
    assert mpeg_audio.parse_table(bytes(frame), mpeg_audio.header(b"\xff\xfb\x90\x00")) == {"bytes": 5000, "frames": 12, "seek": [21, 27]}


def test_audio_of_odd_rows(spark, odd, nothing):
    rows = mpeg_audio.read_media(mpeg_audio.store_texts(odd)).collect()
    want = Counter((r["doc_id"], hashlib.sha256(mpeg_audio.padded(r["text"])[1]).hexdigest()) for r in odd.collect())
    assert Counter((r["doc_id"], hashlib.sha256(r["payload"]).hexdigest()) for r in rows) == want
    assert mpeg_audio.read_media(mpeg_audio.store_texts(nothing)).count() == 0


def check_mix(rows, docs):
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d["doc_id"], len(WORD.findall(d["text"] or ""))) for d in docs)
    sums = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[r["source"], r["target"], r["source_size"]] += r["taken"]
    assert all(int(t) == taken and t <= 2 * s for (_, t, s), taken in sums.items())
    assert len(sums) == len({r["source"] for r in rows})
    total = sum(s for _, _, s in sums)
    assert sum(t for _, t, _ in sums) == pytest.approx(1.5 * total)


def test_mix_meets_budgets(spark, odd, nothing):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = source_mix.mix(docs, per_range=7)
        check_mix(rows.collect(), docs.collect())
        assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, source_mix.mix(docs, per_range=7).collect()))
    assert source_mix.mix(nothing).count() == 0


def test_targets_reshare_excess(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 5), (None, 100), ("d", 0)]
    got = {r["source"]: r["target"] for r in source_mix.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = {"a": 3.0, "b": 1.0, "c": 2.0, "d": 3.0, None: 1.0}
    cap = {s: 2.0 * n for s, n in sizes}
    total = 1.5 * sum(n for _, n in sizes)
    full = set()
    while True:
        rest = total - sum(cap[s] for s in full)
        level = rest / sum(weight[s] for s in weight if s not in full)
        more = {s for s in weight if s not in full and level * weight[s] > cap[s]}
        if not more:
            break
        full |= more
    for s in weight:
        assert got[s] == pytest.approx(cap[s] if s in full else level * weight[s])


def test_taken_rows_hold_the_words_taken(spark, odd):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        out = source_mix.taken_rows(docs)
        assert out.columns == docs.columns
        taken = Counter()
        for r in source_mix.mix(docs).collect():
            taken[r["doc_id"]] += r["taken"]
        got = Counter()
        for r in out.collect():
            got[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
        assert all(got[i] == n for i, n in taken.items())


def test_copies_take_places_of_their_own(spark):
    """Three equal rows of 35 words each, and rows of one id and size with other texts: no word is lost, none is cut twice."""
    rows = [(1, " ".join(f"a{i}" for i in range(35)), "s", n) for n in range(3)]
    rows += [(2, " ".join(f"{c}{i}" for i in range(20)), "s", n) for n, c in enumerate("xyz")] + [(3, "", "s", 9), (4, None, "s", 9), (None, "only one", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mixed = source_mix.mix(docs, share=0.7).collect()
    out = source_mix.taken_rows(docs, share=0.7)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += r["taken"]
    assert +got == +want and sum(got.values()) == sum(int(t) for t in {r["source"]: r["target"] for r in mixed}.values())
    cuts = [r for r in out.collect() if r["source"] == "s" and len(WORD.findall(r["text"] or "")) not in (35, 20)]
    assert len(cuts) <= 1 and all(r["text"] for r in out.collect())  # no whole epoch: rows without words go
    whole = source_mix.taken_rows(docs, share=1.5).collect()
    assert Counter(r["doc_id"] for r in whole)[3] == Counter(r["doc_id"] for r in whole)[4] == 1


def plain_mcd(x, above=None, support=0.75):
    """Concentration steps on whole rows, from the same start, to the end, with the level above as `PRIOR` weighs it."""
    p, n = quality_mcd.P, len(x)
    floor = np.array(quality_mcd.FLOOR)
    mean = np.median(x, 0)
    spread = np.maximum(np.median(np.abs(x - mean), 0) * 1.4826, floor)
    d = (((x - mean) / spread) ** 2).sum(1)
    factor = support / quality_mcd.chi2_cdf(quality_mcd.chi2_quantile(support, p), p + 2)
    a, b = (n / (n + k) for k in quality_mcd.PRIOR)
    for _ in range(40):
        near = x[np.argsort(d, kind="stable")[: int(np.ceil(support * n))]]
        up = above or (near.mean(0), np.diag(np.square(quality_mcd.WIDE)))
        mean = a * near.mean(0) + (1 - a) * up[0]
        cov = b * np.cov(near.T, bias=True) * factor + (1 - b) * up[1]
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + np.diag(floor**2) * 0.25), x - mean)
    return d, (mean, cov)


def test_verdicts_agree_with_a_plain_estimate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = quality_mcd.statistics(docs).toPandas()
    limit = 2.0 * quality_mcd.chi2_quantile(1 - 1e-7, quality_mcd.P)
    vectors = lambda part: part[[f"x{i}" for i in range(quality_mcd.P)]].to_numpy()
    want = {}
    _, top = plain_mcd(vectors(table))
    for _, of_lang in table.groupby("lang", dropna=False):
        _, middle = plain_mcd(vectors(of_lang), top)
        for _, part in of_lang.groupby("source", dropna=False):
            want |= dict(zip(part["doc_id"], plain_mcd(vectors(part), middle)[0]))
    found = quality_mcd.judge(docs).collect()
    far = lambda d: d > limit
    clear = [r for r in found if not 0.8 * limit < want[r["doc_id"]] < 1.25 * limit]
    assert len(clear) >= 0.97 * len(found)
    assert all(r["settled"] for r in found)
    agree = sum(far(r["distance2"]) == far(want[r["doc_id"]]) and r["kept"] == (not r["base_failed"] and not far(want[r["doc_id"]])) for r in clear)
    assert agree >= 0.995 * len(clear)


def test_junk_that_passes_the_base_rule_is_rejected(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) + ("." if rng.random() < 0.1 else "")
    rows = [(i, " ".join(word() for _ in range(rng.randrange(80, 200))), "en", "a") for i in range(300)]
    rows += [(i, " ".join("#%&=/@!" * 3 + str(rng.randrange(10**9)) for _ in range(100)), "en", "a") for i in range(300, 306)]
    found = quality_mcd.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in found)
    assert {r["doc_id"] for r in found if not r["kept"]} == set(range(300, 306))
