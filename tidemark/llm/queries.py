"""The numbered queries of this subpackage, their SQL, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bm25_packing, crf_pii, dart_minhash, lsa_knn, merkle_manifest, mpeg_audio, quality_mcd, source_divergence, source_mix, string_kernel, toxicity_fst, url_rules, window_index
from tidemark.llm.labelled import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality_mcd.STATS, "base_failed", "kept", "distance2")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rules(spark)).select("page_id", "host", "path", "rule", "verdict")


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpeg_audio.read_media(mpeg_audio.store_texts(table(spark, sf_dir, "documents")), keep_payload=False)
    rates = F.array_join(F.transform(F.array_sort(F.map_entries("kbps")), lambda e: F.concat_ws("x", e["key"], e["value"])), "+")
    seek = F.concat_ws(",", F.element_at("frame_offsets", 1), F.element_at("frame_offsets", -1))
    feature = F.format_string("frames=%d;samples=%d;rate=%d;kbps=%s;seek=%s;checked=%d;failed=%d;skipped=%d;table=%d/%d", "frames", "samples", "sample_rate", rates, seek, "checked", "failed", "skipped_bytes", "table_frames", "table_bytes")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "duration_s", "frames")


def op4_toxicity_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity_fst.score(docs, toxicity_fst.learned(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(table(spark, sf_dir, "documents"))


def op7_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_index.remove_repeated(table(spark, sf_dir, "documents"))


def op8_lsa_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lsa_knn.score(docs, lsa_knn.learned(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crf_pii.find(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in crf_pii.BASE_KINDS]
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long")
    return found.select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), secrets.alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = string_kernel.identify(docs, string_kernel.learned(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_manifest.manifest(table(spark, sf_dir, "documents"), changed={"text": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("path", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_quality_mcd, op2_url_rules, op3_mpeg_audio, op4_toxicity_fst, op5_bm25_packing, op6_dart_minhash, op7_window_index, op8_lsa_knn, op9_source_mix, op10_crf_pii, op11_source_divergence, op12_string_kernel, op13_merkle_manifest)}


def _op2_sql() -> str:
    """The rules are the operator's own parameters; the base ones are matched on host and path, not through an index."""
    host = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    base = sorted(((len(r), r, a) for a, r in url_rules.HOST_RULES), reverse=True)
    fits = []
    for _, rule, _action in base:
        name, _, rest = rule.partition("/")
        fits.append(f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')")
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, (_, r, _a) in zip(fits, base, strict=True)) + " END"
    action = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{a}'" for _, r, a in base)
    any_of = lambda what: " OR ".join(f"regexp_matches('//' || host || path, '{p}')" for a, p, _ in url_rules.PATTERN_RULES if a == what)
    return (
        f"WITH a AS (SELECT page_id, {host} AS host, {path} AS path FROM pages), b AS (SELECT *, {rule} AS rule FROM a) "
        f"SELECT page_id, host, path, rule, {action} WHEN ({any_of('block')}) AND NOT ({any_of('allow')}) THEN 'block' ELSE 'allow' END AS verdict FROM b"
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
-- Each source that is full leaves the rest to the others: the level is the first at which no open source is above its cap.
l AS (SELECT a.source, a.cap / a.w AS ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM r) - coalesce(sum(b.cap), 0)) / ((SELECT sum(w) FROM r) - coalesce(sum(b.w), 0)) AS level
      FROM r a LEFT JOIN r b ON b.cap / b.w < a.cap / a.w GROUP BY a.source, a.cap, a.w),
t AS (SELECT source, source_size, least(cap, (SELECT min_by(level, ratio) FROM l WHERE level <= ratio) * w) AS target FROM r),
k AS (SELECT d.*, CAST(('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), '-'), size, md5(text))), 1, 13)) AS BIGINT) AS key FROM d),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size, md5(k.text) ROWS UNBOUNDED PRECEDING) AS BIGINT) - k.size AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS taken FROM p
"""

OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 30),
size AS (SELECT lang, count(t) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
n AS (SELECT lang, source, t, CAST(count(*) AS HUGEINT) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) JOIN kept USING (lang, t) GROUP BY lang, source, t),
cell AS (SELECT g.lang, g.source, k.t, coalesce(n.n, 0::HUGEINT) AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.t = k.t),
p AS (SELECT lang, source, t, n, 1 + (1000000000::HUGEINT * (n + 5)) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) + 5 * v) AS p FROM cell JOIN size USING (lang)),
whole AS (SELECT lang, t, CAST(sum(n) AS HUGEINT) AS n FROM cell GROUP BY lang, t),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (n + 5)) // (CAST(sum(n) OVER (PARTITION BY lang) AS HUGEINT) + 5 * v) AS q FROM whole JOIN size USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
         FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, t AS item, p - q AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_BEFORE_TEXT = " || ".join(_FIELD(c) for c in merkle_manifest.COLUMNS[:-1])
#: CRC-32 of the id as text: each byte goes in, then eight steps (-1) shift it through.
_CRC = (
    "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([ord(c)::BIGINT], list_transform(range(8), lambda k: -1::BIGINT))))), "
    "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END))"
)
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_BEFORE_TEXT} || {_FIELD('text')}) AS leaf, text, {_BEFORE_TEXT} AS head FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
node AS (SELECT source, 0 AS level, i, n, leaf AS h FROM leaves UNION ALL
         SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY source, level, i // 3, n),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, level AS height FROM node WHERE n = 1),
top AS (SELECT 0 AS level, i, n, subroot AS h FROM subroots UNION ALL
        SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3, n),
root AS (SELECT h AS root FROM top WHERE n = 1),
run AS (SELECT source, level, i // 3 AS i, list(h ORDER BY i) AS hs FROM node WHERE n > 1 GROUP BY source, level, i // 3),
top_run AS (SELECT level, i // 3 AS i, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY level, i // 3),
-- Levels of all sources and of the sources' tree in one order for each leaf: level, place in the run, the run.
fold AS (
  SELECT l.doc_id, l.source, l.leaf, s.height, s.i AS source_i, 0 AS level, l.i AS i, '' AS proof,
         CASE WHEN crc % 2 = 0 THEN sha256(l.head || {_FIELD("replace(l.text, chr(10), '')")}) ELSE l.leaf END AS h
  FROM (SELECT *, {_CRC} AS crc FROM leaves) l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT f.doc_id, f.source, f.leaf, f.height, f.source_i, f.level + 1, f.at // 3, f.proof || array_to_string(list_concat(f.hs[:f.at % 3], f.hs[f.at % 3 + 2:]), ''),
         sha256(array_to_string(list_concat(f.hs[:f.at % 3], [f.h], f.hs[f.at % 3 + 2:]), ''))
  FROM (SELECT g.*, coalesce(r.hs, t.hs) AS hs, CASE WHEN g.level < g.height THEN g.i WHEN g.level = g.height THEN g.source_i ELSE g.i END AS at
        FROM fold g LEFT JOIN run r ON g.level < g.height AND r.source IS NOT DISTINCT FROM g.source AND r.level = g.level AND r.i = g.i // 3
        LEFT JOIN top_run t ON g.level >= g.height AND t.level = g.level - g.height AND t.i = (CASE WHEN g.level = g.height THEN g.source_i ELSE g.i END) // 3) f
  WHERE f.hs IS NOT NULL)
SELECT f.doc_id, f.leaf, s.subroot, root.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM fold f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source, root WHERE f.level = f.height + (SELECT max(level) FROM top)
"""

ORACLE_SQL = {"op2_url_rules": _op2_sql(), "op9_source_mix": OP9_SQL, "op11_source_divergence": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
