"""The pipeline's stages: columns, decisions and odd rows."""

import re

import corpus_pipeline
from tidemark.llm import crf_pii, dart_minhash, toxicity_fst
from tidemark.llm.scratch import stored

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    model = toxicity_fst.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity_fst.score(docs, model).filter("score >= 0.7").collect()}
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        out.append(docs)
    assert all(d.columns == columns for d in out[:-1])
    ids = [[r["doc_id"] for r in d.collect()] for d in out[:-1]]
    assert set(ids[0]) == set(before) - toxic
    classes = dart_minhash.classes(out[0]).collect()
    assert sorted(ids[1]) == sorted({r["class_id"] for r in classes}) and len(ids[1]) == len(set(ids[1]))
    assert sorted(ids[2]) == sorted(ids[1])
    finder = crf_pii.Finder(crf_pii.trained())
    for r in out[2].collect():
        assert crf_pii.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
    sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in out[2].collect()}
    taken = {}
    for r in out[3].collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert all(n <= 2 * sizes[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 25
    rows = out[4].collect()
    assert {r["doc_id"] for r in rows} == set(ids[3]) and all(len(r["ids"]) == r["length"] for r in rows)
    del finder


def test_stages_on_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF))
            assert name == "packing" or docs.columns == columns


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
