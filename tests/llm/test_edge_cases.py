"""Every operator and stage on nulls, blank and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm import chat, common, hnsw, licenses, mixing, near_dup, packing, pii, quality, token_counts, toxicity
from tidewheel.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, _n string, h string, score string, `group` string, _id string, _h string, _row string"
LABELS = "doc_id long, quality int, toxic int, text string"
LONG = "word another, " * 20000


def rows():
    x = ("7", "8", "9", "10", "11")
    out = [(i, f"plain sentence number {i} about the river and the hill near town {i * 7}.", "en", "a", 1) for i in range(20)]
    out += [(100, None, "en", "a", None), (101, "", None, "b", 0), (102, " \n\t ", "en", None, 3), (103, LONG, "en", "b", 9), (None, "no id here but some words", None, None, 1)]
    out += [(104, "the same text twice over and over", "en", "b", 2)] * 2 + [(105, "the same text twice over and over", "de", "b", 2)]
    return [(*r[:4], r[4], 1, *x[:4], "12", "13", "14") for r in out]


@pytest.fixture(autouse=True)
def tables_go():
    yield
    common.release()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0), "x") for i in range(20)] + [(None, 1, 1, None), (5, None, None, None)], LABELS)


def test_licenses(spark, docs, nothing):
    got = licenses.scan(docs.unionByName(spark.createDataFrame([(1, "x\nReleased under the MIT License.\nAll rights reserved", "en", "a", 1, 1, *[""] * 7)], DOCS)))
    assert {(r.block, r.license) for r in got.collect()} == {(1, "MIT"), (2, "Proprietary")}
    assert licenses.scan(nothing).count() == 0


def test_packing(docs, nothing):
    got = packing.pack(docs, 50).toPandas()
    assert packing.pack(nothing).count() == 0
    assert set(got.doc_id.dropna()) == {*range(20), 103, 104, 105} and got.doc_id.isna().sum() == 1
    assert (got[got.doc_id == 104].groupby("piece").size() == 2).all()  # repeated rows are documents of their own
    assert got[got.doc_id == 103].n_tokens.sum() == len(LONG.split())
    assert (got.bin_offset + got.n_tokens <= 50).all()


def test_mixing(docs, nothing):
    got = mixing.select(docs, ratio=None).toPandas()
    assert set(got.doc_id.dropna()) == {*range(20), 103, 104, 105}
    assert mixing.select(nothing).count() == 0 and mixing.mix(nothing).columns == nothing.columns
    mixed = mixing.mix(docs, ratio=None)
    assert mixed.columns == docs.columns and mixed.count() == len(got)
    assert {(r._n, r.h, r._id, r._h, r._row) for r in mixed.collect()} == {("7", "8", "12", "13", "14")}
    only = mixing.select(docs, targets={"b": 1.0}, ratio=0.2).toPandas()
    assert set(only.source) <= {"b"}


def test_near_duplicates(docs, nothing):
    assert {(r.doc_a, r.doc_b) for r in near_dup.pairs(docs.filter("doc_id > 99 or doc_id is null")).collect()} == {(104, 105)}
    assert near_dup.pairs(nothing).count() == 0
    kept = near_dup.dedup(docs.filter("doc_id > 99 or doc_id is null"))
    assert kept.columns == docs.columns and {(r._n, r.h, r._id, r._h, r._row) for r in kept.collect()} == {("7", "8", "12", "13", "14")}
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["100", "101", "102", "103", "104", "None"]
    assert near_dup.dedup(nothing).count() == 0


def test_quality(spark, docs, nothing, labels):
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert got[101].n_lines == 0 and not got[101].keep and not got[100].keep and not got[102].keep
    assert quality.judge(nothing, labels).count() == 0
    everything = quality.judge(docs, spark.createDataFrame([], LABELS))
    assert everything.filter("n_lines > 0 and not keep").count() == 0
    assert quality.filtered(docs, labels).columns == docs.columns


def test_pii(spark, docs, nothing):
    some = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit("écrire à ana.42@mail.example.com ou 10.20.30.40 vite")).otherwise(F.col("text")))
    got = pii.findings(some)
    assert {(r.doc_id, r.kind, r.value, r.start) for r in got.collect()} == {(3, "EMAIL", "ana.42@mail.example.com", 9), (3, "IP", "10.20.30.40", 36)}
    clean = pii.redact(some)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.filter("doc_id = 3").first().text == "écrire à <EMAIL> ou <IP> vite"
    assert clean.filter("text is null").count() == 1
    assert pii.findings(nothing).count() == 0 and pii.redact(nothing).count() == 0


def test_toxicity(spark, docs, nothing, labels):
    bad = [(1000 + i, f"you {w} and you rotten {v} person {i} walk", "en", "a", 1, 1, *[""] * 7) for i, (w, v) in enumerate([("fiend", "ghoul"), ("ghoul", "fiend"), ("fiend", "wretch"), ("wretch", "ghoul")] * 15)]
    good = [(2000 + i, f"we saw {i} birds over the lake and a boat by pier {i * 3} then", "en", "a", 1, 1, *[""] * 7) for i in range(120)]
    table = docs.unionByName(spark.createDataFrame(bad + good, DOCS))
    marks = spark.createDataFrame([(r[0], 1, 1, None) for r in bad[:40]] + [(r[0], 1, 0, None) for r in good], LABELS)
    kept = toxicity.clean(table, marks)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & {r[0] for r in bad} and ids >= {r[0] for r in good} | {100, 101, 102, 103}
    assert toxicity.clean(docs, spark.createDataFrame([], LABELS)).count() == docs.count()
    assert toxicity.clean(nothing, labels).count() == 0


def test_token_counts(spark, docs, nothing):
    cache = f"{shared_dir(spark)}/cache-edge-{uuid.uuid4().hex}"
    got = token_counts.counts(docs, cache).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (100, 101, 102)} == {100: 0, 101: 0, 102: 0}
    assert len({r.n_tokens for r in got if r.doc_id in (104, 105)}) == 1
    assert token_counts.counts(nothing, f"{cache}-2").count() == 0


def test_operators_leave_the_session_as_it_is(spark, docs, labels):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    quality.judge(docs, labels).count()
    near_dup.pairs(docs).count()
    toxicity.scores(docs, toxicity.induce(docs, labels)).count()
    pii.findings(docs).count()
    assert spark.conf.get(key) == before


def test_scratch_tables_go(spark, docs):
    import os

    outer = common.written(docs, "kept")
    with common.scratch():
        inner = common.written(docs.limit(3), "dropped")
        assert inner.count() == 3
        path = common._written[-1][1]
        assert os.path.exists(path.removeprefix("file://").removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:")) and outer.count() == docs.count()


def test_license_scan_of_repeated_rows_and_null_ids(spark):
    rows = [(7, "Released under the MIT License"), (7, "Released under the MIT License"), (None, "All rights reserved")]
    got = sorted((str(r.doc_id), licenses.TEMPLATES[r.template][1]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # two templates share enough words with the line
    assert got == [("7", "Licensed under the MIT License")] * 2 + [("7", "Released under the MIT License")] * 2 + [("None", "All rights reserved")]


def test_long_conversations(spark):
    turns = [(1, i, "assistant" if i % 100 == 99 else "user", "word " * 300) for i in range(1200)] * 2
    got = chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 12 and max(r.n_context for r in got) == 1199 and all(r.text[r.train_from : r.train_to] == "word " * 300 + "<|end|>\n" for r in got)


def test_quality_and_personal_data_of_repeated_rows(spark, labels):
    docs = spark.createDataFrame([(1, "ana.42@mail.example.com said so."), (1, "ana.42@mail.example.com said so."), (None, "ana.42@mail.example.com"), (2, None)], "doc_id long, text string")
    assert pii.findings(docs).count() == 3 and pii.redact(docs).filter("text like '%<EMAIL>%'").count() == 3
    assert quality.judge(docs, labels).count() == 4 and quality.filtered(docs, spark.createDataFrame([], LABELS)).count() == 3


def test_clashing_names(spark, labels):
    names = ["_text", "content", "_who", "score", "keep", "_n", "_at", "_s", "_cut", "a", "b", "node", "group", "_weight"]
    docs = spark.createDataFrame([(i, f"text of document {i % 4} by the river", "en", "s", *["x"] * len(names)) for i in range(12)], f"doc_id long, text string, lang string, source string, {', '.join(f'`{n}` string' for n in names)}")
    for out in (mixing.mix(docs, ratio=None), near_dup.dedup(docs), pii.redact(docs), quality.filtered(docs, labels), toxicity.clean(docs, labels)):
        assert out.columns == docs.columns and {r[-1] for r in out.collect()} == {"x"}
    assert token_counts.counts(docs, f"{shared_dir(spark)}/cache-clash-{uuid.uuid4().hex}").count() == 12 and packing.pack(docs).count() == 12


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, said string, i int"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, None, None, None), (1, 2, "assistant", " "), (1, 3, "assistant", "more"), (None, 0, "assistant", "lost"), (2, 0, "assistant", "first")]
    got = {(r.conv_id, r.turn): r for r in chat.examples(spark.createDataFrame([(*t, "z", 1) for t in turns], schema)).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 0)}
    r = got[1, 3]
    assert r.text[r.train_from : r.train_to] == "more<|end|>\n" and r.n_context == 4 and r.text.startswith("<|unknown|>\n<|end|>\n<|user|>\nhi")
    assert chat.examples(spark.createDataFrame([], schema)).count() == 0


def test_neighbours(spark):
    schema = "vec_id long, embedding array<float>, vec string, shard int"
    data = [(i, [float(i), 0.0]) for i in range(8)] + [(0, [9.0, 9.0]), (20, None), (21, [1.0]), (22, [float("nan"), 1.0]), (None, [1.0, 1.0]), (23, [1.0, None]), (30, [3.0, 0.0])]
    got = hnsw.neighbours(spark.createDataFrame([(*d, "x", 1) for d in data], schema), 3).toPandas()
    assert set(got.vec_id) == {*range(8), 30}
    assert got[got.vec_id == 0].neighbour.tolist() == [1, 2, 3]
    assert got[(got.vec_id == 3) & (got["rank"] == 1)].neighbour.tolist() == [30]
    assert hnsw.neighbours(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_stages(spark, docs, nothing, labels, tmp_path):
    for name, df in (("labels", labels), ("documents", docs)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, at, str(tmp_path))
        empty = stage(spark, nothing, str(tmp_path))
        assert empty.count() == 0
        if name != "packing":
            assert after.columns == docs.columns and empty.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    assert at.count() > 0
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, at.collect()))
