"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import licenses, line_dedup, mixing, neardup, ngram_join, packing, pii, suffix_tree, topk, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", id string, a string, th string, h string, node string, toxicity string, removed_lines string, _th string, n_tokens string, text_hash string, rank string, s string"
LABELS = "doc_id bigint, quality int, toxic int"


def rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 7)))
    out = []
    for i in range(30):
        text = "\n".join(" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6)))
        out.append((i, text, "en", f"src{i % 3}", len(text)))
    long = " ".join(word() for _ in range(60_000))
    out += [(30, long, "en", "src0", len(long)), (31, out[3][1], "en", "src1", 5), (31, out[3][1], "en", "src1", 5)]
    out += [(None, out[4][1], None, None, None), (32, None, None, "src2", None), (33, "", "en", "src2", 0), (34, " \n \n", "en", None, 4), (35, "zone", "de", "src1", 4), (35, "two zone", "de", "src1", 8)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + ("x",) * EXTRA.count("string") for r in rows()], DOCS + EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + EXTRA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None), (3, 1, 1)], LABELS)


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int, id string, v string, dim string")


def test_vectors(spark):
    ok = [1.0, 2.0, 3.0]
    data = [(1, ok), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, float("nan"), 0.0]), (7, [1.0, None, 2.0]), (None, ok), (8, [1.0, 2.0]), (2, ok), (9, [3.0, -1.0, 0.0])]
    got = neardup.near_duplicates(vectors(spark, [(i, v, 0, "", "", "") for i, v in data])).collect()
    assert len(got) == len(data)
    assert {(r.vec_id, r.cluster_id) for r in got} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (None, None), (8, 8), (9, 9)}
    assert all(r.links == {1: 1, 2: 2}.get(r.vec_id, 0) for r in got)
    named = vectors(spark, [(1, ok, 0, "", "", ""), (2, ok, 0, "", "", ""), (3, [1e30, 2e30, 3e30], 0, "", "", ""), (4, [3.0, -1.0, 0.0], 0, "", "", "")]).withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    assert {(r.vec_id, r.cluster_id, r.links) for r in neardup.near_duplicates(named).collect()} == {("v1", "v1", 1), ("v2", "v1", 1), ("v3", "v1", 1), ("v4", "v4", 0)}
    assert all(r.keep for r in got if r.vec_id != 2) and not any(r.keep for r in got if r.vec_id == 2)
    assert neardup.near_duplicates(vectors(spark, [])).count() == 0


def test_top_k(spark, docs, empty):
    ask = spark.createDataFrame([(1, rows()[5][1], "x"), (1, rows()[6][1], "x"), (2, None, "x"), (None, "zone", "x"), (3, "", "x"), (4, "zone zwei", "x")], "item_id bigint, text string, score string")
    got = topk.top_k(docs, ask, k=3).collect()
    assert {r.item_id for r in got} == {1, 4}
    assert [r.doc_id for r in sorted((r for r in got if r.item_id == 4), key=lambda r: r["rank"])] == [35, 35]
    named = topk.top_k(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), ask.withColumn("item_id", F.concat(F.lit("i"), "item_id")), k=3).collect()
    assert {r.item_id for r in named} == {"i1", "i4"} and {r.doc_id for r in named if r.item_id == "i4"} == {"d35"}
    assert topk.top_k(empty, ask).count() == 0 and topk.top_k(docs, ask.limit(0)).count() == 0


def test_licenses(spark, docs, empty):
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert got == set() and licenses.scan(empty).count() == 0
    line = "Released under the MIT License."
    both = spark.createDataFrame([(1, line + " x y z " * 40 + line), (1, line + " x y z " * 40 + line), (None, line), (None, line + " more"), (2, line)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.license) for r in licenses.scan(both).collect()) == [(0, "MIT"), (0, "MIT"), (1, "MIT"), (1, "MIT"), (2, "MIT")]


def test_scores(docs, empty):
    got = suffix_tree.score(docs).collect()
    assert len(got) == len(rows()) and {r.doc_id for r in got if r.bits_per_byte is None} == {32, 33}
    assert all(r.bits_per_byte > 0 for r in got if r.bits_per_byte is not None)
    assert suffix_tree.score(empty).count() == 0


def test_toxicity(docs, empty, labels):
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.toxicity <= 1 for r in got)
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.classify(empty, labels).count() == 0 and toxicity.accepted(docs, labels.limit(0)).count() == len(rows())


def test_lines(docs, empty):
    got = line_dedup.line_dedup(docs)
    assert got.count() == len(rows()) and set(docs.columns) == set(got.columns)
    by = {(r.doc_id, r.source): r for r in got.collect()}
    assert by[(32, "src2")].text is None and by[(33, "src2")].text == "" and by[(30, "src0")].text == rows()[30][1]
    assert line_dedup.line_dedup(empty).count() == 0


def test_private(spark, docs, empty):
    assert pii.private_data(docs).count() == 0 and pii.private_data(empty).count() == 0
    mail = "write to a.b@x.com or a.b@x.com"
    data = [(1, mail, "x"), (1, mail, "x"), (None, mail, "x"), (2, None, "x"), (3, "", "x"), (4, "zone " * 100_000 + mail, "x")]
    got = sorted((r.doc_id or 0, r.start) for r in pii.private_data(spark.createDataFrame(data, "doc_id bigint, text string, label string")).collect())
    at = [9, 22]
    assert got == [(0, a) for a in at] + sorted([(1, a) for a in at] * 2) + [(4, 500_000 + a) for a in at]


def test_join(docs, empty):
    got = sorted((r.doc_id, r.group_id, r.links) for r in ngram_join.similar_groups(docs).collect())
    assert got == [(3, 3, 0), (31, 3, 0)]
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert sorted((r.doc_id, r.group_id) for r in ngram_join.similar_groups(named).collect()) == [("d3", "d3"), ("d31", "d3")]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows()) - 2
    assert ngram_join.similar_groups(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0
    again = docs.union(docs)
    assert ngram_join.one_of_each(again).filter("doc_id IS NOT NULL").count() == kept.filter("doc_id IS NOT NULL").count()


def test_mixing(docs, empty):
    got = mixing.mix(docs, weights={"src0": 1.0, "src1": 1.0, "nowhere": 1.0}, total=300)
    assert got.columns == docs.columns and {r.source for r in got.select("source").distinct().collect()} <= {"src0", "src1"}
    assert mixing.mixture(docs).count() > 0 and mixing.mixture(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    tokens = sum(len((r[1] or "").split()) for r in rows())
    assert sum(r.length for r in got) == tokens and packing.pack(empty).count() == 0
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin, r.capacity), []).append((r.position, r.length))
    assert all(packing.check_bins(v, k[2]) for k, v in bins.items())


def test_pipeline_stages(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for source in (docs, empty):
        now = source.select("doc_id", "text", "lang", "source", "n_chars")
        columns = now.columns
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            where = str(tmp_path / f"{source is docs}-{n}")
            out.write.parquet(where)
            now = spark.read.parquet(where)
            if n + 1 < len(corpus_pipeline.STAGES):
                assert now.columns == columns
        assert (now.count() > 0) == (source is docs)
