"""The parts around the operators: contexts, assets, specs and domains, tracked objects, files and encodings."""

import gzip
import glob

import pandas as pd
import pytest
from pyspark.sql import functions as F

import lodestone.api as api
from lodestone.functions import columns as C
from lodestone.operators import analyzers as A
from lodestone.operators import mappers as M
from lodestone.operators.vocabulary import vocabulary
from lodestone.plans.tables import Context, shared_dir
from lodestone.sources import formats


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("a", 1.0, [1.0, 10.0]), ("b", 2.0, [3.0, 30.0]), ("a", 3.0, [5.0, 20.0])], "k string, v double, w array<double>")


def test_context_nests(spark, people, tmp_path):
    with Context(work_dir=str(tmp_path / "outer"), passthrough=["k"]):
        assert shared_dir(spark) == str(tmp_path / "outer")
        with Context(work_dir=str(tmp_path / "inner")):
            assert shared_dir(spark) == str(tmp_path / "inner") and Context.current().passthrough == ("k",)
        found = api.analyze(people, lambda x: {"z": x["v"] - A.min(x["v"])})
        assert found.input_schema.fieldNames() == ["v", "w"]
        assert sorted(map(tuple, found.apply(people).collect())) == [("a", 0.0), ("a", 2.0), ("b", 1.0)]
    assert shared_dir(spark) != str(tmp_path / "outer")


def test_save_and_load(spark, people, tmp_path):
    note = tmp_path / "note.txt"
    note.write_text("hello")

    def fn(x):
        M.annotate_asset("a/note", str(note))
        return {
            "i": M.compute_and_apply_vocabulary(x["k"], vocab_filename="a/b", default_value=-1), "j": M.compute_and_apply_vocabulary(x["k"], vocab_filename="a_b", file_format="text_gzip", top_k=1),
            "b": M.bucketize(x["v"], 3), "s": M.annotate_shape(x["w"], [2]), "n": M.num_buckets_of(M.bucketize(x["v"], 2)),
        }

    found = api.analyze(people, fn)
    path = str(tmp_path / "saved")
    found.save(spark, path)
    with pytest.raises(FileExistsError):
        found.save(spark, path)
    again = api.Frozen.load(spark, path)
    assert again.apply(people).collect() == found.apply(people).collect()
    assert again.vocabulary_by_name("a/b") == ["a", "b"] and again.vocabulary_by_name("a_b") == ["a"]
    assert again.vocabulary_file_by_name("a/b") != again.vocabulary_file_by_name("a_b")
    (part,) = glob.glob(again.vocabulary_file_by_name("a_b") + "/part-*")
    assert gzip.open(part, "rt").read() == "a\n"
    assert open(again.asset("a/note")).read() == "hello"
    domains = again.output_domains(spark)
    assert (domains["i"].low, domains["i"].high) == (-1, 1) and (domains["b"].low, domains["b"].high) == (0, 2) and "s" not in domains
    assert again.output_specs(spark)["i"].dtype == "int64" and again.input_specs()["v"].dtype == "float32"
    assert again.output_schema(spark)["s"].metadata["shape"] == [2]
    assert again.apply(people).first()["n"] == 2
    api.remove(spark, path)


def test_per_key_by_position(people):
    def fn(x):
        return {"u": M.scale_to_0_1_per_key(x["w"], x["k"], elementwise=True), "z": M.scale_to_z_score_per_key(x["w"], x["k"], elementwise=True, output_dtype="double"), "v": x["v"]}

    found = api.analyze(people, fn)
    assert len(found.values) == 2
    got = {r.v: (list(r.u), list(r.z)) for r in found.apply(people).collect()}
    assert got[1.0] == ([0.0, 0.0], [-1.0, -1.0]) and got[3.0] == ([1.0, 1.0], [1.0, 1.0])
    assert got[2.0][0] == pytest.approx([1 / (1 + 2.718281828**-3.0), 1.0], abs=1e-5) and got[2.0][1] == [0.0, 0.0]


def test_quantiles_by_sketch(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("v"), (F.col("id") % 5).cast("double").alias("w"))
    found = api.analyze(df, lambda x: {"exact": A.quantiles(x["v"], 8), "near": A.quantiles(x["v"], 8, epsilon=0.01), "some": A.quantiles(F.when(x["v"] < 100, 3.0).otherwise(x["v"]), 4)})
    r = found.apply(df.limit(1)).first()
    assert r["exact"] == [2500.0 * k for k in range(1, 8)] and r["some"] == [5000.0, 10000.0, 15000.0]
    assert all(abs(a - b) <= 0.01 * 20_000 for a, b in zip(r["near"], r["exact"]))


def test_count_threshold(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 1), ("b", 1), ("c", 0)], "k string, y int")
    got = {}

    def fn(x):
        got["n"] = vocabulary(x["k"], count_threshold=2)
        got["mi"] = vocabulary(x["k"], labels=x["y"], count_threshold=2, min_diff_from_avg=0.0)
        return {"one": F.lit(1)}

    api.analyze(df, fn)
    assert {r.token for r in got["n"].table.collect()} == {r.token for r in got["mi"].table.collect()} == {"a", "b"}
    assert got["n"].unfiltered_size == 3


def test_tracked_objects_and_models(people):
    made = []
    table = M.make_and_track(lambda: made.append(1) or {"a": 1.0, "b": 2.0}, "table")
    assert table.get() is table.get() and made == [1]
    four = M.apply_model  # any number of columns
    found = api.analyze(people, lambda x: {"y": four(lambda: 10.0, lambda m, a, b, c, d: m + a + b + c + d, "double", x["v"], x["v"], x["v"], x["v"])})
    assert sorted(r.y for r in found.apply(people).collect()) == [14.0, 18.0, 22.0]


def test_folder_for_custom_analyzers(spark, people):
    def analyze(df, folder):
        df.write.parquet(f"{folder}/kept")
        return df.sparkSession.read.parquet(f"{folder}/kept").agg(F.sum("c0"))

    def fn(x):
        v = A.custom_in_folder([x["v"]], analyze)
        return {"t": v[0] if isinstance(v, tuple) else v}

    assert api.analyze(people, fn).apply(people).first()[0] == 6.0


def test_csv_lines(spark):
    df = spark.createDataFrame([(' a "q" ', 1, [1, 2]), ("x,y", None, []), ("two\nlines", 3, None), ("", 4, [5])], "s string, n int, l array<int>")
    assert [r.value for r in formats.encode_csv(df).collect()] == ['" a ""q"" ",1,1|2', '"x,y",,', '"two\nlines",3,', ",4,5"]


def test_nested_records(spark):
    df = spark.createDataFrame([([[1, 2], [], [3]], "a", [0.5])], "r array<array<bigint>>, s string, `v.w` array<float>")
    flat = formats.flat_features(df)
    assert flat.columns == ["r$row_lengths_1", "r", "s", "v.w"] and list(flat.first()) == [[2, 0, 1], [1, 2, 3], "a", [0.5]]
    value = bytes(formats.encode_examples(df).first().value)
    assert value == formats.example_bytes({"r": [1, 2, 3], "r$row_lengths_1": [2, 0, 1], "s": ["a"], "v.w": [0.5]})


def test_row_expressions(spark):
    df = spark.createDataFrame([(["a", "b", "a"], [3, 3, 7, 3], [None, 5, None, 6]), ([], [], []), (None, None, None)], "t array<string>, s array<int>, g array<int>")
    got = df.select(C.bag_of_words(F.col("t"), (1, 2)).alias("bag"), C.segment_indices(F.col("s")).alias("at"), C.left_align(F.col("g")).alias("left")).collect()
    assert got[0].bag == ["a", "a b", "b", "b a"] and got[0]["at"] == [0, 1, 0, 0] and got[0].left == [5, 6]
    assert got[1].bag == [] and got[1]["at"] == [] and got[1].left == []
    dense = df.limit(1).select(C.dense_from_sparse(F.array(F.lit(3).cast("bigint"), F.lit(0).cast("bigint")), F.array(F.lit("x"), F.lit("y")), 5, "-").alias("d")).first().d
    assert dense == ["y", "-", "-", "x", "-"]


def test_hashed_strings(spark):
    df = spark.range(4000).select(F.concat(F.lit("u"), "id").alias("s"))
    got = df.select("s", C.hash_strings(F.col("s"), 16).alias("a"), C.hash_strings(F.col("s"), 16, [7, 11]).alias("b"), C.hash_strings(F.lit(None).cast("string"), 16).alias("n")).collect()
    counts = pd.Series([r.a for r in got]).value_counts()
    assert set(counts.index) == set(range(16)) and counts.min() > 150 and all(r.n is None for r in got)
    assert 0.02 < sum(r.a == r.b for r in got) / 4000 < 0.12  # keyed buckets are others
    assert [r.a for r in got] == [r.a for r in df.select(C.hash_strings(F.col("s"), 16).alias("a")).collect()]


def test_formats_round_trip(spark, people, tmp_path):
    for kind in ("parquet", "orc", "json"):
        formats.write(people, str(tmp_path / kind), kind)
        assert sorted(formats.read(spark, str(tmp_path / kind), kind, people.schema).collect()) == sorted(people.collect())
