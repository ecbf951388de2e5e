"""Calls that differ stay apart, within a trace and in the cache; calls that are the same meet."""

import os
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

import lodestone.api as api
from lodestone.operators import analyzers as A
from lodestone.operators import mappers as M
from lodestone.operators.vocabulary import vocabulary
from lodestone.plans import cache as C
from lodestone.plans import trace as P


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(float(v), "ab"[v % 2], v % 3) for v in range(10)], "v double, k string, y int")


def values(df, fn):
    found = api.analyze(df, fn)
    return list(found.apply(df.limit(1)).first())


def test_user_analyzers_stay_apart(numbers):
    def fn(x):
        high = A.custom([x["v"]], lambda df: df.agg(F.max("c0")))
        low = A.custom([x["v"]], lambda df: df.agg(F.min("c0")))
        return {"high": high if not isinstance(high, tuple) else high[0], "low": low if not isinstance(low, tuple) else low[0]}

    assert values(numbers, fn) == [9.0, 0.0]


def test_cacheable_analyzers_stay_apart(spark, numbers, tmp_path):
    def one(agg):
        return A.CacheableAnalyzer(lambda df: df.agg(agg("c0").alias("p")), lambda p: p.agg(agg("p")), lambda r: [r[0]])

    def fn(x):
        out = {"total": one(F.sum)(x["v"]), "high": one(F.max)(x["v"])}
        return {k: v[0] if isinstance(v, tuple) else v for k, v in out.items()}

    assert values(numbers, fn) == [45.0, 9.0]
    cache = C.AnalysisCache(spark, str(tmp_path / "c"))
    for hits in (0, 2):
        found = api.analyze_with_cache({"d": numbers}, fn, cache)
        assert list(found.apply(numbers.limit(1)).first()) == [45.0, 9.0] and cache.hits == hits


def test_encoded_accumulators(spark, numbers, tmp_path):
    mine = A.CacheableAnalyzer(
        lambda df: df.agg(F.sum("c0").alias("p")), lambda p: p.agg(F.sum("p")), lambda r: [r[0]],
        lambda p: p.select(F.col("p").cast("string").alias("text")), lambda p: p.select(F.col("text").cast("double").alias("p")),
    )

    def fn(x):
        v = mine(x["v"])
        return {"total": v[0] if isinstance(v, tuple) else v}

    cache = C.AnalysisCache(spark, str(tmp_path / "c"))
    found = api.analyze_with_cache({"a": numbers, "b": numbers}, fn, cache)
    assert found.apply(numbers.limit(1)).first()[0] == 90.0
    entry = cache.entry_keys("a")[0]
    assert spark.read.parquet(str(tmp_path / "c" / f"v{C.VERSION}" / "d-a" / entry)).columns == ["text"]


def test_python_functions_stay_apart(numbers):
    def fn(x):
        return {"plus": A.sum(M.apply_pyfunc(lambda v: v + 1, "double", x["v"])), "times": A.sum(M.apply_pyfunc(lambda v: v * 100, "double", x["v"]))}

    assert values(numbers, fn) == [55.0, 4500.0]


def test_roles_of_columns_stay_apart(numbers):
    got = {}

    def fn(x):
        got["w"] = vocabulary(x["k"], weights=x["y"])
        got["l"] = vocabulary(x["k"], labels=x["y"], min_diff_from_avg=0.0)
        got["a"] = vocabulary(x["k"], top_k=1, coverage_top_k=1, key_fn=lambda t: t)
        got["b"] = vocabulary(x["k"], top_k=1, coverage_top_k=1, key_fn=lambda t: F.lit(1))
        return {"one": F.lit(1)}

    api.analyze(numbers, fn)
    assert {r.token: r.value for r in got["w"].table.collect()} == {"a": 5.0, "b": 4.0}
    assert all(r.value < 4 for r in got["l"].table.collect())
    assert got["a"].size == 2 and got["b"].size == 1


def test_equal_calls_meet(numbers):
    t, _ = P.trace(numbers, lambda x: {"a": A.sum(x["v"] + 1), "b": A.sum(x["v"] + 1), "c": A.sum(F.transform(F.array(x["v"]), lambda e: e + 1)), "d": A.sum(F.transform(F.array(x["v"]), lambda e: e + 1))}, {})
    assert len(t.calls) == 2


def test_columns_named_like_lambda_variables(spark):
    df = spark.createDataFrame([(1.0, 5.0)], "x_1 double, x_2 double")
    assert values(df, lambda x: {"a": A.sum(x["x_1"]), "b": A.sum(x["x_2"])}) == [1.0, 5.0]


def test_cache_follows_lookups(spark, tmp_path):
    one = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    two = spark.createDataFrame([("a", 9.0), ("b", 5.0), ("b", 6.0)], "k string, v double")
    fn = lambda x: {"m": A.mean(M.scale_to_0_1_per_key(x["v"], x["k"]), output_dtype="double")}
    cache = C.AnalysisCache(spark, str(tmp_path / "c"))
    api.analyze_with_cache({"one": one}, fn, cache)
    cached = api.analyze_with_cache({"one": one, "two": two}, fn, cache).apply(one).first()[0]
    assert cached == pytest.approx(api.analyze(one.union(two), fn).apply(one).first()[0], abs=1e-6)


def test_datasets_with_like_names(spark, tmp_path):
    cache = C.AnalysisCache(spark, str(tmp_path / "c"))
    sums = {}
    for name, v in (("a b", 1.0), ("a_b", 2.0), ("a/b", 3.0), ("..", 4.0), ("a%20b", 5.0)):
        df = spark.createDataFrame([(v,)], "v double")
        sums[name] = api.analyze_with_cache({name: df}, lambda x: {"s": A.sum(x["v"])}, cache).apply(df).first()[0]
    assert list(sums.values()) == [1.0, 2.0, 3.0, 4.0, 5.0] and cache.hits == 0


def test_needed_datasets_and_lambdas_hit(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.0],), ([5.0],)], "v array<double>")
    fn = lambda x: {"s": A.sum(F.transform(x["v"], lambda e: e * 2))}
    cache = C.AnalysisCache(spark, str(tmp_path / "c"))
    calls = P.trace(df, fn, {})[0].calls
    assert C.needed_datasets(["one", "two"], calls, cache) == ["one", "two"]
    api.analyze_with_cache({"one": df}, fn, cache)
    calls = P.trace(df, fn, {})[0].calls
    assert C.needed_datasets(["one", "two"], calls, cache) == ["two"]
    api.analyze_with_cache({"one": None, "two": df}, fn, cache)
    assert (cache.hits, cache.misses) == (1, 2)


def test_signatures_hold_across_sessions():
    code = """
from pyspark.sql import SparkSession, functions as F
from lodestone.operators import analyzers as A
from lodestone.plans import trace as P
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = s.createDataFrame([(1.0, "a")], "v double, k string")
t, _ = P.trace(df, lambda x: {"a": A.mean(x["v"].cast("float") / 3), "b": A.sum(F.transform(F.array(x["v"]), lambda e: e + 1)), "q": A.custom([x["k"]], lambda d: d.agg(F.max("c0")))}, {})
print("SIGNED", [c.signature for c in t.calls])
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    runs = [subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root).stdout for _ in range(2)]
    lines = [[x for x in r.splitlines() if x.startswith("SIGNED")] for r in runs]
    assert lines[0] and lines[0] == lines[1]
