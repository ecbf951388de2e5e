"""analyze, apply, save and load."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, types as T

from .operators.vocabulary import Vocabulary, sanitized_name
from .plans import files
from .plans import trace as P
from .plans.cache import AnalysisCache, solver
from .plans.tables import Context
from .schema import Domain, Spec, domains_of, specs_of

Fn = Callable[[Mapping[str, Column]], Mapping[str, Column]]


class Frozen:
    """A preprocessing function with its full-pass results; applied as one projection, with joins for large lookups."""

    def __init__(self, fn: Fn, values: dict[str, Any], input_schema: T.StructType, assets: dict[str, str] | None = None):
        self.fn, self.values, self.input_schema, self.assets = fn, values, input_schema, assets or {}
        self.phases = 0

    def apply(self, df: DataFrame, passthrough: Sequence[str] = (), exclude_outputs: Sequence[str] = ()) -> DataFrame:
        """The outputs, one row for each input row; passthrough columns are carried along unseen by the function."""
        passthrough = passthrough or Context.current().passthrough or ()
        clash = set(passthrough) & set(self.input_schema.fieldNames())
        if clash:
            raise ValueError(f"passthrough columns are inputs too: {sorted(clash)}")
        hidden = df.drop(*passthrough) if passthrough else df
        t, out = P.trace(hidden, self.fn, self.values)
        if t.calls or t.pending:
            raise ValueError("the function asks for results that the analysis doesn't have")
        unknown = set(exclude_outputs) - out.keys()
        if unknown:
            raise ValueError(f"no such outputs: {sorted(unknown)}")
        return P.apply(df, t, {k: c for k, c in out.items() if k not in exclude_outputs}, passthrough)

    def _annotations(self, spark: SparkSession) -> dict[str, Any]:
        return P.trace(spark.createDataFrame([], self.input_schema), self.fn, self.values)[0].annotations

    def output_schema(self, spark: SparkSession) -> T.StructType:
        return self.apply(spark.createDataFrame([], self.input_schema)).schema

    def input_specs(self) -> dict[str, Spec]:
        return specs_of(self.input_schema)

    def output_specs(self, spark: SparkSession) -> dict[str, Spec]:
        return specs_of(self.output_schema(spark))

    def input_domains(self) -> dict[str, Domain]:
        return domains_of(self.input_schema)

    def output_domains(self, spark: SparkSession) -> dict[str, Domain]:
        """Domains of outputs that are indices or buckets as an operator returned them."""
        return domains_of(self.output_schema(spark))

    # vocabularies, buckets and assets by name
    def asset(self, name: str) -> str | None:
        return self.assets.get(name)

    def _vocabulary(self, name: str) -> Vocabulary:
        for v in self.values.values():
            if isinstance(v, Vocabulary) and v.name == name:
                return v
        raise ValueError(f"there is no vocabulary named {name}")

    def vocabulary_by_name(self, name: str) -> list[str]:
        return [r["token"] for r in self._vocabulary(name).table.orderBy("index").collect()]

    def vocabulary_size_by_name(self, name: str) -> int:
        return self._vocabulary(name).size

    def vocabulary_file_by_name(self, name: str) -> str | None:
        return self.assets.get(name)

    def num_buckets(self, spark: SparkSession, name: str) -> int:
        return self._annotations(spark)["buckets"][name]

    def save(self, spark: SparkSession, path: str) -> None:
        """Values as JSON, tables as Parquet, vocabularies also as text, assets, and the function; put in place by one rename, on any file system."""
        path = path.rstrip("/")
        if files.exists(spark, path):
            raise FileExistsError(path)
        temp = f"{path}.{uuid.uuid4().hex}"
        files.make(spark, temp)
        stored, assets, used = {}, {}, set()
        for k, (key, value) in enumerate(self.values.items()):
            if isinstance(value, Vocabulary):
                value.table.write.parquet(f"{temp}/tables/{k}")
                meta = {"size": value.size, "unfiltered_size": value.unfiltered_size, "name": value.name, "store_frequency": value.store_frequency, "file_format": value.file_format}
                stored[key] = {"vocabulary": k, **meta}
                if value.name not in assets:
                    name = unused(sanitized_name(value.name, "frequency" if value.store_frequency else "plain"), used)
                    write_vocabulary(value, f"{temp}/vocabularies/{name}")
                    assets[value.name] = f"{path}/vocabularies/{name}"
            elif isinstance(value, DataFrame):
                value.write.parquet(f"{temp}/tables/{k}")
                stored[key] = {"table": k}
            else:
                stored[key] = {"value": value, "tuple": isinstance(value, tuple)}
        for name, source in (self._annotations(spark).get("assets", {}) | {k: v for k, v in self.assets.items() if k not in assets}).items():
            safe = unused(re.sub(r"[^\w.\-]+", "_", name).strip("._") or "asset", used)
            files.copy(spark, source, f"{temp}/assets/{safe}")
            assets[name] = f"{path}/assets/{safe}"
        files.write_bytes(spark, f"{temp}/values.json", json.dumps({"values": stored, "assets": assets, "schema": json.loads(self.input_schema.json())}).encode())
        files.write_bytes(spark, f"{temp}/function.pkl", cloudpickle.dumps(self.fn))
        files.rename(spark, temp, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Frozen":
        """What save wrote. The function is unpickled: load only what you trust."""
        meta = json.loads(files.read_bytes(spark, f"{path}/values.json"))
        fn = cloudpickle.loads(files.read_bytes(spark, f"{path}/function.pkl"))
        values: dict[str, Any] = {}
        for key, v in meta["values"].items():
            if "vocabulary" in v:
                values[key] = Vocabulary(spark.read.parquet(f"{path}/tables/{v['vocabulary']}"), v["size"], v["unfiltered_size"], v["name"], v["store_frequency"], v["file_format"])
            elif "table" in v:
                values[key] = spark.read.parquet(f"{path}/tables/{v['table']}")
            else:
                values[key] = _tuples(v["value"]) if v["tuple"] else v["value"]
        return Frozen(fn, values, T.StructType.fromJson(meta["schema"]), meta["assets"])


def unused(name: str, used: set[str]) -> str:
    """A name that isn't used yet, and now is."""
    out, n = name, 1
    while out in used:
        out, n = f"{name}_{n}", n + 1
    used.add(out)
    return out


def _tuples(v: Any) -> Any:
    return tuple(v) if isinstance(v, list) else v


def write_vocabulary(v: Vocabulary, path: str) -> None:
    """One token on each line, in order; 'value token' with frequencies. One file, written by a task, not the driver; gzipped if the vocabulary asks for it."""
    from pyspark.sql import functions as F

    line = F.concat_ws(" ", F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string")), "token") if v.store_frequency else F.col("token")
    v.table.repartition(1).sortWithinPartitions("index").select(line.alias("value")).write.option("compression", "gzip" if v.file_format == "text_gzip" else "none").text(path)


def analyze(df: DataFrame, fn: Fn) -> Frozen:
    """Runs the analyzers of a preprocessing function over df, without the columns that a Context passes through."""
    df = df.drop(*(Context.current().passthrough or ()))
    values, t, out, phases = P.phases(df, fn)
    result = Frozen(fn, values, df.schema)
    result.phases = phases
    return result


def fit_apply(df: DataFrame, fn: Fn, passthrough: Sequence[str] = ()) -> tuple[DataFrame, Frozen]:
    passthrough = passthrough or Context.current().passthrough or ()
    found = analyze(df.drop(*passthrough), fn)
    return found.apply(df, passthrough), found


def analyze_with_cache(datasets: Mapping[str, DataFrame | None], fn: Fn, cache: AnalysisCache) -> Frozen:
    """Like analyze over the union of named datasets; partial results of each are read from the cache or put there.

    A dataset whose partial results are all cached may be given as None.
    """
    there = [d for d in datasets.values() if d is not None]
    if not there:
        raise ValueError("at least one dataset must be given, for its schema")
    union = there[0]
    for d in there[1:]:
        union = union.unionByName(d)
    values, t, out, phases = P.phases(union, fn, solver(datasets, cache))
    result = Frozen(fn, values, there[0].schema)
    result.phases = phases
    return result


def without_analysis(schema: T.StructType, fn: Fn, spark: SparkSession) -> Frozen:
    """A frozen function that calls no analyzer, made without reading data."""
    t, _ = P.trace(spark.createDataFrame([], schema), fn, {})
    if t.calls or t.pending:
        raise ValueError("the function calls analyzers")
    return Frozen(fn, {}, schema)


def remove(spark: SparkSession, path: str) -> None:
    files.remove(spark, path)
