"""Which input columns a preprocessing function uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, types as T

from . import trace as P


def _references(df: DataFrame, columns: list[Column], names: list[str]) -> list[str]:
    """Input columns without which one of the columns can't be resolved."""
    used = []
    for n in names:
        short = df.drop(n)
        for c in columns:
            try:
                short.select(c).schema
            except Exception:
                used.append(n)
                break
    return used


def analyze_input_columns(spark: SparkSession, schema: T.StructType, fn: Callable) -> list[str]:
    """Inputs that analyzers read, directly or through other analyzers; found on an empty table."""
    df = spark.createDataFrame([], schema)
    known, used = {}, []
    for _ in range(100):
        t, _ = P.trace(df, fn, known)
        if not t.calls:
            break
        used += [c for call in t.calls for c in call.columns]
        known |= P.compute(df, t.calls)
        known |= {k: known[twin] for k, twin in t.aliases.items()}
    return _references(df, used, schema.fieldNames())


def output_input_columns(spark: SparkSession, schema: T.StructType, fn: Callable) -> list[str]:
    """Inputs that the outputs read once the analysis is done."""
    df = spark.createDataFrame([], schema)
    known, t, out, _ = P.phases(df, fn)
    return _references(df, [*out.values(), *[look.key for look in t.lookups]], schema.fieldNames()) if not t.lookups else _through_joins(df, t, out, schema)


def _through_joins(df: DataFrame, t: P.Trace, out: dict, schema: T.StructType) -> list[str]:
    used = []
    for n in schema.fieldNames():
        try:
            P.apply(df.drop(n), t, out).schema
        except Exception:
            used.append(n)
    return used
