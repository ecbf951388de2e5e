"""Analyzers: values that need a full pass over the data.

Nulls are missing. NaN is ignored by min, max, mean, var and quantiles, and
infinities by mean and var; sum and size count everything that isn't null. Arrays are
reduced over all their elements, or with elementwise=True by position.
"""

from __future__ import annotations

import builtins
import math
import uuid
from collections.abc import Callable, Sequence
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from ..plans.tables import shared_dir, written
from ..plans.trace import PENDING, RowState, TableState, Trace

builtins_max, builtins_min = builtins.max, builtins.min  # this module has its own
_FLOATS = (T.FloatType, T.DoubleType)
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _is_array(t: T.DataType | None) -> bool:
    return isinstance(t, T.ArrayType)


def _element(t: T.DataType) -> T.DataType:
    while isinstance(t, T.ArrayType):
        t = t.elementType
    return t


def literal(value: Any, t: T.DataType | str | None = None) -> Column:
    if isinstance(value, (list, tuple, np.ndarray)):
        items = [literal(v) for v in value]
        c = F.array(*items) if items else F.array()
    else:
        c = F.lit(value)
    return c.cast(t) if t is not None else c


def exploded(df: DataFrame, columns: Sequence[Column], names: Sequence[str], with_position: bool = False) -> DataFrame:
    """Columns as scalars, those that are arrays exploded together; pos is the place in the outermost array."""
    df = df.select(*[c.alias(n) for c, n in zip(columns, names)])
    level = 0
    while any(_is_array(df.schema[n].dataType) for n in names):
        arrays = [n for n in names if _is_array(df.schema[n].dataType)]
        rest = [c for c in df.columns if c not in arrays]
        zipped = F.arrays_zip(*[F.col(n) for n in arrays])
        if with_position and level == 0:
            df = df.select(*rest, F.posexplode(zipped).alias("pos", "z"))
        else:
            df = df.select(*rest, F.explode(zipped).alias("z"))
        keep = [c for c in df.columns if c != "z"]
        df = df.select(*keep, *[F.col("z").getField(n).alias(n) for n in arrays])
        level += 1
    return df


def _by_position(aggs: dict[str, Column], merges: dict[str, Callable[[str], Column]], x: Column, finish: Callable[[dict], Any]) -> TableState:
    """A state for each position of an array; aggs are over the column x."""

    def close(parts: DataFrame) -> list:
        rows = parts.groupBy("pos").agg(*[merges[n](n).alias(n) for n in aggs]).orderBy("pos").collect()  # one row for each position
        return [finish({n: r[n] for n in aggs}) for r in rows]

    return TableState(lambda df: exploded(df, [x], ["x"], True).groupBy("pos").agg(*[a.alias(n) for n, a in aggs.items()]), close)


def _reduce(kind: str, x: Column, elementwise: bool, aggs: Callable[[Column], dict[str, Column]], merges: dict, finish: Callable[[dict], Any], name: str | None) -> Any:
    t = Trace.current()
    kind_type = t.dtype(x)

    def state():
        if not _is_array(kind_type):
            return RowState(aggs(x), merges, finish)
        if elementwise:
            return _by_position(aggs(F.col("x")), merges, x, finish)
        own = aggs(F.col("x"))

        def close(parts: DataFrame) -> Any:
            row = parts.agg(*[merges[n](n).alias(n) for n in own]).first()
            return finish({n: row[n] for n in own})

        return TableState(lambda df: exploded(df, [x], ["x"]).agg(*[a.alias(n) for n, a in own.items()]), close)

    return t.request(kind, [x], state, {"elementwise": elementwise}, name)


def _out(value: Any, t: T.DataType | str | None = None) -> Column:
    if value is PENDING:
        return Trace.current().placeholder()
    if isinstance(value, list):
        return literal(value, T.ArrayType(t) if isinstance(t, T.DataType) else f"array<{t}>" if t else None)
    return literal(value, t)


def _element_type(x: Column) -> T.DataType:
    t = Trace.current().dtype(x)
    return _element(t) if t is not None else T.DoubleType()


def _extremes(x: Column, elementwise: bool, name: str | None) -> Any:
    kind = _element_type(x)
    real = isinstance(kind, _FLOATS)
    top = math.inf if real else 2 ** (_BITS.get(kind.simpleString(), 64) - 1) - 1
    keep = (lambda c: F.when(~F.isnan(c), c)) if real else (lambda c: c)
    return _reduce(
        "min_and_max", x, elementwise,
        lambda c: {"low": F.min(keep(c)), "high": F.max(keep(c))},
        {"low": F.min, "high": F.max},
        lambda r: (top if r["low"] is None else r["low"], -top if r["high"] is None else r["high"]),
        name,
    )


def _pair(value: Any, i: int) -> Any:
    if value is PENDING:
        return PENDING
    return [v[i] for v in value] if isinstance(value, list) else value[i]


def min_and_max(x: Column, elementwise: bool = False, name: str | None = None) -> tuple[Column, Column]:
    """Least and largest value. Without values: the type's largest and its negative (infinities for floats)."""
    kind, value = _element_type(x), _extremes(x, elementwise, name)
    return _out(_pair(value, 0), kind), _out(_pair(value, 1), kind)


def min(x: Column, elementwise: bool = False, name: str | None = None) -> Column:  # noqa: A001
    return min_and_max(x, elementwise, name)[0]


def max(x: Column, elementwise: bool = False, name: str | None = None) -> Column:  # noqa: A001
    return min_and_max(x, elementwise, name)[1]


def sum(x: Column, elementwise: bool = False, name: str | None = None) -> Column:  # noqa: A001
    """Sum, widened for integers; 0 without values."""
    kind = _element_type(x)
    real = isinstance(kind, _FLOATS)
    value = _reduce("sum", x, elementwise, lambda c: {"s": F.sum(c)}, {"s": F.sum}, lambda r: r["s"] if r["s"] is not None else (0.0 if real else 0), name)
    return _out(value, kind if real else T.LongType())


def size(x: Column, elementwise: bool = False, name: str | None = None) -> Column:
    """Number of values that aren't null."""
    return _out(_reduce("size", x, elementwise, lambda c: {"n": F.count(c)}, {"n": F.sum}, lambda r: r["n"] or 0, name), "bigint")


def _moments(c: Column) -> dict[str, Column]:
    v = F.when(is_finite(c), c.cast("double"))
    return {"n": F.count(v), "mean": F.coalesce(F.avg(v), F.lit(0.0)), "m2": F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)), "s": F.coalesce(F.sum(v), F.lit(0.0))}


def _merge_moments(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Partial (n, mean, m2, s) rows of each key as one, by the pairwise formula."""
    total = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0))
    spread = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - mean) * (p["mean"] - mean))
    return total.select(*keys, "n", mean.alias("mean"), F.when(F.col("n") > 0, spread / F.col("n")).otherwise(F.lit(0.0)).alias("var"))


def _mean_and_var(x: Column, elementwise: bool, name: str | None) -> Any:
    t = Trace.current()
    keys = ["pos"] if elementwise else []
    array = _is_array(t.dtype(x))

    def accumulate(df: DataFrame) -> DataFrame:
        return exploded(df, [x], ["x"], elementwise).groupBy(*keys).agg(*[a.alias(n) for n, a in _moments(F.col("x")).items()])

    def finish(parts: DataFrame) -> Any:
        merged = _merge_moments(parts, keys)
        rows = [(r["mean"], r["var"]) for r in (merged.orderBy(*keys) if keys else merged).collect()]  # one row for each position
        return rows if elementwise else rows[0] if rows else (0.0, 0.0)

    def state():
        if array:
            return TableState(accumulate, finish)

        def combine(parts: DataFrame) -> dict[str, Any]:
            r = _merge_moments(parts).first()
            return {"n": r["n"], "mean": r["mean"], "m2": r["var"] * r["n"]}

        return RowState(_moments(x), {}, lambda r: (r["mean"], r["m2"] / r["n"] if r["n"] else 0.0), combine)

    return t.request("mean_and_var", [x], state, {"elementwise": elementwise}, name)


def _stat_type(x: Column, output_dtype: str | None) -> str:
    return output_dtype or ("double" if isinstance(_element_type(x), T.DoubleType) else "float")


def mean_and_var(x: Column, elementwise: bool = False, output_dtype: str | None = None, name: str | None = None) -> tuple[Column, Column]:
    kind, value = _stat_type(x, output_dtype), _mean_and_var(x, elementwise, name)
    return _out(_pair(value, 0), kind), _out(_pair(value, 1), kind)


def mean(x: Column, elementwise: bool = False, output_dtype: str | None = None, name: str | None = None) -> Column:
    """Mean of the finite values; 0 without any."""
    return mean_and_var(x, elementwise, output_dtype, name)[0]


def var(x: Column, elementwise: bool = False, output_dtype: str | None = None, name: str | None = None) -> Column:
    """Variance of the finite values, divided by their number; 0 without any."""
    return mean_and_var(x, elementwise, output_dtype, name)[1]


def per_key(kind: str, x: Column, key: Column, aggs: Callable[[Column], dict[str, Column]], merge: Callable[[DataFrame, list[str]], DataFrame], name: str | None = None, elementwise: bool = False) -> Any:
    """A table (key, ...) of aggregates by key; elementwise each is an array by position, found in one pass."""
    t = Trace.current()
    elementwise = elementwise and _is_array(t.dtype(x))
    keys = ["key", "pos"] if elementwise else ["key"]

    def accumulate(df: DataFrame) -> DataFrame:
        flat = exploded(df, [x, key], ["x", "key"], elementwise).filter(F.col("key").isNotNull())
        return flat.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs(F.col("x")).items()])

    def finish(parts: DataFrame) -> DataFrame:
        merged = merge(parts, keys)
        if elementwise:  # as many rows for a key as its arrays are long
            values = [c for c in merged.columns if c not in keys]
            rows = merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", *values))).alias("z"))
            merged = rows.select("key", *[F.col("z")[v].alias(v) for v in values])
        return written(merged, "per-key")

    return t.request(kind, [x, key], lambda: TableState(accumulate, finish), {"elementwise": elementwise}, name)


def min_and_max_per_key(x: Column, key: Column, name: str | None = None, elementwise: bool = False) -> Any:
    """Table (key, low, high)."""
    merge = lambda p, keys: p.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    clean = lambda c: F.when(~F.isnan(c.cast("double")), c)
    return per_key("min_and_max_per_key", x, key, lambda c: {"low": F.min(clean(c)), "high": F.max(clean(c))}, merge, name, elementwise)


def mean_and_var_per_key(x: Column, key: Column, name: str | None = None, elementwise: bool = False) -> Any:
    """Table (key, n, mean, var)."""
    return per_key("mean_and_var_per_key", x, key, _moments, _merge_moments, name, elementwise)


def count_per_key(key: Column, name: str | None = None) -> Any:
    """Table (key, count); lists of it are sorted by the key's bytes."""
    t = Trace.current()
    acc = lambda df: exploded(df, [key], ["key"]).filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("count"))
    return t.request("count_per_key", [key], lambda: TableState(acc, lambda p: written(p.groupBy("key").agg(F.sum("count").alias("count")), "counts")), None, name)


def sorted_counts(table: DataFrame) -> tuple[list, list]:
    rows = table.orderBy(F.col("key").cast("string")).collect()
    return [r["key"] for r in rows], [r["count"] for r in rows]


# -- order statistics -------------------------------------------------------


def value_weights(df: DataFrame, x: Column, weights: Column | None, groups: Sequence[tuple[str, Column]] = (), elementwise: bool = False) -> DataFrame:
    """(groups..., v, w, c): distinct values with their weight and count, without null and NaN."""
    names = [g for g, _ in groups]
    flat = exploded(df, [x, weights if weights is not None else F.lit(1.0), *[c for _, c in groups]], ["v", "w", *names], elementwise)
    keys = names + (["pos"] if elementwise else [])
    flat = flat.withColumn("v", F.col("v").cast("double")).filter("v IS NOT NULL AND NOT isnan(v)")
    return flat.groupBy(*keys, "v").agg(F.sum(F.col("w").cast("double")).alias("w"), F.count("*").alias("c"))


def ranked(values: DataFrame) -> DataFrame:
    """(v, w, c, below_w, below_c) over one group of distinct values, without a single-task window.

    Values are range-partitioned and written with their partition's number;
    the totals of the partitions, one row each, give the offsets.
    """
    parts = written(values.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()), "ranked")
    sums = parts.groupBy("part").agg(F.sum("w").alias("w"), F.sum("c").alias("c")).orderBy("part").collect()
    offsets, w, c = [], 0.0, 0
    for r in sums:
        offsets.append((r["part"], w, c))
        w, c = w + r["w"], c + r["c"]
    table = values.sparkSession.createDataFrame(offsets or [(0, 0.0, 0)], "part int, off_w double, off_c bigint")
    before = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("bw", F.coalesce(F.sum("w").over(before), F.lit(0.0))).withColumn("bc", F.coalesce(F.sum("c").over(before), F.lit(0)))
    return own.join(F.broadcast(table), "part").select("v", "w", "c", (F.col("bw") + F.col("off_w")).alias("below_w"), (F.col("bc") + F.col("off_c")).alias("below_c"))


def _cuts(num_buckets: int, total: Column) -> list[Column]:
    """Boundary k: the least value whose cumulative weight exceeds total * k / num_buckets, else the largest."""
    return [
        F.coalesce(F.min(F.when(F.col("below_w") + F.col("w") > total * k / num_buckets + total * 1e-12, F.col("v"))), F.max("v")).cast("float").cast("double").alias(f"q{k}")
        for k in range(1, num_buckets)
    ]


#: Cells between the marks of a sketch of the data, by whose exact totals a quantile is found.
CELLS = 128


def _cell(marks: Sequence[float], first: int = 0) -> Column:
    """Number of the cell of v among sorted marks, by halving: v in cell i is at least mark i - 1 and less than mark i."""
    if not marks:
        return F.lit(first)
    mid = len(marks) // 2
    return F.when(F.col("v") < F.lit(marks[mid]), _cell(marks[:mid], first)).otherwise(_cell(marks[mid + 1 :], first + mid + 1))


def located_quantiles(flat: DataFrame, num_buckets: int) -> list[float]:
    """Exact boundaries of (v, w) without sorting all values: a mergeable sketch sets marks, totals between marks tell the cells of the boundaries, and only what is in these is sorted."""
    ranks = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    row = flat.agg(F.kll_sketch_agg_double("v", F.lit(1024)).alias("s"), F.count("v").alias("n")).select(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", ranks)).alias("q")).first()
    if row["q"] is None:
        return [0.0] * (num_buckets - 1)
    marks = sorted(set(row["q"]))
    celled = flat.withColumn("cell", _cell(marks))
    totals = {r["cell"]: r["w"] for r in celled.groupBy("cell").agg(F.sum("w").alias("w")).collect()}  # one row for each cell
    total = float(np.sum(list(totals.values())))
    if not total:
        return [0.0] * (num_buckets - 1)
    start, at, wanted = {}, 0.0, {}
    for cell in sorted(totals):
        start[cell], at = at, at + totals[cell]
        for k in range(1, num_buckets):
            if k not in wanted and at > total * k / num_buckets + total * 1e-12:
                wanted[k] = cell
    last = builtins_max(totals)
    wanted = {k: wanted.get(k, last) for k in range(1, num_buckets)}
    inside = celled.filter(F.col("cell").isin(sorted(set(wanted.values()))))
    table = ranked(inside.groupBy("v").agg(F.sum("w").alias("w"), F.count("*").alias("c")))
    before, own = 0.0, {}
    for cell in sorted(set(wanted.values())):
        own[cell], before = start[cell] - before, before + totals[cell]  # weight that is left out below the cell
    table = table.withColumn("cell", _cell(marks))
    cuts = []
    for k, cell in wanted.items():
        above = F.col("below_w") + F.lit(own[cell]) + F.col("w") > total * k / num_buckets + total * 1e-12
        here = F.col("cell") == cell
        cuts.append(F.coalesce(F.min(F.when(here & above, F.col("v"))), F.max(F.when(here, F.col("v")))).cast("float").cast("double").alias(f"q{k}"))
    row = table.agg(*cuts).first()
    return [row[f"q{k}"] for k in range(1, num_buckets)]


def sketch_size(epsilon: float) -> int:
    """Size of a sketch whose ranks are off by at most about epsilon."""
    return int(builtins_min(65535, builtins_max(8, math.ceil((2.296 / epsilon) ** (1 / 0.9021)))))


def _sketched(x: Column, num_buckets: int, epsilon: float) -> TableState:
    """Boundaries within epsilon of their rank, from sketches that merge."""
    ranks = F.array(*[F.lit(k / num_buckets) for k in range(1, num_buckets)])
    size = F.lit(sketch_size(epsilon))

    def accumulate(df: DataFrame) -> DataFrame:
        flat = exploded(df, [x], ["v"]).select(F.col("v").cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
        return flat.agg(F.kll_sketch_agg_double("v", size).alias("s"), F.count("v").alias("n")).filter("n > 0")

    def finish(parts: DataFrame) -> list[float]:
        got = parts.agg(F.kll_merge_agg_double("s").alias("s"), F.sum("n").alias("n")).select(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", ranks)).alias("q")).first()["q"]
        return [float(np.float32(v)) for v in got] if got else [0.0] * (num_buckets - 1)

    return TableState(accumulate, finish)


def _merge_weights(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys, "v").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))


def quantile_list(x: Column, num_buckets: int, weights: Column | None = None, elementwise: bool = False, name: str | None = None, epsilon: float | None = None) -> Any:
    """Interior boundaries as a list (of lists by position); all 0 without data."""
    if num_buckets < 1:
        raise ValueError("num_buckets must be positive")
    if epsilon is not None and not 0 < epsilon < 1:
        raise ValueError("epsilon must be between 0 and 1")
    t = Trace.current()
    names = [f"q{k}" for k in range(1, num_buckets)]

    def finish(parts: DataFrame) -> Any:
        if not names:
            return []
        if elementwise:
            rows = per_group_quantiles(_merge_weights(parts, ["pos"]), ["pos"], num_buckets).orderBy("pos").collect()
            return [list(r["bounds"]) for r in rows]
        table = ranked(_merge_weights(parts, []))
        total = table.agg(F.sum("w")).first()[0]
        if not total:
            return [0.0] * len(names)
        row = table.agg(*_cuts(num_buckets, F.lit(float(total)))).first()
        return [row[n] for n in names]

    def direct(df: DataFrame) -> Any:
        flat = exploded(df, [x, weights if weights is not None else F.lit(1.0)], ["v", "w"]).select(F.col("v").cast("double").alias("v"), F.col("w").cast("double").alias("w"))
        return located_quantiles(flat.filter("v IS NOT NULL AND NOT isnan(v)"), num_buckets)

    def state() -> TableState:
        if epsilon is not None and weights is None and not elementwise and names:
            return _sketched(x, num_buckets, epsilon)
        return TableState(lambda df: value_weights(df, x, weights, (), elementwise), finish, None if elementwise or not names else direct)

    columns = [x] + ([weights] if weights is not None else [])
    return t.request("quantiles", columns, state, {"B": num_buckets, "elementwise": elementwise, "epsilon": epsilon}, name)


def quantiles(x: Column, num_buckets: int, epsilon: float | None = None, weights: Column | None = None, elementwise: bool = False, name: str | None = None) -> Column:
    """num_buckets - 1 boundaries as an array.

    Without epsilon they are exact: one scan sketches the data, one totals the
    cells between the sketch's marks, and only cells with a boundary are sorted.
    With epsilon one scan makes a mergeable sketch, and each boundary's rank is
    off by about epsilon of the rows at most; with weights or elementwise they
    are exact all the same.
    """
    return _out(quantile_list(x, num_buckets, weights, elementwise, name, epsilon), "array<double>" if elementwise else "double")


def per_group_quantiles(values: DataFrame, keys: Sequence[str], num_buckets: int) -> DataFrame:
    """(keys..., bounds) from distinct values by group.

    Groups are range-partitioned together with their values, so that a large one
    takes several tasks; the weights of a group's parts, one row each, give the
    offsets.
    """
    parts = written(values.repartitionByRange(*keys, "v").select(*keys, "v", "w", F.spark_partition_id().alias("part")), "group-values")
    whole, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "part").agg(F.sum("w").alias("part_w"))
    sums = sums.select(*keys, "part", F.coalesce(F.sum("part_w").over(up), F.lit(0.0)).alias("off"), F.sum("part_w").over(whole).alias("total"))
    before = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("below", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = own.join(sums, [*keys, "part"]).withColumn("upto", F.col("below") + F.col("off") + F.col("w"))
    cuts = [
        F.coalesce(F.min(F.when(F.col("upto") > F.col("total") * k / num_buckets + F.col("total") * 1e-12, F.col("v"))), F.max("v")).cast("float").cast("double")
        for k in range(1, num_buckets)
    ]
    return rows.groupBy(*keys).agg((F.array(*cuts) if cuts else F.array().cast("array<double>")).alias("bounds"))


def quantiles_per_key(x: Column, key: Column, num_buckets: int, weights: Column | None = None, name: str | None = None) -> Any:
    """Table (key, bounds)."""
    t = Trace.current()
    acc = lambda df: value_weights(df, x, weights, [("key", key)]).filter("key IS NOT NULL")
    done = lambda p: written(per_group_quantiles(_merge_weights(p, ["key"]), ["key"], num_buckets), "key-quantiles")
    columns = [x, key] + ([weights] if weights is not None else [])
    return t.request("quantiles_per_key", columns, lambda: TableState(acc, done), {"B": num_buckets}, name)


def histogram(x: Column, boundaries: int | Sequence[float] | None = None, categorical: bool = False, name: str | None = None) -> tuple[Column, Column]:
    """(counts, boundaries); values outside fall into the end bins.

    boundaries: a list, or a number of points from min to max; by default ten bins over
    [0, 1]. categorical: counts of values, sorted as strings.
    """
    t = Trace.current()
    if categorical:
        table = count_per_key(x, name)
        if table is PENDING:
            return t.placeholder(), t.placeholder()
        keys, counts = sorted_counts(table)
        return _out(counts, "bigint"), literal(keys) if keys else F.array().cast("array<string>")
    if boundaries is None:
        boundaries = 11
        low_high: Any = (0.0, 1.0)
    elif isinstance(boundaries, int):
        low_high = _extremes(x, False, None)
        if low_high is PENDING:
            return t.placeholder(), t.placeholder()
    if isinstance(boundaries, int):
        boundaries = np.linspace(float(low_high[0]), float(low_high[1]), boundaries).tolist()
    edges = [float(b) for b in boundaries]
    inner = [float(np.float32(np.float32(b) - np.float32(0.0001))) for b in edges[1:-1]]
    place = F.size(F.filter(literal(inner, "array<double>"), lambda b: b < F.col("v").cast("double"))) if inner else F.lit(0)

    def finish(parts: DataFrame) -> list[int]:
        got = {r["bin"]: r["n"] for r in parts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # one row for each bin
        return [got.get(i, 0) for i in range(len(edges) - 1)]

    acc = lambda df: exploded(df, [x], ["v"]).filter("v IS NOT NULL").groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    counts = t.request("histogram", [x], lambda: TableState(acc, finish), edges, name)
    return _out(counts, "bigint"), literal(edges, "array<double>")


# -- linear algebra and shape ------------------------------------------------


def _gram(df: DataFrame, x: Column) -> DataFrame:
    """One row for each partition's vectors: their number, sums, and products of their distances from their own mean."""

    def run(frames):
        n, mean, p = 0, None, None
        for pdf in frames:
            rows = [v for v in pdf["x"] if v is not None and len(v)]
            if rows:
                m = np.stack(rows).astype(float)
                k, own = len(m), m.mean(axis=0)
                d = m - own
                q = d.T @ d
                if n:
                    away = own - mean
                    q += p + np.outer(away, away) * (n * k / (n + k))
                    own = mean + away * (k / (n + k))
                n, mean, p = n + k, own, q
        if n:
            yield pd.DataFrame({"n": [n], "s": [mean * n], "p": [p.ravel()]})

    return df.select(x.cast("array<double>").alias("x")).mapInPandas(run, "n bigint, s array<double>, p array<double>")


def _covariance(x: Column, name: str | None, kind: str) -> Any:
    def finish(parts: DataFrame) -> list[list[float]]:
        sums = parts.select("n", F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()  # one row for each dimension
        if not sums:
            return []
        n, mean = sums[0]["n"], np.array([r["v"] for r in sums]) / sums[0]["n"]

        def about_mean(frames):
            for pdf in frames:
                for k, s, p in zip(pdf["n"], pdf["s"], pdf["p"]):
                    d = np.asarray(s) / k - mean
                    yield pd.DataFrame({"p": [np.asarray(p) + (np.outer(d, d) * k).ravel()]})

        moved = parts.mapInPandas(about_mean, "p array<double>").select(F.posexplode("p").alias("i", "v"))
        rows = moved.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # one row for each cell
        return (np.array([r["v"] for r in rows]) / n).reshape(len(mean), len(mean)).tolist()

    return Trace.current().request(kind, [x], lambda: TableState(lambda df: written(_gram(df, x), "gram"), finish), None, name)


def covariance(x: Column, dtype: str = "float", name: str | None = None) -> Column:
    """Covariance matrix of a vector column, divided by n; empty without data."""
    return _out(_covariance(x, name, "covariance"), f"array<{dtype}>")


def pca(x: Column, output_dim: int, dtype: str = "float", name: str | None = None) -> Column:
    """(d, output_dim) matrix of eigenvectors by decreasing eigenvalue.

    The sign makes each vector's largest component positive. Without data it is
    empty.
    """
    value = _covariance(x, name, "pca")
    if value is PENDING:
        return Trace.current().placeholder()
    if not value:
        return F.array().cast(f"array<array<{dtype}>>")
    return _out(principal(np.array(value), output_dim).tolist(), f"array<{dtype}>")


def principal(cov: np.ndarray, k: int) -> np.ndarray:
    _, vectors = np.linalg.eigh(cov)
    top = vectors[:, ::-1][:, :k]
    return top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])


def l_moments(x: Column, name: str | None = None) -> Any:
    """The first four L-moments and (mean, var) of the finite values, exact over the whole column."""

    def finish(parts: DataFrame) -> dict[str, float]:
        table = ranked(_merge_weights(parts, []).filter("abs(v) < double('infinity')"))
        a, b = F.col("below_c").cast("double"), (F.col("below_c") + F.col("c")).cast("double")
        p2 = lambda n: n * (n - 1) / 2
        p3 = lambda n: n * (n - 1) * (n - 2) / 3
        p4 = lambda n: n * (n - 1) * (n - 2) * (n - 3) / 4
        row = table.agg(
            F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s0"), F.sum(F.col("v") * (p2(b) - p2(a))).alias("s1"),
            F.sum(F.col("v") * (p3(b) - p3(a))).alias("s2"), F.sum(F.col("v") * (p4(b) - p4(a))).alias("s3"),
            F.sum(F.col("c") * F.col("v") * F.col("v")).alias("sq"),
        ).first()
        n = float(row["n"] or 0)
        if not n:
            return {"l1": 0.0, "l2": 0.0, "l3": 0.0, "l4": 0.0, "n": 0.0, "var": 0.0}
        b0 = row["s0"] / n
        b1 = row["s1"] / n / (n - 1) if n > 1 else 0.0
        b2 = row["s2"] / n / (n - 1) / (n - 2) if n > 2 else 0.0
        b3 = row["s3"] / n / (n - 1) / (n - 2) / (n - 3) if n > 3 else 0.0
        return {
            "l1": b0, "l2": 2 * b1 - b0 if n > 1 else 0.0, "l3": 6 * b2 - 6 * b1 + b0 if n > 2 else 0.0,
            "l4": 20 * b3 - 30 * b2 + 12 * b1 - b0 if n > 3 else 0.0, "n": n, "var": builtins_max(row["sq"] / n - b0 * b0, 0.0),
        }

    return Trace.current().request("l_moments", [x], lambda: TableState(lambda df: value_weights(df, x, None), finish), None, name)




def tukey_parameters(x: Column, name: str | None = None) -> Any:
    """dict of loc, scale, hl, hr, mean and sd of the fitted Tukey HH distribution, or PENDING."""
    from .gauss import fit_tukey

    value = l_moments(x, name)
    return PENDING if value is PENDING else fit_tukey(value)


def tukey_location(x: Column, output_dtype: str | None = None, name: str | None = None) -> Column:
    v = tukey_parameters(x, name)
    return _out(v if v is PENDING else v["loc"], _stat_type(x, output_dtype))


def tukey_scale(x: Column, output_dtype: str | None = None, name: str | None = None) -> Column:
    v = tukey_parameters(x, name)
    return _out(v if v is PENDING else v["scale"], _stat_type(x, output_dtype))


def tukey_h_params(x: Column, output_dtype: str | None = None, name: str | None = None) -> tuple[Column, Column]:
    v, kind = tukey_parameters(x, name), _stat_type(x, output_dtype)
    return _out(v if v is PENDING else v["hl"], kind), _out(v if v is PENDING else v["hr"], kind)


def custom(inputs: Sequence[Column], analyze: Callable[[DataFrame], DataFrame], name: str | None = None) -> Any:
    """A user's full-pass aggregate: analyze gets a frame of the inputs (c0, c1, ...) and returns one row; a tuple of literals, or a placeholder."""
    t = Trace.current()
    acc = lambda df: analyze(df.select(*[c.alias(f"c{i}") for i, c in enumerate(inputs)]))
    code = analyze.func if isinstance(analyze, partial) else analyze
    value = t.request("custom", list(inputs), lambda: TableState(acc, lambda p: tuple(p.first())), None, name, [code])
    return t.placeholder() if value is PENDING else tuple(literal(v) for v in value)


def custom_in_folder(inputs: Sequence[Column], analyze: Callable[[DataFrame, str], DataFrame], name: str | None = None) -> Any:
    """Like custom, for an aggregate that writes tables on the way: analyze gets a new folder too, which all executors share."""
    folder = f"{shared_dir(Trace.current().df.sparkSession)}/custom-{uuid.uuid4().hex}"
    return custom(inputs, partial(analyze, folder=folder), name)


class CacheableAnalyzer:
    """A user's mergeable aggregate: make partial rows, merge them, extract values.

    encode and decode, if given, turn a partial frame into the one that a cache
    keeps and back.
    """

    def __init__(
        self,
        make: Callable[[DataFrame], DataFrame],
        merge: Callable[[DataFrame], DataFrame],
        extract: Callable[[Any], Sequence],
        encode: Callable[[DataFrame], DataFrame] | None = None,
        decode: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.make, self.merge, self.extract = make, merge, extract
        self.encode, self.decode = encode or (lambda p: p), decode or (lambda p: p)

    def __call__(self, *inputs: Column, name: str | None = None) -> Any:
        t = Trace.current()
        acc = lambda df: self.encode(self.make(df.select(*[c.alias(f"c{i}") for i, c in enumerate(inputs)])))
        done = lambda p: tuple(self.extract(self.merge(self.decode(p)).first()))
        value = t.request("cacheable", list(inputs), lambda: TableState(acc, done), None, name, [self.make, self.merge, self.extract, self.encode, self.decode])
        return t.placeholder() if value is PENDING else tuple(literal(v) for v in value)
