"""Mappers: analyzers whose results are applied to every row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.tables import written
from ..plans.trace import PENDING, TableState, Trace, function_id
from . import analyzers as A
from .gauss import gaussianized
from .vocabulary import Vocabulary, vocabulary

#: Entries of a vocabulary that array lookups may hold in each Python worker; a larger one is joined.
DICT_ROWS = 500_000


def _is_array(x: Column) -> bool:
    return isinstance(Trace.current().dtype(x), T.ArrayType)


def _each(x: Column, one: Callable[..., Column], *stats: Column, elementwise: bool = False) -> Column:
    """one(value, *stats) on a scalar, or on each element of an array; elementwise takes the statistics of its position."""
    if not _is_array(x):
        return one(x, *stats)
    if elementwise:
        return F.transform(x, lambda e, i: one(e, *[F.get(s, i) for s in stats]))
    return F.transform(x, lambda e: one(e, *stats))


def _min_max(v: Column, low: Column, high: Column, a: float, b: float) -> Column:
    f = v.cast("float")
    low, high = low.cast("float"), high.cast("float")
    unit = F.when(low < high, (f - low) / F.nullif(high - low, F.lit(0.0).cast("float"))).otherwise(C.sigmoid(f))
    return (unit * F.lit(float(b - a)) + F.lit(float(a))).cast("float")


def scale_by_min_max(x: Column, output_min: float = 0.0, output_max: float = 1.0, elementwise: bool = False, name: str | None = None) -> Column:
    """To [output_min, output_max]; the sigmoid of x where all values are equal or there are none."""
    if output_max <= output_min:
        raise ValueError("output_min must be less than output_max")
    low, high = A.min_and_max(x, elementwise, name)
    return _each(x, lambda v, a, b: _min_max(v, a, b, output_min, output_max), low, high, elementwise=elementwise)


def scale_to_0_1(x: Column, elementwise: bool = False, name: str | None = None) -> Column:
    return scale_by_min_max(x, 0.0, 1.0, elementwise, name)


def _keyed(table: Any, key: Column, values: Sequence[str]) -> dict[str, Column] | None:
    return None if table is PENDING else Trace.current().join(key, table, values)


def scale_by_min_max_per_key(x: Column, key: Column, output_min: float = 0.0, output_max: float = 1.0, elementwise: bool = False, name: str | None = None) -> Column:
    """By the key's extremes, or those of key and position; a key that wasn't seen has 0 and 0, so the sigmoid."""
    if output_max <= output_min:
        raise ValueError("output_min must be less than output_max")
    got = _keyed(A.min_and_max_per_key(x, key, name, elementwise), key, ["low", "high"])
    if got is None:
        return Trace.current().placeholder()
    one = lambda v, low, high: _min_max(v, F.coalesce(low.cast("double"), F.lit(0.0)), F.coalesce(high.cast("double"), F.lit(0.0)), output_min, output_max)
    return _each(x, one, got["low"], got["high"], elementwise=elementwise)


def _by_position(x: Column, one: Callable[[Column, int], Column]) -> Column:
    """A fixed-length array whose positions are treated apart."""
    t = Trace.current()
    if not isinstance(t.dtype(x), T.ArrayType):
        return one(x, 0)
    length = A._reduce("length", F.size(x), False, lambda c: {"n": F.max(c)}, {"n": F.max}, lambda r: r["n"] or 0, None)
    if length is PENDING:
        return t.placeholder()
    return F.array(*[one(F.get(x, F.lit(i)), i) for i in range(length)])


def scale_to_0_1_per_key(x: Column, key: Column, elementwise: bool = False, name: str | None = None) -> Column:
    return scale_by_min_max_per_key(x, key, 0.0, 1.0, elementwise, name)


def _z(v: Column, mean: Column, var: Column, kind: str) -> Column:
    d, sd = v.cast("double") - mean.cast("double"), F.sqrt(var.cast("double"))
    return F.when(sd > 0, d / F.nullif(sd, F.lit(0.0))).otherwise(d).cast(kind)


def scale_to_z_score(x: Column, elementwise: bool = False, output_dtype: str | None = None, name: str | None = None) -> Column:
    """(x - mean) / deviation; x - mean where the deviation is 0."""
    kind = A._stat_type(x, output_dtype)
    mean, var = A.mean_and_var(x, elementwise, "double", name)
    return _each(x, lambda v, m, s: _z(v, m, s, kind), mean, var, elementwise=elementwise)


def scale_to_z_score_per_key(x: Column, key: Column, elementwise: bool = False, output_dtype: str | None = None, name: str | None = None) -> Column:
    """By the mean and deviation of the key, or of key and position; a key that wasn't seen leaves x as it is."""
    kind = A._stat_type(x, output_dtype)
    got = _keyed(A.mean_and_var_per_key(x, key, name, elementwise), key, ["mean", "var"])
    if got is None:
        return Trace.current().placeholder()
    one = lambda v, mean, var: _z(v, F.coalesce(mean, F.lit(0.0)), F.coalesce(var, F.lit(0.0)), kind)
    return _each(x, one, got["mean"], got["var"], elementwise=elementwise)


def scale_to_gaussian(x: Column, elementwise: bool = False, output_dtype: str | None = None, name: str | None = None) -> Column:
    """A column whose tails are pulled in to those of a normal distribution, centred and scaled; elementwise each position of an array by itself."""
    if elementwise:
        return _by_position(x, lambda e, i: scale_to_gaussian(e, False, output_dtype, name and f"{name}{i}"))
    kind, value = A._stat_type(x, output_dtype), A.tukey_parameters(x, name)
    if value is PENDING:
        return Trace.current().placeholder()
    return gaussianized(x, value["loc"], value["scale"], value["hl"], value["hr"]).cast(kind)


# -- buckets -----------------------------------------------------------------


def apply_buckets(x: Column, bucket_boundaries: Column | Sequence[float]) -> Column:
    """Number of boundaries <= x, in [0, len]; NaN is in the last bucket."""
    return _each(x, lambda v: C.bucket(v, bucket_boundaries))


def apply_buckets_with_interpolation(x: Column, bucket_boundaries: Column | Sequence[float]) -> Column:
    if not isinstance(bucket_boundaries, Column) and not any(np.isfinite(b) for b in bucket_boundaries):
        raise ValueError("there must be a finite boundary")
    return _each(x, lambda v: C.interpolated(v, bucket_boundaries))


def bucketize(x: Column, num_buckets: int, epsilon: float | None = None, weights: Column | None = None, elementwise: bool = False, name: str | None = None) -> Column:
    """Bucket by quantiles, which are exact without epsilon; see quantiles()."""
    if not isinstance(num_buckets, int):
        raise TypeError(f"{num_buckets!r} buckets: a whole number is needed")
    if num_buckets < 1:
        raise ValueError("num_buckets must be positive")
    bounds = A.quantiles(x, num_buckets, epsilon, weights, elementwise, name)
    t = Trace.current()
    t.annotations.setdefault("buckets", {})[name or f"bucketize_{len(t.annotations.get('buckets', {}))}"] = num_buckets
    out = _each(x, lambda v, b: C.bucket(v, b), bounds, elementwise=elementwise) if elementwise else _each(x, lambda v: C.bucket(v, bounds))
    return t.note(out, buckets=num_buckets, domain=(0, num_buckets - 1, True))


def strictly_increasing(bounds: Column) -> Column:
    """Boundaries with equal ones set apart by a millionth of their range."""
    span = F.array_max(bounds) - F.array_min(bounds)
    step = F.when(span > 0, span * 1e-6).otherwise(F.lit(1e-6))
    start = F.array().cast("array<double>")
    return F.aggregate(bounds, start, lambda acc, b: F.concat(acc, F.array(F.when(F.size(acc) == 0, b).otherwise(F.greatest(b, F.get(acc, F.size(acc) - 1) + step)))))


def bucketize_per_key(x: Column, key: Column, num_buckets: int, epsilon: float | None = None, weights: Column | None = None, name: str | None = None) -> Column:
    """By the key's quantiles; -1 for a key that wasn't seen."""
    got = _keyed(A.quantiles_per_key(x, key, num_buckets, weights, name), key, ["bounds"])
    if got is None:
        return Trace.current().placeholder()
    bounds = strictly_increasing(got["bounds"])
    one = lambda v: F.when(got["bounds"].isNull(), F.lit(-1)).otherwise(F.least(C.bucket(v, bounds), F.lit(num_buckets - 1))).cast("bigint")
    return Trace.current().note(_each(x, one), buckets=num_buckets, domain=(-1, num_buckets - 1, True))


def estimated_probability_density(x: Column, boundaries: int | Sequence[float] | None = None, categorical: bool = False, name: str | None = None) -> Column:
    """Share of the histogram's bin of x by its width; for categories their share, 0 if not seen."""
    t = Trace.current()
    if categorical:
        table = A.count_per_key(x, name)
        if table is PENDING:
            return t.placeholder()
        total = table.agg(F.sum("count")).first()[0] or 1
        got = t.join(x, table, ["count"])
        return (F.coalesce(got["count"], F.lit(0)) / F.lit(float(total))).cast("float")
    counts, edges = A.histogram(x, boundaries, False, name)
    b = F.transform(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: (e - 0.0001).cast("float").cast("double"))
    place = F.size(F.filter(b, lambda e: e < x.cast("double")))
    width = (F.element_at(edges, -1) - F.element_at(edges, 1)) / F.size(counts)
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c)
    return F.when(x.isNotNull(), F.get(counts, place) / F.greatest(total, F.lit(1)) / width).cast("float")


# -- vocabularies and text -----------------------------------------------------


def apply_vocabulary(x: Column, vocab: Vocabulary | Any, *, default_value: int = -1, num_oov_buckets: int = 0, lookup_fn: Callable[[Column, DataFrame], Column | tuple[Column, int]] | None = None) -> Column:
    """Index of each token; a token that isn't there has default_value, or one of num_oov_buckets after the last index.

    lookup_fn, if given, makes the column from x and the table (token, index, value); it may return the size of its range too.
    """
    t = Trace.current()
    if vocab is PENDING:
        return t.placeholder()
    if lookup_fn is not None:
        got = lookup_fn(x, vocab.table)
        return t.note(got[0], domain=(min(0, default_value), got[1] - 1, True)) if isinstance(got, tuple) else got
    clean = (lambda c: F.replace(c.cast("string"), F.lit(" "), F.lit("__SPACE__"))) if vocab.store_frequency else (lambda c: c.cast("string"))
    missing = (lambda c: F.lit(vocab.size).cast("bigint") + F.pmod(F.xxhash64(clean(c)), F.lit(num_oov_buckets))) if num_oov_buckets else (lambda c: F.lit(default_value).cast("bigint"))
    low, high = (0, vocab.size + num_oov_buckets - 1) if num_oov_buckets else (min(0, default_value), max(vocab.size - 1, default_value))
    known = lambda c: t.note(c, domain=(low, high, True))
    kind = t.dtype(x)
    if not isinstance(kind, T.ArrayType):
        got = t.join(clean(x), vocab.table.select("token", "index"), ["index"])
        return known(F.when(x.isNotNull(), F.coalesce(got["index"], missing(x))))
    if isinstance(kind.elementType, T.ArrayType):
        raise ValueError("flatten nested arrays before a vocabulary is applied")
    tokens = F.transform(x, clean) if vocab.store_frequency or not isinstance(kind.elementType, T.StringType) else x
    if not num_oov_buckets:
        return known(_lookup_array(tokens, vocab, default_value))
    found = _lookup_array(tokens, vocab)
    return known(F.transform(F.arrays_zip(x.alias("a"), found.alias("b")), lambda p: F.coalesce(p["b"], missing(p["a"]))))


def _lookup_array(tokens: Column, vocab: Vocabulary, default: int | None = None) -> Column:
    """Indices of an array's tokens in order; default where there is none."""
    t = Trace.current()
    if vocab.size > DICT_ROWS:
        got = _joined_array(tokens, vocab.table)
        return got if default is None else F.transform(got, lambda i: F.coalesce(i, F.lit(default).cast("bigint")))
    known = vocab.table.select("token", "index").toArrow()  # at most DICT_ROWS
    index = t.df.sparkSession.sparkContext.broadcast((known.column("token").combine_chunks(), known.column("index").combine_chunks()))

    def find(arrays: pa.Array) -> pa.Array:
        words, places = index.value
        flat = arrays.flatten()
        got = places.take(pc.index_in(flat.cast(words.type), value_set=words)) if len(words) else pa.nulls(len(flat), pa.int64())
        if default is not None:
            got = pc.fill_null(got, default)
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), got.cast(pa.int64()), mask=arrays.is_null())

    return F.arrow_udf(find, "array<bigint>")(tokens)


def _joined_array(tokens: Column, table: DataFrame) -> Column:
    """The same by a join of the distinct arrays' tokens, put back in order; keyed by the array itself."""
    t = Trace.current()
    distinct = written(t.df.select(tokens.alias("a")).filter("a IS NOT NULL").distinct().withColumn("id", F.monotonically_increasing_id()), "arrays")
    flat = distinct.select("id", F.posexplode_outer("a").alias("pos", "token")).join(table.select("token", "index"), "token", "left")
    back = flat.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "index")))).alias("z")).select("id", F.col("z.index").alias("found"))
    got = t.join(tokens, written(distinct.join(back, "id").select("a", "found"), "array-index"), ["found"])
    return got["found"]


def compute_and_apply_vocabulary(x: Column, *, default_value: int = -1, num_oov_buckets: int = 0, min_diff_from_avg: float = 0.0, **options) -> Column:
    return apply_vocabulary(x, vocabulary(x, min_diff_from_avg=min_diff_from_avg, **options), default_value=default_value, num_oov_buckets=num_oov_buckets)


def compute_and_apply_approximate_vocabulary(x: Column, *, top_k: int, default_value: int = -1, num_oov_buckets: int = 0, **options) -> Column:
    from .vocabulary import approximate_vocabulary

    return apply_vocabulary(x, approximate_vocabulary(x, top_k, **options), default_value=default_value, num_oov_buckets=num_oov_buckets)


def _documents(x: Column, vocab_size: int, name: str | None) -> Any:
    """(rows, {id: documents with it}) with ids modulo the vocabulary's size."""
    t = Trace.current()
    slots = F.array_distinct(F.transform(x, lambda e: C.vocab_slot(e, vocab_size)))

    def accumulate(df: DataFrame) -> DataFrame:
        rows = df.select(slots.alias("s"))
        by = rows.select(F.explode("s").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        return by.union(rows.select(F.lit(None).cast("bigint").alias("id"), F.lit(1).alias("n")).groupBy("id").agg(F.sum("n").alias("n")))

    return t.request("document_frequency", [x], lambda: TableState(accumulate, lambda p: written(p.groupBy("id").agg(F.sum("n").alias("n")), "df")), vocab_size, name)


def _per_id(x: Column, vocab_size: int, name: str | None) -> tuple[int, Column] | None:
    """(rows, document frequency of each position's id), or None."""
    t = Trace.current()
    table = _documents(x, vocab_size, name)
    if table is PENDING:
        return None
    n = table.filter("id IS NULL").select("n").first()
    ids = F.transform(x, lambda e: C.vocab_slot(e, vocab_size).cast("string"))
    as_vocab = Vocabulary(table.filter("id IS NOT NULL").select(F.col("id").cast("string").alias("token"), F.col("n").alias("index")), table.count(), 0, "df")
    return (n["n"] if n else 0), F.transform(_lookup_array(ids, as_vocab), lambda c: F.coalesce(c, F.lit(0)))


def document_frequency(x: Column, vocab_size: int, name: str | None = None) -> Column:
    """For each position the number of rows that have its id."""
    got = _per_id(x, vocab_size, name)
    return Trace.current().placeholder() if got is None else F.transform(got[1], lambda c: c.cast("bigint"))


def _idf(df: Column, n: int, smooth: bool, add_baseline: bool) -> Column:
    base = 1.0 if add_baseline else 0.0
    return (F.log((n + 1) / (df + 1.0)) if smooth else F.log(n / F.greatest(df, F.lit(1)).cast("double"))) + base


def idf(x: Column, vocab_size: int, smooth: bool = True, add_baseline: bool = True, name: str | None = None) -> Column:
    """Inverse document frequency of each position; all rows count, empty ones too."""
    got = _per_id(x, vocab_size, name)
    if got is None:
        return Trace.current().placeholder()
    return F.transform(got[1], lambda c: _idf(c, got[0], smooth, add_baseline).cast("float"))


def tfidf(x: Column, vocab_size: int, smooth: bool = True, name: str | None = None) -> tuple[Column, Column]:
    """(ids, weights) of each row's distinct ids, in order."""
    t = Trace.current()
    slots = F.transform(x, lambda e: C.vocab_slot(e, vocab_size))
    got = _per_id(x, vocab_size, name)
    if got is None:
        return t.placeholder(), t.placeholder()
    n, df = got

    def weighted(b: Column) -> Column:
        pairs = F.array_sort(F.array_distinct(F.arrays_zip(b["i"].alias("i"), b["d"].alias("d"))))
        count = lambda i: F.size(F.filter(b["i"], lambda s: s == i))
        weight = lambda p: ((count(p["i"]) / F.size(b["i"])).cast("double") * _idf(p["d"], n, smooth, True).cast("float")).cast("float")
        return F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), weight(p).alias("w")))

    z = C.let(F.struct(slots.alias("i"), df.alias("d")), weighted)
    return z["i"], z["w"]


def num_buckets_of(feature: Column | str) -> Column:
    """Buckets of a column that a bucketize call returned, or of such a call by its name."""
    t = Trace.current()
    found = t.annotations.get("buckets", {}).get(feature) if isinstance(feature, str) else t.fact(feature, "buckets")
    if found is None and not isinstance(feature, str) and t.pending:
        return t.placeholder()
    if found is None:
        raise ValueError(f"{feature} is not a bucketized feature")
    return F.lit(found).cast("bigint")


def get_vocabulary_size_by_name(name: str) -> Column:
    """Size of a vocabulary computed before under this file name, without out-of-vocabulary buckets."""
    t = Trace.current()
    found = t.annotations.get("vocabularies", {})
    if name in found:
        return F.lit(found[name].size).cast("bigint")
    if t.pending or t.calls:
        return t.placeholder()
    raise ValueError(f"there is no vocabulary named {name}")


def apply_pyfunc(fn: Callable[..., pd.Series], return_type: str, *args: Column) -> Column:
    """A user's function of pandas Series, run on Arrow batches."""
    return F.pandas_udf(fn, return_type)(*args)


class Tracked:
    """An object that is made once in each process that uses it, whatever it is made of; pickled as how it is made."""

    _made: dict[str, Any] = {}

    def __init__(self, make: Callable[[], Any], name: str | None = None):
        self.make, self.name = make, name or function_id(make)

    def get(self) -> Any:
        if self.name not in Tracked._made:
            Tracked._made[self.name] = self.make()
        return Tracked._made[self.name]


def make_and_track(make: Callable[[], Any], name: str | None = None) -> Tracked:
    """An object for user functions, such as a table or a model: made on first use, kept for the next phase or batch."""
    return Tracked(make, name)


def apply_model(load: Callable[[], Any] | Tracked, predict: Callable[..., Any], return_type: str, *args: Column) -> Column:
    """A frozen model: loaded once in each Python worker, predict(model, *series) on each batch of any number of columns."""
    held = load if isinstance(load, Tracked) else Tracked(load)

    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(predict(held.get(), *[rows[c] for c in rows.columns]))

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, return_type)(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(args)]))


def annotate_asset(name: str, path: str) -> None:
    """A file that belongs to the frozen function: save() copies it, and asset() of the loaded one tells where it is."""
    t = Trace.current()
    if t.annotations.setdefault("assets", {}).setdefault(name, path) != path:
        raise ValueError(f"there are two assets named {name}")


def annotate_shape(c: Column, shape: Sequence[int]) -> Column:
    """A column whose output has a fixed shape, kept in the output's metadata."""
    return Trace.current().note(c, shape=list(shape))
