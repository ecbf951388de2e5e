"""Row-level expressions; none of them needs a pass over the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    d = x.cast("double")
    return x.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once: inside a lambda an expression would be evaluated again for each element."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def as_bounds(bounds: Column | Sequence[float]) -> Column:
    return bounds if isinstance(bounds, Column) else F.array(*[F.lit(float(b)) for b in bounds]) if len(bounds) else F.array().cast("array<double>")


def bucket(x: Column, bounds: Column | Sequence[float]) -> Column:
    """How many boundaries are <= x; NaN is in the last bucket, null stays null."""
    return F.when(x.isNotNull(), F.size(F.filter(as_bounds(bounds), lambda b: b <= x.cast("double"))).cast("bigint"))


def interpolated(x: Column, bounds: Column | Sequence[float]) -> Column:
    """Position of x among the finite boundaries in [0, 1], linear inside a bucket; NaN is 0.5."""
    v = x.cast("double")
    b = F.filter(as_bounds(bounds), lambda e: is_finite(e))
    n, k = F.size(b), F.size(F.filter(b, lambda e: e <= v))
    low, high = F.get(b, k - 1), F.get(b, k)
    inside = F.when(high > low, (v - low) / (high - low)).otherwise(F.lit(0.5))
    return (
        F.when(v.isNull(), F.lit(None).cast("float"))
        .when(F.isnan(v), F.lit(0.5))
        .when(n == 1, F.when(k == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
        .when(k == 0, F.lit(0.0))
        .when(k == n, F.lit(1.0))
        .otherwise((k - 1 + inside) / F.greatest(n - 1, F.lit(1)))
        .cast("float")
    )


def ngrams(tokens: Column, ngram_range: tuple[int, int], separator: str = " ") -> Column:
    """At each token the runs of least to most size that fit in the row, shortest first."""
    least, most = ngram_range
    if least < 1 or most < least:
        raise ValueError(f"bad ngram_range {ngram_range}")

    def runs(t: Column) -> Column:
        one = lambda i: F.transform(
            F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: i + k - 1 <= F.size(t)),
            lambda k: F.array_join(F.slice(t, i, k), separator),
        )
        return F.when(F.coalesce(F.size(t), F.lit(0)) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.size(t)), one))).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def bag_of_words(tokens: Column, ngram_range: tuple[int, int], separator: str = " ") -> Column:
    return F.array_distinct(ngrams(tokens, ngram_range, separator))


def deduplicate_per_row(x: Column) -> Column:
    return F.array_distinct(x)


def word_count(tokens: Column) -> Column:
    return F.when(tokens.isNull(), 0).otherwise(F.size(tokens)).cast("bigint")


def segment_indices(segments: Column) -> Column:
    """For an array of segment ids, the 0-based place of each element in its run."""

    def places(v: Column) -> Column:
        # (last value, its place, places so far), element by element
        start = F.struct(F.get(v, F.lit(0)).alias("last"), F.lit(-1).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))

        def step(s: Column, e: Column) -> Column:
            at = F.when((F.size(s["out"]) > 0) & (s["last"] != e), F.lit(0).cast("bigint")).otherwise(s["at"] + 1)
            return F.struct(e.alias("last"), at.alias("at"), F.array_append(s["out"], at).alias("out"))

        return F.when(F.size(v) > 0, F.aggregate(v, start, step, lambda s: s["out"])).otherwise(F.array().cast("array<bigint>"))

    return let(segments, places)


def pad(x: Column, length: int, default) -> Column:
    """The first elements of an array, filled up to a fixed length."""
    return let(x, lambda v: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.get(v, i), F.lit(default))))


def left_align(x: Column) -> Column:
    """An array without its gaps (nulls), in order."""
    return F.filter(x, lambda e: e.isNotNull())


def dense_from_sparse(indices: Column, values: Column, length: int, default) -> Column:
    """A fixed-length array from index and value arrays."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(length - 1).cast("bigint")), lambda i: F.coalesce(F.get(values, (F.array_position(indices, i) - 1).cast("int")), F.lit(default)))


def hash_strings(x: Column, hash_buckets: int, key: Sequence[int] | None = None) -> Column:
    """Bucket of a string by a 64-bit hash; key salts it. The values are those of xxhash64."""
    if hash_buckets < 1:
        raise ValueError("hash_buckets must be positive")
    parts = [F.lit(int(k)) for k in key] if key is not None else []
    one = lambda s: F.when(s.isNotNull(), F.pmod(F.xxhash64(*parts, s.cast("string")), F.lit(hash_buckets)).cast("bigint"))
    return one(x)


def hash_strings_array(x: Column, hash_buckets: int, key: Sequence[int] | None = None) -> Column:
    return F.transform(x, lambda s: hash_strings(s, hash_buckets, key))


def one_hot(index: Column, depth: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: (i == index).cast("float"))


def vocab_slot(x: Column, vocab_size: int | Column) -> Column:
    """An id taken modulo the vocabulary's size, so that -1 is its last slot."""
    size = vocab_size if isinstance(vocab_size, Column) else F.lit(vocab_size)
    return F.pmod(x.cast("bigint"), size.cast("bigint"))


def split_words(x: Column, pattern: str = r"\S+") -> Column:
    """Maximal matches of a pattern; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
