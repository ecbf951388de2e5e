"""Feature declarations, and their Spark types."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

_TYPES = {"int64": T.LongType(), "float32": T.FloatType(), "string": T.StringType()}


def _type(dtype: str) -> T.DataType:
    if dtype not in _TYPES:
        raise ValueError(f"features are int64, float32 or string, not {dtype}")
    return _TYPES[dtype]


@dataclass(frozen=True)
class FixedLen:
    """A scalar (shape ()), or an array of fixed shape; never missing."""

    dtype: str
    shape: tuple[int, ...] = ()


@dataclass(frozen=True)
class VarLen:
    """Any number of values."""

    dtype: str


@dataclass(frozen=True)
class Ragged:
    """Nested lists, as deep as there are partitions, and one more."""

    dtype: str
    partitions: int = 1


@dataclass(frozen=True)
class Sparse:
    """Values at places of a dense array: index columns and a value column."""

    index_keys: tuple[str, ...]
    value_key: str
    dtype: str
    size: tuple[int, ...]


@dataclass(frozen=True)
class Domain:
    """Least and largest value of an integer or float feature; categorical ones are indices."""

    low: float
    high: float
    categorical: bool = False


Spec = FixedLen | VarLen | Ragged | Sparse


def fields(name: str, spec: Spec, domain: Domain | None = None) -> list[T.StructField]:
    """The columns that hold a feature; a sparse one has an index column for each dimension and a value column."""
    meta = {"shape": list(getattr(spec, "shape", ()) or ()), "kind": type(spec).__name__}
    if domain is not None:
        meta["domain"] = {"min": domain.low, "max": domain.high, "is_categorical": domain.categorical}
    t = _type(spec.dtype)
    if isinstance(spec, FixedLen):
        for _ in spec.shape:
            t = T.ArrayType(t, False)
        return [T.StructField(name, t, False, meta)]
    if isinstance(spec, VarLen):
        return [T.StructField(name, T.ArrayType(t), True, meta)]
    if isinstance(spec, Ragged):
        for _ in range(spec.partitions + 1):
            t = T.ArrayType(t)
        return [T.StructField(name, t, True, meta)]
    meta |= {"feature": name, "size": list(spec.size), "index_keys": list(spec.index_keys), "value_key": spec.value_key}
    return [T.StructField(k, T.ArrayType(T.LongType()), True) for k in spec.index_keys] + [T.StructField(spec.value_key, T.ArrayType(t), True, meta)]


def schema_of(specs: Mapping[str, Spec], domains: Mapping[str, Domain] | None = None) -> T.StructType:
    """A Spark schema of declared features; at least one."""
    if not specs:
        raise ValueError("a schema needs a feature")
    domains = domains or {}
    return T.StructType([f for name, spec in specs.items() for f in fields(name, spec, domains.get(name))])


def specs_of(schema: T.StructType) -> dict[str, Spec]:
    """The declarations back; columns that were not declared count as scalars, lists or nested lists by their type."""
    names = {"bigint": "int64", "int": "int64", "float": "float32", "double": "float32", "string": "string"}
    out: dict[str, Spec] = {}
    skip = {k for f in schema for k in (f.metadata or {}).get("index_keys", [])}
    for f in schema:
        if f.name in skip:
            continue
        meta, t, depth = f.metadata or {}, f.dataType, 0
        while isinstance(t, T.ArrayType):
            t, depth = t.elementType, depth + 1
        if t.simpleString() not in names:
            raise ValueError(f"{f.name} has the type {t.simpleString()}")
        dtype = names[t.simpleString()]
        if "value_key" in meta:
            out[meta["feature"]] = Sparse(tuple(meta["index_keys"]), meta["value_key"], dtype, tuple(meta["size"]))
        elif meta.get("kind") == "FixedLen" or depth == 0:
            out[f.name] = FixedLen(dtype, tuple(meta.get("shape", ())))
        else:
            out[f.name] = VarLen(dtype) if depth == 1 else Ragged(dtype, depth - 1)
    return out


def domains_of(schema: T.StructType) -> dict[str, Domain]:
    found = {f.name: (f.metadata or {}).get("domain") for f in schema}
    return {n: Domain(d["min"], d["max"], d["is_categorical"]) for n, d in found.items() if d}


def annotated(c: Column, name: str, low: float | None = None, high: float | None = None, categorical: bool = True, shape: list[int] | None = None) -> Column:
    """A column with its domain or fixed output shape in its metadata."""
    meta: dict = {}
    if low is not None and high is not None:
        meta["domain"] = {"min": low, "max": high, "is_categorical": categorical}
    if shape is not None:
        meta["shape"] = shape
    return c.alias(name, metadata=json.loads(json.dumps(meta)))


def true_sparse(x: Column) -> Column:
    """An array with gaps as a struct of the indices and the values that are there."""
    places = F.filter(F.transform(x, lambda v, i: F.when(v.isNotNull(), i.cast("bigint"))), lambda i: i.isNotNull())
    return F.struct(places.alias("indices"), F.filter(x, lambda v: v.isNotNull()).alias("values"))
