"""Phases of an analysis.

A preprocessing function maps a dict of input columns to a dict of output
columns and may call analyzers. Each analyzer call registers a State: a table
or row of partial results, and how to turn it into values. The function is
traced again and again; in each round the calls whose columns depend on no
unknown result are computed, all one-row states of the round in one
aggregation, until none is left. Results then stand in the output as literals,
or as joins with small tables.
"""

from __future__ import annotations

import contextvars
import hashlib
import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from .files import stored_bytes

#: Bytes, as stored, of a lookup table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 24 << 20
_active: contextvars.ContextVar["Trace | None"] = contextvars.ContextVar("trace", default=None)


@dataclass
class RowState:
    """Partial results in one row: aggregates of the data, how partial rows merge, and the value."""

    aggs: dict[str, Column]
    merges: dict[str, Callable[[str], Column]]
    finish: Callable[[dict[str, Any]], Any]
    combine: Callable[[DataFrame], dict[str, Any]] | None = None

    def merged(self, parts: DataFrame) -> dict[str, Any]:
        """One row of several partial ones."""
        if self.combine is not None:
            return self.combine(parts)
        return parts.agg(*[self.merges[n](n).alias(n) for n in self.aggs]).first().asDict()


@dataclass
class TableState:
    """Partial results in a table: accumulate one dataset, then finish the union of such tables."""

    accumulate: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], Any]
    direct: Callable[[DataFrame], Any] | None = None  # the value of one dataset without partial results, if that is cheaper


@dataclass
class Call:
    """An analyzer call. text tells calls apart but for what columns print alike: user functions, and the contents of lookups."""

    key: str
    columns: list[Column]
    state: RowState | TableState
    text: str
    lookups: list["Lookup"]
    frame: DataFrame

    def same(self, other: "Call") -> bool:
        """Whether both compute the same: Spark compares the resolved columns, with the code of Python functions in them."""
        return self.text == other.text and len(self.lookups) == len(other.lookups) and self.frame.sameSemantics(other.frame)

    @property
    def signature(self) -> str:
        """A name of what is computed, for the cache: also by the contents of the tables that the columns are looked up in."""
        # over a plan without files or row sets, whose hash would be another in each session
        bare = self.frame.sparkSession.range(0, 0, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        parts = [self.text, self.schema.simpleString(), str(bare.select(*self.columns).semanticHash())]
        for look in self.lookups:
            row = look.table.agg(F.count("*"), F.sum(F.xxhash64(*look.table.columns).cast("decimal(38,0)"))).first()
            parts.append(f"{unnumbered(str(look.key))} {look.table.columns} {row[0]} {row[1]}")
        return hashlib.sha1("\n".join(parts).encode()).hexdigest()

    schema: T.StructType = field(default_factory=T.StructType)


def unnumbered(text: str) -> str:
    """A column's text without the running numbers of lambda variables."""
    seen: dict[str, str] = {}
    return re.sub(r"\b([a-z])_(\d+)\b", lambda m: seen.setdefault(m[0], f"{m[1]}_#{len(seen)}"), text)


def function_id(f: Callable) -> str:
    """A name of a function's code and of what it holds on to."""
    try:
        return hashlib.sha1(cloudpickle.dumps(f)).hexdigest()
    except Exception:  # what can't be pickled is known by its identity
        return f"object {id(f)}"


@dataclass
class Lookup:
    """A join that the outputs need: key column against a table (key, values...)."""

    key: Column
    table: DataFrame
    values: list[str]
    prefix: str


@dataclass
class Trace:
    df: DataFrame
    known: dict[str, Any]
    calls: list[Call] = field(default_factory=list)
    lookups: list[Lookup] = field(default_factory=list)
    annotations: dict[str, Any] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)
    pending: int = 0
    inputs_used: list[Column] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    types: dict[int, tuple] = field(default_factory=dict)
    facts: dict[int, tuple] = field(default_factory=dict)

    @staticmethod
    def current() -> "Trace":
        t = _active.get()
        if t is None:
            raise RuntimeError("analyzers and mappers are called inside a preprocessing function")
        return t

    def placeholder(self) -> Column:
        self.pending += 1
        return F.col(f"__pending_{self.pending}__")

    def dtype(self, c: Column) -> T.DataType | None:
        """The type of a column, or None if it depends on an unknown result; each column object is resolved once."""
        if id(c) in self.types:
            return self.types[id(c)][1]
        if "__pending_" in str(c):
            self.types[id(c)] = (c, None)
            return None
        try:
            kind = self.df.select(c).schema[0].dataType
        except AnalysisException as e:
            if "__pending_" not in str(e):
                raise
            kind = None
        self.types[id(c)] = (c, kind)
        return kind

    def note(self, c: Column, **facts: Any) -> Column:
        """Remembers something about a column that the function may return as it is, such as its domain."""
        self.facts[id(c)] = (c, self.facts.get(id(c), (c, {}))[1] | facts)
        return c

    def fact(self, c: Column, name: str) -> Any:
        return self.facts.get(id(c), (c, {}))[1].get(name)

    def ready(self, columns: Sequence[Column]) -> bool:
        return all(self.dtype(c) is not None for c in columns)

    def key(self, kind: str, name: str | None) -> str:
        base = name or kind
        self.seen[base] = self.seen.get(base, 0) + 1
        n = self.seen[base]
        return base if n == 1 else f"{base}#{n}"

    def request(self, kind: str, columns: Sequence[Column], state: Callable[[], RowState | TableState], params: Any = None, name: str | None = None, functions: Sequence[Callable] = ()) -> Any:
        """The value of an analyzer call, or PENDING. params must hold all that the state depends on but columns and functions."""
        key = self.key(kind, name)
        self.inputs_used += list(columns)
        if key in self.known:
            return self.known[key]
        if self.ready(columns):
            text = json.dumps([kind, params, [unnumbered(str(c)) for c in columns], [function_id(f) for f in functions]], default=str, sort_keys=True)
            call = Call(key, list(columns), state(), text, list(self.lookups), self.df.select(*columns), self.df.schema)
            twin = next((c for c in self.calls if c.same(call)), None)
            if twin is not None:
                self.aliases[key] = twin.key
                return PENDING
            self.calls.append(call)
        return PENDING

    def join(self, key: Column, table: DataFrame, values: Sequence[str]) -> dict[str, Column]:
        """Columns of a left join with a table (key, values...); null where the key is unknown."""
        prefix = f"__lk{len(self.lookups)}_"
        self.lookups.append(Lookup(key, table, list(values), prefix))
        self.df = joined(self.df, self.lookups[-1:])
        return {v: F.col(prefix + v) for v in values}


class _Pending:
    def __repr__(self) -> str:
        return "PENDING"


PENDING = _Pending()


def trace(df: DataFrame, fn: Callable, known: dict[str, Any]) -> tuple[Trace, dict[str, Column]]:
    t = Trace(df, known)
    token = _active.set(t)
    try:
        out = fn({c: F.col(f"`{c}`") for c in df.columns})
    finally:
        _active.reset(token)
    if not out:
        raise ValueError("the preprocessing function returned no outputs")
    return t, out


def joined(df: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """df with the value columns of the lookups; a side is broadcast only if it is small enough."""
    for look in lookups:
        name = look.prefix + "key"
        side = look.table.select(F.col(look.table.columns[0]).alias(name), *[F.col(v).alias(look.prefix + v) for v in look.values])
        if stored_bytes(look.table) <= BROADCAST_BYTES:
            side = F.broadcast(side)
        df = df.join(side, look.key == F.col(name), "left").drop(name)
    return df


def compute(df: DataFrame, calls: Sequence[Call]) -> dict[str, Any]:
    """Values of the calls: one aggregation for all one-row states over the same joins, one job for each table."""
    values: dict[str, Any] = {}
    for depth in sorted({len(c.lookups) for c in calls}):
        mine = [c for c in calls if len(c.lookups) == depth]
        base = joined(df, mine[0].lookups)
        rows = [c for c in mine if isinstance(c.state, RowState)]
        if rows:
            row = base.agg(*[agg.alias(f"{i}.{n}") for i, c in enumerate(rows) for n, agg in c.state.aggs.items()]).first()
            for i, c in enumerate(rows):
                values[c.key] = c.state.finish({n: row[f"{i}.{n}"] for n in c.state.aggs})
        for c in mine:
            if isinstance(c.state, TableState):
                values[c.key] = c.state.direct(base) if c.state.direct is not None else c.state.finish(c.state.accumulate(base))
    return values


def phases(df: DataFrame, fn: Callable, solve: Callable[[DataFrame, Sequence[Call]], dict[str, Any]] = compute) -> tuple[dict[str, Any], Trace, dict[str, Column], int]:
    """(values, last trace, outputs, number of phases)."""
    known: dict[str, Any] = {}
    for number in range(100):
        t, out = trace(df, fn, known)
        if not t.calls:
            if t.pending:
                raise ValueError("an analyzer depends on a column that can't be computed")
            return known, t, out, number
        known |= solve(df, t.calls)
        known |= {k: known[twin] for k, twin in t.aliases.items()}
    raise ValueError("the analysis needs more than 100 phases")


def apply(df: DataFrame, t: Trace, out: dict[str, Column], passthrough: Sequence[str] = ()) -> DataFrame:
    """The outputs over df: joins with lookup tables, then one projection."""
    df = joined(df, t.lookups)
    return df.select(*[F.col(f"`{p}`") for p in passthrough], *[described(t, c, n) for n, c in out.items()])


def described(t: Trace, c: Column, name: str) -> Column:
    """The column under its name, with what is known of it in the metadata."""
    domain, shape = t.fact(c, "domain"), t.fact(c, "shape")
    meta: dict[str, Any] = {}
    if domain is not None:
        meta["domain"] = {"min": domain[0], "max": domain[1], "is_categorical": domain[2]}
    if shape is not None:
        meta["shape"] = list(shape)
    return c.alias(name, metadata=meta) if meta else c.alias(name)
