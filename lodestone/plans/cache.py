"""Partial results of named datasets, kept as Parquet, so that only new data is read again."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from . import files
from . import trace as P

#: Changes when the layout of partial results does.
VERSION = "2"


class AnalysisCache:
    """A folder of entries (dataset, analyzer), each a Parquet table, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hits = self.misses = 0

    def _dataset(self, dataset: str) -> str:
        return f"{self.path}/v{VERSION}/d-{quote(dataset, safe='')}"

    def get(self, dataset: str, signature: str) -> DataFrame | None:
        where = f"{self._dataset(dataset)}/{signature}"
        if files.exists(self.spark, f"{where}/_SUCCESS"):
            self.hits += 1
            return self.spark.read.parquet(where)
        self.misses += 1
        return None

    def put(self, dataset: str, signature: str, parts: DataFrame) -> DataFrame:
        """Written apart and put in place by one rename; if another run was first, its entry stands."""
        where = f"{self._dataset(dataset)}/{signature}"
        temp = f"{self.path}/v{VERSION}/w-{uuid.uuid4().hex}"
        parts.write.parquet(temp)
        try:
            files.make(self.spark, self._dataset(dataset))
            files.rename(self.spark, temp, where)
        except FileExistsError:
            files.remove(self.spark, temp)
        return self.spark.read.parquet(where)

    def entry_keys(self, dataset: str) -> list[str]:
        return files.names(self.spark, self._dataset(dataset))


def needed_datasets(names: Sequence[str], calls: Sequence[P.Call], cache: AnalysisCache) -> list[str]:
    """The datasets that must be read: those of which a partial result is missing."""
    wanted = {c.signature for c in calls}
    return [n for n in names if not wanted <= set(cache.entry_keys(n))]


def solver(datasets: Mapping[str, DataFrame | None], cache: AnalysisCache):
    """Computes the calls of a phase from cached and fresh partial results; fresh rows of a dataset share one aggregation."""

    def solve(_: DataFrame, calls: Sequence[P.Call]) -> dict[str, Any]:
        parts: dict[str, list[DataFrame]] = {c.key: [] for c in calls}
        names = {c.key: c.signature for c in calls}
        for name, df in datasets.items():
            missing = []
            for c in calls:
                found = cache.get(name, names[c.key])
                if found is None:
                    missing.append(c)
                else:
                    parts[c.key].append(found)
            if missing and df is None:
                raise ValueError(f"dataset {name} isn't given and its results aren't cached")
            for depth in sorted({len(c.lookups) for c in missing}):
                mine = [c for c in missing if len(c.lookups) == depth]
                base = P.joined(df, mine[0].lookups)
                rows = [c for c in mine if isinstance(c.state, P.RowState)]
                if rows:
                    one = base.agg(*[a.alias(f"{i}_{n}") for i, c in enumerate(rows) for n, a in c.state.aggs.items()])
                    one = cache.spark.createDataFrame([one.first()], one.schema)
                    for i, c in enumerate(rows):
                        parts[c.key].append(cache.put(name, names[c.key], one.selectExpr(*[f"`{i}_{n}` AS `{n}`" for n in c.state.aggs])))
                for c in mine:
                    if isinstance(c.state, P.TableState):
                        parts[c.key].append(cache.put(name, names[c.key], c.state.accumulate(base)))
        values = {}
        for c in calls:
            union = parts[c.key][0]
            for p in parts[c.key][1:]:
                union = union.unionByName(p)
            values[c.key] = c.state.finish(c.state.merged(union)) if isinstance(c.state, P.RowState) else c.state.finish(union)
        return values

    return solve
