"""Tables between the passes of an analysis, kept in the folder that all executors share."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Once a table is written, the shuffle files that led to it aren't needed again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Settings:
    """What a Context sets; None where the outer one, or the default, holds."""

    work_dir: str | None = None
    passthrough: tuple[str, ...] | None = None


_settings: contextvars.ContextVar[Settings] = contextvars.ContextVar("settings", default=Settings())


class Context:
    """Settings for the analyses inside a with block; an inner block inherits what it doesn't set.

    work_dir: a folder that all executors share, instead of spark.checkpoint.dir.
    passthrough: columns that are carried along where a call names none.
    """

    def __init__(self, work_dir: str | None = None, passthrough: tuple[str, ...] | list[str] | None = None):
        self._set = {k: v for k, v in (("work_dir", work_dir), ("passthrough", None if passthrough is None else tuple(passthrough))) if v is not None}
        self._tokens: list[contextvars.Token] = []

    def __enter__(self) -> "Context":
        self._tokens.append(_settings.set(replace(_settings.get(), **self._set)))
        return self

    def __exit__(self, *_) -> None:
        _settings.reset(self._tokens.pop())

    @staticmethod
    def current() -> Settings:
        return _settings.get()


def shared_dir(spark: SparkSession) -> str:
    """The Context's folder, or that of spark.checkpoint.dir; without either a temporary one, in a local session only."""
    found = _settings.get().work_dir or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="lodestone-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, so its lineage is cut and its size known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
