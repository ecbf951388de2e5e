"""Intermediate tables that survive the loss of an executor.

``written(df)`` writes a frame as Parquet into the folder named by
``spark.checkpoint.dir`` and returns a frame that reads it back: lineage is cut,
the files are shared by all executors, and a later join knows the table's size.
Where the setting is absent a temporary folder is used, but only if the session
runs in one process; on a cluster that would be a machine-local folder, so it
is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of an Arrow batch; the bytes keep a Python worker's memory small even if texts are long.
BATCH_ROWS, BATCH_BYTES = 20_000, 4 << 20
#: Bytes, as stored, of a written table that a join may broadcast; beyond that it shuffles.
BROADCAST_BYTES = 24 << 20
#: Once a table is written, the shuffle files that led to it aren't needed again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="lodestone-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a Parquet table under the shared folder; the shuffle files of the write go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Spark's estimate of a frame's size; for a written table the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a table of texts: Spark's estimate, or where it has none the length of the texts."""
    known = stored_bytes(docs)
    return known if known < 1 << 50 else docs.agg(F.sum(F.length(column))).first()[0] or 0


def small_side(side: DataFrame) -> DataFrame:
    """A written table as one side of a join: broadcast if its bytes allow, else hashed after a shuffle."""
    return F.broadcast(side) if stored_bytes(side) <= BROADCAST_BYTES else side.hint("shuffle_hash")


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch for operators that hand texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def by_number(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame | None]:
    """df with a bigint in place of a key column, in the key's order, and the table (number, key) to get back by.

    Whole numbers stand for themselves, without a table; other keys are sorted
    in range partitions and numbered by place. A null key stays null.
    """
    kind = df.schema[column].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn(column, F.col(column).cast("bigint")), None
    keys = df.select(F.col(column).alias("__key")).filter("__key IS NOT NULL").distinct()
    keys = written(keys.repartitionByRange("__key").sortWithinPartitions("__key").select(F.monotonically_increasing_id().alias("__number"), "__key"), "numbers")
    numbered = df.join(small_side(keys), df[column] == F.col("__key"), "left")
    return numbered.select(*[F.col("__number").alias(c) if c == column else df[c] for c in df.columns]), keys


def by_key(df: DataFrame, columns: list[str], keys: DataFrame | None) -> DataFrame:
    """The keys again in the columns given, which hold numbers of by_number."""
    if keys is None:
        return df
    names = df.columns
    for c in columns:
        side = small_side(keys.withColumnsRenamed({"__number": f"__number_{c}", "__key": f"__key_{c}"}))
        df = df.join(side, F.col(c) == F.col(f"__number_{c}"), "left").drop(c, f"__number_{c}").withColumnRenamed(f"__key_{c}", c)
    return df.select(*names)
