"""Small files and folders on whatever file system Spark reads: local, HDFS or an object store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def make(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Puts a folder in place; fails if something is there."""
    fs, p = _at(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    if fs.exists(target) or not fs.rename(p, target):
        raise FileExistsError(new)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _at(spark, source)
    to, q = _at(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()  # one small file
    return bytes(rows[0]["content"])


def stored_bytes(df: DataFrame) -> int:
    """Spark's estimate of a frame's size; for a written table the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
