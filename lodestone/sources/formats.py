"""Readers and writers, and the two record encodings."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    """parquet, orc, csv, json or text; give a schema to csv and json, or the data is read twice."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists", **options) -> None:
    df.write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def encode_csv(df: DataFrame, columns: Sequence[str] | None = None, delimiter: str = ",", secondary_delimiter: str = "|") -> DataFrame:
    """One string column of CSV lines; arrays are joined by the secondary delimiter; a missing value is empty."""
    names = list(columns or df.columns)
    plain = [F.array_join(F.col(n).cast("array<string>"), secondary_delimiter) if isinstance(df.schema[n].dataType, T.ArrayType) else F.col(n).cast("string") for n in names]

    options = {"sep": delimiter, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return df.select(F.to_csv(F.struct(*[p.alias(n) for p, n in zip(plain, names)]), options).alias("value"))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def example_bytes(features: dict[str, Iterable]) -> bytes:
    """A record of named lists of bytes, floats or integers in protocol-buffer wire format (map field 1; lists 1, 2, 3)."""
    body = b""
    for name in sorted(features):
        values = list(features[name])
        if values and isinstance(values[0], (str, bytes)):
            kind = _message(1, b"".join(_message(1, v.encode() if isinstance(v, str) else v) for v in values))
        elif values and isinstance(values[0], float):
            kind = _message(2, _message(1, struct.pack(f"<{len(values)}f", *values)))
        elif values:
            kind = _message(3, _message(1, b"".join(map(_varint, values))))
        else:
            kind = b""
        body += _message(1, _message(1, name.encode()) + _message(2, kind))
    return _message(1, body)


def flat_features(df: DataFrame) -> DataFrame:
    """Nested lists as flat ones: name holds the values, and name$row_lengths_k the lengths of the lists at depth k.

    Sparse features are index and value columns already, and stay as they are.
    """
    out = []
    for f in df.schema:
        c, t, k = F.col(f"`{f.name}`"), f.dataType, 1
        while isinstance(t, T.ArrayType) and isinstance(t.elementType, T.ArrayType):
            out.append(F.transform(c, lambda row: F.size(row).cast("bigint")).alias(f"{f.name}$row_lengths_{k}"))
            c, t, k = F.flatten(c), t.elementType, k + 1
        out.append(c.alias(f.name))
    return df.select(*out)


def encode_examples(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """One binary column of records; scalars are lists of one, a null is an empty list, nested lists are flat with their row lengths."""
    df = flat_features(df.drop(*exclude))
    names = df.columns
    real = {n for n in names if df.schema[n].dataType.simpleString().removeprefix("array<").rstrip(">") in ("float", "double")}

    def encode(rows: pa.Array) -> pa.Array:
        columns = [rows.field(k).to_pylist() for k in range(len(names))]
        out = []
        for r in zip(*columns):
            features = {}
            for n, v in zip(names, r):
                items = [i for i in (v if isinstance(v, list) else [v]) if i is not None]
                features[n] = [float(i) for i in items] if n in real else [i if isinstance(i, (str, bytes)) else int(i) for i in items]
            out.append(example_bytes(features))
        return pa.array(out, pa.binary())

    return df.select(F.arrow_udf(encode, "binary")(F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])).alias("value"))
