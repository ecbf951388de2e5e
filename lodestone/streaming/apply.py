"""A frozen function over a stream.

It holds no state: a projection, with broadcast joins against static lookup
tables. Analyzers need all of their data and run on batch tables only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import Frozen


def apply_stream(stream: DataFrame, found: Frozen, passthrough: Sequence[str] = ()) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("this is not a stream")
    return found.apply(stream, passthrough)


def write_stream(stream: DataFrame, found: Frozen, path: str, checkpoint: str, passthrough: Sequence[str] = ()) -> StreamingQuery:
    """Its outputs, appended as Parquet; the checkpoint makes a restart go on where it stopped."""
    out = apply_stream(stream, found, passthrough)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
