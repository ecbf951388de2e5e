"""Best-fit packing of documents into sequences of several permitted lengths.

A piece goes into the open bin that it fills best; if none fits, a bin of the
size with the least cost for each token is opened. At the end every bin is
downsized to the smallest permitted length that holds its contents. Which
length a piece opens is optimised on each shard for all lengths together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import token_count
from .storage import written

#: Permitted lengths of a sequence, in tokens.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Pieces packed together; more shards, not larger ones, hold a larger corpus.
SHARD_PIECES = 40_000


def cost(length: int) -> float:
    """Of running one sequence: its tokens, a fixed overhead, and attention."""
    return length + 64 + length * length / 65536


def best_fit(pieces: Sequence[int], lengths: Sequence[int], opened: Sequence[int]) -> tuple[list[int], list[int]]:
    """The bin of each piece, in order, and the contents of each bin. opened: by piece, the size to open."""
    biggest = max(lengths)
    by_room: list[list[int]] = [[] for _ in range(biggest + 1)]
    mask, where, filled = 0, [], []
    for n, size in zip(pieces, opened):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
            filled[b] += n
        else:
            b, room = len(filled), size
            filled.append(n)
        where.append(b)
        left = room - n
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return where, filled


def pack_lengths(pieces: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, contents of each bin, length of each bin) for pieces in decreasing order.

    Pieces are classed by the least length that holds them, and a policy tells
    which length a piece of each class opens. From the best of three simple
    policies, the choice of one class at a time is changed while the total cost
    of the packed and downsized bins falls; so the lengths are chosen jointly.
    """
    sizes = sorted(lengths)
    kind = np.searchsorted(sizes, pieces).tolist()
    seen: dict[tuple[int, ...], tuple] = {}

    def packed(policy: tuple[int, ...]) -> tuple:
        if policy not in seen:
            where, filled = best_fit(pieces, sizes, [sizes[policy[c]] for c in kind])
            final = [sizes[k] for k in np.searchsorted(sizes, filled)]
            seen[policy] = (sum(map(cost, final)), where, filled, final)
        return seen[policy]

    every = range(len(sizes))
    cheapest = [min((k for k in every if k >= c), key=lambda k: (cost(sizes[k]) / sizes[k], k)) for c in every]
    now = min((tuple(cheapest), tuple(every), (len(sizes) - 1,) * len(sizes)), key=lambda p: packed(p)[0])
    while True:
        others = [now[:c] + (k,) + now[c + 1 :] for c in sorted(set(kind), reverse=True) for k in every if k >= c and k != now[c]]
        better = min(others, key=lambda p: packed(p)[0], default=now)
        if packed(better)[0] >= packed(now)[0]:
            return packed(now)[1:]
        now = better


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Where every token goes: (shard, bin, capacity, doc_id, text_hash, start, length, position).

    sequences() makes the texts of the bins from it. A document of more than the largest length is cut into pieces of that
    length and a rest. start counts tokens of the document, position those of
    the bin before the piece. Repeated rows are packed as often as they occur;
    a null doc_id is kept; documents without tokens (null or empty text) need
    no bin and have no row. Extra columns are ignored. An empty table gives an
    empty result. Bins never cross shards; a shard is packed in one task, and
    the number of shards follows the number of pieces. Ties between pieces of
    one length go by a hash of doc_id and text.
    """
    lengths = tuple(lengths)
    top = max(lengths)
    pieces = (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id", "text").alias("h"), token_count(F.col("text")).alias("t"))
        .filter("t > 0")
        .select("doc_id", "text_hash", "h", "t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("t") - 1, F.lit(top).cast("bigint"))).alias("start"))
        .select("doc_id", "text_hash", "h", "start", F.least(F.col("t") - F.col("start"), F.lit(top)).cast("int").alias("length"))
    )
    pieces = written(pieces, "pack-pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "h", "start"], ascending=[False, True, True], kind="stable")
        where, _, final = pack_lengths(pdf["length"].tolist(), lengths)
        pdf["bin"] = np.asarray(where, np.int64)
        pdf["capacity"] = np.asarray(final, np.int32)[where]
        pdf["position"] = (pdf.groupby("bin")["length"].cumsum() - pdf["length"]).astype("int32")
        return pdf[["shard", "bin", "capacity", "doc_id", "text_hash", "start", "length", "position"]]

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return (
        pieces.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(run, f"shard bigint, bin bigint, capacity int, doc_id {kind}, text_hash bigint, start bigint, length int, position int")
    )


def sequences(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(shard, bin, capacity, n_tokens, text): one row for each bin, its pieces' tokens in order, joined by blanks.

    docs are those that were packed; rows that agree in doc_id and text stand
    for each other. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h"), "text").filter("text <> ''").dropDuplicates(["__id", "__h"])
    own = packed.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__h")))
    tokens = F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), (F.col("start") + 1).cast("int"), F.col("length"))
    piece = F.struct("position", F.array_join(tokens, " ").alias("t"), "length")
    bins = own.groupBy("shard", "bin", "capacity").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.sum("length").alias("n_tokens"))
    return bins.select("shard", "bin", "capacity", "n_tokens", F.array_join("p.t", " ").alias("text"))


def check_bins(rows: Iterator[tuple[int, int]], capacity: int) -> bool:
    """Whether pieces (position, length) of one bin neither overlap nor leave its capacity."""
    end = 0
    for position, length in sorted(rows):
        if position != end:
            return False
        end += length
    return end <= capacity
