"""Removal of repeated passages of whole lines.

Chunks between boundaries that rolling hashes choose were tried first: a
passage of two to four lines then seldom is a chunk of its own, as a boundary
falls by chance, and its first and last lines are glued to unlike neighbours.
So each line is a possible boundary here.

A passage is at least two lines with RUN_WORDS words, or one line with
LONG_WORDS. From each line the shortest passage that starts there and the
shortest one that ends there are hashed; any longer passage is covered by the
short ones inside it, whatever stands around it. So exactly the lines of
passages that came before go, after the bytes were compared with those of the
first occurrence, which stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from .storage import small_side, written

#: A line of so many words may go alone.
LONG_WORDS = 40
#: Words that a passage of several lines must have to go.
RUN_WORDS = 25
#: Characters of passages that a Python worker gathers before it hands them on.
BATCH_CHARS = 4 << 20


def chunks(text: str) -> list[tuple[int, int, int]]:
    """(line, line after it, words) of each line of a text. Lines end at line feeds."""
    return [(k, k + 1, len(x.split())) for k, x in enumerate(text.split("\n"))]


def passages(count: list[int]) -> list[tuple[int, int]]:
    """(first line, line after the last) of the shortest passages of lines with so many words, by place.

    In a run of lines without words only those next to a line with words start
    or end a passage, so a long run is not hashed again from each of its lines.
    """
    n = len(count)
    before = [0]
    for c in count:
        before.append(before[-1] + c)
    out = {(k, k + 1) for k, c in enumerate(count) if c >= LONG_WORDS}
    end = 0
    for start in range(n):
        end = max(end, start + 2)
        while end <= n and before[end] - before[start] < RUN_WORDS:
            end += 1
        if end > n:
            break
        if count[start] or count[start + 1]:
            out.add((start, end))
    start = 0
    for end in range(2, n + 1):
        while start + 1 <= end - 2 and before[end] - before[start + 1] >= RUN_WORDS:
            start += 1
        if before[end] - before[start] >= RUN_WORDS and (count[end - 1] or count[end - 2]):
            out.add((start, end))
    return sorted(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, first, end, h = [], [], [], []
        for r, text in enumerate(batch.column(2).to_pylist()):
            lines = text.split("\n")
            digests = b"".join(xxhash.xxh3_64_digest(x.encode("utf-8", "surrogatepass")) for x in lines)
            for a, b in passages([len(x.split()) for x in lines]):
                d = xxhash.xxh3_64_intdigest(digests[8 * a : 8 * b])
                row.append(r)
                first.append(a)
                end.append(b)
                h.append(d - ((d >> 63) << 64))
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(h, pa.int64())], ["id", "th", "first", "end", "h"]
        )


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of candidate passages, from rows (id, th, text, [(h, first, end)]): each once for a batch, with all its places there."""
    for batch in batches:
        ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        held: dict[tuple[int, str], list[tuple]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            places = [sorted(p) for p in held.values()]
            at = pa.array(np.cumsum([0] + [len(p) for p in places]), pa.int32())
            flat = [x for p in places for x in p]
            row = pa.array([x[4] for x in flat], pa.int32())
            lists = [batch.column(0).take(row), batch.column(1).take(row), pa.array([x[3] for x in flat], pa.int32()), pa.array([x[5] for x in flat], pa.int32())]
            first = pa.array([p[0][4] for p in places], pa.int32())
            h, data = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), batch.column(0).take(first), batch.column(1).take(first), pa.array([p[0][3] for p in places], pa.int32()), pa.array(data, pa.string()), *[pa.ListArray.from_arrays(at, x) for x in lists]],
                ["h", "id", "th", "first", "data", "ids", "ths", "firsts", "ends"],
            )

        for r, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            lines = text.split("\n")
            for w in wanted:
                key = w["h"], "\n".join(lines[w["first"] : w["end"]])
                if key not in held:
                    size += len(key[1])
                # sorted by place, a null doc_id last
                held.setdefault(key, []).append((ids[r] is None, ids[r] if ids[r] is not None else 0, ths[r], w["first"], r, w["end"]))
            if size > BATCH_CHARS:
                yield out()
                held, size = {}, 0
        if held:
            yield out()


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of passages whose bytes came before, not overlapping the first occurrence: rows sorted by hash, then by their first place."""
    now, seen = None, {}
    for batch in batches:
        lists = batch.columns[5:]
        flat = [c.flatten() for c in lists]
        ids, ths, firsts, ends = (c.to_pylist() for c in flat)
        size = lists[0].value_lengths().to_pylist()
        out, at = [], 0
        for h, data, n in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), size):
            if h != now:
                now, seen = h, {}
            i, th, end = seen.setdefault(data, (ids[at], ths[at], ends[at]))
            out += [k for k in range(at, at + n) if ids[k] != i or ths[k] != th or firsts[k] >= end]
            at += n
        take = pa.array(out, pa.int32())
        yield pa.RecordBatch.from_arrays([c.take(take) for c in flat], ["id", "th", "first", "end"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the passages listed: the last column, which is dropped, follows the text."""
    for batch in batches:
        texts, gone = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, removed = [], []
        for text, drop in zip(texts, gone):
            n = 0
            if drop:
                lines, kept, at = text.split("\n"), [], 0
                for a, b in sorted((d["first"], d["end"]) for d in drop):
                    kept += lines[at:a]
                    at = max(at, b)
                kept += lines[at:]
                n = len(lines) - len(kept)
                text = "\n".join(kept)
            out.append(text)
            removed.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(removed, pa.int32()), *batch.columns[2:]], ["text", "removed_lines", *batch.schema.names[2:]])


def removals(docs: DataFrame) -> DataFrame:
    """(id, th, passages): for each text, named by doc_id and hash, the passages to remove."""
    own = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text").filter("text <> ''")
    kind = own.schema["id"].dataType.simpleString()
    cut = written(own.mapInArrow(_cut, f"id {kind}, th bigint, first int, end int, h bigint"), "line-passages")
    often = cut.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    again = cut.join(often, "h")
    lists = written(again.groupBy(F.col("id").alias("w_id"), F.col("th").alias("w_th")).agg(F.collect_set(F.struct("h", "first", "end")).alias("wanted")), "line-wanted")
    match = F.col("th").eqNullSafe(F.col("w_th")) & F.col("id").eqNullSafe(F.col("w_id"))
    there = own.join(small_side(lists), match).select("id", "th", "text", "wanted")
    # rows that agree in doc_id and text give the same places twice; _repeats takes them for one
    # a passage that a third of all documents have comes once for each batch
    data = there.mapInArrow(_bytes, f"h bigint, id {kind}, th bigint, first int, data string, ids array<{kind}>, ths array<bigint>, firsts array<int>, ends array<int>")
    repeats = data.repartition("h").sortWithinPartitions("h", F.col("id").asc_nulls_last(), "th", "first").mapInArrow(_repeats, f"id {kind}, th bigint, first int, end int")
    return written(repeats.groupBy("id", "th").agg(F.collect_set(F.struct("first", "end")).alias("passages")), "line-removals")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with repeated passages removed from text, and removed_lines.

    The first occurrence, by doc_id (null last), text and position, stays, and
    so does one that overlaps it in the same text. Rows
    that agree in doc_id and text are one place: each keeps what the other
    keeps. A null text stays null and an empty one empty, with 0 removed lines.
    All other columns are carried along, whatever their names; if there is one
    named removed_lines, it is replaced. An empty table gives an empty result.
    """
    gone = removals(docs)
    names = [c for c in docs.columns if c not in ("text", "removed_lines")]
    # other columns go along in one, whatever their names
    own = docs.select(F.xxhash64("text").alias("th"), F.col("doc_id").alias("id"), "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("rest"))
    side = small_side(gone.toDF("r_id", "r_th", "passages"))
    joined = own.join(side, F.col("th").eqNullSafe(F.col("r_th")) & F.col("id").eqNullSafe(F.col("r_id")), "left").select("text", "passages", "rest")
    out = joined.mapInArrow(_rebuild, T.StructType([T.StructField("text", T.StringType()), T.StructField("removed_lines", T.IntegerType()), joined.schema["rest"]]))
    return out.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns if c != "removed_lines"], "removed_lines")
