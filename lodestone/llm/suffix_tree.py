"""Language-model scores from a probabilistic suffix tree over bytes.

Every run of ORDER + 1 bytes of the corpus is counted; byte 255, which UTF-8
never uses, stands before the start of a text. A context of d bytes is kept if
its next-byte distribution diverges enough from that of its suffix, weighted by
how often it occurs (n * KL >= gain * ln N), or if a longer kept context ends
in it. Distributions are smoothed towards the one of the suffix, down to the
uniform one. A byte is scored in the state of the longest kept suffix of what
comes before it.

A gram of d + 1 bytes is a number: the context's bytes, oldest first, then the
next byte; masking it shortens the context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

ORDER = 5
START = b"\xff" * ORDER
#: Strength of smoothing, and of the divergence test.
BETA, GAIN = 2.0, 2.0
#: Grams of kept contexts that each worker may hold (16 bytes each); beyond that scoring joins.
MODEL_ROWS = 4_000_000
#: Grams sorted at a time when counting.
COUNT_AT_ONCE = 4_000_000


def mask(order: int) -> int:
    """Keeps the last `order` bytes of context and the next byte."""
    return (1 << 8 * (order + 1)) - 1


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, bytes of each text), text after text."""
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(START + r for r in raw), np.uint8)
    out = np.zeros(max(0, len(flat) - ORDER), np.uint64)
    for j in range(ORDER + 1):
        out = (out << np.uint64(8)) | flat[j : len(flat) - ORDER + j]
    # position p ends a gram unless it is among the start bytes of a later text
    keep = np.ones(len(out) + ORDER, bool)
    begin = np.concatenate([[0], np.cumsum(size[:-1] + ORDER)]).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    for j in range(ORDER):
        keep[begin + j] = False
    return out[keep[ORDER:]].view(np.int64), size


def _sum_sorted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    start = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
    return keys[start], np.add.reduceat(n, start)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, held_size, total = [], 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def merge():
        u, n = np.unique(np.concatenate(held), return_counts=True)
        both = np.concatenate([total[0], u]), np.concatenate([total[1], n])
        return _sum_sorted(*both) if len(both[0]) else both

    def out():
        for k in range(0, len(total[0]), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(total[0][k : k + 200_000]), pa.array(total[1][k : k + 200_000])], ["gram", "n"])

    for batch in batches:
        held.append(text_grams(batch.column(0).to_pylist())[0])
        held_size += len(held[-1])
        if held_size >= COUNT_AT_ONCE:
            total, held, held_size = merge(), [], 0
            if len(total[0]) >= COUNT_AT_ONCE:
                yield from out()
                total = (total[0][:0], total[1][:0])
    if held:
        total = merge()
    yield from out()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts."""
    return docs.select("text").filter("text <> ''").mapInArrow(_count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def grow(counts: DataFrame, beta: float = BETA, gain: float = GAIN) -> DataFrame:
    """(level, gram, p): next-byte probabilities of the kept contexts; level 0 is the empty one."""
    levels = [written(counts, f"pst-{ORDER}")]
    for d in range(ORDER - 1, -1, -1):
        levels.append(written(levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit(mask(d))).alias("gram")).agg(F.sum("n").alias("n")), f"pst-{d}"))
    levels.reverse()
    size = levels[0].agg(F.sum("n")).first()[0] or 0
    need = gain * float(np.log(max(2, size)))

    def contexts(d: int) -> DataFrame:
        return levels[d].groupBy(F.shiftright("gram", 8).alias("c")).agg(F.sum("n").alias("total"))

    keep: list[DataFrame] = [None] * (ORDER + 1)  # (c) kept at each level from 1
    for d in range(ORDER, 0, -1):
        short = mask(d - 1)
        own = levels[d].select("gram", "n", F.shiftright("gram", 8).alias("c"), F.col("gram").bitwiseAND(F.lit(short)).alias("g"))
        up = levels[d - 1].select(F.col("gram").alias("g"), F.col("n").alias("up_n"))
        # the suffix of a context: its last d - 1 bytes
        suffix = F.col("c").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))
        totals = contexts(d).withColumn("s", suffix).join(contexts(d - 1).toDF("s", "up_total"), "s").select("c", "total", "up_total")
        # a context seen too rarely can't reach the threshold: n * KL <= n * ln(1 / least p)
        kl = F.sum(F.col("n") * F.log(F.col("n") * F.col("up_total") / (F.col("total") * F.col("up_n"))))
        kept = own.join(up, "g").join(totals, "c").groupBy("c").agg(kl.alias("gain")).filter(F.col("gain") >= need).select("c")
        if d < ORDER:
            kept = kept.union(keep[d + 1].select(F.col("c").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("c"))).distinct()
        keep[d] = written(kept, f"pst-keep-{d}")
    root = levels[0].select(F.lit(0).alias("level"), "gram", ((F.col("n") + beta / 256) / (size + beta)).alias("p"))
    table, above = [written(root, "pst-p-0")], None
    for d in range(1, ORDER + 1):
        above = table[-1].select(F.col("gram").alias("g"), F.col("p").alias("up"))
        rows = levels[d].withColumn("c", F.shiftright("gram", 8)).join(keep[d], "c", "left_semi").join(contexts(d), "c").withColumn("g", F.col("gram").bitwiseAND(F.lit(mask(d - 1))))
        p = (F.col("n") + beta * F.col("up")) / (F.col("total") + beta)
        table.append(written(rows.join(above, "g").select(F.lit(d).alias("level"), "gram", p.alias("p")), f"pst-p-{d}"))
    out = table[0]
    for t in table[1:]:
        out = out.union(t)
    return out


def _scores(model):
    """Log-probabilities summed by text: the broadcast model has sorted grams and their logs for each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loss, length = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            at = batch.num_columns - 1
            for k in range(0, len(batch), 1 << 14):
                grams, size = text_grams(batch.column(at).slice(k, 1 << 14).to_pylist())
                length[k : k + len(size)] = size
                owner = np.repeat(np.arange(len(size), dtype=np.uint64), size)
                # sorted with the text in the low bits, equal grams are looked up once
                packed = np.sort((grams.view(np.uint64) << np.uint64(16)) | owner)
                key, owner = (packed >> np.uint64(16)).view(np.int64), (packed & np.uint64(0xFFFF)).astype(np.intp)
                start = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.zeros(0, int)
                unique = key[start]
                logs = np.full(len(unique), np.nan)
                left = np.arange(len(unique))
                for d in range(ORDER, -1, -1):
                    table, p = model.value[d]
                    if not len(table) or not len(left):
                        continue
                    want = unique[left] & mask(d)
                    place = np.minimum(np.searchsorted(table, want), len(table) - 1)
                    hit = table[place] == want
                    logs[left[hit]] = p[place[hit]]
                    left = left[~hit]
                each = np.repeat(logs, np.diff(np.r_[start, len(key)]))
                loss[k : k + len(size)] = np.bincount(owner, each, len(size))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(length), pa.array(loss)], [*batch.schema.names[:at], "n_bytes", "logp"])

    return run


def score(docs: DataFrame, beta: float = BETA, gain: float = GAIN, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(doc_id, n_bytes, bits_per_byte) for every row, by the tree grown from all of them.

    A null or empty text has 0 bytes and null bits. Rows that repeat are
    counted, and scored, as often as they occur. A null doc_id stays null.
    Extra columns are ignored; an empty table gives an empty result.
    """
    tree = grow(gram_counts(docs), beta, gain)
    own = docs.select("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    if tree.count() <= model_rows:
        model = docs.sparkSession.sparkContext.broadcast(_tables(tree))
        scored = own.mapInArrow(_scores(model), f"doc_id {kind}, n_bytes bigint, logp double")
    else:
        scored = _score_by_join(own, tree)
    bits = F.when(F.col("n_bytes") > 0, F.round(-F.col("logp") / F.col("n_bytes") / F.log(F.lit(2.0)), 6))
    return scored.select("doc_id", "n_bytes", bits.alias("bits_per_byte"))


def _tables(tree: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and log-probabilities of each level; the caller has checked the size."""
    t = tree.toArrow()
    own, gram, p = (t.column(c).to_numpy() for c in ("level", "gram", "p"))
    out = []
    for d in range(ORDER + 1):
        g, q = gram[own == d], p[own == d]
        order = np.argsort(g)
        out.append((g[order], np.log(q[order])))
    return out


def _score_by_join(own: DataFrame, tree: DataFrame) -> DataFrame:
    """The same scores when no worker can hold the tree: grams of each row are joined with it level by level."""
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = written(own.withColumn("row", F.monotonically_increasing_id()), "pst-rows")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 100):
                grams, size = text_grams(batch.column(1).slice(k, 100).to_pylist())
                row = np.repeat(batch.column(0).slice(k, 100).to_numpy(), size)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(grams)], ["row", "gram"])

    left = rows.select("row", "text").mapInArrow(explode, "row bigint, gram bigint").groupBy("row", "gram").agg(F.count("*").alias("n"))
    # the state of each distinct gram is found first, so that the long side is joined once
    state = left.select("gram").distinct()
    for d in range(ORDER + 1):
        t = tree.filter(F.col("level") == d).select(F.col("gram").alias("g"), F.col("p").alias(f"p{d}"))
        state = state.join(t, F.col("gram").bitwiseAND(F.lit(mask(d))) == F.col("g"), "left").drop("g")
    state = state.select("gram", F.log(F.coalesce(*[F.col(f"p{d}") for d in range(ORDER, -1, -1)])).alias("logp"))
    total = left.join(state, "gram").groupBy("row").agg(F.sum("n").alias("b"), F.sum(F.col("n") * F.col("logp")).alias("logp"))
    out = rows.select("row", "doc_id").join(total, "row", "left")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), F.coalesce("b", F.lit(0)).alias("n_bytes"), F.coalesce("logp", F.lit(0.0)).alias("logp"))
