"""Exact top-k search by block-at-a-time pruning.

Documents are kept as forward rows: the terms they share with the queries and
their frequencies. Each task sorts its rows by document and cuts them into
blocks of consecutive documents. For every term a block knows its largest
contribution; a query visits the blocks in order of the sum of these maxima,
scores a block through its forward index, and stops when the next bound is
below the k-th score found. The tasks' lists are merged by rank.

Scores are BM25 with every query term counted as often as it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from .storage import by_key, by_number, written
from .words import WordHashes, word_hashes

K1, B = 1.2, 0.75
#: Documents in a block.
BLOCK = 512
#: Queries answered by one pass over the forward rows; more queries make more passes.
QUERY_CHUNK = 2000
#: Terms of all queries (8 bytes each) that every task may hold while it indexes; beyond that all terms are indexed.
MOST_TERMS = 1_000_000


def _forward(known: np.ndarray | None):
    """(id, len, terms, tfs) for each text: hashes of its terms in order, and how often it has them; only those known, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            length, flat, tfs, at = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                h = word_hashes(text, cache).view(np.int64)
                length.append(len(h))
                t, n = np.unique(h, return_counts=True)
                if known is not None and len(t):
                    place = np.minimum(np.searchsorted(known, t), len(known) - 1) if len(known) else np.zeros(len(t), int)
                    keep = known[place] == t if len(known) else np.zeros(len(t), bool)
                    t, n = t[keep], n[keep]
                flat.append(t)
                tfs.append(n.astype(np.int32))
                at.append(at[-1] + len(t))
            offsets = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(length, pa.int32()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tfs) if tfs else np.zeros(0, np.int32))),
                ],
                ["id", "len", "terms", "tfs"],
            )

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cache = WordHashes()
        found = [word_hashes(t, cache).view(np.int64) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64))], ["term"])


class Block:
    """Forward index of consecutive documents, with the largest contribution of each term."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, idf: np.ndarray, mean: float):
        self.ids = ids
        self.at = np.repeat(np.arange(len(ids)), counts)
        self.terms = terms
        norm = K1 * (1 - B + B * length[self.at] / mean)
        self.impact = idf[terms] * (tfs * (K1 + 1)) / (tfs + norm)
        self.most = np.zeros(len(idf))
        np.maximum.at(self.most, terms, self.impact)

    def scores(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.impact * weight[self.terms], len(self.ids))


def search_blocks(blocks: list[Block], query: tuple[np.ndarray, np.ndarray], k: int, terms: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, blocks scored) of the k best documents; equal scores, to six digits, by id."""
    qt, qn = query
    weight = np.zeros(terms)
    weight[qt] = qn
    bound = np.array([b.most[qt] @ qn for b in blocks])
    ids, best, used = np.zeros(0, np.int64), np.zeros(0), 0
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] <= 0 or len(ids) == k and bound[i] < best[-1] - 1e-6:
            break
        s = np.round(blocks[i].scores(weight), 6)
        hit = np.nonzero(s > 0)[0]
        if len(ids) == k:
            hit = hit[s[hit] >= best[-1]]
        used += 1
        ids, best = np.concatenate([ids, blocks[i].ids[hit]]), np.concatenate([best, s[hit]])
        order = np.lexsort([ids, -best])[:k]
        ids, best = ids[order], best[order]
    return ids, best, used


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "item_id", query_text: str = "text", block: int = BLOCK, chunk: int = QUERY_CHUNK) -> DataFrame:
    """(item_id, doc_id, score, rank): for each query its k best documents with a score above 0.

    Every row of queries is a query; rows that repeat an id each have their own
    list only if their text differs too. Ties, at six digits, go to the lower
    doc_id. Documents with a null doc_id, and queries with a null id, are left
    out; a null or empty text has no terms. Documents that repeat a doc_id are
    scored row by row. Both ids may be of any type that can be ordered. Extra
    columns are ignored. If either table is empty, so is the result.
    """
    asked = written(queries.select(F.col(query_id).alias("q"), F.col(query_text).alias("t")).filter("q IS NOT NULL AND t IS NOT NULL").distinct(), "queries")
    docs, keys = by_number(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    # one forward index for all queries, of their terms alone if these are few enough to be sent to every task
    terms = written(asked.select("t").mapInArrow(_query_terms, "term bigint").distinct(), "query-terms")
    known = np.sort(terms.toArrow().column(0).to_numpy()) if terms.count() <= MOST_TERMS else None
    forward = written(docs.filter("id IS NOT NULL").mapInArrow(_forward(known), "id bigint, len int, terms array<bigint>, tfs array<int>"), "forward")
    size = forward.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    often = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    often = written(often.join(terms, "term", "left_semi"), "term-counts")
    parts, total = [], asked.count()
    for number in range(max(1, -(-total // chunk))):
        # a bounded number of queries is in memory at a time
        mine = asked if total <= chunk else asked.filter(F.pmod(F.xxhash64("q", "t"), F.lit(-(-total // chunk))) == number)
        parts.append(_search(forward, often, sorted((r["q"], r["t"]) for r in mine.collect()), size["n"], size["mean"], k, block, asked.schema["q"].dataType).withColumn("n", F.col("n") + F.lit(number << 32)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    order = Window.partitionBy("q", "n").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return by_key(ranked.select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank"), ["doc_id"], keys)


def _search(forward: DataFrame, often: DataFrame, rows: list[tuple], docs: int, mean: float | None, k: int, block: int, kind: T.DataType) -> DataFrame:
    """(q, n, id, score): k documents at least for each query of each task; rows are at most a chunk of queries."""
    cache, asked = WordHashes(), []
    for _, text in rows:
        t, n = np.unique(word_hashes(text, cache).view(np.int64), return_counts=True)
        asked.append((t, n.astype(float)))
    terms = np.unique(np.concatenate([t for t, _ in asked])) if asked else np.zeros(0, np.int64)
    asked = [(np.searchsorted(terms, t), n) for t, n in asked]
    wanted = docs_with(often, terms)
    df = np.array([wanted.get(t, 0) for t in terms.tolist()], float)
    idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))
    mean = max(mean or 1.0, 1e-9)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = []
        held: list[pa.RecordBatch] = []

        def close() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            for start in range(0, len(t), block):
                part = t.slice(start, block).combine_chunks()
                tc, fc = part.column(2).combine_chunks(), part.column(3).combine_chunks()
                counts, flat, tfs = tc.value_lengths().to_numpy(), tc.flatten().to_numpy(), fc.flatten().to_numpy()
                place = np.minimum(np.searchsorted(terms, flat), max(len(terms) - 1, 0))
                keep = terms[place] == flat if len(terms) else np.zeros(len(flat), bool)
                if not keep.all():
                    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
                blocks.append(Block(part.column(0).to_numpy(), part.column(1).to_numpy(), counts, place[keep], tfs[keep], idf, mean))
            held.clear()

        def answers() -> Iterator[pa.RecordBatch]:
            q, n, d, s = [], [], [], []
            for i, query in enumerate(asked):
                if not len(query[0]):
                    continue
                got, score, _ = search_blocks(blocks, query, k, len(terms))
                q += [i] * len(got)
                d.append(got)
                s.append(score)
            blocks.clear()
            if d:
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(np.concatenate(d)), pa.array(np.concatenate(s))], ["n", "id", "score"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 4 * block:
                close()
            if len(blocks) >= 64:
                yield from answers()
        if held:
            close()
        if blocks:
            yield from answers()

    ordered = forward.repartitionByRange("id").sortWithinPartitions("id", "len")
    found = ordered.mapInArrow(search, "n int, id bigint, score double")
    names = forward.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], T.StructType([T.StructField("n", T.IntegerType()), T.StructField("q", kind)]))
    return found.join(F.broadcast(names), "n").select("q", "n", "id", "score")


def docs_with(often: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """term -> documents with it, for a chunk's terms."""
    own = often.sparkSession.createDataFrame(pa.table({"term": terms}))
    return {r["term"]: r["n"] for r in often.join(F.broadcast(own), "term").collect()}
