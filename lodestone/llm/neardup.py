"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets a signature, the concatenated signs of its
projections on that pass's random directions, after the table's mean has been
subtracted. Vectors are sorted by signature,
each is compared with the next few in that order, and pairs that are similar
enough are united over all passes.

The number of passes is measured: for a sample of rows, a few signatures of the
whole table tell how many bits narrow it down to a window of unlike rows, and
passes are added until a partner at the threshold agrees on those bits in one
of them with a mean probability of recall. It is at least what vectors spread
evenly about the origin need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, least_labels
from .storage import by_key, by_number, written

BITS = 62
#: Vectors in a block of a cluster whose links are counted.
BLOCK = 2048
#: Rows of the sample, about, signatures that measure the table, and partners drawn for each row of the sample.
SAMPLE, PILOTS, PARTNERS = 256, 4, 8


def passes_needed(rows: int, threshold: float, window: int, recall: float) -> int:
    same = 1 - math.acos(threshold) / math.pi
    hit = same ** max(1.0, math.log2(max(2, rows) / window))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - min(hit, 0.9))))


def chance_of_bit(x: np.ndarray, mean: np.ndarray, threshold: float) -> np.ndarray:
    """For each unit vector, the chance that it agrees with a partner at the threshold on one bit, once both are centred."""
    rng, own = np.random.default_rng(len(x)), x - mean
    chance = np.zeros(len(x))
    for _ in range(PARTNERS):
        u = rng.standard_normal(x.shape)
        u -= (u * x).sum(axis=1, keepdims=True) * x
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        other = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * u - mean
        cos = (own * other).sum(axis=1) / np.maximum(np.linalg.norm(own, axis=1) * np.linalg.norm(other, axis=1), 1e-12)
        chance += 1 - np.arccos(np.clip(cos, -1, 1)) / math.pi
    return chance / PARTNERS


def passes_for(hit: np.ndarray, recall: float) -> int:
    """Passes for a mean recall, from each row's chance in one pass."""
    low, high = 0, 1
    while (1 - (1 - hit) ** high).mean() < recall and high < 1 << 30:
        low, high = high, high * 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if (1 - (1 - hit) ** mid).mean() >= recall else (mid, high)
    return high


def unit(part: pd.DataFrame) -> np.ndarray:
    """Vectors of length 1, whatever the size of their entries."""
    x = np.stack(part["v"].to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def table_means(usable: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the unit vectors of each dimension."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in frames:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                held[dim] = held.get(dim, 0.0) + np.append(unit(part).sum(axis=0, dtype=np.float64), len(part))
        for dim, total in held.items():
            yield pd.DataFrame({"dim": dim, "k": np.arange(dim + 1), "s": total})

    rows = usable.select("v").mapInPandas(sums, "dim int, k int, s double").groupBy("dim", "k").agg(F.sum("s").alias("s")).toPandas()
    totals = {int(d): g.sort_values("k")["s"].to_numpy() for d, g in rows.groupby("dim")}
    return {d: (t[:-1] / t[-1]).astype(np.float32) for d, t in totals.items()}


def passes_measured(usable: DataFrame, means: dict[int, np.ndarray], rows: int, threshold: float, window: int, recall: float, seed: int) -> int:
    """The passes that the dimension which needs most of them needs, by the sizes of signature prefixes over the whole table."""
    drawn = usable.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // SAMPLE))) == 0).toPandas()
    sample = {int(d): unit(g) for d, g in drawn.groupby(drawn["v"].map(len))} if len(drawn) else {}

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(dim, pilot, row of the sample, bits in common, unlike rows)"""
        held: dict[tuple[int, int], np.ndarray] = {}
        for pdf in frames:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                if dim not in sample:
                    continue
                own, all_ = sample[dim], unit(part)
                for k in range(0, len(all_), 2000):
                    x = all_[k : k + 2000]
                    unlike = x @ own.T < threshold
                    for q in range(PILOTS):
                        differ = signatures(x - means[dim], q, seed)[:, None] ^ signatures(own - means[dim], q, seed)[None, :]
                        common = BITS - np.frexp(differ.astype(np.float64))[1]
                        at = (np.arange(len(own))[None, :] * (BITS + 1) + np.maximum(common, 0))[unlike]
                        held[dim, q] = held.get((dim, q), 0) + np.bincount(at, minlength=len(own) * (BITS + 1))
        for (dim, q), n in held.items():
            some = np.nonzero(n)[0]
            yield pd.DataFrame({"dim": dim, "q": q, "i": some // (BITS + 1), "bits": some % (BITS + 1), "n": n[some]})

    found = usable.select("v").mapInPandas(prefixes, "dim int, q int, i int, bits int, n bigint").groupBy("dim", "q", "i", "bits").agg(F.sum("n").alias("n")).toPandas()
    most = 1
    for dim, own in sample.items():
        mine = found[found["dim"] == dim]
        n = np.zeros((PILOTS, len(own), BITS + 1), np.int64)
        n[mine["q"], mine["i"], mine["bits"]] = mine["n"]
        left = n[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]  # unlike rows that share so many bits or more
        need = (left > window).sum(axis=2)
        hit = (chance_of_bit(own, means[dim], threshold)[None, :] ** need).mean(axis=0)
        most = max(most, passes_for(hit, recall))
    return most


def signatures(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, number]).standard_normal((x.shape[1], BITS)).astype(np.float32)
    return ((x @ planes > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))).astype(np.int64)


def close_pairs(x: np.ndarray, rank: np.ndarray, window: int, threshold: float, fresh: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j), i < j, at most window apart in rank and similar, j >= fresh."""
    a, b = [], []
    for d in range(1, min(window, len(x) - 1) + 1):
        start = max(0, fresh - d)
        end = len(x) - d
        if start >= end:
            continue
        ok = np.einsum("ij,ij->i", x[start:end], x[start + d :]) >= threshold
        ok &= rank[start + d :] - rank[start:end] <= window
        i = np.nonzero(ok)[0] + start
        a.append(i)
        b.append(i + d)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    window: int = 128,
    recall: float = 0.99,
    seed: int = 11,
    passes: int | None = None,
) -> DataFrame:
    """(vec_id, cluster_id, keep, links) for every row.

    cluster_id is the least id that a row is united with, directly or through
    others; keep marks the rows where it is their own. links is the number of
    different vectors of the cluster that are similar to this one: rows with
    equal vectors are copies, one class in the passes, and count as one. It is
    counted over the whole cluster in blocks, not only within windows. Rows
    with a null id, a null, empty or zero vector, or one with nulls, NaN or
    infinities are united with none; neither are vectors of different
    dimensions. A null id has a null cluster and is kept. Rows that repeat an id
    stay and share its cluster; links of their different vectors are added up.
    Ids may be of any type that can be ordered. Extra columns are ignored. An
    empty table gives an empty result.
    """
    src, keys = by_number(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")), "id")
    good = F.col("id").isNotNull() & (F.size("v") > 0) & F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)) & F.exists("v", lambda e: e != 0)
    hashed = src.filter(good).withColumn("vh", F.xxhash64("v"))
    usable = written(hashed.groupBy("vh").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v")), "vectors")
    copies = written(hashed.select("vh", "id").distinct().join(usable.select("vh", F.col("id").alias("rep")), "vh").select("id", "rep"), "vector-copies")
    sizes = [(r[0], r[1]) for r in usable.groupBy(F.size("v")).count().collect()]  # one row for each dimension
    most = max([n for _, n in sizes], default=0)
    means = table_means(usable)
    count = passes if passes is not None else max(passes_needed(most, threshold, window, recall), passes_measured(usable, means, most, threshold, window, recall, seed))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                x = unit(part)
                for p in range(count):
                    yield pd.DataFrame({"dim": dim, "pass": p, "sig": signatures(x - means[dim], p, seed), "id": part["id"].to_numpy(), "v": list(x)})

    sorted_ = (
        usable.mapInPandas(project, "dim int, pass int, sig bigint, id bigint, v array<float>")
        .repartitionByRange("dim", "pass", "sig", "id")
        .sortWithinPartitions("dim", "pass", "sig", "id")
    )
    sorted_ = sorted_.withColumn("part", F.spark_partition_id())

    def slide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs inside a partition, and its first and last rows of each pass with their rank (kind 1)."""
        key, x, ids, seen, part = None, None, None, 0, 0

        def edges(key, a, b):
            if len(a):
                node, root = least_labels(a, b)
                far = node != root
                a, b = root[far], node[far]
            return pd.DataFrame({"kind": 0, "dim": key[0], "pass": key[1], "part": part, "rank": np.zeros(len(a), np.int64), "a": a, "b": b, "v": pd.Series([None] * len(a), dtype=object)})

        def rows(key, kind, rank, ids, x):
            return pd.DataFrame({"kind": kind, "dim": key[0], "pass": key[1], "part": part, "rank": rank, "a": ids, "b": ids, "v": list(x)})

        def tail(key):
            # the last rows, unless the head has them; kind 2 tells how many rows there are
            first = max(window, seen - window)
            n = max(0, seen - first)
            if n:
                yield rows(key, 1, np.arange(first, seen), ids[-n:], x[-n:])
            yield rows(key, 2, np.array([seen]), ids[:1], x[:1])

        for pdf in frames:
            for k, g in pdf.groupby(["dim", "pass"], sort=True):
                part = int(g["part"].iloc[0])
                if k != key:
                    if key is not None:
                        yield from tail(key)
                    key, x, ids, seen = k, np.zeros((0, k[0]), np.float32), np.zeros(0, np.int64), 0
                new, new_ids = np.stack(g["v"].to_numpy()).astype(np.float32), g["id"].to_numpy()
                head = max(0, min(window - seen, len(new)))
                if head:
                    yield rows(k, 1, np.arange(seen, seen + head), new_ids[:head], new[:head])
                fresh = len(x)
                x, ids, seen = np.concatenate([x, new]), np.concatenate([ids, new_ids]), seen + len(new)
                i, j = close_pairs(x, np.arange(len(x)), window, threshold, fresh)
                yield edges(k, ids[i], ids[j])
                x, ids = x[-window:], ids[-window:]
        if key is not None:
            yield from tail(key)

    found = written(sorted_.mapInPandas(slide, "kind int, dim int, pass int, part int, rank bigint, a bigint, b bigint, v array<float>"), "projected")

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs that straddle partitions of one pass."""
        sizes = pdf[pdf["kind"] == 2].sort_values("part")
        before = dict(zip(sizes["part"], sizes["rank"].cumsum() - sizes["rank"]))
        own = pdf[pdf["kind"] == 1]
        rank = own["rank"].to_numpy() + own["part"].map(before).to_numpy()
        order = np.argsort(rank, kind="stable")
        rank, ids, part = rank[order], own["a"].to_numpy()[order], own["part"].to_numpy()[order]
        if len(np.unique(part)) < 2:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        x = np.stack(own["v"].to_numpy()[order]).astype(np.float32)
        i, j = close_pairs(x, rank, window, threshold)
        return pd.DataFrame({"a": ids[i], "b": ids[j]})

    straddling = found.filter("kind > 0").groupBy("dim", "pass").applyInPandas(borders, "a bigint, b bigint")
    # a row that repeats an id with another vector unites the two
    roots = components(found.filter("kind = 0").select("a", "b").union(straddling).union(copies.select("id", "rep")))
    links = _links(usable.select("id", "v").join(roots, F.col("id") == F.col("node"), "left").select(F.coalesce("root", "id").alias("root"), "id", "v"), threshold)
    linked = written(copies.join(links.select(F.col("id").alias("rep"), "links"), "rep").groupBy("id").agg(F.sum("links").alias("links")), "vector-links")
    cluster = F.coalesce(F.col("root"), F.col("id"))
    out = (
        src.select("id")
        .join(roots, F.col("id") == F.col("node"), "left")
        .join(linked.withColumnRenamed("id", "linked"), F.col("id") == F.col("linked"), "left")
        .select(F.col("id").alias("vec_id"), cluster.alias("cluster_id"), F.coalesce(cluster == F.col("id"), F.lit(True)).alias("keep"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    )
    return by_key(out, ["vec_id", "cluster_id"], keys)


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): for the vectors (root, id, v) of each cluster the number of others of it that are similar.

    A large cluster is cut into blocks of about BLOCK vectors; each pair of blocks is
    one step of a task, and counts, not pairs, come out.
    """
    members = written(members, "cluster-vectors")
    blocks = members.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("root").alias("r"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = members.join(blocks, F.col("root") == F.col("r")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def solve(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            ids, out = [], []
            step = pdf[["root", "i", "j"]].to_numpy()
            start = np.nonzero(np.r_[True, (step[1:] != step[:-1]).any(axis=1)])[0]
            own = pdf["own"].to_numpy()
            for a, b in zip(start.tolist(), np.r_[start[1:], len(pdf)].tolist()):
                part = pdf.iloc[a:b]
                i, j = step[a, 1], step[a, 2]
                for _, rows in part.groupby(part["v"].map(len)):
                    x, at = unit(rows), own[rows.index]
                    left = at == i
                    if i == j:
                        hit = (x @ x.T >= threshold).sum(axis=1) - 1
                        ids.append(rows["id"].to_numpy())
                        out.append(hit)
                    else:
                        near = x[left] @ x[~left].T >= threshold
                        ids += [rows["id"].to_numpy()[left], rows["id"].to_numpy()[~left]]
                        out += [near.sum(axis=1), near.sum(axis=0)]
            yield pd.DataFrame({"id": np.concatenate(ids), "n": np.concatenate(out).astype(np.int64)})

        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = held[["root", "i", "j"]].iloc[-1].to_numpy()
            open_ = (held[["root", "i", "j"]].to_numpy() == last).all(axis=1)
            if not open_.all():
                yield from solve(held[~open_].reset_index(drop=True))
                held = held[open_].reset_index(drop=True)
        if held is not None and len(held):
            yield from solve(held)

    ordered = paired.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = ordered.mapInPandas(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("links"))
    return found
