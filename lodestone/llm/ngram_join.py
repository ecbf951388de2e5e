"""Exact Jaccard join of documents by word n-grams.

Every pair of different texts with a similarity of at least the threshold is
found; nothing is thinned, capped or sampled. Texts with the same set of
n-grams are copies: they are one class, named by the set's hash, and only
classes are joined.

1. n-grams that no other document has can't be in an overlap. Each task sorts
   its n-grams and sends each of them once, so one that a third of all
   documents share travels once for each task, not once for each document. A
   document of which fewer than threshold * size n-grams occur elsewhere has no
   partner and goes.
2. What is left is signed: n-grams are put in one order for all documents,
   rarest first, and the first size - ceil(threshold * size) + 1 of them are
   the document's signatures. Two sets with so large an overlap as the
   threshold asks for share one. A signature only pairs sets of like size, and
   only if enough n-grams follow it on both sides for the overlap.
3. Near copies share most signatures, and each would make the same pair again.
   So sets that are probably alike (their least n-gram in one of a few orders is
   the same) form blocks of bounded size. A set travels to its block once, and
   its pairs there are found and verified in one task. Through signatures go
   only pairs of different blocks.
4. Each candidate pair is verified on the full sets.

PartEnum's signatures (subsets of parts of the domain) were tried first. At a
similarity of 0.5 the sets may differ in two thirds of their size, so that a
signature has one or two n-grams and often none; they were made selective by
thinning the domain, which loses pairs. The README has figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .components import components
from .storage import small_side, text_bytes, written
from .words import WordHashes, grams, mix, word_hashes

#: n-grams that a task sorts at a time; documents sorted together have a 16-bit number.
FLUSH, FLUSH_DOCS = 2_000_000, 65_000
#: Of an n-gram that several documents of the task have, so no number is sent.
_SEVERAL = 0xFFFF
#: Input bytes for each part of the domain of n-grams; the number of parts only bounds what one step holds.
PART_BYTES, LEAST_PARTS, MOST_PARTS = 2 << 20, 16, 1 << 17
#: Most n-grams of the sets that one task compares with each other at a time.
BLOCK_GRAMS = 2_000_000
_U = np.uint64
#: Odd factors, each of which puts n-grams in another order.
_ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def ngram_set(text: str | None, n: int, cache: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct n-grams; a shorter text is one n-gram, an empty one has none."""
    return np.unique(grams(word_hashes(text, cache), n))


def set_hash(s: np.ndarray) -> int:
    """A hash of a set of hashes, by which copies are known."""
    both = np.array([mix(s).sum(), len(s)], np.uint64) * np.array([1, 0x9E3779B97F4A7C15], np.uint64)
    return int(mix(both.sum(keepdims=True)).view(np.int64)[0])


def _lists(kind: pa.DataType, items: list, number: int) -> pa.Array:
    """A column of nulls but for the first row, a list."""
    return pa.array([items] + [None] * (number - 1), pa.list_(kind))


def _postings(n: int, parts: int, kind: pa.DataType):
    """A function over rows (id, th, text): for each part of the domain the n-grams of a number of documents, and one row about these documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, number = WordHashes(), 0
        task = TaskContext.get().partitionId()
        sets: list[np.ndarray] = []
        known: dict[int, int] = {}
        ids: list = []
        ths: list[int] = []
        at: list[int] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, total
            tag = (task << 24) + number
            number += 1
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            g, own = flat[order], np.repeat(np.arange(len(sets), dtype=np.uint16), size)[order]
            start = np.nonzero(np.r_[True, g[1:] != g[:-1]])[0]
            count = np.diff(np.r_[start, len(g)])
            shared = np.bincount(own[np.repeat(count > 1, count)], minlength=len(sets))
            g, own = g[start], np.where(count > 1, np.uint16(_SEVERAL), own[start])
            part = ((g >> _U(32)) * _U(parts)) >> _U(32)
            cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64)).tolist()
            low = g.astype(np.uint32)
            about = {"ids": _lists(kind, ids, 1), "ths": _lists(pa.int64(), ths, 1), "at": _lists(pa.int32(), at, 1), "hs": _lists(pa.int64(), list(known), 1), "sizes": _lists(pa.int32(), size.tolist(), 1), "shared": _lists(pa.int32(), shared.tolist(), 1)}
            yield pa.RecordBatch.from_arrays([pa.array([tag % parts], pa.int32()), pa.array([tag], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *about.values()], ["part", "tag", "low", "own", *about])
            some = [p for p in range(parts) if cut[p] < cut[p + 1]]
            for k in range(0, len(some), 32):
                mine = some[k : k + 32]
                columns = [pa.array(mine, pa.int32()), pa.array([tag] * len(mine), pa.int64())]
                columns += [pa.array([x[cut[p] : cut[p + 1]].tobytes() for p in mine], pa.binary()) for x in (low, own)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(mine), a.type) for a in about.values()]], ["part", "tag", "low", "own", *about])
            for x in (sets, known, ids, ths, at):
                x.clear()
            total = 0

        for batch in batches:
            for i, th, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = ngram_set(text, n, cache)
                if not len(s):
                    continue
                h = set_hash(s)
                if h not in known:
                    known[h] = len(sets)
                    sets.append(s)
                    total += len(s)
                ids.append(i)
                ths.append(th)
                at.append(known[h])
                if total >= FLUSH or len(sets) >= FLUSH_DOCS or len(ids) >= 4 * FLUSH_DOCS:
                    yield from flush()
        if sets:
            yield from flush()

    return run


def _elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _postings sorted by part: the numbers of the documents of each tag, once for each n-gram that another tag has too."""
    part, low, own, tags = None, [], [], []
    found: dict[int, list[np.ndarray]] = {}
    held, rest = 0, None

    def close() -> None:
        nonlocal held
        size = [len(x) for x in low]
        f, o = np.concatenate(low), np.concatenate(own)
        order = np.argsort(f, kind="stable")
        f, o, source = f[order], o[order], np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
        start = np.nonzero(np.r_[True, f[1:] != f[:-1]])[0]
        count = np.diff(np.r_[start, len(f)])
        shared = (count > 1) | (np.maximum.reduceat(o, start) == _SEVERAL)
        hit = np.repeat(shared, count) & (o != _SEVERAL)
        source, o = source[hit], o[hit]
        order = np.argsort(source, kind="stable")
        cut = np.searchsorted(source[order], np.arange(len(size) + 1))
        o = o[order]
        for k, tag in enumerate(tags):
            if cut[k] < cut[k + 1]:
                found.setdefault(tag, []).append(o[cut[k] : cut[k + 1]])
        held += len(o)
        for x in (low, own, tags):
            x.clear()

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal held
        names = list(found)
        for k in range(0, len(names), 64):
            mine = names[k : k + 64]
            data = pa.array([np.concatenate(found[t]).tobytes() for t in mine], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), data, *[pa.nulls(len(mine), c.type) for c in rest.columns[4:]]], ["tag", "own", *rest.schema.names[4:]])
        found.clear()
        held = 0

    for batch in batches:
        rest = batch if rest is None else rest
        about = batch.filter(batch.column(2).is_null())
        if len(about):
            yield pa.RecordBatch.from_arrays([about.column(1), about.column(3), *about.columns[4:]], ["tag", "own", *batch.schema.names[4:]])
        for p, t, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if a is None:
                continue
            if p != part:
                if low:
                    close()
                if held > 4 * FLUSH:
                    yield from out()
                part = p
            low.append(np.frombuffer(a, np.uint32))
            own.append(np.frombuffer(b, np.uint16))
            tags.append(t)
    if low:
        close()
    if found:
        yield from out()


def _members(threshold: float):
    """Rows of _elsewhere sorted by tag: (id, th, h, size, alive) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, about, hits = None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            ids, ths, at, hs, sizes, shared = about
            at, size = at.values.to_numpy(), sizes.values.to_numpy()
            m = shared.values.to_numpy() + (0 if hits is None else hits[: len(size)])
            alive = m >= threshold * size - 1e-9
            for k in range(0, len(at), 100_000):
                s = slice(k, k + 100_000)
                own = at[s]
                yield pa.RecordBatch.from_arrays(
                    [ids.values[s], ths.values[s], pa.array(hs.values.to_numpy()[own]), pa.array(size[own].astype(np.int32)), pa.array(alive[own])], ["id", "th", "h", "size", "alive"]
                )

        for batch in batches:
            for k, (t, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if t != tag:
                    if about is not None:
                        yield from close()
                    tag, about, hits = t, None, None
                if own is None:
                    about = [c[k] for c in batch.columns[2:]]
                else:
                    counted = np.bincount(np.frombuffer(own, np.uint16), minlength=FLUSH_DOCS)
                    hits = counted if hits is None else hits + counted
        if about is not None:
            yield from close()

    return run


def members(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, th, h, size, alive) of each row with words: th hashes the text, h its set; only a set that is alive may have a partner.

    Also alive are copies in different tasks, each of which has the other's n-grams.
    """
    kind = docs.select("id").schema["id"].dataType.simpleString()
    parts = max(LEAST_PARTS, min(MOST_PARTS, text_bytes(docs) // PART_BYTES))
    about = f"ids array<{kind}>, ths array<bigint>, at array<int>, hs array<bigint>, sizes array<int>, shared array<int>"
    arrow = to_arrow_type(docs.select("id").schema["id"].dataType)
    sent = docs.select("id", "th", "text").mapInArrow(_postings(n, parts, arrow), f"part int, tag bigint, low binary, own binary, {about}")
    found = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_elsewhere, f"tag bigint, own binary, {about}")
    found = written(found, "join-elsewhere").repartition("tag").sortWithinPartitions("tag")
    return written(found.mapInArrow(_members(threshold), f"id {kind}, th bigint, h bigint, size int, alive boolean"), "join-members")


def _gram_sets(n: int):
    """A function over rows (h, text): the set, and its least n-grams in a few orders, which similar sets tend to share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                sets = [ngram_set(t, n, cache) for t in part.column(1).to_pylist()]
                homes = np.array([[(s * m).min() for m in _ORDERS] for s in sets], np.uint64).view(np.int64)
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * len(_ORDERS)), pa.array(homes.ravel())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), *columns], ["h", "size", "grams", "homes"])

    return run


def _least_overlap(size, threshold: float):
    return np.ceil(size * (threshold / (1 + threshold)) - 1e-9)


def _slices(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from start to end, one range after the other."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _alike(sets: DataFrame) -> DataFrame:
    """(h, block, n) of each set: its block, which one task compares, and the number of sets in it.

    A block is what least n-grams in common connect, or if that is too large a
    part of it with one least n-gram, or if that is too large a single set. It
    only settles where a pair is found, not whether.
    """
    roots = components(sets.select("h", F.explode("homes").alias("home")))
    own = sets.select("h", "size", F.col("homes")[0].alias("home")).join(small_side(roots), F.col("h") == F.col("node"), "left")
    own = written(own.select("h", "size", "home", F.coalesce("root", "h").alias("root")), "join-homes")
    whole = own.groupBy("root").agg(F.sum("size").alias("whole"))
    part = own.groupBy("root", "home").agg(F.sum("size").alias("part"))
    block = F.when(F.col("whole") <= BLOCK_GRAMS, F.col("root")).when(F.col("part") <= BLOCK_GRAMS, F.xxhash64("root", "home")).otherwise(F.col("h"))
    found = own.join(whole, "root").join(part, ["root", "home"]).select("h", block.alias("block"))
    return written(found.withColumn("n", F.count("*").over(Window.partitionBy("block"))), "join-alike")


def _similar(h: np.ndarray, size: np.ndarray, length: np.ndarray, flat: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, jaccard) of all similar pairs of sets, which are given by rising size, one after the other in flat."""
    k = len(h)
    key = np.unique(np.repeat(np.arange(k), length) << 32 | flat.view(np.uint32).astype(np.int64))
    _, code, count = np.unique(key & 0xFFFFFFFF, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    key = np.sort(key >> 32 << 32 | rank[code])
    own, code, single = key >> 32, key & 0xFFFFFFFF, int((count == 1).sum())
    start = np.searchsorted(own, np.arange(k + 1))
    signs = np.maximum(start[1:] - start[:-1] - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1, 0)
    signed = np.flatnonzero((np.arange(len(code)) - start[own] < signs[own]) & (code >= single))
    order = signed[np.argsort(code[signed], kind="stable")]
    holders = own[order]
    first = np.searchsorted(code[order], np.arange(len(count) + 1))
    first, last = first[:-1].copy(), first[1:]
    end = np.searchsorted(size, size / threshold + 1e-9, side="right")
    marked, seen = np.zeros(k, bool), np.zeros(len(count), bool)
    for i in range(k):
        mine = code[start[i] : start[i] + signs[i]]
        mine = mine[mine >= single]
        first[mine] += 1  # a pair is met at its smaller set
        met = holders[_slices(first[mine], last[mine])]
        marked[met] = True
        others = i + 1 + np.flatnonzero(marked[i + 1 : end[i]])
        marked[met] = False
        if not len(others):
            continue
        mine = code[start[i] : start[i + 1]]
        seen[mine] = True
        hit = seen[code[_slices(start[others], start[others + 1])]]
        seen[mine] = False
        length = start[others + 1] - start[others]
        common = np.add.reduceat(hit, np.cumsum(length) - length, dtype=np.int64)
        jaccard = common / (size[i] + size[others] - common)
        good = jaccard >= threshold
        yield np.full(good.sum(), h[i]), h[others[good]], jaccard[good]


def _within(threshold: float):
    """A function over rows (block, h, size, low) sorted by block and size: the similar pairs of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, out, number = None, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            columns = [pa.array(np.concatenate(x)) for x in zip(*out)]
            out.clear()
            number = 0
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "jaccard"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for found in _similar(*(np.concatenate(x) for x in zip(*held)), threshold):
                out.append(found)
                number += len(found[0])
                if number >= 50_000:
                    yield flush()
            held.clear()

        for batch in batches:
            blocks, h, size = (batch.column(k).to_numpy() for k in range(3))
            at, flat = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            cut = [*np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]][: len(batch)]).tolist(), len(batch)]
            for i, j in zip(cut, cut[1:]):
                if blocks[i] != block:
                    if held:
                        yield from close()
                    block = blocks[i]
                held.append((h[i:j].copy(), size[i:j].astype(np.int64), np.diff(at[i : j + 1]), flat[at[i] : at[j]].copy()))
        if held:
            yield from close()
        if out:
            yield flush()

    return run


def _across(threshold: float):
    """A function over signatures (g, block, h, size, place) sorted by g and block: the pairs of different blocks that a signature makes candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        found: list[np.ndarray] = []
        rows, number = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            pairs = np.unique(np.concatenate(found).view("i8,i8")).view(np.int64).reshape(-1, 2)
            found.clear()
            number = 0
            for k in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[k : k + 100_000, x])) for x in (0, 1)], ["a", "b"])

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rows, number
            g, block, h, size, place = (np.concatenate(x) for x in zip(*held))
            held.clear()
            new = np.r_[True, g[1:] != g[:-1]]
            if not last:
                whole = np.flatnonzero(new)[-1]
                held.append([x[whole:] for x in (g, block, h, size, place)])
                g, block, h, size, place, new = (x[:whole] for x in (g, block, h, size, place, new))
            rows = sum(len(x[0]) for x in held)
            if not len(g):
                return
            ends = []
            for starts in (new, new | np.r_[True, block[1:] != block[:-1]]):
                at = np.flatnonzero(starts)
                ends.append(np.repeat(np.r_[at[1:], len(g)], np.diff(np.r_[at, len(g)])))
            end, j = ends
            i = np.flatnonzero(j < end)
            j = j[i]
            while len(i):
                small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
                left = np.minimum(size[i] - place[i], size[j] - place[j])
                good = (small >= large * threshold - 1e-9) & (left >= _least_overlap(small + large, threshold))
                if good.any():
                    x, y = h[i[good]], h[j[good]]
                    found.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
                    number += len(x)
                    if number >= FLUSH:
                        yield from flush()
                j = j + 1
                more = j < end[i]
                i, j = i[more], j[more]

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += len(batch)
            if rows >= FLUSH // 4:
                before = rows
                yield from close(False)
                if rows == before:  # one n-gram that many have; it grows before it is looked at again
                    rows = 0
        if held:
            yield from close(True)
        if found:
            yield from flush()

    return run


def class_pairs(docs: DataFrame, own: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, jaccard) for every pair of different sets that are similar, a and b being their hashes."""
    reps = own.filter("alive").groupBy("h").agg(F.min(F.struct("id", "th")).alias("r")).select("h", F.col("r.id").alias("r_id"), F.col("r.th").alias("r_th"))
    reps = written(reps, "join-reps")
    texts = docs.join(small_side(reps), (F.col("th") == F.col("r_th")) & (F.col("id") == F.col("r_id"))).select("h", "text")
    sets = texts.mapInArrow(_gram_sets(n), "h bigint, size int, grams array<bigint>, homes array<bigint>")
    if not own.groupBy("id", "th").count().filter("count > 1").isEmpty():
        sets = sets.dropDuplicates(["h"])
    sets = written(sets, "join-sets")
    # within a pair of sets, 32 bits of a hash are as good as 64
    full = sets.select("h", "size", F.transform("grams", lambda g: F.shiftright(g, 32).cast("int")).alias("low"))
    alike = _alike(sets)
    inside = full.join(small_side(alike.filter("n > 1").select("h", "block")), "h").select("block", "h", "size", "low")
    inside = inside.repartition("block").sortWithinPartitions("block", "size").mapInArrow(_within(threshold), "a bigint, b bigint, jaccard double")
    inside = written(inside, "join-within")
    each = sets.select("h", "size", F.explode("grams").alias("g"))
    often = each.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    there = Window.partitionBy("h")
    place = F.col("size") - F.count("*").over(there) + F.row_number().over(there.orderBy("n", "g")) - 1
    signed = each.join(often, "g").withColumn("place", place.cast("int"))
    signed = signed.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9)).join(small_side(alike.select("h", "block")), "h")
    signed = written(signed.select("g", "block", "h", "size", "place"), "join-signed")
    pairs = signed.repartition("g").sortWithinPartitions("g", "block").mapInArrow(_across(threshold), "a bigint, b bigint")
    pairs = written(pairs.distinct(), "join-pairs")
    first, second = (full.toDF(x, f"{x}_size", f"{x}_low").join(small_side(pairs.select(x)), x, "left_semi") for x in ("a", "b"))
    both = first.join(small_side(pairs), "a").join(second, "b")
    common = F.size(F.array_intersect("a_low", "b_low"))
    jaccard = F.col("common") / (F.col("a_size") + F.col("b_size") - F.col("common"))
    outside = both.withColumn("common", common).select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)
    return inside.unionByName(written(outside, "join-across"))


def _grouped(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, th, h, root, links) of each row with words; root is the same for all documents of a group."""
    docs = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text").filter("id IS NOT NULL AND text IS NOT NULL")
    own = members(docs, n, threshold)
    good = class_pairs(docs, own, n, threshold)
    roots = components(good.select("a", "b")).select(F.col("node").alias("h"), "root")
    links = good.select(F.col("a").alias("h")).union(good.select("b")).groupBy("h").agg(F.count("*").alias("links"))
    out = own.select("id", "th", "h").join(roots, "h", "left").join(links, "h", "left")
    return out.select("id", "th", "h", F.coalesce("root", "h").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def similar_groups(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """(doc_id, group_id, links) for every document that is similar to another.

    group_id is the least doc_id of those that are similar directly or through
    others. links is the number of different texts (sets of n-grams) that the
    document is similar to, copies of its own not counted, so it is 0 for one
    that has only copies. Rows with a null doc_id, or a null, empty or wordless
    text, are in no group. A doc_id that repeats with another text is a
    document of its own; with the same words it is the same. doc_id may be of any
    type that can be ordered. Extra columns are ignored; an empty table has no
    groups.
    """
    all_ = written(_grouped(docs, n, threshold).select("id", "h", "root", "links").distinct(), "join-groups")
    groups = all_.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).filter("n > 1").select("root", "group_id")
    return all_.join(groups, "root").select(F.col("id").alias("doc_id"), "group_id", "links")


def one_of_each(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """docs without the documents that are similar to one with a lower doc_id in their group.

    Rows with a null doc_id, and documents without words, stay. Of rows that
    agree in doc_id and text one stays. If the lowest doc_id of a group has
    several texts, the one with the least hash stays.
    """
    all_ = written(_grouped(docs, n, threshold).select("id", "th", "root").withColumn("both", F.struct("id", "th")), "join-groups")
    first = all_.groupBy("root").agg(F.min("both").alias("first"))
    gone = written(all_.join(first, "root").filter(F.col("both") != F.col("first")).select(F.col("id").alias("__gone_id"), F.col("th").alias("__gone_th")).distinct(), "join-gone")
    text_hash = F.xxhash64(docs["text"])
    kept = docs.join(small_side(gone), (docs["doc_id"] == F.col("__gone_id")) & (text_hash == F.col("__gone_th")), "left_anti")
    again = written(docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__again")), "join-again")
    if again.isEmpty():
        return kept
    unique = kept.join(small_side(again), kept["doc_id"] == F.col("__again"), "left_anti")
    return unique.unionByName(kept.join(small_side(again), kept["doc_id"] == F.col("__again"), "left_semi").dropDuplicates(["doc_id", "text"]))
