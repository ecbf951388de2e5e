"""License texts in documents, found by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions
of those hashes in the templates. A hit votes for the diagonal, the offset
between document and template; votes are summed by diagonal, neighbouring
diagonals whose stretches touch are merged, so a few words may be added or
lost inside a license, and the words of each span are compared before it
counts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import small_side, written
from .words import WordHashes, find_words, grams, word_hashes, words

K = 3
#: Diagonals so near to each other, with stretches at most so many words apart, belong to one span.
DRIFT, GAP = 4, 12
#: Share of the template's words that a span must have in order, and share of the span's words that these must be.
COVER, PURE = 0.75, 0.6
#: Templates with more positions than this are joined by shuffle, not broadcast.
BROADCAST_POSITIONS = 2_000_000

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    'the "Software", to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
)
#: (license, text); several texts may name one license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL),
    ("BSD-3-Clause", _BSD),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def positions(templates: Sequence[tuple[str, str]], k: int = K) -> list[tuple[int, int, int]]:
    """(hash, template, position) of every k-gram of every template."""
    cache = WordHashes()
    out = []
    for t, (_, text) in enumerate(templates):
        h = word_hashes(text, cache)
        if len(h) >= k:
            out += [(int(x), t, p) for p, x in enumerate(grams(h, k).view(np.int64))]
    return out


def _roll(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            flat, at = [], [0]
            for text in batch.column(2).to_pylist():
                h = word_hashes(text, cache)
                g = grams(h, k).view(np.int64) if len(h) >= k else np.zeros(0, np.int64)
                flat.append(g)
                at.append(at[-1] + len(g))
            hashes = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes], ["id", "th", "grams"])

    return run


def compare(span: list[str], template: list[str]) -> tuple[int, int, int]:
    """(words in common and in order, first and one past the last of them in the span)."""
    blocks = [m for m in SequenceMatcher(None, span, template, autojunk=False).get_matching_blocks() if m.size]
    return (sum(m.size for m in blocks), blocks[0].a, blocks[-1].a + blocks[-1].size) if blocks else (0, 0, 0)


def passage(own: list[str], want: list[str], first: int, last: int, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(words in common, first word, word after the last) of a template near a span of votes, if it covers enough.

    First between where the template would begin and end on the outer diagonals,
    so that a repeat nearby isn't taken for this one; then with GAP more words on both sides.
    """
    a, b = max(0, min(first, low)), min(len(own), max(last + k, high + len(want)))
    for more in (0, GAP):
        start, end = max(0, a - more), min(len(own), b + more)
        there, wanted = Counter(own[start:end]), Counter(want)
        if sum(min(n, there[w]) for w, n in wanted.items()) < COVER * len(want):
            continue  # not so many words in common, in whatever order
        common, x, y = compare(own[start:end], want)
        if common >= COVER * len(want) and common >= PURE * (y - x):
            return common, start + x, start + y
    return None


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of passages (common, template, first, end) those with most words in common, none of which overlaps one before it."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for p in sorted(set(found), key=lambda p: (-p[0], p[1], p[2], p[3])):
        at = bisect_left(starts, p[3])
        if at == 0 or ends[at - 1] <= p[2]:
            starts.insert(at, p[2])
            ends.insert(at, p[3])
            out.append(p)
    return out


def _verify(templates: Sequence[tuple[str, str]], k: int):
    """A function over rows (doc_id, th, text, spans): the passages of each row."""
    known = [words(t) for _, t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for r, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                own, found = find_words(text.lower()), []
                for s in spans:
                    got = passage(own, known[s["template"]], s["first"], s["last"], s["low"], s["high"], k)
                    if got is not None:
                        found.append((got[0], s["template"], got[1], got[2]))
                best = apart(found)
                row += [r] * len(best)
                out += best
            common, template, first, end = zip(*out) if out else ((),) * 4
            cover = [round(c / len(known[t]), 6) for c, t in zip(common, template)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array([templates[t][0] for t in template], pa.string()), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(cover, pa.float64())],
                ["doc_id", "license", "first_word", "end_word", "cover"],
            )

    return run


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """(doc_id, license, first_word, end_word, cover) for every license passage.

    Words are counted from 0 and end_word is one past the last; cover is the
    share of the template found. Passages are taken in order of their words in
    common, ties by earlier template, then by place; one that overlaps a
    passage taken before is left out, and nothing else is.
    Templates of fewer than k words are never found. Rows that agree in doc_id
    and text count once; a null doc_id is kept; a null or empty text has no
    passage; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").filter("text <> ''")
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = positions(templates, k)
    place = spark.createDataFrame(rows, "h bigint, template int, pos int")
    place = F.broadcast(place) if len(rows) <= BROADCAST_POSITIONS else place
    rolled = own.mapInArrow(_roll(k), f"id {kind}, th bigint, grams array<bigint>").select("id", "th", F.posexplode("grams").alias("at", "h"))
    # repeated rows vote once
    hits = rolled.join(place, "h").select("id", "th", "template", "at", "pos").distinct()
    lines = hits.groupBy("id", "th", "template", (F.col("at") - F.col("pos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    order = Window.partitionBy("id", "th", "template").orderBy("diagonal", "first")
    new = (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT) | (
        F.greatest("first", F.lag("first").over(order)) - F.least("last", F.lag("last").over(order)) > GAP + k
    )
    merged = (
        lines.withColumn("span", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order))
        .groupBy("id", "th", "template", "span")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    )
    # words decide, not votes: a span with a single vote is compared too
    spans = written(
        merged.groupBy(F.col("id").alias("s_id"), F.col("th").alias("s_th")).agg(F.sort_array(F.collect_list(F.struct("first", "last", "low", "high", "template"))).alias("spans")), "license-spans"
    )
    match = F.col("th").eqNullSafe(F.col("s_th")) & F.col("id").eqNullSafe(F.col("s_id"))
    found = own.withColumnRenamed("doc_id", "id").join(small_side(spans), match).select("id", "th", "text", "spans").dropDuplicates(["id", "th"])
    return found.mapInArrow(_verify(templates, k), f"doc_id {kind}, license string, first_word int, end_word int, cover double")
