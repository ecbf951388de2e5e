"""Toxicity classifier with a counterfactual penalty.

A logistic model over the distinct words, and word beginnings, of a document.
Spark counts each feature among the labelled documents and keeps the most
telling ones; the model is fitted in one task on a bounded sample of labelled
rows. In every labelled document that mentions a group, the group terms are
swapped for others and for neutral words, and the fit is penalised by the
square of the change in score, so a mention alone doesn't move the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import words

#: Labelled documents that are used to fit; a seeded hash chooses them if there are more.
FIT_ROWS = 20_000
#: A feature must be in so many labelled documents, and its shares among toxic and other ones so many deviations apart. All that are enter the model.
LEAST_DOCS, LEAST_Z = 3, 4.0
PREFIX = 4
#: The fit is constrained to a bias of at most this, so that a document without any telling feature isn't rejected whatever the labels' share.
MOST_BIAS = -1.0
IDENTITY = (
    "women men woman man girls boys gay lesbian straight bisexual transgender queer muslim muslims christian christians jewish jews "
    "hindu buddhist atheist black white asian african european american mexican arab immigrant immigrants refugee refugees disabled "
    "deaf blind autistic old young elderly teenage mujeres hombres musulmanes judíos frauen männer muslime juden femmes hommes musulmans juifs"
).split()
NEUTRAL = ("people", "person", "someone")


def features(text: str | None) -> set[str]:
    """Distinct words, and beginnings of longer words with a star."""
    w = set(words(text))
    return w | {x[:PREFIX] + "*" for x in w if len(x) > PREFIX}


def swapped(text: str, identity: Sequence[str] = IDENTITY) -> list[set[str]]:
    """Features of the text with its group terms replaced: by another group, and by a neutral word."""
    there, known = set(words(text)), set(identity)
    hits = sorted(there & known)
    if not hits:
        return []
    out = []
    for kind in (identity, NEUTRAL):
        fresh = {kind[(zlib.crc32(w.encode()) + 1) % len(kind)] for w in hits}
        w = there - known | fresh
        out.append(w | {x[:PREFIX] + "*" for x in w if len(x) > PREFIX})
    return out


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each batch with their documents: (feature, toxic, n)."""
    for batch in batches:
        counts: tuple[dict, dict] = ({}, {})
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = counts[toxic]
            for f in features(text):
                c[f] = c.get(f, 0) + 1
        for toxic, c in enumerate(counts):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["f", "toxic", "n"])


def fit_logistic(
    rows: list[np.ndarray], y: np.ndarray, diffs: list[tuple[np.ndarray, np.ndarray]], size: int, fairness: float, l2: float = 0.1, steps: int = 300
) -> np.ndarray:
    """Weights and, last, the bias, which stays at MOST_BIAS or below. rows: features of each document; diffs: features gained and lost by a swap."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, int)
    d_at = np.concatenate([np.repeat(k, len(a) + len(b)) for k, (a, b) in enumerate(diffs)]) if diffs else np.zeros(0, int)
    d_col = np.concatenate([np.concatenate(d) for d in diffs]) if diffs else np.zeros(0, int)
    d_val = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in diffs]) if diffs else np.zeros(0)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    for t in range(1, steps + 1):
        z = np.bincount(at, w[col], len(rows)) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.r_[np.bincount(col, err[at], size), err.sum()]
        if len(d_at):
            move = np.bincount(d_at, w[d_col] * d_val, len(diffs))
            g[:-1] += 2 * fairness * np.bincount(d_col, move[d_at] * d_val, size)
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (0.99 ** (t / 3)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[-1] = min(w[-1], MOST_BIAS)
    return w


def train(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fairness: float = 10.0, identity: Sequence[str] = IDENTITY, seed: int = 5
) -> dict[str, float]:
    """Feature weights; the bias is under the empty string.

    Labels with a null doc_id or toxic are left out, and of repeated labels of
    a document the highest counts. Without any labelled document every
    weight is 0 and the bias is -10: nothing is rejected.
    """
    chosen = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_id", F.lit(seed)), "_id")
        .limit(fit_rows)
    )
    # at most fit_rows pairs of numbers
    texts = written(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", (F.col("toxic") > 0).cast("int").alias("toxic")), "toxic-fit")
    total = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    if not total:
        return {"": -10.0}
    p, q = max(1, total.get(1, 0)), max(1, total.get(0, 0))
    a, b = F.col("pos") / p, F.col("neg") / q
    pool = (F.col("pos") + F.col("neg")) / (p + q)
    z = F.abs(a - b) / F.sqrt(pool * (1 - pool) * (1 / p + 1 / q) + 1e-12)
    counted = (
        texts.mapInArrow(_explode, "f string, toxic int, n bigint")
        .groupBy("f")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
        .filter(F.col("pos") + F.col("neg") >= LEAST_DOCS)
    )
    # words of at most fit_rows documents
    names = sorted(r[0] for r in counted.filter(z >= LEAST_Z).select("f").collect())
    index = {f: k for k, f in enumerate(names)}

    def ids(found: set[str]) -> list[int]:
        return sorted(index[f] for f in found & index.keys())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = ids(features(text))
                there = set(own)
                swaps = [set(ids(s)) for s in swapped(text or "", identity)]
                out.append((own, toxic, [sorted(s - there) for s in swaps], [sorted(there - s) for s in swaps]))
            x, y, more, less = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.int32())), pa.array(y, pa.int32()), pa.array(more, pa.list_(pa.list_(pa.int32()))), pa.array(less, pa.list_(pa.list_(pa.int32())))],
                ["x", "y", "more", "less"],
            )

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, diffs = [], [], []
        for pdf in frames:
            x += [np.asarray(r, int) for r in pdf["x"]]
            y += pdf["y"].tolist()
            for more, less in zip(pdf["more"], pdf["less"]):
                diffs += [(np.asarray(g, int), np.asarray(l, int)) for g, l in zip(more, less) if len(g) + len(l)]
        w = fit_logistic(x, np.asarray(y, float), diffs, len(names), fairness)
        yield pd.DataFrame({"f": [*names, ""], "w": w})

    encoded = texts.mapInArrow(rows, "x array<int>, y int, more array<array<int>>, less array<array<int>>")
    ordered = encoded.repartition(1).sortWithinPartitions("y", "x")  # the same order whatever order rows arrive in
    return {r["f"]: r["w"] for r in ordered.mapInPandas(fit, "f string, w double").collect()}


def scored(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """docs with toxicity, the model's probability; a null or empty text has the one that the bias gives."""
    bias, known = model.get("", 0.0), {f: w for f, w in model.items() if f and abs(w) > 1e-6}
    whole = {f for f in known if not f.endswith("*")}
    starts = {f[:-1] for f in known if f.endswith("*")}
    # a word and its beginning never share a key: words hold no star

    def score(text: str | None) -> float:
        there = set(words(text))
        z = bias
        for f in sorted(there & whole):
            z += known[f]
        for f in sorted({x[:PREFIX] for x in there if len(x) > PREFIX} & starts):
            z += known[f + "*"]
        return 1 / (1 + np.exp(-z)) if z > -500 else 0.0

    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        return text.map(score, na_action=None).astype(float)

    return docs.withColumn("toxicity", probability(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """(doc_id, toxicity, toxic) for every row of docs.

    Rows with one text have one score, a null or empty text that of the bias
    alone; a null doc_id stays null. Extra columns are ignored; an empty table
    gives an empty result. train() says what labels count.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels, **options))
    return out.select("doc_id", F.round("toxicity", 6).alias("toxicity"), (F.col("toxicity") >= threshold).alias("toxic"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs whose score is below the threshold, with docs' columns, whatever their names.

    A null or empty text stays; repeated rows stay or go together. An empty
    table gives an empty result.
    """
    both = scored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), train(docs, labels, **options))
    return both.filter(F.col("toxicity") < threshold).select("row.*")
