"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a token budget; documents are counted by exact token length,
each length is taken in proportion, and a bounded-knapsack dynamic programme
spends what is left to the token. Which documents of a length are taken is
decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Tokens that the registered query and the pipeline ask for, as a share of all; no small source bounds the others.
SHARE = 1.0
#: Tokens that the dynamic programme begins with; it gets more where these can't be spent to the token.
DP_TOKENS = 1 << 16


def token_count(text: Column) -> Column:
    """Tokens between white space; 0 for a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is the largest one within the budget.

    Reachable sums are the bits of an integer; counts are split into powers of
    two, and for each sum the step that first reached it is kept, to walk back
    from the best one: 4 bytes for each token of the budget.
    """
    goal, reach = 1 << budget, 1
    full, size = (goal << 1) - 1, budget // 8 + 1
    steps: list[tuple[int, int]] = []
    first = np.zeros(budget + 1, np.int32)
    for i, (n, have) in enumerate(zip(lengths, counts)):
        if n <= 0 or n > budget:
            continue
        have, part = min(have, budget // n), 1
        while have > 0 and not reach & goal:
            step = min(part, have)
            have, part = have - step, part * 2
            if step * n <= budget:
                new = (reach << step * n) & full & ~reach
                bits = np.unpackbits(np.frombuffer(new.to_bytes(size, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(steps)
                steps.append((i, step))
                reach |= new
    best, take = reach.bit_length() - 1, [0] * len(lengths)
    while best:
        i, step = steps[first[best]]
        take[i] += step
        best -= step * lengths[i]
    return take


def fit(lengths: list[int], counts: list[int], budget: int, window: int = DP_TOKENS) -> list[int]:
    """Documents to take of each length: in proportion, then by fractions down to the window, then by the dynamic programme.

    If that doesn't spend the budget to the token, the window is widened
    fourfold, until it holds the whole remainder of the proportional part.
    """
    have = sum(n * c for n, c in zip(lengths, counts))
    if have <= budget:
        return list(counts)
    share = [c * budget // have for c in counts]
    rest = budget - sum(n * x for n, x in zip(lengths, share))
    order = sorted(range(len(lengths)), key=lambda i: (-(counts[i] * budget % have), lengths[i]))
    best, most = share, -1
    while True:
        take, left = list(share), rest
        for i in order:
            if left <= window:
                break
            if take[i] < counts[i] and 0 < lengths[i] <= left:
                take[i], left = take[i] + 1, left - lengths[i]
        more = knapsack(lengths, [c - x for c, x in zip(counts, take)], left)
        take = [x + y for x, y in zip(take, more)]
        spent = sum(n * x for n, x in zip(lengths, take))
        if spent > most:
            best, most = take, spent
        if most == budget or window >= rest:
            return best
        window *= 4


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("n_tokens")
    return pdf.assign(take=fit(pdf["n_tokens"].tolist(), pdf["n"].tolist(), int(pdf["budget"].iloc[0])))[["source", "n_tokens", "take"]]


def mixture(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = 0.7,
    total: int | None = None,
    seed: int = 17,
    share: float | None = None,
) -> DataFrame:
    """The documents chosen: (doc_id, source, text_hash, n_tokens).

    weights: share of the tokens per source; a source not named gets none.
    Without weights, shares are proportional to a source's tokens to the power
    alpha. total: tokens wanted overall; share: the same as a share of the tokens
    of all sources that have a weight. Without both it is the most for which
    every source can meet its share, so that the smallest source bounds all
    others. A source that has less than its budget is taken whole.

    Rows that agree in doc_id, source and text form one item whose length is
    the sum of theirs: they are chosen or left together. Nulls in doc_id and
    source are values like others. Documents without tokens cost nothing and
    are all chosen, if their source has a share. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    items = written(
        docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), token_count(F.col("text")).alias("t"))
        .groupBy("doc_id", "source", "text_hash")
        .agg(F.sum("t").alias("n_tokens")),
        "mix-items",
    )
    lengths = items.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    have = lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("have"))
    if weights is None:
        raw = have.withColumn("w", F.pow(F.col("have").cast("double"), F.lit(float(alpha))))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        raw = have.join(given, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # one row per source from here on
    every = Window.partitionBy(F.lit(0))
    parts = raw.filter("w > 0").withColumn("w", F.col("w") / F.sum("w").over(every))
    if total is not None:
        limit = F.lit(float(total))
    elif share is not None:
        limit = F.sum("have").over(every) * F.lit(float(share))
    else:
        limit = F.min(F.when(F.col("have") > 0, F.col("have") / F.col("w"))).over(every)
    budget = F.least(F.col("have"), F.floor(F.coalesce(limit, F.lit(0.0)) * F.col("w") + F.lit(1e-6)))
    budgets = parts.select(F.col("source").alias("s"), budget.cast("bigint").alias("budget"))
    taken = (
        lengths.join(budgets, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .groupBy("source")
        .applyInPandas(_fit_source, "source string, n_tokens bigint, take bigint")
        .filter("take > 0")
        .select(F.col("source").alias("s"), F.col("n_tokens").alias("len"), "take")
    )
    taken = written(taken, "mix-taken")
    order = Window.partitionBy("source", "n_tokens").orderBy(F.xxhash64("doc_id", "text_hash", F.lit(seed)), "doc_id", "text_hash")
    return (
        items.withColumn("rank", F.row_number().over(order))
        .join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("n_tokens") == F.col("len")) & (F.col("rank") <= F.col("take")))
        .select("doc_id", "source", "text_hash", "n_tokens")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that mixture() chooses, with all their columns."""
    keys = mixture(docs, **options).select(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("text_hash").alias("__h"))
    match = F.xxhash64(docs["text"]).eqNullSafe(keys["__h"]) & docs["doc_id"].eqNullSafe(keys["__id"]) & docs["source"].eqNullSafe(keys["__s"])
    return docs.join(keys.hint("shuffle_hash"), match, "left_semi")
