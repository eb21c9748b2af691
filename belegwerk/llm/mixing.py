"""Mixing sources to target weights by subset sums over exact token lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.common import WORD, null_safe, spread_rows
from belegwerk.operators.ranking import numbered
from belegwerk.workspace import Workspace

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 42
# The knapsack tables are this long; the budget above is filled by length in proportion.
WINDOW = 1 << 15


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many of the ``counts[i]`` documents of ``sizes[i]`` words to take so that their words come to ``budget``.

    The sum never exceeds the budget. Down to the window each length gives its share, then the longest
    that fit; what remains is a bounded knapsack over what is left of each length, solved exactly, so
    the result is the best sum that these first steps leave open. Each length enters the table in
    chunks of 1, 2, 4 … copies. Sizes must be positive; ties and order do not matter.
    """
    order = np.argsort(-sizes, kind="stable")
    w, left = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((w * left).sum())
    if budget >= total:
        return counts.astype(np.int64)
    taken = np.zeros(len(w), np.int64)
    if budget > window:
        taken = (left * ((budget - window) / total)).astype(np.int64)
        left = left - taken
        budget -= int((w * taken).sum())
        for i in np.flatnonzero(left):
            if budget <= window:
                break
            more = min(int(left[i]), max(0, (budget - window + int(w[i]) - 1) // int(w[i])), budget // int(w[i]))
            taken[i] += more
            left[i] -= more
            budget -= more * int(w[i])
    # first[s] is the chunk by which the sum s was first reached; earlier chunks reach what it adds to.
    first = np.full(budget + 1, -1, np.int64)
    first[0] = -2
    chunks: list[tuple[int, int]] = []
    for i in np.flatnonzero((left > 0) & (w <= budget)):
        rest, copies = min(int(left[i]), budget // int(w[i])), 1
        while rest and first[budget] == -1:
            copies = min(copies, rest)
            step = copies * int(w[i])
            fresh = np.flatnonzero((first[step:] == -1) & (first[: budget + 1 - step] != -1))
            first[fresh + step] = len(chunks)
            chunks.append((int(i), copies))
            rest -= copies
            copies *= 2
    at = int(np.flatnonzero(first != -1)[-1])
    while at:
        i, copies = chunks[first[at]]
        taken[i] += copies
        at -= copies * int(w[i])
    out = np.empty_like(taken)
    out[order] = taken
    return out


def targets(ws: Workspace, sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source_key, source_size, target`` from ``source_key, source, source_size``.

    Sources stand in the order of their code points, a null one last, and take the weights in turn. They
    share the sum of all sizes by weight; a target above ``repeats`` times its source's size is cut
    to that, and what is cut off is shared by weight among the others, until none is above.
    """
    ordered = numbered(ws, sources.withColumn("_last", F.col("source").isNull().cast("int")), [], ["_last", "source_key"], "rank")
    turn = (F.col("rank") - 1) % len(weights) + 1
    weighed = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    weighed = ws.stage(weighed.withColumn("cap", F.col("source_size") * repeats).drop("_last", "rank"), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    # A source is full at this level of words per weight; the level only rises, so full ones stay full.
    level, full = 0.0, -1
    while True:
        at = F.col("cap") <= F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.coalesce(F.sum(F.when(at, F.col("cap"))), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~at, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(at, 1)).alias("full"),
        ).first()
        if row.full == full or not row.open:
            break
        full, level = row.full, (total - row.given) / row.open
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return weighed.select("source_key", "source_size", target.alias("target"))


def mix(
    ws: Workspace,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``.

    A source whose target is ``f`` times its size and a rest gives each document ``f`` times, and
    once more to those that fill the rest: documents are counted by exact length, a bounded
    knapsack picks how many of each length, and a seeded hash of the key picks which. So reruns agree,
    and no document is taken more than ``repeats`` times. A null or empty text has size 0 and is taken
    with 0 words; a null source is a source of its own; repeated rows are documents of their own,
    null keys as well. A source without words has target 0.
    """
    sized = spread_rows(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))).select(
        "doc_id",
        "source",
        null_safe("source").alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_draw"),
    )
    sized = ws.stage(sized, "sized")
    lengths = ws.stage(sized.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")), "lengths")
    sources = lengths.groupBy("source_key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = ws.stage(targets(ws, ws.stage(sources, "sources"), weights, repeats), "targets")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source's lengths; k different lengths need k²/2 words, so they are few."""
        whole = int(pdf["whole"].iloc[0])
        extra = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["rest"].iloc[0]))
        return pd.DataFrame({"source_key": pdf["source_key"], "size": pdf["size"], "extra": extra, "whole": whole})

    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats)).cast("long")
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    counted = lengths.where("size > 0").join(aims, "source_key").withColumn("whole", whole).withColumn("rest", rest)
    picks = counted.groupBy("source_key").applyInPandas(plan, "source_key string, size long, extra long, whole long")
    picks = ws.stage(picks, "picks")
    ranked = numbered(ws, sized, ["source_key", "size"], ["_draw", "doc_id"], "rank")
    joined = ranked.join(picks, ["source_key", "size"], "left").join(aims, "source_key", "left")
    times = F.col("whole") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.coalesce(F.col("size") * times, F.lit(0)).cast("long").alias("taken"),
    )
