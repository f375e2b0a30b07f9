"""Mixing sources to target weights by fitting budgets as subset sums.

A source's target is its share of all words by weight, at most ``most`` times its size;
what is above is shared again by weight among the others until none is above.  The mix
takes every document of a source as many whole times as fit, and fits the rest of the
budget as a subset sum: documents are counted by their exact length, and along the
lengths every document has the same chance (systematic sampling from a seeded start), so
each length and each run of near ones gives its proportional part, at every size of
source.  That misses the budget by at most the longest document; a dynamic programme over
lengths in a seeded order puts documents in or takes them out until the sum is met.  For
every sum within ``DP_WORDS`` and the longest document of the budget it keeps the one step
that first reached it, so its memory doesn't grow with the number of lengths.  Where no
such sum meets the budget, the nearest is taken; what is farther off than that is never
nearer, so only the sums that lead through a detour beyond the window are left untried.
Within a length, documents are taken in the order of a seeded hash, so reruns agree.

Only counts by source and length meet in one task.  The documents of a length are dealt
into hash buckets, which are taken whole or not at all by their counts; a bucket in which
the quota ends is cut.  Only rows of cut buckets are ranked, over ranges and not in one
task, so that a bucket of any size (all rows of one id) is no hot spot.

Defined cases: null texts have size 0, and documents of size 0 are never taken; a null
source is one of its own, after all others; rows that repeat an id and a length are
alike, so which of them counts makes no difference; other columns pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.manifest import ranks
from .common import WORD_PATTERN, staged, table, text_of

BUCKETS = 256
#: Words on either side of the budget that the dynamic programme's sums may reach, besides the longest document.
DP_WORDS = 1 << 17
#: Cut buckets that may be broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_CELLS = 50_000


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD_PATTERN)).cast("long")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 5) -> np.ndarray:
    """How many documents of each length to take (at most ``counts``) so that the words come as near to ``budget`` as can be (from below where two sums are equally near)."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    budget = max(0, min(int(budget), total))
    if not budget:
        return np.zeros_like(counts)
    rng = np.random.default_rng(seed)
    rising = np.argsort(lengths, kind="stable")
    parts = np.floor(np.cumsum(counts[rising]) * (budget / total) + rng.random()).astype(np.int64)
    take = np.zeros_like(counts)
    take[rising] = np.minimum(np.diff(parts, prepend=0), counts[rising])
    left = budget - int((take * lengths).sum())
    # place ``zero`` stands for the sum so far; a sum above the budget may be the nearest
    zero = min(total, DP_WORDS + int(lengths.max()) + abs(left))
    goal = zero + left
    step = int(np.gcd.reduce(lengths))  # all sums are multiples of it
    best = goal - left % step if 2 * (left % step) <= step else goal + step - left % step
    reach = np.zeros(2 * zero + 1, bool)
    reach[zero] = True
    by = np.full(2 * zero + 1, -1, np.int32)  # the step that first reached a sum: its own sum before was reached by an earlier one
    steps: list[tuple[int, int]] = []
    order = np.argsort(rng.exponential(size=len(counts)) / np.maximum(counts, 1), kind="stable")  # as the first of each length comes in a shuffle of all documents
    into, out = counts - take, take.copy()
    for most in (1, total):  # one document of each length, then all
        for i in order:
            for sign, room in ((1, into), (-1, out)):
                n, unit = min(int(room[i]), most, 2 * zero // int(lengths[i])), 1
                room[i] -= n
                while n > 0 and not reach[best]:
                    k = min(unit, n)
                    shift = k * int(lengths[i])
                    fresh = np.zeros_like(reach)
                    if shift < len(reach):
                        if sign > 0:
                            fresh[shift:] = reach[:-shift]
                        else:
                            fresh[:-shift] = reach[shift:]
                    fresh &= ~reach
                    by[fresh] = len(steps)
                    reach |= fresh
                    steps.append((int(i), sign * k))
                    n -= k
                    unit *= 2
            if reach[best]:
                break
    under, over = np.flatnonzero(reach[: goal + 1]), np.flatnonzero(reach[goal + 1 :])
    at = int(under[-1]) if len(under) else -1
    if len(over) and (at < 0 or int(over[0]) + 1 < goal - at):
        at = goal + 1 + int(over[0])
    while at != zero:
        i, k = steps[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, share: float = 1.0) -> DataFrame:
    """``__source``, ``source_size`` and ``target`` of every source, from rows (``__source``, ``__size``).

    Filling levels: the sources below the level are capped and what they leave raises it,
    until no more fall below.  Each round is one sum over the table of sources, which is
    ranked by ranges, so that no task sees all sources.
    """
    ranked = ranks(staged(sizes.groupBy("__source").agg(F.sum("__size").alias("source_size")), "sources", 0), "__source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    rows = staged(ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most)), "sources", 0)
    everything = float(rows.agg(F.sum("source_size")).first()[0] or 0) * float(min(share, most))
    level, below = 0.0, -1
    while True:
        low = F.col("cap") < F.col("w") * level
        n, capped, open_ = rows.agg(F.count_if(low), F.sum(F.when(low, F.col("cap"))), F.sum(F.when(~low, F.col("w")))).first()
        if n == below or not open_:
            break
        below, level = n, (everything - (capped or 0.0)) / open_
    return rows.select("__source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def mix(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, share: float = 1.0, seed: int = 5, statistics: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``source_size``, ``target``, ``repeats`` (times that the mix takes the row) and ``taken`` (its words, repeats counted).

    ``statistics`` may name the same rows without their wide columns, for counting.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))  # null last
    draw = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed))
    marks = {"__source": key, "__size": F.col(size_col), "__draw": draw, "__bucket": F.pmod(F.shiftrightunsigned(draw, 40), F.lit(BUCKETS)).cast("int")}
    marked = rows.withColumns(marks)
    counted = (rows if statistics is None else statistics).withColumns(marks)
    goal = staged(targets(counted, weights, most, share), "targets", 0)
    cells = staged(counted.groupBy("__source", "__size", "__bucket").agg(F.count("*").alias("n")), "cells", counted.count())
    lengths = cells.groupBy("__source", "__size").agg(F.sum("n").alias("n")).filter("__size > 0").join(goal, "__source")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__size", ignore_index=True)
        size, goal = int(pdf["source_size"][0]), float(pdf["target"][0])
        full = min(most, int(goal // size))
        rest = 0 if full == most else int(round(goal - full * size))
        pdf["quota"] = fit_counts(pdf["__size"].to_numpy(), pdf["n"].to_numpy(), rest, zlib.crc32(f"{seed} {pdf['__source'][0]}".encode()))
        pdf["full"] = full
        return pdf[["__source", "__size", "full", "quota"]]

    quotas = lengths.groupBy("__source").applyInPandas(fit, "__source string, __size long, full long, quota long")
    earlier = Window.partitionBy("__source", "__size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = cells.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(quotas, ["__source", "__size"], "left")
    room = F.coalesce("quota", F.lit(0)) - F.col("earlier")
    plan = plan.select("__source", "__size", "__bucket", F.coalesce("full", F.lit(0)).alias("__full"), room.alias("__room"), "n").join(goal, "__source")
    plan = staged(plan.withColumn("__cut", (F.col("__room") > 0) & (F.col("__room") < F.col("n"))), "plan", 0)
    cell = ["__source", "__size", "__bucket"]
    clash = {"source_size", "target", "repeats", "taken"}
    kept = [c for c in rows.columns if c not in clash]
    out = marked.select(*kept, *marks)
    whole = out.join(plan.filter("not __cut"), cell).withColumn("repeats", F.col("__full") + (F.col("__room") > 0).cast("long"))
    # a number of the row itself parts rows that share id and draw, once it is written
    cells_cut = plan.filter("__cut")
    if cells_cut.count() <= BROADCAST_CELLS:
        cells_cut = F.broadcast(cells_cut)  # all rows need not be dealt a second time for the few that they find
    cut = staged(out.join(cells_cut, cell).withColumn("__row", F.monotonically_increasing_id()), "cut")
    ranked = ranks(cut, *cell, "__draw", "__row")
    first = ranked.groupBy(*cell).agg(F.min("position").alias("__first"))
    ranked = ranked.join(first, cell).withColumn("repeats", F.col("__full") + (F.col("position") - F.col("__first") < F.col("__room")).cast("long"))
    named = lambda df: df.select(*[F.col(c) for c in kept], "source_size", "target", "repeats", (F.col("repeats") * F.col("__size")).alias("taken"))
    return named(whole).unionByName(named(ranked))


def op6_mixing(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Query: what the mix takes of every document."""
    docs = docs if docs is not None else table(spark, sf_dir, "documents")
    rows = staged(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")
