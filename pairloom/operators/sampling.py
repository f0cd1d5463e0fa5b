"""Reproducible sampling.

Every draw is a cut of the seeded permutation.  Fixed small quotas use a bounded
``row_number`` (kept per input partition before the shuffle); quotas that depend
on the data use ``hash_rank``, which spreads a hot stratum over 4096 slices.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pairloom.functions.sequence import gc_fraction
from pairloom.plans import hash_order, hash_rank, ordered_prefix, quantiles, top_per_group
from pairloom.plans.ordering import null_safe

WINDOW_LIMIT = 1000  # largest bound Spark pushes below the shuffle


def count_scalar(df: DataFrame):
    return df.agg(F.count(F.lit(1))).scalar()


def stratified_cap(df, n: int, strata, keys, seed=42, trim=False) -> DataFrame:
    """At most about n rows, keeping strata shares: k = max(1, round(n * share))."""
    total = count_scalar(df)
    ranked = hash_rank(df, strata, keys, seed, rank="_rk", size="_sz").withColumn("_total", total)
    k = F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("_sz") / F.col("_total")))
    out = ranked.where((F.col("_total") <= n) | (F.col("_rk") <= k))
    if trim:
        small = hash_rank(out, [], keys, f"{seed}|trim", rank="_t")
        out = small.where((F.col("_total") <= n) | (F.col("_t") <= n)).drop("_t")
    return out.drop("_rk", "_sz", "_total")


def group_cap(df, group, n: int, keys, seed=42) -> DataFrame:
    """At most n uniform rows per group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if n <= WINDOW_LIMIT:
        h = df.withColumn("_h", hash_order(seed, *keys))
        return top_per_group(h, group, ["_h", *keys], n, rank="_rk").drop("_h", "_rk")
    return hash_rank(df, group, keys, seed, rank="_rk").where(F.col("_rk") <= n).drop("_rk")


def quartile_sample(df, group, value, key, n: int, seed=42) -> DataFrame:
    """n rows per group spread over value quartiles, topped up from the rest."""
    q = quantiles(df, group, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    v = F.col(value)
    binned = (
        null_safe(null_safe(df, q, group), sizes, group)
        .withColumn("_bin", F.when(v <= F.col("_q1"), 0).when(v <= F.col("_q2"), 1).when(v <= F.col("_q3"), 2).otherwise(3))
        .withColumn("_h", hash_order(seed, key))
    )
    per = max(1, n // 4)
    # the first n of each bin hold every row that can be picked or topped up
    ranked = top_per_group(binned, [group, "_bin"], ["_h", key], n, rank="_rk")
    ranked = ranked.withColumn("_first", (F.col("_rk") <= per).cast("int"))
    out = top_per_group(ranked, group, [F.desc("_first"), "_h", key], n, rank="_pick")
    return out.drop("_q1", "_q2", "_q3", "_n", "_bin", "_h", "_rk", "_first", "_pick")


def spectrum_sample(df, group: str, value: str, key: str, n: int = 100) -> DataFrame:
    """n rows at evenly spaced percentiles, nearest unused row per target.

    Only rows within n+1 ranks of a target can be picked, so at most n(2n+3) rows
    of a group reach the greedy step, however large the group is.
    """
    rows = df.where(F.col(value).isNotNull()).select(group, key, value)
    pre = ordered_prefix(rows.withColumn("_one", F.lit(1)), group, [value, key], {"rk": "_one"}, totals=True)
    total = F.col("rk_total")
    m = F.least(F.lit(n), total)
    step = F.when(m > 1, (100 - 1 / m) / (m - 1)).otherwise(F.lit(1.0))
    span = F.greatest(total - 1, F.lit(1))
    nearest = F.least(F.greatest(F.round((F.col("rk") / span * 100 - 0.5 / m) / step), F.lit(0)), m - 1)
    at = (0.5 / m + nearest * step) / 100 * (total - 1)
    near = pre.where(F.abs(F.col("rk") - at) <= n + 1).select(group, key, value, "rk", "rk_total")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rk")
        rk, v, count = pdf["rk"].to_numpy(), pdf[value].to_numpy(float), int(pdf["rk_total"].iloc[0])
        take = min(n, count)
        used = np.zeros(len(pdf), bool)
        out = []
        for i, pct in enumerate(np.linspace(0.5 / take, 100 - 0.5 / take, take)):
            pos = pct / 100 * (count - 1)
            lo, hi = (v[np.searchsorted(rk, f)] for f in (math.floor(pos), math.ceil(pos)))
            target = lo + (hi - lo) * (pos - math.floor(pos))
            j = int(np.argmin(np.where(used, np.inf, np.abs(v - target))))
            used[j] = True
            out.append((pdf[group].iloc[0], pdf[key].iloc[j], v[j], i + 1, pct, target))
        return pd.DataFrame(out, columns=[group, key, value, "spectrum_rank", "target_percentile", "target_value"])

    schema = df.select(group, key).schema.simpleString()[7:-1].replace(":", " ")
    return near.groupBy(group).applyInPandas(
        pick, f"{schema}, {value} double, spectrum_rank int, target_percentile double, target_value double"
    )


def nearest_first(pos: dict, neg: dict, reach: float) -> dict:
    """{(label, value): rows taken} when the closest free pair at most ``reach`` apart is always taken next.

    pos, neg: {value: rows}.  Of the values still free the closest pair are neighbours in
    order, so only neighbours wait in the heap.  Ties: the smaller value first.
    """
    taken: dict = {}

    def take(a, b, k):
        for key in ((1, a), (0, b)):
            taken[key] = taken.get(key, 0) + k

    values, free, label = [], [], []
    for v in sorted(pos.keys() | neg.keys()):
        p, n = pos.get(v, 0), neg.get(v, 0)
        if min(p, n):
            take(v, v, min(p, n))
        if p != n:
            values.append(v)
            free.append(abs(p - n))
            label.append(1 if p > n else 0)
    before, after = list(range(-1, len(values) - 1)), list(range(1, len(values) + 1))
    heap: list = []

    def meet(i, j):
        if 0 <= i and j < len(values) and label[i] != label[j] and values[j] - values[i] <= reach:
            heapq.heappush(heap, (values[j] - values[i], i, j))

    for i in range(len(values) - 1):
        meet(i, i + 1)
    while heap:
        _, i, j = heapq.heappop(heap)
        if not (free[i] and free[j]):
            continue
        k = min(free[i], free[j])
        a, b = (i, j) if label[i] else (j, i)
        take(values[a], values[b], k)
        for x in (i, j):
            free[x] -= k
            if not free[x]:
                lo, hi = before[x], after[x]
                if lo >= 0:
                    after[lo] = hi
                if hi < len(values):
                    before[hi] = lo
                meet(lo, hi)
    return taken


def gc_match(df, group: str, key: str, label="binding_label", seq="rna_sequence", caliper=0.02, seed=42) -> DataFrame:
    """Pair positives with the nearest-GC unused negatives of the group, 1:1.

    A group of any size becomes a histogram of its GC values, of which there are as many as
    fractions of letters, not of rows.  Nearest-first matching runs on that histogram and
    holds real distances against the caliper; rows are then taken from each value in seeded order.
    """
    cells = df.withColumn("_gc", gc_fraction(seq))
    hist = cells.where(F.col("_gc").isNotNull()).groupBy(group, label, "_gc").agg(F.count(F.lit(1)).alias("_n"))
    # a difference of two fractions is off by less than this
    reach = caliper + 1e-12

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        free = {lab: dict(zip(g["_gc"], g["_n"])) for lab, g in pdf.groupby(label)}
        taken = nearest_first(free.get(1, {}), free.get(0, {}), reach)
        rows = [(pdf[group].iloc[0], lab, v, k) for (lab, v), k in taken.items()]
        return pd.DataFrame(rows, columns=[group, label, "_gc", "_take"])

    gtype = dict(df.dtypes)
    taken = hist.groupBy(group).applyInPandas(match, f"{group} {gtype[group]}, {label} {gtype[label]}, _gc double, _take long")
    ranked = hash_rank(cells, [group, label, "_gc"], key, seed, rank="_rk")
    return (
        ranked.join(taken, [group, label, "_gc"])
        .where(F.col("_rk") <= F.col("_take"))
        .withColumn("gc", F.col("_gc"))
        .drop("_gc", "_rk", "_take")
    )
