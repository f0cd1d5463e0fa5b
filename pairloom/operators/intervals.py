"""Interval joins without bins that can run hot and without pair output.

Intervals are half-open and non-empty.  ``interval_any`` needs only a running
maximum by start.  ``interval_max`` cuts ranges into dyadic blocks, so each side
touches O(log length) keys and the looked-up side is pre-aggregated to one row
per key: a crowded region never meets row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.plans import ordered_prefix, top_per_group

AT = ["chrom", "start_pos", "end_pos"]


def dyadic_cover(lo, hi):
    """array<struct<lvl, blk>> of the aligned blocks that tile [lo, hi)."""
    lo, hi = (F.col(c) if isinstance(c, str) else c for c in (lo, hi))
    top = F.when(hi > lo, F.ceil(F.log2((hi - lo).cast("double"))) + 1).otherwise(F.lit(0)).cast("int")

    def at_level(j):
        size = F.call_function("shiftleft", F.lit(1).cast("long"), j)
        a, b = F.floor((lo + size - 1) / size).cast("long"), F.floor(hi / size).cast("long")
        left = F.when((a < b) & (a % 2 == 1), F.struct(j.alias("lvl"), a.alias("blk")))
        right = F.when((a < b) & (b % 2 == 1), F.struct(j.alias("lvl"), (b - 1).alias("blk")))
        return F.array_distinct(F.array_compact(F.array(left, right)))

    return F.flatten(F.transform(F.sequence(F.lit(0), top), at_level))


def point_blocks(df: DataFrame, pos: str, top, kind: str, *keep) -> DataFrame:
    """Rows repeated for the block of ``pos`` at every level up to ``top``."""
    rows = df.withColumn("_top", top).select(*df.columns, F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("lvl"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("lvl"))
    return rows.select(*keep, F.lit(kind).alias("kind"), "lvl", F.floor(F.col(pos) / size).cast("long").alias("blk"))


def _top_level(df: DataFrame):
    longest = F.max(F.col("end_pos") - F.col("start_pos")).cast("double")
    return df.agg(F.coalesce(F.ceil(F.log2(longest)) + 1, F.lit(0)).cast("int")).scalar()


def interval_max(a: DataFrame, b: DataFrame, value="score", out="max_value") -> DataFrame:
    """Largest value among strictly overlapping intervals of the chrom; none gives null."""
    av = a.select(*AT).distinct()
    bv = b.groupBy(*AT).agg(F.max(value).alias("_v"))
    # overlap = b starts inside (a.start, a.end)  or  b covers the point a.start
    starts = point_blocks(bv, "start_pos", _top_level(a), "s", "chrom", "_v")
    covers = bv.select("chrom", "_v", F.lit("c").alias("kind"), F.explode(dyadic_cover("start_pos", "end_pos")).alias("k"))
    covers = covers.select("chrom", "_v", "kind", "k.lvl", "k.blk")
    table = starts.unionByName(covers).groupBy("chrom", "kind", "lvl", "blk").agg(F.max("_v").alias("_v"))
    inside = av.select(*AT, F.lit("s").alias("kind"), F.explode(dyadic_cover(F.col("start_pos") + 1, F.col("end_pos"))).alias("k"))
    inside = inside.select(*AT, "kind", "k.lvl", "k.blk")
    probes = inside.unionByName(point_blocks(av, "start_pos", _top_level(b), "c", *AT))
    best = probes.join(table, ["chrom", "kind", "lvl", "blk"]).groupBy(*AT).agg(F.max("_v").alias(out))
    return a.join(best, AT, "left")


def interval_any(a: DataFrame, b: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of a that overlap (or, with keep=False, do not overlap) any b.

    Some b overlaps iff the largest end among the b that start before a.end lies
    beyond a.start: one running maximum.
    """
    null = F.lit(None).cast("long")
    asks = a.select("chrom", F.col("end_pos").alias("at"), F.lit(0).alias("kind"), "start_pos", null.alias("reach_end")).distinct()
    adds = b.groupBy("chrom", F.col("start_pos").alias("at")).agg(F.max("end_pos").alias("reach_end"))
    adds = adds.select("chrom", "at", F.lit(1).alias("kind"), null.alias("start_pos"), "reach_end")
    pre = ordered_prefix(asks.unionByName(adds), "chrom", ["at", "kind", "start_pos"], maxes={"reach": "reach_end"})
    hit = pre.where((F.col("kind") == 0) & (F.col("reach") > F.col("start_pos"))).select("chrom", "start_pos", F.col("at").alias("end_pos"))
    return a.join(hit, AT, "left_semi" if keep else "left_anti")


def merge_intervals(df: DataFrame, by="chrom") -> DataFrame:
    """Union of overlapping or touching intervals per chrom."""
    by = [by] if isinstance(by, str) else list(by)
    s = df.groupBy(*by, "start_pos").agg(F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n"))
    reach = ordered_prefix(s, by, "start_pos", maxes={"reach": "end_pos"})
    flagged = reach.withColumn("_new", F.when(F.col("reach").isNull() | (F.col("start_pos") > F.col("reach")), 1).otherwise(0))
    isl = ordered_prefix(flagged, by, "start_pos", sums={"_before": "_new"})
    return (
        isl.groupBy(*by, (F.col("_before") + F.col("_new")).alias("island"))
        .agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.sum("n").alias("n"))
    )


def flank_negatives(peaks: DataFrame, key: str, window=60, mult=3, ratio=2) -> DataFrame:
    """Flanking windows, alternately up and down, that overlap no peak; ``ratio`` per peak."""
    half = window // 2
    tries = 2 * (ratio // 2 + 1)
    c = peaks.select(
        key, "chrom", "strand", "summit", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("i")
    )
    side = F.when(F.col("i") % 2 == 0, 1).otherwise(-1)
    center = F.col("summit") + side * mult * window * (F.floor(F.col("i") / 2) + 1)
    c = c.withColumns({"center": center, "start_pos": F.greatest(F.lit(1), center - half)})
    c = c.withColumn("end_pos", F.col("start_pos") + window)
    free = interval_any(c, peaks.select(*AT), keep=False)
    out = top_per_group(free, key, ["i"], ratio)
    return out.withColumn("score", F.lit(0.0)).drop("i", "rk")
