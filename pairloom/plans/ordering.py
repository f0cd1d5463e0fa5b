"""Order-dependent work without a one-task sort.

``hash_rank``       exact seeded permutation; each group is cut in 4096 even
                    slices by the first three hex digits of its digest.
``ordered_prefix``  exact running sums/maxima by value; one range partitioning
                    over (group, value), slice totals, then a local window.
``quantiles``       exact interpolated quantiles on top of ``ordered_prefix``.

A group that holds a third of the table is spread over many tasks in all three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.plans.lineage import cut_lineage


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def hash_order(seed, *cols) -> Column:
    """sha256 digest of ``seed|col|col`` as hex: the library's permutation key."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def seed_long(seed, *cols) -> Column:
    """First eight hex digits of the digest as a number."""
    return F.conv(F.substring(hash_order(seed, *cols), 1, 8), 16, 10).cast("long")


def keyed(df: DataFrame, keys, key="__k") -> DataFrame:
    """Add the keys as one struct: structs compare null equal to null, and a join and a
    window on the same struct share one shuffle."""
    return df.withColumn(key, F.struct(*_names(keys)))


def null_safe(left: DataFrame, right: DataFrame, keys, how="inner", keep_key=False) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; keeps the left key columns."""
    keys = _names(keys)
    out = keyed(left, keys).join(keyed(right, keys).drop(*keys), "__k", how)
    return out if keep_key else out.drop("__k")


def hash_rank(df: DataFrame, group, keys, seed, rank="rk", size=None) -> DataFrame:
    """Add the 1-based position in the seeded permutation of each group.

    ``keys`` must identify a row inside its group.  ``size`` optionally names a
    column with the group's row count.
    """
    group, keys = _names(group), _names(keys)
    digest = hash_order(seed, *keys)
    # bytes sort as their hex digits do and are half as long
    sliced = df.withColumns({"__h": F.unhex(digest), "__slice": F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")})
    # at most 4096 slice rows per group reach this window
    per_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    counts = sliced.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.select(
        *group,
        "__slice",
        F.coalesce(
            F.sum("__c").over(per_group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
        F.sum("__c").over(per_group).alias("__n"),
    )
    joined = null_safe(sliced, offsets, [*group, "__slice"], keep_key=True)
    local = Window.partitionBy("__k").orderBy("__h", *keys)
    out = joined.withColumn(rank, F.row_number().over(local) + F.col("__off"))
    if size:
        out = out.withColumn(size, F.col("__n"))
    return out.drop("__h", "__slice", "__off", "__n", "__k")


def ordered_prefix(
    df: DataFrame, group, order, sums: dict | None = None, maxes: dict | None = None, totals: bool = False
) -> DataFrame:
    """Add running values over all *earlier* rows of the group in ``order``.

    ``sums`` / ``maxes`` map an output name to a numeric column name.  Sums start
    at 0, maxima at null.  With ``totals`` each sum also gets ``<name>_total``.
    ``order`` should be (nearly) unique inside the group: aggregate ties first.
    """
    group, order = _names(group), _names(order)
    sums, maxes = sums or {}, maxes or {}
    ranged = df.repartitionByRange(*[F.col(c) for c in group + order])
    chunked = cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()))
    aggs = [F.sum(c).alias(f"_s_{o}") for o, c in sums.items()] + [F.max(c).alias(f"_m_{o}") for o, c in maxes.items()]
    # one row per (group, range partition): bounded by the partition count
    per = chunked.groupBy(*group, "_chunk").agg(*aggs)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in sums]
    cols += [F.max(f"_m_{o}").over(earlier).alias(f"_o_{o}") for o in maxes]
    if totals:
        cols += [F.sum(f"_s_{o}").over(whole).alias(f"{o}_total") for o in sums]
    offsets = per.select(*group, "_chunk", *cols)
    joined = null_safe(chunked, offsets, [*group, "_chunk"], keep_key=True)
    local = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {o: F.coalesce(F.sum(c).over(local), F.lit(0)) + F.col(f"_o_{o}") for o, c in sums.items()}
    added |= {o: F.greatest(F.max(c).over(local), F.col(f"_o_{o}")) for o, c in maxes.items()}
    return joined.withColumns(added).drop("_chunk", "__k", *[f"_o_{o}" for o in [*sums, *maxes]])


def quantiles(df: DataFrame, group, value, probs: dict, weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group; one output column per prob."""
    group = _names(group)
    w = F.sum(weight) if weight else F.count(F.lit(1))
    cells = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(w.alias("_c"))
    pre = ordered_prefix(cells, group, "_v", {"_before": "_c"}, totals=True)
    aggs, final = [], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_before_total") - 1)
        hit = lambda at: F.max(
            F.when((F.col("_before") <= at) & (at < F.col("_before") + F.col("_c")), F.col("_v"))
        )
        aggs += [hit(F.floor(pos)).alias(f"_lo_{name}"), hit(F.ceil(pos)).alias(f"_hi_{name}")]
        aggs += [F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        final.append((lo + (hi - lo) * F.col(f"_f_{name}")).cast("double").alias(name))
    return pre.groupBy(*group).agg(*aggs).select(*group, *final)


def with_quantiles(summary: DataFrame, df: DataFrame, group, value, probs: dict) -> DataFrame:
    """``summary`` (one row a group) with the exact quantiles of df beside it; null without values."""
    group = _names(group)
    q = quantiles(df, group, value, probs)
    if group:
        return null_safe(summary, q, group, "left")
    return summary.select("*", *[q.select(name).scalar().alias(name) for name in probs])


def top_per_group(df: DataFrame, group, order, n: int, rank="rk") -> DataFrame:
    """First n rows per group.

    The literal bound on row_number lets Spark keep at most n rows per group and
    input partition before the shuffle, so a hot group never moves whole.
    """
    group = _names(group)
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
