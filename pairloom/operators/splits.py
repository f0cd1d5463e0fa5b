"""Leak-safe splits: every function returns rows or keys with a ``split`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.plans import components, hash_order, hash_rank, ordered_prefix
from pairloom.plans.ordering import null_safe


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def cut3(rank, n, f_train, f_val, at_least=0):
    """train/val/test by half-even rounded cut points."""
    a = F.greatest(F.lit(at_least), F.bround(n * f_train))
    b = F.greatest(F.lit(at_least), F.bround(n * f_val))
    return F.when(rank <= a, "train").when(rank <= a + b, "val").otherwise("test")


def group_split_map(df, keys, f_train=0.75, f_val=0.11, seed=42) -> DataFrame:
    keys = _list(keys)
    r = hash_rank(df.select(*keys).distinct(), [], keys, seed, rank="_rk", size="_n")
    return r.select(*keys, cut3(F.col("_rk"), F.col("_n"), f_train, f_val).alias("split"))


def group_split(df, keys, f_train=0.75, f_val=0.11, seed=42) -> DataFrame:
    return df.drop("split").join(group_split_map(df, keys, f_train, f_val, seed), _list(keys))


def stratified_group_split_map(df, group, strat, f_train=0.75, f_val=0.11, seed=42) -> DataFrame:
    """Groups split inside their majority stratum (ties: smallest value)."""
    counts = df.groupBy(group, strat).agg(F.count(F.lit(1)).alias("_c"))
    major = counts.groupBy(group).agg(F.min_by(strat, F.struct(-F.col("_c"), F.col(strat))).alias("stratum"))
    r = hash_rank(major, "stratum", group, seed, rank="_rk", size="_n")
    return r.select(group, "stratum", cut3(F.col("_rk"), F.col("_n"), f_train, f_val, at_least=1).alias("split"))


def drop_seen(train, val, test, key="rna_sequence", val_too=False):
    """Eval rows whose key occurs in train (and, for test, optionally in val) go."""
    seen = train.select(key).distinct()
    val_out = val.join(seen, key, "left_anti")
    barred = seen.unionByName(val.select(key)).distinct() if val_too else seen
    return val_out, test.join(barred, key, "left_anti")


def strict_split(df, group, key="rna_sequence", seed=42) -> DataFrame:
    """Group split with eval rows dropped whose sequence occurs in train."""
    s = group_split(df, group, seed=seed)
    train = s.where(F.col("split") == "train")
    seen = train.select(key).distinct().withColumn("_seen", F.lit(1))
    return s.join(seen, key, "left").where((F.col("split") == "train") | F.col("_seen").isNull()).drop("_seen")


def strict_stats(df, group, key="rna_sequence", seed=42) -> DataFrame:
    """Rows per split before and after, and how many sequences overlapped train."""
    s = group_split(df, group, seed=seed)
    per_key = s.groupBy("split", key).agg(F.count(F.lit(1)).alias("_n"))
    seen = s.where(F.col("split") == "train").select(key).distinct().withColumn("_seen", F.lit(1))
    j = per_key.join(seen, key, "left").withColumn(
        "_hit", (F.col("_seen").isNotNull() & (F.col("split") != "train")).cast("int")
    )
    return j.groupBy("split").agg(
        F.sum("_n").alias("rows_before"),
        F.sum(F.col("_n") * (1 - F.col("_hit"))).alias("rows_after"),
        F.count(F.lit(1)).alias("sequences"),
        F.sum("_hit").alias("sequences_in_train"),
    )


def _new_groups(new: DataFrame, key, seed, f_val, f_test) -> DataFrame:
    """Truncated quotas of at least one group; order train, val, test."""
    r = hash_rank(new, [], key, seed, rank="_rk", size="_n")
    n_val = F.greatest(F.lit(1), F.floor(F.col("_n") * f_val))
    n_test = F.greatest(F.lit(1), F.floor(F.col("_n") * f_test))
    n_train = F.col("_n") - n_val - n_test
    return r.select(
        key,
        F.when(F.col("_rk") <= n_train, "train").when(F.col("_rk") <= n_train + n_val, "val").otherwise("test").alias("split"),
    )


def carry_forward(new: DataFrame, split_map: DataFrame, train_only, key="protein_name", source="dataset_source", f_val=0.1, f_test=0.1, seed=42) -> DataFrame:
    """Known groups keep their split, listed sources train only, new groups are cut."""
    forced = F.col(source).isin(list(train_only))
    fresh = new.where(~F.coalesce(forced, F.lit(False))).select(key).distinct().join(split_map.select(key), key, "left_anti")
    full = split_map.select(key, "split").unionByName(_new_groups(fresh, key, seed, f_val, f_test))
    return new.drop("split").join(full, key, "left").withColumn(
        "split", F.when(F.coalesce(forced, F.lit(False)), "train").otherwise(F.col("split"))
    )


def homology_split_map(panel: DataFrame, split_map: DataFrame, hits: DataFrame, key="protein_name", f_val=0.1, f_test=0.1, seed=42) -> DataFrame:
    """Known name keeps its split; homolog of an eval group trains; the rest is cut.

    All comparisons are upper-case on both sides.
    """
    up = F.upper(F.col(key))
    names = panel.select(F.col(key)).distinct().withColumn("_k", up)
    known = split_map.select(up.alias("_k"), F.col("split").alias("_known")).dropDuplicates(["_k"])
    both = hits.select(F.upper("query").alias("_k"), F.upper("target").alias("_o")).unionByName(
        hits.select(F.upper("target").alias("_k"), F.upper("query").alias("_o"))
    )
    held = known.where(F.col("_known") != "train").select(F.col("_k").alias("_o"))
    blocked = both.distinct().join(held, "_o", "left_semi").select("_k").distinct().withColumn("_blocked", F.lit(1))
    j = names.join(known, "_k", "left").join(blocked, "_k", "left")
    fresh = j.where(F.col("_known").isNull() & F.col("_blocked").isNull()).select(key)
    cut = _new_groups(fresh, key, seed, f_val, f_test)
    return (
        j.join(cut, key, "left")
        .select(
            key,
            F.coalesce(F.col("_known"), F.when(F.col("_blocked") == 1, "train"), F.col("split")).alias("split"),
            F.when(F.col("_known").isNotNull(), "name_match").when(F.col("_blocked") == 1, "homolog_blocked").otherwise("new").alias("rule"),
        )
    )


def link_filter(hits, min_id=0.4, cov=0.5, hi_id=0.7, hi_cov=0.1) -> DataFrame:
    mx = F.greatest("qcov", "tcov")
    return hits.where(
        ((F.col("fident") >= min_id) & (mx >= cov)) | ((F.col("fident") >= hi_id) & (mx >= hi_cov))
    ).select("query", "target")


def connected_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Single-linkage clusters (node, cluster = smallest member) over links between the nodes.

    Alternating stars settle any chain in about log n rounds; there is no round limit.
    """
    known = nodes.select("node").distinct()
    e = links.select(F.col("query").alias("a"), F.col("target").alias("b"))
    for end in ("a", "b"):
        e = e.join(known.withColumnRenamed("node", end), end, "left_semi")
    found = components(e)
    return known.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("cluster"))


def allocate_clusters(clusters: DataFrame, f_test=0.12, f_val=0.11, holdout=None, seed=42) -> DataFrame:
    """Per family, in seeded order: fill test, then val, the rest trains.

    A cluster above half the test quota trains and does not count.  As test takes
    exactly the clusters whose running total is below the quota, the greedy fill
    is a running sum, and no family is gathered in one task.
    ``clusters`` has cluster_id, family, n_rows.
    """
    totals = clusters.groupBy("family").agg(F.sum("n_rows").alias("_tot"))
    j = clusters.join(totals, "family")
    giant = F.col("n_rows") > 0.5 * f_test * F.col("_tot")
    j = j.withColumns({"_w": F.when(giant, 0).otherwise(F.col("n_rows")), "_h": hash_order(seed, "cluster_id")})
    pre = ordered_prefix(j, "family", ["_h", "cluster_id"], {"_before": "_w"})
    quota_t, quota_v = f_test * F.col("_tot"), f_val * F.col("_tot")
    pre = pre.withColumn("_in_test", (F.col("_w") > 0) & (F.col("_before") < quota_t))
    test = pre.groupBy("family").agg(F.coalesce(F.sum(F.when(F.col("_in_test"), F.col("_w"))), F.lit(0)).alias("_t"))
    j2 = pre.join(test, "family")
    split = (
        F.when(F.col("_w") == 0, "train")
        .when(F.col("_in_test"), "test")
        .when(F.col("_before") - F.col("_t") < quota_v, "val")
        .otherwise("train")
    )
    if holdout is not None:
        split = F.when(F.col("family") == holdout, "test").otherwise(split)
    return j2.select("cluster_id", "family", "n_rows", split.alias("split"))


def stratified_rows(df, group, key, label="binding_label", f_test=0.2, f_val=0.2, min_class=5, seed=42) -> DataFrame:
    """Per group and label 60/20/20 rows; groups short of a class are dropped."""
    big = (
        df.groupBy(group)
        .agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_q"))
        .where((F.col("_p") >= min_class) & (F.col("_q") >= min_class))
        .select(group)
    )
    r = hash_rank(df.drop("split").join(big, group, "left_semi"), [group, label], key, seed, rank="_rk", size="_n")
    n_test = F.bround(F.col("_n") * f_test)
    n_val = F.bround((F.col("_n") - n_test) * (f_val / (1 - f_test)))
    n_train = F.col("_n") - n_test - n_val
    split = F.when(F.col("_rk") <= n_train, "train").when(F.col("_rk") <= n_train + n_val, "val").otherwise("test")
    return r.withColumn("split", split).drop("_rk", "_n")


def fold_map(df, k: int, by, seed=42) -> DataFrame:
    """The fold of each group of ``by``."""
    by = _list(by)
    f = hash_rank(df.select(*by).distinct(), [], by, seed, rank="_rk")
    return f.select(*by, ((F.col("_rk") - 1) % k).cast("int").alias("fold"))


def kfold(df, k: int, key, by=None, label=None, seed=42) -> DataFrame:
    """Fold ids: plain, stratified by ``label``, or whole groups with ``by``."""
    if by:
        return df.join(fold_map(df, k, by, seed), _list(by))
    r = hash_rank(df, [label] if label else [], key, seed, rank="_rk")
    return r.withColumn("fold", ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")


def holdout_units(df, unit, frac=0.2, seed=42) -> DataFrame:
    """Flag rows of a seeded share of units (at least one unit)."""
    u = hash_rank(df.select(unit).distinct(), [], unit, seed, rank="_rk", size="_n")
    held = F.col("_rk") <= F.greatest(F.lit(1), F.floor(F.col("_n") * frac))
    return df.join(u.select(unit, held.cast("int").alias("held_out")), unit)


def unit_of(name):
    return F.get(F.split(F.col(name), r"\|"), F.lit(0))
