"""Ranking metrics and statistics.

All ranking metrics start from (group, score) cells with their label counts.
The cells are range-partitioned by (group, score), so one group, or no group at
all, still spreads over the cluster.  Medians over *groups* use Spark's exact
``with_quantiles`` on the already aggregated table (one row per group).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.sequence import au_fraction, gc_fraction
from pairloom.plans import cut_lineage, hash_rank, ordered_prefix, quantiles, top_per_group, with_quantiles
from pairloom.plans.ordering import null_safe

LABEL = "binding_label"


def _list(x):
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def cells(df, group, score, label=LABEL, weight=None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*_list(group), F.col(score).alias("_s")).agg(
        F.sum(F.col(label) * w).alias("_p"), F.sum((1 - F.col(label)) * w).alias("_n")
    )


def ranking(df, group, score, label=LABEL, weight=None) -> DataFrame:
    """AUROC (mid-rank ties) and average precision per group in one sorted pass.

    Both are null when a class is missing.
    """
    return ranked_cells(cells(df, group, score, label, weight), group)


def ranked_cells(cell: DataFrame, group) -> DataFrame:
    """``ranking`` of ``cells``."""
    group = _list(group)
    pre = ordered_prefix(cell, group, "_s", {"_pb": "_p", "_nb": "_n"}, totals=True)
    tp, fp = F.col("_pb_total") - F.col("_pb"), F.col("_nb_total") - F.col("_nb")
    pre = pre.withColumns(
        {"_u": F.col("_p") * (F.col("_nb") + F.col("_n") / 2.0), "_a": F.when(F.col("_p") > 0, F.col("_p") * tp / (tp + fp)).otherwise(0.0)}
    )
    g = pre.groupBy(*group).agg(
        F.sum("_u").alias("_u"), F.sum("_a").alias("_a"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg")
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return g.select(
        *group,
        F.when(both, F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"),
        F.when(both, F.col("_a") / F.col("n_pos")).alias("auprc"),
        "n_pos",
        "n_neg",
    )


def auroc(df, group, score, label=LABEL) -> DataFrame:
    return ranking(df, group, score, label).drop("auprc")


def auprc(df, group, score, label=LABEL) -> DataFrame:
    return ranking(df, group, score, label).drop("auroc")


def threshold_metrics(df, group=None, score="score", label=LABEL, thr=0.5) -> DataFrame:
    y, hit = F.col(label), (F.col(score) >= thr).cast("int")
    a = df.groupBy(*_list(group)).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(y).alias("n_positive"),
        F.sum(y * hit).alias("tp"),
        F.sum((1 - y) * hit).alias("fp"),
        F.sum(y * (1 - hit)).alias("fn"),
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier_score"),
    )
    z = lambda num, den: F.coalesce(F.try_divide(num, den), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.select(
        *_list(group), "n_samples", "n_positive",
        ((F.col("n_samples") - fp - fn) / F.col("n_samples")).alias("accuracy"),
        z(2 * tp, 2 * tp + fp + fn).alias("f1"), z(tp, tp + fp).alias("precision"), z(tp, tp + fn).alias("recall"),
        "brier_score", (F.col("n_positive") / F.col("n_samples")).alias("positive_rate"),
    )


def per_group_metrics(df, group="protein_name", score="score", label=LABEL, min_examples=10, min_class=1) -> DataFrame:
    """AUROC/AUPRC with a note: too_few_examples, single_class or ok."""
    r = ranking(df, group, score, label)
    n = F.col("n_pos") + F.col("n_neg")
    note = (
        F.when(n < min_examples, "too_few_examples")
        .when((F.col("n_pos") < min_class) | (F.col("n_neg") < min_class), "single_class")
        .otherwise("ok")
    )
    r = r.withColumns({"n_examples": n, "note": note})
    ok = F.col("note") == "ok"
    return r.select(
        *_list(group), F.when(ok, F.col("auroc")).alias("auroc"), F.when(ok, F.col("auprc")).alias("auprc"), "n_examples",
        F.col("n_pos").alias("n_positive"), "note",
    )


def sorted_groups(per_group) -> DataFrame:
    return per_group.orderBy(F.desc_nulls_last("auroc"))


def group_summary(per_group, by=None, value="auroc", flag_below=0.6) -> DataFrame:
    v = F.col(value)
    over = lambda t: F.avg((v > t).cast("double"))
    rows = cut_lineage(per_group.where(v.isNotNull()))
    summary = rows.groupBy(*_list(by)).agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg(value).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"), over(0.5).alias("share_above_05"),
        over(0.6).alias("share_above_06"), over(0.7).alias("share_above_07"),
        F.sum((v < flag_below).cast("int")).alias("n_flagged"),
    )
    return with_quantiles(summary, rows, _list(by), value, {"median": 0.5})


def composition_baseline(test, train, group="protein_name", key="pair_id", seq="rna_sequence", seed=42) -> DataFrame:
    """How far GC or AU content alone separates the labels, before and after GC matching."""
    from pairloom.operators.sampling import gc_match

    t = test.withColumns({"gc": gc_fraction(seq), "au": au_fraction(seq)})
    m = gc_match(test, group, key, seq=seq, seed=seed).withColumns({"gc": gc_fraction(seq), "au": au_fraction(seq)})
    parts = []
    for subset, d in (("all", t), ("gc_matched", m)):
        long = d.select(group, LABEL, F.explode(F.create_map(F.lit("gc"), "gc", F.lit("au"), "au")).alias("feature", "score"))
        whole = auroc(long, "feature", "score").select("feature", "auroc", (F.col("n_pos") + F.col("n_neg")).alias("n"))
        by_group = cut_lineage(auroc(long, ["feature", group], "score"))
        parts.append(with_quantiles(whole, by_group, "feature", "auroc", {"group_median": 0.5}).withColumn("subset", F.lit(subset)))
    seen = train.select(seq).distinct().withColumn("_s", F.lit(1))
    share = test.select(seq).distinct().join(seen, seq, "left").agg(F.avg(F.coalesce("_s", F.lit(0))).alias("x")).scalar()
    return _union(parts).withColumn("share_rna_in_train", share)


def calibration(df, score, label=LABEL, bins=15, group=None) -> DataFrame:
    """Quantile bins by edges (equal scores never split); mean prediction and observed rate."""
    group = _list(group)
    names = {f"_e{i}": i / bins for i in range(1, bins)}
    edges = quantiles(df, group, score, names)
    edges = edges.select(*group, F.array_distinct(F.array(*names)).alias("_edges"))
    per = cells(df, group, score, label).withColumn("_c", F.col("_p") + F.col("_n"))
    j = null_safe(per, edges, group) if group else per.withColumn("_edges", edges.select("_edges").scalar())
    b = F.size(F.filter("_edges", lambda e: e < F.col("_s")))
    return j.groupBy(*group, b.alias("bin")).agg(
        F.sum("_c").alias("n"),
        (F.sum(F.col("_s") * F.col("_c")) / F.sum("_c")).alias("mean_predicted"),
        (F.sum("_p") / F.sum("_c")).alias("observed_rate"),
    )


def expected_calibration_error(bins: DataFrame, group=None) -> DataFrame:
    return bins.groupBy(*_list(group)).agg(
        F.avg(F.abs(F.col("observed_rate") - F.col("mean_predicted"))).alias("ece"), F.count(F.lit(1)).alias("n_bins")
    )


def confusion(df, group, score, label=LABEL, thr=0.5, extreme=0.7) -> DataFrame:
    y, hit = F.col(label), (F.col(score) >= thr).cast("int")
    a = df.groupBy(*_list(group)).agg(
        F.sum(y * hit).alias("tp"), F.sum((1 - y) * (1 - hit)).alias("tn"), F.sum((1 - y) * hit).alias("fp"), F.sum(y * (1 - hit)).alias("fn")
    )
    a = a.withColumns({"fpr": F.try_divide("fp", F.col("fp") + F.col("tn")), "fnr": F.try_divide("fn", F.col("fn") + F.col("tp"))})
    return a.withColumns(
        {"extreme_fpr": F.coalesce((F.col("fpr") > extreme).cast("int"), F.lit(0)), "extreme_fnr": F.coalesce((F.col("fnr") > extreme).cast("int"), F.lit(0))}
    )


def strata_of(df, columns: dict, identity=None) -> DataFrame:
    """Rows repeated for each stratum they belong to (a handful), plus cumulative identity cuts."""
    parts = [F.lit("all")] + [F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in columns.items()]
    if identity:
        parts += [F.when(F.col(identity) < 0.5, "identity<50%"), F.when(F.col(identity) < 0.3, "identity<30%")]
    return df.select("*", F.explode(F.array_compact(F.array(*parts))).alias("stratum"))


def stratified_metrics(df, score, columns: dict, identity=None, group="protein_name", label=LABEL, min_class=5, min_groups=1) -> DataFrame:
    s = strata_of(df, columns, identity)
    groups = s.groupBy("stratum", group).agg(F.count(F.lit(1)).alias("_n")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n_groups"))
    r = ranking(s, "stratum", score, label).join(groups, "stratum")
    return r.where((F.col("n_pos") >= min_class) & (F.col("n_neg") >= min_class) & (F.col("n_groups") >= min_groups))


def mid_ranks(df, group, value, weight, out) -> DataFrame:
    """Average rank of every distinct value of the group, by weight."""
    group = _list(group)
    c = df.groupBy(*group, value).agg(F.sum(weight).alias("_w"))
    pre = ordered_prefix(c, group, value, {"_b": "_w"}, totals=True)
    centred = F.col("_b") + (F.col("_w") + 1) / 2.0 - (F.col("_b_total") + 1) / 2.0
    return pre.select(*group, value, centred.alias(out))


def spearman(df, group, x, y, min_n=30, weight=None) -> DataFrame:
    """Spearman correlation with average ranks; null under min_n rows.

    Works on (group, x, y) cells, so heavy ties shrink before any join.
    """
    group = _list(group)
    w = F.sum(weight) if weight else F.count(F.lit(1))
    c = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(w.alias("_c"))
    # the cells are read three times and may come from model fits: write them once
    c = cut_lineage(c.where(F.col("_c") > 0))
    j = null_safe(c, mid_ranks(c, group, "_x", "_c", "_rx"), [*group, "_x"])
    j = null_safe(j, mid_ranks(c, group, "_y", "_c", "_ry"), [*group, "_y"])
    s = lambda a, b: F.sum(F.col("_c") * F.col(a) * F.col(b))
    g = j.groupBy(*group).agg(F.sum("_c").alias("n"), s("_rx", "_ry").alias("_xy"), s("_rx", "_rx").alias("_xx"), s("_ry", "_ry").alias("_yy"))
    rho = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    return g.select(*group, "n", F.when(F.col("n") >= min_n, rho).alias("rho"))


def topk_overlap(p, q, group, k=20, word="kmer", score="score") -> DataFrame:
    """Share of the top k words two profiles share, and whether p's first is among q's top k."""
    order = [F.desc(score), word]
    a = top_per_group(p, group, order, k, "ra").select(*_list(group), word, "ra")
    b = top_per_group(q, group, order, k, "rb").select(*_list(group), word, "rb")
    j = a.join(b, [*_list(group), word], "left")
    return j.groupBy(*_list(group)).agg(
        (F.sum(F.col("rb").isNotNull().cast("int")) / k).alias("overlap"),
        F.max(((F.col("ra") == 1) & F.col("rb").isNotNull()).cast("int")).alias("top1_hit"),
    )


def profile_vectors(long, node, word, value) -> DataFrame:
    """Profiles as arrays in word order (one row per node, |words| entries)."""
    return long.groupBy(node).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(word, value))), lambda x: x[value]).alias("profile")
    )


def profile_corr(long, node, word, value) -> DataFrame:
    """Pearson correlation of complete profiles for all node pairs a < b, by blocked products."""
    from pairloom.operators.joins import cosine_pairs

    v = profile_vectors(long, node, word, value)
    mean = F.aggregate("profile", F.lit(0.0), lambda acc, x: acc + x) / F.size("profile")
    v = v.withColumn("_m", mean).withColumn("profile", F.transform("profile", lambda x: x - F.col("_m"))).drop("_m")
    return cosine_pairs(v, node, "profile").withColumnRenamed("sim", "r")


def validation_decision(m, auroc_col="auroc", median_col="group_median") -> DataFrame:
    ok = (F.col(auroc_col) >= 0.70) & (F.col(median_col) >= 0.65)
    status = F.when(ok, "PASS").when(F.col(auroc_col) >= 0.60, "WARN").otherwise("FAIL")
    text = (
        F.when(status == "PASS", "signal confirmed")
        .when(status == "WARN", "marginal: look at the flagged groups first")
        .otherwise("validation failed: do not train on this set")
    )
    return m.withColumns({"status": status, "message": text})


def aggregate_seeds(runs, model="model", seed="seed", value="auroc") -> DataFrame:
    return runs.groupBy(model).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(F.lit(1)).alias("n_seeds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seed, value))), lambda x: F.round(x[value], 6).cast("string")), ";").alias("values"),
    )


def paired_seed_difference(runs, a, b, model="model", seed="seed", value="auroc") -> DataFrame:
    side = lambda m, n: runs.where(F.col(model) == m).select(seed, F.col(value).alias(n))
    d = side(a, "a").join(side(b, "b"), seed).select((F.col("a") - F.col("b")).alias("d"))
    return d.agg(F.avg("d").alias("mean_diff"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("std_diff"), F.count(F.lit(1)).alias("n_seeds"))


WEIGHTS = {"test_auroc": 0.5, "test_auprc": 0.3, "per_group_median": 0.2}


def leaderboard(models: DataFrame, reference: dict | None = None) -> DataFrame:
    """Weighted score (null if a part is missing), val-test gap and rank; one optional fixed row."""
    if reference:
        ref = models.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in reference.items()])
        models = models.unionByName(ref, allowMissingColumns=True)
    score = sum((F.col(c) * w for c, w in list(WEIGHTS.items())[1:]), F.col("test_auroc") * WEIGHTS["test_auroc"])
    m = models.withColumns(
        {
            "leaderboard_score": score,
            "val_test_gap": F.when(F.col("best_val_auroc").isNotNull(), F.col("best_val_auroc") - F.coalesce("test_auroc", F.lit(0.0))),
            "_o": F.lit(0) - F.coalesce(score, F.lit(float("-inf"))),
        }
    )
    one = ordered_prefix(m.withColumn("_one", F.lit(1)), [], ["_o", "model"], {"rank": "_one"})
    return one.withColumn("rank", F.col("rank") + 1).drop("_one", "_o")


def extremes(per_group, model="model", group="protein_name", value="auroc", n=10) -> DataFrame:
    v = per_group.where(F.col(value).isNotNull())
    hard = top_per_group(v, model, [F.asc(value), group], n).withColumn("kind", F.lit("hardest"))
    easy = top_per_group(v, model, [F.desc(value), group], n).withColumn("kind", F.lit("easiest"))
    return hard.unionByName(easy)


def curves(df, group, score, label=LABEL) -> DataFrame:
    """ROC and precision-recall points, one per distinct score, threshold >= score."""
    group = _list(group)
    pre = ordered_prefix(cells(df, group, score, label), group, "_s", {"_pb": "_p", "_nb": "_n"}, totals=True)
    tp, fp = F.col("_pb_total") - F.col("_pb"), F.col("_nb_total") - F.col("_nb")
    return pre.select(
        *group, F.col("_s").alias("threshold"), F.try_divide(tp, F.col("_pb_total")).alias("tpr"),
        F.try_divide(fp, F.col("_nb_total")).alias("fpr"), (tp / (tp + fp)).alias("precision"),
    )


def eval_integrity(df, rna_max=101, group="protein_name", seq="rna_sequence", label=LABEL) -> DataFrame:
    """Gate before any headline number: BLOCK, WARN or OK with the reasons."""
    per = df.groupBy(group).agg(
        F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n"), F.sum((F.length(seq) > rna_max).cast("int")).alias("_l")
    )
    a = per.agg(
        F.sum("_n").alias("n_pairs"), F.sum("_p").alias("n_pos"), (F.sum("_n") - F.sum("_p")).alias("n_neg"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum(((F.col("_p") == 0) | (F.col("_p") == F.col("_n"))).cast("int")).alias("n_single_class"),
        F.sum("_l").alias("n_long"),
    )
    a = a.withColumn("positive_rate", F.col("n_pos") / F.col("n_pairs"))
    warn = F.array_compact(
        F.array(
            F.when((F.col("n_pos") < 10) | (F.col("n_neg") < 10), "BLOCK:insufficient_classes"),
            F.when(F.col("n_single_class") / F.col("n_groups") > 0.5, "WARN:single_class_groups"),
            F.when(F.col("n_long") / F.col("n_pairs") > 0.3, "WARN:window_max_inflation"),
            F.when(F.col("positive_rate") > 0.6, "WARN:high_positive_rate"),
        )
    )
    a = a.withColumn("issues", F.array_join(warn, ";"))
    return a.withColumn("gate", F.when(F.col("issues").contains("BLOCK"), "BLOCK").when(F.col("issues") != "", "WARN").otherwise("OK"))


def subset_metrics(df, subsets, score, label=LABEL) -> DataFrame:
    """Metrics by subset; ``subsets`` is an array column of names.  AUPRC gain over prevalence."""
    s = df.select("*", F.explode(subsets).alias("subset"))
    r = ranking(s, "subset", score, label)
    return r.withColumn("auprc_gain", F.col("auprc") - F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")))


def permute_column(df, key, col, seed=42) -> DataFrame:
    """Deal a column out again over the rows by a seeded permutation."""
    to = hash_rank(df.select(key), [], key, f"{seed}|to", rank="_rk")
    vals = hash_rank(df.select(key, F.col(col).alias(f"{col}_shuffled")), [], key, seed, rank="_rk").drop(key)
    return to.join(vals, "_rk").drop("_rk")


def shuffle_control(df, real, shuffled, group="protein_name", label=LABEL) -> DataFrame:
    """AUROC and group-median loss when the partner is shuffled.

    df is read once: the whole's cells are sums of the groups' cells, which are written.
    """
    long = df.select(
        group, label, F.explode(F.create_map(F.lit("real"), F.col(real).cast("double"), F.lit("shuffled"), F.col(shuffled).cast("double"))).alias("kind", "score")
    )
    cell = cut_lineage(cells(long, ["kind", group], "score", label))
    both = cell.groupBy("kind", "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    whole = ranked_cells(both, "kind").select("kind", "auroc")
    by_group = cut_lineage(ranked_cells(cell, ["kind", group]).drop("auprc"))
    j = with_quantiles(whole, by_group, "kind", "auroc", {"group_median": 0.5})
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    return j.agg(
        pick("real", "auroc").alias("auroc_real"), pick("shuffled", "auroc").alias("auroc_shuffled"),
        pick("real", "group_median").alias("median_real"), pick("shuffled", "group_median").alias("median_shuffled"),
    ).withColumns(
        {"delta_auroc": F.col("auroc_real") - F.col("auroc_shuffled"), "delta_median": F.col("median_real") - F.col("median_shuffled")}
    )
