"""Reports and grouped summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.sequence import first_motif, gc_fraction, is_strict_rna, outcome, sanitize_protein, validate_protein
from pairloom.operators import kmers as km
from pairloom.operators.filters import best_experiment
from pairloom.operators.joins import flag_in
from pairloom.operators.metrics import spearman
from pairloom.operators.sampling import group_cap
from pairloom.plans import cut_lineage, ordered_prefix, quantiles, top_per_group, with_quantiles
from pairloom.plans.ordering import null_safe

LABEL = "binding_label"


def _list(x):
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def _n():
    return F.count(F.lit(1))


def length_stats(df, col, group=None, prefix="len") -> DataFrame:
    """Min, median and max length; the median runs over (length, count), at most one row per length."""
    c = df.where(F.col(col).isNotNull()).groupBy(*_list(group), F.length(col).alias("_l")).agg(_n().alias("_c"))
    return c.groupBy(*_list(group)).agg(
        F.min("_l").alias(f"{prefix}_min"), F.percentile("_l", F.lit(0.5), F.col("_c")).alias(f"{prefix}_median"), F.max("_l").alias(f"{prefix}_max")
    )


def validate_dataset(df, group="protein_name", seq="rna_sequence", required=("rna_sequence", "protein_name", LABEL)) -> DataFrame:
    """One row of counts, lengths, null rates and warnings."""
    missing = [c for c in required if c not in df.columns]
    per = df.groupBy(group).agg(F.min(LABEL).alias("_a"), F.max(LABEL).alias("_b"))
    g = per.where(F.col(group).isNotNull()).agg(_n().alias("n_groups"), F.sum((F.col("_a") == F.col("_b")).cast("int")).alias("single_class_groups"))
    nulls = [F.round(F.avg(F.col(c).isNull().cast("double")), 3).alias(f"null_{c}") for c in df.columns]
    a = df.agg(
        _n().alias("n_rows"), F.sum((F.col(LABEL) == 1).cast("int")).alias("n_pos"), F.sum((F.col(LABEL) == 0).cast("int")).alias("n_neg"),
        F.sum((~is_strict_rna(seq)).cast("int")).alias("n_invalid"), F.sum(F.upper(seq).contains("T").cast("int")).alias("n_with_t"), *nulls,
    )
    one = F.lit(1).alias("_k")
    j = a.select("*", one).join(g.select("*", one), "_k").join(length_stats(df, seq).select("*", one), "_k").drop("_k")
    j = j.withColumn("pos_rate", F.col("n_pos") / F.col("n_rows"))
    warn = F.array_compact(
        F.array(
            F.when(F.lit(bool(missing)), F.lit("missing_columns:" + ",".join(missing))),
            F.when(F.col("n_pos") < 10, "few_positives"),
            F.when(F.col("pos_rate") > 0.8, "high_positive_rate"),
            F.when(F.col("single_class_groups") > 0, F.concat(F.col("single_class_groups").cast("string"), F.lit("_single_class_groups"))),
        )
    )
    return j.withColumn("warnings", F.array_join(warn, ";"))


def split_stats(df, group="protein_name", experiment="experiment_id", seq="rna_sequence") -> DataFrame:
    """Per split: rows, labels, groups, experiments, both-class groups, unique sequences, mean GC by label.

    Distinct counts are taken over pre-aggregated keys, so no expand step multiplies the rows.
    """
    y = F.col(LABEL)
    gc = gc_fraction(seq)
    base = df.groupBy("split").agg(
        _n().alias("rows"), F.sum(y).alias("n_pos"), F.sum(1 - y).alias("n_neg"), F.avg(F.when(y == 1, gc)).alias("gc_pos"), F.avg(F.when(y == 0, gc)).alias("gc_neg")
    )
    per = df.groupBy("split", group).agg(F.min(LABEL).alias("_a"), F.max(LABEL).alias("_b"))
    groups = per.groupBy("split").agg(_n().alias("groups"), F.sum((F.col("_a") != F.col("_b")).cast("int")).alias("both_class_groups"))
    uniq = lambda c, out: df.select("split", c).distinct().groupBy("split").agg(_n().alias(out))
    return base.join(groups, "split").join(uniq(experiment, "experiments"), "split").join(uniq(seq, "unique_sequences"), "split")


def split_integrity(df, prot="protein_name", seq="rna_sequence", ref="train") -> DataFrame:
    """Duplicates, label conflicts and overlap with the train split, per split."""
    train = df.where(F.col("split") == ref)
    cells = df.groupBy("split", prot, seq).agg(_n().alias("_n"), F.count_distinct(LABEL).alias("_d"))
    c = flag_in(cells, train, seq, "_r")
    c = flag_in(c, train.where(F.col(LABEL) == 1), seq, "_rp")
    c = flag_in(c, train, [prot, seq], "_x")
    rows = c.groupBy("split").agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - F.col("_d")).alias("duplicate_rows"), F.sum((F.col("_d") > 1).cast("int")).alias("conflicting_pairs"),
        *[(F.sum(F.col(f) * F.col("_n")) * 100 / F.sum("_n")).alias(o) for f, o in (("_r", "pct_rna_in_train"), ("_rp", "pct_positive_rna_in_train"), ("_x", "pct_pair_in_train"))],
    )
    g = flag_in(df.groupBy("split", prot).agg(F.min(LABEL).alias("_a"), F.max(LABEL).alias("_b")), train, prot, "_in")
    names = g.groupBy("split").agg(_n().alias("groups"), F.sum("_in").alias("groups_in_train"), F.sum((F.col("_a") == F.col("_b")).cast("int")).alias("single_class_groups"))
    return rows.join(names, "split")


def audit_sequences(df, seq="protein_sequence") -> DataFrame:
    """Unique sequences with their problems."""
    u = df.select(F.col(seq).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    clean = sanitize_protein("raw")["seq"]
    up = F.upper("raw")
    return u.select(
        "raw", up.rlike("[0-9]").cast("int").alias("has_digits"), up.contains("*").cast("int").alias("has_stop"),
        up.rlike("[^A-Z0-9*]").cast("int").alias("has_other"), (clean != F.col("raw")).cast("int").alias("changed"),
        (validate_protein(clean) == "ok").cast("int").alias("valid_after"), F.length("raw").alias("len_before"), F.length(clean).alias("len_after"),
    )


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.agg(_n().alias("unique_sequences"), *[F.sum(c).alias(c) for c in ("has_digits", "has_stop", "has_other", "changed", "valid_after")])


def check_fasta(fa: DataFrame, expected: DataFrame, key="seq_id", seq="seq") -> DataFrame:
    """Problems of an exported FASTA against the table it came from: (key, problem, level)."""
    per = fa.groupBy(key).agg(_n().alias("_n"), F.min(seq).alias("_s"))
    j = per.join(expected.select(key, F.col(seq).alias("_e")).withColumn("_x", F.lit(1)), key, "full_outer")
    s = F.col("_s")
    have = F.col("_n").isNotNull()
    checks = F.array_compact(
        F.array(
            F.when(have & F.col("_x").isNull(), "extra"),
            F.when(~have | F.col("_n").isNull(), "expected_missing"),
            F.when(F.col("_n") > 1, "duplicate_header"),
            F.when(s == "", "empty"),
            F.when(s.contains("*"), "stop_codon"),
            F.when(s.rlike("[0-9]"), "digits"),
            F.when(F.upper(s).rlike("[^ACDEFGHIKLMNPQRSTVWY*0-9]"), "invalid_characters"),
            F.when(s.rlike("[a-z]"), "lowercase"),
            F.when(have & F.col("_x").isNotNull() & (s != F.col("_e")), "mismatch"),
        )
    )
    level = F.when(F.col("problem").isin("lowercase", "extra"), "WARN").otherwise("FAIL")
    return j.select(key, F.explode(checks).alias("problem")).withColumn("level", level)


def exemplars(df, top, group, key, n=5, pos_score="pos_score", neg_score="neg_score", neg_ascending=False, seq="rna_sequence") -> DataFrame:
    """Positives holding a top word (modal length, best first) and negatives holding none."""
    d = km.with_ranked_list(df, top, group).withColumn("_m", first_motif(seq, F.col("ranked")))
    held = F.col("_m.pos") >= 0
    pos = d.where((F.col(LABEL) == 1) & held)
    lens = pos.groupBy(group, F.length(seq).alias("_l")).agg(_n().alias("_c"))
    mode = lens.groupBy(group).agg(F.min_by("_l", F.struct(-F.col("_c"), F.col("_l"))).alias("_mode"))
    fixed = lambda x: x.join(mode, group).where(F.length(seq) == F.col("_mode"))
    best = top_per_group(fixed(pos), group, [F.desc(pos_score), key], n, "rank").withColumn("kind", F.lit("positive"))
    order = F.asc(neg_score) if neg_ascending else F.desc(neg_score)
    none = top_per_group(fixed(d.where((F.col(LABEL) == 0) & ~held)), group, [order, key], n, "rank").withColumn("kind", F.lit("negative"))
    both = best.unionByName(none)
    return both.select(
        group, key, seq, LABEL, "kind", "rank", F.col("_m.motif").alias("matched_kmer"), F.col("_m.pos").alias("kmer_position"), F.length(seq).alias("probe_length")
    )


def compare_rankings(a, b, group, key) -> DataFrame:
    """Overlap of two top-n selections (n rows per group each)."""
    s = lambda d, o: d.groupBy(group).agg(F.array_sort(F.collect_set(key)).alias(o))
    j = s(a, "x").join(s(b, "y"), group, "full_outer")
    x, y = (F.coalesce(c, F.array().cast("array<string>")) for c in ("x", "y"))
    both = F.size(F.array_intersect(x, y))
    return j.select(
        group, both.alias("overlap"), F.try_divide(both, F.size(x)).alias("fraction"), F.try_divide(both, F.size(F.array_union(x, y))).alias("jaccard"),
        F.array_join(F.array_except(x, y), ";").alias("only_a"), F.array_join(F.array_except(y, x), ";").alias("only_b"),
    )


def kmer_positions(ex, group, seq="rna_sequence") -> DataFrame:
    """Position summary of exemplars (a few rows per group)."""
    p = ex.where(F.col("kind") == "positive")
    start3 = F.left(seq, F.lit(3))
    at0 = (F.col("kmer_position") == 0).cast("int")
    g = p.groupBy(group).agg(
        _n().alias("n_positive"), F.sum(at0).alias("n_pos0"), F.percentile("kmer_position", F.lit(0.5)).alias("median_position"),
        F.avg("kmer_position").alias("mean_position"), F.mode("matched_kmer", True).alias("top_kmer"), F.mode(start3, True).alias("common_start3"),
        F.sum(F.startswith(F.col(seq), F.lit("AG")).cast("int")).alias("n_start_ag"), F.count_distinct(start3).alias("n_start3"),
        F.sum(F.startswith(F.col(seq), F.col("matched_kmer")).cast("int")).alias("n_motif_at_start"),
    )
    pct = lambda c: F.round(100 * F.col(c) / F.col("n_positive"), 1)
    return g.withColumns(
        {"pct_pos0": pct("n_pos0"), "pct_start_ag": pct("n_start_ag"), "reconciled": (F.col("n_pos0") == F.col("n_motif_at_start")).cast("int")}
    )


def pair_counts(reads, a="gene1", b="gene2", library="library") -> DataFrame:
    """Read and library counts per gene pair; combined per (pair, library) first."""
    c = reads.where(F.col(a) != F.col(b)).groupBy(a, b, library).agg(_n().alias("_c"))
    return c.groupBy(a, b).agg(F.sum("_c").alias("n_reads"), _n().alias("n_libraries"), F.array_join(F.array_sort(F.collect_list(library)), ";").alias("libraries"))


def intensity_ranking(df, group="protein_name", value="probe_intensity", length="protein_length") -> DataFrame:
    """Groups by mean positive intensity of their best experiment."""
    b = best_experiment(df, group, value=value)
    g = b.groupBy(group).agg(
        F.avg(F.when(F.col(LABEL) == 1, F.col(value))).alias("mean_intensity"), F.sum(LABEL).alias("n_pos"), F.sum(1 - F.col(LABEL)).alias("n_neg"), F.max(length).alias(length)
    )
    ranked = ordered_prefix(
        g.where(F.col("mean_intensity").isNotNull()).withColumns({"_one": F.lit(1), "_o": -F.col("mean_intensity")}), [], ["_o", group], {"rank": "_one"}
    )
    return ranked.withColumn("rank", F.col("rank") + 1).drop("_one", "_o")


def length_correlation(ranking, x="protein_length", y="mean_intensity", min_n=3) -> DataFrame:
    rho = spearman(ranking, None, x, y, min_n=min_n).select(F.col("rho").alias("spearman"), "n")
    one = F.lit(1).alias("_k")
    r = ranking.agg(F.when(_n() >= min_n, F.corr(F.col(x).cast("double"), y)).alias("pearson"))
    return rho.select("*", one).join(r.select("*", one), "_k").drop("_k")


def domain_diverse(ranking, arch_map, include=(), group="protein_name", value="mean_intensity"):
    """(one protein per architecture, proteins with conflicting architectures)."""
    long = arch_map.select(F.explode(F.split("ids", ";")).alias(group), "architecture").withColumn(group, F.trim(group)).where(F.col(group) != "").distinct()
    per = long.groupBy(group).agg(F.array_sort(F.collect_set("architecture")).alias("archs"))
    conflicts = per.where(F.size("archs") > 1).select(group, F.array_join("archs", "|").alias("architectures"))
    j = ranking.join(per.where(F.size("archs") == 1).select(group, F.col("archs")[0].alias("architecture")), group)
    best = j.groupBy("architecture").agg(F.max_by(F.struct(group, value), F.struct(F.col(value), F.col(group))).alias("b")).select("architecture", "b.*")
    forced = j.where(F.col(group).isin(list(include))).select("architecture", group, value) if include else None
    picked = best.withColumn("reason", F.lit("best_of_architecture"))
    if forced is not None:
        extra = forced.join(best.select(group), group, "left_anti").select("architecture", group, value, F.lit("forced").alias("reason"))
        picked = picked.unionByName(extra)
    return picked, conflicts


def crosstab(df, a, b, values) -> DataFrame:
    return df.groupBy(a).pivot(b, list(values)).agg(_n()).na.fill(0)


def transfer_summary(t, by, value="auroc") -> DataFrame:
    t = cut_lineage(t)
    out = t.groupBy(*_list(by)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    out = with_quantiles(out, t, _list(by), value, {"median": 0.5})
    return with_quantiles(out, t, _list(by), "overlap", {"overlap_median": 0.5})


def signal_motif_panel(df, group, signal, score, min_n=30) -> DataFrame:
    """Mean motif score in the top and bottom signal quartile, and Spearman of the two."""
    d = df.where(F.col(signal).isNotNull() & F.col(score).isNotNull())
    q = quantiles(d, group, signal, {"_q1": 0.25, "_q3": 0.75})
    j = null_safe(d, q, group)
    s, v = F.col(signal), F.col(score)
    g = j.groupBy(*_list(group)).agg(
        F.avg(F.when(s <= F.col("_q1"), v)).alias("score_low"), F.avg(F.when(s >= F.col("_q3"), v)).alias("score_high"), F.avg(v).alias("score_mean")
    )
    return null_safe(g, spearman(d, group, signal, score, min_n), group)


def panel_summary(panel, pooled) -> DataFrame:
    one = F.lit(1).alias("_k")
    panel = cut_lineage(panel)
    m = panel.agg(_n().alias("n_experiments"), F.sum((F.col("rho") > 0).cast("int")).alias("n_positive_rho"))
    m = with_quantiles(m, panel, [], "rho", {"rho_median": 0.5})
    return m.select("*", one).join(pooled.select(F.col("rho").alias("rho_pooled"), F.col("n").alias("n_rows"), one), "_k").drop("_k")


def error_kmers(df, score, key, thr=0.5, k=6, top=15, cap=None, min_seqs=5, seq="rna_sequence", seed=42) -> DataFrame:
    """k-mers of errors: FP against TN and FN against TP, over all rows; ``cap`` asks for a draw per side."""
    o = df.withColumn("outcome", outcome(LABEL, score, thr))
    capped = group_cap(o, "outcome", cap, key, seed) if cap else o
    side = F.col("outcome").isin("FP", "TN")
    c = capped.withColumns({"comparison": F.when(side, "FP_vs_TN").otherwise("FN_vs_TP"), "_err": F.col("outcome").isin("FP", "FN").cast("int")})
    ok = c.groupBy("comparison").agg(F.sum("_err").alias("a"), F.sum(1 - F.col("_err")).alias("b")).where((F.col("a") >= min_seqs) & (F.col("b") >= min_seqs))
    c = c.join(ok.select("comparison"), "comparison", "left_semi")
    r = km.kmer_log2(c, "comparison", seq, k, label="_err").withColumn("log2_ratio", F.round("log2_ratio", 9))
    return top_per_group(r, "comparison", [F.desc("log2_ratio"), "kmer"], top)


def score_trend(df, score, features: dict, bins=30, group=None) -> DataFrame:
    """Median score over equal-width bins of each feature."""
    group = _list(group)
    long = df.select(
        *group, F.col(score).alias("_score"),
        F.explode(F.create_map(*[x for n, c in features.items() for x in (F.lit(n), c.cast("double"))])).alias("feature", "x"),
    ).where(F.col("x").isNotNull())
    span = long.groupBy(*group, "feature").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    j = null_safe(long, span, [*group, "feature"])
    b = F.least(F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins), F.lit(bins - 1))
    j = j.withColumn("bin", b.cast("int"))
    keys = [*group, "feature", "bin"]
    q = quantiles(j, keys, "_score", {"median_score": 0.5})
    n = j.groupBy(*keys).agg(_n().alias("n"))
    return null_safe(q, n, keys)


def transfer_pivot(t, protocols, a="train_protocol", b="test_protocol", value="auroc") -> DataFrame:
    t = cut_lineage(t)
    cells = with_quantiles(t.groupBy(a, b).agg(F.count(value).alias("n")), t, [a, b], value, {"median": 0.5})
    return cells.groupBy(a).pivot(b, list(protocols)).agg(F.max("median").alias("median"), F.max("n").alias("n"))


def transfer_with_within(t, w, key) -> DataFrame:
    """Transfer rows with the within-protocol value of both ends and their null-ignoring mean."""
    side = lambda c, o: w.select(key, F.col("protocol").alias(c), F.col("auroc").alias(o))
    j = t.join(side("train_protocol", "within_train"), [key, "train_protocol"], "left").join(side("test_protocol", "within_test"), [key, "test_protocol"], "left")
    vals = F.array_compact(F.array("within_train", "within_test"))
    mean = F.try_divide(F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x), F.size(vals))
    return j.withColumn("within_mean", mean)


def model_wins(cmp, models, dataset="dataset", group="protein_name", value="auroc") -> DataFrame:
    best = cmp.where(F.col(value).isNotNull()).groupBy(dataset, group).agg(F.min_by("model", F.struct(-F.col(value), F.col("model"))).alias("model"))
    return crosstab(best, dataset, "model", models)
