"""Filters and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.sequence import gc_fraction, sanitize_protein
from pairloom.plans import top_per_group


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def both_classes(df, group, label="binding_label") -> DataFrame:
    keep = df.groupBy(group).agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a <> b").select(group)
    return df.join(keep, group, "left_semi")


def dropped_groups(df, group, label="binding_label") -> DataFrame:
    g = df.groupBy(group).agg(F.min(label).alias("a"), F.max(label).alias("b"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum((F.col("a") == F.col("b")).cast("int")).alias("dropped"))


def modal_length(df, group, seq="rna_sequence", split=None, ref="train") -> DataFrame:
    """Rows of the group's most common length (ties: smallest), optionally from ``ref`` rows only."""
    base = df.where(F.col(split) == ref) if split else df
    counts = base.groupBy(group, F.length(seq).alias("_len")).agg(F.count(F.lit(1)).alias("_c"))
    mode = counts.groupBy(group).agg(F.min_by("_len", F.struct(-F.col("_c"), F.col("_len"))).alias("_mode"))
    return df.join(mode, group).where(F.length(seq) == F.col("_mode")).drop("_mode")


def _best(df, means: DataFrame, group, experiment) -> DataFrame:
    # means are compared at nine digits: the order of a sum must not decide a tie
    best = means.groupBy(group).agg(
        F.max_by(experiment, F.struct(F.round("_mean", 9), F.col(experiment))).alias("_best")
    )
    return df.join(best, group, "left").where(F.col("_best").isNull() | (F.col(experiment) == F.col("_best"))).drop("_best")


def positive_means(df, group, experiment, value="probe_intensity", label="binding_label") -> DataFrame:
    return (
        df.where(F.col(label) == 1)
        .groupBy(group, experiment)
        .agg(F.avg(value).alias("_mean"))
        .where(F.col("_mean").isNotNull())
    )


def best_experiment(df, group="protein_name", experiment="experiment_id", value="probe_intensity") -> DataFrame:
    """Keep the experiment with the highest mean positive value; none known keeps all."""
    return _best(df, positive_means(df, group, experiment, value), group, experiment)


def experiment_motif_scores(z: DataFrame, experiment="experiment_id", k=10, min_z=2.0) -> DataFrame:
    """Mean z of the top k words at or above min_z; experiments without any score -1."""
    top = top_per_group(z.where(F.col("z") >= min_z), experiment, [F.desc("z"), "kmer"], k)
    scored = top.groupBy(experiment).agg(F.avg("z").alias("_z"))
    return z.select(experiment).distinct().join(scored, experiment, "left").select(
        experiment, F.coalesce("_z", F.lit(-1.0)).alias("_z")
    )


def best_experiment_by_motif(df, z, group="protein_name", experiment="experiment_id", k=10, min_z=2.0, value="probe_intensity") -> DataFrame:
    """Best experiment by top-word z where any has one, else by intensity."""
    exps = df.select(group, experiment).distinct()
    zs = exps.join(experiment_motif_scores(z, experiment, k, min_z), experiment).where(F.col("_z") > -1)
    has_z = zs.select(group).distinct().withColumn("_has", F.lit(1))
    means = positive_means(df, group, experiment, value).join(has_z, group, "left").where(F.col("_has").isNull())
    both = zs.select(group, experiment, F.col("_z").alias("_mean")).unionByName(means.select(group, experiment, "_mean"))
    return _best(df, both, group, experiment)


def quality_rows(df, rna="rna_sequence", prot="protein_sequence", min_rna=10, min_prot=20, prot_length=None) -> DataFrame:
    """``prot_length`` names a column with the protein's length, for rows that do not carry its text."""
    long = F.col(prot_length) if prot_length else F.length(prot)
    return df.where(F.col(rna).isNotNull() & long.isNotNull() & (F.length(rna) >= min_rna) & (long >= min_prot))


def quality_problems(df, seq="protein_sequence", min_len=10, weight=None) -> DataFrame:
    """One row of checks: placeholder text, distinct sequences, shortest length; ``weight`` names a
    column with the number of rows that a row stands for."""
    per = df.groupBy(seq).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    return per.agg(
        F.sum(F.when(F.lower(F.trim(seq)) == "ok", F.col("_n")).otherwise(0)).alias("placeholders"),
        F.count(seq).alias("distinct_sequences"),
        F.min(F.length(seq)).alias("min_length"),
    ).withColumn(
        "failed",
        ((F.col("placeholders") > 0) | (F.col("distinct_sequences") < 2) | (F.col("min_length") < min_len)).cast("int"),
    )


def quality_gate(df, seq="protein_sequence", min_len=10) -> DataFrame:
    """Raise when the sequence column is not usable, else the filtered rows."""
    bad = quality_problems(df, seq, min_len).first()
    if bad["failed"]:
        raise ValueError(f"sequence column failed the quality gate: {bad.asDict()}")
    return quality_rows(df, prot=seq)


def eval_subsets(test, train, key, group="protein_name", seq="rna_sequence", caliper=0.02, seed=42) -> DataFrame:
    """Long form (subset, key): full, gc_matched, rna_unseen, protein_unseen."""
    from pairloom.operators.sampling import gc_match

    seen_r = train.select(seq).distinct().withColumn("_r", F.lit(1))
    seen_p = train.select(group).distinct().withColumn("_p", F.lit(1))
    matched = gc_match(test, group, key, seq=seq, caliper=caliper, seed=seed).select(key).withColumn("_g", F.lit(1))
    j = test.join(seen_r, seq, "left").join(seen_p, group, "left").join(matched, key, "left")
    names = F.array_compact(
        F.array(
            F.lit("full"),
            F.when(F.col("_g").isNotNull(), "gc_matched"),
            F.when(F.col("_r").isNull(), "rna_unseen"),
            F.when(F.col("_p").isNull(), "protein_unseen"),
        )
    )
    return j.select(F.explode(names).alias("subset"), key, group, "binding_label")


def dedup(df, keys, order) -> DataFrame:
    """First row per key set in ``order``; min_by combines map-side, so copies never pile up."""
    keys = _list(keys)
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*_list(order))).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def dedup_majority(df, key, order, label="binding_label") -> DataFrame:
    """One row per key with the majority label; ties go; other columns from the first row."""
    keys = _list(key)
    rest = [c for c in df.columns if c not in keys + [label]]
    g = df.groupBy(*keys).agg(
        F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*rest), F.struct(*_list(order))).alias("_r")
    )
    g = g.where(2 * F.col("_p") != F.col("_n"))
    return g.select(
        *keys, (2 * F.col("_p") > F.col("_n")).cast("int").alias(label), *[F.col(f"_r.{c}").alias(c) for c in rest]
    )


def average_replicates(df, keys, value) -> DataFrame:
    return df.groupBy(*_list(keys)).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("replicates"))


def variant_registry(df, name="protein_name", seq="protein_sequence", source="dataset_source", split="split", texts=None, key="protein_key") -> DataFrame:
    """Unique (name, sequence) variants; the first split is the alphabetically first.

    With ``texts`` (key, seq) the rows carry the key only: they are counted by it before the
    texts come in, once for each name and key.
    """
    of = [name, seq if texts is None else key]
    v = df.groupBy(*of).agg(F.min(split).alias("_split"), F.min(source).alias("_source"), F.count(F.lit(1)).alias("_n"))
    v = v if texts is None else v.join(texts, key)
    v = v.withColumn(seq, sanitize_protein(seq)["seq"]).groupBy(name, seq).agg(
        F.min("_split").alias("split_first_seen"), F.min("_source").alias("first_source"), F.sum("_n").alias("n_rows")
    )
    per = v.groupBy(name).agg(F.count(F.lit(1)).alias("n_variants"))
    return v.join(per, name).withColumn("multi_sequence", (F.col("n_variants") > 1).cast("int"))


def with_gc(df, seq="rna_sequence") -> DataFrame:
    return df.withColumn("gc", gc_fraction(seq))
