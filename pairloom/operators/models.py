"""Distributed baselines: closed-form k-mer weights, neighbour transfer, spark.ml fits and
many small per-group fits.

Per-group fits never gather a group: a group above ``SHARD_ROWS`` rows is cut in
even shards by row hash.  Ridge adds the shards' normal equations.  Logistic fits take
Newton steps: a group of one shard inside its task, a larger one from the added gradients
and curvatures of its shards.  Both give the same weights.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, Normalizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from pairloom.functions.sequence import (
    AMINO_ACIDS, alphabet_kmers, center_crop, gc_fraction, kmers, rna_windows, triad_letters,
)
from pairloom.operators import kmers as km, metrics as mt
from pairloom.operators.joins import cosine_knn, slices
from pairloom.operators.splits import fold_map, kfold
from pairloom.plans import cut_lineage, hash_rank, ordered_prefix, quantiles, top_per_group
from pairloom.plans.ordering import with_quantiles

LABEL = "binding_label"
SHARD_ROWS = 50_000
RNA4 = "ACGU"


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ---- closed-form k-mer models -------------------------------------------------


def nb_weights(train, group, seq, k=4, label=LABEL) -> DataFrame:
    """Log-odds weight of every word per group (pseudo-count 1): (group, kmer, weight)."""
    return km.kmer_profile(train, group, seq, k, label).select(group, "kmer", (F.col("profile") * F.log(F.lit(2.0))).alias("weight"))


def mean_weights(weights) -> DataFrame:
    return weights.groupBy("kmer").agg(F.avg("weight").alias("weight"))


def word_counts(rows, key, seq, k) -> DataFrame:
    """(key.., kmer, n) with the map-side combine on the row key."""
    return km.explode_kmers(rows, key, seq, [k]).groupBy(*([key] if isinstance(key, str) else key), "kmer").agg(F.count(F.lit(1)).alias("n"))


def word_codes(seq, k):
    """The row's ACGU words as their places among all words of k letters in order."""
    digits = F.translate(seq, "0123" + RNA4, "----0123")
    return F.transform(kmers(digits, k, "0123"), lambda w: F.conv(w, 4, 10).cast("int"))


def word_arrays(weights, by, names, k) -> DataFrame:
    """(by.., one array for each of ``names``): weights of all ACGU words of k letters in order, 0 without one."""
    cells = weights.where(F.col("kmer").rlike(f"^[{RNA4}]{{{k}}}$")).select(*by, word_index("kmer").alias("_i"), *names)
    places = F.explode(F.sequence(F.lit(0), F.lit(4**k - 1))).alias("_i")
    grid = (weights.select(*by).distinct() if by else weights.sparkSession.range(1)).select(*by, places, *[F.lit(0.0).alias(n) for n in names])
    # 4^k rows a group
    full = cells.unionByName(grid).groupBy(*by, "_i").agg(*[F.sum(n).alias(n) for n in names])
    return full.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", *names))).alias("_c")).select(*by, *[F.col(f"_c.{n}").alias(n) for n in names])


def mean_array(weights, k):
    """The mean model as one array value."""
    return word_arrays(mean_weights(weights), [], ["weight"], k).scalar()


PARTS = 8  # a group's rows meet copies of its model in as many tasks


def with_arrays(rows, own, mean, key, group, seq) -> DataFrame:
    """(key, group, _seq) with the group's arrays, null where it has none, and the mean model as _mean."""
    parted = rows.select(key, group, F.col(seq).alias("_seq"), F.pmod(F.xxhash64(key, seq), F.lit(PARTS)).cast("int").alias("_part"))
    copies = own.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return parted.join(copies, [group, "_part"], "left").withColumn("_mean", mean)


def word_sums(rows, key, group, seq, k, arrays: dict) -> DataFrame:
    """(key, group, a sum for each of ``arrays``): the values of a row's words, found in the row itself, so
    that one short row a row moves and not its words.  Rows without words give none."""
    at = rows.withColumn("_at", word_codes(seq, k))
    total = lambda a: F.aggregate("_at", F.lit(0.0), lambda acc, i: acc + F.get(a, i))
    each = at.select(key, group, *[F.when(F.size("_at") > 0, total(a)).alias(n) for n, a in arrays.items()])
    return each.groupBy(key, group).agg(*[F.sum(n).alias(n) for n in arrays]).where(F.col(next(iter(arrays))).isNotNull())


def nb_scores(rows, weights, key, group, seq, k=4) -> DataFrame:
    """Sum of count x weight; groups without a model use the mean model."""
    weights = cut_lineage(weights)
    own = word_arrays(weights, [group], ["weight"], k).withColumnRenamed("weight", "_own")
    met = with_arrays(rows, own, mean_array(weights, k), key, group, seq)
    return word_sums(met, key, group, "_seq", k, {"score": F.coalesce("_own", "_mean")})


def knn_transfer(rows, weights, neighbours, key, group, seq, k=4, n=3) -> DataFrame:
    """Scores by identity-weighted models of the n nearest train groups; mean model without hits.

    neighbours: (group, target, fident, rk).  The blended model is built per group
    first (one array a group), so rows meet one model only.
    """
    weights = cut_lineage(weights)
    near = neighbours.where((F.col("rk") <= n) & (F.col("fident") > 0))
    total = near.groupBy(group).agg(F.sum("fident").alias("_t"))
    blend = (
        near.join(total, group)
        .join(weights.withColumnRenamed(group, "target"), "target")
        .groupBy(group, "kmer")
        .agg(F.sum(F.col("weight") * F.col("fident") / F.col("_t")).alias("_own"))
    )
    own = word_arrays(blend, [group], ["_own"], k)
    met = with_arrays(rows, own, mean_array(weights, k), key, group, seq)
    # a row without a group has no model
    none = F.when(F.col(group).isNull(), F.array_repeat(F.lit(0.0), 4**k))
    return word_sums(met, key, group, "_seq", k, {"score": F.coalesce(none, "_own", "_mean")})


def neighbour_scores(rows, weights, neighbours, key, group, seq, k=4, ns=(1, 3, 5)) -> DataFrame:
    """(key, group, mean, nn1, nn3, ..): scores by the mean model and by the identity-weighted models
    of the nearest n groups, all in one pass over the rows; the mean model without hits."""
    weights = cut_lineage(weights)
    near = neighbours.where((F.col("rk") <= max(ns)) & (F.col("fident") > 0))
    each = near.select("*", F.explode(F.filter(F.array(*[F.lit(n) for n in ns]), lambda n: n >= F.col("rk"))).alias("_n"))
    total = each.groupBy(group, "_n").agg(F.sum("fident").alias("_t"))
    blend = each.join(total, [group, "_n"]).join(weights.withColumnRenamed(group, "target"), "target")
    part = F.col("weight") * F.col("fident") / F.col("_t")
    wide = blend.groupBy(group, "kmer").agg(*[F.sum(F.when(F.col("_n") == n, part)).alias(f"_w{n}") for n in ns])
    own = word_arrays(wide, [group], [f"_w{n}" for n in ns], k)
    met = with_arrays(rows, own, mean_array(weights, k), key, group, seq)
    return word_sums(met, key, group, "_seq", k, {"mean": F.col("_mean")} | {f"nn{n}": F.coalesce(f"_w{n}", "_mean") for n in ns})


def best_identity(neighbours, group) -> DataFrame:
    """Identity of each group's nearest neighbour."""
    return neighbours.where("rk = 1").select(group, F.col("fident").alias("best_identity"))


def transfer_report(scored, scorers, group, n_boot=200, ref="mean", bins="identity_bin", label=LABEL, seed=42) -> DataFrame:
    """scored (group, label, bins, a column for each scorer): by scorer, overall and by bin, the AUROC
    with its interval over resampled groups, the difference to ``ref`` with its interval, the median
    AUROC of a group, and the rows and groups that took part (groups with both labels)."""
    from pairloom.operators.bootstrap import paired_bootstrap

    both = scored.groupBy(group).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a < _b").select(group)
    scored = scored.join(both, group, "left_semi")
    long = scored.select(group, label, bins, *scorers).unpivot([group, label, bins], list(scorers), "scorer", "score")
    long = cut_lineage(long.select(group, label, "scorer", "score", F.explode(F.array(F.lit("overall"), F.col(bins))).alias("scope")))
    ci = paired_bootstrap(long, ref, n_boot, unit=group, label=label, stratum="scope", seed=seed)
    per = mt.auroc(long, ["scope", "scorer", group], "score", label).where("auroc IS NOT NULL")
    mid = quantiles(per, ["scope", "scorer"], "auroc", {"group_median": 0.5})
    size = long.groupBy("scope", "scorer").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"))
    return ci.join(mid, ["scope", "scorer"]).join(size, ["scope", "scorer"])


def label_prior(train, test, key, group="protein_name", seq="rna_sequence", label=LABEL) -> DataFrame:
    """Mean train label of the protein, else of the RNA, else of all; and the degree variant."""
    p = train.groupBy(group).agg(F.avg(label).alias("_p"))
    r = train.groupBy(seq).agg(F.avg(label).alias("_r"))
    base = train.agg(F.avg(label)).scalar()
    j = test.join(p, group, "left").join(r, seq, "left").withColumn("_g", base)
    half = F.lit(0.5)
    return j.select(
        key, label, F.coalesce("_p", "_r", "_g").alias("prior"), ((F.coalesce("_p", half) + F.coalesce("_r", half)) / 2).alias("degree_prior")
    )


# ---- many small fits ----------------------------------------------------------

_CODE = np.full(256, -1, np.int64)
for _i, _b in enumerate(RNA4):
    _CODE[ord(_b)] = _i


WORD_ROWS = 4096


def word_matrix(seqs, k: int) -> np.ndarray:
    """Row-normalised word frequencies, words in ACGU order."""
    out = np.zeros((len(seqs), 4**k))
    powers = 4 ** np.arange(k - 1, -1, -1)
    for lo in range(0, len(seqs), WORD_ROWS):
        texts = [s.encode("latin1", "replace") for s in seqs[lo : lo + WORD_ROWS]]
        code = _CODE[np.frombuffer(b"".join(texts), np.uint8)]
        if len(code) < k:
            continue
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        win = np.lib.stride_tricks.sliding_window_view(code, k)
        row, last = row[: len(win)], row[k - 1 :]
        keep = (win >= 0).all(1) & (row == last)
        n = np.bincount(row[keep] * 4**k + win[keep] @ powers, minlength=len(texts) * 4**k).reshape(len(texts), -1)
        out[lo : lo + len(texts)] = n / np.maximum(1, n.sum(1, keepdims=True))
    return out


STEPS, SETTLED = 25, 1e-6


def _design(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x / scale])


def _slopes(a: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss over some rows; both add over rows."""
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    return a.T @ (p - y), (a * (p * (1 - p))[:, None]).T @ a


def _newton(w: np.ndarray, g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, bool]:
    """The next weights, and whether they have settled; the intercept is hardly penalised."""
    pen = np.full(len(w), l2)
    pen[0] = 1e-6
    d = np.linalg.solve(h + np.diag(pen + 1e-9), g + pen * w)
    return w - d, bool(np.abs(d).max() < SETTLED)


def logistic_fit(x: np.ndarray, y: np.ndarray, l2: float, steps: int = STEPS) -> np.ndarray:
    """Newton steps for ridge-penalised logistic regression; first entry is the intercept."""
    scale = x.std(0)
    scale[(scale == 0) | (x.min(0) == x.max(0))] = 1.0
    a = _design(x, scale)
    w, settled = np.zeros(a.shape[1]), False
    for _ in range(steps):
        w, settled = _newton(w, *_slopes(a, y, w), l2)
        if settled:
            break
    w[1:] /= scale
    return w


def sharded(df, group, key, limit=SHARD_ROWS) -> DataFrame:
    """Rows with _shards, how many shards of at most about ``limit`` rows the group has, and _shard."""
    n = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / limit).alias("_shards"))
    return df.join(n, group).withColumn("_shard", F.pmod(F.xxhash64(F.lit("shard"), key), F.col("_shards")))


def combined(parts, keys, column, how=F.sum) -> DataFrame:
    """Arrays of equal length, combined place by place: partial results meet before the shuffle."""
    cells = parts.select(*keys, F.posexplode(column).alias("_i", "_v")).groupBy(*keys, "_i").agg(how("_v").alias("_v"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_v")))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda c: c["_v"]).alias(column))


def _packed_shards(rows, group, seq, label) -> DataFrame:
    """(group, shard, texts, labels): one row a shard, written once."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: [pdf[group].iloc[0]], "shard": [pdf["_shard"].iloc[0]], "texts": [pdf[seq].tolist()], "labels": [pdf[label].to_numpy(float)]})

    kind = f"{group} {dict(rows.dtypes)[group]}, shard long, texts array<string>, labels array<double>"
    return cut_lineage(rows.groupBy(group, "_shard").applyInPandas(pack, kind))


def _shard_slopes(shards, models, group, gtype, k) -> DataFrame:
    """Gradient and curvature of every shard under its group's models, without a shuffle of the shards:
    a model has some kilobytes, and there is one for every ``SHARD_ROWS`` rows at most."""

    def slopes(batches):
        for pdf in batches:
            out, seen = [], None
            for m in pdf.itertuples():
                if seen != (m.of, m.shard):
                    seen, x, y = (m.of, m.shard), word_matrix(m.texts, k), np.asarray(m.labels, float)
                g, h = _slopes(_design(x, m.scale), y, m.w)
                out.append((m.of, m.model, np.concatenate([g, h.ravel()])))
            yield pd.DataFrame(out, columns=[group, "model", "slopes"])

    ask = shards.join(F.broadcast(models.select(group, "model", "w", "scale")), group)
    return ask.withColumnRenamed(group, "of").mapInPandas(slopes, f"{group} {gtype}, model string, slopes array<double>")


def _fit_shards(rows, group, seq, label, k, l2s, steps=STEPS) -> DataFrame:
    """``logistic_fit`` of groups of any size: (group, model, weights), one job a Newton step.

    A shard is written once, as one row; a step sends the models to the shards, and only sums move.
    """
    gtype, d = dict(rows.dtypes)[group], 4**k
    shards = _packed_shards(rows, group, seq, label)

    def moments(batches):
        for pdf in batches:
            out = []
            for g, texts, y in zip(pdf[group], pdf["texts"], pdf["labels"]):
                x = word_matrix(texts, k)
                sums = np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)])
                out.append((g, sums, np.concatenate([x.min(0), -x.max(0)])))
            yield pd.DataFrame(out, columns=[group, "sums", "ends"])

    first = cut_lineage(shards.mapInPandas(moments, f"{group} {gtype}, sums array<double>, ends array<double>"))
    return _newton_steps(first, lambda models: _shard_slopes(shards, models, group, gtype, k), group, gtype, d, l2s, steps)


def _newton_steps(first, slopes, group, gtype, d, l2s, steps) -> DataFrame:
    """(group, model, weights) from the moments of shards, ``first``, and ``slopes(models)``, gradients and curvatures of shards."""

    def begin(batches):
        for pdf in batches:
            out = []
            for g, sums, ends in zip(pdf[group], pdf["sums"], pdf["ends"]):
                n, ones, mean, square = sums[0], sums[1], sums[2 : 2 + d] / sums[0], sums[2 + d :] / sums[0]
                scale = np.sqrt(np.maximum(square - mean**2, 0))
                scale[(scale == 0) | (ends[:d] == -ends[d:])] = 1.0
                if 0 < ones < n:
                    out += [(g, f"l2={c:g}", float(c), np.zeros(d + 1), scale, False) for c in l2s]
            yield pd.DataFrame(out, columns=[group, "model", "l2", "w", "scale", "settled"])

    def step(batches):
        for pdf in batches:
            moved = [
                (w, True) if settled else _newton(w, s[: d + 1], s[d + 1 :].reshape(d + 1, d + 1), l2)
                for w, settled, s, l2 in zip(pdf["w"], pdf["settled"], pdf["slopes"], pdf["l2"])
            ]
            yield pdf.drop(columns="slopes").assign(w=[w for w, _ in moved], settled=[done for _, done in moved])

    state = f"{group} {gtype}, model string, l2 double, w array<double>, scale array<double>, settled boolean"
    models = cut_lineage(combined(first, [group], "sums").join(combined(first, [group], "ends", F.min), group).mapInPandas(begin, state))
    for _ in range(steps):
        parts = slopes(models.where("not settled"))
        moved = models.join(combined(parts, [group, "model"], "slopes"), [group, "model"], "left")
        models = cut_lineage(moved.select(*models.columns, "slopes").mapInPandas(step, state))
        if models.where("not settled").isEmpty():
            break
    unscaled = F.transform("w", lambda w, i: F.when(i == 0, w).otherwise(w / F.get("scale", i - 1)))
    return models.select(group, "model", unscaled.alias("weights"))


def fit_groups(train, group, key, seq="rna_sequence", label=LABEL, k=3, l2s=(1.0,), limit=SHARD_ROWS) -> DataFrame:
    """One logistic word model per group and penalty: (group, model, weights), weights[0] the intercept.

    Groups with one label only get no model.
    """
    gtype = dict(train.dtypes)[group]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[label].to_numpy(float)
        if y.min() == y.max():
            return pd.DataFrame(columns=[group, "model", "weights"])
        x = word_matrix(pdf[seq].tolist(), k)
        rows = [(pdf[group].iloc[0], f"l2={c:g}", logistic_fit(x, y, c)) for c in l2s]
        return pd.DataFrame(rows, columns=[group, "model", "weights"])

    rows = cut_lineage(sharded(train.select(group, F.col(key).alias("_key"), seq, label), group, "_key", limit))
    whole = rows.where("_shards = 1").groupBy(group).applyInPandas(fit, f"{group} {gtype}, model string, weights array<double>")
    large = rows.where("_shards > 1")
    return whole if large.isEmpty() else whole.unionByName(_fit_shards(large, group, seq, label, k, l2s))


def word_index(word):
    """Position of an ACGU word in word order."""
    return F.conv(F.translate(word, RNA4, "0123"), 4, 10).cast("int")


def dot_score(seq, weights, k):
    """Intercept plus mean weight of the words: one array look-up per word, inside the JVM."""
    words = kmers(seq, k, RNA4)
    total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.get(weights, word_index(w) + 1))
    return F.get(weights, F.lit(0)) + F.coalesce(F.try_divide(total, F.size(words)), F.lit(0.0))


def score_groups(rows, models, on, seq="rna_sequence", k=3) -> DataFrame:
    return rows.join(models, on).withColumn("score", dot_score(seq, F.col("weights"), k)).drop("weights")


def per_group_models(df, group, key, seq="rna_sequence", label=LABEL, k=3, l2s=(0.1, 1.0, 10.0), min_train=20, min_class=5, seed=42) -> DataFrame:
    """Majority dedup, 60/20/20, modal train length, fit, choose by validation, report test."""
    from pairloom.operators.filters import dedup_majority, modal_length
    from pairloom.operators.splits import stratified_rows

    one = dedup_majority(df.select(group, key, seq, label), [group, seq], key)
    s = cut_lineage(modal_length(stratified_rows(one, group, key, label, min_class=min_class, seed=seed), group, seq, split="split"))
    train = s.where(F.col("split") == "train")
    big = train.groupBy(group).agg(F.count(F.lit(1)).alias("n_train"), F.min(label).alias("_a"), F.max(label).alias("_b")).where(
        (F.col("n_train") >= min_train) & (F.col("_a") != F.col("_b"))
    )
    models = cut_lineage(fit_groups(train.join(big.select(group), group, "left_semi"), group, key, seq, label, k, l2s))
    scored = cut_lineage(score_groups(s.where(F.col("split") != "train"), models, group, seq, k).select(group, "model", "split", label, "score"))
    m = mt.ranking(scored, [group, "model", "split"], "score", label)
    val = m.where((F.col("split") == "val") & F.col("auroc").isNotNull())
    best = val.groupBy(group).agg(F.max_by(F.struct("model", "auroc", "auprc"), F.struct("auroc", "auprc", "model")).alias("v"))
    test = m.where(F.col("split") == "test").select(group, "model", F.col("auroc").alias("test_auroc"), F.col("auprc").alias("test_auprc"), F.col("n_pos").alias("test_pos"), F.col("n_neg").alias("test_neg"))
    return best.select(group, "v.model", F.col("v.auroc").alias("val_auroc")).join(test, [group, "model"]).join(big.select(group, "n_train"), group)


def per_group_cv(df, group, key, seq="rna_sequence", label=LABEL, folds=5, k=3, l2=1.0, seed=42) -> DataFrame:
    """Out-of-fold AUROC per group; equal sequences share a fold."""
    f = cut_lineage(kfold(df.select(group, key, seq, label), folds, key, by=seq, seed=seed))
    unit = lambda c: F.concat_ws("|", F.col(group).cast("string"), c.cast("string"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda x: x != F.col("fold"))
    train = f.select(group, key, seq, label, F.explode(others).alias("leave")).withColumn("unit", unit(F.col("leave")))
    models = fit_groups(train, "unit", key, seq, label, k, (l2,))
    scored = score_groups(f.withColumn("unit", unit(F.col("fold"))), models, "unit", seq, k)
    return mt.ranking(scored, group, "score", label)


def score_exemplars(exemplars, models, group, seq="rna_sequence", k=3) -> DataFrame:
    """Per group: medians, do all positives beat all negatives, share above zero (few rows per group)."""
    s = score_groups(exemplars, models, group, seq, k)
    pos, neg = F.when(F.col(LABEL) == 1, F.col("score")), F.when(F.col(LABEL) == 0, F.col("score"))
    return s.groupBy(group).agg(
        F.percentile(pos, F.lit(0.5)).alias("median_pos"), F.percentile(neg, F.lit(0.5)).alias("median_neg"),
        (F.min(pos) > F.max(neg)).cast("int").alias("all_above"), F.avg((pos > 0).cast("double")).alias("share_pos_above"),
        F.avg((neg > 0).cast("double")).alias("share_neg_above"),
    )


def transfer_matrix(df, group, protocol, key, seq="rna_sequence", label=LABEL, k=3, l2=1.0, min_class=5, seed=42) -> DataFrame:
    """Train on one protocol, test on each protocol of the same group; own rows are a 60/20/20 split."""
    from pairloom.operators.splits import stratified_rows

    d = df.withColumn("unit", F.concat_ws("|", group, protocol))
    s = cut_lineage(stratified_rows(d.select(group, protocol, "unit", key, seq, label), "unit", key, label, min_class=min_class, seed=seed))
    train = s.where(F.col("split") == "train")
    models = cut_lineage(fit_groups(train, "unit", key, seq, label, k, (l2,)))
    owner = s.select("unit", group, F.col(protocol).alias("train_protocol")).distinct()
    models = models.join(owner, "unit").select(group, "train_protocol", "weights")
    rows = s.select(group, F.col(protocol).alias("test_protocol"), key, seq, label, "split")
    # protocols are a handful, so a row meets a handful of models
    scored = rows.join(models, group).where((F.col("train_protocol") != F.col("test_protocol")) | (F.col("split") == "test"))
    scored = cut_lineage(scored.withColumn("score", dot_score(seq, F.col("weights"), k)).select(group, "train_protocol", "test_protocol", seq, label, "score"))
    m = mt.ranking(scored, [group, "train_protocol", "test_protocol"], "score", label)
    seen = train.select(group, F.col(protocol).alias("train_protocol"), seq).distinct().withColumn("_s", F.lit(1))
    share = (
        scored.select(group, "train_protocol", "test_protocol", seq).distinct().join(seen, [group, "train_protocol", seq], "left")
        .groupBy(group, "train_protocol", "test_protocol").agg(F.sum(F.coalesce("_s", F.lit(0))).alias("n_shared_rna"), F.avg(F.coalesce("_s", F.lit(0))).alias("share_rna"))
    )
    kind = F.when(F.col("train_protocol") == F.col("test_protocol"), "within").otherwise("transfer")
    return m.join(share, [group, "train_protocol", "test_protocol"]).withColumn("kind", kind)


# ---- ridge --------------------------------------------------------------------


def ridge_groups(df, group, key, seq, target, k=3, alpha=1.0, limit=SHARD_ROWS) -> DataFrame:
    """Exact ridge word model per group: shards emit normal equations, one small task per group solves."""
    gtype, size = dict(df.dtypes)[group], 4**k + 1

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.hstack([np.ones((len(pdf), 1)), word_matrix(pdf[seq].tolist(), k)])
        y = pdf[target].to_numpy(float)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "sums": [np.concatenate([(x.T @ x).ravel(), x.T @ y])]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        both = pdf["sums"].iloc[0]
        xx, xy = both[: size * size].reshape(size, size), both[size * size :]
        pen = np.full(size, alpha)
        pen[0] = 1e-9
        return pd.DataFrame({group: [pdf[group].iloc[0]], "weights": [np.linalg.solve(xx + np.diag(pen), xy)]})

    parts = sharded(df.select(group, F.col(key).alias("_key"), seq, target), group, "_key", limit).groupBy(group, "_shard").applyInPandas(
        partial, f"{group} {gtype}, sums array<double>"
    )
    return combined(parts, [group], "sums").groupBy(group).applyInPandas(solve, f"{group} {gtype}, weights array<double>")


def intensity_spearman(df, scores, scorers, group, key, seq, value, k=3, folds=3, min_probes=200, alpha=0.01, seed=42) -> DataFrame:
    """(group, n_probes, a rank correlation with the intensity for each scorer, own_cv): the last is a
    ridge of the group's own probes on the ranks of their intensities, in cross-validation.

    Replicates of a probe are averaged; groups of fewer than ``min_probes`` probes are left out.
    ``scores``: (key, scorers..) of the first key of a probe.
    """
    d = df.groupBy(group, seq).agg(F.min(key).alias(key), F.avg(value).alias(value))
    n = d.groupBy(group).agg(F.count(F.lit(1)).alias("n_probes")).where(F.col("n_probes") >= min_probes)
    d = cut_lineage(kfold(d.join(n.select(group), group, "left_semi"), folds, key, by=seq, seed=seed))
    at = d.groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = ordered_prefix(at, group, value, {"_before": "_c"}).select(group, value, (F.col("_before") + (F.col("_c") - 1) / 2.0).alias("_rank"))
    d = cut_lineage(d.join(ranks, [group, value]))
    unit = lambda c: F.concat_ws("|", F.col(group).cast("string"), c.cast("string"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda x: x != F.col("fold"))
    train = d.select(group, key, seq, "_rank", F.explode(others).alias("leave")).withColumn("unit", unit(F.col("leave")))
    own = score_groups(d.withColumn("unit", unit(F.col("fold"))), ridge_groups(train, "unit", key, seq, "_rank", k, alpha), "unit", seq, k)
    out = n.join(mt.spearman(own, group, value, "score").select(group, F.col("rho").alias("own_cv")), group, "left")
    long = d.select(group, key, value).join(scores.select(key, *scorers), key).unpivot([group, value], list(scorers), "scorer", "score")
    rho = mt.spearman(long, [group, "scorer"], value, "score")
    wide = rho.groupBy(group).agg(*[F.max(F.when(F.col("scorer") == c, F.col("rho"))).alias(c) for c in scorers])
    return out.join(wide, group, "left")


def intensity_summary(table, scorers, group, bins="identity_bin", n_boot=200, seed=42) -> DataFrame:
    """By scorer, overall and by bin: number, mean and median of the groups' correlations and the
    interval of the mean over resampled groups."""
    from pairloom.operators.bootstrap import bootstrap_stat

    long = table.select(group, bins, *scorers).unpivot([group, bins], list(scorers), "scorer", "rho").where("rho IS NOT NULL")
    long = cut_lineage(long.select(group, "scorer", "rho", F.explode(F.array(F.lit("overall"), F.col(bins))).alias("scope")))
    by = ["scope", "scorer"]
    ci = bootstrap_stat(long, group, "rho", "mean", by, n_boot, seed).withColumnsRenamed({"point": "mean", "stat_lo": "mean_lo", "stat_hi": "mean_hi"})
    return ci.drop("n_replicates").join(quantiles(long, by, "rho", {"median": 0.5}), by)


# ---- spark.ml -----------------------------------------------------------------


def word_vector(df, seq, k, alphabet, out) -> DataFrame:
    """Sparse L1-normalised word vector over a vocabulary made by rule."""
    tokens = f"_{out}_tok"
    cv = CountVectorizerModel.from_vocabulary(alphabet_kmers(alphabet, k), inputCol=tokens, outputCol=f"_{out}_raw")
    d = cv.transform(df.withColumn(tokens, kmers(seq, k, alphabet)))
    return Normalizer(p=1.0, inputCol=f"_{out}_raw", outputCol=out).transform(d).drop(tokens, f"_{out}_raw")


def protein_vectors(df, group="protein_name", seq="protein_sequence", k=3) -> DataFrame:
    """Each distinct protein is encoded once."""
    p = df.groupBy(group).agg(F.min(seq).alias(seq))
    return word_vector(p, seq, k, AMINO_ACIDS, "prot_vec").select(group, "prot_vec", F.length(seq).alias("prot_len"))


def build_features(df, proteins, group="protein_name", seq="rna_sequence", source="dataset_source", split="split", k=4):
    """RNA 4-mers, protein 3-mers, source, lengths over the train maximum; scaled by train only.

    ``group`` is the key by which rows name their protein of ``proteins``.
    """
    p = protein_vectors(proteins, group)
    d = word_vector(df, seq, k, "AUGC", "rna_vec").join(p, group)
    train = d.where(F.col(split) == "train")
    top = train.agg(F.max(F.length(seq)).alias("r"), F.max("prot_len").alias("p")).first()
    d = d.withColumns({"rna_rel": F.length(seq) / top["r"], "prot_rel": F.col("prot_len") / top["p"]})
    index = StringIndexer(inputCol=source, outputCol="_src", handleInvalid="keep").fit(d.where(F.col(split) == "train"))
    d = index.transform(d)
    hot = OneHotEncoder(inputCol="_src", outputCol="src_vec", handleInvalid="keep")
    d = hot.fit(d).transform(d)
    d = VectorAssembler(inputCols=["rna_vec", "prot_vec", "src_vec", "rna_rel", "prot_rel"], outputCol="_raw").transform(d)
    scaler = StandardScaler(withMean=False, withStd=True, inputCol="_raw", outputCol="features")
    return scaler.fit(d.where(F.col(split) == "train")).transform(d).drop("_raw", "_src", "prot_vec", "src_vec")


def fit_scores(train, test, model, label=LABEL) -> DataFrame:
    fitted = model.fit(train.withColumn("label", F.col(label).cast("double")))
    return fitted.transform(test).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def train_baselines(df, label=LABEL, split="split", seed=42, trees=200, depth=15, rounds=300, boosted_depth=6, steps=1000) -> DataFrame:
    """LR, random forest and boosted trees on ``features``; validation metrics, best first.

    The defaults are the surveyed sizes.
    """
    df = cut_lineage(df.select(label, split, "features"))
    train, val = df.where(F.col(split) == "train"), df.where(F.col(split) == "val")
    cols = dict(featuresCol="features", labelCol="label")
    kinds = {
        "logistic": LogisticRegression(maxIter=steps, regParam=0.01, **cols),
        "forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **cols),
        "boosted": GBTClassifier(maxIter=rounds, maxDepth=boosted_depth, seed=seed, **cols),
    }
    parts = [fit_scores(train, val, m, label).select(F.lit(n).alias("model"), label, "score") for n, m in kinds.items()]
    scored = cut_lineage(_union(parts))
    r = mt.ranking(scored, "model", "score", label).join(mt.threshold_metrics(scored, "model", "score", label), "model")
    return r.orderBy(F.desc("auroc"))


def kmer_lr(train, test, key, seq="rna_sequence", label=LABEL, k_max=4) -> DataFrame:
    """RNA-only n-gram logistic baseline: (key, label, score)."""

    def encode(d):
        for k in range(1, k_max + 1):
            d = word_vector(d, seq, k, "AUGC", f"w{k}")
        return VectorAssembler(inputCols=[f"w{k}" for k in range(1, k_max + 1)], outputCol="_raw").transform(d)

    a, b = encode(train), encode(test)
    sc = StandardScaler(withMean=False, inputCol="_raw", outputCol="features").fit(a)
    lr = LogisticRegression(maxIter=20, regParam=0.01, featuresCol="features", labelCol="label")
    return fit_scores(sc.transform(a), sc.transform(b), lr, label).select(key, label, "score")


def audit_splits(group, seq) -> dict:
    return {"random": None, "protein_disjoint": group, "rna_disjoint": seq}


def audit_folds(df, key, group="protein_name", seq="rna_sequence", label=LABEL, folds=5, seed=42) -> DataFrame:
    """The rows of ``shortcut_audit``, each once, with a column for each split: the row's fold, null where it is not in the split."""
    out = df
    for name, by in audit_splits(group, seq).items():
        if by:
            out = out.join(fold_map(df, folds, by, seed).withColumnRenamed("fold", name), by, "left")
        else:
            out = kfold(out, folds, key, label=label, seed=seed).withColumnRenamed("fold", name)
    return cut_lineage(out.drop(key))


def fold_priors(f, split, group, seq, label) -> DataFrame:
    """(fold, label, score): the mean label of the row's group in the other folds, else that of its sequence, else that of all."""
    rows = f.where(F.col(split).isNotNull()).select(group, seq, label, F.col(split).alias("fold"))

    def others(by, name):
        own = rows.groupBy(*by, "fold").agg(F.sum(label).alias("_s"), F.count(label).alias("_c"))
        total = own.groupBy(*by).agg(F.sum("_s").alias("_all"), F.sum("_c").alias("_of"))
        both = own.join(total, by) if by else own.crossJoin(total)
        return both.select(*by, "fold", F.try_divide(F.coalesce("_all", F.lit(0)) - F.coalesce("_s", F.lit(0)), F.col("_of") - F.col("_c")).alias(name))

    known = rows.join(others([group], "_p"), [group, "fold"], "left")
    rest = known.where("_p IS NULL").join(others([seq], "_r"), [seq, "fold"], "left").join(others([], "_g"), "fold", "left")
    return known.where("_p IS NOT NULL").select("fold", label, F.col("_p").alias("score")).unionByName(rest.select("fold", label, F.coalesce("_r", "_g").alias("score")))


AUDIT_ROWS = 1024  # rows whose scores under all models are held at once


def _audit_shards(f, proteins, protein, seq, label, splits, limit=SHARD_ROWS) -> DataFrame:
    """One row a shard: its rows' sequences, labels, folds and proteins by place among the shard's, and these as
    residue classes.  A protein lies once in each shard that has rows of it."""
    n = f.count()
    of = max(int(f.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // limit))
    bucket = F.pmod(F.xxhash64(protein), F.lit(of)).cast("int").alias("_bucket")
    size = cut_lineage(f.groupBy(bucket).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("_shards")))
    rows = f.select(protein, seq, label, *splits, bucket).join(size, "_bucket")
    rows = rows.select(protein, seq, label, *splits, "_bucket", F.pmod(F.xxhash64(seq, *splits), F.col("_shards")).cast("int").alias("_shard"))
    texts = proteins.select(protein, triad_letters("protein_sequence").alias("_t"), bucket).join(size.toDF("_bucket", "_n"), "_bucket")
    texts = texts.select(protein, "_t", "_bucket", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_shard"))

    def pack(own: pd.DataFrame, prot: pd.DataFrame) -> pd.DataFrame:
        if own[label].isnull().any():
            raise ValueError("labels must not be null")
        place = {k: i for i, k in enumerate(prot[protein])}
        own = own.assign(_at=own[protein].map(place)).dropna(subset=["_at"]).sort_values("_at", kind="stable")
        if not len(own):
            return pd.DataFrame(columns=AUDIT)
        folds = own[splits].fillna(-1).to_numpy(np.int8)
        at, used = np.unique(own["_at"].to_numpy(int), return_inverse=True)
        return pd.DataFrame([(own[seq].tolist(), own[label].to_numpy(float).tobytes(), folds.tobytes(), used.astype(np.int32).tobytes(), prot["_t"].iloc[at].tolist())], columns=AUDIT)

    return cut_lineage(rows.groupBy("_bucket", "_shard").cogroup(texts.groupBy("_bucket", "_shard")).applyInPandas(pack, AUDIT_TYPE))


AUDIT = ["texts", "y", "folds", "of", "proteins"]
AUDIT_TYPE = "texts array<string>, y binary, folds binary, of binary, proteins array<string>"


def _triads(text: str, k: int) -> np.ndarray:
    c = np.frombuffer(text.encode(), np.uint8).astype(np.int64) - 48
    if len(c) < k:
        return np.zeros(7**k)
    win = np.lib.stride_tricks.sliding_window_view(c, k) @ 7 ** np.arange(k - 1, -1, -1)
    return np.bincount(win, minlength=7**k) / len(win)


def _audit_blocks(batches, rna_k: int, protein_k: int, n_splits: int):
    """(word frequencies, labels, folds, proteins by place, protein frequencies) of blocks of a shard's rows."""
    for row in _rows(batches):
        prot = np.stack([_triads(t, protein_k) for t in row.proteins])
        y, of = np.frombuffer(row.y, float), np.frombuffer(row.of, np.int32)
        folds = np.frombuffer(row.folds, np.int8).reshape(-1, n_splits)
        for lo in range(0, len(y), AUDIT_ROWS):
            hi = min(len(y), lo + AUDIT_ROWS)
            first = of[lo]
            yield word_matrix(list(row.texts[lo:hi]), rna_k), y[lo:hi], folds[lo:hi], of[lo:hi] - first, prot[first : of[hi - 1] + 1]


class _Audit:
    """Models of a shortcut audit over packed shards: ``models`` are (split, features, fold); all are evaluated in one pass.

    A model's rows are those of its split outside its fold.  Features are centred and scaled by their rows, as spark.ml does.
    """

    def __init__(self, shards, splits, folds, rna_k, protein_k):
        self.shards, self.splits, self.folds, self.ks = shards, splits, folds, (rna_k, protein_k)
        self.width = (4**rna_k, 7**protein_k)

    def moments(self):
        """By split and fold: number of rows, of ones, sums, squares and ends of the features."""
        ks, n_splits, folds = self.ks, len(self.splits), self.folds

        def run(batches):
            total = {}
            for x, y, fold, of, prot in _audit_blocks(batches, *ks, n_splits):
                both = np.hstack([x, prot[of]])
                for s in range(n_splits):
                    for k in range(folds):
                        own = fold[:, s] == k
                        if own.any():
                            z = both[own]
                            new = np.concatenate([[len(z), y[own].sum()], z.sum(0), (z * z).sum(0)]), np.concatenate([z.min(0), -z.max(0)])
                            old = total.get((s, k))
                            total[s, k] = new if old is None else (old[0] + new[0], np.minimum(old[1], new[1]))
            yield pd.DataFrame([(s, k, *v) for (s, k), v in total.items()], columns=["s", "k", "sums", "ends"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.iloc[:1].assign(sums=[np.sum(pdf["sums"].to_list(), 0)], ends=[np.min(pdf["ends"].to_list(), 0)])

        kind = "s int, k int, sums array<double>, ends array<double>"
        got = self.shards.mapInPandas(run, kind).groupBy("s", "k").applyInPandas(add, kind).toPandas()  # a row a split and fold
        return {(r.s, r.k): (np.array(r.sums), np.array(r.ends)) for r in got.itertuples()}

    def prepare(self, kinds: dict):
        """Models that have both labels, with the mean and scale of their features."""
        have, d = self.moments(), sum(self.width)
        self.models, self.mean, self.scale, self.start, self.rows = [], [], [], [], []
        for s in range(len(self.splits)):
            for k in range(self.folds):
                rest = [v for (t, j), v in have.items() if t == s and j != k]
                if not rest or (s, k) not in have:
                    continue
                sums, ends = np.sum([v[0] for v in rest], 0), np.min([v[1] for v in rest], 0)
                n, ones = sums[:2]
                if not 0 < ones < n:
                    continue
                mean = sums[2 : 2 + d] / n
                var = np.maximum(sums[2 + d :] - n * mean**2, 0) / (n - 1)
                var[ends[:d] == -ends[d:]] = 0
                inv = np.where(var > 0, 1 / np.sqrt(np.where(var > 0, var, 1)), 0.0)
                for kind, use in kinds.items():
                    keep = np.repeat(use, self.width)
                    self.models.append((s, kind, k))
                    self.mean.append(np.where(keep, mean, 0))
                    self.scale.append(np.where(keep, inv, 0))
                    self.start.append(np.log(ones / (n - ones)))
                    self.rows.append(n)

    def slopes(self, asked: dict) -> dict:
        """Loss and gradient of each asked model at its point (scaled and centred coefficients, then the intercept)."""
        ids = list(asked)
        w = np.stack([asked[m][:-1] * self.scale[m] for m in ids], 1)
        at = np.array([asked[m][-1] - asked[m][:-1] @ (self.scale[m] * self.mean[m]) for m in ids])
        split, fold = np.array([self.models[m][0] for m in ids]), np.array([self.models[m][2] for m in ids])
        ks, n_splits, r = self.ks, len(self.splits), self.width[0]

        def run(batches):
            loss, grad, ones = np.zeros(len(ids)), np.zeros_like(w), np.zeros(len(ids))
            for x, y, folds, of, prot in _audit_blocks(batches, *ks, n_splits):
                z = x @ w[:r] + (prot @ w[r:])[of] + at
                own = folds[:, split]
                keep = (own != fold) & (own >= 0)
                # log(1 + e^z) - y z
                loss += ((np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y[:, None] * z) * keep).sum(0)
                m = (1 / (1 + np.exp(-z)) - y[:, None]) * keep
                ones += m.sum(0)
                grad[:r] += x.T @ m
                start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                grad[r:] += prot[of[start]].T @ np.add.reduceat(m, start)
            yield pd.DataFrame({"m": ids, "v": [np.concatenate([[loss[i], ones[i]], grad[:, i]]) for i in range(len(ids))]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.iloc[:1].assign(v=[np.sum(pdf["v"].to_list(), 0)])

        with np.errstate(over="ignore"):
            got = self.shards.mapInPandas(run, "m int, v array<double>").groupBy("m").applyInPandas(add, "m int, v array<double>").toPandas()  # a row a model
        out = {}
        for row in got.itertuples():
            v, m = np.array(row.v), row.m
            g = (v[2:] - v[1] * self.mean[m]) * self.scale[m]
            out[m] = v[0] / self.rows[m], np.append(g, v[1]) / self.rows[m]
        return out

    def fit(self, l2: float, steps: int):
        """Coefficients and intercepts, by the L-BFGS steps of spark.ml, all models side by side."""

        def penalised(m, x, f, g):
            return f + 0.5 * l2 * (x[:-1] @ x[:-1]), g + l2 * np.append(x[:-1], 0)

        runs = {m: lbfgs_steps(np.append(np.zeros(sum(self.width)), b), steps) for m, b in enumerate(self.start)}
        asked, done = {m: next(run) for m, run in runs.items()}, {}
        while asked:
            more = {}
            for m, (f, g) in self.slopes(asked).items():
                try:
                    more[m] = runs[m].send(penalised(m, asked[m], f, g))
                except StopIteration as end:
                    done[m] = end.value
            asked = more
        return [(done[m][:-1] * self.scale[m], done[m][-1] - done[m][:-1] @ (self.scale[m] * self.mean[m])) for m in range(len(self.models))]

    def cells(self, fits, label) -> DataFrame:
        """(m, score, label, n): the scores of every model's fold, counted."""
        w, at = np.stack([c for c, _ in fits], 1), np.array([b for _, b in fits])
        split, fold = np.array([m[0] for m in self.models]), np.array([m[2] for m in self.models])
        ks, n_splits, r = self.ks, len(self.splits), self.width[0]

        def run(batches):
            for x, y, folds, of, prot in _audit_blocks(batches, *ks, n_splits):
                p = 1 / (1 + np.exp(-(x @ w[:r] + (prot @ w[r:])[of] + at)))
                row, m = np.nonzero(folds[:, split] == fold)
                yield pd.DataFrame({"m": m, "score": p[row, m], label: y[row]}).groupby(["m", "score", label], as_index=False).size().rename(columns={"size": "n"})

        return self.shards.mapInPandas(run, f"m int, score double, {label} double, n long")


def lbfgs_steps(x, steps: int, memory=10, tol=1e-6):
    """L-BFGS with a strong Wolfe line search as in Breeze, which spark.ml uses: yields points, is sent (value, gradient),
    returns the last point."""
    f, g = yield x
    s_, y_, failed, it = [], [], False, 0
    while it < steps and np.linalg.norm(g) > max(tol * abs(f), 1e-8):
        d, alphas = g.copy(), []
        for s, y in zip(s_, y_):
            alphas.append((s @ d) / (s @ y))
            d -= alphas[-1] * y
        if s_:
            d *= (s_[0] @ y_[0]) / (y_[0] @ y_[0])
        for s, y, a in reversed([*zip(s_, y_, alphas)]):
            d += (a - (y @ d) / (s @ y)) * s
        d = -d
        met = yield from _wolfe(x, d, f, g @ d, 1.0 if it else 1.0 / np.linalg.norm(d))
        if met is None or met[0] * np.linalg.norm(g) < 1e-10:
            if failed:
                break
            failed, s_, y_ = True, [], []
            continue
        t, value, _, slope = met
        new = x + t * d
        s_, y_ = [new - x, *s_][:memory], [slope - g, *y_][:memory]
        x, f, g, failed, it = new, value, slope, False, it + 1
    return x


def _wolfe(x, d, f0, dd0, t):
    """(step, value, slope along d, gradient) along d, t being tried first; None if the search fails."""

    def phi(t):
        f, g = yield x + t * d
        return t, f, g @ d, g

    def between(low, high):
        (tl, fl, dl, _), (tr, fr, dr, _) = (high, low) if low[0] > high[0] else (low, high)
        d1 = dl + dr - 3 * (fl - fr) / (tl - tr)
        d2 = np.sqrt(d1 * d1 - dl * dr)
        t = tr - (tr - tl) * (dr + d2 - d1) / (dr - dl + 2 * d2)
        lo, hi = tl + 0.1 * (tr - tl), tl + 0.9 * (tr - tl)
        return lo if t < lo else hi if t > hi else t

    def zoom(low, high):
        for _ in range(10):
            c = yield from phi(between(low, high))
            if c[1] > f0 + 1e-4 * c[0] * dd0 or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(dd0):
                    return c
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        return None

    if dd0 > 0:
        return None
    low = 0.0, f0, dd0, None
    for i in range(10):
        c = yield from phi(t)
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > f0 + 1e-4 * t * dd0 or (c[1] >= low[1] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[2]) <= 0.9 * abs(dd0):
            return c
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low, t = c, t * 1.5
    return None


def shortcut_audit(
    df, proteins, key, group="protein_name", seq="rna_sequence", label=LABEL, folds=5, rna_k=4, protein_k=3, seed=42, protein=None
) -> DataFrame:
    """RNA-only, protein-only and both, under random, protein-disjoint and RNA-disjoint folds.

    Folds go by ``group``; ``protein`` (by default the same) is the key by which rows name their
    protein of ``proteins``.

    Every fold is scored by a model of the others: mean and spread of the folds' metrics, with
    the label prior (``prior``) as the score that knows names only.  A fold with one label has
    no metric and counts in n_folds only.

    Rows are packed once in shards, with each protein's text once; all models take their steps side by side, one pass
    over the shards for the values and gradients of all of them.
    """
    protein = protein or group
    splits = list(audit_splits(group, seq))
    rows = df.select(key, group, seq, label, *([] if protein == group else [protein])).join(proteins.select(protein), protein)
    f = audit_folds(rows, key, group, seq, label, folds, seed)
    audit = _Audit(_audit_shards(f, proteins, protein, seq, label, splits), splits, folds, rna_k, protein_k)
    audit.prepare({"rna": (True, False), "protein": (False, True), "both": (True, True)})
    prior = [fold_priors(f, s, group, seq, label).groupBy("fold", "score", label).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("split"), F.lit("prior").alias("features_used"), "fold", "score", F.col(label).cast("double").alias(label), "n") for s in splits]
    if audit.models:
        names = f.sparkSession.createDataFrame([(m, splits[s], kind, k) for m, (s, kind, k) in enumerate(audit.models)], "m int, split string, features_used string, fold int")
        prior.append(audit.cells(audit.fit(0.01, 15), label).join(F.broadcast(names), "m").drop("m"))
    m = mt.ranking(cut_lineage(_union(prior)), ["split", "features_used", "fold"], "score", label, weight="n")
    return m.groupBy("split", "features_used").agg(
        F.avg("auroc").alias("auroc"), F.stddev_samp("auroc").alias("auroc_std"), F.avg("auprc").alias("auprc"),
        F.count(F.lit(1)).alias("n_folds"), F.sum("n_pos").cast("long").alias("n_pos"), F.sum("n_neg").cast("long").alias("n_neg"),
    )


def fold_overlap(df, group, protein, seq, splits) -> DataFrame:
    """By split, a column of ``df`` with the row's fold: the shares of rows whose protein name, protein, RNA and pair also occur in another fold.

    Every row is a test row once, in its own fold; a key occurs in another fold if its folds differ.
    Only the keys' ends and numbers of rows move.
    """
    whole = F.col(group).isNotNull() & F.col(protein).isNotNull() & F.col(seq).isNotNull()
    keys = {"name_in_train": [group], "protein_in_train": [protein], "rna_in_train": [seq], "pair_in_train": [protein, seq]}
    out, rows = None, df
    for name, on in keys.items():
        rows = rows.where(F.col(on[0]).isNotNull())
        ends = rows.groupBy(*on).agg(*[x for s in splits for x in (F.min(s).alias(f"_lo_{s}"), F.max(s).alias(f"_hi_{s}"), F.count(F.when(whole, F.col(s))).alias(f"_n_{s}"))])
        hits = lambda s: F.sum(F.when(F.col(f"_lo_{s}") < F.col(f"_hi_{s}"), F.col(f"_n_{s}")).otherwise(0))
        one = ends.agg(F.array(*[F.struct(F.lit(s).alias("split"), hits(s).alias("hits"), F.sum(f"_n_{s}").alias("n")) for s in splits]).alias("_z"))
        share = one.select(F.explode("_z").alias("_z")).select("_z.*").where("n > 0").select("split", (F.col("hits") / F.col("n")).alias(name))
        out = share if out is None else out.join(share, "split")
    return out


def fold_similarity(df, key, pairs, cuts, name, splits) -> DataFrame:
    """By split, a column of ``df`` with the row's fold: the shares of rows whose sequence has one of similarity c or more in another
    fold, for each cut c.  ``key`` names the sequences' digests, pairs: (a, b, jaccard) of different sequences."""
    both = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("jaccard").alias("_sim"))
    both = both.unionByName(both.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "_sim"))
    seqs = df.select(F.col(key).alias("_a"), *splits)
    # the others have nothing similar in another fold
    wide = seqs.groupBy("_a").agg(*[F.min(s).alias(f"_lo_{s}") for s in splits], *[F.max(s).alias(f"_hi_{s}") for s in splits])
    apart = wide.where(reduce(lambda a, b: a | b, [F.col(f"_lo_{s}") < F.col(f"_hi_{s}") for s in splits])).select("_a")
    seqs = seqs.join(apart.unionByName(both.select("_a")).distinct(), "_a", "left_semi")
    long = seqs.select("_a", F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("fold")) for s in splits])).alias("_z")).select("_a", "_z.*").where("fold IS NOT NULL")
    cells = cut_lineage(long.groupBy("split", "_a", "fold").agg(F.count(F.lit(1)).alias("_rows")))
    ends = cells.groupBy("split", "_a").agg(F.min("fold").alias("_lo"), F.max("fold").alias("_hi"))
    own = ends.select("split", "_a", "_lo", "_hi", F.lit(1.0).alias("_sim"))
    near = both.join(ends.withColumnRenamed("_a", "_b"), "_b").select("split", "_a", "_lo", "_hi", "_sim")
    # the best similar sequence by the folds it lies in: two of them are enough to serve every fold
    best = own.unionByName(near).groupBy("split", "_a", "_lo", "_hi").agg(F.max("_sim").alias("_sim"))
    hit = cells.join(best, ["split", "_a"]).where((F.col("_lo") != F.col("fold")) | (F.col("_hi") != F.col("fold")))
    hit = hit.groupBy("split", "_a", "fold").agg(F.max("_sim").alias("_sim"))
    rows = cells.join(hit, ["split", "_a", "fold"])
    hits = rows.groupBy("split").agg(*[F.sum(F.when(F.col("_sim") >= c, F.col("_rows")).otherwise(0)).alias(f"_{i}") for i, c in enumerate(cuts)])
    n = df.agg(F.array(*[F.struct(F.lit(s).alias("split"), F.count(s).alias("n")) for s in splits]).alias("_z"))
    n = n.select(F.explode("_z").alias("_z")).select("_z.*").where("n > 0")
    return n.join(hits, "split", "left").select("split", *[(F.coalesce(f"_{i}", F.lit(0)) / F.col("n")).alias(f"{name}_similar_{round(100 * c)}") for i, c in enumerate(cuts)])


FIT_NEGATIVES = 10_000  # cross-unit negatives of one dataset that the reverse transfer is fitted on
POOL_ROWS = 4096  # sequences of a pool's shard


def _rank_digest(seed, name, seq) -> bytes:
    """The digest that ranks a sequence among the negatives of a dataset: that of the row's key, itself a digest."""
    return hashlib.sha256(f"{seed}|{hashlib.sha256(f'{name}|{seq}'.encode()).hexdigest()}".encode()).digest()


def _pool_shards(pool, cell, seq, names: dict, seed) -> DataFrame:
    """Shards of a cell's positives: their texts and, for each dataset of the cell, the first 32 bits of
    the digests that rank them among its negatives, and which are its own."""

    def shard(c, texts, owners):
        marks, own = [], []
        for name in names[c]:
            mine = np.array([name in o for o in owners])
            first = [0 if m else int.from_bytes(_rank_digest(seed, name, t)[:4], "big") for t, m in zip(texts, mine)]
            marks.append(np.array(first, np.uint32).tobytes())
            own.append(mine.tobytes())
        return 0.0, names[c], texts, marks, own

    def run(batches):
        open_ = {}
        for pdf in batches:
            out = []
            for c, t, o in zip(pdf[cell], pdf[seq], pdf["_owners"]):
                if c not in names:
                    continue
                texts, owners = open_.setdefault(c, ([], []))
                texts.append(t)
                owners.append(set(o))
                if len(texts) == POOL_ROWS:
                    out.append(shard(c, *open_.pop(c)))
            yield pd.DataFrame(out, columns=SHARD)
        yield pd.DataFrame([shard(c, *x) for c, x in open_.items()], columns=SHARD)

    return pool.mapInPandas(run, SHARD_TYPE)


SHARD = ["y", "names", "texts", "marks", "own"]
SHARD_TYPE = "y double, names array<string>, texts array<string>, marks array<binary>, own array<binary>"


def _own_shards(rows, dataset, seq) -> DataFrame:
    """Shards of the datasets' own positives (dataset, seq, is_test): marks are 1 for rows to fit on and 2 for rows to test."""

    def run(batches):
        open_ = {}
        for pdf in batches:
            out = []
            for name, t, test in zip(pdf[dataset], pdf[seq], pdf["is_test"]):
                texts, marks = open_.setdefault(name, ([], []))
                texts.append(t)
                marks.append(1 + test)
                if len(texts) == POOL_ROWS:
                    texts, marks = open_.pop(name)
                    out.append((1.0, [name], texts, [bytes(marks)], []))
            yield pd.DataFrame(out, columns=SHARD)
        yield pd.DataFrame([(1.0, [n], t, [bytes(m)], []) for n, (t, m) in open_.items()], columns=SHARD)

    return rows.select(dataset, seq, "is_test").mapInPandas(run, SHARD_TYPE)


def _foreign(row):
    """(name, first digest bits, whether foreign) of the datasets of a pool's shard."""
    for name, marks, own in zip(row.names, row.marks, row.own):
        yield name, np.frombuffer(marks, np.uint32), ~np.frombuffer(own, bool)


def _parts(row, cuts: dict, seed, limits: dict):
    """(name, the shard's rows to fit the dataset's model on, those to test it on).

    ``cuts``: the last digest of the negatives to fit on; ``limits``: the first 64 bits of the last one in the order of the limit."""
    if row.y:
        for name, marks in zip(row.names, row.marks):
            code = np.frombuffer(marks, np.uint8)
            yield name, code == 1, code == 2
        return
    for name, first, foreign in _foreign(row):
        if name not in cuts:
            continue
        cut = int.from_bytes(cuts[name][:4], "big")
        train = first < cut
        for i in np.flatnonzero((first == cut) & foreign):
            train[i] = _rank_digest(seed, name, row.texts[i]) <= cuts[name]
        test = foreign & ~train
        train = foreign & train
        if name in limits:
            for i in np.flatnonzero(train):
                train[i] = int.from_bytes(_rank_digest(f"{seed}|fit", name, row.texts[i])[:8], "big") <= limits[name]
        yield name, train, test


def _rows(batches):
    for pdf in batches:
        yield from pdf.itertuples()


def _rank_cuts(shards, dataset, wanted, seed) -> tuple[dict, dict]:
    """(number of negatives, digest of the ``wanted(number)``-th) by dataset: slice counts first, then the
    digests of one slice of 4096 only."""

    def count(batches):
        total = {}
        for row in _rows(batches):
            for name, first, foreign in _foreign(row):
                n = np.bincount(first[foreign] >> 20, minlength=4096)
                total[name] = total[name] + n if name in total else n
        yield pd.DataFrame([(name, i, int(c)) for name, n in total.items() for i, c in enumerate(n) if c], columns=[dataset, "slice", "n"])

    kind = f"{dataset} string, slice int, n long"
    n = shards.mapInPandas(count, kind).groupBy(dataset, "slice").agg(F.sum("n").alias("n")).toPandas()  # 4096 rows a dataset
    size, at = {}, {}
    for name, own in n.sort_values("slice").groupby(dataset):
        total = own["n"].cumsum().to_numpy()
        size[name] = int(total[-1])
        i = int(np.searchsorted(total, wanted(size[name])))
        at[name] = (int(own["slice"].iloc[i]), wanted(size[name]) - (int(total[i - 1]) if i else 0))

    def digests(batches):
        for row in _rows(batches):
            out = []
            for name, first, foreign in _foreign(row):
                if name in at:
                    out += [(name, _rank_digest(seed, name, row.texts[i]), at[name][1]) for i in np.flatnonzero(foreign & (first >> 20 == at[name][0]))]
            yield pd.DataFrame(out, columns=[dataset, "h", "rk"])

    inside = shards.mapInPandas(digests, f"{dataset} string, h binary, rk int").groupBy(dataset, "rk").agg(F.array_sort(F.collect_list("h")).alias("h"))
    return size, {r[0]: bytes(r[1]) for r in inside.select(dataset, F.get("h", F.col("rk") - 1)).collect()}


def _limit_cuts(shards, dataset, cuts, cap, seed) -> dict:
    """By dataset with more than ``cap`` negatives to fit on, the last digest of the first ``cap`` in the order of the limit."""

    def digests(batches):
        for row in _rows(batches):
            out = []
            for name, train, _ in _parts(row, cuts, seed, {}):
                out += [(name, _rank_digest(f"{seed}|fit", name, row.texts[i])[:8]) for i in np.flatnonzero(train)]
            yield pd.DataFrame(out, columns=[dataset, "h"])

    ranked = top_per_group(shards.mapInPandas(digests, f"{dataset} string, h binary"), dataset, ["h"], cap)
    return {r[0]: int.from_bytes(r[1], "big") for r in ranked.where(F.col("rk") == cap).select(dataset, "h").collect()}


def _pool_moments(shards, dataset, k, cuts, seed, limits) -> DataFrame:
    """Sums and ends of the rows to fit on, one row a dataset and task."""

    def run(batches):
        sums, ends = {}, {}
        for row in _rows(batches):
            x = word_matrix(list(row.texts), k)
            for name, train, _ in _parts(row, cuts, seed, limits):
                if train.any():
                    own = x[train]
                    s = np.concatenate([[len(own), len(own) * row.y], own.sum(0), (own * own).sum(0)])
                    e = np.concatenate([own.min(0), -own.max(0)])
                    sums[name] = sums[name] + s if name in sums else s
                    ends[name] = np.minimum(ends[name], e) if name in ends else e
        yield pd.DataFrame([(name, sums[name], ends[name]) for name in sums], columns=[dataset, "sums", "ends"])

    return cut_lineage(shards.mapInPandas(run, f"{dataset} string, sums array<double>, ends array<double>"))


def _products(a: np.ndarray) -> np.ndarray:
    """The products of every two columns, one row each, in the order of ``np.triu_indices``."""
    t = np.ascontiguousarray(a.T)
    return np.concatenate([t[i:] * t[i] for i in range(len(t))])


def _pool_slopes(shards, models, dataset, k, cuts, seed, limits) -> DataFrame:
    """Gradient and curvature of every model over the rows to fit on, one row a model and task.

    A shard's words are counted once for all datasets; products of words, too."""
    held = [(r[dataset], r["model"], np.array(r["w"]), np.array(r["scale"])) for r in models.collect()]  # some kilobytes a dataset
    d = 4**k + 1
    i, j = np.triu_indices(d)

    def run(batches):
        total = {}
        for row in _rows(batches):
            parts = {name: train for name, train, _ in _parts(row, cuts, seed, limits) if train.any()}
            mine = [m for m in held if m[0] in parts]
            if not mine:
                continue
            a = _design(word_matrix(list(row.texts), k), 1.0)
            w = np.stack([np.append(w[0], w[1:] / scale) for _, _, w, scale in mine], 1)
            keep = np.stack([parts[m[0]] for m in mine], 1)
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g, s = a.T @ ((p - row.y) * keep), p * (1 - p) * keep
            h = sum(_products(a[lo : lo + 512]) @ s[lo : lo + 512] for lo in range(0, len(a), 512))
            for n, m in enumerate(mine):
                old = total.get(m[:2])
                total[m[:2]] = (g[:, n], h[:, n]) if old is None else (old[0] + g[:, n], old[1] + h[:, n])
        out = []
        for name, model, _, scale in held:
            if (name, model) in total:
                g, h = total[name, model]
                full, by = np.zeros((d, d)), np.append(1.0, scale)
                full[i, j] = full[j, i] = h
                out.append((name, model, np.concatenate([g / by, (full / by / by[:, None]).ravel()])))
        yield pd.DataFrame(out, columns=[dataset, "model", "slopes"])

    return shards.mapInPandas(run, f"{dataset} string, model string, slopes array<double>")


def _pool_cells(shards, models, dataset, k, cuts, seed) -> DataFrame:
    """(dataset, _s, _p, _n): the scores of the rows to test, counted."""
    held = {r[dataset]: np.array(r["weights"]) for r in models.collect()}

    def run(batches):
        for row in _rows(batches):
            x, out = word_matrix(list(row.texts), k), []
            for name, _, test in _parts(row, cuts, seed, {}):
                if name in held and test.any():
                    s, n = np.unique(held[name][0] + x[test] @ held[name][1:], return_counts=True)
                    out.append(pd.DataFrame({dataset: name, "_s": s, "_p": n * int(row.y), "_n": n * int(1 - row.y)}))
            if out:
                yield pd.concat(out)

    return shards.mapInPandas(run, f"{dataset} string, _s double, _p long, _n long").groupBy(dataset, "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))


def cross_unit_auroc(base, dataset, cell, key, seq, label, k, l2, cap=None, min_class=5, seed=42) -> DataFrame:
    """AUROC of models that tell a dataset's positives from those of the cell's other datasets that are not its own.

    The negatives are those of ``cross_unit``, but no row of a dataset and a negative is written: a cell's positives
    are shards of texts, and whether one is a negative of a dataset, to fit on or to test, is told from its digest.
    """
    from pairloom.operators.negatives import owned_pool

    pos = base.where(F.col(label) == 1)
    names = {}
    for r in pos.where(F.col(dataset).isNotNull() & F.col(cell).isNotNull()).select(cell, dataset).distinct().collect():
        names.setdefault(r[0], []).append(r[1])
    pool = owned_pool(pos.where(F.col(cell).isNotNull()), dataset, cell, seq)
    foreign = cut_lineage(_pool_shards(pool, cell, seq, names, seed))
    share = lambda n: n - round(n * 0.2)
    size, cuts = _rank_cuts(foreign, dataset, share, seed)
    enough = pos.groupBy(dataset).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_class).select(dataset).collect()
    both = [r[0] for r in enough if size.get(r[0], 0) >= min_class]
    cuts = {name: cuts[name] for name in both}
    limits = _limit_cuts(foreign, dataset, cuts, cap, seed) if cap is not None else {}
    ranked = hash_rank(pos.where(F.col(dataset).isin(both)).select(dataset, key, seq), dataset, key, seed, rank="_rk", size="_n")
    own = ranked.withColumn("is_test", (F.col("_rk") > F.col("_n") - F.bround(F.col("_n") * 0.2)).cast("int"))
    shards = foreign.unionByName(cut_lineage(_own_shards(own, dataset, seq)))
    first = _pool_moments(shards, dataset, k, cuts, seed, limits)
    models = _newton_steps(first, lambda m: _pool_slopes(shards, m, dataset, k, cuts, seed, limits), dataset, "string", 4**k, (l2,), STEPS)
    return mt.ranked_cells(_pool_cells(shards, cut_lineage(models), dataset, k, cuts, seed), dataset).drop("auprc")


def rna_audit(df, dataset, cell, unit, key, seq="rna_sequence", label=LABEL, k=3, l2=1.0, cap=None, seed=42) -> DataFrame:
    """(dataset, cell, kind, n_pos, n_neg, auroc, n_cell, cell_median, all_median, all_mean): RNA-only AUROC per
    dataset on random rows, held-out units, cross-unit negatives and by GC alone, with the medians.

    Cross-unit negatives are all positives of the cell's other datasets that are not the dataset's
    own.  All are fitted on or scored; with ``cap`` the model is fitted on at most so many of a dataset, the
    first in a seeded order.
    """
    from pairloom.operators.splits import holdout_units, stratified_rows

    base = cut_lineage(df.select(dataset, cell, unit, key, seq, label))

    def evaluate(d, name):
        d = cut_lineage(d.select(dataset, key, seq, label, "is_test"))
        m = fit_groups(d.where("is_test = 0"), dataset, key, seq, label, k, (l2,))
        s = score_groups(d.where("is_test = 1"), m, dataset, seq, k)
        return cut_lineage(mt.auroc(s, dataset, "score", label).withColumn("kind", F.lit(name))), d

    test = (F.col("split") == "test").cast("int")
    rand = stratified_rows(base, dataset, key, label, f_test=0.2, f_val=0.0, seed=seed).withColumn("is_test", test)
    r, kept = evaluate(rand, "random")
    g = kept.where("is_test = 1").withColumn("score", gc_fraction(seq))
    gc = mt.auroc(g, dataset, "score", label).withColumn("kind", F.lit("gc"))
    held = holdout_units(base, unit, seed=seed).withColumnRenamed("held_out", "is_test")
    t, _ = evaluate(held, "unit")
    c = cross_unit_auroc(base, dataset, cell, key, seq, label, k, l2, cap, seed=seed).withColumn("kind", F.lit("cross_unit"))
    parts = [p.select(dataset, "kind", "n_pos", "n_neg", "auroc") for p in (r, gc, t, c)]
    out = cut_lineage(_union(parts).join(base.groupBy(dataset).agg(F.min(cell).alias(cell)), dataset))
    seen = out.where("auroc IS NOT NULL")
    every = with_quantiles(seen.groupBy("kind").agg(F.avg("auroc").alias("all_mean")), seen, "kind", "auroc", {"all_median": 0.5})
    cells = with_quantiles(seen.groupBy(cell, "kind").agg(F.count(F.lit(1)).alias("n_cell")), seen, [cell, "kind"], "auroc", {"cell_median": 0.5})
    return out.join(cells, [cell, "kind"], "left").join(every, "kind", "left")


def reverse_transfer(source, target, group, key, seq="rna_sequence", label=LABEL, k=3, l2=1.0, folds=3, cap=FIT_NEGATIVES, seed=42) -> DataFrame:
    """Fit on one assay (its own or cross-group negatives), test on another; prior and own CV as bounds.

    Cross-group negatives are the other groups' positives, at most ``cap`` a group: they are only
    fitted on.
    """
    from pairloom.operators.negatives import cross_unit

    tgt = cut_lineage(target.select(group, key, seq, label))
    parts = []
    genomic = source.select(group, key, seq, label)
    parts.append((genomic, "genomic"))
    pos = source.where(F.col(label) == 1)
    neg = cross_unit(pos.withColumn("_all", F.lit("all")), group, "_all", seq, cap=cap, seed=seed)
    cross = pos.select(group, key, seq, label).unionByName(neg.select(group, F.sha2(F.concat_ws("|", group, seq), 256).alias(key), seq, F.lit(0).alias(label)))
    parts.append((cross, "cross"))
    out = []
    for d, name in parts:
        s = score_groups(tgt, fit_groups(d, group, key, seq, label, k, (l2,)), group, seq, k)
        out.append(mt.auroc(s, group, "score", label).select(group, F.lit(name).alias("kind"), "auroc"))
    prior = mean_weights(nb_weights(source, group, seq, k, label))
    c = word_counts(tgt, [key, group, label], seq, k).join(prior, "kmer").groupBy(key, group, label).agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    out.append(mt.auroc(c, group, "score", label).select(group, F.lit("prior").alias("kind"), "auroc"))
    out.append(per_group_cv(tgt, group, key, seq, label, folds, k, l2, seed).select(group, F.lit("own_cv").alias("kind"), "auroc"))
    return _union(out)


# ---- profiles from embeddings -------------------------------------------------


def ridge_matrix(train, vec, profile, alphas, held, key) -> tuple:
    """Ridge from embedding to profile; alpha by held-out error.  The driver only sees d x d sums."""

    def sums(batches):
        # a short row for each column of [x, y]: its products with x
        for pdf in batches:
            if len(pdf):
                x = np.hstack([np.ones((len(pdf), 1)), np.vstack(pdf[vec].to_list())]).astype(float)
                y = np.vstack(pdf[profile].to_list()).astype(float)
                xy = x.T @ np.hstack([x, y])
                yield pd.DataFrame({"col": np.arange(xy.shape[1]), "v": list(xy.T)})

    part = train.select(vec, profile).mapInPandas(sums, "col long, v array<double>")
    total = part.select("col", F.posexplode("v").alias("i", "v")).groupBy("col", "i").agg(F.sum("v").alias("v")).toPandas()
    d = int(total["i"].max()) + 1
    both = total.sort_values(["i", "col"])["v"].to_numpy().reshape(d, -1)
    xx, xy = both[:, :d], both[:, d:]
    pen = np.diag([1e-9] + [1.0] * (d - 1))
    # a few columns at a time: the driver's linear algebra then stays on one thread
    solve = lambda a: np.hstack([np.linalg.solve(xx + a * pen, xy[:, j : j + 16]) for j in range(0, xy.shape[1], 16)])
    fits = {a: solve(a) for a in alphas}

    def errors(batches):
        for pdf in slices(batches):
            if len(pdf):
                x = np.hstack([np.ones((len(pdf), 1)), np.vstack(pdf[vec].to_list())]).astype(float)
                y = np.vstack(pdf[profile].to_list()).astype(float)
                yield pd.DataFrame({"alpha": list(fits), "err": [float(((x @ w - y) ** 2).sum()) for w in fits.values()]})

    e = held.select(vec, profile).mapInPandas(errors, "alpha double, err double").groupBy("alpha").agg(F.sum("err").alias("err"))
    best = e.agg(F.min_by("alpha", F.struct("err", "alpha"))).first()[0]
    return best, fits[best]


def _average_ranks(m: np.ndarray) -> np.ndarray:
    """Ranks of each row's entries, ties by their mean."""
    order = np.argsort(m, axis=1, kind="stable")
    sorted_ = np.take_along_axis(m, order, 1)
    n = m.shape[1]
    new = np.ones_like(sorted_, bool)
    new[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(new, at, 0), 1)
    end = np.ones_like(new)
    end[:, :-1] = new[:, 1:]
    # the end of a run of ties, read from the right
    last = np.minimum.accumulate(np.where(end, at, n)[:, ::-1], 1)[:, ::-1]
    out = np.empty_like(m)
    np.put_along_axis(out, order, (first + last) / 2.0, 1)
    return out


def profile_fit(pred: np.ndarray, truth: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: Spearman's rho (nan for a constant row) and the share of the ``top`` entries in common
    (ties by position)."""
    rank = [_average_ranks(m) for m in (pred, truth)]
    a, b = (r - r.mean(1, keepdims=True) for r in rank)
    with np.errstate(invalid="ignore", divide="ignore"):
        rho = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
    first = [np.argsort(-m, axis=1, kind="stable")[:, :top] for m in (pred, truth)]
    common = (first[0][:, :, None] == first[1][:, None, :]).any(2).mean(1)
    return rho, common


def word_number(c):
    """The place of an ACGU word among all words of its length in order."""
    return F.conv(F.translate(c, "ACGU", "0123"), 4, 10).cast("int")


def dense_profiles(long, key, index, value, size: int, out="profile") -> DataFrame:
    """(key, index, value) cells to one array of ``size`` a key, 0 where there is no cell."""
    lists = long.groupBy(key).agg(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v"))).alias("_c"))

    def run(batches):
        for pdf in slices(batches):
            rows = []
            for i, v in zip(pdf["_i"], pdf["_v"]):
                full = np.zeros(size)
                full[i] = v
                rows.append(full)
            yield pd.DataFrame({key: pdf[key], out: rows})

    kind = dict(long.dtypes)[key]
    return lists.select(key, F.col("_c.i").alias("_i"), F.col("_c.v").alias("_v")).mapInPandas(run, f"{key} {kind}, {out} array<double>")


def profile_predictions(emb, prof, key="protein_name", vec="embedding", profile="profile", split="split", alphas=(1.0, 10.0, 100.0, 1000.0, 10_000.0)) -> DataFrame:
    """(key, model, pred, truth) for test nodes: the mean train profile (prior), cosine neighbours (knn1
    and knn5, weighted by similarity), a ridge whose penalty the validation nodes choose, and the own
    profile (oracle).  Vectors are z-scored by the train nodes; a profile is one array."""
    from pairloom.operators.joins import standardise

    d = emb.join(prof, key)
    d = cut_lineage(standardise(d, d.where(F.col(split) == "train"), key, vec, scale=True))
    train, val, test = (d.where(F.col(split) == s) for s in ("train", "val", "test"))
    size = F.posexplode(profile).alias("i", "y")
    mean = train.select(size).groupBy("i").agg(F.avg("y").alias("y")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda x: x["y"])).scalar()
    parts = [test.select(key, F.lit("prior").alias("model"), mean.alias("pred")), test.select(key, F.lit("oracle").alias("model"), F.col(profile).alias("pred"))]
    near = cut_lineage(cosine_knn(test, train, key, vec, 5).join(train.select(F.col(key).alias("target"), F.col(profile).alias("_y")), "target"))

    def blend(pdf: pd.DataFrame) -> pd.DataFrame:
        # five rows at most
        pdf = pdf.sort_values("rk")
        w, y = np.maximum(pdf["sim"].to_numpy(), 1e-3), np.vstack(pdf["_y"].to_list())
        rows = [(pdf["query"].iloc[0], f"knn{n}", (w[:n, None] * y[:n]).sum(0) / w[:n].sum()) for n in (1, 5)]
        return pd.DataFrame(rows, columns=[key, "model", "pred"])

    schema = f"{key} string, model string, pred array<double>"
    parts.append(near.groupBy("query").applyInPandas(blend, schema))
    _, w = ridge_matrix(train, vec, profile, list(alphas), val, key)

    def predict(batches):
        for pdf in slices(batches):
            if len(pdf):
                x = np.hstack([np.ones((len(pdf), 1)), np.vstack(pdf[vec].to_list())]).astype(float)
                yield pd.DataFrame({key: pdf[key], "model": "ridge", "pred": list(x @ w)})

    parts.append(test.select(key, vec).mapInPandas(predict, schema))
    return cut_lineage(_union([p.select(key, "model", "pred") for p in parts]).join(test.select(key, F.col(profile).alias("truth")), key))


def probe_scores(pred, probes, words, key="protein_name", seq="rna_sequence", label=LABEL, probe="pair_id") -> DataFrame:
    """(model, probe, label, score): the mean predicted value of a probe's words (0 without any);
    ``words``: the profile's words in its order."""
    k = len(words[0])
    value = pred.select(key, "model", F.posexplode("pred").alias("i", "value"))
    at = F.array_position(F.lit(words), F.col("kmer")) - 1 if len(words) <= 64 else None
    if at is None:  # the words are all of ACGU in order: their place is their number in base four
        if words != alphabet_kmers("ACGU", k):
            raise ValueError("words of a long profile must be all words over ACGU in order")
        at = word_number("kmer")
    c = word_counts(probes, [probe, key, label], seq, k).where(F.col("kmer").rlike("^[ACGU]+$")).withColumn("i", at.cast("int"))
    scored = c.join(value, [key, "i"]).groupBy("model", probe).agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("score"))
    asked = probes.join(pred.select(key, "model"), key).select("model", probe, label)
    return asked.join(scored, ["model", probe], "left").na.fill(0.0, ["score"])


def profile_regression(emb, prof, probes, words, key="protein_name", vec="embedding", profile="profile", split="split", top=20, n_boot=200, label=LABEL, seq="rna_sequence", probe="pair_id", seed=42) -> DataFrame:
    """By predictor: number of test nodes, median and mean Spearman with the interval of the mean over
    resampled nodes, the share of the ``top`` words found, and the AUROC of the probes of test nodes
    scored by predicted profiles."""
    from pairloom.operators.bootstrap import bootstrap_stat

    pred = profile_predictions(emb, prof, key, vec, profile, split)

    def fit(batches):
        for pdf in slices(batches):
            if len(pdf):
                rho, common = profile_fit(np.vstack(pdf["pred"].to_list()), np.vstack(pdf["truth"].to_list()), top)
                yield pd.DataFrame({key: pdf[key], "model": pdf["model"], "rho": [None if np.isnan(x) else x for x in rho], "common": common})

    each = cut_lineage(pred.mapInPandas(fit, f"{key} string, model string, rho double, common double"))
    ci = bootstrap_stat(each, key, "rho", "mean", "model", n_boot, seed).withColumnsRenamed({"point": "mean_rho", "stat_lo": "mean_lo", "stat_hi": "mean_hi"})
    out = ci.drop("n_replicates").join(quantiles(each, "model", "rho", {"median_rho": 0.5}), "model")
    out = out.join(each.groupBy("model").agg(F.avg("common").alias(f"top{top}")), "model", "right")
    auroc = mt.auroc(probe_scores(pred, probes, words, key, seq, label, probe), "model", "score", label).select("model", F.col("auroc").alias("probe_auroc"))
    return out.join(auroc, "model", "left")


def window_scores(rows, key, seq, scorer, win=101, step=50) -> DataFrame:
    """Score long sequences by windows with any Column scorer: max, mean, centre crop, full."""
    w = rows.select(key, F.explode(rna_windows(seq, win, step)).alias("_w")).select(key, scorer(F.col("_w")).alias("_s"))
    agg = w.groupBy(key).agg(F.max("_s").alias("max_score"), F.avg("_s").alias("mean_score"), F.count(F.lit(1)).alias("n_windows"))
    single = rows.select(key, scorer(center_crop(seq, win)).alias("center_score"), scorer(F.col(seq)).alias("full_score"))
    return agg.join(single, key)
