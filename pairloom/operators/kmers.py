"""k-mer enrichment, profiles, top lists, exemplars and logos.

Counting always explodes k-mers and aggregates by (group, k-mer): the map-side
combine shrinks a hot group to at most 4^k rows per task before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.functions.sequence import alphabet_kmers, chars, kmers
from pairloom.plans import ordered_prefix, quantiles, top_per_group

def explode_kmers(df: DataFrame, keys, seq: str, ks, alphabet="ACGU", distinct=False) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    arrays = [kmers(seq, k, alphabet, distinct) for k in ks]
    return df.select(*keys, F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("kmer"))


CELLS = 1 << 21  # words of a block of keys, counted at once


def _word_cells(texts, ks, alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of every word inside the alphabet; words are numbered by length, in alphabet order."""
    letter = np.full(256, -1, np.int64)
    letter[[ord(a) for a in alphabet]] = np.arange(len(alphabet))
    size = np.array([len(t) for t in texts])
    code = letter[np.frombuffer("".join(texts).encode("latin1", "replace"), np.uint8)]
    row = np.repeat(np.arange(len(texts)), size)
    out, first = [], 0
    for k in ks:
        if len(code) >= k:
            win = np.lib.stride_tricks.sliding_window_view(code, k)
            ok = (win >= 0).all(1) & (row[: len(win)] == row[k - 1 :])
            out.append((row[: len(win)][ok], first + win[ok] @ len(alphabet) ** np.arange(k - 1, -1, -1)))
        first += len(alphabet) ** k
    rows, words = zip(*out) if out else ((np.zeros(0, int),), (np.zeros(0, int),))
    return np.concatenate(rows), np.concatenate(words)


def _frequencies(ks, alphabet: str):
    """(key, texts) to (key, words, n, freq), lists of the words that occur."""
    words = pa.array([w for k in ks for w in alphabet_kmers(alphabet, k)])
    ends = np.cumsum([0, *[len(alphabet) ** k for k in ks]])

    def block(batch, lo, hi):
        texts, own = [], []
        for i, ts in enumerate(batch.column(1).slice(lo, hi - lo).to_pylist()):
            texts += ts
            own += [i] * len(ts)
        row, word = _word_cells(texts, ks, alphabet)
        n = np.bincount(np.array(own, np.int64)[row] * ends[-1] + word, minlength=(hi - lo) * ends[-1]).reshape(hi - lo, -1)
        total = np.stack([n[:, i:j].sum(1) for i, j in zip(ends, ends[1:])], 1)
        row, word = np.nonzero(n)
        of = np.searchsorted(ends, word, "right") - 1
        offs = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
        lists = [words.take(pa.array(word)), pa.array(n[row, word]), pa.array(n[row, word] / total[row, of])]
        return pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.ListArray.from_arrays(offs, x) for x in lists]], ["key", "w", "n", "f"])

    def run(batches):
        step = max(1, CELLS // int(ends[-1]))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                yield block(batch, lo, min(batch.num_rows, lo + step))

    return run


def kmer_freq(df, key, seq, ks, alphabet) -> DataFrame:
    """Long frequency table, each k normalised alone: (key, kmer, n, freq).

    A key's texts move, not their words; words are counted in blocks of keys.
    """
    kind = df.schema[key].dataType.simpleString()
    texts = df.groupBy(F.col(key).alias("key")).agg(F.collect_list(seq).alias("_t"))
    lists = texts.mapInArrow(_frequencies(list(ks), alphabet), f"key {kind}, w array<string>, n array<long>, f array<double>")
    cells = lists.select("key", F.explode(F.arrays_zip("w", "n", "f")).alias("_z"))
    return cells.select(F.col("key").alias(key), F.col("_z.w").alias("kmer"), F.col("_z.n").alias("n"), F.col("_z.f").alias("freq"))


def positive_counts(df, group, seq, k, label="binding_label") -> DataFrame:
    return (
        explode_kmers(df.where(F.col(label) == 1), group, seq, [k])
        .groupBy(group, "kmer")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_kmers(scores: DataFrame, group, score: str, k: int = 10, min_score=None) -> DataFrame:
    s = scores if min_score is None else scores.where(F.col(score) >= min_score)
    return top_per_group(s, group, [F.desc(score), F.asc("kmer")], k)


def motif_matrix(words: DataFrame, group: str, word: str, weight: str) -> DataFrame:
    """Long position matrix (group, pos, base, p) from weighted words."""
    long = words.select(group, weight, F.posexplode(chars(word)).alias("pos", "base"))
    cells = long.groupBy(group, "pos", "base").agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(group, "pos")
    return cells.select(group, "pos", "base", (F.col("_w") / F.sum("_w").over(w)).alias("p"))


def pwm_columns(matrix: DataFrame, group: str) -> DataFrame:
    """Collapse a long matrix to one array<map<base,p>> per group (motif length rows)."""
    by_pos = matrix.groupBy(group, "pos").agg(
        F.map_from_entries(F.collect_list(F.struct("base", "p"))).alias("m")
    )
    ordered = by_pos.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("pos", "m"))).alias("rows"))
    size = F.map_keys("rows")
    return ordered.select(
        group, F.transform(F.array_sort(size), lambda i: F.element_at(F.col("rows"), i)).alias("pwm")
    )


def motif_logo(matrix: DataFrame, group: str) -> DataFrame:
    """Information content: p * (2 - entropy of the position)."""
    w = Window.partitionBy(group, "pos")
    ent = F.sum(-F.col("p") * F.log2(F.greatest(F.col("p"), F.lit(1e-9)))).over(w)
    return matrix.withColumn("bits", F.col("p") * (2 - ent))


def kmer_presence(df, group, seq, k, label="binding_label") -> DataFrame:
    """Share of positives holding a k-mer over ((negatives holding it + 1) / n_neg)."""
    held = (
        explode_kmers(df, [group, label], seq, [k], distinct=True)
        .groupBy(group, "kmer")
        .agg(F.sum(label).alias("pos_with"), F.sum(1 - F.col(label)).alias("neg_with"))
        .where(F.col("pos_with") > 0)
    )
    totals = df.groupBy(group).agg(F.sum(label).alias("n_pos"), F.sum(1 - F.col(label)).alias("n_neg"))
    return held.join(totals, group).withColumn(
        "enrichment",
        (F.col("pos_with") / F.col("n_pos")) / F.try_divide(F.col("neg_with") + 1, F.greatest(F.col("n_neg"), F.lit(1))),
    )


def kmer_log2(df, group, seq, k=6, label="binding_label", pseudo=0.5) -> DataFrame:
    """log2 of the pooled frequency ratio with a pseudo-count."""
    group = [group] if isinstance(group, str) else list(group)
    counts = (
        explode_kmers(df, [*group, label], seq, [k])
        .groupBy(*group, "kmer")
        .agg(F.sum(label).alias("n_pos"), F.sum(1 - F.col(label)).alias("n_neg"))
    )
    # at most 4^k rows per group
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    tp, tn = F.sum("n_pos").over(w), F.sum("n_neg").over(w)
    return counts.withColumn(
        "log2_ratio",
        F.log2(((F.col("n_pos") + pseudo) / F.greatest(tp, F.lit(1))) / ((F.col("n_neg") + pseudo) / F.greatest(tn, F.lit(1)))),
    )


def kmer_profile(df, group, seq, k=5, label="binding_label", alphabet="ACGU", pseudo=1.0) -> DataFrame:
    """log2 enrichment over every word of the alphabet, absent words included."""
    counts = (
        explode_kmers(df, [group, label], seq, [k])
        .groupBy(group, "kmer")
        .agg(F.sum(label).alias("n_pos"), F.sum(1 - F.col(label)).alias("n_neg"))
    )
    words = F.array(*[F.lit(w) for w in alphabet_kmers(alphabet, k)])
    grid = df.select(group).distinct().select(group, F.explode(words).alias("kmer"))
    full = grid.join(counts, [group, "kmer"], "left").na.fill(0, ["n_pos", "n_neg"])
    w = Window.partitionBy(group)  # exactly |alphabet|^k rows
    p, n = F.col("n_pos") + pseudo, F.col("n_neg") + pseudo
    return full.withColumn("profile", F.log2((p / F.sum(p).over(w)) / (n / F.sum(n).over(w))))


def pooled_profile(df, seq, k=5, label="binding_label") -> DataFrame:
    return kmer_profile(df.withColumn("_all", F.lit("ALL")), "_all", seq, k, label).drop("_all")


def pool_scores(df, row_id, group, seq, k, top: int = 10, label="binding_label") -> DataFrame:
    """Row scores: top-word counts, negative-pool counts and the best enrichment."""
    pool = kmer_presence(df, group, seq, k, label)
    pos = top_kmers(positive_counts(df, group, seq, k, label), group, "n", top).select(
        group, "kmer", F.col("n").alias("pos_pool")
    )
    neg = (
        explode_kmers(df.where(F.col(label) == 0), group, seq, [k]).groupBy(group, "kmer")
        .agg(F.count(F.lit(1)).alias("neg_pool"))
    )
    words = (
        neg.join(pos, [group, "kmer"], "full").join(pool.select(group, "kmer", "enrichment"), [group, "kmer"], "full")
    )
    held = explode_kmers(df, [row_id, group], seq, [k], distinct=True)
    return (
        held.join(words, [group, "kmer"], "left")
        .groupBy(row_id, group)
        .agg(
            F.coalesce(F.sum("pos_pool"), F.lit(0)).alias("pos_score"),
            F.coalesce(F.sum("neg_pool"), F.lit(0)).alias("neg_score"),
            F.coalesce(F.max("enrichment"), F.lit(0.0)).alias("best_enrichment"),
        )
    )


def with_ranked_list(df, top: DataFrame, group: str) -> DataFrame:
    """Attach the group's ranked word list (at most k words) as an array."""
    lists = top.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "kmer"))), lambda x: x["kmer"]).alias("ranked")
    )
    return df.join(lists, group, "left").withColumn(
        "ranked", F.coalesce("ranked", F.array().cast("array<string>"))
    )
