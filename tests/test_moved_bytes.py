"""What moves and what is written: similarity postings, shuffle control, cross-unit negatives, sharded fits."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import joins as jn, metrics as mt, models as ml, negatives as ng
from pairloom.plans import cut_lineage


def test_postings_carry_no_lists_and_pairs_come_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGU"), 30)) for _ in range(25)]
    seqs += [s[:k] + "A" + s[k + 1 :] for s in seqs for k in (3, 27)] + [s[2:] for s in seqs]
    written = []
    monkeypatch.setattr(jn, "cut_lineage", lambda df: written.append(df) or cut_lineage(df))
    got = [(r.seq_a, r.seq_b, round(r.jaccard, 9)) for r in jn.pair_similarity(spark.createDataFrame([(s,) for s in seqs], "s string"), "s", k=4, min_sim=0.5).collect()]
    postings = [df for df in written if "at" in df.columns]
    assert postings and not any(t.startswith("array") for df in postings for _, t in df.dtypes)
    words = {s: {s[i : i + 4] for i in range(len(s) - 3)} for s in seqs}
    sim = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b])
    want = {(*sorted((a, b)), round(sim(a, b), 9)) for a in words for b in words if a < b and sim(a, b) >= 0.5}
    assert len(got) == len(want) > 25
    assert {(*sorted(x[:2]), x[2]) for x in got} == want


def test_shuffle_control_reads_rows_once(spark, monkeypatch):
    rows = [(f"g{i % 3}", i % 2, float(i % 11), float(i * 7 % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "protein_name string, binding_label int, a double, b double")
    calls, cells = [], mt.cells
    monkeypatch.setattr(mt, "cells", lambda *a, **k: calls.append(1) or cells(*a, **k))
    r = mt.shuffle_control(df, "a", "b").first()
    assert len(calls) == 1
    for c, name in (("a", "real"), ("b", "shuffled")):
        assert r[f"auroc_{name}"] == pytest.approx(mt.auroc(df, [], c).first().auroc)
        by = sorted(x.auroc for x in mt.auroc(df, "protein_name", c).collect())
        assert r[f"median_{name}"] == pytest.approx(by[1])


def test_all_foreign_positives_are_not_ranked(spark, monkeypatch):
    rows = [("u1", "w", "A"), ("u1", "w", "B"), ("u2", "w", "B"), ("u2", "w", None), ("u3", "v", "A"), (None, "w", "C"), ("u1", None, "D")]
    df = spark.createDataFrame(rows * 2, "unit string, within string, rna_sequence string")
    monkeypatch.setattr(ng, "ordered_prefix", None)
    got = [(r.unit, r.within, r.rna_sequence) for r in ng.cross_unit(df, "unit", "within").collect()]
    # a null unit or sequence owns nothing
    pool = {"A", "B", "C", None}
    want = {(u, "w", s) for u, own in (("u1", "AB"), ("u2", "B"), (None, "")) for s in pool if s is None or s not in own}
    assert len(got) == len(want) and set(got) == want


def test_steps_of_large_groups_move_sums_only(spark):
    rng = np.random.default_rng(4)
    rows = [("g", i, "".join(rng.choice(list("ACGU"), 20)), int(i % 2)) for i in range(90)]
    df = ml.sharded(spark.createDataFrame(rows, "g string, key long, rna_sequence string, binding_label int"), "g", "key", 40)
    shards = ml._packed_shards(df, "g", "rna_sequence", "binding_label")
    assert shards.count() == 3 and shards.select(F.sum(F.size("texts"))).first()[0] == 90
    models = spark.createDataFrame([("g", m, [0.1] * 17, [1.0] * 16) for m in ("x", "y")], "g string, model string, w array<double>, scale array<double>")
    parts = ml._shard_slopes(shards, models, "g", "string", 2)
    assert "hashpartitioning" not in parts._jdf.queryExecution().executedPlan().toString()
    x, y = ml.word_matrix([r[2] for r in rows], 2), np.array([r[3] for r in rows], float)
    g, h = ml._slopes(ml._design(x, np.ones(16)), y, np.full(17, 0.1))
    for m in ("x", "y"):
        total = sum(np.array(r.slopes) for r in parts.where(F.col("model") == m).collect())
        assert np.allclose(total, np.concatenate([g, h.ravel()]))


def test_word_matrix_of_blocks(monkeypatch):
    seqs = ["ACGU", "", "AC", "NNACGNUACG", "ACGTACGU", "é" * 5 + "ACG", "UUUU"] * 3
    monkeypatch.setattr(ml, "WORD_ROWS", 4)
    words = [a + b + c for a in "ACGU" for b in "ACGU" for c in "ACGU"]
    for s, row in zip(seqs, ml.word_matrix(seqs, 3)):
        n = [sum(s[i : i + 3] == w for i in range(len(s) - 2)) for w in words]
        assert row.tolist() == [c / max(1, sum(n)) for c in n]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_written_rows_leave_no_shuffle_files(spark):
    from pairloom.plans.lineage import CLEANUP

    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    grouped = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    rows = cut_lineage(grouped)
    end = time.time() + 20  # Spark deletes beside the next work
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    # both the written rows and the plan they came from can be used again
    assert rows.count() == grouped.count() == 1000 and rows.agg(F.sum("n")).first()[0] == 10_000
    assert spark.conf.get(CLEANUP) == setting
