"""Cosine neighbours through pivots, by brute force and by the number of visits."""

import numpy as np
import pytest

from pairloom.operators import joins as jn
from pairloom.plans import cut_lineage


def table(spark, rng, n, spread):
    centres = rng.normal(size=(25, 12))
    x = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, 12)) * spread
    x[: n // 3] = x[0]  # a third of the vectors are one
    x[n // 3] = 0
    return x, spark.createDataFrame([(f"v{k:04d}", row) for k, row in enumerate(x.tolist())], "name string, vec array<double>").repartition(4)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_neighbours_by_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(jn, "BLOCK", 48)
    x, df = table(spark, np.random.default_rng(4), 700, spread)
    u = jn._unit(list(x))
    sim = np.round(u @ u.T, 9)
    np.fill_diagonal(sim, -np.inf)
    got = {}
    for r in jn.cosine_knn(df, df, "name", "vec", 4).collect():
        got.setdefault(r["query"], []).append(r)
    assert len(got) == 700
    for k in range(700):
        best = sorted(-sim[k])[:4]
        mine = sorted(got[f"v{k:04d}"], key=lambda r: r["rk"])
        assert np.allclose([-r["sim"] for r in mine], best, atol=1e-8)
        assert all(abs(sim[k, int(r["target"][1:])] - r["sim"]) < 1e-8 for r in mine)


def test_visits_grow_below_all_pairs(spark, monkeypatch):
    """On clustered vectors most clusters are passed over."""
    monkeypatch.setattr(jn, "BLOCK", 40)
    x, df = table(spark, np.random.default_rng(5), 1000, 0.05)
    clusters = jn._Clusters(df, "name", "vec")
    asked = clusters.deal(df)
    near = jn.top_per_group(clusters.best(asked, 3, True), "query", [jn.F.desc("sim"), "target"], 3)
    bound = near.groupBy(jn.F.col("query").alias("name")).agg(jn.F.when(jn.F.count(jn.F.lit(1)) >= 3, jn.F.min("sim")).alias("_b"))
    visits = clusters.others(asked.join(bound, "name").where("_b IS NOT NULL")).count()
    assert len(clusters.pivots) == 25 and visits < 0.2 * 1000 * len(clusters.pivots)


def test_empty_and_single(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "name string, vec array<double>")
    assert jn.cosine_knn(df, df, "name", "vec", 3).count() == 0
    assert jn.cosine_knn(df, df.limit(0), "name", "vec", 3).count() == 0
    assert jn.cosine_knn(df.limit(0), df, "name", "vec", 3).count() == 0


@pytest.mark.parametrize(("posting", "one_pass", "sim"), [(2000, 10**9, 0.5), (3, 200, 0.5), (3, 200, 0.8)])
def test_similar_pairs_by_brute_force(spark, monkeypatch, posting, one_pass, sim):
    check_pairs(spark, monkeypatch, posting, one_pass, sim)


def test_long_texts_share_several_words_of_a_bucket(spark, monkeypatch):
    """Texts that have a phrase in common are not passed on, similar ones are."""
    rng = np.random.default_rng(8)
    letter = lambda n: "".join(rng.choice(list("ACDEFGHIKL"), n))
    phrase, base = letter(40), letter(600)
    seqs = [letter(300) + phrase + letter(300) for _ in range(40)] + [base, base[:500] + letter(100), letter(60) + base]
    written = []
    monkeypatch.setattr(jn, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    found = jn.pair_similarity(spark.createDataFrame([(s,) for s in seqs], "s string"), "s", 6, 0.5).collect()
    assert {frozenset((r.seq_a, r.seq_b)) for r in found} == {frozenset((seqs[i], seqs[j])) for i, j in ((40, 41), (40, 42), (41, 42))}
    assert len({(r.a, r.b) for df in written if "at" in df.columns for r in df.collect()}) < 10


def check_pairs(spark, monkeypatch, posting, one_pass, sim):
    """Long and short texts, repeats inside a text, words of many texts, several passes and blocks."""
    rng = np.random.default_rng(6)
    letter = lambda n, a="ACGU": "".join(rng.choice(list(a), n))
    base = [letter(60) for _ in range(30)] + [letter(n, "ACDEFGHIKL") for n in (5, 12, 14, 300, 900)] + ["ACAC" * 15, "é\U0001f600" * 20 + letter(9)]
    common = letter(40)
    seqs = [*base, *[b[: len(b) * 2 // 3] + letter(len(b) // 8) for b in base], *[b[3:] for b in base], *[common + letter(n) for n in range(5, 30)], "", "A", None]
    monkeypatch.setattr(jn, "POSTING", posting)
    monkeypatch.setattr(jn, "PASS", one_pass)
    monkeypatch.setattr(jn, "TEXT_CELLS", 4000)
    df = spark.createDataFrame([(s,) for s in seqs * 2], "s string").repartition(3)
    got = {(*sorted((r.seq_a, r.seq_b)), round(r.jaccard, 9), round(r.containment, 9)) for r in jn.pair_similarity(df, "s", 6, sim).collect()}
    words = {s: {s[i : i + 6] for i in range(len(s) - 5)} for s in seqs if s and len(s) > 5}
    want = set()
    for a in words:
        for b in words:
            both = len(words[a] & words[b])
            if a < b and both / len(words[a] | words[b]) >= sim:
                want.add((a, b, round(both / len(words[a] | words[b]), 9), round(both / min(len(words[a]), len(words[b])), 9)))
    assert got == want and len(want) > 30


def test_no_pair_of_random_texts_is_written(spark, monkeypatch):
    """Texts that share a word by chance meet in their bucket and are not passed on."""
    rng = np.random.default_rng(7)
    seqs = ["".join(rng.choice(list("ACGU"), 60)) for _ in range(400)]
    written = []
    monkeypatch.setattr(jn, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    assert jn.pair_similarity(spark.createDataFrame([(s,) for s in seqs], "s string"), "s", 5, 0.5).count() == 0
    met = [df.count() for df in written if "at" in df.columns]
    assert len(met) == 1 and met[0] < 500  # of 79,800 pairs


def test_visits_are_not_written_as_vectors(spark, monkeypatch):
    """On vectors without clusters every query needs every cluster: vectors are packed once, results are those of all pairs."""
    monkeypatch.setattr(jn, "BLOCK", 30)
    x = np.random.default_rng(9).normal(size=(400, 6))
    names = [f"v{k // 2:04d}" if k < 20 else f"v{k:04d}" for k in range(400)]  # some names come twice
    df = spark.createDataFrame(list(zip(names, x.tolist())), "name string, vec array<double>").repartition(5)
    written = []
    monkeypatch.setattr(jn, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    got = jn.cosine_knn(df, df, "name", "vec", 4).collect()
    assert all(w.count() <= 2 * 400 * 30 // 4 for w in written if "vec" in w.columns)
    assert sum(w.select(jn.F.sum(jn.F.length("m"))).first()[0] for w in written if "m" in w.columns) == 2 * 400 * 6 * 8
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    for k in range(20, 400):
        best = sorted((s for j, s in enumerate(sim[k]) if names[j] != names[k]), reverse=True)[:4]
        assert np.allclose(sorted((r["sim"] for r in got if r["query"] == names[k]), reverse=True), best, atol=1e-8)
