"""Profiles from embeddings, neighbour transfer and audits against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import models as ml
from pairloom.functions import alphabet_kmers
from pairloom.functions.sequence import alphabet_kmers as words_of


def ranks(x):
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    for v in np.unique(x):
        at = np.flatnonzero(x[order] == v)
        out[order[at]] = at.mean()
    return out


def rho(a, b):
    return np.corrcoef(ranks(a), ranks(b))[0, 1]


def test_rows_of_ranks_and_top_entries():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 6, (30, 40)).astype(float), rng.normal(size=(30, 40)).round(1)
    a[3] = 1.0
    got, common = ml.profile_fit(a, b, 7)
    for k in range(30):
        assert np.isnan(got[k]) if k == 3 else abs(got[k] - rho(a[k], b[k])) < 1e-12
        first = lambda x: set(sorted(range(40), key=lambda i: (-x[i], i))[:7])
        assert abs(common[k] - len(first(a[k]) & first(b[k])) / 7) < 1e-12


def test_profile_regression_by_brute_force(spark):
    rng = np.random.default_rng(2)
    k, n = 3, 60
    words = words_of("ACGU", k)
    assert words == alphabet_kmers("ACGU", k)
    x = rng.normal(size=(n, 4))
    y = np.abs(x @ rng.normal(size=(4, 64)) + rng.normal(size=(n, 64)) * 0.3)
    split = ["train" if i % 5 < 3 else "val" if i % 5 == 3 else "test" for i in range(n)]
    name = [f"V{i}" for i in range(n)]
    seqs = ["".join(rng.choice(list("ACGU"), rng.integers(2, 30))) for _ in range(200)]
    probes = [(f"q{j}", name[int(rng.integers(n))], seqs[j], int(rng.integers(0, 2))) for j in range(200)]
    emb = spark.createDataFrame(list(zip(name, x.tolist())), "protein_name string, embedding array<double>")
    prof = spark.createDataFrame(list(zip(name, y.tolist(), split)), "protein_name string, profile array<double>, split string")
    rows = spark.createDataFrame(probes, "pair_id string, protein_name string, rna_sequence string, binding_label int")
    got = {r["model"]: r for r in ml.profile_regression(emb, prof, rows, words, top=5).collect()}
    tr, va, te = (np.array([i for i in range(n) if split[i] == s]) for s in ("train", "val", "test"))
    z = (x - x[tr].mean(0)) / x[tr].std(0, ddof=1)
    unit = z / np.linalg.norm(z, axis=1, keepdims=True)
    sim = unit[te] @ unit[tr].T
    pred = {"prior": np.tile(y[tr].mean(0), (len(te), 1)), "oracle": y[te]}
    for m in (1, 5):
        best = np.argsort(-sim, axis=1)[:, :m]
        w = np.maximum(np.take_along_axis(sim, best, 1), 1e-3)
        pred[f"knn{m}"] = (y[tr][best] * (w / w.sum(1, keepdims=True))[:, :, None]).sum(1)
    a = lambda i: np.hstack([np.ones((len(i), 1)), z[i]])
    fits = {}
    for alpha in (1.0, 10.0, 100.0, 1000.0, 10_000.0):
        fits[alpha] = np.linalg.solve(a(tr).T @ a(tr) + alpha * np.diag([1e-9, 1, 1, 1, 1]), a(tr).T @ y[tr])
    best = min(fits, key=lambda q: ((a(va) @ fits[q] - y[va]) ** 2).sum())
    pred["ridge"] = a(te) @ fits[best]
    assert set(got) == set(pred)
    of = {name[i]: k for k, i in enumerate(te)}
    for model, p in pred.items():
        each = [rho(p[k], y[i]) for k, i in enumerate(te)]
        assert abs(got[model]["median_rho"] - np.median(each)) < 1e-6 and abs(got[model]["mean_rho"] - np.mean(each)) < 1e-6
        assert got[model]["mean_lo"] <= got[model]["mean_rho"] <= got[model]["mean_hi"] and got[model]["n"] == len(te)
        scores, labels = [], []
        for _, node, s, label in probes:
            if node in of:
                at = [words.index(s[i : i + k_]) for k_ in [3] for i in range(len(s) - 2)]
                scores.append(p[of[node]][at].mean() if at else 0.0)
                labels.append(label)
        scores, labels = np.array(scores).round(12), np.array(labels)
        r = ranks(scores) + 1
        pos = labels.sum()
        assert abs(got[model]["probe_auroc"] - (r[labels == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(labels) - pos))) < 0.01
    assert abs(got["oracle"]["top5"] - 1) < 1e-12


def test_rna_audit_tests_every_cross_unit_negative(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(6):
        for j in range(80):
            rows.append((f"d{d}", f"c{d % 2}", f"t{d}_{j % 20}", f"k{d}_{j}", "".join(rng.choice(list("ACGU"), 20, p=[0.4, 0.1, 0.1, 0.4] if d < 2 and j < 40 else [0.25] * 4)), int(j < 40)))
    df = spark.createDataFrame(rows, "dataset string, cell string, unit string, key string, rna_sequence string, binding_label int")
    for cap in (10_000, 15):
        out = ml.rna_audit(df, "dataset", "cell", "unit", "key", cap=cap).collect()
        assert len(out) == 24
        for r in out:
            if r["kind"] == "cross_unit":  # two other datasets of the cell with 40 positives each, a fifth of them tested
                assert (r["n_pos"], r["n_neg"]) == (8, 16)
            of = lambda test: [x["auroc"] for x in out if x["kind"] == r["kind"] and test(x)]
            assert abs(r["cell_median"] - np.median(of(lambda x: x["cell"] == r["cell"]))) < 1e-12 and r["n_cell"] == 3
            assert abs(r["all_median"] - np.median(of(lambda x: True))) < 1e-12


def test_neighbour_scores_by_brute_force(spark):
    rng = np.random.default_rng(4)
    words = words_of("ACGU", 2)
    groups = [f"g{i}" for i in range(6)]
    w = {g: rng.normal(size=16) for g in groups}
    weights = spark.createDataFrame([(g, words[i], float(w[g][i])) for g in groups for i in range(16)], "grp string, kmer string, weight double")
    near = [("a", "g0", 0.9, 1), ("a", "g3", 0.5, 2), ("a", "g5", 0.0, 3), ("a", "g1", 0.2, 4), ("b", "g2", 0.4, 1)]
    seqs = [("r1", "a", "ACGUAC"), ("r2", "b", "GGUU"), ("r3", "nohit", "ACACAC"), ("r4", "a", "A")]
    rows = spark.createDataFrame(seqs, "key string, grp string, seq string")
    hits = spark.createDataFrame(near, "grp string, target string, fident double, rk int")
    got = {r["key"]: r for r in ml.neighbour_scores(rows, weights, hits, "key", "grp", "seq", 2).collect()}
    mean = sum(w.values()) / 6
    assert set(got) == {"r1", "r2", "r3"}
    for key, g, s in seqs[:3]:
        c = np.zeros(16)
        for i in range(len(s) - 1):
            c[words.index(s[i : i + 2])] += 1
        assert abs(got[key]["mean"] - c @ mean) < 1e-9
        for n in (1, 3, 5):
            own = [(t, f) for q, t, f, rk in near if q == g and rk <= n and f > 0]
            model = sum(w[t] * f for t, f in own) / sum(f for _, f in own) if own else mean
            assert abs(got[key][f"nn{n}"] - c @ model) < 1e-9


def test_baselines_have_the_surveyed_sizes(spark, monkeypatch):
    seen = {}

    def recorded(train, test, model, label):
        seen[type(model).__name__] = model
        return test.withColumn("score", F.rand(1))

    monkeypatch.setattr(ml, "fit_scores", recorded)
    df = spark.createDataFrame([(i % 2, ("train", "val")[i // 2 % 2], float(i)) for i in range(8)], "binding_label int, split string, features double")
    assert ml.train_baselines(df).count() == 3
    forest, boosted = seen["RandomForestClassifier"], seen["GBTClassifier"]
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (200, 15)
    assert (boosted.getMaxIter(), boosted.getMaxDepth()) == (300, 6)
    assert seen["LogisticRegression"].getMaxIter() == 1000


def test_rna_audit_fits_on_every_cross_unit_negative(spark, monkeypatch):
    """Weights, split and AUROC of the cross-unit part, by numpy over all negatives; a limit is passed on only if asked for."""
    rng = np.random.default_rng(9)
    rows = []
    for d in range(4):
        for j in range(90):
            rows.append((f"d{d}", "c", f"t{d}_{j % 9}", f"k{d}_{j}", "".join(rng.choice(list("ACGU"), 12, p=[0.4, 0.1, 0.1, 0.4] if d < 2 else [0.25] * 4)), int(j < 60)))
    rows.append(("d0", "c", "t0_0", "k0_x", rows[90][4], 1))  # a positive of two datasets
    df = spark.createDataFrame(rows, "dataset string, cell string, unit string, key string, rna_sequence string, binding_label int")
    monkeypatch.setattr(ml, "POOL_ROWS", 7)
    got = {r["dataset"]: r for r in ml.rna_audit(df, "dataset", "cell", "unit", "key", k=2).collect() if r["kind"] == "cross_unit"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    positives = {d: [(r[3], r[4]) for r in rows if r[0] == d and r[5]] for d in got}
    pool = {s for own in positives.values() for _, s in own}
    assert len(got) == 4
    for d, r in got.items():
        parts = {"train": ([], []), "test": ([], [])}
        for y, own in ((1, positives[d]), (0, [(sha(f"{d}|{s}"), s) for s in pool - {s for _, s in positives[d]}])):
            order = sorted(own, key=lambda x: sha(f"42|{x[0]}"))
            n_train = len(order) - round(len(order) * 0.2)
            for i, (_, s) in enumerate(order):
                texts, labels = parts["train" if i < n_train else "test"]
                texts.append(s)
                labels.append(y)
        assert len(parts["train"][0]) > 150
        w = ml.logistic_fit(ml.word_matrix(parts["train"][0], 2), np.array(parts["train"][1], float), 1.0)
        score, y = w[0] + ml.word_matrix(parts["test"][0], 2) @ w[1:], np.array(parts["test"][1])
        pos, neg = np.round(score[y == 1], 9), np.round(score[y == 0], 9)
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert (r["n_pos"], r["n_neg"]) == (len(pos), len(neg)) and abs(r["auroc"] - want) < 0.002


def test_audit_takes_the_steps_of_spark_ml(spark):
    """All models of the shortcut audit in one pass a step, against spark.ml fits of each; a protein lies once in a shard."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(11)
    prot = [("".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), n)), f"p{i}") for i, n in enumerate([2, *rng.integers(20, 60, 9)])]
    rows = [(f"k{i}", f"p{i % 10}", "".join(rng.choice(list("ACGU"), rng.integers(1, 20))), int(rng.random() < 0.6)) for i in range(220)]
    df = spark.createDataFrame(rows, "key string, name string, seq string, y int")
    proteins = spark.createDataFrame(prot, "protein_sequence string, name string")
    f = ml.audit_folds(df, "key", "name", "seq", "y", 2)
    splits = list(ml.audit_splits("name", "seq"))
    shards = ml._audit_shards(f, proteins, "name", "seq", "y", splits, limit=30)
    assert shards.count() > 8 and shards.select(F.max(F.size("proteins"))).first()[0] < 10
    audit = ml._Audit(shards, splits, 2, 2, 1)
    audit.prepare({"rna": (True, False), "both": (True, True)})
    fits = audit.fit(0.01, 15)
    digits = dict(zip("AGVILFPYMTSHNQWRKDEC", "00011112222333344556"))
    triads = {n: np.bincount([int(digits[c]) for c in t], minlength=7) / len(t) for t, n in prot}
    data = f.collect()
    for (s, kind, k), (w, b) in zip(audit.models, fits):
        own = [r for r in data if r[splits[s]] is not None and r[splits[s]] != k]
        x = ml.word_matrix([r["seq"] for r in own], 2)
        x = np.hstack([x, np.stack([triads[r["name"]] for r in own])]) if kind == "both" else x
        train = spark.createDataFrame([(float(r["y"]), Vectors.dense(v)) for r, v in zip(own, x)], ["label", "features"])
        m = LogisticRegression(maxIter=15, regParam=0.01).fit(train)
        assert np.allclose(w[: x.shape[1]], m.coefficients.toArray(), atol=1e-5) and abs(b - m.intercept) < 1e-5
    assert len(fits) == 12


def test_prior_of_the_other_folds(spark):
    rng = np.random.default_rng(12)
    rows = [(f"k{i}", None if i % 11 == 0 else f"p{i % 7}", f"s{rng.integers(9)}", int(rng.random() < 0.5)) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, name string, seq string, y int")
    f = ml.audit_folds(df, "key", "name", "seq", "y", 3)
    assert f.where("protein_disjoint IS NULL").count() == 11
    for split in ml.audit_splits("name", "seq"):
        got = sorted((r.fold, r.y, round(r.score, 9)) for r in ml.fold_priors(f, split, "name", "seq", "y").collect())
        kept, want = f.where(F.col(split).isNotNull()), []
        for k in range(3):
            train, test = (kept.where(F.col(split) != k), kept.where(F.col(split) == k))
            want += [(k, r.y, round(r.prior, 9)) for r in ml.label_prior(train, test.withColumn("key", F.lit(1)), "key", "name", "seq", "y").collect()]
        assert got == sorted(want) and want


def test_shares_of_folds_by_brute_force(spark):
    """One row a row, not one a split; rows without a name are in no share, as before."""
    rng = np.random.default_rng(13)
    rows = [(f"k{i}", None if i % 13 == 0 else f"n{rng.integers(12)}", f"p{rng.integers(30)}", f"s{rng.integers(60)}", i % 2) for i in range(150)]
    df = spark.createDataFrame(rows, "key string, name string, prot string, seq string, binding_label int")
    f = ml.audit_folds(df, "key", "name", "seq", folds=3)
    assert f.count() == 150
    splits, data = list(ml.audit_splits("name", "seq")), f.collect()
    got = {r["split"]: r for r in ml.fold_overlap(f, "name", "prot", "seq", splits).collect()}
    pairs = [("p1", "p2", 0.6), ("p2", "p9", 0.8), ("p3", "zz", 0.9)]
    near = {r["split"]: r for r in ml.fold_similarity(f, "prot", spark.createDataFrame(pairs, "a string, b string, jaccard double"), (0.5, 0.7), "p", splits).collect()}
    sim = {(a, b): x for u, v, x in pairs for a, b in ((u, v), (v, u))}
    for s in splits:
        own = [r for r in data if r[s] is not None and r["name"] is not None]
        for name, key in (("name", ["name"]), ("protein", ["prot"]), ("rna", ["seq"]), ("pair", ["prot", "seq"])):
            folds = {}
            for r in own:
                folds.setdefault(tuple(r[c] for c in key), set()).add(r[s])
            want = np.mean([len(folds[tuple(r[c] for c in key)]) > 1 for r in own])
            assert abs(got[s][f"{name}_in_train"] - want) < 1e-12
        all_ = [r for r in data if r[s] is not None]
        best = [max([1.0 if q["prot"] == r["prot"] else sim.get((r["prot"], q["prot"]), 0) for q in all_ if q[s] != r[s]], default=0) for r in all_]
        assert abs(near[s]["p_similar_50"] - np.mean([b >= 0.5 for b in best])) < 1e-12
        assert abs(near[s]["p_similar_70"] - np.mean([b >= 0.7 for b in best])) < 1e-12


def test_audit_refuses_null_labels(spark):
    df = spark.createDataFrame([(f"k{i}", f"n{i % 3}", "ACGU" * (1 + i % 4), None if i == 5 else i % 2) for i in range(12)], "key string, name string, seq string, y int")
    proteins = spark.createDataFrame([(f"n{i}", "ACDEFGHIK") for i in range(3)], "name string, protein_sequence string")
    with pytest.raises(Exception, match="labels must not be null"):
        ml.shortcut_audit(df, proteins, "key", "name", "seq", "y", folds=2)
