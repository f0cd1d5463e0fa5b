"""Operators without an SQL form: quotas, disjointness, preserved counts, brute force."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import catalog, functions as fn, views
from pairloom.operators import bootstrap as bt, filters as fl, intervals as iv, joins as jn, metrics as mt, models as ml, negatives as ng, sampling as sm, splits as sp
from pairloom.plans import hash_rank, ordered_prefix, quantiles

Q = catalog.queries()


def rows(df):
    return [r.asDict() for r in df.collect()]


def gc(s):
    return sum(c in "GC" for c in s) / len(s)


def dinucs(s):
    return Counter(s[i : i + 2] for i in range(len(s) - 1))


@pytest.fixture(scope="module")
def pairs(spark, sf):
    p = views.pairs_seq(spark, sf).select("pair_id", "protein_name", "protein_sequence", "rna_sequence", "binding_label", "dataset_source").cache()
    p.count()
    return p


def test_ordered_prefix_with_a_hot_group(spark):
    data = [("hot", i * 7 % 1000, 1 + i % 3) for i in range(1000)] + [(None, i, 1) for i in range(20)] + [("b", 5, 2)]
    out = rows(ordered_prefix(spark.createDataFrame(data, "g string, v int, w int"), "g", "v", {"before": "w"}, {"top": "v"}, totals=True))
    by = defaultdict(list)
    for g, v, w in data:
        by[g].append((v, w))
    for r in out:
        less = [(v, w) for v, w in by[r["g"]] if v < r["v"]]
        assert r["before"] == sum(w for _, w in less)
        assert r["top"] == (max(v for v, _ in less) if less else None)
        assert r["before_total"] == sum(w for _, w in by[r["g"]])


def test_hash_rank_is_a_permutation_and_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("a")).alias("g"), F.col("id").cast("string").alias("k"))
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append({(r["g"], r["k"]): r["rk"] for r in rows(hash_rank(df.repartition(5), "g", "k", 42))})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]
    assert sorted(v for (g, _), v in seen[0].items() if g is None) == list(range(1, 1001))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=501).round(2)
    df = spark.createDataFrame([("g", float(x)) for x in v], "g string, v double")
    r = rows(quantiles(df, "g", "v", {"a": 0.1, "b": 0.5, "c": 0.975}))[0]
    assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(v, [0.1, 0.5, 0.975]))


def test_clusters_equal_union_find(spark):
    rnd = random.Random(3)
    nodes = [f"n{i}" for i in range(300)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(180)] + [(f"c{i}", f"c{i+1}") for i in range(60)]
    nodes += [f"c{i}" for i in range(61)]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["cluster"] for r in rows(sp.connected_clusters(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "query string, target string")))}
    assert got == {n: find(n) for n in nodes}


def test_cluster_query_has_one_label_per_node(spark, sf):
    got = rows(Q["spl_cluster"](spark, sf))
    assert len({r["node"] for r in got}) == len(got)
    assert all(r["cluster"] <= r["node"] for r in got)


def test_family_allocation_equals_the_greedy_loop(spark):
    rnd = random.Random(5)
    data = [(f"c{i}", f"f{i % 3}", rnd.randint(1, 30)) for i in range(200)] + [("big", "f0", 2000)]
    got = {r["cluster_id"]: r["split"] for r in rows(sp.allocate_clusters(spark.createDataFrame(data, "cluster_id string, family string, n_rows int")))}
    import hashlib

    for fam in ("f0", "f1", "f2"):
        members = sorted([d for d in data if d[1] == fam], key=lambda d: hashlib.sha256(f"42|{d[0]}".encode()).hexdigest())
        total, test, val = sum(d[2] for d in members), 0, 0
        for cid, _, n in members:
            if n > 0.5 * 0.12 * total:
                want = "train"
            elif test < 0.12 * total:
                want, test = "test", test + n
            elif val < 0.11 * total:
                want, val = "val", val + n
            else:
                want = "train"
            assert got[cid] == want


def test_gc_match_is_one_to_one_within_the_caliper(spark, pairs):
    m = rows(sm.gc_match(pairs, "dataset_source", "pair_id", caliper=0.02))
    by = defaultdict(lambda: ([], []))
    for r in m:
        by[r["dataset_source"]][r["binding_label"]].append(gc(r["rna_sequence"]))
    assert len({r["pair_id"] for r in m}) == len(m) > 0
    for neg, pos in by.values():
        assert len(neg) == len(pos)
        assert all(abs(a - b) <= 0.02 + 1e-9 for a, b in zip(sorted(neg), sorted(pos)))


def test_gc_match_keeps_every_exact_partner(spark):
    data = [(f"p{i}", "g", 1, "G" * (i % 5) + "A" * (20 - i % 5)) for i in range(20)] + [(f"n{i}", "g", 0, "C" * (i % 5) + "U" * (20 - i % 5)) for i in range(20)]
    df = spark.createDataFrame(data, "pair_id string, g string, binding_label int, rna_sequence string")
    assert sm.gc_match(df, "g", "pair_id").count() == 40


def test_spectrum_equals_the_greedy_loop(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=700).round(1)
    df = spark.createDataFrame([("g", f"k{i:04d}", float(x)) for i, x in enumerate(v)], "g string, k string, v double")
    got = [r["v"] for r in sorted(rows(sm.spectrum_sample(df, "g", "v", "k", 25)), key=lambda r: r["spectrum_rank"])]
    s, used, want = np.sort(v), np.zeros(700, bool), []
    for pct in np.linspace(0.5 / 25, 100 - 0.5 / 25, 25):
        j = int(np.argmin(np.where(used, np.inf, np.abs(s - np.percentile(v, pct)))))
        used[j] = True
        want.append(s[j])
    assert np.allclose(got, want)


def test_uniform_shuffle(spark, pairs):
    pos = {r["pair_id"]: r for r in rows(pairs.where("binding_label = 1"))}
    known = {(r["protein_name"], r["rna_sequence"]) for r in rows(pairs)}
    out = rows(ng.shuffle_uniform(pairs, pairs))
    assert 0.9 * len(pos) < len(out) <= len(pos)
    for r in out:
        a, b = pos[r["parent_pair_id"]]["rna_sequence"], r["rna_sequence"]
        assert Counter(a) == Counter(b) and (r["protein_name"], b) not in known
        assert sum(x != y for x, y in zip(a, b)) >= max(3, -(-len(a) * 5 // 100))


def test_dinucleotide_shuffle(spark, pairs):
    pos = {r["pair_id"]: r for r in rows(pairs.where("binding_label = 1"))}
    out = rows(ng.shuffle_dinuc(pairs, pairs))
    assert len(out) > 0.9 * len(pos)
    for r in out:
        a, b = pos[r["parent_pair_id"]]["rna_sequence"], r["rna_sequence"]
        assert dinucs(a) == dinucs(b) and a != b and (a[0], a[-1]) == (b[0], b[-1])


def test_short_and_uniform_letters_fail_to_shuffle(spark):
    df = spark.createDataFrame([("a", "P", "MK", "AAAAAAAA", 1), ("b", "P", "MK", "AC", 1)], "pair_id string, protein_name string, protein_sequence string, rna_sequence string, binding_label int")
    assert ng.shuffle_uniform(df, df).count() == 0
    assert ng.shuffle_dinuc(df, df).count() == 0


def test_expanded_benchmark_has_unique_pairs(spark, sf):
    lit = views.literature(spark, sf)
    out = rows(ng.expand_benchmark(lit, lit))
    assert len({(r["protein_sequence"], r["rna_sequence"]) for r in out}) == len(out)
    kinds = Counter(r["example_class"] for r in out)
    assert kinds["curated_positive"] == lit.where("binding_label = 1").count()
    assert set(r["neg_strategy"] for r in out) == {"", *ng.STRATEGY_ORDER}
    assert all(r["protein_name_in_train"] == 1 for r in out)


def test_far_partner_grows_until_an_allowed_one_is_found(spark):
    letters = "ACGU"
    rna = ["".join(random.Random(i).choice(letters) for _ in range(30)) for i in range(40)]
    data = [(f"q{i:02d}", f"P{i}", "".join(random.Random(100 + i).choice("ACDEFGHIK") for _ in range(40)), rna[i], 1) for i in range(40)]
    df = spark.createDataFrame(data, "pair_id string, protein_name string, protein_sequence string, rna_sequence string, binding_label int")
    # the first protein is known with every RNA but the last two
    known = df.union(spark.createDataFrame([("x", "P0", data[0][2], r, 1) for r in rna[:38]], df.schema))
    got = {r["parent_pair_id"]: r for r in rows(ng.cross_rna(df, known, min_dist=0.0))}

    def kset(s):
        return {s[i : i + 3] for i in range(len(s) - 2)}

    a = data[0]
    d = {b[0]: 1 - len(kset(a[3]) & kset(b[3])) / len(kset(a[3]) | kset(b[3])) for b in data[1:]}
    best = max(d.values())
    tier = [i for i in sorted(d) if d[i] >= best - 1e-9]
    allowed = [i for i in tier if (data[0][2], data[int(i[1:])][3]) not in {(data[0][2], r) for r in rna[:38]}]
    assert (got["q00"]["partner_pair_id"] if "q00" in got else None) == (allowed[0] if allowed else None)


def test_other_target_never_lies_on_a_peak_of_its_factor(spark, sf):
    from pairloom.catalog.negatives import peak_windows

    peaks, _ = peak_windows(spark, sf)
    own = defaultdict(list)
    seq = {}
    for r in rows(peaks):
        own[r["factor"], r["cell"], r["chrom"]].append((r["start_pos"], r["end_pos"]))
        seq[r["peak_id"]] = r
    out = rows(Q["neg_other_target"](spark, sf))
    assert {r["kind"] for r in out} <= {"xtf", "gc"} and out
    for r in out:
        p = seq[r["peak_id"]]
        if r["kind"] == "xtf":
            assert r["factor"] != p["factor"] and r["cell"] == p["cell"]
            assert not any(s < r["end_pos"] and e > r["start_pos"] for s, e in own[r["factor"], r["cell"], p["chrom"]])
        else:
            assert r["factor"] == p["factor"]


def test_interval_max_by_brute_force(spark):
    rnd = random.Random(9)
    mk = lambda n, big: [("c1" if rnd.random() < 0.8 else "c2", s, s + rnd.randint(1, big), rnd.random()) for s in (rnd.randint(0, 500) for _ in range(n))]
    a, b = mk(150, 40), mk(150, 300)
    schema = "chrom string, start_pos long, end_pos long, score double"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = Counter((r["chrom"], r["start_pos"], r["end_pos"], r["max_value"]) for r in rows(iv.interval_max(da, db)))
    want = Counter()
    for c, s, e, _ in a:
        hit = [v for cc, ss, ee, v in b if cc == c and ss < e and ee > s]
        want[c, s, e, max(hit) if hit else None] += 1
    assert got == want
    n = sum(any(cc == c and ss < e and ee > s for cc, ss, ee, _ in b) for c, s, e, _ in a)
    assert iv.interval_any(da, db).count() == n and iv.interval_any(da, db, keep=False).count() == len(a) - n


def test_adjacent_intervals_touch_but_do_not_overlap(spark):
    schema = "chrom string, start_pos long, end_pos long, score double"
    a, b = spark.createDataFrame([("c", 0, 10, 1.0)], schema), spark.createDataFrame([("c", 10, 20, 2.0)], schema)
    assert rows(iv.interval_max(a, b))[0]["max_value"] is None
    assert iv.interval_any(a, b).count() == 0
    assert iv.merge_intervals(a.union(b)).count() == 1


def test_pair_similarity_by_brute_force(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("ACGU") for _ in range(40)) for _ in range(25)]
    texts = base + [b[:30] + "".join(rnd.choice("ACGU") for _ in range(10)) for b in base] + base[:5]
    got = {frozenset((r["seq_a"], r["seq_b"])): r["jaccard"] for r in rows(jn.pair_similarity(spark.createDataFrame([(t,) for t in texts], "s string"), "s", 5, 0.3))}
    k = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    want = {}
    for x, y in itertools.combinations(sorted(set(texts)), 2):
        j = len(k(x) & k(y)) / len(k(x) | k(y))
        if j >= 0.3:
            want[frozenset((x, y))] = j
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_cosine_neighbours_by_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(f"v{i:02d}", [float(x) for x in r]) for i, r in enumerate(m)], "k string, v array<double>")
    got = defaultdict(list)
    for r in rows(jn.cosine_knn(df, df, "k", "v", 3)):
        got[r["query"]].append((r["rk"], r["target"]))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -9)
    for i in range(60):
        assert [t for _, t in sorted(got[f"v{i:02d}"])] == [f"v{j:02d}" for j in np.argsort(-sim[i])[:3]]


def test_auroc_edge_cases(spark):
    df = spark.createDataFrame([("one", 1, 0.5)] * 3 + [("tie", 1, 0.5), ("tie", 0, 0.5)] + [("sep", 1, 0.9), ("sep", 0, 0.1)], "g string, binding_label int, score double")
    got = {r["g"]: r for r in rows(mt.ranking(df, "g", "score"))}
    assert got["one"]["auroc"] is None and got["one"]["auprc"] is None
    assert got["tie"]["auroc"] == 0.5 and got["sep"]["auroc"] == 1.0 and got["sep"]["auprc"] == 1.0


def test_bootstrap_equals_repeated_rows(spark):
    rnd = random.Random(8)
    data = [(f"u{i % 7}", int(rnd.random() < 0.4), round(rnd.random(), 1)) for i in range(400)]
    df = spark.createDataFrame(data, "protein_name string, binding_label int, score double")
    c = mt.cells(df, "protein_name", "score")
    m = bt.multiplicities(c, "protein_name", 6)
    mult = {(r["replicate"], r["protein_name"]): r["m"] for r in rows(m)}
    got = {r["replicate"]: r["auroc"] for r in rows(bt.replicated_auroc(c, m, "protein_name", 6))}
    for b in range(6):
        ys = [(y, s) for u, y, s in data for _ in range(mult.get((b, u), 0))]
        pos, neg = [s for y, s in ys if y], [s for y, s in ys if not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got[b] - want) < 1e-12
        assert sum(v for (r, _), v in mult.items() if r == b) == 7


def test_sharded_fits(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(600):
        y = int(rng.random() < 0.5)
        data.append((f"k{i}", "hot" if i % 3 else "b", "".join(rng.choice(list("ACGU"), 30, p=[0.4, 0.2, 0.2, 0.2] if y else [0.1, 0.3, 0.3, 0.3])), y))
    df = spark.createDataFrame(data, "key string, g string, rna_sequence string, binding_label int")
    whole = {r["g"]: r["weights"] for r in rows(ml.ridge_groups(df, "g", "key", "rna_sequence", "binding_label", 2))}
    cut = {r["g"]: r["weights"] for r in rows(ml.ridge_groups(df, "g", "key", "rna_sequence", "binding_label", 2, limit=50))}
    assert all(np.allclose(whole[g], cut[g]) for g in whole)
    for limit in (50_000, 100):
        m = ml.fit_groups(df, "g", "key", k=1, limit=limit).drop("model")
        a = {r["g"]: r["auroc"] for r in rows(mt.auroc(ml.score_groups(df, m, "g", k=1), "g", "score"))}
        assert min(a.values()) > 0.9
    one_label = df.unionByName(df.selectExpr("'x' || key AS key", "'one' AS g", "rna_sequence", "1 AS binding_label"))
    fits = [
        {(r["g"], r["model"]): r["weights"] for r in rows(ml.fit_groups(one_label, "g", "key", k=2, l2s=(0.5, 2.0), limit=limit))}
        for limit in (10**9, 100)
    ]
    assert set(fits[0]) == set(fits[1]) == {(g, m) for g in ("hot", "b") for m in ("l2=0.5", "l2=2")}
    assert all(np.allclose(fits[0][m], fits[1][m], rtol=0, atol=1e-6) for m in fits[0])


def test_cross_unit_has_no_limit_of_its_own(spark):
    data = [(f"u{i % 3}", "w", f"s{i}") for i in range(9000)] + [("u0", "w", "s1"), ("u1", "v", "s1")]
    pos = spark.createDataFrame(data, "unit string, within string, rna_sequence string")
    own = {}
    for u, w, x in data:
        own.setdefault((u, w), set()).add(x)
    foreign = {k: set().union(*(v for j, v in own.items() if j[1] == k[1])) - v for k, v in own.items()}
    for kw, size in (({}, lambda k: len(foreign[k])), ({"cap": 7}, lambda k: min(7, len(foreign[k]))), ({"per_own": 0.5}, lambda k: min(-(-len(own[k]) // 2), len(foreign[k])))):
        got = {}
        for r in rows(ng.cross_unit(pos, "unit", "within", **kw)):
            got.setdefault((r["unit"], r["within"]), []).append(r["rna_sequence"])
        for k in own:
            assert len(got.get(k, [])) == len(set(got.get(k, []))) == size(k) and set(got.get(k, [])) <= foreign[k]


def test_nearest_first_leaves_no_partner_inside_the_caliper():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pos, neg = ({int(a) / int(b): int(c) for a, b, c in zip(rng.integers(0, 30, 12), rng.integers(30, 60, 12), rng.integers(1, 4, 12))} for _ in range(2))
        taken = sm.nearest_first(pos, neg, 0.02)
        left = [[v for v, n in side.items() if n > taken.get((lab, v), 0)] for lab, side in ((1, pos), (0, neg))]
        assert all(taken[lab, v] <= (neg, pos)[lab][v] for lab, v in taken)
        assert sum(k for (lab, _), k in taken.items() if lab) == sum(k for (lab, _), k in taken.items() if not lab)
        assert not any(abs(a - b) <= 0.02 for a in left[0] for b in left[1])


def test_jvm_score_equals_numpy(spark):
    seqs = ["ACGUACGU", "GGGG", "AC"]
    w = [float(x) for x in np.random.default_rng(0).normal(size=17)]
    df = spark.createDataFrame([(s, w) for s in seqs], "s string, w array<double>")
    got = [r["x"] for r in rows(df.select(ml.dot_score("s", F.col("w"), 2).alias("x")))]
    assert np.allclose(got, w[0] + ml.word_matrix(seqs, 2) @ np.array(w[1:]))


def test_model_queries_give_sane_numbers(spark, sf):
    for name in ("ml_per_group_cv", "ml_within_transfer", "ml_marginals", "ml_rna_audit", "ml_reverse"):
        vals = [r["auroc"] for r in rows(Q[name](spark, sf)) if r["auroc"] is not None]
        assert vals and all(0 <= v <= 1 for v in vals), name
    f = rows(Q["ml_features"](spark, sf))
    assert len({r["dims"] for r in f}) == 1 and f[0]["dims"] >= 8256
    assert {r["model"] for r in rows(Q["ml_profile_knn"](spark, sf))} == {"prior", "knn1", "knn5", "ridge", "oracle"}
    assert {r["model"] for r in rows(Q["ml_baselines"](spark, sf))} == {"logistic", "forest", "boosted"}


def test_subsets_and_composition(spark, sf):
    s = Counter(r["subset"] for r in rows(Q["flt_eval_subsets"](spark, sf)))
    assert s["full"] >= max(s["gc_matched"], s["rna_unseen"], s["protein_unseen"])
    c = rows(Q["met_composition"](spark, sf))
    assert {(r["subset"], r["feature"]) for r in c} == {(a, b) for a in ("all", "gc_matched") for b in ("gc", "au")}


def test_quality_gate_raises_on_placeholder(spark):
    df = spark.createDataFrame([("A" * 20, "ok")], "rna_sequence string, protein_sequence string")
    with pytest.raises(ValueError):
        fl.quality_gate(df)


def test_attach_scores_refuses_duplicate_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, score double")
    with pytest.raises(ValueError):
        jn.attach_scores(df.select("k").distinct(), df, "k")


def test_string_edge_cases(spark):
    df = spark.createDataFrame([("", "ACGU"), ("AC", "AC"), ("ACGUAC", "ACGUAC")], "a string, b string")
    r = rows(df.select(fn.kmers("a", 3).alias("k"), fn.hamming("a", "b").alias("h"), fn.gc_fraction("a").alias("g"), fn.kmer_jaccard("a", "b").alias("j"), fn.rna_windows("a", 4, 4).alias("w")))
    assert r[0]["k"] == [] and r[0]["h"] == 4 and r[0]["g"] == 0 and r[0]["j"] == 0.0
    assert r[1]["k"] == [] and r[1]["j"] == 1.0 and r[1]["w"] == ["AC"]
    assert r[2]["w"] == ["ACGU", "GUAC"]


def test_iupac_and_consensus(spark):
    from pairloom.sources import consensus_line_kmers, expand_iupac

    df = spark.createDataFrame([("ARY",)], "c string")
    assert sorted(df.select(expand_iupac(F.col("c")).alias("x")).first()["x"]) == ["AAC", "AAU", "AGC", "AGU"]
    assert df.select(consensus_line_kmers(F.col("c"), 2, 10).alias("x")).first()["x"] == ["AA", "AG", "AC", "AU", "GC", "GU"]


def test_meme_files(spark, sf):
    from pairloom.catalog.sources import motif_files
    from pairloom.sources import load_pwms

    a = {(r["motif_id"], r["pos"], r["base"]): r["p"] for r in rows(load_pwms(spark, motif_files(spark, sf, meme=False)))}
    b = Counter((r["pos"], r["base"], r["p"]) for r in rows(load_pwms(spark, motif_files(spark, sf, meme=True))))
    assert b == Counter((k[1], k[2], v) for k, v in a.items()) and len(a) > 0


def test_motif_files_by_content(spark, tmp_path):
    from pairloom.sources import load_motifs

    files = {
        "h.motif": ">ACGU\tnamed\t5\n0.9\t0.1\t0\t0\n0.1\t0.8\t0.1\t0\n0.2\t0.2\t0.3\t0.3\n",
        "m.txt": "MEME\nMOTIF x\nletter-probability matrix: alength= 4 w= 3\n 0.1 0.2 0.3 0.4\n 0.25 0.25 0.25 0.25\n 1e-3 9e-1 0 0.099\n\nletter-probability matrix: alength= 4\n 1 0 0 0\n",
        "i.txt": "no matrix\nConsensus ARY\n",
        "short.txt": "consensus A\n",
        "empty.txt": "nothing here\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r["motif_id"]: (r["kind"], r["width"], r["consensus"], r["kmers"]) for r in rows(load_motifs(spark, str(tmp_path / "*"), 2, 5))}
    assert got == {
        "named": ("homer", 3, "ACG", ["AC", "CG"]), "m": ("meme", 3, "UAC", ["UA", "AC"]), "i": ("iupac", 3, "ARY", ["AA", "AG", "AC", "AU", "GC"]),
        "short": ("iupac", 1, "A", []), "empty": ("none", 0, "", []),
    }


def test_windows_reader_needs_its_columns(spark, tmp_path):
    from pairloom.sources import load_windows

    (tmp_path / "x.tsv").write_text("chr\tstart\nc\t1\n")
    with pytest.raises(ValueError):
        load_windows(spark, str(tmp_path / "x.tsv"))


def test_shuffled_chain_is_one_cluster(spark):
    names = [f"n{k:03d}" for k in np.random.default_rng(5).permutation(300)]
    nodes = spark.createDataFrame([(n,) for n in [*names, "lonely"]], "node string")
    links = spark.createDataFrame(list(zip(names[:-1], names[1:])) + [("lonely", "elsewhere")], "query string, target string")
    got = {r.node: r.cluster for r in sp.connected_clusters(nodes, links).collect()}
    assert got == {n: "n000" for n in names} | {"lonely": "lonely"}


def test_wide_row_ids_stay_distinct(spark):
    from pairloom.sources.readers import parse_curated

    raw = spark.createDataFrame(
        [(k, "P1", "Yes", "ACGUACGU", "MKVLAAGGKLMN") for k in (7, 12345, 12346)],
        "row long, Protein string, `Interaction (yes/no)` string, `RNA sequence` string, `Protein Sequence` string",
    )
    assert {r.pair_id for r in parse_curated(raw, "row").collect()} == {"curated_0007", "curated_12345", "curated_12346"}


def test_summaries_have_exact_medians(spark):
    from pairloom.operators import aggregates as ag

    panel = spark.createDataFrame([(i, x) for i, x in enumerate([0.3, -0.1, 0.5, 0.2, None])], "unit int, rho double")
    pooled = spark.createDataFrame([(0.25, 90)], "rho double, n long")
    r = rows(ag.panel_summary(panel, pooled))
    assert len(r) == 1 and abs(r[0]["rho_median"] - 0.25) < 1e-12
    assert (r[0]["n_experiments"], r[0]["n_positive_rho"], r[0]["n_rows"]) == (5, 3, 90)
    t = spark.createDataFrame([("a", 0.1, 1.0), ("a", 0.4, None), (None, 0.5, 2.0), ("z", None, None)], "k string, auroc double, overlap double")
    got = {r["k"]: (r["n"], r["median"], r["overlap_median"]) for r in rows(ag.transfer_summary(t, "k"))}
    assert got == {"a": (2, 0.25, 1.0), None: (1, 0.5, 2.0), "z": (0, None, None)}
