"""Word scores found inside the rows against plain Python; window texts are made once."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom import views
from pairloom.operators import models as ml

K = 2
ROWS = [
    ("a", "P", "ACGUAC"), ("a", "P", "GGNGU"), ("b", "Q", "0123ACGG"), ("c", None, "ACGU"), (None, "P", "UUA"), (None, "P", "CCA"),
    ("d", "P", "A"), ("e", "P", None), ("f", "P", ""), ("g", "R", "acACxGG"), ("h", "R", "CCCC"),
]
WEIGHTS = [("P", "AC", 1.5), ("P", "GG", -2.0), ("R", "AC", 0.25), ("R", "UU", 4.0), ("R", "CC", None), ("S", "CC", 3.0), ("S", "GU", -1.0)]
NEAR = [("P", "R", 0.5, 1), ("P", "S", 0.25, 2), ("R", "S", 0.5, 1), ("T", "P", 0.9, 1), ("R", "none", 0.7, 2)]


def words(seq):
    return [] if seq is None else [w for w in (seq[i : i + K] for i in range(len(seq) - K + 1)) if set(w) <= set("ACGU")]


def tables(spark):
    rows = spark.createDataFrame(ROWS, "id string, g string, seq string")
    return rows, spark.createDataFrame(WEIGHTS, "g string, kmer string, weight double"), spark.createDataFrame(NEAR, "g string, target string, fident double, rk int")


def summed(model):
    out = {}
    for key, g, seq in ROWS:
        if words(seq):
            out[key, g] = out.get((key, g), 0.0) + sum(model(g, w) for w in words(seq))
    return out


def mean_of(w):
    x = [v for _, u, v in WEIGHTS if u == w and v is not None]
    return sum(x) / len(x) if x else 0.0


def weight_of(g, w):
    return next((v or 0.0 for h, u, v in WEIGHTS if (h, u) == (g, w)), 0.0)


def blended(n):
    def model(g, w):
        near = [(t, f) for h, t, f, rk in NEAR if h == g and rk <= n]
        if not any(t in "PRS" for t, _ in near):
            return mean_of(w)
        return sum(weight_of(t, w) * f for t, f in near) / sum(f for _, f in near)

    return model


def check(found, column, expected):
    assert {(r["id"], r["g"]) for r in found} == set(expected) and len(found) == len(expected)
    assert all(math.isclose(r[column], expected[r["id"], r["g"]], abs_tol=1e-12) for r in found)


def test_scores_by_brute_force(spark):
    rows, weights, near = tables(spark)
    fitted = {g for g, _, _ in WEIGHTS}
    check(ml.nb_scores(rows, weights, "id", "g", "seq", K).collect(), "score", summed(lambda g, w: weight_of(g, w) if g in fitted else mean_of(w)))
    transfer = summed(lambda g, w: 0.0 if g is None else blended(2)(g, w))
    check(ml.knn_transfer(rows, weights, near, "id", "g", "seq", K, 2).collect(), "score", transfer)
    found = ml.neighbour_scores(rows, weights, near, "id", "g", "seq", K, (1, 2)).collect()
    for column, model in {"mean": lambda g, w: mean_of(w), "nn1": blended(1), "nn2": blended(2)}.items():
        check(found, column, summed(model))


def test_words_of_the_rows_do_not_move(spark):
    rows, weights, near = tables(spark)
    for d in (
        ml.nb_scores(rows, weights, "id", "g", "seq", K), ml.knn_transfer(rows, weights, near, "id", "g", "seq", K),
        ml.neighbour_scores(rows, weights, near, "id", "g", "seq", K),
    ):
        assert "explode(regexp_extract_all" not in d._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("view", [views.pairs, views.pairs_keyed])
def test_window_texts_are_made_once(spark, tmp_path, view):
    letters = "abcdefghij" * 13
    docs = [(1, letters, "en", "s", 130), (1, letters, "en", "s", 130), (2, "a-c", "de", "s", 3), (3, None, "fr", "s", 0), (4, "no label", "en", "s", 8), (None, letters, "en", "s", 130), (5, "b" * 64, "en", "t", 64)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (3, 1), (5, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    d = view(spark, str(tmp_path))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("translate(regexp_replace(lower(text") == (1 if view is views.pairs else 2)
    rna = letters.translate(str.maketrans(views.LETTERS, views.TO_RNA))
    expected = sorted(2 * [(1, o, rna[o : o + 60]) for o in (0, 60, 70)] + ([(5, o, "C" * 60) for o in (0, 4)] if view is views.pairs else []))
    assert sorted((r["doc_id"], r["off"], r["rna_sequence"]) for r in d.select("doc_id", "off", "rna_sequence").collect()) == expected
    if view is views.pairs_keyed:
        prot = "".join(c for c in letters if c not in "bjouxz").upper()
        assert {(r[0], r[1]) for r in d.select("protein_key", "protein_length").collect()} == {(spark.range(1).select(F.md5(F.lit(prot))).first()[0], len(prot))}


def test_kmer_frequencies_move_texts_only(spark):
    """By brute force over keys that repeat or are null; no word is shuffled."""
    from pairloom.operators import kmers as km

    rows = [(1, "ACGUAC"), (1, "GGNGG"), (2, "A"), (None, "UUUU"), (None, "AXU"), (3, None), (4, ""), (5, "\u00e9ACGU\U0001f600AC")] + [(k, "ACGU" * k) for k in range(6, 40)]
    df = spark.createDataFrame(rows, "id long, s string").repartition(3)
    out = km.kmer_freq(df, "id", "s", [1, 2, 3], "AUGC")
    assert out.dtypes == [("id", "bigint"), ("kmer", "string"), ("n", "bigint"), ("freq", "double")]
    want = set()
    for key in {k for k, _ in rows}:
        for k in (1, 2, 3):
            n = Counter(s[i : i + k] for q, s in rows if q == key and s for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGU"))
            want |= {(key, w, c, c / sum(n.values())) for w, c in n.items()}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("Exchange")[-1]


def test_counts_of_letters_and_pairs(spark):
    """RNA texts by replacing, others by matching: the same as by hand."""
    from pairloom import functions as fn

    texts = ["", "A", "AA", "AAAA", "ACGU", "AACAAGAAA", "GGGCCCUUUAAAGC", "acgt tt", "ANNA", "x.[x.[", "UUUUUUUA", " AU "]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "s string")
    got = {r.s: r for r in df.select("s", fn.nt_counts("s").alias("n"), fn.dinuc_counts("s").alias("d"), fn.dinuc_counts("s", circular=True).alias("c")).collect()}
    pairs = lambda s: sorted(Counter(s[i : i + 2] for i in range(len(s) - 1)).items())
    for t in texts:
        s = t.strip(" ").upper().replace("T", "U")
        assert [tuple(x) for x in got[t].n] == sorted(Counter(s).items())
        assert [tuple(x) for x in got[t].d] == pairs(s)
        assert [tuple(x) for x in got[t].c] == pairs(s + s[0] if len(s) > 1 else s)
    assert got[None].n is None
    plan = df.select(fn.dinuc_counts("s"))._jdf.queryExecution().executedPlan().toString()
    assert "replace(" in plan
