"""Queries for the distributed baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import functions as fn, views
from pairloom.catalog.aggregates import exemplar_rows
from pairloom.catalog.metrics import auc_sql, boot_auc, rounded, spearman_sql
from pairloom.catalog.registry import rd, register
from pairloom.catalog.sqlviews import sql
from pairloom.operators import metrics as mt, models as ml
from pairloom.plans import cut_lineage

QUERIES: dict = {}
SQL: dict = {}
reg = register(QUERIES, SQL)


def rows(spark, sf):
    """The derived rows, written once: the fits below pass over them several times."""
    return cut_lineage(views.pairs(spark, sf))


def keyed_rows(spark, sf):
    """Rows with their own document's protein as a digest, written once."""
    return cut_lineage(views.pairs_keyed(spark, sf))


def by_split(spark, sf, name):
    return views.pairs(spark, sf).where(F.col("split") == name)


@reg(
    "ml_features",
    sql("pairs_seq", """WITH j AS (SELECT *, length(protein_sequence) AS pl, md5(protein_sequence) AS pk FROM pairs_seq), tr AS (SELECT * FROM j WHERE split='train'),
 w AS (SELECT DISTINCT pair_id, split, unnest([substr(rna_sequence,i,4) for i in range(1,length(rna_sequence)-2)]) AS kmer FROM j), tw AS (SELECT DISTINCT kmer FROM w WHERE split='train'), rn AS (SELECT pair_id, count(*) AS n FROM w JOIN tw USING (kmer) GROUP BY 1),
 v AS (SELECT DISTINCT md5(prot) AS pk, unnest([substr(prot,i,3) for i in range(1,length(prot)-1)]) AS kmer FROM docs WHERE length(prot)>=30), tv AS (SELECT DISTINCT kmer FROM v WHERE pk IN (SELECT pk FROM tr)), pn AS (SELECT pk, count(*) AS n FROM v JOIN tv USING (kmer) GROUP BY 1),
 c AS (SELECT count(DISTINCT dataset_source) AS ns, max(length(rna_sequence)) AS r, max(pl) AS p, CASE WHEN count(DISTINCT length(rna_sequence))>1 THEN 1 ELSE 0 END AS rv, CASE WHEN count(DISTINCT pl)>1 THEN 1 ELSE 0 END AS pv FROM tr)
 SELECT pair_id, split, (256+8000+ns+1+2)::INT AS dims, (coalesce(rn.n,0)+coalesce(pn.n,0)+rv+pv+CASE WHEN dataset_source IN (SELECT dataset_source FROM tr) THEN 1 ELSE 0 END)::INT AS nonzero, round(length(rna_sequence)/r,9) AS rna_rel, round(pl/p,9) AS prot_rel
 FROM j LEFT JOIN rn USING (pair_id) LEFT JOIN pn USING (pk), c"""),
)
def ml_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    f = ml.build_features(views.pairs_keyed(spark, sf), views.protein_texts(spark, sf), "protein_key")
    a = vector_to_array("features")
    return f.select("pair_id", "split", F.size(a).alias("dims"), F.size(F.filter(a, lambda x: x != 0)).alias("nonzero"), rd("rna_rel").alias("rna_rel"), rd("prot_rel").alias("prot_rel"))


@reg("ml_baselines")
def ml_baselines(spark, sf):
    p = ml.build_features(keyed_rows(spark, sf), views.protein_texts(spark, sf), "protein_key")
    return rounded(ml.train_baselines(p.select("binding_label", "split", "features")), "auroc", "auprc")


@reg("ml_kmer_lr")
def ml_kmer_lr(spark, sf):
    s = ml.kmer_lr(by_split(spark, sf, "train"), by_split(spark, sf, "test"), "pair_id")
    return rounded(s, "score", digits=6)


@reg("ml_per_group")
def ml_per_group(spark, sf):
    m = ml.per_group_models(views.pairs(spark, sf), "experiment_id", "pair_id", k=4)
    return rounded(m, "val_auroc", "test_auroc", "test_auprc", digits=6)


@reg("ml_per_group_cv")
def ml_per_group_cv(spark, sf):
    return rounded(ml.per_group_cv(rows(spark, sf), "experiment_id", "pair_id"), "auroc", "auprc", digits=6)


@reg("ml_exemplar_scores")
def ml_exemplar_scores(spark, sf):
    m = ml.fit_groups(by_split(spark, sf, "train"), "protein_name", "pair_id").drop("model")
    return ml.score_exemplars(exemplar_rows(spark, sf), m, "protein_name")


@reg("ml_within_transfer")
def ml_within_transfer(spark, sf):
    t = ml.transfer_matrix(rows(spark, sf), "protein_name", "dataset_source", "pair_id")
    return rounded(t, "auroc", "auprc", "share_rna", digits=6)


NBW = """WITH tr AS (SELECT * FROM pairs WHERE split='train'), kc AS (SELECT {g} AS grp, kmer, sum(binding_label) AS p, sum(1-binding_label) AS n FROM (SELECT {g}, binding_label, unnest([substr(rna_sequence,i,4) for i in range(1,length(rna_sequence)-2)]) AS kmer FROM tr) GROUP BY {g}, kmer),
 al AS (SELECT unnest(['A','C','G','U']) AS x), wd AS (SELECT a.x||b.x||c.x||d.x AS kmer FROM al a, al b, al c, al d), gr AS (SELECT DISTINCT {g} AS grp FROM tr), fl AS (SELECT grp, kmer, coalesce(p,0)+1.0::DOUBLE AS p, coalesce(n,0)+1.0::DOUBLE AS n FROM gr CROSS JOIN wd LEFT JOIN kc USING (grp, kmer)),
 w AS (SELECT grp, kmer, ln((p/sum(p) OVER g)/(n/sum(n) OVER g)) AS weight FROM fl WINDOW g AS (PARTITION BY grp)), mw AS (SELECT kmer, avg(weight) AS weight FROM w GROUP BY 1),
 te AS (SELECT pair_id, {g} AS grp, binding_label, kmer, count(*) AS c FROM (SELECT pair_id, {g}, binding_label, unnest([substr(rna_sequence,i,4) for i in range(1,length(rna_sequence)-2)]) AS kmer FROM pairs WHERE split='test') GROUP BY ALL)"""


@reg(
    "ml_nb_weights",
    sql("pairs", NBW.format(g="experiment_id") + """ SELECT pair_id, te.grp AS experiment_id, round(sum(c*CASE WHEN g.grp IS NULL THEN mw.weight ELSE coalesce(w.weight,0) END),9)+0.0::DOUBLE AS score FROM te LEFT JOIN gr g ON g.grp=te.grp LEFT JOIN w ON w.grp=te.grp AND w.kmer=te.kmer JOIN mw ON mw.kmer=te.kmer GROUP BY 1,2"""),
)
def ml_nb_weights(spark, sf):
    p = rows(spark, sf)
    w = ml.nb_weights(p.where("split = 'train'"), "experiment_id", "rna_sequence", 4)
    return rounded(ml.nb_scores(p.where("split = 'test'"), w, "pair_id", "experiment_id", "rna_sequence", 4), "score")


@reg(
    "ml_knn_transfer",
    sql("pairs hits", NBW.format(g="protein_name") + """, hh AS (SELECT 'src'||(substr(query,2)::INT%20) AS grp, 'src'||(substr(target,2)::INT%20) AS target, max(fident) AS fident, max(bits) AS bits FROM hits WHERE fident>0 GROUP BY 1,2),
 nn AS (SELECT * FROM hh WHERE grp<>target QUALIFY row_number() OVER (PARTITION BY grp ORDER BY bits DESC, target)<=3), nt AS (SELECT *, sum(fident) OVER (PARTITION BY grp) AS t FROM nn),
 bl AS (SELECT nt.grp, w.kmer, sum(weight*fident/t) AS weight FROM nt JOIN w ON w.grp=nt.target GROUP BY 1,2), md AS (SELECT * FROM bl UNION ALL SELECT g.grp, kmer, weight FROM (SELECT DISTINCT grp FROM te WHERE grp NOT IN (SELECT grp FROM bl)) g, mw)
 SELECT pair_id, te.grp AS protein_name, round(sum(c*coalesce(weight,0)),6)+0.0::DOUBLE AS score FROM te LEFT JOIN md USING (grp,kmer) GROUP BY 1,2"""),
)
def ml_knn_transfer(spark, sf):
    p = rows(spark, sf)
    w = ml.nb_weights(p.where("split = 'train'"), "protein_name", "rna_sequence", 4)
    return rounded(ml.knn_transfer(p.where("split = 'test'"), w, neighbours(spark, sf), "pair_id", "protein_name", "rna_sequence", 4), "score", digits=6)


def neighbours(spark, sf, n=3):
    node = lambda c: F.concat(F.lit("src"), (F.substring(c, 2, 10).cast("int") % 20).cast("string"))
    h = views.hits(spark, sf).where("fident > 0").groupBy(node("query").alias("protein_name"), node("target").alias("target")).agg(
        F.max("fident").alias("fident"), F.max("bits").alias("bits")
    )
    h = h.where(F.col("protein_name") != F.col("target"))
    from pairloom.plans import top_per_group

    return top_per_group(h, "protein_name", [F.desc("bits"), "target"], n)


NNS = (1, 3, 5)
SCORERS = ["mean", *[f"nn{n}" for n in NNS]]


def transfer_scores(spark, sf, k=4):
    """Test rows with the mean model's score and those of 1, 3 and 5 neighbours, and their identity bin."""
    near = cut_lineage(neighbours(spark, sf, max(NNS)))
    p = rows(spark, sf)
    w = ml.nb_weights(p.where("split = 'train'"), "protein_name", "rna_sequence", k)
    test = p.where("split = 'test'")
    s = ml.neighbour_scores(test, w, near, "pair_id", "protein_name", "rna_sequence", k, NNS)
    best = ml.best_identity(near, "protein_name")
    d = test.select("pair_id", "binding_label", "rna_sequence", "probe_intensity").join(s, "pair_id").join(best, "protein_name", "left")
    return d.withColumn("identity_bin", fn.identity_bin(F.coalesce("best_identity", F.lit(0.0)))).withColumns({c: F.round(c, 6) for c in SCORERS})


IBIN = "CASE WHEN {x}<=0 THEN 'no_hit' WHEN {x}<0.3 THEN '<30%' WHEN {x}<0.5 THEN '30-50%' WHEN {x}<0.7 THEN '50-70%' WHEN {x}<0.9 THEN '70-90%' ELSE '>=90%' END"
TRANSFER = NBW.format(g="protein_name") + f""", hh AS (SELECT 'src'||(substr(query,2)::INT%20) AS grp, 'src'||(substr(target,2)::INT%20) AS target, max(fident) AS fident, max(bits) AS bits FROM hits WHERE fident>0 GROUP BY 1,2),
 nn AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY bits DESC, target) AS rk FROM hh WHERE grp<>target QUALIFY rk<=5), ns AS (SELECT nn.*, n FROM nn, (VALUES (1),(3),(5)) v(n) WHERE rk<=n), nt AS (SELECT *, sum(fident) OVER (PARTITION BY grp, n) AS t FROM ns),
 bl AS (SELECT nt.grp, w.kmer, sum(weight*fident/t) FILTER (n=1) AS w1, sum(weight*fident/t) FILTER (n=3) AS w3, sum(weight*fident/t) FILTER (n=5) AS w5 FROM nt JOIN w ON w.grp=nt.target GROUP BY 1,2), ht AS (SELECT DISTINCT grp FROM bl),
 sw AS (SELECT pair_id, te.grp AS protein_name, any_value(te.binding_label) AS binding_label, round(sum(c*mw.weight),6) AS "mean", round(sum(c*CASE WHEN ht.grp IS NULL THEN mw.weight ELSE coalesce(w1,0) END),6) AS nn1,
  round(sum(c*CASE WHEN ht.grp IS NULL THEN mw.weight ELSE coalesce(w3,0) END),6) AS nn3, round(sum(c*CASE WHEN ht.grp IS NULL THEN mw.weight ELSE coalesce(w5,0) END),6) AS nn5
  FROM te LEFT JOIN ht USING (grp) LEFT JOIN bl USING (grp,kmer) JOIN mw USING (kmer) GROUP BY 1,2),
 ib AS (SELECT sw.*, {IBIN.format(x="coalesce(fident,0)")} AS identity_bin FROM sw LEFT JOIN nn ON nn.grp=sw.protein_name AND rk=1)"""


@reg(
    "ml_knn_scores",
    sql("pairs hits", TRANSFER + """ SELECT pair_id, protein_name, identity_bin, "mean"+0.0::DOUBLE AS "mean", nn1+0.0::DOUBLE AS nn1, nn3+0.0::DOUBLE AS nn3, nn5+0.0::DOUBLE AS nn5 FROM ib"""),
)
def ml_knn_scores(spark, sf):
    """Scores of 1, 3 and 5 neighbours in one pass."""
    return rounded(transfer_scores(spark, sf).select("pair_id", "protein_name", "identity_bin", *SCORERS), *SCORERS, digits=6)


@reg(
    "ml_knn_report",
    sql("pairs hits", TRANSFER + """, lg AS (SELECT protein_name, binding_label, identity_bin, scorer, s FROM (UNPIVOT ib ON "mean", nn1, nn3, nn5 INTO NAME scorer VALUE s)),
 ok AS (SELECT protein_name FROM ib GROUP BY 1 HAVING min(binding_label)<max(binding_label)), sc AS (SELECT unnest(['overall', identity_bin]) AS scope, scorer, protein_name, binding_label, s FROM lg WHERE protein_name IN (SELECT protein_name FROM ok)),
 un AS (SELECT DISTINCT scope, protein_name FROM sc), ix AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY protein_name)-1 AS idx, count(*) OVER (PARTITION BY scope) AS n FROM un),
 dr AS (SELECT scope, b AS replicate, ('0x'||substr(sha256('42|'||b||'|'||idx),1,8))::BIGINT % n AS idx FROM ix, range(0,200) r(b)), mu AS (SELECT dr.scope, replicate, protein_name, count(*) AS m FROM dr JOIN ix USING (scope, idx) GROUP BY ALL),
 cl AS (SELECT scope, scorer, protein_name, s, sum(binding_label) AS p, sum(1-binding_label) AS n FROM sc GROUP BY ALL), rw AS (SELECT scope, scorer, replicate, s, p*m AS p, n*m AS n FROM cl JOIN mu USING (scope, protein_name)),
 """ + boot_auc("rep", "rw", "scope, scorer, replicate") + ", " + boot_auc("pt", "cl", "scope, scorer") + ", " + boot_auc("pg", "cl", "scope, scorer, protein_name") + """,
 md AS (SELECT scope, scorer, quantile_cont(auroc,0.5) AS gm FROM pg WHERE auroc IS NOT NULL GROUP BY ALL), d AS (SELECT r.scope, r.scorer, r.auroc, r.auroc-f.auroc AS delta FROM rep r JOIN rep f ON f.scope=r.scope AND f.replicate=r.replicate AND f.scorer='mean'),
 z AS (SELECT scope, scorer, count(*) AS n_rows, count(DISTINCT protein_name) AS n_groups FROM sc GROUP BY ALL)
 SELECT d.scope, d.scorer, round(any_value(pt.auroc),9) AS auroc, round(quantile_cont(d.auroc,0.025),9) AS auroc_lo, round(quantile_cont(d.auroc,0.975),9) AS auroc_hi, round(quantile_cont(delta,0.025),9)+0.0::DOUBLE AS delta_lo, round(quantile_cont(delta,0.975),9)+0.0::DOUBLE AS delta_hi,
  round(any_value(pt.auroc)-any_value(p0.auroc),9)+0.0::DOUBLE AS delta, round(any_value(gm),9) AS group_median, any_value(n_rows) AS n_rows, any_value(n_groups) AS n_groups
 FROM d JOIN pt USING (scope, scorer) JOIN pt p0 ON p0.scope=d.scope AND p0.scorer='mean' JOIN md ON md.scope=d.scope AND md.scorer=d.scorer JOIN z ON z.scope=d.scope AND z.scorer=d.scorer GROUP BY d.scope, d.scorer"""),
)
def ml_knn_report(spark, sf):
    """AUROC by scorer, overall and by identity bin, with cluster intervals."""
    r = ml.transfer_report(transfer_scores(spark, sf), SCORERS, "protein_name").drop("p_le_0")
    return rounded(r, "auroc", "auroc_lo", "auroc_hi", "delta", "delta_lo", "delta_hi", "group_median")


@reg(
    "ml_label_prior",
    sql("pairs", """WITH t AS (SELECT * FROM pairs WHERE split='train'), p AS (SELECT experiment_id, avg(binding_label) AS p FROM t GROUP BY 1), r AS (SELECT rna_sequence, avg(binding_label) AS r FROM t GROUP BY 1)
 SELECT pair_id, binding_label, round(coalesce(p,r,(SELECT avg(binding_label) FROM t)),9) AS prior, round((coalesce(p,0.5::DOUBLE)+coalesce(r,0.5::DOUBLE))/2,9) AS degree_prior FROM pairs LEFT JOIN p USING (experiment_id) LEFT JOIN r USING (rna_sequence) WHERE split='test'"""),
)
def ml_label_prior(spark, sf):
    return rounded(ml.label_prior(by_split(spark, sf, "train"), by_split(spark, sf, "test"), "pair_id", "experiment_id"), "prior", "degree_prior")


FOLD_COLUMNS = ["pair_id", "protein_name", "protein_key", "rna_sequence", "binding_label"]


def fold_rows(spark, sf):
    """The columns of ``keyed_rows`` that folds need, written once."""
    return cut_lineage(views.pairs_keyed(spark, sf).select(*FOLD_COLUMNS))


def fold_shares(spark, sf, p):
    """Overlap and similarity of the audit's folds, by split."""
    from pairloom.operators.joins import pair_similarity

    splits = list(ml.audit_splits("protein_name", "rna_sequence"))
    f = ml.audit_folds(p.select(*FOLD_COLUMNS), "pair_id")
    rna = pair_similarity(p, "rna_sequence", k=12, min_sim=0.5, texts=False)
    shares = ml.fold_overlap(f, "protein_name", "protein_key", "rna_sequence", splits)
    named = f.select(F.sha2("rna_sequence", 256).alias("rna_key"), *splits)
    rna = ml.fold_similarity(named, "rna_key", cut_lineage(rna), (0.5, 0.8), "rna", splits)
    prot = pair_similarity(views.protein_texts(spark, sf), "protein_sequence", k=12, min_sim=0.5, texts=False)
    # proteins are named by md5 in the rows and by sha-256 in the pairs
    named = views.protein_texts(spark, sf).select("protein_key", F.sha2("protein_sequence", 256).alias("sha"))
    for c in ("a", "b"):
        prot = prot.join(named.withColumnsRenamed({"sha": c, "protein_key": f"_{c}"}), c)
    prot = cut_lineage(prot.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "jaccard"))
    return shares.join(rna, "split").join(ml.fold_similarity(f, "protein_key", prot, (0.5, 0.7), "protein", splits), "split")


SHARES = ["name_in_train", "protein_in_train", "rna_in_train", "pair_in_train", "rna_similar_50", "rna_similar_80", "protein_similar_50", "protein_similar_70"]


@reg("ml_marginals")
def ml_marginals(spark, sf):
    p = fold_rows(spark, sf)
    m = ml.shortcut_audit(p, views.protein_texts(spark, sf), "pair_id", protein="protein_key").join(fold_shares(spark, sf, p), "split")
    return rounded(m, "auroc", "auroc_std", "auprc", *SHARES, digits=6)


SIMILAR_SQL = """{n}_w AS (SELECT s, list_distinct([substr(s,i,12) for i in range(1,length(s)-10)]) AS w FROM (SELECT DISTINCT {c} AS s FROM p) WHERE length(s)>=12), {n}_x AS (SELECT s, len(w) AS n, unnest(w) AS t FROM {n}_w),
 {n}_p AS (SELECT a.s AS a, b.s AS b, count(*)::DOUBLE/(any_value(a.n)+any_value(b.n)-count(*)) AS sim FROM {n}_x a JOIN {n}_x b ON a.t=b.t AND a.s<>b.s GROUP BY 1,2 HAVING sim>=0.5), {n}_s AS (SELECT a, b, sim FROM {n}_p UNION ALL SELECT DISTINCT {c}, {c}, 1.0::DOUBLE FROM p),
 {n}_c AS (SELECT DISTINCT split, {c} AS s, fold FROM f), {n}_h AS (SELECT c.split, c.s, c.fold, max(sim) AS sim FROM {n}_c c JOIN {n}_s q ON q.a=c.s JOIN {n}_c d ON d.split=c.split AND d.s=q.b AND d.fold<>c.fold GROUP BY ALL)"""


@reg(
    "ml_fold_shares",
    sql("pairs_seq", """WITH p AS (SELECT pair_id, protein_name, protein_sequence, rna_sequence, binding_label FROM pairs_seq),
 g AS (SELECT protein_name, (row_number() OVER (ORDER BY sha256('42|'||protein_name), protein_name)-1)%5 AS fold FROM (SELECT DISTINCT protein_name FROM p)), s AS (SELECT rna_sequence, (row_number() OVER (ORDER BY sha256('42|'||rna_sequence), rna_sequence)-1)%5 AS fold FROM (SELECT DISTINCT rna_sequence FROM p)),
 f AS (SELECT *, 'random' AS split, (row_number() OVER (PARTITION BY binding_label ORDER BY sha256('42|'||pair_id), pair_id)-1)%5 AS fold FROM p UNION ALL SELECT p.*, 'protein_disjoint', fold FROM p JOIN g USING (protein_name) UNION ALL SELECT p.*, 'rna_disjoint', fold FROM p JOIN s USING (rna_sequence)),
 o AS (SELECT split, fold, rna_sequence, protein_sequence, (min(fold) OVER n < max(fold) OVER n)::INT AS name_in_train, (min(fold) OVER t < max(fold) OVER t)::INT AS protein_in_train, (min(fold) OVER r < max(fold) OVER r)::INT AS rna_in_train, (min(fold) OVER b < max(fold) OVER b)::INT AS pair_in_train FROM f
   WINDOW n AS (PARTITION BY split, protein_name), t AS (PARTITION BY split, protein_sequence), r AS (PARTITION BY split, rna_sequence), b AS (PARTITION BY split, protein_sequence, rna_sequence)),
 """ + SIMILAR_SQL.format(n="r", c="rna_sequence") + ", " + SIMILAR_SQL.format(n="t", c="protein_sequence") + """
 SELECT o.split, round(avg(name_in_train),6) AS name_in_train, round(avg(protein_in_train),6) AS protein_in_train, round(avg(rna_in_train),6) AS rna_in_train, round(avg(pair_in_train),6) AS pair_in_train,
  round(avg((coalesce(r_h.sim,0)>=0.5)::INT),6) AS rna_similar_50, round(avg((coalesce(r_h.sim,0)>=0.8)::INT),6) AS rna_similar_80, round(avg((coalesce(t_h.sim,0)>=0.5)::INT),6) AS protein_similar_50, round(avg((coalesce(t_h.sim,0)>=0.7)::INT),6) AS protein_similar_70
 FROM o LEFT JOIN r_h ON r_h.split=o.split AND r_h.s=o.rna_sequence AND r_h.fold=o.fold LEFT JOIN t_h ON t_h.split=o.split AND t_h.s=o.protein_sequence AND t_h.fold=o.fold GROUP BY o.split"""),
)
def ml_fold_shares(spark, sf):
    """The closed-form columns of ml_marginals."""
    return rounded(fold_shares(spark, sf, fold_rows(spark, sf)), *SHARES, digits=6)


@reg("ml_rna_audit")
def ml_rna_audit(spark, sf):
    """Datasets are a protein's windows of one source; the source is their cell."""
    p = views.pairs(spark, sf).withColumn("dataset", F.concat_ws("_", "protein_name", "dataset_source"))
    a = ml.rna_audit(p, "dataset", "dataset_source", "doc_id", "pair_id")
    return rounded(a, "auroc", "cell_median", "all_median", "all_mean", digits=6)


@reg("ml_reverse")
def ml_reverse(spark, sf):
    p = rows(spark, sf)
    return rounded(ml.reverse_transfer(p.where("dataset_source = 'en'"), p.where("dataset_source <> 'en'"), "protein_name", "pair_id"), "auroc", digits=6)


PROFILE_K = 5


@reg("ml_profile_knn")
def ml_profile_knn(spark, sf):
    """Embeddings against the five-letter profile of the whole document with the same number; the
    document's windows are the probes."""
    from pairloom.operators import kmers as km

    e = views.embeddings(spark, sf)
    named = lambda d: d.withColumn("protein_name", F.concat(F.lit("V"), F.col("doc_id").cast("string"))).join(e.select("protein_name"), "protein_name", "left_semi")
    d = named(views.docs(spark, sf))
    words = fn.alphabet_kmers("ACGU", PROFILE_K)
    freq = km.kmer_freq(d, "protein_name", "rna", [PROFILE_K], "ACGU")
    prof = ml.dense_profiles(freq.withColumn("i", ml.word_number("kmer")), "protein_name", "i", "freq", len(words))
    no = F.substring("protein_name", 2, 20).cast("int") % 5
    prof = cut_lineage(prof.withColumn("split", F.when(no < 3, "train").when(no == 3, "val").otherwise("test")))
    probes = named(views.pairs(spark, sf).drop("protein_name")).select("pair_id", "protein_name", "rna_sequence", "binding_label")
    r = ml.profile_regression(e.select("protein_name", "embedding"), prof, probes, words)
    return rounded(r, "median_rho", "mean_rho", "mean_lo", "mean_hi", "top20", "probe_auroc", digits=6)


def intensity_table(spark, sf):
    d = cut_lineage(transfer_scores(spark, sf, 3))
    t = ml.intensity_spearman(d, d, SCORERS[:2], "protein_name", "pair_id", "rna_sequence", "probe_intensity", min_probes=30)
    return t.join(d.select("protein_name", "identity_bin").distinct(), "protein_name")


@reg("ml_intensity")
def ml_intensity(spark, sf):
    """Rank correlation of the transferred scores with intensities, and the ceiling of an own ridge."""
    return rounded(intensity_table(spark, sf), "mean", "nn1", "own_cv", digits=6)


@reg("ml_intensity_summary")
def ml_intensity_summary(spark, sf):
    s = ml.intensity_summary(intensity_table(spark, sf), [*SCORERS[:2], "own_cv"], "protein_name")
    return rounded(s, "mean", "mean_lo", "mean_hi", "median", digits=6)


@reg(
    "ml_intensity_transfer",
    sql("pairs hits", TRANSFER.replace("substr(rna_sequence,i,4) for i in range(1,length(rna_sequence)-2)", "substr(rna_sequence,i,3) for i in range(1,length(rna_sequence)-1)").replace("a.x||b.x||c.x||d.x AS kmer FROM al a, al b, al c, al d", "a.x||b.x||c.x AS kmer FROM al a, al b, al c") + """,
 pr AS (SELECT protein_name, rna_sequence, min(pair_id) AS pair_id, avg(probe_intensity) AS v FROM pairs WHERE split='test' GROUP BY 1,2), ok AS (SELECT protein_name, count(*) AS n_probes FROM pr GROUP BY 1 HAVING count(*)>=30),
 j AS (SELECT pr.protein_name, v, "mean", nn1 FROM pr JOIN ok USING (protein_name) JOIN sw USING (pair_id)), l AS (SELECT protein_name, scorer, v, s FROM (UNPIVOT j ON "mean", nn1 INTO NAME scorer VALUE s)), """ + spearman_sql("r", "l", "protein_name, scorer", "v", "s", 30) + """
 SELECT ok.protein_name, n_probes, round(max(rho) FILTER (scorer='mean'),6)+0.0::DOUBLE AS "mean", round(max(rho) FILTER (scorer='nn1'),6)+0.0::DOUBLE AS nn1 FROM ok LEFT JOIN r USING (protein_name) GROUP BY 1,2"""),
)
def ml_intensity_transfer(spark, sf):
    """The closed-form columns of ml_intensity."""
    return rounded(intensity_table(spark, sf).select("protein_name", "n_probes", "mean", "nn1"), "mean", "nn1", digits=6)


GCF = "(length({0})-length(translate({0},'GC','')))/length({0})"


@reg(
    "ml_window_scores",
    sql("docs", f"""WITH d AS (SELECT doc_id, rna FROM docs WHERE length(rna)>0), w AS (SELECT doc_id, rna, unnest(CASE WHEN length(rna)<=101 THEN [0::BIGINT] ELSE list_concat(range(0,length(rna)-100,50), CASE WHEN (length(rna)-101)%50<>0 THEN [length(rna)-101] ELSE [] END) END) AS o FROM d),
 s AS (SELECT doc_id, substr(rna,o+1,101) AS x FROM w), a AS (SELECT doc_id, max({GCF.format('x')}) AS mx, avg({GCF.format('x')}) AS mn, count(*) AS n_windows FROM s GROUP BY 1), c AS (SELECT doc_id, rna, CASE WHEN length(rna)<=101 THEN rna ELSE substr(rna,((length(rna)-101)//2)+1,101) END AS cr FROM d)
 SELECT doc_id, round(mx,9) AS max_score, round(mn,9) AS mean_score, n_windows, round({GCF.format('cr')},9) AS center_score, round({GCF.format('rna')},9) AS full_score FROM a JOIN c USING (doc_id)"""),
)
def ml_window_scores(spark, sf):
    d = views.docs(spark, sf).where(F.length("rna") > 0)
    return rounded(ml.window_scores(d, "doc_id", "rna", fn.gc_fraction), "max_score", "mean_score", "center_score", "full_score")


FLAG_SQL = NBW.format(g="protein_name") + """, sc AS (SELECT pair_id, te.grp AS protein_name, te.binding_label, sum(c*coalesce(w.weight,0)) AS s FROM te LEFT JOIN w ON w.grp=te.grp AND w.kmer=te.kmer GROUP BY 1,2,3), sr AS (SELECT protein_name, binding_label, round(s,6) AS s FROM sc), """


@reg("flagship_nb_transfer", sql("pairs", FLAG_SQL + auc_sql("m", "sr", "protein_name", "s") + " SELECT protein_name, round(auroc,9) AS auroc, round(auprc,9) AS auprc, n_pos+n_neg AS n_examples, n_pos AS n_positive, CASE WHEN n_pos+n_neg<10 THEN 'too_few_examples' WHEN n_pos=0 OR n_neg=0 THEN 'single_class' ELSE 'ok' END AS note FROM m"))
def flagship(spark, sf):
    """Closed-form word weights on train, scored on test, per-group ranking metrics."""
    p = rows(spark, sf)
    w = ml.nb_weights(p.where("split = 'train'"), "protein_name", "rna_sequence", 4)
    test = p.where("split = 'test'").select("pair_id", "protein_name", "rna_sequence", "binding_label")
    s = ml.nb_scores(test, w, "pair_id", "protein_name", "rna_sequence", 4).select("pair_id", rd("score", 6).alias("score"))
    m = mt.per_group_metrics(test.join(s, "pair_id"), "protein_name", "score")
    return rounded(m, "auroc", "auprc")
