"""Queries for metrics, statistics and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import views
from pairloom.catalog.registry import rd, register
from pairloom.catalog.sqlviews import sql
from pairloom.operators import bootstrap as bt, kmers as km, metrics as mt
from pairloom.plans import cut_lineage

QUERIES: dict = {}
SQL: dict = {}
reg = register(QUERIES, SQL)


def auc_sql(name: str, table: str, group: str, score: str) -> str:
    """CTE with auroc and auprc per group (textbook definitions)."""
    g = f"{group}," if group else ""
    p = f"PARTITION BY {group}" if group else ""
    pb = f"PARTITION BY {group}, s" if group else "PARTITION BY s"
    gb = f"GROUP BY {group}" if group else ""
    on = " AND ".join(f"c.{x.strip()}=d.{x.strip()}" for x in group.split(",")) if group else "true"
    return f"""{name}_r AS (SELECT {g} binding_label AS y, s, rank() OVER ({p} ORDER BY s) + (count(*) OVER ({pb})-1)/2.0::DOUBLE AS r FROM (SELECT {g} binding_label, {score} AS s FROM {table})),
 {name}_a AS (SELECT {g} sum(y)::BIGINT AS n_pos, sum(1-y)::BIGINT AS n_neg, CASE WHEN sum(y)>0 AND sum(1-y)>0 THEN (sum(r*y)-sum(y)*(sum(y)+1)/2.0::DOUBLE)/(sum(y)::DOUBLE*sum(1-y)) END AS auroc FROM {name}_r {gb}),
 {name}_c AS (SELECT {g} s, sum(y) AS p, count(*) AS n FROM {name}_r GROUP BY {g} s),
 {name}_d AS (SELECT {g} p, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER ({p}) AS pt FROM {name}_c WINDOW w AS ({p} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
 {name}_p AS (SELECT {g} sum(CASE WHEN p>0 THEN (p/pt::DOUBLE)*(tp/k::DOUBLE) ELSE 0 END) AS auprc FROM {name}_d {gb}),
 {name} AS (SELECT c.*, CASE WHEN c.auroc IS NOT NULL THEN d.auprc END AS auprc FROM {name}_a c JOIN {name}_p d ON {on})"""


def count():
    return F.count(F.lit(1))


def rounded(df, *cols, digits=9):
    return df.withColumns({c: rd(c, digits) for c in cols})


@reg("met_auroc", sql("scores", "WITH " + auc_sql("m", "scores", "protein_name", "score_a") + """, """ + auc_sql("o", "scores", "", "score_c") + """
 SELECT protein_name, n_pos, n_neg, round(auroc,9) AS auroc FROM m UNION ALL SELECT 'ALL', n_pos, n_neg, round(auroc,9) FROM o"""))
def met_auroc(spark, sf):
    s = views.scores(spark, sf)
    a = mt.auroc(s, "protein_name", "score_a")
    o = mt.auroc(s, None, "score_c").withColumn("protein_name", F.lit("ALL"))
    return rounded(a.unionByName(o), "auroc")


@reg("met_auprc", sql("scores", "WITH " + auc_sql("m", "scores", "protein_name", "score_b") + ", " + auc_sql("o", "scores", "", "score_a") + """
 SELECT protein_name, n_pos, n_neg, round(auprc,9) AS auprc FROM m UNION ALL SELECT 'ALL', n_pos, n_neg, round(auprc,9) FROM o"""))
def met_auprc(spark, sf):
    s = views.scores(spark, sf)
    a = mt.auprc(s, "protein_name", "score_b")
    o = mt.auprc(s, None, "score_a").withColumn("protein_name", F.lit("ALL"))
    return rounded(a.unionByName(o), "auprc")


@reg(
    "met_threshold",
    sql("scores", """WITH c AS (SELECT protein_name, count(*) AS n_samples, sum(binding_label)::BIGINT AS n_positive, count(*) FILTER (score_a>=0.5 AND binding_label=1) AS tp, count(*) FILTER (score_a>=0.5 AND binding_label=0) AS fp, count(*) FILTER (score_a<0.5 AND binding_label=1) AS fn, avg((score_a-binding_label)*(score_a-binding_label)) AS b FROM scores GROUP BY 1)
 SELECT protein_name, n_samples, n_positive, round((n_samples-fp-fn)/n_samples,9) AS accuracy, round(CASE WHEN 2*tp+fp+fn=0 THEN 0.0::DOUBLE ELSE 2*tp/(2*tp+fp+fn) END,9) AS f1, round(CASE WHEN tp+fp=0 THEN 0.0::DOUBLE ELSE tp/(tp+fp) END,9) AS precision, round(CASE WHEN tp+fn=0 THEN 0.0::DOUBLE ELSE tp/(tp+fn) END,9) AS recall, round(b,9) AS brier_score, round(n_positive/n_samples,9) AS positive_rate FROM c"""),
)
def met_threshold(spark, sf):
    m = mt.threshold_metrics(views.scores(spark, sf), "protein_name", "score_a")
    return rounded(m, "accuracy", "f1", "precision", "recall", "brier_score", "positive_rate")


PER_GROUP = "WITH " + auc_sql("m", "scores", "protein_name", "score_a") + """, pg AS (SELECT protein_name, CASE WHEN note='ok' THEN auroc END AS auroc, CASE WHEN note='ok' THEN auprc END AS auprc, n_examples, n_pos AS n_positive, note FROM
 (SELECT *, n_pos+n_neg AS n_examples, CASE WHEN n_pos+n_neg<580 THEN 'too_few_examples' WHEN n_pos<190 OR n_neg<190 THEN 'single_class' ELSE 'ok' END AS note FROM m))"""


@reg("met_per_group", sql("scores", PER_GROUP + " SELECT protein_name, round(auroc,9) AS auroc, round(auprc,9) AS auprc, n_examples, n_positive, note FROM pg"))
def met_per_group(spark, sf):
    m = mt.per_group_metrics(views.scores(spark, sf), "protein_name", "score_a", min_examples=580, min_class=190)
    return mt.sorted_groups(rounded(m, "auroc", "auprc"))


@reg(
    "met_group_summary",
    sql("scores", "WITH " + auc_sql("m", "scores", "protein_name", "score_a") + """ SELECT count(*) AS n_groups, round(quantile_cont(auroc,0.5),9) AS median, round(avg(auroc),9) AS mean, round(min(auroc),9) AS min, round(max(auroc),9) AS max,
 round(avg(CASE WHEN auroc>0.5 THEN 1.0::DOUBLE ELSE 0 END),9) AS share_above_05, round(avg(CASE WHEN auroc>0.6 THEN 1.0::DOUBLE ELSE 0 END),9) AS share_above_06, round(avg(CASE WHEN auroc>0.7 THEN 1.0::DOUBLE ELSE 0 END),9) AS share_above_07, count(*) FILTER (auroc<0.49) AS n_flagged FROM m WHERE auroc IS NOT NULL"""),
)
def met_group_summary(spark, sf):
    m = mt.per_group_metrics(views.scores(spark, sf), "protein_name", "score_a")
    s = mt.group_summary(m, flag_below=0.49)
    return rounded(s, "median", "mean", "min", "max", "share_above_05", "share_above_06", "share_above_07")


@reg("met_composition")
def met_composition(spark, sf):
    p = cut_lineage(views.pairs(spark, sf))
    c = mt.composition_baseline(p.where("split = 'test'"), p.where("split = 'train'"), "experiment_id")
    return rounded(c, "auroc", "group_median", "share_rna_in_train")


@reg(
    "met_composition_all",
    sql("pairs", """WITH te AS (SELECT *, length(rna_sequence) AS n, length(translate(rna_sequence,'GC','')) AS au FROM pairs WHERE split='test'),
 lg AS (SELECT experiment_id, binding_label, 'gc' AS feature, (n-au)/n AS s FROM te UNION ALL SELECT experiment_id, binding_label, 'au', au/n FROM te),
 """ + auc_sql("w", "lg", "feature", "s") + ", " + auc_sql("g", "lg", "feature, experiment_id", "s") + """, md AS (SELECT feature, quantile_cont(auroc,0.5) AS gm FROM g WHERE auroc IS NOT NULL GROUP BY 1),
 sh AS (SELECT avg(CASE WHEN rna_sequence IN (SELECT rna_sequence FROM pairs WHERE split='train') THEN 1 ELSE 0 END) AS x FROM (SELECT DISTINCT rna_sequence FROM te))
 SELECT 'all' AS subset, feature, round(auroc,9) AS auroc, n_pos+n_neg AS n, round(gm,9) AS group_median, round((SELECT x FROM sh),9) AS share_rna_in_train FROM w LEFT JOIN md USING (feature)"""),
)
def met_composition_all(spark, sf):
    """The rows before matching; the matched ones are drawn and have no SQL."""
    return met_composition(spark, sf).where("subset = 'all'")


CALIB = """WITH e AS (SELECT protein_name, list_distinct([quantile_cont(score_a, 1/15.0::DOUBLE),""" + ",".join(f"quantile_cont(score_a,{i}/15.0::DOUBLE)" for i in range(2, 15)) + """]) AS edges FROM scores GROUP BY 1),
 b AS (SELECT s.*, len([x for x in edges if x < score_a]) AS bin FROM scores s JOIN e USING (protein_name)), g AS (SELECT protein_name, bin, count(*) AS n, avg(score_a) AS mean_predicted, avg(binding_label) AS observed_rate FROM b GROUP BY 1,2)"""


@reg("met_calibration", sql("scores", CALIB + " SELECT protein_name, bin, n, round(mean_predicted,9) AS mean_predicted, round(observed_rate,9) AS observed_rate, round(avg(abs(observed_rate-mean_predicted)) OVER (PARTITION BY protein_name),9) AS ece FROM g"))
def met_calibration(spark, sf):
    b = mt.calibration(views.scores(spark, sf), "score_a", bins=15, group="protein_name")
    e = mt.expected_calibration_error(b, "protein_name").drop("n_bins")
    return rounded(b.join(e, "protein_name"), "mean_predicted", "observed_rate", "ece")


@reg(
    "met_confusion",
    sql("scores", """WITH c AS (SELECT protein_name, count(*) FILTER (score_a>=0.3 AND binding_label=1) AS tp, count(*) FILTER (score_a<0.3 AND binding_label=0) AS tn, count(*) FILTER (score_a>=0.3 AND binding_label=0) AS fp, count(*) FILTER (score_a<0.3 AND binding_label=1) AS fn FROM scores GROUP BY 1)
 SELECT protein_name, tp, tn, fp, fn, round(fp/nullif(fp+tn,0),9) AS fpr, round(fn/nullif(fn+tp,0),9) AS fnr, CASE WHEN fp/nullif(fp+tn,0)>0.72 THEN 1 ELSE 0 END AS extreme_fpr, CASE WHEN fn/nullif(fn+tp,0)>0.72 THEN 1 ELSE 0 END AS extreme_fnr FROM c"""),
)
def met_confusion(spark, sf):
    return rounded(mt.confusion(views.scores(spark, sf), "protein_name", "score_a", thr=0.3, extreme=0.72), "fpr", "fnr")


STRATA = """WITH st AS (SELECT *, unnest(list_concat(['all','family:'||family,'source:'||source], CASE WHEN identity<0.3 THEN ['identity<50%','identity<30%'] WHEN identity<0.5 THEN ['identity<50%'] ELSE [] END)) AS stratum FROM scores)"""


@reg("met_stratified", sql("scores", STRATA + ", " + auc_sql("m", "st", "stratum", "score_c") + """, g AS (SELECT stratum, count(DISTINCT protein_name) AS n_groups FROM st GROUP BY 1)
 SELECT stratum, n_pos, n_neg, n_groups, round(auroc,9) AS auroc, round(auprc,9) AS auprc FROM m JOIN g USING (stratum) WHERE n_pos>=5 AND n_neg>=5"""))
def met_stratified(spark, sf):
    m = mt.stratified_metrics(views.scores(spark, sf), "score_c", {"family": "family", "source": "source"}, identity="identity")
    return rounded(m, "auroc", "auprc")


def draws_sql(units: str, unit: str, n: int, seed=42) -> str:
    return f"""ix AS (SELECT {unit}, row_number() OVER (ORDER BY {unit})-1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT {unit} FROM {units})),
 dr AS (SELECT b AS replicate, ('0x'||substr(sha256('{seed}|'||b||'|'||idx),1,8))::BIGINT % n AS idx FROM ix, range(0,{n}) r(b)),
 mu AS (SELECT replicate, {unit}, count(*) AS m FROM dr JOIN ix USING (idx) GROUP BY 1,2)"""


def boot_auc(name, rows, group):
    """Weighted AUROC per group from columns s, p, n."""
    return f"""{name}_c AS (SELECT {group}, s, sum(p)::DOUBLE AS p, sum(n)::DOUBLE AS n FROM {rows} GROUP BY {group}, s),
 {name}_w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {group} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS nb FROM {name}_c),
 {name} AS (SELECT {group}, sum(p*(nb+n/2))/nullif(sum(p)*sum(n),0) AS auroc FROM {name}_w GROUP BY {group})"""


N_BOOT = 200


@reg(
    "met_bootstrap",
    sql("scores", "WITH " + draws_sql("scores", "protein_name", N_BOOT) + """, cl AS (SELECT protein_name, score_c AS s, sum(binding_label) AS p, sum(1-binding_label) AS n FROM scores GROUP BY 1,2),
 rw AS (SELECT replicate, s, p*m AS p, n*m AS n FROM cl JOIN mu USING (protein_name)), """ + boot_auc("rep", "rw", "replicate") + """, one AS (SELECT 1 AS k, s, p, n FROM cl), """ + boot_auc("pt", "one", "k") + """, """ + boot_auc("un", "cl", "protein_name") + """,
 ex AS (SELECT replicate, unnest([auroc for i in range(0,m)]) AS a FROM mu JOIN un USING (protein_name) WHERE auroc IS NOT NULL), md AS (SELECT replicate, quantile_cont(a,0.5) AS gm FROM ex GROUP BY 1)
 SELECT round((SELECT auroc FROM pt),9) AS auroc, round(quantile_cont(auroc,0.025),9) AS auroc_lo, round(quantile_cont(auroc,0.975),9) AS auroc_hi, round((SELECT quantile_cont(auroc,0.5) FROM un WHERE auroc IS NOT NULL),9) AS group_median,
  round(quantile_cont(gm,0.025),9) AS group_median_lo, round(quantile_cont(gm,0.975),9) AS group_median_hi, count(*) AS n_replicates FROM rep JOIN md USING (replicate)"""),
)
def met_bootstrap(spark, sf):
    b = bt.cluster_bootstrap(views.scores(spark, sf), N_BOOT, score="score_c")
    return rounded(b, "auroc", "auroc_lo", "auroc_hi", "group_median", "group_median_lo", "group_median_hi")


@reg(
    "met_bootstrap_delta",
    sql("scores", "WITH " + draws_sql("scores", "protein_name", N_BOOT) + """, lg AS (UNPIVOT (SELECT protein_name, binding_label, score_a, score_b, score_c FROM scores) ON score_a, score_b, score_c INTO NAME scorer VALUE s),
 cl AS (SELECT scorer, protein_name, s, sum(binding_label) AS p, sum(1-binding_label) AS n FROM lg GROUP BY 1,2,3), rw AS (SELECT scorer, replicate, s, p*m AS p, n*m AS n FROM cl JOIN mu USING (protein_name)),
 """ + boot_auc("rep", "rw", "scorer, replicate") + ", " + boot_auc("pt", "cl", "scorer") + """, d AS (SELECT r.scorer, r.auroc, r.auroc-f.auroc AS delta FROM rep r JOIN rep f ON f.replicate=r.replicate AND f.scorer='score_a')
 SELECT d.scorer, round(any_value(pt.auroc),9) AS auroc, round(quantile_cont(d.auroc,0.025),9) AS auroc_lo, round(quantile_cont(d.auroc,0.975),9) AS auroc_hi, round(quantile_cont(delta,0.025),9)+0.0::DOUBLE AS delta_lo, round(quantile_cont(delta,0.975),9)+0.0::DOUBLE AS delta_hi,
  round(avg(CASE WHEN delta<=0 THEN 1.0::DOUBLE ELSE 0 END),9) AS p_le_0, round(any_value(pt.auroc)-(SELECT auroc FROM pt WHERE scorer='score_a'),9)+0.0::DOUBLE AS delta FROM d JOIN pt USING (scorer) GROUP BY d.scorer"""),
)
def met_bootstrap_delta(spark, sf):
    long = views.scores(spark, sf).select("protein_name", "binding_label", "score_a", "score_b", "score_c").unpivot(
        ["protein_name", "binding_label"], ["score_a", "score_b", "score_c"], "scorer", "score"
    )
    b = bt.paired_bootstrap(long, "score_a", N_BOOT)
    return rounded(b, "auroc", "auroc_lo", "auroc_hi", "delta_lo", "delta_hi", "p_le_0", "delta")


@reg(
    "met_bootstrap_stat",
    sql("scores", "WITH un AS (SELECT protein_name, avg(score_a) AS v FROM scores GROUP BY 1), " + draws_sql("un", "protein_name", N_BOOT) + """,
 ex AS (SELECT replicate, unnest([v for i in range(0,m)]) AS v FROM mu JOIN un USING (protein_name)), st AS (SELECT replicate, quantile_cont(v,0.5) AS md, avg(v) AS mn FROM ex GROUP BY 1)
 SELECT 'median' AS kind, (SELECT round(quantile_cont(v,0.5),9) FROM un) AS point, (SELECT count(*) FROM un) AS n, round(quantile_cont(md,0.025),9) AS stat_lo, round(quantile_cont(md,0.975),9) AS stat_hi, count(*) AS n_replicates FROM st
 UNION ALL SELECT 'mean', (SELECT round(avg(v),9) FROM un), (SELECT count(*) FROM un), round(quantile_cont(mn,0.025),9), round(quantile_cont(mn,0.975),9), count(*) FROM st"""),
)
def met_bootstrap_stat(spark, sf):
    u = views.scores(spark, sf).groupBy("protein_name").agg(F.avg("score_a").alias("v"))
    parts = [bt.bootstrap_stat(u, "protein_name", "v", k, n_boot=N_BOOT).withColumn("kind", F.lit(k)) for k in ("median", "mean")]
    return rounded(parts[0].unionByName(parts[1]), "point", "stat_lo", "stat_hi")


@reg(
    "met_shuffle_control",
    sql("scores", """WITH t AS (SELECT row_id, row_number() OVER (ORDER BY sha256('42|to|'||row_id), row_id) AS rk FROM scores), v AS (SELECT score_c AS x, row_number() OVER (ORDER BY sha256('42|'||row_id), row_id) AS rk FROM scores),
 j AS (SELECT protein_name, binding_label, score_c, x FROM scores JOIN t USING (row_id) JOIN v USING (rk)), lg AS (SELECT protein_name, binding_label, 'real' AS kind, score_c AS s FROM j UNION ALL SELECT protein_name, binding_label, 'shuffled', x FROM j),
 """ + auc_sql("w", "lg", "kind", "s") + ", " + auc_sql("g", "lg", "kind, protein_name", "s") + """, md AS (SELECT kind, quantile_cont(auroc,0.5) AS gm FROM g GROUP BY 1), z AS (SELECT w.kind, auroc, gm FROM w JOIN md USING (kind))
 SELECT round(a.auroc,9) AS auroc_real, round(b.auroc,9) AS auroc_shuffled, round(a.gm,9) AS median_real, round(b.gm,9) AS median_shuffled, round(a.auroc-b.auroc,9) AS delta_auroc, round(a.gm-b.gm,9) AS delta_median FROM z a, z b WHERE a.kind='real' AND b.kind='shuffled'"""),
)
def met_shuffle_control(spark, sf):
    s = views.scores(spark, sf)
    j = s.join(mt.permute_column(s, "row_id", "score_c"), "row_id")
    return rounded(mt.shuffle_control(j, "score_c", "score_c_shuffled"), "auroc_real", "auroc_shuffled", "median_real", "median_shuffled", "delta_auroc", "delta_median")


def spearman_sql(name, table, group, x, y, min_n):
    g, p = (f"{group},", f"PARTITION BY {group}") if group else ("", "")
    px, py = (f"PARTITION BY {group}, {x}", f"PARTITION BY {group}, {y}") if group else (f"PARTITION BY {x}", f"PARTITION BY {y}")
    return f"""{name}_r AS (SELECT {g} rank() OVER ({p} ORDER BY {x})+(count(*) OVER ({px})-1)/2.0::DOUBLE AS rx, rank() OVER ({p} ORDER BY {y})+(count(*) OVER ({py})-1)/2.0::DOUBLE AS ry FROM {table}),
 {name} AS (SELECT {g} count(*) AS n, CASE WHEN count(*)>={min_n} THEN corr(rx,ry) END AS rho FROM {name}_r {'GROUP BY '+group if group else ''})"""


@reg("met_spearman", sql("scores", "WITH " + spearman_sql("s", "scores", "protein_name", "score_a", "score_c", 580) + " SELECT protein_name, n, round(rho,9)+0.0::DOUBLE AS rho FROM s"))
def met_spearman(spark, sf):
    return rounded(mt.spearman(views.scores(spark, sf), "protein_name", "score_a", "score_c", min_n=580), "rho")


PROF = """WITH kc AS (SELECT {g} AS grp, kmer, sum(binding_label) AS p, sum(1-binding_label) AS n FROM (SELECT {g}, binding_label, unnest([substr(rna_sequence,i,{k}) for i in range(1,length(rna_sequence)-{k}+2)]) AS kmer FROM pairs) GROUP BY ALL),
 al AS (SELECT unnest(['A','C','G','U']) AS x), wd AS (SELECT {words} AS kmer FROM {froms}), gr AS (SELECT DISTINCT {g} AS grp FROM pairs),
 fl AS (SELECT grp, kmer, coalesce(p,0)+1.0::DOUBLE AS p, coalesce(n,0)+1.0::DOUBLE AS n FROM gr CROSS JOIN wd LEFT JOIN kc USING (grp, kmer)),
 pf AS (SELECT grp, kmer, log2((p/sum(p) OVER w)/(n/sum(n) OVER w)) AS v FROM fl WINDOW w AS (PARTITION BY grp))"""


def prof_sql(group: str, k: int) -> str:
    al = [f"a{i}" for i in range(k)]
    return PROF.format(g=group, k=k, words="||".join(f"{a}.x" for a in al), froms=", ".join(f"al {a}" for a in al))


def profiles(spark, sf, group="experiment_id", k=4):
    return km.kmer_profile(views.pairs(spark, sf), group, "rna_sequence", k)


@reg(
    "met_topk_overlap",
    sql("pairs", prof_sql("protein_name", 4) + """, a AS (SELECT grp, kmer, row_number() OVER (PARTITION BY grp ORDER BY round(v,9) DESC, kmer) AS ra FROM pf QUALIFY ra<=20),
 tot AS (SELECT kmer, sum(p) AS p, sum(n) AS n FROM kc GROUP BY 1), q0 AS (SELECT kmer, coalesce(p,0)+1.0::DOUBLE AS p, coalesce(n,0)+1.0::DOUBLE AS n FROM wd LEFT JOIN tot USING (kmer)), q1 AS (SELECT kmer, log2((p/sum(p) OVER ())/(n/sum(n) OVER ())) AS v FROM q0),
 b AS (SELECT kmer, row_number() OVER (ORDER BY round(v,9) DESC, kmer) AS rb FROM q1 QUALIFY rb<=20)
 SELECT grp AS protein_name, round(count(rb)/20,9) AS overlap, max(CASE WHEN ra=1 AND rb IS NOT NULL THEN 1 ELSE 0 END) AS top1_hit FROM a LEFT JOIN b USING (kmer) GROUP BY grp"""),
)
def met_topk_overlap(spark, sf):
    p = profiles(spark, sf, "protein_name").select("protein_name", "kmer", rd("profile").alias("score"))
    pooled = km.pooled_profile(views.pairs(spark, sf), "rna_sequence", 4).select("kmer", rd("profile").alias("score"))
    words = pooled.agg(F.collect_list(F.struct("kmer", "score"))).scalar()
    prior = p.select("protein_name").distinct().withColumn("_w", words).select("protein_name", F.explode("_w").alias("_w")).select("protein_name", "_w.*")
    return rounded(mt.topk_overlap(p, prior, "protein_name", 20), "overlap")


@reg("met_profile_corr", sql("pairs", prof_sql("experiment_id", 4) + """ SELECT a.grp AS a, b.grp AS b, round(corr(a.v,b.v),9)+0.0::DOUBLE AS r FROM pf a JOIN pf b ON a.kmer=b.kmer AND a.grp<b.grp GROUP BY 1,2"""))
def met_profile_corr(spark, sf):
    return rounded(mt.profile_corr(profiles(spark, sf), "experiment_id", "kmer", "profile"), "r")


def pair_table(spark, sf, digits=9):
    """Experiment pairs: profile correlations at two word lengths, and family."""
    x = mt.profile_corr(profiles(spark, sf, "experiment_id", 3), "experiment_id", "kmer", "profile").withColumnRenamed("r", "x")
    y = mt.profile_corr(profiles(spark, sf, "experiment_id", 4), "experiment_id", "kmer", "profile").withColumnRenamed("r", "y")
    fam = lambda c: F.regexp_extract(c, "^(src[0-9])", 1)
    j = x.join(y, ["a", "b"]).withColumns(
        {"x": F.round("x", 9), "y": F.round("y", digits) if digits else F.col("y"), "same_family": (fam("a") == fam("b")).cast("int")}
    )
    return cut_lineage(j)


PAIRTAB = prof_sql("experiment_id", 4) + """, c3 AS (SELECT grp AS grp, substr(kmer,1,3) AS kmer FROM kc WHERE false),
 k3 AS (SELECT experiment_id AS grp, kmer, sum(binding_label) AS p, sum(1-binding_label) AS n FROM (SELECT experiment_id, binding_label, unnest([substr(rna_sequence,i,3) for i in range(1,length(rna_sequence)-1)]) AS kmer FROM pairs) GROUP BY ALL),
 w3 AS (SELECT a.x||b.x||c.x AS kmer FROM al a, al b, al c), f3 AS (SELECT grp, kmer, coalesce(p,0)+1.0::DOUBLE AS p, coalesce(n,0)+1.0::DOUBLE AS n FROM gr CROSS JOIN w3 LEFT JOIN k3 USING (grp,kmer)),
 p3 AS (SELECT grp, kmer, log2((p/sum(p) OVER w)/(n/sum(n) OVER w)) AS v FROM f3 WINDOW w AS (PARTITION BY grp)),
 tx AS (SELECT a.grp AS a, b.grp AS b, round(corr(a.v,b.v),9) AS x FROM p3 a JOIN p3 b ON a.kmer=b.kmer AND a.grp<b.grp GROUP BY 1,2), ty AS (SELECT a.grp AS a, b.grp AS b, round(corr(a.v,b.v),9) AS y FROM pf a JOIN pf b ON a.kmer=b.kmer AND a.grp<b.grp GROUP BY 1,2),
 pt AS (SELECT a, b, x, y, CASE WHEN regexp_extract(a,'^(src[0-9])',1)=regexp_extract(b,'^(src[0-9])',1) THEN 1 ELSE 0 END AS same_family FROM tx JOIN ty USING (a,b))"""

SIMBIN = "CASE WHEN x<=0 THEN 'no_hit' WHEN x<0.3 THEN '<30%' WHEN x<0.5 THEN '30-50%' WHEN x<0.7 THEN '50-70%' WHEN x<0.9 THEN '70-90%' ELSE '>=90%' END"


@reg(
    "met_similarity_curve",
    sql("pairs", PAIRTAB.replace("round(corr(a.v,b.v),9) AS y", "corr(a.v,b.v) AS y") + f""", lg AS (SELECT {SIMBIN} AS identity_bin, a||'|'||b AS pair_id, y, unnest(['all', CASE same_family WHEN 1 THEN 'same_family' ELSE 'different_family' END]) AS subset FROM pt),
 ix AS (SELECT *, row_number() OVER (PARTITION BY subset, identity_bin ORDER BY pair_id)-1 AS idx, count(*) OVER (PARTITION BY subset, identity_bin) AS n FROM lg),
 dr AS (SELECT subset, identity_bin, b AS replicate, ('0x'||substr(sha256('42|'||b||'|'||idx),1,8))::BIGINT % n AS idx FROM ix, range(0,{N_BOOT}) r(b)),
 st AS (SELECT dr.subset, dr.identity_bin, replicate, quantile_cont(y,0.5) AS m FROM dr JOIN ix USING (subset, identity_bin, idx) GROUP BY 1,2,3), po AS (SELECT subset, identity_bin, quantile_cont(y,0.5) AS point, count(*) AS n FROM lg GROUP BY 1,2)
 SELECT subset, identity_bin, n, round(any_value(point),9) AS point, round(quantile_cont(m,0.025),9) AS stat_lo, round(quantile_cont(m,0.975),9) AS stat_hi FROM po JOIN st USING (subset, identity_bin) GROUP BY subset, identity_bin, n"""),
)
def met_similarity_curve(spark, sf):
    from pairloom.functions import identity_bin

    p = pair_table(spark, sf, digits=None).withColumns({"identity_bin": identity_bin("x"), "pair_id": F.concat_ws("|", "a", "b")})
    c = bt.similarity_curve(p, value="y", n_boot=N_BOOT)
    return rounded(c.drop("n_replicates"), "point", "stat_lo", "stat_hi")


@reg(
    "met_mantel",
    sql("pairs", PAIRTAB + """, nd AS (SELECT a AS node FROM pt UNION SELECT b FROM pt), ix AS (SELECT node, row_number() OVER (ORDER BY node)-1 AS idx FROM nd),
 pm AS (SELECT b AS replicate, node, row_number() OVER (PARTITION BY b ORDER BY sha256('42|'||node), node)-1 AS idx FROM nd, range(1,200) r(b) UNION ALL SELECT 0, node, idx FROM ix),
 pn AS (SELECT replicate, pm.node, ix.node AS dst FROM pm JOIN ix USING (idx)),
 mv AS (SELECT u.replicate, least(u.dst,v.dst) AS a, greatest(u.dst,v.dst) AS b, y FROM pt JOIN pn u ON u.node=pt.a JOIN pn v ON v.node=pt.b AND v.replicate=u.replicate),
 jj AS (SELECT mv.replicate, pt.x, mv.y FROM mv JOIN pt USING (a,b)), """ + spearman_sql("s", "jj", "replicate", "x", "y", 3) + """
 SELECT round((SELECT rho FROM s WHERE replicate=0),9) AS rho, round((sum(CASE WHEN abs(rho)>=abs((SELECT rho FROM s WHERE replicate=0))-1e-12 THEN 1 ELSE 0 END)+1)/(count(*)+1),9) AS p_value, count(*) AS n_perm FROM s WHERE replicate>0"""),
)
def met_mantel(spark, sf):
    return rounded(bt.mantel(pair_table(spark, sf), n_perm=199), "rho", "p_value")


@reg(
    "met_node_bootstrap",
    sql("pairs", PAIRTAB + ", nd AS (SELECT a AS node FROM pt UNION SELECT b FROM pt), " + draws_sql("nd", "node", N_BOOT) + """,
 lg AS (SELECT 'fine' AS layer, a, b, x, y FROM pt UNION ALL SELECT 'family', a, b, same_family::DOUBLE, y FROM pt),
 ex AS (SELECT layer, u.replicate, x, y, unnest(range(0, u.m*v.m)) AS z FROM lg JOIN mu u ON u.node=lg.a JOIN mu v ON v.node=lg.b AND v.replicate=u.replicate),
 """ + spearman_sql("s", "ex", "layer, replicate", "x", "y", 3) + """, df AS (SELECT s.layer, s.rho, s.rho-f.rho AS diff FROM s JOIN s f ON f.replicate=s.replicate AND f.layer='family')
 SELECT layer, round(avg(rho),9) AS rho_mean, round(quantile_cont(rho,0.025),9) AS rho_lo, round(quantile_cont(rho,0.975),9) AS rho_hi, round(quantile_cont(diff,0.025),9)+0.0::DOUBLE AS diff_lo, round(quantile_cont(diff,0.975),9)+0.0::DOUBLE AS diff_hi FROM df GROUP BY layer"""),
)
def met_node_bootstrap(spark, sf):
    p = pair_table(spark, sf)
    long = p.select("a", "b", "x", "y", F.lit("fine").alias("layer")).unionByName(
        p.select("a", "b", F.col("same_family").cast("double").alias("x"), "y", F.lit("family").alias("layer"))
    )
    return rounded(bt.node_bootstrap(long, N_BOOT, ref="family"), "rho_mean", "rho_lo", "rho_hi", "diff_lo", "diff_hi")


@reg(
    "met_nearest_neighbour",
    sql("pairs", PAIRTAB + """, bo AS (SELECT a AS q, b AS t, x, y FROM pt UNION ALL SELECT b, a, x, y FROM pt), nx AS (SELECT q, y AS by_x FROM bo QUALIFY row_number() OVER (PARTITION BY q ORDER BY x DESC, t DESC)=1),
 g AS (SELECT q, max(y) AS o, avg(y) AS r FROM bo GROUP BY 1) SELECT round(quantile_cont(by_x,0.5),9) AS by_x, round(quantile_cont(o,0.5),9) AS oracle, round(quantile_cont(r,0.5),9) AS random, count(*) AS n_nodes FROM g JOIN nx USING (q)"""),
)
def met_nearest_neighbour(spark, sf):
    return rounded(bt.nearest_vs_oracle(pair_table(spark, sf), sims=("x",), value="y"), "by_x", "oracle", "random")


@reg("met_decision", sql("scores", "WITH " + auc_sql("m", "scores", "family, protein_name", "score_a") + ", " + auc_sql("f", "scores", "family", "score_a") + """, md AS (SELECT family, quantile_cont(auroc,0.5) AS gm FROM m GROUP BY 1),
 j AS (SELECT family, auroc+0.12::DOUBLE AS a, gm+0.16::DOUBLE AS g FROM f JOIN md USING (family)) SELECT family, round(a,9) AS auroc, round(g,9) AS group_median, CASE WHEN a>=0.7 AND g>=0.65 THEN 'PASS' WHEN a>=0.6 THEN 'WARN' ELSE 'FAIL' END AS status, CASE WHEN a>=0.7 AND g>=0.65 THEN 'signal confirmed' WHEN a>=0.6 THEN 'marginal: look at the flagged groups first' ELSE 'validation failed: do not train on this set' END AS message FROM j"""))
def met_decision(spark, sf):
    s = views.scores(spark, sf)
    med = mt.auroc(s, ["family", "protein_name"], "score_a").groupBy("family").agg((F.percentile("auroc", F.lit(0.5)) + 0.16).alias("group_median"))
    m = mt.auroc(s, "family", "score_a").select("family", (F.col("auroc") + 0.12).alias("auroc")).join(med, "family")
    return rounded(mt.validation_decision(m), "auroc", "group_median")


@reg("met_multiseed", sql("scores", "WITH " + auc_sql("m", "scores", "family, source", "score_c") + """ SELECT family AS model, round(avg(auroc),9) AS mean, round(coalesce(stddev_samp(auroc),0),9) AS std, round(min(auroc),9) AS min, round(max(auroc),9) AS max, count(*) AS n_seeds, string_agg(round(auroc,6)::VARCHAR, ';' ORDER BY source) AS "values" FROM m GROUP BY 1"""))
def met_multiseed(spark, sf):
    r = mt.auroc(views.scores(spark, sf), ["family", "source"], "score_c").select(F.col("family").alias("model"), F.col("source").alias("seed"), "auroc")
    return rounded(mt.aggregate_seeds(r), "mean", "std", "min", "max")


@reg("met_paired_seeds", sql("scores", "WITH " + auc_sql("m", "scores", "family, source", "score_c") + """, d AS (SELECT a.auroc-b.auroc AS d FROM m a JOIN m b USING (source) WHERE a.family='F0' AND b.family='F1')
 SELECT round(avg(d),9)+0.0::DOUBLE AS mean_diff, round(coalesce(stddev_samp(d),0),9) AS std_diff, count(*) AS n_seeds FROM d"""))
def met_paired_seeds(spark, sf):
    r = mt.auroc(views.scores(spark, sf), ["family", "source"], "score_c").select(F.col("family").alias("model"), F.col("source").alias("seed"), "auroc")
    return rounded(mt.paired_seed_difference(r, "F0", "F1"), "mean_diff", "std_diff")


@reg("met_leaderboard", sql("scores", "WITH " + auc_sql("t", "scores", "family", "score_c") + ", " + auc_sql("v", "scores", "family", "score_a") + ", " + auc_sql("g", "scores", "family, protein_name", "score_c") + """,
 md AS (SELECT family, quantile_cont(auroc,0.5) AS gm FROM g GROUP BY 1), r AS (SELECT t.family AS model, t.auroc AS ta, t.auprc AS tp, CASE WHEN t.family='F3' THEN NULL ELSE gm END AS gm, v.auroc AS va FROM t JOIN v USING (family) JOIN md USING (family) UNION ALL SELECT 'reference', 0.51, 0.25, 0.5, NULL),
 s AS (SELECT *, 0.5::DOUBLE*ta+0.3::DOUBLE*tp+0.2::DOUBLE*gm AS sc FROM r) SELECT model, round(sc,9) AS leaderboard_score, round(va-ta,9) AS val_test_gap, row_number() OVER (ORDER BY coalesce(sc,-1e9) DESC, model) AS rank FROM s"""))
def met_leaderboard(spark, sf):
    s = views.scores(spark, sf)
    t = mt.ranking(s, "family", "score_c").select(F.col("family").alias("model"), F.col("auroc").alias("test_auroc"), F.col("auprc").alias("test_auprc"))
    v = mt.auroc(s, "family", "score_a").select(F.col("family").alias("model"), F.col("auroc").alias("best_val_auroc"))
    med = mt.auroc(s, ["family", "protein_name"], "score_c").groupBy(F.col("family").alias("model")).agg(F.percentile("auroc", F.lit(0.5)).alias("gm"))
    m = t.join(v, "model").join(med, "model").withColumn("per_group_median", F.when(F.col("model") != "F3", F.col("gm"))).drop("gm")
    ref = {"model": "reference", "test_auroc": 0.51, "test_auprc": 0.25, "per_group_median": 0.5}
    return rounded(mt.leaderboard(m, ref).select("model", "leaderboard_score", "val_test_gap", "rank"), "leaderboard_score", "val_test_gap")


@reg("met_extremes", sql("scores", "WITH " + auc_sql("m", "scores", "source, protein_name", "score_c") + """ SELECT * FROM (SELECT source AS model, protein_name, round(auroc,9) AS auroc, 'hardest' AS kind, row_number() OVER (PARTITION BY source ORDER BY round(auroc,9), protein_name) AS rk FROM m WHERE auroc IS NOT NULL QUALIFY rk<=10)
 UNION ALL SELECT * FROM (SELECT source, protein_name, round(auroc,9), 'easiest', row_number() OVER (PARTITION BY source ORDER BY round(auroc,9) DESC, protein_name) AS rk FROM m WHERE auroc IS NOT NULL QUALIFY rk<=10)"""))
def met_extremes(spark, sf):
    r = mt.auroc(views.scores(spark, sf), ["source", "protein_name"], "score_c")
    r = r.select(F.col("source").alias("model"), "protein_name", rd("auroc").alias("auroc"))
    return mt.extremes(r)


@reg("met_curves", sql("scores", """WITH c AS (SELECT protein_name, score_a AS threshold, sum(binding_label) AS p, sum(1-binding_label) AS n FROM scores GROUP BY 1,2),
 w AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS fp, sum(p) OVER g AS pt, sum(n) OVER g AS nt FROM c WINDOW o AS (PARTITION BY protein_name ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY protein_name))
 SELECT protein_name, round(threshold,9) AS threshold, round(tp::DOUBLE/pt,9) AS tpr, round(fp::DOUBLE/nt,9) AS fpr, round(tp::DOUBLE/(tp+fp),9) AS precision FROM w"""))
def met_curves(spark, sf):
    return rounded(mt.curves(views.scores(spark, sf), "protein_name", "score_a"), "threshold", "tpr", "fpr", "precision")


@reg("met_eval_integrity", sql("pairs", """WITH g AS (SELECT experiment_id, sum(binding_label) AS p, count(*) AS n, count(*) FILTER (length(rna_sequence)>59) AS l FROM pairs GROUP BY 1),
 a AS (SELECT sum(n)::BIGINT AS n_pairs, sum(p)::BIGINT AS n_pos, (sum(n)-sum(p))::BIGINT AS n_neg, count(*) AS n_groups, count(*) FILTER (p=0 OR p=n) AS n_single_class, sum(l)::BIGINT AS n_long FROM g)
 SELECT *, round(n_pos/n_pairs,9) AS positive_rate, array_to_string([x for x in [CASE WHEN n_pos<10 OR n_neg<10 THEN 'BLOCK:insufficient_classes' END, CASE WHEN n_single_class/n_groups>0.5 THEN 'WARN:single_class_groups' END, CASE WHEN n_long/n_pairs>0.3 THEN 'WARN:window_max_inflation' END, CASE WHEN n_pos/n_pairs>0.6 THEN 'WARN:high_positive_rate' END] if x IS NOT NULL],';') AS issues, CASE WHEN issues LIKE '%BLOCK%' THEN 'BLOCK' WHEN issues<>'' THEN 'WARN' ELSE 'OK' END AS gate FROM a"""))
def met_eval_integrity(spark, sf):
    return rounded(mt.eval_integrity(views.pairs(spark, sf), rna_max=59, group="experiment_id"), "positive_rate")


@reg("met_eval_subsets", sql("scores", "WITH st AS (SELECT *, unnest(CASE WHEN binding_label=1 THEN ['all','curated','vs_F1','vs_F2'] WHEN family='F0' THEN ['all','curated'] WHEN family='F1' THEN ['all','vs_F1'] WHEN family='F2' THEN ['all','vs_F2'] ELSE ['all'] END) AS subset FROM scores), " + auc_sql("m", "st", "subset", "score_c") + """
 SELECT subset, n_pos, n_neg, round(auroc,9) AS auroc, round(auprc,9) AS auprc, round(auprc-n_pos/(n_pos+n_neg),9)+0.0::DOUBLE AS auprc_gain FROM m"""))
def met_eval_subsets(spark, sf):
    s = views.scores(spark, sf)
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    f = F.col("family")
    subsets = (
        F.when(F.col("binding_label") == 1, arr("all", "curated", "vs_F1", "vs_F2")).when(f == "F0", arr("all", "curated"))
        .when(f == "F1", arr("all", "vs_F1")).when(f == "F2", arr("all", "vs_F2")).otherwise(arr("all"))
    )
    return rounded(mt.subset_metrics(s, subsets, "score_c"), "auroc", "auprc", "auprc_gain")
