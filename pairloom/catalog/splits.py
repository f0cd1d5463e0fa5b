"""Queries for splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import functions as fn, views
from pairloom.catalog.registry import rd, register
from pairloom.catalog.sqlviews import sql
from pairloom.operators import sampling as sm, splits as sp

QUERIES: dict = {}
SQL: dict = {}
reg = register(QUERIES, SQL)


@reg(
    "spl_group",
    sql("pairs", """WITH k AS (SELECT DISTINCT rna_sequence FROM pairs),
 r AS (SELECT rna_sequence, row_number() OVER (ORDER BY sha256('42|'||rna_sequence), rna_sequence) AS rk, count(*) OVER () AS n FROM k)
 SELECT rna_sequence, CASE WHEN rk <= round_even(n*0.75::DOUBLE,0) THEN 'train' WHEN rk <= round_even(n*0.75::DOUBLE,0)+round_even(n*0.11::DOUBLE,0) THEN 'val' ELSE 'test' END AS split FROM r"""),
)
def spl_group(spark, sf):
    return sp.group_split_map(views.pairs(spark, sf), "rna_sequence")


@reg(
    "spl_stratified",
    sql("scores", """WITH c AS (SELECT rna_id, source, count(*) AS c FROM scores GROUP BY ALL),
 m AS (SELECT rna_id, source AS stratum FROM c QUALIFY row_number() OVER (PARTITION BY rna_id ORDER BY c DESC, source)=1),
 r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42|'||rna_id), rna_id) AS rk, count(*) OVER (PARTITION BY stratum) AS n FROM m)
 SELECT rna_id, stratum, CASE WHEN rk <= greatest(1,round_even(n*0.75::DOUBLE,0)) THEN 'train' WHEN rk <= greatest(1,round_even(n*0.75::DOUBLE,0))+greatest(1,round_even(n*0.11::DOUBLE,0)) THEN 'val' ELSE 'test' END AS split FROM r"""),
)
def spl_stratified(spark, sf):
    return sp.stratified_group_split_map(views.scores(spark, sf), "rna_id", "source")


@reg(
    "spl_strict",
    sql("pairs", """WITH k AS (SELECT DISTINCT experiment_id FROM pairs),
 r AS (SELECT experiment_id, row_number() OVER (ORDER BY sha256('42|'||experiment_id)) AS rk, count(*) OVER () AS n FROM k),
 m AS (SELECT experiment_id, CASE WHEN rk <= round_even(n*0.75::DOUBLE,0) THEN 'train' WHEN rk <= round_even(n*0.75::DOUBLE,0)+round_even(n*0.11::DOUBLE,0) THEN 'val' ELSE 'test' END AS sp FROM r),
 s AS (SELECT p.rna_sequence, m.sp FROM pairs p JOIN m USING (experiment_id)),
 t AS (SELECT DISTINCT rna_sequence FROM s WHERE sp='train'),
 f AS (SELECT s.*, CASE WHEN sp<>'train' AND rna_sequence IN (SELECT rna_sequence FROM t) THEN 1 ELSE 0 END AS hit FROM s)
 SELECT sp AS split, count(*) AS rows_before, sum(1-hit)::BIGINT AS rows_after, count(DISTINCT rna_sequence) AS sequences, count(DISTINCT CASE WHEN hit=1 THEN rna_sequence END) AS sequences_in_train FROM f GROUP BY sp"""),
)
def spl_strict(spark, sf):
    return sp.strict_stats(views.pairs(spark, sf), "experiment_id")


@reg(
    "spl_strict_rows",
    sql("pairs", """WITH k AS (SELECT DISTINCT experiment_id FROM pairs),
 r AS (SELECT experiment_id, row_number() OVER (ORDER BY sha256('42|'||experiment_id)) AS rk, count(*) OVER () AS n FROM k),
 s AS (SELECT pair_id, rna_sequence, CASE WHEN rk <= round_even(n*0.75::DOUBLE,0) THEN 'train' WHEN rk <= round_even(n*0.75::DOUBLE,0)+round_even(n*0.11::DOUBLE,0) THEN 'val' ELSE 'test' END AS split FROM pairs JOIN r USING (experiment_id))
 SELECT pair_id, split FROM s WHERE split='train' OR rna_sequence NOT IN (SELECT rna_sequence FROM s WHERE split='train')"""),
)
def spl_strict_rows(spark, sf):
    return sp.strict_split(views.pairs(spark, sf).drop("split"), "experiment_id").select("pair_id", "split")


CARRY = """WITH old AS (SELECT DISTINCT experiment_id FROM pairs WHERE dataset_source='en' AND binding_label=0),
 r0 AS (SELECT experiment_id, row_number() OVER (ORDER BY sha256('42|'||experiment_id)) AS rk, count(*) OVER () AS n FROM old),
 smap AS (SELECT experiment_id, CASE WHEN rk <= round_even(n*0.75::DOUBLE,0) THEN 'train' WHEN rk <= round_even(n*0.75::DOUBLE,0)+round_even(n*0.11::DOUBLE,0) THEN 'val' ELSE 'test' END AS split FROM r0)"""


def _cut_new(src, key, seed):
    return f"""fr AS (SELECT {key}, row_number() OVER (ORDER BY sha256('{seed}|'||{key}), {key}) AS rk, count(*) OVER () AS n FROM {src}),
 fresh AS (SELECT {key}, CASE WHEN rk <= n-greatest(1,floor(n*0.1::DOUBLE))-greatest(1,floor(n*0.1::DOUBLE)) THEN 'train' WHEN rk <= n-greatest(1,floor(n*0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM fr)"""


@reg(
    "spl_carry_forward",
    sql("pairs", CARRY + """, src AS (SELECT DISTINCT experiment_id FROM pairs WHERE dataset_source NOT IN ('fr') AND experiment_id NOT IN (SELECT experiment_id FROM smap)),
 """ + _cut_new("src", "experiment_id", 42) + """, full_map AS (SELECT * FROM smap UNION ALL SELECT * FROM fresh)
 SELECT pair_id, CASE WHEN dataset_source='fr' THEN 'train' ELSE m.split END AS split FROM pairs p LEFT JOIN full_map m USING (experiment_id)"""),
)
def spl_carry_forward(spark, sf):
    p = views.pairs(spark, sf)
    old = p.where((F.col("dataset_source") == "en") & (F.col("binding_label") == 0))
    smap = sp.group_split_map(old, "experiment_id")
    return sp.carry_forward(p, smap, ["fr"], key="experiment_id").select("pair_id", "split")


@reg(
    "spl_homology",
    sql("hits", """WITH q AS (SELECT DISTINCT target AS protein_name FROM hits), known AS (SELECT DISTINCT query AS k FROM hits),
 r0 AS (SELECT k, row_number() OVER (ORDER BY sha256('42|'||k)) AS rk, count(*) OVER () AS n FROM known),
 smap AS (SELECT k, CASE WHEN rk <= round_even(n*0.75::DOUBLE,0) THEN 'train' WHEN rk <= round_even(n*0.75::DOUBLE,0)+round_even(n*0.11::DOUBLE,0) THEN 'val' ELSE 'test' END AS s FROM r0),
 blocked AS (SELECT DISTINCT target AS protein_name FROM hits h JOIN smap ON smap.k=h.query WHERE s<>'train' AND fident>=0.8 AND qcov>=0.95),
 src AS (SELECT protein_name FROM q WHERE protein_name NOT IN (SELECT protein_name FROM blocked)),
 """ + _cut_new("src", "protein_name", 42) + """
 SELECT q.protein_name, coalesce(CASE WHEN b.protein_name IS NOT NULL THEN 'train' END, f.split) AS split, CASE WHEN b.protein_name IS NOT NULL THEN 'homolog_blocked' ELSE 'new' END AS rule
 FROM q LEFT JOIN blocked b USING (protein_name) LEFT JOIN fresh f USING (protein_name)"""),
)
def spl_homology(spark, sf):
    h = views.hits(spark, sf)
    known = h.select(F.col("query").alias("protein_name"))
    smap = sp.group_split_map(known, "protein_name")
    panel = h.select(F.col("target").alias("protein_name"))
    strong = h.where((F.col("fident") >= 0.8) & (F.col("qcov") >= 0.95))
    return sp.homology_split_map(panel, smap, strong)


@reg(
    "spl_cluster",
    """WITH RECURSIVE l AS (SELECT 'N'||l_partkey AS query, 'N'||(l_partkey*7%1009+l_suppkey) AS target, l_discount*9 AS fident, l_quantity/50 AS qcov, l_tax*12 AS tcov FROM lineitem),
 k AS (SELECT DISTINCT query, target FROM l WHERE query<>target AND ((fident>=0.85::DOUBLE AND greatest(qcov,tcov)>=0.98::DOUBLE) OR (fident>=0.89::DOUBLE AND greatest(qcov,tcov)>=0.97::DOUBLE))),
 e AS (SELECT query AS a, target AS b FROM k UNION SELECT target, query FROM k), n AS (SELECT query AS node FROM l UNION SELECT target FROM l),
 r AS (SELECT node, node AS cl FROM n UNION SELECT e.b, r.cl FROM r JOIN e ON e.a=r.node WHERE r.cl < e.b)
 SELECT node, min(cl) AS cluster FROM r GROUP BY node""",
)
def spl_cluster(spark, sf):
    h = views.links(spark, sf)
    strong = sp.link_filter(h, min_id=0.85, cov=0.98, hi_id=0.89, hi_cov=0.97)
    nodes = h.select(F.col("query").alias("node")).union(h.select("target"))
    return sp.connected_clusters(nodes, strong)


@reg(
    "spl_family_alloc",
    sql("names", """WITH c AS (SELECT protocol || '|' || native_name AS cluster_id, domain_class AS family, sum(size)::BIGINT AS n_rows FROM names GROUP BY ALL),
 c2 AS (SELECT cluster_id || '|' || family AS cluster_id, family, n_rows, sum(n_rows) OVER (PARTITION BY family) AS tot FROM c),
 c3 AS (SELECT *, CASE WHEN n_rows > 0.5::DOUBLE*0.12::DOUBLE*tot THEN 0 ELSE n_rows END AS w FROM c2),
 p AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY family ORDER BY sha256('42|'||cluster_id), cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM c3),
 t AS (SELECT family, coalesce(sum(w) FILTER (w>0 AND before < 0.12::DOUBLE*tot),0) AS t FROM p GROUP BY family)
 SELECT cluster_id, p.family, n_rows, CASE WHEN p.family='PROMO' THEN 'test' WHEN w=0 THEN 'train' WHEN before < 0.12::DOUBLE*tot THEN 'test' WHEN before-t < 0.11::DOUBLE*tot THEN 'val' ELSE 'train' END AS split FROM p JOIN t USING (family)"""),
)
def spl_family_alloc(spark, sf):
    n = views.names(spark, sf)
    c = n.groupBy("protocol", "native_name", F.col("domain_class").alias("family")).agg(F.sum("size").alias("n_rows"))
    c = c.select(F.concat_ws("|", "protocol", "native_name", "family").alias("cluster_id"), "family", "n_rows")
    return sp.allocate_clusters(c, holdout="PROMO")


@reg(
    "spl_rows3",
    sql("pairs", """WITH g AS (SELECT experiment_id FROM pairs GROUP BY 1 HAVING sum(binding_label)>=5 AND sum(1-binding_label)>=5),
 r AS (SELECT pair_id, experiment_id, binding_label, row_number() OVER (PARTITION BY experiment_id, binding_label ORDER BY sha256('42|'||pair_id), pair_id) AS rk, count(*) OVER (PARTITION BY experiment_id, binding_label) AS n FROM pairs WHERE experiment_id IN (SELECT experiment_id FROM g)),
 s AS (SELECT *, round_even(n*0.2::DOUBLE,0) AS nt FROM r), u AS (SELECT *, round_even((n-nt)*0.25::DOUBLE,0) AS nv FROM s)
 SELECT pair_id, CASE WHEN rk <= n-nt-nv THEN 'train' WHEN rk <= n-nt THEN 'val' ELSE 'test' END AS split FROM u"""),
)
def spl_rows3(spark, sf):
    return sp.stratified_rows(views.pairs(spark, sf), "experiment_id", "pair_id").select("pair_id", "split")


@reg(
    "spl_kfold",
    sql("pairs", """WITH a AS (SELECT pair_id, rna_sequence, (row_number() OVER (PARTITION BY binding_label ORDER BY sha256('42|'||pair_id), pair_id)-1)%5 AS stratified_fold FROM pairs),
 g AS (SELECT rna_sequence, (row_number() OVER (ORDER BY sha256('42|'||rna_sequence), rna_sequence)-1)%5 AS group_fold FROM (SELECT DISTINCT rna_sequence FROM pairs))
 SELECT pair_id, stratified_fold, group_fold FROM a JOIN g USING (rna_sequence)"""),
)
def spl_kfold(spark, sf):
    p = views.pairs(spark, sf).select("pair_id", "rna_sequence", "binding_label")
    s = sp.kfold(p, 5, "pair_id", label="binding_label").withColumnRenamed("fold", "stratified_fold")
    g = sp.kfold(s, 5, "pair_id", by="rna_sequence").withColumnRenamed("fold", "group_fold")
    return g.select("pair_id", "stratified_fold", "group_fold")


@reg(
    "spl_holdout_unit",
    sql("pairs", """WITH n AS (SELECT pair_id, string_split('doc'||doc_id||'|'||pair_id,'|')[1] AS unit FROM pairs),
 u AS (SELECT unit, row_number() OVER (ORDER BY sha256('42|'||unit), unit) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT unit FROM n))
 SELECT pair_id, n.unit, CASE WHEN rk <= greatest(1,floor(u.n*0.2::DOUBLE)) THEN 1 ELSE 0 END AS held_out FROM n JOIN u USING (unit)"""),
)
def spl_holdout_unit(spark, sf):
    p = views.pairs(spark, sf).select(
        "pair_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("|"), F.col("pair_id")).alias("full_name")
    )
    return sp.holdout_units(p.select("pair_id", sp.unit_of("full_name").alias("unit")), "unit")


@reg(
    "smp_stratified",
    sql("pairs", """WITH r AS (SELECT pair_id, row_number() OVER (PARTITION BY protein_name, binding_label ORDER BY sha256('42|'||pair_id), pair_id) AS rk, count(*) OVER (PARTITION BY protein_name, binding_label) AS n, count(*) OVER () AS t FROM pairs)
 SELECT pair_id FROM r WHERE t <= 5000 OR rk <= greatest(1, round_even(5000*n/t::DOUBLE,0))"""),
)
def smp_stratified(spark, sf):
    p = views.pairs(spark, sf)
    return sm.stratified_cap(p, 5000, ["protein_name", "binding_label"], "pair_id").select("pair_id")


@reg(
    "smp_group_cap",
    sql("scores", "SELECT protein_name, row_id FROM scores QUALIFY row_number() OVER (PARTITION BY protein_name ORDER BY sha256('42|'||row_id), row_id) <= 50"),
)
def smp_group_cap(spark, sf):
    return sm.group_cap(views.scores(spark, sf), "protein_name", 50, "row_id").select("protein_name", "row_id")


@reg(
    "smp_quartile",
    sql("intervals", """WITH q AS (SELECT experiment_id, quantile_cont(score,0.25) AS a, quantile_cont(score,0.5) AS b, quantile_cont(score,0.75) AS c FROM intervals GROUP BY 1),
 f AS (SELECT i.experiment_id, name, score, sha256('42|'||name) AS h, CASE WHEN score<=a THEN 0 WHEN score<=b THEN 1 WHEN score<=c THEN 2 ELSE 3 END AS bin FROM intervals i JOIN q USING (experiment_id)),
 r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY experiment_id, bin ORDER BY h, name) <= 15 THEN 1 ELSE 0 END AS first FROM f)
 SELECT experiment_id, name, score FROM r QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY first DESC, h, name) <= 62"""),
)
def smp_quartile(spark, sf):
    return sm.quartile_sample(views.intervals(spark, sf), "experiment_id", "score", "name", 62).select(
        "experiment_id", "name", "score"
    )


@reg("smp_spectrum")
def smp_spectrum(spark, sf):
    p = views.pairs(spark, sf)
    low = p.groupBy("protein_name").agg(F.min("probe_intensity").alias("low"))
    v = p.join(low, "protein_name").withColumn("log_intensity", fn.log_intensity("probe_intensity", "low"))
    out = sm.spectrum_sample(v, "protein_name", "log_intensity", "pair_id", 40)
    return out.select(
        "protein_name", "pair_id", "spectrum_rank", rd("log_intensity").alias("log_intensity"), rd("target_value").alias("target_value")
    )


@reg("smp_gc_match")
def smp_gc_match(spark, sf):
    m = sm.gc_match(views.pairs(spark, sf), "protein_name", "pair_id")
    return m.select("protein_name", "pair_id", "binding_label", rd("gc").alias("gc"))
