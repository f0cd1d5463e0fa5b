"""Queries for aggregations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import functions as fn, views
from pairloom.catalog.functions import TOPK
from pairloom.catalog.joins import TOPLIST, top_lists
from pairloom.catalog.metrics import auc_sql, prof_sql, rounded, spearman_sql
from pairloom.catalog.registry import rd, register
from pairloom.catalog.sqlviews import sql
from pairloom.operators import aggregates as ag, filters as fl, kmers as km, metrics as mt
from pairloom.plans import cut_lineage

QUERIES: dict = {}
SQL: dict = {}
reg = register(QUERIES, SQL)


@reg(
    "agg_validate",
    sql("pairs", """WITH g AS (SELECT experiment_id, min(binding_label) AS a, max(binding_label) AS b FROM pairs GROUP BY 1),
 s AS (SELECT count(*) AS n_rows, count(*) FILTER (binding_label=1) AS n_pos, count(*) FILTER (binding_label=0) AS n_neg, count(*) FILTER (NOT regexp_full_match(rna_sequence,'[AUGC]+')) AS n_invalid, count(*) FILTER (rna_sequence LIKE '%T%') AS n_with_t,
  min(length(rna_sequence)) AS len_min, quantile_cont(length(rna_sequence),0.5) AS len_median, max(length(rna_sequence)) AS len_max, round(avg(CASE WHEN organism IS NULL THEN 1.0::DOUBLE ELSE 0 END),3) AS null_organism FROM pairs)
 SELECT s.*, (SELECT count(*) FROM g) AS n_groups, (SELECT count(*) FROM g WHERE a=b) AS single_class_groups, round(n_pos/n_rows,9) AS pos_rate,
  array_to_string([x for x in [CASE WHEN n_pos<10 THEN 'few_positives' END, CASE WHEN n_pos/n_rows>0.8 THEN 'high_positive_rate' END, CASE WHEN (SELECT count(*) FROM g WHERE a=b)>0 THEN (SELECT count(*) FROM g WHERE a=b)||'_single_class_groups' END] if x IS NOT NULL],';') AS warnings FROM s"""),
)
def agg_validate(spark, sf):
    p = views.pairs(spark, sf).select("experiment_id", "rna_sequence", "binding_label", "organism", "protein_name")
    v = ag.validate_dataset(p, "experiment_id")
    return rounded(v.drop("null_experiment_id", "null_rna_sequence", "null_binding_label", "null_protein_name"), "pos_rate")


GC = "(length(rna_sequence)-length(translate(rna_sequence,'GC','')))/length(rna_sequence)"


@reg(
    "agg_split_stats",
    sql("pairs", f"""WITH g AS (SELECT split, protein_name, min(binding_label) AS a, max(binding_label) AS b FROM pairs GROUP BY 1,2), h AS (SELECT split, count(*) FILTER (a<>b) AS both_class_groups FROM g GROUP BY 1)
 SELECT split, count(*) AS rows, sum(binding_label)::BIGINT AS n_pos, sum(1-binding_label)::BIGINT AS n_neg, round(avg({GC}) FILTER (binding_label=1),9) AS gc_pos, round(avg({GC}) FILTER (binding_label=0),9) AS gc_neg,
  count(DISTINCT protein_name) AS groups, any_value(both_class_groups) AS both_class_groups, count(DISTINCT experiment_id) AS experiments, count(DISTINCT rna_sequence) AS unique_sequences FROM pairs JOIN h USING (split) GROUP BY split"""),
)
def agg_split_stats(spark, sf):
    return rounded(ag.split_stats(views.pairs(spark, sf)), "gc_pos", "gc_neg")


@reg(
    "agg_split_integrity",
    sql("pairs", """WITH t AS (SELECT * FROM pairs WHERE split='train'), c AS (SELECT split, experiment_id, rna_sequence, count(*) AS n, count(DISTINCT binding_label) AS d FROM pairs GROUP BY 1,2,3),
 f AS (SELECT c.*, CASE WHEN rna_sequence IN (SELECT rna_sequence FROM t) THEN n ELSE 0 END AS r, CASE WHEN rna_sequence IN (SELECT rna_sequence FROM t WHERE binding_label=1) THEN n ELSE 0 END AS rp, CASE WHEN experiment_id||rna_sequence IN (SELECT experiment_id||rna_sequence FROM t) THEN n ELSE 0 END AS x FROM c),
 g AS (SELECT split, experiment_id, min(binding_label) AS a, max(binding_label) AS b FROM pairs GROUP BY 1,2), h AS (SELECT split, count(*) AS groups, count(*) FILTER (experiment_id IN (SELECT experiment_id FROM t)) AS groups_in_train, count(*) FILTER (a=b) AS single_class_groups FROM g GROUP BY 1)
 SELECT f.split, sum(n)::BIGINT AS rows, sum(n-d)::BIGINT AS duplicate_rows, count(*) FILTER (d>1) AS conflicting_pairs, round(sum(r)*100/sum(n),9) AS pct_rna_in_train, round(sum(rp)*100/sum(n),9) AS pct_positive_rna_in_train, round(sum(x)*100/sum(n),9) AS pct_pair_in_train,
  any_value(groups) AS groups, any_value(groups_in_train) AS groups_in_train, any_value(single_class_groups) AS single_class_groups FROM f JOIN h USING (split) GROUP BY f.split"""),
)
def agg_split_integrity(spark, sf):
    i = ag.split_integrity(views.pairs(spark, sf), "experiment_id")
    return rounded(i, "pct_rna_in_train", "pct_positive_rna_in_train", "pct_pair_in_train")


@reg(
    "agg_sequence_audit",
    r"""WITH u AS (SELECT DISTINCT replace(CASE WHEN doc_id%3=0 THEN text||'*' ELSE text END,'ß','SS') AS raw FROM documents), a AS (SELECT raw, upper(raw) AS up, regexp_replace(regexp_replace(upper(trim(raw,' ')),'\*+$',''),'[^ACDEFGHIKLMNPQRSTVWY]','','g') AS c FROM u)
 SELECT count(*) AS unique_sequences, count(*) FILTER (regexp_matches(up,'[0-9]')) AS has_digits, count(*) FILTER (up LIKE '%*%') AS has_stop, count(*) FILTER (regexp_matches(up,'[^A-Z0-9*]')) AS has_other, count(*) FILTER (c<>raw) AS changed, count(*) FILTER (c<>'') AS valid_after FROM a""",
)
def agg_sequence_audit(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("*"))).otherwise(F.col("text"))
    d = views.spread(views.table(spark, sf, "documents"), "doc_id").select(F.replace(raw, F.lit("ß"), F.lit("SS")).alias("protein_sequence"))
    return ag.audit_counts(ag.audit_sequences(d))


@reg(
    "agg_fasta_check",
    sql("docs", """WITH e AS (SELECT 'd'||doc_id AS seq_id, prot AS seq FROM docs WHERE lang<>'de'), f AS (SELECT 'd'||doc_id AS seq_id, CASE doc_id%7 WHEN 1 THEN prot||'*' WHEN 2 THEN '7'||prot WHEN 3 THEN lower(prot) WHEN 4 THEN prot||'B' WHEN 5 THEN '' ELSE prot END AS seq FROM docs WHERE lang<>'fr'),
 a AS (SELECT f.seq_id AS fid, e.seq_id AS eid, f.seq AS s, e.seq AS x FROM f FULL OUTER JOIN e ON e.seq_id=f.seq_id),
 p AS (SELECT coalesce(fid,eid) AS seq_id, unnest([y for y in [CASE WHEN fid IS NOT NULL AND eid IS NULL THEN 'extra' END, CASE WHEN fid IS NULL THEN 'expected_missing' END, CASE WHEN s='' THEN 'empty' END, CASE WHEN s LIKE '%*%' THEN 'stop_codon' END, CASE WHEN regexp_matches(s,'[0-9]') THEN 'digits' END,
   CASE WHEN regexp_matches(upper(s),'[^ACDEFGHIKLMNPQRSTVWY*0-9]') THEN 'invalid_characters' END, CASE WHEN regexp_matches(s,'[a-z]') THEN 'lowercase' END, CASE WHEN eid IS NOT NULL AND fid IS NOT NULL AND s<>x THEN 'mismatch' END] if y IS NOT NULL]) AS problem FROM a)
 SELECT seq_id, problem, CASE WHEN problem IN ('lowercase','extra') THEN 'WARN' ELSE 'FAIL' END AS level FROM p"""),
)
def agg_fasta_check(spark, sf):
    d = views.docs(spark, sf)
    i = F.col("doc_id")
    sid = F.concat(F.lit("d"), i.cast("string")).alias("seq_id")
    s = F.col("prot")
    seq = (
        F.when(i % 7 == 1, F.concat(s, F.lit("*"))).when(i % 7 == 2, F.concat(F.lit("7"), s)).when(i % 7 == 3, F.lower(s))
        .when(i % 7 == 4, F.concat(s, F.lit("B"))).when(i % 7 == 5, F.lit("")).otherwise(s)
    )
    return ag.check_fasta(d.where("lang <> 'fr'").select(sid, seq.alias("seq")), d.where("lang <> 'de'").select(sid, s.alias("seq")))


def pres_sql(g, k):
    return f"""tt AS (SELECT {g} AS grp, sum(binding_label) AS n_pos, sum(1-binding_label) AS n_neg FROM pairs GROUP BY 1),
 ps AS (SELECT {g} AS grp, kmer, sum(binding_label) AS pos_with, sum(1-binding_label) AS neg_with FROM (SELECT {g}, binding_label, unnest(list_distinct([substr(rna_sequence,i,{k}) for i in range(1,length(rna_sequence)-{k}+2)])) AS kmer FROM pairs) GROUP BY ALL HAVING sum(binding_label)>0),
 pe AS (SELECT grp, kmer, pos_with, neg_with, (pos_with::DOUBLE/n_pos)/((neg_with+1)::DOUBLE/greatest(n_neg,1)) AS e FROM ps JOIN tt USING (grp))"""


@reg("agg_kmer_presence", sql("pairs", "WITH " + pres_sql("protein_name", 5) + " SELECT grp AS protein_name, kmer, pos_with::BIGINT AS pos_with, neg_with::BIGINT AS neg_with, round(e,9) AS enrichment FROM pe"))
def agg_kmer_presence(spark, sf):
    r = km.kmer_presence(views.pairs(spark, sf), "protein_name", "rna_sequence", 5)
    return rounded(r.select("protein_name", "kmer", "pos_with", "neg_with", "enrichment"), "enrichment")


LOG2 = """WITH c AS (SELECT dataset_source, kmer, sum(binding_label) AS p, sum(1-binding_label) AS n FROM (SELECT dataset_source, binding_label, unnest([substr(rna_sequence,i,6) for i in range(1,length(rna_sequence)-4)]) AS kmer FROM pairs) GROUP BY ALL),
 l AS (SELECT dataset_source, kmer, log2(((p+0.5::DOUBLE)/greatest(sum(p) OVER w,1))/((n+0.5::DOUBLE)/greatest(sum(n) OVER w,1))) AS v FROM c WINDOW w AS (PARTITION BY dataset_source))"""


@reg("agg_kmer_log2", sql("pairs", LOG2 + " SELECT dataset_source, kmer, round(v,9)+0.0::DOUBLE AS log2_ratio, row_number() OVER (PARTITION BY dataset_source ORDER BY round(v,9) DESC, kmer) AS rk FROM l QUALIFY rk<=50"))
def agg_kmer_log2(spark, sf):
    r = km.kmer_log2(views.pairs(spark, sf), "dataset_source", "rna_sequence", 6).withColumn("log2_ratio", rd("log2_ratio"))
    return km.top_kmers(r, "dataset_source", "log2_ratio", 50).select("dataset_source", "kmer", "log2_ratio", "rk")


@reg("agg_kmer_profile", sql("pairs", prof_sql("protein_name", 5) + " SELECT grp AS protein_name, kmer, round(v,9)+0.0::DOUBLE AS profile FROM pf"))
def agg_kmer_profile(spark, sf):
    p = km.kmer_profile(views.pairs(spark, sf), "protein_name", "rna_sequence", 5)
    return p.select("protein_name", "kmer", rd("profile").alias("profile"))


@reg("agg_top_kmers", sql("pairs", TOPLIST + " SELECT protein_name, protocol, kmer, n, row_number() OVER (PARTITION BY protein_name, protocol ORDER BY n DESC, kmer) AS rk FROM tk"))
def agg_top_kmers(spark, sf):
    return top_lists(spark, sf)


POOL = "WITH " + pres_sql("protein_name", 6) + """, pc AS (SELECT protein_name AS grp, kmer, count(*) AS n FROM (SELECT protein_name, unnest([substr(rna_sequence,i,6) for i in range(1,length(rna_sequence)-4)]) AS kmer FROM pairs WHERE binding_label=1) GROUP BY protein_name, kmer QUALIFY row_number() OVER (PARTITION BY protein_name ORDER BY count(*) DESC, kmer)<=10),
 nc AS (SELECT protein_name AS grp, kmer, count(*) AS n FROM (SELECT protein_name, unnest([substr(rna_sequence,i,6) for i in range(1,length(rna_sequence)-4)]) AS kmer FROM pairs WHERE binding_label=0) GROUP BY ALL),
 hh AS (SELECT DISTINCT pair_id, protein_name AS grp, unnest([substr(rna_sequence,i,6) for i in range(1,length(rna_sequence)-4)]) AS kmer FROM pairs),
 sc AS (SELECT pair_id, grp, coalesce(sum(pc.n),0)::BIGINT AS pos_score, coalesce(sum(nc.n),0)::BIGINT AS neg_score, coalesce(max(e),0) AS be FROM hh LEFT JOIN pc USING (grp,kmer) LEFT JOIN nc USING (grp,kmer) LEFT JOIN pe USING (grp,kmer) GROUP BY 1,2)"""


@reg("agg_kmer_pool_scores", sql("pairs", POOL + " SELECT pair_id, grp AS protein_name, pos_score, neg_score, round(be,9) AS best_enrichment FROM sc"))
def agg_kmer_pool_scores(spark, sf):
    return rounded(km.pool_scores(views.pairs(spark, sf), "pair_id", "protein_name", "rna_sequence", 6), "best_enrichment")


def exemplar_rows(spark, sf, n=5):
    p = cut_lineage(views.pairs(spark, sf))
    top = km.top_kmers(km.positive_counts(p, "protein_name", "rna_sequence", 6), "protein_name", "n", 10)
    s = km.pool_scores(p, "pair_id", "protein_name", "rna_sequence", 6)
    return ag.exemplars(p.join(s.drop("protein_name"), "pair_id"), top, "protein_name", "pair_id", n)


EXEMPLAR = POOL + """, ll AS (SELECT grp, list(kmer ORDER BY n DESC, kmer) AS ranked FROM pc GROUP BY 1), mm AS (SELECT p.pair_id, p.protein_name, p.rna_sequence, p.binding_label, pos_score, neg_score, [x for x in coalesce(ranked,[]) if instr(p.rna_sequence,x)>0][1] AS hit FROM pairs p JOIN sc USING (pair_id) LEFT JOIN ll ON ll.grp=p.protein_name),
 md AS (SELECT protein_name, length(rna_sequence) AS l FROM mm WHERE binding_label=1 AND hit IS NOT NULL GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY protein_name ORDER BY count(*) DESC, l)=1),
 ff AS (SELECT mm.* FROM mm JOIN md ON md.protein_name=mm.protein_name AND l=length(rna_sequence)),
 ex AS (SELECT *, 'positive' AS kind, row_number() OVER (PARTITION BY protein_name ORDER BY pos_score DESC, pair_id) AS rank FROM ff WHERE binding_label=1 AND hit IS NOT NULL QUALIFY rank<=5 UNION ALL SELECT *, 'negative', row_number() OVER (PARTITION BY protein_name ORDER BY neg_score DESC, pair_id) AS rank FROM ff WHERE binding_label=0 AND hit IS NULL QUALIFY rank<=5)"""


@reg("agg_exemplars", sql("pairs", EXEMPLAR + " SELECT protein_name, pair_id, rna_sequence, binding_label, kind, rank, coalesce(hit,'-') AS matched_kmer, coalesce(instr(rna_sequence,hit)-1,-1) AS kmer_position, length(rna_sequence) AS probe_length FROM ex"))
def agg_exemplars(spark, sf):
    return exemplar_rows(spark, sf)


@reg(
    "agg_rank_compare",
    sql("pairs", """WITH c AS (SELECT protein_name, dataset_source='en' AS e, kmer, count(*) AS n FROM (SELECT protein_name, dataset_source, unnest([substr(rna_sequence,i,6) for i in range(1,length(rna_sequence)-4)]) AS kmer FROM pairs) GROUP BY ALL), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY protein_name, e ORDER BY n DESC, kmer)<=20),
 a AS (SELECT protein_name, list(kmer ORDER BY kmer) AS x FROM t WHERE e GROUP BY 1), b AS (SELECT protein_name, list(kmer ORDER BY kmer) AS y FROM t WHERE NOT e GROUP BY 1), j AS (SELECT protein_name, coalesce(x,[]) AS x, coalesce(y,[]) AS y FROM a FULL OUTER JOIN b USING (protein_name))
 SELECT protein_name, len(list_intersect(x,y)) AS overlap, round(len(list_intersect(x,y))/nullif(len(x),0),9) AS fraction, round(len(list_intersect(x,y))/nullif(len(list_distinct(list_concat(x,y))),0),9) AS jaccard,
  array_to_string([z for z in x if NOT list_contains(y,z)],';') AS only_a, array_to_string([z for z in y if NOT list_contains(x,z)],';') AS only_b FROM j"""),
)
def agg_rank_compare(spark, sf):
    p = views.pairs(spark, sf)
    en = F.col("dataset_source") == "en"
    top = lambda d: km.top_kmers(
        km.explode_kmers(d, "protein_name", "rna_sequence", [6]).groupBy("protein_name", "kmer").agg(F.count(F.lit(1)).alias("n")), "protein_name", "n", 20
    )
    return rounded(ag.compare_rankings(top(p.where(en)), top(p.where(~en)), "protein_name", "kmer"), "fraction", "jaccard")


@reg(
    "agg_kmer_position",
    sql("pairs", EXEMPLAR + """, po AS (SELECT *, instr(rna_sequence,hit)-1 AS pos, substr(rna_sequence,1,3) AS s3 FROM ex WHERE kind='positive'),
 k1 AS (SELECT protein_name, hit FROM po GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY protein_name ORDER BY count(*) DESC, hit)=1), k2 AS (SELECT protein_name, s3 FROM po GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY protein_name ORDER BY count(*) DESC, s3)=1)
 SELECT po.protein_name, count(*) AS n_positive, count(*) FILTER (pos=0) AS n_pos0, quantile_cont(pos,0.5) AS median_position, round(avg(pos),9) AS mean_position, any_value(k1.hit) AS top_kmer, any_value(k2.s3) AS common_start3, count(*) FILTER (rna_sequence LIKE 'AG%') AS n_start_ag, count(DISTINCT po.s3) AS n_start3,
  count(*) FILTER (pos=0) AS n_motif_at_start, 1 AS reconciled FROM po JOIN k1 USING (protein_name) JOIN k2 USING (protein_name) GROUP BY po.protein_name"""),
)
def agg_kmer_position(spark, sf):
    return rounded(ag.kmer_positions(exemplar_rows(spark, sf), "protein_name").drop("pct_pos0", "pct_start_ag"), "mean_position")


@reg("agg_pair_counts", sql("reads", "SELECT gene1, gene2, count(*) AS n_reads, count(DISTINCT library) AS n_libraries, string_agg(DISTINCT library, ';' ORDER BY library) AS libraries FROM reads WHERE gene1<>gene2 GROUP BY 1,2"))
def agg_pair_counts(spark, sf):
    return ag.pair_counts(views.reads(spark, sf)).orderBy(F.desc("n_reads"), "gene1", "gene2")


RANKING = """WITH m AS (SELECT protein_name, experiment_id, avg(probe_intensity) AS a FROM pairs_seq WHERE binding_label=1 GROUP BY ALL), b AS (SELECT protein_name, experiment_id AS best FROM m QUALIFY row_number() OVER (PARTITION BY protein_name ORDER BY round(a,9) DESC, experiment_id DESC)=1),
 g AS (SELECT p.protein_name, avg(probe_intensity) FILTER (binding_label=1) AS mean_intensity, sum(binding_label)::BIGINT AS n_pos, sum(1-binding_label)::BIGINT AS n_neg, max(length(protein_sequence)) AS protein_length FROM pairs_seq p LEFT JOIN b USING (protein_name) WHERE best IS NULL OR best=experiment_id GROUP BY 1),
 rk AS (SELECT *, row_number() OVER (ORDER BY mean_intensity DESC, protein_name) AS rank FROM g WHERE mean_intensity IS NOT NULL)"""


def ranking(spark, sf):
    return ag.intensity_ranking(views.pairs_keyed(spark, sf))


@reg(
    "agg_mean_intensity",
    sql("pairs_seq", RANKING + ", " + spearman_sql("s", "rk", "", "protein_length", "mean_intensity", 3) + " SELECT protein_name, round(mean_intensity,6) AS mean_intensity, n_pos, n_neg, protein_length, rank, round((SELECT rho FROM s),9)+0.0::DOUBLE AS spearman, round((SELECT corr(protein_length, mean_intensity) FROM rk),9)+0.0::DOUBLE AS pearson FROM rk"),
)
def agg_mean_intensity(spark, sf):
    r = ranking(spark, sf)
    c = ag.length_correlation(r).select(rd("spearman").alias("spearman"), rd("pearson").alias("pearson"))
    return r.select(
        "protein_name", rd("mean_intensity", 6).alias("mean_intensity"), "n_pos", "n_neg", "protein_length", "rank",
        c.select("spearman").scalar().alias("spearman"), c.select("pearson").scalar().alias("pearson"),
    )


@reg(
    "agg_domain_diverse",
    sql("pairs_seq", RANKING + """, mp AS (SELECT DISTINCT 'src'||(p_partkey%20) AS protein_name, ['KH','RRM','PUM','ZF','CSD'][(p_partkey%20)%5+1] AS architecture FROM part UNION SELECT DISTINCT 'src'||((p_partkey%20)), 'SAM' FROM part WHERE p_partkey%20 IN (4,7)),
 pc AS (SELECT protein_name, count(*) AS c, min(architecture) AS architecture FROM mp GROUP BY 1), j AS (SELECT rk.*, architecture FROM rk JOIN pc USING (protein_name) WHERE c=1),
 bb AS (SELECT architecture, protein_name, mean_intensity FROM j QUALIFY row_number() OVER (PARTITION BY architecture ORDER BY mean_intensity DESC, protein_name DESC)=1)
 SELECT architecture, protein_name, round(mean_intensity,6) AS mean_intensity, 'best_of_architecture' AS reason FROM bb UNION ALL SELECT architecture, protein_name, round(mean_intensity,6), 'forced' FROM j WHERE protein_name IN ('src1','src2') AND protein_name NOT IN (SELECT protein_name FROM bb)
 UNION ALL SELECT string_agg(architecture,'|' ORDER BY architecture), protein_name, NULL, 'conflict' FROM mp GROUP BY protein_name HAVING count(*)>1"""),
)
def agg_domain_diverse(spark, sf):
    k = F.col("p_partkey") % 20
    name = F.concat(F.lit("src"), k.cast("string"))
    arch = F.element_at(F.array(*[F.lit(a) for a in ("KH", "RRM", "PUM", "ZF", "CSD")]), (k % 5 + 1).cast("int"))
    part = views.table(spark, sf, "part")
    m = part.select(F.concat(name, F.lit("; "), name).alias("ids"), arch.alias("architecture"))
    m = m.unionByName(part.where(k.isin(4, 7)).select(name.alias("ids"), F.lit("SAM").alias("architecture")))
    picked, conflicts = ag.domain_diverse(ranking(spark, sf), m, include=("src1", "src2"))
    c = conflicts.select(F.col("architectures").alias("architecture"), "protein_name", F.lit(None).cast("double").alias("mean_intensity"), F.lit("conflict").alias("reason"))
    return picked.unionByName(c).withColumn("mean_intensity", rd("mean_intensity", 6))


@reg("agg_crosstab", sql("scores", "SELECT family, count(*) FILTER (source='F') AS \"F\", count(*) FILTER (source='O') AS \"O\" FROM scores GROUP BY family"))
def agg_crosstab(spark, sf):
    return ag.crosstab(views.scores(spark, sf), "family", "source", ["F", "O"])


@reg("agg_by_class", sql("scores", "WITH " + auc_sql("m", "scores", "family, protein_name", "score_c") + ", ov AS (SELECT family, protein_name, avg(score_a) AS overlap FROM scores GROUP BY 1,2) SELECT family, count(auroc) AS n, round(quantile_cont(auroc,0.5),9) AS median, round(avg(auroc),9) AS mean, round(quantile_cont(overlap,0.5),9) AS overlap_median FROM m JOIN ov USING (family, protein_name) GROUP BY family"))
def agg_by_class(spark, sf):
    s = views.scores(spark, sf)
    t = mt.auroc(s, ["family", "protein_name"], "score_c").join(s.groupBy("family", "protein_name").agg(F.avg("score_a").alias("overlap")), ["family", "protein_name"])
    return rounded(ag.transfer_summary(t, "family"), "median", "mean", "overlap_median")


@reg("agg_logo", sql("pairs", "WITH " + TOPK[2:] + " SELECT protein_name, pos-1 AS pos, base, round(p,9) AS p, round(p*(2-sum(-p*log2(greatest(p,1e-9))) OVER (PARTITION BY protein_name, pos)),9) AS bits FROM pwm"))
def agg_logo(spark, sf):
    p = views.pairs(spark, sf)
    top = km.top_kmers(km.positive_counts(p, "protein_name", "rna_sequence", 6), "protein_name", "n", 10)
    return rounded(km.motif_logo(km.motif_matrix(top, "protein_name", "kmer", "n"), "protein_name"), "p", "bits")


@reg(
    "agg_signal_quartiles",
    sql("pairs", f"""WITH d AS (SELECT experiment_id, probe_intensity AS x, {GC} AS y FROM pairs), q AS (SELECT experiment_id, quantile_cont(x,0.25) AS q1, quantile_cont(x,0.75) AS q3 FROM d GROUP BY 1),
 g AS (SELECT d.experiment_id, avg(y) FILTER (x<=q1) AS lo, avg(y) FILTER (x>=q3) AS hi, avg(y) AS mn FROM d JOIN q USING (experiment_id) GROUP BY 1), """ + spearman_sql("s", "d", "experiment_id", "x", "y", 30) + """
 SELECT experiment_id, round(lo,9) AS score_low, round(hi,9) AS score_high, round(mn,9) AS score_mean, n, round(rho,9)+0.0::DOUBLE AS rho FROM g JOIN s USING (experiment_id)"""),
)
def agg_signal_quartiles(spark, sf):
    p = views.pairs(spark, sf).withColumn("gc", fn.gc_fraction("rna_sequence"))
    return rounded(ag.signal_motif_panel(p, "experiment_id", "probe_intensity", "gc"), "score_low", "score_high", "score_mean", "rho")


@reg(
    "agg_error_kmers",
    sql("pairs", f"""WITH o AS (SELECT rna_sequence, binding_label AS y, CASE WHEN {GC}>=0.5 THEN 1 ELSE 0 END AS h FROM pairs), c AS (SELECT rna_sequence, CASE WHEN y=0 THEN 'FP_vs_TN' ELSE 'FN_vs_TP' END AS comparison, CASE WHEN y<>h THEN 1 ELSE 0 END AS e FROM o),
 k AS (SELECT comparison, kmer, sum(e) AS p, sum(1-e) AS n FROM (SELECT comparison, e, unnest([substr(rna_sequence,i,6) for i in range(1,length(rna_sequence)-4)]) AS kmer FROM c) GROUP BY 1,2),
 l AS (SELECT comparison, kmer, round(log2(((p+0.5::DOUBLE)/greatest(sum(p) OVER w,1))/((n+0.5::DOUBLE)/greatest(sum(n) OVER w,1))),9) AS log2_ratio FROM k WINDOW w AS (PARTITION BY comparison))
 SELECT comparison, kmer, log2_ratio, row_number() OVER (PARTITION BY comparison ORDER BY log2_ratio DESC, kmer) AS rk FROM l QUALIFY rk<=15"""),
)
def agg_error_kmers(spark, sf):
    p = views.pairs(spark, sf).withColumn("gc", fn.gc_fraction("rna_sequence"))
    return ag.error_kmers(p, "gc", "pair_id").select("comparison", "kmer", "log2_ratio", "rk")


@reg(
    "agg_score_trend",
    sql("docs", """WITH l AS (SELECT doc_id, n_chars::DOUBLE AS s, unnest(['rna_len','prot_len','gc']) AS feature, unnest([length(rna)::DOUBLE, length(prot)::DOUBLE, (length(rna)-length(translate(rna,'GC','')))/length(rna)]) AS x FROM docs WHERE length(rna)>0),
 b AS (SELECT feature, s, least(floor((x-min(x) OVER w)/(max(x) OVER w-min(x) OVER w)*30),29)::INT AS bin FROM l WINDOW w AS (PARTITION BY feature)) SELECT feature, bin, quantile_cont(s,0.5) AS median_score, count(*) AS n FROM b GROUP BY 1,2"""),
)
def agg_score_trend(spark, sf):
    d = views.docs(spark, sf).where(F.length("rna") > 0).withColumn("score", F.col("n_chars").cast("double"))
    feats = {"rna_len": F.length("rna"), "prot_len": F.length("prot"), "gc": fn.gc_fraction("rna")}
    return ag.score_trend(d, "score", feats, 30)


TRANSFER = """, l AS (SELECT protein_name, protocol, list(kmer) AS w FROM tk GROUP BY ALL), t AS (SELECT a.protein_name, a.protocol AS train_protocol, b.protocol AS test_protocol, len(list_intersect(a.w,b.w))/20.0::DOUBLE AS auroc FROM l a JOIN l b ON a.protein_name=b.protein_name AND a.protocol<>b.protocol)"""


def transfer_rows(spark, sf):
    l = top_lists(spark, sf).groupBy("protein_name", "protocol").agg(F.collect_set("kmer").alias("w"))
    side = lambda p: l.select("protein_name", F.col("protocol").alias(f"{p}_protocol"), F.col("w").alias(f"w_{p}"))
    j = side("train").join(side("test"), "protein_name").where("train_protocol <> test_protocol")
    return j.select("protein_name", "train_protocol", "test_protocol", (F.size(F.array_intersect("w_train", "w_test")) / 20.0).alias("auroc"))


@reg(
    "agg_transfer_pivot",
    sql("pairs", TOPLIST + TRANSFER + """ SELECT train_protocol, round(quantile_cont(auroc,0.5) FILTER (test_protocol='de'),9) AS de_median, count(auroc) FILTER (test_protocol='de') AS de_n, round(quantile_cont(auroc,0.5) FILTER (test_protocol='en'),9) AS en_median, count(auroc) FILTER (test_protocol='en') AS en_n,
 round(quantile_cont(auroc,0.5) FILTER (test_protocol='fr'),9) AS fr_median, count(auroc) FILTER (test_protocol='fr') AS fr_n FROM t GROUP BY 1"""),
)
def agg_transfer_pivot(spark, sf):
    p = ag.transfer_pivot(transfer_rows(spark, sf), ["de", "en", "fr"])
    p = p.na.fill(0, ["de_n", "en_n", "fr_n"])
    return rounded(p, "de_median", "en_median", "fr_median")


@reg(
    "agg_transfer_within",
    sql("pairs", TOPLIST + TRANSFER + """, w AS (SELECT protein_name, protocol, avg(n) AS a FROM tk WHERE protocol<>'fr' GROUP BY 1,2)
 SELECT t.protein_name, t.train_protocol, t.test_protocol, round(t.auroc,9) AS auroc, round(x.a,9) AS within_train, round(y.a,9) AS within_test, round(CASE WHEN x.a IS NULL THEN y.a WHEN y.a IS NULL THEN x.a ELSE (x.a+y.a)/2 END,9) AS within_mean
 FROM t LEFT JOIN w x ON x.protein_name=t.protein_name AND x.protocol=train_protocol LEFT JOIN w y ON y.protein_name=t.protein_name AND y.protocol=test_protocol"""),
)
def agg_transfer_within(spark, sf):
    w = top_lists(spark, sf).where("protocol <> 'fr'").groupBy("protein_name", "protocol").agg(F.avg("n").alias("auroc"))
    return rounded(ag.transfer_with_within(transfer_rows(spark, sf), w, "protein_name"), "auroc", "within_train", "within_test", "within_mean")


@reg(
    "agg_model_wins",
    sql("scores", """WITH a AS (SELECT family AS dataset, protein_name, unnest(['score_a','score_b','score_c']) AS model, unnest([round(avg(score_a) FILTER (binding_label=1)-avg(score_a) FILTER (binding_label=0),9), round(avg(score_b) FILTER (binding_label=1)-avg(score_b) FILTER (binding_label=0),9), round((avg(score_c) FILTER (binding_label=1)-avg(score_c) FILTER (binding_label=0))/30000,9)]) AS v FROM scores GROUP BY 1,2),
 b AS (SELECT dataset, protein_name, model FROM a WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset, protein_name ORDER BY v DESC, model)=1) SELECT dataset, count(*) FILTER (model='score_a') AS score_a, count(*) FILTER (model='score_b') AS score_b, count(*) FILTER (model='score_c') AS score_c FROM b GROUP BY 1"""),
)
def agg_model_wins(spark, sf):
    y = F.col("binding_label")
    gap = lambda c: F.avg(F.when(y == 1, F.col(c))) - F.avg(F.when(y == 0, F.col(c)))
    w = views.scores(spark, sf).groupBy(F.col("family").alias("dataset"), "protein_name").agg(
        gap("score_a").alias("score_a"), gap("score_b").alias("score_b"), (gap("score_c") / 30000).alias("score_c")
    )
    long = w.unpivot(["dataset", "protein_name"], ["score_a", "score_b", "score_c"], "model", "auroc").withColumn("auroc", rd("auroc"))
    return ag.model_wins(long, ["score_a", "score_b", "score_c"])
