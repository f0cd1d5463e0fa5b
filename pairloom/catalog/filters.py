"""Queries for filters and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import views
from pairloom.catalog.registry import rd, register
from pairloom.catalog.sqlviews import sql
from pairloom.operators import filters as fl, kmers as km

QUERIES: dict = {}
SQL: dict = {}
reg = register(QUERIES, SQL)


@reg(
    "flt_both_classes",
    sql("pairs", "SELECT pair_id, experiment_id FROM pairs WHERE experiment_id IN (SELECT experiment_id FROM pairs GROUP BY 1 HAVING min(binding_label)<>max(binding_label))"),
)
def flt_both_classes(spark, sf):
    return fl.both_classes(views.pairs(spark, sf), "experiment_id").select("pair_id", "experiment_id")


@reg(
    "flt_modal_length",
    """WITH s AS (SELECT source, split, unnest(string_split(regexp_replace(lower(text),'[^a-z ]','','g'),' ')) AS word FROM (SELECT d.source, CASE WHEN doc_id // 20 % 5 < 3 THEN 'train' ELSE 'test' END AS split, text FROM documents d)),
 c AS (SELECT source, length(word) AS l, count(*) AS n FROM s WHERE split='train' AND word<>'' GROUP BY ALL),
 m AS (SELECT source, l FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, l)=1)
 SELECT s.source, split, l AS modal_length, count(*) AS n FROM s JOIN m ON m.source=s.source AND length(word)=l GROUP BY ALL""",
)
def flt_modal_length(spark, sf):
    w = views.table(spark, sf, "documents").select(
        "source",
        F.when(F.floor(F.col("doc_id") / 20) % 5 < 3, "train").otherwise("test").alias("split"),
        F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " ")).alias("word"),
    ).where(F.col("word") != "")
    kept = fl.modal_length(w, "source", seq="word", split="split")
    return kept.groupBy("source", "split", F.length("word").cast("long").alias("modal_length")).agg(F.count(F.lit(1)).alias("n"))


@reg(
    "flt_best_experiment",
    sql("pairs", """WITH m AS (SELECT protein_name, experiment_id, avg(probe_intensity) AS a FROM pairs WHERE binding_label=1 GROUP BY ALL),
 b AS (SELECT protein_name, experiment_id AS best FROM m QUALIFY row_number() OVER (PARTITION BY protein_name ORDER BY round(a,9) DESC, experiment_id DESC)=1)
 SELECT pair_id, experiment_id FROM pairs LEFT JOIN b USING (protein_name) WHERE best IS NULL OR best=experiment_id"""),
)
def flt_best_experiment(spark, sf):
    return fl.best_experiment(views.pairs(spark, sf)).select("pair_id", "experiment_id")


ZSQL = """WITH kc AS (SELECT experiment_id, kmer, count(*) AS n FROM (SELECT experiment_id, unnest([substr(rna_sequence,i,5) for i in range(1,length(rna_sequence)-3)]) AS kmer FROM pairs) GROUP BY ALL),
 z AS (SELECT experiment_id, kmer, (n-avg(n) OVER w)/nullif(stddev_samp(n) OVER w,0) AS z FROM kc WINDOW w AS (PARTITION BY experiment_id))"""


def zscores(spark, sf):
    """k-mer z scores by experiment, from counts."""
    c = km.explode_kmers(views.pairs(spark, sf), "experiment_id", "rna_sequence", [5]).groupBy("experiment_id", "kmer").agg(
        F.count(F.lit(1)).alias("n")
    )
    s = c.groupBy("experiment_id").agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("s"))
    return c.join(s, "experiment_id").select("experiment_id", "kmer", F.try_divide(F.col("n") - F.col("m"), F.col("s")).alias("z"))


@reg(
    "flt_best_experiment_z",
    sql("pairs", ZSQL + """, t AS (SELECT experiment_id, avg(z) AS mz FROM (SELECT * FROM z WHERE z>=2 QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY z DESC, kmer)<=10) GROUP BY 1),
 e AS (SELECT DISTINCT protein_name, experiment_id FROM pairs), zz AS (SELECT e.*, mz AS a FROM e JOIN t USING (experiment_id)),
 m AS (SELECT protein_name, experiment_id, avg(probe_intensity) AS a FROM pairs WHERE binding_label=1 AND protein_name NOT IN (SELECT protein_name FROM zz) GROUP BY ALL),
 b AS (SELECT protein_name, experiment_id AS best FROM (SELECT * FROM zz UNION ALL SELECT * FROM m) QUALIFY row_number() OVER (PARTITION BY protein_name ORDER BY round(a,9) DESC, experiment_id DESC)=1)
 SELECT pair_id, experiment_id FROM pairs LEFT JOIN b USING (protein_name) WHERE best IS NULL OR best=experiment_id"""),
)
def flt_best_experiment_z(spark, sf):
    return fl.best_experiment_by_motif(views.pairs(spark, sf), zscores(spark, sf)).select("pair_id", "experiment_id")


@reg(
    "flt_quality",
    sql("pairs_seq", """SELECT count(*) AS rows_kept, (SELECT count(*) FROM pairs_seq) AS rows_in, count(DISTINCT protein_sequence) AS distinct_sequences, min(length(protein_sequence)) AS min_length, 0 AS failed
 FROM pairs_seq WHERE length(rna_sequence)>=10 AND length(protein_sequence)>=20"""),
)
def flt_quality(spark, sf):
    p = views.pairs_keyed(spark, sf)
    kept = fl.quality_rows(p, prot_length="protein_length")
    counted = p.groupBy("protein_key").agg(F.count(F.lit(1)).alias("n")).join(views.protein_texts(spark, sf), "protein_key")
    q = fl.quality_problems(counted, weight="n")
    n = kept.agg(F.count(F.lit(1))).scalar()
    total = p.agg(F.count(F.lit(1))).scalar()
    return q.select(n.alias("rows_kept"), total.alias("rows_in"), "distinct_sequences", F.col("min_length").cast("long").alias("min_length"), "failed")


@reg("flt_eval_subsets")
def flt_eval_subsets(spark, sf):
    p = views.pairs(spark, sf)
    return fl.eval_subsets(p.where("split = 'test'"), p.where("split = 'train'"), "pair_id", "experiment_id")


@reg(
    "flt_eval_subsets_seen",
    sql("pairs", """WITH tr AS (SELECT * FROM pairs WHERE split='train')
 SELECT * FROM (SELECT unnest(['full', CASE WHEN rna_sequence NOT IN (SELECT rna_sequence FROM tr) THEN 'rna_unseen' END, CASE WHEN experiment_id NOT IN (SELECT experiment_id FROM tr) THEN 'protein_unseen' END]) AS subset,
   pair_id, experiment_id, binding_label FROM pairs WHERE split='test') WHERE subset IS NOT NULL"""),
)
def flt_eval_subsets_seen(spark, sf):
    """The subsets that need no draw."""
    return flt_eval_subsets(spark, sf).where("subset <> 'gc_matched'")


@reg(
    "ddp_keys",
    sql("pairs", "SELECT protein_name, rna_sequence, binding_label, min(pair_id) AS pair_id, count(*) - 1 AS removed FROM pairs GROUP BY ALL"),
)
def ddp_keys(spark, sf):
    keys = ["protein_name", "rna_sequence", "binding_label"]
    p = views.pairs(spark, sf).select(*keys, "pair_id")
    removed = p.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("removed"))
    return fl.dedup(p, keys, "pair_id").join(removed, keys)


@reg(
    "ddp_majority",
    sql("pairs", "SELECT rna_sequence, CASE WHEN 2*sum(binding_label)>count(*) THEN 1 ELSE 0 END AS binding_label, min_by(protein_name, pair_id) AS protein_name, min(pair_id) AS pair_id FROM pairs GROUP BY 1 HAVING 2*sum(binding_label)<>count(*)"),
)
def ddp_majority(spark, sf):
    p = views.pairs(spark, sf).select("rna_sequence", "binding_label", "protein_name", "pair_id")
    return fl.dedup_majority(p, "rna_sequence", "pair_id")


@reg(
    "ddp_replicates",
    sql("scores", "SELECT protein_name, rna_id, round(avg(score_c),6) AS score_c, count(*) AS replicates FROM scores GROUP BY ALL"),
)
def ddp_replicates(spark, sf):
    a = fl.average_replicates(views.scores(spark, sf), ["protein_name", "rna_id"], "score_c")
    return a.withColumn("score_c", rd("score_c", 6))


@reg(
    "ddp_variants",
    sql("pairs_seq", """WITH q AS (SELECT protein_name, dataset_source, split, regexp_replace(substr(protein_sequence, CASE dataset_source WHEN 'fr' THEN 11 ELSE 1 END),'[^ACDEFGHIKLMNPQRSTVWY]','','g') AS s FROM pairs_seq),
 v AS (SELECT protein_name, md5(s) AS seq, min(split) AS split_first_seen, min(dataset_source) AS first_source, count(*) AS n_rows FROM q GROUP BY protein_name, md5(s))
 SELECT *, count(*) OVER (PARTITION BY protein_name) AS n_variants, CASE WHEN count(*) OVER (PARTITION BY protein_name)>1 THEN 1 ELSE 0 END AS multi_sequence FROM v"""),
)
def ddp_variants(spark, sf):
    """Rows of one language have their proteins without the first ten residues."""
    cut = lambda c: F.concat(c, F.lit("|cut"))
    p = views.pairs_keyed(spark, sf)
    p = p.withColumn("protein_key", F.when(F.col("dataset_source") == "fr", cut(F.col("protein_key"))).otherwise(F.col("protein_key")))
    whole = views.protein_texts(spark, sf)
    short = whole.select(cut(F.col("protein_key")).alias("protein_key"), F.expr("substr(protein_sequence, 11)").alias("protein_sequence"))
    v = fl.variant_registry(p, texts=whole.unionByName(short))
    return v.withColumn("seq", F.md5("protein_sequence")).drop("protein_sequence")
