"""Queries for negative generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import functions as fn, views
from pairloom.catalog.registry import rd, register
from pairloom.catalog.sqlviews import sql
from pairloom.operators import intervals as iv, negatives as ng
from pairloom.plans import cut_lineage

QUERIES: dict = {}
SQL: dict = {}
reg = register(QUERIES, SQL)


@reg("neg_uniform")
def neg_uniform(spark, sf):
    p = views.pairs_keyed(spark, sf).drop("protein_key", "protein_length")
    return ng.shuffle_uniform(p, p)


@reg("neg_dinuc")
def neg_dinuc(spark, sf):
    p = views.pairs_keyed(spark, sf).drop("protein_key", "protein_length")
    return ng.shuffle_dinuc(p, p)


@reg("neg_failures")
def neg_failures(spark, sf):
    """What the strategies could not generate, for the curated pairs and for all windows."""
    lit = views.literature(spark, sf)
    p = cut_lineage(views.pairs_keyed(spark, sf).select("pair_id", "protein_name", "rna_sequence", "binding_label"))
    shuffles = ng.STRATEGY_ORDER[:2]
    both = ng.shuffle_uniform(p, p).unionByName(ng.shuffle_dinuc(p, p))
    parts = [
        ng.generation_failures(lit, ng.generate_all(lit)).withColumn("pairs", F.lit("curated")),
        ng.generation_failures(p, both, shuffles).withColumn("pairs", F.lit("windows")),
    ]
    return parts[0].unionByName(parts[1])


KJ = """len(list_intersect({a},{b}))::DOUBLE/len(list_distinct(list_concat({a},{b})))"""


def _cross_sql(col, extra, skip):
    return sql("literature", f"""WITH p AS (SELECT *, list_distinct([substr({col},i,3) for i in range(1,length({col})-1)]) AS w FROM literature WHERE binding_label=1),
 c AS (SELECT a.pair_id AS aid, b.pair_id AS bid, a.protein_name AS an, b.protein_name AS bn, a.protein_sequence AS ap, b.protein_sequence AS bp, a.rna_sequence AS ar, b.rna_sequence AS br,
   1.0::DOUBLE-len(list_intersect(a.w,b.w))::DOUBLE/len(list_distinct(list_concat(a.w,b.w))) AS d FROM p a JOIN p b ON a.pair_id<>b.pair_id AND {extra}),
 m AS (SELECT *, max(d) OVER (PARTITION BY aid) AS best FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY bid) AS i, count(*) OVER (PARTITION BY aid) AS n FROM m WHERE d >= greatest(0.05::DOUBLE, best-1e-9)),
 o AS (SELECT * FROM t WHERE {skip} QUALIFY row_number() OVER (PARTITION BY aid ORDER BY i)=1)""")


@reg(
    "neg_cross_protein",
    _cross_sql("protein_sequence", "a.protein_name<>b.protein_name AND a.protein_sequence<>b.protein_sequence", "ar<>br AND NOT EXISTS (SELECT 1 FROM literature k WHERE k.protein_sequence=bp AND k.rna_sequence=ar)")
    + " SELECT aid||'__neg_cross_protein_0' AS pair_id, bid AS partner_pair_id, bn AS protein_name, ar AS rna_sequence, i AS rejection_attempts, ('0x'||substr(sha256('42|'||aid||'|cross_protein|0'),1,8))::BIGINT AS generation_seed FROM o",
)
def neg_cross_protein(spark, sf):
    p = views.literature(spark, sf)
    return ng.cross_protein(p, p).select("pair_id", "partner_pair_id", "protein_name", "rna_sequence", "rejection_attempts", "generation_seed")


@reg(
    "neg_cross_rna",
    _cross_sql("rna_sequence", "a.rna_sequence<>b.rna_sequence", "an<>bn AND NOT EXISTS (SELECT 1 FROM literature k WHERE k.protein_sequence=ap AND k.rna_sequence=br)")
    + """ SELECT aid||'__neg_cross_rna_0' AS pair_id, bid AS partner_pair_id, an AS protein_name, br AS rna_sequence, i AS rejection_attempts,
 CASE WHEN length(ar)<>length(br) THEN greatest(length(ar),length(br)) ELSE len([1 for j in range(1,length(ar)+1) if substr(ar,j,1)<>substr(br,j,1)]) END AS hamming_to_parent_rna FROM o""",
)
def neg_cross_rna(spark, sf):
    p = views.literature(spark, sf)
    return ng.cross_rna(p, p).select("pair_id", "partner_pair_id", "protein_name", "rna_sequence", "rejection_attempts", "hamming_to_parent_rna")


@reg("neg_expand")
def neg_expand(spark, sf):
    """The expanded benchmark, row by row."""
    train = views.pairs_keyed(spark, sf).where("split = 'train'")
    return ng.expand_benchmark(views.literature(spark, sf), train).drop("protein_sequence")


@reg(
    "neg_expand_balance",
    sql("pairs literature", """WITH t AS (SELECT DISTINCT rna_sequence FROM pairs WHERE split='train' AND binding_label=1),
 o AS (SELECT *, row_number() OVER (PARTITION BY protein_sequence, rna_sequence ORDER BY pair_id) AS i FROM literature)
 SELECT CASE binding_label WHEN 1 THEN 'curated_positive' ELSE 'curated_negative' END AS example_class, '' AS neg_strategy, count(*) AS n, count(DISTINCT protein_name) AS proteins,
  count(*) FILTER (rna_sequence IN (SELECT rna_sequence FROM t)) AS rna_leaked FROM o WHERE i=1 GROUP BY ALL"""),
)
def neg_expand_balance(spark, sf):
    """The curated classes of the expanded benchmark; the generated ones depend on random draws."""
    train = views.pairs_keyed(spark, sf).where("split = 'train'")
    balance = ng.class_balance(ng.expand_benchmark(views.literature(spark, sf), train))
    return balance.where("neg_strategy = ''")


@reg(
    "neg_donor",
    sql("pairs", """WITH p AS (SELECT pair_id, protein_name, rna_sequence FROM pairs WHERE binding_label=1),
 s AS (SELECT protein_name, count(*) AS bn FROM p GROUP BY 1), o AS (SELECT *, coalesce(sum(bn) OVER (ORDER BY protein_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS bs, sum(bn) OVER () AS t FROM s),
 x AS (SELECT p.*, o.*, bs + row_number() OVER (PARTITION BY p.protein_name ORDER BY sha256('42|'||pair_id), pair_id) - 1 AS idx FROM p JOIN o USING (protein_name)),
 q AS (SELECT pair_id, protein_name, (bs + bn + ('0x'||substr(sha256('42|donor|'||pair_id),1,8))::BIGINT % (t-bn)) % t AS d FROM x)
 SELECT 'xprot_neg_'||q.pair_id||'_from_'||x.protein_name AS pair_id, q.protein_name, x.rna_sequence, 0 AS binding_label, x.pair_id AS neg_source_id FROM q JOIN x ON x.idx=q.d
 UNION ALL SELECT pair_id, protein_name, rna_sequence, 1, '' FROM p"""),
)
def neg_donor(spark, sf):
    pos = views.pairs(spark, sf).where("binding_label = 1").select("pair_id", "protein_name", "rna_sequence")
    return ng.donor_negatives(pos).select("pair_id", "protein_name", "rna_sequence", "binding_label", "neg_source_id")


@reg(
    "neg_swap_protein",
    sql("pairs", """WITH p0 AS (SELECT protein_name, rna_sequence, min(dataset_source) AS dataset_source FROM pairs WHERE binding_label=1 GROUP BY 1,2),
 m AS (SELECT dataset_source, protein_name, row_number() OVER (PARTITION BY dataset_source ORDER BY protein_name)-1 AS idx, count(*) OVER (PARTITION BY dataset_source) AS n FROM (SELECT DISTINCT dataset_source, protein_name FROM pairs)),
 a AS (SELECT p0.*, idx AS own, n FROM p0 JOIN m USING (dataset_source, protein_name) WHERE n>1),
 t AS (SELECT a.*, i AS attempt, ('0x'||substr(sha256('42|'||protein_name||'|'||rna_sequence||'|'||i),1,8))::BIGINT % (n-1) AS d FROM a, range(0,20) r(i)),
 c AS (SELECT t.protein_name, t.rna_sequence, t.dataset_source, attempt, m.protein_name AS cand FROM t JOIN m ON m.dataset_source=t.dataset_source AND m.idx = CASE WHEN d>=own THEN d+1 ELSE d END),
 f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM p0 WHERE p0.protein_name=c.cand AND p0.rna_sequence=c.rna_sequence) QUALIFY row_number() OVER (PARTITION BY protein_name, rna_sequence ORDER BY attempt)=1)
 SELECT cand AS protein_name, rna_sequence, dataset_source, 0 AS binding_label FROM f UNION ALL SELECT protein_name, rna_sequence, dataset_source, 1 FROM f"""),
)
def neg_swap_protein(spark, sf):
    return ng.swap_protein(views.pairs(spark, sf))


@reg(
    "neg_flank",
    sql("intervals", """WITH p AS (SELECT name, chrom, strand, start_pos, start_pos+100 AS end_pos, start_pos+50 AS summit FROM intervals),
 c AS (SELECT name, chrom, strand, i, greatest(1, summit + (CASE WHEN i%2=0 THEN 1 ELSE -1 END)*3*60*(i//2+1) - 30) AS s FROM p, range(0,4) r(i)),
 f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.chrom=c.chrom AND p.start_pos < c.s+60 AND p.end_pos > c.s))
 SELECT name, chrom, strand, s AS start_pos, s+60 AS end_pos FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY i)<=2"""),
)
def neg_flank(spark, sf):
    p = views.intervals(spark, sf).withColumns({"end_pos": F.col("start_pos") + 100, "summit": F.col("start_pos") + 50})
    return iv.flank_negatives(p, "name").select("name", "chrom", "strand", "start_pos", "end_pos")


@reg(
    "neg_gc_envelope",
    sql("pairs", """WITH g AS (SELECT *, (length(rna_sequence)-length(translate(rna_sequence,'GC','')))/length(rna_sequence) AS gc FROM pairs),
 e AS (SELECT doc_id % 50 AS grp, min(gc)-0.01::DOUBLE AS lo, max(gc)+0.01::DOUBLE AS hi FROM g WHERE binding_label=1 GROUP BY 1)
 SELECT pair_id FROM g LEFT JOIN e ON e.grp=g.doc_id%50 WHERE binding_label=0 AND (lo IS NULL OR gc BETWEEN lo AND hi)"""),
)
def neg_gc_envelope(spark, sf):
    p = views.pairs(spark, sf).withColumn("grp", F.col("doc_id") % 50)
    return ng.gc_envelope(p.where("binding_label = 1"), p.where("binding_label = 0"), "grp", tol=0.01).select("pair_id")


def peak_windows(spark, sf):
    """Windows as genomic intervals of their document; GC-rich ones are peaks of a factor."""
    p = views.pairs(spark, sf).select(
        F.col("pair_id").alias("peak_id"),
        F.concat(F.lit("TF"), (F.col("off") % 7).cast("string")).alias("factor"),
        F.col("dataset_source").alias("cell"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"),
        F.col("off").cast("long").alias("start_pos"),
        (F.col("off") + F.length("rna_sequence")).cast("long").alias("end_pos"),
        F.col("rna_sequence").alias("seq"),
    )
    rich = fn.gc_fraction("seq") >= 0.5
    return p.where(rich), p.where(~rich).withColumnRenamed("peak_id", "cand_id").drop("factor", "cell")


#: peaks p, candidate windows c numbered by GC, the factors of a cell m and what they bind
OTHER = """WITH RECURSIVE w AS (SELECT pair_id AS peak_id, 'TF'||(off%7) AS factor, dataset_source AS cell, 'doc'||doc_id AS chrom, off::BIGINT AS start_pos, (off+length(rna_sequence))::BIGINT AS end_pos,
   (length(rna_sequence)-length(translate(rna_sequence,'GC','')))/length(rna_sequence) AS gc FROM pairs),
 p AS (SELECT *, ('0x'||substr(sha256('42|'||peak_id||'|xtf'),1,8))::BIGINT AS hx, ('0x'||substr(sha256('42|'||peak_id||'|gc'),1,8))::BIGINT AS hg FROM w WHERE gc>=0.5),
 c AS (SELECT *, row_number() OVER (ORDER BY gc, sha256('42|'||peak_id), peak_id)-1 AS idx FROM w WHERE {candidates}),
 m AS (SELECT cell, factor, row_number() OVER (PARTITION BY cell ORDER BY factor)-1 AS own, count(*) OVER (PARTITION BY cell)-1 AS others FROM (SELECT DISTINCT cell, factor FROM p)),
 bx AS (SELECT DISTINCT a.peak_id, q.factor FROM p a JOIN p q ON q.cell=a.cell AND q.chrom=a.chrom AND q.start_pos<a.end_pos AND q.end_pos>a.start_pos),
 xt AS (SELECT p.peak_id, o.factor, p.cell, p.chrom, p.start_pos, p.end_pos FROM p JOIN m USING (cell, factor) JOIN m o ON o.cell=p.cell AND o.factor<>p.factor LEFT JOIN bx ON bx.peak_id=p.peak_id AND bx.factor=o.factor
   WHERE bx.peak_id IS NULL QUALIFY row_number() OVER (PARTITION BY p.peak_id ORDER BY (o.own - (o.own>m.own)::INT - hx % m.others + m.others) % m.others)=1),
 bg AS (SELECT DISTINCT q.factor, q.cell, c.idx FROM c JOIN p q ON q.chrom=c.chrom AND q.start_pos<c.end_pos AND q.end_pos>c.start_pos),
 n AS (SELECT gc, count(*) AS n FROM c GROUP BY gc),
 z AS (SELECT v.gc, coalesce(sum(n) FILTER (n.gc < v.gc-0.05::DOUBLE),0)::BIGINT AS lo, coalesce(sum(n) FILTER (n.gc <= v.gc+0.05::DOUBLE),0)::BIGINT AS hi FROM (SELECT DISTINCT gc FROM p) v, n GROUP BY v.gc),
 a AS (SELECT peak_id, factor, cell, lo, hi-lo AS n, hg % nullif(hi-lo,0) AS h FROM p JOIN z USING (gc)),
 r AS (SELECT a.*, 0::BIGINT AS k, bg.idx IS NULL AS free FROM a LEFT JOIN bg ON bg.factor=a.factor AND bg.cell=a.cell AND bg.idx=lo+h WHERE n>0
   UNION ALL SELECT t.peak_id, t.factor, t.cell, t.lo, t.n, t.h, t.k+1, bg.idx IS NULL FROM (SELECT * FROM r WHERE NOT free AND k+1<n) t LEFT JOIN bg ON bg.factor=t.factor AND bg.cell=t.cell AND bg.idx=t.lo+(t.h+t.k+1)%t.n),
 gf AS (SELECT r.*, c.chrom, c.start_pos, c.end_pos FROM r JOIN c ON c.idx=lo+(h+k)%n WHERE free)"""


@reg(
    "neg_other_target",
    sql("pairs", OTHER.format(candidates="true") + """ SELECT *, 'xtf' AS kind, 0 AS binding_label FROM xt UNION ALL SELECT peak_id, factor, cell, chrom, start_pos, end_pos, 'gc', 0 FROM gf"""),
)
def neg_other_target(spark, sf):
    peaks, cand = (cut_lineage(d) for d in peak_windows(spark, sf))
    cand = cand.unionByName(peaks.select(F.col("peak_id").alias("cand_id"), "chrom", "start_pos", "end_pos", "seq"))
    return ng.other_target(peaks, cand).drop("seq")


@reg(
    "neg_other_target_left",
    sql("pairs", OTHER.format(candidates="gc<0.5") + """ SELECT p.peak_id, factor, p.cell, 'xtf' AS kind, CASE WHEN others>0 THEN 'all_factors_bind' ELSE 'no_other_factor' END AS reason
   FROM p JOIN m USING (cell, factor) WHERE peak_id NOT IN (SELECT peak_id FROM xt)
 UNION ALL SELECT peak_id, factor, cell, 'gc', CASE WHEN n>0 THEN 'all_windows_bound' ELSE 'no_window_in_reach' END FROM a WHERE peak_id NOT IN (SELECT peak_id FROM gf)"""),
)
def neg_other_target_left(spark, sf):
    peaks, cand = (cut_lineage(d) for d in peak_windows(spark, sf))
    return ng.without_negative(ng.other_target_all(peaks, cand))


@reg(
    "neg_cross_unit",
    sql("pairs", """WITH o AS (SELECT DISTINCT protein_name, dataset_source, rna_sequence FROM pairs WHERE binding_label=1),
 q AS (SELECT DISTINCT dataset_source, rna_sequence FROM o),
 u AS (SELECT DISTINCT protein_name, dataset_source FROM o)
 SELECT u.protein_name, u.dataset_source, q.rna_sequence FROM u JOIN q USING (dataset_source) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.protein_name=u.protein_name AND o.dataset_source=u.dataset_source AND o.rna_sequence=q.rna_sequence)"""),
)
def neg_cross_unit(spark, sf):
    pos = views.pairs(spark, sf).where("binding_label = 1")
    return ng.cross_unit(pos, "protein_name", "dataset_source").drop("binding_label")
