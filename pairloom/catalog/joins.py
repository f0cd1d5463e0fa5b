"""Queries for joins and interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import views
from pairloom.catalog.functions import ARCH, ARCH_SQL, architecture
from pairloom.catalog.registry import rd, register
from pairloom.catalog.sqlviews import sql
from pairloom.operators import intervals as iv, joins as jn, kmers as km

QUERIES: dict = {}
SQL: dict = {}
reg = register(QUERIES, SQL)

FLAGS_SQL = """e AS (SELECT * FROM pairs_seq WHERE split='test'), t AS (SELECT * FROM pairs_seq WHERE split='train')"""


@reg(
    "jn_leakage",
    sql("pairs_seq", "WITH " + FLAGS_SQL + """
 SELECT pair_id, CASE WHEN protein_name IN (SELECT protein_name FROM t) THEN 1 ELSE 0 END AS protein_name_in_train,
  CASE WHEN md5(protein_sequence) IN (SELECT md5(protein_sequence) FROM t) THEN 1 ELSE 0 END AS protein_sequence_in_train,
  CASE WHEN rna_sequence IN (SELECT rna_sequence FROM t WHERE binding_label=1) THEN 1 ELSE 0 END AS rna_in_train_positives,
  CASE WHEN md5(protein_sequence)||rna_sequence IN (SELECT md5(protein_sequence)||rna_sequence FROM t) THEN 1 ELSE 0 END AS exact_pair_in_train,
  CASE WHEN protein_name IN (SELECT protein_name FROM t) THEN 1 ELSE 0 END AS gene_key_in_train FROM e"""),
)
def jn_leakage(spark, sf):
    p = views.pairs_keyed(spark, sf)
    return jn.annotate_leakage(p.where("split = 'test'"), p.where("split = 'train'")).select("pair_id", *jn.LEAKAGE_FLAGS)


@reg(
    "jn_drop_seen",
    sql("pairs", """SELECT pair_id, split FROM pairs WHERE (split='val' AND rna_sequence NOT IN (SELECT rna_sequence FROM pairs WHERE split='train')) OR (split='test' AND rna_sequence NOT IN (SELECT rna_sequence FROM pairs WHERE split<>'test'))"""),
)
def jn_drop_seen(spark, sf):
    from pairloom.operators.splits import drop_seen

    p = views.pairs(spark, sf)
    val, test = drop_seen(*[p.where(F.col("split") == s) for s in ("train", "val", "test")], val_too=True)
    return val.unionByName(test).select("pair_id", "split")


SYN = {"REDWIDGET": "BLUEBOLT", "SMALLRING": "TINYRING"}
ROSTER = r"""WITH b AS (SELECT DISTINCT protocol, native_name, regexp_replace(native_name,'(?i)([-_](construct\d+|isoform\d+|trunc(ation)?\d*))+$','') AS stripped FROM names),
 k AS (SELECT protocol, native_name, CASE WHEN stripped=native_name THEN 0 ELSE 1 END AS notplain, regexp_replace(upper(stripped),'[^A-Z0-9]+','','g') AS base FROM b),
 t AS (SELECT *, CASE base WHEN 'REDWIDGET' THEN 'BLUEBOLT' WHEN 'SMALLRING' THEN 'TINYRING' END AS target FROM k),
 m AS (SELECT t.*, CASE WHEN target IS NULL THEN 'exact_base' WHEN EXISTS (SELECT 1 FROM k WHERE k.protocol=t.protocol AND k.base=t.target) THEN 'synonym_blocked_collision' ELSE 'synonym' END AS rule FROM t),
 mm AS (SELECT protocol, native_name, notplain, rule, CASE WHEN rule='synonym' THEN target ELSE base END AS protein_key FROM m),
 rep AS (SELECT protein_key, protocol, native_name AS representative FROM mm QUALIFY row_number() OVER (PARTITION BY protein_key, protocol ORDER BY notplain, length(native_name), upper(native_name), native_name)=1),
 ros AS (SELECT protein_key, count(*) AS n_protocols, string_agg(protocol,';' ORDER BY protocol) AS protocols, min_by(representative, protocol) AS protein_name FROM rep GROUP BY 1 HAVING count(*)>=2)"""


@reg(
    "jn_semi_roster",
    sql("names", ROSTER + """ SELECT n.row_no, rep.protein_key, n.native_name FROM names n JOIN rep ON rep.protocol=n.protocol AND rep.representative=n.native_name JOIN ros USING (protein_key) WHERE n.protocol='Brand#3'"""),
)
def jn_semi_roster(spark, sf):
    n = views.names(spark, sf)
    long = jn.build_roster(n, 2, SYN)[1]
    r = jn.restrict_roster(n.where("protocol = 'Brand#3'"), long, "Brand#3", name="native_name")
    return r.select("row_no", "protein_key", "native_name")


@reg("jn_roster", sql("names", ROSTER + " SELECT * FROM ros"))
def jn_roster(spark, sf):
    return jn.build_roster(views.names(spark, sf), 2, SYN)[0]


@reg(
    "jn_scored",
    sql("scores", """WITH s AS (SELECT protein_name, rna_id, binding_label, avg(score_c) AS score FROM scores WHERE source='O' GROUP BY ALL)
 SELECT row_id, round(s.score,6) AS score, CASE WHEN s.score IS NULL THEN 1 ELSE 0 END AS missing_score FROM scores LEFT JOIN s USING (protein_name, rna_id, binding_label)"""),
)
def jn_scored(spark, sf):
    s = views.scores(spark, sf)
    keys = ["protein_name", "rna_id", "binding_label"]
    table = s.where("source = 'O'").groupBy(*keys).agg(F.avg("score_c").alias("score"))
    return jn.attach_scores(s, table, keys).select("row_id", rd("score", 6).alias("score"), "missing_score")


@reg(
    "jn_interval_max",
    sql("intervals", """SELECT a.name, max(b.score) AS max_value FROM intervals a LEFT JOIN intervals b ON b.side=1 AND a.chrom=b.chrom AND b.start_pos<a.end_pos AND b.end_pos>a.start_pos WHERE a.side=0 GROUP BY a.name"""),
)
def jn_interval_max(spark, sf):
    i = views.intervals(spark, sf)
    return iv.interval_max(i.where("side = 0"), i.where("side = 1")).select("name", "max_value")


@reg(
    "jn_interval_any",
    sql("intervals", """SELECT a.name, CASE WHEN EXISTS (SELECT 1 FROM intervals b WHERE b.side=1 AND a.chrom=b.chrom AND b.start_pos<a.end_pos AND b.end_pos>a.start_pos) THEN 1 ELSE 0 END AS hit FROM intervals a WHERE a.side=0"""),
)
def jn_interval_any(spark, sf):
    i = views.intervals(spark, sf)
    a, b = i.where("side = 0"), i.where("side = 1")
    yes = iv.interval_any(a, b).select("name", F.lit(1).alias("hit"))
    return yes.unionByName(iv.interval_any(a, b, keep=False).select("name", F.lit(0).alias("hit")))


@reg(
    "jn_interval_merge",
    sql("intervals", """WITH s AS (SELECT chrom, start_pos, end_pos, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos>reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM s)
 SELECT chrom, island::BIGINT AS island, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n FROM g GROUP BY chrom, island"""),
)
def jn_interval_merge(spark, sf):
    return iv.merge_intervals(views.intervals(spark, sf))


@reg(
    "jn_pair_similarity",
    sql("literature", """WITH s AS (SELECT DISTINCT rna_sequence AS s FROM literature), k AS (SELECT s, list_distinct([substr(s,i,4) for i in range(1,length(s)-2)]) AS w FROM s),
 p AS (SELECT a.s AS seq_a, b.s AS seq_b, len(list_intersect(a.w,b.w)) AS i, len(a.w) AS na, len(b.w) AS nb, sha256(a.s) AS ha, sha256(b.s) AS hb FROM k a JOIN k b ON sha256(a.s)<sha256(b.s))
 SELECT ha AS a, hb AS b, round(i::DOUBLE/(na+nb-i),9) AS jaccard, round(i::DOUBLE/least(na,nb),9) AS containment FROM p WHERE i::DOUBLE/(na+nb-i) >= 0.4"""),
)
def jn_pair_similarity(spark, sf):
    out = jn.pair_similarity(views.literature(spark, sf), "rna_sequence", k=4, min_sim=0.4, texts=False)
    return out.select("a", "b", rd("jaccard").alias("jaccard"), rd("containment").alias("containment"))


@reg(
    "jn_pair_similarity_probes",
    sql("pairs", """WITH s AS (SELECT DISTINCT rna_sequence AS s FROM pairs WHERE length(rna_sequence)>=12), k AS (SELECT s, sha256(s) AS h, list_distinct([substr(s,i,12) for i in range(1,length(s)-10)]) AS w FROM s),
 x AS (SELECT h, len(w) AS n, unnest(w) AS t FROM k),
 p AS (SELECT a.h AS a, b.h AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.t=b.t AND a.h<b.h GROUP BY a.h, b.h)
 SELECT a, b, round(i::DOUBLE/(na+nb-i),9) AS jaccard, round(i::DOUBLE/least(na,nb),9) AS containment FROM p WHERE i::DOUBLE/(na+nb-i) >= 0.5"""),
)
def jn_pair_similarity_probes(spark, sf):
    out = jn.pair_similarity(views.pairs(spark, sf), "rna_sequence", k=12, min_sim=0.5, texts=False)
    return out.select("a", "b", rd("jaccard").alias("jaccard"), rd("containment").alias("containment"))


@reg(
    "jn_best_hit",
    sql("hits", """WITH q AS (SELECT DISTINCT query FROM hits), h AS (SELECT * FROM hits WHERE qcov>=0.9 QUALIFY row_number() OVER (PARTITION BY query ORDER BY fident DESC, bits DESC, target)=1)
 SELECT query, coalesce(target,'') AS best_target, round(coalesce(fident,0),9) AS best_identity, coalesce(bits,0) AS bits FROM q LEFT JOIN h USING (query)"""),
)
def jn_best_hit(spark, sf):
    h = views.hits(spark, sf)
    b = jn.best_hit(h.select("query").distinct(), h, min_cov=0.9)
    return b.withColumn("best_identity", rd("best_identity"))


@reg(
    "jn_topn_neighbours",
    sql("hits", """WITH q AS (SELECT DISTINCT query FROM hits), g AS (SELECT query, target, max(bits) AS bits, max_by(fident, (bits, fident, qcov)) AS fident, max_by(qcov, (bits, fident, qcov)) AS qcov FROM hits
   WHERE substr(query,2)::INT % 10 <> substr(target,2)::INT % 10 GROUP BY query, target),
 t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) AS rk FROM g QUALIFY rk<=3)
 SELECT query, coalesce(target,'') AS target, round(coalesce(fident,0),9) AS fident, coalesce(qcov,0) AS qcov, coalesce(rk,1) AS rk FROM q LEFT JOIN t USING (query)"""),
)
def jn_topn_neighbours(spark, sf):
    h = views.hits(spark, sf)
    node = h.select(F.col("query").alias("node")).union(h.select("target")).distinct()
    cl = node.withColumn("cluster", F.substring("node", 2, 10).cast("int") % 10)
    t = jn.top_neighbours(h.select("query").distinct(), h, 3, cl)
    return t.withColumn("fident", rd("fident"))


@reg(
    "jn_cosine",
    sql("emb", """WITH u AS (SELECT protein_name, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1) AS i FROM emb), m AS (SELECT i, avg(x) AS m FROM u GROUP BY i),
 c AS (SELECT protein_name, list(x-m ORDER BY i) AS v FROM u JOIN m USING (i) GROUP BY protein_name),
 s AS (SELECT a.protein_name AS query, b.protein_name AS target, list_cosine_similarity(a.v,b.v) AS sim FROM c a JOIN c b ON a.protein_name<>b.protein_name)
 SELECT query, target, round(sim,7) AS sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, target) AS rk FROM s QUALIFY rk<=5"""),
)
def jn_cosine(spark, sf):
    e = views.embeddings(spark, sf)
    return jn.cosine_knn(e, e, "protein_name", "embedding", 5, center=True).withColumn("sim", rd("sim", 7))


def constructs(spark, sf):
    """Construct rows cut from the protein sequences: shorter, equal, reversed, repeated."""
    p = views.document_proteins(spark, sf).withColumn("no", views.document_number())
    s, n = F.col("protein_sequence"), F.length("protein_sequence")
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("i"), seq.alias("construct_seq"), F.lit(sp).alias("species"), F.lit(b).alias("boundaries"), z.alias("z"), ok.alias("ok"))
            for i, (seq, sp, b, z, ok) in enumerate(
                [
                    (F.substr(s, F.lit(11), n - 20), "Homo sapiens", "5;20;22;30", F.lit(2.5), F.col("no") % 5 != 0),
                    (s, "Mus musculus", "3;9", F.lit(3.0), F.col("no") % 2 == 0),
                    (F.reverse(s), "Homo sapiens", "1;4", F.lit(9.0), F.col("no") % 3 == 0),
                    (F.concat(s, F.lit("ACDEF")), "Homo sapiens", "9000000;9000001", F.lit(1.0), F.col("no") % 10 == 5),
                ]
            )
        ]
    )
    x = p.select("protein_name", "no", F.explode(rows).alias("r")).where("r.ok")
    parts = F.array(*[F.lit(a) for a in ARCH])
    return x.select(
        F.concat("protein_name", F.lit("-construct"), F.col("r.i").cast("string")).alias("native"),
        F.element_at(parts, ((F.col("no") + F.col("r.i")) % 7 + 1).cast("int")).alias("architecture"),
        "r.construct_seq", "r.species", "r.boundaries", "r.z",
    )


CONS_SQL = f"""WITH pn AS (SELECT protein_name, regexp_extract(protein_name,'d([0-9]+)$',1)::BIGINT AS no, protein_sequence AS s FROM document_proteins),
 cr AS (SELECT protein_name, no, 0 AS i, substr(s,11,length(s)-20) AS c, 1 AS human, 30 AS last, 2.5 AS z, '5-20;22-30' AS iv FROM pn WHERE no%5<>0 UNION ALL SELECT protein_name, no, 1, s, 0, 9, 3.0, '3-9' FROM pn WHERE no%2=0
   UNION ALL SELECT protein_name, no, 2, reverse(s), 1, 4, 9.0, '1-4' FROM pn WHERE no%3=0 UNION ALL SELECT protein_name, no, 3, s||'ACDEF', 1, 9000001, 1.0, '9000000-9000001' FROM pn WHERE no%10=5),
 ca AS (SELECT cr.*, CASE WHEN last<=length(c) THEN 1 ELSE 0 END AS fit, {ARCH_SQL}[(cr.no+cr.i)%7+1] AS arch, s, CASE WHEN s=c THEN 0 WHEN instr(s,c)>0 THEN 1 WHEN instr(c,s)>0 THEN 2 ELSE 3 END AS tier FROM cr JOIN pn USING (protein_name)),
 best AS (SELECT *, count(*) OVER (PARTITION BY protein_name) AS n_candidates FROM ca QUALIFY row_number() OVER (PARTITION BY protein_name ORDER BY tier, -human, -fit, -z, i)=1),
 al AS (SELECT pn.protein_name, pn.s, coalesce(['exact','construct_in_train','train_in_construct','disjoint'][tier+1],'no_s1') AS relation, CASE tier WHEN 0 THEN 0 WHEN 1 THEN instr(pn.s,c)-1 ELSE -1 END AS off, c, arch, coalesce(fit,0) AS fit, iv,
   CASE WHEN tier IN (0,1) AND fit=1 THEN 1 ELSE 0 END AS safe, coalesce(n_candidates,0) AS n_candidates FROM pn LEFT JOIN best USING (protein_name))"""


@reg("jn_construct_align", sql("document_proteins", CONS_SQL + " SELECT protein_name, relation, off::BIGINT AS off, coalesce(length(c),0) AS construct_len, fit, safe AS safe_train_mask, n_candidates FROM al"))
def jn_construct_align(spark, sf):
    a = jn.align_constructs(views.document_proteins(spark, sf), jn.prepare_constructs(constructs(spark, sf)))
    return a.select(
        "protein_name", "relation", F.col("offset").cast("long").alias("off"), F.length("construct_seq").alias("construct_len"),
        F.col("fit").cast("int").alias("fit"), F.col("safe_train_mask").cast("int").alias("safe_train_mask"), "n_candidates",
    )


MODES = [("full_length", "length_reducing_substring"), ("construct_replace", "length_reducing_substring"), ("construct_replace", "aligned_any"),
         ("construct_domain_mask", "length_reducing_substring"), ("train_domain_mask", "length_reducing_substring")]


@reg(
    "jn_construct_apply",
    sql("document_proteins", CONS_SQL + """, md AS (SELECT unnest(['full_length|length_reducing_substring','construct_replace|length_reducing_substring','construct_replace|aligned_any','construct_domain_mask|length_reducing_substring','train_domain_mask|length_reducing_substring']) AS mode),
 st AS (SELECT md.mode, al.*, CASE
   WHEN mode LIKE 'full%' THEN 'full_length'
   WHEN mode LIKE 'train%' THEN CASE WHEN relation='no_s1' THEN 'fallback_no_s1' WHEN safe=0 THEN 'fallback_unsafe_train_mask' ELSE 'train_domain_mask:'||relation END
   WHEN relation='no_s1' THEN 'noop_no_s1'
   WHEN mode='construct_replace|aligned_any' THEN CASE WHEN relation='disjoint' THEN 'fallback_unaligned' ELSE 'construct_replace:'||relation END
   WHEN relation='exact' THEN 'noop_exact_already_construct' WHEN relation='train_in_construct' THEN 'noop_would_lengthen' WHEN relation='disjoint' THEN 'noop_disjoint'
   WHEN mode LIKE 'construct_replace%' THEN 'construct_replace:length_reducing_substring' WHEN fit=0 THEN 'construct_replace_no_intervals' ELSE 'construct_domain_mask:length_reducing_substring' END AS status FROM al, md)
 SELECT mode, protein_name, status, CASE WHEN status LIKE 'construct%' THEN length(c) ELSE length(s) END AS model_len FROM st"""),
)
def jn_construct_apply(spark, sf):
    a = jn.align_constructs(views.document_proteins(spark, sf), jn.prepare_constructs(constructs(spark, sf)))
    parts = [
        jn.apply_construct(a, m, p).select(F.lit(f"{m}|{p}").alias("mode"), "protein_name", "status", F.length("model_seq").alias("model_len"))
        for m, p in MODES
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@reg(
    "jn_domain_labels",
    sql("document_proteins", CONS_SQL + """, tb AS (SELECT upper(protein_name) AS protein_key, CASE WHEN no%4=0 THEN 'unknown' ELSE 'KH' END AS cls FROM pn),
 cl AS (SELECT protein_name, upper(protein_name) AS protein_key, CASE arch WHEN 'RRM1' THEN 'RRM' WHEN 'KH_dom' THEN 'KH' WHEN 'pumilio' THEN 'PUM' WHEN 'zf-ccch' THEN 'CCCH' WHEN 'SAM' THEN 'SAM' WHEN 'zinc knuckle' THEN 'ZF' ELSE 'unknown' END AS a FROM al),
 lb AS (SELECT protein_name, CASE WHEN a<>'unknown' THEN a WHEN cls<>'unknown' THEN cls ELSE 'unknown' END AS domain_class, CASE WHEN a<>'unknown' THEN 'alignment_qc' WHEN cls<>'unknown' THEN 'domains_table' ELSE 'unknown' END AS label_source FROM cl LEFT JOIN tb USING (protein_key)),
 r1 AS (SELECT protein_name, row_number() OVER (ORDER BY sha256('42|to|'||protein_name)) AS rk FROM lb), r2 AS (SELECT domain_class AS permuted, row_number() OVER (ORDER BY sha256('42|'||protein_name)) AS rk FROM lb)
 SELECT lb.*, permuted FROM lb JOIN r1 USING (protein_name) JOIN r2 USING (rk)"""),
)
def jn_domain_labels(spark, sf):
    a = jn.align_constructs(views.document_proteins(spark, sf), jn.prepare_constructs(constructs(spark, sf)))
    no = views.document_number()
    table = views.document_proteins(spark, sf).select(
        F.upper("protein_name").alias("protein_key"), F.when(no % 4 == 0, "unknown").otherwise("KH").alias("domain_class")
    )
    labels = jn.domain_labels(a, table).join(a.select("variant_id", "protein_name"), "variant_id").drop("variant_id")
    perm = jn.permuted_labels(labels, key="protein_name").withColumnRenamed("domain_class", "permuted")
    return labels.join(perm, "protein_name")


@reg(
    "jn_domain_pick",
    sql("names", f"""WITH d AS (SELECT regexp_replace(upper(regexp_replace(native_name,'-construct[0-9]+$','')),'[^A-Z0-9]+','','g') AS protein_key, native_name AS native, CASE WHEN size%3=1 THEN 'Homo sapiens' ELSE 'Mus musculus' END AS species,
   {ARCH_SQL}[size%7+1] AS architecture, z FROM names),
 b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY protein_key ORDER BY CASE WHEN species='Homo sapiens' THEN 0 ELSE 1 END, z DESC, native, architecture)=1),
 g AS (SELECT protein_key, count(*) AS n_constructs, count(DISTINCT CASE WHEN architecture<>'' THEN architecture END) AS na, string_agg(DISTINCT CASE WHEN architecture<>'' THEN architecture END,'|' ORDER BY CASE WHEN architecture<>'' THEN architecture END) AS architectures FROM d GROUP BY 1)
 SELECT protein_key, architecture, species, native, n_constructs, CASE WHEN na>1 THEN 'ambiguous_architectures' WHEN n_constructs>1 THEN 'multiple_constructs_same_architecture' ELSE 'unique' END AS status, coalesce(architectures,'') AS architectures FROM b JOIN g USING (protein_key)"""),
)
def jn_domain_pick(spark, sf):
    from pairloom.functions import domain_class, gene_key

    parts = F.array(*[F.lit(a) for a in ARCH])
    d = views.names(spark, sf).select(
        gene_key("native_name").alias("protein_key"), F.col("native_name").alias("native"),
        F.when(F.col("size") % 3 == 1, "Homo sapiens").otherwise("Mus musculus").alias("species"),
        F.element_at(parts, F.col("size") % 7 + 1).alias("architecture"), "z",
    ).withColumn("domain_class", domain_class("architecture"))
    return jn.pick_domain(d).drop("domain_class")


TOPLIST = """WITH kc AS (SELECT protein_name, dataset_source AS protocol, kmer, count(*) AS n FROM (SELECT protein_name, dataset_source, unnest([substr(rna_sequence,i,7) for i in range(1,length(rna_sequence)-5)]) AS kmer FROM pairs WHERE binding_label=1) GROUP BY ALL),
 tk AS (SELECT protein_name, protocol, kmer, n FROM kc QUALIFY row_number() OVER (PARTITION BY protein_name, protocol ORDER BY n DESC, kmer)<=20)"""


def top_lists(spark, sf):
    p = views.pairs(spark, sf).where("binding_label = 1")
    c = km.explode_kmers(p, ["protein_name", "dataset_source"], "rna_sequence", [7]).groupBy(
        "protein_name", F.col("dataset_source").alias("protocol"), "kmer"
    ).agg(F.count(F.lit(1)).alias("n"))
    return km.top_kmers(c, ["protein_name", "protocol"], "n", 20)


CONC = TOPLIST + """, l AS (SELECT protein_name, protocol, list(kmer) AS w, list_distinct(flatten(list([substr(kmer,i,5) for i in range(1,4)]))) AS c FROM tk GROUP BY ALL),
 sh AS (SELECT a.protein_name, a.protocol AS pa, b.protocol AS pb, a.kmer, a.n::DOUBLE AS x, b.n::DOUBLE AS y FROM tk a JOIN tk b ON a.protein_name=b.protein_name AND a.kmer=b.kmer AND a.protocol<b.protocol),
 rk AS (SELECT *, rank() OVER (PARTITION BY protein_name,pa,pb ORDER BY x) + (count(*) OVER (PARTITION BY protein_name,pa,pb,x)-1)/2.0::DOUBLE AS rx, rank() OVER (PARTITION BY protein_name,pa,pb ORDER BY y) + (count(*) OVER (PARTITION BY protein_name,pa,pb,y)-1)/2.0::DOUBLE AS ry FROM sh),
 sp AS (SELECT protein_name, pa, pb, count(*) AS n_shared, CASE WHEN count(*)>=3 AND min(rx)<>max(rx) AND min(ry)<>max(ry) THEN corr(rx,ry) END AS rho FROM rk GROUP BY ALL),
 conc AS (SELECT a.protein_name, a.protocol AS protocol_a, b.protocol AS protocol_b, len(list_intersect(a.w,b.w))::DOUBLE/len(list_distinct(list_concat(a.w,b.w))) AS jaccard,
  len(list_intersect(a.c,b.c))::DOUBLE/len(list_distinct(list_concat(a.c,b.c))) AS jaccard_core5, rho AS spearman, coalesce(n_shared,0) AS n_shared, len(a.w) AS n_a, len(b.w) AS n_b
  FROM l a JOIN l b ON a.protein_name=b.protein_name AND a.protocol<b.protocol LEFT JOIN sp ON sp.protein_name=a.protein_name AND pa=a.protocol AND pb=b.protocol)"""


def _concordance(spark, sf):
    return jn.motif_concordance(top_lists(spark, sf), key="protein_name", protocol="protocol", score="n")


@reg("jn_motif_concordance", sql("pairs", CONC + " SELECT protein_name, protocol_a, protocol_b, round(jaccard,9) AS jaccard, round(jaccard_core5,9) AS jaccard_core5, round(spearman,9)+0.0::DOUBLE AS spearman, n_shared, n_a, n_b FROM conc"))
def jn_motif_concordance(spark, sf):
    c = _concordance(spark, sf)
    return c.withColumns({x: rd(x) for x in ("jaccard", "jaccard_core5", "spearman")})


@reg(
    "jn_motif_transfer",
    sql("pairs", CONC + """, tr AS (SELECT a.protein_name, a.protocol AS train_protocol, b.protocol AS test_protocol, len(list_intersect(a.w,b.w))/20.0::DOUBLE AS auroc FROM l a JOIN l b ON a.protein_name=b.protein_name AND a.protocol<>b.protocol),
 tg AS (SELECT protein_name, least(train_protocol,test_protocol) AS protocol_a, greatest(train_protocol,test_protocol) AS protocol_b, avg(auroc) AS m, count(*) AS n FROM tr GROUP BY ALL)
 SELECT protein_name, protocol_a, protocol_b, round(jaccard,9) AS jaccard, round(m,9) AS mean_transfer_auroc, coalesce(n,0) AS n_transfer_dirs FROM conc LEFT JOIN tg USING (protein_name, protocol_a, protocol_b)"""),
)
def jn_motif_transfer(spark, sf):
    l = top_lists(spark, sf).groupBy("protein_name", "protocol").agg(F.collect_set("kmer").alias("w"))
    a = l.select("protein_name", F.col("protocol").alias("train_protocol"), F.col("w").alias("wa"))
    b = l.select("protein_name", F.col("protocol").alias("test_protocol"), F.col("w").alias("wb"))
    t = a.join(b, "protein_name").where("train_protocol <> test_protocol")
    t = t.select("protein_name", "train_protocol", "test_protocol", (F.size(F.array_intersect("wa", "wb")) / 20.0).alias("auroc"))
    c = jn.motif_vs_transfer(_concordance(spark, sf), t, key="protein_name")
    return c.select("protein_name", "protocol_a", "protocol_b", rd("jaccard").alias("jaccard"), rd("mean_transfer_auroc").alias("mean_transfer_auroc"), "n_transfer_dirs")


@reg(
    "jn_overlap_assay",
    sql("pairs_seq", "WITH " + FLAGS_SQL + """, l AS (SELECT * FROM pairs_seq WHERE split='val')
 SELECT count(*) AS n_rows, count(DISTINCT protein_name) AS n_names, count(DISTINCT CASE WHEN protein_name IN (SELECT protein_name FROM t) THEN protein_name END) AS n_names_in_train,
  count(DISTINCT CASE WHEN protein_name IN (SELECT protein_name FROM l) THEN protein_name END) AS n_names_in_literature, count(*) AS n_with_sequences,
  count(*) FILTER (md5(protein_sequence)||rna_sequence IN (SELECT md5(protein_sequence)||rna_sequence FROM l)) AS pairs_in_literature,
  count(*) FILTER (md5(protein_sequence)||rna_sequence IN (SELECT md5(protein_sequence)||rna_sequence FROM t)) AS exact_pair_in_train,
  count(*) FILTER (rna_sequence IN (SELECT rna_sequence FROM t WHERE binding_label=1)) AS rna_in_train_positives,
  round(count(*) FILTER (md5(protein_sequence)||rna_sequence IN (SELECT md5(protein_sequence)||rna_sequence FROM t))::DOUBLE/count(*),9) AS fraction_exact_pair_in_train FROM e"""),
)
def jn_overlap_assay(spark, sf):
    p = views.pairs_keyed(spark, sf)
    s = lambda x: p.where(F.col("split") == x)
    o = jn.assay_overlap(s("test"), s("val"), s("train"))
    return o.withColumn("fraction_exact_pair_in_train", rd("fraction_exact_pair_in_train"))


@reg(
    "jn_transcript_pick",
    """WITH g AS (SELECT 'G'||(p_partkey%500) AS gene, 'T'||p_partkey AS tid, ['lncRNA','protein_coding','miRNA','weird'][(p_size%4)+1] AS gt FROM part),
 b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY gene ORDER BY CASE gt WHEN 'protein_coding' THEN 1 WHEN 'lncRNA' THEN 3 WHEN 'miRNA' THEN 6 ELSE 99 END, tid)=1)
 SELECT 'G'||(l_partkey%500) AS rna_gene, 'P'||l_suppkey AS protein_name, tid AS transcript_id, CASE WHEN gt IS NOT NULL AND substr(tid,2)::INT%3<>0 THEN 'S'||tid END AS rna_sequence, CASE WHEN s_suppkey IS NOT NULL THEN s_name END AS protein_sequence, count(*) AS n
 FROM lineitem LEFT JOIN b ON b.gene='G'||(l_partkey%500) LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal>0) s ON s_suppkey=l_suppkey GROUP BY ALL""",
)
def jn_transcript_pick(spark, sf):
    p = views.table(spark, sf, "part")
    genes = p.select(
        F.concat(F.lit("G"), (F.col("p_partkey") % 500).cast("string")).alias("gene"),
        F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("transcript_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("lncRNA", "protein_coding", "miRNA", "weird")]), F.col("p_size") % 4 + 1).alias("gene_type"),
    )
    seqs = genes.where(F.substring("transcript_id", 2, 20).cast("int") % 3 != 0).select("transcript_id", F.concat(F.lit("S"), "transcript_id").alias("rna_sequence"))
    prot = views.table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("protein_name"), F.col("s_name").alias("protein_sequence")
    )
    pairs = views.table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("G"), (F.col("l_partkey") % 500).cast("string")).alias("rna_gene"),
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("protein_name"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return jn.attach_transcripts(pairs, jn.pick_transcripts(genes), seqs, prot)


@reg(
    "jn_experiment_ids",
    """WITH d AS (SELECT o_orderkey AS k, ['rnacompete','rbns','htr_selex'][(o_orderkey%3+1)::INT] AS protocol, 'd'||(o_orderkey%2) AS dataset, 'P'||(o_custkey%50) AS protein_name, CASE WHEN o_custkey%4=0 THEN 'given' WHEN o_custkey%4=1 THEN ' ' END AS e FROM orders)
 SELECT k, protocol, dataset, protein_name, CASE WHEN trim(e)<>'' THEN trim(e) ELSE CASE protocol WHEN 'rnacompete' THEN CASE WHEN substr(protein_name,2)::INT%2=0 THEN 'rc_'||dataset||protein_name END WHEN 'rbns' THEN CASE WHEN substr(protein_name,2)::INT%3=0 THEN 'rb_'||protein_name END ELSE CASE WHEN substr(protein_name,2)::INT%5=0 THEN 'hs_'||protein_name END END END AS experiment_id FROM d""",
)
def jn_experiment_ids(spark, sf):
    o = views.table(spark, sf, "orders")
    c = F.col("o_custkey")
    d = o.select(
        F.col("o_orderkey").alias("k"),
        F.element_at(F.array(*[F.lit(x) for x in ("rnacompete", "rbns", "htr_selex")]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("protocol"),
        F.concat(F.lit("d"), (F.col("o_orderkey") % 2).cast("string")).alias("dataset"),
        F.concat(F.lit("P"), (c % 50).cast("string")).alias("protein_name"),
        F.when(c % 4 == 0, "given").when(c % 4 == 1, " ").alias("experiment_id"),
    )
    pn = F.col("protein_name")
    no = F.substring("protein_name", 2, 9).cast("int")
    known = d.select("dataset", "protein_name").distinct()
    one = known.select("protein_name").distinct()
    maps = {
        "rnacompete": (known.where(no % 2 == 0).withColumn("experiment_id", F.concat(F.lit("rc_"), "dataset", pn)), ["dataset", "protein_name"]),
        "rbns": (one.where(no % 3 == 0).withColumn("experiment_id", F.concat(F.lit("rb_"), pn)), ["protein_name"]),
        "htr_selex": (one.where(no % 5 == 0).withColumn("experiment_id", F.concat(F.lit("hs_"), pn)), ["protein_name"]),
    }
    return jn.annotate_experiments(d, maps)


@reg(
    "jn_model_matrix",
    sql("scores", """WITH a AS (SELECT protein_name, avg(score_a) FILTER (binding_label=1) AS m1, avg(score_b) FILTER (binding_label=1) AS m2, avg(score_c) FILTER (binding_label=1 AND score_c>15000) AS m3 FROM scores GROUP BY 1)
 SELECT protein_name, round(m1,6) AS m1, round(m2,6) AS m2, round(m3,6) AS m3, round((m1+m2+m3)/3,6) AS mean FROM a WHERE m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL"""),
)
def jn_model_matrix(spark, sf):
    pos = views.scores(spark, sf).where("binding_label = 1")
    parts = [
        pos.where(cond).groupBy("protein_name").agg(F.avg(col).alias("auroc")).withColumn("model", F.lit(m))
        for m, col, cond in (("m1", "score_a", "true"), ("m2", "score_b", "true"), ("m3", "score_c", "score_c > 15000"))
    ]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = jn.model_matrix(long, ["m1", "m2", "m3"])
    return w.select("protein_name", *[rd(c, 6).alias(c) for c in ("m1", "m2", "m3", "mean")])
