"""Queries for the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import functions as fn, views
from pairloom.catalog.registry import rd, register
from pairloom.catalog.sqlviews import sql
from pairloom.operators import kmers as km
from pairloom.plans import seed_long

QUERIES: dict = {}
SQL: dict = {}
reg = register(QUERIES, SQL)


def _tokens(c):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["token"], x["n"].cast("string"))), ",")


@reg("fn_normalize_rna", "SELECT doc_id, md5(replace(upper(trim(replace(text,'ß','SS'), ' ')),'T','U')) AS h FROM documents")
def fn_normalize_rna(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.md5(fn.normalize_rna("text")).alias("h"))


@reg(
    "fn_clean_rna",
    """SELECT doc_id, length(c) AS n, md5(c) AS h, CASE WHEN regexp_full_match(u, '[AUGC]+') THEN 1 ELSE 0 END AS strict FROM (
  SELECT doc_id, replace(upper(trim(text, ' ')),'T','U') AS u, regexp_replace(replace(upper(trim(text, ' ')),'T','U'),'[^AUGC]','','g') AS c FROM documents)""",
)
def fn_clean_rna(spark, sf):
    c = fn.clean_rna("text")
    return views.table(spark, sf, "documents").select(
        "doc_id", F.length(c).alias("n"), F.md5(c).alias("h"), fn.is_strict_rna("text").cast("int").alias("strict")
    )


@reg(
    "fn_clean_aptamer",
    sql("", """SELECT conv_id, turn, CASE WHEN length(s) >= 5 THEN s END AS seq FROM (SELECT conv_id, turn,
  regexp_replace(regexp_replace(regexp_replace(translate('5''-' || upper(text) || '-3''','T','U'),'^5[''′]?',''),'3[''′]?$',''),'[^ACGU]','','g') AS s
  FROM conversations)"""),
)
def fn_clean_aptamer(spark, sf):
    marked = F.concat(F.lit("5'-"), F.upper("text"), F.lit("-3'"))
    return views.table(spark, sf, "conversations").select("conv_id", "turn", fn.clean_aptamer(marked).alias("seq"))


@reg(
    "fn_sanitize_protein",
    r"""SELECT doc_id, length(seq) AS n, md5(seq) AS h, array_to_string([x for x in [
   CASE WHEN f LIKE '%*' THEN 'stripped_trailing_stop_codon' END,
   CASE WHEN regexp_matches(raw,'[0-9]') THEN 'removed_embedded_digits' END,
   CASE WHEN regexp_matches(raw,'[^ACDEFGHIKLMNPQRSTVWY0-9\s]') THEN 'removed_non_amino_acid_characters' END,
   CASE WHEN seq='' THEN 'empty_after_sanitization' WHEN length(seq)<>length(raw) THEN 'length_changed_'||length(raw)||'_to_'||length(seq) END] if x IS NOT NULL],';') AS warnings
 FROM (SELECT *, regexp_replace(raw,'[^ACDEFGHIKLMNPQRSTVWY]','','g') AS seq FROM (
   SELECT doc_id, f, regexp_replace(f,'\*+$','') AS raw FROM (
    SELECT doc_id, upper(trim(CASE WHEN doc_id % 3 = 0 THEN replace(text,'ß','SS') || '**' WHEN doc_id % 3 = 1 THEN regexp_replace(lower(text),'[^acdefghiklmnpqrstvwy]','','g') ELSE replace(text,'ß','SS') END,' ')) AS f FROM documents)))""",
)
def fn_sanitize_protein(spark, sf):
    t = (
        F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("**")))
        .when(F.col("doc_id") % 3 == 1, F.regexp_replace(F.lower("text"), "[^acdefghiklmnpqrstvwy]", ""))
        .otherwise(F.col("text"))
    )
    d = views.table(spark, sf, "documents").select("doc_id", fn.sanitize_protein(t).alias("s"))
    return d.select(
        "doc_id", F.length("s.seq").alias("n"), F.md5("s.seq").alias("h"), F.array_join("s.warnings", ";").alias("warnings")
    )


@reg(
    "fn_validate_protein",
    r"""SELECT doc_id, CASE WHEN p='' OR p IS NULL THEN 'empty' WHEN bad<>'' THEN 'invalid_characters:'||array_to_string(list_sort(list_distinct(string_split(bad,''))),'') ELSE 'ok' END AS reason
 FROM (SELECT doc_id, p, regexp_replace(upper(p),'[ACDEFGHIKLMNPQRSTVWY]','','g') AS bad FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(lower(text),'[^a-z]','','g') ELSE translate(regexp_replace(lower(text),'[^a-z]','','g'),'bjouxz','') END AS p FROM documents))""",
)
def fn_validate_protein(spark, sf):
    p = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.lower("text"), "[^a-z]", "")).otherwise(
        views.to_protein(F.col("text"))
    )
    return views.table(spark, sf, "documents").select("doc_id", fn.validate_protein(p).alias("reason"))


@reg(
    "fn_gc_au",
    sql("docs", """SELECT doc_id, CASE WHEN length(rna)>0 THEN round((length(rna)-length(translate(rna,'GC','')))/length(rna),9) ELSE 0.0::DOUBLE END AS gc,
  CASE WHEN length(rna)>0 THEN round((length(rna)-length(translate(rna,'AU','')))/length(rna),9) ELSE 0.0::DOUBLE END AS au FROM docs"""),
)
def fn_gc_au(spark, sf):
    return views.docs(spark, sf).select("doc_id", rd(fn.gc_fraction("rna")).alias("gc"), rd(fn.au_fraction("rna")).alias("au"))


@reg(
    "fn_nt_counts",
    sql("docs", """, t AS (SELECT doc_id, i, substr(rna,i,1) AS a, CASE WHEN i<length(rna) THEN substr(rna,i,2) END AS b,
   CASE WHEN length(rna)>=2 THEN CASE WHEN i<length(rna) THEN substr(rna,i,2) ELSE substr(rna,i,1)||substr(rna,1,1) END END AS cc
   FROM (SELECT doc_id, rna, unnest(range(1,length(rna)+1)) AS i FROM docs)),
 n AS (SELECT doc_id, a AS k, 'n' AS w, count(*) AS c FROM t GROUP BY ALL UNION ALL SELECT doc_id, b, 'd', count(*) FROM t WHERE b IS NOT NULL GROUP BY ALL
   UNION ALL SELECT doc_id, cc, 'c', count(*) FROM t WHERE cc IS NOT NULL GROUP BY ALL),
 s AS (SELECT doc_id, w, string_agg(k||':'||c, ',' ORDER BY k) AS s FROM n GROUP BY ALL)
 SELECT d.doc_id, coalesce(max(s) FILTER (w='n'),'') AS nt, coalesce(max(s) FILTER (w='d'),'') AS di, coalesce(max(s) FILTER (w='c'),'') AS di_circular
 FROM docs d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""".replace(", t AS", "WITH t AS", 1)),
)
def fn_nt_counts(spark, sf):
    return views.docs(spark, sf).select(
        "doc_id",
        _tokens(fn.nt_counts("rna")).alias("nt"),
        _tokens(fn.dinuc_counts("rna")).alias("di"),
        _tokens(fn.dinuc_counts("rna", circular=True)).alias("di_circular"),
    )


@reg(
    "fn_hamming",
    sql("pairs", """SELECT pair_id, h::BIGINT AS hamming, CASE WHEN a<>b AND h >= greatest(3, ceil(length(a)*0.05::DOUBLE)) THEN 1 ELSE 0 END AS passes FROM (
  SELECT pair_id, a, b, CASE WHEN length(a)<>length(b) THEN greatest(length(a),length(b)) ELSE len([1 for i in range(1,length(a)+1) if substr(a,i,1)<>substr(b,i,1)]) END AS h
  FROM (SELECT pair_id, rna_sequence AS a, CASE WHEN off % 120 = 0 THEN reverse(rna_sequence) ELSE rna_sequence || 'A' END AS b FROM pairs))"""),
)
def fn_hamming(spark, sf):
    b = F.when(F.col("off") % 120 == 0, F.reverse("rna_sequence")).otherwise(F.concat("rna_sequence", F.lit("A")))
    return views.pairs(spark, sf).select(
        "pair_id",
        fn.hamming("rna_sequence", b).cast("long").alias("hamming"),
        fn.passes_hamming("rna_sequence", b).cast("int").alias("passes"),
    )


@reg(
    "fn_kmer_jaccard",
    sql("pairs", """, k AS (SELECT pair_id, list_distinct([substr(rna_sequence,i,3) for i in range(1,length(rna_sequence)-1)]) AS x,
     list_distinct([substr(reverse(rna_sequence),i,3) for i in range(1,length(rna_sequence)-1)]) AS y FROM pairs)
 SELECT pair_id, round(len(list_intersect(x,y))::DOUBLE/len(list_distinct(list_concat(x,y))),9) AS jaccard FROM k""".replace(", k", "WITH k", 1)),
)
def fn_kmer_jaccard(spark, sf):
    return views.pairs(spark, sf).select(
        "pair_id", rd(fn.kmer_jaccard("rna_sequence", F.reverse("rna_sequence"), 3)).alias("jaccard")
    )


@reg(
    "fn_kmers",
    sql("docs", """SELECT kmer, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (
  SELECT doc_id, unnest([substr(rna,i,5) for i in range(1,length(rna)-3)]) AS kmer FROM docs) GROUP BY kmer"""),
)
def fn_kmers(spark, sf):
    per = (
        views.docs(spark, sf)
        .select("doc_id", F.explode(fn.kmers("rna", 5, "ACGU")).alias("kmer"))
        .groupBy("doc_id", "kmer")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return per.groupBy("kmer").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@reg(
    "fn_kmer_freq",
    sql("docs", """WITH k AS (SELECT doc_id, unnest([substr(rna,i,3) for i in range(1,length(rna)-1)]) AS kmer FROM docs)
 SELECT doc_id, kmer, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY doc_id),9) AS freq FROM k GROUP BY doc_id, kmer"""),
)
def fn_kmer_freq(spark, sf):
    return km.kmer_freq(views.docs(spark, sf), "doc_id", "rna", [3], "AUGC").select(
        "doc_id", "kmer", rd("freq").alias("freq")
    )


@reg(
    "fn_kmer_multi",
    sql("pairs", """WITH k AS (SELECT pair_id, length(kmer) AS k, kmer FROM (SELECT pair_id, unnest(flatten([[substr(rna_sequence,i,k) for i in range(1,length(rna_sequence)-k+2)] for k in range(1,5)])) AS kmer FROM pairs)),
 f AS (SELECT pair_id, k, kmer, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY pair_id, k) AS f FROM k GROUP BY pair_id, k, kmer)
 SELECT pair_id, count(*) AS dims, round(sum(f),9) AS total, round(max(f),9) AS top, round(sum(f*f),9) AS energy FROM f GROUP BY pair_id"""),
)
def fn_kmer_multi(spark, sf):
    f = km.kmer_freq(views.pairs(spark, sf), "pair_id", "rna_sequence", [1, 2, 3, 4], "AUGC")
    return f.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("dims"),
        rd(F.sum("freq")).alias("total"),
        rd(F.max("freq")).alias("top"),
        rd(F.sum(F.col("freq") * F.col("freq"))).alias("energy"),
    )


@reg(
    "fn_conjoint_triad",
    sql("document_proteins", """WITH t AS (SELECT protein_name, translate(regexp_replace(protein_sequence,'[^AGVILFPYMTSHNQWRKDEC]','A','g'),'AGVILFPYMTSHNQWRKDEC','00011112222333344556') AS s FROM document_proteins),
 k AS (SELECT protein_name, unnest([substr(s,i,3) for i in range(1,length(s)-1)]) AS triad FROM t)
 SELECT protein_name, triad, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY protein_name),9) AS freq FROM k GROUP BY protein_name, triad"""),
)
def fn_conjoint_triad(spark, sf):
    p = views.document_proteins(spark, sf).select("protein_name", fn.triad_letters("protein_sequence").alias("s"))
    f = km.kmer_freq(p, "protein_name", "s", [3], "0123456")
    return f.select("protein_name", F.col("kmer").alias("triad"), rd("freq").alias("freq"))


@reg(
    "fn_one_hot",
    sql("pairs", """SELECT pair_id, array_to_string([CASE substr(rna_sequence,i,1) WHEN 'A' THEN '1000' WHEN 'U' THEN '0100' WHEN 'G' THEN '0010' WHEN 'C' THEN '0001' ELSE '0000' END for i in range(1,65)],'') AS bits FROM pairs"""),
)
def fn_one_hot(spark, sf):
    m = fn.one_hot("rna_sequence", 64)
    bits = F.array_join(F.transform(F.flatten(m), lambda v: v.cast("int").cast("string")), "")
    return views.pairs(spark, sf).select("pair_id", bits.alias("bits"))


@reg(
    "fn_windows",
    sql("docs", """WITH w AS (SELECT doc_id, rna, unnest(CASE WHEN length(rna)<=100 THEN [0::BIGINT] ELSE list_concat(range(0,length(rna)-99,50), CASE WHEN (length(rna)-100)%50<>0 THEN [length(rna)-100] ELSE [] END) END) AS o FROM docs)
 SELECT doc_id, o AS start_pos, substr(rna,o+1,100) AS win, length(CASE WHEN length(rna)<=101 THEN rna ELSE substr(rna,((length(rna)-101)//2)+1,101) END) AS crop_len,
   md5(CASE WHEN length(rna)<=101 THEN rna ELSE substr(rna,((length(rna)-101)//2)+1,101) END) AS crop FROM w"""),
)
def fn_windows(spark, sf):
    w = views.docs(spark, sf).select("doc_id", "rna", F.explode(fn.window_offsets("rna", 100, 50)).alias("o"))
    crop = fn.center_crop("rna", 101)
    return w.select(
        "doc_id",
        F.col("o").cast("long").alias("start_pos"),
        F.substring("rna", F.col("o") + 1, F.lit(100)).alias("win"),
        F.length(crop).alias("crop_len"),
        F.md5(crop).alias("crop"),
    )


@reg(
    "fn_gene_key",
    sql("names", r"""SELECT DISTINCT native_name, regexp_replace(upper(regexp_replace(native_name,'(?i)([-_](construct\d+|isoform\d+|trunc(ation)?\d*))+$','')),'[^A-Z0-9]+','','g') AS key FROM names"""),
)
def fn_gene_key(spark, sf):
    return views.names(spark, sf).select("native_name", fn.gene_key("native_name").alias("key")).distinct()


ARCH = ["RRM1", "KH_dom", "pumilio", "zf-ccch", "SAM", "zinc knuckle", ""]


def architecture(key, step):
    """Architecture text from two columns of a table row."""
    parts = F.array(*[F.lit(a) for a in ARCH])
    pick = lambda i: F.element_at(parts, (i % 7 + 1).cast("int"))
    return F.concat_ws(";", pick(key), pick(key + step % 2), pick(key + step % 2))


ARCH_SQL = "['RRM1','KH_dom','pumilio','zf-ccch','SAM','zinc knuckle','']"


@reg(
    "fn_domain_class",
    f"""WITH a AS (SELECT p_partkey, [x for x in [trim(y) for y in string_split(upper({ARCH_SQL}[p_partkey%7+1] || ';' || {ARCH_SQL}[(p_partkey+p_size%2)%7+1] || ';' || {ARCH_SQL}[(p_partkey+p_size%2)%7+1]),';')] if x<>''] AS p FROM part),
 c AS (SELECT p_partkey, list_distinct([CASE WHEN x LIKE 'RRM%' THEN 'RRM' WHEN x LIKE 'KH%' THEN 'KH' WHEN x LIKE '%PUM%' THEN 'PUM' WHEN x LIKE '%CCCH%' THEN 'CCCH' WHEN x LIKE '%ZINC%' OR x LIKE 'ZF%' THEN 'ZF' ELSE x END for x in p]) AS f FROM a)
 SELECT p_partkey, CASE len(f) WHEN 0 THEN 'unknown' WHEN 1 THEN f[1] ELSE 'multi' END AS domain_class FROM c""",
)
def fn_domain_class(spark, sf):
    return views.table(spark, sf, "part").select(
        "p_partkey", fn.domain_class(architecture(F.col("p_partkey"), F.col("p_size"))).alias("domain_class")
    )


HIT_NAMES = ["RRM_1", "KH_2", "zf-CCCH_4", "zf-CCHC", "DEAD", "dsrm", "LaRP", "S1", "WD40", "Piwi"]
HIT_SQL = "['RRM_1','KH_2','zf-CCCH_4','zf-CCHC','DEAD','dsrm','LaRP','S1','WD40','Piwi']"


@reg(
    "fn_pfam_family",
    f"""WITH h AS (SELECT p_partkey, [{HIT_SQL}[p_size%10+1], {HIT_SQL}[(p_size+p_partkey%3)%10+1]] AS hits FROM part),
 f AS (SELECT p_partkey, list_distinct([y for y in [CASE WHEN x LIKE 'RRM%' THEN 'RRM' WHEN x LIKE 'KH\\_%' ESCAPE '\\' THEN 'KH' WHEN x LIKE 'zf-CCCH%' THEN 'CCCH' WHEN x LIKE 'zf-CCHC%' THEN 'CCHC' WHEN x LIKE 'DEAD%' THEN 'DEAD' WHEN x LIKE 'dsrm%' THEN 'dsRBD' WHEN x LIKE 'La%' THEN 'La' WHEN x LIKE 'S1%' THEN 'S1' WHEN x LIKE 'Piwi%' THEN 'Piwi' END for x in hits] if y IS NOT NULL]) AS f FROM h)
 SELECT p_partkey, CASE len(f) WHEN 0 THEN 'other' WHEN 1 THEN f[1] ELSE 'multi' END AS family FROM f""",
)
def fn_pfam_family(spark, sf):
    n = F.array(*[F.lit(x) for x in HIT_NAMES])
    hits = F.array(
        F.element_at(n, F.col("p_size") % 10 + 1),
        F.element_at(n, ((F.col("p_size") + F.col("p_partkey") % 3) % 10 + 1).cast("int")),
    )
    return views.table(spark, sf, "part").select("p_partkey", fn.pfam_family(hits).alias("family"))


@reg(
    "fn_feature_text",
    """WITH a AS (SELECT p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN 'RRM 1' WHEN 1 THEN 'KH' WHEN 2 THEN 'C3H1-type' WHEN 3 THEN p_name ELSE 'RanBP2-type' END AS note FROM part)
 SELECT p_partkey, (CASE p_partkey % 5 WHEN 0 THEN 'RRM' WHEN 1 THEN 'KH' WHEN 2 THEN 'CCCH' WHEN 3 THEN CASE WHEN upper(note) LIKE '%CSD%' OR upper(note) LIKE '%COLD%' THEN 'CSD' WHEN upper(note) LIKE '%ZINC%' THEN 'ZF' ELSE string_split(note,' ')[1] END ELSE 'ZF' END) || ';ZF' AS labels,
  p_size || '-' || (p_size+70) || ';' || (p_size+80) || '-' || (p_size+110) AS spans FROM a""",
)
def fn_feature_text(spark, sf):
    p = F.col("p_partkey") % 5
    note = (
        F.when(p == 0, F.lit("RRM 1")).when(p == 1, F.lit("KH")).when(p == 2, F.lit("C3H1-type"))
        .when(p == 3, F.col("p_name")).otherwise(F.lit("RanBP2-type"))
    )
    s = F.col("p_size")
    text = F.format_string(
        'DOMAIN %d..%d; /note="%s"; ZN_FING %d..%d; /note="any"', s, s + 70, note, s + 80, s + 110
    )
    f = views.table(spark, sf, "part").select("p_partkey", fn.parse_features(text).alias("f"))
    return f.select("p_partkey", F.array_join("f.label", ";").alias("labels"), F.array_join("f.span", ";").alias("spans"))


@reg(
    "fn_parse_kd",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN round(l_quantity::INT*1e-6,9) WHEN 2 THEN round(l_quantity::INT*1e-3,9) WHEN 3 THEN l_quantity::INT::DOUBLE
  WHEN 4 THEN l_quantity::INT*1e3 WHEN 5 THEN l_quantity::INT*1e6 WHEN 6 THEN round(l_quantity::INT*pow(10.0,-9)*1e9,9) END AS kd_nm FROM lineitem""",
)
def fn_parse_kd(spark, sf):
    unit = F.element_at(
        F.array(*[F.lit(x) for x in [" fM", " pM ", " ± 2 nM", " uM", " mM (approx)", "e-9", " units"]]),
        F.least(F.col("l_linenumber"), F.lit(7)),
    )
    text = F.concat(F.lit("Kd = "), F.col("l_quantity").cast("int").cast("string"), unit)
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(fn.parse_kd_nm(text), 9).alias("kd_nm")
    )


@reg(
    "fn_intervals",
    sql("document_proteins", """WITH j AS (SELECT protein_name, no%50 AS a, no%50+30 AS b, no%1000+900 AS c, no%1000+950 AS d, protein_sequence AS s, length(protein_sequence) AS n
   FROM (SELECT *, regexp_extract(protein_name,'d([0-9]+)$',1)::BIGINT AS no FROM document_proteins))
 SELECT protein_name, (CASE WHEN a>0 THEN a||'-'||b||';' ELSE '' END)||c||'-'||d AS spans, CASE WHEN d<=n AND (a=0 OR b<=n) THEN 1 ELSE 0 END AS fit,
   (CASE WHEN a>0 THEN (a+5)||'-'||(b+5)||';' ELSE '' END)||(c+5)||'-'||(d+5) AS shifted,
   md5(array_to_string([CASE WHEN (i BETWEEN a AND b AND a>0) OR i BETWEEN c AND d THEN substr(s,i,1) ELSE 'X' END for i in range(1,n+1)],'')) AS masked FROM j"""),
)
def fn_intervals(spark, sf):
    no = views.document_number()
    ends = (no % 50, no % 50 + 30, no % 1000 + 900, no % 1000 + 950)
    raw = F.concat_ws(";", *[c.cast("string") for c in ends])
    j = views.document_proteins(spark, sf).withColumn("iv", fn.parse_intervals(raw))
    return j.select(
        "protein_name",
        fn.intervals_text("iv").alias("spans"),
        fn.intervals_fit("iv", F.length("protein_sequence")).cast("int").alias("fit"),
        fn.intervals_text(fn.shift_intervals("iv", 5)).alias("shifted"),
        F.md5(fn.mask_outside("protein_sequence", "iv")).alias("masked"),
    )


MOTIFS = ["UGUAU", "GACGU", "ACGAC", "CCUUA", "GUACG", "AAUGC"]


@reg(
    "fn_first_motif",
    sql("pairs", """WITH r AS (SELECT pair_id, rna_sequence AS s, [x for x in ['UGUAU','GACGU','ACGAC','CCUUA','GUACG','AAUGC'] if instr(rna_sequence,x)>0] AS f FROM pairs)
 SELECT pair_id, coalesce(f[1],'-') AS motif, CASE WHEN len(f)>0 THEN instr(s,f[1])-1 ELSE -1 END AS pos, CASE WHEN len(f)>0 THEN 1 ELSE 0 END AS has_any, CASE WHEN s LIKE 'UGUAU%' THEN 1 ELSE 0 END AS starts FROM r"""),
)
def fn_first_motif(spark, sf):
    ranked = F.array(*[F.lit(m) for m in MOTIFS])
    m = fn.first_motif("rna_sequence", ranked)
    return views.pairs(spark, sf).select(
        "pair_id",
        m["motif"].alias("motif"),
        m["pos"].cast("long").alias("pos"),
        (m["pos"] >= 0).cast("int").alias("has_any"),
        F.startswith("rna_sequence", F.lit(MOTIFS[0])).cast("int").alias("starts"),
    )


TOPK = """, kc AS (SELECT protein_name, kmer, count(*) AS n FROM (SELECT protein_name, unnest([substr(rna_sequence,i,6) for i in range(1,length(rna_sequence)-4)]) AS kmer FROM pairs WHERE binding_label=1) GROUP BY ALL),
 tk AS (SELECT protein_name, kmer, n FROM kc QUALIFY row_number() OVER (PARTITION BY protein_name ORDER BY n DESC, kmer) <= 10),
 pwm AS (SELECT protein_name, i AS pos, substr(kmer,i,1) AS base, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY protein_name, i) AS p FROM tk, range(1,7) r(i) GROUP BY protein_name, i, base)"""


@reg(
    "fn_pwm_score",
    sql("pairs", ("""WITH w AS (SELECT pair_id, protein_name, j, substr(rna_sequence,j,6) AS win FROM pairs, LATERAL (SELECT unnest(range(1,length(rna_sequence)-4)) AS j))"""
    + TOPK + """, u AS (SELECT DISTINCT protein_name, win FROM w), ex AS (SELECT protein_name, win, i AS pos, substr(win,i,1) AS base FROM u, range(1,7) r(i)),
 sc AS (SELECT e.protein_name, e.win, sum(ln(greatest(coalesce(p.p,0),1e-6)/0.25)) AS s FROM ex e LEFT JOIN pwm p USING (protein_name,pos,base) GROUP BY ALL),
 best AS (SELECT w.pair_id, max(s) AS s FROM w JOIN sc USING (protein_name, win) GROUP BY w.pair_id)
 SELECT p.pair_id, round(b.s,9) + 0.0::DOUBLE AS score FROM pairs p LEFT JOIN best b USING (pair_id)""")),
)
def fn_pwm_score(spark, sf):
    p = views.pairs(spark, sf)
    top = km.top_kmers(km.positive_counts(p, "protein_name", "rna_sequence", 6), "protein_name", "n", 10)
    motif = km.pwm_columns(km.motif_matrix(top, "protein_name", "kmer", "n"), "protein_name")
    j = p.join(motif, "protein_name", "left")
    return j.select("pair_id", rd(fn.pwm_score("rna_sequence", F.col("pwm"), F.size("pwm"))).alias("score"))


@reg(
    "fn_cores",
    sql("pairs", "WITH " + TOPK[2:].split(", pwm", 1)[0].rsplit(",\n pwm", 1)[0] + """
 SELECT protein_name, array_to_string(list_sort(list_distinct(flatten(list([substr(kmer,i,5) for i in range(1,3)])))),',') AS cores FROM tk GROUP BY protein_name"""),
)
def fn_cores(spark, sf):
    p = views.pairs(spark, sf)
    top = km.top_kmers(km.positive_counts(p, "protein_name", "rna_sequence", 6), "protein_name", "n", 10)
    g = top.groupBy("protein_name").agg(F.collect_set("kmer").alias("kmers"))
    return g.select("protein_name", F.array_join(F.array_sort(fn.kmer_cores(F.col("kmers"), 5)), ",").alias("cores"))


@reg(
    "fn_log_intensity",
    sql("pairs", "SELECT pair_id, round(log10(probe_intensity - min(probe_intensity) OVER (PARTITION BY experiment_id) + 1),9) AS v FROM pairs"),
)
def fn_log_intensity(spark, sf):
    p = views.pairs(spark, sf)
    low = p.groupBy("experiment_id").agg(F.min("probe_intensity").alias("low"))
    return p.join(low, "experiment_id").select("pair_id", rd(fn.log_intensity("probe_intensity", "low")).alias("v"))


@reg("fn_revcomp", sql("docs", "SELECT doc_id, md5(reverse(translate(replace(rna,'U','T'),'ACGT','TGCA'))) AS h FROM docs"))
def fn_revcomp(spark, sf):
    return views.docs(spark, sf).select("doc_id", F.md5(fn.revcomp(F.translate("rna", "U", "T"))).alias("h"))


@reg(
    "fn_identity_bin",
    sql("hits", """SELECT b, f, count(*) AS n FROM (SELECT CASE WHEN fident<=0 THEN 'no_hit' WHEN fident<0.3 THEN '<30%' WHEN fident<0.5 THEN '30-50%' WHEN fident<0.7 THEN '50-70%' WHEN fident<0.9 THEN '70-90%' ELSE '>=90%' END AS b,
  CASE WHEN fident<0.2 THEN '0-20%' WHEN fident<0.3 THEN '20-30%' WHEN fident<0.4 THEN '30-40%' WHEN fident<0.5 THEN '40-50%' WHEN fident<0.7 THEN '50-70%' ELSE '>=70%' END AS f FROM hits) GROUP BY b, f"""),
)
def fn_identity_bin(spark, sf):
    h = views.hits(spark, sf)
    return h.groupBy(fn.identity_bin("fident").alias("b"), fn.identity_bin_fine("fident").alias("f")).agg(
        F.count(F.lit(1)).alias("n")
    )


@reg(
    "fn_outcome",
    sql("scores", """SELECT protein_name, CASE WHEN score_a>=0.5 THEN CASE binding_label WHEN 1 THEN 'TP' ELSE 'FP' END ELSE CASE binding_label WHEN 1 THEN 'FN' ELSE 'TN' END END AS outcome, count(*) AS n FROM scores GROUP BY ALL"""),
)
def fn_outcome(spark, sf):
    return (
        views.scores(spark, sf)
        .groupBy("protein_name", fn.outcome("binding_label", "score_a").alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@reg("fn_seed", sql("pairs", "SELECT pair_id, ('0x' || substr(sha256('42|' || pair_id || '|shuffle_uniform|0'),1,8))::BIGINT AS seed FROM pairs"))
def fn_seed(spark, sf):
    return views.pairs(spark, sf).select(
        "pair_id", seed_long(42, F.col("pair_id"), F.lit("shuffle_uniform"), F.lit("0")).alias("seed")
    )


@reg(
    "fn_variant_key",
    sql("document_proteins", "SELECT protein_name, length(protein_name || '||' || regexp_replace(protein_sequence,'[^ACDEFGHIKLMNPQRSTVWY]','','g')) AS n, md5(protein_name || '||' || regexp_replace(protein_sequence,'[^ACDEFGHIKLMNPQRSTVWY]','','g')) AS h FROM document_proteins"),
)
def fn_variant_key(spark, sf):
    v = fn.variant_key("protein_name", "protein_sequence")
    return views.document_proteins(spark, sf).select("protein_name", F.length(v).alias("n"), F.md5(v).alias("h"))


@reg(
    "fn_protocol_id",
    """SELECT protocol, dataset, count(*) AS n, CASE WHEN protocol IN ('HTR_SELEX','RBNS','eCLIP') THEN lower(protocol) WHEN protocol='RNAcompete' THEN CASE dataset WHEN 'Eukarya' THEN 'rnacompete_eukarya' WHEN 'RBPzoo_v1' THEN 'rnacompete_rbpzoo' ELSE 'rnacompete' END END AS pid
 FROM (SELECT ['HTR_SELEX','RBNS','RNAcompete','eCLIP','other'][(o_custkey%5+1)::INT] AS protocol, ['Eukarya','RBPzoo_v1','misc'][(o_orderkey%3+1)::INT] AS dataset FROM orders) GROUP BY ALL""",
)
def fn_protocol_id(spark, sf):
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))
    o = views.table(spark, sf, "orders").select(
        pick(["HTR_SELEX", "RBNS", "RNAcompete", "eCLIP", "other"], F.col("o_custkey") % 5).alias("protocol"),
        pick(["Eukarya", "RBPzoo_v1", "misc"], F.col("o_orderkey") % 3).alias("dataset"),
    )
    return (
        o.groupBy("protocol", "dataset")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pid", fn.protocol_id("protocol", "dataset"))
    )
