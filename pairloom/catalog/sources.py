"""Queries that write a derived table as files and read it back, and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import sources as so, views
from pairloom.catalog.registry import rd, register
from pairloom.catalog.sqlviews import sql
from pairloom.operators import kmers as km

QUERIES: dict = {}
SQL: dict = {}
reg = register(QUERIES, SQL)


@reg(
    "src_pairs",
    sql("pairs", "SELECT pair_id, rna_sequence, protein_name, binding_label, coalesce(CASE WHEN dataset_source='en' THEN NULL ELSE dataset_source END,'panel_a') AS dataset_source, experiment_id, organism FROM pairs"),
)
def src_pairs(spark, sf):
    p = views.pairs(spark, sf).select(
        "pair_id",
        F.lower(F.translate("rna_sequence", "U", "T")).alias("probe_sequence"),
        F.col("protein_name").alias("rbp_name"),
        F.col("binding_label").alias("class"),
        F.when(F.col("dataset_source") != "en", F.col("dataset_source")).alias("dataset_label"),
        F.col("experiment_id").alias("hyb_id"),
        "organism",
    )
    path = so.scratch_path(spark, "src_pairs") + "/panel_a.tsv"
    p.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return so.load_pairs(spark, path).drop("protein_sequence")


@reg(
    "src_panel",
    sql("pairs", """WITH h AS (SELECT * FROM pairs WHERE NOT coalesce(organism IN ('Homo sapiens','Mus musculus'), false))
 SELECT pair_id, protein_name, organism FROM h WHERE protein_name IN (SELECT protein_name FROM h GROUP BY 1 HAVING sum(binding_label)>=10 AND sum(1-binding_label)>=10)"""),
)
def src_panel(spark, sf):
    path = so.scratch_path(spark, "src_panel")
    views.pairs(spark, sf).drop("split").write.option("sep", "\t").option("header", True).csv(path)
    return so.load_panel(spark, path, "nonhuman").select("pair_id", "protein_name", "organism")


@reg(
    "src_affinity",
    """SELECT 'G' || l_partkey AS protein_name, l_orderkey AS o, l_linenumber AS l, CASE WHEN l_linenumber<>3 THEN l_extendedprice END AS kd, CASE WHEN l_linenumber<>3 AND l_extendedprice<=20000 THEN 1 ELSE 0 END AS binding_label, 'affinity' AS dataset_source FROM lineitem""",
)
def src_affinity(spark, sf):
    raw = views.table(spark, sf, "lineitem").select(
        F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene_name"),
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("l"),
        F.when(F.col("l_linenumber") == 3, F.lit("n/d")).otherwise(F.col("l_extendedprice").cast("string")).alias("Kd_nM"),
    )
    path = so.scratch_path(spark, "src_affinity") + "/affinity.tsv"
    raw.write.option("sep", "\t").option("header", True).csv(path)
    a = so.load_affinity(spark, path, thr=20000.0)
    return a.select("protein_name", *[F.col(c).cast(raw.schema[c].dataType).alias(c) for c in ("o", "l")], F.col("affinity_kd_nM").alias("kd"), "binding_label", "dataset_source")


@reg("src_bed", sql("intervals", "SELECT chrom, start_pos, end_pos, name, score, strand, 1 AS binding_label, 'K562' AS dataset_source FROM intervals"))
def src_bed(spark, sf):
    path = so.scratch_path(spark, "src_bed") + "/K562_eclip.bed"
    so.write_bed(so.export_bed6(views.intervals(spark, sf)), path)
    b = so.load_bed(spark, path)
    return b.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@reg(
    "src_narrowpeak",
    """WITH e AS (SELECT event_id AS i, event_type AS c, floor(epoch(ts)-epoch(timestamp '2024-01-01'))::BIGINT AS s, value FROM events),
 k AS (SELECT i, CASE WHEN i%11=0 THEN 'chr1_alt' ELSE c END AS chrom, s AS peak_start, s+900 AS peak_end, CASE WHEN i%3=0 THEN s+450 ELSE s + i%200 END AS summit, CASE WHEN i%2=0 THEN '-' ELSE '+' END AS strand, value AS signal FROM e WHERE i%13<>0 AND i%17<>0 AND i%19<>0)
 SELECT chrom, peak_start, peak_end, summit, 'e'||i AS name, strand, signal, greatest(0, summit-37) AS win_start, greatest(0,summit-37)+75 AS win_end FROM k WHERE chrom<>'chr1_alt'""",
)
def src_narrowpeak(spark, sf):
    i = F.col("i")
    e = views.intervals(spark, sf).withColumn("i", F.substring("name", 2, 20).cast("long"))
    line = F.concat_ws(
        "\t",
        F.when(i % 11 == 0, "chr1_alt").otherwise(F.col("chrom")),
        F.col("start_pos").cast("string"),
        F.col("end_pos").cast("string"),
        "name",
        F.lit("0"),
        F.when(i % 2 == 0, "-").otherwise("?"),
        F.when(i % 19 == 0, "bad").otherwise(F.col("score").cast("string")),
        F.lit("-1"),
        F.lit("-1"),
        F.when(i % 3 == 0, ".").otherwise((i % 200).cast("string")),
    )
    text = F.when(i % 13 == 0, "# comment").when(i % 17 == 0, F.concat_ws("\t", "chrom", F.lit("5"))).otherwise(line)
    path = so.scratch_path(spark, "src_narrowpeak")
    e.select(text.alias("value")).write.text(path)
    return so.load_narrowpeak(spark, path)


@reg(
    "src_windows",
    sql("intervals", "SELECT chrom, start_pos, end_pos, score AS l2or FROM intervals WHERE substr(name,2)::BIGINT % 9 <> 0 AND substr(name,2)::BIGINT % 10 <> 0"),
)
def src_windows(spark, sf):
    n = F.substring("name", 2, 20).cast("long")
    path = so.scratch_path(spark, "src_windows")
    views.intervals(spark, sf).select(
        F.col("chrom").alias("chr"),
        F.when(n % 9 == 0, "x").otherwise(F.col("start_pos").cast("string")).alias("start"),
        F.col("end_pos").alias("end"),
        F.when(n % 10 == 0, "").otherwise(F.col("score").cast("string")).alias("enrichment_l2or_mean"),
    ).write.option("sep", "\t").option("header", True).csv(path)
    return so.load_windows(spark, path)


@reg(
    "src_fasta",
    sql("pairs", "SELECT pair_id AS seq_id, rna_sequence, protein_name AS symbol, dataset_source AS cell_line, 'ENCSR' || upper(protein_name) AS accession, binding_label FROM pairs"),
)
def src_fasta(spark, sf):
    p = views.pairs(spark, sf)
    rec = F.concat(F.lit(">"), F.col("pair_id"), F.lit("\n"), so.wrap(F.translate("rna_sequence", "U", "T"), 25))
    fname = F.concat(
        "protein_name", F.lit("_"), "dataset_source", F.lit("_ENCSR"), F.upper("protein_name"), F.lit(".fixlen_151."),
        F.when(F.col("binding_label") == 1, "positives").otherwise("negatives"), F.lit(".fa"),
    )
    path = so.scratch_path(spark, "src_fasta")
    p.select(rec.alias("value"), fname.alias("exp")).write.partitionBy("exp").text(path)
    return so.load_fasta_dataset(spark, path + "/*")


MOTIF = """WITH kc AS (SELECT protein_name, kmer, count(*) AS n FROM (SELECT protein_name, unnest([substr(rna_sequence,i,8) for i in range(1,length(rna_sequence)-6)]) AS kmer FROM pairs WHERE binding_label=1) GROUP BY ALL),
 tk AS (SELECT protein_name, kmer, n FROM kc QUALIFY row_number() OVER (PARTITION BY protein_name ORDER BY n DESC, kmer) <= 10),
 cell AS (SELECT protein_name, i AS pos, substr(kmer,i,1) AS base, sum(n)::DOUBLE AS w FROM tk, range(1,9) r(i) GROUP BY protein_name, i, substr(kmer,i,1)),
 pwm AS (SELECT protein_name, pos, base, round(w / sum(w) OVER (PARTITION BY protein_name, pos),4) AS p FROM cell)"""


def motif_files(spark, sf, meme: bool):
    """One motif file per protein, written from the derived matrix."""
    p = views.pairs(spark, sf)
    top = km.top_kmers(km.positive_counts(p, "protein_name", "rna_sequence", 8), "protein_name", "n", 10)
    m = km.motif_matrix(top, "protein_name", "kmer", "n")
    row = m.groupBy("protein_name", "pos").agg(
        *[F.max(F.when(F.col("base") == b, F.round("p", 4)).otherwise(0.0)).alias(b) for b in "ACGU"]
    )
    sep = "  " if meme else "\t"
    line = F.concat(F.lit(" " if meme else ""), F.concat_ws(sep, *[F.format_number(b, 4) for b in "ACGU"]))
    body = row.groupBy("protein_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("b")
    )
    head = (
        F.lit("MEME version 5\nMOTIF one\nletter-probability matrix: alength= 4\n")
        if meme
        else F.concat(F.lit(">CONS\t"), "protein_name", F.lit("\t0\n"))
    )
    path = so.scratch_path(spark, "motifs")
    text = body.select(F.concat(head, "b", F.lit("\n")).alias("value"), F.concat(F.lit("m_"), "protein_name").alias("file"))
    # one file per motif: every protein has a single text row
    text.write.partitionBy("file").text(path)
    return path + "/*"


def motif_library(spark, sf):
    """One motif file per protein: HOMER, MEME or a consensus line of codes, by the protein's number."""
    p = views.pairs(spark, sf)
    top = km.top_kmers(km.positive_counts(p, "protein_name", "rna_sequence", 8), "protein_name", "n", 10)
    m = km.motif_matrix(top, "protein_name", "kmer", "n")
    base = lambda b: F.max(F.when(F.col("base") == b, F.round("p", 4)).otherwise(0.0))
    row = m.groupBy("protein_name", "pos").agg(*[base(b).alias(b) for b in "ACGU"])
    frequent = F.array_join(F.array_compact(F.array(*[F.when(F.col(b) >= 0.3, b) for b in "ACGU"])), "")
    codes = {"".join(sorted(v)): c for c, v in so.IUPAC.items()} | {b: b for b in "ACGU"}
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), frequent), F.lit("N"))
    nth = F.regexp_extract("protein_name", "([0-9]+)$", 1).cast("int") % 3
    number = lambda sep: F.concat_ws(sep, *[F.format_number(b, 4) for b in "ACGU"])
    line = F.when(nth == 0, number("\t")).when(nth == 1, F.concat(F.lit(" "), number("  "))).otherwise(code)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"])
    body = row.groupBy("protein_name").agg(lines.alias("b"))
    text = (
        F.when(nth == 0, F.concat(F.lit(">CONS\t"), "protein_name", F.lit("\t0\n"), F.array_join("b", "\n"), F.lit("\n")))
        .when(nth == 1, F.concat(F.lit("MEME version 5\nMOTIF one\nletter-probability matrix: alength= 4\n"), F.array_join("b", "\n"), F.lit("\n")))
        .otherwise(F.concat(F.lit("motif without a matrix\nConsensus  "), F.array_join("b", ""), F.lit("\n")))
    )
    path = so.scratch_path(spark, "motif_library")
    body.select(text.alias("value"), F.col("protein_name").alias("motif")).write.partitionBy("motif").text(path)
    return path


CODES = ", ".join(f"('{c}', {i}, '{b}')" for c, v in (so.IUPAC | {b: b for b in "ACGU"}).items() for i, b in enumerate(v))
CODE_OF = " ".join(f"WHEN '{''.join(sorted(v))}' THEN '{c}'" for c, v in so.IUPAC.items())


@reg(
    "src_motif_tables",
    sql("pairs", MOTIF.replace("WITH kc", "WITH RECURSIVE kc") + f""", z AS (SELECT protein_name AS m, substr(protein_name,4)::INT % 3 AS kind, pos, base, p FROM pwm),
 b AS (SELECT m, pos, base FROM z QUALIFY row_number() OVER (PARTITION BY m, pos ORDER BY p DESC, base)=1), c AS (SELECT m, string_agg(base,'' ORDER BY pos) AS matrix FROM b GROUP BY 1),
 f AS (SELECT m, pos, string_agg(base,'' ORDER BY base) FILTER (p>=0.3) AS s FROM z GROUP BY 1,2), l AS (SELECT m, string_agg(CASE s {CODE_OF} ELSE CASE WHEN length(s)=1 THEN s ELSE 'N' END END,'' ORDER BY pos) AS codes FROM f GROUP BY 1),
 o(code, i, base) AS (VALUES {CODES}),
 e AS (SELECT m, w, 0 AS n, substr(codes,w,7) AS win, '' AS word, []::INT[] AS path FROM l, range(1,3) r(w)
   UNION ALL SELECT m, w, n+1, win, word||base, list_append(path, i) FROM e JOIN o ON code=substr(win,n+1,1) WHERE n<7),
 x AS (SELECT m, word, min((w, path)) AS place FROM e WHERE n=7 GROUP BY 1,2), y AS (SELECT m, word, row_number() OVER (PARTITION BY m ORDER BY place) AS rk FROM x),
 k AS (SELECT m, string_agg(word, ',' ORDER BY rk) AS words FROM y WHERE rk<=10 GROUP BY 1)
 SELECT DISTINCT z.m AS motif_id, ['homer','meme','iupac'][kind+1] AS kind, 8 AS width, CASE kind WHEN 2 THEN codes ELSE matrix END AS consensus,
  CASE kind WHEN 2 THEN words ELSE CASE WHEN substr(matrix,1,7)=substr(matrix,2,7) THEN substr(matrix,1,7) ELSE substr(matrix,1,7)||','||substr(matrix,2,7) END END AS kmers
 FROM z JOIN c USING (m) JOIN l USING (m) JOIN k USING (m)"""),
)
def src_motif_tables(spark, sf):
    motifs = so.load_motifs(spark, motif_library(spark, sf), 7, 10, id_col="motif")
    return motifs.withColumn("kmers", F.array_join("kmers", ","))


@reg(
    "src_matrix_unpivot",
    """WITH w AS (SELECT l_partkey, sum(l_quantity) FILTER (l_returnflag='A') AS "A", sum(l_quantity) FILTER (l_returnflag='N') AS "N", sum(l_quantity) FILTER (l_returnflag='R') AS "R" FROM lineitem GROUP BY 1),
 u AS (SELECT * FROM w UNPIVOT INCLUDE NULLS (z FOR experiment_id IN ("A","N","R")))
 SELECT l_partkey, experiment_id, round((z-avg(z) OVER (PARTITION BY experiment_id))/stddev_samp(z) OVER (PARTITION BY experiment_id),9)+0.0::DOUBLE AS z FROM u""",
)
def src_matrix_unpivot(spark, sf):
    wide = views.table(spark, sf, "lineitem").groupBy("l_partkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return so.unpivot_scores(wide, ["l_partkey"], zscore=True).select("l_partkey", "experiment_id", rd("z").alias("z"))


@reg(
    "src_curated",
    r"""WITH t AS (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN '1' ELSE 'maybe' END AS lab, CASE WHEN doc_id%7=0 THEN '' ELSE source END AS name, trim(replace(text,'ß','SS'),' ') AS full_seq, CASE WHEN doc_id%3=0 THEN trim(replace(source,'ß','SS'),' ') ELSE '' END AS dom FROM documents),
 s AS (SELECT doc_id, name, CASE WHEN lower(trim(lab)) IN ('yes','1','true') THEN 1 WHEN lower(trim(lab)) IN ('no','0','false') THEN 0 END AS y, full_seq AS rna, CASE WHEN length(dom)>=10 THEN dom ELSE full_seq END AS prot FROM t),
 c AS (SELECT *, regexp_replace(replace(upper(rna),'T','U'),'[^AUGC]','','g') AS rna_c, regexp_replace(upper(prot),'[^ACDEFGHIKLMNPQRSTVWY]','','g') AS prot_c FROM s)
 SELECT doc_id, 'curated_'||CASE WHEN doc_id BETWEEN 0 AND 999 THEN right('000'||doc_id,4) ELSE doc_id::VARCHAR END AS pair_id, y AS binding_label, length(rna_c) AS rna_len, length(prot_c) AS prot_len,
  CASE WHEN y IS NULL THEN 'ambiguous_label' WHEN length(rna)<4 OR length(prot)<10 OR name='' THEN 'missing_sequence' WHEN length(rna_c)<4 THEN 'invalid_rna' WHEN length(prot_c)<10 THEN 'invalid_protein' END AS skip_reason FROM c""",
)
def src_curated(spark, sf):
    d = F.col("doc_id")
    raw = views.table(spark, sf, "documents").select(
        "doc_id",
        F.when(d % 7 == 0, "").otherwise(F.col("source")).alias("Protein name"),
        F.col("text").alias("RNA sequence"),
        F.col("text").alias("Protein sequence (full)"),
        F.when(d % 3 == 0, F.col("source")).alias("Domain sequence"),
        F.element_at(F.array(F.lit("Yes"), F.lit(" no"), F.lit("1"), F.lit("maybe")), (d % 4 + 1).cast("int")).alias("Interaction (yes/no)"),
    )
    p = so.parse_curated(raw, "doc_id")
    return p.select("doc_id", "pair_id", "binding_label", F.length("rna_sequence").alias("rna_len"), F.length("protein_sequence").alias("prot_len"), "skip_reason")


@reg(
    "src_interactions",
    """WITH t AS (SELECT o_orderkey AS k, ['protein','mRNA','lncRNA','DNA'][(o_orderkey%4+1)::INT] AS t1, ['RBP','miRNA','protein'][(o_custkey%3+1)::INT] AS t2,
   CASE WHEN o_custkey%5=0 THEN 'Mus musculus' ELSE 'Homo sapiens' END AS s1, CASE WHEN o_orderkey%5<3 THEN 'Mus musculus' ELSE 'HOMO SAPIENS' END AS s2 FROM orders),
 f AS (SELECT * FROM t WHERE (lower(s1) LIKE '%sapiens%' OR lower(s2) LIKE '%sapiens%') AND ((lower(t1) IN ('protein','rbp') AND lower(t2) LIKE '%rna%') OR (lower(t2) IN ('protein','rbp') AND lower(t1) LIKE '%rna%')))
 SELECT CASE WHEN t1='protein' THEN 'a'||k ELSE 'b'||k END AS protein_id, CASE WHEN t1='protein' THEN 'b'||k ELSE 'a'||k END AS rna_id, 1 AS binding_label FROM f""",
)
def src_interactions(spark, sf):
    o = views.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))
    side = lambda p: F.concat(F.lit(p), k.cast("string"))
    raw = o.select(
        side("a").alias("Interactor1_ID"),
        side("na").alias("Interactor1_name"),
        pick(["protein", "mRNA", "lncRNA", "DNA"], k % 4).alias("Interactor1_type"),
        F.when(c % 5 == 0, "Mus musculus").otherwise("Homo sapiens").alias("Interactor1_species"),
        side("b").alias("Interactor2_ID"),
        side("nb").alias("Interactor2_name"),
        pick(["RBP", "miRNA", "protein"], c % 3).alias("Interactor2_type"),
        F.when(k % 5 < 3, "Mus musculus").otherwise("HOMO SAPIENS").alias("Interactor2_species"),
    )
    return so.load_interactions(raw).select("protein_id", "rna_id", "binding_label")


@reg(
    "src_union_panels",
    sql("pairs", """WITH u AS (SELECT pair_id, protein_name, rna_sequence, binding_label, dataset_source, replace(organism,'_',' ') AS organism, CASE dataset_source WHEN 'en' THEN 'main' WHEN 'de' THEN 'second' ELSE 'third' END AS probe_set FROM pairs)
 SELECT protein_name, rna_sequence, probe_set, organism, count(*) AS n FROM u WHERE probe_set<>'third' OR protein_name IN ('src1','src2','src3','src5') GROUP BY ALL"""),
)
def src_union_panels(spark, sf):
    p = views.pairs(spark, sf)
    part = lambda cond: p.where(cond).select(
        "protein_name", F.lower(F.translate("rna_sequence", "U", "T")).alias("rna_sequence"), "binding_label",
        "dataset_source", F.translate("organism", " ", "_").alias("organism"), "probe_intensity",
    )
    path = so.scratch_path(spark, "whitelist")
    names = p.select("protein_name").distinct().where(F.col("protein_name").isin("src1", "src2", "src3", "src5"))
    names.select(F.concat("protein_name", F.lit("  # kept")).alias("value")).write.text(path)
    wl = so.read_whitelist(spark, path)
    src = F.col("dataset_source")
    panels = {"main": part(src == "en"), "second": part(src == "de"), "third": part(~src.isin("en", "de"))}
    u = so.union_panels(panels, wl, "third")
    return u.groupBy("protein_name", "rna_sequence", "probe_set", "organism").agg(F.count(F.lit(1)).alias("n"))


@reg(
    "src_folds",
    sql("pairs", """WITH f AS (SELECT pair_id, protein_name, rna_sequence, binding_label, dataset_source, 'fold'||(doc_id%5) AS fold, CASE WHEN split='train' THEN 'train' ELSE 'val' END AS split FROM pairs)
 SELECT 'rna' AS kind, pair_id AS id, max_by(rna_sequence, dataset_source||'|'||fold||'|'||split) AS sequence FROM f GROUP BY pair_id UNION ALL SELECT 'protein', protein_name, max('SEQ'||protein_name) FROM f GROUP BY protein_name"""),
)
def src_folds(spark, sf):
    path = so.scratch_path(spark, "folds")
    views.pairs(spark, sf).select(
        F.col("protein_name").alias("Protein_id"),
        F.col("pair_id").alias("RNA_id"),
        F.concat(F.lit("SEQ"), "protein_name").alias("Prot_seqs"),
        F.col("rna_sequence").alias("RNA_seqs"),
        F.col("binding_label").alias("labels"),
        F.col("dataset_source").alias("level"),
        F.concat(F.lit("fold"), (F.col("doc_id") % 5).cast("string")).alias("fold"),
        F.when(F.col("split") == "train", "train.csv").otherwise("val.csv").alias("file"),
    ).write.partitionBy("level", "fold", "file").option("header", True).csv(path)
    return so.unique_molecules(so.load_folds(spark, path + "/*/*/*"))


@reg(
    "src_invivo",
    sql("pairs", "SELECT protein_name, rna_sequence, binding_label, protein_name||'_'||dataset_source||'.txt' AS experiment_id, count(*) AS n FROM pairs WHERE off % 11 <> 0 GROUP BY ALL"),
)
def src_invivo(spark, sf):
    path = so.scratch_path(spark, "invivo")
    seq = F.when(F.col("off") % 11 == 0, F.concat("rna_sequence", F.lit("N"))).otherwise(F.lower("rna_sequence"))
    views.pairs(spark, sf).select(
        F.concat(F.lit("class"), F.col("binding_label").cast("string"), F.lit("\t"), seq).alias("value"),
        F.concat("protein_name", F.lit("_"), "dataset_source", F.lit(".txt")).alias("file"),
    ).write.partitionBy("file").text(path)
    r = so.load_label_seq(spark, path + "/*")
    return r.groupBy("protein_name", "rna_sequence", "binding_label", "experiment_id").agg(F.count(F.lit(1)).alias("n"))


@reg("snk_splits", sql("pairs", "SELECT split, protein_name, count(*) AS n FROM pairs GROUP BY ALL"))
def snk_splits(spark, sf):
    path = so.scratch_path(spark, "splits")
    so.write_splits(views.pairs(spark, sf), path)
    rows = spark.read.parquet(f"{path}/rows").groupBy("split", "protein_name").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(spark.read.parquet(f"{path}/split_map"), ["split", "protein_name"])


@reg(
    "snk_bed",
    sql("intervals", """SELECT chrom, start_pos, end_pos, 'set1' AS name, score, strand, score AS signal, CASE WHEN score/100<=0 THEN -1.0::DOUBLE ELSE round(least(400,-log10(score/100)),9) END AS neg_log_p, -1.0::DOUBLE AS neg_log_q, -1 AS peak FROM intervals"""),
)
def snk_bed(spark, sf):
    i = views.intervals(spark, sf).select(
        "chrom", "start_pos", "end_pos", "strand", F.col("score").alias("l2or"), (F.col("score") / 100).alias("p_min"), F.lit(0.0).alias("q_min")
    )
    b = so.export_bed10(i, "set1")
    path = so.scratch_path(spark, "bed10")
    so.write_bed(b, path)
    back = so.read_tsv(spark, path, header=False, schema=b.schema)
    return back.withColumn("neg_log_p", rd("neg_log_p"))


@reg(
    "snk_fasta",
    sql("docs", """SELECT source AS seq_id, min_by(rna, doc_id) AS seq FROM docs WHERE rna<>'' GROUP BY source"""),
)
def snk_fasta(spark, sf):
    path = so.scratch_path(spark, "fasta")
    so.write_fasta(so.fasta_records(views.docs(spark, sf), "source", "rna", "doc_id"), path, sort=["source"])
    return so.load_fasta(spark, path).select("seq_id", "seq")


@reg(
    "snk_report",
    sql("pairs", """WITH s AS (SELECT split, count(*) AS r, sum(binding_label) AS p, count(DISTINCT protein_name) AS q FROM pairs GROUP BY 1)
 SELECT '{"name":"demo","rows":' || sum(r)::BIGINT || ',"positives":' || sum(p)::BIGINT || ',"by_split":{' || string_agg('"' || split || '":{"rows":' || r || ',"positives":' || p::BIGINT || ',"proteins":' || q || '}', ',' ORDER BY split) || '}}' AS value FROM s"""),
)
def snk_report(spark, sf):
    path = so.scratch_path(spark, "report")
    so.write_report(views.pairs(spark, sf), path, "demo")
    return spark.read.text(path)
