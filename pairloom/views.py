"""Pair tables derived from the driver's tables, always from whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.sequence import window_offsets

LETTERS = "abcdefghijklmnopqrstuvwxyz"
TO_RNA = "ACGUACGUACGUACGUACGUACGUAC"
WINDOW = 60


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys) -> DataFrame:
    """Split a scan of too few files over all cores; a scan with enough splits is left alone."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *keys) if df.rdd.getNumPartitions() < n else df


def to_rna(c):
    return F.translate(F.regexp_replace(F.lower(c), "[^a-z]", ""), LETTERS, TO_RNA)


def to_protein(c):
    return F.upper(F.translate(F.regexp_replace(F.lower(c), "[^a-z]", ""), "bjouxz", ""))


def docs(spark, sf) -> DataFrame:
    """Whole documents as RNA and as protein letters."""
    return spread(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", "source", "lang", "n_chars", to_rna(F.col("text")).alias("rna"), to_protein(F.col("text")).alias("prot")
    )


def proteins(spark, sf) -> DataFrame:
    """One protein per source: its first document with at least 30 residues."""
    return (
        docs(spark, sf)
        .where(F.length("prot") >= 30)
        .groupBy(F.col("source").alias("protein_name"))
        .agg(F.min_by("prot", "doc_id").alias("protein_sequence"))
    )


def document_proteins(spark, sf) -> DataFrame:
    """One protein per document with at least 30 residues, named by source and number."""
    return docs(spark, sf).where(F.length("prot") >= 30).select(
        F.concat_ws("d", "source", F.col("doc_id").cast("string")).alias("protein_name"), F.col("prot").alias("protein_sequence")
    )


def document_number(name="protein_name"):
    return F.regexp_extract(name, "d([0-9]+)$", 1).cast("long")


def _windows(spark, sf, fits, *more, **made) -> DataFrame:
    """Windows of the labelled documents that fit; ``made`` names columns made from the text.

    Texts are put in letters after the join, and once: a filter on them, also the one Spark adds for
    a plain explode, would be pushed below and make them again.
    """
    d = spread(table(spark, sf, "documents"), "doc_id").join(table(spark, sf, "labels"), "doc_id")
    d = d.withColumns({"rna": to_rna(F.col("text")), **made}).drop("text")
    offsets = F.when((F.length("rna") >= 4) & fits, window_offsets("rna", WINDOW, WINDOW))
    return d.select("*", F.explode_outer(offsets).alias("off")).where(F.col("off").isNotNull()).select(
        F.concat_ws("_", F.lit("pair"), F.col("doc_id").cast("string"), F.col("off").cast("string")).alias("pair_id"),
        "doc_id",
        "off",
        F.col("source").alias("protein_name"),
        F.substring("rna", F.col("off") + 1, F.lit(WINDOW)).alias("rna_sequence"),
        F.col("quality").alias("binding_label"),
        F.col("lang").alias("dataset_source"),
        F.concat_ws("_", "source", (F.col("doc_id") % 3).cast("string")).alias("experiment_id"),
        F.when(F.col("lang") == "en", "Homo sapiens").when(F.col("lang") == "de", "Mus musculus")
        .when(F.col("lang") == "fr", "Danio rerio").alias("organism"),
        (F.col("n_chars").cast("double") / (F.col("off") + 1)).alias("probe_intensity"),
        F.when(F.col("off") % 7 < 4, "train").when(F.col("off") % 7 == 4, "val").otherwise("test").alias("split"),
        *more,
    )


def pairs(spark, sf) -> DataFrame:
    """Every 60-letter window of every labelled document."""
    return _windows(spark, sf, F.lit(True))


def pairs_keyed(spark, sf) -> DataFrame:
    """``pairs`` of documents with a protein of 30 residues or more, each with its own document's
    protein as a digest and a length: the long text stays in ``protein_texts``."""
    own = F.transform(F.array(to_protein(F.col("text"))), lambda p: F.struct(F.md5(p).alias("key"), F.length(p).alias("length")))[0]
    named = [F.col("_own.key").alias("protein_key"), F.col("_own.length").alias("protein_length")]
    return _windows(spark, sf, F.col("_own.length") >= 30, *named, _own=own)


def protein_texts(spark, sf) -> DataFrame:
    """Every distinct protein once, by its digest."""
    d = docs(spark, sf).where(F.length("prot") >= 30).select(F.md5("prot").alias("protein_key"), F.col("prot").alias("protein_sequence"))
    return d.dropDuplicates(["protein_key"])


def pairs_seq(spark, sf) -> DataFrame:
    """``pairs_keyed`` with the protein texts."""
    return pairs_keyed(spark, sf).join(protein_texts(spark, sf), "protein_key").drop("protein_key", "protein_length")


def scores(spark, sf) -> DataFrame:
    """Line items as scored rows: score_a and score_b tie a lot, score_c little."""
    return table(spark, sf, "lineitem").select(
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("string")).alias("row_id"),
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("protein_name"),
        F.concat(F.lit("R"), F.col("l_partkey").cast("string")).alias("rna_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("binding_label"),
        (F.col("l_quantity") / 50).alias("score_a"),
        F.col("l_discount").alias("score_b"),
        F.col("l_extendedprice").alias("score_c"),
        F.concat(F.lit("F"), (F.col("l_suppkey") % 7).cast("string")).alias("family"),
        (F.col("l_suppkey") % 10 / 10.0).alias("identity"),
        F.col("l_linestatus").alias("source"),
    )


def intervals(spark, sf) -> DataFrame:
    start = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf, "events").select(
        F.col("event_type").alias("chrom"),
        start.cast("long").alias("start_pos"),
        (start + 900).cast("long").alias("end_pos"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"),
        F.col("value").alias("score"),
        F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"),
        (F.col("user_id") % 2).cast("int").alias("side"),
        F.concat(F.lit("exp"), (F.col("user_id") % 12).cast("string")).alias("experiment_id"),
    )


def hits(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("Q"), F.col("l_suppkey").cast("string")).alias("query"),
        F.concat(F.lit("T"), (F.col("l_partkey") % 200).cast("string")).alias("target"),
        (F.col("l_discount") * 9).alias("fident"),
        (F.col("l_quantity") / 50).alias("qcov"),
        (F.col("l_tax") * 12).alias("tcov"),
        F.col("l_extendedprice").alias("bits"),
    )


def links(spark, sf) -> DataFrame:
    """Similarity edges between customers' orders: a sparse graph for clustering."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("N"), F.col("l_partkey").cast("string")).alias("query"),
        F.concat(F.lit("N"), (F.col("l_partkey") * 7 % 1009 + F.col("l_suppkey")).cast("string")).alias("target"),
        (F.col("l_discount") * 9).alias("fident"),
        (F.col("l_quantity") / 50).alias("qcov"),
        (F.col("l_tax") * 12).alias("tcov"),
        F.col("l_extendedprice").alias("bits"),
    )


def names(spark, sf) -> DataFrame:
    size = F.col("p_size") % 3
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("protocol"),
        F.when(size == 0, F.col("p_name")).otherwise(
            F.concat(F.col("p_name"), F.lit("-construct"), size.cast("string"))
        ).alias("native_name"),
        F.col("p_type").alias("domain_class"),
        F.col("p_retailprice").alias("z"),
        F.col("p_partkey").alias("row_no"),
        F.col("p_size").alias("size"),
    )


def reads(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("G"), (F.col("l_partkey") % 40).cast("string")).alias("gene1"),
        F.concat(F.lit("G"), (F.col("l_suppkey") % 40).cast("string")).alias("gene2"),
        F.concat("l_returnflag", "l_linestatus").alias("library"),
    )


def literature(spark, sf) -> DataFrame:
    """The held-out passages as curated positives: whole text as RNA and protein."""
    t = F.col("text")
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("curated_"), F.col("item_id").cast("string")).alias("pair_id"),
        F.concat(F.lit("L"), (F.col("item_id") % 20).cast("string")).alias("protein_name"),
        to_protein(t).alias("protein_sequence"),
        to_rna(t).alias("rna_sequence"),
        (F.col("item_id") % 4 != 3).cast("int").alias("binding_label"),
    )


def embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("protein_name"),
        "embedding",
        F.concat(F.lit("fam"), F.col("label").cast("string")).alias("family"),
    )
