"""Document fingerprints: SimHash with weighted terms, and permuted block tables.

Terms are pairs of neighbouring words of the lower-cased text (words: what white space
separates; a text of one word gives that word), each occurrence weighted by its length in
characters.  The 64 bits of a term's hash vote with the weight; a bit is set if over half of
the weight votes for it.  Two bits are counted in one number, 32 sums in all.  Texts without
words have the fingerprint zero; null texts count as empty.

A search within a Hamming radius cuts the bits in ``radius + 2`` blocks: two fingerprints
within the radius agree on two whole blocks at least, so each pair of blocks is the key of
one table.  A pair counts in the first table that finds it.  Equal fingerprints are one row.

DataFrame functions only.  Equal ids: see ``common``; the id null counts as the smallest id.  A
text of any length is one row; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import distinct_documents, outer_id
from pairloom.plans import cut_lineage, ordered_prefix

RADIUS, QUERIES = 3, 100
LANES = 0x0000000100000001


def fingerprints(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row that has words; ids are unique."""
    words = texts.select(id_col, F.array_remove(F.split(F.lower(F.col(text_col)), r"\s+"), "").alias("w"))
    size = F.size("w")
    pairs = F.when(size > 1, F.arrays_zip(F.slice("w", 1, size - 1).alias("a"), F.slice("w", 2, size - 1).alias("b"))).otherwise(
        F.arrays_zip(F.col("w").alias("a"), F.col("w").alias("b"))
    )
    rows = words.select(id_col, F.explode(pairs).alias("t")).select(id_col, F.xxhash64("t.a", "t.b").alias("h"), (F.length("t.a") + F.length("t.b")).cast("long").alias("n"))
    votes = [F.sum(F.shiftright("h", k).bitwiseAND(F.lit(LANES)) * F.col("n")).alias(f"s{k}") for k in range(32)]
    summed = rows.groupBy(id_col).agg(F.sum("n").alias("n"), *votes)

    def bit(k: int) -> Column:
        lane = F.col(f"s{k % 32}")
        lane = lane.bitwiseAND(F.lit(0xFFFFFFFF)) if k < 32 else F.shiftrightunsigned(lane, 32)
        return F.when(lane * 2 > F.col("n"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    return summed.select(id_col, functools.reduce(Column.bitwiseOR, [bit(k) for k in range(64)]).alias("fp"))


def hex_fp(c) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def likeness(a, b) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64


def block_masks(radius: int) -> list[int]:
    """The bits of each table's key: two of radius + 2 blocks."""
    count = radius + 2
    edges = [64 * k // count for k in range(count + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def within(points: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """points (fp, n), queries (fp), both distinct: (query, fp, n) for all pairs in the radius."""
    masks = block_masks(radius)

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k")) for t, m in enumerate(masks)])
        return df.withColumn("key", F.explode(keys)).withColumnRenamed("fp", name)

    pairs = tables(queries.select("fp"), "query").join(tables(points, "fp"), "key")
    apart = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(_signed(m)).cast("long")) == 0, F.lit(t)) for t, m in enumerate(masks)])
    return pairs.where((F.bit_count(apart) <= radius) & (F.col("key.t") == first)).select("query", "fp", "n")


def edited(docs: DataFrame, order: DataFrame) -> DataFrame:
    """(doc_id, edited): the last floor(n/2) characters replaced by as many first ones of the
    next document.  order: (doc_id, n_chars, next_id, prev_id, prev_chars)."""
    both = docs.join(order.hint("shuffle_hash"), "doc_id")
    head = both.select("doc_id", F.expr("substring(text, 1, CAST(n_chars - n_chars div 2 AS INT))").alias("head"))
    tail = both.select(F.col("prev_id").alias("doc_id"), F.expr("substring(text, 1, CAST(prev_chars div 2 AS INT))").alias("tail"))
    return head.join(tail, "doc_id").select("doc_id", F.concat("head", "tail").alias("edited"))


def next_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, next_id, prev_id, prev_chars) in a ring by descending id."""
    sizes = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    run = ordered_prefix(sizes, [], ["doc_id"], maxes={"next_id": "doc_id"})
    last = sizes.agg(F.max("doc_id")).first()[0]
    ring = cut_lineage(run.withColumn("next_id", F.coalesce("next_id", F.lit(last))))
    back = ring.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), F.col("n_chars").alias("prev_chars"))
    return ring.join(back, "doc_id")


def edit_report(docs: DataFrame, radius: int = RADIUS, every: int = QUERIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (likeness: share of equal bits), and near_count: for ids divisible by
    ``every`` the number of documents, itself included, within the radius; else null."""
    docs = distinct_documents(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = cut_lineage(next_documents(docs))
    zero = F.lit(0).cast("long")
    own = cut_lineage(order.join(fingerprints(docs), "doc_id", "left").withColumn("fp", F.coalesce("fp", zero)))
    texts = edited(docs, order)
    changed = fingerprints(texts, "doc_id", "edited").withColumnRenamed("fp", "edited_fp")
    digests = texts.select("doc_id", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    points = cut_lineage(own.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    queries = own.where(F.col("doc_id") % every == 0).select("fp").distinct()
    near = within(points, queries, radius).groupBy("query").agg(F.sum("n").alias("near_count"))
    following = own.select(F.col("doc_id").alias("next_id"), F.col("fp").alias("next_fp"))
    out = own.select("doc_id", "n_chars", "fp", "next_id").join(following, "next_id").join(near.withColumnRenamed("query", "fp"), "fp", "left")
    out = out.join(digests, "doc_id").join(changed, "doc_id", "left").withColumn("edited_fp", F.coalesce("edited_fp", zero))
    return out.select(
        outer_id(), "n_chars", "edited_sha256", hex_fp("fp").alias("fingerprint"), hex_fp("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("near_count")).alias("near_count"),
    )
