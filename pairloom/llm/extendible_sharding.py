"""Sharding by extendible hashing.

A row's place is the md5 of its key, ``BITS`` bits of it.  A shard is a prefix of these bits;
only a prefix whose rows exceed the byte limit is split on another bit, until every shard
fits.  Sizes are summed once by a fine prefix, and all coarser ones from these sums; only
prefixes that are still too large are summed again by more bits.  The directory has an entry
for every value of the longest prefix; each points to the shard that covers it.

Rows of one key cannot be told apart by bits: where a shard holds one hash only and exceeds
the limit, its rows go to pages, by a running sum that is spread over many tasks.  A row of
more than half the limit has a page of its own, and a page of others never exceeds the limit.
One row above the limit is the only way for a shard or page to exceed it.

DataFrame functions only.  Null keys count as one key of their own, null sizes as 0.  Texts of
any length are one row with their size.  An empty table gives no shard.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.plans import cut_lineage, ordered_prefix

BITS, SPARE, STEP = 60, 6, 12
LIMIT = 1 << 20


def place(key) -> Column:
    """The key's hash bits as a number below 2**BITS."""
    text = F.coalesce(F.concat(F.lit("v"), key.cast("string")), F.lit("n"))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def right(bits, by) -> Column:
    return F.call_function("shiftright", bits, by.cast("int"))


def left(bits, by) -> Column:
    return F.call_function("shiftleft", bits, by.cast("int"))


def prefix(bits, depth: int) -> Column:
    return F.shiftright(bits, BITS - depth)


def leaves(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """rows (h, size): for each grain (bits of a cell) the finished cells and their shards
    (cell, low, depth): a shard's first place and number of bits."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    grain = min(BITS, SPARE + max(0, math.ceil(math.log2(max(1, total) / limit))))
    done, open_rows, from_depth = [], rows, 0
    while True:
        cells = open_rows.groupBy(prefix(F.col("h"), grain).alias("cell")).agg(
            F.sum("size").alias("size"), (F.min("h") == F.max("h")).alias("one")
        )
        cells = cut_lineage(cells)
        nodes = cells.select(F.explode(F.sequence(F.lit(from_depth), F.lit(grain))).alias("depth"), "cell", "size").groupBy(
            "depth", right(F.col("cell"), F.lit(grain) - F.col("depth")).alias("node")
        )
        large = nodes.agg(F.sum("size").alias("size")).where(F.col("size") > limit).select("depth", "node")
        # the deepest prefix of a cell that is too large; its child is the shard
        paths = cells.select("cell", "one", "size", F.explode(F.sequence(F.lit(from_depth), F.lit(grain))).alias("depth")).withColumn(
            "node", right(F.col("cell"), F.lit(grain) - F.col("depth"))
        )
        found = paths.join(large, ["depth", "node"], "left_semi").groupBy("cell").agg((F.max("depth") + 1).alias("depth"))
        cells = cut_lineage(cells.join(found, "cell", "left").withColumn("depth", F.coalesce("depth", F.lit(from_depth))))
        # a cell of one hash cannot be split further
        final = (F.col("depth") <= grain) | F.col("one") | F.lit(grain == BITS)
        ended = cells.where(final).withColumn("depth", F.least("depth", F.lit(grain)))
        done.append((grain, ended.select(left(right(F.col("cell"), F.lit(grain) - F.col("depth")), F.lit(BITS) - F.col("depth")).alias("low"), "depth", "cell")))
        rest = cells.where(~final).select("cell")
        if grain == BITS or rest.isEmpty():
            break
        open_rows = open_rows.withColumn("cell", prefix(F.col("h"), grain)).join(rest, "cell", "left_semi").drop("cell")
        from_depth, grain = grain + 1, min(BITS, grain + STEP)
    return done


def assign(rows: DataFrame, key: str, size: str, limit: int = LIMIT, carry: list[str] = ()) -> DataFrame:
    """(key, size, depth, prefix, page, shard_rows, shard_bytes, global_depth), one row for each
    row.  ``page`` is 0 but in shards of one hash that exceed the limit.  ``carry`` names columns
    that are kept as fields of a last column ``row``."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = rows.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("size"), *kept).withColumn("h", place(F.col("key")))
    parts = [rows.withColumn("cell", prefix(F.col("h"), grain)).join(cells, "cell").drop("cell") for grain, cells in leaves(rows.select("h", "size"), limit)]
    placed = functools.reduce(DataFrame.unionByName, parts)
    sums = cut_lineage(placed.groupBy("low", "depth").agg(F.count(F.lit(1)).alias("shard_rows"), F.sum("size").alias("shard_bytes")))
    depth = sums.agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long")).first()[0]
    crowded = sums.where((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).select("low", "depth")
    if crowded.isEmpty():
        paged = placed.withColumn("page", F.lit(0).cast("long"))
    else:
        inside = placed.join(crowded, ["low", "depth"], "left_semi").withColumn("half", (F.col("size") * 2 > limit).cast("int"))
        inside = inside.withColumn("unit", F.when(F.col("half") == 1, F.lit(1)).otherwise(F.col("size")))
        run = ordered_prefix(inside, ["low", "depth", "half"], ["size"], {"before": "unit"})
        page = F.when(F.col("half") == 1, -1 - F.col("before")).otherwise(F.floor(F.col("before") / F.lit(max(1, limit // 2))))
        paged = placed.join(crowded, ["low", "depth"], "left_anti").withColumn("page", F.lit(0).cast("long")).unionByName(
            run.withColumn("page", page.cast("long")).drop("half", "unit", "before")
        )
    return paged.join(sums, ["low", "depth"]).select(
        "key", "size", F.col("depth").cast("long").alias("depth"), right(F.col("low"), F.lit(BITS) - F.col("depth")).alias("prefix"),
        "page", "shard_rows", "shard_bytes", F.lit(depth).alias("global_depth"), *(["row"] if carry else []),
    )


def directory(assigned: DataFrame) -> DataFrame:
    """(entry, depth, prefix): the shard of every value of the longest prefix."""
    shards = assigned.select("depth", "prefix", "global_depth").distinct()
    spare = F.col("global_depth") - F.col("depth")
    first = left(F.col("prefix"), spare)
    count = left(F.lit(1).cast("long"), spare)
    return shards.select(F.explode(F.sequence(first, first + count - 1)).alias("entry"), "depth", "prefix")


def write_shards(rows: DataFrame, key: str, size: str, path: str, limit: int = LIMIT) -> None:
    """All rows with all columns as Parquet below folders depth, prefix and page, one folder and
    file for each shard; columns of the rows that have these names are written as ``_depth`` and
    so on.  Repeated and null keys are rows like all others."""
    names = {c: f"_{c}" if c in ("depth", "prefix", "page") else c for c in rows.columns}
    placed = assign(rows, key, size, limit, carry=rows.columns)
    out = placed.select("depth", "prefix", "page", *[F.col(f"row.`{c}`").alias(n) for c, n in names.items()])
    out.repartition("depth", "prefix", "page").write.partitionBy("depth", "prefix", "page").parquet(path)
