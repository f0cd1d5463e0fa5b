"""Near-duplicate groups: SimHash of word shingles, linked through vantage-point trees.

Fingerprints of ``64 * words`` bits that differ in at most ``radius`` bits are linked; groups
are the connected components.  The bits are cut in ``parts``: a pair within the radius agrees
to ``radius // parts`` bits in one part at least, so each part has a vantage-point tree of its
own over its Hamming distance, and the small radius leaves few branches open.  A tree is
fitted on a bounded sample of distinct fingerprints (at most ``SAMPLE``, the smallest by a
hash): a node splits at the median distance to its vantage point.  Every fingerprint has one
home leaf a tree.  By the triangle inequality a partner across a node's boundary lies within
the radius of it, so a fingerprint near the boundary also visits the other side as a guest,
and guests follow every branch that the bound leaves open.  A leaf holds homes against homes
and guests, exactly, on all bits, in blocks; one with many homes is dealt out to several
tasks.  The sample decides speed only, never results.  A leaf passes on a spanning forest of
its links, not the pairs.

``ratio`` (optional) links only texts of like length: shingle counts are cut in bands of this
ratio, and a text meets its own band and the next.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; texts with fewer words
than a shingle give one shingle of all words; texts without words have the fingerprint zero.
Null texts count as empty.  Equal ids: see ``common``; the id null is the smallest id.  Long texts are
hashed whole, one text at a time; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import U64, blocks, byte_rows, distinct_documents, mix, outer_id
from pairloom.plans import components, cut_lineage

SHINGLE, RADIUS, SEED, PARTS = 3, 3, 42, 2
SAMPLE, LEAF, HOMES = 16_384, 4_096, 16_384
BLOCK = 1 << 18
POINT = "id long, n long, fp array<long>"


def _more_words(h: np.ndarray, words: int):
    """Further 64-bit hashes of the shingles, each mixed from the first."""
    yield h
    for k in range(1, words):
        yield mix(h * U64(2 * k + 1) ^ U64(0x9E3779B97F4A7C15 * k & (2**64 - 1)))


def shingle_hashes(raw: bytes, width: int) -> list[int]:
    """The hash of every shingle of a text, in order."""
    tokens = raw.lower().split()
    n = max(1, len(tokens) - width + 1) if tokens else 0
    if not n:
        return []
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[min(width, len(tokens)) - 1 :].tolist())]


def fingerprint_rows(texts: list[bytes], width: int = SHINGLE, words: int = 1):
    """Fingerprints (a row of ``words`` numbers a text) and shingle counts."""
    return vote([shingle_hashes(raw, width) for raw in texts], words)


def vote(shingles: list, words: int):
    """Fingerprints and sizes of lists of shingle hashes."""
    hashes = [h for own in shingles for h in own]
    counts = np.array([len(own) for own in shingles], np.int64)
    out = np.zeros((len(shingles), words), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        at = (np.cumsum(counts) - counts)[some]
        for k, h in enumerate(_more_words(np.array(hashes, np.uint64), words)):
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
            out[some, k] = np.packbits(votes * 2 > counts[some, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out, counts


def fp_column(fp: np.ndarray) -> pa.Array:
    n, words = fp.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words), pa.array(np.ascontiguousarray(fp).reshape(-1).view(np.int64)))


def fp_matrix(column, words: int) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, words)


def _fingerprints(width: int, words: int):
    def run(batches):
        for batch in batches:
            data, offs = byte_rows(batch.column("text"))
            parts = [fingerprint_rows([data[offs[k] : offs[k + 1]].tobytes() for k in range(i, j)], width, words) for i, j in blocks(offs, BLOCK)]
            if parts:
                fp, n = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), fp_column(fp)], ["id", "n", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE, words: int = 1) -> DataFrame:
    """(id, n shingles, fp) for rows of ``distinct_documents``."""
    return docs.mapInArrow(_fingerprints(width, words), POINT)


def fit_tree(sample: np.ndarray, total: int, leaf: int = LEAF) -> list[tuple]:
    """Nodes (vantage point, distance, inside, outside); a child below zero is leaf -child-1."""
    nodes: list = []
    leaves = 0

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        if len(points) > 1 and len(points) * total > leaf * len(sample):
            d = np.bitwise_count(points ^ points[0])
            mu = int(np.median(d))
            mu = mu if (d > mu).any() else mu - 1
            if (d <= mu).any():
                at = len(nodes)
                nodes.append(None)
                nodes[at] = (int(points[0]), mu, grow(points[d <= mu]), grow(points[d > mu]))
                return at
        leaves += 1
        return -leaves

    root = grow(sample)
    return nodes if root >= 0 else []


def visits(tree: list, fp: np.ndarray, radius: int, at_home: bool = True):
    """(leaf, index into fp, home) for every leaf a fingerprint belongs to or must be held against."""
    everyone = np.arange(len(fp)), np.full(len(fp), at_home)
    if not tree:
        return np.zeros(len(fp), np.int64), *everyone
    out, stack = [], [(0, *everyone)]
    while stack:
        node, rows, home = stack.pop()
        if not len(rows):
            continue
        if node < 0:
            out.append((np.full(len(rows), -node - 1), rows, home))
            continue
        vantage, mu, inside, outside = tree[node]
        d = np.bitwise_count(fp[rows] ^ np.uint64(vantage)).astype(np.int64)
        near, far = (d <= mu) & home, (d > mu) & home
        # a pair across the boundary is found by its inner point, as a guest outside
        to_in = near | (~home & (d <= mu + radius))
        to_out = far | (~far & (d > mu - radius))
        stack.append((inside, rows[to_in], home[to_in]))
        stack.append((outside, rows[to_out], far[to_out]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, bool)]


def forest(fp: np.ndarray, homes: int, radius: int):
    """Spanning edges (positions) of the links of the first ``homes`` rows with all rows."""
    root = np.arange(len(fp))
    columns = [np.ascontiguousarray(c) for c in fp.T]
    at, step = 0, 8
    while at < homes:
        end = min(homes, at + step)
        i, j = [], []
        for lo in range(0, len(fp), 1 << 14):
            hi = lo + (1 << 14)
            d = np.bitwise_count(columns[0][at:end, None] ^ columns[0][None, lo:hi])
            if len(columns) > 1:
                d = d + np.bitwise_count(columns[1][at:end, None] ^ columns[1][None, lo:hi])
            a, b = np.nonzero(d <= radius)
            a, b = a + at, b + lo
            if len(columns) > 2:
                near = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64) <= radius
                a, b = a[near], b[near]
            i.append(a)
            j.append(b)
        i, j = root[np.concatenate(i)], root[np.concatenate(j)]
        while (open_ := i != j).any():
            i, j = i[open_], j[open_]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while not np.array_equal(up := root[root], root):
                root = up
            i, j = root[i], root[j]
        at, step = end, min(256, step * 2)
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return linked, root[linked]


def _leaf(radius: int, words: int):
    def run(table: pa.Table) -> pa.Table:
        ids, fp, home = table.column("id").to_numpy(), fp_matrix(table.column("fp"), words), table.column("home").to_numpy()
        order = np.argsort(~home, kind="stable")
        ids = ids[order]
        a, b = forest(fp[order], int(home.sum()), radius)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return run


def masks(words: int, parts: int) -> list[tuple[int, int]]:
    """(word, bits of it) of each part; parts: a multiple of words."""
    each = parts // words
    size = 64 // each
    return [(w, ((1 << size) - 1) << (size * k)) for w in range(words) for k in range(each)]


def _band(ratio: float | None):
    """Texts whose shingle counts differ by a factor up to 1 / ratio lie at most one band apart."""
    return F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / -math.log(ratio)).cast("long") if ratio else F.lit(0).cast("long")


def links(points: DataFrame, radius: int, words: int = 1, parts: int = PARTS, ratio: float | None = None, leaf: int = LEAF, homes: int = HOMES, task=None) -> DataFrame:
    """points (id, n, fp), fp distinct: edges (a, b) that connect just what links connect, or what
    ``task`` makes of each leaf."""
    # the largest number of fingerprints that may meet; one count for each band
    total = points.groupBy(_band(ratio).alias("band")).count().agg(F.max("count")).first()[0] or 0
    size = min(SAMPLE, max(256, 8 * -(-total // leaf)))
    drawn = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).toArrow() if total > leaf else None
    trees = [(0, 0, [])]
    if drawn is not None:
        sample = fp_matrix(drawn.column("fp"), words)
        trees = [(w, m, fit_tree(np.unique(sample[:, w] & U64(m)), total, leaf)) for w, m in masks(words, parts)]
    near = radius // parts

    def place(split: dict, guests: bool):
        def run(batches):
            for batch in batches:
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                fp = fp_matrix(batch.column("fp"), words)
                band = batch.column("band").to_numpy(zero_copy_only=False)
                for t, (w, m, tree) in enumerate(trees):
                    key = fp[:, w] & U64(m)
                    for shift in (0, 1) if ratio and guests else (0,):
                        at, row, home = visits(tree, key, near, shift == 0)
                        if not guests:
                            at, row, home = at[home], row[home], home[home]
                        count = np.array([split.get((int(b), t, int(x)), 1) for b, x in zip(band[row] + shift, at)], np.int64)
                        own = (mix(fp[row, 0]) >> U64(32)).astype(np.int64) % np.maximum(1, count)
                        block = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                        row, at, home = np.repeat(row, count), np.repeat(at, count), np.repeat(home, count) & (block == np.repeat(own, count))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(band[row] + shift), pa.array(np.full(len(row), t)), pa.array(at), pa.array(block), pa.array(ids[row]), fp_column(fp[row]), pa.array(home)],
                            ["band", "tree", "leaf", "block", "id", "fp", "home"],
                        )

        return run

    points = points.withColumn("band", _band(ratio))
    kind = "band long, tree long, leaf long, block long, id long, fp array<long>, home boolean"
    # one row for each band, tree and leaf: at most as many leaves as sampled points
    heavy = points.mapInArrow(place({}, False), kind).groupBy("band", "tree", "leaf").count().where(F.col("count") > homes).collect()
    split = {(r["band"], r["tree"], r["leaf"]): -(-r["count"] // homes) for r in heavy}
    rows = points.mapInArrow(place(split, True), kind)
    return rows.groupBy("band", "tree", "leaf", "block").applyInArrow(task or _leaf(radius, words), "a long, b long")


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, words: int = 1, parts: int = PARTS, ratio: float | None = None,
    leaf: int = LEAF, homes: int = HOMES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp, component_id): the fingerprint and the smallest id of the group."""
    rows = cut_lineage(fingerprints(distinct_documents(docs, id_col, text_col), width, words))
    same = ["n", "fp"] if ratio else ["fp"]
    points = cut_lineage(rows.groupBy(*same).agg(F.min("id").alias("low"), *([] if ratio else [F.max("n").alias("n")])))
    group = components(links(points.select(F.col("low").alias("id"), "n", "fp"), radius, words, parts, ratio, leaf, homes))
    of_point = points.join(group.withColumnRenamed("node", "low"), "low", "left").select(*same, F.coalesce("root", "low").alias("component_id"))
    return rows.withColumnRenamed("id", "doc_id").join(of_point, same).select(outer_id(), "fp", outer_id("component_id"))
