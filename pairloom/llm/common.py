"""What the operators share: document rows, byte buffers, hashes and packed arrays.

Rows of a document table are reduced to ``(doc_id, text)`` before any work, so further
columns, whatever their names, never clash.  A null id counts as one id below all others.
Rows that repeat an id count as one document, the one with the smallest text (null first).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from pairloom.plans import cut_lineage

NULL_ID = -(2**63)
U64 = np.uint64


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """(doc_id, text), one row per id; the id null becomes NULL_ID.  ``carry`` names columns to
    keep, as fields of a column ``row``."""
    extra = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    base = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        *extra,
    )
    repeated = cut_lineage(base.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return base
    rest = ["text", "row"] if carry else ["text"]
    one = base.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNotNull().alias("b"), *rest)).alias("m"))
    return base.join(repeated, "doc_id", "left_anti").unionByName(one.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in rest]))


def outer_id(col="doc_id"):
    """The id as the caller knows it."""
    c = F.col(col)
    return F.when(c != F.lit(NULL_ID), c).alias(col)


def fold(modulus: int, id_col="doc_id"):
    """crc32 of the id as text, modulo; null for the id null."""
    return F.pmod(F.crc32(outer_id(id_col).cast("string").cast("binary")), F.lit(modulus))


def shuffle_partitions(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def byte_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; null reads as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(offsets: np.ndarray, limit: int):
    """Ranges [i, j) of rows with at most ``limit`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> U64(32))
    h *= U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


class Rolling:
    """Polynomial hashes modulo 2**64 of any byte range, from one running sum."""

    BASE, OTHER = 0x5851F42D4C957F2D, 0xD1342543DE82EF95
    tables: dict = {}

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        if base not in Rolling.tables or len(Rolling.tables[base][0]) < n + 1:
            size = max(n + 1, 1 << 20)
            Rolling.tables[base] = Rolling._series(base, size), Rolling._series(pow(base, -1, 2**64), size)
        self.powers, self.inverse = Rolling.tables[base]
        self.sums = np.zeros(n + 1, np.uint64)
        x = data.astype(np.uint64)
        x += U64(1)
        x *= self.powers[:n]
        np.cumsum(x, out=self.sums[1:])

    @staticmethod
    def _series(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of every k bytes in a row."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Starts and ends of the runs of bytes with ``inside[byte]``, and each run's row."""
    n = len(data)
    flag = inside[data]
    change = np.zeros(n + 1, bool)
    if n:
        change[0], change[n] = flag[0], flag[-1]
        change[1:n] = flag[1:] != flag[:-1]
    # a row boundary inside a run ends one run and starts the next
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    cut = cut[flag[cut] & flag[cut - 1]] if len(cut) else cut
    edges = np.flatnonzero(change)
    starts, ends = edges[0::2], edges[1::2]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def repeat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the row before."""
    n = len(keys[0])
    out = np.ones(n, bool)
    if n:
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes; each is split into byte planes, which compress well."""
    n = len(arrays[0])
    out = [struct.pack("<qB", n, len(arrays))]
    for a in arrays:
        out.append(a.dtype.str.encode().ljust(4))
        out.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, count = struct.unpack_from("<qB", raw)
    at, out = 9, []
    for _ in range(count):
        kind = np.dtype(raw[at : at + 4].decode().strip())
        size = kind.itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at + 4).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 4 + n * size
    return out


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of half-open spans per document, sorted."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    new = first_of_runs(doc)
    group = np.cumsum(new) - 1
    # a running maximum per document: lift each document's ends above all earlier ones
    lift = group.astype(np.int64) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    begin = new.copy()
    begin[1:] |= (start + lift)[1:] > reach[:-1]
    at = np.flatnonzero(begin)
    last = np.append(at[1:] - 1, len(doc) - 1)
    return doc[at], start[at], reach[last] - lift[last]
