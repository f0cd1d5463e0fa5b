"""Benchmark decontamination with spaced seeds.

Tokens are runs of letters, digits and bytes above ASCII of the lower-cased text.  A mask
keeps some positions of a span and ignores the rest, so a hash of the kept tokens survives a
substitution between them.  The two masks of ``MASKS`` together hit every stretch of
``STRETCH`` tokens with any two tokens substituted.  Documents' hashes at every position are
looked up among the test items' hashes; around each hit the texts are laid side by side and
the longest stretch is taken that starts and ends on equal tokens, has at least ``SHARE`` of
equal tokens and ``STRETCH`` tokens (or the whole item, if shorter).  Items shorter than a
mask are looked up as a whole, without gaps.

The items are a stated query set, held against all documents: they are sent to the tasks in
blocks of at most ``ITEM_BYTES`` of text (or one item), however many blocks that takes, and
no document moves.  Null and empty texts, and items without tokens, match nothing; items that
repeat an id count once (smallest text), the item id null matches as null.  Ties between places
go to the shorter stretch, then the earlier one.  An empty table on either side gives no rows.
Texts are searched whole; a token that recurs all through a text and an item costs a look at each
of their diagonals.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import Rolling, U64, blocks, byte_rows, distinct_documents, mix, outer_id, word_bounds

MASKS = ("111100011", "1000101111")
STRETCH, SHARE = 13, 0.8
ITEM_BYTES, BLOCK = 1 << 24, 1 << 18
FILTER_BITS = 22
HITS = 1 << 21  # hits that are turned into diagonals at once
RESULT = "doc_id long, item_id long, matched long, overlap long, item_tokens long, doc_start long, item_start long"

INSIDE = np.zeros(256, bool)
INSIDE[ord("0") : ord("9") + 1] = INSIDE[ord("a") : ord("z") + 1] = INSIDE[128:] = True


def tokens(column):
    """Token hashes of all rows, and the n+1 offsets of the rows in them."""
    data, offs = byte_rows(column)
    hashes, rows = [], []
    for i, j in blocks(offs, BLOCK):
        part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        start, end, row = word_bounds(part, own, INSIDE)
        hashes.append(Rolling(part).spans(start, end))
        rows.append(np.bincount(row, minlength=j - i) if len(row) else np.zeros(j - i, np.int64))
    counts = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def seeds(tok: np.ndarray, offsets: np.ndarray, mask: str, salt: int):
    """Hash of the kept tokens and position, wherever the mask fits in a row."""
    n = len(tok) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, salt, np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            h = (h + tok[k : k + n]) * U64(0x5851F42D4C957F2D)
    h = mix(h)
    fits = np.zeros(n + 1, np.int32)
    size = np.diff(offsets)
    room = size >= len(mask)
    np.add.at(fits, offsets[:-1][room], 1)
    np.add.at(fits, offsets[1:][room] - len(mask) + 1, -1)
    at = np.flatnonzero(np.cumsum(fits)[:n] > 0)
    return h[at], at


def best_stretch(same: np.ndarray, share: float, least: int):
    """(start, length, equal) of the longest stretch with the share of equal tokens."""
    gain = np.concatenate([[0.0], np.cumsum(same - share)]) + 1e-9 * np.arange(len(same) + 1)
    ends = np.flatnonzero(same) + 1
    starts = ends - 1
    if not len(ends):
        return None
    # the lowest gain up to each start falls; look each end up in it
    low = np.minimum.accumulate(gain[starts])
    first = np.searchsorted(-low, -gain[ends] - 1e-12, "left")
    ok = first < len(starts)
    ok[ok] &= starts[first[ok]] < ends[ok]
    if not ok.any():
        return None
    size = np.where(ok, ends - starts[np.minimum(first, len(starts) - 1)], 0)
    k = int(np.argmax(size))
    if size[k] < least:
        return None
    a = int(starts[first[k]])
    return a, int(size[k]), int(same[a : ends[k]].sum())


class Items:
    """The seeds of a block of test items, ready for look-ups."""

    def __init__(self, ids: np.ndarray, column, masks=MASKS, stretch=STRETCH, share=SHARE):
        self.ids, self.stretch, self.share = ids, stretch, share
        self.tok, self.offs = tokens(column)
        size = np.diff(self.offs)
        shortest = min(map(len, masks))
        whole = sorted({int(x) for x in size if 0 < x < shortest})
        self.tables = []
        for salt, mask in enumerate([*masks, *["1" * x for x in whole]]):
            h, at = seeds(self.tok, self.offs, mask, salt + 1)
            item = np.searchsorted(self.offs, at, "right") - 1
            if salt >= len(masks):
                keep = size[item] == len(mask)
                h, at, item = h[keep], at[keep], item[keep]
            order = np.argsort(h, kind="stable")
            some = np.zeros(1 << FILTER_BITS, bool)
            some[(h >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((salt + 1, mask, h[order], at[order] - self.offs[item[order]], item[order], some))

    def overlaps(self, column):
        """(row, item index, equal, length, row start, item start), the best for each row and item."""
        tok, offs = tokens(column)
        # a diagonal of a row and an item as one number
        longest = int(np.diff(self.offs).max(initial=0)) + 1
        width = longest + int(np.diff(offs).max(initial=0)) + 1
        found = []
        for salt, mask, h, pos, item, some in self.tables:
            own, at = seeds(tok, offs, mask, salt)
            maybe = some[(own >> U64(64 - FILTER_BITS)).astype(np.int64)]
            own, at = own[maybe], at[maybe]
            lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            at, lo, count = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            # a seed that recurs in the items gives a hit for each place; many hits are few diagonals
            group = (np.cumsum(count) - count) // HITS
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(group)) + 1):
                n = count[part]
                k = np.repeat(lo[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                place = np.repeat(at[part], n)
                row = np.searchsorted(offs, place, "right") - 1
                found.append(np.unique((row * len(self.ids) + item[k]) * width + (place - offs[row] - pos[k] + longest)))
        code = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        row, item, shift = code // width // len(self.ids), code // width % len(self.ids), code % width - longest
        best: dict = {}
        for r, i, s in zip(row.tolist(), item.tolist(), shift.tolist()):
            n, m = int(offs[r + 1] - offs[r]), int(self.offs[i + 1] - self.offs[i])
            lo, hi = max(0, -s), min(m, n - s)
            a, b = offs[r] + s, self.offs[i]
            found = best_stretch(tok[a + lo : a + hi] == self.tok[b + lo : b + hi], self.share, min(self.stretch, m))
            if found:
                start, size, equal = found
                cand = (-equal, size, s + lo + start, lo + start)
                if (r, i) not in best or cand < best[r, i]:
                    best[r, i] = cand
        return [(r, i, -c[0], c[1], c[2], c[3]) for (r, i), c in best.items()]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = ITEM_BYTES):
    """The test items in blocks of bounded size."""
    rows = distinct_documents(benchmark, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // limit) * 2 if total > limit else 1
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(count)) == k).orderBy("doc_id").toArrow()
        if part.num_rows:
            yield part.column("doc_id").to_numpy(), pc.utf8_lower(part.column("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(doc_id, item_id, matched, overlap, item_tokens, doc_start, item_start) for every document
    and item that overlap; places count tokens."""
    docs = distinct_documents(docs, id_col, text_col)
    # the look-up tables are built in the tasks: only the texts are sent
    parts = [docs.mapInArrow(_finder(ids, texts, params), RESULT) for ids, texts in item_blocks(benchmark)]
    out = functools.reduce(DataFrame.unionByName, parts, docs.sparkSession.createDataFrame([], RESULT))
    return out.select(outer_id(), outer_id("item_id"), "matched", "overlap", "item_tokens", "doc_start", "item_start")


def _finder(ids, texts, params):
    def run(batches):
        items = Items(ids, texts, **params)
        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            found = items.overlaps(pc.utf8_lower(batch.column("text")))
            cols = [[own[r] for r, *_ in found], [int(ids[i]) for _, i, *_ in found], [x[2] for x in found], [x[3] for x in found],
                    [int(items.offs[x[1] + 1] - items.offs[x[1]]) for x in found], [x[4] for x in found], [x[5] for x in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "matched", "overlap", "item_tokens", "doc_start", "item_start"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The rows of docs, all columns, that overlap with no item."""

    def cleaner(ids, texts):
        def run(batches):
            items = Items(ids, texts, **params)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in items.overlaps(pc.utf8_lower(batch.column(text_col)))]] = False
                yield batch.filter(pa.array(keep))

        return run

    for ids, texts in item_blocks(benchmark):
        docs = docs.mapInArrow(cleaner(ids, texts), docs.schema)
    return docs
