"""Removal of repeated byte strings by prefix-free parsing.

Every ``length``-byte window takes as trigger the smallest rolling hash of its
``TRIGGER``-byte strings.  A maximal run of windows with one trigger is a phrase; its text
reaches to the end of its last window.  Equal windows have equal triggers wherever they
stand, so each window lies in exactly one phrase and can only recur under the same trigger.

1. parse: tasks cut their documents into phrases and collapse equal ones of a block, then of a
   chunk of ``CHUNK`` phrases; the rows (trigger, phrase hash, first document, place) go to
   buckets of the trigger, of which there are more the more bytes the texts have.
2. dictionary: a phrase's first document owns it; occurrences in later documents are
   removed whole.  Distinct phrases under one trigger may share some windows only: these
   entries alone are fetched as text.
3. suffix array: a trigger's dictionary texts are sorted by their suffixes to the depth of a
   window; a run of equal suffixes belongs to its smallest document.
4. corpus order: the spans are merged by document and cut out.

A trigger that many phrases share (a common header, say) is split: each of its windows is a
phrase of its own with a trigger from its own hash, which equal windows share, and a phrase hash
to another base.  Such triggers are
found on every ``SHARE``-th document (by hash), where they have ``OFTEN`` phrases or more; which
ones are found decides speed only, never results.

No step gathers more than one bucket of the dictionary or one document.  Triggers replace
the usual "hash modulo p" rule, which leaves windows without any trigger.

Null and empty texts have nothing to remove, an empty table gives no rows.  Long texts are parsed
in pieces.  Repeats within one document stay.  Equal ids: see ``common``.  The first document (smallest id) keeps its text.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pairloom.llm.common import (
    Rolling,
    U64,
    blocks,
    byte_rows,
    distinct_documents,
    first_of_runs,
    merged,
    mix,
    outer_id,
    packed,
    repeat_ranges,
    shuffle_partitions,
    unpacked,
)
from pairloom.plans import cut_lineage

LENGTH, TRIGGER = 50, 20
BLOCK, CHUNK = 1 << 18, 1 << 20  # bytes hashed at once, phrases and spans kept before rows are sent
PIECE = 1 << 19  # bytes of a long text that are parsed at once
BUCKET = 1 << 23  # bytes of text a bucket
KEY = U64((1 << 48) - 1)
SHARE, OFTEN, SPLIT = 32, 64, 1 << 20  # SPLIT: most triggers that are sent to the tasks
FOUND = "doc_id long, start long, end long, trigger long"
SPANS = "doc_id long, start long, end long"


def window_minimum(h: np.ndarray, width: int, n: int) -> np.ndarray:
    """Smallest of ``width`` values from each of the first n places."""
    m, span = h, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[:n], m[width - span : width - span + n]) if span < width else m[:n]


def parse(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, split: np.ndarray = np.zeros(0, np.uint64)):
    """Phrases of the rows: (row, place in the row, windows, trigger, phrase hash).  Windows under
    a trigger of ``split`` (sorted) are phrases of their own."""
    n = len(data) - length + 1
    if n <= 0:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    k = min(TRIGGER, length)
    roll = Rolling(data)
    m = window_minimum(roll.grams(k), length - k + 1, n)
    edge = np.zeros(n + 1, np.int32)
    long_enough = np.diff(offsets) >= length
    np.add.at(edge, offsets[:-1][long_enough], 1)
    np.add.at(edge, offsets[1:][long_enough] - length + 1, -1)
    valid = np.cumsum(edge)[:n] > 0
    # two rows meet at invalid windows, or where the next row starts
    change = m[1:] != m[:-1]
    if length == 1:
        change[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)] - 1] = True
    first, last = valid.copy(), valid.copy()
    first[1:] &= ~valid[:-1] | change
    last[:-1] &= ~valid[1:] | change
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    trigger = m[s] & KEY
    cut = np.zeros(0, bool)
    if len(split):
        cut = split[np.minimum(np.searchsorted(split, trigger), len(split) - 1)] == trigger
        count = np.where(cut, e - s + 1, 1)
        at = repeat_ranges(s, count)
        cut, e = np.repeat(cut, count), np.repeat(e, count)
        s, e, trigger = at, np.where(cut, at, e), np.repeat(trigger, count)
        own = mix(roll.spans(s[cut], s[cut] + length) ^ U64(0x9E3779B97F4A7C15))
        trigger[cut] = own & KEY
    phrase = roll.spans(s, e + length) & KEY
    if cut.any():
        # the trigger is a hash of the same bytes: a second base makes 96 bits of both
        phrase[cut] = Rolling(data, Rolling.OTHER).spans(s[cut], e[cut] + length) & KEY
    row = np.searchsorted(offsets, s, "right") - 1
    return row, s - offsets[row], e - s + 1, trigger, phrase


def collapse(doc, pos, n, trig, phrase, length: int):
    """Phrases by trigger and hash without those that a smaller document has too; their spans."""
    order = np.lexsort((doc, phrase, trig))
    doc, pos, n, trig, phrase = (x[order] for x in (doc, pos, n, trig, phrase))
    new = first_of_runs(trig, phrase)
    later = doc > doc[new][np.cumsum(new) - 1] if len(doc) else np.zeros(0, bool)
    spans = merged(doc[later], pos[later], pos[later] + n[later] + length - 1)
    return [x[~later] for x in (doc, pos, n, trig, phrase)], spans


def _triggers(length: int):
    def run(batches):
        for batch in batches:
            data, offs = byte_rows(batch.column("text"))
            for i, j in blocks(offs, BLOCK):
                _, _, _, trig, phrase = parse(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length)
                trig, n = np.unique(np.unique(np.stack([trig, phrase]), axis=1)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(trig.astype(np.int64)), pa.array(n)], ["trigger", "n"])

    return run


def common_triggers(docs: DataFrame, length: int, share: int, often: int) -> np.ndarray:
    """Sorted triggers with at least ``often`` phrases in every ``share``-th document."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    counts = some.mapInArrow(_triggers(length), "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= often).orderBy(F.desc("n"), "trigger").limit(SPLIT).toArrow()
    return np.sort(found.column("trigger").to_numpy().astype(np.uint64))


def _span_rows(doc, start, end, trigger=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.nulls(len(doc), pa.int64()) if trigger is None else pa.array(trigger, pa.int64())],
        ["doc_id", "start", "end", "trigger"],
    )


def _parser(buckets: int, length: int, split: np.ndarray):
    step = ((1 << 48) + buckets - 1) // buckets

    def send(parts, spans):
        (doc, pos, n, trig, phrase), more = collapse(*(np.concatenate(x) for x in zip(*parts)), length)
        spans = merged(*(np.concatenate(x) for x in zip(*spans, more)))
        # 48-bit triggers are minima, so low values prevail: spread them before cutting ranges
        place = ((trig * U64(0x9E3779B97F4A7C15)) & KEY) // U64(step)
        order = np.argsort(place, kind="stable")
        doc, pos, n, trig, phrase, place = (x[order] for x in (doc, pos, n, trig, phrase, place))
        cuts = np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64))
        ids, codes = np.unique(doc, return_inverse=True)
        rows = []
        for b in range(buckets):
            i, j = cuts[b], cuts[b + 1]
            if i < j:
                step_back = np.diff(trig[i:j], prepend=U64(0))
                table, local = np.unique(codes[i:j], return_inverse=True)
                rows.append((b, packed(step_back, phrase[i:j], local.astype(np.uint32), pos[i:j].astype(np.uint32), n[i:j].astype(np.uint32)), packed(ids[table])))
        if len(spans[0]):
            rows.append((int(spans[0][0] % buckets), None, packed(*spans)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "phrases", "rest"])

    def run(batches):
        parts, spans, size = [], [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offs = byte_rows(batch.column("text"))
            for i, j in blocks(offs, BLOCK):
                # one long row is parsed in pieces that overlap by a window less one byte
                lo, hi = int(offs[i]), int(offs[j])
                cut = range(lo, max(lo + 1, hi - length + 1), PIECE) if j == i + 1 else [lo]
                for a in cut:
                    z = min(hi, a + PIECE + length - 1) if j == i + 1 else hi
                    row, pos, n, trig, phrase = parse(data[a:z], np.array([0, z - a]) if j == i + 1 else offs[i : j + 1] - lo, length, split)
                    kept, found = collapse(ids[i:j][row], pos + (a - lo if j == i + 1 else 0), n, trig, phrase, length)
                    parts.append(kept)
                    spans.append(found)
                    size += len(kept[0]) + len(found[0])
                    if size >= CHUNK:
                        yield send(parts, spans)
                        parts, spans, size = [], [], 0
        if parts:
            yield send(parts, spans)

    return run


def _dictionary(length: int):
    def run(table: pa.Table) -> pa.Table:
        got, spans = [], []
        for phrases, rest in zip(table.column("phrases").to_pylist(), table.column("rest").to_pylist()):
            if phrases is None:
                spans.append(unpacked(rest))
                continue
            (ids,) = unpacked(rest)
            trig, phrase, local, pos, n = unpacked(phrases)
            got.append((np.cumsum(trig, dtype=np.uint64), phrase, ids[local], pos.astype(np.int64), n.astype(np.int64)))
        out = [_span_rows(*s) for s in spans]
        if got:
            trig, phrase, doc, pos, n = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((doc, phrase, trig))
            trig, phrase, doc, pos, n = (x[order] for x in (trig, phrase, doc, pos, n))
            new = first_of_runs(trig, phrase)
            later = doc > doc[new][np.cumsum(new) - 1]
            out.append(_span_rows(*merged(doc[later], pos[later], pos[later] + n[later] + length - 1)))
            trig, doc, pos, n = (x[~later] for x in (trig, doc, pos, n))
            new = np.flatnonzero(first_of_runs(trig))
            mixed = np.minimum.reduceat(doc, new) < np.maximum.reduceat(doc, new)
            ask = np.repeat(mixed, np.diff(np.append(new, len(doc))))
            out.append(_span_rows(doc[ask], pos[ask], pos[ask] + n[ask] + length - 1, trig[ask].astype(np.int64)))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_span_rows([], [], [])])

    return run


def _fetch(batches):
    """The dictionary texts that a document was asked for."""
    for batch in batches:
        data, offs = byte_rows(batch.column("text"))
        asked = batch.column("asked").combine_chunks() if isinstance(batch.column("asked"), pa.ChunkedArray) else batch.column("asked")
        flat = asked.flatten()
        start, end, trig = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        count = np.diff(np.asarray(asked.offsets))
        row = np.repeat(np.arange(len(count)), count)
        size = end - start
        text = data[repeat_ranges(offs[row] + start, size)]
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))])
        yield pa.RecordBatch.from_arrays([pa.array(trig, pa.int64()), pa.array(ids[row], pa.int64()), pa.array(start, pa.int64()), texts.cast(pa.binary())], ["trigger", "doc_id", "start", "phrase"])


def _suffix_order(length: int):
    """Sort the suffixes of a bucket's dictionary to the depth of a window; a run of equal
    ones belongs to the smallest document."""

    def run(table: pa.Table) -> pa.Table:
        data, offs = byte_rows_binary(table.column("phrase"))
        doc, start, trig = (table.column(c).to_numpy() for c in ("doc_id", "start", "trigger"))
        out = []
        order = np.argsort(trig, kind="stable")
        # whole triggers at a time, so that the sorted suffixes stay small
        size = np.diff(offs)[order]
        ends = np.flatnonzero(np.append(first_of_runs(trig[order])[1:], True)) + 1
        i = 0
        done = np.concatenate([[0], np.cumsum(size)])
        while i < len(order):
            j = int(ends[min(len(ends) - 1, max(np.searchsorted(ends, i, "right"), np.searchsorted(done[ends], done[i] + (1 << 20), "right") - 1))])
            rows = order[i:j]
            count = np.diff(offs)[rows] - length + 1
            at = repeat_ranges(offs[rows], count)
            suffix = np.lib.stride_tricks.sliding_window_view(data, length)[at]
            suffix = np.ascontiguousarray(suffix).view(f"S{length}").reshape(-1)
            owner = np.repeat(doc[rows], count)
            place = at - np.repeat(offs[rows] - start[rows], count)
            rank = np.lexsort((owner, suffix))
            suffix, owner, place = suffix[rank], owner[rank], place[rank]
            new = first_of_runs(suffix)
            later = owner > owner[new][np.cumsum(new) - 1]
            out.append(_span_rows(*merged(owner[later], place[later], place[later] + length)).select(["doc_id", "start", "end"]))
            i = j
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_span_rows([], [], []).select(["doc_id", "start", "end"])])

    return run


def byte_rows_binary(column) -> tuple[np.ndarray, np.ndarray]:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_binary())
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return np.frombuffer(arr.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def repeated_spans(docs: DataFrame, length: int = LENGTH, share: int = SHARE, often: int = OFTEN) -> DataFrame:
    """(doc_id, start, end): bytes covered by a ``length``-byte string that also starts in a
    document with a smaller id.  ``docs``: the rows of ``distinct_documents``.  Spans of a
    document may touch or overlap."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * shuffle_partitions(docs.sparkSession), -(-size // BUCKET))
    split = common_triggers(docs, length, share, often)
    rows = docs.mapInArrow(_parser(buckets, length, split), "bucket int, phrases binary, rest binary")
    found = cut_lineage(rows.groupBy("bucket").applyInArrow(_dictionary(length), FOUND))
    asked = found.where("trigger IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "trigger")).alias("asked"))
    texts = docs.join(asked, "doc_id").mapInArrow(_fetch, "trigger long, doc_id long, start long, phrase binary")
    partial = texts.groupBy(F.pmod(F.xxhash64("trigger"), F.lit(buckets)).alias("bucket")).applyInArrow(lambda t: _suffix_order(length)(t), SPANS)
    return found.where("trigger IS NULL").select("doc_id", "start", "end").unionByName(partial)


def _cut(keep_text: bool, carry: bool):
    def run(batches):
        for batch in batches:
            data, offs = byte_rows(batch.column("text"))
            spans = batch.column("spans").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            cols: list[list] = [[], [], [], [], [], []]
            for k, found in enumerate(spans):
                raw = data[offs[k] : offs[k + 1]].tobytes()
                kept, removed, n = raw, 0, 0
                if found:
                    s = np.array([x["start"] for x in found], np.int64)
                    e = np.array([x["end"] for x in found], np.int64)
                    _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                    n, removed = len(s), int((e - s).sum())
                    kept = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)]))
                row = (ids[k], len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)] + ([batch.column("row")] if carry else []), names + ["row"] * carry)

    return run


def strip_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    and ``kept``, the remaining text (bytes of a character cut in two are left out).  The
    columns named by ``carry`` come along in a column ``row``."""
    docs = distinct_documents(docs, id_col, text_col, carry)
    spans = repeated_spans(docs.select("doc_id", "text"), length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    if carry:
        kind = kind.add(docs.schema["row"])
    return docs.join(spans, "doc_id", "left").mapInArrow(_cut(keep_text, bool(carry)), kind).withColumn("doc_id", outer_id())
