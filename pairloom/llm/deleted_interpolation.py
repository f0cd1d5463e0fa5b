"""Language-model scores by deleted interpolation.

P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1), the weights l by bucket of the
context's count: 0, 1, 2, 3-4, 5-8, ...  They are learned by expectation-maximisation on one fold
of the training rows (``DELETED``), with maximum-likelihood estimates from the others and buckets
of the counts there; the counts of the final model come from all training rows.  Tokens: words
(A-Z lower-cased, split at ASCII white space) and one end a text, which is a token; the context of
a first word is the start.  A context without counts has l2 = 0.

Every word is a context.  Those with at least a share ``1 / CONTEXTS`` of the text's bytes over six
are common: there are at most a few times ``CONTEXTS`` of them, and they are sent to the tasks with
their counts, which spares shuffles and changes no result.

Tasks pass on packed (word, context, document) counts, dealt out by context, or by word and
context if the context is common, so that c(v) and c(v, w) are summed in one place.  There a common
word is scored; events of rarer words go on, dealt out by word, to where c(w) is summed.  Chunks of
documents gather packed partial sums of their scores.  For the weights, (context, word) counts of
the two parts take the same way, and each bucket's probabilities are summed in cells of a quarter
of a logarithm: a bounded table for any corpus.

Null texts are empty: one token, the end.  Without training rows every token has l0 / (V + 1)
with l0 = 1.  Equal ids: see ``common``; the id null is a training row.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import Rolling, U64, blocks, byte_rows, first_of_runs, mix, packed, unpacked, word_bounds
from pairloom.plans import cut_lineage

FOLDS, HELD_OUT, DELETED = 7, 2, 3
CONTEXTS = 1 << 16
BLOCK, CHUNK, BUCKET, PARTS = 1 << 18, 1 << 23, 1 << 24, 16
END, START = U64(1), U64(2)
EM_ROUNDS = 200

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(row, word, context) of every token, in order; the last of a row is END."""
    low = LOWER[data]
    start, end, row = word_bounds(low, offsets, WORD)
    n = len(offsets) - 1
    size = np.bincount(row, minlength=n) + 1
    word = np.full(int(size.sum()), END, np.uint64)
    rows = np.repeat(np.arange(n), size)
    last = np.cumsum(size) - 1
    inside = np.ones(len(word), bool)
    inside[last] = False
    word[inside] = Rolling(low).spans(start, end) | U64(4)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[last - size + 1] = START
    return rows, word, context


def _chunks(batches, columns):
    """Token arrays of about CHUNK bytes of text: the given columns by token, word, context."""
    parts, size = [], 0
    for batch in batches:
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        data, offs = byte_rows(batch.column("text"))
        for i, j in blocks(offs, BLOCK):
            rows, word, context = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            parts.append([*[c[i:j][rows] for c in own], word, context])
            size += int(offs[j] - offs[i])
            if size >= CHUNK:
                yield [np.concatenate(x) for x in zip(*parts)]
                parts, size = [], 0
    if parts:
        yield [np.concatenate(x) for x in zip(*parts)]


def _words(batches):
    for fold, word, _ in _chunks(batches, ["fold"]):
        keep = fold != HELD_OUT
        word, deleted = word[keep], fold[keep] == DELETED
        order = np.argsort(word, kind="stable")
        word, deleted = word[order], deleted[order]
        at = np.flatnonzero(first_of_runs(word))
        if len(at):
            n, b = np.diff(np.append(at, len(word))), np.add.reduceat(deleted.astype(np.int64), at)
            yield pa.RecordBatch.from_arrays([pa.array(word[at].view(np.int64)), pa.array(n - b), pa.array(b)], ["word", "a", "b"])


def _frequent(least: int):
    def run(batches):
        total = np.zeros(3, np.int64)
        for batch in batches:
            word, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("word", "a", "b"))
            total += (len(word), a.sum(), b.sum())
            keep = (a + b >= least) | (word == int(END))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (word, a, b)] + [pa.array(np.zeros(int(keep.sum()), np.int64))], ["word", "a", "b", "types"])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (0, total[1], total[2], total[0])], ["word", "a", "b", "types"])

    return run


class Contexts:
    """The common words: sorted hashes and counts.  Code 0 is every other word."""

    def __init__(self, word: np.ndarray, a: np.ndarray, b: np.ndarray):
        order = np.argsort(word)
        self.word = word[order]
        self.a, self.b = (np.concatenate([[0], x[order]]) for x in (a, b))

    def code(self, word: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        return np.where(self.word[at] == word, at + 1, 0)


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for the count 0, then 1, 2, 3-4, 5-8, ..."""
    return np.where(count > 0, 1 + np.ceil(np.log2(np.maximum(1, count))), 0).astype(np.int64)


def _runs(word: np.ndarray):
    at = np.flatnonzero(first_of_runs(word))
    return word[at], np.diff(np.append(at, len(word))).astype(np.uint32)


def _steps(word: np.ndarray) -> np.ndarray:
    return np.diff(word, prepend=word.dtype.type(0))


def _rolled(word: np.ndarray) -> bytes:
    words, size = _runs(word)
    return packed(_steps(words), size)


def _unrolled(blob: bytes) -> np.ndarray:
    steps, size = unpacked(blob)
    return np.repeat(np.cumsum(steps, dtype=np.uint64), size)


def _place(word, context, code, buckets: int):
    """By context; by word and context where the context is common."""
    return (mix(context ^ np.where(code > 0, word * U64(0x9E3779B97F4A7C15), U64(0))) % U64(buckets)).astype(np.int64)


def _sent(ctx: Contexts, word, context, code, *rest) -> list[bytes]:
    """Rows as blobs: common contexts by code, sorted by word; others sorted by context."""
    hot, own = np.flatnonzero(code > 0), np.flatnonzero(code == 0)
    own = own[np.lexsort((word[own], context[own]))]
    of = ctx.code(word[own])
    return [
        _rolled(word[hot]), packed(code[hot].astype(np.uint32), *[x[hot] for x in rest]),
        _rolled(context[own]), packed(of.astype(np.uint32), *[x[own] for x in rest]), packed(word[own][of == 0]),
    ]


def _received(ctx: Contexts, blobs: list[bytes]):
    """(word, context, the other columns) of rows made by ``_sent``."""
    code, *hot = unpacked(blobs[1])
    of, *own = unpacked(blobs[3])
    context = np.concatenate([ctx.word[code.astype(np.int64) - 1], _unrolled(blobs[2])])
    word = np.empty(len(of), np.uint64)
    word[of > 0] = ctx.word[of[of > 0].astype(np.int64) - 1]
    (word[of == 0],) = unpacked(blobs[4])
    return np.concatenate([_unrolled(blobs[0]), word]), context, *[np.concatenate(x) for x in zip(hot, own)]


def _cuts(place: np.ndarray, buckets: int):
    """(bucket, i, j) of the rows sorted by place."""
    cuts = np.searchsorted(place, np.arange(buckets + 1))
    return [(k, i, j) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]


BLOBS = pa.list_(pa.binary())


def _send_counts(ctx: Contexts, buckets: int):
    def run(batches):
        for fold, word, context in _chunks(batches, ["fold"]):
            keep = fold != HELD_OUT
            word, context, b = word[keep], context[keep], (fold[keep] == DELETED).astype(np.int64)
            order = np.lexsort((context, word))
            word, context, b = word[order], context[order], b[order]
            at = np.flatnonzero(first_of_runs(word, context))
            n = np.diff(np.append(at, len(word)))
            b = np.add.reduceat(b, at) if len(at) else b
            word, context = word[at], context[at]
            code = ctx.code(context)
            place = _place(word, context, code, buckets)
            order = np.argsort(place, kind="stable")
            cols = [x[order] for x in (word, context, code, (n - b).astype(np.uint32), b.astype(np.uint32))]
            rows = [(k, _sent(ctx, *[c[i:j] for c in cols])) for k, i, j in _cuts(place[order], buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], BLOBS)], ["bucket", "blobs"])

    return run


def _ranges(words: np.ndarray):
    """A bucket's rows in PARTS ranges of the word's hash, so that sorting needs little room."""
    place = (words >> U64(60)).astype(np.uint8)
    for k in range(PARTS):
        own = np.flatnonzero(place == k)
        if len(own):
            yield own


def _by_word(word, n):
    """Sum of n over each run of equal words, at every row."""
    at = np.flatnonzero(first_of_runs(word))
    return np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(word))))


CELLS = "bucket int, word binary, blob binary, cell long, n double, p1 double, p2 double"


def _cell_table(of_context, of_word, a, b, total_a: int) -> pa.Table:
    """Sums over (context, word) pairs with b > 0 by bucket and rounded probabilities."""
    held = b > 0
    of_context, of_word, a, b = (x[held] for x in (of_context, of_word, a, b))
    p1 = of_word / max(1, total_a)
    p2 = a / np.maximum(1, of_context)
    q1, q2 = (np.where(p > 0, np.round(np.log(np.maximum(p, 1e-300)) * 4), 1).astype(np.int64) for p in (p1, p2))
    key = (bucket_of(of_context) << 32) + ((q1 + (1 << 14)) << 16) + (q2 + (1 << 14))
    order = np.argsort(key, kind="stable")
    key, b, p1, p2 = key[order], b[order], p1[order], p2[order]
    at = np.flatnonzero(first_of_runs(key))
    sums = [np.add.reduceat(x, at) if len(at) else x[:0] for x in (b.astype(float), b * p1, b * p2)]
    none = len(at)
    return pa.table({"bucket": pa.nulls(none, pa.int32()), "word": pa.nulls(none, pa.binary()), "blob": pa.nulls(none, pa.binary()), "cell": pa.array(key[at]), **{c: pa.array(x) for c, x in zip(("n", "p1", "p2"), sums)}})


def _cells(ctx: Contexts, total_a: int, buckets: int):
    """Pairs by context: cells of the common words, blobs of all others by bucket of the word."""

    def run(table: pa.Table) -> pa.Table:
        cols = [np.concatenate(x) for x in zip(*[_received(ctx, x) for x in table.column("blobs").to_pylist()])]
        out, left = zip(*[part(*[c[own] for c in cols]) for own in _ranges(cols[1])])
        cols.clear()
        word, of_context, a, b = (np.concatenate(x) for x in zip(*left))
        place = (mix(word.copy()) % U64(buckets)).astype(np.int64)
        order = np.lexsort((word, place))
        word, of_context, a, b = (x[order] for x in (word, of_context, a, b))
        rows = [(k, _rolled(word[i:j]), packed(*[x[i:j] for x in (of_context, a, b)])) for k, i, j in _cuts(place[order], buckets)]
        none = len(rows)
        sent = {"bucket": pa.array([r[0] for r in rows], pa.int32()), "word": pa.array([r[1] for r in rows], pa.binary()), "blob": pa.array([r[2] for r in rows], pa.binary()), "cell": pa.nulls(none, pa.int64())}
        return pa.concat_tables([*out, pa.table(sent | {c: pa.nulls(none, pa.float64()) for c in ("n", "p1", "p2")})])

    def part(word, context, a, b):
        order = np.lexsort((word, context))
        word, context, a, b = word[order], context[order], a[order].astype(np.int64), b[order].astype(np.int64)
        at = np.flatnonzero(first_of_runs(context, word))
        word, context, a, b = word[at], context[at], np.add.reduceat(a, at), np.add.reduceat(b, at)
        code, known = ctx.code(context), ctx.code(word)
        of_context = np.where(code > 0, ctx.a[code], _by_word(context, a))
        hot, rare = known > 0, known == 0
        return _cell_table(of_context[hot], ctx.a[known[hot]], a[hot], b[hot], total_a), (word[rare], *[x[rare].astype(np.uint32) for x in (np.where(b > 0, of_context, 0), a, b)])

    return run


def _rare_cells(total_a: int):
    def run(table: pa.Table) -> pa.Table:
        word = np.concatenate([_unrolled(x) for x in table.column("word").to_pylist()])
        counts = [np.concatenate(x) for x in zip(*[unpacked(x) for x in table.column("blob").to_pylist()])]
        order = np.argsort(word, kind="stable")
        of_context, a, b = (x[order].astype(np.int64) for x in counts)
        return _cell_table(of_context, _by_word(word[order], a), a, b, total_a).select(["cell", "n", "p1", "p2"])

    return run


def learn_weights(bucket: np.ndarray, n: np.ndarray, p1: np.ndarray, p2: np.ndarray, p0: float, buckets: int) -> np.ndarray:
    """Rows (l2, l1, l0) by bucket, by expectation-maximisation from even weights."""
    out = np.tile([1 / 3, 1 / 3, 1 / 3], (buckets, 1))
    out[0] = 0, 0.5, 0.5  # without counts there is no context estimate
    parts = np.stack([p2, p1, np.full(len(n), p0)], axis=1)
    for _ in range(EM_ROUNDS):
        share = out[bucket] * parts
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], minlength=buckets) for k in range(3)], axis=1).astype(float)
        # one unseen token a bucket keeps the uniform part above zero
        sums[:, 2] += 1e-3
        seen = np.bincount(bucket, n, minlength=buckets) > 0
        out[seen] = (sums / sums.sum(axis=1, keepdims=True))[seen]
    # a bucket without tokens takes the weights of the next lower one with some, else of the next higher
    known = np.unique(bucket[(n > 0) & (bucket > 0)])
    for k in np.setdiff1d(np.arange(1, buckets), known) if len(known) else []:
        out[k] = out[known[max(0, int(np.searchsorted(known, k)) - 1)]]
    return out


def _send_events(ctx: Contexts, buckets: int):
    def run(batches):
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        for chunk, (ids, fold, word, context) in enumerate(_chunks(batches, ["doc_id", "fold"]), number):
            table, doc = np.unique(ids, return_inverse=True)
            train = np.zeros(len(table), np.uint32)
            train[doc[fold != HELD_OUT]] = 1
            order = np.lexsort((doc, context, word))
            word, context, doc = word[order], context[order], doc[order]
            at = np.flatnonzero(first_of_runs(word, context, doc))
            n = np.diff(np.append(at, len(word)))
            word, context, doc = word[at], context[at], doc[at]
            code = ctx.code(context)
            place = _place(word, context, code, buckets)
            order = np.argsort(place, kind="stable")
            word, context, code, doc, n, place = (x[order] for x in (word, context, code, doc, n, place))
            rows = []
            for k, i, j in _cuts(place, buckets):
                own, local = np.unique(doc[i:j], return_inverse=True)
                rows.append((k, chunk, _sent(ctx, word[i:j], context[i:j], code[i:j], local.astype(np.uint32), n[i:j].astype(np.uint32)), packed(table[own], train[own].astype(np.int64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], BLOBS), pa.array([r[3] for r in rows], pa.binary())],
                ["bucket", "chunk", "blobs", "docs"],
            )

    return run


def _sums(of_context, of_pair, of_word, n, doc, docs: int, weights: np.ndarray, total: int, types: int) -> np.ndarray:
    """Tokens, known tokens, base and score of each document."""
    l2, l1, l0 = weights[bucket_of(of_context)].T
    p = l2 * of_pair / np.maximum(1, of_context) + l1 * of_word / max(1, total) + l0 / (types + 1)
    columns = n, n * (of_word > 0), n * np.log10((of_word + 1) / (total + types + 1)), n * np.log10(p)
    return np.stack([np.bincount(doc, x, minlength=docs) for x in columns])


def _sum_rows(chunk: np.ndarray, ids: np.ndarray, cols: np.ndarray) -> list:
    """(chunk, blob) of documents sorted by chunk and id."""
    at = np.append(np.flatnonzero(first_of_runs(chunk)), len(chunk))
    return [(int(chunk[i]), packed(_steps(ids[i:j]), *[c[i:j].astype(np.uint32) for c in cols[:2]], *[c[i:j] for c in cols[2:]])) for i, j in zip(at[:-1], at[1:])]


PARTIAL = "bucket int, chunk long, blob binary, docs binary, word binary"


def _partial_scores(ctx: Contexts, weights: np.ndarray, total: int, types: int, buckets: int):
    """Events by context: sums over the common words by chunk, blobs of all others by bucket of the word."""

    def run(table: pa.Table) -> pa.Table:
        parts, base, ids, chunks, train = [], 0, [], [], []
        for chunk, blobs, docs in zip(*[table.column(c).to_pylist() for c in ("chunk", "blobs", "docs")]):
            word, context, local, n = _received(ctx, blobs)
            parts.append((word, context, local + np.uint32(base), n))
            own = unpacked(docs)
            ids.append(own[0])
            train.append(own[1])
            chunks.append(np.full(len(own[0]), chunk))
            base += len(own[0])
        columns = [np.concatenate(x) for x in zip(*parts)]
        parts.clear()
        ids, chunks, train = (np.concatenate(x) for x in (ids, chunks, train))
        cols, left = np.zeros((4, base)), []
        for own in _ranges(columns[1]):
            more, rest = part(train, *[c[own] for c in columns])
            cols += more
            left.append(rest)
        columns.clear()
        order = np.lexsort((ids, chunks))
        order = order[cols[0][order] > 0]
        rows = [(None, chunk, blob, None, None) for chunk, blob in _sum_rows(chunks[order], ids[order], cols[:, order])]
        word, of_context, of_pair, doc, n = (np.concatenate(x) for x in zip(*left))
        left.clear()
        place = (mix(word.copy()) % U64(buckets)).astype(np.int64)
        order = np.lexsort((word, place))
        word, of_context, of_pair, doc, n = (x[order] for x in (word, of_context, of_pair, doc, n))
        for k, i, j in _cuts(place[order], buckets):
            own, local = np.unique(doc[i:j], return_inverse=True)
            rows.append((k, None, packed(of_context[i:j], of_pair[i:j], local.astype(np.uint32), n[i:j]), packed(chunks[own], ids[own], train[own]), _rolled(word[i:j])))
        kinds = pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
        return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(("bucket", "chunk", "blob", "docs", "word"), kinds))})

    def part(train, word, context, doc, n):
        order = np.lexsort((word, context))
        word, context, doc, n = word[order], context[order], doc[order], n[order].astype(np.int64)
        learned = n * train[doc]
        at = np.flatnonzero(first_of_runs(context, word))
        of_pair = np.repeat(np.add.reduceat(learned, at), np.diff(np.append(at, len(word))))
        code, known = ctx.code(context), ctx.code(word)
        of_context = np.where(code > 0, (ctx.a + ctx.b)[code], _by_word(context, learned))
        hot, rare = known > 0, known == 0
        done = _sums(of_context[hot], of_pair[hot], (ctx.a + ctx.b)[known[hot]], n[hot], doc[hot], len(train), weights, total, types)
        return done, [word[rare], *[x[rare].astype(np.uint32) for x in (of_context, of_pair, doc, n)]]

    return run


def _rare_scores(weights: np.ndarray, total: int, types: int):
    def run(table: pa.Table) -> pa.Table:
        parts, base, docs = [], 0, []
        for events, of, words in zip(*[table.column(c).to_pylist() for c in ("blob", "docs", "word")]):
            of_context, of_pair, local, n = unpacked(events)
            parts.append((_unrolled(words), of_context, of_pair, local + np.uint32(base), n))
            docs.append(unpacked(of))
            base += len(docs[-1][0])
        word, of_context, of_pair, doc, n = (np.concatenate(x) for x in zip(*parts))
        chunks, ids, train = (np.concatenate(x) for x in zip(*docs))
        order = np.argsort(word, kind="stable")
        of_context, of_pair, doc, n = (x[order].astype(np.int64) for x in (of_context, of_pair, doc, n))
        of_word = _by_word(word[order], n * train[doc])
        cols = _sums(of_context, of_pair, of_word, n, doc, base, weights, total, types)
        order = np.lexsort((ids, chunks))
        rows = _sum_rows(chunks[order], ids[order], cols[:, order])
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _merged(table: pa.Table) -> pa.Table:
    """The sums of a chunk's documents over all buckets."""
    steps, *cols = zip(*[unpacked(x) for x in table.column("blob").to_pylist()])
    ids, doc = np.unique(np.concatenate([np.cumsum(x) for x in steps]), return_inverse=True)
    sums = [np.bincount(doc, np.concatenate(c), minlength=len(ids)) for c in cols]
    kinds = (np.int64, np.int64, float, float)
    return pa.table({"doc_id": pa.array(ids), **{n: pa.array(x.astype(k)) for n, x, k in zip(("n_tokens", "n_known", "base_score", "score"), sums, kinds)}})


def _release(spark) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """docs (doc_id, text, fold), ids unique; fold HELD_OUT is not learned from.
    (doc_id, n_tokens, n_known, train_tokens, base_score, score).  ``contexts`` decides speed only."""
    size, rows, starts_a, starts_b = docs.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1)),
        F.count(F.when(~F.col("fold").isin(HELD_OUT, DELETED), 1)), F.count(F.when(F.col("fold") == DELETED, 1)),
    ).first()
    least = max(2, size // (6 * contexts))
    buckets = max(1, -(-size // BUCKET))
    counted = docs.mapInArrow(_words, "word long, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # at most (size / 2 + rows) / least frequent words, and a row of totals for each task
    found = counted.mapInArrow(_frequent(least), "word long, a long, b long, types long").toArrow()
    word, a, b, kinds = (found.column(c).to_numpy().astype(np.int64) for c in ("word", "a", "b", "types"))
    sums = word == 0
    total_a, total_b, types = int(a[sums].sum()), int(b[sums].sum()), int(kinds[sums].sum())
    word = np.append(word[~sums].view(np.uint64), START)
    ctx = Contexts(word, np.append(a[~sums], starts_a), np.append(b[~sums], starts_b))
    pairs = docs.mapInArrow(_send_counts(ctx, buckets), "bucket int, blobs array<binary>")
    found = cut_lineage(pairs.groupBy("bucket").applyInArrow(_cells(ctx, total_a, buckets), CELLS))
    kind = "cell long, n double, p1 double, p2 double"
    rare = found.where("blob IS NOT NULL").select("bucket", "word", "blob").groupBy("bucket").applyInArrow(_rare_cells(total_a), kind)
    cells = found.where("blob IS NULL").select("cell", "n", "p1", "p2").unionByName(rare)
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p1").alias("p1"), F.sum("p2").alias("p2")).orderBy("cell").toArrow()
    cell, n, p1, p2 = (cells.column(c).to_numpy() for c in ("cell", "n", "p1", "p2"))
    weights = learn_weights(cell >> 32, n, p1 / np.maximum(n, 1), p2 / np.maximum(n, 1), 1 / (types + 1), int(bucket_of(np.array([total_a + total_b + starts_a + starts_b]))[0]) + 1)
    if not total_a + total_b:
        weights[:] = 0, 0, 1
    model = weights, total_a + total_b, types
    # the shuffle files of the learning go before those of the scores come
    del counted, pairs, found, rare, cells
    _release(docs.sparkSession)
    events = docs.mapInArrow(_send_events(ctx, buckets), "bucket int, chunk long, blobs array<binary>, docs binary")
    parts = cut_lineage(events.groupBy("bucket").applyInArrow(_partial_scores(ctx, *model, buckets), PARTIAL))
    # the sums are written: the shuffle files of the events go before those of the rare words come
    del events
    _release(docs.sparkSession)
    rare = parts.where("docs IS NOT NULL").select("bucket", "blob", "docs", "word").groupBy("bucket").applyInArrow(_rare_scores(*model), "chunk long, blob binary")
    parts = parts.where("docs IS NULL").select("chunk", "blob").unionByName(rare)
    out = parts.groupBy("chunk").applyInArrow(_merged, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total_a + total_b).cast("long").alias("train_tokens"), "base_score", "score")
