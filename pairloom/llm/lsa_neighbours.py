"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Features of a text, hashed to ``FEATURES`` numbers: its words, their shapes (letters, digits
and cases as classes, runs collapsed), pairs of neighbouring shapes, words that repeat the
one before, and the share of distinct words.  Weights are log term frequency times inverse
document frequency, counted over all documents.  A truncated singular value decomposition
of labelled rows gives ``RANK`` latent directions; every whole text is projected.

The labelled vectors (at most ``SAMPLE`` rows, the smallest by a hash of the id; the
decomposition takes the ``HEAVY`` heaviest features of each) are sent to the tasks, which
multiply them with the documents in blocks, exactly.  The ``NEIGHBOURS`` nearest vote with
the fourth power of their cosine as weight.

Null texts count as empty; texts without words, and all texts where nothing is labelled,
score the share of label 1 in the sample, or 0.5.  A document with several labels has the
smallest.  Equal ids: see ``common``.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import Rolling, U64, blocks, byte_rows, first_of_runs, mix, word_bounds

FEATURES, RANK, SAMPLE, HEAVY, NEIGHBOURS = 1 << 15, 48, 8192, 512, 32
BLOCK, ROWS, ROUNDS, SEED = 1 << 18, 256, 4, 7

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[128:] = ord("a")


def features(data: np.ndarray, offsets: np.ndarray):
    """(row, feature, count), sorted by row and feature."""
    start, end, row = word_bounds(data, offsets, WORD)
    if not len(start):
        return [np.zeros(0, np.int64)] * 3
    word = Rolling(data).spans(start, end)
    shapes = SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shapes[1:] != shapes[:-1]
    keep[start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = Rolling(shapes[keep]).spans(at[start], at[end])
    same_row = row[1:] == row[:-1]
    pair = mix(shape[:-1] * U64(3) + shape[1:])[same_row]
    again = (word[1:] == word[:-1]) & same_row
    order = np.argsort(word ^ mix(row.astype(np.uint64)), kind="stable")
    new = np.zeros(len(row), bool)
    new[order] = first_of_runs(word[order], row[order])
    n = len(offsets) - 1
    total = np.bincount(row, minlength=n)
    rows = np.flatnonzero(total)
    share = np.bincount(row, new, minlength=n)[rows] * 10 // total[rows]
    parts = [
        (row, word),
        (row, mix(shape + U64(1))),
        (row[1:][same_row], pair),
        (row[1:][again], np.full(int(again.sum()), 11, np.uint64)),
        (rows, mix(share.astype(np.uint64) + U64(101))),
    ]
    keys = np.sort(np.concatenate([(r.astype(np.int64) << 15) | (h >> U64(49)).astype(np.int64) for r, h in parts]))
    first = np.flatnonzero(first_of_runs(keys))
    return keys[first] >> 15, keys[first] & (FEATURES - 1), np.diff(np.append(first, len(keys)))


def _feature_blocks(column):
    data, offs = byte_rows(column)
    for i, j in blocks(offs, BLOCK):
        yield i, j, features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def _document_counts(batches):
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        n += batch.num_rows
        for _, _, (_, feature, _) in _feature_blocks(batch.column("text")):
            df += np.bincount(feature, minlength=FEATURES)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["feature", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the feature)) + 1, over all rows."""
    rows = texts.mapInArrow(_document_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1)
    df[rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)


def _weights(feature, count, idf):
    return (np.log1p(count) * idf[feature]).astype(np.float32)


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    at = np.flatnonzero(first_of_runs(rows))
    if len(at):
        out[rows[at]] = np.add.reduceat(values, at, axis=0)
    return out


def directions(row: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (FEATURES, rank) by subspace iteration."""
    step = 1 << 16
    by_feature = np.argsort(feature, kind="stable")

    def times(m, rows, cols, w, size):
        out = np.zeros((size, m.shape[1]), np.float32)
        for lo in range(0, len(rows), step):
            part = slice(lo, lo + step)
            out += _sums(rows[part], m[cols[part]] * w[part, None], size)
        return out

    basis = np.random.default_rng(SEED).standard_normal((FEATURES, rank)).astype(np.float32)
    for _ in range(ROUNDS):
        left = np.linalg.qr(times(basis, row, feature, weight, n))[0]
        basis = np.linalg.qr(times(left, feature[by_feature], row[by_feature], weight[by_feature], FEATURES))[0]
    return basis.astype(np.float32)


def _heaviest(idf: np.ndarray, heavy: int):
    def run(batches):
        for batch in batches:
            for i, j, (row, feature, count) in _feature_blocks(batch.column("text")):
                weight = _weights(feature, count, idf)
                order = np.lexsort((-weight, row))
                row, feature, weight = row[order], feature[order], weight[order]
                start = np.flatnonzero(first_of_runs(row))
                size = np.diff(np.append(start, len(row)))
                keep = np.arange(len(row)) - np.repeat(start, size) < heavy
                norm = np.sqrt(np.bincount(row, weight.astype(float) ** 2, minlength=j - i))
                rows = [(feature[a : a + z][keep[a : a + z]].astype(np.int32), (weight[a : a + z][keep[a : a + z]] / norm[row[a]]).astype(np.float32)) for a, z in zip(start, size)]
                ids = batch.column("doc_id").slice(i, j - i).take(pa.array(row[start]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())], ["doc_id", "features", "weights"])

    return run


def vectors(column, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors of all rows; zero where there is no word."""
    out = np.zeros((len(column), basis.shape[1]), np.float32)
    for i, j, (row, feature, count) in _feature_blocks(column):
        weight = _weights(feature, count, idf)
        for lo in range(0, len(row), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            out[i:j] += _sums(row[part], basis[feature[part]] * weight[part, None], j - i)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def vote(own: np.ndarray, known: np.ndarray, labels: np.ndarray, base: float, k: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest of each row."""
    out = np.full(len(own), base)
    k = min(k, len(known))
    for lo in range(0, len(own), ROWS):
        cos = own[lo : lo + ROWS] @ known.T
        near = np.argpartition(cos, len(known) - k, axis=1)[:, len(known) - k :]
        weight = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(float) ** 4
        total = weight.sum(axis=1)
        some = total > 0
        out[lo : lo + ROWS][some] = (weight * labels[near]).sum(axis=1)[some] / total[some]
    return np.clip(out, 0, 1)


def _project(idf, basis, known=None, labels=None, base=0.5):
    def run(batches):
        for batch in batches:
            own = vectors(batch.column("text"), idf, basis)
            if known is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([v.tobytes() for v in own], pa.binary())], ["doc_id", "vector"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(vote(own, known, labels, base), pa.float64())], ["doc_id", "score"])

    return run


def _picker(ids: np.ndarray):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(np.isin(batch.column("doc_id").to_numpy(zero_copy_only=False), ids)))

    return run


def score(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> DataFrame:
    """docs: rows of ``distinct_documents``; labelled (doc_id, label): (doc_id, score)."""
    idf = inverse_frequencies(docs.select("text"))
    drawn = labelled.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    drawn = drawn.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    base = float(drawn["label"].mean()) if len(drawn) else 0.5
    known, labels = np.zeros((0, rank), np.float32), np.zeros(0)
    basis = np.zeros((FEATURES, rank), np.float32)
    if len(drawn):
        # the sample is bounded: tasks pick its rows as they read, no text is dealt out
        chosen = docs.mapInArrow(_picker(drawn["doc_id"].to_numpy(np.int64)), docs.schema)
        table = chosen.mapInArrow(_heaviest(idf, HEAVY), "doc_id long, features binary, weights binary").orderBy("doc_id").toArrow()
        cols = [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("features", np.int32), ("weights", np.float32))]
        size = np.array([len(x) // 4 for x in table.column("features").to_pylist()], np.int64)
        if len(size):
            basis = directions(np.repeat(np.arange(len(size)), size), cols[0].astype(np.int64), cols[1], len(size), min(rank, len(size)))
        known_rows = chosen.mapInArrow(_project(idf, basis), "doc_id long, vector binary").toPandas().sort_values("doc_id").merge(drawn, on="doc_id")
        known = np.frombuffer(b"".join(known_rows["vector"]), np.float32).reshape(len(known_rows), -1)
        labels = known_rows["label"].to_numpy(float)
    return docs.mapInArrow(_project(idf, basis, known, labels, base), "doc_id long, score double")
