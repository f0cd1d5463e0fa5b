"""Language identification by rank-order n-gram profiles.

A profile is a list of the ``PROFILE`` most frequent n-grams (1 to 3 letters, words padded
with a blank on each side, letters lower-cased, everything else a blank).  A document's own
list is held against every language's: each n-gram costs its distance out of place, or
``PROFILE`` if the language lacks it.  The distance is the mean cost over ``PROFILE``, the
score one less the distance of the nearest language.  Ties in frequency go by the n-gram's
code, ties in distance by the language's name.

Null texts and texts without a letter are ``und`` with score 0.  Without a labelled
document every text is ``und``, and an empty table gives no rows.  An n-gram's code holds three
letters in full.  A text is counted whole, long ones in one task at about 60 bytes a letter.
Equal ids: see ``common``.  Profiles are counted over all labelled training rows; the profiles (PROFILE
rows a language) are sent to the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import U64, blocks, byte_rows, first_of_runs
from pairloom.plans import top_per_group

PROFILE, BLOCK, FLUSH = 300, 1 << 18, 1 << 24
UNKNOWN = "und"
CODE = 21  # bits of a letter

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point to the letter in lower case; 0 for all that is no letter."""
    global _letters
    if _letters is None:
        _letters = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)
    return _letters


def gram_counts(data: np.ndarray, offsets: np.ndarray):
    """(row, n-gram, count) sorted by row and n-gram; rows are numbered from 0."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if heads[-1] != len(chars):  # bytes that are no UTF-8: row by row
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        heads = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return _count(letters()[chars], heads)


def _count(found: np.ndarray, heads: np.ndarray):
    """``gram_counts`` of letters, rows given by their n+1 offsets."""
    sizes = np.diff(heads)
    bits = (int(found.max(initial=0)) + 1).bit_length()
    if 3 * bits + len(sizes).bit_length() > 64 and len(sizes) > 1:
        # row and n-gram do not fit into one number: fewer rows at a time
        half, parts = len(sizes) // 2, []
        for lo, hi in ((0, half), (half, len(sizes))):
            row, gram, count = _count(found[heads[lo] : heads[hi]], heads[lo : hi + 1] - heads[lo])
            parts.append((row + lo, gram, count))
        return [np.concatenate(x) for x in zip(*parts)]
    code = np.zeros(len(found) + len(sizes) + 1, np.uint64)
    row = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes + 1)
    # one blank before every row, one after the last
    code[np.arange(len(found)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = found
    row = np.append(row, U64(max(0, len(sizes) - 1)))
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    keep[0] = keep[-1] = True
    code, row = code[keep], row[keep]
    if not code.any():
        return [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64)]
    shift, none = U64(bits), U64((1 << bits) - 1)
    top = row << U64(3 * bits)
    pair = (code[:-1] << shift) | code[1:]
    # a pair ends on a code that no letter has, and belongs to the row of its letter
    of_pair = np.where(code[:-1] != 0, top[:-1], top[1:])
    parts = [(top | code)[code != 0], (of_pair | (pair << shift) | none)[(code[:-1] != 0) | (code[1:] != 0)]]
    middle = code[1:-1] != 0
    parts.append((top[1:-1] | (code[:-2] << (shift + shift)) | pair[1:])[middle])
    keys = np.sort(np.concatenate(parts))
    at = np.flatnonzero(first_of_runs(keys))
    count = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    gram = np.zeros(len(keys), np.uint64)
    for place in (2, 1, 0):
        letter = (keys >> U64(place * bits)) & none
        gram = (gram << U64(CODE)) | np.where(letter == none, U64((1 << CODE) - 1), letter)
    last = keys >> U64(3 * bits) if 3 * bits < 64 else np.zeros(len(keys), np.uint64)
    return last.astype(np.int64), gram, count


def ranked(row: np.ndarray, gram: np.ndarray, count: np.ndarray, size: int = PROFILE):
    """The ``size`` most frequent n-grams of each row with their places."""
    order = np.lexsort((gram, -count, row))
    row, gram = row[order], gram[order]
    new = first_of_runs(row)
    start = np.flatnonzero(new)
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    keep = place < size
    return row[keep], gram[keep], place[keep]


def _learner(batches):
    def send(total):
        langs, grams, counts = [], [], []
        for lang, parts in total.items():
            g, c = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(g, kind="stable")
            at = np.flatnonzero(first_of_runs(g[order]))
            langs += [lang] * len(at)
            grams.append(g[order][at])
            counts.append(np.add.reduceat(c[order], at))
        if langs:
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(counts), pa.int64())], ["lang", "gram", "n"])

    total, size = {}, 0
    for batch in batches:
        order = pa.compute.sort_indices(batch.column("lang"))
        batch = batch.take(order)
        names = np.array(batch.column("lang").to_pylist(), object)
        data, offs = byte_rows(batch.column("text"))
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            own = offs[lo : hi + 1]
            for i, j in blocks(own, BLOCK):
                part = data[own[i] : own[j]]
                # counts of a language: all rows of the block as one
                _, gram, count = gram_counts_joined(part, own[i : j + 1] - own[i])
                if len(gram):
                    total.setdefault(names[lo], []).append((gram, count))
                size += len(part)
            if size >= FLUSH:
                yield from send(total)
                total, size = {}, 0
    yield from send(total)


def gram_counts_joined(data, offsets):
    """As ``gram_counts``, summed over the rows."""
    row, gram, count = gram_counts(data, offsets)
    if not len(gram):
        return row, gram, count
    order = np.argsort(gram, kind="stable")
    at = np.flatnonzero(first_of_runs(gram[order]))
    return row[:0], gram[order][at], np.add.reduceat(count[order], at)


def learn_profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language to its n-grams in order, from every row with a language."""
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang IS NOT NULL")
    counts = rows.mapInArrow(_learner, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = top_per_group(counts, "lang", [F.desc("n"), F.asc("gram")], size).orderBy("lang", "rk").toPandas()
    return {lang: g["gram"].to_numpy(np.int64).view(np.uint64) for lang, g in best.groupby("lang")}


class Identifier:
    """Profiles laid out for look-ups."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.names = size, sorted(profiles)
        self.tables = []
        for name in self.names:
            order = np.argsort(profiles[name])
            self.tables.append((profiles[name][order], order))

    def scores(self, data: np.ndarray, offsets: np.ndarray):
        """Index of the language (-1: und) and score of each row."""
        n = len(offsets) - 1
        lang, score = np.full(n, -1, np.int64), np.zeros(n)
        row, gram, place = ranked(*gram_counts(data, offsets), self.size)
        if not len(row) or not self.names:
            return lang, score
        listed = np.bincount(row, minlength=n)
        cost = np.zeros((len(self.names), n))
        for k, (grams, places) in enumerate(self.tables):
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            out = np.where(grams[at] == gram, np.abs(places[at] - place), self.size)
            cost[k] = np.bincount(row, out, minlength=n)
        cost /= np.maximum(1, listed) * self.size
        some = listed > 0
        lang[some] = np.argmin(cost, axis=0)[some]
        score[some] = 1 - cost.min(axis=0)[some]
        return lang, np.clip(score, 0, 1)

    def batch(self, column):
        data, offs = byte_rows(column)
        parts = [self.scores(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in blocks(offs, BLOCK)]
        lang, score = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))
        return np.array([*self.names, UNKNOWN], object)[lang], score


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """docs (doc_id, text): (doc_id, lang_pred, score)."""
    model = Identifier(profiles)

    def run(batches):
        for batch in batches:
            names, score = model.batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: dict[str, np.ndarray], least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of ``least`` or more."""
    model = Identifier(profiles)

    def run(batches):
        for batch in batches:
            names, score = model.batch(batch.column(text_col))
            yield batch.filter(pa.array((names != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
