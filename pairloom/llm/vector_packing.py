"""Packing of token pieces by vector bin packing.

A sequence holds pieces under simultaneous limits on tokens, segments and loss-bearing
tokens.  A document is tokenised whole, then its full sequences are cut off; what is left
waits in a pool.  A bin takes, again and again, the waiting piece that fits and has the
largest dot product of its needs with the bin's free room, both as shares of the limits.
When no piece fits, the one with the largest product is cut to fill the tokens left.  A bin
that ends short (a limit other than tokens is reached, or the pool is empty) is cut back to a
power of two, which needs no padding; what was cut off goes back to the pool.

Every task packs its own documents while it reads them, with a pool of bounded size: no
token moves, and there is nothing to gather.  Sequence ids are the task's number and a
counter, the same in every attempt of a task.

Loss-bearing are all ids of a document but its first, which nothing precedes.  Null texts are
empty; an empty text gives the end id alone.  Rows that repeat an id are packed each.  An empty
table gives no pieces.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

LENGTH, SEGMENTS, LOSS, END = 1024, 64, 1024, 0
POOL, WORDS = 1024, 300_000
#: fixed value: how byte-level BPE cuts a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_loaded: dict = {}


class ByteBpe:
    """Ids of a byte-level BPE file of `tokenizers`; words after a blank are looked up once.

    A blank before a character that is no white space always starts a piece, so a text can be
    cut there and each part be encoded on its own.  Texts with other blanks are encoded
    whole, texts with a special token's string by the library of the file itself.
    """

    class _Words(dict):
        def __init__(self, encode):
            super().__init__()
            self.encode = encode

        def __missing__(self, word):
            ids = np.array(self.encode(" " + word), np.uint32).tobytes()
            if len(word) <= 64:
                if len(self) >= WORDS:
                    self.clear()
                self[word] = ids
            return ids

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        # the file writes bytes as printable characters
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.encode = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = ByteBpe._Words(self.encode)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        first, *rest = text.split(" ")
        if any(not w or w[0].isspace() for w in rest):
            return np.array(self.encode(text), np.uint32).tobytes()
        return np.array(self.encode(first), np.uint32).tobytes() + b"".join(map(self.words.__getitem__, rest))


def bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


class Packer:
    """Pieces (key, start, length, loss-bearing ids) to sequences."""

    def __init__(self, limits=(LENGTH, SEGMENTS, LOSS), pool: int = POOL):
        self.limits = np.array(limits, float)
        self.size = pool
        self.keys: list = []
        self.needs = np.zeros((0, 3))
        self.starts = np.zeros(0, np.int64)

    def add(self, pieces: list[tuple]) -> None:
        if pieces:
            self.keys += [p[0] for p in pieces]
            self.starts = np.concatenate([self.starts, [p[1] for p in pieces]])
            self.needs = np.concatenate([self.needs, [(p[2], 1, p[3]) for p in pieces]])

    def _loss(self, start, length) -> int:
        return length - (start == 0)

    def fill(self) -> list[tuple]:
        """One sequence from the pool: (key, start, length)."""
        free, out = self.limits.copy(), []
        alive = np.ones(len(self.keys), bool)
        put_back = []
        shares = self.needs / self.limits
        while free[0] >= 1 and free[1] >= 1 and alive.any():
            product = shares @ (free / self.limits)
            product[~alive] = -1
            fits = (self.needs <= free).all(axis=1) & alive
            if fits.any():
                k = int(np.argmax(np.where(fits, product, -1)))
                start, length = int(self.starts[k]), int(self.needs[k, 0])
            else:
                # cut the best piece to the room left; its rest stays in the pool
                k = int(np.argmax(product))
                start = int(self.starts[k])
                length = int(min(free[0], free[2] + (start == 0)))
                if length < 1:
                    break
                rest = int(self.needs[k, 0]) - length
                put_back.append((self.keys[k], start + length, rest, self._loss(start + length, rest)))
            alive[k] = False
            out.append((self.keys[k], start, length))
            free -= (length, 1, self._loss(start, length))
        total = sum(p[2] for p in out)
        extra = 0 if total == self.limits[0] else total - (1 << total.bit_length() - 1)
        while extra:
            key, start, length = out.pop()
            cut = min(extra, length)
            if cut < length:
                out.append((key, start, length - cut))
            put_back.append((key, start + length - cut, cut, self._loss(start + length - cut, cut)))
            extra -= cut
        self.keys = [k for k, a in zip(self.keys, alive) if a]
        self.needs, self.starts = self.needs[alive], self.starts[alive]
        self.add(put_back)
        return out

    def drain(self, last: bool):
        while len(self.keys) > (0 if last else self.size):
            yield self.fill()


def pack(
    docs: DataFrame, tokenizer: str, limits=(LENGTH, SEGMENTS, LOSS), end: int = END, with_ids: bool = False, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a piece; ``tokenizer`` is the file's path on every machine.  ``with_ids`` adds
    the piece's ids as ``input_ids``."""
    length, _, loss = limits

    def run(batches):
        model, packer = bpe(tokenizer), Packer(limits, pool)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        texts: dict = {}  # a document waits here while pieces of it wait in the pool
        serial = 0
        rows: list = []

        def put(pieces):
            nonlocal number
            offset = 0
            for key, start, n in pieces:
                doc, raw, left = texts[key]
                ids = raw[4 * start : 4 * (start + n)]
                rows.append((doc, start, n, zlib.crc32(ids), len(raw) // 4, number, offset, *([np.frombuffer(ids, np.uint32)] if with_ids else [])))
                offset += n
                left -= n
                if left:
                    texts[key] = (doc, raw, left)
                else:
                    del texts[key]
            number += 1

        def batch_out():
            cols = list(zip(*rows)) if rows else [[]] * (8 if with_ids else 7)
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
                names.append("input_ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = model.ids(text.as_py() or "") + int(end).to_bytes(4, "little")
                n, key = len(raw) // 4, serial
                serial += 1
                texts[key] = (doc, raw, n)
                start = 0
                while n - start >= length and length - (start == 0) <= loss:
                    put([(key, start, length)])
                    start += length
                if start < n:
                    packer.add([(key, start, n - start, n - start - (start == 0))])
                if len(packer.keys) > 2 * pool:
                    for pieces in packer.drain(False):
                        put(pieces)
                if len(rows) >= 10_000:
                    yield batch_out()
        for pieces in packer.drain(True):
            put(pieces)
        yield batch_out()

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(run, PIECE + (", input_ids array<int>" if with_ids else ""))
