"""Merge-type (BPE) SentencePiece encoding by backtracking, and decoding.

The library merges neighbours again and again, the pair of the best score first, the leftmost
of equals.  The same pieces are found left to right: a list of pieces is the encoding exactly
if every two neighbours, merged anew on their own, come out as these two pieces.  From each
position the longest piece that an Aho-Corasick automaton finds there is tried first, then the
shorter ones; a piece must be compatible with its left neighbour, and must not end where a
bitfield marks that no way leads on.  If none is left, the position is marked and the last piece
taken back.  Pieces that merging their own letters does not give are not in the automaton.

Blanks become U+2581, and one is put in front if the model says so.  Two characters that no piece
has side by side are never merged, so that a text may be cut there.  No piece has U+2581 after
another character: a text falls into words (such signs, then others), and these into parts, which
are encoded on their own and remembered.  Characters without a piece are parts of their own and
become bytes, or the unknown id in models without them.  Models of another type, with a normaliser
or with user-defined or unused pieces are refused when they are loaded.

Texts are cut between words in parts of ``PART`` characters, so that long ones need little more
than their ids.  Null reads as empty, and an empty text has the end id only.  Repeated and null
ids: see ``common``.  An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import distinct_documents, repeat_ranges

MARK = "▁"
PART, WINDOW, REMEMBERED, LONG = 1 << 20, 4096, 1 << 19, 48
ENCODED = "doc_id long, ids array<int>"
REPORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_loaded: dict = {}
_AFTER_WORD = re.compile(f"[^{MARK}]{MARK}")

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class _Words(dict):
    """Word to ids.  When it has grown too large it starts anew, and words of the time before are
    taken over as they come again."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, word):
        ids = self.before.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in size]
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.prefix = model.encode("a", out_type=str)[:1] != ["a"]
        bytes_ = {int(names[i][3:5], 16): i for i in size if model.is_byte(i)}
        self.byte = [bytes_.get(b) for b in range(256)] if len(bytes_) == 256 else None
        plain = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: model.get_score(i) for i in plain}
        self._check(model, path)
        self.chars = {p for p in self.ids if len(p) == 1}
        self.longest = max(map(len, self.ids))
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if set(p) <= self.chars and self.merged(p) == [p]:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.names, self.length = names, [len(n) for n in names]
        self.pairs: dict = {}
        cuts = "".join(c for c in map(chr, range(1, 32)) if c not in self.chars)
        out = re.escape(cuts)
        self.words = re.compile((f"[{out}]+|" if cuts else "") + f"{MARK}+[^{MARK}{out}]*|[^{MARK}{out}]+")
        self.known = _Words(self.encode_word)
        # decoding: the bytes of every id, end to end
        raw = [b""] * len(names)
        for p, i in self.ids.items():
            raw[i] = p.replace(MARK, " ").encode()
        for b, i in bytes_.items():
            raw[i] = bytes([b])
        raw[self.unknown] = " ⁇ ".encode()
        self.is_byte = np.array([model.is_byte(i) for i in size])
        self.marked = np.array([n.startswith(MARK) for n in names])
        self.control = np.array([model.is_control(i) for i in size])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text_of = [str(i) for i in size]

    def _check(self, model, path):
        probe = "ﬁ Å ①  Á  "
        odd = [p for p in self.ids if MARK in p.lstrip(MARK)]
        odd += [i for i in range(model.get_piece_size()) if model.is_unused(i)]
        if odd or model.decode(model.encode(probe)) != probe or model.encode_as_pieces("a" * 9) != self._merge_text("a" * 9):
            raise ValueError(f"{path}: no merge-type model without normalisation")

    def _merge_text(self, text):
        return self.merged((MARK if self.prefix else "") + text)

    def merged(self, text: str) -> list[str]:
        """The pieces by merging, the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Do the two pieces, merged anew from their letters, come out as they are?"""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        names = [self.names[left], self.names[right]]
        found = self.pairs[left << 32 | right] = self.merged("".join(names)) == names
        return found

    def _matches(self, text: str, lo: int, hi: int) -> list[list[int]]:
        """The ids of the pieces from each position of [lo, hi), short ones first."""
        found: list = [[] for _ in range(hi - lo)]
        length, n, first = self.length, hi - lo, lo - 1
        for end, i in self.automaton.iter(text, lo, min(len(text), hi + self.longest)):
            if (k := end - length[i] - first) < n:
                found[k].append(i)
        return found

    def _by_windows(self, text: str):
        """``_matches`` of one position of a long text: windows of it, of which the last two are kept."""
        kept: dict = {}

        def at(pos):
            w = pos // WINDOW
            if w not in kept:
                if len(kept) > 1:
                    kept.pop(next(iter(kept)))
                kept[w] = self._matches(text, w * WINDOW, min(len(text), w * WINDOW + WINDOW))
            return kept[w][pos - w * WINDOW]

        return at

    def backtrack(self, text: str) -> list[int]:
        """The ids of a text whose characters all have a piece."""
        n, length, pairs = len(text), self.length, self.pairs
        at = self._matches(text, 0, n).__getitem__ if n <= WINDOW else self._by_windows(text)
        failed = bytearray((n >> 3) + 1)
        ids, tried, pos, last = [], [], 0, -1
        offers = at(0)
        k = len(offers) - 1
        while True:
            while k >= 0:
                i = offers[k]
                end = pos + length[i]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | i)
                    if self.compatible(last, i) if fits is None else fits:
                        break
                k -= 1
            if k >= 0:
                ids.append(i)
                if end == n:
                    return ids
                tried.append(k)
                last, pos = i, end
                offers = at(pos)
                k = len(offers) - 1
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos -= length[ids.pop()]
                offers = at(pos)
                k = tried.pop() - 1
                last = ids[-1] if ids else -1

    def encode_word(self, word: str) -> list[int]:
        """A word is cut where two characters meet that no piece has side by side."""
        out, a, inside = [], 0, self.inside
        for b in range(1, len(word)):
            if word[b - 1 : b + 1] not in inside:
                out += self.known[word[a:b]]
                a = b
        if a:
            return out + self.known[word[a:]]
        if word[0] not in self.chars:
            return [self.byte[x] for x in word.encode()] if self.byte else [self.unknown]
        return self.backtrack(word)

    def _parts(self, text: str):
        text = text.replace(" ", MARK)
        if self.prefix and text:
            text = MARK + text
        a = 0
        while a < len(text):
            cut = _AFTER_WORD.search(text, a + PART - 1) if a + PART < len(text) else None
            b = cut.end() - 1 if cut else len(text)
            yield text[a:b]
            a = b

    def encode(self, text: str, end: bool = True) -> np.ndarray:
        known, out = self.known, []
        for part in self._parts(text):
            ids: list = []
            for word in self.words.findall(part):
                ids += known[word]
            out.append(np.array(ids, np.int32))
        return np.concatenate([*out, np.array([self.end] if end else [], np.int32)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8.  Bytes that are no UTF-8 become U+FFFD one by one."""
        ids = np.asarray(ids, np.int64)
        ids = ids[~self.control[ids]]
        if not len(ids):
            return b""
        raw = self.raw[repeat_ranges(self.starts[ids], self.sizes[ids])].tobytes()
        if self.prefix and self.marked[ids[0]]:
            raw = raw[1:]
        try:
            if self.is_byte[ids].any():
                raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "each_byte").encode()


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids), the end id included."""

    def run(batches):
        model = codec(model_path)
        for batch in batches:
            for k in range(0, len(batch), 64):
                ids = [model.encode(x or "") for x in batch.column("text").slice(k, 64).to_pylist()]
                offs = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 64), pa.ListArray.from_arrays(pa.array(offs), values)], ["doc_id", "ids"])

    return distinct_documents(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids read as none."""

    def run(batches):
        model = codec(model_path)
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, model_path: str) -> DataFrame:
    """Digests of the ids that ``encode`` gives and of the text that ``decode`` makes of them, in one pass."""

    def row(model, text):
        ids = model.encode(text)
        listed = " ".join(map(model.text_of.__getitem__, ids.tolist()))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(model.decode(ids)).hexdigest()

    def run(batches):
        model = codec(model_path)
        for batch in batches:
            texts = (batch.column("text")[k].as_py() or "" for k in range(len(batch)))
            cols = list(zip(*[row(model, x) for x in texts])) or [[], [], []]
            kinds = [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return distinct_documents(docs).mapInArrow(run, REPORT)
