"""Chat formatting with a loss mask from offsets.

A conversation is rendered whole: each turn is START, role, SAYS, text, DONE.  The three
marks are special tokens of the tokenizer in use.  Inside roles and texts every ``<``,
backslashes, ``|`` gets one backslash more, so no mark can stand there, and taking it away
gives the text back.  The rendered string is encoded once with offsets; the sorted spans of
the roles that bear loss are intersected with the sorted token spans by binary search.

Rows of one conversation are ordered by turn (null first), role and text and read one
conversation at a time from sorted partitions.  One conversation is the unit of work and has
to fit in a task; its size is its author's, not the table's.  An empty table gives no rows.  Null roles and texts count as
empty; the conversation null is one of its own; a conversation without assistant turns has an
empty mask.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

START, SAYS, DONE = MARKS = ("<|turn|>", "<|says|>", "<|done|>")
PROBE = "</s>[INST] ok [/INST]"
LOSS_ROLES = ("assistant",)
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_PARSE = re.compile(re.escape(START) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(DONE), re.S)
FORMATTED = "conv_id long, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_starts array<long>, loss_ends array<long>"
REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
_loaded: dict = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.add_special_tokens(list(MARKS))
        _loaded[path] = model
    return _loaded[path]


def render(turns: list[tuple[str, str]], loss_roles=LOSS_ROLES):
    """The conversation and the spans of the texts that bear loss, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SAYS, escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, DONE]
        at += len(head) + len(body) + len(DONE)
    return "".join(out), spans


def loss_spans(offsets: np.ndarray, spans: list[tuple[int, int]]):
    """Token mask, and each marked token's part of its span: (mask, starts, ends)."""
    mask = np.zeros(len(offsets), bool)
    starts, ends = [], []
    if len(offsets) and spans:
        lo, hi = np.asarray(spans, np.int64).T
        # token starts and ends both ascend; parts of one character share their span
        first = np.searchsorted(offsets[:, 1], lo, "right")
        last = np.searchsorted(offsets[:, 0], hi, "left")
        for a, b, i, j in zip(lo, hi, first, last):
            mask[i:j] = True
            starts.append(np.maximum(offsets[i:j, 0], a))
            ends.append(np.minimum(offsets[i:j, 1], b))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return mask, cat(starts), cat(ends)


def encode(model, turns, loss_roles=LOSS_ROLES):
    """(formatted, ids, mask, starts, ends) of one conversation."""
    formatted, spans = render(turns, loss_roles)
    found = model.encode(formatted, add_special_tokens=False)
    offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
    return formatted, found.ids, *loss_spans(offsets, spans)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(x)) for r, x in _PARSE.findall(formatted)]


def read_loss(formatted: str, starts, ends) -> str:
    """The text under the mask: the union of the marked parts, unescaped turn by turn."""
    out, a, b = [], None, None
    for s, e in zip(starts.tolist(), ends.tolist()):
        if b is not None and s <= b:
            b = max(b, e)
            continue
        if b is not None:
            out.append(unescape(formatted[a:b]))
        a, b = s, e
    if b is not None:
        out.append(unescape(formatted[a:b]))
    return "".join(out)


def _conversations(batches):
    """(conv_id, turns), one conversation after the other."""
    current, turns = None, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
        for conv, role, text in zip(*cols):
            if turns is None or conv != current:
                if turns is not None:
                    yield current, turns
                current, turns = conv, []
            turns.append((role or "", text or ""))
    if turns is not None:
        yield current, turns


def _rows(path: str, schema: str, row):
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        model, out, size = tokenizer(path), [], 0
        kinds = {"conv_id": pa.int64(), "formatted": pa.string(), "input_ids": pa.list_(pa.int32()), "loss_mask": pa.list_(pa.bool_()), "loss_starts": pa.list_(pa.int64()), "loss_ends": pa.list_(pa.int64()), "turns_sha256": pa.string(), "loss_sha256": pa.string()}

        def send():
            cols = list(zip(*out)) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(cols, names)], names)

        for conv, turns in _conversations(batches):
            found = encode(model, turns)
            out.append((conv, *row(*found)))
            size += len(found[0])
            if len(out) >= 5_000 or size >= 1 << 23:
                yield send()
                out.clear()
                size = 0
        yield send()

    return run


def _sorted(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """turns (conv_id, turn, role, text): the formatted string, ids, token mask and the marked
    character parts of every conversation."""
    return _sorted(turns).mapInArrow(_rows(tokenizer_path, FORMATTED, lambda text, ids, mask, s, e: (text, ids, mask.tolist(), s, e)), FORMATTED)


def _digest(text, ids, mask, starts, ends):
    turns, loss = read_turns(text), read_loss(text, starts, ends)
    digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    return len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(ids), int(mask.sum())


def report(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """The digests of ``format_chats``, read back from its output in the same task."""
    out = _sorted(turns).mapInArrow(_rows(tokenizer_path, REPORT, _digest), REPORT)
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
