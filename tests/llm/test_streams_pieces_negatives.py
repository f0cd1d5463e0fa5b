"""Conversation repair, piece codes and hard negatives against brute force on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pairloom.llm import conversation_repair, cover_tree, piece_codec, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TURNS = "conv_id long, turn long, role string, text string, digest string, gone_by string"


def conversations():
    rng = random.Random(5)
    rows = []
    for conv in range(150):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 30])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "ua", "", None])
            text = rng.choice(["Yes.", "No", "Why? ", "ok!", "", " \t\n", " ", "One. Two", "日本。", None, "a" * 5000 + ".", f"turn {turn}."])
            rows.append((conv, turn * rng.choice([1, 1, 3]), role, text))
    rows += [(None, 0, "user", "a."), (None, None, "user", "b."), (7000, None, None, None), (7001, 4, "assistant", "x.")]
    rows += [(8000, k, "user" if k % 2 == 0 else "assistant", f"long {k % 97}" + ("." if k % 5 else "")) for k in range(3000)]
    rows += [(8001, 1, "user", "same again.")] * 40 + [(8001, 2, "assistant", "same again.")] * 3
    return rows


def damage(rows):
    """Every conversation's turns after damage, in order, as (turn, role, text)."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        part = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        out[conv]
        role, text = name(role), name(text)
        if part:
            text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
            row = (turn, "user" if part == 4 else role, text)
            out[conv] += [row] * (2 if part == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {c: sorted(r, key=key) for c, r in out.items()}


def repaired(turns):
    """The contract's columns by dynamic programming over whole edit strings, first turn first."""
    seen, faults = set(), []
    for _, role, text in turns:
        left = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    go = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    better = lambda a, b: b if a is None or b[:2] < a[:2] else a

    def inserted(best):
        for _ in range(3):
            for s, (cost, audit, rows) in list(best.items()):
                t, role = (3, "assistant") if s == 2 else (2, "user")
                best[t] = better(best.get(t), (cost + 5, audit + "I", (rows, (role, ""))))
        return best

    best = inserted({0: (0, "", None)})
    for (_, role, text), fault in zip(turns, faults):
        new = {}
        for s, (cost, audit, rows) in best.items():
            new[s] = better(new.get(s), (cost + 2, audit + "D", rows))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                for t, r in ((2, "user"), (3, "assistant")):
                    if (r[0], s) in go and go[r[0], s] == t:
                        new[t] = better(new.get(t), (cost + 1 + more, audit + "R", (rows, (r, text))))
                if (role[:1], s) in go:
                    t = go[role[:1], s]
                    new[t] = better(new.get(t), (cost + more, audit + "K", (rows, (role, text))))
        best = inserted(new)
    cost, audit, rows = min((best[s] for s in (0, 3) if s in best), key=lambda b: b[:2])
    lines = []
    while rows:
        rows, (role, text) = rows
        lines.append(f"{role}:{text}")
    lines.reverse()
    numbers = {t for t, _, _ in turns if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


@pytest.mark.parametrize("chunk", [7, conversation_repair.CHUNK])
def test_repair(spark, chunk):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(5)
    want = {c: repaired(t) for c, t in damage(rows).items()}
    got = conversation_repair.report(conversation_repair.damaged(df), chunk).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id][0]
    lines = collections.defaultdict(list)
    for r in conversation_repair.repair(conversation_repair.damaged(df)).orderBy("place").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {c: x for c, (_, x) in want.items() if x}
    # an insertion (5) never beats the deletion of its neighbour (2)
    assert sum(w[0][5] for w in want.values()) > 100 and {c for w in want.values() for c in w[0][6]} == set("DKR")


def test_repair_carries_state_over_batches_and_spills(spark):
    """The stream of one giant conversation cut into small Arrow batches, in chunks of 50 turns."""
    import pyarrow as pa

    rows = [(1, -k, b"d%d" % k, "ua"[k % 2] if k % 7 else "s", k % 3 and 1, False) for k in range(2000)]
    names = ["conv_id", "turn", "digest", "initial", "fault", "later"]
    batches = lambda n: (pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + n]]) for k in range(0, 2000, n))
    one = pa.Table.from_batches(conversation_repair._backward(10**9)(batches(2000))).to_pylist()
    many = pa.Table.from_batches(conversation_repair._backward(50)(batches(13))).to_pylist()
    assert [r["counts"] for r in one if r["part"] == 0] == [r["counts"] for r in many if r["part"] == 0]
    pieces = sorted((r for r in many if r["part"]), key=lambda r: r["ord"])
    assert len(pieces) == 40 and b"".join(r["ops"] for r in pieces) == one[0]["ops"]


def test_repair_of_empty_tables(spark):
    df = spark.createDataFrame([], TURNS)
    assert conversation_repair.report(conversation_repair.damaged(df)).count() == 0
    assert conversation_repair.repair(df).count() == 0


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(2)
    parts = ["a", "th", "the", " ", "  ", " " * 17, "▁", "\n", "\t", "日", "本", "🙂", "é", "é", "<s>", "<0x41>", "\x00", "�", "ing", "23", "\r\n", "﻿", "!!!", "ab" * 9, "z" * 40, "\x7f", "Ω"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    return texts + [None, "", " ", "zz" * 20_000, "日本" * 9_000, " " * 9_000, "word and " * 150_000, "\n" * 5_000]


def test_pieces_are_those_of_the_library(spark, library):
    texts = odd_texts()
    rows = [(k, t, [1], "d") for k, t in enumerate(texts)] + [(None, "no id", None, None), (3, texts[3], [2], "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string").repartition(3)
    encoded = piece_codec.encode(docs, MODEL)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    want = {k: library.encode(t or "", add_eos=True) for k, t in enumerate(texts)}
    assert {k: v for k, v in got.items() if k >= 0} == want and len(got) == len(want) + 1
    back = {r.doc_id: r.text for r in piece_codec.decode(encoded, MODEL).collect()}
    assert all(back[k] == library.decode(ids) for k, ids in want.items())
    report = {r.doc_id: r for r in piece_codec.report(docs, MODEL).collect()}
    for k, ids in want.items():
        r, sha = report[k], lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert piece_codec.report(docs.limit(0), MODEL).count() == 0


def test_decoding_of_any_ids(library):
    codec, rng = piece_codec.codec(MODEL), random.Random(4)
    for _ in range(4000):
        ids = [rng.choice([rng.randint(0, 31_999), rng.randint(3, 258), rng.randint(131, 258)]) for _ in range(rng.randint(0, 9))]
        assert codec.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_backtracking_takes_pieces_back():
    """A longest match that no list of compatible pieces begins with is given up."""
    codec = piece_codec.codec(MODEL)
    pieces = sorted(codec.ids)
    rng, longest_first = random.Random(6), 0
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(2)).replace("▁", "")
        if text and set(text) <= codec.chars:
            found = [codec.names[i] for i in codec.backtrack(text)]
            assert found == codec.merged(text)
            longest_first += max((p for p in codec.ids if text.startswith(p)), key=len) != found[0] if _ < 100 else 0
    assert longest_first > 5


def score(a, b):
    return max(-cover_tree.LONG, min(cover_tree.LONG, sum(int(x) * int(y) for x, y in zip(a, b))))


def mined(rows, anchors):
    """(anchor, positive, rank, negative, scores) by looking at every pair."""
    out = set()
    for a, label, v in anchors:
        first = lambda found, k: sorted(found, key=lambda f: (-f[0], f[1]))[:k]
        scored = [(score(v, w), i, of) for i, of, w in rows]
        for p, i, _ in first([s for s in scored if s[2] == label and s[1] != a], 5):
            fits = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p]
            for rank, (n, j, _) in enumerate(first(fits, 3), 1):
                out.add((a, i, rank, j, p, n))
    return out


@pytest.mark.parametrize("shard", [60, cover_tree.SHARD])
def test_hard_negatives(spark, shard, monkeypatch):
    monkeypatch.setattr(cover_tree, "SHARD", shard)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6))
    vectors = [(centres[k % 12] + rng.normal(size=6) * 0.2).round(2).tolist() for k in range(500)]
    vectors[20:60] = [vectors[0]] * 40  # ties, some of them anchors
    vectors[100] = vectors[101] = [0.0] * 6
    vectors[150], vectors[151], vectors[152] = [1.0, 2.0], [3e18] * 6, [2e18] * 6
    rows = [(k, k % 3, v) for k, v in enumerate(vectors)]
    odd = [(600, None, vectors[1]), (700, 1, None), (None, 1, vectors[1]), (750, 1, [1.0, None]), (800, 1, [float("nan")] * 6), (850, 2, [float("inf")] * 6), (900, 2, [])]
    df = spark.createDataFrame([(*r, "v", 1) for r in rows + odd + rows[:9]], "vec_id long, label int, embedding array<double>, v string, score int").repartition(4)
    taken = cover_tree.whole(df)
    got = cover_tree.mine(taken, taken.where("vec_id % 50 = 0")).collect()
    plain = [(i, of, [float(np.floor(256 * x)) for x in v]) for i, of, v in rows + [odd[-1]]]
    want = mined(plain, [r for r in plain if r[0] % 50 == 0])
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50
    assert cover_tree.mine(taken.limit(0), taken).count() == 0
    assert cover_tree.mine(taken, taken.limit(0)).count() == 0


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.05))
    labels = rng.integers(0, 3, 4000)
    forest = cover_tree.Forest(np.arange(4000), labels, x)
    todo, leaves = list(forest.roots.values()), []
    while todo:
        n = todo.pop()
        if forest.leaf[n]:
            leaves.append(forest.last[n] - forest.first[n])
        else:
            todo += range(forest.first[n], forest.last[n])
    assert sum(leaves) == 4000 and len(leaves) > 100
    visited = []
    products = forest.products
    forest.products = lambda p, q: visited.append(len(p)) or products(p, q)
    for q in x[:30]:
        exact = np.rint(x @ q).astype(np.int64)
        top = int(exact.max())
        windows = [(-cover_tree.LONG, cover_tree.LONG), (top // 4, top // 2), (top // 2, 95 * top // 100), (top + 1, 2 * top)]
        roots = [forest.roots[0], forest.roots[2]]
        for (low, high), (ids, scores) in zip(windows, forest.search(q, roots, windows, 3, None)):
            fits = np.flatnonzero((labels != 1) & (exact >= low) & (exact <= high))
            best = fits[np.lexsort((fits, -exact[fits]))][:3]
            assert ids.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()
    assert sum(visited) < 30 * (labels != 1).sum() / 3


@pytest.mark.parametrize("name", ["op11_stream_repair", "op12_backtracking_pieces", "op13_cover_tree"])
def test_empty_query_tables(spark, sf, tmp_path, name):
    for t in ("documents", "conversations", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_query_reads_every_document(spark, sf, library):
    got = {r.doc_id: r for r in queries.QUERIES["op12_backtracking_pieces"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert {d.doc_id: len(library.encode(d.text, add_eos=True)) for d in docs} == {i: r.n_tokens for i, r in got.items()}
