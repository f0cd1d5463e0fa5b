"""Every dealt operator against brute force on small tables with odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pairloom.llm import block_simhash, chat_format, deleted_interpolation, extendible_sharding, lsa_neighbours
from pairloom.llm import queries, rank_order, simhash_vptree, spaced_seeds, suffix_dedup, vector_packing
from pairloom.llm.common import distinct_documents, fold, merged, packed, unpacked

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, fp long, row string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    words = ["the", "of", "Rain", "plain", "stays", "mainly", "in", "für", "größer", "日本", "x1", "a.b", "nach"]
    line = "this passage of some fifty bytes and more is in several documents of the table"
    texts = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(40)]
    texts += [None, "", " \t\n", "one", "two words", line, texts[3], texts[3], texts[5] + " " + line, line + " " + texts[7], "z" * 400, "z" * 300, "42 17", texts[9] * 40]
    rows = [(10 * i, t, ("de" if "für" in t else "en") if t and i % 7 else None, "s", len(t or ""), "b", 1, "r") for i, t in enumerate(texts)]
    rows += [(30, "zzz later", "en", "s", 9, "b", 1, "r"), rows[4], (None, "no id at all", "en", "s", 12, "b", 1, "r"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    """id to text as the operators see it; null ids below all others."""
    out = {}
    for r in df.collect():
        i = -(2**63) if r.doc_id is None else r.doc_id
        key = (r.text is not None, r.text or "")
        out[i] = min(out.get(i, key), key)
    return {i: t for i, (_, t) in out.items()}


def outer(i):
    return None if i == -(2**63) else i


def by_id(df):
    rows = df.collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_helpers():
    a, b = np.arange(5, dtype=np.int64) - 2, np.arange(5, dtype=np.uint32)
    assert all((x == y).all() for x, y in zip(unpacked(packed(a, b)), (a, b)))
    doc, s, e = merged(np.array([2, 1, 1, 1]), np.array([0, 5, 0, 9]), np.array([3, 8, 5, 12]))
    assert list(zip(doc, s, e)) == [(1, 0, 8), (1, 9, 12), (2, 0, 3)]


def test_suffix_dedup(odd):
    want, owner = {}, {}
    docs = plain(odd)
    for i in sorted(docs):
        raw = docs[i].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if owner.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        want[outer(i)] = (len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = by_id(suffix_dedup.strip_repeats(odd, carry=["row"]))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert sum(x[1] for x in want.values()) > 500


def test_suffix_dedup_splits_common_triggers(spark):
    rng = np.random.default_rng(6)
    letters = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    head = "a common header of forty bytes, or more."
    texts = [letters(40) + head + letters(40) for _ in range(300)]
    texts += [texts[i][20 : 110 - i % 40] + letters(30) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    first, want = {}, {i: set() for i in range(len(texts))}
    for i, t in enumerate(texts):
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                want[i] |= set(range(p, p + 50))
    split = suffix_dedup.common_triggers(docs, 50, 1, 100)
    assert len(split)
    for often in (100, 1 << 40):
        got = {i: set() for i in want}
        for r in suffix_dedup.repeated_spans(docs, 50, 1, often).collect():
            got[r.doc_id] |= set(range(r.start, r.end))
        assert got == want
    # no trigger has more phrases than equal windows have places
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    _, _, _, trig, phrase = suffix_dedup.parse(data, offs, 50, split)
    assert np.unique(np.unique(np.stack([trig, phrase]), axis=1)[0], return_counts=True)[1].max() < 100


def test_suffix_dedup_of_long_texts(spark):
    """A text of several pieces, and slices of it and of its copy, against a set of all windows."""
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefgh "), 3 * suffix_dedup.PIECE // 2))
    at = [5, suffix_dedup.PIECE - 30, suffix_dedup.PIECE + 1, len(long) - 900]
    texts = [long, *[long[a : a + 800] + "x" + long[a + 300 : a + 360] for a in at], "y" * 100 + long[1000:]]
    windows, want = set(), {}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        own = [t[p : p + 50] for p in range(len(t) - 49)]
        for p, w in enumerate(own):
            if w in windows:
                gone[p : p + 50] = True
        windows.update(own if i < 5 else [])
        want[i] = (len(t), int(gone.sum()), hashlib.sha256(np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {i: (r.n_bytes, r.n_removed, r.kept_sha256) for i, r in by_id(suffix_dedup.strip_repeats(docs)).items()} == want
    assert want[5][1] > len(long) - 1100


def test_simhash_groups(odd):
    docs = plain(odd)
    fps = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in docs}
    for _ in docs:
        for i in docs:
            for j in docs:
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    got = by_id(simhash_vptree.near_duplicates(odd))
    assert {i: (r.fp[0] % 2**64, r.component_id) for i, r in got.items()} == {outer(i): (fps[i], outer(root[i])) for i in docs}


def test_tree_finds_every_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near])).view(np.int64)
    points = spark.createDataFrame([(k, 1, [int(x)]) for k, x in enumerate(fp)], simhash_vptree.POINT)
    edges = simhash_vptree.links(points, 3, leaf=16, homes=5).collect()
    u = fp.view(np.uint64)
    assert all((int(u[r.a]) ^ int(u[r.b])).bit_count() for r in edges)
    root = np.arange(len(fp))
    for _ in range(3):
        for r in edges:
            root[r.a] = root[r.b] = min(root[r.a], root[r.b])
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None]) <= 3)
    assert len(i) > len(fp) and (root[i] == root[j]).all()


def test_components_of_a_chain(spark):
    from pairloom.plans import components

    order = np.random.default_rng(0).permutation(400).tolist()
    got = components(spark.createDataFrame(list(zip(order[:-1], order[1:])), "a long, b long")).collect()
    assert len(got) == 400 and {r.root for r in got} == {0}


def test_spaced_seeds(odd, spark):
    item = "in the plain one two three stays mainly four five six seven eight nine ten eleven"
    words = item.split()
    swapped = " ".join("other" if k in (3, 9, 14) else w for k, w in enumerate(words))
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(9001, "x y " + item.upper()), (9002, swapped), (9003, " ".join(words[::2])), (9004, "foo tiny item bar")], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, "")], "item_id long, text string")
    got = spaced_seeds.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in got} == {(9001, 1, 16), (9002, 1, 13), (9004, 2, 2)}
    assert spaced_seeds.contaminated(docs, bench.limit(0)).count() == 0
    kept = {r.doc_id for r in spaced_seeds.keep_clean(docs, bench).collect()}
    assert not kept & {9001, 9002, 9004} and 9003 in kept


def overlaps_by_brute_force(text, item):
    """The best stretch of a text and an item over all diagonals on which a mask fits equal tokens."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    a, b = words(text), words(item)
    least, best = min(spaced_seeds.STRETCH, len(b)), None
    shortest = min(map(len, spaced_seeds.MASKS))
    masks = list(spaced_seeds.MASKS) + (["1" * len(b)] if 0 < len(b) < shortest else [])
    for shift in range(-len(b), len(a)):
        same = {i: a[i + shift] == b[i] for i in range(len(b)) if 0 <= i + shift < len(a)}
        hit = any(all(c == "0" or same[p + k] for k, c in enumerate(m)) for m in masks for p in same if p + len(m) - 1 in same)
        if not hit:
            continue
        longest = None
        for end in sorted(i for i in same if same[i]):
            for start in sorted(i for i in same if same[i] and i <= end):
                size, equal = end - start + 1, sum(same[i] for i in range(start, end + 1))
                if equal >= spaced_seeds.SHARE * size - 1e-9:
                    if longest is None or size > longest[0]:
                        longest = (size, equal, start)
                    break
        if longest and longest[0] >= least:
            size, equal, start = longest
            cand = (-equal, size, shift + start, start)
            best = cand if best is None or cand < best else best
    return best and (-best[0], best[1], best[2], best[3])


def test_spaced_seeds_by_brute_force(spark):
    rng = np.random.default_rng(14)
    words = ["a", "b", "cc", "dé", "x1", "the", "of", "日本"]
    line = lambda n: " ".join(rng.choice(words, n))
    items = [line(int(n)) for n in rng.integers(1, 30, 12)] + ["a " * 40, "a " * 20 + "b " * 20, None, " .,", "the of the"]
    texts = [line(int(n)) for n in rng.integers(0, 60, 30)] + ["a " * 90, None, "", "the of the", "b " * 15 + "a " * 15]
    for k in range(15):
        own = (items[k % 12] or "").split()
        for p in rng.integers(0, len(own), len(own) // 7):
            own[p] = "other"
        texts.append(line(5) + " " + " ".join(own).upper() + "! " + line(4))
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, item_id long").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.overlap, r.doc_start, r.item_start) for r in spaced_seeds.contaminated(docs, bench).collect()}
    want = {(i, j): f for i, t in enumerate(texts) for j, x in enumerate(items) if (f := overlaps_by_brute_force(t, x))}
    assert got == want and len(want) > 20


def test_spaced_seeds_of_repeated_tokens_end():
    import pyarrow as pa

    items = spaced_seeds.Items(np.array([5]), pa.array(["a " * 500]))
    found = items.overlaps(pa.array(["b", "a " * 20_000]))
    assert [(r, i, n) for r, i, n, *_ in found] == [(1, 0, 500)]


def test_masks_hit_two_substitutions():
    from itertools import combinations

    for gone in combinations(range(spaced_seeds.STRETCH), 2):
        assert any(not any(m[k] == "1" and o + k in gone for k in range(len(m))) for m in spaced_seeds.MASKS for o in range(spaced_seeds.STRETCH - len(m) + 1))


def test_packing(odd):
    model = Tokenizer.from_file(BPE)
    rows = vector_packing.pack(odd, BPE, with_ids=True, pool=4).collect()
    size, sequences = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.input_ids, np.uint32).tobytes()) == r.ids_crc32 and len(r.input_ids) == r.length
        size[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    want = collections.Counter()
    for r in odd.collect():
        want[r.doc_id] += len(model.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert size == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at.bit_count() == 1


def test_packing_limits():
    packer = vector_packing.Packer((64, 3, 40))
    packer.add([(k, 0, 5 + 7 * k % 50, 4 + 7 * k % 50) for k in range(60)])
    done = collections.Counter()
    for pieces in packer.drain(True):
        assert sum(p[2] for p in pieces) <= 64 and len(pieces) <= 3 and sum(p[2] - (p[1] == 0) for p in pieces) <= 40
        for k, _, n in pieces:
            done[k] += n
    assert done == collections.Counter({k: 5 + 7 * k % 50 for k in range(60)})


@pytest.mark.parametrize("text", ["", " ", "a  b", " a b ", "a \n b", "it's 'tis don't", "a\n\n b", "é ü　 日本", "<|endoftext|> a", "x <|endoftext|>"])
def test_tokens_are_those_of_the_library(text):
    assert np.frombuffer(vector_packing.bpe(BPE).ids(text), np.uint32).tolist() == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_chat_round_trip(spark):
    odd_text = "<|turn|> <\\|says|> <\\\\| <| </s> é日 \n\n  "
    turns = [("system", None), ("user", odd_text), ("assistant", odd_text), (None, "x"), ("assistant", ""), ("assistant", " tail ")]
    rows = [(5, k, r, t) for k, (r, t) in enumerate(turns)] + [(None, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.format_chats(df, BPE).collect()}
    assert chat_format.read_turns(out[5].formatted) == [(r or "", t or "") for r, t in turns]
    assert chat_format.read_loss(out[5].formatted, np.array(out[5].loss_starts), np.array(out[5].loss_ends)) == odd_text + " tail "
    assert sum(out[None].loss_mask) == 0
    assert chat_format.report(df.limit(0), BPE).count() == 0


def test_language_model(odd):
    docs = distinct_documents(odd).withColumn("fold", F.coalesce(fold(7), F.lit(0)).cast("long"))
    texts, count = plain(odd), collections.Counter()
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    for i, t in tokens.items():
        if i < 0 or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(t)
    total, types = sum(count.values()), len(count)
    got = {r.doc_id: r for r in deleted_interpolation.score(docs).collect()}
    assert set(got) == set(tokens)
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), total)
        assert abs(r.base_score - sum(np.log10((count[w] + 1) / (total + types + 1)) for w in t)) < 1e-6
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert deleted_interpolation.score(docs.limit(0)).count() == 0


def brute_model(tokens, folds):
    """Scores of a bigram model with every word as context, by dictionaries."""
    bigrams = {i: list(zip([1, *t[:-1]], t)) for i, t in tokens.items()}

    def counts(use):
        one, two, of = collections.Counter(), collections.Counter(), collections.Counter()
        for i in tokens:
            if folds[i] in use:
                one.update(tokens[i])
                two.update(bigrams[i])
                of.update(v for v, _ in bigrams[i])
        return one, two, of

    def bucket(c):
        return 0 if not c else 1 + (c - 1).bit_length()

    one, two, of = counts(set(range(7)) - {2})
    a1, a2, a0 = counts(set(range(7)) - {2, 3})
    total, total_a, p0 = sum(one.values()), sum(a1.values()), 1 / (len(one) + 1)
    held = sorted(counts({3})[1].items(), key=str)
    columns = zip(*[(bucket(a0[v]), n, a1[w] / total_a, a2[v, w] / max(1, a0[v])) for (v, w), n in held])
    kinds = int, float, float, float
    l = deleted_interpolation.learn_weights(*[np.array(c, k) for c, k in zip(columns, kinds)], p0, bucket(max(of.values())) + 1)  # noqa: E741
    p = lambda v, w: l[bucket(of[v])] @ [two[v, w] / max(1, of[v]), one[w] / total, p0]
    return {i: sum(np.log10(p(v, w)) for v, w in b) for i, b in bigrams.items()}


@pytest.mark.parametrize("contexts", [1 << 16, 3])
def test_language_model_by_brute_force(spark, contexts, monkeypatch):
    monkeypatch.setattr(deleted_interpolation, "BUCKET", 1 << 12)
    rng = np.random.default_rng(8)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 12_000) % 3000]
    texts = {i: " ".join(words[20 * i : 20 * i + 20]) for i in range(600)}
    texts |= {600 + i: f"rare{i // 3} follows{i // 3} w1" for i in range(300)}
    folds = {i: i % 7 for i in texts}
    want = brute_model({i: [*t.split(), None] for i, t in texts.items()}, folds)
    docs = spark.createDataFrame([(i, t, folds[i]) for i, t in texts.items()], "doc_id long, text string, fold long").repartition(4)
    got = {r.doc_id: r.score for r in deleted_interpolation.score(docs, contexts).collect()}
    assert set(got) == set(want)
    # the weights are learned on cells of a quarter of a logarithm
    assert max(abs(got[i] / want[i] - 1) for i in want) < 0.01


def test_bigrams_of_a_word_outlast_growth(spark):
    """The estimates after a rare word stay when many other documents are added."""
    rows = [(i, "seldom seen pair here", 0 if i % 3 else 3) for i in range(9)]
    rows += [(100 + i, f"x{i % 50} y{i * 7 % 50} " * 20, i % 7) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fold long")
    got = {r.doc_id: r for r in deleted_interpolation.score(docs, contexts=16).collect()}
    unigram = sum(np.log10(9 / got[1].train_tokens) for _ in range(4))
    assert got[1].score > unigram / 2


def test_em_finds_the_mixture():
    n = np.array([70.0, 30.0])
    w = deleted_interpolation.learn_weights(np.array([1, 1]), n, np.array([1.0, 0.0]), np.array([0.0, 0.0]), 1e-2, 2)
    assert abs(w[1, 1] - 0.7) < 0.02


def test_fingerprints(odd):
    texts = plain(odd)
    order = sorted(texts, reverse=True)
    got = by_id(block_simhash.edit_report(odd))
    fps = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for k, i in enumerate(order):
        t, after = texts[i], order[(k + 1) % len(order)]
        edited = t[: len(t) - len(t) // 2] + texts[after][: len(t) // 2]
        r = got[outer(i)]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == 1 - (fps[outer(i)] ^ fps[outer(after)]).bit_count() / 64
        if i % 100 == 0 and i >= 0:
            assert r.near_count == sum((fps[i] ^ x).bit_count() <= 3 for x in fps.values())
    assert fps[30] == fps[460] == fps[470]


def test_weighted_fingerprints_by_brute_force(odd):
    """Every term's hash votes on each bit with the term's length."""
    docs = {i: t for i, t in plain(odd).items() if t.split()}
    got = {r.doc_id: r.fp % 2**64 for r in block_simhash.fingerprints(distinct_documents(odd)).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        w = re.split("[ \t\n\x0b\f\r]+", t.lower().strip(" \t\n"))
        terms = list(zip(w, w[1:])) or [(w[0], w[0])]
        votes, total = [0] * 64, sum(len(a) + len(b) for a, b in terms)
        for a, b in terms:
            h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
            for k in range(64):
                votes[k] += (len(a) + len(b)) * (h >> k & 1)
        assert got[i] == sum(1 << k for k in range(64) if 2 * votes[k] > total)


def test_languages(odd):
    profiles = rank_order.learn_profiles(odd)
    assert set(profiles) == {"de", "en"}
    got = by_id(rank_order.identify(distinct_documents(odd), profiles).withColumn("doc_id", F.when(F.col("doc_id") >= 0, F.col("doc_id"))))
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {None, 400, 410, 420, 520}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in rank_order.identify(distinct_documents(odd), {}).collect()} == {"und"}


def gram_counts_of(text):
    """The n-grams of 1 to 3 letters of a text as codes, by a dictionary."""
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()
    out, none = collections.Counter(), (1 << rank_order.CODE) - 1
    line = [0, *[ord(c) for c in " ".join(words).replace(" ", "\0")], 0] if words else []
    code = lambda a, b, c: (a << 2 * rank_order.CODE) | (b << rank_order.CODE) | c
    out.update(code(0, 0, a) for a in line if a)
    out.update(code(a, b, none) for a, b in zip(line, line[1:]))
    out.update(code(a, b, c) for a, b, c in zip(line, line[1:], line[2:]) if b)
    return out


def test_grams_by_dictionary_in_any_place(odd):
    """A text has the same n-grams as first, middle and last of a block, letters from all planes."""
    texts = [t for t in plain(odd).values()] + ["𐐀𐐁 𐐀𐐁b", "漢字 漢字かな x", "\U0001F642 a", "ǅ ß İ"]
    want = [gram_counts_of(t) for t in texts]
    for order in (list(range(len(texts))), list(range(len(texts)))[::-1], *[[k] for k in range(len(texts))], [5, 5, 3, 5]):
        raw = [texts[k].encode() for k in order]
        offs = np.cumsum([0, *map(len, raw)])
        row, gram, count = rank_order.gram_counts(np.frombuffer(b"".join(raw), np.uint8), offs)
        got = collections.defaultdict(dict)
        for r, g, n in zip(row.tolist(), gram.tolist(), count.tolist()):
            got[r][g] = n
        assert [got[p] for p in range(len(order))] == [want[k] for k in order]


def test_language_scores_by_brute_force(spark, odd):
    docs, size = plain(odd), 40
    lists = {}
    rank = lambda counts: {g: p for p, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}
    by_lang = collections.defaultdict(collections.Counter)
    for r in odd.collect():
        if r.lang is not None:
            by_lang[r.lang].update(gram_counts_of(r.text))
    lists = {lang: rank(c) for lang, c in by_lang.items()}
    profiles = rank_order.learn_profiles(odd, size=size)
    assert {lang: [int(g) for g in p] for lang, p in profiles.items()} == {lang: sorted(p, key=p.get) for lang, p in lists.items()}
    model = rank_order.Identifier(profiles, size)
    import pyarrow as pa

    texts = [docs[i] for i in sorted(docs)]
    names, scores = model.batch(pa.array(texts))
    for text, name, score in zip(texts, names, scores):
        own = rank(gram_counts_of(text))
        if not own:
            assert (name, score) == ("und", 0)
            continue
        cost = {lang: sum(abs(p[g] - k) if g in p else size for g, k in own.items()) / (len(own) * size) for lang, p in lists.items()}
        best = min(sorted(cost), key=cost.get)
        assert name == best and abs(score - (1 - cost[best])) < 1e-9


def test_language_ties_go_by_name(spark):
    rows = spark.createDataFrame([(1, "abc", "zz"), (2, "abc", "aa"), (3, "abc", None)], "doc_id long, text string, lang string")
    got = rank_order.identify(distinct_documents(rows), rank_order.learn_profiles(rows)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("aa", 1.0)}


def test_quality(spark, odd):
    docs = distinct_documents(odd)
    labels = odd.select("doc_id", F.when(F.col("text").contains("z"), 0).otherwise(1).alias("label"))
    got = {r.doc_id: r.score for r in lsa_neighbours.score(docs, labels).collect()}
    assert len(got) == docs.count() and got[500] < 0.5 < got[0] and 0 < got[400] < 1
    assert {r.score for r in lsa_neighbours.score(docs, labels.limit(0)).collect()} == {0.5}


def test_sharding_of_hot_keys(spark):
    rows = spark.createDataFrame([("hot" if k % 3 == 0 else f"k{k % 40}", 100 if k else 5000) for k in range(900)] + [(None, 40), (None, None)], "key string, size long")
    got = extendible_sharding.assign(rows, "key", "size", 1000)
    assert got.count() == 902
    for r in got.groupBy("depth", "prefix", "page").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        assert r.b <= 1000 or r.n == 1
    entries = extendible_sharding.directory(extendible_sharding.assign(rows.where("key <> 'hot'"), "key", "size", 4000)).collect()
    assert len({r.entry for r in entries}) == len(entries)


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [("a", 300, 1, "x"), ("a", 300, 1, "x"), ("a", 900, 2, None), (None, 5, 3, "n"), ("b", None, 4, "y")] + [(f"k{k}", 50, k, "z") for k in range(200)]
    df = spark.createDataFrame(rows, "key string, size long, page long, row string")
    extendible_sharding.write_shards(df, "key", "size", f"{tmp_path}/shards", 1000)
    back = spark.read.parquet(f"{tmp_path}/shards")
    order = lambda x: sorted(x, key=str)
    assert order(tuple(r) for r in back.select("key", "size", "_page", "row").collect()) == order(rows)
    back = back.withColumn("file", F.input_file_name())
    for r in back.groupBy("depth", "prefix", "page").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("file").alias("files")).collect():
        assert (r.b is None or r.b <= 1000 or r.n == 1) and r.files == 1


EMPTY = ["op1_extendible_sharding", "op2_simhash_vptree", "op3_spaced_seeds", "op4_vector_packing", "op6_deleted_interpolation", "op7_block_simhash", "op8_rank_order", "op9_lsa_neighbours", "op10_suffix_dedup", "pipeline"]


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, sf, tmp_path, name):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    query = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert query(spark, str(tmp_path)).count() == 0


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, "mainly in the plain stays")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == odd.columns
            ids = [r.doc_id for r in out.select("doc_id").collect()]
            if name == "language_id":
                assert not {400, 410, 420, 520} & set(ids)
            if name == "near_dedup":
                assert len(ids) == len(set(ids)) and {30, 460, 470} & set(ids) == {30}
        docs = out
    assert docs.where("length > 0").count() == docs.count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (df, want))
    assert a.equals(b.astype(a.dtypes))
