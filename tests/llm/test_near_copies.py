"""Groups of near copies against all pairs of shingle sets, on odd and planted rows."""

import numpy as np
import pytest

from pairloom.llm import near_copies
from pairloom.llm.simhash_vptree import vote


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def roots(sets, least=0.8):
    """Smallest id of each group by looking at every pair."""
    root = {i: i for i in sets}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if similarity(sets[i], sets[j]) >= least:
                a, b = up(i), up(j)
                root[max(a, b)] = min(a, b)
    return {i: up(i) for i in ids}


def planted():
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n: list(rng.choice(words, n))
    out = []
    for _ in range(60):  # long texts and copies of many similarities
        base = text(int(rng.integers(60, 400)))
        out.append(base)
        for _ in range(int(rng.integers(0, 4))):
            copy = list(base)
            for p in rng.choice(len(base), max(1, int(len(base) * rng.choice([0.005, 0.015, 0.03, 0.06]))), replace=False):
                copy[p] = str(rng.choice(words))
            out.append(copy)
    for n in (8, 10, 12, 16):  # the last word differs: similarity 0.60, 0.71, 0.78, 0.85
        base = text(n)
        out += [base, [*base[:-1], "other"]]
    base = text(150)
    out += [base, base + base, base[:120], base[:121] + ["x"]]
    family = text(200)  # one group of many near copies
    for k in range(80):
        copy = list(family)
        copy[k], copy[(7 * k + 3) % 200] = f"e{k}", f"f{k}"
        out.append(copy)
    texts = [" ".join(t) for t in out]
    return texts + [texts[0], texts[0].upper(), "", None, " \n", "one", "one", "One ", "two words", "zz " * 300, "zz " * 5]


@pytest.mark.parametrize("homes", [near_copies.HOMES, 64])
def test_groups_by_brute_force(spark, homes):
    texts = planted()
    rows = [(3 * k, t, "g", b"s") for k, t in enumerate(texts)] + [(None, "one", "g", None), (0, texts[0] + " zzz", "g", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, same binary").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs, homes=homes).collect()}
    assert len(got) == len(texts) + 1
    sets = {3 * k: shingles(t) for k, t in enumerate(texts)} | {-1: shingles("one")}
    want = {i: r for i, r in roots(sets).items()}
    outer = lambda i: None if i == -1 else i
    assert got == {outer(i): outer(r) for i, r in want.items()}
    assert len(set(want.values())) < len(want) - 100


def test_recall_of_pairs_at_the_similarity():
    """Pairs of 0.8 to 0.85 lie within the radius, those of 0.7 beyond ``TIGHT``."""
    rng = np.random.default_rng(12)
    found, total, close = 0, 0, 0
    for _ in range(400):
        n = int(rng.integers(100, 800))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        share = rng.uniform(0.8, 0.85)
        k = int(round(n * 2 * share / (1 + share)))
        b = np.concatenate([a[:k], rng.integers(0, 2**63, n - k, dtype=np.uint64)])
        c = np.concatenate([a[: int(n * 0.82)], rng.integers(0, 2**63, n - int(n * 0.82), dtype=np.uint64)])  # 0.7
        fp, _ = vote([a.tolist(), b.tolist(), c.tolist()], near_copies.WORDS)
        total += 1
        found += np.bitwise_count(fp[0] ^ fp[1]).sum() <= near_copies.RADIUS
        close += np.bitwise_count(fp[0] ^ fp[2]).sum() <= near_copies.TIGHT
    assert found / total > 0.98 and close / total < 0.02


def test_candidates_span_every_cluster():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 2**63, (30, 4), dtype=np.uint64)
    fp = base[rng.integers(0, 30, 600)].copy()
    for row in fp:
        for _ in range(int(rng.integers(0, 20))):
            row[rng.integers(0, 4)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    d = sum(np.bitwise_count(fp[:, None, w] ^ fp[None, :, w]).astype(int) for w in range(4))
    i, j = near_copies.candidates(fp, len(fp), near_copies.TIGHT, near_copies.RADIUS)
    assert (d[i, j] <= near_copies.RADIUS).all() and len(i) < 2 * len(fp)

    def cluster(pairs, limit):
        root = np.arange(len(fp))
        while True:
            low = root.copy()
            for a, b in pairs:
                if d[a, b] <= limit:
                    low[a] = low[b] = min(low[a], low[b], low[low[a]], low[low[b]])
            if (low == root).all():
                return low
            root = low

    for limit in (near_copies.TIGHT, near_copies.RADIUS):
        every = np.argwhere(np.triu(d <= limit, 1))
        assert (cluster(list(zip(i, j)), limit) == cluster(every, limit)).all()


def test_pairs_beyond_the_radius(spark):
    """Sets of four and of five shingles are similar, but many of their fingerprints lie beyond the radius."""
    rng = np.random.default_rng(14)
    texts, far = ["in the end of all " * 3] * 2, 0
    for k in range(60):
        base = [f"t{k}w{i}" for i in range(9)]
        texts += [" ".join(base), " ".join(base[:8])]
    for k in range(60):  # a third text beside two that are closer to each other
        base = [f"s{k}w{i}" for i in rng.permutation(40)]
        texts += [" ".join(base), " ".join(base[:-4]), " ".join(base[4:]), " ".join([*base[:-1], "x"])]
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    for k in range(2, 122, 2):
        fp, _ = vote([near_copies.shingle_hashes(texts[k + x].encode(), 5) for x in (0, 1)], near_copies.WORDS)
        far += int(np.bitwise_count(fp[0] ^ fp[1]).sum() > near_copies.RADIUS)
    assert far > 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()} == roots(sets)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(15)
    hashes = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    for common in ((hashes[:0], np.zeros(0, np.int64)), (hashes[::3], rng.integers(2, 9, len(hashes[::3])))):
        for _ in range(300):
            a = np.unique(rng.choice(hashes, int(rng.integers(1, 60)), replace=False))
            b = np.unique(np.concatenate([rng.choice(a, max(1, len(a) - int(rng.integers(0, 6))), replace=False), rng.choice(hashes, int(rng.integers(0, 4)))]))
            if similarity(set(a.tolist()), set(b.tolist())) >= 0.8:
                assert np.intersect1d(near_copies._prefix(a, 0.8, common), near_copies._prefix(b, 0.8, common)).size


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.groups(docs).count() == 0


def test_variants_of_one_text_meet_in_few_pairs(spark, monkeypatch):
    """Most variants of a text are about as near to it as the similarity, and less near to each other."""
    rng = np.random.default_rng(15)
    base, texts = [f"v{i}" for i in range(150)], []
    for k in range(400):
        copy = list(base)
        for p in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            copy[p] = f"e{k}x{p}"
        texts.append(" ".join(copy))
    pairs, check = [], near_copies.similar_pairs
    monkeypatch.setattr(near_copies, "similar_pairs", lambda docs, found, *rest: pairs.append(found.distinct().count()) or check(docs, found, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()} == roots({k: shingles(t) for k, t in enumerate(texts)})
    assert sum(pairs) < 5 * len(texts)


def test_parity_bits_never_differ_more_than_the_sets():
    rng = np.random.default_rng(16)
    for n in (0, 5, 100, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * n)], rng.integers(0, 2**63, n // 8, dtype=np.uint64)]))
        x, y = near_copies._parity([a, b])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
