"""Each filtering stage of the pipeline on a table of its own, against brute force."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from pairloom.llm import rank_order
from .test_near_copies import roots, shingles
from .test_operators import gram_counts_of, overlaps_by_brute_force

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string"


def texts():
    rng = np.random.default_rng(21)
    en = ["the", "rain", "in", "plain", "stays", "mainly", "and", "when", "there", "water", "Water", "house", "night", "under"]
    de = ["der", "regen", "und", "über", "straße", "größe", "nicht", "schnell", "Wetter", "durch", "zwischen", "haus"]
    out = []
    for words, lang in ((en, "en"), (de, "de")):
        for _ in range(12):
            base = list(rng.choice(words, int(rng.integers(20, 90))))
            base = [w + str(rng.integers(0, 99)) if rng.random() < 0.5 else w for w in base]
            out.append((" ".join(base), lang))
            copy = list(base)
            copy[int(rng.integers(len(copy)))] = "changed"
            out.append((" ".join(copy), lang if rng.random() < 0.7 else None))
    passage = "a passage of well over one hundred bytes that several documents of this small table repeat, word by word, for the test"
    out += [(passage, "en"), ("before it " + passage, "en"), (passage + " after it", None), (passage, "en"), ("x " + passage[:99], "en"), (passage[5:110] + "y", None)]
    return out + [("42 17 99", "en"), (None, "en"), ("", None), ("漢字かな 漢字", None), ("ЖЖЖ ффф", None), ("one", None), ("one", None)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(10 * k, t, lang, "s", len(t or ""), "r", "k") for k, (t, lang) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), {r[0]: (r[1], r[2]) for r in rows}


def kept(spark, table, name, folder="."):
    out = dict(corpus_pipeline.STAGES)[name](spark, table[0], str(folder))
    assert out.columns == table[0].columns
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def test_language_stage(spark, table):
    size = rank_order.PROFILE
    rank = lambda c: {g: p for p, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])}
    sums = collections.defaultdict(collections.Counter)
    for text, lang in table[1].values():
        if lang:
            sums[lang].update(gram_counts_of(text))
    profiles = {lang: rank(c) for lang, c in sums.items()}
    want = set()
    for i, (text, _) in table[1].items():
        own = rank(gram_counts_of(text))
        if own:
            cost = min(sum(abs(p[g] - k) if g in p else size for g, k in own.items()) / (len(own) * size) for p in profiles.values())
            if 1 - cost >= corpus_pipeline.LEAST_SCORE:
                want.add(i)
    assert set(kept(spark, table, "language_id")) == want and 20 < len(want) < len(table[1])


def test_near_copies_stage(spark, table):
    found = roots({i: shingles(t) for i, (t, _) in table[1].items()})
    assert set(kept(spark, table, "near_dedup")) == {i for i, r in found.items() if i == r}
    assert len(set(found.values())) < len(found) - 10


def test_passage_stage(spark, table):
    first, want, n = {}, {}, corpus_pipeline.PASSAGE
    for i, (text, _) in sorted(table[1].items()):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            if first.setdefault(raw[p : p + n], i) < i:
                gone[p : p + n] = b"\1" * n
        left = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        if left or not any(gone):
            want[i] = left
    got = kept(spark, table, "passage_dedup")
    assert {i: r.text or "" for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text or "") for r in got.values()) and len(want) < len(table[1])


def test_decontamination_stage(spark, table, tmp_path):
    some = [t for t, _ in table[1].values() if t and len(t.split()) > 20]
    items = [" ".join(some[0].split()[3:20]), " ".join(some[6].split()[:15] + ["other"]), "one", None, "nowhere in this table at all"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {i for i, (t, _) in table[1].items() if not any(overlaps_by_brute_force(t, x) for x in items)}
    assert set(kept(spark, table, "decontaminate", tmp_path)) == want and 10 < len(want) < len(table[1]) - 3
