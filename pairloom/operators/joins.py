"""Joins: leakage, rosters, neighbours, similarity, constructs.

No broadcast is forced: adaptive execution broadcasts a side only after it has
measured it.  Looked-up sides are reduced to unique keys first, so a hot key on
the row side can be split by the skew-join rule.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pairloom.functions import names as nm, parsing as ps
from pairloom.functions.sequence import kmer_cores, kmers, normalize_rna, sanitize_protein
from pairloom.plans import cut_lineage, hash_rank, top_per_group

# fixed values: transcript type order
GENE_TYPES = ["protein_coding", "mRNA", "lncRNA", "transcribed_pseudogene", "ncRNA", "miRNA", "snRNA", "snoRNA"]


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def flag_in(df: DataFrame, keys: DataFrame, on, name: str) -> DataFrame:
    """int flag: does the key occur in ``keys``?"""
    on = _list(on)
    k = keys.select(*on).distinct().withColumn(name, F.lit(1))
    return df.join(k, on, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def _digest(c):
    """128-bit digest: long sequences meet by digest, so joins move 16 bytes instead of the text."""
    return F.unhex(F.md5(c))


def _canonical(df: DataFrame) -> DataFrame:
    """Add _p, _r and _g: the digest of the protein, taken from ``protein_key`` (md5 of the text in
    upper case) where rows carry it instead of the text, the RNA and the gene key."""
    p = F.unhex("protein_key") if "protein_key" in df.columns else _digest(F.upper("protein_sequence"))
    return df.withColumns({"_p": p, "_r": normalize_rna("rna_sequence"), "_g": nm.gene_key("protein_name")})


def annotate_leakage(ev: DataFrame, train: DataFrame) -> DataFrame:
    """Five train-leakage flags per eval row."""
    e, t = _canonical(ev), _canonical(train)
    out = flag_in(e, t, "protein_name", "protein_name_in_train")
    out = flag_in(out, t, "_p", "protein_sequence_in_train")
    out = flag_in(out, t.where(F.col("binding_label") == 1), "_r", "rna_in_train_positives")
    out = flag_in(out, t, ["_p", "_r"], "exact_pair_in_train")
    out = flag_in(out, t, "_g", "gene_key_in_train")
    return out.drop("_p", "_r", "_g")


LEAKAGE_FLAGS = [
    "protein_name_in_train", "protein_sequence_in_train", "rna_in_train_positives", "exact_pair_in_train", "gene_key_in_train",
]


def leakage_counts(annotated: DataFrame) -> DataFrame:
    return annotated.agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in LEAKAGE_FLAGS])


def restrict_roster(df: DataFrame, roster: DataFrame, protocol: str, name="protein_name") -> DataFrame:
    """Rows of a protocol's representative names, with the roster key attached."""
    reps = roster.where((F.col("protocol") == protocol) & (F.col("is_representative") == 1)).select(
        "protein_key", F.col("native_name").alias(name)
    )
    return df.join(reps, name)


def attach_scores(df: DataFrame, scores: DataFrame, keys, score="score") -> DataFrame:
    """Left m:1 join; duplicate keys on the score side raise."""
    keys = _list(keys)
    dup = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).limit(1)
    if dup.count():
        raise ValueError("score table has duplicate keys")
    out = df.join(scores.select(*keys, score), keys, "left")
    return out.withColumn("missing_score", F.col(score).isNull().cast("int"))


def best_hit(queries: DataFrame, hits: DataFrame, min_cov=0.5) -> DataFrame:
    """Best target per query by identity then bits (then name); 0 and '' without a hit."""
    order = F.struct(-F.col("fident"), -F.col("bits"), F.col("target"))
    best = (
        hits.where(F.col("qcov") >= min_cov)
        .groupBy("query")
        .agg(F.min_by(F.struct("target", "fident", "bits", "qcov"), order).alias("h"))
    )
    return queries.join(best, "query", "left").select(
        "query",
        F.coalesce("h.target", F.lit("")).alias("best_target"),
        F.coalesce("h.fident", F.lit(0.0)).alias("best_identity"),
        F.coalesce("h.bits", F.lit(0.0)).alias("bits"),
    )


def top_neighbours(queries: DataFrame, hits: DataFrame, n=1, clusters: DataFrame | None = None) -> DataFrame:
    """Top n targets by bits; with clusters, never the query itself or its own cluster."""
    h = hits.groupBy("query", "target").agg(F.max(F.struct("bits", "fident", "qcov")).alias("h"))
    if clusters is not None:
        cq = clusters.select(F.col("node").alias("query"), F.col("cluster").alias("_cq"))
        ct = clusters.select(F.col("node").alias("target"), F.col("cluster").alias("_ct"))
        h = h.join(cq, "query", "left").join(ct, "target", "left")
        same = F.coalesce(F.col("_cq") == F.col("_ct"), F.lit(False))
        h = h.where((F.col("query") != F.col("target")) & ~same)
    top = top_per_group(h, "query", [F.desc("h.bits"), "target"], n)
    return queries.join(top, "query", "left").select(
        "query",
        F.coalesce("target", F.lit("")).alias("target"),
        F.coalesce("h.fident", F.lit(0.0)).alias("fident"),
        F.coalesce("h.qcov", F.lit(0.0)).alias("qcov"),
        F.coalesce("rk", F.lit(1)).alias("rk"),
    )


POSTING = 2000  # members of one k-mer handled by one task slice
TEXT_CELLS = 1 << 21  # words of a block of texts, as a matrix
BUCKET = 5_000_000  # postings met in one task
LONG = 64  # a quarter of the words of a text that counts as long
PASS = 50_000_000  # postings written at once; four passes at most
WORD_MIX = np.random.default_rng(20).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _text_blocks(texts, k: int):
    """(first, last) of blocks of texts whose words fit ``TEXT_CELLS`` as a matrix."""
    lo, width = 0, 0
    for i, t in enumerate(texts):
        wide = max(width, len(t) - k + 1)
        if i > lo and ((i - lo + 1) * wide > TEXT_CELLS or i - lo == 1 << 15):
            yield lo, i
            lo, wide = i, len(t) - k + 1
        width = wide
    if lo < len(texts):
        yield lo, len(texts)


def _word_rows(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of k letters, a row a text, and how many words each has; the rest is filled up."""
    size = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.maximum(size - k + 1, 0)
    h = np.zeros(max(len(code) - k + 1, 0), np.uint64)
    for j in range(k):
        h += (code[j : j + len(h)] + np.uint64(1)) * WORD_MIX[j % len(WORD_MIX)] + np.uint64(j // len(WORD_MIX))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    out = np.full((len(texts), max(1, int(n.max(initial=1)))), np.iinfo(np.uint64).max)
    at = np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out[np.arange(out.shape[1]) < n[:, None]] = h[at]
    return out, n


def _word_sets(texts, k: int, order=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, a row a text, which of them are there for the first time, and the size of the set.

    ``order`` are new places for the first 16 bits: hashes are renamed so that their order is the order of words."""
    h, n = _word_rows(texts, k)
    if order is not None:
        h = (order[(h >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (h & np.uint64((1 << 48) - 1))
        h[np.arange(h.shape[1]) >= n[:, None]] = np.iinfo(np.uint64).max
    h.sort(axis=1)
    new = np.arange(h.shape[1]) < n[:, None]
    new[:, 1:] &= h[:, 1:] != h[:, :-1]
    return h, new, new.sum(1)


def _shares(n, groups: int):
    """How many words of their prefixes similar sets must share, of n words the smaller: a quarter, if that is more than the
    groups that words are dealt to, so that two are in one group; else one."""
    return np.where(n // 4 > groups, n // 4, 1)


def _prefix(n, min_sim: float, groups: int):
    """How many first words, in any one order, of a set of n words have ``_shares`` in common with a similar set's."""
    return (n - np.ceil(n * min_sim - 1e-9)).astype(np.int64) + _shares(n, groups)


def _word_order(seqs: DataFrame, k: int, min_sim: float) -> tuple[np.ndarray, int]:
    """Places of the first 16 bits of words by their number in all sequences, common ones last, and the number of postings."""

    def count(batches):
        total, posts = np.zeros(1 << 16, np.int64), 0
        for pdf in batches:
            texts = pdf["seq"].tolist()
            for lo, hi in _text_blocks(texts, k):
                h, new, n = _word_sets(texts[lo:hi], k)
                total += np.bincount((h[new] >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
                posts += int(_prefix(n, min_sim, LONG).sum())
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": np.append(at, -1), "c": np.append(total[at], posts)})

    got = seqs.select("seq").mapInPandas(count, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).toPandas()  # 65,537 rows at most
    counts, posts = np.zeros(1 << 16, np.int64), 0
    if len(got):
        counts[got["i"][got["i"] >= 0]] = got["c"][got["i"] >= 0]
        posts = int(got["c"][got["i"] < 0].sum())
    order = np.empty(1 << 16, np.uint64)
    order[np.argsort(counts, kind="stable")] = np.arange(1 << 16, dtype=np.uint64)
    return order, posts


def _parity(h, new) -> np.ndarray:
    """Two words of parity bits a set: each word flips one, so that sets differ in at least as many words as bits."""
    row, _ = np.nonzero(new)
    bit = (h[new] & np.uint64(127)).astype(np.int64)
    odd = (np.bincount(row * 128 + bit, minlength=len(h) * 128) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, 128), axis=1, bitorder="little").view(np.uint64)


POSTS = "bucket int, w binary, at binary, of binary, sid binary, n binary, bits binary"


def _posts(k: int, min_sim: float, order, buckets: int, passes: int, this: int):
    """The postings of prefix words, packed by bucket: a row a block of texts and bucket."""

    def run(batches):
        for pdf in batches:
            texts, sid = pdf["seq"].tolist(), pdf["sid"].to_numpy(np.int64)
            for lo, hi in _text_blocks(texts, k):
                h, new, n = _word_sets(texts[lo:hi], k, order)
                at = np.cumsum(new, axis=1)
                keep = new & (at <= _prefix(n, min_sim, buckets * passes)[:, None])
                if passes > 1:
                    keep &= (h >> np.uint64(24) & np.uint64(0xFFFFFF)) % np.uint64(passes) == this
                row, _ = np.nonzero(keep)
                w, at, bits = h[keep], at[keep], _parity(h, new)
                to = (w & np.uint64(0xFFFFFF)) % np.uint64(buckets)
                by = np.argsort(to, kind="stable")
                row, w, at, to = row[by], w[by], at[by], to[by]
                out = []
                start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else []
                for i, j in zip(start, [*start[1:], len(to)]):
                    # the sets of the bucket once, their words by place among them
                    sets, of = np.unique(row[i:j], return_inverse=True)
                    cells = (w[i:j], at[i:j].astype(np.uint32), of.astype(np.uint16), sid[lo + sets], n[sets].astype(np.int64), bits[sets])
                    out.append((int(to[i]), *[np.ascontiguousarray(c).tobytes() for c in cells]))
                yield pd.DataFrame(out, columns=["bucket", "w", "at", "of", "sid", "n", "bits"])

    return run


MET = "a long, b long, at long, w long, n long, s0 long, s1 long"


def _counted(parts) -> list:
    """[(a, b, the first one's position, how many words)], each pair once."""
    a, b, at, c = np.concatenate(parts, 1)
    by = np.lexsort((at, b, a))
    a, b, at, c = a[by], b[by], at[by], c[by]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, int)
    return [np.stack([a[start], b[start], at[start], np.add.reduceat(c, start) if len(a) else c])]


WAITING = 4_000_000  # words of pairs that a bucket holds before it counts them


def _meet(min_sim: float, groups: int):
    """Pairs of a bucket that may be similar: (a, b, at the first one's position).  Similar sets share ``_shares`` words of
    their prefixes, so in one of the buckets at least that number over all ``groups``.  Words of more than ``POSTING``
    sequences are passed on as postings, b null."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, t: [np.frombuffer(x, t) for x in pdf[c]]
        sid, n, bits = (np.concatenate(read(c, t)) for c, t in (("sid", np.int64), ("n", np.int64), ("bits", np.uint64)))
        bits = bits.reshape(-1, 2)
        first = np.cumsum([0, *[len(x) for x in read("sid", np.int64)][:-1]])
        of = np.concatenate([o.astype(np.int64) + f for o, f in zip(read("of", np.uint16), first)])
        w, at = np.concatenate(read("w", np.uint64)), np.concatenate(read("at", np.uint32)).astype(np.int64)
        by = np.argsort(w, kind="stable")
        w, at, of = w[by], at[by], of[by]
        start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        size = np.diff(np.r_[start, len(w)])
        left = np.repeat(size - 1, size) - (np.arange(len(w)) - np.repeat(start, size))  # members of the word after this one
        hot = np.repeat(size > POSTING, size)
        cells = lambda i, b: {"a": sid[of[i]], "b": b, "at": at[i], "w": w[i].view(np.int64), "n": n[of[i]], "s0": bits[of[i], 0].view(np.int64), "s1": bits[of[i], 1].view(np.int64)}
        posts = pd.DataFrame(cells(hot, None)).astype({"b": "Int64"})
        left[hot] = 0
        # a partner step by step: those with a d-th member after them
        least = -(-_shares(n, groups) // groups)
        pairs, held, i, d = [], 0, np.flatnonzero(left), 1
        while len(i):
            a, b = of[i], of[i + d]
            need = np.ceil((n[a] + n[b]) * (min_sim / (1.0 + min_sim)) - 1e-9)
            ok = np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * min_sim - 1e-9
            # what is left must reach the overlap at the first common word; where words are counted, others count too
            ok &= (np.minimum(n[a] - at[i], n[b] - at[i + d]) + 1 >= need) | (np.minimum(least[a], least[b]) > 1)
            a, b, need, here = a[ok], b[ok], need[ok], at[i[ok]]
            ok = np.bitwise_count(bits[a] ^ bits[b]).sum(1) <= n[a] + n[b] - 2 * need
            a, b, here = a[ok], b[ok], here[ok]
            # a set has a place for each block of texts and is in one block
            pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b), here, np.ones(len(a), np.int64)]))
            held += len(a)
            if held > WAITING:
                pairs = _counted(pairs)
                held = len(pairs[0][0]) // 2
            d += 1
            i = i[left[i] >= d]
        a, b, here, c = _counted(pairs)[0] if pairs else np.zeros((4, 0), np.int64)
        ok = c >= np.minimum(least[a], least[b])
        a, b, here = a[ok], b[ok], here[ok]
        a, b = np.minimum(sid[a], sid[b]), np.maximum(sid[a], sid[b])
        met = pd.DataFrame({"a": a, "b": b, "at": here, "w": 0, "n": 0, "s0": 0, "s1": 0}).astype({"b": "Int64"})
        return pd.concat([met, posts]) if len(posts) else met

    return run


def _hot_pairs(posts: DataFrame, min_sim: float) -> DataFrame:
    """Pairs of postings (w, a, n, at, s0, s1) of words of many sequences, in slices of ``POSTING`` members."""
    many = posts.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / POSTING).cast("int").alias("slices"))
    rows = posts.select("a", "n", "at", "w", "s0", "s1").join(many, "w")
    side = lambda o: [F.col(c).alias(f"{c}_{o}") for c in ("n", "at", "s0", "s1")]
    left = rows.select("a", *side("a"), "w", F.pmod(F.xxhash64("a"), F.col("slices").cast("long")).cast("int").alias("part"))
    right = rows.select(F.col("a").alias("b"), *side("b"), "w", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * F.lit(min_sim / (1.0 + min_sim)) - 1e-9)
    may = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    apart = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")))
    fits = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * min_sim - 1e-9) & (may >= need) & (apart <= F.col("n_a") + F.col("n_b") - 2 * need)
    return left.join(right, ["w", "part"]).where((F.col("a") < F.col("b")) & fits).select("a", "b")


def pair_similarity(df: DataFrame, seq: str, k=3, min_sim=0.5, texts=True) -> DataFrame:
    """All pairs of distinct sequences with k-mer Jaccard >= min_sim, exactly but for a clash of
    64-bit word hashes: a, b (sha-256 of the sequences, a < b), jaccard, containment and, with
    ``texts``, seq_a and seq_b.

    Copies are collapsed first.  Prefix filtering: two sets this similar share one of the
    |x| - ceil(t|x|) + 1 first words of each in any one order, so only those are indexed, with their position;
    the order has common words last, by the counts of the words' first 16 bits.  What
    can still be common from the two positions on must reach the overlap that the similarity needs,
    as it does at a pair's first common word, and parity bits must not differ in more words than it leaves.
    Of long texts more words are indexed, and similar ones share several of one bucket.
    Postings move packed by bucket, in up to four passes; only pairs that pass are written.
    Words of many sequences meet in slices.  Nothing is capped.
    """
    seqs = df.select(F.col(seq).alias("seq")).distinct().where(F.length("seq") >= k)
    seqs = cut_lineage(seqs.select(F.monotonically_increasing_id().alias("sid"), F.unhex(F.sha2("seq", 256)).alias("sha"), "seq"))
    order, posts = _word_order(seqs, k, min_sim)
    passes = min(4, max(1, -(-posts // PASS)))
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-posts // passes // BUCKET))
    found = []
    for this in range(passes):
        packed = seqs.select("sid", "seq").mapInPandas(_posts(k, min_sim, order, buckets, passes, this), POSTS)
        found.append(cut_lineage(packed.groupBy("bucket").applyInPandas(_meet(min_sim, buckets * passes), MET)))
    met = reduce(DataFrame.unionByName, found)
    cand = met.where("b IS NOT NULL").select("a", "b")
    hot = met.where("b IS NULL")
    if not hot.isEmpty():
        cand = cand.unionByName(_hot_pairs(hot, min_sim))
    # few bytes but much work per row
    cand = cand.repartition(check_width(met), "a").distinct()
    of = lambda c: seqs.select(F.col("sid").alias(c), F.col("sha").alias(f"sha_{c}"), F.col("seq").alias(f"seq_{c}"))
    j = cand.join(of("a"), "a").join(of("b"), "b").select("sha_a", "sha_b", "seq_a", "seq_b")
    out = {"a": F.lower(F.hex("sha_a")), "b": F.lower(F.hex("sha_b"))} | ({"seq_a": F.col("seq_a"), "seq_b": F.col("seq_b")} if texts else {})
    return j.mapInPandas(_verified(k, min_sim, texts), VERIFIED).select(*[c.alias(n) for n, c in out.items()], "jaccard", "containment")


VERIFIED = "sha_a binary, sha_b binary, seq_a string, seq_b string, jaccard double, containment double"


def _common(a, b, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sizes of two texts' sets of words and of their intersection, row by row."""
    none = np.iinfo(np.uint64).max
    sets, sizes = [], []
    for texts in (a, b):
        h, new, n = _word_sets(texts, k)
        h[~new] = none
        sets.append(h)
        sizes.append(n)
    z = np.sort(np.hstack(sets), axis=1)
    return *sizes, ((z[:, 1:] == z[:, :-1]) & (z[:, 1:] != none)).sum(1)


def _verified(k: int, min_sim: float, texts: bool):
    """Pairs whose sets are similar, in the order of their digests."""

    def run(batches):
        for pdf in batches:
            a, b = pdf["seq_a"].tolist(), pdf["seq_b"].tolist()
            both = [x if len(x) > len(y) else y for x, y in zip(a, b)]
            for lo, hi in _text_blocks(both, k):
                n_a, n_b, inter = _common(a[lo:hi], b[lo:hi], k)
                jaccard = inter / (n_a + n_b - inter)
                ok = np.flatnonzero(jaccard >= min_sim)
                part = pdf.iloc[lo + ok].assign(jaccard=jaccard[ok], containment=(inter / np.minimum(n_a, n_b))[ok])
                turned = [bytes(x) > bytes(y) for x, y in zip(part["sha_a"], part["sha_b"])]
                swap = part.rename(columns={"sha_a": "sha_b", "sha_b": "sha_a", "seq_a": "seq_b", "seq_b": "seq_a"})
                part = pd.concat([part[~np.array(turned, bool)], swap[np.array(turned, bool)]])
                yield part if texts else part.assign(seq_a=None, seq_b=None)

    return run


CHECKED = 200_000  # rows of pairs met whose texts one task checks


def check_width(met: DataFrame) -> int:
    """Tasks for the check of candidates: by the pairs met, at least the session's number."""
    width = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(width, -(-met.count() // CHECKED))


BLOCK = 2048


def _blocks(df: DataFrame, key: str, n: int):
    return df.withColumn("_blk", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def vector_products(q: DataFrame, t: DataFrame, key: str, vec: str, reduce_block, schema: str, sizes=None) -> DataFrame:
    """Blocked matrix products: each task multiplies one block of q by one of t.

    ``reduce_block(q_ids, Q, t_ids, T)`` sees unit-length rows and returns what is
    kept, so all pairs exist only as one block product inside a task.
    """
    nq, nt = sizes or (q.count(), t.count())
    bq, bt = max(1, -(-nq // BLOCK)), max(1, -(-nt // BLOCK))
    left = _blocks(q.select(key, vec), key, bq).withColumn("_tb", F.explode(F.sequence(F.lit(0), F.lit(bt - 1))))
    t = t.select(F.col(key).alias("_tk"), F.col(vec).alias("_tv"))
    right = _blocks(t, "_tk", bt).withColumnRenamed("_blk", "_tb").withColumn(
        "_blk", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)))
    )

    def unit(m):
        m = np.vstack(m).astype(float)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1.0, n)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return reduce_block(a[key].to_numpy(), unit(a[vec].to_list()), b["_tk"].to_numpy(), unit(b["_tv"].to_list()))

    return left.groupBy("_blk", "_tb").cogroup(right.groupBy("_blk", "_tb")).applyInPandas(run, schema)


def standardise(df: DataFrame, ref: DataFrame, key: str, vec: str, scale=False) -> DataFrame:
    """Centre (and z-score) vectors by the reference set's column statistics."""
    stats = (
        ref.select(F.posexplode(vec).alias("i", "x"))
        .groupBy("i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_samp(F.col("x").cast("double")).alias("s"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("st"))
    )
    st = stats.scalar()
    out = F.zip_with(
        vec, "_st", lambda x, s: (x.cast("double") - s["m"]) / (F.when(s["s"] > 0, s["s"]).otherwise(1.0) if scale else F.lit(1.0))
    )
    return df.withColumn("_st", st).withColumn(vec, out).drop("_st")


PIVOTS, SAMPLE = 512, 8192


def _unit(rows) -> np.ndarray:
    m = np.vstack(rows).astype(float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def pivots(t: DataFrame, key: str, vec: str, n: int) -> np.ndarray:
    """n unit vectors of a bounded sample, each the farthest from those before it."""
    drawn = _unit(t.select(vec).orderBy(F.xxhash64(key), key).limit(min(SAMPLE, 16 * n)).toPandas()[vec].to_list())
    out, far = [0], _angles(drawn, drawn[:1])[:, 0]
    while len(out) < min(n, len(drawn)) and far.max() > 0:
        out.append(int(far.argmax()))
        far = np.minimum(far, _angles(drawn, drawn[out[-1:]])[:, 0])
    return drawn[out]


TARGETS = 1 << 17  # targets that a task holds
SLICE = 1024  # vectors held against all pivots at once


def slices(batches, size: int = SLICE):
    """A batch's rows, a few at a time."""
    for pdf in batches:
        for lo in range(0, len(pdf), size):
            yield pdf.iloc[lo : lo + size]


def _nearest(k: int, exclude_self: bool):
    """The k nearest targets of a block of queries in all blocks of targets that follow each other with it; ties go to the smaller name."""

    def emit(names, sim, found):
        row, col = np.nonzero(np.isfinite(sim))
        return pd.DataFrame({"query": names[row], "target": found[row, col], "sim": sim[row, col]})

    def run(batches):
        at, names = None, None
        for pdf in batches:
            for q_names, q, t_names, t in zip(pdf["q_names"], pdf["q"], pdf["t_names"], pdf["t"]):
                if at is None or at != (q_names[0], len(q_names), q):
                    if at is not None:
                        yield emit(names, best, found)
                    at, names = (q_names[0], len(q_names), q), np.array(list(q_names), object)
                    m = np.frombuffer(q, float).reshape(len(names), -1)
                    best, found = np.full((len(names), k), -np.inf), np.full((len(names), k), "", object)
                t_names = np.array(list(t_names), object)
                tm = np.frombuffer(t, float).reshape(len(t_names), -1)
                place = {}
                if exclude_self:
                    for j, x in enumerate(t_names):
                        place.setdefault(x, []).append(j)
                for lo in range(0, len(names), 512):
                    hi = min(len(names), lo + 512)
                    sim = m[lo:hi] @ tm.T
                    for i in range(lo, hi) if exclude_self else ():
                        if names[i] in place:
                            sim[i - lo, place[names[i]]] = -np.inf
                    least = best[lo:hi, -1]
                    if sim.shape[1] > k:
                        least = np.maximum(least, np.partition(sim, sim.shape[1] - k, axis=1)[:, -k])
                    # names are in order inside a block, so the first ones of a tie are kept
                    for i in np.flatnonzero((sim >= np.maximum(least, -3.0)[:, None]).any(1)):
                        hit = np.flatnonzero(sim[i] >= max(least[i], -3.0))
                        hit = hit[np.argsort(-sim[i, hit], kind="stable")[:k]]
                        new, who = np.append(best[lo + i], sim[i, hit]), np.append(found[lo + i], t_names[hit])
                        order = sorted(range(len(new)), key=lambda j: (-new[j], who[j]))[:k]
                        best[lo + i], found[lo + i] = new[order], who[order]
        if at is not None:
            yield emit(names, best, found)

    return run


class _Clusters:
    """Targets dealt to the pivot at the smallest angle; a cluster's radius is its largest angle."""

    def __init__(self, t: DataFrame, key: str, vec: str):
        self.key, self.vec, self.size = key, vec, BLOCK
        n = t.count()
        self.pivots = pivots(t, key, vec, max(1, min(PIVOTS, -(-n // BLOCK)))) if n else np.zeros((1, 1))
        self.rows = cut_lineage(self.deal(t))
        # at most PIVOTS rows
        seen = self.rows.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.max("_a").alias("r")).collect()
        self.n, self.radius = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots))
        for r in seen:
            self.n[r["_c"]], self.radius[r["_c"]] = r["n"], r["r"]

    def deal(self, df: DataFrame) -> DataFrame:
        centre, key, vec = self.pivots, self.key, self.vec

        def run(batches):
            for pdf in slices(batches):
                a = _angles(_unit(pdf[vec].to_list()), centre)
                yield pdf.assign(_c=a.argmin(1).astype("int32"), _a=a.min(1))

        return df.select(F.col(key).cast("string").alias(key), F.col(vec).cast("array<double>").alias(vec)).mapInPandas(run, f"{key} string, {vec} array<double>, _c int, _a double")

    def needs(self, q: DataFrame) -> DataFrame:
        """q (key, vec, _c, _b) with _need, the further clusters that may hold a target of similarity _b or more."""
        centre, radius, filled, key, vec = self.pivots, self.radius, self.n > 0, self.key, self.vec

        def run(batches):
            for pdf in slices(batches):
                least = np.maximum(0.0, _angles(_unit(pdf[vec].to_list()), centre) - radius - 1e-7)
                need = (np.cos(least) >= pdf["_b"].to_numpy()[:, None]) & filled
                need[np.arange(len(pdf)), pdf["_c"]] = False
                yield pd.DataFrame({key: pdf[key], vec: pdf[vec], "_home": pdf["_c"], "_need": [np.flatnonzero(x).astype("int32") for x in need]})

        return q.select(key, vec, "_c", "_b").mapInPandas(run, f"{key} string, {vec} array<double>, _home int, _need array<int>")

    def others(self, q: DataFrame) -> DataFrame:
        """``needs`` as visits, one row a query and cluster."""
        return self.needs(q).select(self.key, self.vec, F.explode("_need").alias("_c"))

    def further(self, q: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """The k nearest of each query in the clusters of its ``needs``, for each two parts of queries and targets.

        Queries and targets are packed once in blocks of unit vectors.  A task reads the blocks of one part of each; no
        vector is copied for a visit.
        """
        # queries of a block have one home cluster, which none of them needs
        queries = cut_lineage(self._packed(self.needs(q), "_home", "_need").repartition(q.sparkSession.sparkContext.defaultParallelism * 4))
        targets = cut_lineage(self._packed(self.rows, "_c", None).repartition(max(1, -(-int(self.n.sum()) // TARGETS))))
        both = queries.toDF("q_part", "q_names", "q", "need").crossJoin(targets.drop("need").toDF("c", "t_names", "t"))
        met = both.where(F.array_contains("need", F.col("c"))).mapInPandas(_nearest(k, exclude_self), "query string, target string, sim double")
        return cut_lineage(met)

    def _packed(self, rows: DataFrame, part: str, need) -> DataFrame:
        """Blocks of at most ``BLOCK`` rows of a part: (part, names, unit vectors, need), need the clusters that any row needs."""
        key, vec, size = self.key, self.vec, self.size

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            pdf = pdf.sort_values(key, kind="stable")
            for lo in range(0, len(pdf), size):
                own = pdf.iloc[lo : lo + size]
                need_ = np.unique(np.concatenate(own[need].to_list())) if need else []
                out.append((int(own[part].iloc[0]), own[key].tolist(), _unit(own[vec].to_list()).tobytes(), need_))
            return pd.DataFrame(out, columns=["part", "names", "m", "need"])

        # a part of a cluster is bounded: a cluster of identical vectors lies in many
        deal = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(max(1, -(-int(self.n.max(initial=1)) // (8 * size))))).cast("int")
        return rows.withColumn("_deal", deal).groupBy(part, "_deal").applyInPandas(run, "part int, names array<string>, m binary, need array<int>")

    def best(self, visits: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """visits (key, vec, _c): the k nearest of each query in each block of the cluster."""
        key, vec = self.key, self.vec
        visits = cut_lineage(visits.select(key, vec, "_c"))
        asked = np.zeros(len(self.n), np.int64)
        for r in visits.groupBy("_c").count().collect():
            asked[r["_c"]] = r["count"]
        of = lambda counts: F.element_at(F.array(*[F.lit(int(max(1, -(-x // self.size)))) for x in counts]), F.col("_c") + 1)
        # cluster c meets its queries in blocks of both
        own, other = (lambda n: F.pmod(F.xxhash64(key), of(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), of(n).cast("int") - 1)))
        left = visits.withColumn("_qb", own(asked)).withColumn("_tb", other(self.n))
        right = self.rows.select(F.col(key), F.col(vec).alias("_tv"), "_c").withColumn("_tb", own(self.n)).withColumn("_qb", other(asked)).withColumnRenamed(key, "_tk")

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame(columns=["query", "target", "sim"])
            sim = _unit(a[vec].to_list()) @ _unit(b["_tv"].to_list()).T
            qi, ti = a[key].to_numpy(), b["_tk"].to_numpy()
            if exclude_self:
                sim[qi[:, None] == ti[None, :]] = -np.inf
            # ties go to the smaller name, as in the final ranking
            by_name = np.argsort(ti, kind="stable")
            sim, ti = sim[:, by_name], ti[by_name]
            order = np.argsort(-sim, axis=1, kind="stable")[:, : min(k, sim.shape[1])]
            rows = np.repeat(np.arange(len(qi)), order.shape[1])
            out = pd.DataFrame({"query": qi[rows], "target": ti[order.ravel()], "sim": sim[rows, order.ravel()]})
            return out[np.isfinite(out["sim"])]

        at = ["_c", "_tb", "_qb"]
        return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(run, "query string, target string, sim double")


def cosine_knn(q: DataFrame, t: DataFrame, key: str, vec: str, k: int, center=False, scale=False, exclude_self=True) -> DataFrame:
    """Top-k cosine neighbours, exact.

    Targets lie in clusters about pivots.  A query is held against its own cluster first; a further
    cluster is visited only if the angle to its pivot less its radius allows the k-th similarity
    found.  A cluster meets its queries in blocks, each of which keeps k a query.
    """
    if center or scale:
        ref = t
        q, t = standardise(q, ref, key, vec, scale), standardise(t, ref, key, vec, scale)
    clusters = _Clusters(t, key, vec)
    if not clusters.n.sum():
        return q.select(F.col(key).cast("string").alias("query"), F.lit("").alias("target"), F.lit(0.0).alias("sim"), F.lit(1).alias("rk")).limit(0)
    asked = cut_lineage(clusters.deal(q))
    near = cut_lineage(top_per_group(clusters.best(asked, k, exclude_self), "query", [F.desc("sim"), "target"], k).drop("rk"))
    if len(clusters.pivots) == 1:
        return top_per_group(near, "query", [F.desc("sim"), "target"], k)
    bound = near.groupBy(F.col("query").alias(key)).agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("_b"))
    open_ = asked.join(bound, key, "left").withColumn("_b", F.coalesce("_b", F.lit(-2.0)))
    both = near.unionByName(clusters.further(open_, k, exclude_self))
    return top_per_group(both, "query", [F.desc("sim"), "target"], k)


def cosine_pairs(df: DataFrame, key: str, vec: str, center=False, min_sim=None) -> DataFrame:
    """Similarity matrix as a < b rows (optionally above a threshold)."""
    if center:
        df = standardise(df, df, key, vec)

    def keep(qi, Q, ti, T):
        sim = Q @ T.T
        ok = qi[:, None].astype(str) < ti[None, :].astype(str)
        if min_sim is not None:
            ok &= sim >= min_sim
        r, c = np.nonzero(ok)
        return pd.DataFrame({"a": qi[r], "b": ti[c], "sim": sim[r, c]})

    n = df.count()
    return vector_products(df, df, key, vec, keep, "a string, b string, sim double", (n, n))


RELATION = {"exact": 0, "construct_in_train": 1, "train_in_construct": 2, "disjoint": 3}


def prepare_constructs(df: DataFrame) -> DataFrame:
    """Raw construct rows to key, clean sequence, intervals and family."""
    return df.select(
        nm.gene_key("native").alias("construct_key"),
        "native",
        "species",
        F.col("architecture"),
        nm.domain_class("architecture").alias("domain_class"),
        sanitize_protein("construct_seq")["seq"].alias("construct_seq"),
        ps.parse_intervals("boundaries").alias("intervals"),
        F.col("z").cast("double").alias("z"),
    ).where(F.col("construct_seq") != "")


def align_constructs(variants: DataFrame, constructs: DataFrame) -> DataFrame:
    """Best construct per (name, sequence) variant, with relation, offset and notes.

    Candidates meet by key and alias; the pick is a min_by over (relation, human,
    intervals fit, z), combined before the shuffle.
    """
    v = variants.select("protein_name", "protein_sequence").distinct().select(
        "protein_name", sanitize_protein("protein_sequence")["seq"].alias("train_seq")
    )
    v = v.distinct().withColumn("variant_id", F.concat_ws("||", "protein_name", "train_seq"))
    v = v.withColumn("protein_key", nm.gene_key("protein_name"))
    j = v.select("*", F.explode(nm.lookup_keys("protein_key")).alias("construct_key")).join(constructs, "construct_key")
    at = F.instr(F.col("train_seq"), F.col("construct_seq"))
    rel = (
        F.when(F.col("train_seq") == F.col("construct_seq"), "exact")
        .when((F.col("train_seq") != "") & (at > 0), "construct_in_train")
        .when((F.col("train_seq") != "") & (F.instr(F.col("construct_seq"), F.col("train_seq")) > 0), "train_in_construct")
        .otherwise("disjoint")
    )
    j = j.withColumn("relation", rel).withColumns(
        {
            "offset": F.when(F.col("relation").isin("exact", "construct_in_train"), at - 1).otherwise(-1),
            "fit": ps.intervals_fit("intervals", F.length("construct_seq")),
            "tier": F.element_at(F.create_map(*[F.lit(x) for kv in RELATION.items() for x in kv]), F.col("relation")),
        }
    )
    order = F.struct(
        F.col("tier"),
        -(F.lower("species") == "homo sapiens").cast("int"),
        -F.col("fit").cast("int"),
        -F.coalesce("z", F.lit(float("-inf"))),
        F.col("native"),
        F.col("construct_seq"),
    )
    pick = F.struct("relation", "offset", "fit", "native", "species", "architecture", "domain_class", "construct_seq", "intervals", "z")
    per_rel = j.groupBy("variant_id", "tier").agg(
        F.min_by(pick, order).alias("c"),
        F.count_distinct("architecture").alias("n_arch"),
        F.count_distinct("native").alias("n_native"),
        F.count(F.lit(1)).alias("n"),
    )
    best = per_rel.groupBy("variant_id").agg(
        F.min_by(F.struct("c", "n_arch", "n_native"), "tier").alias("b"), F.sum("n").alias("n_candidates")
    )
    out = v.join(best, "variant_id", "left").select("variant_id", "protein_name", "protein_key", "train_seq", "b.c.*", "b.n_arch", "b.n_native", "n_candidates")
    unique = F.instr(F.substr("train_seq", F.col("offset") + 2), F.col("construct_seq")) == 0
    in_train = F.col("relation") == "construct_in_train"
    out = out.withColumn("unique_site", F.when(in_train, unique).otherwise(F.lit(True)))
    notes = F.array_compact(
        F.array(
            F.when(F.col("relation").isNull(), "no_construct_match"),
            F.when(F.col("n_arch") > 1, F.concat(F.lit("ambiguous_architectures_in_relation:"), F.col("relation"))),
            F.when(F.col("n_native") > 1, F.concat(F.lit("n_natives_same_relation="), F.col("n_native").cast("string"))),
            F.when(~F.col("fit"), "intervals_do_not_fit_construct"),
            F.when(in_train & ~F.col("unique_site"), "construct_substring_not_unique"),
        )
    )
    safe = F.col("relation").isin("exact", "construct_in_train") & F.col("fit") & F.col("unique_site")
    return out.withColumns(
        {
            "notes": F.array_join(notes, ";"),
            "safe_train_mask": F.coalesce(safe, F.lit(False)),
            "relation": F.coalesce("relation", F.lit("no_s1")),
            "domain_class": F.coalesce("domain_class", F.lit("unknown")),
            "construct_seq": F.coalesce("construct_seq", F.lit("")),
            "offset": F.coalesce("offset", F.lit(-1)),
            "n_candidates": F.coalesce("n_candidates", F.lit(0)),
            "fit": F.coalesce("fit", F.lit(False)),
        }
    )


def apply_construct(aligned: DataFrame, mode: str, policy="length_reducing_substring") -> DataFrame:
    """Model input sequence and status for one mode."""
    train, cons, rel = F.col("train_seq"), F.col("construct_seq"), F.col("relation")
    same = F.lit(None).cast("string")
    if mode == "full_length":
        return aligned.withColumns({"model_seq": train, "status": F.lit("full_length")})
    none = F.size("intervals") <= 0
    if mode == "train_domain_mask":
        moved = F.when(rel == "construct_in_train", ps.shift_intervals("intervals", F.col("offset"))).otherwise(F.col("intervals"))
        a = aligned.withColumn("_iv", moved)
        status = (
            F.when(rel == "no_s1", "fallback_no_s1")
            .when(~F.col("safe_train_mask") | none, "fallback_unsafe_train_mask")
            .when(~ps.intervals_fit("_iv", F.length(train)), "fallback_intervals_out_of_range")
            .otherwise(F.concat(F.lit("train_domain_mask:"), rel))
        )
        a = a.withColumn("status", status)
        masked = F.when(F.col("status").startswith("train_domain_mask"), ps.mask_outside("train_seq", "_iv")).otherwise(train)
        return a.withColumn("model_seq", masked).drop("_iv")
    shorter = (rel == "construct_in_train") & F.col("unique_site") & (F.length(train) > F.length(cons))
    if policy == "length_reducing_substring":
        use, tag = shorter, F.lit(policy)
        refuse = (
            F.when(rel == "exact", "noop_exact_already_construct")
            .when(rel == "train_in_construct", "noop_would_lengthen")
            .when(rel == "construct_in_train", "noop_substring_not_unique_or_not_shorter")
            .otherwise("noop_disjoint")
        )
    else:
        use, tag = rel.isin("exact", "construct_in_train", "train_in_construct"), rel
        refuse = F.lit("fallback_unaligned")
    head = F.lit("construct_replace:" if mode == "construct_replace" else "construct_domain_mask:")
    unmasked = F.lit(mode == "construct_domain_mask") & (none | ~F.col("fit"))
    status = (
        F.when((rel == "no_s1") | (cons == ""), "noop_no_s1")
        .when(~use, refuse)
        .when(unmasked, "construct_replace_no_intervals")
        .otherwise(F.concat(head, tag))
    )
    a = aligned.withColumn("status", F.coalesce(status, same))
    seq = F.when(F.col("status").startswith("construct_domain_mask"), ps.mask_outside("construct_seq", "intervals")).when(
        F.col("status").startswith("construct_replace"), cons
    ).otherwise(train)
    return a.withColumn("model_seq", seq)


def domain_labels(aligned: DataFrame, domains: DataFrame) -> DataFrame:
    """Class per variant: alignment, then table by key, then alias, else unknown."""
    known = domains.where(F.coalesce(F.col("domain_class"), F.lit("unknown")) != "unknown").groupBy("protein_key").agg(
        F.min("domain_class").alias("_k")
    )
    v = aligned.select("variant_id", "protein_key", F.col("domain_class").alias("_a"))
    direct = v.join(known, "protein_key", "left")
    alias = (
        v.select("variant_id", "protein_key", F.posexplode(nm.lookup_keys("protein_key")).alias("i", "_l"))
        .where(F.col("i") > 0)
        .join(known.withColumnsRenamed({"protein_key": "_l", "_k": "_x"}), "_l")
        .groupBy("variant_id")
        .agg(F.min_by("_x", "i").alias("_al"))
    )
    j = direct.join(alias, "variant_id", "left")
    own = F.when(F.col("_a") != "unknown", F.col("_a"))
    return j.select(
        "variant_id",
        F.coalesce(own, "_k", "_al", F.lit("unknown")).alias("domain_class"),
        F.when(own.isNotNull(), "alignment_qc").when(F.col("_k").isNotNull(), "domains_table").when(
            F.col("_al").isNotNull(), "domains_table_alias").otherwise("unknown").alias("label_source"),
    )


def permuted_labels(labels: DataFrame, key="variant_id", label="domain_class", seed=42) -> DataFrame:
    """Control: labels dealt out again by a seeded permutation."""
    a = hash_rank(labels.select(key), [], key, f"{seed}|to", rank="_rk")
    b = hash_rank(labels.select(key, label), [], key, seed, rank="_rk").drop(key)
    return a.join(b, "_rk").select(key, label)


def roster_members(names: DataFrame, synonyms: dict | None = None, protocol="protocol", native="native_name") -> DataFrame:
    """(protocol, native_name, protein_key, rule): synonyms only where the target is free."""
    syn = nm.SYNONYMS if synonyms is None else synonyms
    base = names.select(protocol, F.trim(native).alias("native_name")).distinct().withColumn("base", nm.gene_key("native_name"))
    base = base.where(F.col("base") != "")
    target = F.lit(None).cast("string")
    for a, b in syn.items():
        target = F.when(F.col("base") == a, F.lit(b)).otherwise(target)
    taken = base.select(protocol, F.col("base").alias("target")).distinct().withColumn("_taken", F.lit(1))
    j = base.withColumn("target", target).join(taken, [protocol, "target"], "left")
    rule = (
        F.when(F.col("target").isNull(), "exact_base").when(F.col("_taken") == 1, "synonym_blocked_collision").otherwise("synonym")
    )
    return j.select(
        F.col(protocol).alias("protocol"), "native_name",
        F.when(rule == "synonym", F.col("target")).otherwise(F.col("base")).alias("protein_key"), rule.alias("rule"),
    )


def build_roster(names: DataFrame, min_protocols=2, synonyms=None):
    """(roster, long list, ambiguity table)."""
    m = roster_members(names, synonyms)
    plain = F.when(nm.strip_construct("native_name") == F.col("native_name"), 0).otherwise(1)
    order = F.struct(plain, F.length("native_name"), F.upper("native_name"), F.col("native_name"))
    rep = m.groupBy("protein_key", "protocol").agg(
        F.min_by("native_name", order).alias("representative"),
        F.count(F.lit(1)).alias("n_natives"),
        F.sum(1 - plain).alias("n_plain"),
    )
    rep = rep.withColumn(
        "rep_rule",
        F.when(F.col("n_natives") == 1, "unique").when(F.col("n_plain") == 1, "prefer_no_construct_suffix")
        .when(F.col("n_plain") > 1, "prefer_plain_shortest_stable").otherwise("prefer_construct_shortest_stable"),
    )
    roster = (
        rep.groupBy("protein_key")
        .agg(
            F.count(F.lit(1)).alias("n_protocols"),
            F.array_join(F.array_sort(F.collect_set("protocol")), ";").alias("protocols"),
            F.min_by("representative", "protocol").alias("protein_name"),
        )
        .where(F.col("n_protocols") >= min_protocols)
    )
    kept = m.join(roster.select("protein_key"), "protein_key", "left_semi")
    long = kept.join(rep, ["protein_key", "protocol"]).select(
        "protein_key", "protocol", "native_name", (F.col("native_name") == F.col("representative")).cast("int").alias("is_representative"), "rule",
    )
    blocked = m.where(F.col("rule") == "synonym_blocked_collision").select(
        "protein_key", "protocol", "native_name", F.col("rule").alias("issue"), F.lit("kept base key").alias("detail")
    )
    several = rep.where(F.col("n_natives") > 1).select(
        "protein_key", "protocol", F.col("representative").alias("native_name"), F.lit("multiple_natives_same_key").alias("issue"),
        F.col("rep_rule").alias("detail"),
    )
    return roster, long, blocked.unionByName(several)


def roster_wide(long: DataFrame, protocols) -> DataFrame:
    return long.where(F.col("is_representative") == 1).groupBy("protein_key").pivot("protocol", list(protocols)).agg(F.first("native_name"))


def pick_domain(domains: DataFrame) -> DataFrame:
    """One row per key: human first, then highest z; status and all architectures."""
    human = (F.lower("species") == "homo sapiens").cast("int")
    order = F.struct(-human, -F.coalesce("z", F.lit(float("-inf"))), F.col("native"), F.col("architecture"))
    g = domains.groupBy("protein_key").agg(
        F.min_by(F.struct("architecture", "domain_class", "species", "native"), order).alias("b"),
        F.count(F.lit(1)).alias("n_constructs"),
        F.array_sort(F.collect_set(F.when(F.col("architecture") != "", F.col("architecture")))).alias("archs"),
    )
    status = (
        F.when(F.size("archs") > 1, "ambiguous_architectures")
        .when(F.col("n_constructs") > 1, "multiple_constructs_same_architecture")
        .otherwise("unique")
    )
    return g.select("protein_key", "b.*", "n_constructs", status.alias("status"), F.array_join("archs", "|").alias("architectures"))


def motif_concordance(top: DataFrame, key="protein_key", protocol="protocol", word="kmer", score="score") -> DataFrame:
    """Per key, protocol pairs a<b: Jaccard of words and of 5-letter cores, Spearman of shared words.

    Lists hold at most the top-k words, and a key has one list per protocol.
    """
    lists = top.groupBy(key, protocol).agg(
        F.array_sort(F.collect_list(F.struct(F.col(word).alias("w"), F.col(score).cast("double").alias("s")))).alias("l")
    )
    lists = lists.withColumn("words", F.transform("l", lambda x: x["w"])).withColumn("cores", kmer_cores(F.col("words"), 5))
    side = lambda p: lists.select(key, *[F.col(c).alias(f"{c}_{p}") for c in (protocol, "l", "words", "cores")])
    j = side("a").join(side("b"), key).where(F.col(f"{protocol}_a") < F.col(f"{protocol}_b"))
    jac = lambda x, y: F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))
    shared = F.array_intersect("words_a", "words_b")
    take = lambda col: F.transform(F.filter(col, lambda x: F.array_contains(F.col("shared"), x["w"])), lambda x: x["s"])

    def ranks(v):
        return F.transform(
            v, lambda x: F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / 2.0
        )

    j = j.withColumn("shared", shared).withColumns({"xa": ranks(take("l_a")), "xb": ranks(take("l_b"))})
    n = F.size("shared")
    mean = (n + 1) / 2.0
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda acc, v: acc + v)
    rho = F.when(n >= 3, F.try_divide(dot("xa", "xb"), F.sqrt(dot("xa", "xa") * dot("xb", "xb"))))
    return j.select(
        key, F.col(f"{protocol}_a").alias("protocol_a"), F.col(f"{protocol}_b").alias("protocol_b"),
        jac("words_a", "words_b").alias("jaccard"), jac("cores_a", "cores_b").alias("jaccard_core5"),
        rho.alias("spearman"), n.alias("n_shared"), F.size("words_a").alias("n_a"), F.size("words_b").alias("n_b"),
    )


def motif_vs_transfer(conc: DataFrame, transfer: DataFrame, key="protein_key") -> DataFrame:
    t = transfer.groupBy(
        key, F.least("train_protocol", "test_protocol").alias("protocol_a"), F.greatest("train_protocol", "test_protocol").alias("protocol_b")
    ).agg(F.avg("auroc").alias("mean_transfer_auroc"), F.count(F.lit(1)).alias("n_transfer_dirs"))
    return conc.join(t, [key, "protocol_a", "protocol_b"], "left").withColumn("n_transfer_dirs", F.coalesce("n_transfer_dirs", F.lit(0)))


def assay_overlap(df: DataFrame, literature: DataFrame, train: DataFrame) -> DataFrame:
    """One row: names, rows with both sequences, literature pairs and train leakage."""
    lit = _canonical(literature)
    long = F.col("protein_length") if "protein_length" in df.columns else F.length("protein_sequence")
    flagged = flag_in(_canonical(annotate_leakage(df, train)), lit, ["_p", "_r"], "pair_in_literature")
    has = (long > 0) & (F.length("_r") > 0)
    flagged = flag_in(flagged, lit, "_g", "name_in_literature")
    both = F.coalesce(has, F.lit(False)).cast("int")
    n = F.sum(both)
    return flagged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("_g").alias("n_names"),
        F.count_distinct(F.when(F.col("gene_key_in_train") == 1, F.col("_g"))).alias("n_names_in_train"),
        F.count_distinct(F.when(F.col("name_in_literature") == 1, F.col("_g"))).alias("n_names_in_literature"),
        n.alias("n_with_sequences"),
        F.sum(F.col("pair_in_literature") * both).alias("pairs_in_literature"),
        F.sum(F.col("exact_pair_in_train") * both).alias("exact_pair_in_train"),
        F.sum(F.col("rna_in_train_positives") * both).alias("rna_in_train_positives"),
        F.try_divide(F.sum(F.col("exact_pair_in_train") * both), n).alias("fraction_exact_pair_in_train"),
    )


def pick_transcripts(genes: DataFrame) -> DataFrame:
    """Best transcript per gene by type priority, then id."""
    prio = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(g) for g in GENE_TYPES]), F.col("gene_type")), F.lit(0)), F.lit(99))
    return genes.groupBy("gene").agg(F.min_by(F.struct("transcript_id", "gene_type"), F.struct(prio, F.col("transcript_id"))).alias("b")).select("gene", "b.*")


def attach_transcripts(pairs: DataFrame, transcripts: DataFrame, rna_seqs: DataFrame, prot_seqs: DataFrame) -> DataFrame:
    """Sequences of both partners of gene pairs."""
    t = transcripts.join(rna_seqs, "transcript_id", "left").select(F.col("gene").alias("rna_gene"), "transcript_id", "rna_sequence")
    return pairs.join(t, "rna_gene", "left").join(prot_seqs, "protein_name", "left")


def annotate_experiments(df: DataFrame, maps: dict) -> DataFrame:
    """Fill empty experiment ids; each protocol's map has its own key columns."""
    out = df.withColumn("experiment_id", F.nullif(F.trim("experiment_id"), F.lit("")))
    for protocol, (table, keys) in maps.items():
        m = table.select(*keys, F.col("experiment_id").alias("_new")).withColumn("protocol", F.lit(protocol))
        out = out.join(m, ["protocol", *keys], "left").withColumn("experiment_id", F.coalesce("experiment_id", "_new")).drop("_new")
    return out


def model_matrix(metrics: DataFrame, models, group="protein_name", value="auroc") -> DataFrame:
    """Groups x models, complete rows only, with the mean over models."""
    wide = metrics.groupBy(group).pivot("model", list(models)).agg(F.first(value)).dropna()
    return wide.withColumn("mean", sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models))
