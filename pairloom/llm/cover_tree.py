"""Hard negatives by inner product through cover trees over norm-augmented vectors.

A candidate x gets one more component, sqrt(M^2 - |x|^2), M the largest norm of its shard; all
candidates then lie on a sphere, and for a query q (whose new component is 0) the inner product
with any vector within distance r of a centre c lies in [q.c - |q| r, q.c + |q| r].  The tree is
built from the top: centres are taken farthest first until every vector of the node lies within
half the node's radius of one (or ``FAN`` centres are there), and each centre's vectors form the
next level, with the radius that really covers them; ``LEAF`` vectors are a leaf.  A query goes
down best first, by the upper bound: nodes wholly outside its window of scores, or below the
k-th score found, are skipped, and the vectors of the leaves are compared exactly.

Candidates are dealt by id to shards of about ``SHARD`` rows, which hold one tree for each
label; every query visits every shard (a stated query set against all rows, in blocks), where
a shard's candidates are read first and its queries then stream by.  Of candidates with equal
label and vector only the smallest ids can be among the first, ``k`` and one more of them stay.
Each shard sends on its best k a window, which are then ranked.  Rows that repeat id, label and
vector count once.

Components are whole numbers: floor(256 x), x as a double.  Scores are exact: in doubles below
2**53, beyond that in Python's integers, where they stop at the ends of a long.  Vectors of
different length are compared as if the shorter had zeros.  Rows with a null label, a null
vector or a null or non-finite component (also once scaled) take no part, nor do rows with a
null id.  Rows of one id but other vectors are different candidates; those with an anchor's id
are never its positives, and of anchors that repeat an id the one of the least label and vector
is used.
Ties go to the smaller id, empty tables give no rows, other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import first_of_runs, repeat_ranges
from pairloom.plans import cut_lineage, top_per_group

SHARD, FAN, LEAF, WIDTH = 8192, 64, 32, 64
LONG = 2**63 - 1
FOUND = "id long, window int, other long, score long"


def whole(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v): rows that take part, v the scaled components rounded down, as doubles."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    out = out.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", odd))
    # floor() gives a long; doubles from 2**53 on are whole already
    down = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    return out.withColumn("v", F.transform("v", down))


class Forest:
    """One tree for each label over a shard's vectors."""

    def __init__(self, ids, labels, x):
        order = np.lexsort((ids, labels))
        self.x, labels, ids = x[order], labels[order], ids[order]
        norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.most = float(norm.max(initial=0.0))
        tail = np.sqrt(np.maximum(0.0, self.most**2 - norm**2))
        self.aug = np.hstack([self.x, tail[:, None]])
        self.slack = 1e-6 * (self.most + 1)
        self.centre, self.radius, self.first, self.last, self.leaf, self.roots = [], [], [], [], [], {}
        placed, todo = [], []
        cuts = np.flatnonzero(first_of_runs(labels)) if len(labels) else np.zeros(0, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(labels)]):
            members = np.arange(a, b)
            self.roots[int(labels[a])] = node = self._node(members, int(a))
            todo.append((node, members))
        at = 0
        while todo:
            node, members = todo.pop()
            parts = self._split(members, self.centre[node], self.radius[node] / 2) if len(members) > LEAF else []
            if len(parts) < 2:  # few vectors, or all in one place
                self.leaf[node], self.first[node], self.last[node] = True, at, at + len(members)
                placed.append(members)
                at += len(members)
                continue
            children = [(self._node(own, c), own) for c, own in parts]
            self.first[node], self.last[node] = children[0][0], children[-1][0] + 1
            todo += children
        put = np.concatenate(placed) if placed else np.zeros(0, np.int64)
        self.points, self.ids = self.x[put], ids[put]
        self.centres = self.x[np.array(self.centre, np.int64)]
        self.radius, self.first, self.last, self.leaf = (np.array(a, t) for a, t in ((self.radius, float), (self.first, np.int64), (self.last, np.int64), (self.leaf, bool)))

    def _far(self, members, centre):
        d = self.aug[members] - self.aug[centre]
        with np.errstate(all="ignore"):
            return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _node(self, members, centre):
        self.centre.append(centre)
        self.radius.append(float(self._far(members, centre).max()) + self.slack)
        for a, empty in ((self.first, 0), (self.last, 0), (self.leaf, False)):
            a.append(empty)
        return len(self.centre) - 1

    def _split(self, members, centre, cover):
        """The parent's centre and the farthest vectors after it, each with those nearest to it."""
        centres, far = [centre], self._far(members, centre)
        owner = np.zeros(len(members), np.int64)
        while len(centres) < FAN and far.max() > cover:
            c = int(members[np.argmax(far)])
            d = self._far(members, c)
            near = d < far
            owner[near], far[near] = len(centres), d[near]
            centres.append(c)
        return [(c, members[owner == k]) for k, c in enumerate(centres) if (owner == k).any()]

    def products(self, x, q):
        """Exact inner products as int64."""
        if self.exact:
            return np.rint(x @ q).astype(np.int64)
        whole_q = [int(a) for a in q]
        return np.array([max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(row, whole_q)))) for row in x], np.int64)

    def _inside(self, nodes):
        """What first to last of the nodes holds: children of inner nodes, vectors of leaves."""
        return repeat_ranges(self.first[nodes], self.last[nodes] - self.first[nodes])

    def search(self, q, roots, windows, k, skip):
        """For each window (low, high): (ids, scores) of the k best inside, ties by id.  Bounds and
        scores that a window has needed are kept for the next ones."""
        width = self.points.shape[1]
        q = np.append(q, np.zeros(max(0, width - q.size)))[:width]
        length = float(np.sqrt(q @ q))
        self.exact = length * self.most < 2**52
        scores, seen = np.zeros(len(self.points), np.int64), np.zeros(len(self.leaf), bool)
        top, bottom, bounded = np.zeros(len(self.leaf)), np.zeros(len(self.leaf)), np.zeros(len(self.leaf), bool)

        def bound(nodes):
            """Highest and lowest product of q with a node's vectors."""
            new = nodes[~bounded[nodes]]
            if len(new):
                mid = self.centres[new] @ q
                reach = length * self.radius[new] * (1 + 1e-9) + 1e-9 * length * self.most + 1e-6
                # as the scores do, bounds stop at the ends of a long; no number bounds nothing
                top[new] = np.clip(np.nan_to_num(mid + reach, nan=np.inf), -LONG, LONG)
                bottom[new] = np.clip(np.nan_to_num(mid - reach, nan=-np.inf), -LONG, LONG)
                bounded[new] = True
            return nodes

        for low, high in windows:
            best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            nodes = bound(np.array(roots, np.int64))
            while len(nodes):
                least = max(low, int(best[-1])) if len(best) == k else low
                nodes = nodes[(top[nodes] >= least) & (bottom[nodes] <= high)]
                cut = np.argpartition(-top[nodes], WIDTH) if len(nodes) > WIDTH else np.arange(len(nodes))
                now, nodes = nodes[cut[:WIDTH]], nodes[cut[WIDTH:]]
                leaf = self.leaf[now]
                if not leaf.all():
                    nodes = np.concatenate([nodes, bound(self._inside(now[~leaf]))])
                if leaf.any():
                    now = now[leaf]
                    new = self._inside(now[~seen[now]])
                    if len(new):
                        scores[new] = self.products(self.points[new], q)
                        seen[now] = True
                    at = self._inside(now)
                    fits = (scores[at] >= least) & (scores[at] <= high)
                    if skip is not None:
                        fits &= self.ids[at] != skip
                    at = at[fits]
                    best_id, best = np.append(best_id, self.ids[at]), np.append(best, scores[at])
                    order = np.lexsort((best_id, -best))[:k]
                    best_id, best = best_id[order], best[order]
            yield best_id, best


def _matrix(lists) -> np.ndarray:
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), width))
    for k, v in enumerate(lists):
        out[k, : len(v)] = v
    return out


def _searcher(k: int, same: bool):
    def run(batches):
        shard, held, forest = None, [], None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("shard", "asks", "id", "label", "v", "lows", "highs")]):
                if row[0] != shard:
                    shard, held, forest = row[0], [], None
                if not row[1]:
                    held.append(row[2:5])
                    continue
                if forest is None:
                    forest = Forest(np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), _matrix([h[2] for h in held]))
                    held = []
                _, _, anchor, label, v, lows, highs = row
                roots = [n for of, n in forest.roots.items() if (of == label) == same]
                for w, (ids, scores) in enumerate(forest.search(np.array(v, np.float64), roots, zip(lows, highs), k, anchor if same else None)):
                    out += [(anchor, w, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["id", "window", "other", "score"])

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """candidates (vec_id, label, v); queries (id, label, v, lows, highs): the first k candidates
    of the query's label (``same``, the query's own id left out) or of other labels with
    lows[i] <= score <= highs[i], as (id, window i, other, score, rk)."""
    # equal vectors of one label: the k smallest ids and one more, as the query's own is left out
    first = cut_lineage(top_per_group(candidates.distinct(), ["label", "v"], ["vec_id"], k + 1).drop("rk"))
    shards = max(1, -(-first.count() // SHARD))
    none = F.lit(None).cast("array<long>")
    dealt = first.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "label", "v", none.alias("lows"), none.alias("highs"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "label", "v", "lows", "highs")
    # queries of a shard in blocks, each block with the shard's candidates
    rows = dealt.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "id")
    found = rows.mapInArrow(_searcher(k, same), FOUND)
    return top_per_group(found, ["id", "window"], [F.desc("score"), F.asc("other")], k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """rows, anchors (vec_id, label, v): for each anchor and each of its first ``positives`` rows
    of the same label, the first ``negatives`` rows of other labels whose score is between
    ``low`` and ``high`` per cent of the positive's."""
    one = anchors.groupBy(F.col("vec_id").alias("id")).agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")
    one = cut_lineage(one)
    ends = lambda x: F.array(F.lit(x).cast("long"))
    near = search(rows, one.withColumns({"lows": ends(-LONG), "highs": ends(LONG)}), positives, True)
    near = cut_lineage(near.select("id", F.col("rk").alias("nth"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
    # bounds of whole numbers, in decimals as 95 times a long may not fit; an empty window asks for nothing
    of = lambda c: F.col("positive_score").cast("decimal(20,0)") * F.lit(c)
    lo, hi = F.ceil(of(low) / F.lit(100)).cast("long"), F.floor(of(high) / F.lit(100)).cast("long")
    windows = near.withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    asked = windows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("nth", "lo", "hi"))).alias("w"))
    asked = asked.join(one, "id").select("id", "label", "v", F.col("w.lo").alias("lows"), F.col("w.hi").alias("highs"), F.col("w.nth").alias("nths"))
    far = search(rows, asked.drop("nths"), negatives, False)
    ranks = asked.select("id", F.posexplode("nths").alias("window", "nth"))
    out = far.join(ranks, ["id", "window"]).join(near, ["id", "nth"])
    return out.select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rk").cast("int").alias("rank"), F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
