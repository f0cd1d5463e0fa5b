"""Structure repair of conversations by streaming dynamic programming.

A conversation should read ``(s?(ua)+)?`` by the first letters of its roles: perhaps a system
turn, then user and assistant in turn, or nothing.  A turn is faulty if it is blank (no other
character than 20, 09-0D), a duplicate (its role and text stand earlier in the conversation) or
truncated (its last such character is none of ``.!?``); the first fault in this order counts.
Edits and costs: keep 0, rerole to user or assistant 1, delete 2 (the only way for blank and
duplicate turns), insert an empty user or assistant turn 5; a truncated turn that stays costs 5
more.  The cheapest edits are found; of equally cheap ones those whose initials (D, I, K, R)
read least.

Two sorted streams, each with one shuffle by conversation, do the work:

1.  ``plan``: the turns without their texts, last turn first.  The state is the cost to go from
    each of the four places of the pattern; it moves from Arrow batch to Arrow batch.  What each
    place would do with the turn is one byte, the backpointer.  After ``CHUNK`` turns the bytes
    are spilled: sent out as a row whose key is that of its first turn, so that a conversation
    of any length needs the memory of one chunk.  The rows are checkpointed.
2.  ``_follow``: the turns with their texts, first turn first, each chunk of backpointers in
    front of its turns.  The edits are read off and the repaired turns sent on one by one.

Arrow batches are used instead of pandas ones, in which a null turns an id into a float.  A
conversation is read by one task, but never held: rows are sorted by Spark, which spills.

Turns are in the order of ``turn`` (null first), then of the digest of role and text; equal
rows are adjacent and all but the first are duplicates.  Null roles and texts count as one
space, a null conversation as one of its own.  An empty table gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.plans import cut_lineage

CHUNK = 1 << 16
BATCH = 4096
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: places: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn
NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ADDED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: cost to go after the last turn, and what is then inserted
END, TAIL = (0, 2 * INSERT, INSERT, 0), (0, 2, 1, 0)
OPS = "DIKR"
SOUND, TRUNCATED, DUPLICATE, BLANK, GONE = range(5)
_SPACE = r"\x20\x09-\x0D"
PLAN = "conv_id long, part int, turn long, digest binary, ord long, ops binary, counts array<long>"
EDITS = "conv_id long, place long, op string, role string, text string"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@functools.lru_cache(maxsize=1 << 14)
def step(costs: tuple, initial: str, fault: int):
    """One turn backwards: (cost to go before it, its least value taken off, the byte of edits)."""
    more = CUT if fault == TRUNCATED else 0
    offers = []
    for s in range(4):
        ways = {"D": DELETE + costs[s]}
        if fault <= TRUNCATED:
            ways["R"] = REROLE + more + costs[ADDED[s]]
            if (initial, s) in NEXT:
                ways["K"] = KEEP + more + costs[NEXT[initial, s]]
        offers.append(ways)
    best = [min(w.values()) for w in offers]
    # places 2 and 3 may reach each other by an insertion, 0 and 1 reach place 2
    best[2], best[3] = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
    best[0], best[1] = min(best[0], INSERT + best[2]), min(best[1], INSERT + best[2])
    byte = 0
    for s in range(4):
        ways = offers[s] | {"I": INSERT + best[ADDED[s]]}
        byte |= next(k for k, op in enumerate(OPS) if ways.get(op) == best[s]) << 2 * s
    low = min(best)
    return tuple(b - low for b in best), low, byte


class _Backward:
    """The state of one conversation, fed from its last turn to its first."""

    def __init__(self, conv, chunk):
        self.conv, self.size, self.costs, self.spent, self.ops, self.chunks = conv, chunk, END, 0, bytearray(), 0
        self.faults, self.illegal, self.after = [0] * 5, 0, None
        self.high = self.low = self.seen = None
        self.turns = 0

    def feed(self, turn, digest, initial, fault):
        """The row of a chunk if it is full."""
        if fault == GONE:
            return None
        if turn is not None and turn != self.seen:
            self.high = turn if self.high is None else self.high
            self.low = self.seen = turn
            self.turns += 1
        self.faults[fault] += 1
        if self.after is not None and initial + self.after not in ("su", "ua", "au"):
            self.illegal += 1
        self.after = initial
        self.costs, low, byte = step(self.costs, initial, fault)
        self.spent += low
        self.ops.append(byte)
        self.first = (turn, digest)
        return self.chunk() if len(self.ops) >= self.size else None

    def chunk(self):
        self.chunks += 1
        ops, self.ops = bytes(reversed(self.ops)), bytearray()
        return self.conv, 1, *self.first, -self.chunks, ops, None

    def finish(self):
        if self.ops:
            yield self.chunk()
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        counts = [gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.spent + self.costs[0]]
        yield self.conv, 0, None, None, 0, None, [min(c, 2**63 - 1) for c in counts]


class _Out:
    """Rows collected into Arrow batches."""

    def __init__(self, schema: str):
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        fields = [c.split(" ") for c in schema.split(", ")]
        self.schema = pa.schema([(n, kinds[k]) for n, k in fields])
        self.rows, self.size = [], 0

    def add(self, row, size=0):
        self.rows.append(row)
        self.size += size

    def full(self):
        return len(self.rows) >= BATCH or self.size >= 1 << 23

    def send(self):
        cols = list(zip(*self.rows)) if self.rows else [[]] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, self.schema.types)], schema=self.schema)


def _backward(chunk: int):
    def run(batches):
        out, state, last = _Out(PLAN), None, None

        def take(row, twin):
            # of equal rows side by side the first stays, which is the last one read
            conv, turn, digest, initial, fault, later = row
            if fault in (SOUND, TRUNCATED) and (later or twin):
                fault = DUPLICATE
            full = state.feed(turn, digest, initial, fault)
            if full:
                out.add(full, len(full[5]))

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "digest", "initial", "fault", "later")]):
                if last is not None:
                    take(last, row[:3] == last[:3])
                    if row[0] != last[0]:
                        for x in state.finish():
                            out.add(x)
                        state = None
                if state is None:
                    state = _Backward(row[0], chunk)
                last = row
                if out.full():
                    yield out.send()
        if last is not None:
            take(last, False)
            for x in state.finish():
                out.add(x)
        yield out.send()

    return run


class _Edits:
    """Every edit as a row; the place counts the rows of the edited list, deleted turns included."""

    schema = EDITS

    def __init__(self, conv, counts):
        self.conv, self.place = conv, -1

    def edit(self, op, role, text):
        self.place += 1
        return self.conv, self.place, op, role, text

    def finish(self):
        return None


class _Digest:
    schema = REPORT

    def __init__(self, conv, counts):
        self.conv, self.counts, self.audit, self.sha, self.any = conv, counts, bytearray(), hashlib.sha256(), False

    def edit(self, op, role, text):
        self.audit += op.encode()
        if op != "D":
            self.sha.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode())
            self.any = True

    def finish(self):
        return self.conv, *self.counts, self.audit.decode(), self.sha.hexdigest()


def _forward(kind):
    def run(batches):
        out = _Out(kind.schema)
        sink, place, chunks, at = None, 0, [], 0

        def put(row):
            if row is not None:
                out.add(row, sum(len(x) for x in row if isinstance(x, str)))

        def insert():
            nonlocal place
            place = ADDED[place]
            put(sink.edit("I", ROLE[place], ""))

        def end():
            if sink is not None:
                for _ in range(TAIL[place]):
                    insert()
                put(sink.finish())

        for batch in batches:
            for conv, part, ops, counts, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "ops", "counts", "role", "text")]):
                if part == 0:  # the first row of every conversation
                    end()
                    sink, place, chunks, at = kind(conv, counts), 0, [], 0
                    continue
                if ops is not None:
                    chunks.append(ops)
                    continue
                if at == len(chunks[0]):
                    chunks.pop(0)
                    at = 0
                byte, at = chunks[0][at], at + 1
                while (op := OPS[byte >> 2 * place & 3]) == "I":
                    insert()
                if op == "R":
                    place = ADDED[place]
                    put(sink.edit(op, ROLE[place], text))
                else:
                    place = place if op == "D" else NEXT[role[:1], place]
                    put(sink.edit(op, role, text))
                if out.full():
                    yield out.send()
        end()
        yield out.send()

    return run


def _turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone, digest); ``gone`` marks a turn that is no longer there."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), gone.alias("gone"),
    )
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(whole, 256)))


def plan(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``_turns``: one row of counts (part 0) for each conversation, and the chunks of its backpointers."""
    fault = F.when(F.col("gone"), GONE).when(~F.col("text").rlike(f"[^{_SPACE}]"), BLANK).when(F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), SOUND).otherwise(TRUNCATED)
    slim = rows.select("conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    key = F.struct("conv_id", "digest")
    # turns of equal role and text are compared by their digests; only those found at two places are joined back
    again = slim.where(~F.col("fault").isin(GONE, BLANK)).groupBy(key.alias("key"))
    again = again.agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.max(F.col("turn").isNull()).alias("open")).where("low < high OR (open AND low IS NOT NULL)")
    later = F.when(F.col("open"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("low"))
    marked = slim.withColumn("key", key).join(again, "key", "left").withColumn("later", F.coalesce(later, F.lit(False)))
    stream = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("digest"))
    stream = stream.select("conv_id", "turn", "digest", "initial", "fault", "later")
    return cut_lineage(stream.mapInArrow(_backward(chunk), PLAN))


def _follow(turns: DataFrame, kind, chunk: int) -> DataFrame:
    rows = _turns(turns)
    found = plan(rows, chunk).withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    there = rows.where("NOT gone").select(
        "conv_id", F.lit(1).alias("part"), "turn", "digest", F.lit(0).cast("long").alias("ord"),
        F.lit(None).cast("binary").alias("ops"), F.lit(None).cast("array<long>").alias("counts"), "role", "text",
    )
    both = found.unionByName(there).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "digest", "ord")
    return both.select("conv_id", "part", "ops", "counts", "role", "text").mapInArrow(_forward(kind), kind.schema)


def edits(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """turns (conv_id, turn, role, text): (conv_id, place, op, role, text), the edits in order."""
    return _follow(turns, _Edits, chunk)


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations."""
    return edits(turns).where("op <> 'D'").drop("op")


def report(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a conversation: its gaps, faults, cost, edits and the digest of the repaired turns."""
    return _follow(turns, _Digest, chunk)


def damaged(turns: DataFrame) -> DataFrame:
    """Faults put in by crc32 of ``conv_id:turn`` modulo 20: 0 marks the turn as gone, 1 empties
    its text, 2 takes its ``.!?`` out, 3 repeats it, 4 sets its role to user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    part = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20))
    text = F.when(part.isin(0, 1), "").when(part == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    copies = F.when(part == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(part == 4, "user").otherwise(name("role"))
    out = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (part == 0).alias("gone"), F.explode(copies).alias("copy"))
    return out.drop("copy")
