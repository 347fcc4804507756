"""Cheapest repair of conversations to the shape ``(s?(ua)+)?`` of role initials.

A shortest path over four states (nothing yet, system, user, reply) prices every edit of
every turn.  The path is found by a square-root checkpointed program: a conversation of n
turns is cut into blocks of about sqrt(n) turns, a first pass leaves only the backward
vector of state costs at each block's end, and a second pass computes the vectors inside a
block anew while it walks forward and emits, among the edits that keep the least cost, the
first in ASCII order.

Blocks are the unit of distribution too.  Turns are dealt out by ranges of (conversation,
turn), so one conversation may span many partitions; a block's effect is a four by four
matrix of costs, and its walk is done for each of the four states it may start in.  Only
these small results, about sqrt(n) of them, meet per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stage, table

SPACE = "\\x20\\x09-\\x0D"
START, SYSTEM, USER, REPLY = range(4)
#: The state after the role that must come next, written by Rerole or Insert.
NEXT = (USER, USER, REPLY, USER)
ROLE = ("user", "user", "assistant", "user")
#: State after keeping a turn with an initial (s, u, a, other); None where the shape forbids it.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, REPLY, None), (None, USER, None, None))
FINE, DELETED, TRUNCATED = range(3)
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
FAR = 1 << 40
#: Costs and edits of ending a conversation in a state.
CLOSING = (0, 2 * INSERT, INSERT, 0)
#: Position of what follows the last turn.
LAST = (1 << 63) - 1


# --- the program inside a block ---------------------------------------------------------

def choices(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one turn, in ASCII order; Insert is no edit of a turn."""
    fault, initial = divmod(code, 4)
    out = [("D", DELETE, state)]
    if fault != DELETED:
        extra = CUT if fault == TRUNCATED else 0
        if KEPT[state][initial] is not None:
            out.append(("K", extra, KEPT[state][initial]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


CHOICES = [[choices(code, state) for state in range(4)] for code in range(12)]


def before(code: int, after: list[int]) -> list[int]:
    """Costs before a turn, inserts ahead of it included, from the costs after it."""
    v = [min(cost + after[to] for _, cost, to in CHOICES[code][s]) for s in range(4)]
    for _ in range(2):
        v = [min(v[s], INSERT + v[NEXT[s]]) for s in range(4)]
    return v


#: Min-plus matrices of the twelve kinds of turn: row the state before, column the state after.
STEPS = np.array([[before(code, [0 if s == t else FAR for s in range(4)]) for t in range(4)] for code in range(12)], np.int64).transpose(0, 2, 1)


def matrices(blocks: list[np.ndarray]) -> np.ndarray:
    """The blocks' min-plus matrices, all blocks of a batch side by side."""
    longest = max(map(len, blocks), default=0)
    codes = np.full((len(blocks), longest), -1, np.int64)
    for row, block in zip(codes, blocks):
        row[:len(block)] = block
    total = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (len(blocks), 1, 1))
    for at in range(longest):
        here = np.flatnonzero(codes[:, at] >= 0)
        total[here] = np.minimum((total[here][:, :, :, None] + STEPS[codes[here, at]][:, None]).min(axis=2), FAR)
    return total


def walk(codes: list[int], after: list[int]) -> list[tuple[int, str]]:
    """For each start state the state behind the block and the edits: tight ones only, ASCII-least first."""
    costs = [after]
    for code in reversed(codes):
        costs.append(before(code, costs[-1]))
    costs.reverse()
    out = []
    for state in range(4):
        edits = []
        for at, code in enumerate(codes):
            while True:
                rest = costs[at][state]
                found = next(((x, to) for x, cost, to in CHOICES[code][state] if x == "D" and cost + costs[at + 1][to] == rest), None)
                if found is None and INSERT + costs[at][NEXT[state]] == rest:
                    edits.append("I")
                    state = NEXT[state]
                    continue
                letter, state = found or next((x, to) for x, cost, to in CHOICES[code][state] if cost + costs[at + 1][to] == rest)
                edits.append(letter)
                break
        out.append((state, "".join(edits)))
    return out


def illegal_pairs(initials: np.ndarray) -> int:
    """Adjacent initials other than su, ua and au."""
    pair = initials[:-1] * 4 + initials[1:]
    return int(np.count_nonzero(~np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])))


def effects(codes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in codes:
        blocks = [np.asarray(x, np.int64) for x in batch]
        yield pd.DataFrame({"m": list(matrices(blocks).reshape(-1, 16)), "illegal": [illegal_pairs(x % 4) for x in blocks], "head": [x[0] % 4 for x in blocks], "tail": [x[-1] % 4 for x in blocks]})


def checkpoints(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Backward over a conversation's blocks: the cost vector at each block's end, the whole cost, the illegal pairs."""
    for flat, illegal, head, tail in parts:
        rows = []
        for m, i, h, t in zip(flat, illegal, head, tail):
            steps = np.concatenate(list(m)).reshape(-1, 4, 4)
            ends = np.empty((len(steps), 4), np.int64)
            v = np.array(CLOSING, np.int64)
            for k in range(len(steps) - 1, -1, -1):
                ends[k] = v
                v = np.minimum((steps[k] + v).min(axis=1), FAR)
            seams = sum(illegal_pairs(np.array([a, b])) for a, b in zip(t[:-1], h[1:]))
            rows.append((list(ends), int(v[START]), int(np.sum(i)) + seams))
        yield pd.DataFrame(rows, columns=["ends", "cost", "illegal"])


def walks(blocks: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for codes, after in blocks:
        found = [walk(list(map(int, c)), list(map(int, v))) for c, v in zip(codes, after)]
        yield pd.DataFrame({"to": [[s for s, _ in f] for f in found], "edits": [[e for _, e in f] for f in found]})


def starts(ends: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Forward over a conversation's blocks: the state that each block starts in, and the last state."""
    for batch in ends:
        rows = []
        for blocks in batch:
            state, seen = START, []
            for to in blocks:
                seen.append(state)
                state = int(to[state])
            rows.append((seen, state))
        yield pd.DataFrame(rows, columns=["starts", "final"])


def applied(blocks: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Per turn of a block: its position, the initials inserted ahead of it, its letter and a new role."""
    for positions, codes, start, edits in blocks:
        out = []
        for pos, code, state, letters in zip(positions, codes, start, edits):
            rows, ahead, at = [], "", 0
            for x in letters:
                if x == "I":
                    ahead += ROLE[state][0]
                    state = NEXT[state]
                    continue
                rows.append({"pos": int(pos[at]), "ahead": ahead, "edit": x, "new_role": ROLE[state] if x == "R" else None})
                if x != "D":
                    state = NEXT[state] if x == "R" else KEPT[state][int(code[at]) % 4]
                ahead, at = "", at + 1
            out.append(rows)
        yield pd.Series(out)


# --- Spark jobs -------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the planted faults; a null role or text is one space, a null id or turn is one in the key."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = (F.crc32(key) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.where("fault <> 0").withColumn("copies", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")))


def conversation_key(conv_id: Column) -> Column:
    """A string that joins: the null id has one of its own."""
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def in_order(rows: DataFrame) -> DataFrame:
    """Written rows with conv (a key without nulls) and pos, ascending by conversation and turn, nulls first.

    Turns with the same number follow their role, the first 64 characters of their text, then
    a hash of it.  Rows are dealt out by ranges, equal ones by their place in the input, so
    no conversation and no repeated row has to fit one task.
    """
    rows = rows.select(conversation_key(F.col("conv_id")).alias("conv"), "turn", "role", "text", F.monotonically_increasing_id().alias("line"))
    order = ["conv", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), "line"]
    return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("line").withColumn("pos", F.monotonically_increasing_id()))


def turn_faults(rows: DataFrame) -> DataFrame:
    """(conv, pos, turn, code) of written rows in order; code is 4 * fault + initial, blank and duplicate tell the two deleted kinds apart."""
    role = F.substring("role", 1, 1)
    initial = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    marked = rows.select(
        "conv", "pos", "turn", initial.alias("initial"), (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")).alias("cut"),
        F.xxhash64("role", "text").alias("k1"), F.xxhash64("text", "role", F.lit(1)).alias("k2"))
    first = marked.groupBy("conv", "k1", "k2").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = marked.join(first, ["conv", "k1", "k2"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    seen = seen.withColumn("duplicate", duplicate)
    fault = F.when(F.col("blank") | F.col("duplicate"), DELETED).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    return stage(seen.select("conv", "pos", "turn", "blank", "duplicate", (4 * fault + F.col("initial")).cast("int").alias("code")))


def blocks_of(turns: DataFrame) -> DataFrame:
    """(conv, part, block, positions, codes): a conversation's turns in blocks of about the square root of their number."""
    turns = turns.withColumn("part", F.shiftright("pos", 33))
    runs = turns.groupBy("conv", "part").agg(F.min("pos").alias("from"), F.count("*").alias("m"))
    runs = runs.withColumn("width", F.ceil(F.sqrt(F.sum("m").over(Window.partitionBy("conv"))))).drop("m")
    cut = turns.join(runs, ["conv", "part"]).withColumn("block", F.floor((F.col("pos") - F.col("from")) / F.col("width")))
    found = cut.groupBy("conv", "part", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("x"))
    return stage(found.select("conv", "part", "block", F.col("x.pos").alias("positions"), F.col("x.code").alias("codes")))


def gathered(blocks: DataFrame, *columns: str) -> DataFrame:
    """Small results of a conversation's blocks as arrays in their order: places (part, block) and one array per column."""
    rows = blocks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "block", *columns))).alias("x"))
    return rows.select("conv", F.arrays_zip(F.col("x.part").alias("part"), F.col("x.block").alias("block")).alias("places"), *[F.col(f"x.{c}").alias(c) for c in columns])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``turns`` (conv, pos, code): the edits (pos, ahead, edit, new_role, conv) and per conversation (conv, cost, illegal, audit).

    ``ahead`` holds the initials of empty turns inserted before the turn; inserts at the end
    of a conversation stand at position ``LAST``.
    """
    blocks = blocks_of(turns)
    priced = blocks.select("conv", "part", "block", F.pandas_udf(effects, "m array<long>, illegal long, head int, tail int")("codes").alias("e")).select("conv", "part", "block", "e.*")
    whole = gathered(priced, "m", "illegal", "head", "tail")
    whole = whole.select("conv", "places", F.pandas_udf(checkpoints, "ends array<array<long>>, cost long, illegal long")("m", "illegal", "head", "tail").alias("c"))
    whole = stage(whole.select("conv", "places", "c.*"))
    ends = whole.select("conv", F.explode(F.arrays_zip("places", "ends")).alias("x")).select("conv", "x.places.part", "x.places.block", F.col("x.ends").alias("after"))
    on = ["conv", "part", "block"]
    walked = blocks.join(ends, on).withColumn("w", F.pandas_udf(walks, "to array<int>, edits array<string>")("codes", "after"))
    walked = stage(walked.select(*on, "positions", "codes", "w.to", "w.edits"))
    begun = gathered(walked, "to").select("conv", "places", F.pandas_udf(starts, "starts array<int>, final int")("to").alias("s"))
    begun = stage(begun.select("conv", "places", "s.*"))
    start = begun.select("conv", F.explode(F.arrays_zip("places", "starts")).alias("x")).select("conv", "x.places.part", "x.places.block", F.col("x.starts").alias("start"))
    taken = stage(walked.join(start, on).select(*on, "positions", "codes", "start", F.element_at("edits", F.col("start") + 1).alias("edits")))
    inserted = F.element_at(F.array(F.lit(""), F.lit("ua"), F.lit("a"), F.lit("")), F.col("final") + 1)
    audits = taken.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "block", "edits"))).alias("x"))
    audits = audits.join(begun, "conv").select("conv", F.concat(F.array_join("x.edits", ""), F.repeat(F.lit("I"), F.length(inserted))).alias("audit"))
    kind = "array<struct<pos: long, ahead: string, edit: string, new_role: string>>"
    edits = taken.select("conv", F.explode(F.pandas_udf(applied, kind)("positions", "codes", "start", "edits")).alias("x")).select("conv", "x.*")
    closing = begun.where(F.length(inserted) > 0).select("conv", F.lit(LAST).alias("pos"), inserted.alias("ahead"), F.lit(None).cast("string").alias("edit"), F.lit(None).cast("string").alias("new_role"))
    return edits.unionByName(closing), whole.select("conv", "cost", "illegal").join(audits, "conv")


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, pos, k, role, text) of the repaired conversations; ascending pos and k is their order, inserted turns have an empty text."""
    own = rows.select(F.col("pos").alias("p"), "role", "text")
    joined = edits.join(own, F.col("pos") == F.col("p"), "left")
    new = F.transform(F.split("ahead", "(?!$)"), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    new = F.when(F.length("ahead") == 0, F.array().cast("array<struct<role: string, text: string>>")).otherwise(new)
    stays = F.coalesce(F.col("edit") != "D", F.lit(False))
    itself = F.when(stays, F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role: string, text: string>>"))
    return joined.select("conv", "pos", F.posexplode(F.concat(new, itself)).alias("k", "x")).select("conv", "pos", "k", "x.role", "x.text")


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repaired turns: ``role:text`` lines joined by newlines.

    A conversation's lines go through one hash in order, so through one task, which holds a
    batch of them at a time.
    """
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for batch in batches:
            done = []
            for c, role, text in zip(batch["conv"], batch["role"], batch["text"]):
                if c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
        if state is not None:
            yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv", "repaired_sha256"])

    return turns.repartition("conv").sortWithinPartitions("conv", "pos", "k").mapInPandas(hashed, "conv string, repaired_sha256 string")


def op13_checkpointed_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cost, edits and hash of every conversation after damage and repair.

    The null conv_id is a conversation of its own.  Null turns come first and count in no
    gap; turns of one number follow their role, then their text (``in_order``).  Rows that repeat
    are rows of their own, so later ones are duplicates.  A conversation without rows after
    the damage has zeros, an empty audit and the hash of nothing; an empty table gives none.
    """
    source = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = in_order(damaged(source))
    turns = turn_faults(rows)
    edits, whole = repair(turns)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long"))
    gaps = turns.select("conv", "turn").distinct().groupBy("conv").agg(gaps.alias("gaps"))
    counts = turns.groupBy("conv").agg(*[F.count_if(c).alias(n) for n, c in (("blank", F.col("blank")), ("duplicate", F.col("duplicate")), ("truncated", F.floor(F.col("code") / 4) == TRUNCATED))])
    known = source.select("conv_id").distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    out = known
    for part in (gaps, counts, whole, digests(repaired(rows, edits))):
        out = out.join(part, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
