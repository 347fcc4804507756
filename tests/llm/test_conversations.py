"""Conversation repair against a plain version that tries every audit."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tickloom.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos long, code int, part int, block int"
SHAPE = re.compile("(s?(ua)+)?")
BAD = re.compile("[^\\x20\\x09-\\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def faults(rows):
    """rows: (role, text) in order."""
    seen, out = set(), []
    for row in rows:
        marks = BAD.findall(row[1])
        out.append("blank" if not marks else "duplicate" if row in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add(row)
    return out


def best(rows):
    """(cost, audit, repaired) by a forward search over (turn, state of the shape) that keeps the least (cost, audit)."""
    marks = faults(rows)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    layer = {"": (0, "", ())}

    def put(d, state, x):
        if state not in d or x[:2] < d[state][:2]:
            d[state] = x

    def inserts(d):
        for _ in range(4):
            for state, (cost, audit, out) in list(d.items()):
                for role in ("user", "assistant"):
                    to = after[state].get(role[0])
                    if to:
                        put(d, to, (cost + 5, audit + "I", (*out, f"{role}:")))
        return d

    for (role, text), mark in zip(rows, marks):
        nxt = {}
        for state, (cost, audit, out) in inserts(dict(layer)).items():
            put(nxt, state, (cost + 2, audit + "D", out))
            if mark in ("blank", "duplicate"):
                continue
            extra = 5 if mark else 0
            to = after[state].get(role[:1])
            if to:
                put(nxt, to, (cost + extra, audit + "K", (*out, f"{role}:{text}")))
            for new in ("user", "assistant"):
                to = after[state].get(new[0])
                if to:
                    put(nxt, to, (cost + 1 + extra, audit + "R", (*out, f"{new}:{text}")))
        layer = nxt
    ends = [x for s, x in inserts(layer).items() if s in ("", "a")]
    return min(ends, key=lambda x: x[:2])


def all_audits(rows):
    """(cost, audit) by trying every sequence of edits of a few rows, with up to three inserts at each place."""
    marks, found = faults(rows), []
    own = [["D"] if m in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for m in marks]
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*own):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            shape, audit, cost = "", "", 0
            for gap, e, row, m in zip(ins, (*edits, ""), (*rows, None), (*marks, "")):
                shape, audit, cost = shape + gap, audit + "I" * len(gap), cost + 5 * len(gap)
                if e:
                    shape += row[0][:1] if e == "K" else e[1:]
                    audit += e[0]
                    cost += {"K": 0, "R": 1, "D": 2}[e[0]] + (5 if e != "D" and m == "truncated" else 0)
            if SHAPE.fullmatch(shape):
                found.append((cost, audit))
    return min(found)


def order(row):
    return (row[1] is not None, row[1] or 0, row[2], row[3])


def want(rows):
    out = []
    hurt = damage(rows)
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = sorted((r for r in hurt if r[0] == conv), key=order)
        lines = [r[2:] for r in mine]
        marks, turns = faults(lines), [r[1] for r in mine if r[1] is not None]
        cost, audit, text = best(lines)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", None, "uploader"]
    texts = ["Yes.", "Yes.", "No", "é!\n", " \t", "", None, "What is it?", "…", "A. b"]
    out = []
    for conv in range(n):
        for turn in range(r.choice([1, 2, 3, 5, 9, 14])):
            out.append((conv, None if r.random() < 0.05 else turn + (turn > 3), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"text {conv} {turn}{r.choice(['.', '?', ''])}"))
    return out


def write(spark, folder, rows):
    path = f"{folder}/conversations.parquet"
    spark.createDataFrame([(*x, "x", 1, 1, 1, 1) for x in rows], SCHEMA).write.mode("overwrite").parquet(path)
    return str(folder)


def compare(spark, folder, rows):
    got = C.op13_checkpointed_repair(spark, write(spark, folder, rows)).collect()
    assert sorted(map(tuple, got), key=str) == want(rows)
    return got


def test_plain_version_tries_everything():
    r = random.Random(1)
    for _ in range(60):
        rows = [(r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b.", "c", "", "d!"])) for _ in range(r.randrange(4))]
        assert best(rows)[:2] == all_audits(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, tmp_path, seed):
    got = compare(spark, tmp_path, rows_of(seed, 150))
    assert {x for r in got for x in r.audit} == set("DKR")  # a delete is always cheaper than an insert


def test_awkward_rows(spark, tmp_path):
    long = [(7, i, "user" if i % 2 == 0 else "assistant", f"w{i}" * 3000 + ".") for i in range(300)]
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, None, "user", "b."), (1, 5, "user", None), (2, None, None, "Hi!"), (3, 10**15, "assistant", "a."), (3, -5, "user", "b?")]
    rows += [(4, 0, "user", "same.")] * 5 + [(5, 0, "user", "one."), (5, 0, "assistant", "two.")]
    compare(spark, tmp_path, rows + long)


def test_one_conversation_over_many_partitions(spark, tmp_path):
    r = random.Random(3)
    rows = [(9, t, r.choice(["user", "assistant"]), f"t{r.randrange(400)}{r.choice(['.', ''])}") for t in range(900)] + [(9, 3, "user", "equal.")] * 300 + [(1, 0, "user", "a.")]
    compare(spark, tmp_path, rows)


def test_all_dropped_and_empty(spark, tmp_path):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = compare(spark, tmp_path / "a", [(conv, 0, "user", "a."), (conv + 1, 1, "user", "a.")])
    assert any(r.audit == "" and r.repaired_sha256 == hashlib.sha256().hexdigest() and r.cost == 0 for r in got)
    assert C.op13_checkpointed_repair(spark, write(spark, tmp_path / "b", [])).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5])
def test_blocks_change_nothing(size):
    r = random.Random(size)
    for _ in range(200):
        codes = [r.randrange(12) for _ in range(r.randrange(1, 12))]
        one = C.walk(codes, list(C.CLOSING))[C.START][1]
        blocks = [codes[i:i + size] for i in range(0, len(codes), size)]
        v, ends = list(C.CLOSING), []
        for b in reversed(blocks):
            ends.append(v)
            v = [int(x) for x in (C.matrices([C.np.array(b)])[0] + C.np.array(v)).min(axis=1)]
        state, many = C.START, ""
        for b, end in zip(blocks, reversed(ends)):
            state, edits = C.walk(b, end)[state]
            many += edits
        assert many == one
