"""Small tables with every awkward case, written as the driver's tables are."""

import random

CLASH = ["row", "rid", "size", "shard", "slot", "key", "fp", "root", "kept", "w", "t0", "host", "finish", "score", "vslot", "base_failed", "upto", "id", "src", "placed", "at"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def documents():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, repeated rows, near and exact copies, symbols, other scripts."""
    base = [prose(i, 60) for i in range(12)]
    rows = [(i, t, "en", f"host{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(20, None, "en", "host1", None), (21, "", None, None, 0), (22, " \t\n\r\x0b\x0c ", "en", "host2", 6), (None, base[0], "en", "host0", 1), (None, None, None, None, None)]
    rows += [(30, base[1], "en", "host1", 1), (30, base[1], "en", "host1", 1), (31, base[1] + " extra", "en", "host3", 1), (31, "Other text of the same id " + prose(99, 30), "en", "host3", 1)]
    rows += [(40, prose(7, 30_000, 100_000), "en", "host0", 1), (41, "one", "en", "host2", 1), (42, "ONE", "en", "host2", 1), (43, "two words", "xx", "host2", 1)]
    rows += [(50, "\n".join(["same line here"] * 12 + ["another line"] * 2), "en", "host3", 1), (51, "a|b # c$ %d & <e> *\x00 é İ ß 漢字 🙂 it's 12 ² x y\x85z\x1c<|endoftext|>", "en", "host3", 1)]
    rows += [(60 + i, "bad", "en", "spam", 1) for i in range(30)] + [(95, base[2] + " clean on a bad host", "en", "spam", 1)]
    rows += [(100 + i, base[3] + (" tail" if i % 2 else ""), "en", "host1", 1) for i in range(20)]
    return rows


def write(spark, folder, docs=None, **others):
    """Write documents and others (name=(schema, rows)); gives the folder as a string."""
    docs = documents() if docs is None else docs
    spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in docs], SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    for name, (schema, rows) in others.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def items():
    base = [r[1] for r in documents()[:6]]
    return [(0, " ".join(base[4].split()[5:30])), (10, " ".join(base[5].split()[:10])), (2, "two WORDS"), (3, "one"), (4, None), (5, ""), (None, " ".join(base[4].split()[50:])),
            (10, "nothing that any text holds at all in any of its words"), (7, " ".join(base[4].split()[5:30]))]
