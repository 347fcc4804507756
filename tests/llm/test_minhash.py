"""Tensored MinHash against all pairs."""

import random

import numpy as np
import plain
import pytest
import tables
from test_set_dedup import edited

from tickloom.llm import minhash_dedup as M


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = plain.words(lower)
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def want(docs):
    sets = [shingles(d[1]) for d in docs]
    roots = plain.groups(sets, lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b))
    least = {}
    for d, r, s in zip(docs, roots, sets):
        if s:
            least[r] = min((x for x in (least.get(r), d[0]) if x is not None), default=None)
    return [(d[0], len(s), least[r] if s else d[0], d[0] == (least[r] if s else d[0])) for d, r, s in zip(docs, roots, sets)]


def compare(spark, folder, docs):
    got = M.op12_tensored_minhash(spark, tables.write(spark, folder, docs)).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want(docs)))
    return got


def row(i, text):
    return i, text, "en", "host", 1


def test_awkward_rows(spark, tmp_path):
    got = compare(spark, tmp_path, tables.documents())
    assert any(not r.kept for r in got)


def test_empty(spark, tmp_path):
    assert M.op12_tensored_minhash(spark, tables.write(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("rounds", [1, 3])
def test_crowds(spark, tmp_path, monkeypatch, rounds):
    """Edited copies of one text, at and about the threshold, copies of copies, and texts that share a long passage."""
    monkeypatch.setattr(M, "ROUNDS", rounds)
    r, texts = random.Random(rounds), []
    for g in range(4):
        base = tables.prose(50 + g, 90 + 10 * g, 5000)
        texts += [base] + [edited(base, 1000 * g + k, r.randrange(1, 12)) for k in range(60)]
        for k in range(8):
            texts.append(edited(texts[-1], 777 * g + k, 4))
    passage = tables.prose(5, 60, 5000)
    texts += [f"{passage} {tables.prose(2000 + k, 8 + k % 25, 5000)}" for k in range(120)]
    docs = [row(10_000 - 7 * i, t) for i, t in enumerate(texts)]
    got = compare(spark, tmp_path, docs)
    assert 4 < len({x.component_id for x in got}) < len(got)


def test_threshold(spark, tmp_path):
    """Sets of 90 and 90 with 80 in common are linked, with 79 they are not."""
    base = [f"a{i}" for i in range(91)]
    docs = [row(1, " ".join(base)), row(2, " ".join(base[:81] + [f"b{i}" for i in range(10)])), row(3, " ".join(base[:80] + [f"c{i}" for i in range(11)]))]
    assert {x.doc_id: x.component_id for x in compare(spark, tmp_path, docs)} == {1: 1, 2: 1, 3: 3}


def test_whole_table(spark):
    """All pairs of the sample table, by the sets of an inverted list."""
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = M.op12_tensored_minhash(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(want(docs))


def test_minima_estimate_similarity():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 62, 900)
    a, b = M.minima([np.sort(x[:800]), np.sort(x[100:])])
    assert abs((a == b).mean() - 700 / 900) < 0.2
    small = [np.sort(x[k:k + 5]) for k in range(40)] + [x[:0]]
    with_chunks = M.minima(small)
    assert (with_chunks[-1] == -1).all() and all((M.minima([s])[0] == m).all() for s, m in zip(small, with_chunks))
