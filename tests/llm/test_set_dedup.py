"""Near copies of the pipeline by five-word shingles against all pairs."""

import random

import plain
import pytest
import tables

import corpus_pipeline
from tickloom.llm import set_dedup


def shingles(text):
    w = plain.words((text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def edited(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10_000)}"
    return " ".join(w)


def planted():
    texts = []
    for g in range(12):
        base = tables.prose(1000 + g, 120 + 40 * g, 5000)
        texts += [base, base, *[edited(base, 100 * g + k, 1 + k) for k in range(6)]]
    passage = tables.prose(5, 40, 5000)
    texts += [f"{tables.prose(2000 + k, 15 + k, 5000)} {passage}" for k in range(40)]
    return texts + ["", None, "one two", "ONE two", "one two three"]


@pytest.mark.parametrize("stars", [0, 2])
def test_planted_copies(spark, tmp_path, monkeypatch, stars):
    monkeypatch.setattr(set_dedup, "STARS", stars)
    texts = planted()
    folder = tables.write(spark, tmp_path, docs=[(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    sets = [shingles(t) for t in texts]
    want = sorted(set(plain.groups(sets, lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b))))
    assert len(want) < len(set(sets))
    far = [i for i in range(0, 96, 8) if (plain.fingerprint(texts[i]) ^ plain.fingerprint(texts[i + 3])).bit_count() > 2]
    assert far  # copies that two bits do not link
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.near_dedup(spark, docs, folder)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == want


def test_stage_goes_by_anchor_points(spark, tmp_path, monkeypatch):
    """The stage's first links are all pairs of fingerprints within two bits whose sets are alike; one set stands for a fingerprint."""
    texts = list(dict.fromkeys(t for t in planted() if t))
    base = tables.prose(77, 400, 50_000)
    texts += [base, *[edited(base, 700 + k, 1) for k in range(8)]]
    folder = tables.write(spark, tmp_path, docs=[(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    seen, made = [], set_dedup.anchor_links
    monkeypatch.setattr(set_dedup, "anchor_links", lambda sets: seen.append((sets, made(sets))) or seen[-1][1])
    corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    rows, found = seen[0][0].collect(), {(r.a, r.b) for r in seen[0][1].collect()}
    stands = {fp: min(r.id for r in rows if r.fp == fp) for fp in {r.fp for r in rows}}
    sets = {r.id: set(r.s) for r in rows}
    near = {(stands[a], stands[b]) for a in stands for b in stands if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    near |= {(stands[r.fp], r.id) for r in rows if r.id != stands[r.fp]}
    assert found and found == {(a, b) for a, b in near if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
