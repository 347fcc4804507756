"""Sharding, quality rules and mixing against plain versions."""

import random
from collections import Counter, defaultdict

import plain
import pytest
import tables

from tickloom.llm import mixing, quality_rules, sharding


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return tables.write(spark, tmp_path_factory.mktemp("rows"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables.write(spark, tmp_path_factory.mktemp("none"), docs=[])


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def test_shards(spark, folder):
    rows = sharding.op1_virtual_slots(spark, folder).collect()
    docs = tables.documents()
    want = Counter((d, len((t or "").encode()) + 1, plain.crc(t)) for d, t, *_ in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    per = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        per[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in per.values())


def test_third_of_rows_equal(spark, tmp_path):
    """Equal rows of a longer text spread like others, gapless positions and near equal bytes."""
    docs = [(i, tables.prose(i, 30), "en", "a", 1) for i in range(2000)] + [(5, tables.prose(77, 120), "en", "a", 1)] * 1000 + [(None, None, None, None, None)] * 100
    rows = sharding.op1_virtual_slots(spark, tables.write(spark, tmp_path, docs)).collect()
    assert len(rows) == 3100
    load, slots = Counter(), {}
    for r in rows:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(load) == 16 and max(load.values()) < 1.05 * min(load.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_near_equal(spark):
    rows = sharding.op1_virtual_slots(spark, "/root/testdata/sf0.1").collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert len(load) == 16 and max(load.values()) < 1.02 * min(load.values())


def test_shards_keep_all_columns_and_pieces(spark, folder, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_TASK", 0.001)  # many pieces per slot
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = sharding.shard(docs)
    assert out.select("row.*").columns == docs.columns
    assert sorted(map(key, out.select("row.*").collect())) == sorted(map(key, docs.collect()))
    per = defaultdict(list)
    for r in out.collect():
        per[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in per.values())


def test_rebalance_moves_little_and_versions(spark):
    r = random.Random(1)
    sizes = [(s, r.randrange(1, 2000)) for s in range(sharding.SLOTS)]
    first = sharding.first_map(sizes, 16)
    grown = sharding.rebalance(first, sizes, 17)
    moved = [s for s in first if first[s] != grown[s]]
    assert all(grown[s] == 16 for s in moved)
    load = Counter()
    for s, n in sizes:
        load[grown[s]] += n
    mean = sum(load.values()) / 17
    assert max(load.values()) - min(load.values()) < 0.02 * mean and sum(dict(sizes)[s] for s in moved) < 1.1 * mean
    assert sharding.rebalance(grown, sizes, 17) == grown
    versions = sharding.map_table(spark, [first, grown], sizes)
    assert {tuple(x) for x in versions.where("version = 1").select("slot", "shard").collect()} == set(grown.items())
    with pytest.raises(ValueError):
        sharding.rebalance(grown, sizes, 16)
    assert sharding.rebalance({0: 0, 1: 0}, [], 2) == {0: 0, 1: 0}


def test_rule_counts_and_hosts(spark, folder):
    rows = quality_rules.op2_host_rules(spark, folder).collect()
    docs = tables.documents()
    counts = [plain.rule_counts(t) for _, t, *_ in docs]
    bad = plain.bad_hosts([(d[3], c["base_failed"]) for d, c in zip(docs, counts)])
    assert "spam" in bad and "host0" not in bad
    want = sorted(key((d[0], *c.values(), not c["base_failed"] and d[3] not in bad)) for d, c in zip(docs, counts))
    assert sorted(key(r) for r in rows) == want


def test_kept_documents_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    failed = [plain.rule_counts(d[1])["base_failed"] for d in tables.documents()]
    bad = plain.bad_hosts([(d[3], f) for d, f in zip(tables.documents(), failed)])
    want = [d[:2] for d, f in zip(tables.documents(), failed) if not f and d[3] not in bad]
    assert sorted(key(r) for r in kept.select("doc_id", "text").collect()) == sorted(key(x) for x in want)


def test_mix(spark, folder):
    rows = mixing.op4_weighted_fair_queueing(spark, folder).collect()
    docs = tables.documents()
    target, total, copies = plain.mix([(d[0], d[3], d[1]) for d in docs])
    want = Counter()
    for d, n in zip(docs, copies):
        size = len(plain.words(d[1]))
        want[(d[0], size, total[d[3]], round(target[d[3]], 6), size * n)] += 1
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows) == want


@pytest.mark.parametrize("piece, cut", [(7, 5), (1, 1)])
def test_mix_by_small_pieces(spark, folder, monkeypatch, piece, cut):
    monkeypatch.setattr(mixing, "PIECE", piece)
    monkeypatch.setattr(mixing, "SORTED", cut)
    monkeypatch.setattr(mixing, "SLOTS", 8)
    test_mix(spark, folder)


def test_mix_follows_targets(spark):
    rows = mixing.op4_weighted_fair_queueing(spark, "/root/testdata/sf0.1").collect()
    taken, target, longest = Counter(), {}, Counter()
    sources = {r.source_size: r.target for r in rows}
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[r.source_size] += r.taken
        longest[r.source_size] = max(longest[r.source_size], r.size)
    for s, goal in sources.items():
        assert abs(taken[s] - goal) <= longest[s]


def test_mixed_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = tables.documents()
    _, _, copies = plain.mix([(d[0], d[3], d[1]) for d in rows])
    want = Counter()
    for d, n in zip(rows, copies):
        want[d[0], d[1], d[3]] += n
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == +want


def test_empty_tables(spark, empty):
    assert sharding.op1_virtual_slots(spark, empty).count() == 0
    assert quality_rules.op2_host_rules(spark, empty).count() == 0
    assert mixing.op4_weighted_fair_queueing(spark, empty).count() == 0
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    assert quality_rules.kept_documents(docs).count() == mixing.mixed_documents(docs).count() == 0


def test_tables_without_words(spark, tmp_path):
    folder = tables.write(spark, tmp_path, docs=[(1, None, None, None, None), (2, "", None, "a", 0)])
    assert [(r.size, r.taken, r.target) for r in mixing.op4_weighted_fair_queueing(spark, folder).collect()] == [(0, 0, 0.0)] * 2
