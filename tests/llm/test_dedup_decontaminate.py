"""Near duplicates, decontamination and the pipeline against plain versions."""

import hashlib
import random
from collections import Counter

import plain
import pytest
import tables
from pyspark.sql import functions as F

import corpus_pipeline
from test_set_dedup import shingles
from tickloom.llm import decontamination, set_dedup, simhash_dedup

BENCHMARK = "item_id long, text string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return tables.write(spark, tmp_path_factory.mktemp("rows"), benchmark=(BENCHMARK, tables.items()))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables.write(spark, tmp_path_factory.mktemp("none"), docs=[], benchmark=(BENCHMARK, []))


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def near(a, b):
    return (a ^ b).bit_count() <= 2


def components(docs):
    """Row -> (fingerprint, smallest row of its component)."""
    fps = sorted({plain.fingerprint(d[1]) for d in docs})
    root = dict(zip(fps, plain.groups(fps, near)))
    return [(f, root[f]) for f in (plain.fingerprint(d[1]) for d in docs)]


def test_code_covers(spark):
    r = random.Random(3)
    halves = [r.getrandbits(32) for _ in range(200)] + [0, (1 << 32) - 1]
    rows = spark.createDataFrame([(h,) for h in halves], "h long").select("h", simhash_dedup.home(F.col("h")).alias("home"), simhash_dedup.near_anchors(F.col("h")).alias("near")).collect()

    def decode(h):
        h &= (1 << 31) - 1
        s = 0
        for b in range(31):
            s ^= (b + 1) * (h >> b & 1)
        return h ^ (1 << (s - 1)) if s else h

    for row in rows:
        assert row.home == decode(row.h) and ((row.home ^ row.h) & (1 << 31) - 1).bit_count() <= 1
        assert set(row.near) == {decode(row.h)} | {decode(row.h ^ (1 << b)) for b in range(32)}


@pytest.mark.parametrize("hot", [0, 3, 512])
def test_links_are_exact(spark, hot):
    r = random.Random(hot)
    fps = set()
    for _ in range(25):
        centre = r.getrandbits(64)
        for _ in range(20):
            x = centre
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    crowd = r.getrandbits(32) << 32
    fps |= {crowd | r.getrandbits(12) << 20 for _ in range(150)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(x.a, x.b) for x in simhash_dedup.links(nodes, hot).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and near(fps[i], fps[j])}
    assert got == want


def test_spread_is_not_broadcast(spark):
    """Without crowded anchors Spark sizes the replicated fingerprints as before their explodes, however many they are."""
    r = random.Random(11)
    pairs = {(x, x | 1) for x in (r.getrandbits(62) << 1 for _ in range(1000))}
    nodes = simhash_dedup.stage(spark.createDataFrame([(x,) for pair in pairs for x in pair], "fp long"))
    found = simhash_dedup.links(nodes)
    assert {(x.a, x.b) for x in found.collect()} == pairs
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in final and "Broadcast" not in final


def test_components_of_long_chains(spark):
    r = random.Random(5)
    names = r.sample(range(10_000), 400)
    edges = [(min(a, b), max(a, b)) for a, b in zip(names[:300], names[1:300])] + [(min(names[300], x), max(names[300], x)) for x in names[301:]]
    got = {x.node: x.root for x in simhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(names[:300]) for x in names[:300]} | {x: min(names[300:]) for x in names[300:]}


def test_fingerprints_and_components(spark, folder):
    docs = tables.documents()
    marked = components(docs)
    least = {}
    for d, (_, root) in zip(docs, marked):
        least[root] = min((x for x in (least.get(root), d[0]) if x is not None), default=None)
    want = sorted(key((d[0], f"{fp:016x}", least[root])) for d, (fp, root) in zip(docs, marked))
    assert sorted(key(r) for r in simhash_dedup.op8_anchor_points(spark, folder).collect()) == want


def shingle_roots(rows):
    """Smallest row of each row's component: five-word shingles, similarity 0.8 or more; texts without words are one component."""
    sets = [shingles(d[1]) for d in rows]
    return plain.groups(sets, lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b))


def one_each(rows):
    best = {}
    for i, (d, root) in enumerate(zip(rows, shingle_roots(rows))):
        best[root] = min(best.get(root, (2, 0, 0)), (d[0] is None, d[0] or 0, i))
    return [rows[i] for _, _, i in sorted(best.values(), key=lambda x: x[2])]


def test_one_document_stays(spark, folder):
    """Null ids and texts, repeated rows, a long text, clashing columns."""
    source = spark.read.parquet(f"{folder}/documents.parquet")
    out = set_dedup.without_near_copies(source)
    assert out.columns == source.columns
    assert sorted(key(r) for r in out.select("doc_id", "text").collect()) == sorted(key(d[:2]) for d in one_each(tables.documents()))


def check_hits(spark, folder):
    want = []
    for d in tables.documents():
        n, hit, found = plain.hits(d[1], tables.items())
        want.append(key((d[0], n, hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), hit > 0)))
    assert sorted(key(r) for r in decontamination.op9_prefix_join(spark, folder).collect()) == sorted(want)
    return want


def test_hits(spark, folder):
    want = check_hits(spark, folder)
    assert sum(w[-1][1] for w in want) >= 5


def test_hits_in_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 15)
    check_hits(spark, folder)


def test_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = decontamination.clean_documents(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert out.columns == docs.columns
    want = [key(d[:2]) for d in tables.documents() if not plain.hits(d[1], tables.items())[1]]
    assert sorted(key(r) for r in out.select("doc_id", "text").collect()) == sorted(want)


def test_empty(spark, empty, folder):
    assert simhash_dedup.op8_anchor_points(spark, empty).count() == 0
    assert decontamination.op9_prefix_join(spark, empty).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = spark.read.parquet(f"{empty}/benchmark.parquet")
    assert decontamination.clean_documents(docs, none).count() == docs.count()
    assert set_dedup.without_near_copies(spark.read.parquet(f"{empty}/documents.parquet")).count() == 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline(spark, folder):
    """Every stage against the plain version of what its predecessor kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = tables.documents()
    bad = plain.bad_hosts([(d[3], plain.rule_counts(d[1])["base_failed"]) for d in rows])
    rows = [d for d in rows if not plain.rule_counts(d[1])["base_failed"] and d[3] not in bad]
    rows = one_each(rows)
    rows = [d for d in rows if not plain.hits(d[1], tables.items())[1]]
    _, _, copies = plain.mix([(d[0], d[3], d[1]) for d in rows])
    want = Counter()
    for d, n in zip(rows, copies):
        want[d[:2]] += n
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:len(columns)] == columns and "placed_" in out.columns
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == +want and sum(want.values()) > 5
    per = {}
    for r in got:
        per.setdefault(r.placed_.shard, []).append(r.placed_.slot)
    assert all(sorted(x) == list(range(len(x))) for x in per.values())
