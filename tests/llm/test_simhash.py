from __future__ import annotations

import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from llm_data import DOCS, prose
from pyspark.sql import functions as F

from siteloom.llm import simhash


def groups(pairs) -> set[frozenset]:
    found: dict = {}
    for a, b in pairs:
        joined = found.get(a, {a}) | found.get(b, {b})
        for x in joined:
            found[x] = joined
    return {frozenset(x) for x in found.values()}


def colliding(parts: np.ndarray) -> np.ndarray:
    """(n, n): which fingerprints have a band within RADIUS, for the bands that so many fingerprints are searched by."""
    found = simhash.bands(parts, *simhash.search(len(np.unique(parts, axis=0)))).astype(np.uint64)
    return np.stack([(np.bitwise_count(found ^ own) <= simhash.RADIUS).any(1) for own in found])


def brute(rows) -> dict:
    """All pairs: a band within RADIUS, the whole within MOST; the smallest id of each component."""
    rows = [x for x in dict.fromkeys(rows) if x[0] is not None and x[1]]
    parts, has = simhash.fingerprints(pa.array([t for _, t in rows]))
    bits, meets = parts.astype(np.uint32), colliding(parts)
    pairs = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        if has[i] and has[j] and rows[i][0] != rows[j][0] and meets[i, j] and np.bitwise_count(bits[i] ^ bits[j]).sum() <= simhash.MOST:
            pairs.append((rows[i][0], rows[j][0]))
    return {x: min(g) for g in groups(pairs) for x in g if x != min(g)}


def edited(r, text: str, share: float) -> str:
    return " ".join(prose(r, 1) if r.random() < share else w for w in text.split())


def corpus(r, n: int = 60) -> list[tuple]:
    rows, number = [], itertools.count()
    for _ in range(n):
        base = prose(r, r.randint(60, 250))
        rows.append((next(number), base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            rows.append((next(number), edited(r, base, r.choice([0, 0.02, 0.05, 0.3]))))
    base = prose(r, 150)  # a hot group, above PAIRWISE in each bucket
    rows += [(next(number), edited(r, base, r.choice([0, 0.02]))) for _ in range(80)]
    return rows


def test_matches_brute_force(spark, r):
    rows = corpus(r)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    found = {x.doc_id: x.kept_doc_id for x in simhash.near_duplicates(docs).collect()}
    assert found == brute(rows)
    assert len(found) > 80


def test_near_copies_are_found_and_others_left(r):
    bases = [prose(r, 200) for _ in range(150)]
    a, _ = simhash.fingerprints(pa.array(bases))
    b, _ = simhash.fingerprints(pa.array([edited(r, t, 0.04) for t in bases]))
    d = np.bitwise_count((a ^ b).astype(np.uint32))
    assert ((d.min(1) <= simhash.RADIUS) & (d.sum(1) <= simhash.MOST)).mean() >= 0.95
    d = np.bitwise_count((a[:-1] ^ b[1:]).astype(np.uint32))
    assert not ((d.min(1) <= simhash.RADIUS) & (d.sum(1) <= simhash.MOST)).any()


@pytest.mark.parametrize("first, last, mark", [(0x4E00, 0x5200, "。"), (0x3041, 0x3094, "、"), (0x0E01, 0x0E2E, ""), (0x61, 0x7A, "")])
def test_near_copies_without_spaces_are_found_and_others_left(r, first, last, mark):
    def text(n: int) -> str:
        return "".join(mark if mark and r.random() < 0.05 else chr(r.randint(first, last)) for _ in range(n))

    bases = [text(600) for _ in range(60)]
    a, has = simhash.fingerprints(pa.array(bases))
    b, _ = simhash.fingerprints(pa.array(["".join(text(1) if r.random() < 0.01 else c for c in t) for t in bases]))
    d = np.bitwise_count((a ^ b).astype(np.uint32))
    assert has.all() and ((d.min(1) <= simhash.RADIUS) & (d.sum(1) <= simhash.MOST)).mean() >= 0.95
    d = np.bitwise_count((a[:-1] ^ b[1:]).astype(np.uint32))
    assert not ((d.min(1) <= simhash.RADIUS) & (d.sum(1) <= simhash.MOST)).any()


def test_collisions_are_all_pairs_within_the_radius(spark, r):
    """The ball hash alone against all pairs of one-part distances 0 to 4."""
    values = [r.getrandbits(simhash.BITS) for _ in range(20)]
    rows = [(i, *[v ^ sum(1 << x for x in r.sample(range(simhash.BITS), i % 5)) if b == 0 else r.getrandbits(simhash.BITS) for b in range(simhash.PARTS)]) for i, v in enumerate(values * 4)]
    reps = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} int" for c in simhash.COLUMNS))
    found = {(x.a, x.b) for x in simhash.collisions(simhash.variants(reps)).collect()}
    expected = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if any((p ^ q).bit_count() <= simhash.RADIUS for p, q in zip(x[1:], y[1:], strict=True))}
    assert found == expected


def test_pairs_at_every_accepted_distance_are_found():
    """Against all pairs of the documents within MOST, and of random fingerprints at each distance; also for the bands of far more documents."""
    r = np.random.default_rng(5)
    for n in (10_000, 1 << 24, 1 << 36):
        bits, number = simhash.search(n)
        assert n * sum(math.comb(bits, k) for k in range(simhash.RADIUS + 1)) / 2**bits < 32
        base = r.integers(0, 1 << simhash.BITS, (1500, simhash.PARTS)).astype(np.int32)
        for d in (20, 25, simhash.MOST):
            flips = np.zeros((len(base), simhash.WHOLE), np.int64)
            np.put_along_axis(flips, np.argsort(r.random(flips.shape), 1)[:, :d], 1, 1)
            other = base ^ (flips.reshape(len(base), simhash.PARTS, simhash.BITS) @ (1 << np.arange(simhash.BITS))).astype(np.int32)
            a, b = (simhash.bands(x, bits, number).astype(np.uint64) for x in (base, other))
            assert (np.bitwise_count(a ^ b) <= simhash.RADIUS).any(1).mean() >= simhash.RECALL - 0.03
    texts = duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet' where text is not null").fetchall()
    parts, has = simhash.fingerprints(pa.array([t for (t,) in texts]))
    parts = np.unique(parts[has], axis=0)
    found, bits = simhash.bands(parts, *simhash.search(len(parts))).astype(np.uint64), parts.astype(np.uint32)
    near, hits = np.zeros(simhash.MOST + 1), np.zeros(simhash.MOST + 1)
    for i in range(len(parts) - 1):
        d = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(1)
        for j in np.flatnonzero(d <= simhash.MOST):
            near[d[j]] += 1
            hits[d[j]] += (np.bitwise_count(found[i + 1 + j] ^ found[i]) <= simhash.RADIUS).any()
    assert near.sum() > 1000 and hits.sum() / near.sum() > 0.98 and (hits[:21] == near[:21]).all()
    assert hits[21:26].sum() / near[21:26].sum() > 0.95 and hits[26:].sum() / near[26:].sum() >= simhash.RECALL


def test_hot_buckets_reach_the_same_components(r):
    base = [r.getrandbits(simhash.BITS) for _ in range(simhash.PARTS)]
    rows = [(i, *[v ^ (1 << r.randrange(simhash.BITS) if r.random() < 0.6 else 0) for v in base]) for i in range(40)] + [(100 + i, *[r.getrandbits(simhash.BITS) for _ in base]) for i in range(5)]
    pdf = pd.DataFrame(rows, columns=["doc_id", *simhash.COLUMNS])
    bits = pdf[simhash.COLUMNS].to_numpy().astype(np.uint32)
    near = [(rows[i][0], rows[j][0]) for i, j in itertools.combinations(range(len(rows)), 2) if np.bitwise_count(bits[i] ^ bits[j]).sum() <= simhash.MOST]
    assert groups(simhash.reach(pdf)[["a", "b"]].itertuples(index=False, name=None)) == groups(near)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (150, 202)]
    found = {x.doc_id: x.root for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: min(g) for g in groups(edges) for x in g if x != min(g)}


@pytest.mark.filterwarnings("ignore")
def test_odd_rows(spark, odd_docs, no_docs):
    assert simhash.near_duplicates(odd_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((x.doc_id if x.doc_id is not None else -1) for x in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert simhash.near_duplicates(no_docs).count() == 0 == simhash.keep_one(no_docs).count()


def test_repeated_ids_with_other_texts_are_documents_of_their_own(spark, r):
    a, b, c = (prose(r, 80) for _ in range(3))
    docs = spark.createDataFrame([(1, a, "en", "a", 0), (1, b, "en", "a", 0), (1, b, "en", "b", 1), (2, a, "en", "a", 0), (3, c, "en", "a", 0), (3, None, "en", "a", 0), (None, a, "en", "a", 0)], DOCS)
    assert sorted(((str(x.doc_id), x.text) for x in simhash.keep_one(docs.withColumn("node", F.lit(1))).collect()), key=lambda x: (x[0], str(x[1]))) == sorted([("1", b), ("2", a), ("3", c), ("3", None), ("None", a)], key=lambda x: (x[0], str(x[1])))


def test_stage_keeps_one_of_each_group(spark, r):
    rows = corpus(r, 15)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    gone = brute(rows)
    assert {x.doc_id for x in simhash.keep_one(docs).collect()} == {i for i, _ in rows} - gone.keys()
