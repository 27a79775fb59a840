import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import exact_dedup, near_dedup
from inkwell.llm.components import connected_components

from .conftest import ROWS


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=9000), st.binary(max_size=9000))
def test_fingerprints_compose(a, b):
    assert (exact_dedup.combine(exact_dedup.lanes(a), exact_dedup.lanes(b), len(b)) == exact_dedup.lanes(a + b)).all()


def test_lanes_by_definition():
    s = b"hello\x00"
    want = [sum((c + 1) * pow(int(b), len(s) - 1 - i, int(p)) for i, c in enumerate(s)) % int(p) for p, b in zip(exact_dedup.PRIMES, exact_dedup.BASES)]
    assert exact_dedup.lanes(s).tolist() == want


@pytest.mark.parametrize("how", [{}, {"huge_bytes": 20}, {"mask": 3}])
def test_exact(docs, how):
    got = sorted(map(tuple, exact_dedup.exact_duplicates(docs, **how).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            want.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_keep_rows(docs, no_docs):
    kept = exact_dedup.keep_rows(docs, exact_dedup.exact_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t or "" for _, t, _ in ROWS})
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent):
    """(id, text) -> (size, component) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append(i)
    return [(i, len(sets[k]), min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_against_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 7)  # clusters and buckets in several blocks
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 5)
    r = random.Random(5)
    rows, k = [], 0
    for _ in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.randint(6, 160))]
        for _ in range(r.choice([1, 2, 3, 25])):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = f"x{r.randrange(9)}"
            rows.append((k, " ".join(t) if r.random() < 0.8 else "\n".join(t).upper()))
            k += 1
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert sorted((x[0], x[1], x[2]) for x in got) == sorted(brute(rows, percent))
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_near_edges(docs, no_docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(((x[0], x[1], x[2]) for x in got), key=str) == sorted(brute([(i, t) for i, t, _ in ROWS], 85), key=str)
    assert near_dedup.near_duplicates(no_docs).count() == 0
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(docs, 50)


def test_near_repeated_ids(spark):
    """Rows of one id, and of null, with texts of several components."""
    words = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*words[:-1], f"z{k}"])
    rows = [(5, near(0)), (5, "quite another text of more than five words"), (5, near(1)), (None, near(2)), (None, "quite another text of more than five words"), (3, "a third text that stands alone in here"), (None, "a fourth text that stands alone in here"), (9, near(3))] + [(5, near(0))] * 3
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x[0], x[1], x[2]) for x in got), key=str) == sorted(brute(rows, 85), key=str)


def test_near_large_groups(spark, monkeypatch):
    """A hub with many variants, a chain, and a group whose least text is alike, but linked only by way of others."""
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 16)
    r = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:-1], f"v{i}"])) for i in range(150)]  # all alike
    chain = [f"c{i}" for i in range(100)]
    for i in range(60):  # each like its neighbours, not like those further on
        chain[(i * 3) % 100] = f"d{i}"
        rows.append((1000 + i, " ".join(chain)))
    below = [f"b{i}" for i in range(90)]
    for i in range(60):  # pairs about the limit, many below
        t = list(below)
        for _ in range(2):
            t[r.randrange(90)] = f"e{r.randrange(50)}"
        rows.append((2000 + i, " ".join(t)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows, 85)
    assert sorted((x[0], x[1], x[2]) for x in got) == sorted(want)
    assert 3 < len({c for *_, c in want}) < 200


def test_common_counts():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    got = near_dedup.common_counts(sets)
    assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(30) for b in range(30) if a != b)


def test_sketch_estimates():
    r = np.random.default_rng(2)
    a = np.unique(r.integers(0, 1 << 62, 900).astype(np.uint64))
    b = np.concatenate([a[:-60], np.unique(r.integers(0, 1 << 62, 60).astype(np.uint64))])
    far = np.unique(r.integers(0, 1 << 62, 900).astype(np.uint64))
    ones = lambda x, y: int(np.bitwise_count(near_dedup.signature(np.unique(x))[1].view(np.uint64) ^ near_dedup.signature(np.unique(y))[1].view(np.uint64)).sum())
    assert ones(a, b) <= near_dedup.MAX_XOR < ones(a, far)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
