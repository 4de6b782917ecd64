import itertools
import random

import numpy as np
import pytest
import xxhash
from quillstone.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, errors=4):
    """fps: [(doc_id, fp)]; the smallest reachable doc_id of each."""
    label = {d: d for d, _ in fps}
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(fps, 2) if (x ^ y).bit_count() <= errors]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_linked_fingerprints_share_a_key():
    rng = random.Random(7)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << bit
        kx, ky = (set(simhash.keys(np.array([v], dtype=np.uint64))[2].tolist()) for v in (x, y))
        assert kx & ky


def test_six_codewords_or_one():
    rows, _ = simhash.codewords(np.arange(1 << 12, dtype=np.uint32) * 1777 % (1 << 23))
    assert set(np.bincount(rows).tolist()) == {1, 6}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c d", "A b C d e", "é É \x1c x\x85y " * 40, "w " * 5000])
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")


@pytest.mark.parametrize("heavy", [simhash.HEAVY, 3])
def test_groups_equal_brute_force(spark, heavy):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for i in range(60):
        base = rng.choices(words, k=80)
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            if rng.random() < 0.7:
                own[rng.randrange(80)] = "changed"
            docs.append(" ".join(own))
    docs += [None, "", "  ", "one", "ONE"]
    ids = rng.sample(range(10_000), len(docs))
    rows = [(i, t, "clash", 1) for i, t in zip(ids, docs, strict=True)]
    want_fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    want = brute_components(list(want_fp.items()))
    got = simhash.groups(frame(spark, rows), heavy=heavy).collect()
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == want_fp
    assert {r.doc_id: r.component_id for r in got} == want
    left = simhash.dedup(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in left) == sorted(set(want.values()))


def test_long_runs_are_linked():
    fp = np.array([1 << i for i in range(40)] + [(1 << 50) - 1], dtype=np.uint64)
    a, b = simhash._linked(np.zeros(41, dtype=np.int64), fp, np.arange(41), 4)
    assert len(a) == 39 and set(a.tolist()) | set(b.tolist()) == set(range(40))


def test_empty_and_null_ids(spark):
    assert simhash.groups(frame(spark, [])).count() == 0
    got = simhash.groups(frame(spark, [(None, "a b c d e", "", 0), (4, "a b c d e", "", 0), (None, "zz", "", 0)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 4), (4, 4)]
