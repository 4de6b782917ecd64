import numpy as np
from quillstone.llm import pq


def brute(rows, least=0.98):
    """rows: (id, vector, label)."""
    good = {}
    for i, (vid, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            good[i] = np.array(v, dtype=float) / np.linalg.norm(v)
    links, label = {i: 0 for i in range(len(rows))}, {i: rows[i][0] for i in range(len(rows))}
    pairs = [(i, j) for i in good for j in good if i < j and rows[i][2] == rows[j][2] and good[i] @ good[j] >= least]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return sorted((rows[i][0], links[i], label[i], rows[i][0] == label[i]) for i in range(len(rows)))


def data(seed=1):
    rng = np.random.default_rng(seed)
    rows, vid = [], 0
    for _ in range(60):
        centre = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 1, 2, 5, 30]))):
            v = (centre + rng.normal(size=16) * 0.1 * rng.random()).astype(np.float32)
            rows.append((vid, [float(a) for a in v], int(rng.integers(3))))
            vid += 1
    rows += [(vid + i, rows[5][1], rows[5][2]) for i in range(4)]
    vid += 4
    strange = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0] * 3, []]
    rows += [(vid + i, v, 0) for i, v in enumerate(strange)] + [(vid + 9, rows[5][1], None), (vid + 10, [x * 1e30 for x in rows[5][1]], rows[5][2])]
    return rows


def test_groups_equal_brute_force(spark):
    rows = data()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    want = brute(rows)
    for how in ({}, {"block": 7, "lists": 4}):
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pq.groups(frame, **how).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
        assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
        assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.97


def test_lookup_is_the_coded_distance():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 16))
    index = pq.Index(x, 4, 4, 1)
    codes, off = index.code(x[:50])
    back = np.concatenate([book[codes[:, i]] for i, book in enumerate(index.books)], axis=1)
    want = ((x[:20, None, :] - back[None]) ** 2).sum(-1)
    assert np.allclose(index.looked_up(x[:20], codes), want)
    assert np.allclose(off, np.sqrt(((x[:50] - back) ** 2).sum(1)))


def test_empty_table_and_one_row(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert pq.groups(spark.createDataFrame([], kind)).count() == 0
    got = pq.groups(spark.createDataFrame([(4, [1.0, 2.0], 1)], kind)).collect()
    assert [tuple(r) for r in got] == [(4, 0, 4, True)]
