import random
from types import SimpleNamespace

import numpy as np
from quillstone.llm import toxicity

BAD = ["vile", "foul", "nasty", "rotten", "grubberon", "grubbertel", "grubberix"]


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(400)]
    rows = []
    for i in range(n):
        body, bad = rng.choices(words, k=rng.randint(5, 200)), rng.random() < 0.15
        if bad:
            for w in rng.choices(BAD, k=rng.randint(2, 8)):
                body.insert(rng.randrange(len(body)), w)
        rows.append((i, " ".join(body), int(bad)))
    return rows


def test_severity_orders_and_generalises():
    rows = corpus(1500, 1)
    model = toxicity.fit([SimpleNamespace(text=t, target=b) for _, t, b in rows[:1200]])
    assert np.all(np.diff(model.bounds) > 0)
    p = model.at_least(np.array([sum(map(model.word, toxicity.types(t))) for _, t, _ in rows[1200:]]))
    assert np.all(np.diff(p, axis=1) <= 0)
    bad = np.array([b for *_, b in rows[1200:]])
    assert ((p[:, 0] >= 0.4) == bad).mean() > 0.97
    # A longer list of the same insults is no less severe, and an unseen word of a known stem counts.
    one, two = (sum(map(model.word, toxicity.types(t))) for t in ("vile", "vile nasty foul"))
    assert two > one > 0 and model.word("grubberly") > 0
    assert toxicity.types("a B a") == ["a", "a", "b"]


def test_grades_follow_labels():
    docs = [["a", "bad"], ["a"], ["bad", "bad", "worse"], ["a", "b"]] * 5
    toxic = np.array([True, False, True, False] * 5)
    got = toxicity.grades(docs, toxic)
    assert (got[~toxic] == 0).all() and (got[toxic] >= 1).all() and got[2] > got[0]


def test_table_and_edge_cases(spark):
    rows = corpus(300, 2)
    docs = [(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.1), (901, "", 0.1), (None, "vile nasty foul", 0.1), (902, "x " * 300_000, 0.1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(0, rows[0][2]), (5000, 1), (900, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 304 and got[900].severity == got[901].severity == got[902].severity < 0.4
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got.values())
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert None in ids and sum(b for i, _, b in rows if i in ids) <= 2 and len(ids) >= 250
    none = labels.limit(0)
    assert toxicity.reject(docs, none).count() == 304 and toxicity.reject(docs.limit(0), labels).count() == 0


def test_gradient_equals_finite_differences():
    import numpy as np

    rng = np.random.default_rng(4)
    row, index, grade = np.repeat(np.arange(9), 5), rng.integers(0, 12, 45), rng.integers(0, 4, 9)
    above = (grade[:, None] > np.arange(3)[None, :]).astype(float)
    w, steps = rng.random(12), rng.normal(size=3)
    gw, gs, _ = toxicity.gradient(w, steps, row, index, above, 0.1)
    for x, g in ((w, gw), (steps, gs)):
        for i in range(len(x)):
            loss = []
            for move in (1e-6, -2e-6):
                x[i] += move
                loss.append(toxicity.gradient(w, steps, row, index, above, 0.1)[2])
            x[i] += 1e-6
            assert abs((loss[0] - loss[1]) / 2e-6 - g[i]) < 1e-6
