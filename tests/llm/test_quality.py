import random
from types import SimpleNamespace
from zlib import crc32

import numpy as np
from quillstone.llm import quality


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(300)]
    rows = []
    for i in range(n):
        good, body = rng.random() < 0.8, rng.choices(words, k=rng.randint(8, 80))
        if not good:
            how = rng.randrange(3)
            body = [w.upper() + "!!" for w in body] if how == 0 else [w + "%%%" for w in body] if how == 1 else [w for w in body for _ in range(8)]
        rows.append((i, " ".join(body), int(good)))
    return rows


def test_held_out_accuracy():
    rows = corpus(1500, 1)
    model = quality.fit([SimpleNamespace(text=t, target=g) for _, t, g in rows[:1200]])
    right = [(z >= np.log(0.3 / 0.7)) == g for z, (_, _, g) in zip(quality.logits([t for _, t, _ in rows[1200:]], model), rows[1200:], strict=True)]
    assert np.mean(right) > 0.97


def features(text, buckets):
    """Weights by bucket, by the plain definition."""

    def bucket(h, salt):
        h = (h + salt) * int(quality.MIX) % 2**64
        h ^= h >> 29
        return (h * int(quality.MIX) % 2**64) >> (65 - buckets.bit_length())

    def poly(codes):
        return sum(c * int(quality.STEP) ** i for i, c in enumerate(codes)) % 2**64

    words = text.split()
    pairs = list(zip(words, words[1:], strict=False))
    same = sum(a == b for a, b in pairs)
    total = len(words) + quality.PAIR * len(pairs) + same
    out = {}

    def add(at, weight):
        out[at] = out.get(at, 0) + weight

    whole = [poly(list(map(ord, f"<{w}>"))) for w in words]
    for w, h in zip(words, whole, strict=True):
        codes = list(map(ord, f"<{w}>"))
        grams = [bucket(poly(codes[i : i + n][::-1]), n) for n in quality.GRAMS for i in range(len(codes) - n + 1)]
        for at in [bucket(h, 1), *grams]:
            add(at, 1 / total / (1 + len(grams)))
    for a, b in zip(whole, whole[1:], strict=False):
        add(bucket((a * int(quality.STEP) + b) % 2**64, 2), quality.PAIR / total)
    add(bucket(0, 0), same / total)
    return out


def test_features_equal_the_definition(monkeypatch):
    monkeypatch.setattr(quality, "LETTERS", 40)
    rng = random.Random(3)
    texts = ["", "a", "a a b b b", "x" * 1000, "é 你好 🙂 <b> <b>"] + [" ".join(rng.choices(["ab", "c", "defgh", "<", "ü"], k=rng.randint(0, 30))) for _ in range(60)]
    got = [{} for _ in texts]
    for text, bucket, weight in quality.parts([t.split() for t in texts], 1 << 10):
        for i, b, w in zip(text.tolist(), bucket.tolist(), weight.tolist(), strict=True):
            got[i][b] = got[i].get(b, 0) + w
    for g, t in zip(got, texts, strict=True):
        want = {b: w for b, w in features(t, 1 << 10).items() if w} if t else {}
        assert g.keys() == want.keys() and all(abs(g[b] - w) < 1e-9 for b, w in want.items())
        assert not t or abs(sum(g.values()) - 1) < 1e-9


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    docs = [(rng.choice(30, 12, replace=False), rng.random(12)) for _ in range(7)]
    y, v, u, bias = rng.integers(0, 2, 7), rng.normal(size=(30, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)
    gv, gu, gb, own, _ = quality.gradient(docs, y, v, u, bias)
    for x, g in ((v, gv), (u, gu), (bias, gb)):
        for i in range(0, g.size, 3):
            at = np.unravel_index(i, g.shape)
            place = (own[at[0]], *at[1:]) if x is v else at
            losses = []
            for step in (1e-5, -2e-5):
                x[place] += step
                losses.append(quality.gradient(docs, y, v, u, bias)[4])
            x[place] += 1e-5
            assert abs((losses[0] - losses[1]) / 2e-5 - g[at]) < 1e-4


def test_table_and_edge_cases(spark):
    rows = corpus(300, 2)
    docs = [(i, t, 1) for i, t, _ in rows] + [(900, None, 1), (901, "", 1), (902, " \n", 1), (None, "a b", 1), (903, "y " * 300_000, 1), (0, rows[0][1], 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(900, None), (7777, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 306 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] == by[902]
    held = [(by[i] >= 0.3) == g for i, _, g in rows if crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.9
    # The layout of the tables changes nothing, nor does a label that is there twice.
    again = quality.train(docs.repartition(7), labels.union(labels.filter("quality = 0")).repartition(3))
    assert np.array_equal(again.value, model.value) and again.bias == model.bias
    # Held-out labels are never read.
    flipped = labels.filter("crc32(cast(doc_id as string)) % 5 != 0")
    assert np.array_equal(quality.train(docs, flipped).value, model.value)
    assert quality.score(docs, quality.train(docs, labels.limit(0))).first().score == 0.5
    assert quality.score(docs.limit(0), model).count() == 0
