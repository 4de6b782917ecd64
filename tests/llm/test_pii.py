import itertools
import random
import re
from hashlib import sha256

import numpy as np
import pytest
from quillstone.llm import pii, queries

PLAIN = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            odd = [int(d) for d in digits[-1::-2]], [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
            good = [
                True,
                kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                12 <= len(digits) <= 19 and sum(odd[0] + odd[1]) % 10 == 0,
                9 <= len(digits) <= 15,
            ][kind]
            if good:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def card(rng, n=16):
    digits = "".join(rng.choices("0123456789", k=n - 1))
    return next(digits + d for d in "0123456789" if pii.luhn(digits + d))


def text(rng, joints=("", " ", " ", "\n")):
    parts = []
    for _ in range(rng.randint(3, 25)):
        parts.append(rng.choice([
            "word", "und,", "a.b", f"{rng.randrange(99)}", f"bob.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", card(rng), card(rng)[:4] + " " + card(rng),
            ".".join(str(rng.randrange(300)) for _ in range(rng.randint(2, 9))), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", "x@y", "@", "+", "4111-1111-1111-1111",
        ]))
    return rng.choice(joints).join(parts)


def test_base_equals_the_plain_patterns():
    rng = random.Random(1)
    texts = [text(rng) for _ in range(1500)] + ["".join(rng.choices("a1.@+- (9é", k=40)) for _ in range(3000)]
    texts += ["", "é@ü.com a@b.c@d.e", "1.2.3.4.5.6.7.8", "1..2.3.4.5", "+1" + "(" * 50, "٣٤٥@x.com +١٢٣٤٥٦٧٨٩"]
    for t in texts:
        assert pii.base(t) == plain(t), t


def test_base_is_linear():
    for t in ("x" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000):
        pii.base(t)


def prose(rng):
    words = "call me at the of on paid from with now and mail host".split()
    body = rng.choices(words, k=12)
    kinds = [f"bob.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", card(rng), f"10.{rng.randrange(256)}.3.{rng.randrange(256)}", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"]
    for x in rng.sample(kinds, 2):
        body.insert(rng.randrange(12), x)
    return " ".join(body)


@pytest.fixture(scope="module")
def field():
    rng = random.Random(2)
    return pii.fit([prose(rng) for _ in range(400)], epochs=5)


def test_field_adds_what_patterns_miss(field):
    own, every = pii.spans("call (415) 555-2671 now", field)
    assert own == [] and every == [(5, 3, 19)]
    merged = f"call +1 (415) 555-2671 {card(random.Random(3))} now"
    own, every = pii.spans(merged, field)
    assert own == [] and 2 in [k for _, k, _ in every]
    for t in ("on 2024-01-30 at 12:30", "version 1.2.3", "", "no numbers at all"):
        assert pii.spans(t, field) == ([], [])


def test_decoding_is_the_best_segmentation(field):
    """Against all segmentations of short clusters."""
    rng = random.Random(5)
    none = np.where(np.arange(pii.OTHER + 1) == pii.OTHER, 0.0, -np.inf)
    for _ in range(25):
        t = " ".join(rng.choice(["a", "12", "(415)", "555-2671", "+1", card(rng), "x@y.com"]) for _ in range(4))
        words = [m.span() for m in pii.WORD.finditer(t)]
        scores = field.scores(field.segments(t, words))
        best = -np.inf
        for cuts in itertools.product([0, 1], repeat=3):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [4]
            parts = list(zip([0, *ends], ends, strict=False))
            for kinds in itertools.product(range(pii.OTHER + 1), repeat=len(parts)):
                total = sum(field.next[a, b] for a, b in zip((pii.OTHER, *kinds), kinds, strict=False))
                total += sum(scores.get(p, none if p[1] == p[0] + 1 else none - np.inf)[k] for p, k in zip(parts, kinds, strict=True))
                if total > best:
                    best, found = total, [(*p, k) for p, k in zip(parts, kinds, strict=True) if k != pii.OTHER]
        assert field.best(t, words) == found


def test_table(spark):
    rng = random.Random(4)
    rows = [(i, text(rng)) for i in range(120)] + [(900, None), (901, ""), (None, "a@b.c"), (902, "1 " * 60_000), (3, "10.0.0.1")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = pii.find(docs, pii.train(docs, sample=60, epochs=1)).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows, strict=True):
        want = plain(t or "")
        shown = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.doc_id == i and r.base_sha256 == sha256(shown.encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(filter(None, shown.split(","))) <= set(every)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in every) for k in pii.KINDS]
    assert pii.find(docs.limit(0), pii.Field()).count() == 0
    assert pii.train(docs.limit(0)).weights == {}


def test_query_counts_base_spans(spark, tmp_path, field, monkeypatch):
    monkeypatch.setattr(pii, "train", lambda docs: field)
    rng = random.Random(7)
    rows = [(i, prose(rng)) for i in range(50)] + [(900 + i, f"call (415) 555-26{i:02} now, bob@mail.example.com") for i in range(20)] + [(999, None), (None, "10.0.0.1")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_pii(spark, str(tmp_path)).collect()}
    assert sum("phone:" in got[900 + i].spans for i in range(20)) > 10
    for i, t in rows:
        kinds = [k for _, k, _ in plain(t or "")]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [kinds.count(k) for k in range(4)], t


@pytest.mark.parametrize("before", [398, 399, 400, 799, 1200])
def test_long_clusters_are_decoded_whole(field, before):
    head = "12 " * before
    own, every = pii.spans(f"{head}(415) 555-2671 now", field)
    assert own == [] and (len(head), 3, len(head) + 14) in every


@pytest.mark.parametrize("t", ["1.2.3." + "0" * 5000 + "1", "0" * 10**6 + ".0.0.0", "1.2.3.4." * 100_000, "9" * 10**6, "+" + "1 " * 500_000, "a@" + "b." * 300_000 + "c"])
def test_long_numbers_and_zeros(t):
    found = pii.base(t)
    assert found == sorted(found)
    if t.startswith("1.2.3.0"):
        assert found == [(0, 1, len(t))]


def planted(rng):
    """(text, spans) of numbers that base patterns don't find."""
    parts, spans, at = [], [], 0
    for _ in range(6):
        a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
        number = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}"])
        before = " ".join(rng.choices(["call", "office", "or", "reach", "desk", "tel", "the", "of"], k=rng.randint(5, 9))) + " "
        parts += [before, number, " "]
        at += len(before)
        spans.append((at, 3, at + len(number)))
        at += len(number) + 1
    return "".join(parts), spans


def test_recall_of_added_phones(field):
    rng = random.Random(11)
    want = hit = 0
    for _ in range(40):
        t, truth = planted(rng)
        own, every = pii.spans(t, field)
        want += len(truth)
        hit += len(set(truth) & (set(every) - set(own)))
    assert hit / want > 0.9, hit / want


def test_plain_numbers_are_left_alone(field):
    rng = random.Random(12)
    added = total = 0
    for _ in range(100):
        d = "".join(rng.choices("0123456789", k=14))
        t = f"the item {rng.choice(pii.PLAIN)(d)} of the list"
        own, every = pii.spans(t, field)
        added += len(every) - len(own)
        total += 1
    assert added / total < 0.1, added
