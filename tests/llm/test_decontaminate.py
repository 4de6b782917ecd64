import random

import pytest
from quillstone.llm import decontaminate


def brute(docs, items, max_edits=0.2):
    found = set()
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            x = (item or "").lower().split()
            if x and words and decontaminate.nearest(x, words)[0] <= int(max_edits * len(x)):
                found.add((d, i))
    return found


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, below = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(below[j - 1] + (x != y), below[j] + 1, row[-1] + 1))
    return row[-1]


def test_nearest_is_the_best_passage():
    rng = random.Random(2)
    for _ in range(60):
        item, text = rng.choices("abc", k=rng.randint(1, 5)), rng.choices("abcd", k=rng.randint(1, 9))
        edits, s, e = decontaminate.nearest(item, text)
        every = [plain_distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1)]
        assert edits == min(every) == plain_distance(item, text[s:e])


def test_matches_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([8, 15, 30, 45])))) for i in range(40)]
    items += [(40, items[0][1]), (41, None), (42, "  "), (43, "rare")]
    docs = []
    for d in range(150):
        body = rng.choices(vocabulary, k=rng.randint(0, 300))
        if d % 3:
            words = items[rng.randrange(40)][1].split()
            for _ in range(rng.randint(0, int(0.15 * len(words)))):
                at = rng.randrange(len(words))
                if rng.random() < 0.4:
                    words[at] = rng.choice(vocabulary)
                elif rng.random() < 0.5:
                    del words[at]
                else:
                    words.insert(at, rng.choice(vocabulary))
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() for w in words]
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (902, " \n "), (903, "some Rare word"), (904, "x " * 100_000)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs[:-1], items)
    for block in (5000, 10):
        got = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, bench, block=block).collect()}
        assert got <= want
        assert len(got) >= 0.97 * len(want)
    exact = {(d, i) for d, t in docs[:-1] for i, x in items if x and x.strip() and x.lower() in (t or "").lower() and i != 43}
    assert exact <= got and (903, 43) in got
    left = decontaminate.clean(frame, bench)
    assert left.columns == ["doc_id", "text", "item_id"]
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs, none).count() == 0
    item = spark.createDataFrame([(7, "b c d e")], "item_id long, text string")
    assert decontaminate.matches(docs.limit(0), item).count() == 0
    rows = decontaminate.matches(docs, item).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.edits, r.first_word, r.last_word) for r in rows) == [(0, 7, 0, 1, 4), (1, 7, 0, 1, 4)]
    assert [r.doc_id for r in decontaminate.clean(docs, item).collect()] == [None]


@pytest.mark.parametrize("n", [60, 401, 2000])
def test_recall_of_edited_copies_of_any_length(n):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i in range(8)]
    index = decontaminate.Index(items, 0.2, 16, 3, 11)
    found = 0
    for i, text in items:
        own = text.split()
        for _ in range(n // 10):  # a tenth of the words edited
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], [rng.choice(words)], [own[at], rng.choice(words)]])
        hits = index.search([" ".join(rng.choices(words, k=50) + own + rng.choices(words, k=50))])
        found += any(h[1] == i for h in hits)
    assert found >= 7
