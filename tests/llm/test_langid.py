import random
from zlib import crc32

import numpy as np
from quillstone.llm import langid

STEMS = {"aa": ["the", "ing", "wh", "ther"], "bb": ["ung", "sch", "der", "keit"], "cc": ["eau", "tion", "que", "oi"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        out.append((i, text(rng, lang, rng.randint(3, 60)), lang))
    return out


def test_codewords():
    assert langid.codewords(4).shape == (4, 7)
    for n in (2, 3, 4, 5, 9, 20):
        code = langid.codewords(n)
        apart = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert apart >= (code.shape[1] + 1) // 2 if n <= 5 else apart >= 5
        assert all(len(set(bit)) == 2 for bit in code.T)


def test_wrong_bits_are_corrected():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.eye(7), np.zeros(7), np.ones(7))
    for i, word in enumerate(code):
        for bit in range(7):
            seen = 3 * word
            seen[bit] *= -1
            assert model.decode(seen)[0] == i
    assert model.decode(np.zeros(7))[2]


def test_held_out_accuracy_and_edges(spark):
    data = rows(400, 1)
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "12 -- 3", "bb"), (None, "the wh ing", "aa"), (903, "schung " * 50_000, None), (0, *data[0][1:])]
    docs = spark.createDataFrame([(*r, 1.0) for r in data + extra], "doc_id long, text string, lang string, score double")
    model = langid.train(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == 406 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by[903].lang_pred == "bb" and by[None].lang_pred == "aa"
    assert np.mean([by[i].lang_pred == lang for i, _, lang in data if by[i].held_out]) > 0.97
    # Held-out languages are never read.
    hidden = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 5 != 0 then lang end as lang")
    assert np.array_equal(langid.train(hidden).weights, model.weights)


def test_no_and_one_language(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "?")], "doc_id long, text string")
    none = langid.train(docs.selectExpr("*", "cast(null as string) lang"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    one = langid.train(docs.selectExpr("*", "'xx' lang"))
    assert sorted(r.lang_pred for r in langid.predict(docs, one).collect()) == ["und", "xx", "xx"]
    assert langid.predict(docs.limit(0), one).count() == 0
