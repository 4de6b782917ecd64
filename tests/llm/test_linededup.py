import random

import pytest
from quillstone.llm import linededup
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, n_chars long, left string, runs int"


def frame(spark, texts):
    rows = [(i, t, len(t or ""), "clash", 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng):
    return " ".join(rng.choices("ab cd ef gh ij kl mn op".split(), k=rng.randint(5, 9))).capitalize() + f" x{rng.randrange(10**9)}."


def dedup(spark, texts, **how):
    return {r.doc_id: r.text for r in linededup.dedup(frame(spark, texts), **how).collect()}


def test_lines_join_to_the_text(spark):
    texts = ["A b. C d\ne F\n\ng", "", "Émile À la", " \n \n"]
    got = frame(spark, enumerate(texts)).select(linededup._lines(F.col("text")).alias("x"), "text").collect()
    assert all("".join(r.x) == r.text for r in got)
    assert got[0].x == ["A b. ", "C d\n", "e F\n\n", "g"]


def brute(texts, min_words=20):
    """Lines that lie in an unbroken run seen before, of enough words, by the plain definition."""
    import re

    cut = {i: re.sub(r"(\n|[.!?] | (?=[A-Z]))", "\\1\x01", t).split("\x01") for i, t in texts}
    seen, out = {}, {}
    for i, _ in sorted(texts):
        bare = [x.strip(" \t\n\r") for x in cut[i]]
        dup = [b in seen for b in bare]
        for b in bare:
            seen.setdefault(b, i)
        kept, k = [], 0
        while k < len(dup):
            e = k
            while e < len(dup) and dup[e] == dup[k]:
                e += 1
            if not dup[k] or sum(len(x.split()) for x in bare[k:e]) < min_words:
                kept += cut[i][k:e]
            k = e
        out[i] = "".join(kept)
    return out


def test_passages_go_from_later_documents(spark):
    rng = random.Random(5)
    texts = []
    passages = [" ".join(sentence(rng) for _ in range(7)) for _ in range(6)]
    for i in range(60):
        body = [sentence(rng) for _ in range(rng.randint(1, 30))]
        if i % 2:
            body.insert(rng.randrange(len(body)), f"lower words {i} before " + rng.choice(passages) + f" and {i} after")
        texts.append((i, rng.choice([" ", "\n"]).join(body)))
    texts.append((100, texts[3][1]))
    got = dedup(spark, texts)
    assert got == brute(texts)
    assert got[100] == "" and sum(p in t for t in got.values() for p in passages) <= 6


def test_repeats_within_a_document(spark):
    rng = random.Random(6)
    run = "\n".join(sentence(rng) for _ in range(6))
    got = dedup(spark, [(1, f"{run}\nOnce only.\n{run}")])
    assert got[1].strip() == f"{run}\nOnce only."
    # A line over and over: the first one stays.
    got = dedup(spark, [(1, "The same line again.\n" * 40)])
    assert got[1] == "The same line again.\n"


def test_short_runs_and_clean_documents_stay(spark):
    rng = random.Random(8)
    texts = [(i, "Licensed under CC BY 4.0.\n" + "\n".join(sentence(rng) for _ in range(8))) for i in range(20)]
    assert dedup(spark, texts) == dict(texts)


def test_defined_results(spark):
    assert linededup.dedup(frame(spark, [])).count() == 0
    rng = random.Random(9)
    run = "\n".join(sentence(rng) for _ in range(9))
    rows = [(None, run), (None, run), (1, run), (2, None), (3, ""), (4, run), (4, run), (5, "\n" * 50), (6, "x" * 200_000)]
    frame_ = frame(spark, rows)
    got = sorted(((r.doc_id or 0, r.text, r.n_chars, r.left, r.runs) for r in linededup.dedup(frame_).collect()), key=str)
    want = [(0, run), (0, run), (1, run), (2, None), (3, ""), (4, ""), (4, ""), (5, "\n" * 50), (6, "x" * 200_000)]
    assert got == sorted(((i, t, len(t or ""), "clash", 1) for i, t in want), key=str)
    with pytest.raises(ValueError):
        linededup.runs(frame_, window=4, reach=3)


def test_no_python_on_the_main_path(spark):
    plan = linededup.dedup(frame(spark, [(1, "A b.")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def words_of(rng, n):
    return ["".join(rng.choices("abcdefghiklmnorstu", k=rng.randint(2, 8))) for _ in range(n)]


def said(rng, n, parts):
    """n words in `parts` long sentences."""
    words = words_of(rng, n)
    size = -(-n // parts)
    return " ".join(" ".join(words[i : i + size]).capitalize() + "." for i in range(0, n, size))


def longest_shared(a, b):
    """Words of the longest passage that two texts have in common."""
    import difflib

    return difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).find_longest_match().size


@pytest.mark.parametrize("parts", [0, 1, 2, 3])
def test_short_passages_of_long_sentences(spark, parts):
    rng = random.Random(30 + parts)
    texts, pairs = [], []
    for i in range(20):
        n = rng.randint(51, 60)
        passage = said(rng, n, parts) if parts else " ".join(words_of(rng, n))
        for doc in (i, 100 + i):
            if parts:
                texts.append((doc, f"{said(rng, 40, 2)} {passage} {said(rng, 40, 2)}"))
            else:  # in the middle of a sentence
                texts.append((doc, f"{said(rng, 30, 1)[:-1]} {passage} {' '.join(words_of(rng, 25))}."))
        pairs.append((i, 100 + i))
    texts.sort()
    got = dedup(spark, texts)
    assert all(got[i] == t for i, t in texts if i < 100)
    # At the ends of a passage in a sentence some words up to the next cut stay.
    assert max(longest_shared(got[a], got[b]) for a, b in pairs) < (20 if parts == 0 else 2)


def test_lines_in_other_contexts_hide_nothing(spark):
    rng = random.Random(40)
    run = [sentence(rng) for _ in range(12)]
    # Every line of the run occurs earlier on its own.
    early = list(enumerate(run))
    texts = [*early, (50, "\n".join(run)), (60, f"Own first.\n{chr(10).join(run)}\nOwn last.")]
    got = dedup(spark, texts)
    assert got == dict(texts) | {60: "Own first.\nOwn last."}


def test_only_texts_that_change_are_shuffled(spark, monkeypatch):
    rng = random.Random(41)
    line, run = "Some words that very many of these texts have. And more of them here.", " ".join(sentence(rng) for _ in range(6))
    texts = [(i, f"{sentence(rng)} {line} {sentence(rng)} {run if i in (3, 40) else sentence(rng)}") for i in range(60)]
    seen, parted = [], linededup.parted
    monkeypatch.setattr(linededup, "parted", lambda docs, wanted: seen.extend(r.doc_id for r in wanted.collect()) or parted(docs, wanted))
    got = dedup(spark, texts)
    assert {i for i, t in texts if got[i] != t} == set(seen) == {40}


def test_longest_run_of_windows(spark):
    rng = random.Random(42)
    for window in (1, 2, 3):
        words = [rng.randint(1, 10) for _ in range(60)]
        at = sorted(rng.sample(range(60 - window), 25))
        hits = [(i << linededup.AT) + (words[i] << linededup.AT // 2) + sum(words[i : i + window]) for i in at]
        lines = {i + k for i in at for k in range(window)}
        runs, now = [], 0
        for i in range(61):
            now = now + words[i] if i in lines else runs.append(now) or 0
        got = spark.createDataFrame([(hits,)], "hits array<long>").select(linededup._longest(F.col("hits"), window)).first()[0]
        assert got == max(runs) if window < 3 else got >= max(runs)


def test_words_behind_tabs_and_columns_of_any_name(spark):
    words = words_of(random.Random(43), 30)
    few = "  ".join(words[:19])
    rows = [(i, t, 7) for i, t in enumerate(["\t".join(words)] * 2 + [few] * 2)]
    got = {r.doc_id: (r.text, r.whole) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string, whole int")).collect()}
    assert got == {0: ("\t".join(words), 7), 1: ("", 7), 2: (few, 7), 3: (few, 7)}


def test_lines_are_those_of_the_plain_pattern(spark):
    word = r"\S++(?<![^\p{Lu}\p{P}][.!?])[ \t]++(?!\p{Lu}\p{Ll}\S*+(?: \p{Ll}\S*+){3})"
    plain = rf"\s*+((?:{word}){{0,2}}+(?:(?!\S{{3,4}}\s){word}){{0,7}}+\S++)\s*+|\s++"
    rng = random.Random(44)
    bits = "a of the four Five SIX É Été \U0001f600 \U0001f600. A. a. b! U.S. ... ? ab, cd efg hijk lmnop".split() + [" ", "  ", "\t", "\n", "\x0b", "\r\n", " ", ""]
    texts = ["".join(x + rng.choice(["", " ", " ", " ", "\t"]) for x in rng.choices(bits, k=rng.randint(0, 60))) for _ in range(600)]
    found = frame(spark, enumerate([*texts, ".", "! Ab cd ef gh ij"])).select("text", *(F.regexp_extract_all("text", F.lit(plain), F.lit(k)).alias(f"p{k}") for k in (0, 1)), *(linededup._lines(F.col("text"), k).alias(f"l{k}") for k in (0, 1)))
    assert all((r.p0, r.p1) == (r.l0, r.l1) for r in found.collect())


@pytest.mark.parametrize("window", [1, 2, 3])
def test_fingerprints_are_the_least_of_each_window(spark, window):
    rng, few = random.Random(45), 1 << 62
    rows = [(i, [rng.randrange(9) + rng.choice([0, 0, few]) for _ in range(rng.randint(window, 40))]) for i in range(50)]
    values = spark.createDataFrame(rows, "doc long, v array<long>")
    want = set()
    for doc, v in rows:
        for at in range(len(v) - window + 1):
            m = min(v[at : at + window])
            if m >= few:
                want.add((doc, at, None))  # a hash of the window
            elif not at or m != min(v[at - 1 : at - 1 + window]) or m == v[at + window - 1]:
                want.add((doc, at, m))
    got = linededup._fingerprints(values, window).collect()
    assert {(r.doc, r.at, r.h if 0 <= r.h < few and r.h < 9 else None) for r in got} == want and len(got) == len(want)


def test_fingerprints_are_compiled_and_joined_without_sorting(spark, monkeypatch):
    rng = random.Random(46)
    run = " ".join(sentence(rng) for _ in range(6))
    plans, cut = [], linededup.cut
    monkeypatch.setattr(linededup, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    got = dedup(spark, [(i, f"{sentence(rng)} {run} {sentence(rng)}") for i in range(4)])
    assert sum(run in t for t in got.values()) == 1
    # Functions over arrays run uncompiled, and a Generate that holds one does too.
    assert not any("Generate" in line and "lambda" in line for p in plans for line in p.splitlines())
    assert sum("ShuffledHashJoin" in p for p in plans) == 2
