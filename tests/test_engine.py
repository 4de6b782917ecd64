"""One case that fires and one that does not for each operator, on tables made here."""

import random

import numpy as np
import pytest
from quillstone.functions import text as X
from quillstone.functions.text import ROW_ID
from quillstone.operators import anomalies, checks, evidence, features, profile, repair, report, rules
from quillstone.operators.findings import CHECKS, Finding, Suggestion, as_table, summarise
from quillstone.plans import planner
from quillstone.sources.reader import Loaded
from pyspark.sql import functions as F


def frame(spark, schema, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW_ID} long, {schema}")


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (X.strip, "  a\t ", "a"), (X.normalise, " Straße  X ", "strasse x"), (X.number, " 1e3 ", 1000.0), (X.number, "5d", None), (X.number, "NaN", None), (X.number, "-inf", float("-inf")),
        (X.real, " n/A ", None), (X.layout, "31/12/2024", "DD/MM/YYYY"), (X.layout, "5.1.2024", "DD.MM.YYYY"), (X.layout, "soon", None),
        (lambda c: X.unmarked_number(c, True), "1 234,56 лв", 1234.56), (lambda c: X.unmarked_number(c, False), "$100", 100.0), (lambda c: X.date(c).cast("string"), "01/02/2024", "2024-01-02 00:00:00"), (X.date, "1,50", None),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def types(spark, schema, rows):
    return [p.semantic_type for p in profile.profile_frame(frame(spark, schema, rows))]


def test_semantic_types(spark):
    n = 60
    rows = [(None, "EUR", ["yes", "no"][i % 2], f"2024-01-{1 + i % 28:02}", ["r", "g", "b"][i % 3], f"ID-{i}", "a long sentence about nothing, number " + "x" * (i % 25) + str(i), str(i % 37) + ".5", str(1 + i % 4), i % 2, i * 1.5, "?" if i % 2 else "-") for i in range(n)]
    got = types(spark, "a string, b string, c string, d string, e string, f string, g string, h string, i string, j int, k double, l string", rows)
    assert got == ["empty", "constant", "boolean", "datetime", "categorical", "identifier", "text", "numeric", "categorical", "boolean", "numeric", "empty"]


def test_profile_stats(spark):
    f = frame(spark, "x double, v array<double>", [(x, None) for x in (1.0, 2.0, 3.0, 4.0, 100.0, None, float("inf"))])
    x, v = profile.profile_frame(f)
    assert (x.n_missing, x.n_distinct, x.stats["n_infinite"], x.stats["median"]) == (1, 6, 1, 3.0)
    assert x.stats["skew"] == pytest.approx(2.2324, abs=1e-3)
    assert "not supported" in v.note and profile.as_table(spark, [x, v]).count() == 2
    with pytest.raises(ValueError):
        profile.profile_frame(f.select("x", "x"))
    assert profile.profile_frame(f.limit(0))[0].semantic_type == "empty"


def findings(spark, schema, rows, target=None):
    return checks.detect(frame(spark, schema, rows), target=target)


def names(found):
    return {f.check for f in found}


CASES = {
    "column_names": ("`a ` string", [(x,) for x in "abca"]),
    "disguised_missing": ("v string", [(x,) for x in ("Sofia", "?", "Varna", "?") * 3]),
    "numeric_sentinel": ("v double", [(x,) for x in (1.0, 2.0, 3.0, -999.0, 4.0, 5.0, -999.0)]),
    "infinite_values": ("v double", [(x,) for x in (1.0, 2.5, 3.0, float("inf"))]),
    "missing_values": ("v double", [(x,) for x in (1.0, None, 3.0, 2.5)]),
    "uninformative_columns": ("v string, w string", [(None, "x")] * 4),
    "identifier_columns": ("v string", [(f"ORD-{i}",) for i in range(60)]),
    "redundant_columns": ("v string, w int", [("abc"[i % 3], i % 3 + 1) for i in range(30)]),
    "exact_duplicates": ("v int, w string", [(1, "x"), (2, "y"), (1, "x"), (2, "y")]),
    "normalised_duplicates": ("v string", [("Sofia",), ("Sofia",), ("sofia ",), ("Varna",)]),
    "inconsistent_categories": ("v string", [("Sofia",), ("Sofia",), ("sofia",), ("Varna",)] * 3),
    "mixed_types": ("v string", [(x,) for x in ("1", "2", "3", "a", "b") * 6]),
    "numeric_in_text": ("v string", [(x,) for x in ("1 234,56", "$100", "12 lv", "45%") * 5]),
    "whitespace": ("v string", [(x,) for x in ("a ", "b", "c  d") * 6]),
    "control_characters": ("v string", [(x,) for x in ("Sofia\nBulgaria", "Varna", "Ruse") * 6]),
    "short_values": ("v string", [(x,) for x in ["Maria Ivanova", "Petar Petrov", "Ivan Ivanov"] * 6 + ["x"]]),
    "encoding_damage": ("v string", [(x,) for x in ("Ã©tÃ©", "hiver", "Ã©cole") * 6]),
    "mixed_date_formats": ("v string", [(x,) for x in ("2024-01-05", "05.01.2024", "2024-02-06", "06.02.2024") * 3]),
    "empty_rows": ("v string, w double", [("a", 1.0), (None, None), ("b", 2.0)]),
    "summary_rows": ("v string, w double", [(x, float(i)) for i, x in enumerate("abacb")] + [("TOTAL", 99.0)]),
    "outliers": ("v double", [(float(i % 50) + 0.1 * i,) for i in range(200)] + [(5000.0,), (6000.0,)]),
    "high_skew": ("v double", [(2.0 ** (i / 3),) for i in range(40)]),
}


def test_every_check_has_a_case():
    assert set(CASES) == set(CHECKS) and len(CHECKS) == 22


@pytest.mark.parametrize("name", sorted(CASES))
def test_check_fires(spark, name):
    assert name in names(findings(spark, *CASES[name]))


def test_clean_table_has_no_findings(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(100, 10), rng.choice(["Sofia", "Varna", "Ruse"]), rng.choice(["yes", "no"])) for _ in range(300)]
    assert findings(spark, "amount double, city string, paid string", rows) == []


def test_details_of_findings(spark):
    found = findings(spark, *CASES["disguised_missing"])
    assert found[0].severity == "critical" and found[0].evidence["tokens"] == ["?"] and found[0].affected_rows == 6
    cap = findings(spark, "v double", [(0.0,)] * 20 + [(500.0,), (1200.0,), (99999.0,), (99999.0,)])
    assert [f.suggestion for f in cap if f.check == "numeric_sentinel"] == [None]
    short = findings(spark, "v double", [(float(10 + i % 3),) for i in range(300)] + [(1.0,), (16.0,)] * 3)
    assert {(f.severity, f.suggestion) for f in short if f.check == "outliers"} == {("info", None)}
    assert [f.rank for f in cap] == sorted(f.rank for f in cap)
    assert as_table(spark, found).count() == len(found) and summarise(found)["critical"] == 1
    with pytest.raises(ValueError):
        Finding("x", "awful", "missing", "")


def test_target_protection(spark):
    rows = [("a" if i % 2 else "b", None if i % 5 == 0 else f"L{i % 2}") for i in range(40)]
    found = findings(spark, "v string, y string", rows, target="y")
    assert [(f.severity, f.suggestion.action) for f in found if f.check == "missing_values"] == [("high", "drop_rows_missing_target")]
    ids = findings(spark, *CASES["identifier_columns"], target="v")
    assert [f.suggestion for f in ids if f.check == "identifier_columns"] == [None]


R = rules.Rule


@pytest.mark.parametrize(
    "rule,values,kind,bad",
    [
        (R("v", "not_null"), [1, None], "int", [1]), (R("v", "unique"), [1, 2, 1, None, None], "int", [0, 2]), (R("v", "range", {"min": 0, "max": 5}), ["1", "9", "x", None, "5"], "string", [1, 2]),
        (R("v", "allowed_values", {"values": ["a"]}), ["a", "b", None], "string", [1]), (R("v", "pattern", {"regex": "a+"}), ["aab", "ba", None], "string", [1]), (R("v", "type", {"type": "datetime"}), ["2024-01-01", "x", None], "string", [1]),
        (R("v", "type", {"type": "numeric"}), ["1", "5d"], "string", [1]),
    ],
)
def test_rules(spark, rule, values, kind, bad):
    got = rules.validate(frame(spark, f"v {kind}", [(v,) for v in values]), [rule])
    assert sorted(r[ROW_ID] for r in got.rejected.collect()) == bad and got.valid.count() == len(values) - len(bad)
    assert rules.check_rule(frame(spark, f"v {kind}", [(v,) for v in values]), rule).rows == len(bad)


def test_compare_quarantine_and_inert(spark):
    f = frame(spark, "a string, b string, age int", [("2024-01-01", "2024-02-01", 5), ("2024-03-01", "2024-02-01", -1), (None, "2024-01-01", None)])
    inert = [R("a", "range"), R("a", "allowed_values", {"values": []}), R("a", "pattern", {"regex": "("}), R("zzz", "not_null"), R("a", "compare", {"op": "<", "other": "age"}), R("a", "type", {"type": "?"})]
    got = rules.validate(f, [R("a", "compare", {"op": "<=", "other": "b"}), R("age", "range", {"min": 0}), *inert])
    assert got.inert == inert and not rules.is_applicable(f, inert[0])
    assert [r[rules.BECAUSE] for r in got.rejected.collect()] == ["a must be <= b | age must be at least 0"]
    assert got.rejected.columns[0] == rules.BECAUSE and got.summary()["caution"]
    assert rules.violations_table(spark, got).count() == 2 and rules.rules_table(spark, inert).count() == 6


def test_inferred_rules(spark):
    f = frame(spark, "age double, city string", [(20.0 + i, ["Sofia", "Varna", "?"][i % 3]) for i in range(30)])
    got = {(r.column, r.kind): r.params for r in rules.infer_rules(f, profile.profile_frame(f), target="city")}
    assert got["age", "range"] == {"min": 0.0, "max": 51.9} and got["city", "allowed_values"] == {"values": ["Sofia", "Varna"]}


def test_planner():
    make = lambda check, action, **p: Finding(check, "high", "structure", "", suggestion=Suggestion(action, p))
    found = [
        make("a", "impute", columns=["x"], strategy="mode"), make("b", "impute", columns=["n"], strategy="median"), make("c", "replace_disguised_missing", columns=["v", "id"], tokens=["?"]),
        make("d", "drop_columns", columns=["id", "total"]), make("e", "parse_numeric", columns=["total"]), Finding("f", "info", "features", ""), make("g", "log_transform", columns=["id"]),
    ]
    plan = planner.build(found, target="v")
    assert [s.action for s in plan.steps] == ["parse_numeric", "drop_columns", "replace_disguised_missing", "drop_rows_missing_target", "impute"]
    impute = plan.steps[-1]
    assert impute.params == {"columns": ["x", "n", "total"], "strategy": "mode"} and impute.derived_from
    assert plan.steps[1].columns == ["id"] and plan.steps[2].columns == ["v"] and len(plan.unaddressed) == 1
    assert found[0].suggestion.params["columns"] == ["x"]  # findings aren't changed by merging
    assert planner.renamed(plan, {"x": "z"}).steps[-1].columns == ["z", "n", "total"] and planner.build([]).steps == []


def values(f, column="v"):
    return [r[column] for r in f.orderBy(ROW_ID).collect()]


def test_structural_repairs(spark):
    f = frame(spark, "v string", [(x,) for x in ("Varna", "varna ", " Varna", "US", "US", "us", None)])
    assert values(repair.normalise_categories(f, ["v"])) == ["Varna"] * 3 + ["US"] * 3 + [None]
    f = frame(spark, "v string", [(x,) for x in ("1 234,56", "$100", "x", None)])
    assert values(repair.parse_numeric(f, ["v"])) == [1234.56, 100.0, None, None]
    f = frame(spark, "v string, w int", [("a", 1), ("b", 1), ("a", 1), (None, None), (None, None)])
    assert [r[ROW_ID] for r in repair.drop_duplicate_rows(f).orderBy(ROW_ID).collect()] == [0, 1, 3]
    assert repair.drop_empty_rows(f).count() == 3 and repair.drop_rows(f, [0, 3]).count() == 3
    assert repair.drop_rows_missing_target(f, "v").count() == 3 and repair.drop_rows_missing_target(f, "zz").count() == 5
    f = frame(spark, "x double", [(1.0,), (-999.0,), (float("inf"),)])
    assert values(repair.replace_disguised_missing(f, ["x"], numeric_values=[-999.0], replace_infinite=True), "x") == [1.0, None, None]
    f, renamed = repair.clean_column_names(frame(spark, "`city ` string, `a\nb` string, city string", [("a", "b", "c")]))
    assert f.columns[1:] == ["city", "a b", "city__2"] and renamed["city "] == "city"


def test_split(spark):
    f = frame(spark, "y string", [("rare" if i % 20 == 0 else "often",) for i in range(1000)] + [(None,)] * 10 + [("single",)])
    train, test = repair.split(f, "y")
    assert train.count() + test.count() == 1011 and train.join(test, ROW_ID).count() == 0
    assert {r.y: r["count"] for r in test.groupBy("y").count().collect()} == {"rare": 10, "often": 190, None: 2}
    assert {r[ROW_ID] for r in repair.split(f, "y")[1].collect()} == {r[ROW_ID] for r in test.collect()}
    assert repair.split(f, None)[1].count() == 202 and repair.split(f.limit(1))[1].count() == 0


def test_impute(spark):
    f = frame(spark, "x double, v string, g string", [(1.0, "a", "p"), (3.0, "a", "p"), (None, None, "p"), (100.0, "b", "q"), (None, "b", "q"), (None, "a", "r")])
    fitted = repair.fit_impute(f, ["x", "v"], group_by="g")
    assert fitted["fills"] == {"x": 3.0, "v": "a"}
    out = repair.apply_impute(f, fitted, add_indicator=True)
    assert values(out, "x") == [1.0, 3.0, 2.0, 100.0, 100.0, 3.0] and values(out, "x_was_missing") == [0, 0, 1, 0, 1, 1]
    nothing = frame(spark, "x double", [(None,), (None,)])
    assert values(repair.apply_impute(nothing, repair.fit_impute(nothing, ["x"])), "x") == [None, None]


def test_caps(spark):
    rng = random.Random(3)
    f = frame(spark, "x double, flat double, k int", [(rng.gauss(0, 1), 1.0 if i % 2 else float(i % 40), 20 + i % 40) for i in range(300)] + [(9999.0, 1.0, 500)])
    fitted = anomalies.fit_cap(f, ["x", "flat", "k"])
    assert set(fitted["bounds"]) == {"x", "k"} and "flat" in fitted["refused"]
    assert fitted["bounds"]["k"] == tuple(map(float, map(round, fitted["bounds"]["k"])))
    out, moved = anomalies.apply_cap(f, fitted)
    assert moved == 2 and max(values(out, "x")) == fitted["bounds"]["x"][1]
    assert anomalies.comparison(f, "x").count() == 3
    with pytest.raises(ValueError):
        anomalies.bounds_of({}, "other")


def test_no_leak_from_the_test_half(spark):
    base = [(float(i % 50) if i % 7 else None, f"c{i % 3}") for i in range(200)]
    f = frame(spark, "x double, y string", base)
    _, test = repair.split(f, "y")
    held = {r[ROW_ID] for r in test.collect()}
    g = frame(spark, "x double, y string", [(x + 1e6 if i in held and x is not None else x, y) for i, (x, y) in enumerate(base)])
    plan = planner.build([Finding("m", "low", "missing", "", suggestion=Suggestion("impute", {"columns": ["x"], "strategy": "median"}))])
    fills = [repair.run(h, plan, target="y").applied[0].detail["fills"] for h in (f, g)]
    assert fills[0] == fills[1]


def test_features(spark):
    rng = random.Random(4)
    rows = [(2.0 ** (i % 30), 0.0 if i % 10 else float(i), "abc"[i % 3], f"w{i % 30}", "2024-01-06" if i % 2 else "2024-01-08", rng.gauss(5, 2)) for i in range(300)]
    f = frame(spark, "long double, zeros double, few string, many string, day string, n double", rows).withColumn("twice", 2 * F.col("n"))
    p = profile.profile_frame(f)
    got = features.build(f, f.limit(20), p)
    assert "long" in got.logged and got.dates == ["day"] and got.encoded["few"].startswith("one-hot") and got.encoded["many"].startswith("frequency")
    assert [(a, b) for a, b, _ in got.pruned if b == "twice"] == [("n", "twice")] and got.train.columns == got.test.columns
    assert abs(got.train.agg(F.avg("n")).first()[0]) < 1e-9 and features.skew_table(spark, got).count() >= 1
    unseen = features.apply_encode(frame(spark, "few string", [("z",), (None,)]), features.fit_encode(f, ["few"]))
    assert [tuple(r)[1:] for r in unseen.orderBy(ROW_ID).collect()] == [(0, 0, 0), (0, 0, 0)]
    assert features.correlated(f.withColumn("one", F.lit(1.0)), ["n", "one"]) == []


@pytest.mark.parametrize("y,s,want", [([0, 0, 1, 1], [1, 2, 3, 4], 1), ([1, 1, 0, 0], [1, 2, 3, 4], 0), ([0, 1, 0, 1], [1, 1, 1, 1], 0.5), ([0, 1, 0, 1], [1, 2, 3, 4], 0.75), ([1, 1], [1, 2], None)])
def test_auc(spark, y, s, want):
    got = evidence.auc_frame(spark.createDataFrame(list(zip(map(float, s), y, strict=True)), "score double, label int")).first()[0]
    assert got == want and (want is None and np.isnan(evidence.roc_auc(y, s)) or evidence.roc_auc(y, s) == want)


def test_auc_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 30, 200).astype(float)
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    got = evidence.auc_frame(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, label int")).first()[0]
    assert got == pytest.approx(np.mean(pairs)) == pytest.approx(evidence.roc_auc(y, s))


def test_damage_and_verdicts(spark):
    f = frame(spark, "x double, v string, y string", [(float(i), f"v{i % 4}", f"y{i % 2}") for i in range(1000)])
    bad = evidence.corrupt(f, 0.2, target="y")
    n = bad.filter("x = -999").count()
    assert 150 < n < 250 and n == evidence.corrupt(f, 0.2, target="y").filter("x = -999").count()
    assert bad.select("y").exceptAll(f.select("y")).count() == 0 and evidence.naive_baseline(bad).count() < 800
    make = lambda a, b: evidence.Comparison(evidence.Score(a, 1, 1), evidence.Score(b, 1, 1), 0)
    cases = {(0.8, 0.9): "better", (0.9, 0.8): "worse", (0.8, 0.8005): "same", (0.4, 0.45): "chance", (float("nan"), 0.8): "unscorable"}
    assert {k: evidence.verdict(make(*k))[0] for k in cases} == cases


def test_score_and_report(spark):
    rng = random.Random(6)
    f = frame(spark, "x double, v string, y string", [(rng.gauss(i % 2 * 2, 1), "?" if i % 9 == 0 else "ab"[rng.randrange(2)], f"y{i % 2}") for i in range(300)])
    train, test = repair.split(f, "y")
    assert evidence.score_arm(train, test, "y").auc > 0.8
    assert "one class" in evidence.score_arm(train.filter("y = 'y1'"), test, "y").note
    found = checks.detect(f, target="y")
    plan = planner.build(found, target="y")
    done = repair.run(f, plan, target="y")
    assert done.frame.filter("v is null").count() == 0 and done.summary()["train"] == 240 and repair.as_table(spark, done).count() == len(done.applied)
    text = report.build(Loaded(f, "t.csv"), found, plan, cleaned=done)
    assert all(f"## {i}." in text for i in range(1, 9)) and "replace_disguised_missing" in text


def test_stream(spark, tmp_path):
    from quillstone.streaming.quarantine import quarantine

    frame(spark, "v int", [(1,), (None,), (3,)]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(f"{ROW_ID} long, v int").parquet(f"{tmp_path}/in")
    q = quarantine(stream, [R("v", "not_null")], f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 2 and spark.read.parquet(f"{tmp_path}/bad").count() == 1


def test_rule_params_and_defaults(spark):
    f = frame(spark, "a string, b double, c double", [("1", 1.0, 2.0), ("x", 3.0, 2.0), (None, 2.0, 2.0)])
    for name in ("type", "expected"):
        assert rules.check_rule(f, rules.Rule("a", "type", {name: "numeric"})).rows == 1
    assert rules.check_rule(f, rules.Rule("b", "compare", {"other": "c"})).rows == 1  # at most, unless said otherwise


def test_codes_are_counted_without_blanks(spark):
    f = frame(spark, "code string", [(v,) for v in [str(i) for i in range(1, 10)] * 40 + ["?", "NA"]])
    got = profile.profile_frame(f)[0]
    assert (got.semantic_type, got.note, got.n_distinct) == ("categorical", "numbers used as codes", 11)


def test_profiles_leave_nothing_cached(spark):
    held = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = held().size()
    profile.profile_frame(frame(spark, "a string, b double", [("x", 1.0)] * 5))
    assert held().size() == before
