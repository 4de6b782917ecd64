"""The checks: one for each defect.

A check asks its context for measures. Measures of all checks are gathered first and
worked out together, so twenty checks cost a few jobs; only what needs a shuffle of
its own (duplicates, spellings, layouts, pairs of columns) runs alone.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions.text import ROW_ID, quoted
from quillstone.operators import anomalies
from quillstone.operators.findings import CHECKS, Finding, Suggestion, check
from quillstone.operators.profile import TEXT_LIKE, Profile, data_columns, finite, measured, profile_frame

#: Numbers that stand for "no value", and labels of a totals row.
SENTINELS = (-999.0, -9999.0, -99999.0, 999.0, 9999.0, 99999.0)
TOTAL_WORDS = ("total", "totals", "sum", "subtotal", "grand total", "общо", "всичко", "сума", "итого")
SKEWED, MAX_PAIR_COLUMNS, MAX_PAIR_DISTINCT = 1.0, 40, 1000
HUMAN_NUMBERS, MOJIBAKE_RATE, STUB, STUB_RATIO = 0.90, 0.02, 2, 3.0


class Context:
    """A table, its profiles and the measures that the checks share."""

    def __init__(self, frame: DataFrame, profiles: list[Profile]):
        self.frame, self.profiles = frame, profiles
        self.n = profiles[0].n_rows if profiles else frame.count()

    def texts(self) -> list[Profile]:
        return [p for p in self.profiles if p.kind == "text" and p.semantic_type in TEXT_LIKE]

    def numbers(self) -> list[Profile]:
        return [p for p in self.profiles if p.semantic_type == "numeric" and p.kind in ("number", "text")]

    def value(self, p: Profile) -> Column:
        """The column as a number."""
        return X.number(quoted(p.name)) if p.kind == "text" else quoted(p.name).cast("double")

    @cached_property
    def found(self) -> dict[str, object]:
        measures: dict[str, Column] = {}

        def put(p: Profile, **more: Column) -> None:
            measures.update({f"{p.name}\0{k}": e for k, e in more.items()})

        for p in self.profiles:
            c = quoted(p.name)
            if p.kind == "text":
                token = X.is_token(c)
                put(p, tokens=F.count_if(token), spelled=F.sort_array(F.collect_set(F.when(token, X.strip(c)))))
            if p in self.texts():
                length = F.length(X.strip(c))
                real = X.real(c)
                put(
                    p, strays=F.count_if(X.number(real).isNull() & real.isNotNull()), real=F.count(real), spaced=F.count_if((c != X.strip(c)) | c.rlike(r"(?U)\s\s")),
                    control=F.count_if(c.rlike(r"\p{Cc}")), letters=F.sum(F.length(c)), stubs=F.count_if(real.isNotNull() & (length <= STUB)),
                    damaged=F.count_if(c.rlike("|".join(X.MOJIBAKE))), damage=F.sum(sum((F.regexp_count(c, F.lit(m)) for m in X.MOJIBAKE), F.lit(0))),
                    commas=F.bool_or(X.comma_decimal(real)), plain=F.avg(F.when(real.isNotNull(), X.number(real).isNotNull().cast("double"))),
                    **{f"mark{i}": F.bool_or(e) for i, e in enumerate(X.marks_in(real).values())},
                )
            elif p.kind == "text":
                real = X.real(c)
                put(p, strays=F.count_if(X.number(real).isNull() & real.isNotNull()), real=F.count(real))
            if p.semantic_type == "numeric":
                v = finite(self.value(p))
                put(p, min=F.min(v), max=F.max(v), n=F.count(v), infinite=F.count_if(F.abs(self.value(p)) == float("inf")))
        names = data_columns(self.frame)
        measures["\0blank"] = F.count_if(F.coalesce(*[quoted(c).cast("string") for c in names]).isNull()) if names else F.lit(0)
        return measured(self.frame, measures)

    def of(self, p: Profile, name: str):
        return self.found[f"{p.name}\0{name}"]

    @cached_property
    def outside(self) -> dict[str, dict]:
        """Quartiles, medians and what lies outside, by numeric column."""
        return anomalies.measures(self.frame, {p.name: finite(self.value(p)) for p in self.numbers() if self.of(p, "n") >= anomalies.LEAST})

    def copies(self, columns: list[Column]) -> int:
        """Rows that equal an earlier one in the columns; nulls are equal."""
        groups = self.frame.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(columns)]).agg(F.count(F.lit(1)).alias("n"))
        return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]

    def finding(self, name: str, severity: str, topic: str, columns: list[str], rows: int, message: str, action: str | None = None, params: dict | None = None, why: str = "", **evidence) -> Finding:
        suggestion = Suggestion(action, params if params is not None else {"columns": list(columns)}, why) if action else None
        return Finding(name, severity, topic, message, list(columns), rows, rows / self.n if self.n else 0.0, evidence, suggestion)


@check("column_names")
def column_names(x: Context):
    names = [p.name for p in x.profiles]
    bad = [c for c in names if c != c.strip() or re.search(r"[\r\n]", c) or re.search(r"\.\d+$", c) or names.count(c) > 1]
    if bad:
        yield x.finding("column_names", "medium", "structure", bad, 0, f"headers need cleaning: {bad}", "clean_column_names", why="later steps address columns by name")


@check("disguised_missing")
def disguised_missing(x: Context):
    for p in x.profiles:
        if p.kind == "text" and (n := x.of(p, "tokens")):
            tokens = list(x.of(p, "spelled"))
            params = {"columns": [p.name], "tokens": tokens}
            yield x.finding("disguised_missing", "critical", "missing", [p.name], n, f"'{p.name}' holds {n} blanks in disguise: {tokens}", "replace_disguised_missing", params, "a blank that counts as a value hides from every later step", tokens=tokens, count=n)


@check("numeric_in_text")
def numeric_in_text(x: Context):
    for p in x.texts():
        if not x.of(p, "real") or x.of(p, "plain") >= 0.5:
            continue
        marks = [m for i, m in enumerate((*X.SPACING_MARKS, *X.UNIT_MARKS)) if x.of(p, f"mark{i}")]
        if x.of(p, "commas"):
            marks.append(",")
        if not marks:
            continue
        real = X.real(quoted(p.name))
        number = X.unmarked_number(real, bool(x.of(p, "commas")))
        share, n = x.frame.agg(F.avg(F.when(real.isNotNull(), number.isNotNull().cast("double"))), F.count(number)).first()
        if share >= HUMAN_NUMBERS:
            yield x.finding("numeric_in_text", "high", "structure", [p.name], n, f"'{p.name}' holds numbers written for people", "parse_numeric", {"columns": [p.name], "marks": marks}, "a number kept as text can't be computed with", share=share, marks=marks)


@check("encoding_damage")
def encoding_damage(x: Context):
    for p in x.texts():
        letters, damage = x.of(p, "letters") or 0, x.of(p, "damage") or 0
        if letters and damage / letters >= MOJIBAKE_RATE:
            yield x.finding("encoding_damage", "high", "structure", [p.name], x.of(p, "damaged"), f"'{p.name}' looks decoded twice", rate=damage / letters)


@check("mixed_date_formats")
def mixed_date_formats(x: Context):
    for p in x.profiles:
        if p.kind != "text" or p.semantic_type not in (*TEXT_LIKE, "datetime") or x.of(p, "real") < 4:
            continue
        values = x.frame.select(X.real(quoted(p.name)).alias("v")).filter("v is not null").groupBy("v").count()
        rows = values.groupBy(X.layout(F.col("v")).alias("layout")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("count").alias("n")).collect()
        read = {r.layout: r.kinds for r in rows if r.layout}
        if len(read) >= 2 and sum(read.values()) >= 0.8 * sum(r.kinds for r in rows):
            order = [label for _, label in X.DATE_LAYOUTS if label in read]
            yield x.finding("mixed_date_formats", "high", "structure", [p.name], sum(r.n for r in rows if r.layout), f"'{p.name}' mixes date layouts: {order}", layouts={k: read[k] for k in order})


@check("numeric_sentinel")
def numeric_sentinel(x: Context):
    wanted = [(p, v) for p in x.numbers() if x.of(p, "n") >= 4 for v in sorted({x.of(p, "min"), x.of(p, "max")}) if v in SENTINELS]
    measures = {}
    for p, v in wanted:
        value = finite(x.value(p))
        rest = ~value.isin(x.of(p, "min"), x.of(p, "max"))
        measures |= {f"{p.name}\0{v}\0n": F.count_if(value == v), f"{p.name}\0{v}\0low": F.min(F.when(rest, value))}
    found = measured(x.frame, measures)
    for p, v in wanted:
        n, low = found[f"{p.name}\0{v}\0n"], found[f"{p.name}\0{v}\0low"]
        if n < 2:
            continue
        sure = v < 0 and low is not None and low >= 0
        params = {"columns": [p.name], "numeric_values": [v]}
        yield x.finding("numeric_sentinel", "high" if sure else "medium", "missing", [p.name], n, f"'{p.name}' holds {v:g} {n} times at the end of its range", "replace_disguised_missing" if sure else None, params, "a number that stands for no value moves every statistic", value=v, count=n)


@check("infinite_values")
def infinite_values(x: Context):
    for p in x.numbers():
        if n := x.of(p, "infinite"):
            yield x.finding("infinite_values", "high", "anomalies", [p.name], n, f"'{p.name}' holds {n} infinite values", "replace_disguised_missing", {"columns": [p.name], "replace_infinite": True}, count=n)


@check("missing_values")
def missing_values(x: Context):
    for p in x.profiles:
        if p.n_missing and p.semantic_type != "empty":
            share = p.missing_share
            severity = "high" if share > 0.5 else "medium" if share > 0.05 else "low"
            strategy = "median" if p.semantic_type == "numeric" else "mode"
            yield x.finding("missing_values", severity, "missing", [p.name], p.n_missing, f"'{p.name}' misses {share:.1%}", "impute", {"columns": [p.name], "strategy": strategy}, count=p.n_missing)


@check("mixed_types")
def mixed_types(x: Context):
    for p in x.profiles:
        if p.kind == "text" and p.semantic_type not in ("numeric", "empty", "constant", "datetime") and x.of(p, "real"):
            strays, real = x.of(p, "strays"), x.of(p, "real")
            if 0.05 <= 1 - strays / real <= 0.95:
                yield x.finding("mixed_types", "high", "structure", [p.name], strays, f"'{p.name}' mixes numbers and words", numeric_share=1 - strays / real)


@check("uninformative_columns")
def uninformative_columns(x: Context):
    dead = [p for p in x.profiles if p.semantic_type in ("empty", "constant")]
    if dead:
        names = [p.name for p in dead]
        severity = "high" if any(p.semantic_type == "empty" for p in dead) else "medium"
        yield x.finding("uninformative_columns", severity, "structure", names, x.n, f"columns that say nothing: {names}", "drop_columns")


@check("identifier_columns")
def identifier_columns(x: Context):
    names = [p.name for p in x.profiles if p.semantic_type == "identifier"]
    if names:
        yield x.finding("identifier_columns", "medium", "structure", names, x.n, f"columns that only name rows: {names}", "drop_columns")


@check("redundant_columns")
def redundant_columns(x: Context):
    able = [p for p in x.profiles if p.semantic_type in ("categorical", "numeric", "boolean") and 1 < p.n_distinct <= MAX_PAIR_DISTINCT][:MAX_PAIR_COLUMNS]
    gone: set[str] = set()
    for i, a in enumerate(able):
        right = [b for b in able[i + 1 :] if b.name not in gone]
        if a.name in gone or not right:
            continue
        for b in right:
            # Distinct pairs of at most a million, grouped before anything is counted.
            both = x.frame.select(quoted(a.name).alias("a"), quoted(b.name).alias("b")).dropna().distinct()
            if a.n_missing == b.n_missing == 0 and a.n_distinct != b.n_distinct:
                continue
            n, na, nb = both.agg(F.count(F.lit(1)), F.count_distinct("a"), F.count_distinct("b")).first()
            if n and n == na == nb:
                gone.add(b.name)
                yield x.finding("redundant_columns", "medium", "structure", [a.name, b.name], x.n, f"'{b.name}' says the same as '{a.name}'", "drop_columns", {"columns": [b.name]}, kept=a.name)


@check("exact_duplicates")
def exact_duplicates(x: Context):
    n = x.copies([quoted(p.name) for p in x.profiles])
    if n:
        yield x.finding("exact_duplicates", "medium", "duplicates", [], n, f"{n} rows repeat an earlier one", "drop_duplicate_rows", {}, count=n)


@check("normalised_duplicates")
def normalised_duplicates(x: Context):
    texts = [p.name for p in x.profiles if p.kind == "text"]
    if not texts:
        return
    exact = x.copies([quoted(p.name) for p in x.profiles])
    more = x.copies([X.normalise(quoted(p.name)) if p.kind == "text" else quoted(p.name) for p in x.profiles]) - exact
    if more:
        yield x.finding("normalised_duplicates", "medium", "duplicates", texts, more, f"{more} more rows repeat but for spelling", "normalise_categories", additional=more, exact=exact)


@check("inconsistent_categories")
def inconsistent_categories(x: Context):
    for p in x.profiles:
        if p.kind != "text" or p.semantic_type not in ("categorical", "boolean"):
            continue
        raw = x.frame.filter(quoted(p.name).isNotNull()).groupBy(quoted(p.name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        clash = raw.groupBy(X.normalise(F.col("v")).alias("key")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("spellings")).filter("spellings > 1")
        rows, groups = clash.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
        if groups:
            yield x.finding("inconsistent_categories", "medium", "structure", [p.name], rows, f"'{p.name}' spells {groups} labels in several ways", "normalise_categories", groups=groups)


@check("whitespace")
def whitespace(x: Context):
    for p in x.texts():
        if n := x.of(p, "spaced"):
            yield x.finding("whitespace", "medium", "structure", [p.name], n, f"'{p.name}' has stray spacing in {n} values", "normalise_categories", count=n)


@check("control_characters")
def control_characters(x: Context):
    for p in x.texts():
        if n := x.of(p, "control"):
            yield x.finding("control_characters", "medium", "structure", [p.name], n, f"'{p.name}' has control characters in {n} values", "normalise_categories", {"columns": [p.name], "strip_control": True}, count=n)


@check("short_values")
def short_values(x: Context):
    able = [p for p in x.texts() if x.of(p, "real") >= 10 and x.of(p, "stubs")]
    medians = measured(x.frame, {p.name: F.median(F.length(X.real(quoted(p.name)))) for p in able}, 12)
    for p in able:
        if medians[p.name] >= STUB * STUB_RATIO:
            yield x.finding("short_values", "medium", "missing", [p.name], x.of(p, "stubs"), f"'{p.name}' is usually long but has stubs", median_length=medians[p.name])


@check("empty_rows")
def empty_rows(x: Context):
    if n := x.found["\0blank"]:
        yield x.finding("empty_rows", "medium", "structure", [], n, f"{n} rows are blank", "drop_empty_rows", {}, count=n)


def summary_rows_of(frame: DataFrame, labels: list[str], numbers: list[str], n: int) -> DataFrame:
    """(row): ids of the rows at the foot of the table that look like totals."""
    foot = frame.orderBy(F.desc(ROW_ID)).limit(max(3, n // 100))
    named = F.lit(False)
    for c in labels:
        named = named | F.coalesce(X.fold(X.strip(quoted(c))).isin(*TOTAL_WORDS), F.lit(False))
    blank = sum((F.when(quoted(c).isNull() | (X.strip(quoted(c)) == ""), 1).otherwise(0) for c in labels), F.lit(0))
    full = F.lit(bool(numbers))
    for c in numbers:
        full = full & quoted(c).isNotNull()
    hollow = (blank >= len(labels) - 1) & full & F.lit(len(labels) >= 2)
    return foot.filter(named | hollow).select(F.col(ROW_ID).alias("row"))


@check("summary_rows")
def summary_rows(x: Context):
    if x.n < 3 or ROW_ID not in x.frame.columns:
        return
    labels = [p.name for p in x.profiles if p.kind == "text" and p.semantic_type != "numeric"]
    numbers = [p.name for p in x.profiles if p.semantic_type == "numeric"]
    rows = sorted(r.row for r in summary_rows_of(x.frame, labels, numbers, x.n).collect())
    if rows:
        yield x.finding("summary_rows", "high", "structure", [], len(rows), f"{len(rows)} totals rows at the foot", "drop_rows", {"positions": rows}, positions=rows)


@check("outliers")
def outliers(x: Context):
    for p in x.numbers():
        m = x.outside.get(p.name)
        if not m or not (m["by_iqr"] or m["by_mad"]):
            continue
        unsure = m["dominant"] >= anomalies.DOMINANT or not m["iqr"] or not m["mad"] or m["distinct"] < anomalies.LEAST
        rows = max(m["by_iqr"], m["by_mad"])
        method = "iqr" if m["by_iqr"] else "mad"
        keep = {k: m[k] for k in ("by_iqr", "by_mad", "iqr", "mad", "median", "dominant", "distinct")}
        yield x.finding("outliers", "info" if unsure else "low", "anomalies", [p.name], rows, f"'{p.name}': {m['by_iqr']} values by IQR, {m['by_mad']} by MAD", None if unsure else "cap_outliers", {"columns": [p.name], "method": method}, **keep)


@check("high_skew")
def high_skew(x: Context):
    for p in x.numbers():
        skew = p.stats.get("skew")
        if skew is not None and abs(skew) >= SKEWED:
            low = x.of(p, "min")
            yield x.finding("high_skew", "info", "features", [p.name], 0, f"'{p.name}' is skewed ({skew:.2f})", "log_transform" if low is not None and low >= 0 else None, skew=skew)


PROTECTED = ("drop_columns", "parse_numeric", "log_transform", "cap_outliers", "normalise_categories")


def protect_target(findings: list[Finding], target: str) -> list[Finding]:
    """No repair may fill in, drop or reshape the column to be predicted."""
    out = []
    for f in findings:
        s = f.suggestion
        if s is None or target not in (s.params.get("columns") or f.columns):
            out.append(f)
        elif s.action == "impute":
            drop = Suggestion("drop_rows_missing_target", {"target": target}, "a guessed label is worse than a missing row")
            out.append(replace(f, severity="high", message=f"{f.message}; '{target}' is to be predicted, so its rows are dropped", suggestion=drop))
        elif s.action in PROTECTED:
            rest = [c for c in s.params.get("columns") or [] if c != target]
            kept = Suggestion(s.action, s.params | {"columns": rest}, s.rationale) if rest else None
            out.append(replace(f, message=f"{f.message}; '{target}' is to be predicted, so it is left out", suggestion=kept))
        else:
            out.append(f)
    return out


def detect(frame: DataFrame, profiles: list[Profile] | None = None, *, target: str | None = None) -> list[Finding]:
    """All findings, the worst first."""
    x = Context(frame, profiles if profiles is not None else profile_frame(frame))
    found = [f for run in CHECKS.values() for f in run(x)] if x.profiles else []
    if target:
        found = protect_target(found, target)
    return sorted(found, key=lambda f: (f.rank, f.check, f.columns))
