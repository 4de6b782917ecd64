"""A model matrix: transforms learnt on the training half and applied to both."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions.text import ROW_ID, quoted
from quillstone.operators.profile import Profile, finite, kind_of, measured, skew_expression

SKEWED, HALVED, ONE_HOT, RARE, CORRELATED = 1.0, 0.5, 15, 0.01, 0.95


@dataclass
class Features:
    """What was learnt, and the two halves."""

    train: DataFrame
    test: DataFrame
    logged: dict = field(default_factory=dict)
    reverted: dict = field(default_factory=dict)
    dates: list = field(default_factory=list)
    encoded: dict = field(default_factory=dict)
    scaled: dict = field(default_factory=dict)
    pruned: list = field(default_factory=list)

    def summary(self) -> dict:
        return {
            "columns": len([c for c in self.train.columns if c != ROW_ID]), "logged": len(self.logged), "reverted": len(self.reverted),
            "dates": len(self.dates), "encoded": len(self.encoded), "scaled": len(self.scaled), "pruned": len(self.pruned),
        }


def numeric_columns(frame: DataFrame, target: str | None = None) -> list[str]:
    return [c for c, k in frame.dtypes if kind_of(k) == "number" and c not in (target, ROW_ID)]


def fit_log(train: DataFrame, columns: list[str]) -> tuple[dict, dict]:
    """(kept, reverted): {column: (skew, skew of log1p)}; one job, nothing is applied to find out."""
    measures = {}
    for c in columns:
        v = finite(quoted(c))
        measures |= {f"{c}\0min": F.min(v), f"{c}\0old": skew_expression(v), f"{c}\0new": skew_expression(F.log1p(F.when(v >= 0, v))), f"{c}\0zero": F.avg((v == 0).cast("double"))}
    found = measured(train, measures)
    kept, reverted = {}, {}
    for c in columns:
        low, old, new = (found[f"{c}\0{k}"] for k in ("min", "old", "new"))
        if low is None or low < 0 or abs(old) < SKEWED:
            continue
        if abs(new) <= HALVED * abs(old) or abs(new) < SKEWED:
            kept[c] = (old, new)
        else:
            zeros = found[f"{c}\0zero"]
            reverted[c] = f"skew {old:.2f} only became {new:.2f}" + (f"; {zeros:.0%} are zero, which a logarithm can't move" if zeros > 0.5 else "")
    return kept, reverted


def apply_log(frame: DataFrame, kept: dict) -> DataFrame:
    own = {c: F.log1p(quoted(c).cast("double")) for c in kept if c in frame.columns}
    return frame.withColumns(own) if own else frame


def expand_dates(frame: DataFrame, columns: list[str]) -> DataFrame:
    """year, month, weekday (Monday 0) and is_weekend in place of each date; a null date is no weekend."""
    new = {}
    for c in columns:
        d = X.date(quoted(c)) if kind_of(dict(frame.dtypes)[c]) == "text" else quoted(c).cast("timestamp")
        new |= {f"{c}_year": F.year(d), f"{c}_month": F.month(d), f"{c}_weekday": F.weekday(d), f"{c}_is_weekend": F.coalesce((F.weekday(d) >= 5).cast("int"), F.lit(0))}
    return frame.withColumns(new).drop(*columns) if new else frame


def fit_encode(train: DataFrame, columns: list[str]) -> dict:
    """For each column: its kept levels (one-hot), or shares of all levels (frequency)."""
    out = {}
    for c in columns:
        counts = train.filter(quoted(c).isNotNull()).groupBy(quoted(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        total, levels = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        # A kept level has a hundredth of the rows, so there are a hundred at most.
        keep = sorted(r.v for r in counts.filter(F.col("n") >= RARE * total).collect())
        method = "one-hot" if len(keep) <= ONE_HOT else "frequency"
        shares = counts.select("v", (F.col("n") / F.lit(max(1, total))).alias("share")) if method == "frequency" else None
        out[c] = {"method": method, "levels": keep, "pooled": levels - len(keep), "shares": shares}
    return out


def apply_encode(frame: DataFrame, fitted: dict) -> DataFrame:
    for c, how in fitted.items():
        if c not in frame.columns:
            continue
        v = quoted(c).cast("string")
        if how["method"] == "one-hot":
            new = {f"{c}={x}": F.coalesce((v == x).cast("tinyint"), F.lit(0).cast("tinyint")) for x in how["levels"]}
            if how["pooled"]:
                new[f"{c}=other"] = F.coalesce((~v.isin(*how["levels"])).cast("tinyint"), F.lit(1).cast("tinyint")) if how["levels"] else F.lit(1).cast("tinyint")
            frame = frame.withColumns(new).drop(c)
        else:
            shares = how["shares"].select(F.col("v").alias("__v"), F.col("share").alias("__share"))
            joined = frame.join(shares, v == F.col("__v"), "left")
            frame = joined.withColumn(c, F.coalesce("__share", F.lit(0.0))).drop("__v", "__share")
    return frame


def fit_scale(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    found = measured(train, {f"{c}\0{k}": f(finite(quoted(c))) for c in columns for k, f in (("mean", F.avg), ("sd", F.stddev_samp))})
    pairs = {c: (found[f"{c}\0mean"], found[f"{c}\0sd"]) for c in columns}
    return {c: p for c, p in pairs.items() if p[0] is not None and p[1]}


def apply_scale(frame: DataFrame, fitted: dict) -> DataFrame:
    own = {c: (quoted(c).cast("double") - m) / sd for c, (m, sd) in fitted.items() if c in frame.columns}
    return frame.withColumns(own) if own else frame


def correlation(a: Column, b: Column) -> Column:
    """Pearson over rows where both are there; null where one does not vary (corr raises then)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlated(train: DataFrame, columns: list[str]) -> list[tuple[str, str, float]]:
    """(kept, dropped, correlation), greedily in column order; about thirty pairs a job."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    found = measured(train, {f"{a}\0{b}": correlation(finite(quoted(a)), finite(quoted(b))) for a, b in pairs}, 30)
    gone, out = set(), []
    for a, b in pairs:
        r = found[f"{a}\0{b}"]
        if a not in gone and b not in gone and r is not None and abs(r) >= CORRELATED - 1e-12:
            gone.add(b)
            out.append((a, b, round(abs(r), 4)))
    return out


def build(train: DataFrame, test: DataFrame, profiles: list[Profile], *, target: str | None = None, log: bool = True, dates: bool = True, encode: bool = True, scale: bool = True, prune: bool = True) -> Features:
    out = Features(train, test)
    own = [p for p in profiles if p.name != target and p.name in train.columns]
    both = lambda f, *a: (f(out.train, *a), f(out.test, *a))
    if log:
        numeric = numeric_columns(train, target)
        out.logged, out.reverted = fit_log(train, [p.name for p in own if p.semantic_type == "numeric" and p.name in numeric])
        out.train, out.test = both(apply_log, out.logged)
    if dates:
        out.dates = [p.name for p in own if p.semantic_type == "datetime"]
        out.train, out.test = both(expand_dates, out.dates)
    if encode:
        fitted = fit_encode(out.train, [p.name for p in own if p.semantic_type in ("categorical", "boolean")])
        out.train, out.test = both(apply_encode, fitted)
        out.encoded = {c: f"{f['method']} ({len(f['levels'])} kept, {f['pooled']} pooled)" for c, f in fitted.items()}
    if scale:
        out.scaled = fit_scale(out.train, numeric_columns(out.train, target))
        out.train, out.test = both(apply_scale, out.scaled)
    if prune:
        out.pruned = correlated(out.train, numeric_columns(out.train, target))
        gone = [b for _, b, _ in out.pruned]
        out.train, out.test = out.train.drop(*gone), out.test.drop(*gone)
    return out


def skew_table(spark, f: Features) -> DataFrame:
    rows = [(c, a, b, "kept") for c, (a, b) in f.logged.items()] + [(c, None, None, why) for c, why in f.reverted.items()]
    return spark.createDataFrame(rows, "column string, before double, after double, outcome string")
