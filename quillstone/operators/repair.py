"""Repairs. Structural ones act on the whole table; fitted ones learn on the training half."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions.text import ROW_ID, quoted
from quillstone.operators import anomalies
from quillstone.operators.profile import kind_of
from quillstone.plans import planner
from quillstone.sources.reader import unique_names

SEED, TEST_SIZE, NO_LABEL = 20260827, 0.2, "__missing__"


def data(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c != ROW_ID]


def is_text(frame: DataFrame, name: str) -> bool:
    return kind_of(dict(frame.dtypes).get(name, "")) == "text"


def clean_names(names: list[str]) -> list[str]:
    tidy = [re.sub(r"\s+", " ", c).strip() for c in names]
    return unique_names(tidy)[0]


def clean_column_names(frame: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names = data(frame)
    new = dict(zip(names, clean_names(names), strict=True))
    return frame.toDF(*[new.get(c, c) for c in frame.columns]), {a: b for a, b in new.items() if a != b}


def drop_empty_rows(frame: DataFrame) -> DataFrame:
    return frame.filter(F.coalesce(*[quoted(c).cast("string") for c in data(frame)]).isNotNull())


def drop_rows(frame: DataFrame, rows: list[int]) -> DataFrame:
    """By row id, never by place."""
    return frame.filter(~F.col(ROW_ID).isin(*rows)) if rows else frame


def parse_numeric(frame: DataFrame, columns: list[str]) -> DataFrame:
    own = [c for c in columns if is_text(frame, c)]
    if not own:
        return frame
    commas = frame.agg(*[F.coalesce(F.bool_or(X.comma_decimal(X.real(quoted(c)))), F.lit(False)) for c in own]).first()
    return frame.withColumns({c: X.unmarked_number(quoted(c), commas[i]) for i, c in enumerate(own)})


def spellings(frame: DataFrame, column: str) -> DataFrame:
    """(key, best): the commonest tidy spelling of each key; ties go by the alphabet."""
    c = quoted(column)
    votes = frame.filter(c.isNotNull()).groupBy(X.normalise(c).alias("key"), X.tidy(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # The smallest of (-n, v) is the winner, without sorting a group.
    return votes.groupBy("key").agg(F.min(F.struct(-F.col("n"), F.col("v").alias("v")))["v"].alias("best"))


def normalise_categories(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Every spelling of a label becomes the commonest one; spacing is tidied before the vote."""
    out, order = frame, frame.columns
    for column in columns:
        if is_text(frame, column):
            best = spellings(frame, column).select(F.col("key").alias("__key"), F.col("best").alias("__best"))
            # The planner picks the join: labels are few, but a column of free text may not be.
            out = out.withColumn("__own", X.normalise(quoted(column))).join(best, F.col("__own") == F.col("__key"), "left")
            out = out.withColumn(column, F.when(quoted(column).isNotNull(), F.col("__best"))).drop("__own", "__key", "__best")
    return out.select([quoted(c) for c in order])


def replace_disguised_missing(frame: DataFrame, columns: list[str], *, tokens=(), numeric_values=(), replace_infinite: bool = False) -> DataFrame:
    folded = [str(t).strip().lower() for t in tokens]
    new: dict[str, Column] = {}
    for c in columns:
        if c not in frame.columns:
            continue
        if is_text(frame, c):
            gone = F.lower(X.strip(quoted(c))).isin(*folded) if folded else F.lit(False)
        else:
            gone = quoted(c).isin(*numeric_values) if numeric_values else F.lit(False)
            if replace_infinite:
                gone = gone | (F.abs(quoted(c).cast("double")) == float("inf"))
        new[c] = F.when(~F.coalesce(gone, F.lit(False)), quoted(c))
    return frame.withColumns(new) if new else frame


def drop_duplicate_rows(frame: DataFrame) -> DataFrame:
    """Of equal rows the one with the smallest row id stays (dropDuplicates keeps any)."""
    names, order = data(frame), frame.columns
    first = frame.groupBy(*[quoted(c) for c in names]).agg(F.min(ROW_ID).alias(ROW_ID))
    return first.select([quoted(c) for c in order])


def drop_rows_missing_target(frame: DataFrame, target: str) -> DataFrame:
    return frame.filter(quoted(target).isNotNull()) if target in frame.columns else frame


def split(frame: DataFrame, target: str | None = None, *, test_size: float = TEST_SIZE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test), stratified: of each label, round(n * test_size) rows by a hash order of the row id.

    No label is sorted in one task: only a slice of the hashes around the boundary
    is ranked. The hash is a number from 0 to 2^32 - 1 that halves nothing but orders rows.
    """
    label = F.coalesce(quoted(target).cast("string"), F.lit(NO_LABEL)) if target else F.lit("")
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(ROW_ID).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    keyed = frame.select(ROW_ID, label.alias("__label"), order.alias("__o"))
    # Hash orders are cut to 1,024 bins; the bin that holds the boundary is ranked exactly.
    bins = keyed.groupBy("__label", F.shiftright("__o", 22).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    run = Window.partitionBy("__label").orderBy("bin")
    total = Window.partitionBy("__label")
    bins = bins.withColumn("before", F.sum("n").over(run) - F.col("n")).withColumn("all", F.sum("n").over(total))
    wanted = F.when(F.col("all") < 2, 0).otherwise(F.bround(F.col("all") * F.lit(test_size)).cast("long"))
    bins = bins.withColumn("wanted", wanted)
    placed = keyed.withColumn("bin", F.shiftright("__o", 22)).join(bins.select("__label", "bin", "n", "before", "wanted"), ["__label", "bin"])
    sure = placed.filter(F.col("before") + F.col("n") <= F.col("wanted")).select(ROW_ID)
    edge = placed.filter((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("n") > F.col("wanted")))
    rank = Window.partitionBy("__label").orderBy("__o", ROW_ID)
    edge = edge.withColumn("r", F.row_number().over(rank)).filter(F.col("before") + F.col("r") <= F.col("wanted")).select(ROW_ID)
    test_ids = sure.unionByName(edge).cache()
    return frame.join(test_ids, ROW_ID, "left_anti"), frame.join(test_ids, ROW_ID, "left_semi")


def fit_impute(train: DataFrame, columns: list[str], *, strategy: str = "auto", group_by: str | None = None) -> dict:
    """Fill values learnt on the training half: median, mean or the commonest value (ties: first seen)."""
    kinds = {c: kind_of(dict(train.dtypes)[c]) for c in columns if c in train.columns}
    use = {c: ("median" if k == "number" else "mode") if strategy == "auto" else strategy for c, k in kinds.items()}
    numeric = [c for c in kinds if kinds[c] == "number" and use[c] in ("median", "mean")]
    fills: dict[str, object] = {}
    if numeric:
        row = train.agg(*[(F.median if use[c] == "median" else F.avg)(quoted(c).cast("double")) for c in numeric]).first()
        fills |= dict(zip(numeric, row, strict=True))
    for c in kinds:
        if c not in numeric:
            counts = train.filter(quoted(c).isNotNull()).groupBy(quoted(c).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("first"))
            top = counts.orderBy(F.desc("n"), "first").limit(1).collect()
            fills[c] = top[0].v if top else None
    medians = None
    grouped = [c for c in numeric if use[c] == "median"]
    if group_by and group_by in train.columns and grouped:
        medians = train.groupBy(quoted(group_by).cast("string").alias("__group")).agg(*[F.median(quoted(c).cast("double")).alias(f"__median_{c}") for c in grouped])
    return {"fills": fills, "medians": medians, "group_by": group_by, "grouped": grouped if medians is not None else []}


def apply_impute(frame: DataFrame, fitted: dict, *, add_indicator: bool = False) -> DataFrame:
    """Gaps filled; with add_indicator, <column>_was_missing on every half alike."""
    order, fills = frame.columns, {c: v for c, v in fitted["fills"].items() if c in frame.columns}
    out = frame
    if fitted["medians"] is not None and fitted["group_by"] in frame.columns:
        out = out.join(fitted["medians"], quoted(fitted["group_by"]).cast("string") == F.col("__group"), "left")
    new, flags = {}, {}
    for c, v in fills.items():
        options = [quoted(c)]
        if c in fitted["grouped"] and fitted["group_by"] in frame.columns:
            options.append(quoted(f"__median_{c}"))
        if v is not None:
            options.append(F.lit(v))
        new[c] = F.coalesce(*options)
        if add_indicator:
            flags[f"{c}_was_missing"] = quoted(c).isNull().cast("tinyint")
    kept = [(new[c] if c in new else quoted(c)).alias(c) for c in order]
    return out.select(*kept, *[e.alias(c) for c, e in flags.items()])


@dataclass
class Applied:
    action: str
    detail: dict
    rows_before: int
    rows_after: int


@dataclass
class Cleaned:
    train: DataFrame
    test: DataFrame
    applied: list[Applied] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    target: str | None = None

    @property
    def frame(self) -> DataFrame:
        return self.train.unionByName(self.test, allowMissingColumns=True)

    def summary(self) -> dict:
        return {"train": self.train.count(), "test": self.test.count(), "applied": len(self.applied), "skipped": list(self.skipped)}


BEFORE_SPLIT = {
    "drop_empty_rows": lambda f, p: drop_empty_rows(f),
    "drop_rows": lambda f, p: drop_rows(f, p.get("positions", [])),
    "parse_numeric": lambda f, p: parse_numeric(f, p["columns"]),
    "drop_columns": lambda f, p: f.drop(*p["columns"]),
    "normalise_categories": lambda f, p: normalise_categories(f, p["columns"]),
    "replace_disguised_missing": lambda f, p: replace_disguised_missing(
        f, p["columns"], tokens=p.get("tokens", ()), numeric_values=p.get("numeric_values", ()), replace_infinite=p.get("replace_infinite", False)
    ),
    "drop_duplicate_rows": lambda f, p: drop_duplicate_rows(f),
    "drop_rows_missing_target": lambda f, p: drop_rows_missing_target(f, p["target"]),
}


def run(frame: DataFrame, plan: planner.Plan, *, target: str | None = None, test_size: float = TEST_SIZE, seed: int = SEED, add_indicator: bool = True, group_by: str | None = None) -> Cleaned:
    """The plan: structural steps, split, then steps that learn on train and act on both."""
    applied, skipped, n = [], [], frame.count()
    for step in list(plan.stage(planner.BEFORE)):
        if step.action == "clean_column_names":
            frame, names = clean_column_names(frame)
            plan, target = planner.renamed(plan, names), names.get(target, target)
            group_by = names.get(group_by, group_by)
            applied.append(Applied(step.action, {"renamed": names}, n, n))
            continue
        params = next(s for s in plan.steps if s.action == step.action).params
        frame = BEFORE_SPLIT[step.action](frame, params)
        after = frame.count() if "rows" in step.action else n
        applied.append(Applied(step.action, params, n, after))
        n = after
    frame = frame.cache()
    train, test = split(frame, target, test_size=test_size, seed=seed)
    for step in plan.stage(planner.AFTER):
        columns = [c for c in step.columns if c in train.columns and c != target]
        if step.action == "impute":
            fitted = fit_impute(train, columns, strategy=step.params.get("strategy", "auto"), group_by=group_by)
            train, test = (apply_impute(x, fitted, add_indicator=add_indicator) for x in (train, test))
            applied.append(Applied(step.action, {"fills": fitted["fills"]}, n, n))
        elif step.action == "cap_outliers":
            fitted = anomalies.fit_cap(train, columns, step.params.get("method", "iqr"))
            (train, moved), (test, _) = anomalies.apply_cap(train, fitted), anomalies.apply_cap(test, fitted)
            applied.append(Applied(step.action, fitted | {"moved": moved}, n, n))
        else:
            skipped.append(step.action)  # the features do it
    return Cleaned(train, test, applied, skipped, target)


def as_table(spark, cleaned: Cleaned) -> DataFrame:
    rows = [(i, a.action, str(a.detail)[:500], a.rows_before, a.rows_after) for i, a in enumerate(cleaned.applied, 1)]
    return spark.createDataFrame(rows, "`#` int, step string, detail string, rows_before long, rows_after long")
