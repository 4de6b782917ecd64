"""Column profiles: what each column is, from a few aggregations over the whole table.

Cheap measures of many columns share a job; medians have a job of their own, and the
distinct values of a column come from grouping by it, which also gives the top value.
The frame is best cached by the caller if it is costly to compute.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions.text import ROW_ID, quoted

TYPES = ("empty", "constant", "boolean", "numeric", "datetime", "categorical", "identifier", "text")
TEXT_LIKE = ("categorical", "text", "identifier")
NUMERIC_SHARE, DATETIME_SHARE = 0.95, 0.98
MAX_LABELS, MAX_LABEL_SHARE, TOO_MANY_LABELS = 50, 0.05, 0.5
CODES, IDENTIFIER_SHARE, PROSE_LENGTH = 10, 0.95, 40
#: Pairs that say yes and no.
BOOLEANS = ({"true", "false"}, {"yes", "no"}, {"y", "n"}, {"1", "0"}, {"t", "f"}, {"да", "не"})
#: Measures of a job.
WIDE = 60
#: Columns whose values are grouped at a time.
AT_ONCE = 4
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass
class Profile:
    name: str
    semantic_type: str
    dtype: str
    kind: str  # text, number, boolean, date or other
    n_rows: int
    n_missing: int
    n_distinct: int
    note: str = ""
    top_value: object = None
    top_share: float = 0.0
    stats: dict = field(default_factory=dict)
    examples: list = field(default_factory=list)

    @property
    def missing_share(self) -> float:
        return self.n_missing / self.n_rows if self.n_rows else 0.0


def kind_of(dtype: str) -> str:
    if dtype in NUMBERS or dtype.startswith("decimal"):
        return "number"
    return {"string": "text", "boolean": "boolean", "date": "date", "timestamp": "date", "timestamp_ntz": "date"}.get(dtype, "other")


def data_columns(frame: DataFrame) -> list[str]:
    names = [c for c in frame.columns if c != ROW_ID]
    if twice := sorted({c for c in names if names.count(c) > 1}):
        raise ValueError(f"column names must be unique; repeated: {', '.join(twice)}")
    return names


def measured(frame: DataFrame, measures: dict[str, Column], wide: int = WIDE) -> dict[str, object]:
    """All measures by name, `wide` of them a job."""
    out, names = {}, list(measures)
    for at in range(0, len(names), wide):
        part = names[at : at + wide]
        row = frame.agg(*[measures[n].alias(f"m{i}") for i, n in enumerate(part)]).first()
        out |= {n: row[i] for i, n in enumerate(part)}
    return out


def finite(c: Column) -> Column:
    """A number, null where it is infinite or not a number."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def adjusted_skew(g1, n) -> float:
    """Sample skewness from the population's."""
    return float(g1) * (n * (n - 1)) ** 0.5 / (n - 2) if g1 is not None and n and n > 2 else 0.0


def skew_expression(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.lit(0.0))


def value_counts(frame: DataFrame, column: str) -> DataFrame:
    """(v, n, first): each value, how often, and its first row."""
    first = F.min(ROW_ID) if ROW_ID in frame.columns else F.min(quoted(column).cast("string"))
    return frame.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("v")).agg(F.count(F.lit(1)).alias("n"), first.alias("first"))


def _values(frame: DataFrame, column: str, kind: str) -> dict:
    """What is told from the distinct values of a column; they are grouped once."""
    counts = value_counts(frame, column).persist()
    try:
        codes = F.count(X.real(F.col("v"))) if kind == "text" else F.lit(0)
        rank = F.struct(-F.col("n"), F.col("first"))
        found = counts.agg(
            F.count(F.lit(1)).alias("n_distinct"), F.min_by("v", rank).alias("top"), F.max("n").alias("top_n"), F.min("v").alias("low"), F.max("v").alias("high"), codes.alias("n_codes")
        )
        return found.first().asDict() | {"examples": [r.v for r in counts.orderBy("first").limit(5).collect()]}
    finally:
        counts.unpersist()


def _text_measures(c: Column) -> Iterator[tuple[str, Column]]:
    value, real = X.strip(c), X.real(c)
    n = X.number(real)
    yield "n_real", F.count(real)
    yield "numeric_share", F.avg(F.when(real.isNotNull(), n.isNotNull().cast("double")))
    yield "integral", F.bool_and(F.when(n.isNotNull(), n % 1 == 0))
    yield "shaped", F.avg(F.when(real.isNotNull(), real.rlike(X.DATE_SHAPED).cast("double")))
    yield "dates", F.avg(F.when(real.isNotNull(), X.date(real).isNotNull().cast("double")))
    yield "real_length", F.avg(F.length(real))
    yield "mean_length", F.avg(F.length(value))
    yield "max_length", F.max(F.length(value))


def _number_measures(c: Column) -> Iterator[tuple[str, Column]]:
    d = finite(c)
    yield "min", F.min(d)
    yield "max", F.max(d)
    yield "mean", F.avg(d)
    yield "std", F.stddev_samp(d)
    yield "skew", skew_expression(d)
    yield "n", F.count(d)
    yield "pct_zero", F.avg((d == 0).cast("double"))
    yield "n_infinite", F.count_if(F.abs(c.cast("double")) == float("inf"))
    yield "integral", F.bool_and(d % 1 == 0)
    yield "unit", F.bool_and(d.isin(0.0, 1.0))


def profile_frame(frame: DataFrame, columns: list[str] | None = None) -> list[Profile]:
    """Profiles of the columns, in order. Nested columns are reported as unsupported, not read."""
    names, dtypes = columns or data_columns(frame), dict(frame.dtypes)
    kinds = {c: kind_of(dtypes[c]) for c in names}
    measures = {"rows": F.count(F.lit(1))}
    for c in names:
        q = quoted(c)
        q = F.nanvl(q, F.lit(None).cast(dtypes[c])) if dtypes[c] in ("double", "float") else q
        measures[f"{c}\0present"] = F.count(q)
        own = _text_measures(q) if kinds[c] == "text" else _number_measures(q) if kinds[c] == "number" else ()
        measures |= {f"{c}\0{k}": e for k, e in own}
    found = measured(frame, measures)
    medians = {c: F.median(finite(quoted(c))) for c in names if kinds[c] == "number"}
    medians = measured(frame, medians, 12)
    n_rows, whole_rows = found["rows"], None
    with ThreadPoolExecutor(AT_ONCE) as pool:  # the jobs of a column are small; some run at a time
        read = [c for c in names if kinds[c] != "other"]
        values = dict(zip(read, pool.map(lambda c: _values(frame, c, kinds[c]), read), strict=True))
    out = []
    for c in names:
        m = {k.partition("\0")[2]: v for k, v in found.items() if k.startswith(f"{c}\0")}
        p = Profile(c, "", dtypes[c], kinds[c], n_rows, n_rows - m["present"], 0)
        out.append(p)
        if p.kind == "other":
            p.semantic_type, p.note = "text", "nested column; not supported, so not examined"
            p.n_distinct = -1
            continue
        seen = values[c]
        p.n_distinct, p.examples = seen["n_distinct"], seen["examples"]
        if p.kind == "number":
            p.stats = {k: m[k] for k in ("min", "max", "mean", "std", "skew", "pct_zero", "n_infinite")} | {"median": medians[c]}
        elif p.kind == "text":
            p.stats = {k: m[k] for k in ("mean_length", "max_length")}
            m["n_codes"] = seen["n_codes"]
        pair = {str(seen[k]).strip().lower() for k in ("low", "high")} if p.n_distinct == 2 else set()
        if whole_rows is None and p.kind == "text":
            whole_rows = frame.select([quoted(x) for x in names if kinds[x] != "other"]).distinct().count()
        p.semantic_type, p.note = infer_type(p, m, pair, whole_rows or 0)
        if p.n_distinct and p.semantic_type in ("boolean", "categorical", "constant", "text"):
            p.top_value, p.top_share = seen["top"], seen["top_n"] / max(1, n_rows)
    return out


def infer_type(p: Profile, m: dict, pair: set[str], whole_rows: int) -> tuple[str, str]:
    """(semantic type, note) of a column; the first rule that holds decides."""
    if p.n_missing == p.n_rows:
        return "empty", ""
    if p.n_distinct == 1:
        return "constant", ""
    if p.kind == "boolean":
        return "boolean", ""
    if p.kind == "number":
        if p.n_distinct == 2 and m["unit"] and not p.stats["n_infinite"]:
            return "boolean", ""
        few = p.n_distinct <= CODES and m["integral"]
        return "numeric", "few whole numbers; may be codes" if few else ""
    if p.kind == "date":
        return "datetime", ""
    if pair in BOOLEANS:
        return "boolean", ""
    if not m["n_real"]:
        return "empty", "only blanks in disguise"
    if m["numeric_share"] >= NUMERIC_SHARE:
        if m["n_codes"] <= CODES and m["integral"]:
            return "categorical", "numbers used as codes"
        return "numeric", "numbers kept as text" if m["numeric_share"] == 1 else "numbers with a few strays"
    if m["numeric_share"] <= 0.5 and m["shaped"] >= DATETIME_SHARE and m["dates"] >= DATETIME_SHARE:
        return "datetime", ""
    share = p.n_distinct / p.n_rows
    if share < TOO_MANY_LABELS and (p.n_distinct <= MAX_LABELS or share <= MAX_LABEL_SHARE):
        return "categorical", ""
    if m["real_length"] >= PROSE_LENGTH:
        return "text", ""
    if p.n_distinct >= IDENTIFIER_SHARE * whole_rows:
        return "identifier", ""
    return "categorical", "many labels"


def as_table(spark, profiles: list[Profile]) -> DataFrame:
    schema = "column string, type string, dtype string, missing long, missing_pct double, distinct long, top_value string, top_pct double, skew double, note string"
    rows = [
        (p.name, p.semantic_type, p.dtype, p.n_missing, 100 * p.missing_share, p.n_distinct, None if p.top_value is None else str(p.top_value), 100 * p.top_share, p.stats.get("skew"), p.note)
        for p in profiles
    ]
    return spark.createDataFrame(rows, schema)


def type_counts(profiles: list[Profile]) -> dict[str, int]:
    return {t: n for t in TYPES if (n := sum(p.semantic_type == t for p in profiles))}
