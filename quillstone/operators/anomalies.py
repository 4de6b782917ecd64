"""Bounds of ordinary values, and capping to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import quoted

LEAST, DOMINANT = 20, 0.40
FENCE, MODIFIED_Z, MAD_SCALE, SIGMAS = 3.0, 3.5, 0.6745, 3.0
REFUSE_ABOVE = 0.10
METHODS = ("iqr", "mad", "zscore")


def measures(frame: DataFrame, columns: dict[str, Column], wide: int = 12) -> dict[str, dict]:
    """Quartiles, median, MAD, spread and what each rule flags, by name; two jobs for a dozen columns."""
    out: dict[str, dict] = {}
    names = list(columns)
    for at in range(0, len(names), wide):
        part = names[at : at + wide]
        exact = [F.percentile(columns[c], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for c in part]
        spread = [e for c in part for e in (F.count(columns[c]), F.avg(columns[c]), F.stddev_samp(columns[c]), F.bool_and(columns[c] % 1 == 0))]
        quartiles, moments = frame.agg(*exact).first(), frame.agg(*spread).first()
        for i, c in enumerate(part):
            q, (n, mean, sd, whole) = quartiles[i], moments[4 * i : 4 * i + 4]
            if q is not None:
                out[c] = {"n": n, "q1": q[0], "median": q[1], "q3": q[2], "iqr": q[2] - q[0], "mean": mean, "sd": sd, "whole": whole}
        known = [c for c in part if c in out]
        if not known:
            continue
        mads = frame.agg(*[F.median(F.abs(columns[c] - out[c]["median"])) for c in known]).first()
        for c, mad in zip(known, mads, strict=True):
            out[c]["mad"] = mad
        flags = []
        for c in known:
            v, m = columns[c], out[c]
            flags.append(F.count_if((v < m["q1"] - FENCE * m["iqr"]) | (v > m["q3"] + FENCE * m["iqr"])) if m["iqr"] > 0 else F.lit(0))
            flags.append(F.count_if(MAD_SCALE * F.abs(v - m["median"]) / m["mad"] > MODIFIED_Z) if m["mad"] > 0 else F.lit(0))
        counted = frame.agg(*flags).first()
        for i, c in enumerate(known):
            out[c]["by_iqr"], out[c]["by_mad"] = int(counted[2 * i]), int(counted[2 * i + 1])
            values = frame.select(columns[c].alias("v")).filter("v is not null").groupBy("v").count()
            out[c]["distinct"], most = values.agg(F.count(F.lit(1)), F.max("count")).first()
            out[c]["dominant"] = most / out[c]["n"]
    return out


def bounds_of(m: dict, method: str) -> tuple[float, float] | None:
    """(low, high) by a rule, or None where no rule can be trusted."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; use one of {', '.join(METHODS)}")
    if not m or m["n"] < LEAST or m["distinct"] < LEAST or m["dominant"] >= DOMINANT:
        return None
    if method == "iqr":
        return (m["q1"] - FENCE * m["iqr"], m["q3"] + FENCE * m["iqr"]) if m["iqr"] > 0 else None
    if method == "mad":
        reach = MODIFIED_Z * m["mad"] / MAD_SCALE
        return (m["median"] - reach, m["median"] + reach) if m["mad"] > 0 else None
    return (m["mean"] - SIGMAS * m["sd"], m["mean"] + SIGMAS * m["sd"]) if m["sd"] else None


def fit_cap(train: DataFrame, columns: list[str], method: str = "iqr") -> dict:
    """Bounds learnt on the training half, and why columns were refused."""
    from quillstone.operators.profile import finite

    values = {c: finite(quoted(c)) for c in columns if c in train.columns and dict(train.dtypes)[c] not in ("string", "boolean")}
    found = measures(train, values)
    bounds, refused = {}, {}
    for c in values:
        limits = bounds_of(found.get(c), method)
        if limits is None:
            refused[c] = "the rule can't be trusted on this column"
            continue
        low, high = limits
        if found[c]["whole"]:
            low, high = float(round(low)), float(round(high))  # half to even
        bounds[c] = (low, high)
    if bounds:
        outside = train.agg(*[F.avg(F.when(values[c].isNotNull(), ((values[c] < lo) | (values[c] > hi)).cast("double"))) for c, (lo, hi) in bounds.items()]).first()
        for c, share in zip(list(bounds), outside, strict=True):
            if share and share > REFUSE_ABOVE:
                refused[c] = f"{share:.0%} lie outside, so they are not exceptions"
                del bounds[c]
    return {"bounds": bounds, "refused": refused}


def apply_cap(frame: DataFrame, fitted: dict) -> tuple[DataFrame, int]:
    """(frame with values moved to the bounds, how many were moved)."""
    bounds = {c: b for c, b in fitted["bounds"].items() if c in frame.columns}
    if not bounds:
        return frame, 0
    changed = frame.agg(*[F.count_if((quoted(c) < lo) | (quoted(c) > hi)) for c, (lo, hi) in bounds.items()]).first()
    return frame.withColumns({c: F.when(quoted(c) < lo, F.lit(lo)).when(quoted(c) > hi, F.lit(hi)).otherwise(quoted(c).cast("double")) for c, (lo, hi) in bounds.items()}), sum(changed)


def comparison(frame: DataFrame, column: str) -> DataFrame:
    """The three rules side by side: rule, lower, upper, flagged, note."""
    from quillstone.operators.profile import finite

    v = finite(quoted(column))
    found = measures(frame, {column: v}).get(column)
    rows = []
    for method in METHODS:
        limits = bounds_of(found, method)
        flagged = frame.agg(F.count_if((v < limits[0]) | (v > limits[1]))).first()[0] if limits else None
        rows.append((method, *(limits or (None, None)), flagged, None if limits else "can't be trusted on this column"))
    return frame.sparkSession.createDataFrame(rows, "rule string, lower double, upper double, flagged long, note string")
