"""Registered queries of the data-quality engine, each with its SQL twin.

The supplied tables are clean, so most queries dirty theirs first, by the same SQL in
both: `DIRTY` names such relations. A query is a function of the dirtied relation made
of the engine's own operators; its twin says what the operator means in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions.text import ROW_ID, quoted
from quillstone.operators import anomalies, checks, evidence, features, profile, repair, rules
from quillstone.plans import planner
from quillstone.sources.reader import from_frame, read_table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DIRTY = {
    "d_priority": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN '?' WHEN o_orderkey % 23 = 0 THEN ' Unknown ' ELSE o_orderpriority END AS v, o_orderstatus AS s, o_totalprice AS x FROM orders",
    "d_balance": "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS x, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS v, c_nationkey AS g FROM customer",
    "d_value": "SELECT event_id AS id, CASE WHEN event_id % 29 = 0 THEN -999.0 ELSE value END AS x, event_type AS v FROM events",
    "d_quantity": "SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 97 = 0 THEN 99999.0 ELSE l_quantity END AS x FROM lineitem",
    "d_infinite": "SELECT event_id AS id, CASE WHEN event_id % 101 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS x FROM events",
    "d_segment": "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN upper(c_mktsegment) ELSE concat(c_mktsegment, ' ') END AS v FROM customer",
    "d_copies": "SELECT c_custkey AS id, c_mktsegment AS v, c_nationkey AS g, c_custkey % 50 AS k FROM customer UNION ALL SELECT c_custkey + 1000000, c_mktsegment, c_nationkey, c_custkey % 50 FROM customer WHERE c_custkey % 13 = 0",
    "d_formatted": "SELECT p_partkey AS id, p_name AS v, p_partkey AS k FROM part UNION ALL SELECT p_partkey + 1000000, concat(upper(p_name), ' '), p_partkey FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT p_partkey + 2000000, p_name, p_partkey FROM part WHERE p_partkey % 26 = 0",
    "d_price": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat('$', CAST(CAST(floor(p_retailprice * 10) AS BIGINT) AS VARCHAR(20))) ELSE concat(CAST(p_size AS VARCHAR(20)), ',5 EUR') END AS v FROM part",
    "d_dates": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) ELSE concat(substr(CAST(o_orderdate AS VARCHAR(30)), 9, 2), '.', substr(CAST(o_orderdate AS VARCHAR(30)), 6, 2), '.', substr(CAST(o_orderdate AS VARCHAR(30)), 1, 4)) END AS v FROM orders",
    "d_sizes": "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'heavy' ELSE CAST(p_size AS VARCHAR(20)) END AS v FROM part",
    "d_stubs": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'x' ELSE s_name END AS v FROM supplier",
    "d_dead": "SELECT c_custkey AS id, 'BGN' AS fixed, CAST(NULL AS VARCHAR(10)) AS nothing, c_name AS name, c_mktsegment AS v FROM customer",
    "d_foot": "SELECT s_suppkey AS id, s_name AS v, s_acctbal AS x FROM supplier UNION ALL SELECT 1000000, NULL, NULL UNION ALL SELECT 1000001, 'TOTAL', 0.0",
    "d_mojibake": "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'Ã©') ELSE text END AS v FROM documents",
    "d_items": "SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS shipped, o_orderdate AS ordered, l_quantity AS q, l_discount AS d, l_extendedprice AS p, l_returnflag AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "d_typed": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'abc' WHEN o_orderkey % 31 = 0 THEN '5d' WHEN o_orderkey % 29 = 0 THEN ' 1e3 ' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) END AS v FROM orders",
    "d_nations": "SELECT c_custkey AS id, c_nationkey AS k, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "d_spaced": "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat('  ', c_mktsegment, '   Line ') WHEN 1 THEN concat(c_mktsegment, chr(9), 'x', chr(10)) ELSE c_mktsegment END AS v FROM customer",
}

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dirtied relation (or a table), its id as row order. Views are named by their folder, so runs don't mix."""
    import re

    sql = DIRTY.get(name, f"SELECT * FROM {name}")
    for t in TABLES:
        if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql):
            view = f"q{abs(hash(sf_dir)) % 10**8}_{t}"
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(view)
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {view}", sql)
    return spark.sql(sql)


def loaded(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return from_frame(relation(spark, sf_dir, name), name, "id").frame.drop("id")


def query(name: str, source: str, sql: str | None = None):
    """Registers a function of the loaded source; sql reads the source by its name."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(loaded(spark, sf_dir, source) if source in DIRTY else relation(spark, sf_dir, source))
        if sql:
            head = f"WITH {source} AS ({DIRTY[source]}) " if source in DIRTY else ""
            ORACLE[name] = head + sql
        return f

    return register


def r6(c):
    return F.round(c, 6)


TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in X.TOKENS)
STRIP = r"regexp_replace(v, '^\s+|\s+$', '', 'g')"
TIDY = rf"regexp_replace({STRIP}, '\s+', ' ', 'g')"
NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def finding_row(found: list, name: str, frame: DataFrame) -> DataFrame:
    """The findings of one check as rows: column, affected, share, severity."""
    rows = [(",".join(f.columns), int(f.affected_rows), round(f.affected_share, 6), f.severity) for f in found if f.check == name]
    return frame.sparkSession.createDataFrame(rows, "columns string, affected long, share double, severity string")


def run_check(name: str):
    return lambda f: finding_row(list(checks.CHECKS[name](checks.Context(f, profile.profile_frame(f)))), name, f)


# ---- text expressions


@query("disguised_missing", "d_priority", f"SELECT 'v' AS col, count(*) AS n_rows, count(*) - count(v) AS n_missing, count(*) FILTER (WHERE lower(trim(v)) IN ({TOKENS})) AS n_disguised, round(count(*) FILTER (WHERE lower(trim(v)) IN ({TOKENS})) / count(*), 6) AS disguised_share, string_agg(DISTINCT trim(v), ',' ORDER BY trim(v)) FILTER (WHERE lower(trim(v)) IN ({TOKENS})) AS tokens FROM d_priority")
def _disguised(f):
    hit = X.is_token(F.col("v"))
    tokens = F.array_join(F.sort_array(F.collect_set(F.when(hit, X.strip(F.col("v"))))), ",")
    n = F.count(F.lit(1))
    return f.agg(F.lit("v").alias("col"), n.alias("n_rows"), (n - F.count("v")).alias("n_missing"), F.count_if(hit).alias("n_disguised"), r6(F.count_if(hit) / n).alias("disguised_share"), tokens.alias("tokens"))


query("strip_ws", "d_spaced", f"SELECT id AS row_id, {STRIP} AS stripped FROM d_spaced")(lambda f: f.select(F.col(ROW_ID).alias("row_id"), X.strip(F.col("v")).alias("stripped")))
query("normalise_text", "d_spaced", f"SELECT id AS row_id, lower({TIDY}) AS norm FROM d_spaced")(lambda f: f.select(F.col(ROW_ID).alias("row_id"), X.normalise(F.col("v")).alias("norm")))
query("try_numeric", "d_typed", f"SELECT id AS row_id, CASE WHEN regexp_matches(trim(v), {NUM}) THEN try_cast(trim(v) AS DOUBLE) END AS x FROM d_typed")(lambda f: f.select(F.col(ROW_ID).alias("row_id"), X.number(F.col("v")).alias("x")))
query("parse_numeric", "d_price", "SELECT id AS row_id, try_cast(replace(regexp_replace(v, '[$ ]|EUR', '', 'g'), ',', '.') AS DOUBLE) AS x FROM d_price")(lambda f: repair.parse_numeric(f, ["v"]).select(F.col(ROW_ID).alias("row_id"), F.col("v").alias("x")))
query("try_date", "d_dates", "SELECT id AS row_id, CAST(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d.%m.%Y')) AS DATE) AS day FROM d_dates")(lambda f: f.select(F.col(ROW_ID).alias("row_id"), X.date(F.col("v")).cast("date").alias("day")))
query("date_layouts", "d_dates", "SELECT CASE WHEN v LIKE '____-__-__' THEN 'YYYY-MM-DD' ELSE 'DD.MM.YYYY' END AS layout, count(*) AS n FROM d_dates GROUP BY 1")(lambda f: f.groupBy(X.layout(F.col("v")).alias("layout")).agg(F.count(F.lit(1)).alias("n")))
query("text_marks", "d_price", "SELECT bool_or(contains(v, '$')) AS dollar, bool_or(contains(lower(v), 'eur')) AS eur, bool_or(contains(v, '%')) AS pct FROM d_price")(lambda f: f.agg(*[F.bool_or(X.marks_in(F.col("v"))[m]).alias(a) for m, a in (("$", "dollar"), ("EUR", "eur"), ("%", "pct"))]))

# ---- profiles


@query("profile_numeric", "d_value", "SELECT count(x) AS n, round(min(x),6) AS lo, round(max(x),6) AS hi, round(avg(x),6) AS mean, round(quantile_cont(x,0.5),6) AS med, round(stddev_samp(x),6) AS sd, round(skewness(x),6) AS skew, round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END),6) AS pct_zero FROM d_value")
def _profile_numeric(f):
    p = profile.profile_frame(f, ["x"])[0]
    s = p.stats
    row = (p.n_rows - p.n_missing, *(round(float(s[k]), 6) for k in ("min", "max", "mean", "median", "std", "skew", "pct_zero")))
    return f.sparkSession.createDataFrame([row], "n long, lo double, hi double, mean double, med double, sd double, skew double, pct_zero double")


query("profile_text", "documents", "SELECT round(avg(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))),6) AS mean_length, max(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS max_length, count(DISTINCT text) AS n_distinct FROM documents")(
    lambda f: f.agg(r6(F.avg(F.length(X.strip(F.col("text"))))).alias("mean_length"), F.max(F.length(X.strip(F.col("text")))).cast("long").alias("max_length"), F.count_distinct("text").alias("n_distinct"))
)
query("profile_top_value", "d_priority", "SELECT v AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM d_priority), 6) AS share FROM d_priority WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, min(id) LIMIT 1")(
    lambda f: profile.value_counts(f, "v").crossJoin(f.agg(F.count(F.lit(1)).alias("all"))).orderBy(F.desc("n"), "first").limit(1).select(F.col("v").alias("value"), "n", r6(F.col("n") / F.col("all")).alias("share"))
)
query("null_counts", "d_balance", "SELECT count(*) - count(x) AS x_missing, count(*) - count(v) AS v_missing, count(*) - count(g) AS g_missing FROM d_balance")(
    lambda f: f.sparkSession.createDataFrame([tuple(p.n_missing for p in profile.profile_frame(f, ["x", "v", "g"]))], "x_missing long, v_missing long, g_missing long")
)
query("distinct_counts", "d_priority", "SELECT count(DISTINCT v) AS v_distinct, count(DISTINCT s) AS s_distinct, count(DISTINCT x) AS x_distinct FROM d_priority")(
    lambda f: f.sparkSession.createDataFrame([tuple(p.n_distinct for p in profile.profile_frame(f, ["v", "s", "x"]))], "v_distinct long, s_distinct long, x_distinct long")
)
_DEAD = ", ".join(f"({n}, (SELECT count({c}) FROM d_dead), (SELECT count(DISTINCT {c}) FROM d_dead), (SELECT avg(length({c})) FROM d_dead))" for c, n in ((c, repr(c)) for c in ("fixed", "nothing", "name", "v")))
_TYPED = (
    "SELECT col, CASE WHEN present = 0 THEN 'empty' WHEN d = 1 THEN 'constant' WHEN d / n < 0.5 AND (d <= 50 OR d / n <= 0.05) THEN 'categorical' WHEN len >= 40 THEN 'text' WHEN d >= 0.95 * whole THEN 'identifier' ELSE 'categorical' END AS type "
    f"FROM (VALUES {_DEAD}) t(col, present, d, len), (SELECT count(*) AS n, count(DISTINCT (fixed, nothing, name, v)) AS whole FROM d_dead)"
)
query("semantic_type", "d_dead", _TYPED)(
    lambda f: f.sparkSession.createDataFrame([(p.name, p.semantic_type) for p in profile.profile_frame(f)], "col string, type string")
)
query("type_counts", "d_dead", f"SELECT type, count(*) AS n FROM ({_TYPED}) GROUP BY type")(
    lambda f: f.sparkSession.createDataFrame(list(profile.type_counts(profile.profile_frame(f)).items()), "type string, n long")
)
_TOP = "(SELECT {c} FROM d_priority GROUP BY {c} ORDER BY count(*) DESC, min(id) LIMIT 1)"
_SHARE = "(SELECT round(100.0 * max(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM d_priority GROUP BY {c}))"
query("profile_table", "d_priority", " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct, {_TOP.format(c=c)} AS top_value, {_SHARE.format(c=c)} AS top_pct FROM d_priority" for c in "vs"))(
    lambda f: profile.as_table(f.sparkSession, profile.profile_frame(f.drop("x"))).select(F.col("column").alias("col"), "missing", F.col("distinct").alias("n_distinct"), "top_value", r6("top_pct").alias("top_pct"))
)

# ---- checks

FIND = "SELECT '{c}' AS columns, CAST({n} AS BIGINT) AS affected, round({n} / {all}, 6) AS share, '{sev}' AS severity FROM {t}"
find = lambda c, n, t, sev, all_="count(*)": FIND.format(c=c, n=n, t=t, sev=sev, all=all_)
for _name, _source, _sql in (
    ("missing_values", "d_balance", "SELECT 'x' AS columns, count(*) - count(x) AS affected, round((count(*) - count(x)) / count(*), 6) AS share, 'medium' AS severity FROM d_balance UNION ALL SELECT 'v', count(*) - count(v), round((count(*) - count(v)) / count(*), 6), 'medium' FROM d_balance"),
    ("numeric_sentinel", "d_value", find("x", "count(*) FILTER (WHERE x = -999.0)", "d_value", "high")),
    ("infinite_values", "d_infinite", find("x", "count(*) FILTER (WHERE isinf(x))", "d_infinite", "high")),
    ("inconsistent_categories", "d_segment", "SELECT 'v' AS columns, CAST(sum(n) AS BIGINT) AS affected, round(sum(n) / (SELECT count(*) FROM d_segment), 6) AS share, 'medium' AS severity FROM (SELECT lower(trim(v)) AS k, count(*) AS n, count(DISTINCT v) AS d FROM d_segment GROUP BY 1) WHERE d > 1"),
    ("whitespace", "d_segment", find("v", r"count(*) FILTER (WHERE v <> trim(v) OR regexp_matches(v, '\s\s'))", "d_segment", "medium")),
    ("exact_duplicates", "d_copies", "SELECT '' AS columns, CAST(sum(n - 1) AS BIGINT) AS affected, round(sum(n - 1) / sum(n), 6) AS share, 'medium' AS severity FROM (SELECT count(*) AS n FROM d_copies GROUP BY v, g, k)"),
    ("normalised_duplicates", "d_formatted", "SELECT 'v' AS columns, CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM d_formatted GROUP BY lower(trim(v)), k)) - (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM d_formatted GROUP BY v, k)) AS BIGINT) AS affected, round(((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM d_formatted GROUP BY lower(trim(v)), k)) - (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM d_formatted GROUP BY v, k))) / (SELECT count(*) FROM d_formatted), 6) AS share, 'medium' AS severity"),
    ("mixed_types", "d_sizes", find("v", "count(*) FILTER (WHERE v = 'heavy')", "d_sizes", "high")),
    ("numeric_in_text", "d_price", find("v", "count(*)", "d_price", "high")),
    ("mixed_date_formats", "d_dates", find("v", "count(*)", "d_dates", "high")),
    ("short_values", "d_stubs", find("v", "count(*) FILTER (WHERE v = 'x')", "d_stubs", "medium")),
    ("encoding_damage", "d_mojibake", find("v", "count(*) FILTER (WHERE regexp_matches(v, 'Ð|Ñ|Ã|â€|Â|ï»¿'))", "d_mojibake", "high")),
    ("control_characters", "d_spaced", find("v", "count(*) FILTER (WHERE contains(v, chr(9)))", "d_spaced", "medium")),
    ("uninformative_columns", "d_dead", find("fixed,nothing", "count(*)", "d_dead", "high")),
    ("identifier_columns", "d_dead", find("name", "count(*)", "d_dead", "medium")),
    ("empty_rows", "d_foot", find("", "count(*) FILTER (WHERE v IS NULL AND x IS NULL)", "d_foot", "medium")),
    ("summary_rows", "d_foot", find("", "count(*) FILTER (WHERE v = 'TOTAL')", "d_foot", "high")),
):
    query(_name, _source, _sql)(run_check(_name))
query("check_disguised_missing", "d_priority", find("v", f"count(*) FILTER (WHERE lower(trim(v)) IN ({TOKENS}))", "d_priority", "critical"))(run_check("disguised_missing"))


@query("sentinel_at_the_top", "d_quantity", find("x", "count(*) FILTER (WHERE x = 99999.0)", "d_quantity", "medium"))
def _top(f):
    return run_check("numeric_sentinel")(f)


query("redundant_columns", "d_nations", find("k,name", "count(*)", "d_nations", "medium"))(run_check("redundant_columns"))
query("high_skew", "d_infinite", "SELECT 'x' AS columns, round(skewness(x), 6) AS skew FROM d_infinite WHERE NOT isinf(x) HAVING abs(skewness(x)) >= 1")(
    lambda f: f.sparkSession.createDataFrame([(",".join(x.columns), round(x.evidence["skew"], 6)) for x in checks.CHECKS["high_skew"](checks.Context(f, profile.profile_frame(f)))], "columns string, skew double")
)
query("column_names", "region", "SELECT 'region ' AS columns UNION ALL SELECT 'name.1'")(
    lambda f: f.sparkSession.createDataFrame([(c,) for x in checks.CHECKS["column_names"](checks.Context(f, profile.profile_frame(f.toDF("region ", "name.1")))) for c in x.columns], "columns string")
)
_QUART = "q AS (SELECT quantile_cont(value,0.25) a, quantile_cont(value,0.75) b, quantile_cont(value,0.5) m, avg(value) mu, stddev_samp(value) sd FROM events), m AS (SELECT quantile_cont(abs(value - q.m),0.5) AS mad FROM events, q)"


def _outliers(f):
    v = F.col("value")
    m = anomalies.measures(f, {"value": v})["value"]
    rows = []
    for method in anomalies.METHODS:
        low, high = anomalies.bounds_of(m, method)
        rows.append((method, round(low, 6), round(high, 6)))
    out = f.sparkSession.createDataFrame(rows, "rule string, lower double, upper double")
    flagged = f.agg(*[F.count_if((v < lo) | (v > hi)).alias(r) for r, lo, hi in rows]).first()
    return f.sparkSession.createDataFrame([(*r, flagged[r[0]]) for r in rows], "rule string, lower double, upper double, flagged long") if rows else out


query(
    "outlier_rules", "events",
    f"WITH {_QUART}, b AS (SELECT 'iqr' AS rule, a - 3*(b-a) AS lower, b + 3*(b-a) AS upper FROM q UNION ALL SELECT 'mad', q.m - 3.5*mad/0.6745, q.m + 3.5*mad/0.6745 FROM q, m UNION ALL SELECT 'zscore', mu - 3*sd, mu + 3*sd FROM q) "
    "SELECT rule, round(lower,6) AS lower, round(upper,6) AS upper, count(*) FILTER (WHERE value < lower OR value > upper) AS flagged FROM b, events GROUP BY rule, lower, upper",
)(_outliers)
query("outliers", "events", f"WITH {_QUART} SELECT 'value' AS columns, count(*) FILTER (WHERE value < a - 3*(b-a) OR value > b + 3*(b-a)) AS by_iqr, count(*) FILTER (WHERE 0.6745*abs(value - q.m)/mad > 3.5) AS by_mad FROM events, q, m")(
    lambda f: f.sparkSession.createDataFrame(
        [(",".join(x.columns), x.evidence["by_iqr"], x.evidence["by_mad"]) for x in checks.CHECKS["outliers"](checks.Context(f.select("value"), profile.profile_frame(f.select("value"))))], "columns string, by_iqr long, by_mad long"
    )
)
_SHOWN = "'{c}' AS name, '{sev}' AS severity, '{topic}' AS topic, '{on}' AS columns, '{action}' AS action, count(*) AS affected, round(count(*) / (SELECT count(*) FROM d_priority), 6) AS share"


@query(
    "detect", "d_priority",
    f"SELECT {_SHOWN.format(c='disguised_missing', sev='critical', topic='missing', on='v', action='replace_disguised_missing')} FROM d_priority WHERE lower(trim(v)) IN ({TOKENS}) HAVING count(*) > 0 UNION ALL "
    f"SELECT {_SHOWN.format(c='exact_duplicates', sev='medium', topic='duplicates', on='', action='drop_duplicate_rows')} FROM (SELECT row_number() OVER (PARTITION BY v, s, x ORDER BY id) AS k FROM d_priority) WHERE k > 1 HAVING count(*) > 0 UNION ALL "
    rf"SELECT {_SHOWN.format(c='whitespace', sev='medium', topic='structure', on='v', action='normalise_categories')} FROM d_priority WHERE v <> trim(v) OR regexp_matches(v, '\s\s') HAVING count(*) > 0",
)
def _detect(f):
    rows = [(x.check, x.severity, x.topic, ",".join(x.columns), x.suggestion.action, int(x.affected_rows), round(x.affected_share, 6)) for x in checks.detect(f, target="s")]
    return f.sparkSession.createDataFrame(rows, "name string, severity string, topic string, columns string, action string, affected long, share double")


# ---- rules

R = rules.Rule


def broken(rule: rules.Rule):
    """Ids of the rows that a rule rejects."""
    return lambda f: rules.validate(f, [rule]).rejected.select(F.col(ROW_ID).alias("row_id"))


for _name, _source, _rule, _where in (
    ("rule_not_null", "d_balance", R("x", "not_null"), "x IS NULL"),
    ("rule_unique", "d_copies", R("k", "unique"), "k IN (SELECT k FROM d_copies GROUP BY k HAVING count(*) > 1)"),
    ("rule_range", "d_value", R("x", "range", {"min": 0, "max": 200}), "x < 0 OR x > 200"),
    ("rule_allowed_values", "d_segment", R("v", "allowed_values", {"values": ["BUILDING", "MACHINERY"]}), "v NOT IN ('BUILDING', 'MACHINERY')"),
    ("rule_pattern", "d_segment", R("v", "pattern", {"regex": "[A-Z]+$"}), "NOT regexp_matches(v, '^[A-Z]+$')"),
    ("rule_type", "d_typed", R("v", "type", {"type": "numeric"}), "v IS NOT NULL AND v IN ('abc', '5d')"),
    ("rule_compare", "d_items", R("ordered", "compare", {"op": "<=", "other": "shipped"}), "NOT ordered <= shipped"),
):
    query(_name, _source, f"SELECT id AS row_id FROM {_source} WHERE {_where}")(broken(_rule))


@query("quarantine_reasons", "d_balance", "SELECT id AS row_id, concat_ws(' | ', CASE WHEN x IS NULL THEN 'x must not be empty' END, CASE WHEN x < 0 OR x > 9000 THEN 'x must be at least 0 and at most 9000' END, CASE WHEN v IS NULL THEN 'v must not be empty' END) AS reasons FROM d_balance WHERE x IS NULL OR x < 0 OR x > 9000 OR v IS NULL")
def _quarantine(f):
    found = rules.validate(f, [R("x", "not_null"), R("x", "range", {"min": 0, "max": 9000}), R("v", "not_null")])
    return found.rejected.select(F.col(ROW_ID).alias("row_id"), F.col(rules.BECAUSE).alias("reasons"))


@query("violations", "d_balance", "SELECT 'x' AS col, 'not_null' AS kind, count(*) FILTER (WHERE x IS NULL) AS n FROM d_balance UNION ALL SELECT 'x', 'range', count(*) FILTER (WHERE x < 0) FROM d_balance UNION ALL SELECT 'v', 'not_null', count(*) FILTER (WHERE v IS NULL) FROM d_balance")
def _violations(f):
    found = rules.validate(f, [R("x", "not_null"), R("x", "range", {"min": 0}), R("v", "not_null"), R("gone", "not_null")])
    return f.sparkSession.createDataFrame([(v.rule.column, v.rule.kind, v.rows) for v in found.violations], "col string, kind string, n long")


@query(
    "infer_rules", "d_priority",
    " UNION ALL ".join(f"SELECT '{c}' AS col, 'not_null' AS kind FROM d_priority HAVING count(*) = count({c})" for c in "vsx")
    + "".join(f" UNION ALL SELECT '{c}', 'allowed_values' FROM d_priority HAVING count(DISTINCT {c}) BETWEEN 2 AND 20" for c in "vs") + " UNION ALL SELECT 'x', 'range' FROM d_priority HAVING count(x) > 0",
)
def _infer(f):
    return f.sparkSession.createDataFrame([(r.column, r.kind) for r in rules.infer_rules(f, profile.profile_frame(f))], "col string, kind string")


# ---- repairs

query("normalise_vote", "d_segment", f"SELECT id AS row_id, best AS v FROM (SELECT id, lower({TIDY}) AS k FROM d_segment) JOIN (SELECT k, arg_min(t, (-n, t)) AS best FROM (SELECT lower({TIDY}) AS k, {TIDY} AS t, count(*) AS n FROM d_segment GROUP BY 1, 2) GROUP BY k) USING (k)")(lambda f: repair.normalise_categories(f, ["v"]).select(F.col(ROW_ID).alias("row_id"), "v"))
query("replace_disguised", "d_priority", "SELECT id AS row_id, CASE WHEN lower(trim(v)) IN ('?', 'unknown') THEN NULL ELSE v END AS v FROM d_priority")(lambda f: repair.replace_disguised_missing(f, ["v"], tokens=["?", "Unknown"]).select(F.col(ROW_ID).alias("row_id"), "v"))
query("replace_sentinel", "d_value", "SELECT id AS row_id, CASE WHEN x = -999.0 THEN NULL ELSE x END AS x FROM d_value")(lambda f: repair.replace_disguised_missing(f, ["x"], numeric_values=[-999.0]).select(F.col(ROW_ID).alias("row_id"), "x"))
query("dedup_keep_first", "d_copies", "SELECT min(id) AS row_id, v, g, k FROM d_copies GROUP BY v, g, k")(lambda f: repair.drop_duplicate_rows(f).select(F.col(ROW_ID).alias("row_id"), "v", "g", "k"))
query("drop_missing_target", "d_balance", "SELECT id AS row_id, v FROM d_balance WHERE v IS NOT NULL")(lambda f: repair.drop_rows_missing_target(f, "v").select(F.col(ROW_ID).alias("row_id"), "v"))
query("drop_empty_rows", "d_foot", "SELECT id AS row_id FROM d_foot WHERE v IS NOT NULL OR x IS NOT NULL")(lambda f: repair.drop_empty_rows(f).select(F.col(ROW_ID).alias("row_id")))
query("drop_rows", "d_foot", "SELECT id AS row_id FROM d_foot WHERE id <> 1000001")(lambda f: repair.drop_rows(f, [1000001]).select(F.col(ROW_ID).alias("row_id")))
query("split_stratified", "d_priority", "SELECT row_id, label FROM (SELECT id AS row_id, s AS label, row_number() OVER (PARTITION BY s ORDER BY substr(md5(concat(CAST(id AS VARCHAR), ':20260827')), 1, 8), id) AS r, count(*) OVER (PARTITION BY s) AS n FROM d_priority) WHERE n > 1 AND r <= round_even(n * 0.2, 0)")(lambda f: repair.split(f, "s")[1].select(F.col(ROW_ID).alias("row_id"), F.col("s").alias("label")))
query("impute_median", "d_balance", "SELECT id AS row_id, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM d_balance)) AS x FROM d_balance")(lambda f: repair.apply_impute(f, repair.fit_impute(f, ["x"])).select(F.col(ROW_ID).alias("row_id"), "x"))
query("impute_mean", "d_balance", "SELECT id AS row_id, round(coalesce(x, (SELECT avg(x) FROM d_balance)), 6) AS x FROM d_balance")(lambda f: repair.apply_impute(f, repair.fit_impute(f, ["x"], strategy="mean")).select(F.col(ROW_ID).alias("row_id"), r6("x").alias("x")))
query("impute_mode", "d_balance", "SELECT id AS row_id, coalesce(v, (SELECT v FROM d_balance WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, min(id) LIMIT 1)) AS v FROM d_balance")(lambda f: repair.apply_impute(f, repair.fit_impute(f, ["v"])).select(F.col(ROW_ID).alias("row_id"), "v"))
query("impute_group_median", "d_balance", "SELECT id AS row_id, coalesce(x, m, (SELECT quantile_cont(x, 0.5) FROM d_balance)) AS x FROM d_balance LEFT JOIN (SELECT g, quantile_cont(x, 0.5) AS m FROM d_balance GROUP BY g) USING (g)")(lambda f: repair.apply_impute(f, repair.fit_impute(f, ["x"], group_by="g")).select(F.col(ROW_ID).alias("row_id"), "x"))
query("was_missing", "d_balance", "SELECT id AS row_id, CASE WHEN x IS NULL THEN 1 ELSE 0 END AS flag FROM d_balance")(lambda f: repair.apply_impute(f, repair.fit_impute(f, ["x"]), add_indicator=True).select(F.col(ROW_ID).alias("row_id"), F.col("x_was_missing").cast("int").alias("flag")))
for _method in ("iqr", "mad", "zscore"):
    _bound = {"iqr": ("a - 3*(b-a)", "b + 3*(b-a)"), "mad": ("q.m - 3.5*mad/0.6745", "q.m + 3.5*mad/0.6745"), "zscore": ("mu - 3*sd", "mu + 3*sd")}[_method]
    query(f"cap_{_method}", "events", f"WITH {_QUART} SELECT event_id AS row_id, round(CASE WHEN value < {_bound[0]} THEN {_bound[0]} WHEN value > {_bound[1]} THEN {_bound[1]} ELSE value END, 6) AS value FROM events, q, m")(
        lambda f, how=_method: anomalies.apply_cap(f, anomalies.fit_cap(f, ["value"], how))[0].select(F.col("event_id").alias("row_id"), r6("value").alias("value"))
    )


def _plan(spark, sf_dir):
    f = loaded(spark, sf_dir, "d_priority").drop("x")
    return planner.as_table(spark, planner.build(checks.detect(f, target="s"), target="s"))


def _slot(k: int, stage: str, step: str, columns: str, origin: str, when: str) -> str:
    return f"SELECT {k} AS k, '{stage} split' AS stage, '{step}' AS step, '{columns}' AS columns, '{origin}' AS \"from\" WHERE EXISTS ({when})"


_BLANK = f"SELECT 1 FROM d_priority WHERE lower(trim(v)) IN ({TOKENS})"
QUERIES["repair_plan"] = _plan
ORACLE["repair_plan"] = f"WITH d_priority AS ({DIRTY['d_priority']}) SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS \"#\", stage, step, columns, \"from\" FROM (" + " UNION ALL ".join((
    _slot(1, "before", "normalise_categories", "v", "whitespace", "SELECT 1 FROM d_priority WHERE v <> trim(v)"),
    _slot(2, "before", "replace_disguised_missing", "v", "disguised_missing", _BLANK),
    _slot(3, "before", "drop_duplicate_rows", "(whole table)", "exact_duplicates", "SELECT 1 FROM d_priority GROUP BY v, s HAVING count(*) > 1"),
    _slot(4, "after", "impute", "v", "derived from replace_disguised_missing", _BLANK),
)) + ")"


@query(
    "clean_run", "d_priority",
    "SELECT id AS row_id, s, x, coalesce(v, (SELECT v FROM t WHERE NOT held AND v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, min(id) LIMIT 1)) AS v FROM t",
)
def _pipeline(f):
    f = f.cache()
    done = repair.run(f, planner.build(checks.detect(f, target="s"), target="s"), target="s")
    return done.frame.select(F.col(ROW_ID).alias("row_id"), "s", "x", "v")


# What the plan does before the split, and the split.
ORACLE["clean_run"] = ORACLE["clean_run"].replace(") SELECT id AS row_id", (
    f"), n AS (SELECT id, s, x, CASE WHEN lower(trim(v)) IN ({TOKENS}) THEN NULL ELSE trim(v) END AS v FROM d_priority), u AS (SELECT min(id) AS id, s, x, v FROM n GROUP BY s, x, v), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY substr(md5(concat(CAST(id AS VARCHAR), ':20260827')), 1, 8), id) AS k, count(*) OVER (PARTITION BY s) AS c FROM u), "
    "t AS (SELECT *, c > 1 AND k <= round_even(c * 0.2, 0) AS held FROM r) SELECT id AS row_id"
), 1)

query("drop_columns", "d_dead", "SELECT id AS row_id, name, v FROM d_dead")(
    lambda f: repair.run(f, planner.Plan([planner.Step("drop_columns", {"columns": ["fixed", "nothing", "never there"]})])).frame.withColumnRenamed(ROW_ID, "row_id")
)
query("clean_column_names", "d_balance", "SELECT id AS row_id, x AS \"a b\", v AS c, g AS \"a b__2\" FROM d_balance")(
    lambda f: repair.clean_column_names(f.toDF(ROW_ID, " a\n b", "c ", "a  b"))[0].withColumnRenamed(ROW_ID, "row_id")
)

# ---- files


def _file(lines: DataFrame, name: str) -> str:
    """The path of one text file of lines (n, value), in the shared folder that the session names."""
    import tempfile
    import uuid

    spark = lines.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    folder = f"{folder or tempfile.mkdtemp(prefix='quillstone-')}/{name}-{uuid.uuid4().hex}"
    lines.orderBy("n").select("value").coalesce(1).write.text(folder)
    paths = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    found = paths.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(paths)
    return found[0].getPath().toString()


def _lines(f: DataFrame, above: list[str], line) -> DataFrame:
    """Lines above the table, then one of each row."""
    head = f.sparkSession.createDataFrame([(i - len(above), x) for i, x in enumerate(above)], "n long, value string")
    return head.unionByName(f.select(F.col(ROW_ID).alias("n"), line.alias("value")))


def _cells(f: DataFrame) -> DataFrame:
    """A semicolon table with decimal commas below two lines of title."""
    number = F.replace(F.format_string("%.2f", "x"), F.lit("."), F.lit(","))
    return _lines(f.filter("x is not null and v is not null"), ["Report", "", "key;amount;segment"], F.concat_ws(";", F.format_string("K%s", ROW_ID), number, "v"))


def _read(f: DataFrame, name: str, **how):
    return read_table(f.sparkSession, _file(_cells(f), name), decimal=",", **how)


query("read_delimited", "d_balance", "SELECT concat('K', id) AS key, round(x, 2) AS amount, v AS segment FROM d_balance WHERE x IS NOT NULL AND v IS NOT NULL")(
    lambda f: _read(f, "table").frame.select("key", F.round("amount", 2).alias("amount"), "segment")
)
query("load_summary", "d_balance", "SELECT count(*) AS n_rows, 3 AS n_columns, 'semicolon' AS delimiter, true AS header_row, 2 AS skipped FROM d_balance WHERE x IS NOT NULL AND v IS NOT NULL")(
    lambda f: (lambda x: f.sparkSession.createDataFrame([(x["rows"], x["columns"], x["delimiter"], x["header_row"], x["skipped_rows"])], "n_rows long, n_columns int, delimiter string, header_row boolean, skipped int"))(_read(f, "table").summary())
)


@query("read_headerless", "d_quantity", "SELECT id AS column_1, CAST(x AS BIGINT) AS column_2 FROM d_quantity")
def _headerless(f):
    path = _file(_lines(f, [], F.concat_ws("|", F.col(ROW_ID).cast("string"), F.col("x").cast("bigint").cast("string"))), "numbers")
    return read_table(f.sparkSession, path, has_header=False).frame.drop(ROW_ID)


# ---- features

query("log1p_skew", "d_infinite", "SELECT round(skewness(x), 6) AS before, round(skewness(ln(1 + x)), 6) AS after FROM d_infinite WHERE NOT isinf(x)")(
    lambda f: f.sparkSession.createDataFrame([tuple(round(v, 6) for v in s) for k in features.fit_log(f, ["x"])[:1] for s in k.values()], "before double, after double")
)
query("expand_dates", "d_items", "SELECT id AS row_id, year(ordered) AS ordered_year, month(ordered) AS ordered_month, isodow(ordered) - 1 AS ordered_weekday, CASE WHEN isodow(ordered) >= 6 THEN 1 ELSE 0 END AS ordered_is_weekend FROM d_items")(
    lambda f: features.expand_dates(f.select(ROW_ID, "ordered"), ["ordered"]).withColumnRenamed(ROW_ID, "row_id")
)
query("one_hot", "d_items", "SELECT id AS row_id, CAST(f = 'A' AS INT) AS \"f=A\", CAST(f = 'N' AS INT) AS \"f=N\", CAST(f = 'R' AS INT) AS \"f=R\" FROM d_items")(
    lambda f: features.apply_encode(f.select(ROW_ID, "f"), features.fit_encode(f, ["f"])).select(F.col(ROW_ID).alias("row_id"), *[quoted(f"f={x}").cast("int").alias(f"f={x}") for x in "ANR"])
)
query("freq_encode", "d_balance", "SELECT id AS row_id, round(n / (SELECT count(*) FROM d_balance), 6) AS g FROM d_balance JOIN (SELECT g, count(*) AS n FROM d_balance GROUP BY g) USING (g)")(
    lambda f: features.apply_encode(f.select(ROW_ID, "g"), features.fit_encode(f, ["g"])).select(F.col(ROW_ID).alias("row_id"), r6("g").alias("g"))
)


@query("pool_rare", "events", "SELECT sum(CASE WHEN n >= 0.01 * (SELECT count(*) FROM events) THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN n < 0.01 * (SELECT count(*) FROM events) THEN 1 ELSE 0 END)::BIGINT AS pooled FROM (SELECT props, count(*) AS n FROM events GROUP BY props)")
def _pool(f):
    how = features.fit_encode(f, ["props"])["props"]
    return f.sparkSession.createDataFrame([(len(how["levels"]), how["pooled"])], "kept long, pooled long")


query("scale", "d_items", "SELECT id AS row_id, round((q - (SELECT avg(q) FROM d_items)) / (SELECT stddev_samp(q) FROM d_items), 6) AS q FROM d_items")(lambda f: features.apply_scale(f, features.fit_scale(f, ["q"])).select(F.col(ROW_ID).alias("row_id"), r6("q").alias("q")))
query("corr_prune", "d_items", "SELECT 'q' AS kept, 'twice' AS dropped, round(abs(corr(q, 2 * q + 1)), 4) AS r FROM d_items")(
    lambda f: f.sparkSession.createDataFrame(features.correlated(f.withColumn("twice", 2 * F.col("q") + 1).withColumn("one", F.lit(1.0)), ["q", "d", "twice", "one"]), "kept string, dropped string, r double")
)

# ---- evidence


def _labelled(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("label"))


QUERIES["roc_auc"] = lambda spark, sf_dir: evidence.auc_frame(_labelled(spark, sf_dir)).select(r6("auc").alias("auc"))
ORACLE["roc_auc"] = (
    "SELECT round((sum(CASE WHEN quality = 1 THEN r END) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * (count(*) - sum(quality))), 6) AS auc FROM "
    "(SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id))"
)
query("naive_baseline", "d_priority", "SELECT count(*) AS n FROM d_priority WHERE v NOT IN ('?', 'N/A', '', '-') AND v IS NOT NULL AND s IS NOT NULL AND x IS NOT NULL")(lambda f: evidence.naive_baseline(f).agg(F.count(F.lit(1)).alias("n")))
_HASH = "CAST(concat('0x', substr(md5(concat(CAST(id AS VARCHAR), ':{c}:20260830')), 1, 8)) AS BIGINT)"
query("corrupt", "d_priority", f"SELECT id AS row_id, CASE WHEN {_HASH.format(c='x')} < 858993459 THEN -999.0 ELSE x END AS x, CASE WHEN {_HASH.format(c='v')} < 858993459 THEN ['?', 'N/A', '', '-'][CAST({_HASH.format(c='v')} % 4 AS INT) + 1] ELSE v END AS v FROM d_priority")(
    lambda f: evidence.corrupt(f, 0.2, target="s").select(F.col(ROW_ID).alias("row_id"), "x", "v")
)


def _logistic(spark, sf_dir):
    f = loaded(spark, sf_dir, "d_balance").withColumn("label", F.when(F.col("g") < 12, "low").otherwise("high"))
    train, test = repair.split(f, "label")
    s = evidence.score_arm(train, test, "label")
    return spark.createDataFrame([(s.auc, s.rows, s.features)], "auc double, n long, features int")


QUERIES["logistic_fit"] = _logistic


def _verdict(spark, sf_dir):
    f = loaded(spark, sf_dir, "d_balance").withColumn("label", F.when(F.col("g") < 12, "low").otherwise("high"))
    return evidence.as_table(spark, [evidence.compare(f, "label", share=0.1)])


QUERIES["verdict"] = _verdict
