"""Scans, filters, projections, expressions and functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from larkspur.catalog.registry import add, frame, query, sql
from larkspur.functions.periods import PREDICATES
from larkspur.plans.sqlfront import _PERIOD_SQL, Engine
from larkspur.sources import files

# Scans and sources
query("scan_columns", lambda o: {"from": o, "select": [":o_orderkey", ":o_custkey", ":o_orderstatus"]}, "orders", oracle="SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
query("scan_pushed_filter", lambda l: {"from": l, "where": [("<", ":l_quantity", 5), ("=", ":l_returnflag", "R")], "select": [":l_orderkey", ":l_quantity"]}, "lineitem", oracle="SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R'")
add("scan_read_parquet_function", lambda spark, d: Engine(spark).sql(f"SELECT n_nationkey, n_name FROM read_parquet('{d}/nation.parquet') WHERE n_regionkey = 1"), "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
add("scan_quoted_path", lambda spark, d: Engine(spark).sql(f"SELECT r_regionkey, r_name FROM '{d}/region.parquet'"), "SELECT r_regionkey, r_name FROM region")
add("scan_series_int", lambda spark, d: files.generate_series(spark, 1, 1000, 7), "SELECT generate_series AS value FROM generate_series(1, 1000, 7)")
add("scan_series_double", lambda spark, d: files.generate_series(spark, 0.5, 10.0, 0.5), "SELECT 0.5::DOUBLE + i * 0.5::DOUBLE AS value FROM range(0, 20) t(i)")
add("scan_series_hours", lambda spark, d: files.generate_series(spark, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3), 5, "hours"), "SELECT generate_series AS value FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 5 HOUR)")
add("scan_series_months", lambda spark, d: files.generate_series(spark, dt.datetime(2020, 1, 1), dt.datetime(2021, 6, 15), 2, "months"), "SELECT generate_series AS value FROM generate_series(TIMESTAMP '2020-01-01', TIMESTAMP '2021-06-15', INTERVAL 2 MONTH)")
add("scan_row_maps", lambda spark, d: files.from_maps(spark, [{"a": 1, "b": "x"}, {"a": None, "b": None}, {"a": 3, "b": "z"}]), "SELECT * FROM (VALUES (1::BIGINT, 'x'), (NULL, NULL), (3, 'z')) t(a, b)")
frame("scan_missing_counts", lambda c: files.missing(c.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))), "customer", oracle="SELECT count(*) FILTER (c_custkey IS NULL) AS c_custkey, count(*) FILTER (nullif(c_mktsegment, 'BUILDING') IS NULL) AS seg FROM customer")

# Predicates, in the dict form
L = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE "
_shown = [":l_orderkey", ":l_partkey", ":l_suppkey", ":l_linenumber"]
for _name, _pred, _where in (
    ("lt", ("<", ":l_quantity", 10), "l_quantity < 10"), ("le", ("<=", ":l_quantity", 10), "l_quantity <= 10"), ("gt", (">", ":l_extendedprice", 50000.0), "l_extendedprice > 50000"),
    ("ge", (">=", ":l_quantity", 45), "l_quantity >= 45"), ("eq", ("=", ":l_linestatus", "O"), "l_linestatus = 'O'"), ("ne", ("!=", ":l_returnflag", "N"), "l_returnflag <> 'N'"),
    ("col_vs_col", (">", ":l_partkey", ":l_orderkey"), "l_partkey > l_orderkey"), ("between", ("between", ":l_quantity", 10, 20), "l_quantity BETWEEN 10 AND 20"),
    ("not_between", ("not-between", ":l_quantity", 10, 40), "l_quantity NOT BETWEEN 10 AND 40"), ("in_list", ("in", ":l_linenumber", [1, 3, 7]), "l_linenumber IN (1, 3, 7)"),
    ("in_null", ("in", ":l_returnflag", ["A", None]), "l_returnflag IN ('A', NULL)"), ("not_in", ("not-in", ":l_linenumber", [1, 2]), "l_linenumber NOT IN (1, 2)"),
    ("not_in_null", ("not-in", ":l_linenumber", [1, None]), "l_linenumber NOT IN (1, NULL)"), ("or", ("or", ("<", ":l_quantity", 2), ("=", ":l_returnflag", "A")), "l_quantity < 2 OR l_returnflag = 'A'"),
    ("not_and", ("not", ("and", ("<", ":l_quantity", 30), ("=", ":l_returnflag", "N"))), "NOT (l_quantity < 30 AND l_returnflag = 'N')"),
    ("expression", (">", ("*", ":l_extendedprice", ":l_discount"), 2000.0), "l_extendedprice * l_discount > 2000"),
):
    query(f"filter_{_name}", lambda l, p=_pred: {"from": l, "where": [p], "select": _shown}, "lineitem", oracle=L + _where)
for _name, _pred, _where in (
    ("like", ("like", ":p_name", "%a%e%"), "p_name LIKE '%a%e%'"), ("not_like", ("not-like", ":p_type", "%S_EEL%"), "p_type NOT LIKE '%S_EEL%'"), ("like_escape", ("like", ("concat", ":p_brand", "50%"), "%50!%", "!"), "concat(p_brand, '50%') LIKE '%50!%' ESCAPE '!'"),
    ("ilike", ("ilike", ":p_name", "%A%"), "p_name ILIKE '%A%'"), ("not_ilike", ("not-ilike", ":p_name", "%B%"), "p_name NOT ILIKE '%B%'"), ("contains", ("contains", ":p_name", "ar"), "contains(p_name, 'ar')"),
    ("starts_with", ("starts-with", ":p_brand", "Brand#1"), "starts_with(p_brand, 'Brand#1')"), ("ends_with", ("ends-with", ":p_brand", "3"), "ends_with(p_brand, '3')"),
    ("is_null", ("is-null", ("nullif", ":p_size", 10)), "nullif(p_size, 10) IS NULL"), ("is_not_null", ("is-not-null", ("nullif", ":p_size", 10)), "nullif(p_size, 10) IS NOT NULL"),
):
    query(f"filter_{_name}", lambda p, w=_pred: {"from": p, "where": [w], "select": [":p_partkey", ":p_name"]}, "part", oracle=f"SELECT p_partkey, p_name FROM part WHERE {_where}")
query("filter_row_function", lambda c: {"from": c, "where": [("fn", ":c_acctbal", lambda v: v > 1000 and int(v) % 2 == 0)], "select": [":c_custkey"]}, "customer", oracle="SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND CAST(trunc(c_acctbal) AS BIGINT) % 2 = 0")
_EV = "(SELECT event_id, event_id % 97 AS a, event_id % 97 + event_id % 13 AS b, event_id % 89 AS c, event_id % 89 + event_id % 17 AS d FROM events)"
for _name in PREDICATES:
    sql(f"allen_{_name}", f"SELECT event_id FROM {_EV} t WHERE {_name}(a, b, c, d)", "events", oracle=f"SELECT event_id FROM {_EV} t WHERE {_PERIOD_SQL[_name].format('a', 'b', 'c', 'd')}")

# Numbers
for _name, _expr, _sql in (
    ("arith", ("-", ("+", ":l_linenumber", ("*", ":l_orderkey", 2)), 1), "l_linenumber + l_orderkey * 2 - 1"), ("div", ("/", ":l_orderkey", ":l_linenumber"), "l_orderkey / CAST(l_linenumber AS DOUBLE)"),
    ("div_zero", ("/", ":l_orderkey", ("-", ":l_linenumber", 1)), "l_orderkey / CAST(nullif(l_linenumber - 1, 0) AS DOUBLE)"), ("mod", ("%", ("-", 3, ":l_orderkey"), 7), "(3 - l_orderkey) % 7"),
    ("mod_zero", ("%", ":l_orderkey", ("-", ":l_linenumber", 1)), "l_orderkey % nullif(l_linenumber - 1, 0)"), ("neg", ("-", ":l_orderkey"), "-l_orderkey"), ("abs", ("abs", ("-", ":l_orderkey", 100)), "abs(l_orderkey - 100)"),
    ("sqrt", ("round", ("sqrt", ("-", ":l_quantity", 5)), 6), "round(CASE WHEN l_quantity - 5 >= 0 THEN sqrt(l_quantity - 5) END, 6)"), ("round", ("round", ("-", ":l_extendedprice", 30000.5)), "round(l_extendedprice - 30000.5)"),
    ("round_digits", ("round", ":l_extendedprice", 1), "round(l_extendedprice, 1)"), ("floor", ("cast", ("floor", ("-", ":l_extendedprice", 30000.5)), "double"), "floor(l_extendedprice - 30000.5)"),
    ("ceil", ("cast", ("ceil", ":l_extendedprice"), "double"), "ceil(l_extendedprice)"), ("sign", ("sign", ("-", ":l_quantity", 25)), "CAST(sign(l_quantity - 25) AS DOUBLE)"),
    ("ln", ("round", ("log", ":l_extendedprice"), 9), "round(ln(l_extendedprice), 9)"), ("log10", ("round", ("log10", ":l_extendedprice"), 9), "round(log10(l_extendedprice), 9)"),
    ("exp", ("round", ("exp", ":l_discount"), 9), "round(exp(l_discount), 9)"), ("pow", ("round", ("pow", ":l_quantity", 1.5), 6), "round(pow(l_quantity, 1.5), 6)"),
    ("greatest", ("greatest", ":l_quantity", ("nullif", ":l_tax", 0.0), 20.0), "greatest(l_quantity, nullif(l_tax, 0.0::DOUBLE), 20.0::DOUBLE)"), ("least", ("least", ":l_quantity", ("nullif", ":l_tax", 0.02), 20.0), "least(l_quantity, nullif(l_tax, 0.02::DOUBLE), 20.0::DOUBLE)"),
    ("coalesce", ("coalesce", ("nullif", ":l_linenumber", 1), ("nullif", ":l_linenumber", 2), -1), "coalesce(nullif(l_linenumber, 1), nullif(l_linenumber, 2), -1)"), ("nullif", ("nullif", ":l_linenumber", 3), "nullif(l_linenumber, 3)"),
    ("case_number", ("case", [("<", ":l_quantity", 10), 1], [("<", ":l_quantity", 30), 2], ["else", 3]), "CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 30 THEN 2 ELSE 3 END"),
    ("case_text", ("case", [("=", ":l_returnflag", "R"), "returned"], [("=", ":l_returnflag", "A"), ":l_linestatus"]), "CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_returnflag = 'A' THEN l_linestatus END"),
    ("cast_long", ("cast", ("substr", ("cast", ":l_orderkey", "string"), 1, 2), "long"), "TRY_CAST(substr(CAST(l_orderkey AS VARCHAR), 1, 2) AS BIGINT)"), ("cast_bad", ("cast", ":l_returnflag", "double"), "TRY_CAST(l_returnflag AS DOUBLE)"),
    ("literal", 42, "42"),
):
    query(f"fn_math_{_name}", lambda l, e=_expr: {"from": l, "select": [*_shown, ("as", e, "x")]}, "lineitem", oracle=f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_sql} AS x FROM lineitem")
sql("fn_case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders", "orders")
sql("fn_constants", "SELECT 1 + 2 * 3 AS a, 'x' AS b, CAST('2024-02-29' AS DATE) AS d", oracle="SELECT 1 + 2 * 3 AS a, 'x' AS b, DATE '2024-02-29' AS d")
sql("fn_cast_date", "SELECT o_orderkey FROM orders WHERE o_orderdate < CAST('1996-01-01' AS TIMESTAMP) AND CAST(o_orderdate AS DATE) >= CAST('1995-06-01' AS DATE)", "orders")

# Texts
for _name, _expr, _sql in (
    ("upper", ("upper", ":p_name"), "upper(p_name)"), ("lower", ("lower", ":p_type"), "lower(p_type)"), ("substr", ("substr", ":p_type", 3, 4), "substr(p_type, 3, 4)"), ("substr_rest", ("substr", ":p_type", 4), "substr(p_type, 4)"),
    ("substr_clamped", ("substr", ":p_type", -2, 3), "substr(p_type, 1, 3)"), ("length", ("length", ":p_name"), "CAST(length(p_name) AS INTEGER)"), ("replace", ("replace", ":p_brand", "Brand", "B"), "replace(p_brand, 'Brand', 'B')"),
    ("trim", ("trim", ("concat", "  ", ":p_brand", " ")), "trim(concat('  ', p_brand, ' '))"), ("concat", ("concat", ":p_brand", "-", ":p_type"), "concat(p_brand, '-', p_type)"),
    ("concat_null", ("concat", ":p_brand", ("nullif", ":p_type", "x")), "concat(p_brand, nullif(p_type, 'x'))"),
):
    query(f"fn_str_{_name}", lambda p, e=_expr: {"from": p, "select": [":p_partkey", ("as", e, "x")]}, "part", oracle=f"SELECT p_partkey, {_sql} AS x FROM part")
sql("fn_str_in_group", "SELECT upper(substr(p_type, 1, 3)) AS t, count(*) AS n FROM part WHERE length(p_name) > 5 GROUP BY upper(substr(p_type, 1, 3)) ORDER BY t", "part")

# Dates
for _unit in ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "decade"):
    query(f"fn_date_trunc_{_unit}", lambda e, u=_unit: {"from": e, "select": [":event_id", ("as", ("date-trunc", u, ":ts"), "t")]}, "events", oracle=f"SELECT event_id, CAST(date_trunc('{_unit}', ts) AS TIMESTAMP) AS t FROM events")
for _unit, _span in (("century", 100), ("millennium", 1000)):
    query(f"fn_date_trunc_{_unit}", lambda e, u=_unit: {"from": e, "select": [":event_id", ("as", ("date-trunc", u, ":ts"), "t")]}, "events", oracle=f"SELECT event_id, make_timestamp(year(ts) - (year(ts) - 1) % {_span}, 1, 1, 0, 0, 0) AS t FROM events")
for _unit in ("millisecond", "microsecond"):
    query(f"fn_date_trunc_{_unit}", lambda e, u=_unit: {"from": e, "select": [":event_id", ("as", ("date-trunc", u, ":ts"), "t")]}, "events", oracle=f"SELECT event_id, date_trunc('{_unit}s', ts) AS t FROM events")
for _field in ("year", "month", "day", "hour", "minute", "second", "dow", "isodow", "week", "quarter", "decade", "century", "millennium", "millisecond", "microsecond"):
    query(f"fn_extract_{_field}", lambda e, u=_field: {"from": e, "select": [":event_id", ("as", ("extract", u, ":ts"), "x")]}, "events", oracle=f"SELECT event_id, CAST(extract({_field} FROM ts) AS BIGINT) AS x FROM events")
query("fn_extract_nanosecond", lambda e: {"from": e, "select": [":event_id", ("as", ("extract", "nanosecond", ":ts"), "x")]}, "events", oracle="SELECT event_id, extract(microsecond FROM ts) * 1000 AS x FROM events")
for _unit, _n in (("days", 30), ("hours", -5), ("minutes", 90), ("seconds", 1), ("milliseconds", 250), ("microseconds", 7), ("weeks", 2), ("months", 13), ("years", -1)):
    query(f"fn_date_add_{_unit}", lambda o, u=_unit, n=_n: {"from": o, "select": [":o_orderkey", ("as", ("date-add", u, n, ":o_orderdate"), "t")]}, "orders", oracle=f"SELECT o_orderkey, o_orderdate + INTERVAL ({_n}) {_unit} AS t FROM orders")
sql("fn_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '3' DAY AS a, o_orderdate - INTERVAL '2' MONTH AS b FROM orders", "orders")
for _unit, _us in (("seconds", 10**6), ("hours", 36 * 10**8), ("days", 864 * 10**8)):
    query(f"fn_date_diff_{_unit}", lambda e, u=_unit: {"from": e, "select": [":event_id", ("as", ("round", ("date-diff", u, ":ts", dt.datetime(2024, 1, 15)), 6), "x")]}, "events", oracle=f"SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / {_us}.0::DOUBLE, 6) AS x FROM events")
for _name, _n, _unit in (("5min", 5, "minutes"), ("6h", 6, "hours"), ("3d", 3, "days"), ("2w", 2, "weeks"), ("2months", 2, "months")):
    query(f"fn_time_bucket_{_name}", lambda e, n=_n, u=_unit: {"from": e, "select": [":event_id", ("as", ("time-bucket", n, u, ":ts"), "t")]}, "events", oracle=f"SELECT event_id, CAST(time_bucket(INTERVAL {_n} {_unit}, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS t FROM events")
query("fn_time_bucket_origin", lambda e: {"from": e, "select": [":event_id", ("as", ("time-bucket", 7, "hours", ":ts", dt.datetime(2024, 1, 1, 3)), "t")]}, "events", oracle="SELECT event_id, time_bucket(INTERVAL 7 HOURS, ts, TIMESTAMP '2024-01-01 03:00:00') AS t FROM events")
sql("fn_time_bucket_group", "SELECT TIME_BUCKET(1, 'day', ts) AS d, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1 ORDER BY 1", "events", oracle="SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS d, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1")
query("fn_epoch", lambda e: {"from": e, "select": [":event_id", ("as", ("epoch-days", ":ts"), "d"), ("as", ("epoch-seconds", ":ts"), "s")]}, "events", oracle="SELECT event_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS d, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events")
sql("fn_date_group", "SELECT extract(HOUR FROM ts) AS h, count(*) AS n FROM events GROUP BY 1", "events", oracle="SELECT CAST(extract(HOUR FROM ts) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1")
