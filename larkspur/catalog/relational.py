"""Joins, aggregates, order, sets and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog.registry import add, frame, query, sql
from larkspur.operators import aggregates, joins
from larkspur.session import table

# Equi-joins
query("join_inner", lambda o, c: {"from": o, "join": [{"with": c, "on": ("=", ":o_custkey", ":c_custkey")}], "select": [":o_orderkey", ":c_name", ":c_mktsegment"]}, "orders", "customer", oracle="SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
query("join_left", lambda c, o: {"from": c, "join": [{"with": o, "on": ("=", ":c_custkey", ":o_custkey"), "type": "left"}], "select": [":c_custkey", ":o_orderkey"]}, "customer", "orders", oracle="SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey", "customer", "orders")
sql("join_full", "SELECT a.doc_id AS a, b.doc_id AS b, b.toxic FROM documents a FULL JOIN (SELECT doc_id * 2 AS doc_id, toxic FROM labels) b ON a.doc_id = b.doc_id", "documents", "labels")
sql("join_two_keys", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey, a.l_linenumber", "lineitem")
sql("join_string_key", "SELECT a.c_mktsegment AS seg, count(*) AS n FROM customer a JOIN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 0) b ON a.c_mktsegment = b.c_mktsegment GROUP BY 1", "customer")
sql("join_null_keys", "SELECT a.k AS ak, b.k AS bk FROM (SELECT nullif(n_regionkey, 1) AS k FROM nation) a LEFT JOIN (SELECT nullif(r_regionkey, 1) AS k FROM region) b ON a.k = b.k", "nation", "region")
sql("join_snowflake", "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name", "orders", "customer", "nation", "region")
sql("join_self_aliases", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "nation")
sql("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer", "orders")
sql("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer", "orders")
sql("join_duplicate_keys", "SELECT count(*) AS n FROM orders JOIN (SELECT o_custkey AS k FROM orders) b ON o_custkey = k", "orders")
query("join_group", lambda l, p: {"from": l, "join": [{"with": p, "on": ("=", ":l_partkey", ":p_partkey")}], "group": [":p_brand"], "agg": [("as", ("round", ("sum", ":l_extendedprice"), 2), "total"), ("as", ("count",), "n")]}, "lineitem", "part", oracle="SELECT p_brand, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
sql("join_global_agg", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0", "lineitem", "supplier")

# As-of joins: clicks to the purchases of the same user
_PROBE = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')"
_BUILD = "(SELECT event_id AS buy_id, user_id AS buyer, ts AS buy_ts FROM events WHERE event_type = 'purchase')"


def _sides(e):
    probe = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    build = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("buy_ts"))
    return probe, build


for _name, _op in (("gte", ">="), ("gt", ">"), ("lte", "<="), ("lt", "<")):
    for _how in ("inner", "left"):
        frame(f"asof_{_name}_{_how}", lambda e, op=_op, how=_how: joins.asof_join(*_sides(e), ("ts", op, "buy_ts"), [("user_id", "buyer")], how), "events", oracle=f"SELECT a.*, b.* FROM {_PROBE} a ASOF {'LEFT ' if _how == 'left' else ''}JOIN {_BUILD} b ON a.user_id = b.buyer AND a.ts {_op} b.buy_ts")
_UNIQUE = "QUALIFY row_number() OVER (PARTITION BY buy_ts ORDER BY buy_id DESC) = 1"
frame("asof_no_key", lambda e: joins.asof_join(_sides(e)[0], _sides(e)[1].select("buy_ts", "buy_id"), ("ts", ">=", "buy_ts"), tie=["buy_id"]), "events", oracle=f"SELECT a.*, b.buy_ts, b.buy_id FROM {_PROBE} a ASOF JOIN (SELECT * FROM {_BUILD} {_UNIQUE}) b ON a.ts >= b.buy_ts")
frame("asof_no_key_forward", lambda e: joins.asof_join(_sides(e)[0], _sides(e)[1].select("buy_ts"), ("ts", "<", "buy_ts"), how="left"), "events", oracle=f"SELECT a.*, b.buy_ts FROM {_PROBE} a ASOF LEFT JOIN (SELECT DISTINCT buy_ts FROM {_BUILD}) b ON a.ts < b.buy_ts")
frame("asof_null_keys", lambda e: joins.asof_join(_sides(e)[0].withColumn("user_id", F.nullif("user_id", F.lit(3))), _sides(e)[1].withColumn("buyer", F.nullif("buyer", F.lit(3))), ("ts", ">=", "buy_ts"), [("user_id", "buyer")], "left"), "events", oracle=f"SELECT a.event_id, nullif(a.user_id, 3) AS user_id, a.ts, b.* FROM {_PROBE} a ASOF LEFT JOIN (SELECT buy_id, nullif(buyer, 3) AS buyer, buy_ts FROM {_BUILD}) b ON nullif(a.user_id, 3) = b.buyer AND a.ts >= b.buy_ts")


def _asof_sql(spark, sf_dir):
    from larkspur.plans.sqlfront import Engine

    engine = Engine(spark)
    probe, build = _sides(table(spark, sf_dir, "events"))
    engine.register("clicks", probe)
    engine.register("buys", build)
    return engine.sql("SELECT c.event_id, b.buy_id, c.ts FROM clicks c ASOF LEFT JOIN buys b ON c.user_id = b.buyer AND c.ts >= b.buy_ts")


add("asof_sql", _asof_sql, f"SELECT a.event_id, b.buy_id, a.ts FROM {_PROBE} a ASOF LEFT JOIN {_BUILD} b ON a.user_id = b.buyer AND a.ts >= b.buy_ts")

frame("asof_hot_keys", lambda e: joins.asof_join(*_sides(e), ("ts", ">=", "buy_ts"), [("user_id", "buyer")], "left", hot_keys=True), "events", oracle=f"SELECT a.*, b.* FROM {_PROBE} a ASOF LEFT JOIN {_BUILD} b ON a.user_id = b.buyer AND a.ts >= b.buy_ts")
frame("asof_hot_keys_forward", lambda e: joins.asof_join(*_sides(e), ("ts", "<", "buy_ts"), [("user_id", "buyer")], hot_keys=True), "events", oracle=f"SELECT a.*, b.* FROM {_PROBE} a ASOF JOIN {_BUILD} b ON a.user_id = b.buyer AND a.ts < b.buy_ts")

_HOUR = 3_600_000_000
_WJ = {"n": ("count", "v"), "total": ("sum", "v"), "mean": ("avg", "v"), "low": ("min", "v"), "high": ("max", "v")}


def _window_join(e):
    probe, _ = _sides(e)
    right = e.filter("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("ts").alias("t"), F.col("value").alias("v"))
    out = joins.window_join(probe, right, ("ts", "t"), (-6 * _HOUR, _HOUR), _WJ, [("user_id", "u")])
    return out.select("event_id", F.col("n").alias("n"), F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"), "low", "high")


frame("window_join_all", _window_join, "events", oracle=f"SELECT a.event_id, count(b.value) AS n, round(coalesce(sum(b.value), 0), 4) AS total, round(avg(b.value), 4) AS mean, min(b.value) AS low, max(b.value) AS high FROM {_PROBE} a LEFT JOIN events b ON b.event_type = 'view' AND a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 1 HOUR GROUP BY a.event_id")
frame("latest_on", lambda e: joins.latest_on(e.select("user_id", "ts", "value"), "ts", ["user_id"]), "events", oracle="SELECT user_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
frame("latest_on_oldest", lambda e: joins.latest_on(e.select("user_id", "ts", "value"), "ts", ["user_id"], newest=False), "events", oracle="SELECT user_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) = 1")


def _gap_fill(spark, sf_dir):
    """Every user's last value at each hour."""
    import datetime as dt

    from larkspur.sources.files import generate_series

    data = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), "ts", F.col("value").alias("v"))
    hours = generate_series(spark, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 30), 6, "hours")
    spine = data.select(F.col("u").alias("user_id")).distinct().join(F.broadcast(hours))
    return joins.gap_fill(spine, data, ("value", "ts"), [("user_id", "u")]).select("user_id", "value", "ts", "v")


add("gap_fill", _gap_fill, "SELECT s.user_id, s.value, b.ts, b.v FROM (SELECT user_id, generate_series AS value FROM (SELECT DISTINCT user_id FROM events), generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 6 HOUR)) s ASOF LEFT JOIN (SELECT user_id, ts, value AS v FROM events) b ON s.user_id = b.user_id AND s.value >= b.ts")

# Aggregates
for _name, _agg, _sql in (
    ("count_star", ("count",), "count(*)"), ("count_col", ("count", ("nullif", ":l_returnflag", "A")), "count(nullif(l_returnflag, 'A'))"), ("count_distinct", ("count-distinct", ":l_partkey"), "count(DISTINCT l_partkey)"),
    ("sum", ("round", ("sum", ":l_quantity"), 2), "round(sum(l_quantity), 2)"), ("sum_long", ("sum", ":l_orderkey"), "CAST(sum(l_orderkey) AS BIGINT)"), ("sum_product", ("round", ("sum-product", ":l_extendedprice", ":l_discount"), 2), "round(sum(l_extendedprice * l_discount), 2)"),
    ("avg", ("round", ("avg", ":l_extendedprice"), 4), "round(avg(l_extendedprice), 4)"), ("min", ("min", ":l_extendedprice"), "min(l_extendedprice)"), ("max", ("max", ":l_shipdate"), "max(l_shipdate)"),
    ("min_text", ("min", ":l_linestatus"), "min(l_linestatus)"), ("max_text", ("max", ":l_linestatus"), "max(l_linestatus)"), ("stddev", ("round", ("stddev", ":l_quantity"), 6), "round(stddev_samp(l_quantity), 6)"),
    ("stddev_pop", ("round", ("stddev-pop", ":l_quantity"), 6), "round(stddev_pop(l_quantity), 6)"), ("variance", ("round", ("variance", ":l_quantity"), 6), "round(var_samp(l_quantity), 6)"),
    ("var_pop", ("round", ("var-pop", ":l_quantity"), 6), "round(var_pop(l_quantity), 6)"), ("corr", ("round", ("corr", ":l_quantity", ":l_extendedprice"), 6), "round(corr(l_quantity, l_extendedprice), 6)"),
    ("median", ("median", ":l_extendedprice"), "median(l_extendedprice)"), ("percentile", ("round", ("percentile", ":l_extendedprice", 0.95), 6), "round(quantile_cont(l_extendedprice, 0.95), 6)"),
    ("filter", ("round", ("filter", ("sum", ":l_quantity"), (">", ":l_discount", 0.05)), 2), "round(sum(l_quantity) FILTER (l_discount > 0.05), 2)"), ("filter_count", ("filter", ("count",), ("<", ":l_quantity", 10)), "count(*) FILTER (l_quantity < 10)"),
    ("expression", ("round", ("sum", ("*", ":l_extendedprice", ("-", 1, ":l_discount"))), 2), "round(sum(l_extendedprice * (1 - l_discount)), 2)"), ("compound", ("round", ("-", ("max", ":l_extendedprice"), ("min", ":l_quantity")), 4), "round(max(l_extendedprice) - min(l_quantity), 4)"),
):
    query(f"agg_{_name}", lambda l, a=_agg: {"from": l, "agg": [("as", a, "x")]}, "lineitem", oracle=f"SELECT {_sql} AS x FROM lineitem")
    query(f"agg_{_name}_grouped", lambda l, a=_agg: {"from": l, "group": [":l_returnflag", ":l_linenumber"], "agg": [("as", a, "x")]}, "lineitem", oracle=f"SELECT l_returnflag, l_linenumber, {_sql} AS x FROM lineitem GROUP BY l_returnflag, l_linenumber")
_SHARES = {"low": 0.25, "mid": 0.5, "high": 0.95}
_QUANTILES = "round(quantile_cont({0}, 0.25), 6) AS low, round(quantile_cont({0}, 0.5), 6) AS mid, round(quantile_cont({0}, 0.95), 6) AS high"
_six = lambda df: df.withColumns({n: F.round(n, 6) for n in _SHARES})
frame("agg_percentiles_by_range", lambda l: _six(aggregates.exact_percentiles(l, ["l_returnflag"], "l_extendedprice", _SHARES)), "lineitem", oracle=f"SELECT l_returnflag, {_QUANTILES.format('l_extendedprice')} FROM lineitem GROUP BY 1")
frame("agg_percentiles_by_range_global", lambda l: _six(aggregates.exact_percentiles(l, [], "l_quantity", _SHARES)), "lineitem", oracle=f"SELECT {_QUANTILES.format('l_quantity')} FROM lineitem")
frame("agg_percentiles_by_range_nulls", lambda e: _six(aggregates.exact_percentiles(e.select(F.nullif("event_type", F.lit("view")).alias("g"), F.when(F.col("event_type") != "click", F.col("value")).alias("v")), ["g"], "v", _SHARES)), "events", oracle=f"SELECT nullif(event_type, 'view') AS g, {_QUANTILES.format('v')} FROM (SELECT event_type, CASE WHEN event_type <> 'click' THEN value END AS v FROM events) GROUP BY 1")
query("agg_alias_dedupe", lambda l: {"from": l, "group": [":l_returnflag"], "agg": [("max", ":l_tax"), ("max", ":l_quantity"), ("count",), ("min", ":l_linenumber")]}, "lineitem", oracle="SELECT l_returnflag, max(l_tax) AS max_l_tax, max(l_quantity) AS max_l_quantity, count(*) AS count, min(l_linenumber) AS min FROM lineitem GROUP BY l_returnflag")
sql("agg_percentile_disc", "SELECT l_returnflag, PERCENTILE_DISC(0.25, l_extendedprice) AS p FROM lineitem GROUP BY l_returnflag", "lineitem", oracle="SELECT l_returnflag, quantile_disc(l_extendedprice, 0.25) AS p FROM lineitem GROUP BY l_returnflag")
sql("agg_percentiles", "SELECT PERCENTILE_CONT(0.25, l_quantity) AS a, PERCENTILE_CONT(0.5, l_quantity) AS b, PERCENTILE_CONT(0.75, l_quantity) AS c FROM lineitem", "lineitem", oracle="SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS c FROM lineitem")
add("approx_quantile", lambda spark, d: __import__("larkspur.plans.sqlfront", fromlist=["Engine"]).Engine(spark).over(d, "lineitem").sql("SELECT l_returnflag, APPROX_QUANTILE(l_extendedprice, 0.95) AS p FROM lineitem GROUP BY l_returnflag"))
sql("approx_quantile_rank", "SELECT l_returnflag, abs(avg(CASE WHEN l_extendedprice <= p THEN 1 ELSE 0 END) - 0.95) < 0.01 AS near FROM lineitem JOIN (SELECT l_returnflag AS g, APPROX_QUANTILE(l_extendedprice, 0.95) AS p FROM lineitem GROUP BY l_returnflag) q ON l_returnflag = g GROUP BY l_returnflag", "lineitem", oracle="SELECT DISTINCT l_returnflag, true AS near FROM lineitem")
sql("agg_group_expression", "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1", "orders", oracle="SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n FROM orders GROUP BY 1")
sql("agg_null_group", "SELECT nullif(l_returnflag, 'A') AS g, count(*) AS n, round(sum(l_tax), 4) AS t FROM lineitem GROUP BY 1", "lineitem")
sql("agg_empty_input", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_shipdate) AS m FROM lineitem WHERE l_quantity < 0", "lineitem")
sql("agg_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50 AND max(l_quantity) > avg(l_quantity) AND l_suppkey BETWEEN 2 AND 90", "lineitem")
sql("agg_having_degenerate", "SELECT count(*) AS n FROM lineitem HAVING count(*) > 10", "lineitem")
sql("agg_case_inside", "SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY l_linestatus", "lineitem", oracle="SELECT l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r FROM lineitem GROUP BY l_linestatus")
sql("agg_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem", "lineitem", oracle="SELECT DISTINCT l_returnflag, l_linestatus, l_discount + 0.0::DOUBLE AS l_discount FROM lineitem")
sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
frame("agg_fold_grouped", lambda l: aggregates.fold(l, ["l_linenumber"], "l_tax", 0.0, max, lambda v: 1.0 + v), "lineitem", oracle="SELECT l_linenumber, max(1.0::DOUBLE + l_tax) AS value FROM lineitem GROUP BY l_linenumber")
frame("agg_fold_filtered", lambda o: aggregates.fold(o, [], "o_orderkey", 0, lambda a, b: a ^ b, kind="bigint", where=F.col("o_orderstatus") == "F"), "orders", oracle="SELECT bit_xor(o_orderkey) AS value FROM orders WHERE o_orderstatus = 'F'")
frame("agg_dense_codes", lambda n: aggregates.dense_codes(n, "n_name").select("n_nationkey", "code"), "nation", oracle="SELECT n_nationkey, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS INTEGER) AS code FROM nation")

# Order
sql("sort_multi", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 500", "orders")
sql("sort_nulls_last_asc", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY nullif(n_regionkey, 2), n_nationkey LIMIT 20", "nation", oracle="SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY nullif(n_regionkey, 2) ASC NULLS LAST, n_nationkey LIMIT 20")
sql("sort_nulls_last_desc", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY nullif(n_regionkey, 2) DESC, n_nationkey LIMIT 20", "nation", oracle="SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY nullif(n_regionkey, 2) DESC NULLS LAST, n_nationkey LIMIT 20")
sql("sort_by_unselected_agg", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10", "orders")
sql("sort_limit_zero", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0", "orders")
sql("sort_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 37", "orders")
query("topn_price", lambda l: {"from": l, "order": [(":l_extendedprice", "desc"), (":l_orderkey", "asc"), (":l_partkey", "asc"), (":l_suppkey", "asc"), (":l_linenumber", "asc")], "limit": 25, "select": [":l_orderkey", ":l_extendedprice"]}, "lineitem", oracle="SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 25")
add("sort_head", lambda spark, d: table(spark, d, "orders").select("o_orderkey").limit(10), "SELECT o_orderkey FROM orders LIMIT 10")
sql("topn_per_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2", "orders", oracle="SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders) t WHERE rn <= 2")

# Sets and subqueries
_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier"
sql("set_union_all", f"{_A} UNION ALL {_B}", "customer", "supplier")
sql("set_union", f"{_A} UNION {_B}", "customer", "supplier")
sql("set_intersect", f"{_A} INTERSECT {_B}", "customer", "supplier")
sql("set_except", f"SELECT n_nationkey AS k FROM nation EXCEPT {_B}", "nation", "supplier")
query("set_dict_union", lambda c, s: {"union": [{"from": c, "select": [("as", ":c_nationkey", "k")]}, {"from": s, "select": [("as", ":s_nationkey", "k")]}]}, "customer", "supplier", oracle="SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("sub_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "orders", "customer")
sql("sub_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)", "nation", "supplier")
sql("sub_exists", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3)", "region", "nation")
sql("sub_derived", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) t WHERE n > 10", "customer")
sql("sub_cte_chain", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE t > 100000) SELECT count(*) AS n, round(max(t), 2) AS m FROM b", "orders")
sql("sub_no_from", "SELECT 1 AS a, 'b' AS b")
