"""Window functions and benchmark-shaped queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog.registry import add, frame, query, sql
from larkspur.operators import windows
from larkspur.session import spread, table

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_spec = {"partition": [":user_id"], "order": [":ts", ":event_id"], "as": "x"}
_rows = lambda low, high: f"(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {low} AND {high})"
for _name, _op, _sql in (
    ("row_number", {"op": "row-number"}, f"CAST(row_number() OVER {_W} AS INTEGER)"), ("ntile", {"op": "ntile", "n": 4}, f"CAST(ntile(4) OVER {_W} AS INTEGER)"),
    ("percent_rank", {"op": "percent-rank"}, f"percent_rank() OVER {_W}"), ("cume_dist", {"op": "cume-dist"}, f"cume_dist() OVER {_W}"),
    ("lag", {"op": "lag", "col": ":value"}, f"lag(value) OVER {_W}"), ("lag_default", {"op": "lag", "col": ":value", "n": 2, "default": -1.0}, f"lag(value, 2, -1.0::DOUBLE) OVER {_W}"),
    ("lead", {"op": "lead", "col": ":value", "n": 1}, f"lead(value) OVER {_W}"), ("first_value", {"op": "first-value", "col": ":value"}, f"first_value(value) OVER {_W}"),
    ("last_value", {"op": "last-value", "col": ":value"}, f"last_value(value) OVER {_rows('UNBOUNDED PRECEDING', 'UNBOUNDED FOLLOWING')}"),
    ("nth_value", {"op": "nth-value", "col": ":value", "n": 3}, f"nth_value(value, 3) OVER {_rows('UNBOUNDED PRECEDING', 'UNBOUNDED FOLLOWING')}"),
    ("sum", {"op": "sum", "col": ":event_id"}, f"CAST(sum(event_id) OVER {_rows('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS BIGINT)"), ("count", {"op": "count"}, f"count(*) OVER {_rows('UNBOUNDED PRECEDING', 'CURRENT ROW')}"),
    ("min", {"op": "min", "col": ":value"}, f"min(value) OVER {_rows('UNBOUNDED PRECEDING', 'CURRENT ROW')}"), ("max", {"op": "max", "col": ":value"}, f"max(value) OVER {_rows('UNBOUNDED PRECEDING', 'CURRENT ROW')}"),
    ("frame_sliding", {"op": "sum", "col": ":event_id", "frame": ("rows", -2, 2)}, f"CAST(sum(event_id) OVER {_rows('2 PRECEDING', '2 FOLLOWING')} AS BIGINT)"),
    ("frame_ahead", {"op": "max", "col": ":value", "frame": ("rows", 1, 3)}, f"max(value) OVER {_rows('1 FOLLOWING', '3 FOLLOWING')}"),
    ("frame_rest", {"op": "count", "col": ":value", "frame": ("rows", "current-row", "unbounded-following")}, f"count(value) OVER {_rows('CURRENT ROW', 'UNBOUNDED FOLLOWING')}"),
    ("mmin", {"op": "mmin", "col": ":value", "n": 4}, f"min(value) OVER {_rows('3 PRECEDING', 'CURRENT ROW')}"), ("mmax", {"op": "mmax", "col": ":value", "n": 4}, f"max(value) OVER {_rows('3 PRECEDING', 'CURRENT ROW')}"),
    ("mcount", {"op": "mcount", "col": ":value", "n": 4}, f"count(value) OVER {_rows('3 PRECEDING', 'CURRENT ROW')}"),
):
    query(f"win_{_name}", lambda e, o=_op: {"from": e, "window": [_spec | o], "select": [":event_id", ":x"]}, "events", oracle=f"SELECT event_id, {_sql} AS x FROM events")
for _name, _op, _sql in (
    ("avg", {"op": "avg", "col": ":value"}, f"avg(value) OVER {_rows('UNBOUNDED PRECEDING', 'CURRENT ROW')}"), ("mavg", {"op": "mavg", "col": ":value", "n": 3}, f"avg(value) OVER {_rows('2 PRECEDING', 'CURRENT ROW')}"),
    ("msum", {"op": "msum", "col": ":value", "n": 3}, f"sum(value) OVER {_rows('2 PRECEDING', 'CURRENT ROW')}"), ("mdev", {"op": "mdev", "col": ":value", "n": 5}, f"stddev_pop(value) OVER {_rows('4 PRECEDING', 'CURRENT ROW')}"),
):
    query(f"win_{_name}", lambda e, o=_op: {"from": e, "window": [_spec | o], "select": [":event_id", ("as", ("round", ":x", 8), "x")]}, "events", oracle=f"SELECT event_id, round({_sql}, 8) AS x FROM events")
_T = "(PARTITION BY event_type ORDER BY user_id)"
for _name in ("rank", "dense_rank"):
    query(f"win_{_name}", lambda e, n=_name: {"from": e, "window": [{"op": n.replace("_", "-"), "partition": [":event_type"], "order": [":user_id"], "as": "x"}], "select": [":event_id", ":x"]}, "events", oracle=f"SELECT event_id, CAST({_name}() OVER {_T} AS INTEGER) AS x FROM events")
sql("win_whole_partition", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, max(value) OVER (PARTITION BY user_id) AS m FROM events", "events")
sql("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '12' HOUR PRECEDING AND INTERVAL '1' HOUR FOLLOWING) AS n FROM events", "events")
frame("win_fills", lambda e: e.withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value"))).withColumn("x", windows.fills(F.col("v"), windows.over(["user_id"], ["ts", "event_id"]))).select("event_id", "x"), "events", oracle=f"SELECT event_id, last_value(CASE WHEN event_id % 3 <> 0 THEN value END IGNORE NULLS) OVER {_rows('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS x FROM events")
sql("win_fills_sql", "SELECT event_id, FILLS(nullif(event_type, 'view')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x, MSUM(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events", "events", oracle=f"SELECT event_id, last_value(nullif(event_type, 'view') IGNORE NULLS) OVER {_rows('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS x, CAST(sum(event_id) OVER {_rows('2 PRECEDING', 'CURRENT ROW')} AS BIGINT) AS y FROM events")
query("win_rleid", lambda e: {"from": e, "window": [_spec | {"op": "rleid", "col": ":event_type"}], "select": [":event_id", ":x"]}, "events", oracle=f"WITH t AS (SELECT *, CASE WHEN row_number() OVER {_W} = 1 OR lag(event_type) OVER {_W} IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events) SELECT event_id, CAST(sum(c) OVER {_rows('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS BIGINT) AS x FROM t")
_EMA = """WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, value AS e FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.user_id, o.n, r.e + {a} * (o.value - r.e) FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id, round(e, 9) AS x FROM r"""
for _name, _a, _alpha in (("alpha", 0.3, "0.3::DOUBLE"), ("period", 9, "0.2::DOUBLE")):
    query(f"win_ema_{_name}", lambda e, a=_a: {"from": e.select("event_id", "user_id", "ts", "value"), "window": [_spec | {"op": "ema", "col": ":value", "n": a}], "select": [":event_id", ("as", ("round", ":x", 9), "x")]}, "events", oracle=_EMA.format(a=_alpha))
sql("win_two_windows", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events", "events", oracle="SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS a, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS b FROM events")
sql("win_over_group", "SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS total FROM events GROUP BY event_type", "events", oracle="SELECT event_type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM events GROUP BY event_type")
sql("win_derived_filter", "SELECT event_id FROM (SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) t WHERE r <= 3", "events")

# Benchmark shapes
sql("bench_tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", "lineitem")
sql("bench_tpch_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "lineitem")
sql("bench_ssb_q11", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25", "lineitem")
sql("bench_ssb_q12", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-02-01' AND l_discount BETWEEN 0.04 AND 0.06 AND l_quantity BETWEEN 26 AND 35", "lineitem")
sql("bench_count", "SELECT count(*) AS n FROM lineitem", "lineitem")
sql("bench_filtered_count", "SELECT count(*) AS n FROM lineitem WHERE l_discount <> 0", "lineitem")
sql("bench_low_card_group", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag", "lineitem")
sql("bench_h2o_q1", "SELECT p_brand, round(sum(p_size), 2) AS v FROM part GROUP BY p_brand", "part", oracle="SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS v FROM part GROUP BY p_brand")
sql("bench_h2o_q2", "SELECT l_returnflag, l_suppkey, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY l_returnflag, l_suppkey", "lineitem")
sql("bench_h2o_q3", "SELECT l_partkey, round(sum(l_quantity), 2) AS v1, round(avg(l_tax), 6) AS v3 FROM lineitem GROUP BY l_partkey", "lineitem")
sql("bench_h2o_q4", "SELECT l_suppkey, round(avg(l_quantity), 6) AS v1, round(avg(l_discount), 6) AS v2, round(avg(l_tax), 6) AS v3 FROM lineitem GROUP BY l_suppkey", "lineitem")
sql("bench_h2o_q5", "SELECT l_orderkey, round(sum(l_quantity), 2) AS v1, round(sum(l_discount), 4) AS v2, round(sum(l_tax), 4) AS v3 FROM lineitem GROUP BY l_orderkey", "lineitem")
sql("bench_h2o_q6", "SELECT l_suppkey, l_linenumber, round(stddev(l_extendedprice), 4) AS sd, median(l_quantity) AS md FROM lineitem GROUP BY l_suppkey, l_linenumber", "lineitem")
sql("bench_h2o_q7", "SELECT l_partkey, round(max(l_extendedprice) - min(l_quantity), 4) AS r FROM lineitem GROUP BY l_partkey", "lineitem")
sql("bench_h2o_q8", "SELECT l_partkey, l_extendedprice FROM (SELECT l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) t WHERE rn <= 2", "lineitem")
sql("bench_h2o_q9", "SELECT l_returnflag, l_suppkey, round(pow(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem GROUP BY l_returnflag, l_suppkey", "lineitem")
sql("bench_h2o_q10", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6", "lineitem")
sql("bench_h2o_j1", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS a, round(sum(s_acctbal), 2) AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey", "lineitem", "supplier")
sql("bench_h2o_j3", "SELECT count(*) AS n, count(o_orderkey) AS m, round(sum(l_quantity), 2) AS a FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o_orderkey", "lineitem", "orders")
sql("bench_h2o_j2", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS a, round(sum(o_totalprice), 2) AS b FROM lineitem JOIN (SELECT o_orderkey, o_totalprice, 1 AS o_line FROM orders) o ON l_orderkey = o_orderkey AND l_linenumber = o_line", "lineitem", "orders")
sql("bench_cb_minute_trunc", "SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY 1", "events", oracle="SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS m, count(*) AS n FROM events GROUP BY 1")
sql("bench_percentiles", "SELECT PERCENTILE_CONT(0.25, l_quantity) AS a, PERCENTILE_CONT(0.5, l_quantity) AS b, PERCENTILE_CONT(0.75, l_quantity) AS c FROM lineitem", "lineitem", oracle="SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS c FROM lineitem")
sql("bench_win_row_number", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem", "lineitem", oracle="SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rn FROM lineitem")
sql("bench_semi", "SELECT round(sum(o_totalprice), 2) AS v, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 5)", "orders", "customer")
sql("bench_cb_minute", "SELECT CAST(extract(MINUTE FROM ts) AS INTEGER) AS m, count(*) AS n FROM events GROUP BY 1", "events")
sql("bench_cb_user_group", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10", "events")
sql("bench_cb_distinct_top", "SELECT event_type, count(DISTINCT user_id) AS u, count(*) AS n, round(avg(value), 4) AS a FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10", "events")
sql("bench_cb_like", "SELECT count(*) AS n FROM pages WHERE url LIKE '%example%'", "pages")
sql("bench_cb_url_length", "SELECT round(avg(length(url)), 6) AS a, count(*) AS n FROM pages HAVING count(*) > 10", "pages")
sql("bench_cb_string_group", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name", "part")
sql("bench_taxi_hour_dow", "SELECT EXTRACT(HOUR FROM ts) AS h, EXTRACT(DOW FROM ts) AS d, count(*) AS n FROM events GROUP BY 1, 2", "events", oracle="SELECT CAST(extract(HOUR FROM ts) AS BIGINT) AS h, CAST(extract(DOW FROM ts) AS BIGINT) AS d, count(*) AS n FROM events GROUP BY 1, 2")
sql("bench_taxi_month", "SELECT month(o_orderdate) AS m, round(sum(o_totalprice), 2) AS t FROM orders WHERE o_totalprice > 100000 GROUP BY 1", "orders", oracle="SELECT CAST(month(o_orderdate) AS INTEGER) AS m, round(sum(o_totalprice), 2) AS t FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
sql("bench_join_dim", "SELECT p_type, round(sum(l_extendedprice), 2) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type", "lineitem", "part")
sql("bench_stat_median", "SELECT l_returnflag, median(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag", "lineitem")
sql("bench_win_running", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 2) AS s FROM lineitem", "lineitem", oracle="SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING), 2) AS s FROM lineitem")
sql("bench_ds_store", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS s, count(*) AS n FROM lineitem GROUP BY l_suppkey", "lineitem")


def _forest(spark, sf_dir):
    """Scores of all line items, by a forest trained on a bounded sample."""
    from larkspur.operators import iforest

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    forest = iforest.train(rows, ["l_quantity", "l_extendedprice"], contamination=0.02)
    return spread(rows).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", iforest.anomaly_score(forest).alias("score"), iforest.anomaly_predict(forest).alias("outlier"), iforest.anomaly_proba(forest).alias("proba"), iforest.anomaly_confidence(forest).alias("confidence"))


add("iforest_scores", _forest)


def _forest_sql(spark, sf_dir):
    from larkspur.plans.sqlfront import Engine

    engine = Engine(spark).over(sf_dir, "events")
    engine.sql("CREATE MODEL odd TYPE ISOLATION_FOREST OPTIONS (n_trees = 50, contamination = 0.05) AS SELECT value FROM events")
    return engine.sql("SELECT event_id, ANOMALY_SCORE('odd') AS score, ANOMALY_PREDICT('odd', value) AS outlier FROM events")


add("iforest_sql", _forest_sql)


def _forest_bounds(spark, sf_dir):
    """Scores lie in (0, 1), an outlier's is above the threshold, and a score is the same in both forms."""
    from larkspur.operators import iforest
    from larkspur.plans.sqlfront import Engine

    engine = Engine(spark).over(sf_dir, "events")
    engine.sql("CREATE MODEL odd TYPE ISOLATION_FOREST OPTIONS (n_trees = 50, sample_size = 128, contamination = 0.05) AS SELECT value FROM events")
    forest = engine.models["odd"]
    out = engine.sql("SELECT event_id, value, ANOMALY_SCORE('odd') AS score, ANOMALY_PREDICT('odd', value) AS outlier, ANOMALY_PROBA('odd') AS proba, ANOMALY_CONFIDENCE('odd') AS confidence FROM events")
    score = F.col("score")
    return out.select(
        "event_id", score.between(0.01, 0.99).alias("score_holds"), ((score > forest.threshold) == (F.col("outlier") == 1)).alias("outlier_holds"), F.col("proba").between(0, 1).alias("proba_holds"),
        ((F.col("confidence") > 0) & (F.col("confidence") <= 1)).alias("confidence_holds"), (F.abs(score - iforest.anomaly_score(forest)) < 1e-12).alias("forms_agree"),
        (F.abs(score - iforest.anomaly_weighted(forest, 0.5)) < 1e-12).alias("weights_of_one_age_agree"),
    )


add("iforest_bounds", _forest_bounds, "SELECT event_id, true AS score_holds, true AS outlier_holds, true AS proba_holds, true AS confidence_holds, true AS forms_agree, true AS weights_of_one_age_agree FROM events")


def _model_statements(spark, sf_dir):
    from larkspur.operators import iforest
    from larkspur.plans.sqlfront import Engine

    engine = Engine(spark).over(sf_dir, "events")
    engine.sql("CREATE MODEL one TYPE ISOLATION_FOREST OPTIONS (n_trees = 20, sample_size = 64) AS SELECT value, user_id FROM events")
    engine.sql("CREATE MODEL two TYPE ISOLATION_FOREST AS SELECT value FROM events")
    engine.sql("DROP MODEL two")
    engine.sql("DROP MODEL IF EXISTS two")
    turned = iforest.rotate(engine.models["one"], engine.tables["events"], 5)
    told = engine.sql("DESCRIBE MODEL one").filter("property in ('features', 'trees', 'sample_size')")
    ages = spark.createDataFrame([("ages after rotation", ",".join(map(str, sorted(set(turned.ages))))), ("trees after rotation", str(len(turned.trees)))], "property string, value string")
    return told.unionByName(ages).unionByName(engine.sql("SHOW MODELS").select(F.col("name").alias("property"), F.col("trees").cast("string").alias("value")))


add("model_statements", _model_statements, "SELECT * FROM (VALUES ('features', 'value, user_id'), ('trees', '20'), ('sample_size', '64'), ('ages after rotation', '0,1'), ('trees after rotation', '20'), ('one', '20')) t(property, value)")
