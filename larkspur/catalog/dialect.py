"""Functions, as-of joins, scans and session statements in the SQL form, and sources by way of files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspur.catalog.registry import add, sql
from larkspur.plans import dsl
from larkspur.plans.explain import compiled
from larkspur.plans.sqlfront import Engine
from larkspur.session import shared_root, table
from larkspur.sources import files
from larkspur.sources.store import Store

_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
for _name, _expr, _sql in (
    ("div", "l_orderkey / l_linenumber", "l_orderkey / CAST(l_linenumber AS DOUBLE)"), ("div_zero", "l_orderkey / (l_linenumber - 1)", "l_orderkey / CAST(nullif(l_linenumber - 1, 0) AS DOUBLE)"),
    ("div_literal", "l_linenumber / 2.5", "l_linenumber / 2.5::DOUBLE"), ("mod", "(3 - l_orderkey) % 7", "(3 - l_orderkey) % 7"), ("mod_zero", "l_orderkey % (l_linenumber - 1)", "l_orderkey % nullif(l_linenumber - 1, 0)"),
    ("mod_call", "MOD(l_orderkey, l_linenumber - 1)", "l_orderkey % nullif(l_linenumber - 1, 0)"), ("sqrt", "round(SQRT(l_quantity - 5), 6)", "round(CASE WHEN l_quantity >= 5 THEN sqrt(l_quantity - 5) END, 6)"),
    ("ln", "round(LN(l_quantity - 5), 6)", "round(CASE WHEN l_quantity > 5 THEN ln(l_quantity - 5) END, 6)"), ("log", "round(LOG(l_extendedprice), 9)", "round(ln(l_extendedprice), 9)"), ("log10", "round(LOG10(l_extendedprice), 9)", "round(log10(l_extendedprice), 9)"),
    ("cast_bad", "CAST(l_returnflag AS DOUBLE)", "TRY_CAST(l_returnflag AS DOUBLE)"), ("cast_long", "CAST(SUBSTR(CAST(l_orderkey AS VARCHAR), 1, 2) AS LONG)", "TRY_CAST(substr(CAST(l_orderkey AS VARCHAR), 1, 2) AS BIGINT)"),
    ("cast_date", "CAST(CONCAT('2024-0', l_linenumber, '-30') AS DATE)", "TRY_CAST('2024-0' || l_linenumber || '-30' AS DATE)"), ("greatest", "GREATEST(l_quantity, nullif(l_tax, 0.0), 20.0)", "greatest(l_quantity, nullif(l_tax, 0.0::DOUBLE), 20.0::DOUBLE)"),
    ("sign", "SIGN(l_quantity - 25)", "CAST(sign(l_quantity - 25) AS DOUBLE)"), ("identifier", '"l_quantity" * 2', "l_quantity * 2"),
):
    sql(f"sql_fn_math_{_name}", f"SELECT {_KEYS}, {_expr} AS x FROM lineitem", "lineitem", oracle=f"SELECT {_KEYS}, {_sql} AS x FROM lineitem")
for _name, _expr, _sql in (
    ("substr_clamped", "SUBSTR(p_type, -2, 3)", "substr(p_type, 1, 3)"), ("substr_zero", "SUBSTRING(p_type, 0, 2)", "substr(p_type, 1, 2)"), ("substr_rest", "SUBSTR(p_type, 4)", "substr(p_type, 4)"),
    ("substring_from", "SUBSTRING(p_type FROM 2 FOR 3)", "substr(p_type, 2, 3)"), ("concat_null", "CONCAT(p_brand, nullif(p_size, 10), '-', nullif(p_type, p_type))", "concat(p_brand, nullif(p_size, 10), '-', NULL)"),
    ("quoted", "replace(p_brand, 'Brand#', '\"B\"')", "replace(p_brand, 'Brand#', '\"B\"')"),
):
    sql(f"sql_fn_str_{_name}", f"SELECT p_partkey, {_expr} AS x FROM part", "part", oracle=f"SELECT p_partkey, {_sql} AS x FROM part")
for _field in ("year", "month", "day", "hour", "minute", "second", "dow", "isodow", "week", "quarter", "decade", "century", "millennium", "millisecond", "microsecond"):
    sql(f"sql_fn_extract_{_field}", f"SELECT event_id, EXTRACT({_field.upper()} FROM ts) AS x FROM events", "events", oracle=f"SELECT event_id, CAST(extract({_field} FROM ts) AS BIGINT) AS x FROM events")
sql("sql_fn_extract_nanosecond", "SELECT event_id, EXTRACT(NANOSECOND FROM ts) AS x FROM events", "events", oracle="SELECT event_id, extract(microsecond FROM ts) * 1000 AS x FROM events")
for _unit, _sql in (
    ("decade", "CAST(date_trunc('decade', ts) AS TIMESTAMP)"), ("century", "make_timestamp(year(ts) - (year(ts) - 1) % 100, 1, 1, 0, 0, 0)"), ("millennium", "make_timestamp(year(ts) - (year(ts) - 1) % 1000, 1, 1, 0, 0, 0)"),
    ("week", "CAST(date_trunc('week', ts) AS TIMESTAMP)"), ("millisecond", "date_trunc('milliseconds', ts)"),
):
    sql(f"sql_fn_date_trunc_{_unit}", f"SELECT event_id, DATE_TRUNC('{_unit}', ts) AS t FROM events", "events", oracle=f"SELECT event_id, {_sql} AS t FROM events")
_INSIDE = "(epoch_us({0}) - epoch_us(CAST(date_trunc('month', {0}) AS TIMESTAMP)))"
_ORIGIN = "TIMESTAMP '2024-01-15 06:00:00'"
for _unit, _span in (("months", 1), ("quarters", 3), ("years", 12)):
    sql(f"sql_fn_date_diff_{_unit}", f"SELECT o_orderkey, round(DATE_DIFF('{_unit}', o_orderdate, {_ORIGIN}), 9) AS x FROM orders", "orders", oracle=f"SELECT o_orderkey, round(((year(o_orderdate) * 12 + month(o_orderdate) - 2024 * 12 - 1) + ({_INSIDE.format('o_orderdate')} - {_INSIDE.format(_ORIGIN)}) / 2678400000000.0::DOUBLE) / {_span}.0::DOUBLE, 9) AS x FROM orders")
for _unit, _us in (("seconds", 10**6), ("hours", 36 * 10**8), ("days", 864 * 10**8), ("weeks", 6048 * 10**8)):
    sql(f"sql_fn_date_diff_{_unit}", f"SELECT event_id, round(DATE_DIFF('{_unit}', ts, {_ORIGIN}), 6) AS x FROM events", "events", oracle=f"SELECT event_id, round((epoch_us(ts) - epoch_us({_ORIGIN})) / {_us}.0::DOUBLE, 6) AS x FROM events")
for _name, _n, _unit in (("5min", 5, "minutes"), ("2w", 2, "weeks"), ("2months", 2, "months"), ("quarter", 1, "quarters"), ("5years", 5, "years")):
    sql(f"sql_fn_time_bucket_{_name}", f"SELECT event_id, TIME_BUCKET({_n}, '{_unit}', ts) AS t FROM events", "events", oracle=f"SELECT event_id, CAST(time_bucket(INTERVAL {_n} {_unit}, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS t FROM events")
sql("sql_fn_time_bucket_origin", "SELECT event_id, TIME_BUCKET(5, 'months', ts, TIMESTAMP '2023-03-01') AS t FROM events", "events", oracle="SELECT event_id, CAST(time_bucket(INTERVAL 5 MONTHS, ts, TIMESTAMP '2023-03-01') AS TIMESTAMP) AS t FROM events")
sql("sql_fn_in_where", "SELECT EXTRACT(DOW FROM ts) AS d, COUNT(*) AS n, round(SUM(value) / (COUNT(*) - COUNT(*)), 2) AS nothing FROM events WHERE EXTRACT(ISODOW FROM ts) < 6 AND SQRT(value) >= 0 GROUP BY EXTRACT(DOW FROM ts) ORDER BY d", "events", oracle="SELECT CAST(extract(DOW FROM ts) AS BIGINT) AS d, count(*) AS n, CAST(NULL AS DOUBLE) AS nothing FROM events WHERE extract(ISODOW FROM ts) < 6 AND value >= 0 GROUP BY 1")

# EMA and RLEID
_O = "(PARTITION BY user_id ORDER BY ts, event_id)"
_EMA = """WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events{where}),
r AS (SELECT event_id, user_id, n, value AS e FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.user_id, o.n, r.e + {a} * (o.value - r.e) FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id, round(e, 9) AS x FROM r"""
_RLE = f"WITH t AS (SELECT *, CASE WHEN row_number() OVER {_O} = 1 OR lag(event_type) OVER {_O} IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events) SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS x FROM t"
sql("sql_win_ema_alpha", f"SELECT event_id, round(EMA(value, 0.3) OVER {_O}, 9) AS x FROM events", "events", oracle=_EMA.format(a="0.3::DOUBLE", where=""))
sql("sql_win_ema_period", f"SELECT e.event_id, round(EMA(e.value, 9) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id), 9) AS x FROM events e WHERE e.event_type <> 'view'", "events", oracle=_EMA.format(a="0.2::DOUBLE", where=" WHERE event_type <> 'view'"))
sql("sql_win_rleid", f"SELECT event_id, RLEID(event_type) OVER {_O} AS x FROM events", "events", oracle=_RLE)
sql("sql_win_rleid_runs", f"SELECT user_id, x, count(*) AS n FROM (SELECT user_id, RLEID(event_type) OVER {_O} AS x FROM events) t GROUP BY user_id, x", "events", oracle=f"SELECT user_id, x, count(*) AS n FROM ({_RLE.replace('SELECT event_id, CAST', 'SELECT user_id, CAST')}) GROUP BY user_id, x")

# As-of joins after joins, after one another, and with derived tables. Equal times are made unique first: which of them matches is open.
_CLICKS = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')"
_LAST = "(SELECT user_id AS u{0}, ts AS t{0}, max(event_id) AS id{0} FROM events WHERE event_type = '{1}' GROUP BY user_id, ts)"
sql("sql_asof_derived", f"SELECT c.event_id, p.idp, p.tp FROM {_CLICKS} c ASOF LEFT JOIN {_LAST.format('p', 'purchase')} p ON c.user_id = p.up AND c.ts >= p.tp", "events")
sql("sql_asof_chain", f"SELECT c.event_id, p.idp, v.idv FROM {_CLICKS} AS c ASOF LEFT JOIN {_LAST.format('p', 'purchase')} AS p ON c.user_id = p.up AND c.ts >= p.tp ASOF JOIN {_LAST.format('v', 'view')} v ON v.uv = c.user_id AND v.tv < c.ts WHERE v.idv IS NOT NULL", "events")
sql("sql_asof_after_join", f"SELECT c.event_id, k.c_name, p.idp FROM {_CLICKS} c JOIN customer k ON c.user_id = k.c_custkey ASOF JOIN {_LAST.format('p', 'purchase')} p ON k.c_custkey = p.up AND c.ts > p.tp", "events", "customer")
sql("sql_asof_star", f"SELECT * FROM {_CLICKS} c ASOF JOIN {_LAST.format('p', 'purchase')} p ON user_id = up AND ts <= tp", "events")
sql("sql_asof_grouped", f"SELECT user_id, count(*) AS n, count(p.idp) AS m FROM {_CLICKS} c ASOF LEFT JOIN {_LAST.format('p', 'purchase')} p ON c.user_id = p.up AND c.ts >= p.tp GROUP BY user_id HAVING count(*) > 1 ORDER BY user_id", "events")


# Sources
def _written(spark, sf_dir, name: str, run):
    return run(spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", sf_dir)


def _csv_values(spark, root, sf_dir):
    lines = ["k,v,t,late", "1,1.5,plain,1", "2,,\"quoted, comma\",2", "3,-2e3,\"\",", ",0.25,,4"] + [f"{k},1,x,{k}" for k in range(5, 1500)] + ["1500,2,y,A-77", "1501,1e-3,z,3.5"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(root)
    return files.read_csv(spark, root)


def _csv_table(spark, root, sf_dir):
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").write.csv(root, header=True)
    return Engine(spark).sql(f"SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM read_csv('{root}')")


def _ingested(spark, root, sf_dir):
    store = Store(spark, root)
    store.index_parquet(f"{sf_dir}/part.parquet", "parts")
    return store.load("parts")


def _file_cache(spark, root, sf_dir):
    """Read by way of the store, twice: the second time from the copy; after the file has changed, from the new one."""
    store, path = Store(spark, f"{root}/store"), f"{root}/file.parquet"
    table(spark, sf_dir, "nation").filter("n_regionkey = 1").write.parquet(path)
    first = store.cached(path)
    known = store.graph(store.cache_name(path))
    if store.cached(path).count() != first.count() or store.graph(store.cache_name(path)) != known:
        raise ValueError("the copy was not used")
    import time

    time.sleep(1.1)
    table(spark, sf_dir, "nation").write.mode("overwrite").parquet(path)
    return store.cached(path).select("n_nationkey", "n_name")


def _live(spark, root, sf_dir):
    """A live name sees each new head."""
    store, engine = Store(spark, root), Engine(spark)
    nation = table(spark, sf_dir, "nation")
    store.sync(nation.filter("n_regionkey = 0"), "nation")
    engine.live("now", store, "nation")
    before = engine.sql("SELECT n_nationkey, 'before' AS version FROM now")
    store.sync(nation, "nation")
    return before.unionByName(engine.sql("SELECT n_nationkey, 'after' AS version FROM now"))


def _collected(spark, root, sf_dir):
    """What garbage collection leaves: the commits of branches that are still there, and their data."""
    store, nation = Store(spark, root), table(spark, sf_dir, "nation")
    store.sync(nation, "nation")
    store.fork("nation", "trial")
    store.sync(nation.filter("n_regionkey = 1"), "nation", branch="trial")
    lost = store.head("nation", "trial")
    store.delete_branch("nation", "trial")
    gone = store.gc("nation")
    if gone != [lost]:
        raise ValueError("another commit than the deleted branch's went")
    return store.load("nation").select("n_nationkey").withColumn("commits", F.lit(len(store.graph("nation"))))


for _name, _run, _oracle in (
    ("source_csv_values", _csv_values, "SELECT * FROM (VALUES (1::BIGINT, 1.5::DOUBLE, 'plain', '1'), (2, NULL, 'quoted, comma', '2'), (3, -2000.0, '', NULL), (NULL, 0.25, NULL, '4'), (1500, 2, 'y', 'A-77'), (1501, 0.001, 'z', '3.5')) t(k, v, t, late) UNION ALL SELECT i, 1.0, 'x', CAST(i AS VARCHAR) FROM range(5, 1500) r(i)"),
    ("source_csv_table", _csv_table, "SELECT c_custkey, c_name, c_acctbal, c_nationkey::BIGINT AS c_nationkey FROM customer"),
    ("source_parquet_ingest", _ingested, "SELECT * FROM part"), ("source_file_cache", _file_cache, "SELECT n_nationkey, n_name FROM nation"),
    ("source_live_table", _live, "SELECT n_nationkey, 'before' AS version FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, 'after' FROM nation"),
    ("store_gc", _collected, "SELECT n_nationkey, 1 AS commits FROM nation"),
):
    add(_name, lambda spark, d, n=_name, r=_run: _written(spark, d, n, r), _oracle)
add("source_tuples", lambda spark, d: files.from_tuples(spark, ["a", "b"], files.to_tuples(table(spark, d, "region").select("r_regionkey", "r_name"))), "SELECT r_regionkey::BIGINT AS a, r_name AS b FROM region")


# Statements about the session and plans
def _session(spark, d):
    engine = Engine(spark).over(d, "region", "nation")
    engine.sql("SET my.option = 'on'")
    engine.sql("SET clock_time TO '2001-02-03 04:05:06'")
    shown = engine.sql("SHOW my.option").unionByName(engine.sql("SHOW timezone"))
    if engine.now != "2001-02-03 04:05:06" or engine.sql("SELECT version()").count() != 1:
        raise ValueError("the session doesn't hold its settings")
    return shown


add("session_settings", _session, "SELECT * FROM (VALUES ('my.option', 'on'), ('timezone', 'UTC')) t(name, setting)")
add("catalogue_views", lambda spark, d: Engine(spark).over(d, "region", "nation").sql("SELECT t.table_name, c.column_name, c.ordinal_position FROM information_schema.tables t JOIN information_schema.columns c ON t.table_name = c.table_name JOIN pg_catalog.pg_class k ON k.relname = t.table_name"), "SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position FROM (VALUES ('region', 'r_regionkey', 1), ('region', 'r_name', 2), ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3)) t(table_name, column_name, ordinal_position)")
add("explain_plan", lambda spark, d: Engine(spark).over(d, "region").sql("EXPLAIN SELECT r_name FROM region WHERE r_regionkey = 1").select(F.contains("plan", F.lit("PushedFilters")).alias("pushed"), F.contains("plan", F.lit("r_name")).alias("named")), "SELECT true AS pushed, true AS named")


def _formats(spark, d):
    """The same result as rows and as columns."""
    wanted = {"from": table(spark, d, "region"), "select": [":r_regionkey", ":r_name"], "order": [":r_regionkey"]}
    rows, columns = dsl.run(wanted), dsl.run(wanted | {"result": "columns"})
    if [r["r_name"] for r in rows] != columns["r_name"]:
        raise ValueError("rows and columns differ")
    return spark.createDataFrame(list(zip(columns["r_regionkey"], columns["r_name"], strict=True)), "r_regionkey int, r_name string")


def _refused(spark, d):
    """Statements and queries that must be refused, and by which error."""
    engine = Engine(spark).over(d, "region", "events")
    engine.sql("CREATE TYPE mood AS ENUM ('sad', 'ok')")
    engine.sql("CREATE TABLE m (id INTEGER, x mood, n UTINYINT)")
    events = table(spark, d, "events")
    tries = {
        "system time": lambda: engine.sql("UPDATE region FOR PORTION OF SYSTEM_TIME FROM '2020-01-01' TO '2021-01-01' SET r_name = 'x'"),
        "conflict in a portion": lambda: engine.sql("INSERT INTO region FOR PORTION OF VALID_TIME FROM '2020-01-01' TO '2021-01-01' (r_regionkey) VALUES (1) ON CONFLICT (r_regionkey) DO NOTHING"),
        "bare numeric": lambda: engine.sql("CREATE TABLE n (x NUMERIC)"), "unknown table": lambda: engine.sql("DELETE FROM nowhere"), "unknown model": lambda: engine.sql("SELECT ANOMALY_SCORE('none', value) FROM events"),
        "two inequalities": lambda: engine.sql("SELECT * FROM events a ASOF JOIN events b ON a.ts >= b.ts AND a.value >= b.value"), "parent folder": lambda: engine.sql("SELECT * FROM read_csv('/tmp/../etc/x.csv')"),
        "sum of text": lambda: dsl.q({"from": events, "agg": [("sum", ":event_type")]}), "unknown column": lambda: dsl.q({"from": events, "select": [":nothing"]}), "unknown clause": lambda: dsl.q({"from": events, "wher": []}),
        "label not in the enum": lambda: engine.sql("INSERT INTO m VALUES (1, 'odd', 1)") and engine.tables["m"].collect(), "unsigned overflow": lambda: engine.sql("INSERT INTO m VALUES (1, 'ok', 256)") and engine.tables["m"].collect(),
    }
    found = []
    for name, run in tries.items():
        try:
            run()
        except Exception:  # noqa: BLE001
            found.append((name,))
    return spark.createDataFrame(found, "refused string")


def _compiled(spark, d):
    """A query that is built once."""
    built = []
    call = compiled(lambda low: built.append(low) or table(spark, d, "nation").filter(F.col("n_regionkey") >= low))
    return call(2).select("n_nationkey").union(call(2).select("n_nationkey")).withColumn("built", F.lit(len(built)))


add("result_formats", _formats, "SELECT r_regionkey, r_name FROM region")
add("refusals", _refused, "SELECT unnest(['system time', 'conflict in a portion', 'bare numeric', 'unknown table', 'unknown model', 'two inequalities', 'parent folder', 'sum of text', 'unknown column', 'unknown clause', 'label not in the enum', 'unsigned overflow']) AS refused")
add("compiled_query", _compiled, "SELECT n_nationkey, 1 AS built FROM nation WHERE n_regionkey >= 2 UNION ALL SELECT n_nationkey, 1 FROM nation WHERE n_regionkey >= 2")
