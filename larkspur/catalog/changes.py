"""Changes to tables, time axes and versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.catalog.registry import add, frame
from larkspur.operators import bitemporal, dml
from larkspur.plans.sqlfront import Engine
from larkspur.session import shared_root, table
from larkspur.sources.store import Store

NOW = "2001-01-01 00:00:00"
END = "TIMESTAMP '9999-12-31 23:59:59.999999'"


def changed(*statements: str, tables: tuple[str, ...] = ("customer",), shown: str = "customer"):
    """The table `shown` after statements."""

    def run(spark, sf_dir):
        engine = Engine(spark, NOW).over(sf_dir, *tables)
        for s in statements:
            engine.sql(s)
        return engine.tables[shown]

    return run


_C = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
add("dml_update", changed("UPDATE customer SET c_acctbal = c_acctbal + 100, c_mktsegment = 'NEW' WHERE c_nationkey = 3"), "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
add("dml_delete", changed("DELETE FROM customer WHERE nullif(c_nationkey, 4) < 10"), f"SELECT {_C} FROM customer WHERE NOT coalesce(nullif(c_nationkey, 4) < 10, false)")
add("dml_insert", changed("INSERT INTO customer (c_custkey, c_name) VALUES (900001, 'A''s'), (900002, NULL)"), f"SELECT {_C} FROM customer UNION ALL VALUES (900001, 'A''s', NULL, NULL, NULL), (900002, NULL, NULL, NULL, NULL)")
add("dml_upsert_nothing", changed("INSERT INTO customer (c_custkey, c_name) VALUES (1, 'taken'), (900003, 'free') ON CONFLICT (c_custkey) DO NOTHING"), f"SELECT {_C} FROM customer UNION ALL VALUES (900003, 'free', NULL, NULL, NULL)")
add("dml_upsert_update", changed("INSERT INTO customer (c_custkey, c_name, c_acctbal) VALUES (1, 'new', 5.0), (900004, 'free', 6.0) ON CONFLICT (c_custkey) DO UPDATE SET c_name = EXCLUDED.c_name, c_acctbal = c_acctbal + EXCLUDED.c_acctbal"), "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'new' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey = 1 THEN c_acctbal + 5.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer UNION ALL VALUES (900004, 'free', NULL, 6.0, NULL)")
add("dml_update_from", changed("UPDATE customer SET c_mktsegment = nation.n_name, c_acctbal = customer.c_acctbal * 2 FROM nation WHERE customer.c_nationkey = nation.n_nationkey AND nation.n_regionkey = 2", tables=("customer", "nation")), "SELECT c_custkey, c_name, c_nationkey, CASE WHEN n_nationkey IS NOT NULL THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, coalesce(n_name, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 2")
add("dml_create_insert", changed("CREATE TABLE kv (k INTEGER, v DOUBLE, label TEXT)", "INSERT INTO kv VALUES (1, 1.5, 'a'), (2, NULL, 'b')", "INSERT INTO kv (k) VALUES (3)", tables=(), shown="kv"), "SELECT * FROM (VALUES (1::BIGINT, 1.5::DOUBLE, 'a'), (2, NULL, 'b'), (3, NULL, NULL)) t(k, v, label)")
add("dml_enum", changed("CREATE TYPE mood AS ENUM ('sad', 'ok')", "CREATE TABLE m (id INTEGER, x mood, n UTINYINT)", "INSERT INTO m VALUES (1, 'ok', 255), (2, NULL, 0)", tables=(), shown="m"), "SELECT * FROM (VALUES (1::BIGINT, 'ok', 255::BIGINT), (2, NULL, 0)) t(id, x, n)")
frame("dml_columns", lambda n: dml.rename_column(dml.drop_column(dml.add_column(n, "twice", F.col("n_nationkey") * 2), "n_regionkey"), "n_name", "name"), "nation", oracle="SELECT n_nationkey, n_name AS name, n_nationkey * 2 AS twice FROM nation")

# Order periods: an order holds until the customer's next one
_PERIODS = f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate AS _valid_from, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), {END}) AS _valid_to FROM orders"
_H = f"WITH h AS (SELECT * FROM ({_PERIODS}) WHERE _valid_from < _valid_to) "


def periods(orders):
    until = F.coalesce(F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")), bitemporal.moment("END_OF_TIME"))
    held = orders.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").alias("_valid_from"), until.alias("_valid_to"))
    return held.filter("_valid_from < _valid_to")


def timed(statement: str, then: str | None = None):
    def run(spark, sf_dir):
        engine = Engine(spark, NOW)
        engine.register("h", periods(table(spark, sf_dir, "orders")))
        out = engine.sql(statement)
        return engine.sql(then) if then else out

    return run


add("asof_time_valid", timed("SELECT o_orderkey, o_custkey FROM h FOR VALID_TIME AS OF TIMESTAMP '1998-06-01'"), _H + "SELECT o_orderkey, o_custkey FROM h WHERE _valid_from <= TIMESTAMP '1998-06-01' AND _valid_to > TIMESTAMP '1998-06-01'")
add("asof_time_now", timed("SELECT h.o_orderkey FROM h FOR VALID_TIME AS OF NOW() WHERE h.o_totalprice > 1000"), _H + f"SELECT o_orderkey FROM h WHERE _valid_from <= TIMESTAMP '{NOW}' AND _valid_to > TIMESTAMP '{NOW}' AND o_totalprice > 1000")
add("asof_time_between", timed("SELECT o_orderkey FROM h FOR VALID_TIME BETWEEN DATE '1997-01-01' AND DATE '1997-02-01'"), _H + "SELECT o_orderkey FROM h WHERE _valid_from <= TIMESTAMP '1997-02-01' AND _valid_to > TIMESTAMP '1997-01-01'")
add("asof_time_from_to", timed("SELECT o_orderkey FROM h FOR VALID_TIME FROM '1997-01-01' TO '1997-02-01'"), _H + "SELECT o_orderkey FROM h WHERE _valid_from < TIMESTAMP '1997-02-01' AND _valid_to > TIMESTAMP '1997-01-01'")
add("asof_time_all", timed("SELECT count(*) AS n FROM h FOR ALL VALID_TIME"), _H + "SELECT count(*) AS n FROM h")
_A, _B = "TIMESTAMP '1998-01-01'", "TIMESTAMP '1999-01-01'"
_HIT = f"_valid_from < {_B} AND _valid_to > {_A} AND o_custkey % 3 = 0"
_SPLIT = f"SELECT o_orderkey, o_custkey, o_totalprice, _valid_from, _valid_to FROM h WHERE NOT ({_HIT}) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, _valid_from, {_A} FROM h WHERE {_HIT} AND _valid_from < {_A} UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, {_B}, _valid_to FROM h WHERE {_HIT} AND _valid_to > {_B}"
add("bitemporal_update_portion", timed("UPDATE h FOR PORTION OF VALID_TIME FROM '1998-01-01' TO '1999-01-01' SET o_totalprice = o_totalprice * 2 WHERE o_custkey % 3 = 0", "SELECT * FROM h"), _H + _SPLIT + f" UNION ALL SELECT o_orderkey, o_custkey, o_totalprice * 2, greatest(_valid_from, {_A}), least(_valid_to, {_B}) FROM h WHERE {_HIT}")
add("bitemporal_delete_portion", timed("DELETE FROM h FOR PORTION OF VALID_TIME FROM '1998-01-01' TO '1999-01-01' WHERE o_custkey % 3 = 0", "SELECT * FROM h"), _H + _SPLIT)
add("bitemporal_insert_portion", timed("INSERT INTO h FOR PORTION OF VALID_TIME FROM '2000-01-01' TO '2000-02-01' (o_orderkey, o_custkey, o_totalprice) VALUES (-1, 1, 9.5)", "SELECT * FROM h WHERE o_orderkey < 0"), "SELECT -1::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 9.5::DOUBLE AS o_totalprice, TIMESTAMP '2000-01-01' AS _valid_from, TIMESTAMP '2000-02-01' AS _valid_to")
frame("bitemporal_retract_open", lambda o: bitemporal.retract(periods(o), F.col("o_custkey") % 5 == 0, "1999-01-01"), "orders", oracle=_H + "SELECT o_orderkey, o_custkey, o_totalprice, _valid_from, CASE WHEN o_custkey % 5 = 0 THEN least(_valid_to, TIMESTAMP '1999-01-01') ELSE _valid_to END AS _valid_to FROM h WHERE NOT (o_custkey % 5 = 0 AND _valid_from >= TIMESTAMP '1999-01-01')")
add("bitemporal_erase", timed("ERASE FROM h WHERE o_custkey = 7", "SELECT o_orderkey FROM h"), _H + "SELECT o_orderkey FROM h WHERE o_custkey <> 7")


def _scd2(spark, sf_dir):
    """New prices from 2002 on for the last order of every tenth customer."""
    h = periods(table(spark, sf_dir, "orders")).filter(F.col("_valid_to") == bitemporal.moment("END_OF_TIME"))
    new = h.filter("o_custkey % 10 = 0").select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return bitemporal.upsert(h, new, ["o_custkey"], "2002-01-01")


add("bitemporal_upsert", _scd2, _H + f", c AS (SELECT * FROM h WHERE _valid_to = {END}) SELECT o_orderkey, o_custkey, o_totalprice, _valid_from, CASE WHEN o_custkey % 10 = 0 THEN TIMESTAMP '2002-01-01' ELSE _valid_to END AS _valid_to FROM c UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1, TIMESTAMP '2002-01-01', _valid_to FROM c WHERE o_custkey % 10 = 0")


def _system(spark, sf_dir):
    """A system-versioned update keeps the old row, closed, beside its parts."""
    h = periods(table(spark, sf_dir, "orders"))
    h = h.withColumn("_system_from", bitemporal.moment("1995-01-01")).withColumn("_system_to", bitemporal.moment("END_OF_TIME"))
    return bitemporal.update_portion(h, "1998-01-01", "1999-01-01", {"o_totalprice": F.lit(0.0)}, F.lit(True), NOW)


_SYS = f"_valid_from < {_B} AND _valid_to > {_A}"
_NEW = f"TIMESTAMP '{NOW}' AS _system_from, {END} AS _system_to"
add("bitemporal_system_update", _system, _H + f""", s AS (SELECT * FROM h)
SELECT o_orderkey, o_custkey, o_totalprice, _valid_from, _valid_to, TIMESTAMP '1995-01-01' AS _system_from, CASE WHEN {_SYS} THEN TIMESTAMP '{NOW}' ELSE {END} END AS _system_to FROM s
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, _valid_from, {_A}, {_NEW} FROM s WHERE {_SYS} AND _valid_from < {_A}
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, {_B}, _valid_to, {_NEW} FROM s WHERE {_SYS} AND _valid_to > {_B}
UNION ALL SELECT o_orderkey, o_custkey, 0.0, greatest(_valid_from, {_A}), least(_valid_to, {_B}), {_NEW} FROM s WHERE {_SYS}""")


def _versions(spark, sf_dir):
    """A branch's table at its first commit, after a second one and a fork."""
    store = Store(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}")
    nation = table(spark, sf_dir, "nation")
    first = store.sync(nation, "nation", tx=1)
    store.sync(nation.filter("n_regionkey < 3"), "nation", tx=2)
    store.fork("nation", "trial")
    old, new = store.load("nation", tx=1), store.load("nation", branch="trial")
    if store.verify("nation", store.head("nation"), deep=True) or store.common_ancestor("nation", first, store.head("nation", "trial")) != first:
        raise ValueError("the chain doesn't hold")
    return old.select("n_nationkey", F.lit("old").alias("version")).union(new.select("n_nationkey", F.lit("new")))


add("store_versions", _versions, "SELECT n_nationkey, 'old' AS version FROM nation UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_regionkey < 3")
