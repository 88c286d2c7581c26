"""Golden results and properties of the engine's own operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import dates, scalars
from larkspur.operators import aggregates, bitemporal, dml, iforest, joins, windows
from larkspur.plans import dsl
from larkspur.plans.sqlfront import Engine, SqlError
from larkspur.sources import files
from larkspur.sources.store import Store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_asof(probe, build, op):
    out = []
    for p in probe:
        ok = [b for b in build if p[0] is not None and p[0] == b[0] and p[1] is not None and b[1] is not None and {">=": b[1] <= p[1], ">": b[1] < p[1], "<=": b[1] >= p[1], "<": b[1] > p[1]}[op]]
        pick = (max if op in (">=", ">") else min)(ok, key=lambda b: b[1]) if ok else None
        out.append((*p, *(pick or (None, None, None))))
    return out


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
@pytest.mark.parametrize("keyed", [True, False])
def test_asof_matches_brute_force(spark, op, keyed):
    rng = random.Random(op)
    key = (lambda: rng.choice([1, 2, None])) if keyed else (lambda: 1)
    probe = [(key(), rng.choice([None, *range(30)]), i) for i in range(60)]
    times = rng.sample(range(30), 15)
    build = [(k, t, 100 * (k or 0) + t) for t in times for k in ([1, 2, None] if keyed else [1])] + [(1, None, -1)]
    a, b = spark.createDataFrame(probe, "k int, t int, i int"), spark.createDataFrame(build, "bk int, bt int, v int")
    want = brute_asof(probe, build, op)
    keys = [("k", "bk")] if keyed else []
    assert rows(joins.asof_join(a, b, ("t", op, "bt"), keys, "left")) == sorted(want, key=str)
    assert rows(joins.asof_join(a, b, ("t", op, "bt"), keys)) == sorted([w for w in want if w[-1] is not None], key=str)


def test_window_join_empty_window(spark):
    a = spark.createDataFrame([(0,), (100,), (None,)], "t long")
    b = spark.createDataFrame([(1, 2.0), (3, None), (5, 4.0)], "u long, v double")
    aggs = {"n": ("count", "v"), "s": ("sum", "v"), "m": ("avg", "v"), "lo": ("min", "v"), "hi": ("max", "v")}
    assert rows(joins.window_join(a, b, ("t", "u"), (0, 5), aggs)) == sorted([(0, 2, 6.0, 3.0, 2.0, 4.0), (100, 0, 0.0, None, None, None), (None, 0, 0.0, None, None, None)], key=str)


def test_ema_and_rleid_golden(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0)], "ts int, px double")
    assert [r.ema for r in windows.ema(df, "px", 0.5, [], ["ts"]).orderBy("ts").collect()] == [10.0, 15.0, 22.5, 31.25]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, None, 1, 1, 2, 1])], "ts int, v int")
    assert [r.rleid for r in windows.rleid(df, "v", [], ["ts"]).orderBy("ts").collect()] == [1, 1, 2, 2, 3, 4]


def test_moving_and_fills(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 6.0), (4, 8.0)], "ts int, v double")
    w = windows.over([], ["ts"])
    out = df.select("ts", windows.fills(F.col("v"), w).alias("f"), windows.moving("mavg", F.col("v"), 2, w).alias("m"), windows.moving("mdev", F.col("v"), 2, w).alias("d"))
    assert rows(out) == [(1, 2.0, 2.0, 0.0), (2, 2.0, 2.0, 0.0), (3, 6.0, 6.0, 0.0), (4, 8.0, 7.0, 1.0)]


def test_dates(spark):
    ts = F.lit("2024-01-31 10:20:30.123456").cast("timestamp_ntz")
    out = spark.range(1).select(
        dates.date_add("months", 1, ts).alias("a"), dates.date_diff("hours", ts, F.lit("2024-01-31 08:20:30.123456").cast("timestamp_ntz")).alias("b"), dates.extract("millisecond", ts).alias("c"),
        dates.time_bucket(15, "minutes", ts).alias("d"), dates.date_trunc("century", ts).alias("e"), dates.time_bucket(1, "months", ts).alias("f"), scalars.substring(F.lit("hello"), F.lit(-3), F.lit(2)).alias("g"),
    ).first()
    assert tuple(out) == (dt.datetime(2024, 2, 29, 10, 20, 30, 123456), 2.0, 30123, dt.datetime(2024, 1, 31, 10, 15), dt.datetime(2001, 1, 1), dt.datetime(2024, 1, 1), "he")


def test_dict_queries_name_what_is_there(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (2, "y", None)], "a int, b string, c double")
    with pytest.raises(dsl.QueryError, match="no column zz; there are a, b, c"):
        dsl.q({"from": df, "where": [("<", ":zz", 1)]})
    with pytest.raises(dsl.QueryError, match="sum of the string column b"):
        dsl.q({"from": df, "agg": [("sum", ":b")]})
    with pytest.raises(dsl.QueryError, match="unknown clause"):
        dsl.q({"from": df, "wher": []})
    assert dsl.q({"from": df, "agg": [("sum", ":a"), ("sum", ":c"), ("count",)]}).columns == ["sum_a", "sum_c", "count"]
    assert dsl.run({"from": df, "select": [":a"], "order": [(":c", "desc")], "result": "columns"}) == {"a": [1, 2]}
    joined = dsl.q({"from": df, "join": [{"with": spark.createDataFrame([(1, "z")], "a int, b string"), "on": ("=", ":a", ":a"), "type": "left"}]})
    assert rows(joined) == [(1, 2.0, "z"), (2, None, None)] and joined.columns == ["a", "c", "b"]


def test_csv_types_and_empties(spark, tmp_path):
    (tmp_path / "x.csv").write_text('i,d,s,q\n1,1.5,a,""\n,2,b,\n3,,"c, d",x\n')
    df = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "s": "string", "q": "string"}
    assert rows(df) == sorted([(1, 1.5, "a", ""), (None, 2.0, "b", None), (3, None, "c, d", "x")], key=str)
    with pytest.raises(ValueError):
        files.read_csv(spark, "../x.csv")


def test_store_history_gc_audit(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = store.sync(spark.range(3), "t", tx=5)
    two = store.sync(spark.range(4), "t", tx=9)
    store.fork("t", "b")
    three = store.sync(spark.range(5), "t", branch="b")
    assert [store.load("t", branch="b").count(), store.load("t").count(), store.load("t", tx=6).count(), store.load("t", commit=one).count()] == [5, 4, 3, 3]
    assert store.history("t", three) == [three, two, one] and store.common_ancestor("t", three, two) == two and store.branches("t") == ["b", "main"]
    assert store.verify("t", three, deep=True) == []
    store.delete_branch("t", "b")
    assert store.gc("t") == [three] and store.load("t").count() == 4
    path = tmp_path / "t" / "commits" / f"{one}.json"
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    path.write_text(path.read_text().replace('"tx": 5', '"tx": 6'))
    assert store.verify("t", two) == [one]


def test_changes_in_sql(spark):
    engine = Engine(spark, "2020-01-01 00:00:00")
    engine.sql("CREATE TYPE mood AS ENUM ('sad', 'ok')")
    engine.sql("CREATE TABLE t (k INTEGER PRIMARY KEY, n UTINYINT, m mood)")
    engine.sql("INSERT INTO t VALUES (1, 7, 'ok'), (2, NULL, NULL) -- a comment with FROM read_csv('x')")
    assert rows(engine.sql("SELECT * FROM t ORDER BY n")) == [(1, 7, "ok"), (2, None, None)]
    assert "Aggregate" in engine.sql("EXPLAIN SELECT count(*) FROM t").first()["plan"] and '"rows": 2' in engine.sql("EXPLAIN ANALYZE (FORMAT JSON) SELECT k FROM t").first()["plan"]
    engine.sql("INSERT INTO t VALUES (3, 300, 'ok')")
    with pytest.raises(Exception, match="22003"):
        engine.sql("SELECT * FROM t").collect()
    with pytest.raises(SqlError, match="SYSTEM_TIME"):
        engine.sql("DELETE FROM t FOR PORTION OF SYSTEM_TIME FROM '2020-01-01' TO '2021-01-01'")


def test_three_way_split_and_upsert(spark):
    df = spark.createDataFrame([(1, 10)], "k int, v int").withColumn("_valid_from", bitemporal.moment("2020-01-01")).withColumn("_valid_to", bitemporal.moment("2021-01-01"))
    out = bitemporal.update_portion(df, "2020-03-01", "2020-06-01", {"v": F.lit(99)})
    d = lambda m, y=2020: dt.datetime(y, m, 1)
    assert rows(out) == sorted([(1, 10, d(1), d(3)), (1, 99, d(3), d(6)), (1, 10, d(6), d(1, 2021))], key=str)
    new = spark.createDataFrame([(1, 5)], "k int, v int")
    assert rows(bitemporal.upsert(df, new, ["k"], "2020-05-01")) == sorted([(1, 10, d(1), d(5)), (1, 5, d(5), bitemporal.END_OF_TIME)], key=str)
    with pytest.raises(ValueError, match="overlap"):
        bitemporal.upsert(df, new, ["k"], "2019-05-01")
    assert rows(bitemporal.upsert(df, new, ["k"], "2019-05-01", auto_split=True)) == [(1, 5, dt.datetime(2019, 5, 1), bitemporal.END_OF_TIME)]


def test_forest_ranks_planted_outliers(spark):
    rng = random.Random(3)
    data = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(500)] + [(1000 + i, 9.0 + i, -9.0) for i in range(5)] + [(2000, None, 1.0)]
    df = spark.createDataFrame(data, "i int, x double, y double")
    forest = iforest.train(df, ["x", "y"], contamination=0.02)
    out = df.select("i", iforest.anomaly_score(forest).alias("s"), iforest.anomaly_predict(forest).alias("p"), iforest.anomaly_confidence(forest).alias("c")).collect()
    known = [r for r in out if r.i != 2000]
    assert {r.i for r in sorted(known, key=lambda r: -r.s)[:5]} == {1000, 1001, 1002, 1003, 1004}
    assert all(0 <= r.s <= 1 and 0 < r.c <= 1 for r in known) and 0 < sum(r.p for r in known) < 20
    assert next(r for r in out if r.i == 2000).s is None
    again = iforest.train(df, ["x", "y"], contamination=0.02)
    assert again.threshold == forest.threshold
    assert len(iforest.rotate(forest, df).trees) == 100
    with pytest.raises(ValueError):
        iforest.anomaly_predict(iforest.train(df, ["x", "y"]))


def test_fold_and_upsert(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("b", None)], "g string, v double")
    assert rows(aggregates.fold(df, ["g"], "v", 1.0, lambda a, b: a * b)) == [("a", 6.0), ("b", 1.0)]
    t = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(2, 5.0), (3, 3.0)], "k int, v double")
    assert rows(dml.upsert(t, new, ["k"])) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert rows(dml.upsert(t, new, ["k"], {"v": F.col("t.v") + F.col("excluded.v")})) == [(1, 1.0), (2, 7.0), (3, 3.0)]


def test_stream_windows(spark, tmp_path):
    from larkspur.streaming.windows import windowed

    base = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(base + dt.timedelta(minutes=m), 1.0) for m in (0, 1, 7, 30)], "ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    run = windowed(stream, "ts", "5 minutes", {"n": F.count("*")}).writeStream.outputMode("complete").format("memory").queryName("windows_seen").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.n for r in spark.sql("SELECT n FROM windows_seen").collect()) == [1, 1, 2]


def test_live_tables_and_cached_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.sync(spark.range(2), "t")
    engine = Engine(spark)
    engine.live("t", store, "t")
    assert engine.sql("SELECT count(*) AS n FROM t").first()["n"] == 2
    store.sync(spark.range(7), "t")
    assert engine.sql("SELECT count(*) AS n FROM t").first()["n"] == 7
    assert rows(engine.sql("SHOW TABLES")) == [("t", 1)] and rows(engine.sql("DESCRIBE t")) == [("id", "bigint")]
    (tmp_path / "x.csv").write_text("a\n1\n2\n")
    path = str(tmp_path / "x.csv")
    assert store.cached(path).count() == 2 and store.cached(path).count() == 2
    table = next(n for n in store._list(str(tmp_path / "store")) if n.startswith("file-"))
    assert len(store.history(table, store.head(table))) == 1
