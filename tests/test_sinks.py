import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, sinks
from tidemark.sources.schemas import BARS, EVENTS, MEMBERSHIP

T0 = dt.datetime(2024, 1, 1)


def bar(symbol, day, close, hour, volume=1):
    return (symbol, day, close, close, close, close, volume, "p", T0 + dt.timedelta(hours=hour))


def test_upsert_keeps_the_last_and_touches_only_its_years(spark, tmp_path):
    path = str(tmp_path / "bars")
    d23, d24 = dt.date(2023, 12, 29), dt.date(2024, 1, 2)
    first = spark.createDataFrame([bar("A", d23, 1.0, 1), bar("A", d24, 2.0, 1), bar("B", d24, 3.0, 5)], BARS)
    assert sinks.upsert_by_year(first, path) == ["year=2023", "year=2024"]
    old = {p.name for p in (tmp_path / "bars" / "year=2023").iterdir()}
    second = spark.createDataFrame([bar("A", d24, 9.0, 2), bar("B", d24, 8.0, 4), bar("C", d24, 7.0, 1), bar("C", d24, 6.0, 0)], BARS)
    assert sinks.upsert_by_year(second, path) == ["year=2024"]
    assert {p.name for p in (tmp_path / "bars" / "year=2023").iterdir()} == old
    got = {(r.symbol, r.date): r.close for r in files.read_partitioned_bars(spark, path, BARS).collect()}
    assert got == {("A", d23): 1.0, ("A", d24): 9.0, ("B", d24): 3.0, ("C", d24): 7.0}
    assert sinks.upsert_by_year(second, path) == ["year=2024"]  # again: nothing changes
    assert {(r.symbol, r.date): r.close for r in files.read_partitioned_bars(spark, path, BARS).collect()} == got
    pruned = files.read_partitioned_bars(spark, path, BARS, start=d24, as_of=dt.date(2024, 6, 1))
    assert pruned.count() == 3
    assert "PartitionFilters: [isnotnull(year" in pruned._jdf.queryExecution().toString()
    assert [p.name for p in tmp_path.iterdir()] == ["bars"]


def test_a_batch_with_non_finite_prices_is_refused_whole(spark, tmp_path):
    path = str(tmp_path / "bars")
    bad = spark.createDataFrame([bar("A", dt.date(2024, 1, 2), 1.0, 1), bar("B", dt.date(2024, 1, 2), float("nan"), 1)], BARS)
    with pytest.raises(sinks.NonFiniteValues):
        sinks.upsert_by_year(bad, path)
    assert files.read_partitioned_bars(spark, path, BARS).count() == 0
    assert sinks.upsert_by_year(spark.createDataFrame([], BARS), path) == []


def test_slices_merges_and_orphans(spark, tmp_path):
    path = str(tmp_path / "slices")
    df = lambda rows: spark.createDataFrame(rows, "run string, x int")
    sinks.replace_slice(df([("a", 1), ("a", 2)]), path, "run", "a")
    sinks.replace_slice(df([("b", 3)]), path, "run", "b")
    sinks.replace_slice(df([("a", 9)]), path, "run", "a")
    assert sorted((r.run, r.x) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]
    sinks.replace_slice(df([]), path, "run", "b")
    assert [r.run for r in spark.read.parquet(path).collect()] == ["a"]
    with pytest.raises(ValueError):
        sinks.replace_slice(df([("a", 1)]), path, "run", "b")
    k = lambda rows: spark.createDataFrame(rows, "k int, a int, b string")
    merged = sinks.coalesce_merge(k([(1, 5, "x"), (2, 6, "y")]), k([(1, None, "z"), (3, 7, None)]), ["k"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 5, "z"), (2, 6, "y"), (3, 7, None)]
    kept = sinks.delete_orphans(k([(1, 1, ""), (2, 2, ""), (None, 3, "")]), k([(1, 0, ""), (1, 0, "")]), ["k"])
    assert [r.k for r in kept.collect()] == [1]


def test_text_formats(spark, tmp_path):
    rows = [(dt.date(2024, 1, 1), "A", "A", 'Say, "Corp"', None, "s"), (None, "É", None, "", "Energy", "s")]
    df = spark.createDataFrame(rows, MEMBERSHIP)
    sinks.write_csv(df.drop("source"), str(tmp_path / "c"))
    got = files.read_csv(spark, str(tmp_path / "c"), MEMBERSHIP)
    assert got.schema == MEMBERSHIP and sorted(r.symbol for r in got.collect()) == ["A", "É"]
    assert got.where("symbol = 'A'").first().company_name == 'Say, "Corp"'
    with pytest.raises(ValueError):
        sinks.write_csv(df.withColumn("odd", F.lit(1)), str(tmp_path / "d"))
        files.read_csv(spark, str(tmp_path / "d"), MEMBERSHIP)
    sinks.write_json_lines(df, str(tmp_path / "j"))
    (tmp_path / "j" / "extra.json").write_text('{"symbol": "B"\nnot json\n{"symbol": "C"}\n')
    ok, bad = files.read_json_lines(spark, str(tmp_path / "j"), MEMBERSHIP)
    assert sorted(r.symbol for r in ok.collect()) == ["A", "C", "É"] and bad.count() == 2
    df.drop("source").write.orc(str(tmp_path / "o"))
    assert files.read_orc(spark, str(tmp_path / "o"), MEMBERSHIP).select("source").distinct().collect() == [(None,)]


def test_sql_is_read_only(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert files.read_only_sql(spark, "SELECT sum(x) AS s FROM t", {"t": df}).first().s == 3
    for bad in ("DROP TABLE t", "CREATE TABLE z AS SELECT 1", "INSERT INTO t VALUES (1)", "SET a = 1"):
        with pytest.raises(PermissionError):
            files.read_only_sql(spark, bad, {"t": df})
    assert not spark.catalog.tableExists("t")


def test_streams(spark, tmp_path):
    from tidemark.streaming import events as E

    day = dt.datetime(2024, 1, 1)
    parts = [[(1, 0, 7, "a", 1.0), (2, 30, 7, "a", 2.0), (2, 30, 7, "a", 2.0), (3, 200, 8, "b", 5.0)], [(4, 400, 7, "a", 3.0), (5, 10, 7, "a", 9.0), (6, 410, 8, "b", 1.0)]]
    src = tmp_path / "in"
    for k, rows in enumerate(parts):
        df = spark.createDataFrame([(i, day + dt.timedelta(minutes=m), u, t, v, None) for i, m, u, t, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        src.mkdir(exist_ok=True)
        for f in (tmp_path / f"w{k}").glob("*.parquet"):
            f.rename(src / f"{k}.parquet")
    assert spark.read.parquet(str(src)).schema == EVENTS

    def drain(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    stream = lambda: E.read_events(spark, str(src))
    totals = drain(E.windowed_totals(E.distinct_events(stream())), "totals", "append")
    got = {(r.window_start.hour, r.event_type): (r.n, r.total) for r in totals}
    # The repeated event counts once; a late one may still count while its window is open.
    assert got[0, "a"] in ((2, 3.0), (3, 12.0)) and got[3, "b"] == (1, 5.0)
    last = {}
    for r in drain(E.rising_streaks(stream()), "streaks", "update"):
        last[r.user_id] = max(last.get(r.user_id, (0, 0)), (r.n, r.longest))
    assert last[8] == (2, 1) and last[7][0] == 5


def test_streamed_upserts(spark, tmp_path):
    from tidemark.streaming.events import upsert_bars

    df = spark.createDataFrame([bar("A", dt.date(2024, 1, 2), 1.0, 1), bar("A", dt.date(2024, 1, 2), 2.0, 2)], BARS)
    df.write.parquet(str(tmp_path / "in"))
    q = upsert_bars(spark.readStream.schema(BARS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.close for r in files.read_partitioned_bars(spark, str(tmp_path / "out"), BARS).collect()] == [2.0]


def test_a_batch_without_partition_value_is_refused(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 2024), ("B", 2, None)], "k string, at int, year int")
    with pytest.raises(ValueError):
        sinks.upsert_partitioned(df, str(tmp_path / "t"), ["k"], ["at"], "year")


def test_the_old_partition_stays_if_the_new_one_cannot_move(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("A", 1, 2024)], "k string, at int, year int")
    sinks.upsert_partitioned(df, path, ["k"], ["at"], "year")
    sinks.upsert_partitioned(spark.createDataFrame([("A", 2, 2024), ("B", 1, 2024)], df.schema), path, ["k"], ["at"], "year")
    assert sorted((r.k, r["at"]) for r in spark.read.parquet(path).collect()) == [("A", 2), ("B", 1)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_views_of_the_caller_are_put_back(spark):
    spark.range(3).createOrReplaceTempView("mine")
    assert files.read_only_sql(spark, "WITH q AS (SELECT * FROM mine) SELECT count(*) AS n FROM q", {"mine": spark.range(7), "other": spark.range(1)}).first().n == 7
    assert spark.table("mine").count() == 3 and not spark.catalog.tableExists("other")
    for bad in ("DROP VIEW mine", "INSERT INTO mine VALUES (1)", "CREATE TABLE x AS SELECT 1", "SET a = 1", "CACHE TABLE mine"):
        with pytest.raises(PermissionError):
            files.read_only_sql(spark, bad, {"mine": spark.range(1)})
    spark.catalog.dropTempView("mine")
