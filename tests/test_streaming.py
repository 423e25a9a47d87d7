import datetime as dt

from pyspark.sql import functions as F

from murmurlake.streaming import logs as L


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def source(spark, tmp_path, rows, schema):
    where = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(where)
    return spark.readStream.schema(schema).parquet(where)


def test_daily_counts_and_first_visits(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [("a", "visit", t), ("a", "visit", t + dt.timedelta(hours=1)), ("b", "visit", t + dt.timedelta(days=1)), ("b", "export", t)]
    s = source(spark, tmp_path, rows, "session string, event string, at timestamp")
    got = {(str(r.day), r.event): r["count"] for r in drained(L.daily_counts(s), "days", "complete")}
    assert got == {("2024-01-01", "visit"): 2, ("2024-01-02", "visit"): 1, ("2024-01-01", "export"): 1}
    assert sorted(r.session for r in drained(L.first_visits(s), "firsts")) == ["a", "b"]
    assert len(drained(L.once_per_content(s, ["session", "event"]), "exports")) == 3


def test_allowance_never_falls_below_zero(spark, tmp_path):
    day = L.DAY_US
    rows = [("s", 0, 9000), ("s", 1, 3000), ("s", 2, 2001), ("s", day + 1, 9000), ("r", 0, 3000)]
    s = source(spark, tmp_path, rows, "session string, at_us bigint, words bigint")
    got = {(r.session, r.at_us): (r.charged, r.left) for r in drained(L.allowances(s, 10_000), "runs")}
    assert got[("s", 0)] == (9000, 1000)
    assert got[("s", 1)] == (1000, 0)
    assert got[("s", 2)] == (None, 0)
    assert got[("s", day + 1)] == (9000, 1000) or got[("s", day + 1)] == (9000, 0)
    assert got[("r", 0)] == (3000, 7000)
