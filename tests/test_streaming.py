import datetime as dt

from loamworks.streaming.incremental import grow_index, new_records, sessions, windowed_signals

SCHEMA = "id bigint, ts timestamp, k string, v double"


def landed(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_windows_and_sessions_count_each_record(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    landed(spark, str(tmp_path / "in"), [(1, at(1), "a", 1.0), (2, at(1, 30), "a", 3.0), (3, at(5), "a", 5.0)])
    drained(windowed_signals(stream(spark, str(tmp_path / "in")), "ts", "k", "v", "2 hours"), "w", "complete")
    assert {(r["n"], r["mean"]) for r in spark.table("w").collect()} == {(2, 2.0), (1, 5.0)}
    drained(sessions(stream(spark, str(tmp_path / "in")), "ts", "k"), "s", "complete")
    assert sorted(r["n"] for r in spark.table("s").collect()) == [1, 2]


def test_repeated_records_come_once(spark, tmp_path):
    row = (1, dt.datetime(2024, 1, 1), "a", 1.0)
    landed(spark, str(tmp_path / "in"), [row, row])
    drained(new_records(stream(spark, str(tmp_path / "in")), "ts", ["id"]), "once")
    assert spark.table("once").count() == 1


def test_index_grows_only_by_what_it_lacks(spark, tmp_path):
    out, now = str(tmp_path / "out"), dt.datetime(2024, 1, 1)
    for rows in ([(1, now, "a", 1.0), (2, now, "a", 1.0)], [(2, now, "a", 1.0), (3, now, "a", 1.0), (3, now, "a", 1.0)]):
        landed(spark, str(tmp_path / "in"), rows)
        q = grow_index(stream(spark, str(tmp_path / "in")), out, "id").option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
