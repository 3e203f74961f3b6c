import datetime as dt

from siftline.operators.changes import ChangeTable
from siftline.streaming import flows

DAY = dt.datetime(2026, 1, 1)


def stream(spark, tmp_path, frames):
    src = str(tmp_path / "src")
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(src)


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_rescans_only_changed_content(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    f = lambda rows: spark.createDataFrame(rows, "file string, content string, at timestamp")
    frames = [f([("a", "1", DAY), ("b", "1", DAY)]), f([("a", "1", DAY + dt.timedelta(1)), ("b", "2", DAY + dt.timedelta(1))]), f([("a", None, DAY + dt.timedelta(2))])]
    got = sorted((r["file"], r["kind"]) for r in drain(flows.changed_files(stream(spark, tmp_path, frames)), "rescan", "append"))
    assert got == [("a", "changed"), ("a", "new"), ("b", "changed"), ("b", "new")]


def test_quiet_sets_and_trend_equal_batch(spark, tmp_path):
    rows = [("app/f%d" % (i % 3), DAY + dt.timedelta(minutes=m), "open") for i, m in enumerate([0, 1, 2, 30, 31, 90, 5000])]
    df = spark.createDataFrame(rows, "file string, at timestamp, action string")
    got = drain(flows.quiet_sets(stream(spark, tmp_path, [df])), "quiet", "append")
    want = [(r["start"], r["file"], r["n"]) for r in flows.quiet_sets(df).collect()]
    # the last burst is still open
    assert {(r["start"], r["file"], r["n"]) for r in got} == set(sorted(want)[:-1])
    assert sum(r["n"] for r in flows.trend(df, "at").collect()) == len(rows)


def test_feedback_counters(spark, tmp_path):
    df = spark.createDataFrame([("r", "fp")] * 4 + [("r", "tp")] * 2 + [("s", "tp")], "rule_id string, kind string")
    got = {r["rule_id"]: (r["tp"], r["fp"], r["suppressed"]) for r in drain(flows.feedback_counters(stream(spark, tmp_path, [df])), "counters", "complete")}
    assert got == {"r": (2, 4, True), "s": (1, 0, False)}


def test_maintained_table_equals_one_batch(spark, tmp_path):
    cols = "id long, fingerprint string, timestamp timestamp, action string, old_state string, new_state string"
    rows = [
        (1, "a", DAY, "open", None, "open"), (4, "a", DAY + dt.timedelta(3), "resolve", "open", "fixed"), (2, "b", DAY, "open", None, "open"),
        (5, "b", DAY + dt.timedelta(5), "purge", "open", None), (3, "b", DAY + dt.timedelta(1), "confirm", "open", "confirmed"), (6, "b", DAY + dt.timedelta(6), "open", None, "Open"),
    ]
    df = spark.createDataFrame(rows, cols)
    parts = [spark.createDataFrame(rows[i : i + 2], cols) for i in (4, 0, 2)]
    flows.maintain(stream(spark, tmp_path, parts), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = sorted(map(tuple, ChangeTable(spark, str(tmp_path / "t")).state().collect()))
    once = ChangeTable(spark, str(tmp_path / "o"))
    once.apply(df)
    assert got == sorted(map(tuple, once.state().collect())) == [("a", "fixed"), ("b", "open")]
