from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tonalis.streaming import events as E

T0 = datetime(2024, 1, 1)


def table(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.mode("append").parquet(path)


def test_windows_sessions_and_repeats(spark, tmp_path):
    path = f"{tmp_path}/in"
    rows = [(k, T0 + timedelta(minutes=10 * k), k % 2, "a") for k in range(40)] + [(5, T0 + timedelta(minutes=50), 1, "a")]
    table(spark, path, rows)
    schema = spark.read.parquet(path).schema
    w = E.run_once(E.window_counts(E.read_stream(spark, path, schema), "ts", "event_type"), f"{tmp_path}/w")
    assert sum(r.n for r in w.collect()) == 37 and w.count() == 6
    once = E.run_once(E.first_seen(E.read_stream(spark, path, schema), ["event_id"], "ts"), f"{tmp_path}/o")
    assert once.count() == 40
    s = E.run_once(E.session_windows(E.read_stream(spark, path, schema), "ts", "user_id", "5 minutes"), f"{tmp_path}/s")
    assert s.agg(F.max("n")).first()[0] == 2


def test_counters_go_on_after_a_restart(spark, tmp_path):
    path = f"{tmp_path}/in"
    seen = {}

    def keep(df, _):
        seen.update({r.user_id: r.n for r in df.collect()})

    for part in range(2):
        table(spark, path, [(100 * part + k, T0, k % 2, "a") for k in range(10)])
        schema = spark.read.parquet(path).schema
        q = E.running_plays(E.read_stream(spark, path, schema), "user_id").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert seen == {0: 10, 1: 10}
