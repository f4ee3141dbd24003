"""Streams give what tables give, late rows and repeats included."""

from __future__ import annotations

from accessgeo.streaming import accumulators as acc

EVENTS = "key string, ts timestamp, amount int"


def feed(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.sql("SELECT " + " UNION ALL SELECT ".join(f"'{key}' AS key, TIMESTAMP '2024-01-01 {t}' AS ts, {n} AS amount" for key, t, n in rows)).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_windows_close_behind_the_watermark_and_late_rows_are_dropped(spark, tmp_path):
    batches = [[("a", "00:01:00", 1), ("a", "00:09:00", 2)], [("a", "00:31:00", 4)], [("a", "00:31:30", 0)], [("a", "00:02:00", 8), ("a", "00:32:00", 16)], [("a", "01:30:00", 32)]]
    stream = feed(spark, f"{tmp_path}/in", batches)
    acc.run_to_table(acc.window_counts(stream, "10 minutes", "10 minutes", ["key"]), f"{tmp_path}/out", f"{tmp_path}/state", "append")
    found = {(r["begin"].minute, r["n"], r["amount"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {(0, 2, 3), (30, 3, 20)}


def test_a_key_is_seen_once(spark, tmp_path):
    stream = feed(spark, f"{tmp_path}/in", [[("a", "00:01:00", 1), ("b", "00:01:00", 2)], [("a", "00:02:00", 4)]])
    acc.run_to_table(acc.first_seen(stream, "key", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state", "append")
    assert sorted(r["key"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_a_second_run_goes_on_from_the_state(spark, tmp_path):
    def run():
        stream = spark.readStream.schema("type string, ts timestamp").parquet(f"{tmp_path}/in/*")
        acc.run_to_table(acc.snapshot_counts(stream, "2024-01-20 00:00:00"), f"{tmp_path}/out", f"{tmp_path}/state")
        return {r["type"]: (r["elements"], r["missing"], r["newer"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    spark.sql("SELECT 'way' AS type, TIMESTAMP '2024-01-01' AS ts UNION ALL SELECT 'way', NULL").write.parquet(f"{tmp_path}/in/0")
    assert run() == {"way": (2, 1, 0)}
    spark.sql("SELECT 'way' AS type, TIMESTAMP '2024-02-01' AS ts UNION ALL SELECT 'node', TIMESTAMP '2024-01-20'").write.parquet(f"{tmp_path}/in/1")
    assert run() == {"way": (3, 1, 1), "node": (1, 0, 0)}
