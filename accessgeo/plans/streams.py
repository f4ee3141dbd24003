"""Queries that read a table as a stream, each with the SQL of its final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.session import scratch_path
from accessgeo.session import read as read_table
from accessgeo.streaming import accumulators as acc


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as a stream of its files."""
    return spark.readStream.schema(read_table(spark, sf_dir, table).schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{table}.parquet*")


def _final(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, name + "-state")
    acc.run_to_table(stream, path, checkpoint)
    return spark.read.parquet(path)


def streamed_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stream past their labels, a table."""
    docs = _stream(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.selectExpr("lang as region", "case when doc_id % 13 = 0 then null else quality end as label", "(n_chars % 101) / 100.0D as prob")
    return _final(acc.confusion_counts(rows, 0.5, ["region"]), "confusion")


def streamed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events").selectExpr("case when event_id % 3 = 0 then 'node' else 'way' end as type", "cast(ts as timestamp) as ts")
    return _final(acc.snapshot_counts(e, "2024-01-20 00:00:00"), "snapshot")


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events").selectExpr("cast(ts as timestamp) as ts", "event_type", "event_id % 10 as amount")
    out = _final(acc.window_counts(e, "1 day", "40 days", ["event_type"]), "windows")
    return out.withColumn("begin", F.date_format("begin", "yyyy-MM-dd"))


SQL = {
    "streamed_confusion": "WITH r AS (SELECT lang AS region, CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE quality END AS y, (n_chars % 101) / 100.0::DOUBLE >= 0.5 AS up FROM documents d JOIN labels USING (doc_id)) SELECT region, count(*) FILTER (y = 1 AND up) AS tp, count(*) FILTER (y = 0 AND up) AS fp, count(*) FILTER (y = 1 AND NOT up) AS fn, count(*) FILTER (y = 0 AND NOT up) AS tn FROM r WHERE y IS NOT NULL GROUP BY 1",
    "streamed_snapshot": "SELECT CASE WHEN event_id % 3 = 0 THEN 'node' ELSE 'way' END AS type, count(*) AS elements, count(*) FILTER (ts IS NULL) AS missing, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS newer FROM events GROUP BY 1",
    "streamed_windows": "SELECT strftime(ts::DATE, '%Y-%m-%d') AS begin, event_type, count(*) AS n, sum(event_id % 10)::BIGINT AS amount FROM events GROUP BY 1, 2",
}
QUERIES = {f.__name__: f for f in (streamed_confusion, streamed_snapshot, streamed_windows)}
