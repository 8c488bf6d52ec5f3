"""Streaming jobs as queries: each follows its table until it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.streaming import feeds


def stream_usage_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and kind."""
    out = feeds.usage_windows(spark, f"{d}/events.parquet")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "kind", "n", "total")


def stream_run_states(spark: SparkSession, d: str) -> DataFrame:
    """The newest state of every run, from the stream of its updates."""
    order = ["updated_at", "status"]
    return feeds.latest_states(spark, f"{d}/lab_runs.parquet", "id", order, ["status", "page", "document_id"])


QUERIES = {f.__name__: f for f in (stream_usage_windows, stream_run_states)}
SQL = {
    "stream_usage_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, event_type as kind, count(*) as n, cast(sum(cast(floor(value * 100 + 0.5) as bigint)) as bigint) as total from events group by all",
    "stream_run_states": "select id as key, status, page, document_id from (select *, row_number() over (partition by id order by updated_at desc nulls last, status desc nulls last) as rn from lab_runs where id is not null) where rn = 1",
}
