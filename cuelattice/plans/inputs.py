"""The given tables, and the event series derived from them once per application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuelattice.operators.series import index_rows, with_block
from cuelattice.session import BLOCK_ROWS_KEY, block_rows, materialize_bucketed

_SERIES: dict[tuple[str, str, int], DataFrame] = {}

# Rows one bucket of the series table should hold.
BUCKET_ROWS = 4_000_000
# Spark refuses tables of more than 100,000 buckets; beyond this the buckets grow.
MOST_BUCKETS = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    """Seconds since 2024-01-01 with microsecond grain."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {ts}) / 1e6D")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("series_id"),
        "event_id",
        seconds().alias("t"),
        F.col("value").alias("x"),
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as series: one per user, ``idx`` in time order, bucketed by (series, block).

    The result is a written table, shared by every query of the application that asks for it.
    """
    size = block_rows(spark)
    memo = (spark.sparkContext.applicationId, sf_dir, size)
    if memo not in _SERIES:
        rows = with_block(index_rows(timed_events(spark, sf_dir), ["series_id"], ["t", "event_id"]), size)
        n = table(spark, sf_dir, "events").count()
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(min(least, 64), min(n // BUCKET_ROWS, MOST_BUCKETS))
        _SERIES[memo] = materialize_bucketed(rows, "series", ["series_id", "block"], ["series_id", "block", "idx"], buckets)
    return _SERIES[memo]


def series_lengths(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


# The same series in SQL; ``s`` is the name the statements below read.
S_SQL = """s AS MATERIALIZED (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         event_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value AS x, event_type,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events)"""

__all__ = ["BLOCK_ROWS_KEY", "S_SQL", "event_series", "seconds", "series_lengths", "table", "timed_events"]
