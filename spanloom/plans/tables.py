"""How the test tables are read as timelines: events as spans per user, in microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import time as T

#: The same rows for SQL.
EVENTS = """ev AS (
  SELECT event_id, user_id AS k, event_type AS kind, value, epoch_us(ts) AS start_us,
         epoch_us(ts) + CAST(floor(value * 60000000.0::DOUBLE) AS BIGINT) AS end_us
  FROM events),
dur AS (SELECT k, min(start_us) AS origin, max(end_us) - min(start_us) AS duration_us FROM ev GROUP BY k),
rel AS (SELECT e.event_id, e.k, e.kind, e.value, e.start_us - d.origin AS start_us, e.end_us - d.origin AS end_us, d.duration_us
        FROM ev e JOIN dur d USING (k))"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id``, key ``k``, ``kind``, ``value``, and the span of ``value`` minutes from the event's moment."""
    start = T.from_timestamp(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), F.col("event_type").alias("kind"), "value", start.alias("start_us"), (start + F.floor(F.col("value") * float(T.MINUTE)).cast("long")).alias("end_us"))


def relative(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The spans from each key's first moment on, and each key's ``duration_us``."""
    rows = events(spark, sf_dir)
    ends = rows.groupBy("k").agg(F.min("start_us").alias("origin"), (F.max("end_us") - F.min("start_us")).alias("duration_us"))
    moved = rows.join(ends, "k").select("event_id", "k", "kind", "value", (F.col("start_us") - F.col("origin")).alias("start_us"), (F.col("end_us") - F.col("origin")).alias("end_us"), "duration_us")
    return moved, ends.select("k", "duration_us")
