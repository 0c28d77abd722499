"""Streaming forms: tumbling counts, merged gaps, latest accounts, and tracked text with its state.

Late rows are told by the watermark; a key's tracks close when the watermark passes the hold time.
"""

from __future__ import annotations

import json
import os
import pickle
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from spanloom.operators.tracks import Follower, Settings, frames_of, prepared


def tumbling(events: DataFrame, key: str, at: str, size: str, lateness: str) -> DataFrame:
    """Rows of each key in each window."""
    return events.withWatermark(at, lateness).groupBy(key, F.window(at, size)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def merged_gaps(events: DataFrame, key: str, at: str, gap: str, lateness: str) -> DataFrame:
    """Stretches of each key's events without a gap longer than ``gap``."""
    session = F.session_window(at, gap)
    found = events.withWatermark(at, lateness).groupBy(key, session).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return found.select(key, F.col("session_window.start").alias("start"), "last", "n")


def read_accounts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The best rows of every region that ``latest_accounts`` has written so far."""
    places = sorted(_places(path).values())
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def _places(path: str) -> dict[str, str]:
    """The folder that holds each bucket of regions now."""
    try:
        with open(os.path.join(path, "places.json"), encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def latest_accounts(rows: DataFrame, path: str, region: list[str], buckets: int = 64) -> DataStreamWriter:
    """A ``foreachBatch`` writer that keeps each region's best rows in ``path``, by coverage, then recency.

    Regions lie in buckets by hash. A batch rereads and rewrites the buckets that it touches alone, each into a
    folder of its own number; the list of folders is replaced as a whole, and only then are the old ones removed,
    so a batch that is run again finds what it found before, or that it is done.
    """
    from spanloom.operators.transcripts import best_account
    from spanloom.sources.index import write_json

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucketed = batch.withColumn("__bucket", F.pmod(F.xxhash64(*region), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [str(r["__bucket"]) for r in bucketed.select("__bucket").distinct().collect()]
            places = _places(path)
            old = [places[b] for b in touched if b in places]
            if any(f"/v{number}/" in x for x in old):
                # the list names this batch's folders: it was merged, and is asked for again
                return
            history = spark.read.schema(batch.schema).parquet(*old) if old else batch.where("false")
            best = best_account(history.unionByName(batch), region, "coverage", "recorded_at")
            best.withColumn("__bucket", F.pmod(F.xxhash64(*region), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/v{number}")
            write_json(os.path.join(path, "places.json"), places | {b: f"{path}/v{number}/__bucket={b}" for b in touched})
            for x in old:
                shutil.rmtree(x, ignore_errors=True)
        finally:
            bucketed.unpersist()

    return rows.writeStream.foreachBatch(merge)


def tracked(lines: DataFrame, key: str, at: str, lateness: str, settings: Settings = Settings(), horizon_s: float = 1e9) -> DataFrame:
    """Tracks (key, ``start_us``, ``end_us``, ``text``) as they close, from rows like those of ``track_cues``.

    Frames behind the watermark are taken in order; later ones wait in the state. A change is dated back to
    its first sight, so a track is given out when nothing can change it any more.
    """
    schema = lines.schema
    kind = schema[key].dataType.simpleString()
    columns = [c for c in ("at_us", "text", "confidence", "top", "bottom", "left", "right", "look", "verification", "discovery")]

    def run(found: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, waiting = pickle.loads(state.get[0]) if state.exists else (Follower(horizon_s, settings), pd.DataFrame(columns=columns))
        ended = state.hasTimedOut
        if not ended:
            waiting = pd.concat([waiting, *(b[columns] for b in batches)])
        now = state.getCurrentWatermarkMs() * 1000
        ready = waiting if ended else waiting[waiting.at_us <= now]
        waiting = waiting.iloc[0:0] if ended else waiting[waiting.at_us > now]
        for frame in prepared(list(frames_of(ready)), settings) if len(ready) else ():
            tracker.take(frame)
        done = tracker.finish() if ended else tracker.closed
        out = pd.DataFrame([(found[0], round(t.since * 1e6), round(end * 1e6), tracker.lines.words[t.best].text) for t, end in done], columns=[key, "start_us", "end_us", "text"])
        # the state is what is open
        tracker.compacted()
        if ended:
            state.remove()
        else:
            state.update((pickle.dumps((tracker, waiting)),))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + int(settings.hold_s * 1000) + 1)
        yield out

    stream = lines.withWatermark(at, lateness)
    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, start_us long, end_us long, text string", "state binary", "append", GroupStateTimeout.EventTimeTimeout)
