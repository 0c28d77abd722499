"""Readers of media files, sidecars and logs, and writers of what is derived from them.

Paths may be folders or patterns of any store Spark reads. Sidecars that are missing or malformed give no
row, and join as nulls.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as X

EXTENSIONS = ("mp4", "mkv", "mov", "webm", "avi", "m4v")
HINTS = "title string, channel string, language string, description string, chapters array<struct<start_s:double,end_s:double,title:string>>"
TRACK = "video_id string, audio_language string, track struct<language:string,kind:string,format:string,content_sha256:string,has_word_timing:boolean,cues:array<struct<start_s:double,text:string>>>"
LINE = "text:string,confidence:double,top:double,bottom:double,left:double,right:double,appearance:string,text_height:double"
OBSERVATION = f"timestamp_s double, lines array<struct<{LINE}>>, verification boolean, discovery boolean, regions array<array<double>>"
TRANSCRIPT = "start_s double, end_s double, text string, region array<double>, clip array<double>, model string, recorded_at string"
JSON3 = "struct<events:array<struct<tStartMs:double,segs:array<struct<utf8:string,tOffsetMs:double>>>>>"
VTT_TIMING = r"(\d+):(\d+):(\d+)\.(\d+)\s*-->\s*(\d+):(\d+):(\d+)\.(\d+)"
VTT_HEADERS = r"^\s*(?:WEBVTT|Kind:|Language:|NOTE|STYLE|REGION)"


def media(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """``video_id`` (SHA-256 of the content), ``path`` and ``size_bytes`` of files with an allowed extension.

    The content is digested where the file is read; a file larger than a row may be (2 GB) wants ``digested(media_paths(...))``.
    Raises if no file is there, or none of an allowed extension.
    """
    found = media_paths(spark, path, extensions, "*")
    return found.select(F.sha2("content", 256).alias("video_id"), "path", "size_bytes")


def media_paths(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS, *columns: str) -> DataFrame:
    """``path`` and ``size_bytes`` of files with an allowed extension, their content unread."""
    found = spark.read.format("binaryFile").load(path).withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    allowed = found.where(F.col("extension").isin(*extensions)).withColumnRenamed("length", "size_bytes")
    if allowed.select("path").isEmpty():
        raise ValueError(f"no file at {path} has one of the extensions {', '.join(extensions)}")
    return allowed if columns else allowed.select("path", "size_bytes")


def digested(paths: DataFrame, block: int = 8 << 20) -> DataFrame:
    """``paths`` (``path``) with ``video_id``, the SHA-256 of each file read in blocks, whatever its size.

    Files are opened where the rows are, by any store that Arrow reads.
    """

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(path: str) -> str:
            store, place = fs.FileSystem.from_uri(path)
            found = hashlib.sha256()
            with store.open_input_stream(place) as f:
                while part := f.read(block):
                    found.update(part)
            return found.hexdigest()

        return s.map(one)

    return paths.withColumn("video_id", run("path"))


def _sidecars(spark: SparkSession, path: str, schema: str, suffix: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).json(path)
    rows = rows.withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), f"{suffix}$", ""))
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def hints(spark: SparkSession, path: str) -> DataFrame:
    """Title, channel, language and chapters of ``<video>.meta.json`` files, by ``stem``."""
    return _sidecars(spark, path, HINTS, r"\.meta\.json")


def caption_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Files ``<video>.subs.json``, by ``stem``, with ``looked``: a null ``track`` says that none was found, which
    differs from a file that isn't there once this is joined."""
    return _sidecars(spark, path, TRACK, r"\.subs\.json").withColumn("looked", F.lit(True))


def usable_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks with cues, every one of which has a moment and a text; others correct nothing."""
    sound = F.forall("track.cues", lambda c: c["start_s"].isNotNull() & ~F.isnan(c["start_s"]) & (c["start_s"] >= 0) & c["text"].isNotNull())
    return tracks.where(F.col("track").isNotNull() & (F.size("track.cues") > 0) & sound)


def track_cues(tracks: DataFrame) -> DataFrame:
    cues = usable_tracks(tracks).select("stem", F.posexplode("track.cues").alias("ordinal", "cue")).where(F.trim("cue.text") != "")
    return cues.select("stem", "ordinal", F.round(F.col("cue.start_s") * 1e6).cast("long").alias("start_us"), F.col("cue.text").alias("text"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a log of readings, by ``source``, one row for each line and one for a frame without lines."""
    rows = spark.read.schema(OBSERVATION).option("mode", "DROPMALFORMED").json(path).withColumn("source", F.col("_metadata.file_path"))
    lines = rows.select("source", F.round(F.col("timestamp_s") * 1e6).cast("long").alias("at_us"), F.coalesce("verification", F.lit(False)).alias("verification"), F.coalesce("discovery", F.lit(False)).alias("discovery"), F.explode_outer("lines").alias("l"))
    box = [F.col(f"l.{s}").alias(s) for s in ("top", "bottom", "left", "right")]
    return lines.select("source", "at_us", "verification", "discovery", F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"), *box, F.col("l.appearance").alias("look"), F.col("l.text_height").alias("text_height"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of append-only transcript logs; corrupt lines are skipped."""
    return spark.read.schema(TRANSCRIPT).option("mode", "DROPMALFORMED").json(path).where("text is not null and region is not null")


def parse_json3(payload: Column) -> Column:
    """An array of (``start_us``, ``text``) in order of time, from a json3 payload."""
    events = F.from_json(payload, JSON3)["events"]

    def segments(event: Column) -> Column:
        base = F.coalesce(event["tStartMs"], F.lit(0.0))
        made = F.transform(F.coalesce(event["segs"], F.array().cast("array<struct<utf8:string,tOffsetMs:double>>")), lambda s: F.struct(F.round((base + F.coalesce(s["tOffsetMs"], F.lit(0.0))) * 1000).cast("long").alias("start_us"), X.clean_text(F.coalesce(s["utf8"], F.lit(""))).alias("text")))
        return F.filter(made, lambda s: s["text"] != "")

    return F.array_sort(F.flatten(F.transform(F.coalesce(events, F.array().cast("array<struct<tStartMs:double,segs:array<struct<utf8:string,tOffsetMs:double>>>>")), segments)), lambda a, b: (a["start_us"] > b["start_us"]).cast("int") - (a["start_us"] < b["start_us"]).cast("int"))


def json3_word_timed(payload: Column) -> Column:
    """Whether over a fifth of the events hold several segments with text."""
    events = F.from_json(payload, JSON3)["events"]
    kept = F.transform(events, lambda e: F.size(F.filter(F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string,tOffsetMs:double>>")), lambda s: X.clean_text(F.coalesce(s["utf8"], F.lit(""))) != "")))
    return F.coalesce((F.size(kept) > 0) & (F.size(F.filter(kept, lambda n: n > 1)) > F.size(kept) * 0.2), F.lit(False))


def parse_track(payload: Column, form: Column) -> Column:
    """``cues`` and ``word_timed`` of a payload by the name of its format; whatever isn't json3 is read as WebVTT."""
    is_json = form == "json3"
    cues = F.when(is_json, parse_json3(payload)).otherwise(parse_vtt(payload))
    return F.struct(cues.alias("cues"), F.when(is_json, json3_word_timed(payload)).otherwise(False).alias("word_timed"))


def parse_vtt(payload: Column) -> Column:
    """An array of (``start_us``, ``text``) in order of time, from a WebVTT text."""

    def cue(block: Column) -> Column:
        part = lambda i: F.regexp_extract(block, VTT_TIMING, i).cast("long")
        start = (part(1) * 3600 + part(2) * 60 + part(3)) * 1_000_000 + part(4) * 1000
        lines = F.filter(F.split(block, "\n"), lambda x: ~x.rlike(VTT_TIMING) & (F.trim(x) != "") & ~x.rlike(VTT_HEADERS))
        return F.struct(start.alias("start_us"), X.clean_text(F.array_join(lines, " ")).alias("text"))

    blocks = F.filter(F.split(payload, "\n\n"), lambda b: b.rlike(VTT_TIMING))
    return F.array_sort(F.filter(F.transform(blocks, cue), lambda c: c["text"] != ""), lambda a, b: (a["start_us"] > b["start_us"]).cast("int") - (a["start_us"] < b["start_us"]).cast("int"))


# ---- writers


def write_by_key(rows: DataFrame, path: str, key: str = "video_id") -> None:
    """Replace the folders of the keys that ``rows`` holds; committed as a whole."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append JSON lines, with one moment for the call."""
    rows.withColumn("recorded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).write.mode("append").json(path)
