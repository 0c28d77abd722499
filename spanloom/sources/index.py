"""A stored index: its files, the settings it was made with, and when it may be read again."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "video_id string, start_us long, end_us long, kind string, text string, language string, events array<string>"
CUE = "video_id string, start_us long, end_us long, text string, position string, size string"
STAMP = "video_id string, fingerprint string"


def store(path: str, segments: DataFrame, cues: DataFrame, videos: DataFrame, fingerprint: str) -> None:
    """Replace the folders of ``videos``; their stamps are written last, so a half-written index isn't taken for one."""
    keys = videos.select("video_id").distinct()
    for name, rows in (("segments", segments), ("cues", cues)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(f"{path}/{name}")
    keys.select("video_id", F.lit(fingerprint).alias("fingerprint")).write.mode("append").json(f"{path}/stamps")


def stored(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """``video_id`` of what was stored with these settings; a folder or a line that can't be read holds none."""
    try:
        stamps = spark.read.schema(STAMP).option("mode", "DROPMALFORMED").json(f"{path}/stamps")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "video_id string")
    return stamps.where(F.col("fingerprint") == fingerprint).select("video_id").distinct()


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, cues) of all stored videos."""
    return spark.read.schema(SEGMENT).parquet(f"{path}/segments"), spark.read.schema(CUE).parquet(f"{path}/cues")


def write_text(lines: DataFrame, keys: DataFrame, path: str, key: str = "video_id", order: str = "ordinal", line: str = "line") -> None:
    """One text file for each of ``keys``, its lines in order; a key without lines has a file of one empty line."""
    all_ = keys.select(key).distinct().join(lines, key, "left").select(key, F.coalesce(F.col(order), F.lit(0)).alias("__o"), F.coalesce(F.col(line), F.lit("")).alias("value"))
    all_.repartition(key).sortWithinPartitions(key, "__o").select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def write_observations(lines: DataFrame, path: str, keys: Sequence[str]) -> None:
    """A log of readings, refused ones too, that ``files.observations`` reads: a row for each frame, its lines in one array."""
    line = F.struct("text", "confidence", "top", "bottom", "left", "right", F.col("look").alias("appearance"), "text_height")
    frames = lines.groupBy(*keys, "at_us", "verification", "discovery").agg(F.collect_list(F.when(F.col("text").isNotNull(), line)).alias("lines"))
    frames.select(*keys, (F.col("at_us") / 1e6).alias("timestamp_s"), "lines", "verification", "discovery").write.mode("overwrite").partitionBy(*keys).json(path)


# ---- small files of the driver


def write_json(path: str, data: Any) -> None:
    """Replace a file as a whole: written beside it, then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False, indent=1))
    os.replace(beside, path)


def append_json(path: str, rows: Sequence[Mapping[str, Any]]) -> None:
    """Add lines of JSON to a trace or a sheet of results, in one write."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))


def manifest(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The videos of a YAML or JSON list (``id``, ``file``, ``category``, ``language``, ``title``, ``url``), with their ``path``."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    rows = data.get("videos", []) if isinstance(data, dict) else data or []
    names = ("id", "file", "category", "language", "title", "url")
    listed = [tuple(None if r.get(n) is None else str(r[n]) for n in names) + (os.path.join(folder, str(r.get("file") or "")),) for r in rows if isinstance(r, dict)]
    return spark.createDataFrame(listed, ", ".join(f"{n} string" for n in names) + ", path string")


def snapshot(folder: str, system: str, prompt: str) -> str:
    """What a run asked, kept beside its trace."""
    path = os.path.join(folder, "prompt.txt")
    write_json(path, f"{system}\n\n{prompt}\n")
    return path
