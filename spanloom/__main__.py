"""Commands; the result is one JSON object on standard output, everything else goes to standard error.

``python -m spanloom replay LOG OUT`` derives text cues from a log of readings; ``timeline SPANS OUT`` a timeline;
``index VIDEOS OUT`` indexes files (``--detector``, ``--transcriber``, ``--tagger``, ``--reader``, ``--prober`` name
providers as ``module:class``, ``--frames`` a Parquet table of frames); ``run INDEX OUT --video ID --client
module:class`` reports on an indexed video, ``--views`` naming what makes its ``tools.Views``.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanloom.operators import render, spans, tracks
from spanloom.plans import index, tools
from spanloom.sources import config, files, providers
from spanloom.sources import index as stored


def named(name: str | None) -> Callable[[], Any] | None:
    """The class or function ``module:name`` stands for."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="spanloom")
    out.add_argument("command", choices=("replay", "timeline", "index", "run"))
    out.add_argument("source")
    out.add_argument("target")
    for name in ("config", "detector", "transcriber", "tagger", "reader", "prober", "frames", "video", "client", "views", "mode", "question"):
        out.add_argument(f"--{name}")
    out.add_argument("--force", action="store_true")
    return out


def index_videos(spark: SparkSession, given: argparse.Namespace, settings: config.Settings) -> dict[str, Any]:
    videos = providers.probed(files.media(spark, given.source), named(given.prober) or providers.StubProber).where("duration_us is not null")
    frames = spark.read.parquet(given.frames) if given.frames else None
    made = index.Providers(*(named(getattr(given, n)) for n in ("detector", "transcriber", "tagger", "reader")))
    built = index.build(videos, given.target, made, settings, frames, given.force)
    return {"videos": videos.count(), "built": built.count()}


def run_report(spark: SparkSession, given: argparse.Namespace, settings: config.Settings) -> dict[str, Any]:
    own = F.col("video_id") == given.video
    segments, cues = (t.where(own) for t in stored.read(spark, given.source))
    duration = segments.unionByName(cues, allowMissingColumns=True).agg(F.max("end_us")).first()[0] or 0
    lines = lambda t, order: "\n".join(r.line for r in t.orderBy(*order).collect())
    audio, text = lines(render.audio_lines(segments, ["video_id"]), ["ordinal"]), lines(render.text_lines(cues, ["video_id"]), ["start_us", "line"])
    make = named(given.client)
    if make is None:
        raise SystemExit("--client names no class")
    found = index.report(make(), audio, text, duration / 1e6, settings, (named(given.views) or tools.Views)(), given.question or "", given.target, given.mode or settings.agent.mode)
    return {"title": found.report["title"], "tool_calls": found.tool_calls, "tokens": index.usage(found.trace), "cost": found.cost}


def main(arguments: list[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    settings = config.load(given.config) if given.config else config.checked(config.Settings())
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    began, told = time.monotonic(), {}
    if given.command == "replay":
        lines = files.observations(spark, given.source)
        ends = lines.groupBy("source").agg((F.max("at_us") + 1_000_000).alias("duration_us"))
        cues = tracks.track_cues(lines.join(ends, "source"), ["source"])
        render.text_lines(cues, ["source"]).write.json(given.target)
    elif given.command == "timeline":
        rows = spark.read.parquet(given.source)
        ends = rows.groupBy("key").agg(F.max("end_us").alias("duration_us"))
        spans.timeline(rows, ["key"], ends).write.parquet(given.target)
    else:
        told = (index_videos if given.command == "index" else run_report)(spark, given, settings)
    print(json.dumps({"command": given.command, "target": given.target, **told, "seconds": round(time.monotonic() - began, 3)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
