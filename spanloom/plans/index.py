"""From video files to a stored index, and from an index to a report: what the command line runs.

Providers are handed in; each may be missing. Whatever they can't answer leaves its part of the index empty.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import render, spans, tracks
from spanloom.plans import agent, scan, tools
from spanloom.sources import config, index, providers

KEYS = ["video_id"]


@dataclass(frozen=True)
class Providers:
    detector: Callable[[], providers.SpeechDetector] | None = None
    transcriber: Callable[[], providers.Transcriber] | None = None
    tagger: Callable[[], providers.Tagger] | None = None
    reader: Callable[[], providers.Reader] | None = None


def missing() -> Any:
    raise RuntimeError("no such provider was given")


def second(x: float) -> int:
    return round(x * 1_000_000)


def heard(videos: DataFrame, given: Providers, settings: config.Settings) -> DataFrame:
    """Segments of videos (``video_id``, ``path``, ``duration_us``): a timeline of speech and the rest, each analysed."""
    if given.detector is None:
        return videos.sparkSession.createDataFrame([], index.SEGMENT)
    s = settings.speech
    cuts = {"merge_gap_us": second(s.merge_gap_s), "min_bridge_us": second(s.min_bridge_s), "min_region_us": second(s.min_region_s), "window_max_us": second(s.window_max_s)}
    regions = spans.timeline(providers.detections(videos, given.detector), KEYS, videos.select(*KEYS, "duration_us"), **cuts)
    regions = regions.join(videos.select(*KEYS, "path"), KEYS)
    return providers.analysed(regions, given.transcriber or missing, given.tagger, second(settings.labels.window_s)).drop("path")


def shown(frames: DataFrame | None, given: Providers, settings: config.Settings, spark: SparkSession) -> tuple[DataFrame, DataFrame | None]:
    """(cues, observations) of frames as ``scan.scan_text`` takes them."""
    if given.reader is None or frames is None:
        return spark.createDataFrame([], index.CUE), None
    r = settings.reading
    t = tracks.Settings(r.fps, r.min_confidence, r.singleton_confidence, r.min_text_height, r.max_hold_s, r.rejoin_gap_s, r.same_text_ratio)
    observed = scan.scan_text(frames, given.reader, KEYS, t, r.refresh_s, threshold=r.change_threshold)
    return tracks.track_cues(observed.join(frames.select(*KEYS, "duration_us").distinct(), KEYS), KEYS, settings=t), observed


def build(videos: DataFrame, path: str, given: Providers, settings: config.Settings, frames: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Index videos into ``path`` and return the ``video_id`` of those that were built; what is stored with the same settings stays."""
    spark = videos.sparkSession
    stamp = settings.fingerprint("speech", "labels", "sampling", "reading")
    due = videos if force else videos.join(index.stored(spark, path, stamp), KEYS, "left_anti")
    built = due.select(*KEYS)
    if built.isEmpty():
        return built
    cues, observed = shown(None if frames is None else frames.join(built, KEYS, "left_semi"), given, settings, spark)
    index.store(path, heard(due, given, settings), cues, built, stamp)
    if observed is not None:
        index.write_observations(observed, f"{path}/observations", KEYS)
    segments, cues = index.read(spark, path)
    index.write_text(render.audio_lines(segments, KEYS), built, f"{path}/audio_index")
    index.write_text(render.text_lines(cues, KEYS), built, f"{path}/text_index", order="start_us")
    return built


def prompt(audio: str, text: str, hints: str, question: str) -> str:
    return "\n\n".join(x for x in (hints, f"Audio index:\n{audio}", f"Text index:\n{text}", question) if x)


def report(client: agent.ChatClient, audio: str, text: str, duration: float, settings: config.Settings, given: tools.Views, question: str, folder: str, mode: str = "agentic", hints: str = "", rates: agent.Rates = agent.Rates()) -> agent.Outcome:
    """One run over an index: with tools, over the index alone, or over all frames and words at once. Leaves its prompt, trace and report in ``folder``."""
    if mode not in ("agentic", "baseline_full", "baseline_index_only"):
        raise ValueError(f"no mode {mode}")
    asked = prompt(audio, text, hints, question)
    if mode == "baseline_full":
        asked += "\n\n" + tools.everything(given, duration, settings)
    schemas = tools.SCHEMAS if mode == "agentic" else []
    limits = settings.agent
    at_hand = agent.Tools(tools.functions(given, settings) if schemas else {}, duration, limits.max_interval_s, limits.max_montages, f"{folder}/tools")
    budget = agent.Budget(limits.max_calls if schemas else 0, limits.max_seconds)
    system = "Report what the video shows and says as one JSON object."
    index.snapshot(folder, system, asked)
    out = agent.run(client, at_hand, schemas, system, asked, duration, budget, rates)
    index.append_json(f"{folder}/trace.jsonl", out.trace)
    index.write_json(f"{folder}/report.json", out.report)
    from spanloom.plans import report as R

    index.write_json(f"{folder}/report.md", R.markdown(out.report))
    return out


def usage(trace: list[Mapping[str, Any]]) -> dict[str, int]:
    """Tokens of all turns of a run, repairs too."""
    total: dict[str, int] = {}
    for row in trace:
        for name, n in (row.get("token_usage") or {}).items():
            if isinstance(n, (int, float)):
                total[name] = total.get(name, 0) + int(n)
    return total
