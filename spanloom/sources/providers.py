"""Perception models as providers: what each must answer, deterministic stubs, and how rows run through them.

A provider is made once in each Python worker and sees Arrow batches of rows. One that fails or is missing
leaves its answer empty and a note of why, so a query never fails for a model's sake.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import spans, tags

LABELS = "array<struct<label:string,confidence:double>>"
#: Lines of a reader, boxes in fractions of what was read.
LINES = "array<struct<text:string,confidence:double,left:double,top:double,right:double,bottom:double,text_height:double,look:string>>"
SENTENCES = "array<struct<start_us:bigint,end_us:bigint,text:string,language:string,events:array<string>>>"


class Prober(Protocol):
    def duration_us(self, path: str) -> int: ...


class Demuxer(Protocol):
    """Sound of a video as 16 kHz mono, whole or of a stretch of it; the path of what was written."""

    def audio(self, path: str) -> str: ...

    def clip(self, path: str, start_us: int, end_us: int) -> str: ...


class SpeechDetector(Protocol):
    def detect(self, path: str, duration_us: int) -> Sequence[tuple[int, int]]: ...


class Transcriber(Protocol):
    def transcribe(self, path: str, start_us: int, end_us: int) -> Sequence[dict[str, Any]]: ...


class Tagger(Protocol):
    def tag(self, path: str, start_us: int, end_us: int) -> Sequence[tuple[str, float | None]]: ...


class Reader(Protocol):
    """Lines of a frame or of a box of it (left, top, right, bottom in fractions), and a 256-bit look of a box."""

    def read(self, path: str, box: tuple[float, float, float, float] | None) -> Sequence[dict[str, Any]]: ...

    def fingerprint(self, path: str, box: tuple[float, float, float, float]) -> str: ...


class StubDetector:
    """Every other stretch of a fixed length is speech."""

    def __init__(self, each_us: int = 10_000_000):
        self.each_us = each_us

    def detect(self, path: str, duration_us: int) -> Sequence[tuple[int, int]]:
        return [(a, min(a + self.each_us, duration_us)) for a in range(0, duration_us, 2 * self.each_us)]


class StubTranscriber:
    """One sentence that names its stretch."""

    def transcribe(self, path: str, start_us: int, end_us: int) -> Sequence[dict[str, Any]]:
        return [{"start_us": start_us, "end_us": end_us, "text": f"words {start_us // 1_000_000}", "language": "en", "events": []}]


class StubTagger:
    def __init__(self, labels: Sequence[tuple[str, float | None]] = (("Music", 0.8),)):
        self.labels = labels

    def tag(self, path: str, start_us: int, end_us: int) -> Sequence[tuple[str, float | None]]:
        return self.labels


class StubProber:
    """Every file lasts as many seconds as its path has characters."""

    def duration_us(self, path: str) -> int:
        return len(path) * 1_000_000


class StubDemuxer:
    def audio(self, path: str) -> str:
        return f"{path}.wav"

    def clip(self, path: str, start_us: int, end_us: int) -> str:
        return f"{path}.{start_us}-{end_us}.wav"


#: What a provider raises for what it can't do. Anything else, memory that runs out among it, fails the task.
FAILURES = (ArithmeticError, AttributeError, ImportError, LookupError, OSError, RuntimeError, TypeError, ValueError)


def probed(videos: DataFrame, make: Callable[[], Prober]) -> DataFrame:
    """``videos`` (``path``) with ``duration_us``, null where it can't be told."""
    found = answered(videos, make, lambda p, r: {"us": p.duration_us(r.path)}, "found", "struct<us:bigint>")
    return found.withColumn("duration_us", F.col("found.us")).drop("found", "error")


def demuxed(rows: DataFrame, make: Callable[[], Demuxer], stretch: bool = False) -> DataFrame:
    """Rows (``path``, and with ``stretch`` a span) with ``audio_path``, null where it can't be had."""
    ask = (lambda p, r: {"path": p.clip(r.path, r.start_us, r.end_us)}) if stretch else (lambda p, r: {"path": p.audio(r.path)})
    found = answered(rows, make, ask, "found", "struct<path:string>")
    return found.withColumn("audio_path", F.col("found.path")).drop("found", "error")


def failures(rows: DataFrame) -> DataFrame:
    """Rows and errors of what ``answered`` gave, so that a broken model doesn't pass for an empty table."""
    return rows.agg(F.count("*").alias("rows"), F.count("error").alias("failed"), F.first("error", ignorenulls=True).alias("first_error"))


def answered(rows: DataFrame, make: Callable[[], Any], ask: Callable[[Any, Any], Any], answer: str, schema: str) -> DataFrame:
    """``rows`` with ``answer`` (of the type ``schema``) and ``error``; ``ask`` takes the provider and a row."""
    fields = rows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            provider, broken = make(), None
        except FAILURES as e:  # a model that cannot be loaded is no reason to fail
            provider, broken = None, f"{type(e).__name__}: {e}"
        for batch in batches:
            found, errors = [], []
            for row in batch.itertuples(index=False):
                try:
                    if broken:
                        raise RuntimeError(broken)
                    found.append(json.dumps(ask(provider, row)))
                    errors.append(None)
                except FAILURES as e:
                    found.append(None)
                    errors.append(str(e))
            yield batch.assign(__answer=found, error=errors)

    from pyspark.sql.types import StringType, StructType

    out = StructType([*fields.fields]).add("__answer", StringType()).add("error", StringType())
    return rows.mapInPandas(run, out).withColumn(answer, F.from_json("__answer", schema)).drop("__answer")


def detections(videos: DataFrame, make: Callable[[], SpeechDetector]) -> DataFrame:
    """Raw spans of speech of each video (``video_id``, ``path``, ``duration_us``), empty ones left out."""
    ask = lambda p, r: [{"start_us": a, "end_us": b} for a, b in p.detect(r.path, r.duration_us)]
    rows = answered(videos, make, ask, "found", "array<struct<start_us:bigint,end_us:bigint>>")
    return spans.clamp(rows.select("video_id", "duration_us", F.explode("found").alias("s")).select("video_id", "duration_us", "s.start_us", "s.end_us"), F.col("duration_us")).where("end_us > start_us")


def analysed(regions: DataFrame, transcriber: Callable[[], Transcriber], tagger: Callable[[], Tagger] | None, window_us: int = 10_000_000) -> DataFrame:
    """Segments of regions (``video_id``, ``path``, spans, ``kind``): words of speech, sound labels of the rest.

    Speech is transcribed region by region; without words its labels stand in. Other regions are tagged in
    windows, and neighbouring windows that agree become one; without a tagger they are left out.
    """
    keys = ["video_id", "path"]
    base = [*keys, "start_us", "end_us"]
    ask = lambda p, r: [dict(s) for s in p.transcribe(r.path, r.start_us, r.end_us)]
    spoken = answered(regions.where("kind = 'speech'").select(*base), transcriber, ask, "said", SENTENCES)
    kept = F.filter("said", lambda s: (s["language"] != "nospeech") & s["text"].rlike(r"[\p{L}\p{N}]"))
    heard = F.flatten(F.transform("said", lambda s: F.transform(s["events"], lambda e: F.struct(e.alias("label"), F.lit(None).cast("double").alias("confidence")))))
    none = F.array().cast("array<string>")
    language = F.try_element_at(F.filter(F.transform(kept, lambda s: s["language"]), lambda x: x != "unknown"), F.lit(1))
    words = F.array_join(F.transform(kept, lambda s: F.trim(s["text"])), " ")
    speech = spoken.select(*base, F.lit("speech").alias("kind"), F.coalesce(words, F.lit("")).alias("text"), F.coalesce(language, F.lit("unknown")).alias("language"), F.when(F.size(kept) > 0, none).otherwise(F.coalesce(tags.kept(heard), none)).alias("events"))
    if tagger is None:
        return speech
    windows = spans.split_long(regions.where("kind = 'non_speech'").select(*base, F.col("start_us").alias("region")), window_us)
    ask = lambda p, r: [{"label": label, "confidence": c} for label, c in p.tag(r.path, r.start_us, r.end_us)]
    tagged = answered(windows, tagger, ask, "labels", LABELS).withColumn("events", F.coalesce(tags.kept(F.col("labels")), none))
    quiet = spans.merge_runs(tagged.select(*base, "region", "events"), [*keys, "region"], "events")
    return speech.unionByName(quiet.select(*base, F.lit("non_speech").alias("kind"), F.lit("").alias("text"), F.lit("unknown").alias("language"), "events"))
