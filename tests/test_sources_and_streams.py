"""Readers and writers over files, and the streaming forms against their batch results."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators.tracks import Settings
from spanloom.sources import files, index
from spanloom.streaming import timelines

S = 1_000_000


def test_media_are_known_by_content(spark, tmp_path):
    (tmp_path / "a.MP4").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    rows = files.media(spark, str(tmp_path)).collect()
    assert [(r.video_id, r.size_bytes) for r in rows] == [(hashlib.sha256(b"abc").hexdigest(), 3)]
    assert [r.video_id for r in files.digested(files.media_paths(spark, str(tmp_path)), 2).collect()] == [rows[0].video_id]
    with pytest.raises(ValueError, match="extensions"):
        files.media(spark, str(tmp_path), ("avi",))


def test_sidecars(spark, tmp_path):
    (tmp_path / "v.subs.json").write_text(json.dumps({"video_id": "v", "track": {"language": "ko", "cues": [{"start_s": 1.5, "text": "x"}, {"start_s": 2, "text": " "}]}}))
    (tmp_path / "w.subs.json").write_text(json.dumps({"video_id": "w", "track": None}))
    (tmp_path / "x.subs.json").write_text("{broken")
    found = files.track_cues(files.caption_tracks(spark, str(tmp_path / "*.subs.json"))).collect()
    assert [(r.stem, r.start_us, r.text) for r in found] == [("v", 1_500_000, "x")]
    # a file that says there is no track is there, one that isn't there is not
    assert sorted((r.stem, r.looked, r.track is None) for r in files.caption_tracks(spark, str(tmp_path / "*.subs.json")).collect()) == [("v", True, False), ("w", True, True)]
    (tmp_path / "v.meta.json").write_text(json.dumps({"title": "T", "chapters": [{"start_s": 0, "end_s": 9, "title": "c"}]}))
    row = files.hints(spark, str(tmp_path / "*.meta.json")).first()
    assert (row.stem, row.title, row.chapters[0].title) == ("v", "T", "c")


def test_logs(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text(json.dumps({"timestamp_s": 1.0, "lines": [{"text": "a", "top": 0.1, "bottom": 0.2, "left": 0.0, "right": 1.0}]}) + "\n" + json.dumps({"timestamp_s": 2.0, "lines": []}) + "\n")
    assert sorted((r.at_us, r.text) for r in files.observations(spark, str(tmp_path / "o.jsonl")).collect()) == [(S, "a"), (2 * S, None)]
    (tmp_path / "t.jsonl").write_text('{"start_s": 1, "end_s": 2, "text": "x", "region": [0, 9], "clip": [0, 9]}\nnot json\n')
    assert files.transcripts(spark, str(tmp_path / "t.jsonl")).count() == 1


def test_writers(spark, tmp_path):
    files.append_log(spark.range(2), f"{tmp_path}/log")
    files.append_log(spark.range(1), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 3
    rows = spark.createDataFrame([("v", 2, "b"), ("v", 1, "a"), ("w", 1, "c")], "video_id string, ordinal long, line string")
    index.write_text(rows, spark.createDataFrame([("v",), ("w",), ("x",)], "video_id string"), f"{tmp_path}/text")
    assert [r.value for r in spark.read.text(f"{tmp_path}/text/video_id=v").collect()] == ["a", "b"]
    assert [r.value for r in spark.read.text(f"{tmp_path}/text/video_id=x").collect()] == [""]
    files.write_by_key(rows, f"{tmp_path}/keys")
    files.write_by_key(rows.where("video_id = 'v'").withColumn("line", F.lit("n")), f"{tmp_path}/keys")
    assert sorted(r.line for r in spark.read.parquet(f"{tmp_path}/keys").collect()) == ["c", "n", "n"]


def moment(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def drained(spark, frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def streamed(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_gaps_merge_in_a_stream(spark, tmp_path):
    rows = [[("a", moment(0)), ("a", moment(5)), ("a", moment(30))], [("a", moment(500))], [("a", moment(900))]]
    found = drained(spark, timelines.merged_gaps(streamed(spark, tmp_path, rows, "k string, ts timestamp"), "k", "ts", "10 seconds", "0 seconds"), "gaps")
    assert sorted((r.start, r.last, r.n) for r in found)[:2] == [(moment(0), moment(5), 2), (moment(30), moment(30), 1)]


def test_windows_count_in_a_stream(spark, tmp_path):
    rows = [[("a", moment(0)), ("a", moment(59)), ("a", moment(61))], [("a", moment(500))], [("a", moment(900))]]
    found = drained(spark, timelines.tumbling(streamed(spark, tmp_path, rows, "k string, ts timestamp"), "k", "ts", "1 minute", "0 seconds"), "windows")
    assert sorted((r.start, r.n) for r in found)[:2] == [(moment(0), 2), (moment(60), 1)]


def test_text_is_tracked_in_a_stream(spark, tmp_path):
    line = lambda t, text: ("a", moment(t), int(t * S), text, 0.99, 0.9, 0.95, 0.3, 0.7, None, False, False)
    schema = "k string, ts timestamp, at_us long, text string, confidence double, top double, bottom double, left double, right double, look string, verification boolean, discovery boolean"
    offset = int((moment(0) - datetime.datetime(1970, 1, 1)).total_seconds())
    at = lambda t, text: (*line(t, text)[:2], (offset + t) * S, *line(t, text)[3:])
    rows = [[at(0, "Hello there"), at(1, "Hello there")], [at(2, "Another line"), at(3, "Another line")], [at(200, "Much later")], [at(400, "The end of it")]]
    stream = timelines.tracked(streamed(spark, tmp_path, rows, schema), "k", "ts", "0 seconds", Settings(fps=1, min_confidence=0.5, singleton=0.85, min_height=0), horizon_s=1e12)
    found = sorted((r.start_us // S - offset, r.end_us // S - offset, r.text) for r in drained(spark, stream, "tracks"))
    assert found[:2] == [(0, 2, "Hello there"), (2, 33, "Another line")]


def test_a_stream_keeps_the_best_account_of_each_region(spark, tmp_path):
    schema = "region string, coverage double, recorded_at string, text string"
    batches = [[("a", 0.5, "1", "half"), ("b", 1.0, "1", "whole")], [("a", 0.9, "2", "more"), ("c", 0.1, "2", "some")], [("a", 0.7, "3", "less"), ("b", 1.0, "3", "newer")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{n}")
    out = str(tmp_path / "accounts")
    for n in range(3):
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in/{n}")
        timelines.latest_accounts(stream, out, ["region"], 8).option("checkpointLocation", f"{tmp_path}/cp{n}").trigger(availableNow=True).start().awaitTermination(120)
        if n < 2:
            # each source numbers its batches from 0, so later ones are given the numbers that follow
            (tmp_path / "accounts" / "v0").rename(tmp_path / "accounts" / f"u{n}")
            places = tmp_path / "accounts" / "places.json"
            places.write_text(places.read_text().replace("/v0/", f"/u{n}/"))
    found = timelines.read_accounts(spark, out, spark.createDataFrame([], schema).schema)
    assert sorted((r.region, r.text) for r in found.collect()) == [("a", "more"), ("b", "newer"), ("c", "some")]
