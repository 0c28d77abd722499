"""Providers with stubs, settings, clocks, and the overlay of transcripts and captions."""

import json

import pytest

from spanloom.__main__ import main
from spanloom.operators import captions, clocks, spans
from spanloom.plans import overlay
from spanloom.sources import config, providers

S = 1_000_000


def test_regions_run_through_their_models(spark):
    videos = spark.createDataFrame([("v", "p", 40 * S)], "video_id string, path string, duration_us long")
    found = providers.detections(videos, providers.StubDetector)
    assert sorted((r.start_us // S, r.end_us // S) for r in found.collect()) == [(0, 10), (20, 30)]
    regions = spans.timeline(found, ["video_id"], videos).join(videos.select("video_id", "path"), "video_id")
    rows = sorted((r.start_us // S, r.end_us // S, r.kind, r.text, tuple(r.events)) for r in providers.analysed(regions, providers.StubTranscriber, providers.StubTagger, 4 * S).collect())
    assert rows == [(0, 10, "speech", "words 0", ()), (10, 20, "non_speech", "", ("music",)), (20, 30, "speech", "words 20", ()), (30, 40, "non_speech", "", ("music",))]
    assert providers.analysed(regions, providers.StubTranscriber, None).where("kind <> 'speech'").count() == 0


def broken():
    raise OSError("no model here")


def test_a_missing_model_leaves_empty_answers(spark):
    rows = spark.createDataFrame([("v", "p", 0, 9 * S, "speech")], "video_id string, path string, start_us long, end_us long, kind string")
    row = providers.analysed(rows, broken, None).first()
    assert (row.text, row.language, row.events) == ("", "unknown", [])


@pytest.mark.parametrize("data,message", [({"speech": {"window_max_s": 0}}, "positive"), ({"labels": {"min_confidence": 2}}, "between"), ({"sampling": {"min_interval_s": 60}}, "exceed"), ({"speech": {"x": 1}}, "no setting"), ({"reading": {"singleton_confidence": 0.1}}, "exceed"), ({"agent": {"mode": "x"}}, "one of"), ({"agent": {"allowed_fps": []}}, "positive"), ({"montage": {"width": 1000}}, "divisible"), ({"reading": {"scan_width": 8}}, "at least 32"), ({"speech": {"merge_gap_s": -1}}, "negative"), ({"agent": {"temperature": 3}}, "temperature"), ({"sampling": {"hwaccel": "x"}}, "one of")])
def test_settings_are_checked(data, message):
    with pytest.raises(config.ConfigError, match=message):
        config.from_mapping(data)


def test_settings_of_a_language_and_fingerprints(tmp_path):
    (tmp_path / "c.yaml").write_text("reading:\n  languages:\n    ko: {same_text_ratio: 0.7}\n")
    found = config.load(str(tmp_path / "c.yaml"))
    assert found.reading.for_language("ko_KR").same_text_ratio == 0.7 and found.reading.for_language("en").same_text_ratio == 0.8
    assert found.fingerprint("speech") == config.Settings().fingerprint("speech") and found.fingerprint() != config.Settings().fingerprint()


def test_clocks(spark):
    ends = spark.createDataFrame([("v", 3 * S)], "video_id string, duration_us long")
    dense = clocks.frames(ends, 4)
    assert [r.at_us for r in clocks.every(dense, 4).orderBy("frame").collect()] == [0, S, 2 * S]
    assert clocks.on_clock(clocks.every(dense, 4), dense, ["video_id"]).count() == 3
    asked = spark.createDataFrame([(S, 2 * S)], "start_us long, end_us long")
    assert [r.at_us / S for r in clocks.interval(asked, 2).orderBy("at_us").collect()] == [1, 1.5, 2]
    chosen = spark.createDataFrame([("v", 0), ("v", 1), ("v", 5)], "video_id string, frame long")
    assert sorted(r.frame for r in clocks.beside(chosen, ["video_id"]).collect()) == [2, 4, 6]


def test_transcripts_come_before_captions(spark):
    segments = spark.createDataFrame([("v", 0, 0, 20 * S, "speech", "draft"), ("v", 1, 20 * S, 40 * S, "speech", "kept words here")], "k string, segment_id long, start_us long, end_us long, kind string, text string")
    accounts = spark.createDataFrame([("v", 0, "helo everyone out there")], "k string, segment_id long, text string")
    cues = spark.createDataFrame([("v", 0, 1 * S, "Hello everyone"), ("v", 1, 5 * S, "out there, friends")], "k string, ordinal long, start_us long, text string")
    shown = spark.createDataFrame([("v", 0, 0, 5 * S, "logo")], "k string, cue_id long, start_us long, end_us long, text string")
    language = lambda x: spark.createDataFrame([("v", x)], "k string, language string")
    spoken, read, told = overlay.apply(segments, shown, cues, ["k"], language("en"), accounts)
    assert {r.segment_id: r.fused for r in spoken.collect()} == {0: "Hello everyone out there, friends", 1: "kept words here"}
    assert read.first().fused == "logo"
    assert [(r.k, r.language_ok, r.cues, r.n_audio, r.verdict) for r in told.collect()] == [("v", True, 2, 2, "speech_transcript")]
    spoken, _, told = overlay.apply(segments, shown, cues, ["k"], language("ko"), accounts)
    assert {r.segment_id: r.fused for r in spoken.collect()} == {0: "helo everyone out there", 1: "kept words here"}
    assert [(r.language_ok, r.script_share, r.n_drop, r.verdict) for r in told.collect()] == [(False, 0.0, 2, "rejected_language")]
    # a track with a broken line corrects nothing
    bad = cues.unionByName(spark.createDataFrame([("v", 3, None, "x")], cues.schema))
    spoken, _, told = overlay.apply(segments, shown, bad, ["k"], language("en"))
    assert {r.fused for r in spoken.collect()} == {"draft", "kept words here"} and told.count() == 0


def test_lines_that_were_read_on_screen(spark):
    segments = spark.createDataFrame([("v", 0, 100 * S, 120 * S, "speech", "x")], "k string, segment_id long, start_us long, end_us long, kind string, text string")
    cues = spark.createDataFrame([("v", i, (i * 5) * S, f"Written sentence {i}") for i in range(4)] + [("v", 9, 30 * S, "hm")], "k string, ordinal long, start_us long, text string")
    shown = spark.createDataFrame([("v", i, (i * 5) * S, (i * 5 + 3) * S, f"written  sentence {i}") for i in range(4)], "k string, cue_id long, start_us long, end_us long, text string")
    rows = overlay.line_statistics(cues, segments, shown, ["k"], captions.Attribution())
    assert {r.ordinal: (r.tokens, r.tokens_in_speech, r.on_screen) for r in rows.collect()} == {i: (3, 0, True) for i in range(4)} | {9: (1, 0, None)}
    assert {r.decision for r in captions.route(rows, ["k"]).collect()} == {"text"}


def test_replay(spark, tmp_path, capsys):
    box = {"top": 0.9, "bottom": 0.95, "left": 0.3, "right": 0.7, "confidence": 0.99}
    (tmp_path / "o.jsonl").write_text("".join(json.dumps({"timestamp_s": t, "lines": [{"text": "Readable text", **box}]}) + "\n" for t in (0.0, 1.0)))
    assert main(["replay", str(tmp_path / "o.jsonl"), str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["command"] == "replay"
    assert [r.line for r in spark.read.json(str(tmp_path / "out")).collect()] == ["[0-2, bottom center, medium] Readable text"]
