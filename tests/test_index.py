"""Files to a stored index and a report, with stubs; hints, rich transcripts, tools and measures by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.__main__ import main
from spanloom.functions import images
from spanloom.operators import hints
from spanloom.plans import agent, tools
from spanloom.plans import index as I
from spanloom.sources import config, files, index, providers, rich

S = 1_000_000


class Client:
    """A model that looks once and reports."""

    def __init__(self, *answers):
        self.answers = list(answers) or [{"role": "assistant", "content": '{"title": "T", "sections": [{"title": "a", "start_s": 0, "end_s": 9, "citations": [{"claim": "c", "timestamp_s": 4}]}]}'}]

    def complete(self, messages, given):
        self.last = messages
        return {"message": self.answers.pop(0), "usage": {"prompt_tokens": 10, "completion_tokens": 5}}


class Wall:
    def read(self, path, box):
        return [{"text": path, "confidence": 0.99, "left": 0.3, "top": 0.8, "right": 0.7, "bottom": 0.86, "text_height": 0.06, "look": None}] if box is None else []

    def fingerprint(self, path, box):
        return f"{len(path):064x}"


def test_videos_are_indexed_once(spark, tmp_path):
    videos = spark.createDataFrame([("v", "p", 40 * S), ("w", "q", 5 * S)], "video_id string, path string, duration_us long")
    frames = spark.createDataFrame([("v", i * S, "Mind the gap", 1000, 1000, [i // 3], False, 40 * S) for i in range(6)], "video_id string, at_us long, path string, width int, height int, signature array<int>, required boolean, duration_us long")
    given = I.Providers(providers.StubDetector, providers.StubTranscriber, providers.StubTagger, Wall)
    path, settings = str(tmp_path / "index"), config.Settings(reading=config.Reading(fps=1.0))
    assert sorted(r.video_id for r in I.build(videos, path, given, settings, frames).collect()) == ["v", "w"]
    segments, cues = index.read(spark, path)
    assert segments.where("video_id = 'v' and kind = 'speech'").count() == 2 and [r.text for r in cues.collect()] == ["Mind the gap"]
    assert [r.value for r in spark.read.text(f"{path}/text_index/video_id=v").collect()] == ["[0-6, bottom center, medium] Mind the gap"] or cues.first().start_us == 0
    assert [r.value for r in spark.read.text(f"{path}/text_index/video_id=w").collect()] == [""]
    assert files.observations(spark, f"{path}/observations/*/*.json").where("text = 'Mind the gap'").count() >= 2
    # nothing is left to do with the same settings; other settings, or force, build anew
    assert I.build(videos, path, given, settings, frames).count() == 0
    assert I.build(videos.where("video_id = 'w'"), path, given, settings, None, force=True).count() == 1
    other = config.Settings(speech=config.Speech(merge_gap_s=0.1))
    assert I.build(videos.where("video_id = 'w'"), path, given, other).count() == 1


def test_a_stamp_that_cannot_be_read_stamps_nothing(spark, tmp_path):
    assert index.stored(spark, str(tmp_path / "none"), "f").count() == 0
    (tmp_path / "i" / "stamps").mkdir(parents=True)
    (tmp_path / "i" / "stamps" / "a.json").write_text('{"video_id": "v", "fingerprint": "f"}\n{broken\n{"video_id": "w", "fingerprint": "g"}\n')
    assert [r.video_id for r in index.stored(spark, str(tmp_path / "i"), "f").collect()] == ["v"]


def test_providers_that_are_missing_leave_their_part_empty(spark, tmp_path):
    videos = spark.createDataFrame([("v", "p", 40 * S)], "video_id string, path string, duration_us long")
    I.build(videos, str(tmp_path / "i"), I.Providers(providers.StubDetector), config.Settings())
    segments, cues = index.read(spark, str(tmp_path / "i"))
    assert {(r.kind, r.text) for r in segments.collect()} == {("speech", "")} and cues.count() == 0


def broken():
    raise MemoryError


def test_only_what_a_provider_can_fail_at_is_an_answer(spark):
    rows = spark.createDataFrame([("p",), ("qq",)], "path string")
    assert sorted((r.path, r.duration_us) for r in providers.probed(rows, providers.StubProber).collect()) == [("p", S), ("qq", 2 * S)]
    assert {r.audio_path for r in providers.demuxed(rows, providers.StubDemuxer).collect()} == {"p.wav", "qq.wav"}
    told = providers.failures(providers.answered(rows, lambda: None, lambda p, r: p.x, "a", "struct<x:int>")).first()
    assert (told["rows"], told.failed) == (2, 2) and "NoneType" in told.first_error
    with pytest.raises(Exception, match="MemoryError"):
        providers.answered(rows, broken, lambda p, r: {}, "a", "struct<x:int>").collect()


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.mp4").write_bytes(b"abc")
    assert main(["index", str(tmp_path / "a.mp4"), str(tmp_path / "i"), "--detector", "spanloom.sources.providers:StubDetector", "--transcriber", "spanloom.sources.providers:StubTranscriber"]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (told["videos"], told["built"]) == (1, 1)
    video = index.read(spark, str(tmp_path / "i"))[0].first().video_id
    assert main(["run", str(tmp_path / "i"), str(tmp_path / "r"), "--video", video, "--client", "tests.test_index:Client", "--question", "What is it?"]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["title"] == "T" and told["tokens"] == {"prompt_tokens": 10, "completion_tokens": 5}
    assert "What is it?" in (tmp_path / "r" / "prompt.txt").read_text() and json.loads((tmp_path / "r" / "report.json").read_text())["title"] == "T"
    assert (tmp_path / "r" / "report.md").read_text().startswith("# T") and len((tmp_path / "r" / "trace.jsonl").read_text().splitlines()) == 1


class Frames:
    def montages(self, moments, n, cell):
        return [f"{len(moments)}@{n}:{cell[0]}x{cell[1]}"]


class Account:
    def transcribe(self, start_s, end_s, language, prompt):
        return [{"start_s": start_s, "end_s": end_s, "text": f"{language} {prompt}".strip(), "events": ["music"]}]


def test_tools_check_what_they_are_asked():
    settings = config.Settings()
    given = tools.Views(Frames(), Account(), "ko", lambda a, b: "hint")
    at_hand = agent.Tools(tools.functions(given, settings), 100)
    assert at_hand.run("view_frames", {"start_s": 0, "end_s": 10, "fps": 1.0, "n": 2})["montages"] == ["10@2:576x576"]
    assert "fps" in at_hand.run("view_frames", {"start_s": 0, "end_s": 10, "fps": 3.0, "n": 2})["error"]
    assert "n must" in at_hand.run("view_frames", {"start_s": 0, "end_s": 10, "fps": 1.0, "n": 7})["error"]
    assert "montages" in at_hand.run("view_frames", {"start_s": 0, "end_s": 60, "fps": 2.0, "n": 1})["error"]
    assert at_hand.run("transcribe_segment", {"start_s": 3.5, "end_s": 9})["transcript"] == "[3-9] <music> ko hint"
    assert "to be had" in agent.Tools(tools.functions(tools.Views(), settings), 100).run("transcribe_segment", {"start_s": 0, "end_s": 9})["error"]
    assert {s["function"]["name"] for s in tools.SCHEMAS} == {"view_frames", "transcribe_segment"}


def test_tools_remember_over_runs(tmp_path):
    asked = []
    make = lambda: agent.Tools({"look": lambda start_s, end_s: asked.append(1) or {"seen": end_s}}, 100, folder=str(tmp_path))
    assert make().run("look", {"start_s": 0, "end_s": 9}) == {"seen": 9}
    assert make().run("look", {"end_s": 9, "start_s": 0}) == {"seen": 9, "cache_hit": True} and len(asked) == 1
    next(tmp_path.glob("*.json")).write_text("{broken")
    assert make().run("look", {"start_s": 0, "end_s": 9}) == {"seen": 9} and len(asked) == 2


def test_the_language_of_a_stretch():
    heard = [{"start_s": 0, "end_s": 10, "language": "en"}, {"start_s": 10, "end_s": 40, "language": "ko"}, {"start_s": 40, "end_s": 60, "language": "unknown"}]
    assert [tools.language_of(heard, a, b, "ja") for a, b in ((0, 12), (5, 30), (45, 50), (90, 99))] == ["en", "ko", "ja", "ja"]


def test_baselines(tmp_path):
    given, settings = tools.Views(Frames(), Account()), config.Settings()
    client = Client()
    I.report(client, "audio", "text", 90.0, settings, given, "q", str(tmp_path / "full"), "baseline_full")
    asked = client.last[1]["content"]
    assert "Frames: 18@3" in asked and "[60-90] <music>" in asked
    client = Client()
    out = I.report(client, "audio", "text", 90.0, settings, given, "q", str(tmp_path / "only"), "baseline_index_only", hints="Title: x")
    assert client.last[1]["content"] == "Title: x\n\nAudio index:\naudio\n\nText index:\ntext\n\nq" and out.tool_calls == 0
    assert out.report["sections"][0]["citations"] == [{"claim": "c", "start_s": 4, "end_s": 4}]
    with pytest.raises(ValueError, match="mode"):
        I.report(client, "", "", 1.0, settings, given, "", str(tmp_path), "other")


def test_rich_transcripts(spark):
    flat = "<|en|><|HAPPY|><|BGM|><|Applause|>Hello there"
    cut = {"text": "noise <|ko|><|NEUTRAL|>one <|zh|><|Laughter|>two", "sentence_info": [{"start": 0, "end": 1500.4, "text": "x"}, {"start": 2000, "end": 2500, "text": "y"}, {"start": 3000, "end": 3500, "text": "z"}]}
    rows = [("a", json.dumps({"text": flat}), 9 * S), ("b", json.dumps([cut]), 9 * S), ("c", "{no json", 9 * S), ("d", json.dumps([{"raw_text": "", "text": "plain"}]), S), ("e", None, S)]
    found = rich.segments(spark.createDataFrame(rows, "k string, payload string, duration_us long")).orderBy("k", "ordinal").collect()
    assert [(r.k, r.start_us, r.end_us, r.text, r.language, r.emotion, r.events) for r in found] == [
        ("a", 0, 9 * S, "Hello there", "en", "happy", ["BGM", "Applause"]),
        ("b", 0, 1_500_400, "one", "ko", "neutral", []),
        ("b", 2 * S, 2_500_000, "two", "zh", None, ["Laughter"]),
        ("b", 3 * S, 3_500_000, "z", "unknown", None, []),
        ("d", 0, S, "plain", "unknown", None, []),
    ]


def test_hints_are_told_in_short(spark):
    df = spark.createDataFrame([("T", "C", ["one", "", "two"]), ("", None, []), (None, "C", None)], "title string, channel string, chapters array<string>")
    assert [r[0] for r in df.select(hints.reading_prompt(F.col("title"), F.col("channel"), F.col("chapters"))).collect()] == ["C - T - one, two", "", "C"]
    df = spark.createDataFrame([("T", None, [(0, 9_500_000, "a")]), ("", "", [])], "title string, channel string, chapters array<struct<start_us:long,end_us:long,title:string>>")
    assert [r[0] for r in df.select(hints.prompt_block(F.col("title"), F.col("channel"), F.col("chapters"))).collect()] == ["Video metadata (as the channel gives it):\nTitle: T\nChapters:\n[0-9] a", ""]


def test_formats_of_tracks(spark):
    vtt = "WEBVTT\n\n00:00:01.500 --> 00:00:02.000\nfirst &eacute;t&eacute; line\n"
    df = spark.createDataFrame([(vtt, "vtt"), ('{"events": [{"tStartMs": 1000, "segs": [{"utf8": "hello"}, {"utf8": "you", "tOffsetMs": 400}]}]}', "json3")], "p string, f string")
    found = df.select(files.parse_track(F.col("p"), F.col("f")).alias("t")).collect()
    assert [(len(r.t.cues), r.t.word_timed, r.t.cues[0].start_us) for r in found] == [(1, False, 1_500_000), (2, True, S)]
    assert found[0].t.cues[0].text == "first été line"


def test_manifests_and_traces(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("videos:\n  - {id: a, file: a.mp4, language: ko}\n  - {id: b, file: b.mp4}\n")
    assert [(r.id, r.path, r.language) for r in index.manifest(spark, str(tmp_path / "m.yaml"), "/v").orderBy("id").collect()] == [("a", "/v/a.mp4", "ko"), ("b", "/v/b.mp4", None)]
    index.append_json(str(tmp_path / "t" / "x.jsonl"), [{"a": 1}])
    index.append_json(str(tmp_path / "t" / "x.jsonl"), [{"a": 2}, {"a": 3}])
    assert [json.loads(x)["a"] for x in (tmp_path / "t" / "x.jsonl").read_text().splitlines()] == [1, 2, 3]
    index.write_json(str(tmp_path / "r.json"), {"x": 1})
    assert json.loads((tmp_path / "r.json").read_text()) == {"x": 1} and len(list(tmp_path.glob("tmp*"))) == 0


def test_pictures():
    rising = np.tile(np.arange(64), (16, 1))
    assert images.fingerprint(rising, (0, 0, 64, 16)) == "f" * 64 and images.fingerprint(rising[:, ::-1], (0, 0, 64, 16)) == "0" * 64
    assert images.fingerprint(rising, (5, 5, 5, 9)) == "" and images.shrunk(np.full((9, 9), 7.0), 3, 3).tolist() == [[7.0] * 3] * 3
    assert images.montage_cell(1152, 900, 3) == (384, 300)
    with pytest.raises(ValueError, match="cut"):
        images.montage_cell(1000, 900, 3)
