"""Literal cases of text forms, captions, labels, parsers and rendering."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import geometry as G
from spanloom.functions import images as I
from spanloom.functions import text as X
from spanloom.functions import time as T
from spanloom.operators import captions, joins, render, tags, transcripts
from spanloom.sources import files, rich

S = 1_000_000


def value(spark, column, **cells):
    """A column's value over one row of the given cells."""
    names = list(cells) or ["none"]
    return spark.createDataFrame([tuple(cells.values()) or (1,)], names).select(column.alias("v")).first().v


@pytest.mark.parametrize("text,key", [("가 나-é_1!", "가나é_1"), ("Open, Culture", "openculture"), ("", "")])
def test_text_key(spark, text, key):
    assert value(spark, X.text_key(F.col("t")), t=text) == key == X.key_of(text)


@pytest.mark.parametrize("text,line", [("(birds chirp) - hello", "hello"), ("- hello [music] there", "hello there"), ("【音楽】こんにちは", "こんにちは")])
def test_conventions(spark, text, line):
    assert value(spark, X.strip_conventions(F.col("t")), t=text) == line


def test_tokens_by_script(spark):
    assert value(spark, X.tokens(F.col("t")), t="it's 안녕하세요 日本 go") == ["it's", "안녕하세요", "日", "本", "go"]


@pytest.mark.parametrize("text,language,share", [("안녕하세요 여러분", "ko", 1.0), ("Hello everyone", "ko-KR", 0.0), ("Hello", "en", None), ("", "ja", 0.0)])
def test_script_share(spark, text, language, share):
    assert value(spark, X.script_share(F.col("t"), F.col("l")), t=text, l=language) == share


def test_ratio_keeps_the_order_of_its_arguments():
    assert (X.ratio_of("tide", "diet", True), X.ratio_of("diet", "tide", True)) == (0.25, 0.5)


def test_clean_text_knows_entities(spark):
    assert value(spark, X.clean_text(F.col("t")), t="a&nbsp;&eacute; <b>x</b>\ny &#233;&#xE9; &amp;lt; &lt;i> &nosuch; R&D") == "a é x y éé &lt; &nosuch; R&D"
    assert value(spark, X.clean_text(F.col("t")), t="a&nbsp;&amp; <b>x</b>\ny") == "a & x y"


@pytest.mark.parametrize("candidate,reference,adds", [("10 of 20", "10 20 30", False), ("20 10", "10 20", True), ("none", "5", False), ("7", "none", True)])
def test_numbers_may_go_but_not_come(spark, candidate, reference, adds):
    assert value(spark, X.adds_numbers(F.col("a"), F.col("b")), a=candidate, b=reference) is adds


def test_digit_at_an_edge(spark):
    pairs = [("Episode", "Episode 2", True), ("Episode", "3 Episode", True), ("Episode", "Episodes", False), ("Ep", "Ep2", False), ("Part 1", "Part 12", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.select("want", X.extends_by_digit(F.col("a"), F.col("b")).alias("got")).collect())


LABELS = [
    ([("Music", 0.834), ("Animal", 0.316), ("Snake", 0.247), ("Squish", 0.221)], ["music"]),
    ([("Biting", 0.549), ("Crunch", 0.389), ("Chewing, mastication", 0.254), ("Inside, small room", 0.131)], ["biting", "crunch", "chewing"]),
    ([("Applause", 0.05), ("Laughter", None)], ["laughter"]),
    ([("Speech", 0.9), ("Music", 0.3)], []),
    ([("Water tap, faucet", 0.5), ("Sink (filling or washing)", 0.5), ("Chopping (food)", 0.5)], ["running_water", "chopping"]),
    ([("BGM", 0.1), ("Music", 0.5)], ["music"]),
]


@pytest.mark.parametrize("scored,names", LABELS)
def test_labels_clear_two_bars(spark, scored, names):
    df = spark.createDataFrame([(scored,)], "t array<struct<label:string,confidence:double>>")
    assert df.select(tags.kept(F.col("t")).alias("v")).first().v == names


def test_json3(spark):
    payload = json.dumps({"events": [{"tStartMs": 3920, "segs": [{"utf8": "hello"}, {"utf8": "everyone", "tOffsetMs": 400}]}, {"tStartMs": 4000, "segs": [{"utf8": "\n"}]}, {"tStartMs": 5200, "segs": [{"utf8": "today"}, {"utf8": "we", "tOffsetMs": 400}, {"utf8": "talk", "tOffsetMs": 800}]}]})
    cues = value(spark, files.parse_json3(F.col("p")), p=payload)
    assert [(c.start_us / S, c.text) for c in cues][:2] == [(3.92, "hello"), (4.32, "everyone")] and len(cues) == 5
    assert value(spark, files.json3_word_timed(F.col("p")), p=payload) is True
    assert value(spark, files.parse_json3(F.col("p")), p="{}") == []


def test_vtt(spark):
    payload = "WEBVTT\nKind: captions\n\n00:00:01.500 --> 00:00:03.000\nfirst line\n\n00:00:04.000 --> 00:00:05.000 align:start\nsecond <c>line</c>\n\nNOTE x"
    assert [(c.start_us / S, c.text) for c in value(spark, files.parse_vtt(F.col("p")), p=payload)] == [(1.5, "first line"), (4.0, "second line")]


def test_rich_line(spark):
    found = value(spark, rich.decoded(F.col("p")), p="<|en|><|NEUTRAL|><|BGM|>Hello")
    assert (found.language, found.emotion, found.events, found.text) == ("en", "neutral", ["BGM"], "Hello")


def lines(spark, rows):
    return spark.createDataFrame([("v", i, int(t * S), x) for i, (t, x) in enumerate(rows)], "k string, ordinal long, start_us long, text string")


def test_caption_ends(spark):
    found = captions.with_ends(lines(spark, [(1.0, "a"), (1.1, "b"), (5.0, "x" * 50)]), ["k"]).orderBy("ordinal").collect()
    assert [r.end_us / S for r in found] == [1.2, 5.0, 8.0]


def test_narration_then_silence(spark):
    rows = [("v", i, int(t * S), "t", 3, 3, False) for i, t in enumerate(range(5, 60, 5))] + [("v", 11 + i, int(t * S), "t", 3, 0, True) for i, t in enumerate(range(200, 260, 5))]
    df = spark.createDataFrame(rows, "k string, ordinal long, start_us long, text string, tokens long, tokens_in_speech long, on_screen boolean")
    for seconds in (10, 30, 60):
        found = captions.route(df, ["k"], captions.Attribution(neighbourhood_us=seconds * S)).orderBy("ordinal").collect()
        assert [r.decision for r in found] == ["audio"] * 11 + ["text"] * 12


def segments(spark, rows):
    return spark.createDataFrame([("v", i, int(a * S), int(b * S), kind, text) for i, (a, b, kind, text) in enumerate(rows)], "k string, segment_id long, start_us long, end_us long, kind string, text string")


def test_captions_correct_what_was_heard(spark):
    heard = segments(spark, [(0, 10, "speech", "helo everyone today"), (10, 20, "non_speech", ""), (20, 30, "speech", "completely different words"), (30, 40, "speech", "")])
    cues = lines(spark, [(1, "Hello everyone,"), (4, "(music) today!"), (12, "nowhere"), (21, "그런데 말입니다"), (31, "spoken here")])
    found = {r.segment_id: (r.fused, r.outcome) for r in captions.fuse_audio(heard, cues, ["k"]).collect()}
    assert found == {0: ("Hello everyone, today!", "rewritten"), 1: ("", None), 2: ("completely different words", "guarded"), 3: ("spoken here", "recovered")}


def test_captions_correct_what_was_read(spark):
    rows = [("v", 0, 0, 2 * S, "open cuiture"), ("v", 1, 0, 2 * S, "pyrex"), ("v", 2, 50 * S, 52 * S, "open cuiture"), ("v", 3, 0, 2 * S, "Open-Culture")]
    cues = spark.createDataFrame(rows, "k string, cue_id long, start_us long, end_us long, text string")
    track = captions.with_ends(lines(spark, [(1, "open culture"), (3, "z" * 40)]), ["k"])
    found = {r.cue_id: (r.fused, r.outcome) for r in captions.fuse_text(cues, track, ["k"]).collect()}
    assert found == {0: ("open culture", "corrected"), 1: ("pyrex", None), 2: ("open cuiture", None), 3: ("open culture", "cosmetic")}


def test_whole_call_of_the_best_account(spark):
    rows = [("r", 0.3, "2024-01-02", "late part"), ("r", 1.0, "2024-01-01", "first half"), ("r", 1.0, "2024-01-01", "second half")]
    df = spark.createDataFrame(rows, "region string, coverage double, recorded_at string, text string")
    assert {r.text for r in transcripts.best_account(df, ["region"], "coverage", "recorded_at").collect()} == {"first half", "second half"}


def test_lines_of_an_index(spark):
    rows = [("v", 0, 4 * S, "en", [], "hello"), ("v", 4 * S, 9 * S, "unknown", ["music"], ""), ("v", 9 * S, 10 * S, "unknown", [], "")]
    df = spark.createDataFrame(rows, "k string, start_us long, end_us long, language string, events array<string>, text string")
    assert [r.line for r in render.audio_lines(df, ["k"]).orderBy("ordinal").collect()] == ["[0-4] <en> hello", "[4-9] <music>"]


def test_recurring_text_is_one_line(spark):
    rows = [("v", 0, 2 * S, "Readable text"), ("v", 2 * S, 3 * S, "Readable / text"), ("v", 9 * S, 9 * S + 1, "readable text")]
    df = spark.createDataFrame([(*r, "bottom center", "medium") for r in rows], "k string, start_us long, end_us long, text string, position string, size string")
    assert [r.line for r in render.text_lines(df, ["k"]).collect()] == ["[0-3; 9-10, bottom center, medium] Readable text"]


def test_nearest_prefers_the_earlier(spark):
    moments = spark.createDataFrame([("a", 1, 10), ("a", 2, 15), ("a", 3, 100), ("b", 4, 1)], "k string, id long, at long")
    grid = spark.createDataFrame([("a", 10), ("a", 20)], "k string, g long")
    assert {r.id: r.nearest_us for r in joins.nearest(moments, grid, ["k"], "at", "id", "g").collect()} == {1: 10, 2: 10, 3: 20}


def test_pairs_that_span_buckets_count_once(spark):
    a = spark.createDataFrame([("a", 0, 100)], "k string, start_us long, end_us long")
    b = spark.createDataFrame([("a", 5, 95), ("a", 100, 120)], "k string, r_start_us long, r_end_us long")
    assert joins.overlapping(a, b, ["k"], 7).count() == 1


def test_bits_and_boxes(spark):
    grid = [float(i) for i in range(64)]
    words = value(spark, I.words(I.mean_bits(F.col("c"))), c=grid)
    assert words == [(1 << 32) - 1]
    assert value(spark, I.hamming(F.col("a"), F.col("b")), a=[-1, 0], b=[0, 0]) == 64
    cells = {"left": 0.3, "top": 0.9, "right": 0.7, "bottom": 0.95}
    assert value(spark, G.position(G.box("")), **cells) == "bottom center"
    assert value(spark, T.clock(F.col("t")), t=61_900_000) == "01:01"
