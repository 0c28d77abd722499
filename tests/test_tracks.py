"""Text followed through scenes of our own, and the plans of what to read."""

import itertools

import numpy as np
import pytest

from spanloom.functions import text as X
from spanloom.operators import read_plans as P
from spanloom.operators import sheets as S
from spanloom.operators import tracks as T

LOOSE = T.Settings(fps=1, min_confidence=0.4, singleton=0.9, min_height=0)


def at(x, y, text, sure=0.8, wide=0.3, tall=0.06):
    return (text, sure, x, y, x + wide, y + tall, None)


def scene(*moments):
    """Frames one second apart; each is a list of readings."""
    return [T.Frame(float(i), S.sheet(list(m))) for i, m in enumerate(moments)]


def shown(frames, settings=LOOSE):
    return [(a, b, text) for a, b, text, _, _ in T.published(frames, float(len(frames)), settings)]


def test_a_sign_is_named_by_its_clearest_reading():
    blurred, clear = [at(0.1, 0.1, "Harbour Cafë", 0.7)], [at(0.1, 0.1, "Harbour Café", 0.93)]
    assert shown(scene(*[blurred] * 40, *[clear] * 3, *[blurred] * 5)) == [(0, 48, "Harbour Café")]


def test_a_score_that_stays_begins_where_it_was_first_seen():
    name, point = [at(0.6, 0.8, "Visitors", 0.95)], [at(0.6, 0.8, "Visitors 7", 0.91)]
    assert shown(scene(name, name, name, point, point, [])) == [(0, 3, "Visitors"), (3, 5, "Visitors 7")]
    # one doubtful glimpse of a digit is no score
    assert shown(scene(name, name, point, name, name, [])) == [(0, 5, "Visitors")]


@pytest.mark.parametrize("a,b", [("Platform 4", "Platform 9"), ("Mix 1.5 cups", "Mix 15 cups"), ("Level -3", "Level +3")])
def test_another_number_is_another_text(a, b):
    assert not X.same_text_of(a, b, 0.5)
    assert [t for _, _, t in shown(scene(*[[at(0.2, 0.4, a, 0.97)]] * 3, *[[at(0.2, 0.4, b, 0.97)]] * 3))] == [a, b]


def test_misread_letters_are_the_same_text():
    assert all(X.same_text_of("mountain railway", x, 0.8) for x in ("mountaln railway", "mountain.rallway", "mountain raiway"))
    assert shown(scene([at(0.2, 0.4, "mountain railway")], [at(0.2, 0.4, "mountaln railway")], [at(0.2, 0.4, "mountain rallway")])) == [(0, 3, "mountain railway")]


def test_out_of_sight_for_long_is_gone():
    sign = [at(0.3, 0.3, "Exit left")]
    assert shown(scene(sign, sign, [], [], sign, sign)) == [(0, 6, "Exit left")]
    assert [t for _, _, t in shown(scene(sign, sign, *[[]] * 9, sign, sign))] == ["Exit left", "Exit left"]


def test_seen_once_is_not_published():
    assert shown(scene([], [at(0.4, 0.4, "phantom")], [])) == []


def test_two_rows_make_a_paragraph_and_two_columns_do_not():
    rows = [at(0.1, 0.30, "Boil the water"), at(0.1, 0.37, "then add salt")]
    assert [t for _, _, t in shown(scene(rows, rows, rows))] == ["Boil the water / then add salt"]
    columns = [at(0.05, 0.30, "Boil the water"), at(0.65, 0.37, "then add salt")]
    assert sorted(t for _, _, t in shown(scene(columns, columns, columns))) == ["Boil the water", "then add salt"]


def test_fragments_of_a_row_are_joined_and_read_in_order():
    parts = [at(0.32, 0.502, "now", wide=0.08), at(0.1, 0.5, "Turn right", wide=0.2), at(0.1, 0.6, "below")]
    assert [w.text for w in S.assembled(S.sheet(parts), 0.4, 0.9).words] == ["Turn right now", "below"]
    slanted = S.sheet([at(0.5, 0.100, "second"), at(0.1, 0.112, "first"), at(0.1, 0.3, "third")])
    assert [slanted.words[i].text for i in S.in_reading_order(slanted)] == ["first", "second", "third"]


def test_owners_by_trying_every_moment():
    rng = np.random.default_rng(4)
    texts = ["river", "the river bank", "bank", "a bank"]
    for _ in range(30):
        n = 7
        starts = rng.integers(0, 12, n).astype(float)
        ends = starts + rng.integers(0, 8, n)
        s = S.sheet([at(0.1, float(rng.choice([0.1, 0.5])), texts[rng.integers(4)]) for _ in range(n)])
        found = {}
        for a, b, x in S.owners(starts, ends, s):
            for t in np.arange(a, b):
                found.setdefault(t, []).append((x.words[0].text, float(x.box[0, 1])))
        for t in range(20):
            claimed = []
            for i in sorted((i for i in range(n) if starts[i] <= t < ends[i]), key=lambda i: (-len(s.keys[i]), i)):
                if not any(s.keys[i] in s.keys[j] and s.box[i, 1] == s.box[j, 1] for j in claimed):
                    claimed.append(i)
            assert sorted(found.get(t, [])) == sorted((s.words[i].text, float(s.box[i, 1])) for i in claimed)


def test_a_stream_keeps_what_is_open_alone():
    frames = scene(*[[at(0.1, 0.1, "steady text")]] * 3, [at(0.1, 0.1, "steady text"), at(0.5, 0.5, "other words")], *[[at(0.1, 0.1, "steady text")]] * 6)
    whole = T.follow(frames, 10.0, LOOSE)
    want = sorted((t.since, end, whole.lines.words[t.best].text) for t, end in whole.closed)
    f, found = T.Follower(10.0, LOOSE), []
    for frame in frames:
        f.take(frame)
        found += [(t.since, end, f.lines.words[t.best].text) for t, end in f.closed]
        f.compacted()
        assert len(f.lines) == sum(len(t.places) for t in f.open)
    found += [(t.since, end, f.lines.words[t.best].text) for t, end in f.finish()]
    assert sorted(found) == want


def test_cues_of_keys_in_spark(spark):
    rows = [(k, 3_000_000, t * 1_000_000, text, 0.9, 0.70, 0.76, 0.1, 0.3, None, False, False) for k, text in (("a", "Mind the gap"), ("b", "Doors close")) for t in (0, 1, 2)]
    df = spark.createDataFrame(rows, "k string, duration_us long, at_us long, text string, confidence double, top double, bottom double, left double, right double, look string, verification boolean, discovery boolean")
    found = {(r.k, r.start_us, r.end_us, r.text, r.position, r.size) for r in T.track_cues(df, ["k"], settings=LOOSE).collect()}
    assert found == {("a", 0, 3_000_000, "Mind the gap", "bottom left", "medium"), ("b", 0, 3_000_000, "Doors close", "bottom left", "medium")}
    # a line that is seen once wants another look
    once = df.where("k = 'a' or at_us = 1000000")
    assert [(r.k, r.at_us, r.text) for r in T.verification_targets(once, ["k"], settings=LOOSE).collect()] == [("b", 1_000_000, "Doors close")]


# ---- plans


def plain_reads(times, signatures, required, refresh, check, threshold):
    out, read, checked, last = [], -1e9, -1e9, None
    nearest = {min(range(len(times)), key=lambda i: abs(times[i] - m)) for m in required}
    for i, t in enumerate(times):
        looks = t - checked >= check
        checked = t if looks else checked
        if i in nearest or t - read >= refresh or (looks and (last is None or np.mean(signatures[i] != last) >= threshold)):
            out.append(i)
            read, last = t, signatures[i]
    return out


def test_reads_equal_a_plain_fold():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        times = np.cumsum(rng.choice([0.25, 0.5, 1.5, 6.0], n))
        signatures = list(rng.integers(0, 2, (n, 6)))
        required = rng.uniform(0, 30, rng.integers(0, 3)).tolist()
        assert P.read_at(times, signatures, required, 4.0, 1.0, 0.5) == plain_reads(times, signatures, required, 4.0, 1.0, 0.5)
    assert P.read_at(np.empty(0), []) == []


def test_a_still_picture_is_read_at_the_refresh_alone():
    assert P.read_at(np.arange(50) / 5, [np.ones(4)] * 50, refresh_s=3.0) == [0, 15, 30, 45]


def test_looks_are_held_against_the_last_accepted():
    a, b = 0, (1 << 200) - 1
    times = np.array([0.0, 0.25, 0.5, 1.0, 1.6, 2.0])
    assert P.read_again(times, [a, a, b, b, a, b], np.array([True, False, False, False, False, False])) == [2, 4]
    assert P.read_again(times, [a, a, b, b, a, b], np.array([True, False, True, False, False, False])) == [4]
    assert P.read_again(np.empty(0), [], np.empty(0, bool)) == []


def test_crops_are_united_until_none_meet():
    boxes = np.array([(0.1, 0.1, 0.3, 0.2), (0.5, 0.5, 0.6, 0.6), (0.12, 0.1, 0.4, 0.2), (0.0, 0.0, 0.45, 0.3)])
    for order in itertools.permutations(range(4)):
        crops, of = P.crops_of(boxes[list(order)])
        assert crops.tolist() == [[0.0, 0.0, 0.45, 0.3], [0.5, 0.5, 0.6, 0.6]]
        assert [int(of[order.index(i)]) for i in range(4)] == [0, 1, 0, 0]
    apart = P.crops_of(np.array([(0.1, 0.1, 0.3, 0.2), (0.1, 0.19, 0.3, 0.29)]))[0]
    assert len(apart) == 2 and len(P.crops_of(np.empty((0, 4)))[0]) == 0


LINES = "k string, at_us long, text string, confidence double, left double, top double, right double, bottom double"


def test_slots_that_change(spark):
    rows = [("a", 0, "Round one", 0.97, 0.3, 0.9, 0.7, 0.95), ("a", 1_000_000, "ROUND ONE", 0.97, 0.3, 0.9, 0.7, 0.95), ("a", 2_000_000, "Final", 0.6, 0.32, 0.9, 0.7, 0.95)]
    rows += [("a", 2_000_000, "far off", 0.97, 0.3, 0.1, 0.7, 0.15), ("b", 2_500_000, "Final", 0.97, 0.3, 0.9, 0.7, 0.95), ("a", 9_000_000, "Late", 0.97, 0.3, 0.9, 0.7, 0.95)]
    lines = spark.createDataFrame(rows, LINES)
    found = P.changing_slots(lines, ["k"])
    assert [(r.from_us, r.to_us, r.earlier.text, r.later.text) for r in found.collect()] == [(1_000_000, 2_000_000, "ROUND ONE", "Final")]
    inside = P.in_changing_slots(lines, found, ["k"]).collect()
    assert sorted((r.at_us, r.text) for r in inside) == [(1_000_000, "ROUND ONE"), (2_000_000, "Final")]


def test_lines_of_a_crop_are_placed_in_the_frame(spark):
    rows = [("kept", 0.1, 0.4, 0.9, 0.6), ("cut off", 0.0, 0.4, 0.9, 0.6), ("at the frame's edge", 0.1, 0.4, 1.0, 0.6)]
    crop = "struct(0.5D as left, 0.5D as top, 1.0D as right, 0.7D as bottom)"
    df = spark.createDataFrame(rows, "text string, left double, top double, right double, bottom double").selectExpr("*", f"{crop} as crop", "1000 as width", "500 as height", "cast(null as double) as text_height")
    found = {r.text: r for r in P.lifted(df).collect()}
    assert set(found) == {"kept", "at the frame's edge"}
    assert [round(found["kept"][s], 6) for s in (*P.BOX, "text_height")] == [0.55, 0.58, 0.95, 0.62, 0.04]


class Wall:
    """A reader of frames whose path is the text that they show; the slot's text changes with it."""

    asked = []

    def read(self, path, box):
        if path == "dark":
            return []
        line = {"text": path, "confidence": 0.97, "left": 0.3, "top": 0.8, "right": 0.7, "bottom": 0.86, "text_height": 0.06, "look": None}
        if box is not None:
            left, top, right, bottom = box
            wide, tall = right - left, bottom - top
            line |= {"left": (0.3 - left) / wide, "right": (0.7 - left) / wide, "top": (0.8 - top) / tall, "bottom": (0.86 - top) / tall, "text_height": 0.06 / tall}
        return [line]

    def fingerprint(self, path, box):
        return f"{(1 << 256) - 1 if path == 'Between them' else len(path):064x}"


def test_three_stages_of_reading(spark):
    from spanloom.plans.scan import scan_text

    # a text that is shown between two base frames is found in the slot that changed
    shows = ["First words"] * 8 + ["Between them"] * 4 + ["Second text"] * 12
    rows = [("v", i * 250_000, shows[i], 1000, 1000, [0 if i < 12 else 1], i == 0, 6_000_000) for i in range(24)]
    frames = spark.createDataFrame(rows, "k string, at_us long, path string, width int, height int, signature array<int>, required boolean, duration_us long")
    seen = scan_text(frames, Wall, ["k"], refresh_s=100.0).collect()
    base = [(r.at_us, r.text) for r in seen if not r.discovery and not r.verification]
    assert base == [(0, "First words"), (3_000_000, "Second text")]
    found = {(r.at_us, r.text) for r in seen if r.discovery}
    assert (2_000_000, "Between them") in found and all(0.79 < r.top < 0.81 for r in seen)
    probes = [r for r in seen if r.verification]
    doubtful = [at for at, _ in [*base, *found]]
    assert probes and all(min(abs(r.at_us - t) for t in doubtful) <= 501_000 and r.at_us not in (0, 3_000_000) for r in probes)


def test_keys_are_dealt_to_all_cores(spark):
    """A key costs time and few bytes, by which its rows would all be put into one task."""
    from pyspark.sql import functions as F

    rows = spark.range(60).select((F.col("id") % 30).alias("k"), F.lit(10_000_000).cast("long").alias("duration_us"), F.when(F.col("id") >= 30, 1_000_000).otherwise(0).cast("long").alias("at_us"), F.lit("open daily").alias("text"), F.lit(0.99).alias("confidence"), F.lit(0.4).alias("top"), F.lit(0.5).alias("bottom"), F.lit(0.1).alias("left"), F.lit(0.9).alias("right"), F.lit(None).cast("string").alias("look"), F.lit(False).alias("verification"), F.lit(False).alias("discovery"))
    found = T.track_cues(rows, ["k"])
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert found.count() == found.where("text = 'open daily' and start_us = 0").count() == 30


def test_bounds_of_likeness_need_no_matcher(monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(X.difflib, "SequenceMatcher", never)
    assert not X.reaches("a" * 500, "b" * 500, 0.8) and not X.reaches("a" * 9, "a" * 90, 0.8)


def test_parts_among_many_texts_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcde"), n)) for n in rng.integers(3, 9, 300)]
    box = lambda t: (t, 0.99, 0.1, 0.4, 0.1 + 0.02 * len(t), 0.4 + 0.01 * (1 + len(t) % 7), None)
    readings = S.sheet([box(t) for t in texts])
    runs = S.sheet([box("".join(rng.choice(texts, 3))) for _ in range(40)])
    found = T.heights(runs, readings)
    for i, key in enumerate(runs.keys):
        parts = [j for j, k in enumerate(readings.keys) if k != key and k in key and readings.box[j, 0] >= runs.box[i, 0] - 0.05 and readings.box[j, 2] <= runs.box[i, 2] + 0.05]
        if parts and key not in readings.keys:
            assert found[i] == np.median(readings.height[parts])
