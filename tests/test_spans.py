"""Literal cases and properties of the span algebra."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import sampling, spans

S = 1_000_000


def frame(spark, rows):
    return spark.createDataFrame([("a", int(s * S), int(e * S)) for s, e in rows], "k string, start_us long, end_us long")


def ends(spark, seconds):
    return spark.createDataFrame([("a", int(seconds * S))], "k string, duration_us long")


def got(df):
    return sorted((r.start_us / S, r.end_us / S) for r in df.collect())


def test_union_over_a_gap(spark):
    assert got(spans.union(frame(spark, [(0, 5), (6, 10), (20, 25)]), ["k"], S)) == [(0, 10), (20, 25)]


def test_union_keeps_a_span_inside_another(spark):
    assert got(spans.union(frame(spark, [(0, 10), (2, 3), (9, 12)]), ["k"])) == [(0, 12)]


def test_complement_of_nothing_is_everything(spark):
    assert got(spans.complement(frame(spark, []), ["k"], ends(spark, 7))) == [(0, 7)]


def test_split_in_equal_parts(spark):
    parts = got(spans.split_long(frame(spark, [(0, 70)]), 30 * S))
    assert len(parts) == 3 and parts[-1][1] == 70 and all(b - a <= 30 for a, b in parts)


def test_split_needs_a_length(spark):
    with pytest.raises(ValueError):
        spans.split_long(frame(spark, [(0, 1)]), 0)


def test_detections_widen_to_whole_seconds(spark):
    assert got(spans.speech_view(frame(spark, [(4.4, 9.1), (20.9, 24.2)]), ["k"], ends(spark, 60))) == [(4, 10), (20, 25)]


def test_breath_is_bridged_and_pause_is_not(spark):
    assert got(spans.speech_view(frame(spark, [(0, 12), (13.2, 25)]), ["k"], ends(spark, 60))) == [(0, 25)]
    assert got(spans.speech_view(frame(spark, [(0, 12), (20, 25)]), ["k"], ends(spark, 60))) == [(0, 12), (20, 25)]


def test_timeline_of_two_regions(spark):
    rows = spans.timeline(frame(spark, [(2.4, 9.6), (20, 29)]), ["k"], ends(spark, 40)).orderBy("start_us").collect()
    assert [r.kind[0] for r in rows] == ["n", "s", "n", "s", "n"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(1, 20)), max_size=8))
def test_timeline_is_a_partition(spark, pairs):
    rows = [(a, min(a + n, 100)) for a, n in pairs]
    found = got(spans.timeline(frame(spark, rows), ["k"], ends(spark, 100)).drop("kind"))
    assert found[0][0] == 0 and found[-1][1] == 100
    assert all(a[1] == b[0] for a, b in zip(found, found[1:]))


def test_timeline_sorts_its_rows_once(spark):
    """Sorts and sums of one task stand side by side in its memory."""
    plan = spans.timeline(frame(spark, [(2, 9)]), ["k"], ends(spark, 40))._jdf.queryExecution().sparkPlan().toString()
    executed = spans.timeline(frame(spark, [(2, 9)]), ["k"], ends(spark, 40))._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Sort [") == 1 and executed.count("Exchange ") == 1
    assert "Aggregate" not in plan and "Join" not in plan


def test_timeline_of_keys_without_rows_or_duration(spark):
    rows = spark.createDataFrame([("a", 10 * S, 20 * S), ("b", 30 * S, 30 * S), ("c", 1, 9), (None, 1, 9 * S)], "k string, start_us long, end_us long")
    told = spark.createDataFrame([("a", 50 * S), ("b", 25 * S), (None, 20 * S), ("d", 0)], "k string, duration_us long")
    found = {tuple(r) for r in spans.timeline(rows, ["k"], told).select("k", "kind", "start_us", "end_us").collect()}
    assert found == {("a", "non_speech", 0, 10 * S), ("a", "speech", 10 * S, 20 * S), ("a", "non_speech", 20 * S, 50 * S), ("b", "non_speech", 0, 25 * S), (None, "non_speech", 0, 20 * S)}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=8))
def test_union_is_idempotent_and_complements_twice(spark, pairs):
    df = frame(spark, [(a, a + n) for a, n in pairs])
    once = spans.union(df, ["k"])
    assert got(spans.union(once, ["k"])) == got(once)
    twice = spans.complement(spans.complement(df, ["k"], ends(spark, 60)), ["k"], ends(spark, 60))
    assert got(twice) == got(once)


def test_windows_that_agree_become_one(spark):
    rows = [("a", 0, 1, ["x", "y"]), ("a", 1, 2, ["y", "x"]), ("a", 2, 3, []), ("a", 3, 4, [])]
    df = spark.createDataFrame(rows, "k string, start_us long, end_us long, tags array<string>")
    found = sorted((r.start_us, r.end_us, r.tags) for r in spans.merge_runs(df, ["k"], "tags").collect())
    assert found == [(0, 2, ["x", "y"]), (2, 4, [])]


def moments(spark, cuts, end, **more):
    df = spark.createDataFrame([("a", int(t * S), float(s)) for t, s in cuts], "k string, at_us long, score double")
    found = sorted(tuple(r)[1:] for r in sampling.candidates(df, ["k"], ends(spark, end), **{"budget": 0} | more).collect())
    return [m / S for m, _ in found], [m / S for m, cut in found if cut]


def test_cuts_keep_their_distance(spark):
    assert moments(spark, [(10, 1), (10.5, 1), (11, 1), (11.5, 1), (13, 1)], 20)[1] == [10.25, 13.25]


def test_weak_cuts_go_first_and_gaps_stay_covered(spark):
    every, cuts = moments(spark, [(t, t) for t in range(2, 59, 3)], 60, budget=6, most_us=20 * S)
    assert cuts == [50.25, 53.25, 56.25][-len(cuts) :] and len(every) <= 6
    assert max(b - a for a, b in zip(every, [*every[1:], 60], strict=True)) <= 20


def test_a_fold_goes_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(200).selectExpr("cast(id % 2 as string) as k", "id * 1000 as at_us")
        found = sorted((r.k, r.at_us) for r in sampling.spaced(df, ["k"], 30_000).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == [(str(k), (i + k) * 1000) for k in (0, 1) for i in range(0, 200, 30)]


def test_no_cut_leaves_no_gap_above_the_interval(spark):
    cuts = spark.createDataFrame([], "k string, at_us long, score double")
    found = sorted(r.at_us / S for r in sampling.candidates(cuts, ["k"], ends(spark, 600)).collect())
    assert found[0] == 0 and max(b - a for a, b in zip(found, [*found[1:], 600])) <= 30


@pytest.mark.parametrize(
    "frames,end,kept",
    [
        ([(0, 0, False), (30, 0, False), (60, 0, False), (90, 0, False)], 120, [0, 30, 60, 90]),
        ([(0, 0, False), (29, 0, True), (30, 0, False), (60, 0, False)], 60, [0, 29, 30]),
        ([(0, 0, False), (2, 0, False), (4, (1 << 40) - 1, False), (6, (1 << 40) - 1, False)], 8, [0, 4]),
    ],
)
def test_frames_that_say_nothing_new_are_dropped(spark, frames, end, kept):
    rows = [("a", int(t * S), [w], cut) for t, w, cut in frames]
    df = spark.createDataFrame(rows, "k string, at_us long, words array<long>, at_shot_boundary boolean")
    found = sorted(r.at_us / S for r in sampling.dedupe(df, ["k"], ends(spark, end), 30 * S, 12).collect())
    assert found == kept
