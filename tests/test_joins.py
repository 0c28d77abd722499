"""Joins of spans against all pairs, and what the planner makes of them."""

import itertools
import random

import pytest

from spanloom.operators import captions, joins
from spanloom.plans import registry

SF = "/root/testdata/sf0.001"


def spans_of(seed, n, most):
    rng = random.Random(seed)
    found = [(rng.choice("ab"), i, a, a + int(10 ** rng.uniform(0, most))) for i in range(n) for a in [rng.randrange(-40_000, 900_000)]]
    return [*found, ("a", n, 4096, 4096), ("a", n + 1, 512, 8 * 512), (None, n + 2, 0, 900_000)]


@pytest.mark.parametrize("bucket_us", [7, 512, 100_000])
def test_spans_meet_once_whatever_their_lengths(spark, bucket_us):
    left, right = spans_of(1, 150, 5.9), spans_of(2, 150, 5.9)
    a = spark.createDataFrame(left, "k string, i long, start_us long, end_us long")
    b = spark.createDataFrame(right, "k string, j long, r_start_us long, r_end_us long")
    want = sorted((i, j) for k, i, s, e in left for m, j, t, f in right if k and k == m and s < f and t < e)
    assert sorted((r.i, r.j) for r in joins.overlapping(a, b, ["k"], bucket_us).collect()) == want
    want = sorted((i, j) for k, i, s, _ in left for m, j, t, f in right if k and k == m and t <= s < f)
    assert sorted((r.i, r.j) for r in joins.spans_with_moments(a, b, ["k"], "start_us", "r_start_us", "r_end_us", bucket_us).collect()) == want
    held = {i for i, _ in want}
    assert sorted(r.i for r in joins.outside_all(a, b, ["k"], "start_us", "r_start_us", "r_end_us", max(bucket_us, 512)).collect()) == sorted(i for _, i, *_ in left if i not in held)


def test_long_spans_are_not_repeated_for_every_bucket(spark):
    rows = spark.createDataFrame([("a", 0, 8 * 60_000_000)], "k string, start_us long, end_us long")
    assert joins._in_cells(rows, "start_us", "end_us", 1_000_000, [0], [1]).count() <= 8


@pytest.mark.parametrize("name", ["fuse_text", "text_outcomes", "fuse_audio", "unplaced_anti"])
def test_repeated_spans_are_not_broadcast(spark, name):
    """The planner doesn't know how many rows a span becomes: no such side may go through the driver."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:  # what is joined or summed below it is a result, no longer repeated spans
            own = itertools.takewhile(lambda x: "Join" not in x and "Aggregate" not in x, lines[i + 1 :])
            assert not any("Generate explode" in x for x in own), plan


def test_equal_lines_take_the_first(spark):
    cues = spark.createDataFrame([("a", 1, 0, 7_200_000_000, "alpha")], "k string, cue_id long, start_us long, end_us long, text string")
    track = spark.createDataFrame([("a", n, n * 60_000_000, n * 60_000_000 + 1, "ALPHA" if n else "gamma") for n in range(120)], "k string, ordinal long, start_us long, end_us long, text string")
    assert [(r.fused, r.outcome) for r in captions.fuse_text(cues, track, ["k"]).collect()] == [("ALPHA", "cosmetic")]
