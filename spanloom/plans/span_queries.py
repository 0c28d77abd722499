"""Queries of the span algebra and the interval joins over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import time as T
from spanloom.operators import clocks, joins, sampling, spans
from spanloom.plans.tables import EVENTS, events, relative

HOUR = 3600 * T.SECOND
KEYS = ["k"]
UNION_SQL = """
reach AS (SELECT *, max(end_us) OVER (PARTITION BY k ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {src}),
runs AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_us - reached > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run FROM reach),
merged AS (SELECT k, min(start_us) AS start_us, max(end_us) AS end_us FROM runs GROUP BY k, run)"""


def span_union(spark: SparkSession, sf: str) -> DataFrame:
    return spans.union(events(spark, sf), KEYS, gap_us=T.MINUTE, bucket_us=24 * HOUR)


def span_complement(spark: SparkSession, sf: str) -> DataFrame:
    rows, ends = relative(spark, sf)
    return spans.complement(rows, KEYS, ends, bucket_us=24 * HOUR)


def span_split(spark: SparkSession, sf: str) -> DataFrame:
    return spans.split_long(events(spark, sf).select("event_id", "start_us", "end_us"), 10 * T.MINUTE)


SPEECH = {"merge_gap_us": 20 * T.MINUTE, "min_bridge_us": 5 * T.MINUTE, "min_region_us": 2 * T.MINUTE, "window_max_us": HOUR}


def timeline_partition(spark: SparkSession, sf: str) -> DataFrame:
    rows, ends = relative(spark, sf)
    return spans.timeline(rows, KEYS, ends, **SPEECH).select("k", "start_us", "end_us", "kind")


TIMELINE_SQL = f"""WITH {EVENTS},
raw AS (SELECT *, lag(end_us) OVER w AS le, lag(end_us - start_us) OVER w AS ll FROM rel WHERE end_us > start_us WINDOW w AS (PARTITION BY k ORDER BY start_us, end_us)),
wide AS (SELECT k, duration_us, start_us AS a, end_us AS b, start_us - start_us % 1000000 AS s,
    least((end_us + 999999) // 1000000 * 1000000, greatest(end_us, duration_us)) AS e,
    coalesce(start_us - le <= {SPEECH["merge_gap_us"]} AND start_us - le <= greatest({SPEECH["min_bridge_us"]}, least(ll, end_us - start_us)), false) AS breath FROM raw),
w2 AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM wide),
w3 AS (SELECT *, sum(CASE WHEN reached IS NULL OR NOT (s <= reached OR breath) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM w2),
j AS (SELECT k, duration_us, min(s) AS s, max(e) AS e FROM w3 GROUP BY k, duration_us, run),
j2 AS (SELECT *, lag(e) OVER (PARTITION BY k ORDER BY s, e) AS pe FROM j),
j3 AS (SELECT k, duration_us, e, CASE WHEN pe IS NULL AND s < {SPEECH["min_region_us"]} THEN 0 ELSE s END AS s,
    sum(CASE WHEN pe IS NULL OR s - pe >= {SPEECH["min_region_us"]} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM j2),
ab AS (SELECT k, duration_us, min(s) AS s, max(e) AS e FROM j3 GROUP BY k, duration_us, run),
sp AS (SELECT k, duration_us, s, CASE WHEN lead(s) OVER (PARTITION BY k ORDER BY s) IS NULL AND duration_us - e > 0 AND duration_us - e < {SPEECH["min_region_us"]} THEN duration_us ELSE e END AS e FROM ab),
gaps AS (SELECT k, lag(e, 1, 0::BIGINT) OVER (PARTITION BY k ORDER BY s) AS s, s AS e FROM sp
    UNION ALL SELECT d.k, coalesce(max(sp.e), 0), d.duration_us FROM dur d LEFT JOIN sp ON d.k = sp.k GROUP BY d.k, d.duration_us),
parts AS (SELECT k, s, e, 'speech' AS kind FROM sp UNION ALL SELECT k, s, e, 'non_speech' FROM gaps WHERE e - s >= {SPEECH["min_region_us"]}),
n AS (SELECT *, greatest(1, (e - s + {HOUR - 1}) // {HOUR}) AS c FROM parts),
x AS (SELECT *, unnest(range(c)) AS i FROM n)
SELECT k, s + (i * (e - s)) // c AS start_us, CASE WHEN i + 1 = c THEN e ELSE s + ((i + 1) * (e - s)) // c END AS end_us, kind FROM x"""


def tumbling_count(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each chunk of six hours of each key's duration, empty chunks included."""
    rows, ends = relative(spark, sf)
    grid = spans.chunks(ends, 6 * HOUR)
    counts = rows.groupBy("k", (F.floor(F.col("start_us") / (6 * HOUR)) * (6 * HOUR)).alias("start_us")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["k", "start_us"], "left").select("k", "start_us", "end_us", F.coalesce("n", F.lit(0)).alias("n_events"))


def rle_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours whose tags are one set, in whatever order each has them, and repeated or not."""
    tag = F.when(F.col("kind") == "view", "click").otherwise(F.col("kind"))
    tags = F.when(F.col("event_id") % 3 == 0, F.array(tag, F.lit("all"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("all"), tag)).otherwise(F.array(tag, F.lit("all"), tag))
    rows = events(spark, sf).select("k", "start_us", "end_us", tags.alias("tags"))
    return spans.merge_runs(rows, KEYS, "tags").select("k", "start_us", "end_us", F.array_join("tags", " ").alias("tag"))


def coverage_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows, ends = relative(spark, sf)
    return sampling.fill_gaps(rows.select("k", F.col("start_us").alias("at_us")), KEYS, ends, 6 * HOUR)


def spacing_thin(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = relative(spark, sf)
    return sampling.spaced(rows.select("k", F.col("start_us").alias("at_us")), KEYS, 2 * HOUR)


def point_in_span(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    moments = rows.where("kind = 'click'").select("k", F.col("event_id").alias("moment_id"), F.col("start_us").alias("at_us"))
    regions = rows.where("kind = 'view'").select("k", F.col("event_id").alias("region_id"), "start_us", "end_us")
    found = joins.first_span_of(moments, regions, KEYS, "moment_id", "at_us", "start_us", "end_us", [F.col("start_us"), F.col("region_id")], HOUR)
    return found.select("k", "moment_id", "region_id")


def unplaced_anti(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    moments = rows.where("kind <> 'view'").select("k", "event_id", F.col("start_us").alias("at_us"))
    return joins.outside_all(moments, rows.where("kind = 'view'"), KEYS, "at_us", "start_us", "end_us", HOUR).select("k", "event_id")


def overlap_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Whether another kind of span overlaps each click within three minutes; null for spans too short to judge."""
    rows = events(spark, sf)
    near = rows.where("kind = 'click'").select("k", "event_id", "value", (F.col("start_us") - 3 * T.MINUTE).alias("start_us"), (F.col("start_us") + 3 * T.MINUTE).alias("end_us"))
    other = rows.where("kind = 'purchase'").select("k", F.col("start_us").alias("r_start_us"), F.col("end_us").alias("r_end_us"))
    hits = joins.overlapping(near, other, KEYS, HOUR).select("event_id").distinct().withColumn("hit", F.lit(True))
    seen = F.when(F.col("value") < 1, F.lit(None)).otherwise(F.coalesce("hit", F.lit(False)))
    return near.join(hits, "event_id", "left").select("event_id", seen.alias("seen"))


def clip_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    left = rows.where("kind = 'click'").select("k", "event_id", "start_us", "end_us")
    right = rows.where("kind = 'error'").select("k", F.col("event_id").alias("r_event_id"), F.col("start_us").alias("r_start_us"), F.col("end_us").alias("r_end_us"))
    return joins.clipped(left, right, KEYS, HOUR, 30 * T.SECOND).select("event_id", "r_event_id", "clip_start_us", "clip_end_us")


def first_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The first region that overlaps each request."""
    return joins.first_overlapping(clip_overlap(spark, sf), "event_id", "r_event_id").select("event_id", F.col("r_event_id").alias("region_id"))


def asof_prev(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("k", "event_id", "kind", F.col("start_us").alias("at_us"))
    return joins.as_of_previous(rows, KEYS, "at_us", "event_id", 12 * HOUR, F.col("l.kind") != F.col("r.kind")).select("k", "event_id", "prev_event_id")


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    moments = rows.where("kind = 'purchase'").select("k", "event_id", F.col("start_us").alias("at_us"))
    grid = rows.where("kind = 'view'").select("k", F.col("start_us").alias("grid_us"))
    return joins.nearest(moments, grid, KEYS, "at_us", "event_id", "grid_us").select("k", "event_id", "nearest_us")


def support_count(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct moments of the key within an hour of each event, and whether two support it."""
    rows = events(spark, sf)
    counted = joins.support(rows, ["k", "kind"], "start_us", HOUR)
    return counted.select("event_id", "n_moments", (F.col("n_moments") >= 2).alias("supported"))


def asof_any(spark: SparkSession, sf: str) -> DataFrame:
    """The event of the user before each event, at most twelve hours back."""
    return joins.as_of_previous(events(spark, sf), KEYS, "start_us", "event_id", 12 * HOUR).select("k", "event_id", "prev_event_id")


def change_points(spark: SparkSession, sf: str) -> DataFrame:
    """Moments at which a key's value moves by more than a threshold."""
    rows = events(spark, sf)
    return sampling.change_points(rows.select("k", "event_id", F.col("start_us").alias("at_us"), "value"), KEYS, "event_id", "value", 20.0)


def weakest_cut(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest moments of each key within a budget of forty."""
    rows = events(spark, sf)
    return sampling.within_budget(rows.select("k", "event_id", F.col("value").alias("score")), KEYS, "event_id", "score", 40).select("k", "event_id")


def montage_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    return sampling.montage(rows.select("k", "event_id", F.col("start_us").alias("at_us")), KEYS, "at_us", "event_id", 3)


def frame_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Every third frame of a clock of one an hour over each key's duration."""
    _, ends = relative(spark, sf)
    return clocks.every(clocks.frames(ends, 1 / 3600), 3).select("k", "frame", "at_us")


def neighbour_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of the hourly clock beside those that hold an event, holding none themselves."""
    rows, _ = relative(spark, sf)
    chosen = rows.select("k", F.floor(F.col("start_us") / HOUR).alias("frame")).distinct()
    return clocks.beside(chosen, KEYS)


def dedupe_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames with sixteen bits of their number as hash."""
    rows, ends = relative(spark, sf)
    frames = rows.select("k", F.col("start_us").alias("at_us"), F.array(F.pmod(F.col("event_id") * 40503, F.lit(65536))).alias("words"), (F.col("kind") == "error").alias("at_shot_boundary"))
    return sampling.dedupe(frames, KEYS, ends, 6 * HOUR, 4)


def sample_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Moments to sample of each key under a budget of forty."""
    rows, ends = relative(spark, sf)
    cuts = rows.where("kind = 'click'").select("k", F.col("start_us").alias("at_us"), F.col("value").alias("score"))
    return sampling.candidates(cuts, KEYS, ends, least_us=HOUR, most_us=24 * HOUR, budget=40)


def settled_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user and kind the first of two events in a row that agree in their hour, else the first."""
    rows = events(spark, sf)
    probes = rows.select("k", "kind", F.col("start_us").alias("at_us"), F.array(F.floor(F.pmod(F.col("start_us"), F.lit(24 * HOUR)) / HOUR)).alias("words"), (F.col("value") < 2).alias("flat"))
    return sampling.settled(probes, ["k", "kind"], 0)


QUERIES = {f.__name__: f for f in (span_union, span_complement, span_split, timeline_partition, tumbling_count, rle_merge, coverage_fill, spacing_thin, point_in_span, unplaced_anti, overlap_semi, clip_overlap, first_overlap, asof_prev, nearest, support_count, asof_any, change_points, weakest_cut, montage_cells, frame_clock, neighbour_frames, dedupe_frames, sample_candidates, settled_probes)}

CLIP_SQL = f"""SELECT a.event_id, b.event_id AS r_event_id, greatest(a.start_us, b.start_us) AS clip_start_us, least(a.end_us, b.end_us) AS clip_end_us
FROM ev a JOIN ev b ON a.k = b.k AND a.kind = 'click' AND b.kind = 'error' AND a.start_us < b.end_us AND b.start_us < a.end_us
WHERE least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) >= {30 * T.SECOND}"""

ORACLES = {
    "asof_any": f"""WITH {EVENTS}, x AS (SELECT l.k, l.event_id, r.event_id AS prev_event_id, row_number() OVER (PARTITION BY l.event_id ORDER BY r.start_us DESC, r.event_id DESC) AS n
FROM ev l JOIN ev r ON l.k = r.k AND l.start_us > r.start_us AND l.start_us - r.start_us <= {12 * HOUR}) SELECT k, event_id, prev_event_id FROM x WHERE n = 1""",
    "dedupe_frames": f"""WITH RECURSIVE {EVENTS}, f AS (SELECT k, start_us AS at_us, event_id * 40503 % 65536 AS word, kind = 'error' AS cut, coalesce(lead(start_us) OVER (PARTITION BY k ORDER BY start_us), duration_us) AS next_us FROM rel),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY at_us, word, cut, next_us) AS n FROM f),
r(k, n, seen, word, kept) AS (SELECT k, n, at_us, word, true FROM o WHERE n = 1
  UNION ALL SELECT o.k, o.n, CASE WHEN c.good THEN o.at_us ELSE r.seen END, CASE WHEN c.good THEN o.word ELSE r.word END, c.good
  FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1, LATERAL (SELECT o.cut OR bit_count(xor(o.word, r.word)) > 4 OR o.next_us - r.seen > {6 * HOUR} AS good) c)
SELECT r.k, o.at_us FROM r JOIN o ON r.k = o.k AND r.n = o.n WHERE kept""",
    "sample_candidates": f"""WITH RECURSIVE {EVENTS}, c AS (SELECT k, start_us + 250000 AS m, min(value) AS s FROM rel WHERE kind = 'click' AND start_us + 250000 < duration_us GROUP BY 1, 2),
t(k, m) AS (SELECT k, 0::BIGINT FROM dur UNION ALL SELECT t.k, (SELECT min(c.m) FROM c WHERE c.k = t.k AND c.m >= t.m + {HOUR}) FROM t WHERE EXISTS (SELECT 1 FROM c WHERE c.k = t.k AND c.m >= t.m + {HOUR})),
z AS (SELECT d.k, d.duration_us AS e, coalesce(list({{'s': c.s, 'm': c.m}}) FILTER (c.m IS NOT NULL), []) AS kept FROM dur d LEFT JOIN (SELECT c.* FROM c JOIN t ON c.k = t.k AND c.m = t.m WHERE t.m > 0) c ON d.k = c.k GROUP BY d.k, d.duration_us),
w(k, e, kept, i) AS (SELECT k, e, kept, 0 FROM z UNION ALL SELECT k, e, list_sort(kept)[surplus + 1:], i + 1 FROM (SELECT *, 1 + len(kept) + coalesce(list_sum(list_transform(range(1, len(edges)), lambda j: greatest((edges[j + 1] - edges[j] + {24 * HOUR - 1}) // {24 * HOUR} - 1, 0))), 0)::BIGINT - 40 AS surplus
  FROM (SELECT *, list_sort(list_concat([0, e], list_transform(kept, lambda x: x.m))) AS edges FROM w)) WHERE surplus > 0 AND len(kept) > 0),
l AS (SELECT k, e, list_transform(kept, lambda x: x.m) AS cuts FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1),
g AS (SELECT k, list_sort(list_concat([0, e], cuts)) AS edges, cuts FROM l),
h AS (SELECT k, edges[j] AS a, edges[j + 1] AS b, (edges[j + 1] - edges[j] + {24 * HOUR - 1}) // {24 * HOUR} AS parts FROM (SELECT *, unnest(range(1, len(edges))) AS j FROM g))
SELECT k, 0::BIGINT AS at_us, false AS at_shot_boundary FROM g UNION ALL SELECT k, unnest(cuts), true FROM g UNION ALL SELECT k, a + i * (b - a) // parts, false FROM (SELECT *, unnest(range(1, parts)) AS i FROM h WHERE b - a > {24 * HOUR})""",
    "frame_clock": f"""WITH {EVENTS}, f AS (SELECT k, duration_us, unnest(range(0, greatest((duration_us + {HOUR - 1}) // {HOUR}, 1))) AS frame FROM dur WHERE duration_us > 0) SELECT k, frame, least(frame * {HOUR}, duration_us) AS at_us FROM f WHERE frame % 3 = 0""",
    "neighbour_frames": f"""WITH {EVENTS}, c AS (SELECT DISTINCT k, start_us // {HOUR} AS frame FROM rel), n AS (SELECT k, frame - 1 AS frame FROM c UNION SELECT k, frame + 1 FROM c) SELECT k, frame FROM n WHERE frame >= 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.k = n.k AND c.frame = n.frame)""",
    "settled_probes": f"""WITH {EVENTS}, p AS (SELECT k, kind, start_us AS a, start_us % {24 * HOUR} // {HOUR} AS h, value < 2 AS flat FROM ev),
l AS (SELECT *, lag(a) OVER w AS pa, lag(h) OVER w AS ph, lag(flat) OVER w AS pf FROM p WINDOW w AS (PARTITION BY k, kind ORDER BY a)),
s AS (SELECT k, kind, coalesce(min(pa) FILTER (NOT flat AND NOT pf AND bit_count(xor(h, ph)) = 0), min(a) FILTER (NOT flat)) AS at_us FROM l GROUP BY k, kind) SELECT k, kind, at_us FROM s WHERE at_us IS NOT NULL""",
    "span_union": f"WITH {EVENTS}, {UNION_SQL.format(src='ev', gap=T.MINUTE)} SELECT k, start_us, end_us FROM merged",
    "span_complement": f"""WITH {EVENTS}, {UNION_SQL.format(src='rel', gap=0)},
gaps AS (SELECT k, greatest(0, lag(end_us, 1, 0::BIGINT) OVER (PARTITION BY k ORDER BY start_us)) AS start_us, start_us AS end_us FROM merged
  UNION ALL SELECT d.k, coalesce(max(m.end_us), 0), d.duration_us FROM dur d LEFT JOIN merged m ON d.k = m.k GROUP BY d.k, d.duration_us)
SELECT k, start_us, end_us FROM gaps WHERE end_us > start_us""",
    "span_split": f"""WITH {EVENTS}, n AS (SELECT *, greatest(1, (end_us - start_us + {10 * T.MINUTE - 1}) // {10 * T.MINUTE}) AS c FROM ev), x AS (SELECT *, unnest(range(c)) AS i FROM n)
SELECT event_id, start_us + (i * (end_us - start_us)) // c AS start_us, CASE WHEN i + 1 = c THEN end_us ELSE start_us + ((i + 1) * (end_us - start_us)) // c END AS end_us FROM x""",
    "timeline_partition": TIMELINE_SQL,
    "tumbling_count": f"""WITH {EVENTS}, g AS (SELECT k, duration_us, unnest(range(0, duration_us, {6 * HOUR})) AS start_us FROM dur),
c AS (SELECT k, start_us // {6 * HOUR} * {6 * HOUR} AS start_us, count(*) AS n FROM rel GROUP BY 1, 2)
SELECT g.k, g.start_us, least(g.start_us + {6 * HOUR}, duration_us) AS end_us, coalesce(n, 0) AS n_events FROM g LEFT JOIN c ON g.k = c.k AND g.start_us = c.start_us""",
    "rle_merge": f"""WITH {EVENTS}, t AS (SELECT k, start_us, end_us, CASE WHEN kind = 'view' THEN 'click' ELSE kind END AS tag, event_id FROM ev),
l AS (SELECT *, CASE WHEN tag = lag(tag) OVER w THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY k ORDER BY start_us, end_us)),
r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT k, min(start_us) AS start_us, max(end_us) AS end_us, arg_min(CASE event_id % 3 WHEN 0 THEN tag || ' all' WHEN 1 THEN 'all ' || tag ELSE tag || ' all ' || tag END, start_us) AS tag FROM r GROUP BY k, run""",
    "coverage_fill": f"""WITH {EVENTS}, e AS (SELECT k, start_us AS a, lead(start_us, 1, duration_us) OVER (PARTITION BY k ORDER BY start_us) AS b FROM rel),
g AS (SELECT *, (b - a + {6 * HOUR - 1}) // {6 * HOUR} - 1 AS needed FROM e WHERE b - a > {6 * HOUR}), x AS (SELECT *, unnest(range(1, needed + 1)) AS i FROM g)
SELECT k, a + i * (b - a) // (needed + 1) AS at_us FROM x""",
    "spacing_thin": f"""WITH RECURSIVE {EVENTS}, pick(k, at_us) AS (SELECT k, min(start_us) FROM rel GROUP BY k
  UNION ALL SELECT p.k, (SELECT min(r.start_us) FROM rel r WHERE r.k = p.k AND r.start_us >= p.at_us + {2 * HOUR}) FROM pick p
  WHERE (SELECT min(r.start_us) FROM rel r WHERE r.k = p.k AND r.start_us >= p.at_us + {2 * HOUR}) IS NOT NULL)
SELECT k, at_us FROM pick""",
    "point_in_span": f"""WITH {EVENTS}, x AS (SELECT m.k, m.event_id AS moment_id, r.event_id AS region_id, row_number() OVER (PARTITION BY m.event_id ORDER BY r.start_us, r.event_id) AS n
FROM ev m JOIN ev r ON m.k = r.k AND m.kind = 'click' AND r.kind = 'view' AND m.start_us >= r.start_us AND m.start_us < r.end_us) SELECT k, moment_id, region_id FROM x WHERE n = 1""",
    "unplaced_anti": f"""WITH {EVENTS} SELECT k, event_id FROM ev m WHERE kind <> 'view' AND NOT EXISTS (SELECT 1 FROM ev r WHERE r.k = m.k AND r.kind = 'view' AND m.start_us >= r.start_us AND m.start_us < r.end_us)""",
    "overlap_semi": f"""WITH {EVENTS} SELECT event_id, CASE WHEN value < 1 THEN NULL ELSE EXISTS (SELECT 1 FROM ev r WHERE r.k = m.k AND r.kind = 'purchase'
  AND m.start_us - {3 * T.MINUTE} < r.end_us AND r.start_us < m.start_us + {3 * T.MINUTE}) END AS seen FROM ev m WHERE kind = 'click'""",
    "clip_overlap": f"WITH {EVENTS} {CLIP_SQL}",
    "first_overlap": f"WITH {EVENTS}, c AS ({CLIP_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY clip_start_us, r_event_id) AS n FROM c) SELECT event_id, r_event_id AS region_id FROM r WHERE n = 1",
    "asof_prev": f"""WITH {EVENTS}, x AS (SELECT l.k, l.event_id, r.event_id AS prev_event_id, row_number() OVER (PARTITION BY l.event_id ORDER BY r.start_us DESC, r.event_id DESC) AS n
FROM ev l JOIN ev r ON l.k = r.k AND l.kind <> r.kind AND l.start_us > r.start_us AND l.start_us - r.start_us <= {12 * HOUR}) SELECT k, event_id, prev_event_id FROM x WHERE n = 1""",
    "nearest": f"""WITH {EVENTS}, x AS (SELECT m.k, m.event_id, g.start_us AS nearest_us, row_number() OVER (PARTITION BY m.event_id ORDER BY abs(m.start_us - g.start_us), g.start_us) AS n
FROM ev m JOIN ev g ON m.k = g.k AND m.kind = 'purchase' AND g.kind = 'view') SELECT k, event_id, nearest_us FROM x WHERE n = 1""",
    "support_count": f"""WITH {EVENTS}, x AS (SELECT e.event_id, count(DISTINCT o.start_us) AS n FROM ev e JOIN ev o ON e.k = o.k AND e.kind = o.kind AND o.start_us BETWEEN e.start_us - {HOUR} AND e.start_us + {HOUR} GROUP BY e.event_id)
SELECT event_id, n AS n_moments, n >= 2 AS supported FROM x""",
    "change_points": f"""WITH {EVENTS}, x AS (SELECT k, event_id, start_us AS at_us, abs(value - lag(value) OVER (PARTITION BY k ORDER BY start_us, event_id)) AS d FROM ev) SELECT k, event_id, at_us FROM x WHERE d > 20""",
    "weakest_cut": f"""WITH {EVENTS}, x AS (SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY value, event_id) AS n, count(*) OVER (PARTITION BY k) AS c FROM ev) SELECT k, event_id FROM x WHERE n > c - 40""",
    "montage_cells": f"""WITH {EVENTS}, x AS (SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY start_us, event_id) - 1 AS n, count(*) OVER (PARTITION BY k) AS c FROM ev),
y AS (SELECT *, n // 9 AS g, least(9, c - n // 9 * 9) AS size FROM x)
SELECT k, event_id, g AS montage, CAST(ceil(sqrt(size)) AS BIGINT) AS grid, (n % 9) % CAST(ceil(sqrt(size)) AS BIGINT) AS cell_x, (n % 9) // CAST(ceil(sqrt(size)) AS BIGINT) AS cell_y FROM y""",
}
