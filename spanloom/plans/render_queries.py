"""Queries of the parsers and the rendered indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import time as T
from spanloom.operators import read_plans, render, tracks
from spanloom.plans.tables import EVENTS, events, read
from spanloom.sources import files


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def vtt_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as WebVTT, a cue every 3.5 s, and read back."""
    seconds = F.col("turn") * 3500
    stamp = F.format_string("%02d:%02d:%02d.%03d", F.floor(seconds / 3600000), F.floor(F.pmod(seconds, F.lit(3600000)) / 60000), F.floor(F.pmod(seconds, F.lit(60000)) / 1000), F.pmod(seconds, F.lit(1000)))
    block = F.concat(stamp, F.lit(" --> "), stamp, F.lit("\n"), F.col("text"))
    listed = _turns(spark, sf).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda r: r["b"]), "\n\n").alias("b"))
    cues = listed.select("conv_id", F.explode(files.parse_vtt(F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.col("b")))).alias("c"))
    return cues.select("conv_id", F.col("c.start_us").alias("start_us"), F.col("c.text").alias("text"))


def json3_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as json3, a word of its own after every fourth turn, and read back: some are word-timed."""
    segment = lambda text, ms: F.struct(text.alias("utf8"), F.lit(ms).alias("tOffsetMs"))
    body = segment(F.col("text"), 250)
    segments = F.when((F.col("turn") + F.col("conv_id")) % 4 == 0, F.array(body, segment(F.lit("&eacute;&#33;"), 750))).otherwise(F.array(body, segment(F.lit("\n"), 0)))
    event = F.struct((F.col("turn") * 2000).alias("tStartMs"), segments.alias("segs"))
    payload = _turns(spark, sf).groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("p"))
    cues = payload.select("conv_id", files.json3_word_timed(F.col("p")).alias("word_timed"), F.explode(files.parse_json3(F.col("p"))).alias("c"))
    return cues.select("conv_id", "word_timed", F.col("c.start_us").alias("start_us"), F.col("c.text").alias("text"))


def audio_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    words = F.when(F.col("kind").isin("view", "click"), F.concat(F.lit("event "), F.col("event_id").cast("string"))).otherwise("")
    segments = rows.select("k", "start_us", "end_us", F.when(F.col("event_id") % 3 == 0, "unknown").otherwise("en").alias("language"), F.when(F.col("kind").isin("purchase", "view"), F.array("kind")).otherwise(F.array().cast("array<string>")).alias("events"), words.alias("text"))
    return render.audio_lines(segments, ["k"]).select("k", F.col("ordinal").cast("long").alias("ordinal"), "line")


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as on-screen text of one place: each text of a user with its intervals."""
    rows = events(spark, sf).select("k", "start_us", "end_us", F.col("kind").alias("text"), F.lit("top left").alias("position"), F.lit("small").alias("size"))
    return render.text_lines(rows, ["k"]).select("k", "line")


def track_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's turns as two readings a second apart of one line; the tracker has no SQL."""
    turns = _turns(spark, sf)
    seen = turns.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at_us", (F.col("turn") * 10 + F.col("n")) * T.SECOND)
    lines = seen.select("conv_id", F.lit(10_000 * T.SECOND).cast("long").alias("duration_us"), "at_us", "text", F.lit(0.99).alias("confidence"), F.lit(0.4).alias("top"), F.lit(0.5).alias("bottom"), F.lit(0.1).alias("left"), F.lit(0.9).alias("right"), F.lit(None).cast("string").alias("look"), F.lit(False).alias("verification"), F.lit(False).alias("discovery"))
    return tracks.track_cues(lines, ["conv_id"])


def visible_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as runs of text in three slots of the frame, each moment owned once."""
    top = F.pmod("event_id", F.lit(3)) * 0.3
    rows = events(spark, sf).select("k", "start_us", "end_us", F.col("kind").alias("text"), top.alias("top"), (top + 0.1).alias("bottom"), F.lit(0.1).alias("left"), F.lit(0.9).alias("right"))
    return tracks.owned(rows, ["k"])


def read_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Which events of each user to read, had each a signature of its kind."""
    rows = events(spark, sf).select("k", F.col("start_us").alias("at_us"), F.array(F.length("kind"), F.floor(F.col("value") / 10).cast("int")).alias("signature"), (F.col("event_id") % 50 == 0).alias("required"))
    return read_plans.reads(rows, ["k"], refresh_s=86400.0, check_s=3600.0)


QUERIES = {f.__name__: f for f in (vtt_parse, json3_parse, audio_lines, text_lines, track_entities, visible_regions, read_plan)}

TURNS = r"t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '<[^>]{0,40}>', '', 'g'), '\s+', ' ', 'g')) AS text FROM conversations)"
ORACLES = {
    # texts cover one another only where they are equal, and of those in one slot the earliest has the first claim
    "visible_regions": f"""WITH {EVENTS}, m AS (SELECT *, max(end_us) OVER (PARTITION BY k, kind, event_id % 3 ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM ev WHERE end_us > start_us)
SELECT k, greatest(start_us, coalesce(reached, start_us)) AS start_us, end_us, kind AS text FROM m WHERE end_us > coalesce(reached, start_us)""",
    "read_plan": f"""WITH RECURSIVE {EVENTS}, f AS (SELECT k, start_us AS at_us, [length(kind), floor(value / 10)::INT] AS sig, event_id % 50 = 0 AS required, row_number() OVER (PARTITION BY k ORDER BY start_us) AS n FROM ev),
r(k, n, checked, last_read, sig, take) AS (SELECT k, n, at_us, at_us, sig, true FROM f WHERE n = 1
  UNION ALL SELECT f.k, f.n, CASE WHEN d.due THEN f.at_us ELSE r.checked END, CASE WHEN t.take THEN f.at_us ELSE r.last_read END, CASE WHEN t.take THEN f.sig ELSE r.sig END, t.take
  FROM r JOIN f ON f.k = r.k AND f.n = r.n + 1, LATERAL (SELECT f.at_us - r.checked >= 3600000000 AS due) d,
  LATERAL (SELECT f.required OR f.at_us - r.last_read >= 86400000000 OR (d.due AND f.sig <> r.sig) AS take) t)
SELECT r.k, f.at_us FROM r JOIN f ON r.k = f.k AND r.n = f.n WHERE take""",
    "vtt_parse": f"WITH {TURNS} SELECT conv_id, turn * 3500000 AS start_us, text FROM t WHERE text <> ''",
    "json3_parse": f"""WITH {TURNS}, w AS (SELECT *, (turn + conv_id) % 4 = 0 AS two FROM t), e AS (SELECT conv_id, count(*) FILTER (two AND text <> '') > 0.2 * count(*) AND count(*) > 0 AS word_timed FROM w GROUP BY conv_id),
c AS (SELECT conv_id, turn * 2000000 + 250000 AS start_us, text FROM w WHERE text <> '' UNION ALL SELECT conv_id, turn * 2000000 + 750000, 'é!' FROM w WHERE two)
SELECT c.conv_id, word_timed, start_us, text FROM c JOIN e ON c.conv_id = e.conv_id""",
    "audio_lines": f"""WITH {EVENTS}, s AS (SELECT *, CASE WHEN kind IN ('view', 'click') THEN 'event ' || event_id ELSE '' END AS words FROM ev WHERE kind IN ('view', 'click', 'purchase'))
SELECT k, row_number() OVER (PARTITION BY k ORDER BY start_us, end_us) AS ordinal, '[' || start_us // 1000000 || '-' || end_us // 1000000 || '] ' ||
  concat_ws(' ', CASE WHEN words <> '' AND event_id % 3 <> 0 THEN '<en>' END, CASE WHEN kind IN ('purchase', 'view') THEN '<' || kind || '>' END, nullif(words, '')) AS line FROM s""",
    "text_lines": f"""WITH {EVENTS}, r AS (SELECT *, max(end_us) OVER (PARTITION BY k, kind ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM ev),
n AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_us > reached THEN 1 ELSE 0 END) OVER (PARTITION BY k, kind ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS run FROM r),
s AS (SELECT k, kind, min(start_us) AS a, max(end_us) AS b FROM n GROUP BY k, kind, run)
SELECT k, '[' || string_agg(a // 1000000 || '-' || (b + 999999) // 1000000, '; ' ORDER BY a, b) || ', top left, small] ' || kind AS line FROM s GROUP BY k, kind""",
}
