"""Queries of fused captions, rich transcripts, hints and measures, over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import images as I
from spanloom.functions import time as T
from spanloom.operators import captions, hints
from spanloom.plans.tables import EVENTS, events, read
from spanloom.sources import rich

WORDS = ("alpha", "beta", "", "gamma delta")
LINES = ("Alpha", "beta", "(noise)", "omega", "alpha")


def _one_of(values: tuple[str, ...], key: str = "event_id"):
    return F.element_at(F.array(*(F.lit(x) for x in values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def _fused_audio(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    segments = rows.where("kind = 'view'").select("k", F.col("event_id").alias("segment_id"), "start_us", "end_us", F.lit("speech").alias("kind"), _one_of(WORDS).alias("text"))
    cues = rows.where("kind <> 'view'").select("k", F.col("event_id").alias("ordinal"), "start_us", _one_of(LINES).alias("text"))
    return captions.fuse_audio(segments, cues, ["k"])


def fuse_audio(spark: SparkSession, sf: str) -> DataFrame:
    """Views as speech of known words, other events as caption lines: what becomes of each region."""
    return _fused_audio(spark, sf).select("segment_id", "fused", "outcome")


def audio_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return captions.audio_outcomes(_fused_audio(spark, sf), ["k"])


def _fused_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    cues = rows.where("kind = 'purchase'").select("k", F.col("event_id").alias("cue_id"), "start_us", "end_us", _one_of(("alpha", "alphx", "omega")).alias("text"))
    lines = rows.where("kind = 'click'").select("k", F.col("event_id").alias("ordinal"), "start_us", "end_us", _one_of(("ALPHA", "kuruz", "alpha beta")).alias("text"))
    return captions.fuse_text(cues, lines, ["k"])


def fuse_text(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as texts on screen, clicks as caption lines near them: the best line of each and what it corrects."""
    return _fused_text(spark, sf).select("cue_id", "fused", "outcome")


def text_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return captions.text_outcomes(_fused_text(spark, sf), ["k"])


def rich_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as marked-up results of a recogniser, a sentence for each turn, and read back."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).where("text <> ''")
    tag = F.concat(F.lit("<|"), _one_of(("en", "KO", "fr"), "turn"), F.lit("|><|NEUTRAL|><|"), _one_of(("BGM", "withitn"), "turn"), F.lit("|>"))
    sentence = F.struct((F.col("turn") * 1000.0).alias("start"), (F.col("turn") * 1000.0 + 900).alias("end"), F.concat(tag, F.col("text")).alias("raw_text"))
    listed = turns.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(sentence)).alias("sentence_info"))).alias("payload"))
    found = rich.segments(listed.withColumn("duration_us", F.lit(0).cast("long")))
    return found.select("conv_id", "start_us", "end_us", "language", "emotion", F.array_join("events", " ").alias("events"), "text")


def chapters_at(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as chapters: the views and chapters that share a moment."""
    rows = events(spark, sf)
    chapters = rows.where("kind = 'purchase'").select("k", F.col("start_us").alias("r_start_us"), F.col("end_us").alias("r_end_us"), F.concat(F.lit("chapter "), "event_id").alias("title"))
    spans = rows.where("kind = 'view'").select("k", "event_id", "start_us", "end_us")
    return hints.chapters_at(chapters, spans, ["k"], 3600 * T.SECOND).select("event_id", "title")


def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    said = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("words "), "event_id"))
    line = hints.transcript_line(F.col("start_us"), F.col("end_us"), F.when(F.col("event_id") % 2 == 0, F.array("kind")), said)
    return rows.select("event_id", line.alias("line"))


def timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """Moments named in made-up answers, and how many are those expected at their places."""
    rows = read(spark, sf, "events").select("event_id")
    clock = lambda n: F.concat(F.floor(F.pmod(n, F.lit(60)) / 6).cast("string"), F.lit(":"), F.lpad(F.pmod(n, F.lit(60)).cast("string"), 2, "0"))
    text = F.concat(F.lit("seen at "), clock(F.col("event_id")), F.lit(", then "), clock(F.col("event_id") * 7), F.lit(" and 1:99"))
    found = rows.withColumn("found", hints.timestamps(text))
    want = F.array(F.lpad(clock(F.col("event_id")), 5, "0"), F.lit("00:07"))
    return found.select("event_id", F.array_join("found", " ").alias("found"), hints.positional_accuracy(F.col("found"), want).alias("accuracy"))


def mode_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("kind", (F.col("event_id") % 100).cast("double").alias("latency_s"), F.when(F.col("event_id") % 11 == 0, "failed").alias("error"))
    return hints.means_by_mode(rows, "kind", ["latency_s"], "error")


def edge_density(spark: SparkSession, sf: str) -> DataFrame:
    """Share of strong edges in the images' grids of cells, as grey values."""
    grey = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.least(F.abs(x) * 500, F.lit(255.0))))
    return read(spark, sf, "embeddings").select("vec_id", I.edge_density(grey, 8).alias("density"))


QUERIES = {f.__name__: f for f in (fuse_audio, audio_outcomes, fuse_text, text_outcomes, rich_segments, chapters_at, transcript_lines, timestamps, mode_means, edge_density)}


def _case(values: tuple[str, ...], key: str = "event_id") -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# every line is one word, so the account's similarity is twice the words in common, of those of both
AUDIO = f"""{EVENTS}, s AS (SELECT k, event_id AS segment_id, start_us, end_us, {_case(WORDS)} AS text FROM ev WHERE kind = 'view'),
c AS (SELECT k, event_id AS ordinal, start_us, {_case(LINES)} AS line FROM ev WHERE kind <> 'view'),
p AS (SELECT c.*, segment_id, row_number() OVER (PARTITION BY c.k, ordinal ORDER BY s.start_us, segment_id) AS n FROM c JOIN s ON c.k = s.k AND c.start_us >= s.start_us AND c.start_us < s.end_us),
g AS (SELECT k, segment_id, coalesce(string_agg(CASE WHEN line <> '(noise)' THEN line END, ' ' ORDER BY ordinal), '') AS caption FROM p WHERE n = 1 GROUP BY k, segment_id),
t AS (SELECT s.*, caption, CASE WHEN text = '' THEN [] ELSE string_split(text, ' ') END AS heard, CASE WHEN caption = '' THEN [] ELSE string_split(lower(caption), ' ') END AS words FROM s LEFT JOIN g ON s.k = g.k AND s.segment_id = g.segment_id),
m AS (SELECT *, CASE WHEN len(heard) = 0 THEN 1.0 WHEN len(heard) = 1 THEN 2.0 * (CASE WHEN list_contains(words, heard[1]) THEN 1 ELSE 0 END) / (1 + len(words)) ELSE 0.0 END AS alike FROM t),
f AS (SELECT *, CASE WHEN caption IS NOT NULL AND caption <> '' AND alike >= 0.2 THEN caption ELSE text END AS fused0 FROM m),
n AS (SELECT *, lower(replace(fused0, ' ', '')) = lower(replace(text, ' ', '')) AS same, lower(replace(caption, ' ', '')) <> lower(replace(text, ' ', '')) AS other FROM f),
o AS (SELECT k, segment_id, CASE WHEN same THEN text ELSE fused0 END AS fused, CASE WHEN caption IS NULL THEN NULL WHEN same AND other THEN 'guarded' WHEN same THEN 'agreed' WHEN trim(text) = '' THEN 'recovered' ELSE 'rewritten' END AS outcome FROM n)"""
# matching blocks of the few words there are
TEXT = f"""{EVENTS}, q AS (SELECT k, event_id AS cue_id, start_us, end_us, {_case(("alpha", "alphx", "omega"))} AS text FROM ev WHERE kind = 'purchase'),
l AS (SELECT k, event_id AS ordinal, start_us, end_us, {_case(("ALPHA", "kuruz", "alpha beta"))} AS line FROM ev WHERE kind = 'click'),
r(text, line, score) AS (VALUES ('alpha', 'ALPHA', 1.0), ('alphx', 'ALPHA', 0.8), ('alpha', 'alpha beta', 10.0 / 14), ('alphx', 'alpha beta', 8.0 / 14)),
p AS (SELECT q.*, l.line, score, row_number() OVER (PARTITION BY q.k, cue_id ORDER BY score DESC, ordinal) AS n FROM q JOIN l ON q.k = l.k AND q.start_us < l.end_us + 3000000 AND l.start_us - 3000000 < q.end_us JOIN r ON q.text = r.text AND l.line = r.line),
o AS (SELECT q.k, q.cue_id, CASE WHEN p.line = 'ALPHA' THEN p.line ELSE q.text END AS fused, CASE WHEN p.line = 'alpha beta' THEN 'guarded' WHEN q.text = 'alpha' AND p.line = 'ALPHA' THEN 'cosmetic' WHEN p.line = 'ALPHA' THEN 'corrected' END AS outcome
FROM q LEFT JOIN (SELECT * FROM p WHERE n = 1) p ON q.k = p.k AND q.cue_id = p.cue_id)"""
CLOCK = "({n} % 60 // 6) || ':' || lpad(({n} % 60)::VARCHAR, 2, '0')"

ORACLES = {
    "fuse_audio": f"WITH {AUDIO} SELECT segment_id, fused, outcome FROM o",
    "audio_outcomes": f"""WITH {AUDIO} SELECT k, count(*) AS speech_regions, count(outcome) AS regions_covered, count(*) FILTER (outcome IN ('rewritten', 'recovered')) AS regions_rewritten,
count(*) FILTER (outcome = 'guarded') AS regions_guarded, count(*) FILTER (outcome = 'recovered') AS regions_recovered FROM o GROUP BY k""",
    "fuse_text": f"WITH {TEXT} SELECT cue_id, fused, outcome FROM o",
    "text_outcomes": f"WITH {TEXT} SELECT k, count(*) AS cues, count(*) FILTER (outcome = 'corrected') AS corrected, count(*) FILTER (outcome = 'cosmetic') AS cosmetic, count(*) FILTER (outcome = 'guarded') AS guarded FROM o GROUP BY k",
    "rich_segments": r"""SELECT conv_id, turn * 1000000 AS start_us, turn * 1000000 + 900000 AS end_us, CASE turn % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ko' ELSE 'unknown' END AS language, 'neutral' AS emotion,
concat_ws(' ', CASE WHEN turn % 3 = 2 THEN 'fr' END, CASE WHEN turn % 2 = 0 THEN 'BGM' END) AS events, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""",
    "chapters_at": f"WITH {EVENTS} SELECT v.event_id, 'chapter ' || p.event_id AS title FROM ev v JOIN ev p ON v.k = p.k AND v.kind = 'view' AND p.kind = 'purchase' AND v.start_us < p.end_us AND p.start_us < v.end_us",
    "transcript_lines": f"""WITH {EVENTS} SELECT event_id, rtrim('[' || start_us // 1000000 || '-' || end_us // 1000000 || '] ' || concat_ws(' ', CASE WHEN event_id % 2 = 0 THEN '<' || kind || '>' END, CASE WHEN event_id % 3 > 0 THEN 'words ' || event_id END)) AS line FROM ev""",
    "timestamps": f"""WITH t AS (SELECT event_id, lpad({CLOCK.format(n="event_id")}, 5, '0') AS a, lpad({CLOCK.format(n="event_id * 7")}, 5, '0') AS b FROM events)
SELECT event_id, a || ' ' || b AS found, (1 + CASE WHEN b = '00:07' THEN 1 ELSE 0 END) / 2.0::DOUBLE AS accuracy FROM t""",
    "mode_means": f"WITH {EVENTS} SELECT kind, count(*) FILTER (event_id % 11 <> 0) AS n, count(*) FILTER (event_id % 11 = 0) AS failed, avg((event_id % 100)::DOUBLE) FILTER (event_id % 11 <> 0) AS latency_s FROM ev GROUP BY kind",
    "edge_density": """WITH g AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(least(abs(x) * 500, 255))) AS c FROM embeddings),
e AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6 THEN least(greatest(8 * c[i + 1] - c[i - 8] - c[i - 7] - c[i - 6] - c[i] - c[i + 2] - c[i + 8] - c[i + 9] - c[i + 10], 0), 255) ELSE c[i + 1] END) AS edges FROM g)
SELECT vec_id, len(list_filter(edges, lambda x: x >= 48)) / 64.0::DOUBLE AS density FROM e""",
}
