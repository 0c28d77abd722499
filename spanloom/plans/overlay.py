"""The index as it should be read: stored segments and cues, corrected by what arrived beside them.

Transcripts come first, captions second, so that a track corrects what the better transcript says. Both are
views; the stored tables stay as they were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import captions, joins, transcripts


def line_statistics(cues: DataFrame, segments: DataFrame, text_cues: DataFrame, keys: Sequence[str], settings: captions.Attribution, word_timed=None, bucket_us: int = 60_000_000) -> DataFrame:
    """``tokens``, ``tokens_in_speech`` and ``on_screen`` of each caption line, as routing wants them."""
    timed = captions.with_ends(cues, keys)
    moments = captions.token_moments(timed, F.lit(False) if word_timed is None else word_timed)
    counted = moments.groupBy(*keys, "ordinal").agg(F.count("*").alias("tokens"))
    speech = segments.where("kind = 'speech'").select(*keys, F.col("start_us").alias("s"), F.col("end_us").alias("e"), "segment_id")
    numbered = moments.withColumn("moment_id", F.monotonically_increasing_id()).select(*keys, "ordinal", "moment_id", "at_us")
    inside = joins.first_span_of(numbered, speech, keys, "moment_id", "at_us", "s", "e", [F.col("s")], bucket_us).groupBy(*keys, "ordinal").agg(F.count("*").alias("tokens_in_speech"))
    form = X.normalize(X.strip_conventions(F.col("text")))
    w = settings.screen_window_us
    asked = timed.select(*keys, "ordinal", form.alias("form"), (F.col("start_us") - w).alias("start_us"), (F.col("start_us") + w).alias("end_us"))
    shown = text_cues.select(*keys, X.normalize(F.col("text")).alias("seen"), F.col("start_us").alias("r_start_us"), F.col("end_us").alias("r_end_us")).where("seen <> ''")
    pairs = joins.overlapping(asked.where(F.length("form") >= 6), shown, keys, bucket_us)
    head = lambda x: F.substring(x, 1, 12)
    hit = pairs.where(F.contains("seen", head("form")) | F.contains("form", head("seen"))).select(*keys, "ordinal").distinct().withColumn("hit", F.lit(True))
    out = timed.join(counted, [*keys, "ordinal"], "left").join(inside, [*keys, "ordinal"], "left").join(asked.select(*keys, "ordinal", "form"), [*keys, "ordinal"]).join(hit, [*keys, "ordinal"], "left")
    on_screen = F.when(F.length("form") >= 6, F.coalesce("hit", F.lit(False)))
    return out.select(*keys, "ordinal", "start_us", "end_us", "text", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("tokens_in_speech", F.lit(0)).alias("tokens_in_speech"), on_screen.alias("on_screen"))


def apply(segments: DataFrame, text_cues: DataFrame, cues: DataFrame, keys: Sequence[str], languages: DataFrame, accounts: DataFrame | None = None, settings: captions.Attribution = captions.Attribution()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, text cues) with ``fused`` and ``outcome``, and the ``verdict`` and routing counts of each track.

    ``languages``: keys and ``language`` of each track. A track whose letters are not in its language's script
    corrects nothing, and neither does one with a cue that has no moment or no text: its index reads as it was.
    """
    if accounts is not None:
        segments = transcripts.overlay(segments, accounts, [*keys, "segment_id"])
    broken = cues.groupBy(*keys).agg(F.bool_or(F.col("start_us").isNull() | (F.col("start_us") < 0) | F.col("text").isNull()).alias("broken"))
    sound = broken.where(~F.col("broken")).select(*keys)
    # letters are counted line by line, and their share is taken of the sums
    lettered = cues.join(sound, list(keys), "left_semi").join(languages, list(keys)).withColumn("__share", X.script_share(F.col("text"), F.col("language")))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    shares = lettered.groupBy(*keys).agg((F.sum(F.col("__share") * letters) / F.greatest(F.sum(F.when(F.col("__share").isNotNull(), letters)), F.lit(1))).alias("share"))
    shares = shares.withColumn("language_ok", F.col("share").isNull() | (F.col("share") >= settings.script_share))
    usable = cues.join(shares.where("language_ok").select(*keys), list(keys), "left_semi")
    routed = captions.route(line_statistics(usable, segments, text_cues, keys, settings), keys, settings)
    lines = routed.select(*keys, "ordinal", "start_us", "end_us", "text", "decision")
    spoken = captions.fuse_audio(segments, lines.where("decision = 'audio'"), keys, settings)
    shown = captions.fuse_text(text_cues, lines.where("decision = 'text'"), keys, settings)
    counts = lines.groupBy(*keys).agg(*(F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("audio", "text", "drop")))
    all_ = cues.join(sound, list(keys), "left_semi").groupBy(*keys).agg(F.count("*").alias("cues"))
    summary = shares.join(counts, list(keys), "left").join(all_, list(keys))
    n = lambda d: F.coalesce(f"n_{d}", F.lit(0) if d != "drop" else F.col("cues"))
    told = captions.verdict(F.col("language_ok"), n("audio"), n("text"))
    return spoken, shown, summary.select(*keys, "language_ok", F.round("share", 4).alias("script_share"), "cues", n("audio").alias("n_audio"), n("text").alias("n_text"), n("drop").alias("n_drop"), told.alias("verdict"))
