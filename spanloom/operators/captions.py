"""Caption tracks: their spans and tokens, where each line belongs, and what it corrects.

Captions are rows of a ``track`` key with ``ordinal``, ``start_us`` and ``text``. A correction is a view over the
stored index: nothing here rewrites it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import joins


@dataclass(frozen=True)
class Attribution:
    speech_share: float = 0.6
    screen_share: float = 0.7
    script_share: float = 0.05
    screen_window_us: int = 3_000_000
    align: float = 0.2
    scope: tuple[float, float] = (0.8, 1.25)
    match: float = 0.55
    neighbourhood_us: int = 30_000_000
    neighbourhood_cues: int = 3


def with_ends(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``end_us``: the next line's start; the last runs by its length; no line is shorter than 0.2 s."""
    order = Window.partitionBy(*keys).orderBy("start_us", "ordinal")
    own = F.col("start_us") + F.greatest(F.lit(1_000_000), F.length("text") * 60_000)
    return cues.withColumn("end_us", F.greatest(F.coalesce(F.lead("start_us").over(order), own), F.col("start_us") + 200_000))


def token_moments(cues: DataFrame, word_timed: Column) -> DataFrame:
    """One row for each token: at its line's start where words are timed, else spread over the line's span."""
    words = X.tokens(X.strip_conventions(F.col("text")))
    spread = cues.withColumn("__n", F.size(words)).select("*", F.posexplode(words).alias("__i", "token"))
    span = F.col("end_us") - F.col("start_us")
    at = F.when(word_timed, F.col("start_us")).otherwise(F.col("start_us") + F.floor(span * (2 * F.col("__i") + 1) / (2 * F.col("__n"))).cast("long"))
    return spread.withColumn("at_us", at).drop("__n", "__i")


def route(lines: DataFrame, keys: Sequence[str], settings: Attribution = Attribution()) -> DataFrame:
    """``decision`` of each line from its neighbourhood: ``audio``, ``text`` or ``drop``.

    Lines carry ``tokens``, ``tokens_in_speech`` and ``on_screen`` (null where too short to judge). The
    neighbourhood is a stretch of time, or the next lines either side where that holds too few. Sums over
    ordered frames, so a track of n lines costs n log n.
    """
    near = Window.partitionBy(*keys).orderBy("start_us").rangeBetween(-settings.neighbourhood_us, settings.neighbourhood_us)
    half = max(settings.neighbourhood_cues // 2, 1)
    beside = Window.partitionBy(*keys).orderBy("start_us", "ordinal").rowsBetween(-half, half)
    seen = F.col("on_screen").cast("int")
    few = F.count("*").over(near) < settings.neighbourhood_cues
    pick = lambda agg: F.when(few, agg.over(beside)).otherwise(agg.over(near))
    inside, every = pick(F.sum("tokens_in_speech")), pick(F.sum("tokens"))
    graded, yes = pick(F.count(seen)), pick(F.sum(seen))
    speech = F.when(every > 0, inside / every).otherwise(0.0)
    screen = F.when(graded > 0, yes / graded).otherwise(0.0)
    decided = F.when(speech >= settings.speech_share, "audio").when(screen >= settings.screen_share, "text").otherwise("drop")
    return lines.withColumn("decision", decided)


def verdict(language_ok: Column, audio: Column, text: Column) -> Column:
    return (
        F.when(~language_ok, "rejected_language")
        .when((audio > 0) & (text > 0), "mixed")
        .when(audio > 0, "speech_transcript")
        .when(text > 0, "hardsub_copy")
        .otherwise("rejected_unaligned")
    )


def fuse_audio(segments: DataFrame, cues: DataFrame, keys: Sequence[str], settings: Attribution = Attribution(), bucket_us: int = 60_000_000) -> DataFrame:
    """Speech segments (``segment_id``, ``kind``, ``text``) with ``fused`` and the ``outcome`` of the lines in each.

    A line goes to the one region that holds its start. A region takes its lines' text unless its own words do
    not resemble them at all.
    """
    speech = segments.where("kind = 'speech'")
    inside = joins.first_span_of(cues.select(*keys, "ordinal", F.col("start_us").alias("at_us"), F.col("text").alias("line")), speech, keys, "ordinal", "at_us", "start_us", "end_us", [F.col("start_us"), F.col("segment_id")], bucket_us)
    line = X.strip_conventions(F.col("line"))
    ordered = F.array_sort(F.collect_list(F.when(line != "", F.struct("ordinal", line.alias("line")))))
    lines = inside.groupBy(*keys, "segment_id").agg(F.array_join(F.transform(ordered, lambda r: r["line"]), " ").alias("caption"))
    joined = segments.join(lines, [*keys, "segment_id"], "left")
    words, heard = X.tokens(F.col("caption")), X.tokens(F.col("text"))
    covered = F.col("caption").isNotNull()
    fold = lambda t: F.transform(t, F.lower)
    joined = joined.withColumns({"__heard": fold(heard), "__words": fold(words)})
    # equal accounts need no matching, and no more can match than both have
    most = 2 * F.least(F.size("__heard"), F.size("__words")) / F.greatest(F.size("__heard") + F.size("__words"), F.lit(1))
    open_ = covered & (F.col("caption") != "") & (F.size("__heard") > 0) & (F.col("__heard") != F.col("__words")) & (most >= settings.align)
    asked = joined.where(open_).withColumn("__alike", X.token_ratio(F.col("__heard"), F.col("__words")))
    told = joined.where(~F.coalesce(open_, F.lit(False))).withColumn("__alike", F.when((F.size("__heard") == 0) | (F.col("__heard") == F.col("__words")), 1.0).otherwise(0.0))
    joined = asked.unionByName(told).drop("__heard", "__words")
    fused = F.when(covered & (F.col("caption") != "") & (F.coalesce("__alike", F.lit(0.0)) >= settings.align), F.col("caption")).otherwise(F.col("text"))
    joined = joined.withColumn("fused", fused).drop("__alike")
    same = X.normalize(F.col("fused")) == X.normalize(F.col("text"))
    outcome = (
        F.when(~covered, F.lit(None))
        .when(same & (X.normalize(F.col("caption")) != X.normalize(F.col("text"))), "guarded")
        .when(same, "agreed")
        .when(F.trim("text") == "", "recovered")
        .otherwise("rewritten")
    )
    return joined.withColumn("outcome", outcome).withColumn("fused", F.when(same, F.col("text")).otherwise(F.col("fused"))).drop("caption")


def audio_outcomes(fused: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of what became of each key's speech regions."""
    speech = F.col("kind") == "speech"
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return fused.groupBy(*keys).agg(
        F.count_if(speech).alias("speech_regions"),
        F.count_if(F.col("outcome").isNotNull()).alias("regions_covered"),
        n("rewritten", "recovered").alias("regions_rewritten"),
        n("guarded").alias("regions_guarded"),
        n("recovered").alias("regions_recovered"),
    )


def text_outcomes(fused: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of what became of each key's text cues."""
    n = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return fused.groupBy(*keys).agg(F.count("*").alias("cues"), n("corrected"), n("cosmetic"), n("guarded"))


def clauses(x: Column) -> Column:
    """A line and the clauses it may stand in on screen, three characters of normal form or more."""
    pieces = F.transform(F.concat(F.array(x), F.split(x, X.CLAUSE_END)), lambda p: F.trim(p))
    return F.filter(pieces, lambda p: F.length(X.bare_key(p)) >= 3)


def fuse_text(cues: DataFrame, captions: DataFrame, keys: Sequence[str], settings: Attribution = Attribution(), bucket_us: int = 60_000_000) -> DataFrame:
    """Text cues (``cue_id``, spans, ``text``) with ``fused`` and ``outcome`` from the lines near them in time.

    The best clause wins, of equals the first line's first; it must reach the match and keep the length.
    """
    w = settings.screen_window_us
    right = captions.select(*keys, "ordinal", (F.col("start_us") - w).alias("r_start_us"), (F.col("end_us") + w).alias("r_end_us"), F.posexplode(clauses(F.col("text"))).alias("piece", "clause"))
    pairs = joins.overlapping(cues, right, keys, bucket_us)
    score = X.ratio(X.normalize(F.col("text")), X.normalize(F.col("clause")), True)
    best = F.max(F.struct(F.col("score"), (-F.col("ordinal")).alias("o"), (-F.col("piece")).alias("p"), "clause")).alias("best")
    found = pairs.withColumn("score", score).groupBy(*keys, "cue_id").agg(best)
    joined = cues.join(found, [*keys, "cue_id"], "left")
    clause = F.col("best.clause")
    scope = F.length(X.normalize(clause)) / F.greatest(F.length(X.normalize(F.col("text"))), F.lit(1))
    usable = (F.col("best.score") >= settings.match) & (clause != F.col("text"))
    outcome = (
        F.when(~F.coalesce(usable, F.lit(False)), F.lit(None))
        .when(~scope.between(*settings.scope), "guarded")
        .when(X.normalize(clause) == X.normalize(F.col("text")), "cosmetic")
        .otherwise("corrected")
    )
    joined = joined.withColumn("outcome", outcome)
    fused = F.when(F.col("outcome").isin("cosmetic", "corrected"), clause).otherwise(F.col("text"))
    return joined.withColumn("fused", fused).drop("best")
