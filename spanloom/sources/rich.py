"""Results of a speech recogniser that marks its text with ``<|tags|>``: segments, languages, moods and sounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that name a language, a mood, or nothing that is heard.
LANGUAGES = ("zh", "en", "yue", "ja", "ko", "nospeech")
MOODS = ("happy", "sad", "angry", "neutral", "emo_unk", "emo_unknown")
NO_SOUND = (*LANGUAGES, *MOODS, "withitn", "woitn")
TAG = r"<\|([^|]+)\|>"
#: One result, or a list of them.
RESULTS = "array<struct<text:string,raw_text:string,sentence_info:array<struct<start:double,end:double,text:string,raw_text:string>>>>"


def decoded(raw: Column) -> Column:
    """``language``, ``emotion``, ``events`` and plain ``text`` of a marked-up line.

    The first tag of each vocabulary counts, in any case; what is in neither is a sound, named as it was written.
    """
    tags = F.regexp_extract_all(raw, F.lit(TAG), F.lit(1))
    first = lambda names: F.try_element_at(F.filter(F.transform(tags, F.lower), lambda t: t.isin(*names)), F.lit(1))
    return F.struct(
        F.coalesce(first(LANGUAGES), F.lit("unknown")).alias("language"),
        first(MOODS).alias("emotion"),
        F.filter(tags, lambda t: ~F.lower(t).isin(*NO_SOUND)).alias("events"),
        F.trim(F.regexp_replace(raw, TAG, "")).alias("text"),
    )


def pieces(text: Column) -> Column:
    """A text cut before each run of tags; what stands before the first run is left out."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(?:<\|[^|]+\|>)+.*?(?=<\|[^|]+\|>|$)"), F.lit(0)), lambda x: F.trim(x))


def segments(results: DataFrame, payload: str = "payload", duration_us: str = "duration_us") -> DataFrame:
    """``results`` with one row for each sentence of a JSON payload: ``ordinal``, span, ``raw_text`` and what it decodes to.

    Sentences take the pieces of the whole text in order, else their own; a result without sentences is one
    segment over the whole duration. A payload that isn't JSON gives no row.
    """
    body = F.when(F.ltrim(F.col(payload)).startswith("["), F.col(payload)).otherwise(F.concat(F.lit("["), F.col(payload), F.lit("]")))
    items = results.withColumn("__r", F.explode(F.from_json(body, RESULTS))).where("__r is not null")
    whole = F.coalesce(F.col("__r.text"), F.lit(""))
    nonempty = lambda *xs: F.coalesce(*(F.when(x != "", x) for x in xs), F.lit(""))
    us = lambda ms: F.round(F.coalesce(ms, F.lit(0.0)) * 1000).cast("long")
    each = F.transform("__r.sentence_info", lambda s, i: F.struct(us(s["start"]).alias("start_us"), us(s["end"]).alias("end_us"), nonempty(F.get(pieces(whole), i), s["raw_text"], s["text"]).alias("raw_text")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("start_us"), F.col(duration_us).cast("long").alias("end_us"), nonempty(F.col("__r.raw_text"), whole).alias("raw_text")))
    out = items.select(*results.columns, F.posexplode(F.when(F.size("__r.sentence_info") > 0, each).otherwise(one)).alias("ordinal", "__s"))
    return out.select(*results.columns, "ordinal", "__s.*", decoded(F.col("__s.raw_text")).alias("__d")).select("*", "__d.*").drop("__d")
