"""Language identification by Bayesian evidence fusion.

The posterior of a language given a row is the product of a text likelihood, the declared markup language,
the address suffix and the host's prior, normalised:

* text: hashed byte-trigram multinomials, fitted on a bounded sample of the rows of each declared language and
  applied to whole texts; the log-likelihood ratio is tempered, as neighbouring trigrams are not independent.
  What a profile leaves to trigrams it hasn't seen is the share of its own that it saw once;
* declaration and address: a symmetric confusion, right with a fixed probability;
* host: counts of the text's own best language by host, its parent domain, and all rows, each level smoothed
  by the one above it and without the row itself, whose text is evidence already. The counts come from grouped
  aggregation over all rows, so a host with a third of all rows is summed before the shuffle; rows of such
  hosts meet their prior in several tasks.

``und`` is a class of its own for texts of languages without a profile: all trigrams alike, with a part of
the mean of all profiles. Its rows are never kept.

Defined results: a null or empty text gives equal text likelihoods and the other evidence decides; without
any evidence the global prior does. A null host takes the global prior. Where no row declares a language,
nothing can be told: every row is ``und`` at 0 and kept, as there is nothing to reject it by. An empty table
gives an empty result; repeated rows get equal results. Columns of any names may stand beside; those called
``language``, ``posterior`` and ``kept`` are replaced by ``identify``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from .shared import sliced, stash, texts_of

SLOTS = 1 << 16
BLOCK = 4 << 20
UNKNOWN = "und"
#: Part of the mean of all profiles in the class for other languages; the rest is all trigrams alike.
ANYONES = 0.1
#: Rows of a host of at least this part of all are dealt to several tasks; there are as many such hosts at most.
HOT_SHARE = 1 / 200


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    weights: np.ndarray  # SLOTS x languages, log-probabilities


@dataclass(frozen=True)
class Settings:
    """Bounds of the fitting sample and the strengths of each kind of evidence."""

    sample_rows: int = 2000
    sample_chars: int = 4000
    temper: float = 0.2
    declared_right: float = 0.9
    suffix_right: float = 0.95
    smoothing: float = 20.0
    least: float = 0.6


def _slots(data: np.ndarray) -> np.ndarray:
    """A slot for each byte trigram that starts at a byte; the last two wrap and are dropped by callers."""
    x = data.astype(np.uint32)
    key = x[:-2] * np.uint32(65536) + x[1:-1] * np.uint32(256) + x[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)


def _drawn_by_language(labelled: DataFrame, settings: Settings) -> DataFrame:
    """``l`` and ``t`` of at most an equal part of ``sample_rows`` distinct rows of each language, 20 at least.

    Rows are drawn by a hash of their columns. Those of each language are first thinned to about twice as many,
    the one of least hash always among them, so that none is without a row and few are shuffled.
    """
    range_ = 1 << 40
    hashed = labelled.withColumn("__h", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in labelled.columns)), F.lit(range_)))
    sizes = stash(hashed.groupBy("l").agg(F.approx_count_distinct("__h").alias("n"), F.min("__h").alias("least")), "language-sizes")
    each = max(20, -(-settings.sample_rows // max(sizes.count(), 1)))
    bounds = sizes.select(F.col("l").alias("__l"), F.greatest("least", (F.least(F.lit(1.0), 2.0 * each / F.col("n")) * range_).cast("long")).alias("__most"))
    thinned = hashed.join(bounds, F.col("l") == F.col("__l")).where("__h <= __most").groupBy("l", "__h").agg(F.min(F.substring("t", 1, settings.sample_chars)).alias("t"))
    return thinned.withColumn("__i", F.row_number().over(Window.partitionBy("l").orderBy("__h"))).where(F.col("__i") <= each).select("l", "t")


def fit(docs: DataFrame, text: str, declared: str, settings: Settings = Settings()) -> Profiles:
    """Trigram profiles of all languages that rows with text declare, each from rows of its own."""
    labelled = docs.select(F.col(f"`{text}`").alias("t"), F.lower(F.col(f"`{declared}`")).alias("l")).where((F.length(F.trim("t")) > 0) & (F.col("l") != UNKNOWN))
    texts: dict[str, list[str]] = {}
    for r in _drawn_by_language(labelled, settings).collect():
        texts.setdefault(r.l, []).append(r.t)
    known = tuple(sorted(texts))
    shares, unseen = np.empty((SLOTS, len(known))), np.empty(len(known))
    for i, language in enumerate(known):
        counts = np.zeros(SLOTS)
        for t in texts[language]:
            counts += np.bincount(_slots(_bytes(t)), minlength=SLOTS)
        total = max(counts.sum(), 1.0)
        unseen[i] = min(0.5, max((counts == 1).sum(), 1) / total)
        shares[:, i] = counts / total
    weights = np.empty((SLOTS, len(known) + 1), np.float32)
    weights[:, :-1] = np.log((1 - unseen) * shares + unseen / SLOTS)
    weights[:, -1] = np.log(ANYONES * (shares.mean(1) if known else 1 / SLOTS) + (1 - ANYONES) / SLOTS)
    return Profiles((*known, UNKNOWN), weights)


def _batch_scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Summed log-probabilities of each text's trigrams, the texts taken in blocks of bounded bytes."""
    out = np.zeros((len(texts), weights.shape[1]), np.float64)
    pending: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if pending:
            joined = np.concatenate([x for _, x in pending])
            slots = _slots(joined)
            starts = np.cumsum([0, *(len(x) for _, x in pending)])
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                out[pending[i][0]] += weights[slots[a : b - 2]].sum(0, dtype=np.float64)

    for i, text in enumerate(texts):
        data = _bytes(text)
        for at in range(0, max(len(data) - 2, 0), BLOCK):
            part = data[at : at + BLOCK + 2]
            pending.append((i, part))
            size += len(part)
            if size >= BLOCK:
                flush()
                pending, size = [], 0
    flush()
    return out


def log_likelihoods(docs: DataFrame, text: str, profiles: Profiles, settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``__ll``: the tempered log-likelihood of each language, 0 for the likeliest,
    and ``__best``: the number of the language that the text tells from all others, if it does."""
    weights, temper = profiles.weights, settings.temper
    source = docs if keep is None else docs.select(*(F.col(f"`{k}`") for k in dict.fromkeys([*keep, text])))
    names = [n for n in source.columns if keep is None or n in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = texts_of(batch.column(text))
            scores = _batch_scores(texts, weights) * temper
            scores[[not x.strip() for x in texts]] = 0
            if len(scores):
                scores -= scores.max(1, keepdims=True)
            flat = pa.array(scores.ravel(), pa.float64())
            ll = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * weights.shape[1], pa.int32()), flat)
            sure = (scores > -2.0).sum(1) == 1
            best = pa.array(scores.argmax(1) if len(scores) else [], pa.int32(), mask=~sure)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ll, best], [*names, "__ll", "__best"])

    fields = source.select(*(F.col(f"`{n}`") for n in names)).schema
    return source.mapInArrow(run, StructType([*fields.fields]).add("__ll", ArrayType(DoubleType())).add("__best", IntegerType()))


def parent_domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _own(host: str, i: int) -> Column:
    """1.0 where a row counts for language ``i`` of its host."""
    return F.when(F.col(host).isNotNull() & (F.col("__best") == i), 1.0).otherwise(0.0)


def host_counts(scored: DataFrame, host: str, languages: tuple[str, ...]) -> tuple[DataFrame, list[float], dict[str, int]]:
    """(``__host``, ``__c``, ``__d`` and their sums: rows of each language of the host and of its parent domain; those of all rows;
    the number of tasks for the rows of each hot host)."""
    k = len(languages)
    counts = scored.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("__n"), *(F.sum(_own(host, i)).alias(f"__c{i}") for i in range(k)))
    counts = stash(counts, "host-counts")
    domains = counts.groupBy(parent_domain(F.col("__host")).alias("__domain")).agg(*(F.sum(f"__c{i}").alias(f"__d{i}") for i in range(k)))
    domains = stash(domains, "domain-counts")
    row = domains.agg(*(F.sum(f"__d{i}").alias(f"g{i}") for i in range(k))).first()
    rows = counts.agg(F.sum("__n")).first()[0] or 0
    hot = {r["__host"]: int(-(-r["__n"] // max(1, int(HOT_SHARE * rows)))) for r in counts.where(F.col("__n") > HOT_SHARE * rows).select("__host", "__n").collect()}
    found = counts.join(domains, parent_domain(F.col("__host")) == F.col("__domain"))
    lists = {level: F.array(*(f"{level}{i}" for i in range(k))) for level in ("__c", "__d")}
    totals = {f"{level}_all": sum((F.col(f"{level}{i}") for i in range(k)), F.lit(0.0)) for level in lists}
    found = found.select("__host", *(x.alias(n) for n, x in (lists | totals).items()))
    return stash(found, "host-levels"), [row[f"g{i}"] or 0.0 for i in range(k)], hot


def _evidence(value: Column, i: int, languages: tuple[str, ...], right: float) -> Column:
    """log P(value | language i); 0 where the value is missing or names no profiled language. ``und`` is anyone's."""
    known = [x for x in languages if x != UNKNOWN]
    if languages[i] == UNKNOWN:
        return F.when(value.isin(*known), float(np.log(1 / max(len(known), 1)))).otherwise(0.0)
    wrong = (1 - right) / max(len(known) - 1, 1)
    return F.when(value == languages[i], float(np.log(right))).when(value.isin(*known), float(np.log(max(wrong, 1e-9)))).otherwise(0.0)


def _parts(host: Column, hot: dict[str, int]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair)) if hot else None
    return F.coalesce(F.try_element_at(table, host), F.lit(1)) if hot else F.lit(1)


def fuse(scored: DataFrame, levels: DataFrame | None, overall: list[float], hot: dict[str, int], languages: tuple[str, ...], declared: str | None, suffix: str | None, host: str | None, settings: Settings = Settings()) -> DataFrame:
    """Add ``__language``, ``__posterior`` and ``__kept`` from all the evidence; Catalyst expressions alone."""
    k, a = len(languages), settings.smoothing
    own = [_own(host, i) for i in range(k)] if host else [F.lit(0.0)] * k
    mine = F.when(F.col(host).isNotNull() & F.col("__best").isNotNull(), 1.0).otherwise(0.0) if host else F.lit(0.0)
    prior = [(overall[i] + 1 - own[i]) / (sum(overall) + k - mine) for i in range(k)]
    if host:
        dealt = scored.withColumn("__part", F.pmod(F.xxhash64("__row"), _parts(F.col(host), hot)))
        spread = levels.withColumn("__at", F.explode(F.sequence(F.lit(0), _parts(F.col("__host"), hot) - 1)))
        joined = dealt.join(spread, (F.col(host) == F.col("__host")) & (F.col("__part") == F.col("__at")), "left")
        for level in ("__d", "__c"):
            prior = [F.when(F.col(level).isNull(), prior[i]).otherwise((F.col(level)[i] - own[i] + a * prior[i]) / (F.col(f"{level}_all") - mine + a)) for i in range(k)]
    else:
        joined = scored
    logs = [F.col("__ll")[i] + F.log(prior[i]) for i in range(k)]
    for name, right in ((declared, settings.declared_right), (suffix, settings.suffix_right)):
        if name:
            logs = [x + _evidence(F.lower(F.col(name)), i, languages, right) for i, x in enumerate(logs)]
    names = F.array(*(F.lit(x) for x in languages))

    def told(log: Column) -> Column:
        best = F.element_at(names, F.array_position(log, F.array_max(log)).cast("int"))
        if k == 1:
            return F.struct(best.alias("language"), F.lit(0.0).alias("posterior"), F.lit(True).alias("kept"))
        posterior = _let(F.array_max(log), lambda top: 1 / F.aggregate(log, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
        return _let(posterior, lambda p: F.struct(best.alias("language"), p.alias("posterior"), ((p >= settings.least) & (best != UNKNOWN)).alias("kept")))

    verdict = joined.withColumn("__told", _let(F.array(*logs), told))
    return verdict.select("*", F.col("__told.language").alias("__language"), F.col("__told.posterior").alias("__posterior"), F.col("__told.kept").alias("__kept"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _identified(docs: DataFrame, text: str, declared: str | None, suffix: str | None, host: str | None, settings: Settings, profiles: Profiles | None, keep: list[str]) -> DataFrame:
    """``__row`` (the columns ``keep``), ``__language``, ``__posterior`` and ``__kept``.

    The row travels as one struct, so that its columns' names cannot clash with the evidence's. The text is read
    twice, once for the host counts and once for the verdicts: sending whole texts through a shuffle to save the
    second pass would cost more.
    """
    lone = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    if profiles is None and declared is None:
        raise ValueError("without profiles a column must declare languages to fit them on")
    profiles = profiles or fit(docs, text, declared, settings)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("__row"), lone(text).alias("__text"), lone(declared).alias("__declared"), lone(suffix).alias("__suffix"), lone(host).cast("string").alias("__of"))
    levels, overall, hot = None, [0.0] * len(profiles.languages), {}
    if host:
        levels, overall, hot = host_counts(log_likelihoods(packed, "__text", profiles, settings, ["__of"]), "__of", profiles.languages)
    scored = log_likelihoods(packed, "__text", profiles, settings, ["__row", "__declared", "__suffix", "__of"])
    return fuse(scored, levels, overall, hot, profiles.languages, "__declared" if declared else None, "__suffix" if suffix else None, "__of" if host else None, settings)


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", suffix: str | None = None, host: str | None = "source", settings: Settings = Settings(), profiles: Profiles | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``language``, ``posterior`` and ``kept``."""
    wanted = [c for c in (docs.columns if keep is None else keep) if c not in ("language", "posterior", "kept")]
    found = _identified(docs, text, declared, suffix, host, settings, profiles, wanted)
    return found.select(*(F.col(f"__row.`{c}`").alias(c) for c in wanted), F.col("__language").alias("language"), F.col("__posterior").alias("posterior"), F.col("__kept").alias("kept"))


def keep_identified(docs: DataFrame, text: str = "text", declared: str | None = "lang", suffix: str | None = None, host: str | None = "source", settings: Settings = Settings(), write_to: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is certain enough, with their columns; ``write_to`` is set to the language."""
    found = _identified(docs, text, declared, suffix, host, settings, None, docs.columns).where("__kept")
    return found.select(*(F.col("__language").alias(c) if c == write_to else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


#: Parts of an address that name a language.
SUFFIX_LANGUAGES = {"de": "de", "at": "de", "en": "en", "uk": "en", "us": "en", "es": "es", "mx": "es", "fr": "fr", "be": "fr"}


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages with ``text`` (markup taken out), ``declared``, ``suffix`` and ``host`` from markup and address."""
    page = F.coalesce(F.col(html), F.lit(""))
    plain = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"://([^/?#]*)", 1))
    table = F.create_map(*(F.lit(x) for pair in SUFFIX_LANGUAGES.items() for x in pair))
    segment = F.lower(F.regexp_extract(address, r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    last = F.substring_index(host, ".", -1)
    return pages.select(
        "*",
        plain.alias("__plain"),
        F.nullif(F.lower(declared), F.lit("")).alias("__declared"),
        F.coalesce(F.try_element_at(table, segment), F.try_element_at(table, last)).alias("__suffix"),
        F.nullif(host, F.lit("")).alias("__address_host"),
    )
