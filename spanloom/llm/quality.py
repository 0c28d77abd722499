"""Quality rules as a short-circuit cascade.

``plan`` measures the rules on a bounded sample drawn from all rows and orders them greedily: next comes the
rule that rejects the most of the sampled texts that are still there for the seconds it takes, given what
earlier rules have worked out of them already. ``judge`` applies the rules in that order to each whole text and
stops at the first one that rejects. The verdict is the conjunction of all rules, so the order changes the cost
alone.

Defined results: a null text counts as an empty one; an empty text has no words and fails ``few_words``;
repeated rows get equal verdicts; an empty table gives an empty result. Other columns pass through
``judge`` untouched, whatever their names.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drawn, sliced

# Fixed values of the contract.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Thresholds of the method's own rules.
MAX_SYMBOLS_PER_10_WORDS = 3
MAX_WORD_CHARS = 20
MIN_ALPHA_PERCENT = 60
MAX_BULLET_PERCENT = 90
MAX_ELLIPSIS_PERCENT = 30
MAX_TOP_PAIR_PERCENT = 20
MIN_STOP_WORDS = 2
BULLETS = ("-", "*", "•", "‣", "▪", "◦")
ELLIPSES = ("...", "…")
# Common short words of the languages at hand.
STOP_WORDS = frozenset(
    "the be to of and that have with in is it for on at by as was are this from or an not "
    "le la les de des et un une est que qui dans pour pas sur en au ce il ne se avec "
    "der die das und ist nicht ein eine zu den mit von auf für im dem es sich auch "
    "el los las y es una del por con para su lo no al como más pero".split()
)


class Text:
    """What the rules read of a text, each computed at most once and only when asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def symbols(self) -> int:
        return len(SYMBOL.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def alpha_words(self) -> int:
        return sum(1 for w in self.words if w[0].isalpha() or w[-1].isalpha() or any(map(str.isalpha, w)))

    @cached_property
    def stop_words(self) -> int:
        """Stop words, counted no further than the rule needs."""
        found = 0
        for w in self.words:
            found += w.lower() in STOP_WORDS
            if found >= MIN_STOP_WORDS:
                break
        return found

    @cached_property
    def bullet_lines(self) -> int:
        return sum(1 for x in self.lines if x.lstrip(" \t").startswith(BULLETS))

    @cached_property
    def ellipsis_lines(self) -> int:
        return sum(1 for x in self.lines if x.rstrip(" \t\r").endswith(ELLIPSES))

    @cached_property
    def top_pair_words(self) -> int:
        """Words in the most frequent pair of neighbours, all its places counted; 0 where it is there once, or where
        no word is frequent enough for its pairs to matter."""
        words = self.words
        if 200 * max(Counter(words).values(), default=0) <= MAX_TOP_PAIR_PERCENT * len(words):
            return 0
        most = max(Counter(zip(words, words[1:], strict=False)).values(), default=0)
        return 2 * most if most > 1 else 0

    @cached_property
    def dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def repeat_words(self) -> int:
        """Words covered by three-word windows that occur twice or more."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        covered, end = 0, 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


RULES = (
    Rule("few_words", lambda t: len(t.words) < MIN_WORDS),
    Rule("repeated_windows", lambda t: 100 * t.repeat_words > MAX_REPEAT_PERCENT * len(t.words)),
    Rule("symbols", lambda t: 10 * t.symbols > MAX_SYMBOLS_PER_10_WORDS * len(t.words)),
    Rule("shouting", lambda t: 2 * len(UPPER.findall(t.text)) > t.word_chars),
    Rule("exclamations", lambda t: 2 * t.text.count("!") > len(t.words)),
    Rule("duplicate_lines", lambda t: 2 * t.dup_lines > len(t.lines)),
    Rule("long_words", lambda t: t.word_chars > MAX_WORD_CHARS * len(t.words)),
    Rule("few_alphabetic", lambda t: 100 * t.alpha_words < MIN_ALPHA_PERCENT * len(t.words)),
    Rule("bullets", lambda t: 100 * t.bullet_lines > MAX_BULLET_PERCENT * len(t.lines)),
    Rule("ellipses", lambda t: 100 * t.ellipsis_lines > MAX_ELLIPSIS_PERCENT * len(t.lines)),
    Rule("no_stop_words", lambda t: t.stop_words < MIN_STOP_WORDS),
    Rule("one_pair", lambda t: 100 * t.top_pair_words > MAX_TOP_PAIR_PERCENT * len(t.words)),
)


@dataclass(frozen=True)
class Measured:
    """A rule's mean seconds on the texts that reached it, and the share of them that it rejected."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def measure(alive: list[Text], rule: Rule) -> Measured:
    """A rule on copies of texts, so that what earlier rules have worked out costs nothing and nothing is added."""
    copies = []
    for t in alive:
        copy = Text(t.text)
        copy.__dict__.update(t.__dict__)
        copies.append(copy)
    began = time.perf_counter()
    rejected = sum(rule.rejects(t) for t in copies)
    seconds = time.perf_counter() - began
    return Measured(rule, seconds / max(len(alive), 1), rejected / max(len(alive), 1))


def ordered(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[Measured]:
    """The rules in the order of the cascade: always the one of most worth for what is still alive; rules that
    reject nothing of it come last, the cheapest first."""
    alive, left, out = [Text(x) for x in texts], list(rules), []
    while left:
        tried = [measure(alive, r) for r in left]
        best = max(tried, key=lambda m: (m.worth, -m.seconds))
        out.append(best)
        left.remove(best.rule)
        alive = [t for t in alive if not best.rule.rejects(t)]
    return out


def plan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 200, sample_chars: int = 50_000) -> tuple[Rule, ...]:
    """The rules in order. ``sample_rows`` rows are drawn by hash from all rows, and at most ``sample_chars``
    characters of each are read for it, so the driver holds at most their product."""
    rows = drawn(docs.select(F.col(f"`{text}`").alias("x")), sample_rows).select(F.substring("x", 1, sample_chars).alias("x")).collect()
    return tuple(m.rule for m in ordered([r.x for r in rows], rules))


def _batches(names: list[str], make: Callable[[str | None], tuple], text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [make(x) for x in batch.column(text).to_pylist()]
            columns = [pa.array(c) for c in zip(*made, strict=True)] if made else [pa.array([], pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n in names]
            rest = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *columns], [*rest, *names])

    return run


def profile(docs: DataFrame, order: tuple[Rule, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every text and the cascade's verdict, in whole texts.

    The two base rules come first because their counts are wanted anyway; the rest of the cascade runs on
    what they pass."""
    rest = tuple(r for r in order if r.name not in ("few_words", "repeated_windows"))

    def make(x: str | None) -> tuple:
        t = Text(x)
        n, repeated = len(t.words), t.repeat_words
        failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
        kept = not failed and not any(r.rejects(t) for r in rest)
        return n, t.word_chars, t.symbols, t.dup_lines, repeated, failed, kept

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    source = docs.select(F.col(key), F.col(text))
    kind = dict(source.dtypes)[key]
    schema = f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return source.mapInArrow(_batches(names, make, text), schema)


def judge(docs: DataFrame, order: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no rule rejects, with their columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept = [not any(r.rejects(t) for r in order) for t in map(Text, batch.column(text).to_pylist())]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
