"""Normal forms and tokens of captions and of text read off frames.

Three forms are kept apart: ``text_key`` compares readings, ``normalize`` compares captions, ``squeezed`` keeps
punctuation. Catalyst expressions where they suffice; Unicode folding and sequence matching take Arrow batches.
"""

from __future__ import annotations

import difflib
import html
import html.entities
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges and patterns.
HAN_KANA = "぀-ヿ㐀-䶿一-鿿豈-﫿"
HANGUL = "가-힣"
BRACKETED = r"[（(\[【][^)\]）】]{0,60}[)\]）】]"
SPEAKER_DASH = r"^\s*[-–—]\s+"
MARKUP = r"<[^>]{0,40}>"
NUMBER = r"[+-]?\d+(?:[.,:/-]\d+)*"
CLAUSE_END = r"[,\.!?·]\s+|\s{2,}"
SCRIPTS = {"ko": "가-힣", "ja": "぀-ヿ", "zh": "一-鿿"}


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def text_key(x: Column) -> Column:
    """No case, spacing or punctuation, of the compatibility form.

    Texts of ASCII and Latin-1 letters, which have no other such form, stay in the JVM; the rest take Arrow batches.
    """
    plain = x.rlike(r"^[\x00-\x7F\u00C0-\u00FF]*$")
    return F.when(plain | x.isNull(), F.lower(F.regexp_replace(x, r"(?U)[^\w]+", ""))).otherwise(_mapped(F.when(~plain, x), key_of))


def bare_key(x: Column) -> Column:
    """``text_key`` of what is in its compatibility form already; Catalyst alone."""
    return F.lower(F.regexp_replace(x, r"(?U)[^\w]+", ""))


def strip_conventions(x: Column) -> Column:
    """Without bracketed asides and a leading speaker's dash."""
    return squeezed(F.regexp_replace(F.regexp_replace(x, BRACKETED, " "), SPEAKER_DASH, ""))


def number_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0))


def tokens(x: Column) -> Column:
    """Words, runs of Hangul, and single characters of Han and Kana."""
    word = rf"[^\W{HAN_KANA}{HANGUL}]+"
    return F.regexp_extract_all(x, F.lit(rf"(?U)[{HAN_KANA}]|[{HANGUL}]+|{word}(?:['’]{word})*"), F.lit(0))


def entities(x: Column) -> Column:
    """A text with its character references read: all that HTML names, and numbers; ``&amp;`` last, so none is read twice."""
    known = F.from_json(F.lit(json.dumps({n: c for n, c in html.entities.html5.items() if n.endswith(";")})), "map<string,string>")
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"&(#[0-9]{1,7};|#[xX][0-9A-Fa-f]{1,6};|[A-Za-z][A-Za-z0-9]*;)"), F.lit(1)))
    ordered = F.concat(F.filter(found, lambda n: n != "amp;"), F.filter(found, lambda n: n == "amp;"))

    def char(n: Column) -> Column:
        code = F.when(F.lower(F.substring(n, 2, 1)) == "x", F.regexp_extract(n, r"^#[xX](\w+);", 1)).otherwise(F.conv(F.regexp_extract(n, r"^#(\d+);", 1), 10, 16))
        return F.when(F.startswith(n, F.lit("#")), F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")).otherwise(F.try_element_at(known, n))

    return F.aggregate(ordered, x, lambda text, n: F.replace(text, F.concat(F.lit("&"), n), F.coalesce(char(n), F.concat(F.lit("&"), n))))


def clean_text(x: Column) -> Column:
    """Display markup out, character references and spaces resolved."""
    return squeezed(F.regexp_replace(F.replace(entities(x), F.lit("\u00a0"), F.lit(" ")), MARKUP, ""))


def script_share(x: Column, language: Column) -> Column:
    """Share of letters in the language's own script; null where the language has none of its own, 0 without letters."""
    base = F.element_at(F.split(F.replace(F.lower(F.coalesce(language, F.lit(""))), F.lit("_"), F.lit("-")), "-"), 1)
    out = F.when(F.lit(False), F.lit(0.0))
    for code, letters in SCRIPTS.items():
        own = F.length(F.regexp_replace(x, f"[^{letters}]", ""))
        every = F.length(F.regexp_replace(x, rf"[^\p{{L}}{letters}]", ""))
        out = out.when(base == code, F.when(every > 0, own / every).otherwise(0.0))
    return out


def adds_numbers(candidate: Column, reference: Column) -> Column:
    """Whether a candidate has a number that the reference's numbers, read in order, do not."""
    kept = number_tokens(reference)
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))

    def step(s, x):
        rest = F.slice(kept, s["at"] + 1, F.greatest(F.size(kept) - s["at"], F.lit(0)))
        found = F.array_position(rest, x).cast("int")
        return F.struct((s["at"] + found).alias("at"), (s["ok"] & (found > 0)).alias("ok"))

    return ~F.aggregate(number_tokens(candidate), start, step, lambda s: s["ok"])


def extends_by_digit(base: Column, extended: Column) -> Column:
    """Whether ``extended`` adds one digit at an edge of a reading of four characters or more without numbers."""
    a, b = text_key(base), text_key(extended)
    right = F.startswith(b, a) & F.substring(b, -1, 1).rlike(r"^\d$")
    left = F.endswith(b, a) & ~F.startswith(b, a) & F.substring(b, 1, 1).rlike(r"^\d$")
    return (F.length(a) >= 4) & (F.size(number_tokens(base)) == 0) & (F.length(b) == F.length(a) + 1) & (right | left)


# ---- plain Python forms, and Arrow functions over them


def nfkc_text(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


def key_of(text: str) -> str:
    return re.sub(r"[^\w]+", "", nfkc_text(text).lower())


def normal_of(text: str) -> str:
    """Compatibility form, word characters alone, case folded."""
    return re.sub(r"[^\w]", "", unicodedata.normalize("NFKC", text)).casefold()


def numbers_of(text: str) -> list[str]:
    return re.findall(NUMBER, nfkc_text(text))


def ratio_of(a: str, b: str, autojunk: bool) -> float:
    """Similarity by matching blocks; it isn't symmetric, and ``autojunk`` tells from 200 characters on."""
    return difflib.SequenceMatcher(None, a, b, autojunk).ratio()


def reaches(a: str, b: str, least: float) -> bool:
    """Whether the similarity is at least ``least``; its cheap upper bounds are asked first."""
    share = lambda n: 2.0 * n / (len(a) + len(b)) if a or b else 1.0
    # the matcher indexes a whole text before it can tell its own bounds
    if share(min(len(a), len(b))) < least or share((Counter(a) & Counter(b)).total()) < least:
        return False
    return difflib.SequenceMatcher(None, a, b, False).ratio() >= least


def _taken_apart(key: str) -> str:
    """Letters and marks of their own: syllable blocks that differ in one letter are alike only so."""
    return unicodedata.normalize("NFD", key)


@lru_cache(maxsize=8192)
def _forms(text: str) -> tuple[str, list[str]]:
    return key_of(text), numbers_of(text)


@lru_cache(maxsize=8192)
def same_text_of(a: str, b: str, least: float) -> bool:
    """Whether two readings are of one text: equal numbers, and keys that are equal or, from four characters on, alike."""
    (*keys,), (*numbers,) = zip(_forms(a), _forms(b), strict=True)
    if numbers[0] != numbers[1] or (keys[0] != keys[1] and min(map(len, keys)) < 4):
        return False
    tries = ((str, least), (_taken_apart, max(0.85, least)))
    return keys[0] == keys[1] or any(reaches(*map(form, keys), bar) for form, bar in tries)


def _mapped(x: Column, change: Callable[[str], str]) -> Column:
    """A string function over Arrow batches; built when called, as workers import this module without a session."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else change(t))

    return run(x)


def nfkc(x: Column) -> Column:
    return _mapped(x, nfkc_text)


def normalize(x: Column) -> Column:
    return _mapped(x, normal_of)


def ratio(a: Column, b: Column, autojunk: bool) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ratio_of(p, q, autojunk) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def token_ratio(a: Column, b: Column) -> Column:
    """The same over arrays of tokens, cases folded."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        fold = lambda t: [w.casefold() for w in t]
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, fold(p), fold(q)).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def same_text(a: Column, b: Column, least: float = 0.8) -> Column:
    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p is not None and q is not None and same_text_of(p, q, least) for p, q in zip(x, y, strict=True)])

    return run(a, b)
