"""Replace personal data by keyed surrogates of the same type and format.

``entities`` finds e-mail addresses, telephone numbers (international, North American, and national ones that
begin with 0), IPv4 and IPv6 addresses, payment card numbers with a right check digit, bank account and social
security numbers, dates of birth that are called so, access keys, assigned secrets, and names that follow a form
of address. Later mentions of a name in the same text, in full or by its last word, are the same person. A value
that is assigned to a secret's name but has a shape of its own (an access key, an address) is of that type, so one
value is one entity wherever it stands. Postal addresses and names without a form of address aren't looked for.

A surrogate is drawn from a keyed digest of the entity's type and normal form, so one entity has one surrogate
in every document and run (coreference), and keeps the format: digits for digits, letters for letters of the
same case and script, the same separators, a valid check digit where there was one, addresses of one domain in
one domain, and for names the gender that the forms of address of all texts or the ending tell. A name's title is
no part of it. Numbers of fixed length go through a keyed permutation of their format, so two of them never draw
the same at one attempt.

Distinctness is checked over the whole table: entities are grouped, and any that draws a surrogate that
another entity draws, or that is itself an entity of the table, draws again until none is left. ``assign`` raises
after ``rounds`` attempts, which only a format with hardly any value free can need.

Defined results: null and empty texts stay as they are; repeated rows get equal texts; an entity that
occurs twice, in one text or several, gets one surrogate; an empty table gives an empty result. Other
columns pass through untouched, whatever their names; a column called as ``count`` is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .shared import free, sliced, stash, texts_of

# Forms of address and the gender they tell ("" for none).
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "",
    "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f",
    "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
# Syllables of invented names by script, and endings by script and gender.
SYLLABLES = {
    "latin": ["ba", "de", "ri", "mo", "la", "ne", "su", "ti", "ka", "vo", "fe", "lu", "ma", "ro", "se", "ni"],
    "cyrillic": ["ба", "де", "ри", "мо", "ла", "не", "су", "ти", "ка", "во", "фе", "лу", "ма", "ро", "се", "ни"],
    "greek": ["βα", "δε", "ρι", "μο", "λα", "νε", "σο", "τι", "κα", "φο", "φε", "λο", "μα", "ρο", "σε", "νι"],
}
ENDINGS = {
    "latin": {"m": "rd", "f": "ra", "": "n"},
    "cyrillic": {"m": "в", "f": "ва", "": "н"},
    "greek": {"m": "ς", "f": "η", "": "ν"},
}

_UPPER = sorted({t.upper() for t in TITLES} - {"MS", "DON"})
#: Only lines that match this are looked at more closely; no entity reaches over a line's end.
_HINT = re.compile(r"[0-9@=:]|AKIA|ASIA|(?:gh[pos]|xox[bp]|sk|pk)[_-]|\b(?:" + "|".join(map(re.escape, [*TITLES, *_UPPER])) + r")\b")

_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:ghp|gho|ghs|xoxb|xoxp|sk|pk)[_-][A-Za-z0-9_-]{16,}"
_EMAIL = r"[\p{L}\p{N}_%+-]+(?:\.[\p{L}\p{N}_%+-]+)*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Earlier alternatives win at one place, so assigned secrets come before the shapes they may contain.
_ENTITY = regex.compile(
    r"""
    (?P<secret>(?i:\b(?:password|passwd|pwd|secret|token|api_?key|secret_?key|access_?key))["']?[ \t]*[=:][ \t]*["']?(?P<value>[^\s"',;]{6,}))
  | (?P<key>"""
    + _KEY
    + r""")
  | (?P<email>"""
    + _EMAIL
    + r""")
  | (?P<ip>(?<![\d.])(?:"""
    + _OCTET
    + r"""\.){3}"""
    + _OCTET
    + r"""(?![\d]|\.\d))
  | (?P<ip6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
  | (?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
  | (?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d]|-\d))
  | (?P<born>(?i:\b(?:born(?:[ ]on)?|date[ ]of[ ]birth|d\.?o\.?b\.?|geboren(?:[ ]am)?|née?[ ]le|nacid[oa][ ]el))[ :]{1,3}(?P<date>\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})(?!\d)|\d{4}-\d{2}-\d{2}(?!\d)))
  | (?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])
      |(?<![\w.,/-])0\d{1,4}[ /-]\d{5,8}(?![\d-]|[.,]\d)|(?<![\w.,/-])0\d(?:[ .]\d{2}){4}(?![\d-]|[.,]\d))
  | (?P<hex>(?<![0-9A-Za-z])(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}(?![0-9A-Za-z]))
  | (?P<name>\b(?:(?P<title>"""
    + "|".join(sorted(map(regex.escape, TITLES), key=len, reverse=True))
    + r""")\.?[ ](?P<who>\p{Lu}\p{L}+(?:[ -]\p{Lu}\p{L}+){0,2})|(?P<TITLE>"""
    + "|".join(sorted(map(regex.escape, _UPPER), key=len, reverse=True))
    + r""")\.?[ ](?P<WHO>\p{Lu}{2,}(?:[ -]\p{Lu}{2,}){0,2}))\b)
    """,
    regex.VERBOSE,
)
_OWN_SHAPE = {"key": regex.compile(_KEY), "email": regex.compile(_EMAIL), "ip": regex.compile(rf"(?:{_OCTET}\.){{3}}{_OCTET}")}


def _luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 == 0 else 1)
        total += x - 9 * (x > 9)
    return -total % 10


def _mod97(account: str) -> int:
    """Remainder of an account number, its letters read as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account)) % 97


def script_of(text: str) -> str:
    if regex.search(r"\p{Cyrillic}", text):
        return "cyrillic"
    return "greek" if regex.search(r"\p{Greek}", text) else "latin"


def gender_of(title: str, name: str) -> str:
    """From the form of address, else from the ending of the first word."""
    told = TITLES.get(title.rstrip("."), TITLES.get(title.rstrip(".").capitalize(), ""))
    if told:
        return told
    first = regex.split("[ -]", name)[0].lower()
    return "f" if first.endswith(("a", "а", "я", "η", "α")) else "m" if script_of(name) == "greek" and first.endswith("ς") else ""


def _matches(text: str) -> Iterator[regex.Match]:
    hint = _HINT.search(text)
    while hint:
        start, end = text.rfind("\n", 0, hint.start()) + 1, text.find("\n", hint.start())
        end = len(text) if end < 0 else end
        yield from _ENTITY.finditer(text, start, end)
        hint = _HINT.search(text, end)


@dataclass(frozen=True)
class Entity:
    """What stands from ``start`` to ``end``: its type and normal form, for names the gender told there, and whether
    it is a name's last word alone."""

    start: int
    end: int
    kind: str
    normal: str
    gender: str = ""
    last: bool = False


def _first_found(text: str) -> Iterator[Entity]:
    for m in _matches(text):
        if m["secret"]:
            value = m["value"]
            kind = next((k for k, shape in _OWN_SHAPE.items() if shape.fullmatch(value)), "secret")
            yield Entity(*m.span("value"), kind, value.lower() if kind == "email" else value)
        elif m["name"]:
            group = "who" if m["who"] else "WHO"
            who = m[group]
            yield Entity(*m.span(group), "name", f"{script_of(who)}:{' '.join(regex.split('[ -]', who.lower()))}", gender_of(m["title"] or m["TITLE"], who))
        elif m["email"] or m["ip6"]:
            yield Entity(*m.span(), "email" if m["email"] else "ip6", m[0].lower())
        elif m["born"]:
            yield Entity(*m.span("date"), "born", m["date"])
        elif m["card"]:
            digits = regex.sub(r"\D", "", m[0])
            if _luhn(digits[:-1]) == int(digits[-1]):
                yield Entity(*m.span(), "card", digits)
        elif m["phone"] or m["ssn"]:
            yield Entity(*m.span(), "phone" if m["phone"] else "ssn", regex.sub(r"\D", "", m[0]))
        elif m["iban"]:
            account = m[0].replace(" ", "")
            if _mod97(account[4:] + account[:4]) == 1:
                yield Entity(*m.span(), "iban", account)
        else:
            yield Entity(*m.span(), "key" if m["key"] else "ip" if m["ip"] else "hex", m[0])


def entities(text: str) -> list[Entity]:
    """The entities of a text in order, later mentions of its names among them. Ends are of what is replaced."""
    found = list(_first_found(text))
    names = [e for e in found if e.kind == "name"]
    if not names:
        return found
    # a lone last name is who is called so in full, if that is one person
    whole: dict[str, set[str]] = {}
    for e in names:
        if " " in e.normal:
            whole.setdefault(f"{e.normal.split(':')[0]}:{e.normal.rsplit(' ', 1)[1]}", set()).add(e.normal)
    of = {n: n for n in (e.normal for e in names)} | {k: next(iter(v)) for k, v in whole.items() if len(v) == 1}
    gender: dict[str, str] = {}
    for e in names:
        n = of[e.normal]
        gender[n] = gender.get(n) or e.gender
    found = [e if e.kind != "name" else replace(e, normal=of[e.normal], gender=gender[of[e.normal]], last=of[e.normal] != e.normal) for e in found]
    forms: dict[str, tuple[str, bool]] = {}
    for e in names:
        n, words = of[e.normal], text[e.start : e.end]
        forms[words] = forms[words.upper()] = (n, of[e.normal] != e.normal)
        for x in (regex.split("[ -]", words)[-1],):
            if len(x) > 2 and " " in n and of.get(f"{n.split(':')[0]}:{x.lower()}") == n:
                forms.setdefault(x, (n, True))
                forms.setdefault(x.upper(), (n, True))
    mention = regex.compile(r"\b(?:" + "|".join(map(regex.escape, sorted(forms, key=len, reverse=True))) + r")\b")
    taken, out = [(e.start, e.end) for e in found], list(found)
    at = 0
    for m in mention.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or taken[at][0] >= m.end():
            n, last = forms[m[0]]
            out.append(Entity(*m.span(), "name", n, gender[n], last))
    return sorted(out, key=lambda e: e.start)


class _Draws:
    """Endless keyed digits of an entity."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\x00{normal}\x00{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        self.block, self.state = 0, 0

    def below(self, n: int) -> int:
        if self.state < n << 64:
            self.block += 1
            self.state = (self.state << 256) | int.from_bytes(hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest(), "big")
        self.state, out = divmod(self.state, n)
        return out


def _same_shape(text: str, draws: _Draws) -> str:
    """Digits for digits and letters for letters of the same case; hexadecimal stays hexadecimal."""
    hexadecimal = regex.fullmatch(r"[0-9a-f]+", text) and regex.search("[a-f]", text)
    out = []
    for c in text:
        if c.isdigit():
            out.append("0123456789"[draws.below(10)])
        elif c.isalpha():
            alphabet = "abcdef" if hexadecimal else "абвгдежзиклмнопрстуфхц" if "\u0400" <= c <= "\u04ff" else "αβγδεζηθικλμνξοπρστυφχψω" if "\u0370" <= c <= "\u03ff" else "abcdefghijklmnopqrstuvwxyz"
            x = alphabet[draws.below(len(alphabet))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def permuted(key: bytes, label: str, value: int, size: int) -> int:
    """The image of ``value`` under a keyed permutation of ``range(size)``: eight rounds over two halves, walked
    on until the image is in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for i in range(8):
            digest = hmac.new(key, f"{label}\x00{i}\x00{b}".encode(), hashlib.sha256).digest()
            a, b = b, a ^ (int.from_bytes(digest, "big") & mask)
        value = (a << half) | b
        if value < size:
            return value


def _digits(key: bytes, label: str, digits: str) -> str:
    """The image of a run of digits under a permutation of all runs as long."""
    return f"{permuted(key, f'{label}/{len(digits)}', int(digits), 10 ** len(digits)):0{len(digits)}d}" if digits else ""


def _date(text: str, draws: _Draws) -> str:
    """A date in the same order and widths."""
    parts = regex.findall(r"\d+|\D", text)
    day, month, year = 1 + draws.below(28), 1 + draws.below(12), 1930 + draws.below(80)
    numbers = [p for p in parts if p.isdigit()]
    made = iter([year, month, day] if len(numbers[0]) == 4 else [month, day, year] if int(numbers[1]) > 12 else [day, month, year])
    return "".join(str(next(made) % 10 ** max(len(p), 2)).zfill(len(p)) if p.isdigit() else p for p in parts)


def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0, gender: str = "") -> str:
    """The normal form of an entity's surrogate; a name's has its gender in it."""
    draws = _Draws(key, kind, normal, attempt)
    if kind == "email":
        name, _, domain = normal.rpartition("@")
        return f"{_same_shape(name, draws)}@mail{_Draws(key, 'domain', domain, 0).below(10**6)}.example.org"
    if kind == "ip":
        # 240.0.0.0/4 is reserved; where many addresses fill it, later attempts draw from all others
        first = 240 + draws.below(16) if attempt < 4 else 1 + draws.below(223)
        return f"{first}.{draws.below(256)}.{draws.below(256)}.{draws.below(256)}"
    if kind == "ip6":
        return regex.sub(r"[0-9a-f]+", lambda m: "".join("123456789abcdef0"[draws.below(15 + (i > 0))] for i in range(len(m[0]))), normal)
    if kind == "card":
        body = normal[0] + _digits(key, f"card/{attempt}/{normal[0]}", normal[1:-1])
        return body + str(_luhn(body))
    if kind == "phone":
        # the country code stays, and the 0 of a national number
        stay = max(0, len(normal) - 10, int(normal[0] == "0"))
        return normal[:stay] + _digits(key, f"phone/{attempt}/{normal[:stay]}", normal[stay:])
    if kind == "ssn":
        return _digits(key, f"ssn/{attempt}", normal)
    if kind == "born":
        return _date(normal, draws)
    if kind == "key" and normal.isupper():
        return normal[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draws.below(32)] for _ in normal[4:])
    if kind == "key":
        return normal[:4] + _same_shape(normal[4:], draws)
    if kind == "iban":
        body = _same_shape(normal[4:], draws)
        return f"{normal[:2]}{98 - _mod97(body + normal[:2] + '00'):02d}{body}"
    if kind == "name":
        script, who = normal.split(":", 1)
        words = []
        # each later attempt draws from sixteen times as many, so there are names enough for any table
        for i, _ in enumerate(who.split()):
            word = "".join(SYLLABLES[script][draws.below(16)] for _ in range(3 + draws.below(2) + attempt))
            words.append(word + (ENDINGS[script][gender] if i == 0 else ""))
        return f"{script}:{' '.join(words)}"
    return _same_shape(normal, draws)


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def rendered(entity: Entity, found: str, normal: str) -> str:
    """A surrogate's normal form in the format of the occurrence it replaces."""
    if entity.kind in ("card", "phone", "ssn", "iban"):
        signs = iter(normal)
        return "".join(next(signs) if c.isalnum() else c for c in found)
    if entity.kind == "name":
        words = normal.split(":", 1)[1].split()
        words = iter(words[-1:] if entity.last else words)
        return regex.sub(r"\p{L}+", lambda m: _cased(next(words, ""), m[0]), found)
    if entity.kind == "email":
        # the name's letters as they were written; capitals of the domain begin its surrogate's
        name, _, domain = found.rpartition("@")
        made, _, place = normal.rpartition("@")
        return "".join(c.upper() if f.isupper() else c for c, f in zip(made, name, strict=True)) + "@" + (place.capitalize() if domain[:1].isupper() else place)
    if entity.kind == "ip6" and found != found.lower():
        return normal.upper()
    return normal


COLUMNS = ["kind", "normal", "gender"]


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """(``kind``, ``normal``, ``gender``) for each entity of each batch of texts; repeats within a batch are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = sorted({(e.kind, e.normal, e.gender) for x in texts_of(batch.column(0)) for e in entities(x)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(3)], COLUMNS)

    return docs.select(F.col(text).alias("__text")).mapInArrow(run, "kind string, normal string, gender string")


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kinds, normals, genders, attempts = (batch.column(i).to_pylist() for i in range(4))
            made = [surrogate(key, k, n, a, g) for k, n, g, a in zip(kinds, normals, genders, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*COLUMNS, "attempt", "made"])

    return rows.select(*COLUMNS, "attempt").mapInArrow(run, "kind string, normal string, gender string, attempt int, made string")


def assign(found: DataFrame, key: bytes, rounds: int = 60) -> DataFrame:
    """``kind``, ``normal``, ``gender``, ``attempt``, ``made`` for each distinct entity, the surrogates distinct, and
    ``mixed``: whether different genders are told of it.

    A name's gender is the one that is told; of both, the first in order. A surrogate may be neither another
    entity's surrogate nor an entity of the table. Of the entities that draw the same one, the first in order that
    drew it earliest keeps it; the others draw again.
    """
    gender = F.coalesce(F.min(F.nullif("gender", F.lit(""))), F.lit(""))
    distinct = stash(found.groupBy("kind", "normal").agg(gender.alias("gender"), (F.count_distinct("gender") > 1).alias("mixed")), "entities")
    settled = stash(_drawn(distinct.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(rounds):
        real = distinct.select("kind", F.col("normal").alias("made"), F.lit(1).alias("real"))
        keeper = (
            settled.select("kind", "made", F.struct("attempt", "normal").alias("who"), F.lit(0).alias("real"))
            .unionByName(real.withColumn("who", F.lit(None).cast("struct<attempt:int,normal:string>")))
            .groupBy("kind", "made")
            .agg(F.min("who").alias("first"), F.count("who").alias("drawn"), F.max("real").alias("real"))
            .where("drawn > 0 and (drawn > 1 or real = 1)")
        )
        again = stash(
            settled.join(keeper, ["kind", "made"])
            .where((F.col("real") == 1) | (F.col("normal") != F.col("first.normal")))
            .select(*COLUMNS, (F.col("attempt") + 1).alias("attempt")),
            "again",
        )
        if again.isEmpty():
            return settled.join(distinct.where("mixed").select("kind", "normal", "mixed"), ["kind", "normal"], "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
        kept = settled.join(again.select("kind", "normal"), ["kind", "normal"], "left_anti")
        before, settled = settled, stash(kept.select(*COLUMNS, "attempt", "made").unionByName(_drawn(again, key)), "surrogates")
        free(before, again)
    raise RuntimeError(f"surrogates weren't distinct after {rounds} rounds")


Told = dict[tuple[str, str], tuple[int, str]]


def replaced(text: str | None, key: bytes, told: Told) -> tuple[str | None, int]:
    """A text with its entities replaced, and their number; ``told`` holds attempt and gender where they are others than at first sight."""
    if not text:
        return text, 0
    out, at, found = [], 0, entities(text)
    for e in found:
        attempt, gender = told.get((e.kind, e.normal), (0, e.gender))
        out += [text[at : e.start], rendered(e, text[e.start : e.end], surrogate(key, e.kind, e.normal, attempt, gender))]
        at = e.end
    return ("".join(out) + text[at:] if found else text), len(found)


#: Entities to be told up to this many go to every task; beyond it they are joined to the texts that hold them.
MOST_SENT = 20_000


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with ``text`` rewritten, and with ``count`` the number of replacements in a column of that name.

    A surrogate follows from the key and the text alone unless its entity had to draw again or other texts tell
    another gender, so only those few are handed to the tasks: as a list whose size is checked, else grouped by
    text and joined. The row travels as one struct, so its columns' names cannot clash.
    """
    special = stash(assign(detect(docs, text), key).where("attempt > 0 or mixed").select(*COLUMNS, "attempt"), "told")
    sent = special.count() <= MOST_SENT
    told = {(r.kind, r.normal): (r.attempt, r.gender) for r in special.collect()} if sent else {}
    columns = [c for c in docs.columns if c != count]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns if c != text)).alias("__row"), F.col(f"`{text}`").alias("__text")) if len(columns) > 1 else docs.select(F.struct(F.lit(0).alias("__none")).alias("__row"), F.col(f"`{text}`").alias("__text"))
    source = packed.withColumn("__told", F.lit(None).cast("array<struct<kind:string,normal:string,gender:string,attempt:int>>")) if sent else _with_told(packed, special)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = batch.column(2).to_pylist()
            made = [replaced(x, key, told if o is None else {(e["kind"], e["normal"]): (e["attempt"], e["gender"]) for e in o}) for x, o in zip(batch.column(1).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["__row", "__text", "__n"])

    fields = source.select("__row", "__text").schema
    out = source.select("__row", "__text", "__told").mapInArrow(run, StructType([*fields.fields]).add("__n", LongType()))
    return out.select(*(F.col("__text").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in columns), *([F.col("__n").alias(count)] if count else []))


def _with_told(packed: DataFrame, special: DataFrame) -> DataFrame:
    """Rows with ``__told``: what is to be told of each text's entities, found by the text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(d, k, n) for x, d in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True) for k, n in {(e.kind, e.normal) for e in entities(x)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["__digest", "kind", "normal"])

    digest = F.sha2(F.col("__text"), 256)
    held = packed.select("__text", digest.alias("d")).mapInArrow(run, "__digest string, kind string, normal string").distinct()
    lists = held.join(special, ["kind", "normal"]).groupBy("__digest").agg(F.collect_list(F.struct("kind", "normal", "gender", "attempt")).alias("__told"))
    return packed.join(lists, digest == F.col("__digest"), "left").withColumn("__told", F.coalesce("__told", F.array().cast("array<struct<kind:string,normal:string,gender:string,attempt:int>>"))).drop("__digest")
