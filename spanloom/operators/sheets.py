"""Readings of text on frames as columns: geometry of all pairs at once, rows, reading order, paragraphs, ownership.

A ``Sheet`` holds any number of readings, those of one frame or of a whole key. Boxes are compared as matrices;
what depends on a text alone is worked out once for each distinct text and for each distinct pair of texts.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

from spanloom.functions import text as X

LEFT, TOP, RIGHT, BOTTOM = range(4)
#: Sides of no length are taken for this long where something is divided by them.
TINY = 1e-3


@dataclass(frozen=True)
class Wording:
    """A text with the form it is compared by and the numbers in it."""

    text: str
    key: str
    numbers: tuple[str, ...]


@lru_cache(maxsize=1 << 16)
def wording(text: str) -> Wording:
    return Wording(text, X.key_of(text), tuple(X.numbers_of(text)))


@dataclass(frozen=True)
class Sheet:
    """Columns of readings; ``parts`` are the rows (text and box) of a paragraph, none for a line of its own."""

    words: tuple[Wording, ...]
    sure: np.ndarray
    box: np.ndarray
    height: np.ndarray
    looks: tuple[int | None, ...]
    parts: tuple[tuple[tuple[Wording, tuple[float, ...], float], ...], ...]

    def __len__(self) -> int:
        return len(self.words)

    def take(self, places: Iterable[int]) -> Sheet:
        at = np.asarray(places if isinstance(places, np.ndarray) else list(places), np.int64)
        each = at.tolist()
        pick = lambda column: tuple([column[i] for i in each])
        return Sheet(pick(self.words), self.sure[at], self.box[at], self.height[at], pick(self.looks), pick(self.parts))

    @cached_property
    def span(self) -> np.ndarray:
        """Width and height of each box, as they are."""
        return self.box[:, RIGHT:] - self.box[:, :RIGHT]

    @cached_property
    def sides(self) -> np.ndarray:
        return np.maximum(self.span, TINY)

    @cached_property
    def area(self) -> np.ndarray:
        return self.sides.prod(1)

    @cached_property
    def middle(self) -> np.ndarray:
        return (self.box[:, :RIGHT] + self.box[:, RIGHT:]) / 2

    @cached_property
    def keys(self) -> np.ndarray:
        return np.array([w.key for w in self.words], object)

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(w.key) for w in self.words], np.int64)

    def rows(self, i: int) -> tuple[tuple[Wording, tuple[float, ...], float], ...]:
        return self.parts[i] or ((self.words[i], tuple(self.box[i].tolist()), float(self.height[i])),)

    def row_keys(self, i: int) -> tuple[str, ...]:
        return tuple(w.key for w, _, _ in self.rows(i))


def sheet(rows: Sequence[tuple]) -> Sheet:
    """From (text, confidence or None, left, top, right, bottom, look or None) each."""
    box = np.array([r[2:6] for r in rows], float).reshape(-1, 4)
    sure = np.array([1.0 if r[1] is None else r[1] for r in rows], float)
    height = np.maximum(0.0, box[:, BOTTOM] - box[:, TOP])
    return Sheet(tuple(wording(r[0]) for r in rows), sure, box, height, tuple(r[6] for r in rows), ((),) * len(rows))


def stack(sheets: Sequence[Sheet]) -> Sheet:
    sheets = [s for s in sheets if len(s)] or [sheet([])]
    flat = lambda name: tuple(x for s in sheets for x in getattr(s, name))
    whole = lambda name: np.concatenate([getattr(s, name) for s in sheets])
    return Sheet(flat("words"), whole("sure"), whole("box"), whole("height"), flat("looks"), flat("parts"))


# ---- relations of boxes: matrices over (a, b)


def common(a: Sheet, b: Sheet, axis: int) -> np.ndarray:
    """Length that boxes share along an axis (0 across, 1 down), below zero where they lie apart."""
    low, high = axis, axis + 2
    return np.minimum.outer(a.box[:, high], b.box[:, high]) - np.maximum.outer(a.box[:, low], b.box[:, low])


def overlap(a: Sheet, b: Sheet) -> np.ndarray:
    """The lesser share of the shorter side that both axes have in common; none between heights 2.5 times apart."""
    shares = [np.maximum(common(a, b, axis), 0.0) / np.minimum.outer(a.sides[:, axis], b.sides[:, axis]) for axis in (0, 1)]
    tall = a.sides[:, 1], b.sides[:, 1]
    alike = np.maximum.outer(*tall) <= 2.5 * np.minimum.outer(*tall)
    return np.where(alike, np.minimum(*shares), 0.0)


def stacked(s: Sheet) -> np.ndarray:
    """[i, j]: whether j reads on below i: alike in height, close, overlapping in width, and aligned."""
    h = np.maximum(s.height, TINY)
    low, high = np.minimum.outer(h, h), np.maximum.outer(h, h)
    gap = lambda x: x[None, :] - x[:, None]
    down, indent = gap(s.middle[:, 1]), gap(s.box[:, LEFT])
    wide = s.sides[:, 0]
    edge = np.minimum(np.abs(indent), np.abs(gap(s.box[:, RIGHT]))) <= 0.6 * high
    centred = np.abs(gap(s.middle[:, 0])) <= 0.3 * high
    hanging = (indent >= 0) & (indent <= 1.2 * high) & (wide[:, None] >= 1.5 * wide[None, :]) & (gap(s.box[:, RIGHT]) <= 0)
    close = (low >= 0.5 * high) & (down >= 0.3 * low - 1e-6) & (down <= 1.6 * high)
    return close & (edge | centred | hanging) & (np.maximum(common(s, s, 0), 0) >= 0.7 * np.minimum.outer(wide, wide)) & ~np.eye(len(s), dtype=bool)


# ---- relations of texts, each distinct pair once


@lru_cache(maxsize=1 << 16)
def stands_in(rows: tuple[str, ...], host: str) -> bool:
    """Whether the keys of some rows stand in a host's key, one after the other."""
    for key in filter(None, rows):
        _, found, host = host.partition(key)
        if not found:
            return False
    return True


def drawn_from(few: Sequence[str], many: Sequence[str]) -> bool:
    """Whether ``few`` is ``many`` with some left out, in order."""
    rest = iter(many)
    return all(x in rest for x in few)


def digit_more(base: Wording, longer: Wording) -> bool:
    """Whether ``longer`` has one digit more at an edge of a key of four characters or more without numbers."""
    a, b = base.key, longer.key
    if base.numbers or len(a) < 4 or len(b) != len(a) + 1:
        return False
    return (b[:-1] == a and b[-1].isdigit()) or (b[1:] == a != b[:-1] and b[0].isdigit())


# ---- what a frame's readings amount to


def joined(s: Sheet, places: Sequence[int], glue: str, keep_rows: bool) -> Sheet:
    """Several readings as one: the box around them, the least sure, the median height. One is itself."""
    part = s.take(places)
    if len(part) == 1:
        return part
    box = np.concatenate([part.box[:, :RIGHT].min(0), part.box[:, RIGHT:].max(0)])
    text = glue.join(X.nfkc_text(w.text) if keep_rows else w.text for w in part.words)
    rows = tuple((part.words[i], tuple(part.box[i].tolist()), float(part.height[i])) for i in range(len(part))) if keep_rows else ()
    return Sheet((wording(text),), np.array([part.sure.min()]), box[None], np.array([np.median(part.height)]), (None,), (rows,))


def in_reading_order(s: Sheet) -> np.ndarray:
    """Places row by row, each from left to right; a row is told by its first line, so that it cannot drift."""
    order = np.lexsort((s.box[:, LEFT], s.box[:, TOP]))
    heads: list[int] = []
    row = np.zeros(len(s), np.int64)
    for i in order:
        level = np.abs(s.middle[i, 1] - s.middle[heads, 1]) <= np.minimum(s.span[i, 1], s.span[heads, 1]) / 2
        if level.any():
            row[i] = np.flatnonzero(level)[-1]
        else:
            row[i] = len(heads)
            heads.append(i)
    return order[np.lexsort((s.box[order, LEFT], row[order]))]


def _rows_across(s: Sheet) -> list[list[int]]:
    """Readings that continue one another, from left to right: level, straight with the row's first, and adjoining."""
    rows: list[list[int]] = []
    for i in np.lexsort((s.box[:, TOP], s.box[:, LEFT])):
        first, last = np.array([r[0] for r in rows], np.int64), np.array([r[-1] for r in rows], np.int64)
        h = np.maximum(TINY, np.minimum(s.span[last, 1], s.span[i, 1]))
        level = np.minimum(s.box[last, BOTTOM], s.box[i, BOTTOM]) - np.maximum(s.box[last, TOP], s.box[i, TOP]) >= 0.6 * h
        straight = np.abs(s.middle[i, 1] - s.middle[first, 1]) <= 0.5 * np.minimum(s.span[first, 1], s.span[i, 1])
        ahead = s.box[i, LEFT] - s.box[last, RIGHT]
        fits = level & straight & (ahead >= -0.5 * h) & (ahead <= 0.6 * h)
        if s.lengths[i] >= 4:
            fits &= np.array([not any(s.keys[i] in s.keys[p] for p in r) for r in rows], bool)
        if fits.any():
            rows[int(np.where(fits, np.abs(ahead), np.inf).argmin())].append(int(i))
        else:
            rows.append([int(i)])
    return rows


def assembled(s: Sheet, floor: float, certain: float) -> Sheet:
    """A frame's detections that are sure enough, once each, the fragments of a row joined, in reading order."""
    upright = s.span[:, 1] > np.maximum(3.0 * s.span[:, 0], 0.08)
    good = np.flatnonzero((s.lengths > 0) & (s.sure >= floor) & ~(upright & (s.sure < certain)))
    if len(good) < 2:
        return s if len(good) == len(s) else s.take(good)
    texts = np.array([s.words[i].text for i in good], object)
    s = s.take(good[np.lexsort((np.unique(texts, return_inverse=True)[1] if len(texts) else texts, s.box[good, LEFT], s.box[good, TOP], -s.sure[good]))])
    twice = (overlap(s, s) > 0.8) & (s.keys[:, None] == s.keys[None, :])
    stays = np.zeros(len(s), bool)
    for i in range(len(s)):
        stays[i] = not (twice[i] & stays).any()
    s = s.take(np.flatnonzero(stays))
    s = stack([joined(s, row, " ", False) for row in _rows_across(s)])
    return s.take(in_reading_order(s))


def paragraphs(s: Sheet, together: np.ndarray | None = None) -> list[list[int]]:
    """Places of each paragraph's lines, downwards. A line goes on in the nearest one below it, if ``together``
    allows the two; a line below two of them goes on from the lower."""
    if len(s) < 2:
        return [[0]] * len(s)
    down = np.lexsort((np.arange(len(s)), s.box[:, LEFT], s.middle[:, 1]))
    rank = np.argsort(down)
    below = stacked(s)
    next_ = np.where(below, rank[None, :], len(s)).min(1)
    links = [(i, int(down[r])) for i, r in enumerate(next_) if r < len(s)]
    if together is not None:
        links = [(i, j) for i, j in links if together[i, j]]
    above: dict[int, int] = {}
    for i, j in sorted(links, key=lambda x: (s.box[x[0], BOTTOM], -x[0])):
        above[j] = i
    # each line has one above and one below at most, so a paragraph is a chain; follow it to its head
    head = np.arange(len(s))
    for j in down:
        head[j] = head[above[j]] if j in above else j
    groups: dict[int, list[int]] = {}
    for i in down:
        groups.setdefault(int(head[i]), []).append(int(i))
    return sorted(groups.values(), key=min)


# ---- one owner for each row at a time


def _covers(host: tuple[Wording, tuple[float, ...], float], row: tuple[Wording, tuple[float, ...], float]) -> bool:
    """Whether a claimed row shows the same text in the same place."""
    (a, p, _), (b, q, _) = host, row
    if not b.key or b.key not in a.key:
        return False
    shares = ((axis, min(p[axis + 2], q[axis + 2]) - max(p[axis], q[axis]), max(TINY, min(p[axis + 2] - p[axis], q[axis + 2] - q[axis]))) for axis in (0, 1))
    return all(length >= (0.8, 0.5)[axis] * shorter for axis, length, shorter in shares)


def owners(starts: Sequence[float], ends: Sequence[float], s: Sheet) -> list[tuple[float, float, Sheet]]:
    """(from, to, what is owned) of runs that overlap in time: the longest text claims its rows first.

    Edges are swept in order with the set of runs that are there, in order of their claims. A run keeps the
    rows that no earlier claim covers; pieces of one run with the same rows that touch are one.
    """
    edges: dict[float, tuple[list[int], list[int]]] = {}
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        if a < b:
            edges.setdefault(a, ([], []))[0].append(i)
            edges.setdefault(b, ([], []))[1].append(i)
    here: list[tuple[int, int]] = []
    known: dict[tuple, bool] = {}
    pieces: list[tuple[float, float, int, tuple[int, ...]]] = []
    going: dict[tuple[int, tuple[int, ...]], float] = {}

    def covered(by: tuple[int, int], what: tuple[int, int]) -> bool:
        if (by, what) not in known:
            known[by, what] = _covers(s.rows(by[0])[by[1]], s.rows(what[0])[what[1]])
        return known[by, what]

    for at in sorted(edges):
        come, go = edges[at]
        here = [x for x in here if x[1] not in go] if go else here
        for i in come:
            insort(here, (-int(s.lengths[i]), i))
        claimed: list[tuple[int, int]] = []
        now: dict[tuple[int, tuple[int, ...]], float] = {}
        for _, i in here:
            free = tuple(j for j in range(len(s.rows(i))) if not any(covered(c, (i, j)) for c in claimed))
            if free:
                claimed += [(i, j) for j in free]
                now[i, free] = going.get((i, free), at)
        pieces += [(since, at, *what) for what, since in going.items() if what not in now]
        going = now
    out = []
    for a, b, i, free in sorted(pieces, key=lambda p: (p[0], -int(s.lengths[p[2]]), p[2])):
        rows = s.rows(i)
        if len(free) == len(rows):
            out.append((a, b, s.take([i])))
        else:
            left = sheet([(rows[j][0].text, float(s.sure[i]), *rows[j][1], None) for j in free])
            left = Sheet(left.words, left.sure, left.box, np.array([rows[j][2] for j in free]), left.looks, left.parts)
            out.append((a, b, joined(left, range(len(free)), " / ", True)))
    return out


def band(x: float, y: float) -> str:
    """Third of the frame's height and width in which a point lies."""
    third = lambda v, names: names[int(v >= 0.33) + int(v >= 0.66)]
    return f"{third(y, ('top', 'middle', 'bottom'))} {third(x, ('left', 'center', 'right'))}"


def size(height: float) -> str:
    return ("small", "medium", "large")[int(height >= 0.04) + int(height >= 0.08)]
