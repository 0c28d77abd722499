"""Text followed through noisy, repeated readings, per key and in order of time, and published as cues.

A key's readings are the columns of one ``Sheet``; a trail is a list of places in it. For each frame the open
trails are scored against all its lines as one matrix, matched greedily, and each trail then takes one step of a
small state machine (idle, matched, doubtful digit, cropped, missed, replaced). Publication works on the columns
of all trails together: heights and neighbours are found by key or by a window of time, not by trying all pairs.

A key is followed in one task, as each frame depends on the one before; a stream keeps the trails that are
still open, and their readings, as its state.
"""

from __future__ import annotations

import difflib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from spanloom.functions import text as X
from spanloom.operators import sheets as S
from spanloom.operators.sheets import BOTTOM, LEFT, RIGHT, TOP, Sheet


@dataclass(frozen=True)
class Settings:
    """``fps`` of the frames, bars of confidence and height, and how long a text may be out of sight."""

    fps: float = 4.0
    min_confidence: float = 0.7
    singleton: float = 0.95
    min_height: float = 0.025
    hold_s: float = 30.0
    rejoin_s: float = 4.0
    same_text: float = 0.8

    @property
    def slack_s(self) -> float:
        return min(2.0, max(1.0, 1.0 / self.fps))


# Bars of the comparisons.
HEIGHT_RATIO, PLACE_OVERLAP, MOST_MOVED = 0.6, 0.45, 0.12
CONTAINED_OVERLAP, CONTAINED_SHARE = 0.8, 0.6
CLEAR, LOOK_SHARE, LOOK_BITS = 0.95, 0.08, 256
REPLACED_OVERLAP = 0.65


@dataclass(frozen=True)
class Frame:
    """Readings of one moment; a discovery frame saw its regions (left, top, right, bottom) alone."""

    at: float
    lines: Sheet = field(default_factory=lambda: S.sheet([]))
    verification: bool = False
    discovery: bool = False
    regions: tuple[tuple[float, float, float, float], ...] = ()


@dataclass(eq=False)
class Trail:
    """One text: the places of its readings, and per key the place of the clearest reading and their number."""

    places: list[int]
    forms: dict[str, tuple[int, int]]
    seen: float
    since: float
    out_of_sight: float | None = None
    cut_since: float | None = None
    doubtful: int | None = None
    best: int = -1
    height: float = 0.0


class Follower:
    """The open trails of one key and the columns of their readings; ``closed`` holds (trail, end)."""

    def __init__(self, duration: float, settings: Settings):
        self.duration, self.settings = duration, settings
        self.lines, self.times = S.sheet([]), np.empty(0)
        self.open: list[Trail] = []
        self.closed: list[tuple[Trail, float]] = []

    # ---- readings of one trail

    def _begin(self, places: Sequence[int]) -> Trail:
        trail = Trail([], {}, 0.0, float(self.times[places[0]]))
        for p in places:
            self._add(trail, p)
        return trail

    def _add(self, t: Trail, p: int) -> None:
        s, key = self.lines, self.lines.keys[p]
        if t.places:
            less = key != s.keys[t.best] and s.area[p] < 0.8 * s.area[t.best] and self._in(p, t.best)
            t.cut_since = (float(self.times[p]) if t.cut_since is None else t.cut_since) if less else None
        t.places.append(p)
        t.seen, t.out_of_sight = float(self.times[p]), None
        home = self._lesser_of(t, p)
        if home is None and key not in t.forms:
            t.forms[key] = (p, 1)
        else:
            clearest, n = t.forms[home or key]
            better = home is None and s.sure[p] > s.sure[clearest]
            t.forms[home or key] = (p if better else clearest, n + 1)
        self._represent(t)

    def _in(self, part: int, host: int) -> bool:
        return S.stands_in(self.lines.row_keys(part), self.lines.keys[host])

    def _lesser_of(self, t: Trail, p: int) -> str | None:
        """The key of a form that a reading is a crop or a worse reading of."""
        s, established = self.lines, len(t.places) > 3
        n = s.lengths[p]
        for key, (old, _) in t.forms.items():
            inside, around = self._in(p, old), self._in(old, p)
            longest, shortest = max(n, len(key)), min(n, len(key))
            close = s.keys[p] in key and shortest >= 0.6 * max(longest, 1)
            outgrown = n > 1.25 * len(key) and s.area[p] > 1.2 * s.area[old]
            if not (inside or around) or not (established or close) or outgrown or not S.drawn_from(s.words[p].numbers, s.words[old].numbers):
                continue
            smaller = n < len(key) and (s.sides[p, 0] < 0.8 * s.sides[old, 0] or s.area[p] < 0.8 * s.area[old])
            if smaller or s.sure[p] <= s.sure[old] or (inside and shortest < 0.85 * max(longest, 1)):
                return key
        return None

    def _represent(self, t: Trail) -> None:
        """The clearest form that no fuller one, seen twice, contains; the median height of all readings."""
        s, forms = self.lines, list(t.forms.values())
        if len(forms) == 1:
            t.best = forms[0][0]
            t.height = self._height(t)
            return
        at = np.array([p for p, _ in forms])
        often = np.array([n for _, n in forms])
        fuller = (often >= 2)[None, :] & (s.lengths[at][:, None] < 0.8 * s.lengths[at][None, :]) & (1.2 * s.area[at][:, None] < s.area[at][None, :])
        for i, j in zip(*np.nonzero(fuller), strict=True):
            fuller[i, j] = self._in(int(at[i]), int(at[j]))
        whole = ~fuller.any(1)
        whole = whole if whole.any() else ~whole
        t.best = int(max((x for x, ok in zip(forms, whole, strict=True) if ok), key=lambda x: (s.sure[x[0]], x[1], len(s.words[x[0]].text)))[0])
        t.height = self._height(t)

    def _height(self, t: Trail) -> float:
        h = self.lines.height[t.places]
        return float(np.median(h) if len(h) > 2 else h.mean())

    # ---- trails against the lines of a frame

    def _doubtful(self, t: Trail, p: int) -> bool:
        """One unsure digit at an edge of an established text, or the clear reading after such a one."""
        s = self.lines
        best, line = s.words[t.best], s.words[p]
        if not S.digit_more(best, line):
            return len(t.places) == 1 and s.sure[p] > s.sure[t.best] and S.digit_more(line, best)
        if t.doubtful is not None:
            return s.keys[t.doubtful] == line.key
        return len(t.places) >= 2 and s.sure[p] < s.sure[t.best]

    def _likeness(self, t: Trail, p: int, over: float) -> float:
        """How well a line in place continues a trail's text, 0 if it cannot."""
        s, st = self.lines, self.settings
        best, line = s.words[t.best], s.words[p]
        same = lambda: X.same_text_of(best.text, line.text, st.same_text)
        if over < PLACE_OVERLAP:
            if len(line.key) < 4 or not same():
                return 0.0
            over = PLACE_OVERLAP
        shorter, longer = sorted((len(best.key), len(line.key)))
        within = self._in(p, t.best)
        contained = over >= CONTAINED_OVERLAP and shorter >= 2 and shorter >= CONTAINED_SHARE * longer and (within or self._in(t.best, p))
        if contained and best.numbers != line.numbers and s.sure[p] >= st.singleton:
            contained = (within and S.drawn_from(line.numbers, best.numbers)) or self._doubtful(t, p)
        if not contained and not same():
            return 0.0
        if best.key == line.key:
            return 2.0 + over
        ratio, kept = _blocks(best.key, line.key)
        looks = s.looks[t.places[-1]], s.looks[p]
        alike = all(looks) and (looks[0] ^ looks[1]).bit_count() <= LOOK_SHARE * LOOK_BITS
        two_texts = longer - kept > 2 and min(s.sure[t.best], s.sure[p]) >= CLEAR and not alike and not (contained and within)
        return 0.0 if two_texts else ratio + over

    def _scores(self, here: np.ndarray) -> np.ndarray:
        """[trail, line]: 0 where a line can't go on a trail."""
        s = self.lines
        last = s.take([t.places[-1] for t in self.open])
        lines = s.take(here)
        over = S.overlap(last, lines)
        h, g = np.maximum(last.height, S.TINY), np.maximum(lines.height, S.TINY)
        moved = np.abs(last.middle[:, None, :] - lines.middle[None, :, :]).max(2)
        may = (np.minimum.outer(h, g) >= HEIGHT_RATIO * np.maximum.outer(h, g)) & ((over >= PLACE_OVERLAP) | (moved <= MOST_MOVED))
        out = np.zeros(over.shape)
        for i, j in zip(*np.nonzero(may), strict=True):
            out[i, j] = self._likeness(self.open[i], int(here[j]), float(over[i, j]))
        if out.all():
            return out
        # the one place of a phrase on the frame before, and the one on this frame
        best = [s.keys[t.best] for t in self.open]
        once_here, once_there = Counter(best), Counter(lines.keys.tolist())
        sizes = np.minimum(last.span[:, None, :], lines.span[None, :, :]) >= 0.6 * np.maximum(last.span[:, None, :], lines.span[None, :, :])
        for i, j in zip(*np.nonzero((out == 0) & sizes.all(2)), strict=True):
            key, t = best[i], self.open[i]
            if key == lines.keys[j] and len(key) >= 4 and t.out_of_sight is None and once_here[key] == once_there[key] == 1:
                out[i, j] = float(X.same_text_of(s.words[t.best].text, lines.words[j].text, 1.0))
        return out

    def take(self, frame: Frame) -> None:
        now = frame.at
        if not 0 <= now < self.duration:
            return
        self._drop([t for t in self.open if now - t.seen > (self.settings.hold_s if t.out_of_sight is None else self.settings.rejoin_s)])
        here = np.arange(len(self.lines), len(self.lines) + len(frame.lines))
        if len(here):
            self.lines = S.stack([self.lines, frame.lines]) if len(self.lines) else frame.lines
            self.times = np.concatenate([self.times, np.full(len(here), now)])
        self.step(frame, here)

    def step(self, frame: Frame, here: np.ndarray) -> None:
        """One frame whose lines are at the places ``here``."""
        scores = self._scores(here) if self.open and len(here) else np.zeros((len(self.open), len(here)))
        i, j = np.nonzero(scores)
        of_trail: dict[int, int] = {}
        taken: set[int] = set()
        for k in np.lexsort((j, i, -scores[i, j])):
            if i[k] not in of_trail and j[k] not in taken:
                of_trail[int(i[k])] = int(j[k])
                taken.add(int(j[k]))
        free = [int(p) for n, p in enumerate(here) if n not in taken]
        going = []
        for n, t in enumerate(self.open):
            if n in of_trail:
                going.append(self._matched(t, frame.at, int(here[of_trail[n]])))
            elif self._unmatched(t, frame, free):
                going.append(t)
            else:
                self._close(t)
        self.open = going + [self._begin([p]) for p in free]

    def _matched(self, t: Trail, now: float, p: int) -> Trail:
        """The trail after a match, or the one that takes its place."""
        s = self.lines
        if t.doubtful is not None and s.keys[t.doubtful] == s.keys[p]:
            self._close(t, float(self.times[t.doubtful]))
            return self._begin([t.doubtful, p])
        if S.digit_more(s.words[t.best], s.words[p]) and self._doubtful(t, p):
            t.seen, t.out_of_sight, t.doubtful = now, None, p
            return t
        t.doubtful = None
        self._add(t, p)
        cut = t.cut_since
        if cut is None or now - cut < self.settings.rejoin_s:
            return t
        # what is left of a text for so long is a text of its own, from the first crop on
        left = [q for q in t.places if self.times[q] >= cut]
        t.places = [q for q in t.places if self.times[q] < cut]
        self._close(t, cut)
        return self._begin(left)

    def _unmatched(self, t: Trail, frame: Frame, free: list[int]) -> bool:
        """Whether a trail without a match stays open."""
        place, st = self.lines.box[t.places[-1]], self.settings
        if frame.discovery:
            seen = np.array(frame.regions, float).reshape(-1, 4)
            if not ((seen[:, :RIGHT] <= place[:RIGHT]).all(1) & (seen[:, RIGHT:] >= place[RIGHT:]).all(1)).any():
                return True
        if t.out_of_sight is None:
            t.out_of_sight = frame.at
        if free:
            over = S.overlap(self.lines.take(t.places[-1:]), self.lines.take(free))[0]
            if ((over > REPLACED_OVERLAP) & ((self.lines.sure[free] >= st.singleton) | (len(t.places) < 2))).any():
                return False
        return frame.at - t.seen <= st.rejoin_s

    def _close(self, t: Trail, by: float | None = None) -> None:
        cut = t.cut_since if t.cut_since is not None and t.seen - t.cut_since >= self.settings.rejoin_s else None
        end = min(x for x in (self.duration, t.seen + self.settings.hold_s, t.out_of_sight, by, cut) if x is not None)
        if end > t.since:
            self.closed.append((t, end))

    def _drop(self, some: list[Trail]) -> None:
        for t in some:
            self._close(t)
        self.open = [t for t in self.open if not any(t is x for x in some)]

    def finish(self) -> list[tuple[Trail, float]]:
        self._drop(self.open)
        return self.closed

    def compacted(self) -> None:
        """Forget the readings of closed trails."""
        kept = sorted({p for t in self.open for p in (*t.places, *((t.doubtful,) if t.doubtful is not None else ()))})
        to = {p: i for i, p in enumerate(kept)}
        self.lines, self.times = self.lines.take(kept), self.times[kept]
        for t in self.open:
            t.places = [to[p] for p in t.places]
            t.forms = {k: (to[p], n) for k, (p, n) in t.forms.items()}
            t.best = to[t.best]
            t.doubtful = None if t.doubtful is None else to[t.doubtful]
        self.closed = []


def _blocks(a: str, b: str) -> tuple[float, int]:
    """Similarity by matching blocks, and the characters in them."""
    m = difflib.SequenceMatcher(None, a, b, False)
    return m.ratio(), sum(x.size for x in m.get_matching_blocks())


def follow(frames: Sequence[Frame], duration: float, settings: Settings) -> Follower:
    """All trails of a key, closed. The frames' lines lie in its columns in order."""
    out = Follower(duration, settings)
    frames = [f for f in sorted(frames, key=lambda f: f.at) if 0 <= f.at < duration]
    out.lines = S.stack([f.lines for f in frames])
    out.times = np.repeat([f.at for f in frames], [len(f.lines) for f in frames]) if frames else out.times
    begin = 0
    for f in frames:
        out._drop([t for t in out.open if f.at - t.seen > (settings.hold_s if t.out_of_sight is None else settings.rejoin_s)])
        out.step(f, np.arange(begin, begin + len(f.lines)))
        begin += len(f.lines)
    out.finish()
    return out


def prepared(frames: Sequence[Frame], settings: Settings) -> list[Frame]:
    """Frames in order with what their detections amount to; probes are left out, discovery keeps longer readings."""
    out = []
    for f in sorted(frames, key=lambda f: f.at):
        if not f.verification:
            lines = f.lines.take(np.flatnonzero(f.lines.lengths >= 3)) if f.discovery else f.lines
            out.append(replace(f, lines=S.assembled(lines, settings.min_confidence, settings.singleton)))
    return out


# ---- what is published


def _by_key(s: Sheet) -> dict[str, np.ndarray]:
    found = defaultdict(list)
    for i, key in enumerate(s.keys):
        found[key].append(i)
    return {k: np.array(v) for k, v in found.items()}


def confirmed(f: Follower, frames: Sequence[Frame], settings: Settings) -> set[int]:
    """Trails (by place in ``closed``) whose clearest reading other frames close by repeat in place, text and height."""
    frames = sorted(frames, key=lambda x: x.at)
    both = [(x.lines, S.assembled(x.lines, settings.min_confidence, settings.singleton)) for x in frames]
    probes = S.stack([x for pair in both for x in pair])
    frame_of = np.repeat(np.arange(len(frames)), [len(a) + len(b) for a, b in both]) if frames else np.empty(0, np.int64)
    when = np.array([x.at for x in frames])
    at_key, s, out = _by_key(probes), f.lines, set()
    radius = max(0.5, 1.0 / settings.fps) + 0.001
    for n, (t, _) in enumerate(f.closed):
        key = s.keys[t.best]
        if len(key) < 3:
            continue
        own = np.array(t.places)
        anchor = max(t.places, key=lambda p: (s.keys[p] == key, s.sure[p]))
        near = at_key.get(key, np.empty(0, np.int64))
        times = when[frame_of[near]]
        near = near[(np.abs(times - f.times[anchor]) <= radius) & (times != f.times[anchor])]
        if not len(near):
            continue
        there = own[np.abs(when[frame_of[near]][:, None] - f.times[own][None, :]).argmin(1)]
        place, line = s.take(there), probes.take(near)
        heights = np.minimum(place.height, line.height) >= 0.75 * np.maximum(place.height, line.height)
        fits = (np.minimum(line.sure, s.sure[t.best]) >= settings.min_confidence) & heights & (np.diagonal(S.overlap(place, line)) >= 0.8)
        # each frame counts once, by the first of its readings that fits
        _, first = np.unique(frame_of[near[fits]], return_index=True)
        clearest = max([float(s.sure[t.best]), *line.sure[fits][first].tolist()])
        if len(first) >= 2 or (len(first) == 1 and clearest >= settings.singleton):
            out.add(n)
    return out


def supported(f: Follower, trusted: set[float], also: set[int], settings: Settings) -> set[int]:
    """Trails (by place in ``closed``) that repetition, confirmation, a paragraph or a steady slot vouches for."""
    s = f.lines
    of = np.full(len(s), -1)
    for n, (t, _) in enumerate(f.closed):
        of[t.places] = n
    seen = np.flatnonzero((of >= 0) & np.isin(f.times, list(trusted)))
    counts = np.bincount(of[seen], minlength=len(f.closed))
    clear = seen[s.sure[seen] >= settings.singleton]
    vouched: set[int] = set()
    clear = clear[np.argsort(f.times[clear], kind="stable")]
    for here in np.split(clear, np.flatnonzero(np.diff(f.times[clear])) + 1):
        if len(here) < 2:
            continue
        for rows in S.paragraphs(s.take(here)):
            if len(rows) > 1:
                peers = set(of[here[rows]][s.height[here[rows]] > settings.min_height].tolist())
                if sum(counts[i] >= 2 for i in peers) >= 2:
                    vouched |= peers
    order = seen[np.argsort(f.times[seen], kind="stable")]
    out = set()
    for n, (t, _) in enumerate(f.closed):
        sure = s.sure[t.best] >= settings.singleton
        if s.lengths[t.best] <= 2 and not sure:
            continue
        if counts[n] >= 2 or n in also:
            out.add(n)
        elif counts[n] and sure:
            a, b = np.searchsorted(f.times[order], [t.since - settings.rejoin_s, np.nextafter(t.since + settings.rejoin_s, np.inf)])
            near = order[a:b]
            near = near[(f.times[near] != t.since) & (np.abs(f.times[near] - t.since) <= settings.rejoin_s)]
            slots = near[_one_slot(s, t, near)]
            if n in vouched or len(np.unique(f.times[slots])) >= 2:
                out.add(n)
    return out


def _one_slot(s: Sheet, t: Trail, near: np.ndarray) -> np.ndarray:
    """Which readings are as high as a trail's text, on its level, and aligned with it."""
    h = np.maximum(np.maximum(s.height[near], t.height), S.TINY)
    apart = np.minimum(np.abs(s.box[near] - s.box[t.best])[:, [LEFT, RIGHT]].min(1), np.abs(s.middle[near, 0] - s.middle[t.best, 0]))
    return (apart <= 0.6 * h) & (np.minimum(s.height[near], t.height) >= 0.75 * h) & (np.abs(s.middle[near, 1] - s.middle[t.best, 1]) <= 0.3 * h)


def heights(runs: Sheet, readings: Sheet) -> np.ndarray:
    """Each run's height as the median of readings of its text as wide, or of parts of it where those explain more."""
    at_key = _by_key(readings)
    out = runs.height.copy()
    beginnings = defaultdict(list)
    for k in at_key:
        if len(k) >= 3:
            beginnings[k[:3]].append(k)
    mid, wide = readings.middle[:, 0], readings.sides[:, 0]
    for i in range(len(runs)):
        key, w = runs.keys[i], runs.sides[i, 0]
        own = at_key.get(key, np.empty(0, np.int64))
        near = (np.minimum(wide[own], w) >= 0.67 * np.maximum(wide[own], w)) & (np.abs(mid[own] - runs.middle[i, 0]) <= np.maximum(0.05, 0.25 * np.maximum(wide[own], w)))
        direct = own[near]
        parts = {}
        # a part begins somewhere in the text: where there are more texts than that, only such are tried
        tried = [k for x in {key[j : j + 3] for j in range(len(key) - 2)} for k in beginnings.get(x, ())] if len(beginnings) > len(key) else at_key
        for other in (k for k in tried if 3 <= len(k) < len(key) and k in key):
            inside = at_key[other]
            inside = inside[(readings.box[inside, LEFT] >= runs.box[i, LEFT] - 0.05) & (readings.box[inside, RIGHT] <= runs.box[i, RIGHT] + 0.05)]
            if len(inside):
                parts[other] = inside
        pieces = np.concatenate([np.empty(0, np.int64), *parts.values()])
        explained = len(direct) <= 2 and len(parts) >= 2 and sum(map(len, parts)) >= 0.6 * len(key) and len(pieces) > 2 * len(direct)
        found = direct if len(direct) and not explained else np.concatenate([direct, pieces])
        if len(found):
            out[i] = np.median(readings.height[found])
    return out


def tall_enough(starts: np.ndarray, ends: np.ndarray, runs: Sheet, readings: Sheet, settings: Settings) -> set[int]:
    """Runs above the floor of height, and lower lines that go on just below one of them all the while."""
    tall = heights(runs, readings) > settings.min_height + 1e-6
    hosts = np.flatnonzero(tall)
    hosts = hosts[np.argsort(starts[hosts], kind="stable")]
    out = set(hosts.tolist())
    slack = settings.slack_s
    for i in np.flatnonzero(~tall & (runs.lengths >= 3)):
        a, b = np.searchsorted(starts[hosts], [starts[i] - slack - 1e-6, starts[i] + slack + 1e-6])
        h = hosts[a:b]
        together = np.minimum(ends[i], ends[h]) - np.maximum(starts[i], starts[h])
        lasting = (together > 0) & (together >= 0.8 * np.minimum(ends[i] - starts[i], ends[h] - starts[h])) & (np.abs(starts[i] - starts[h]) <= slack) & (np.abs(ends[i] - ends[h]) <= slack)
        gap = runs.box[i, TOP] - runs.box[h, BOTTOM]
        indent = runs.box[i, LEFT] - runs.box[h, LEFT]
        below = (gap >= 0) & (gap <= 3 * np.maximum(runs.span[h, 1], runs.span[i, 1])) & (indent >= 0) & (indent <= 0.03)
        under = (np.minimum(runs.box[i, RIGHT], runs.box[h, RIGHT]) > np.maximum(runs.box[i, LEFT], runs.box[h, LEFT])) & (runs.span[h, 0] >= 1.5 * runs.span[i, 0])
        if (lasting & below & under).any():
            out.add(int(i))
    return out


def whole(starts: np.ndarray, ends: np.ndarray, runs: Sheet, slack: float) -> np.ndarray:
    """Places of the runs that no longer reading of the same text covers, continues or leaves behind."""
    order = np.argsort(starts, kind="stable")
    longest = float((ends - starts).max()) if len(starts) else 0.0
    kept = []
    for i in range(len(runs)):
        a, b = np.searchsorted(starts[order], [starts[i] - longest - slack - 1e-6, ends[i] + slack + 1e-6])
        h = order[a:b]
        h = h[(runs.lengths[h] > runs.lengths[i]) & (ends[h] >= starts[i] - slack)]
        h = np.array([x for x in h if runs.keys[i] and S.stands_in(runs.row_keys(i), runs.keys[x])], np.int64)
        if not len(h) or not _fragment(i, h, starts, ends, runs, slack).any():
            kept.append(i)
    return np.array(kept, np.int64)


def _fragment(i: int, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, runs: Sheet, slack: float) -> np.ndarray:
    """For each host whose text contains run ``i``: whether the run is a fragment of it."""
    line, hosts = runs.take([i]), runs.take(h)
    long = ends[i] - starts[i]
    same_numbers = np.array([w.numbers == runs.words[i].numbers for w in hosts.words])
    no_others = np.array([set(runs.words[i].numbers) <= set(w.numbers) for w in hosts.words])
    begins_so = np.array([k.startswith(runs.keys[i]) for k in hosts.keys])
    after, before = starts[h] - ends[i], starts[i] - ends[h]
    hands_over = (after >= 0) & (after <= slack) & (ends[h] > ends[i]) & (long <= ends[h] - starts[h]) & same_numbers
    still = (np.maximum(S.common(line, hosts, 0)[0], 0) >= 0.8 * np.minimum(line.sides[:, 0], hosts.sides[:, 0])) & (np.abs(line.box[:, LEFT] - hosts.box[:, LEFT]) <= 0.04) & (np.abs(line.middle[:, 1] - hosts.middle[:, 1]) <= 0.18)
    grows = hands_over & (still | begins_so)
    over = S.overlap(line, hosts)[0] >= 0.8
    inside = over & (np.minimum(ends[i], ends[h]) - np.maximum(starts[i], starts[h]) >= 0.8 * long)
    left_behind = over & (before >= 0) & (before <= slack) & (line.area < 0.8 * hosts.area) & no_others
    return grows | ((hosts.lengths >= 1.25 * line.lengths) & (inside | left_behind))


def _moved_to(s: Sheet, at: np.ndarray, heights_: np.ndarray) -> Sheet:
    """Readings with their own sizes, centred at other places; within the frame."""
    by = at - s.middle
    shift = np.hstack([by, by])
    box = s.box + shift
    parts = tuple(tuple((w, tuple((np.array(b) + shift[i]).tolist()), h) for w, b, h in own) for i, own in enumerate(s.parts))
    return Sheet(s.words, s.sure, np.clip(box, [0, 0, -np.inf, -np.inf], [np.inf, np.inf, 1, 1]), heights_, s.looks, parts)


def published(frames: Sequence[Frame], duration: float, settings: Settings = Settings()) -> list[tuple[float, float, str, str, str]]:
    """(start, end, text, position, size) of what the frames show, each row owned once."""
    ready = [f for f in prepared(frames, settings) if 0 <= f.at < duration]
    rows = follow(ready, duration, settings)
    starts, ends = (np.array(x, float) for x in ([t.since for t, _ in rows.closed], [e for _, e in rows.closed]))
    raw = S.stack([f.lines for f in frames if not f.verification])
    readings = raw.take(np.flatnonzero((raw.lengths > 0) & (raw.sure >= settings.min_confidence)))
    best = rows.lines.take([t.best for t, _ in rows.closed])
    best = Sheet(best.words, best.sure, best.box, np.array([t.height for t, _ in rows.closed], float), best.looks, best.parts)
    good = tall_enough(starts, ends, best, readings, settings)
    good &= supported(rows, {f.at for f in ready if not f.discovery}, confirmed(rows, frames, settings), settings)

    of = np.full(len(rows.lines), -1)
    for n in good:
        of[rows.closed[n][0].places] = n
    moments = {n: set(rows.times[rows.closed[n][0].places].tolist()) for n in good}

    def lived_together(a: int, b: int) -> bool:
        return a != b and len(moments[a] & moments[b]) >= 0.6 * max(len(moments[a]), len(moments[b]))

    blocks, begin = [], 0
    for f in ready:
        here = np.arange(begin, begin + len(f.lines))
        begin += len(f.lines)
        here = here[of[here] >= 0]
        lines = rows.lines.take(here)
        together = np.array([[lived_together(int(a), int(b)) for b in of[here]] for a in of[here]], bool).reshape(len(here), len(here))
        blocks.append(replace(f, lines=S.stack([S.joined(lines, own, " / ", True) for own in S.paragraphs(lines, together)])))
    found = follow(blocks, duration, settings)
    runs = _moved_to(found.lines.take([t.best for t, _ in found.closed]), found.lines.middle[[t.places[-1] for t, _ in found.closed]], np.array([t.height for t, _ in found.closed], float))
    starts, ends = (np.array([round(x, 3) for x in xs], float) for xs in ([t.since for t, _ in found.closed], [e for _, e in found.closed]))
    kept = whole(starts, ends, runs, settings.slack_s)
    out = [(float(a), float(b), x.words[0].text, S.band(*x.middle[0]), S.size(x.height[0])) for a, b, x in S.owners(starts[kept], ends[kept], runs.take(kept))]
    return sorted(out, key=lambda c: (c[0], c[3], c[2]))


# ---- over DataFrames


def frames_of(rows: pd.DataFrame) -> Iterator[Frame]:
    """Frames from rows of one line each; a frame without lines has one row with a null text."""
    by = ["at_us", "verification", "discovery"]
    rows = rows.dropna(subset=by)
    rows = rows.iloc[np.lexsort((rows.discovery.to_numpy(bool), rows.verification.to_numpy(bool), rows.at_us.to_numpy()))]
    moments = list(zip(*(rows[x].tolist() for x in by), strict=True))
    seen = rows.text.notna().tolist()
    sure = [None if c != c else c for c in rows.confidence.to_numpy(float, na_value=np.nan).tolist()]
    looks = [int(x, 16) if isinstance(x, str) and x else None for x in rows.look]
    lines = list(zip(rows.text.tolist(), sure, *(rows[x].tolist() for x in ("left", "top", "right", "bottom")), looks, strict=True))
    told = rows.text_height.to_numpy(float) if "text_height" in rows else None
    for moment, own in groupby(range(len(moments)), key=moments.__getitem__):
        here = [i for i in own if seen[i]]
        s = S.sheet([lines[i] for i in here])
        if told is not None:
            s = replace(s, height=np.where(np.isnan(told[here]), s.height, np.maximum(told[here], 0.0)))
        at, verification, discovery = moment
        yield Frame(np.float64(at / 1e6), s, bool(verification), bool(discovery))


def _keyed(rows: list[tuple], names: list[str], keys: list[str], found: tuple) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for name, value in zip(reversed(keys), reversed(found), strict=True):
        out.insert(0, name, value)
    return out


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key in several parts for each core: by their bytes, which are few, they would be put into too few tasks."""
    session = rows.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def track_cues(lines: DataFrame, keys: list[str], duration_us: str = "duration_us", settings: Settings = Settings()) -> DataFrame:
    """Cues of each key from rows (keys, ``duration_us``, ``at_us``, ``text``, ``confidence``, box, ``look``,
    ``verification``, ``discovery``)."""
    types = dict(lines.dtypes)

    def run(found: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = published(list(frames_of(rows)), float(rows[duration_us].iloc[0]) / 1e6, settings)
        return _keyed([(round(a * 1e6), round(b * 1e6), *rest) for a, b, *rest in made], ["start_us", "end_us", "text", "position", "size"], keys, found)

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", start_us long, end_us long, text string, position string, size string"
    return _dealt(lines, keys).groupBy(*keys).applyInPandas(run, schema)


def unsupported(frames: Sequence[Frame], duration: float, settings: Settings = Settings()) -> list[tuple[float, Sheet]]:
    """(moment, line) of each readable trail without support: its surest sample, which other frames may confirm."""
    ready = [f for f in prepared(frames, settings) if 0 <= f.at < duration]
    f = follow(ready, duration, settings)
    good = supported(f, {x.at for x in ready if not x.discovery}, confirmed(f, frames, settings), settings)
    out = []
    for n, (t, _) in enumerate(f.closed):
        if n not in good and f.lines.lengths[t.best] >= 3 and t.height >= settings.min_height:
            p = max(t.places, key=lambda p: f.lines.sure[p])
            out.append((float(f.times[p]), f.lines.take([p])))
    return out


def verification_targets(lines: DataFrame, keys: list[str], duration_us: str = "duration_us", settings: Settings = Settings()) -> DataFrame:
    """The lines (keys, ``at_us``, ``text``, ``confidence``, box) of rows like those of ``track_cues`` that want confirmation."""

    def run(found: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = unsupported(list(frames_of(rows)), float(rows[duration_us].iloc[0]) / 1e6, settings)
        return _keyed([(round(at * 1e6), x.words[0].text, float(x.sure[0]), *x.box[0].tolist()) for at, x in made], ["at_us", "text", "confidence", "left", "top", "right", "bottom"], keys, found)

    types = dict(lines.dtypes)
    return _dealt(lines, keys).groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", at_us long, text string, confidence double, left double, top double, right double, bottom double")


def owned(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, ``start_us``, ``end_us``, ``text``, box) with each moment of a text given to one of them, the longest first."""
    types = dict(runs.dtypes)
    box = ["left", "top", "right", "bottom"]

    def run(found: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_us", "end_us", "text", "top", "bottom", "left", "right"])
        s = S.sheet([(t, None, *b, None) for t, *b in zip(rows.text, *(rows[x] for x in box), strict=True)])
        made = S.owners(rows.start_us.tolist(), rows.end_us.tolist(), s)
        return _keyed([(a, b, x.words[0].text) for a, b, x in made], ["start_us", "end_us", "text"], keys, found)

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", start_us long, end_us long, text string"
    return _dealt(runs, keys).groupBy(*keys).applyInPandas(run, schema)
