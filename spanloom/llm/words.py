"""What the tokenizer operators share: character classes, caches of bounded size."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: Texts of these characters alone are split here; others are left to the tokenizers library, whose
#: classes follow another version of Unicode. Up to U+017F, but for U+0130, text is its own NFC form.
PLAIN_END = 0x180
_ODD = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f\u2010-\u2027\u20ac]")
_ODD_ASCII = re.compile("[\x1c-\x1f]")


def is_plain(text: str) -> bool:
    return not (_ODD_ASCII if text.isascii() else _ODD).search(text)


def joined_ids(lists: pa.ListArray, cache: Recent, learn: Callable[[list], None], kind: np.dtype) -> list[np.ndarray]:
    """For each list of words the ids of its words in a row, each distinct word of the batch looked up once."""
    coded = lists.flatten().dictionary_encode()
    packed = cache.look_up(coded.dictionary.to_pylist(), learn)
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // kind.itemsize
    tokens = np.frombuffer(b"".join(packed), kind)
    at = coded.indices.to_numpy(zero_copy_only=False)
    n = sizes[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    starts = np.cumsum(sizes) - sizes
    ids = tokens[np.repeat(starts[at] - (ends - n), n) + np.arange(total)] if total else tokens[:0]
    offsets = lists.offsets.to_numpy()
    stops = np.concatenate([[0], ends])[offsets - offsets[0]]
    return [ids[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


def _class(pattern: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(PLAIN_END) if regex.match(pattern, chr(i)))


LETTERS, NUMBERS = _class(r"\p{L}"), _class(r"\p{N}")
#: White space below U+0180.
SPACES = re.escape(" \t\n\x0b\x0c\r\x85\xa0")


class Recent:
    """A cache of two generations: what a full young generation still uses moves on, the rest is dropped."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def missing(self, keys: list) -> list:
        young, old = self.young, self.old
        out = []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out

    def look_up(self, keys: list, learn: Callable[[list], None]) -> list:
        """The values of distinct keys; ``learn`` adds those that are in no generation."""
        self.turn()
        get = self.young.get
        found = list(map(get, keys))
        gaps = [i for i, v in enumerate(found) if v is None]
        new = self.missing([keys[i] for i in gaps])
        if new:
            learn(new)
        for i in gaps:
            found[i] = get(keys[i])
        return found

    def turn(self) -> None:
        """Between batches, so that a batch finds all of its keys in the young generation."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}


@contextmanager
def uncollected() -> Iterator[None]:
    """Without collection of cycles: the many short lists of a batch set it off again and again, and none is one."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=4)
def loaded(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found
