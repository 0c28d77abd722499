"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

The leaf of a symbol holds the rank of the pair it begins, with its place as the tie-breaker, so the root is
the leftmost pair of lowest rank. A merge changes three leaves and their paths to the root; encoding a
pretoken ends when the root holds no pair. ``Encoder`` builds the trees of many short pretokens side by side
in arrays, one column each; a long pretoken has a tree of its own.

The vocabulary and merges are read from a tokenizer file given by path; pre-tokenisation is that of the
byte-level scheme, and strings of added tokens in a text become their ids.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows get equal
results; a text of any length is encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sliced, texts_of
from .words import LETTERS, NUMBERS, SPACES, Recent, is_plain, joined_ids, loaded, uncollected

#: The byte-level scheme's split, for plain texts.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
NONE = np.iinfo(np.int32).max
#: Pretokens of up to this many bytes share arrays.
SHORT = 64
#: Entries of the caches of what stands between spaces, and of pretokens.
CACHED, CACHED_PRETOKENS = 700_000, 300_000
FIRST = "\x01"
#: Where a space is followed by more white space, pretokens reach over the space.
WIDE_SPACE = re.compile(rf" [{SPACES}]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Symbols of bytes, the bytes of every id, and a table from pairs of ids to ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        ids: dict[str, int] = content["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.first = np.array([ids[c] for c in symbols], np.int32)
        self.bytes: list[bytes] = [b""] * (max([*ids.values(), *(t["id"] for t in content["added_tokens"])]) + 1)
        for text, i in ids.items():
            self.bytes[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs):
            self.rank.setdefault((ids[a], ids[b]), r)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.size = len(self.bytes)
        self.decimal = [str(i) for i in range(self.size)]
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._hashed()

    def _hashed(self) -> None:
        """An open-addressed table of the pairs, probed in arrays."""
        bits = max(4, (4 * len(self.rank)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 64, -1, np.int64)
        self.ranks = np.full((1 << bits) + 64, NONE, np.int32)
        self.probes = 1
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        for key, at, r in zip(keys.tolist(), self._slot(keys).tolist(), self.rank.values(), strict=True):
            start = at
            while self.keys[at] != -1:
                at += 1
            self.keys[at], self.ranks[at] = key, r
            self.probes = max(self.probes, at - start + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE where there is none or an id is negative."""
        keys = (a.astype(np.int64) << 32) | b
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        open_rows = np.flatnonzero((a >= 0) & (b >= 0))
        for step in range(self.probes):
            if not len(open_rows):
                break
            place = at[open_rows] + step
            there = self.keys[place]
            hit = there == keys[open_rows]
            out[open_rows[hit]] = self.ranks[place[hit]]
            open_rows = open_rows[~hit & (there != -1)]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_one(vocab: Vocabulary, token: bytes) -> list[int]:
    """The ids of one pretoken by one segment tree."""
    symbols = [int(vocab.first[b]) for b in token]
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 1).bit_length()
    rank, merged = vocab.rank, vocab.merged
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none = (NONE, 0)
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = rank.get((symbols[i], symbols[i + 1]))
        if r is not None:
            tree[width + i] = (r, i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: tuple[int, int]) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            best = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best

    while tree[1] is not none and tree[1][0] != NONE:
        r, i = tree[1]
        j = after[i]
        symbols[i], symbols[j] = int(merged[r]), -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        for at in (i, before[i]):
            if at >= 0:
                right = after[at]
                r = rank.get((symbols[at], symbols[right])) if right < n else None
                put(at, none if r is None else (r, at))
    return [x for x in symbols if x >= 0]


def encode_many(vocab: Vocabulary, tokens: list[bytes], width: int) -> list[bytes]:
    """The packed ids of pretokens of at most ``width`` bytes, a power of two; a tree in each column."""
    count = len(tokens)
    lengths = np.array([len(t) for t in tokens], np.int64)
    raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(count, width)
    symbols = vocab.first[raw].T.copy()
    places = np.arange(width, dtype=np.int32)[:, None]
    symbols[places >= lengths] = -1
    after = np.repeat(places + 1, count, 1)
    before = np.repeat(places - 1, count, 1)
    tree = np.full((2 * width, count), NONE, np.int32)
    if width > 1:
        first = vocab.ranks_of(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(width - 1, count)
        tree[width : 2 * width - 1] = np.where(first == NONE, NONE, first * np.int32(width) + places[:-1])
        for k in range(width - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])

    # flat views: element (row, column) is at row * count + column
    flat, sym, nxt, prv = tree.reshape(-1), symbols.reshape(-1), after.reshape(-1), before.reshape(-1)

    def climb(rows: np.ndarray, columns: np.ndarray) -> None:
        node = rows + width
        for _ in range(width.bit_length() - 1):
            node = node >> 1
            at = node * 2 * count + columns
            flat[node * count + columns] = np.minimum(flat[at], flat[at + count])

    live = np.flatnonzero(tree[1] != NONE)
    while len(live):
        root = tree[1, live]
        i = (root % width).astype(np.int64)
        at = i * count + live
        j = nxt[at].astype(np.int64)
        jat = j * count + live
        sym[at] = vocab.merged[root // width]
        sym[jat] = -1
        end = nxt[jat].astype(np.int64)
        nxt[at] = end
        inner = end < width
        prv[(end * count + live)[inner]] = i[inner]
        right = np.full(len(live), -1, np.int32)
        right[inner] = sym[(end * count + live)[inner]]
        ranks = vocab.ranks_of(sym[at], right)
        flat[(i + width) * count + live] = np.where(ranks == NONE, NONE, ranks * np.int32(width) + i.astype(np.int32))
        flat[(j + width) * count + live] = NONE
        p = prv[at].astype(np.int64)
        has = p >= 0
        pc, pr = live[has], p[has]
        ranks = vocab.ranks_of(sym[pr * count + pc], sym[at[has]])
        flat[(pr + width) * count + pc] = np.where(ranks == NONE, NONE, ranks * np.int32(width) + pr.astype(np.int32))
        climb(i, live)
        climb(j, live)
        climb(pr, pc)
        live = live[tree[1, live] != NONE]

    columns = symbols.T
    kept = columns >= 0
    packed = columns[kept].astype(vocab.kind).tobytes()
    ends = np.cumsum(kept.sum(1)) * vocab.kind.itemsize
    return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    """Whole texts to packed ids, the pretokens cached."""

    def __init__(self, path: str):
        self.path, self.vocab = path, vocabulary(path)
        self.spaced, self.pretokens = Recent(CACHED), Recent(CACHED_PRETOKENS)

    def _split(self, text: str) -> list[str]:
        if is_plain(text):
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in loaded(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """In a plain text whose spaces stand alone, no pretoken reaches over a space but to begin with it, so
        what follows a space is looked up before it is split further; ``FIRST`` marks what follows none."""
        with uncollected():
            simple = [is_plain(x) and FIRST not in x and not WIDE_SPACE.search(x) and not any(a in x for a in self.vocab.added) for x in texts]
            rows = pc.split_pattern(pa.array([FIRST + x if s and x else None for x, s in zip(texts, simple, strict=True)], pa.string()), " ")
            found = joined_ids(rows, self.spaced, self._learn_spaced, self.vocab.kind)
            return [ids if s else self._encode_odd(x) for x, s, ids in zip(texts, simple, found, strict=True)]

    def _encode_odd(self, text: str) -> np.ndarray:
        vocab = self.vocab
        own: list = []
        for piece in vocab.added_split.split(text) if vocab.added_split else [text]:
            own += [vocab.added[piece]] if piece in vocab.added else self._split(piece) if piece else []
        distinct = list(dict.fromkeys(own))
        ids = dict(zip(distinct, self.pretokens.look_up(distinct, self._learn), strict=True))
        return np.frombuffer(b"".join(map(ids.__getitem__, own)), vocab.kind)

    def _learn_spaced(self, new: list[str]) -> None:
        young = self.spaced.young
        found = [SPLIT.findall(x[1:] if x.startswith(FIRST) else " " + x) for x in new]
        distinct = list({p for own in found for p in own})
        ids = dict(zip(distinct, self.pretokens.look_up(distinct, self._learn), strict=True))
        for x, own in zip(new, found, strict=True):
            young[x] = ids[own[0]] if len(own) == 1 else b"".join([ids[p] for p in own])

    def _learn(self, new: list) -> None:
        vocab, young = self.vocab, self.pretokens.young
        by_width: dict[int, list] = {}
        for x in new:
            if isinstance(x, int):
                young[x] = np.array([x], vocab.kind).tobytes()
                continue
            data = x.encode()
            if len(data) > SHORT:
                young[x] = np.array(encode_one(vocab, data), vocab.kind).tobytes()
            else:
                by_width.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((x, data))
        for width, found in by_width.items():
            for at in range(0, len(found), 20_000):
                some = found[at : at + 20_000]
                for (x, _), ids in zip(some, encode_many(vocab, [d for _, d in some], width), strict=True):
                    young[x] = ids

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocab.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per document: the key, ``n_tokens``, and ``ids`` with the ``decoded`` text or, with ``digests``, their SHA-256."""
    source = docs.select(F.col(key), F.col(text).alias("__text"))
    names = [key, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        decimal = coder.vocab.decimal
        for batch in sliced(batches, 2000):
            ids = coder.encode(texts_of(batch.column("__text")))
            counts = pa.array([len(x) for x in ids], pa.int64())
            if digests:
                first = pa.array([hashlib.sha256(",".join(map(decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids], pa.string())
                second = pa.array([hashlib.sha256(coder.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string())
            else:
                first = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                second = pa.array([coder.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), counts, first, second], names)

    kind = dict(source.dtypes)[key]
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long, {rest}")
