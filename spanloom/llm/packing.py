"""Mixture-controlled packing of token streams into sequences of fixed length.

Each source is a queue of its documents' tokens. A deficit round-robin fills every window (a sequence): in
each window every queue earns credit in its target proportion, spends the whole tokens of its credit, and
the window's last places go to the largest credits left, which then run a deficit into the next window.
Documents are cut where a window or a turn ends.

Targets are weights of sources, given by the caller. Sources without a weight wait until those with one have
ended, and a source that ends leaves its places to the others, in their proportions. Without targets the
weights are the queues' shares of all tokens, so that all queues end together. A round of ``FRAME`` windows has
whole quotas, after which every deficit is zero; rounds repeat until some queue has less than its quota left,
then quotas are set anew from what remains. Any token's place follows from its place in its queue by
arithmetic: the deficits carry across partitions without a pass over the windows in order.

A source that would get less than half a token of a window (one in ``2 * LENGTH`` of all tokens or less, and
no target) is served whole documents instead, each source by its own share: these sources' documents lie at even
distances along a common stream, which is a queue of its own. So the driver's plan holds at most ``2 * LENGTH``
queues and the caller's targets, whatever the number of sources.

Defined results: a null or empty text is its end mark alone; a null source is the queue of the empty name;
repeated rows, also under one id, are packed once each; an empty table gives no rows; targets for sources that
the table lacks are passed over, and a weight that isn't above zero counts as none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import sliced, stash, texts_of
from .words import LETTERS, NUMBERS, PLAIN_END, SPACES, is_plain, loaded

LENGTH = 2048
FRAME = 64
#: A source with no more than this part of all tokens, and no target, is served whole documents.
LEAST_SHARE = 1 / (2 * LENGTH)
#: Tokens of the rows that are put in order together.
CHUNK_TOKENS = 1 << 19
#: Chunks whose sums are added up in one task.
CHUNKS_AT_ONCE = 10_000
END_ID = 1
#: Entries of the cache of words.
CACHED = 200_000
#: Stands between texts that are split together; no plain text holds it.
BREAK = "\x1f"
SPACE, LETTER, NUMBER, OTHER = range(4)
#: What follows an apostrophe that begins a word of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """The class of each character below ``PLAIN_END``."""
    out = np.full(PLAIN_END, OTHER, np.uint8)
    for kind, members in ((SPACE, SPACES + BREAK), (LETTER, LETTERS), (NUMBER, NUMBERS)):
        out[[i for i in range(PLAIN_END) if re.match(f"[{members}]", chr(i))]] = kind
    return out


CLASSES = _classes()
#: Classes of bytes; those of two-byte characters are filled in, longer plain characters are all of the last class.
BYTE_CLASSES = np.concatenate([CLASSES[:0x80], np.full(0x80, OTHER, np.uint8)])


def words_of(data: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of lower-cased plain texts, given as UTF-8 with ``BREAK`` between, and the words before each break.

    A word is a contraction, a run of letters, one number, or a run of what else isn't white space.
    """
    kind = BYTE_CLASSES[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xC0 + (PLAIN_END >> 6)))
    kind[lead] = kind[lead + 1] = CLASSES[(data[lead].astype(np.int16) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    starts = np.empty(len(data), bool)
    starts[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    digits = np.flatnonzero(kind == NUMBER)
    starts[digits] = (data[digits] & 0xC0) != 0x80
    marks = np.flatnonzero(data == ord("'"))
    marks = marks[starts[marks]]
    for end in CONTRACTIONS:
        own = marks[marks + len(end) < len(data)]
        for i, c in enumerate(end, 1):
            own = own[data[own + i] == ord(c)]
        starts[own + 1] = False
        after = own + len(end) + 1
        starts[after[after < len(data)]] = True
    solid = kind != SPACE
    starts &= solid
    breaks = np.searchsorted(np.flatnonzero(starts), np.flatnonzero(data == ord(BREAK)))
    begins = np.append(np.flatnonzero(starts[solid]), np.count_nonzero(solid))
    return binary_of(begins, data[solid]), breaks


def binary_of(bounds: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    """Values that lie side by side in ``data``, the first from the first of ``bounds`` (bytes) to the second."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64, copy=False)), pa.py_buffer(data)])


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once.

    Words of plain texts are lower-cased and split here as the tokenizer file's normaliser and splitter do,
    mapped to byte symbols, and encoded by the file's model; other texts go to the library whole. Words are
    remembered by number, their ids side by side; a full memory keeps the words met again since it last was.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        from .bpe import byte_symbols

        self.whole = loaded(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.no_truncation()
        self.bare.no_padding()
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.symbols = np.array([ord(x) for x in byte_symbols()], "<u4")
        self.symbols[ord(" ")] = ord(" ")
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.numbers: dict[bytes, int] = {}
        self.ids, self.bounds, self.again = np.empty(0, self.kind), np.zeros(1, np.int64), np.empty(0, bool)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [is_plain(x) and not any(a in x for a in self.added) for x in texts]
        joined = "".join([(x.lower() if p else "") + BREAK for x, p in zip(texts, plain, strict=True)])
        words, breaks = words_of(np.frombuffer(joined.encode(), np.uint8))
        coded = words.dictionary_encode()
        at = self._numbers_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        size = self.kind.itemsize
        found = binary_of(self.bounds * size, self.ids).take(pa.array(at))
        ids, stops = self.ids[:0], np.zeros(len(texts), np.int64)
        if len(found):
            _, bounds, data = found.buffers()
            ids, stops = np.frombuffer(data, self.kind), np.frombuffer(bounds, np.int64)[breaks] // size
        spans = pairwise([0, *stops.tolist()])
        return [ids[a:b] if p else np.array(self.whole.encode(x, add_special_tokens=False).ids, self.kind) for x, p, (a, b) in zip(texts, plain, spans, strict=True)]

    def _numbers_of(self, words: list[bytes]) -> np.ndarray:
        """The number of each of distinct words; those that aren't known are learned."""
        if len(self.numbers) > CACHED:
            self._forget()
        at = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))
        gaps = at < 0
        self.again[at[~gaps]] = True
        new = list(compress(words, gaps))
        if new:
            first = len(self.numbers)
            at[gaps] = np.arange(first, first + len(new), dtype=np.int32)
            self._learn(new)
        return at

    def _learn(self, new: list[bytes]) -> None:
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            symbols = self.symbols[np.frombuffer(b" ".join(some), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.bare.encode_batch_fast([symbols], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError(f"{len(some)} words gave {len(stops)} ends of words")
            first = len(self.numbers)
            self.numbers.update(zip(some, range(first, first + len(some)), strict=True))
            self.bounds = np.append(self.bounds, stops + len(self.ids))
            self.ids = np.append(self.ids, ids)
            self.again = np.append(self.again, np.zeros(len(some), bool))

    def _forget(self) -> None:
        """Keep the words met again; none, if that leaves no room."""
        kept = np.flatnonzero(self.again)
        if 2 * len(kept) > CACHED:
            kept = kept[:0]
        words = compress(self.numbers, self.again) if len(kept) else ()
        self.numbers = {w: i for i, w in enumerate(words)}
        self.ids = self.ids[np.repeat(self.again, np.diff(self.bounds))] if len(kept) else self.ids[:0]
        self.bounds = np.concatenate([[0], np.cumsum(np.diff(self.bounds)[kept])]).astype(np.int64)
        self.again = np.zeros(len(kept), bool)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenise(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``__id``, ``__source``, ``n`` and ``ids``: the packed ids of each document with the end mark."""
    rows = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        end = np.array([END_ID], "<u4").astype(coder.kind).tobytes()
        for batch in sliced(batches, 1000):
            ids = coder.encode(texts_of(batch.column("__text")))
            counts = pa.array([len(x) + 1 for x in ids], pa.int64())
            data = pa.array([x.tobytes() + end for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__source"), counts, data], ["__id", "__source", "n", "ids"])

    return rows.mapInArrow(run, f"__id {dict(rows.dtypes)['__id']}, __source string, n long, ids binary")


@dataclass(frozen=True)
class Round:
    """``repeats`` rounds of the same quotas, from ``window``, each queue from ``starts``; a round has ``windows``."""

    window: int
    repeats: int
    windows: int
    starts: np.ndarray
    quotas: np.ndarray


def apportion(shares: np.ndarray, places: int) -> np.ndarray:
    """``places`` in proportion to whole ``shares``, by largest remainder; none above its share while they suffice."""
    total = int(shares.sum())
    exact = [int(x) * places for x in shares]
    out = np.array([x // total for x in exact], np.int64)
    order = sorted(range(len(shares)), key=lambda i: (-(exact[i] % total), i))
    out[order[: places - int(out.sum())]] += 1
    return out


def _turns(quotas: np.ndarray, length: int) -> np.ndarray:
    """Tokens of each queue in each window (windows x queues) by deficit round-robin, the last window the rest."""
    total, left = int(quotas.sum()), quotas.astype(np.int64)
    credit, out = np.zeros(len(quotas), np.int64), []
    while places := min(length, int(left.sum())):
        credit = credit + quotas * places
        take = np.clip(credit // total, 0, left)
        # by the credit that is left, the first queue first
        order = np.argsort(take * total - credit, kind="stable")
        while (short := places - int(take.sum())) > 0:
            take[order[(take < left)[order]][:short]] += 1
        while (over := int(take.sum()) - places) > 0:
            take[order[::-1][(take > 0)[order[::-1]]][:over]] -= 1
        credit, left = credit - take * total, left - take
        out.append(take)
    return np.array(out, np.int64).reshape(-1, len(quotas))


@lru_cache(maxsize=64)
def _turns_of(quotas: bytes, length: int) -> np.ndarray:
    return _turns(np.frombuffer(quotas, np.int64), length)


def round_robin(quotas: np.ndarray, length: int) -> np.ndarray:
    return _turns_of(np.ascontiguousarray(quotas, np.int64).tobytes(), length)


def _filled(left: np.ndarray, weights: np.ndarray, places: int) -> np.ndarray:
    """``places`` of one window by weight, no queue above what it has left; its surplus goes to the others."""
    out = np.zeros_like(left)
    for tier in (weights, np.where(weights > 0, 0, left)):
        while (open_ := places - int(out.sum())) > 0 and (some := (tier > 0) & (out < left)).any():
            out = np.minimum(left, out + apportion(np.where(some, tier, 0), open_))
    return out


def schedule(totals: np.ndarray, length: int = LENGTH, frame: int = FRAME, weights: np.ndarray | None = None) -> list[Round]:
    """The rounds that place all tokens of the queues, by ``weights`` (whole, 0 for none), else by what is left."""
    left, used, window, out = np.array(totals, np.int64), np.zeros(len(totals), np.int64), 0, []
    while total := int(left.sum()):
        live = left if weights is None else np.where(left > 0, weights, 0)
        if not live.any():
            live = left
        repeats = 1
        if total <= length or (live is left and total <= frame * length):
            quotas = left
        else:
            # as many windows as every queue's weight can be met in, a frame at most
            fits = min(int(x) * int(live.sum()) // (int(w) * length) for x, w in zip(left, live, strict=True) if w)
            windows = min(frame, fits, total // length)
            quotas = apportion(live, windows * length) if windows else left
            while windows and (quotas > left).any():
                windows //= 2
                quotas = apportion(live, windows * length) if windows else left
            if windows:
                repeats = min(int(x) // int(q) for x, q in zip(left, quotas, strict=True) if q)
            else:
                quotas = _filled(left, live, length)
        many = -(-int(quotas.sum()) // length)
        out.append(Round(window, repeats, many, used.copy(), quotas.copy()))
        used, left, window = used + repeats * quotas, left - repeats * quotas, window + repeats * many
    return out


class Places:
    """Where the tokens of one queue go: its turns in order, found from a token's place by arithmetic."""

    def __init__(self, rounds: list[Round], queue: int, length: int = LENGTH):
        own = [r for r in rounds if r.quotas[queue]]
        self.start = np.array([r.starts[queue] for r in own], np.int64)
        self.quota = np.array([r.quotas[queue] for r in own], np.int64)
        self.window = np.array([r.window for r in own], np.int64)
        self.windows = np.array([r.windows for r in own], np.int64)
        # the turns with tokens of each round: size, window, tokens of earlier queues in it and place in the quota
        turns = [(np.flatnonzero(t[:, queue]), t) for t in (round_robin(r.quotas, length) for r in own)]
        self.count = np.array([len(w) for w, _ in turns], np.int64)
        self.index = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        joined = lambda parts: np.concatenate([np.empty(0, np.int64), *parts])
        self.turn = joined(w for w, _ in turns)
        self.size = joined(t[w, queue] for w, t in turns)
        self.base = joined(t[w, :queue].sum(1) for w, t in turns)
        self.place = joined(np.cumsum(t[w, queue]) - t[w, queue] for w, t in turns)
        # turns before each round, its repeats counted
        every = self.count * np.array([r.repeats for r in own], np.int64)
        self.before = np.cumsum(every) - every

    def _turn_at(self, at: np.ndarray) -> np.ndarray:
        """The number of the turn that holds each token."""
        k = np.searchsorted(self.start, at, side="right") - 1
        repeat, inside = np.divmod(at - self.start[k], self.quota[k])
        # places grow within a round; adding a round's width apart makes one sorted list of them
        width = int(self.quota.max()) + 1
        keys = self.place + np.repeat(np.arange(len(self.count)), self.count) * width
        j = np.searchsorted(keys, inside + k * width, side="right") - 1 - self.index[k]
        return self.before[k] + repeat * self.count[k] + j

    def pieces(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """For stretches of ``n`` tokens from ``at``: (stretch, tokens before, length, window, offset) of each piece."""
        first, last = self._turn_at(at), self._turn_at(at + n - 1)
        many = last - first + 1
        of = np.repeat(np.arange(len(at)), many)
        turn = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(of))
        k = np.searchsorted(self.before, turn, side="right") - 1
        repeat, j = np.divmod(turn - self.before[k], self.count[k])
        row = self.index[k] + j
        begin = self.start[k] + repeat * self.quota[k] + self.place[row]
        a, b = np.maximum(begin, at[of]), np.minimum(begin + self.size[row], (at + n)[of])
        return of, a - at[of], b - a, self.window[k] + repeat * self.windows[k] + self.turn[row], self.base[row] + a - begin


def _placed(rows: DataFrame, queue: list[str], order: list[str]) -> DataFrame:
    """``rows`` (with ``__chunk``, ``n``) with ``__at``: the tokens before each in its queue, in order of chunk and ``order``.

    Chunks are summed before they are put in order, and the sums of ``CHUNKS_AT_ONCE`` at a time.
    """
    part = F.floor(F.col("__chunk") / CHUNKS_AT_ONCE).alias("__part")
    sums = stash(rows.groupBy(*queue, "__chunk").agg(F.sum("n").alias("s")).withColumn("__part", part), "chunk-sums")
    parts = sums.groupBy(*queue, "__part").agg(F.sum("s").alias("t"))
    lone = [F.lit(0)] if not queue else [F.col(q) for q in queue]
    parts = parts.select(*queue, "__part", (F.sum("t").over(Window.partitionBy(*lone).orderBy("__part")) - F.col("t")).alias("__earlier"))
    inner = Window.partitionBy(*queue, "__part").orderBy("__chunk")
    before = sums.withColumn("__inner", F.sum("s").over(inner) - F.col("s")).join(parts, [*queue, "__part"]).select(*queue, "__chunk", (F.col("__inner") + F.col("__earlier")).alias("__before"))
    within = Window.partitionBy(*queue, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.join(stash(before, "chunk-starts"), [*queue, "__chunk"])
    return found.withColumn("__at", F.col("__before") + F.sum("n").over(within) - F.col("n"))


def _spread(rows: DataFrame, totals: DataFrame, tokens: int) -> DataFrame:
    """The rows of light sources along one stream, each source's documents at even distances of its tokens.

    A source begins at a place of its own, so those of a single document don't meet.
    """
    timed = rows.join(totals, "__source")
    phase = F.pmod(F.xxhash64("__source"), F.lit(1 << 40)) / float(1 << 40)
    time = F.pmod((F.col("__at") + F.col("n") / 2) / F.col("t") + phase, F.lit(1.0))
    chunk = F.floor(time * max(1, tokens // CHUNK_TOKENS)).cast("long")
    timed = stash(timed.select("__id", "__source", "n", "ids", "__mark", time.alias("__time"), chunk.alias("__chunk")), "spread")
    return _placed(timed, [], ["__time", "__source", "__mark"])


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source", length: int = LENGTH, targets: dict[str, float] | None = None, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per piece: key, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``."""
    # the mark is written with the ids, so it is one for each row whatever reads them
    tokens = stash(tokenise(docs, path, key, text, source).withColumn("__mark", F.monotonically_increasing_id()), "tokens")
    totals = stash(tokens.groupBy("__source").agg(F.sum("n").alias("t")), "queue-totals")
    all_ = totals.agg(F.sum("t")).first()[0] or 0
    weight = {s: int(w * 1_000_000) or 1 for s, w in (targets or {}).items() if w > 0}
    own = (F.col("t") > least_share * all_) | F.col("__source").isin(*weight)
    # at most 1 / least_share sources have more than that share
    heavy = {r["__source"]: r.t for r in totals.where(own).collect()}
    names = sorted(heavy)
    counts = [heavy[x] for x in names]
    rest = all_ - sum(counts)
    weights = [weight.get(x, 0) for x in names]
    if rest:
        counts, weights = [*counts, rest], [*weights, 0]
    rounds = schedule(np.array(counts, np.int64), length, weights=np.array(weights, np.int64) if any(weights) else None)

    chunks = max(1, all_ // CHUNK_TOKENS)
    tokens = tokens.withColumn("__chunk", F.pmod(F.xxhash64("__mark"), F.lit(chunks)))
    columns = ["__id", "__source", "__at", "n", "ids"]
    mine = F.col("__source").isin(*names)
    if not rest:
        placed = _placed(tokens, ["__source"], ["__mark"]).select(*columns)
    else:
        light = _spread(_placed(tokens.where(~mine), ["__source"], ["__mark"]), totals, rest)
        placed = _placed(tokens.where(mine), ["__source"], ["__mark"]).select(*columns).unionByName(light.withColumn("__source", F.lit(None).cast("string")).select(*columns))
    out = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    at_queue = {x: i for i, x in enumerate(names)} | {None: len(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str | None, Places] = {}
        for batch in sliced(batches):
            if not batch.num_rows:
                continue
            queues = np.array(batch.column("__source").to_pylist(), object)
            at, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__at", "n"))
            made = []
            for q in dict.fromkeys(queues):
                if q not in places:
                    places[q] = Places(rounds, at_queue[q], length)
                rows = np.flatnonzero(queues == q)
                of, *found = places[q].pieces(at[rows], n[rows])
                made.append((rows[of], *found))
            row, start, size, window, offset = (np.concatenate(c) for c in zip(*made, strict=True))
            order = np.argsort(row, kind="stable")
            row, start, size, window, offset = (x[order] for x in (row, start, size, window, offset))
            # the pieces of the rows in order are all of their ids in order
            packed = b"".join(batch.column("ids").to_pylist())
            wide = np.frombuffer(packed, "<u2" if len(packed) == 2 * int(n.sum()) else "<u4").astype("<u4")
            ends = np.concatenate([[0], np.cumsum(size) * 4]).astype(np.int64)
            ids = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(wide)]).cast(pa.binary())
            keys = batch.column("__id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(size), ids, pa.array(n[row]), pa.array(window), pa.array(offset)], out)

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(run, schema)
