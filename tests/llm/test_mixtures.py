"""Packing to given mixtures, with more sources than a window has places, and rows under one id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import packing
from spanloom.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


def windows_of(pieces, sources):
    """{window: {source: tokens}}; every window is full but the last, and its offsets have no gap."""
    found, spans = {}, {}
    for r in pieces:
        own = found.setdefault(r.sequence_id, {})
        own[sources[r.doc_id]] = own.get(sources[r.doc_id], 0) + r.length
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    last = max(found)
    for w, own in spans.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == packing.LENGTH or w == last
    return found


def rows_of(spark, sources, words):
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.lit("the")), " ")
    return spark.range(len(sources)).select(F.col("id").alias("doc_id"), body.alias("text")).join(spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string"), "doc_id")


@pytest.mark.parametrize("weights", [None, [3, 1, 0, 2], [1, 0, 0, 0]])
@pytest.mark.parametrize("totals", [[5000, 1, 70_000, 900], [1_000_000, 300_000, 10, 131_073], [2048, 2048, 4096, 2048]])
def test_rounds_place_every_token_once(totals, weights):
    rounds = packing.schedule(np.array(totals), weights=None if weights is None else np.array(weights))
    done, window = np.zeros(4, np.int64), 0
    for r in rounds:
        turns = packing.round_robin(r.quotas, packing.LENGTH)
        assert r.window == window and (r.starts == done).all() and len(turns) == r.windows and (turns.sum(0) == r.quotas).all()
        assert r is rounds[-1] or (turns.sum(1) == packing.LENGTH).all()
        done, window = done + r.repeats * r.quotas, window + r.repeats * r.windows
    assert done.tolist() == totals and window == -(-sum(totals) // packing.LENGTH)


def test_given_targets_fill_every_window_until_a_source_ends(spark):
    sources = ["a"] * 60 + ["b"] * 20 + ["c"] * 20 + ["d"] * 5
    docs = rows_of(spark, sources, 999)
    found = windows_of(packing.pack(docs, PATH, targets={"a": 1, "b": 1, "c": 2, "none": 5, "d": 0}).collect(), sources)
    # c ends first, at twice the pace of b
    ends = 20 * 1000 * 2 // packing.LENGTH
    for w in range(ends - 1):
        assert [abs(found[w].get(s, 0) - packing.LENGTH * p) <= 2 for s, p in zip("abcd", (0.25, 0.25, 0.5, 0), strict=True)] == [True] * 4
    # then a and b share the windows, and what has no target comes last
    assert abs(found[ends + 2]["a"] - packing.LENGTH / 2) <= 2 and "d" not in found[ends + 2]
    assert set(found[max(found)]) == {"d"}


def test_each_of_many_sources_keeps_its_part(spark):
    sources = [f"s{i % 1100}" for i in range(4400)]
    found = windows_of(packing.pack(rows_of(spark, sources, 99), PATH).collect(), sources)
    for w, own in found.items():
        if w != max(found):
            assert len(own) == 1100 and set(own.values()) <= {1, 2, 3}


def test_light_sources_are_spread_by_their_own_parts(spark):
    # 9,000 sources of one document each, 6 of ten times as many tokens, and one of half of all
    sources = [f"x{i}" for i in range(9000)] + [f"y{i % 6}" for i in range(60)] + ["big"] * 9000
    found = windows_of(packing.pack(rows_of(spark, sources, 9), PATH).collect(), sources)
    last = max(found)
    at = {}
    for w, own in found.items():
        if w != last:
            assert abs(own["big"] / packing.LENGTH - 9000 / 18060) < 0.01
        for s in own:
            at.setdefault(s, []).append(w)
    assert len(at) == 9007
    for i in range(6):
        own = sorted(at[f"y{i}"])
        # ten documents of one source lie a tenth of all windows apart
        assert len(own) >= 10 and max(b - a for a, b in zip(own, own[1:], strict=False)) <= last / 10 + 2


def test_rows_under_one_id_lie_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_TOKENS", 500)
    docs = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"))
    pieces = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in pieces) == 1600 and sorted((r.sequence_id, r.offset) for r in pieces) == sorted({(r.sequence_id, r.offset) for r in pieces})
