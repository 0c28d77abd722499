"""Every query with SQL gives the rows that DuckDB gives, over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from spanloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return db


def rows_of(frame):
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        return x.item() if hasattr(x, "item") else x

    return sorted(repr([plain(x) for x in row]) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_the_queries_without_sql_are_these(spark):
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"sequence_ratio", "track_entities"}


def test_ratios_of_matching_blocks(spark):
    """By the definition: the longest common stretch, then what lies before and after it."""

    def same(a, b):
        best = (0, 0, 0)
        run = {}
        for i in range(len(a)):
            now = {}
            for j in range(len(b)):
                if a[i] == b[j]:
                    now[j] = run.get(j - 1, 0) + 1
                    if now[j] > best[0]:
                        best = (now[j], i - now[j] + 1, j - now[j] + 1)
            run = now
        n, i, j = best
        return n and n + same(a[:i], b[:j]) + same(a[i + n :], b[j + n :])

    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {r.item_id: r.ratio for r in registry.queries()["sequence_ratio"](spark, SF).collect()}
    assert set(found) == {i for i in texts if i + 1 in texts}
    for i in sorted(found)[:6]:
        assert found[i] == round(2 * same(texts[i], texts[i + 1]) / (len(texts[i]) + len(texts[i + 1])), 6)


def test_cues_of_turns_by_hand(spark):
    """A turn's line is up from its first reading until the next turn's line takes its place, or the hold time ends."""
    from spanloom.functions import text as X

    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, " ".join(r.text.split())))
    found = {}
    for r in registry.queries()["track_entities"](spark, SF).collect():
        found.setdefault(r.conv_id, []).append((r.start_us, r.end_us, r.text))
    tried = 0
    for conv, own in turns.items():
        own.sort()
        keys = [X.key_of(t) for _, t in own]
        # conversations whose turns are distinct texts that don't contain or resemble one another
        if len({n for n, _ in own}) < len(own) or any(not a for a in keys) or any(i != j and (a in b or X.same_text_of(own[i][1], own[j][1], 0.7)) for i, a in enumerate(keys) for j, b in enumerate(keys)):
            continue
        tried += 1
        ends = [n * 10_000_000 for n, _ in own[1:]] + [own[-1][0] * 10_000_000 + 31_000_000]
        want = [(n * 10_000_000, min(end, n * 10_000_000 + 31_000_000), t) for (n, t), end in zip(own, ends, strict=True)]
        assert sorted(found[conv]) == want
    assert tried >= 5


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
