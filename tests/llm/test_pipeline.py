"""The pipeline against its stages by plain versions, and over odd rows stage by stage."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from spanloom.llm import packing, quality, shared, surrogates
from spanloom.llm.queries import QUERY_KEY, tokenizer
from tests.llm.test_operators import ODD, SCHEMA, SF, check_pieces, plain_components


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_pipeline_equals_its_stages(spark, docs):
    rows, held = docs, []
    for _, stage in P.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, SF).collect(), docs.schema)
        assert rows.columns == docs.columns
        held.append({r.doc_id: r for r in rows.collect()})
    judged = {r.doc_id for r in docs.collect() if not any(rule.rejects(quality.Text(r.text)) for rule in quality.RULES)}
    after_quality, after_language, after_copies, after_names = held
    assert set(after_quality) == judged and len(after_language) >= 0.99 * len(judged)
    components = plain_components([(i, r.text) for i, r in after_language.items()])
    assert set(after_copies) == {c for _, c in components.values()}
    assert set(after_names) == set(after_copies)
    assert all(after_names[i].text == surrogates.replaced(r.text, QUERY_KEY, {})[0] for i, r in after_copies.items() if not any(e.kind == "name" for e in surrogates.entities(r.text)))
    check_pieces(packing.pack(rows, tokenizer("word_bpe_49k.json")).collect(), [r.text for r in after_names.values()])
    run = P.run(spark, SF)
    assert run.agg(F.sum("length")).first()[0] == packing.pack(rows, tokenizer("word_bpe_49k.json")).agg(F.sum("length")).first()[0]


def test_every_stage_over_odd_rows(spark):
    prose = (
        "The house at the end of our road was sold in May to a family with two dogs, and nobody knew why it had stood empty for so long. "
        "Some said that the roof leaked whenever rain came from the west; others blamed an old quarrel over who might use the well behind its garden. "
    )
    body = [(20, prose + "Mr Smith has it.", "en", "s", 1), (20, prose + "Mr Smith has it.", "en", "s", 1), (20, " ".join(reversed(prose.split())), "en", None, 1), (None, prose + "x", None, "s", None), (21, prose.upper(), "en", "t", 0)]
    odd = spark.createDataFrame([*ODD, *body], SCHEMA).withColumns({"kept": F.lit(1), "language": F.lit("z"), "__row": F.lit(2), "__id": F.lit("y")})
    before = spark.conf.get(P.BATCH_SETTING)
    rows = odd
    for name, stage in P.STAGES:
        made = stage(spark, rows, SF)
        empty = stage(spark, rows.where("false"), SF)
        assert empty.count() == 0, name
        if name != "packing":
            assert made.columns == odd.columns and empty.columns == odd.columns
            rows = spark.createDataFrame(made.collect(), odd.schema)
    spark.conf.set(P.BATCH_SETTING, before)
    ids = sorted(str(r.doc_id) for r in rows.collect())
    assert ids and set(ids) <= {"20", "None"}
    assert made.agg(F.sum("length")).first()[0] > 0


def test_a_run_leaves_no_tables_but_its_own(spark):
    folder = shared.shared_dir(spark).removeprefix("file://") + "/spanloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    setting = spark.conf.get(P.BATCH_SETTING)
    out = P.run(spark, SF)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and out.count() > 0 and spark.conf.get(P.BATCH_SETTING) == setting


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(ValueError, match="share"):
        shared.shared_dir(Session())
