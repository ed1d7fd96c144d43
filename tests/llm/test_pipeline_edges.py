"""The stages on nulls, empty and long texts, repeated rows and clashing names."""

import importlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import edge_rows, frame, prose

DATA = "/root/testdata/sf0.001"
pipeline = importlib.import_module("corpus_pipeline")
STAGES = dict(pipeline.STAGES)


def hard(spark):
    """Rows with everything odd; SCHEMA has names that operators use (n_lines, _text, id, score, fp)."""
    long = " ".join(prose(k, 200) for k in range(60))
    more = [(20, long, "en", "src0"), (21, long, "en", "src0"), (21, long, "en", "src0"), (22, None, None, None), (23, "word", "xx", "src1")]
    return frame(spark, edge_rows() + more)


@pytest.mark.parametrize("name", list(STAGES))
def test_a_stage_on_hard_rows(spark, name):
    docs = hard(spark)
    out = STAGES[name](spark, docs, DATA)
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and (name.startswith("mixing") or out.columns == docs.columns)
    mine = {(r.doc_id, r.text): r for r in docs.collect()}
    if name == "line dedup":
        assert {r.doc_id for r in rows} >= {1, 2, 3, 4, 20}
    else:
        assert all((r.doc_id, r.text) in mine for r in rows)
    if name == "simhash near-dedup":
        kept = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
        texts = [r.text for r in rows if (r.text or "").split()]
        assert len(texts) == len(set(texts)) and sum(not (r.text or "").split() for r in rows) == 1  # texts without words are one group
        assert (False, 20) in kept and (False, 21) not in kept and (False, 1) in kept and (False, 2) not in kept
    if name == "benchmark decontamination":
        assert len(rows) == docs.count()


def test_a_long_text_with_a_leak_and_copies_goes(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    long = " ".join(prose(k, 300) for k in range(40))
    docs = frame(spark, [(1, long + " " + item, "en", "s"), (2, long, "en", "s"), (3, long + " tail", "en", "s"), (None, long, "en", "s")])
    assert sorted((r.doc_id or -1) for r in STAGES["benchmark decontamination"](spark, docs, DATA).collect()) == [-1, 2, 3]
    assert [r.doc_id for r in STAGES["simhash near-dedup"](spark, docs.where("doc_id is null or doc_id > 1"), DATA).collect()] == [2]


def test_other_languages_and_no_source_are_sampled(spark):
    docs = frame(spark, [(k, prose(k, 30), None if k % 2 else "it", None) for k in range(400)])
    out = STAGES["mixing to target weights"](spark, docs, DATA)
    assert 120 < out.count() < 280 and out.where(F.col("lang").isNull()).count() > 50
