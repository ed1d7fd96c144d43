"""Forms, reported marginals, and the query's SQL on other languages and odd texts."""

import pytest
from pyspark.sql import functions as F

from sharpsieve.llm import mixing
from tests.llm.test_text_operators import edge_rows, frame, prose


@pytest.mark.parametrize(
    ("text", "form"),
    [
        (prose(1), "prose"), ("12 apples 7 pears 3 plums", "figures"), ("a | b | c | d | e", "symbols"), ("STOP IT NOW please do", "capitals"), ("one two\nthree four\nfive", "lines"),
        ("Licensed under the license of many words that go on and on in this very long line of prose", "prose"), ("", "lines"), (None, "lines"), ("\\ ^ [ ] ~", "symbols"),
    ],
)
def test_forms(spark, text, form):
    assert mixing.mix(frame(spark, [(1, text, "en", "src0")])).first().mix_topic == form


def test_reported_marginals(spark):
    rows = [(k, prose(k, 40) if k % 4 else " | ".join(prose(k, 20).split()), ("en", "fr", "it")[k % 3], ("src0", "src1", "other")[k % 3 if k % 5 else 0]) for k in range(900)]
    report = {}
    out = mixing.mix(frame(spark, rows), sources={"src0": 0.5, "src1": 0.2, "*": 0.3}, langs={"en": 0.6, "fr": 0.4, "*": None}, topics={"prose": 0.7, "symbols": 0.3}, fraction=0.3, rounds=600, report=report)
    assert report["off"] < 1e-6
    for axis in ("source", "lang", "topic"):
        assert sum(x["raked"] for x in report[axis].values()) == pytest.approx(1) and all(x["raked"] == pytest.approx(x["target"], abs=1e-6) for x in report[axis].values())
    share = out.groupBy("mix_lang").agg(F.sum(F.col("n_tokens") * F.col("prob")).alias("n")).collect()
    total = sum(r.n for r in share)
    assert all(r.n / total == pytest.approx(report["lang"][r.mix_lang]["drawn"]) for r in share)
    it = sum(r.n_tokens for r in out.where("mix_lang = '*'").collect()) / sum(r.n_tokens for r in out.collect())
    assert report["lang"]["*"]["target"] == pytest.approx(it)


def test_sql_on_odd_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for r in edge_rows() if r[0] not in (None, 7)] + [(k, prose(k, 30) + (" 1 2 3" * 9 if k % 7 == 0 else " | x" * 30 if k % 5 == 0 else ""), ("en", "fr", None, "it")[k % 4], f"src{k % 6}") for k in range(20, 140)]
    docs = frame(spark, rows)
    documents = docs.toPandas()  # noqa: F841
    want = {(r[0], r[1]): r for r in duckdb.sql("SELECT doc_id, mix_topic, mix_source, mix_lang, n_tokens, round(weight, 7), round(prob, 7) FROM (" + mixing.oracle() + ")").fetchall()}
    for r in mixing.mix(docs).collect():
        assert want[r.doc_id, r.mix_topic][2:] == (r.mix_source, r.mix_lang, r._n_tokens if "_n_tokens" in r else r.n_tokens, pytest.approx(r.weight, abs=2e-7), pytest.approx(r.prob, abs=2e-7))
