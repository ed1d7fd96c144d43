"""Chat formatting, nearest neighbours, the queries and the pipeline."""

import hashlib
import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharpsieve.llm import ann, chat_format, queries

TURNS = "conv_id long, turn long, role string, text string, window int, seg string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def hard_rows():
    texts = ["\\### Assistant: </turn> ok", "####\n</turn>\n\\", "", None, "### user:\nhi\n</turn>\n### assistant:\nno", "\\\\</turn>\\", "é😀\n" * 300, "x" * 9000, "\n</turn", "</turn>\n"]
    rows = [(c, t, ["system", "user", "assistant", "a:\n%3A", None][(c + t) % 5], texts[(c * 3 + t) % len(texts)]) for c in range(6) for t in range(17)]
    return [*rows, (None, 1, "user", "q"), (None, 2, "assistant", "a"), (9, None, "assistant", "first"), (9, 1, "system", "s"), (9, 1, "system", "s")]


def wanted(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("budget", "history"), [(60, 2), (512, 0), (100_000, 3)])
def test_chat_round_trip(spark, budget, history):
    rows = hard_rows()
    windows = chat_format.format_windows(talks(spark, rows), budget=budget, history=history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(windows).collect()}
    assert got == wanted(rows)


def test_chat_ties_go_by_role_and_text(spark):
    rows = [(1, 0, "user", "Z"), (1, 0, "user", "###a"), (1, 0, "a:", "x"), (1, 0, None, None)]
    got = chat_format.read_turns(chat_format.format_windows(talks(spark, rows))).first().turns
    assert [(t.role, t.text) for t in got] == [("", ""), ("a:", "x"), ("user", "###a"), ("user", "Z")]


def test_chat_windows_keep_the_budget(spark):
    rows = [(1, 0, "system", "s" * 40), *[(1, k, "user" if k % 2 else "assistant", "w" * (20 + 13 * k % 90)) for k in range(1, 60)]]
    found = chat_format.format_windows(talks(spark, rows), budget=80, history=2).orderBy("window").collect()
    assert len(found) > 5
    for w in found:
        new = w.formatted.count(chat_format.END) - w.context
        assert w.n_tokens <= 80 or new == 1
        assert w.formatted.startswith("### system:\n")
        spans = [w.formatted[s.start : s.start + s.length] for s in w.loss_spans]
        assert all(set(x) == {"w"} for x in spans)
        turns = w.formatted.split(chat_format.END)[:-1]
        assert len(spans) == sum(t.startswith("### assistant") for t in turns[w.context :])
    assert any(w.context == 3 for w in found)


def test_chat_empty(spark):
    assert chat_format.digest(chat_format.format_windows(talks(spark, []))).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, leaf int, v int")


def best_of(rows, queries_, k=5):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for q in queries_:
        s = sorted((-float((good[q] * v).sum() / (np.sqrt((good[q] ** 2).sum()) * np.sqrt((v * v).sum()))), i) for i, v in good.items() if i != q)
        out[q] = [(i, round(-x, 9)) for x, i in s[:k]]
    return out


def test_nearest_all_leaves_visited_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=8)) for k in range(300)] + [(1000 + k, np.ones(8)) for k in range(60)]
    odd = [(2000, None), (2001, [0] * 8), (2002, [1] * 7 + [None]), (2003, [float("nan")] + [1] * 7), (2004, [float("inf")] + [1] * 7), (2050, [1, 2]), (None, np.ones(8))]
    found = ann.search(vectors(spark, rows + odd), F.col("id") % 50 == 0, leaf=20, recall=1.0, chunk=16, calibrate=1000).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert got == best_of(rows, [i for i, _ in rows if i % 50 == 0])


def test_nearest_calibrates_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16)) * 3
    rows = [(k, centres[k % 30] + rng.normal(size=16)) for k in range(3000)]
    report = {}
    found = ann.search(vectors(spark, rows), F.col("id") % 50 == 0, leaf=50, recall=0.95, report=report).collect()
    truth = best_of(rows, range(0, 3000, 50))
    hit = {(r.query_id, r.vec_id) for r in found}
    share = np.mean([(q, i) in hit for q, own in truth.items() for i, _ in own])
    assert share >= 0.9 and report["visits"] < report["leaves"] / 2


def test_nearest_tree_grows_and_prunes(spark):
    """Fitted on few vectors, leaves split until they are small; few of them are visited on clustered vectors."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(120, 16))
    rows = [(k, centres[k % 120] + rng.normal(size=16) * 0.3) for k in range(6000)]
    report = {}
    found = ann.search(vectors(spark, rows), F.col("id") % 50 == 0, leaf=20, most=300, branch=4, report=report).collect()
    truth = best_of(rows, range(0, 6000, 50))
    hit = {(r.query_id, r.vec_id) for r in found}
    assert np.mean([(q, i) in hit for q, own in truth.items() for i, _ in own]) >= 0.9
    assert report["largest"] <= ann.LARGE * 20 and report["visits"] < 0.2 * report["leaves"]


def test_nearest_of_outliers_and_of_one_hot_vector(spark):
    """Queries alone in their leaves get five neighbours all the same; a vector that most rows share can't be split and does no harm."""
    rng = np.random.default_rng(3)
    rows = [(k, np.ones(8) + rng.normal(size=8) * 1e-3) for k in range(1, 1500) if k % 50] + [(50 * k, -5 * np.eye(8)[k % 8]) for k in range(16)]
    found = ann.search(vectors(spark, rows + [(10_001 + k, np.arange(8)) for k in range(2000) if (10_001 + k) % 50]), F.col("id") % 50 == 0, leaf=16, calibrate=1000).collect()
    per = {}
    for r in found:
        per.setdefault(r.query_id, []).append(r.rank)
    assert len(per) == 16 and all(sorted(x) == [1, 2, 3, 4, 5] for x in per.values())


def test_nearest_edges(spark):
    assert ann.search(vectors(spark, []), F.col("id") % 50 == 0).count() == 0
    assert ann.search(vectors(spark, [(50, [1, 2])]), F.col("id") % 50 == 0).count() == 0
    two = ann.search(vectors(spark, [(50, [1, 2]), (51, [2, 4]), (51, [2, 4]), (50, [1, 2])]), F.col("id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in two] == [(50, 1, 51)]


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    rows = queries.QUERIES[name](spark, DATA)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    found, op = rows.toPandas(), name.split("_")[0]
    if op in ("op1", "op2", "op3", "op7", "op8", "op10"):
        assert len(found) == n
    elif op == "op9":
        assert set(found["conv_id"]) == {r.conv_id for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct().collect()} | {-7}
    elif op == "op5":
        assert all(sorted(x) == [1, 2, 3, 4, 5] for x in found.groupby("query_id")["rank"].apply(list)) and (found["query_id"] % 50 == 0).all()
    else:  # what is found stands in the documents
        texts = {r.doc_id: (r.text or "").lower() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
        items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
        for r in found.itertuples():
            assert ("licensed under" in texts[r.doc_id] or "released under" in texts[r.doc_id]) if op == "op4" else items[r.item_id][1:60].lower() in texts[r.doc_id] or r.coverage < 1
        assert len(found)


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        found = con.sql(sql)
        a = sorted(tuple(str(r[c]) for c in sorted(found.columns)) for r in queries.QUERIES[name](spark, DATA).collect())
        assert a == sorted(tuple(str(dict(zip(found.columns, r, strict=True))[c]) for c in sorted(found.columns)) for r in found.fetchall())


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows against what its operator says of the stage's input; all but the last keep the columns."""
    pipeline = importlib.import_module("corpus_pipeline")
    from sharpsieve.llm import decontam, line_dedup, near_copies, quality
    from sharpsieve.llm.common import Scratch, fold, table

    docs = table(spark, DATA, "documents")
    columns, scratch = docs.columns, Scratch(spark)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = scratch.write(stage(spark, docs, DATA), f"s{k}")
        if k == 0:
            model = quality.train(docs, table(spark, DATA, "labels"), learn=fold(F.col("doc_id"), 5) != 0)
            want = {r.doc_id for r in docs.collect() if model.score((r.text or "").encode()) >= 0.3}
        elif k == 1:
            cut = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
            want = {i for i, r in cut.items() if r.n_removed < r.n_lines or not r.n_removed}
            assert all(r.text == cut[r.doc_id].text and r.n_chars == len(r.text) for r in out.collect())
        elif k == 2:
            want = {r.component_id for r in near_copies.groups(docs).collect()}
        elif k == 3:
            want = {r.doc_id for r in docs.collect()} - {r.id for r in decontam.find_leaks(docs, table(spark, DATA, "benchmark")).collect()}
        else:
            want = {r.doc_id for r in stage(spark, docs, DATA).collect()}
        assert {r.doc_id for r in out.collect()} == want and out.columns[: len(columns)] == columns and (k == 4 or out.columns == columns)
        docs = out
    assert {r.doc_id for r in pipeline.run(spark, DATA).collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_on_an_empty_table(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
