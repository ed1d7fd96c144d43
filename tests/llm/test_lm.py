"""The language model against a statement of it in plain Python."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sharpsieve.llm import maxent
from tests.llm.test_text_operators import edge_rows, frame

M32 = (1 << 32) - 1


def mixed_up(x):
    return (x ^ x >> 15) & M32


def plain_rows(code, history):
    """The rows of the two softmaxes for a word's code after the codes of the three before it (0 and so on: the end)."""
    bits = 32 - maxent.ROW_BITS
    (c1, h1), (c2, h2), (c3, _) = history
    m = int(maxent._M)
    pair = (h1 * 31 + h2) * m & M32
    past = ((c3 * 256 + c2) * 256 + c1 + 1) * m & M32
    of_class = [0, h1 >> bits, h2 >> bits, (mixed_up(pair) * m & M32) >> bits, past >> bits]
    crossed = [((mixed_up(h) + code[0] * 0x85EBCA6B) & M32) * m & M32 for h in (h1, h2)]
    return of_class, [code[0], *((x ^ x >> 13) >> bits for x in crossed)]


def chance(weights, rows, goal):
    sums = [sum(float(weights[t, r, k]) for t, r in enumerate(rows)) for k in range(weights.shape[2])]
    return math.exp(sums[goal]) / sum(math.exp(x) for x in sums)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(0)
    pool = "ant bee cat dog elk fox gnu hen ibis jay kite lark mole newt owl pig".split()
    rows = [*edge_rows(), *[(k, " ".join(rng.choice(pool, 40)), "en", "s") for k in range(100, 160)]]
    report = {}
    found = maxent.score(frame(spark, rows), learn=F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False)), classes=5, block=700, report=report).collect()
    return rows, found, report


def probability(word, history, counts, report):
    """P(word | the words before it), from the model's parts."""
    named = report["classes"]
    codes = [int(x) for x in named.codes([word, *history])]
    parts = [(c >> maxent._CLASS, c >> maxent._SLOT & 31, ((c >> maxent._HASH & 0xFFFFF) * int(maxent._M)) & M32) for c in codes]
    (k, slot, _), past = parts[0], [(c, h) for c, _, h in parts[1:]]
    of_class, of_slot = plain_rows((k, slot), past)
    cell = k * maxent.SLOTS + slot
    inside = (counts[word] + 0.5) / (report["cell_n"][cell] + 0.5 * (report["cell_v"][cell] + 1))
    return chance(report["weights"][0], of_class, k) * chance(report["weights"][1], of_slot, slot) * inside


def test_scores_are_the_products_of_plain_probabilities(fitted):
    rows, found, report = fitted
    low = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = Counter(w for i, t, *_ in rows if i is not None and i % 5 != 1 for w in low(t))
    want = []
    for i, t, *_ in rows:
        if len(t or "") > 5000:
            continue
        words = low(t)
        before = [b"\n"] * 3 + words
        want.append((i is None, i or 0, len(words), sum(math.log10(probability(w, before[j : j + 3][::-1], counts, report)) for j, w in enumerate(words))))
    got = sorted((r.id is None, r.id or 0, r.n_tokens, r.score) for r in found if r.n_tokens < 1000)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-3)


def test_probabilities_of_the_vocabulary_sum_to_one(fitted):
    rows, _, report = fitted
    counts = Counter(w for i, t, *_ in rows if i is not None and i % 5 != 1 for w in (t or "").encode().lower().split() + [b"\n"])
    history = [b"cat", b"ant", b"\n"]
    known = sum(probability(w, history, counts, report) for w in counts)
    codes = {int(c) >> maxent._CLASS: int(c) for c in report["classes"].codes(list(counts))}
    unseen = 0.0
    for k in range(report["classes"].n):
        parts = [int(x) for x in report["classes"].codes(history)]
        past = [(c >> maxent._CLASS, ((c >> maxent._HASH & 0xFFFFF) * int(maxent._M)) & M32) for c in parts]
        of_class, of_slot = plain_rows((k, 0), past)
        for slot in range(maxent.SLOTS):
            cell = k * maxent.SLOTS + slot
            unseen += chance(report["weights"][0], of_class, k) * chance(report["weights"][1], of_slot, slot) * 0.5 / (report["cell_n"][cell] + 0.5 * (report["cell_v"][cell] + 1))
    assert codes and known + unseen == pytest.approx(1, abs=1e-6)


def test_held_out_texts_score_above_unigrams(fitted, spark):
    from sharpsieve.llm import queries

    rows = queries.op3_lm_score(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert np.mean([r.score > r.base_score for r in rows]) > 0.9


def test_words_of_blocks_come_back_many_to_a_row(spark):
    words = [b"\n", b"long" * 300_000, *(b"w%d" % k for k in range(20_000))]
    counts = np.arange(len(words)) % 7
    packed = maxent.pieces(words, counts)
    batch = pa.RecordBatch.from_arrays([pa.array([5] * len(packed)), pa.array(packed, pa.binary())], names=["block", "piece"])
    found = list(maxent.spread(iter([batch])))
    assert max(x.num_rows for x in found) < 10_000
    assert [tuple(r.values()) for x in found for r in x.to_pylist()] == [(5, k, w, int(n)) for k, (w, n) in enumerate(zip(words, counts, strict=True))]

    rng = np.random.default_rng(3)
    sent = [(rng.integers(0, 9, 700), np.array([(k * 700 + i, i % 50, k) for i in range(700)], maxent.KNOWN)) for k in range(10)]
    rows = [r for x in maxent.gathered(iter(sent), 2000) for r in x.to_pylist()]
    assert len(rows) == 4 * 9  # one for each block and 2,100 words
    back = sorted((r["at"], *map(int, x)) for r in rows for x in np.frombuffer(r["known"], maxent.KNOWN))
    assert back == sorted((int(a), *map(int, x)) for at, own in sent for a, x in zip(at, own, strict=True))


def test_words_are_shuffled_as_rows_once(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = gateway.new_array(gateway.jvm.double, 0)
        stages = store.stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    rows = [(k, " ".join(f"w{k}x{i}" for i in range(300)), "en", "s") for k in range(60)]
    before = shuffled()
    found = maxent.score(frame(spark, rows), learn=F.col("doc_id") % 5 != 1, classes=5, block=2000, rounds=1)
    assert found.count() == len(rows)
    sent = sum(n for k, n in shuffled().items() if k not in before)
    assert 60 * 300 <= sent < 2 * 60 * 300  # the words, and the first words of blocks
