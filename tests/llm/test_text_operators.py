"""Edge cases and brute-force versions of the operators on texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sharpsieve.llm import langid, licenses, line_dedup, maxent, mixing, quality, simhash

#: Clashing names on purpose.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, _text string, id int, score double, fp string"
WORDS = "amber birch cedar dune ember fjord grove heath inlet jetty knoll ledge marsh north oasis petal quarry ridge shoal tide".split()


def prose(seed: int, n: int = 60) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + f" end{seed}"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 7, "x", 3, 0.5, "y") for i, t, lang, src in rows], SCHEMA)


def edge_rows():
    long = "\n".join(prose(k) for k in range(400))
    return [
        (1, prose(1), "en", "src0"), (2, prose(1), "en", "src0"), (3, None, "en", "src0"), (4, "", None, None), (5, " \n\t ", "fr", "src1"), (None, prose(2), None, "src0"),
        (7, prose(7), "fr", None), (7, prose(7), "fr", None), (7, prose(8), "de", "src2"), (8, long, "en", "src0"), (9, "é", "fr", "src9"), (10, "\n\n\n\n\n", "en", "src0"), (None, None, None, None),
    ]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- line dedup


def cut(rows, window=3):
    """The kept text of (id, text) rows in order, by brute force."""
    docs = [(i, None if t is None else t.split("\n")) for i, t in rows]
    seen, out = set(), []
    for _, lines in docs:
        if lines is None:
            out.append(None)
            continue
        gone = set()
        for p in range(len(lines) - window + 1):
            key = tuple(lines[p : p + window])
            if not "".join(key).strip():
                continue
            if key in seen:
                gone |= set(range(p, p + window))
            seen.add(key)
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "\n".join(rng.choice(list("abcd"), rng.integers(1, 14))), "en", "src0") for k in range(120)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [got[k] for k in range(120)] == cut([r[:2] for r in rows])


def test_line_dedup_edges(spark):
    docs = frame(spark, edge_rows())
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == len(edge_rows())
    by = {(r.doc_id, r.text): r for r in rows}
    assert by[3, None]["_n_lines"] == 0 and by[4, ""]["_n_lines"] == 1 and by[10, "\n\n\n\n\n"].n_removed == 0
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_one_window_in_every_document(spark):
    rows = [(k, f"a{k}\nx\ny\nz\nb{k}", "en", "src0") for k in range(500)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out[0] == rows[0][1] and all(out[k] == f"a{k}\nb{k}" for k in range(1, 500))


# --- quality


def labelled(spark, n=160):
    rng = np.random.default_rng(0)
    rows = [(k, prose(k, int(rng.integers(20, 80))) if k % 3 else " | ".join(rng.choice(WORDS, 40)) + " |", "en", "src0") for k in range(n)]
    return frame(spark, rows), spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(n)], "doc_id long, quality int, toxic int")


def test_quality_learns_and_scores_whole_texts(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels, learn=F.col("doc_id") < 120)
    got = {r.id: r.score for r in quality.score(docs, model).collect()}
    assert np.mean([(got[k] >= 0.3) == (k % 3 > 0) for k in range(120, 160)]) > 0.95
    again = quality.train(docs.orderBy(F.desc("doc_id")), labels, learn=F.col("doc_id") < 120)
    assert np.allclose(again.weight, model.weight)
    bad = "clean text of many words " * 10 + "\n" + "x | " * 200_000  # over a piece
    assert model.score(bad.encode()) == pytest.approx(1 / (1 + math.exp(-(model.slope * model.margin(quality.indicators(bad.encode())) + model.offset))))


def test_quality_edges(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    rows = quality.score(frame(spark, edge_rows()), model).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(empty(spark), model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert none.score(b"anything") == pytest.approx(0.5)
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, odd).score(b"x") > 0.5
    kept = quality.keep_good(frame(spark, edge_rows()), model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(edge_rows())


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    values, labels = [np.ones(8) / np.sqrt(8) for _ in rows], (rng.random(60) > 0.5).astype(float)
    weight, bias = quality.descend(rows, values, labels, epochs=400)
    upper = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def loss(w, b):
        margins = np.array([w[r] @ v + b for r, v in zip(rows, values, strict=True)]) * np.where(labels > 0, 1, -1)
        return (w @ w + b * b) / 2 + (upper * np.maximum(1 - margins, 0)).sum()

    best = loss(weight, bias)
    for _ in range(200):
        step = rng.normal(size=weight.shape) * 0.01
        assert loss(weight + step * (np.arange(len(weight)) < 40), bias + rng.normal() * 0.01) >= best - 1e-3


# --- language-model scoring


def base(rows, learned):
    low = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = Counter(w for (i, t, *_), ok in zip(rows, learned, strict=True) if ok for w in low(t))
    n, v = sum(counts.values()), len(counts)
    return [(sum(math.log10(counts[w] + 0.5) - math.log10(n + 0.5 * (v + 1)) for w in low(t)), sum(counts[w] > 0 for w in low(t)), len(low(t)), n) for _, t, *_ in rows]


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_lm_base_scores_are_exact(spark, block):
    rows = [*edge_rows(), *[(k, prose(k, 25), "en", "src0") for k in range(100, 140)]]
    learned = [r[0] is not None and r[0] % 5 != 1 for r in rows]
    found = maxent.score(frame(spark, rows), learn=F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False)), block=block, classes=6).collect()
    want = sorted((r[0] is None, r[0] or 0, *(round(x, 8) for x in b)) for r, b in zip(rows, base(rows, learned), strict=True))
    assert sorted((r.id is None, r.id or 0, round(r.base_score, 8), r.n_known, r.n_tokens, r.train_tokens) for r in found) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)


def test_lm_learns_order(spark):
    rows = [(k, "red blue green red blue green " * 20 if k % 2 else "one two three four five " * 20, "en", "s") for k in range(60)]
    found = maxent.score(frame(spark, rows), learn=F.col("doc_id") < 50, classes=8).collect()
    held = [r for r in found if not r.learned]
    assert held and all(r.score > r.base_score for r in held)


def test_lm_empty_and_nothing_learned(spark):
    assert maxent.score(empty(spark), learn=F.lit(True)).count() == 0
    r = maxent.score(frame(spark, [(1, "a b", None, None)]), learn=F.lit(False)).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and np.isfinite(r.score)


def test_lm_class_softmax_is_normalised():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(len(maxent.TABLES), maxent.ROWS, 5)).astype(np.float32)
    rows = rng.integers(0, maxent.ROWS, (len(maxent.TABLES), 7)).astype(np.int32)
    total = sum(np.exp(maxent.log_softmax(weights, rows, np.full(7, c))) for c in range(5))
    assert np.allclose(total, 1, atol=1e-5)


def test_license_texts_inside_long_ones(spark):
    noise = prose(5, 3000)
    rows = [(k, noise + "\n" + t.replace("*", "") + "\n" + noise, "en", "s") for k, t in enumerate(licenses.TEMPLATES.values())]
    changed = [(100, noise + " " + licenses.TEMPLATES["MIT"].replace("Software", "Program") + noise, "en", "s")]
    got = {(r.id, r.license): r.coverage for r in licenses.scan(frame(spark, rows + changed)).collect()}
    for k, name in enumerate(licenses.TEMPLATES):
        assert got[k, name] == 1.0
    assert 0.8 <= got[100, "MIT"] < 1


def test_license_edges(spark):
    assert licenses.scan(frame(spark, edge_rows())).count() == 0 and licenses.scan(empty(spark)).count() == 0
    twice = frame(spark, [(None, "Released under the MIT License.", None, None)] * 2)
    assert licenses.scan(twice).count() == 2


def test_longest_rising():
    rng = np.random.default_rng(2)
    for _ in range(50):
        v = rng.permutation(9).tolist()
        picked = [v[i] for i in licenses.longest_rising(v)]
        best = max(bin(m).count("1") for m in range(512) if (s := [v[i] for i in range(9) if m >> i & 1]) == sorted(s))
        assert picked == sorted(picked) and len(picked) == best


# --- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if near(nodes[i], nodes[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(nodes))]


def test_covering_masks_miss_no_pair():
    rng = np.random.default_rng(0)
    for free in (simhash.ALL, (1 << 32) - 1, 0xFFF):
        found = simhash.masks(3, free)
        spots = [i for i in range(64) if free >> i & 1]
        for _ in range(3000):
            gap = sum(1 << int(b) for b in rng.choice(spots, 3, replace=False))
            assert any(m & gap == 0 and m for m in found)


@pytest.mark.parametrize("bucket", [128, 2048])
def test_links_against_all_pairs(spark, bucket):
    rng = np.random.default_rng(4)
    start = int(rng.integers(0, 1 << 62))
    dense = {start ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8))) for _ in range(700)}
    low = {start ^ (x << 40) for x in range(1 << 10)} if bucket == 128 else set()  # one bucket of many fingerprints
    fps = sorted({x - (1 << 64) if x >> 63 > 0 else x for x in dense | low | {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 200)}})
    from sharpsieve.llm.common import Scratch
    from sharpsieve.operators.components import components

    scratch = Scratch(spark)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), scratch, bucket=bucket)
    roots = {r.node: r.root for r in components(edges, scratch).collect()}
    bits = np.array(fps, np.int64).view(np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= 3) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    assert all(roots.get(f, f) == fps[find(i)] for i, f in enumerate(fps))


def test_simhash_edges_and_brute_force(spark):
    words = prose(30, 80).split()
    near = [(50 + k, " ".join([*words[:-1], f"w{k}"]), "en", "s") for k in range(12)]
    rows = [*edge_rows(), *near]
    got = simhash.near_duplicates(frame(spark, rows), shingle=3).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    comp = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {c: min((r[0] for r, k in zip(rows, comp, strict=True) if k == c and r[0] is not None), default=None) for c in comp}
    want = Counter((r[0], f, least[c]) for r, f, c in zip(rows, fps, comp, strict=True))
    assert Counter((r.id, r.fp & simhash.ALL, r.component_id) for r in got) == want
    kept = simhash.keep_first(frame(spark, rows))
    assert kept.count() == len(set(comp)) and simhash.keep_first(empty(spark)).count() == 0


# --- language ID


def test_language_of_held_out_texts(spark):
    other = "kivu sato mire lopa nuki tero hasi wabe yodu pime".split()
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(WORDS if k % 2 else other, 30)), "en" if k % 2 else "xx", "s") for k in range(120)]
    model = langid.train(frame(spark, rows), learn=F.col("doc_id") < 80)
    got = {r.id: r for r in langid.predict(frame(spark, rows), model).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "xx") and 0 <= got[k].score <= 1 for k in range(80, 120))
    assert model.predict("1234 !!")[0] == "und" and model.predict("ЖЖЖЖ щщщщ ъъъъ")[2]


def test_language_edges(spark):
    rows = edge_rows()
    model = langid.train(frame(spark, rows))
    got = langid.predict(frame(spark, rows), model).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == "und" for r in got if r.id in (3, 4, 5, 10))
    assert all(r.lang_pred != "und" for r in got if r.id in (1, 2, 7, 8, 9))
    nothing = langid.train(frame(spark, rows).where("lang = 'zz'"))
    assert nothing.predict("text")[0] == "und" and langid.predict(empty(spark), model).count() == 0


@pytest.mark.parametrize("text", ["½ ¼ ²", "① Ⅷ", "12 + 4 _ __", "", None, "٣٤"])
def test_no_letter_is_und(spark, text):
    model = langid.train(frame(spark, edge_rows()))
    assert model.predict(text) == ("und", 0.0, True) and model.predict("½ é")[0] != "und"


def test_all_languages_are_learned_in_blocks(spark):
    """More languages than a block holds, one of them of equal rows only; block sizes don't change predictions."""
    rng = np.random.default_rng(0)
    pools = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for _ in range(23)]
    rows = [(100 * k + j, " ".join(rng.choice(pools[k], 25)), f"l{k:02d}", "s") for k in range(23) for j in range(6)]
    rows += [(9000, "zzyzx qoph zzyzx qoph", "same", "s")] * 400
    docs = frame(spark, rows)
    some, one = langid.train(docs, block_langs=5, per_lang=10), langid.train(docs, per_lang=10)
    assert [len(set(b.langs)) for b in some.blocks] == [5, 5, 5, 5, 4] and len(one.blocks) == 1
    got = {r.id: r for r in langid.predict(docs, some).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    for _, t, *_ in rows[::17]:
        assert some.predict(t)[0] == one.predict(t)[0] and some.predict(t)[1] == pytest.approx(one.predict(t)[1], abs=1e-6)


def test_language_of_a_text_of_several_pieces(spark):
    model = langid.train(frame(spark, edge_rows()))
    long = prose(1, 300_000)
    n = langid.counts(long)
    assert len(long) > 1 << 20 and n.sum() == sum(len(long.encode()) + 2 - k + 1 for k in (1, 2, 3, 4))
    assert model.predict(long)[0] == model.predict(long[:1000])[0]


def plain_cosines(text, model):
    """Cosines with all centroids by dictionaries, for texts of plain letters and spaces."""
    data = (" " + text.lower() + " ").encode()
    grams = Counter(data[i : i + n] for n in (1, 2, 3, 4) for i in range(len(data) - n + 1))
    slots = Counter()
    for g, c in grams.items():
        slots[int(langid.byte_grams(g, len(g))[0] >> np.uint64(64 - langid.DIM_BITS))] += c
    weights = {k: math.log1p(c) * model.idf[k] for k, c in slots.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {(lang, j): sum(w / norm * float(b.centres[k, j]) for k, w in weights.items()) for b in model.blocks for j, lang in enumerate(b.langs)}


def test_language_scores_against_plain_cosines(spark):
    other = "kivu sato mire lopa nuki tero hasi wabe yodu pime".split()
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(WORDS if k % 2 else other, 30)), "en" if k % 2 else "xx", "s") for k in range(60)]
    model = langid.train(frame(spark, rows))
    for r in langid.predict(frame(spark, rows), model).collect():
        near = plain_cosines(rows[r.id][1], model)
        (lang, _), top = max(near.items(), key=lambda x: x[1])
        assert r.lang_pred == lang and r.score == pytest.approx(top, abs=1e-4)


# --- mixing


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(0)
    tokens, goals = rng.integers(1, 1000, (3, 4, 2)).astype(float), [rng.dirichlet(np.ones(n)) for n in (3, 4, 2)]
    share = mixing.rake(tokens, goals, rounds=200)
    for axis, goal in enumerate(goals):
        assert np.allclose(share.sum(axis=tuple({0, 1, 2} - {axis})), goal, atol=1e-9)
    prob = mixing.probabilities(tokens, share, 0.5)
    assert prob.max() <= 1 and (prob * tokens).sum() == pytest.approx(0.5 * tokens.sum())


def test_mixing_edges(spark):
    docs = frame(spark, edge_rows())
    out = mixing.mix(docs)
    assert out.count() == len(edge_rows()) and out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert all(0 <= r.prob <= 1 for r in rows) and sum(r.n_tokens for r in rows if r.doc_id == 3) == 0
    assert mixing.mix(empty(spark)).count() == 0
    draws = mixing.sample(frame(spark, [(k, prose(k, 20), "en", "src0") for k in range(2000)]), fraction=0.25).count()
    assert 380 < draws < 620


def test_folds_by_crc(spark):
    from sharpsieve.llm.common import fold

    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
