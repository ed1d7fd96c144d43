"""Decontamination against a plain statement of its rule, and the cases it is for."""

import re
from collections import Counter

import numpy as np
import pytest

from sharpsieve.llm import decontam
from tests.llm.test_text_operators import edge_rows, empty, frame, prose

ITEMS = [
    (1, "A train leaves Boston at 60 km per hour and meets Boston traffic after 3 hours while Anna waits near the old bridge"),
    (2, "the quick brown fox jumps over the lazy dog near a quiet river bank every single morning"), (3, None), (4, "too few"), (2, "the quick brown fox jumps over the lazy dog near a quiet river bank every single morning"),
]


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def leaks(spark, texts, items, **options):
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    return {(r.id, r.item_id): r for r in decontam.find_leaks(frame(spark, rows), benchmark(spark, items), **options).collect()}


def tagged(text):
    """(form, word) of each token, written anew from the docstring."""
    out = []
    for w in re.findall(r"[^\W\d_]+|\d+(?:[.,:]\d+)*", text):
        low = w.lower()
        if re.match(r"\d", w):
            form = "<num>"
        elif out and out[-1][0] == "<num>" and low in decontam.UNITS:
            form = "<unit>"
        elif len(w) > 1 and w == w[0].upper() + w[1:].lower() and w[0] != w[0].lower() and low not in decontam.OPENERS:
            form = "<name>"
        else:
            form = low
        out.append((form, low))
    return out


def plain_leaks(text, items, coverage=0.6):
    """Items in a text: all windows compared with all, one majority map of slots."""
    doc, out = tagged(text or ""), set()
    for item_id, t in set(items):
        own = tagged(t or "")
        if len(own) < 4:
            continue
        n = min(8, len(own))
        places = list(range(len(own) - n + 1))
        rich = [i for i in places if sum(not f.startswith("<") for f, _ in own[i : i + n]) >= 4] or places
        spots = range(len(doc) - n + 1)
        same = {i for i in places for p in spots if [w for _, w in own[i : i + n]] == [w for _, w in doc[p : p + n]]}
        alike = [(i, p) for i in rich for p in spots if [f for f, _ in own[i : i + n]] == [f for f, _ in doc[p : p + n]]]
        pairs = {(i, p): {(own[i + j][1], doc[p + j][1]) for j in range(n) if own[i + j][0].startswith("<")} for i, p in alike}
        votes, first = Counter(), {}
        for (_, p), found in pairs.items():
            for x in found:
                votes[x] += 1
                first[x] = min(first.get(x, p), p)
        bound = {}
        for a, b in sorted(votes, key=lambda x: (-votes[x], first[x], x[1])):
            bound.setdefault(a, b)
        good = same | {i for (i, _), found in pairs.items() if all(bound[a] == b for a, b in found)}
        if max(len(same) / len(places), len(good & set(rich)) / len(rich)) >= coverage - 1e-9:
            out.add(item_id)
    return out


def test_exact_changed_and_partly_changed(spark):
    item = ITEMS[0][1]
    other = item.replace("Boston", "Denver").replace("60", "75").replace("Anna", "Maria")
    mixed = item.replace("leaves Boston", "leaves Denver")
    texts = [prose(1) + " " + item + " " + prose(2), "So " + other, "So " + mixed, prose(9, 500), "THE QUICK brown fox, jumps; over the lazy dog near a quiet river bank every single morning"]
    got = leaks(spark, texts, ITEMS)
    assert set(got) == {(0, 1), (1, 1), (2, 1), (4, 2)}  # one of two repeated names changed: most windows are verbatim
    assert got[0, 1].slots_changed == 0 and got[1, 1].slots_changed == 3 and got[0, 1].coverage == 1.0
    kept = decontam.remove_leaks(frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]), benchmark(spark))
    assert [r.doc_id for r in kept.collect()] == [3]


def test_two_values_may_become_one(spark):
    item = "Tom buys 3 apples and 5 pears at the big market near home"
    got = leaks(spark, ["Tom buys 4 apples and 4 pears at the big market near home"], [(1, item)])
    assert got[0, 1].coverage == 1.0 and got[0, 1].slots_changed == 2


def test_one_map_for_the_whole_item(spark):
    """3 becomes 8 in the first half and 5 in the second: windows that disagree with the map don't count."""
    item = "take 3 red apples and 3 old pears then put 3 big plums near 3 small figs by"
    halves = "take 8 red apples and 8 old pears then put 5 big plums near 5 small figs by"
    got = leaks(spark, [halves, halves.replace("5", "8")], [(1, item)])
    assert set(got) == {(1, 1)} and got[1, 1].coverage == 1.0


def test_short_items_and_names_at_sentence_starts(spark):
    items = [(1, "What is the capital of France?"), (2, "Anna has 5 apples. Anna buys 3 more. How many does Anna have?")]
    texts = ["Q: What is the capital of France?", "so what is the capital of france, then", "Maria has 7 apples. Maria buys 2 more. How many does Maria have?", "What is the price of bread?"]
    assert set(leaks(spark, texts, items)) == {(0, 1), (1, 1), (2, 2)}


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["Rome", "Oslo", "the", "a", "of", "river", "cost", "12", "7", "km", "years", "sold", "Bought", "."]
    items = [(k, " ".join(rng.choice(pool, rng.integers(3, 16)))) for k in range(25)]
    docs = [" ".join([*rng.choice(pool, 6), items[k % 25][1].replace("12", "31" if k % 5 else "12").replace("Rome", "Bern" if k % 7 else "rome") if k % 3 else "", *rng.choice(pool, 6)]) for k in range(60)]
    assert set(leaks(spark, docs, items)) == {(i, x) for i, t in enumerate(docs) for x in plain_leaks(t, items)}


def test_a_phrase_that_all_items_share(spark):
    """Windows of a common opening are rare for no item: they pair nothing, and items are still found."""
    opening = "read the passage below and answer the question that follows with one word "
    items = [(k, opening + prose(k, 30)) for k in range(40)]
    docs = [opening + prose(500 + k, 30) for k in range(40)] + [items[7][1]]
    assert set(leaks(spark, docs, items)) == {(40, 7)}


def test_edges(spark):
    docs = frame(spark, edge_rows())
    assert decontam.find_leaks(docs, benchmark(spark)).count() == 0
    assert decontam.find_leaks(empty(spark), benchmark(spark)).count() == 0
    assert decontam.find_leaks(docs, benchmark(spark).limit(0)).count() == 0
    kept = decontam.remove_leaks(docs, benchmark(spark))
    assert kept.columns == docs.columns and kept.count() == len(edge_rows())
    long = prose(1, 200_000) + " " + ITEMS[1][1]
    twice = frame(spark, [(None, long, None, None), (9, long, None, None), (9, long, None, None)])
    assert sorted((r.id is None, r.item_id) for r in decontam.find_leaks(twice, benchmark(spark)).collect()) == [(False, 2), (False, 2), (True, 2)]
    assert decontam.remove_leaks(twice, benchmark(spark)).count() == 0
    odd = benchmark(spark, [(None, ITEMS[1][1]), (5, ITEMS[1][1])])
    assert sorted((r.item_id is None) for r in decontam.find_leaks(twice.limit(1), odd).collect()) == [False, True]
