"""License scans against longest common subsequences of whole texts, by a plain table."""

import numpy as np
import pytest

from sharpsieve.llm import licenses
from tests.llm.test_text_operators import WORDS

LONG = {k: v for k, v in licenses.TEMPLATES.items() if len(licenses.words(v)) >= licenses.SHORT}


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def found_plainly(template, text, coverage=0.8):
    """Whether coverage of a template's words stand in the text in order, its marks as runs, each first mark with the next later ones, unless another first mark is nearer."""
    parts = [licenses.words(x) for x in template.split("*")]
    total = sum(map(len, parts))
    if len(parts) == 1:
        return subsequence(parts[0], text) >= coverage * total - 1e-9
    marks = parts[1::2]
    at = lambda m, start: next((i for i in range(start, len(text)) if text[i : i + len(m)] == m), None)
    first = -1
    while (first := at(marks[0], first + 1)) is not None:
        spots = [first]
        for k, m in enumerate(marks[1:]):
            nxt = at(m, spots[-1] + len(marks[k]))
            if nxt is None:
                return False
            spots.append(nxt)
        other = at(marks[0], first + 1)
        if len(spots) > 1 and other is not None and other + len(marks[0]) <= spots[1]:
            continue
        cuts = [0, *(x for q, m in zip(spots, marks, strict=True) for x in (q, q + len(m))), len(text)]
        got = sum(map(len, marks)) + sum(subsequence(parts[2 * k], text[cuts[2 * k] : cuts[2 * k + 1]]) for k in range(len(spots) + 1))
        if got >= coverage * total - 1e-9:
            return True
    return False


@pytest.mark.parametrize("gap", [0, 1, 3, 10])
@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "Apache-2.0", "GPL-3.0", "MPL-2.0"])
def test_gaps_of_many_template_lengths(name, gap):
    """The halves of a template far apart, words changed: reported just when the whole text holds the coverage."""
    rng = np.random.default_rng(gap)
    own = licenses.words(LONG[name])
    scanner = licenses.Scanner({name: LONG[name]})
    seen = set()
    for k in range(8):
        changed = [w if rng.random() > 0.04 * k else str(rng.choice(WORDS)) for w in own]
        cut = int(rng.integers(1, len(own)))
        pool = WORDS + (own if k % 2 else [])
        between = [str(x) for x in rng.choice(pool, gap * len(own))]
        text = [*map(str, rng.choice(pool, 30)), *changed[:cut], *between, *changed[cut:], *map(str, rng.choice(WORDS, 30))]
        got = [r[0] for r in scanner.scan(" ".join(text))]
        assert (name in got) == found_plainly(LONG[name], text), (name, gap, k)
        seen.add(name in got)
    assert True in seen


def test_halves_far_apart_are_one_report():
    own = licenses.TEMPLATES["MIT"].split()
    text = " ".join([*own[:80], *["amber birch"] * 300, *own[80:]])
    assert [(r[0], r[1]) for r in licenses.Scanner().scan(text)] == [("MIT", 1.0)]


def test_each_place_of_a_repeated_license():
    for name, t in licenses.TEMPLATES.items():
        plain = t.replace("*", "")
        text = " ".join([plain, "amber birch cedar", plain, plain, "dune " * 500, plain])
        got = licenses.Scanner().scan(text)
        assert [r[0] for r in got if r[1] == 1.0] == [name] * 4, name
        assert [a < b for (*_, a), (*_, b) in zip(got, got[1:], strict=False)] == [True] * 3


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Released under the BSD License.", ["BSD-notice"]), ("Licensed under CC BY 3.0", []), ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0-notice"]), ("Licensed under the Apache License, Version 1.1.", []),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0-notice"]), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-notice"]),
        ("Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.", ["CC-BY-4.0-notice", "CC-BY-NC-4.0-notice"]), ("", []), ("the license of the under version", []),
        (licenses.TEMPLATES["LGPL-3.0"], ["LGPL-3.0"]), (licenses.TEMPLATES["AGPL-3.0"], ["AGPL-3.0"]), (licenses.TEMPLATES["GPL-2.0"] + " " + licenses.TEMPLATES["GPL-3.0"], ["GPL-2.0", "GPL-3.0"]),
        (licenses.TEMPLATES["GPL-3.0"].replace("version 3", "version 1"), []), (licenses.TEMPLATES["BSD-3-Clause"], ["BSD-3-Clause"]), (licenses.TEMPLATES["BSD-2-Clause"], ["BSD-2-Clause"]),
    ],
)
def test_close_relatives_keep_their_names(text, names):
    assert [r[0] for r in licenses.Scanner().scan(text.replace("*", ""))] == names


def test_common_subsequence_against_a_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 6, rng.integers(0, 14))] for _ in range(2))
        for way in (licenses.common, licenses.early):
            pairs = way(a, b)
            assert len(pairs) == subsequence(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:], strict=False))


def test_adversarial_repeats_stay_cheap():
    """A long text of near misses: a mark that is there often, without the rest."""
    text = "Licensed under the Apache License, Version 2.0. amber birch " * 5000
    assert len(licenses.Scanner().scan(text)) == 5000
