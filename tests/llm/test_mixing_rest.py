"""Languages that the targets don't name."""

import numpy as np
import pytest
from corpus_pipeline import mixed
from sharpsieve.llm import mixing
from tests.llm.test_text_operators import frame, prose


def test_pipeline_keeps_other_languages(spark):
    rows = [(k, prose(k, 20), ("en", "it", None)[k % 3], "src0") for k in range(600)]
    got = [r.lang for r in mixed(spark, frame(spark, rows), "").collect()]
    assert 60 < got.count("it") < 140 and 60 < got.count(None) < 140 and 60 < got.count("en") < 140


def test_goal_of_the_rest():
    shares = {"en": 0.5, "fr": 0.3, "*": None}
    assert mixing.goal(shares, np.array([20.0, 40, 20])).tolist() == pytest.approx([0.46875, 0.28125, 0.25])
    assert mixing.goal(shares, np.array([0.0, 0, 20])).tolist() == [0, 0, 1]
    assert mixing.goal({"en": 0.5, "*": 0.0}, np.array([1.0, 1])).tolist() == [0.5, 0]
