"""No query over groups makes more rows than there are close pairs, or a few for each vector, as bands did at a wide distance."""

import numpy as np
import pytest
from helpers import made

from sharpsieve.plans import queries

N = 1500
GROUPS = [
    "hamming_pairs_time_gap",
    "failed_frames",
    "run_groups_and_ratings",
    "group_rank_best",
    "count_by_source",
    "count_by_rating",
    "csv_flat_projection",
    "keepers",
    "rule_ladder_default",
    "run_summary",
    "detector_sources",
    "rejects",
    "sheet_filter_sort",
]


@pytest.mark.parametrize("name", GROUPS)
def test_rows_that_are_made(spark, monkeypatch, name):
    rng = np.random.default_rng(3)
    vectors = [(k, [float(x) for x in v], k % 10) for k, v in enumerate(rng.standard_normal((N, 64)) / 8)]
    tables = {
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"),
        "events": spark.sql(f"select id as event_id, timestamp_seconds(id * 9999) as ts from range({N})"),
    }
    monkeypatch.setattr(queries, "table", lambda spark, sf, name: tables[name])
    assert made(spark, lambda: queries.QUERIES[name](spark, "").collect()) < 10 * N
