"""Scores of nearest neighbours are inner products of the vectors as given."""

import numpy as np
import pytest

from tabforge.llm import ann


@pytest.mark.parametrize(("kind", "wide"), [("float", np.float32), ("double", np.float64)])
def test_scores_of_the_original_vectors(spark, kind, wide):
    rng = np.random.default_rng(6)
    x = {i: rng.normal(size=6).astype(wide).astype(float) for i in range(120)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], f"vec_id long, embedding array<{kind}>")
    got = ann.search(df, lambda c: c % 20 == 0, k=4).collect()
    assert len(got) == 6 * 4
    for r in got:
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-13
