"""Exact neighbours by pivots equal those by comparing all rows."""

import numpy as np
import pytest

from rankloom.operators import pivots, similarity


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, 8)) * 5
    x = centres[rng.integers(0, 40, n)] + 0.2 * rng.standard_normal((n, 8))
    x[:5] = 0
    x[5:15] = x[20]  # ties
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_pivots_find_all_neighbours(spark, metric):
    x = clustered(1200)
    df = frame(spark, x)
    got = {(r.query_id, r["rank"]): (r.target_id, r.score) for r in similarity.nearest(df.filter("id % 7 = 0"), df, 6, metric, True, 40).collect()}
    u = x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
    for i in range(0, 1200, 7):
        score = (u * u[i]).sum(1) if metric == "cosine" else -np.sqrt(((x - x[i]) ** 2).sum(1))
        score[i] = -np.inf
        order = np.lexsort((np.arange(1200), -score))[:6]
        assert [got[i, k + 1][0] for k in range(6)] == order.tolist()
        assert [got[i, k + 1][1] for k in range(6)] == pytest.approx(score[order])
    assert len(got) == 6 * len(range(0, 1200, 7))


def test_share_of_shells_compared(spark):
    df = frame(spark, clustered(3000, 2))
    found, share = pivots.nearest(df, df, 5, "euclidean", True, 50, 3000)
    s = share.first()
    assert s.n_compared < s.n_pairs / 3 and s.n_shells >= 60
    assert found.select("query_id").distinct().count() == 3000


def test_few_rows(spark):
    df = frame(spark, clustered(60, 3))
    assert similarity.nearest(df, df.filter("id < 3"), 5, "euclidean", True, 2).count() == 57 * 3 + 3 * 2
    assert similarity.nearest(df.filter("id < 0"), df, 5, "cosine", True, 10).count() == 0


def test_no_query_is_repeated_and_blocks_of_copies_stay_small(spark, monkeypatch):
    x = clustered(2000, 4)
    x[500:1500] = x[20]
    seen, met = [], pivots.blocks.met
    monkeypatch.setattr(pivots.blocks, "met", lambda asked, gallery, *more: seen.append((asked, gallery)) or met(asked, gallery, *more))
    found = {(r.query_id, r["rank"]): r.target_id for r in similarity.nearest(frame(spark, x), frame(spark, x), 3, "cosine", True, 40).collect()}
    assert [found[700, k] for k in (1, 2, 3)] == [5, 6, 7] and [found[5, k] for k in (1, 2, 3)] == [6, 7, 8]
    asked, gallery = ([len(r.id) // 8 for r in df.collect()] for df in seen[0])
    assert sum(asked) == sum(gallery) == 2000
    assert max(gallery) <= 80
