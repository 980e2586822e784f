import math

import numpy as np
import pytest

from cambium.llm import topk_search
from cambium.llm.topk_search import BallTree, search, top_k


def brute(rows, asked, k):
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(256 * x) for x in v]
    rows = sorted({(i, tuple(whole(v))) for i, v in rows if i is not None and fine(v)})
    out = []
    for q, v in {(i, w) for i, w in rows if i in asked}:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("clustered", [False, True])
def test_branch_and_bound_equals_brute_force(clustered):
    rng = np.random.default_rng(4)
    rows = rng.integers(-9, 10, (900, 6))
    if clustered:
        rows = rows + 400 * rng.integers(-1, 2, (900, 6))
    ids = rng.permutation(900)
    tree = BallTree.build(ids, rows, leaf_rows=20)
    queries = rows[:70]
    best = search(tree, queries, ids[:70], np.full(70, -np.inf), 5)
    scores = queries @ rows.T
    for q in range(70):
        order = [j for j in np.lexsort((ids, -scores[q])) if ids[j] != ids[q]][:5]
        assert [(s, i) for p, s, i in best.found.tolist() if p == q] == [(scores[q, j], ids[j]) for j in order]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, (300, 3)) / 4)]
    rows += [(7, [9.0, 9.0, 9.0]), (8, rows[8][1]), (400, None), (401, []), (402, [None, 1.0, 1.0]), (403, [float("nan"), 1.0, 1.0])]
    rows += [(404, [float("inf"), 0.0, 0.0]), (405, [0.0, 0.0, 0.0]), (None, [5.0, 5.0, 5.0]), (406, [1.0, 2.0]), (407, [1.0, 3.0]), (408, [1e6, -1e6, 3e6, 1e6])]
    rows += [(409, [2e6, 1e6, 1e6, 1e6])]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<double>, id int, shard string")
    asked = df.where("vec_id % 5 = 0 or vec_id in (7, 8) or vec_id > 399")
    ids = {r.vec_id for r in asked.collect()}
    got = sorted(map(tuple, top_k(df, asked, shard_rows=40, block_queries=20).collect()))
    assert got == brute(rows, ids, 5)
    assert {r[0] for r in got} >= {405, 406, 408} and max(r[1] for r in got if r[0] == 406) == 1


def test_far_shards_see_no_queries(spark, monkeypatch):
    """Clusters far apart: the balls of whole shards keep queries away, and the result is still exact."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8)) * 40
    rows = [(i, [float(x) for x in centers[i % 12] + rng.normal(size=8)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    seen = []
    settled = topk_search.settle

    def watched(frame):
        out = settled(frame)
        if {"q_kth", "part"} <= set(out.columns):
            seen.append(sum(len(r.q_ids) // 8 for r in out.select("q_ids").collect()))
        return out

    monkeypatch.setattr(topk_search, "settle", watched)
    got = sorted(map(tuple, top_k(df, df.where("vec_id % 7 = 0"), shard_rows=100, block_queries=30).collect()))
    assert got == brute(rows, {i for i, _ in rows if i % 7 == 0}, 5)
    queries, shards = len({r[0] for r in got}), 12
    assert queries <= seen[0] < queries * shards / 2


@pytest.mark.parametrize("limit", [0, 10**9])
def test_balls_are_sent_or_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(topk_search, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(topk_search, "REGIONS", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(400)] + [(1000 + i, [1.0, 1.0, 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df, df.where("vec_id % 10 = 0"), shard_rows=25, block_queries=7).collect()))
    assert got == brute(rows, {i for i, _ in rows if i % 10 == 0}, 5)


def test_products_beyond_a_long_stop_the_job(spark):
    df = spark.createDataFrame([(1, [1e9, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too long for whole-number"):
        top_k(df, df).collect()
    fits = spark.createDataFrame([(1, [8e6, 0.0]), (2, [8e6, 1.0]), (3, [-8e6, 0.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id): r.score for r in top_k(fits, fits, k=1).collect()}[1, 2] == (256 * 8_000_000) ** 2


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, df).collect() == []
