import math

import numpy as np
from pyspark.sql import functions as F

from cambium.llm import embedding_dedup
from cambium.llm.embedding_dedup import collision_chance, embedding_groups, tables_for


def brute(rows, cosine=0.95):
    fine = [i is not None and v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v) for i, v in rows]
    n, links = len(rows), [set() for _ in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if ok else None for (_, v), ok in zip(rows, fine, strict=True)]
    for a in range(n):
        for b in range(a):
            if fine[a] and fine[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a].add(b)
                links[b].add(a)
    root = [i for i, _ in rows]
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        root[a] = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
    return sorted(((i, len(links[a]), root[a], None if i is None else i == root[a]) for a, (i, _) in enumerate(rows)), key=repr)


def test_equals_brute_force_with_hot_cell(spark):
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x)
    base = rng.standard_normal((60, 16))
    rows = [unit(rng.standard_normal(16)) for _ in range(500)]
    rows += [unit(base[i % 60]) + 0.02 * rng.standard_normal(16) for i in range(300)]
    rows += [unit(base[0]) + 0.03 * rng.standard_normal(16) for _ in range(250)] + [rows[0]] * 4
    # a chain whose ends are far apart
    rows += [np.cos(t) * np.eye(16)[0] + np.sin(t) * np.eye(16)[1] for t in np.arange(0, 2, 0.2)]
    order = rng.permutation(len(rows))
    data = [(int(order[i]), [float(x) for x in v]) for i, v in enumerate(rows)]
    data += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [1.0, None] + [0.0] * 14), (9004, [float("nan")] * 16), (9005, [float("-inf")] * 16)]
    data += [(None, data[0][1]), (9006, [1.0, 1.0]), (9007, [2.0, 2.1]), (9008, [2.0, 2.0]), data[3], (data[4][0], [-x for x in data[4][1]])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in data], "vec_id long, embedding array<double>, cell int, node int")
    got = embedding_groups(df, recall=0.99999, cell_rows=60, block_rows=100)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data)


def test_vectors_that_share_a_number_are_numbered_anew(spark, monkeypatch):
    by_hash, seeds = embedding_dedup.numbered, []

    def clumsy(seed):
        seeds.append(seed)
        return F.pmod(by_hash(seed), F.lit(3)) if seed < 2 else by_hash(seed)

    monkeypatch.setattr(embedding_dedup, "numbered", clumsy)
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((20, 4)).repeat(2, 0))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_groups(df).collect()), key=repr) == brute(data)
    assert seeds == [0, 1, 2]


def test_calibration():
    for planes in (0, 5, 12):
        p, n = collision_chance(0.95, planes), tables_for(0.95, planes, 0.999)
        miss = (1 - p) ** n + n * p * (1 - p) ** (n - 1)
        assert miss <= 0.001
    rng = np.random.default_rng(0)
    u = rng.standard_normal((20_000, 8))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    other = rng.standard_normal(u.shape)
    other -= (other * u).sum(1, keepdims=True) * u
    v = 0.95 * u + (1 - 0.95**2) ** 0.5 * other / np.linalg.norm(other, axis=1, keepdims=True)
    planes, line = rng.standard_normal((3, 8)), rng.standard_normal(8)
    hit = ((u @ planes.T > 0) == (v @ planes.T > 0)).all(1) & (np.abs((u - v) @ line) <= 0.45)
    assert hit.mean() > collision_chance(0.95, 3) - 0.08


def test_empty(spark):
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
