import numpy as np
import pytest

from cambium.functions.numeric import correlation_p_greater
from cambium.operators import chronology as chron
from cambium.operators import climate, interseries
from cambium.operators.skew import exact_ranks, lookup_join, split_hot


def robust(values):
    """Biweight mean written out, as the check for all routes."""
    x = np.asarray(values, dtype=float)
    if len(x) == 0:
        return None
    if len(x) < 3:
        return x.mean()
    med = np.median(x)
    mad = np.median(np.abs(x - med))
    if mad == 0:
        return med
    u = (x - med) / (9 * mad)
    w = np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0)
    return (w * x).sum() / w.sum()


@pytest.fixture(scope="module")
def index_rows():
    """Sites of 1 to 40 trees with ties, outliers and constant years."""
    rng = np.random.default_rng(11)
    rows = []
    for n in list(range(1, 13)) + [40]:
        for year in range(1990, 1996):
            values = rng.normal(1.0, 0.3, n)
            if year == 1991:
                values = np.round(values, 1)
            if year == 1992:
                values[:] = 1.0
            if year == 1993 and n > 3:
                values[0] = 30.0
            if year == 1994:
                values = np.where(np.arange(n) < n - 1, 0.5, values)
            rows += [(f"s{n:02d}", f"t{i:03d}", year, float(v)) for i, v in enumerate(values)]
    return rows


@pytest.fixture(scope="module")
def index(spark, index_rows):
    return spark.createDataFrame(index_rows, "rwl string, tree string, year int, rwi double").cache()


@pytest.mark.parametrize("max_group", [50_000, 3, 8, 20])
def test_chronology_routes_agree_with_numpy(index, index_rows, max_group):
    groups = {}
    for site, _, year, v in index_rows:
        groups.setdefault((site, year), []).append(v)
    got = chron.chronology(index, max_group=max_group).collect()
    assert len(got) == len(groups)
    for r in got:
        values = groups[(r["rwl"], r["year"])]
        assert r["samp_depth"] == len(values)
        assert r["std"] == pytest.approx(robust(values), abs=1e-12)


@pytest.mark.parametrize("max_group", [50_000, 3, 8, 20])
def test_others_routes_agree_with_brute_force(index, index_rows, max_group):
    groups = {}
    for site, tree, year, v in index_rows:
        groups.setdefault((site, year), {})[tree] = v
    got = interseries.others_chronology(index, max_group=max_group).collect()
    assert len(got) == len(index_rows)
    for r in got:
        others = [v for t, v in groups[(r["rwl"], r["year"])].items() if t != r["tree"]]
        assert r["n_others"] == len(others)
        expected = robust(others)
        if expected is None:
            assert r["master"] is None
        else:
            assert r["master"] == pytest.approx(expected, abs=1e-9), (r, others)


def test_a_huge_value_does_not_blur_the_others(spark):
    rows = [(site, f"t{i}", 1, v) for site, vs in {"a": [1e17, 1.1, 1.3], "b": [1e17, 1.7], "c": [1e17, 1.0, 2.0, 3.0, 4.0]}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "rwl string, tree string, year int, rwi double")
    for max_group in (50_000, 2):
        got = {(r["rwl"], r["tree"]): r["master"] for r in interseries.others_chronology(df, max_group=max_group).collect()}
        assert got[("a", "t0")] == pytest.approx(1.2) and got[("b", "t0")] == 1.7
        assert got[("c", "t0")] == pytest.approx(robust([1.0, 2.0, 3.0, 4.0]))


def test_mean_chronology_and_nulls(spark):
    df = spark.createDataFrame(
        [("a", "t", 1, 1.0), ("a", "u", 1, 3.0), ("a", "v", 1, None), ("a", "v", 2, None)],
        "rwl string, tree string, year int, rwi double",
    )
    for biweight in (True, False):
        got = {r["year"]: r for r in chron.chronology(df, biweight=biweight).collect()}
        assert got[1]["std"] == 2.0 and got[1]["samp_depth"] == 2
        assert got[2]["std"] is None and got[2]["samp_depth"] == 0


def scans(df):
    """Leaves of the plan that read something, before any exchange is reused."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("FileScan") + plan.count("Scan ExistingRDD") + plan.count("InMemoryTableScan")


def test_split_hot_computes_the_input_once(spark, index):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    once = index.coalesce(1).mapInArrow(counted, index.schema)
    small, none = split_hot(once, ["rwl", "year"], ["tree"])
    assert none is None and small.count() == index.count()
    assert reads.value == 1
    small, hot = split_hot(once, ["rwl", "year"], ["tree"], max_group=5)
    assert reads.value == 2
    assert small.count() + hot.count() == index.count()
    assert hot.groupBy("rwl", "year").count().filter("count <= 5").count() == 0
    assert small.groupBy("rwl", "year").count().filter("count > 5").count() == 0
    assert reads.value == 2


def test_ordinary_groups_are_one_plan_over_one_scan(spark, index):
    for df in (chron.chronology(index), interseries.others_chronology(index), climate.quartiles(index, ["rwl"], "rwi", ["tree"])):
        assert scans(df) == 1
    stored, hot = split_hot(index, ["rwl", "year"], ["tree"])
    again, _ = split_hot(stored, ["rwl", "year"], ["tree"], stored=True)
    assert again is stored and hot is None


def test_groups_of_nulls_keep_their_row_on_both_routes(spark):
    rows = [("a", f"t{i}", y, None if y == 2 else float(i + y)) for i in range(5) for y in (1, 2, 3)]
    df = spark.createDataFrame(rows, "rwl string, tree string, year int, rwi double")
    small, large = (sorted(map(tuple, chron.chronology(df, max_group=n).collect())) for n in (50_000, 2))
    assert [r[:2] + r[3:] for r in small] == [r[:2] + r[3:] for r in large] == [("a", 1, 5), ("a", 2, 0), ("a", 3, 5)]
    assert [r[2] is None for r in large] == [False, True, False]
    boxes = [sorted(map(tuple, climate.quartiles(df, ["year"], "rwi", ["tree"], n).collect())) for n in (50_000, 2)]
    assert boxes[0] == boxes[1] and boxes[0][1] == (2, 0, None, None, None)


def test_exact_ranks_with_a_narrow_bracket(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 4000), np.repeat(0.25, 1500)])
    rows = [("k", str(i), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, id string, v double")
    # accuracy 200 and max_group 1000 give a bracket of a few percent
    r = exact_ranks(df, ["k"], "v", ["id"], [0.5], chron.middle_ranks, 1000, 200).collect()[0]
    ordered = np.sort(values)
    half = len(values) // 2
    assert (r["v0_0"], r["v0_1"], r["v0_2"]) == tuple(ordered[half - 1 : half + 2])


def test_quartiles_of_large_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(f"m{g}", f"s{i}", float(v)) for g in range(3) for i, v in enumerate(rng.normal(g, 1, 30 + g))]
    df = spark.createDataFrame(rows, "month string, rwl string, v double")
    for max_group in (50_000, 10, 31):
        for r in climate.quartiles(df, ["month"], "v", ["rwl"], max_group).collect():
            x = [v for m, _, v in rows if m == r["month"]]
            assert [r["q1"], r["q2"], r["q3"]] == pytest.approx(list(np.percentile(x, [25, 50, 75])))


def test_lookup_join_keeps_every_row_of_a_dominant_key(spark):
    rows = spark.range(1000).selectExpr("if(id < 900, 'hot', concat('k', id)) as k", "id")
    lookup = spark.createDataFrame([("hot", 1), ("k950", 2)], "k string, v int")
    joined = lookup_join(rows, lookup, "k", "id")
    assert joined.count() == 1000 and joined.filter("v = 1").count() == 900
    assert lookup_join(rows, lookup, "k", "id", "left_anti").count() == 99
    spread = lookup_join(rows, lookup, "k", "id", keep_salt=True).filter("k = 'hot'").select("_salt").distinct()
    assert spread.count() == 16


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_interseries_by_brute_force(spark, index, index_rows):
    got = {(r["rwl"], r["tree"]): r for r in interseries.interseries_cor(index, prewhitened=False).collect()}
    trees = {}
    for site, tree, year, v in index_rows:
        trees.setdefault((site, tree), {})[year] = v
    scaled = {k: {y: v / np.mean(list(s.values())) for y, v in s.items()} for k, s in trees.items()}
    assert set(got) == set(trees)
    for (site, tree), series in scaled.items():
        x, y = [], []
        for year, v in series.items():
            master = robust([s[year] for k, s in scaled.items() if k[0] == site and k[1] != tree])
            if master is not None:
                x.append(round(v, 10))
                y.append(round(master, 10))
        r = got[(site, tree)]
        assert r["n_years"] == len(x)
        if len(x) < 2 or len(set(x)) == 1 or len(set(y)) == 1:
            assert r["res_cor"] is None
        else:
            assert r["res_cor"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])


def test_single_tree_sites_are_flagged(index):
    flags = interseries.interseries_flags(interseries.interseries_cor(index, prewhitened=False)).collect()
    assert [r["rwl"] for r in flags] == ["s01"]


def test_p_values_match_known_quantiles(spark):
    # Student's t upper tails: (t, df, p) of standard tables
    table = [(6.313752, 1, 0.05), (2.919986, 2, 0.05), (2.353363, 3, 0.05), (2.131847, 4, 0.05),
             (1.812461, 10, 0.05), (2.764, 10, 0.01), (1.697261, 30, 0.05), (1.660234, 100, 0.05)]
    rows = [(t / (df + t * t) ** 0.5, df + 2, p) for t, df, p in table]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "r double, n int, p double")
    for r in df.select("p", "r", "n", correlation_p_greater(F.col("r"), F.col("n")).alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], abs=2e-5)
    edge = spark.createDataFrame([(1.0, 5), (-1.0, 5), (0.0, 9), (0.5, 2), (-0.5, 20)], "r double, n int")
    q = [x[0] for x in edge.select(correlation_p_greater(F.col("r"), F.col("n"))).collect()]
    assert q[:4] == [0.0, 1.0, pytest.approx(0.5), None] and q[4] > 0.98


def test_prewhitening_removes_autocorrelation(spark):
    rng = np.random.default_rng(2)
    x = np.zeros(300)
    for t in range(1, 300):
        x[t] = 0.7 * x[t - 1] + rng.normal()
    y = interseries.ar_residuals(x + 5)
    y = y[~np.isnan(y)]
    assert 280 < len(y) < 300 and y.mean() == pytest.approx(5 + x.mean(), abs=0.2)
    assert abs(np.corrcoef(y[:-1], y[1:])[0, 1]) < 0.1
    assert list(interseries.ar_residuals(np.ones(10))) == [1.0] * 10
    rows = [("a", t, i, float(v)) for t in ("t", "u", "v") for i, v in enumerate(x + rng.normal(0, 0.3, 300) + 5)]
    df = spark.createDataFrame(rows, "rwl string, tree string, year int, rwi double")
    got = interseries.interseries_cor(df).collect()
    assert len(got) == 3 and all(r["res_cor"] > 0.6 and r["p_val"] < 1e-6 for r in got)


def test_yule_walker_order_one_coefficient():
    x = np.array([1.0, 2.0, 1.5, 2.5, 1.0, 3.0, 2.0, 2.2, 1.1, 2.9, 1.7, 2.4])
    y = interseries.ar_residuals(x)
    order = int(np.isnan(y).sum())
    d = x - x.mean()
    cov = [(d[: len(d) - k] * d[k:]).sum() / len(d) for k in range(order + 1)]
    if order:
        m = np.array([[cov[abs(i - j)] for j in range(order)] for i in range(order)])
        phi = np.linalg.solve(m, cov[1:])
        expected = d[order:] - sum(phi[k] * d[order - k - 1 : len(d) - k - 1] for k in range(order)) + x.mean()
        assert y[order:] == pytest.approx(expected)
