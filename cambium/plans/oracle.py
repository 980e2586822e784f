"""The registered queries in plain SQL over the star-schema tables.

Each statement is written from the definition of the analysis, by joins over
whole tables where the Spark side uses windows or sums, so that agreement means
something.  ``VIEWS`` holds named sub-selects; a query lists the ones it needs
and gets them, with what they need in turn, as a WITH clause.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[str, str]] = {}
ORACLE: dict[str, str] = {}

META = "country, latitude, longitude, elevation, species_code, species_name"


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (needs, sql)


def out(plain: str = "", whole: str = "", real: str = "", places: int = 6) -> str:
    """Select list: columns as they are, as BIGINT, and rounded (no negative zero)."""
    parts = [c for c in plain.split()]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in whole.split()]
    parts += [f"round({c}, {places}) + 0 AS {c}" for c in real.split()]
    return ", ".join(parts)


def query(name: str, needs: str, sql: str) -> None:
    order: list[str] = []

    def add(view_name: str) -> None:
        if view_name in order:
            return
        for n in VIEWS[view_name][0].split():
            add(n)
        order.append(view_name)

    for n in needs.split():
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    ORACLE[name] = f"WITH RECURSIVE {ctes}\n{sql}" if ctes else sql


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# ---- inputs ---------------------------------------------------------------------------------

GROWTH_YEAR = "CAST(1900 + (year(l_shipdate) - 1992) * 12 + month(l_shipdate) AS INT)"

view(
    "ring_width",
    "",
    f"""SELECT 's' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS rwl,
        't' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS tree,
        {GROWTH_YEAR} AS year, avg(l_quantity) / 10 AS width
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
)
view(
    "ring_coded",
    "ring_width",
    """SELECT rwl, tree, year, CASE WHEN year % 25 = 0 THEN 0.0
        WHEN CAST(substr(tree, 2) AS BIGINT) % 10 = 0 AND year % 20 = 0 THEN 0.01 ELSE width END AS width
    FROM ring_width""",
)
view(
    "climate",
    "",
    f"""SELECT 's' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS rwl, {GROWTH_YEAR} AS year,
        CAST((day(l_shipdate) - 1) % 12 + 1 AS INT) AS month,
        round(sum(l_extendedprice) / 1000, 6) AS pre, round(avg(l_discount) * 100, 6) AS tmp,
        round(min(l_discount) * 100, 6) AS tmn, round(max(l_discount) * 100, 6) AS tmx,
        round(avg(l_tax) * 100, 6) AS spei
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY 1, 2, 3""",
)
view(
    "meta",
    "ring_width",
    """SELECT n.rwl, n.country, n.latitude, n.longitude, n.elevation, n.species_code, n.species_name,
        first_year, last_year
    FROM (SELECT 's' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS rwl, n_name AS country,
            CAST(75 - ((n_nationkey * 11) % 80) * 0.5 - 0.25 AS DOUBLE) AS latitude,
            CAST(-10 + ((n_nationkey * 7) % 90) * 0.5 + 0.25 AS DOUBLE) AS longitude,
            CAST(n_nationkey * 50 AS DOUBLE) AS elevation,
            substr(r_name, 1, 4) AS species_code, r_name AS species_name
        FROM nation JOIN region ON n_regionkey = r_regionkey) n
    LEFT JOIN (SELECT rwl, min(year) AS first_year, max(year) AS last_year FROM ring_width GROUP BY rwl) s
        USING (rwl)""",
)
view(
    "points",
    "",
    """SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS rwl,
        CAST(c_custkey % 490 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST(-12 AS DOUBLE) AS longitude,
        CAST(c_custkey * 7 % 440 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST(33 AS DOUBLE) AS latitude,
        c_custkey AS seq, c_acctbal AS balance FROM customer""",
)
view(
    "cells",
    "points",
    """SELECT *, CASE WHEN inside THEN CAST(least(floor(y), 79) AS INT) END AS row,
        CASE WHEN inside THEN CAST(least(floor(x), 89) AS INT) END AS col
    FROM (SELECT *, x >= 0 AND x <= 90 AND y >= 0 AND y <= 80 AS inside
        FROM (SELECT *, (longitude + 10) / 0.5::DOUBLE AS x, (75 - latitude) / 0.5::DOUBLE AS y FROM points))""",
)
view(
    "monthly_cells",
    "",
    """SELECT CAST(l_partkey % 80 AS INT) AS row, CAST(l_orderkey % 90 AS INT) AS col,
        CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS layer,
        avg(l_quantity) AS pre, round(avg(l_tax), 6) AS spei
    FROM lineitem GROUP BY 1, 2, 3""",
)
view(
    "grid_monthly",
    "monthly_cells",
    """SELECT 'pre' AS variable, row, col, layer, pre AS value FROM monthly_cells
    UNION ALL SELECT 'spei', row, col, layer, spei FROM monthly_cells""",
)
LAYERS = "['ecoregion','soil_carbon','soil_ph','soil_nitrogen','derived_elev','slope','eastness','northness','mountains']"
view(
    "grid_static",
    "",
    f"""SELECT {LAYERS}[CAST(l_orderkey % 9 + 1 AS INT)] AS layer, CAST(l_partkey % 80 AS INT) AS row,
        CAST(l_suppkey * 7 % 90 AS INT) AS col, ln(avg(l_quantity) + 1) AS value
    FROM lineitem GROUP BY 1, 2, 3""",
)

# ---- growth ---------------------------------------------------------------------------------

view(
    "deviations",
    "ring_width",
    """SELECT rwl, tree, year, width, dev, lag(dev) OVER (PARTITION BY rwl, tree ORDER BY year) AS prev
    FROM (SELECT *, width - avg(width) OVER (PARTITION BY rwl, tree) AS dev FROM ring_width)""",
)
view(
    "stats",
    "deviations",
    """SELECT rwl, tree, min(year) AS first, max(year) AS last, max(year) - min(year) + 1 AS age,
        avg(width) AS mean_growth, stddev_samp(width) AS growth_sd,
        sum(dev * prev) / nullif(sum(dev * dev), 0) AS ar1
    FROM deviations GROUP BY rwl, tree""",
)
view(
    "ages",
    "stats",
    """SELECT s.*, rwl_meanage, rwl_totage FROM stats s JOIN (SELECT rwl, avg(age) AS rwl_meanage,
        max(last) - min(first) + 1 AS rwl_totage FROM stats GROUP BY rwl) USING (rwl)""",
)
view(
    "rollup",
    "ages",
    """SELECT rwl, any_value(rwl_meanage) AS rwl_meanage, any_value(rwl_totage) AS rwl_totage,
        avg(ar1) AS mean_ar1, max(age) AS max_age, min(age) AS min_age FROM ages GROUP BY rwl""",
)
STAT_COLUMNS = ("rwl tree", "first last age", "mean_growth growth_sd ar1")
query("tree_stats", "stats", f"SELECT {out(*STAT_COLUMNS)} FROM stats")
query(
    "site_age",
    "ages",
    f"SELECT {out('rwl tree', 'first last age rwl_totage', 'mean_growth growth_sd ar1 rwl_meanage')} FROM ages",
)
query(
    "site_rollup",
    "rollup",
    f"SELECT {out('rwl', 'rwl_totage max_age min_age', 'rwl_meanage mean_ar1')} FROM rollup",
)
META_OUT = ("country species_code species_name", "first_year last_year", "latitude longitude elevation")


def with_meta(plain: str = "", whole: str = "", real: str = "") -> str:
    return out(f"{plain} {META_OUT[0]}", f"{whole} {META_OUT[1]}", f"{real} {META_OUT[2]}")


query(
    "metadata_age",
    "rollup meta",
    f"""SELECT {with_meta('rwl', 'rwl_totage max_age min_age', 'rwl_meanage mean_ar1')}
    FROM rollup LEFT JOIN meta USING (rwl)""",
)
query(
    "site_filter",
    "ring_width meta",
    f"""SELECT {out('rwl tree', 'year', 'width')} FROM ring_width WHERE rwl IN (SELECT rwl FROM meta
    WHERE species_code = 'EURO' AND last_year BETWEEN 1980 AND 2025)""",
)
view(
    "bai",
    "ring_width",
    """SELECT a.rwl, a.tree, a.year,
        pi() * (power(sum(b.width), 2) - power(sum(b.width) - any_value(a.width), 2)) AS bai
    FROM ring_width a JOIN ring_width b ON a.rwl = b.rwl AND a.tree = b.tree AND b.year <= a.year
    GROUP BY a.rwl, a.tree, a.year""",
)
view(
    "bai_dense",
    "bai",
    """SELECT t.rwl, t.tree, y.year, bai FROM (SELECT DISTINCT rwl, tree FROM ring_width) t
    JOIN (SELECT rwl, unnest(generate_series(min(year), max(year))) AS year FROM ring_width GROUP BY rwl) y
        ON t.rwl = y.rwl
    LEFT JOIN bai b ON b.rwl = t.rwl AND b.tree = t.tree AND b.year = y.year""",
)
query("bai_long", "bai", f"SELECT {out('rwl tree', 'year', 'bai')} FROM bai")
query("bai_dense", "bai_dense", f"SELECT {out('rwl tree', 'year', 'bai')} FROM bai_dense")


def slope(y: str) -> str:
    """Least squares slope on year, NULL where the years do not vary."""
    return f"covar_pop({y}, year) / nullif(CASE WHEN count({y}) > 0 THEN var_pop(CASE WHEN {y} IS NOT NULL THEN year END) END, 0)"


view(
    "tree_slopes",
    "bai",
    f"""SELECT rwl, tree, {slope('bai')} AS growth_slope FROM bai
    WHERE year BETWEEN 1975 AND 2025 GROUP BY rwl, tree""",
)
query("tree_trend", "tree_slopes", f"SELECT {out('rwl tree', '', 'growth_slope')} FROM tree_slopes")
query(
    "growth_trend_flags",
    "ring_width",
    """SELECT DISTINCT rwl, 'detrend failed' AS flag FROM (SELECT rwl, tree FROM ring_width GROUP BY rwl, tree
    HAVING max(year) - min(year) + 1 <> count(*))""",
)

# ---- chronologies and inter-series correlation ----------------------------------------------

view(
    "rwi",
    "ring_width",
    """SELECT rwl, tree, year, width / nullif(m, 0) AS rwi FROM ring_width
    JOIN (SELECT rwl, tree, avg(width) AS m FROM ring_width GROUP BY rwl, tree) USING (rwl, tree)""",
)


def biweight(needed: str, keys: str, value: str) -> str:
    """Tukey's biweight mean of ``value`` per group: median, then spread, then weights."""
    return f"""SELECT {keys}, n, CASE WHEN n < 3 THEN mean WHEN mad = 0 THEN med ELSE robust END AS robust
    FROM (SELECT {keys}, any_value(n) AS n, any_value(mean) AS mean, any_value(med) AS med, any_value(mad) AS mad,
            sum(w * {value}) / nullif(sum(w), 0) AS robust
        FROM (SELECT *, CASE WHEN mad > 0 AND abs({value} - med) < 9 * mad
                THEN power(1 - power(({value} - med) / (9 * nullif(mad, 0)), 2), 2) ELSE 0 END AS w
            FROM {needed}
            JOIN (SELECT {keys}, count(*) AS n, avg({value}) AS mean, median({value}) AS med
                FROM {needed} GROUP BY {keys}) USING ({keys})
            JOIN (SELECT {keys}, median(abs({value} - med)) AS mad FROM {needed}
                JOIN (SELECT {keys}, median({value}) AS med FROM {needed} GROUP BY {keys}) USING ({keys})
                GROUP BY {keys}) USING ({keys}))
        GROUP BY {keys})"""


# Smoothing spline: the five-diagonal system eliminated year by year, then solved backwards.
view(
    "knots",
    "ring_width",
    """SELECT *, lead(y, 1) OVER s AS y1, lead(y, 2) OVER s AS y2,
        (2 + cos(2 * pi() / period)) / (12 * power(1 - cos(2 * pi() / period), 2)) AS w
    FROM (SELECT rwl, tree, year, CASE WHEN width = 0 THEN 0.001 ELSE width END AS y,
            row_number() OVER (PARTITION BY rwl, tree ORDER BY year) AS t,
            count(*) OVER (PARTITION BY rwl, tree) AS n,
            greatest(2, floor(0.67 * count(*) OVER (PARTITION BY rwl, tree))) AS period FROM ring_width)
    WINDOW s AS (PARTITION BY rwl, tree ORDER BY year)""",
)
view(
    "forward",
    "knots",
    """SELECT rwl, tree, t, n, w, 2 / 3.0::DOUBLE + 6 * w AS d, 0.0::DOUBLE AS d_before, 0.0::DOUBLE AS e,
        y2 - 2 * y1 + y AS z, 0.0::DOUBLE AS z_before FROM knots WHERE t = 1 AND n >= 3
    UNION ALL
    SELECT rwl, tree, t, n, w, 2 / 3.0::DOUBLE + 6 * w - e * e * d - f * f * d_before, d, e, q - e * z - f * z_before, z
    FROM (SELECT k.rwl, k.tree, k.t, k.n, k.w, d, d_before, z, z_before, y2 - 2 * y1 + y AS q,
            CASE WHEN k.t > 2 THEN k.w / d_before ELSE 0 END AS f,
            (1 / 6.0::DOUBLE - 4 * k.w - CASE WHEN k.t > 2 THEN k.w * e ELSE 0 END) / d AS e
        FROM forward p JOIN knots k ON k.rwl = p.rwl AND k.tree = p.tree AND k.t = p.t + 1 WHERE k.t <= k.n - 2)""",
)
view(
    "backward",
    "forward",
    """SELECT rwl, tree, t, w, z / d AS g, 0.0::DOUBLE AS g_after, e FROM forward WHERE t = n - 2
    UNION ALL
    SELECT f.rwl, f.tree, f.t, f.w, f.z / f.d - b.e * b.g - f.w / f.d * b.g_after, b.g, f.e
    FROM backward b JOIN forward f ON f.rwl = b.rwl AND f.tree = b.tree AND f.t = b.t - 1""",
)
view(
    "smooth",
    "backward",
    """SELECT k.rwl, k.tree, k.year, k.y, k.y - k.w * (coalesce(a.g, 0) - 2 * coalesce(b.g, 0) + coalesce(c.g, 0)) AS s
    FROM knots k LEFT JOIN backward a ON a.rwl = k.rwl AND a.tree = k.tree AND a.t = k.t
    LEFT JOIN backward b ON b.rwl = k.rwl AND b.tree = k.tree AND b.t = k.t - 1
    LEFT JOIN backward c ON c.rwl = k.rwl AND c.tree = k.tree AND c.t = k.t - 2""",
)
view(
    "spline_rwi",
    "smooth",
    """SELECT rwl, tree, year, y / CASE WHEN min(s) OVER t > 0 THEN s ELSE avg(y) OVER t END AS rwi FROM smooth
    WINDOW t AS (PARTITION BY rwl, tree)""",
)
view("spline_robust", "spline_rwi", biweight("spline_rwi", "rwl, year", "rwi"))
query("detrend_spline", "spline_rwi", f"SELECT {out('rwl tree', 'year', 'rwi')} FROM spline_rwi")
query(
    "spline_chronology",
    "spline_robust",
    f"SELECT {out('rwl', 'year samp_depth', 'std')} FROM (SELECT rwl, year, n AS samp_depth, robust AS std FROM spline_robust)",
)

view("robust", "rwi", biweight("rwi", "rwl, year", "rwi"))
view("chron", "robust", "SELECT rwl, year, robust AS std, n AS samp_depth FROM robust")
def correlation(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0)"


# Student's t from its density by Simpson's rule, independent of the closed sum.
P_VALUE = """CASE WHEN res_cor IS NULL OR n_years < 3 THEN NULL WHEN res_cor >= 1 THEN 0 WHEN res_cor <= -1 THEN 1
    ELSE (SELECT sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
            * power(cos(lo + i * (pi() / 2 - lo) / 4000), n_years - 3) * (pi() / 2 - lo) / 4000 / 3
            * exp(lgamma((n_years - 1) / 2.0::DOUBLE) - lgamma((n_years - 2) / 2.0::DOUBLE)) / sqrt(pi()))
        FROM (SELECT unnest(generate_series(0, 4000)) AS i, asin(res_cor) AS lo)) END"""
def interseries(prefix: str, source: str) -> None:
    """Views of the inter-series correlation of one index table."""
    view(
        f"{prefix}others",
        source,
        f"""SELECT a.rwl, a.tree, a.year, b.rwi FROM {source} a JOIN {source} b
        ON a.rwl = b.rwl AND a.year = b.year AND a.tree <> b.tree""",
    )
    view(f"{prefix}others_robust", f"{prefix}others", biweight(f"{prefix}others", "rwl, tree, year", "rwi"))
    view(
        f"{prefix}master",
        f"{source} {prefix}others_robust",
        f"""SELECT a.rwl, a.tree, a.year, a.rwi, coalesce(n, 0) AS n_others, robust AS master
        FROM {source} a LEFT JOIN {prefix}others_robust USING (rwl, tree, year)""",
    )
    view(
        f"{prefix}pairs",
        f"{prefix}master",
        f"""SELECT rwl, tree, year, round(rwi, 10) AS x, round(master, 10) AS y FROM {prefix}master
        WHERE master IS NOT NULL""",
    )
    ranks = ", ".join(
        f"""(SELECT count(*) FROM {prefix}pairs b WHERE b.rwl = a.rwl AND b.tree = a.tree AND b.{c} < a.{c})
        + ((SELECT count(*) FROM {prefix}pairs b WHERE b.rwl = a.rwl AND b.tree = a.tree AND b.{c} = a.{c}) + 1)
        / 2.0::DOUBLE AS {c}"""
        for c in ("x", "y")
    )
    view(f"{prefix}ranked", f"{prefix}pairs", f"SELECT a.rwl, a.tree, a.year, {ranks} FROM {prefix}pairs a")
    for name, pairs in ((f"{prefix}cor_spearman", f"{prefix}ranked"), (f"{prefix}cor_pearson", f"{prefix}pairs")):
        view(
            name,
            f"{source} {pairs}",
            f"""SELECT rwl, tree, res_cor, n_years, {P_VALUE} AS p_val FROM (
            SELECT t.rwl, t.tree, res_cor, coalesce(n_years, 0) AS n_years
            FROM (SELECT DISTINCT rwl, tree FROM {source}) t
            LEFT JOIN (SELECT rwl, tree, {correlation('x', 'y')} AS res_cor, count(*) AS n_years FROM {pairs}
                GROUP BY rwl, tree) c USING (rwl, tree))""",
        )


interseries("", "rwi")

# Yule-Walker coefficients order by order (Levinson), the order by AIC.
view(
    "centred",
    "rwi",
    """SELECT rwl, tree, year, x - avg(x) OVER t AS c, avg(x) OVER t AS m, count(*) OVER t AS n,
        row_number() OVER (PARTITION BY rwl, tree ORDER BY year) AS i
    FROM (SELECT *, rwi / avg(rwi) OVER (PARTITION BY rwl, tree) AS x FROM rwi)
    WINDOW t AS (PARTITION BY rwl, tree)""",
)
view(
    "covariances",
    "centred",
    """SELECT rwl, tree, any_value(n) AS n, list(cov ORDER BY k) AS cov FROM (
        SELECT a.rwl, a.tree, b.i - a.i AS k, any_value(a.n) AS n, sum(a.c * b.c) / any_value(a.n) AS cov
        FROM centred a JOIN centred b ON a.rwl = b.rwl AND a.tree = b.tree
            AND b.i - a.i BETWEEN 0 AND least(a.n - 1, floor(10 * log10(a.n)))
        WHERE a.n >= 4 GROUP BY 1, 2, 3)
    GROUP BY rwl, tree HAVING list(cov ORDER BY k)[1] > 0""",
)
view(
    "levinson",
    "covariances",
    """SELECT rwl, tree, n, cov, 0 AS p, CAST([] AS DOUBLE[]) AS phi, cov[1] AS v, n * ln(cov[1]) + 2 AS aic
        FROM covariances
    UNION ALL
    SELECT rwl, tree, n, cov, p + 1, list_append(list_transform(range(1, p + 1), lambda j: phi[j] - r * phi[p + 1 - j]), r),
        v * (1 - r * r), n * ln(v * (1 - r * r)) + 2 * (p + 1) + 2
    FROM (SELECT *, (cov[p + 2] - coalesce(list_sum(list_transform(range(1, p + 1), lambda j: phi[j] * cov[p + 2 - j])), 0)) / v AS r
        FROM levinson WHERE p + 1 < len(cov))""",
)
view(
    "white",
    "levinson",
    """SELECT rwl, tree, year, rwi FROM (
        SELECT a.rwl, a.tree, a.year, any_value(a.i) AS i, any_value(a.c + a.m) - coalesce(sum(phi[a.i - b.i] * b.c), 0) AS rwi,
            coalesce(any_value(len(phi)), 0) AS lost
        FROM centred a LEFT JOIN (SELECT rwl, tree, arg_min(phi, aic) AS phi FROM levinson GROUP BY rwl, tree) f
            USING (rwl, tree)
        LEFT JOIN centred b ON b.rwl = a.rwl AND b.tree = a.tree AND a.i - b.i BETWEEN 1 AND len(phi)
        GROUP BY a.rwl, a.tree, a.year)
    WHERE i > lost""",
)
interseries("white_", "white")
view(
    "cor_site",
    "cor_spearman",
    "SELECT rwl, avg(res_cor) AS mean_cor, avg(p_val) AS mean_pval FROM cor_spearman GROUP BY rwl",
)
view(
    "cv",
    "chron",
    "SELECT rwl, stddev_samp(std) AS sd, stddev_samp(std) / nullif(avg(std), 0) AS cv FROM chron GROUP BY rwl",
)
view(
    "site_slopes",
    "chron",
    f"""SELECT rwl, count(*) AS n_years, {slope('std')} AS growth_slope FROM chron
    WHERE year BETWEEN 1975 AND 2025 GROUP BY rwl""",
)
COR = ("rwl tree", "n_years", "res_cor p_val")
query("relative_widths", "rwi", f"SELECT {out('rwl tree', 'year', 'rwi')} FROM rwi")
query("chronology", "chron", f"SELECT {out('rwl', 'year samp_depth', 'std')} FROM chron")
query(
    "chronology_mean",
    "rwi",
    "SELECT rwl, CAST(year AS BIGINT) AS year, round(avg(rwi), 6) AS std, count(rwi) AS samp_depth FROM rwi GROUP BY rwl, year",
)
view("gaps", "rwi", "SELECT rwl, tree, year, CASE WHEN year % 10 <> 0 THEN rwi END AS rwi FROM rwi")
view(
    "gaps_robust",
    "gaps",
    f"""SELECT rwl, year, coalesce(n, 0) AS samp_depth, robust AS std FROM (SELECT DISTINCT rwl, year FROM gaps)
    LEFT JOIN ({biweight('(SELECT * FROM gaps WHERE rwi IS NOT NULL)', 'rwl, year', 'rwi')}) USING (rwl, year)""",
)
query("chronology_distributed", "gaps_robust", f"SELECT {out('rwl', 'year samp_depth', 'std')} FROM gaps_robust")
query("chronology_cv", "cv", f"SELECT {out('rwl', '', 'sd cv')} FROM cv")
query("site_trend", "site_slopes", f"SELECT {out('rwl', 'n_years', 'growth_slope', 8)} FROM site_slopes")
query("others_chronology", "master", f"SELECT {out('rwl tree', 'year n_others', 'rwi master')} FROM master")
query("others_chronology_distributed", "master", f"SELECT {out('rwl tree', 'year n_others', 'rwi master')} FROM master")
# All sites of one half of the nations are one site: some fifty trees to a year.
view("regions", "rwi", "SELECT 'r' || CAST(CAST(substr(rwl, 2) AS INT) % 2 AS VARCHAR) AS rwl, tree, year, rwi FROM rwi")
view("regions_robust", "regions", biweight("regions", "rwl, year", "rwi"))
interseries("regions_", "regions")
query(
    "chronology_brackets",
    "regions_robust",
    f"SELECT {out('rwl', 'year samp_depth', 'std')} FROM (SELECT rwl, year, n AS samp_depth, robust AS std FROM regions_robust)",
)
query(
    "others_chronology_brackets",
    "regions_master",
    f"SELECT {out('rwl tree', 'year n_others', 'rwi master')} FROM regions_master",
)
query("interseries_cor", "cor_spearman", f"SELECT {out(*COR)} FROM cor_spearman")
query("interseries_pearson", "cor_pearson", f"SELECT {out(*COR)} FROM cor_pearson")
query("interseries_prewhitened", "white_cor_spearman", f"SELECT {out(*COR)} FROM white_cor_spearman")
query("interseries_site", "cor_site", f"SELECT {out('rwl', '', 'mean_cor mean_pval')} FROM cor_site")
query(
    "interseries_flags",
    "cor_spearman",
    """SELECT rwl, 'Interseries Correlation failed' AS flag FROM cor_spearman GROUP BY rwl
    HAVING count(res_cor) = 0""",
)

# ---- pointer years and resilience -----------------------------------------------------------

view(
    "kernel",
    "",
    """SELECT unnest([-6,-5,-4,-3,-2,-1,0,1,2,3,4,5,6]) AS k,
        unnest([1,12,66,220,495,792,924,792,495,220,66,12,1]) / 4096.0::DOUBLE AS w""",
)
view(
    "idx",
    "ring_width kernel",
    """SELECT a.rwl, a.tree, a.year, any_value(a.width) / nullif(sum(b.width * w), 0) AS index
    FROM ring_width a JOIN ring_width b ON a.rwl = b.rwl AND a.tree = b.tree
    JOIN kernel ON b.year = a.year + k GROUP BY a.rwl, a.tree, a.year HAVING count(*) = 13""",
)
view(
    "z",
    "idx",
    """SELECT rwl, tree, year, (x - m) / nullif(sd, 0) AS z FROM (
        SELECT a.rwl, a.tree, a.year, any_value(a.index) AS x, avg(b.index) AS m, stddev_samp(b.index) AS sd
        FROM idx a JOIN idx b ON a.rwl = b.rwl AND a.tree = b.tree AND b.year BETWEEN a.year - 6 AND a.year + 6
        GROUP BY a.rwl, a.tree, a.year HAVING count(*) = 13)
    WHERE sd > 0""",
)
view(
    "py",
    "z",
    """SELECT rwl, year, count(*) AS nb_series,
        100.0::DOUBLE * count(*) FILTER (z > 1.645) / count(*) AS perc_pos_extreme,
        100.0::DOUBLE * count(*) FILTER (z > 1.28 AND z <= 1.645) / count(*) AS perc_pos_strong,
        100.0::DOUBLE * count(*) FILTER (z > 1 AND z <= 1.28) / count(*) AS perc_pos_weak,
        100.0::DOUBLE * count(*) FILTER (z < -1.645) / count(*) AS perc_neg_extreme,
        100.0::DOUBLE * count(*) FILTER (z < -1.28 AND z >= -1.645) / count(*) AS perc_neg_strong,
        100.0::DOUBLE * count(*) FILTER (z < -1 AND z >= -1.28) / count(*) AS perc_neg_weak,
        CASE WHEN count(*) FILTER (z > 1) * 5 >= count(*) THEN 1
            WHEN count(*) FILTER (z < -1) * 5 >= count(*) THEN -1 ELSE 0 END AS nature
    FROM z GROUP BY rwl, year""",
)
view(
    "missing",
    "ring_coded",
    """SELECT rwl, count(DISTINCT tree) AS series_count, max(year) - min(year) + 1 AS total_year,
        count(*) FILTER (round(width, 4) = 0) AS missing_years_0,
        count(*) FILTER (round(width, 4) = 0.01) AS missing_years_2,
        count(*) FILTER (round(width, 4) = 0.001) AS missing_years_3,
        count(*) FILTER (round(width, 4) IN (0, 0.01, 0.001)) AS total_missing_years
    FROM ring_coded GROUP BY rwl""",
)
view(
    "guards",
    "missing idx",
    """SELECT m.*, coalesce(f, 0) AS f, CASE WHEN series_count < 3 THEN 'less than 3 trees'
        WHEN total_year < 26 THEN 'Less than 26 years'
        WHEN coalesce(f, 0) < 26 THEN 'Less than 26 years after detrend' END AS guard
    FROM missing m LEFT JOIN (SELECT rwl, max(year) - min(year) + 1 AS f FROM idx WHERE index IS NOT NULL GROUP BY rwl)
        USING (rwl)""",
)
COUNT_COLUMNS = "series_count missing_years_0 missing_years_2 missing_years_3 total_missing_years"
COUNT_LIST = ", ".join(COUNT_COLUMNS.split())
view(
    "flags",
    "guards py",
    f"""SELECT * FROM (SELECT rwl, coalesce(guard,
            CASE WHEN NOT EXISTS (SELECT 1 FROM py WHERE py.rwl = g.rwl AND year >= 1900) THEN 'older than 1900' END,
            CASE WHEN NOT EXISTS (SELECT 1 FROM py WHERE py.rwl = g.rwl AND year >= 1900 AND nature = -1)
                THEN 'no pointer years calculated' END) AS flag,
        CASE WHEN guard IN ('less than 3 trees', 'Less than 26 years') THEN total_year ELSE f END AS total_year,
        {COUNT_LIST} FROM guards g) WHERE flag IS NOT NULL""",
)
view(
    "negative",
    "flags",
    f"""SELECT py.rwl, year AS pointer_year, nb_series AS py_series, nature, perc_neg_extreme, perc_neg_strong,
        perc_neg_weak, f AS total_year, {COUNT_LIST}, CAST(NULL AS VARCHAR) AS flag
    FROM py JOIN guards ON py.rwl = guards.rwl WHERE nature = -1 AND year >= 1900 AND guard IS NULL
    UNION ALL SELECT rwl, NULL, NULL, NULL, NULL, NULL, NULL, total_year, {COUNT_LIST}, flag FROM flags""",
)
view("freq", "negative", "SELECT pointer_year, count(*) AS n FROM negative GROUP BY pointer_year")
view(
    "res",
    "idx",
    """SELECT a.rwl, a.tree, a.year, a.index / nullif(p.m, 0) AS resist, q.m / nullif(a.index, 0) AS recov,
        q.m / nullif(p.m, 0) AS resil, (q.m - a.index) / nullif(p.m, 0) AS rel_resil
    FROM idx a
    LEFT JOIN (SELECT x.rwl, x.tree, x.year, avg(y.index) AS m FROM idx x JOIN idx y ON x.rwl = y.rwl
        AND x.tree = y.tree AND y.year BETWEEN x.year - 4 AND x.year - 1 GROUP BY 1, 2, 3 HAVING count(*) = 4) p
        USING (rwl, tree, year)
    LEFT JOIN (SELECT x.rwl, x.tree, x.year, avg(y.index) AS m FROM idx x JOIN idx y ON x.rwl = y.rwl
        AND x.tree = y.tree AND y.year BETWEEN x.year + 1 AND x.year + 4 GROUP BY 1, 2, 3 HAVING count(*) = 4) q
        USING (rwl, tree, year)""",
)
RES_PARTS = {
    "resilience": "resil",
    "rel_resilience": "rel_resil",
    "resistance": "resist",
    "recovery": "recov",
}
view(
    "res_year",
    "res",
    "SELECT rwl, year AS pointer_year, "
    + ", ".join(
        f"avg({c}) AS {n}, stddev_samp({c}) AS {n}_sd, count({c}) AS {n}_series" for n, c in RES_PARTS.items()
    )
    + " FROM res GROUP BY rwl, year",
)
RES_REAL = " ".join(f"{n} {n}_sd" for n in RES_PARTS)
RES_WHOLE = " ".join(f"{n}_series" for n in RES_PARTS)
RES_LIST = ", ".join((RES_REAL + " " + RES_WHOLE).split())
view(
    "res_site",
    "res_year guards freq",
    f"""SELECT rwl, pointer_year, {RES_LIST}, CAST(NULL AS VARCHAR) AS flag FROM res_year
    WHERE pointer_year IN (SELECT pointer_year FROM freq WHERE n > 1 AND pointer_year IS NOT NULL)
        AND rwl IN (SELECT rwl FROM guards WHERE guard IS NULL)
    UNION ALL SELECT rwl, NULL, {', '.join('NULL' for _ in RES_LIST.split(', '))}, guard FROM guards
    WHERE guard IS NOT NULL""",
)
query("lowpass13", "idx", f"SELECT {out('rwl tree', 'year', 'index')} FROM idx")
query("growth_z", "z", f"SELECT {out('rwl tree', 'year', 'z')} FROM z")
SHARES = "perc_pos_extreme perc_pos_strong perc_pos_weak perc_neg_extreme perc_neg_strong perc_neg_weak"
query("pointer_years", "py", f"SELECT {out('rwl', 'year nb_series nature', SHARES)} FROM py")
query("missing_rings", "missing", f"SELECT {out('rwl', 'total_year ' + COUNT_COLUMNS)} FROM missing")
query("pointer_flags", "flags", f"SELECT {out('rwl flag', 'total_year ' + COUNT_COLUMNS)} FROM flags")
NEG = ("rwl flag", "pointer_year py_series nature total_year " + COUNT_COLUMNS, "perc_neg_extreme perc_neg_strong perc_neg_weak")
query("negative_pointer_years", "negative", f"SELECT {out(*NEG)} FROM negative")
query(
    "pointer_year_report",
    "freq",
    f"SELECT {out('', 'pointer_year n place')} FROM (SELECT *, row_number() OVER (ORDER BY n DESC, pointer_year NULLS FIRST) AS place FROM freq)",
)
query("pointer_year_freq", "freq", f"SELECT {out('', 'pointer_year n')} FROM freq")
query(
    "frequent_years",
    "freq",
    "SELECT CAST(pointer_year AS BIGINT) AS pointer_year FROM freq WHERE n > 1 AND pointer_year IS NOT NULL",
)
query("resilience_tree", "res", f"SELECT {out('rwl tree', 'year', 'resist recov resil rel_resil')} FROM res")
for _name in ("tree_stats", "detrend_spline", "lowpass13", "growth_z", "resilience_tree"):
    ORACLE[f"series_{_name}"] = ORACLE[_name]
query(
    "recovery_period",
    "idx",
    """SELECT a.rwl, a.tree, CAST(a.year AS BIGINT) AS year, CAST(min(CASE WHEN a.index < m AND b.index >= m
        THEN b.year - a.year END) AS BIGINT) AS rec_period
    FROM idx a
    LEFT JOIN (SELECT x.rwl, x.tree, x.year, avg(y.index) AS m FROM idx x JOIN idx y ON x.rwl = y.rwl
        AND x.tree = y.tree AND y.year BETWEEN x.year - 4 AND x.year - 1 GROUP BY 1, 2, 3 HAVING count(*) = 4) p
        USING (rwl, tree, year)
    LEFT JOIN idx b ON b.rwl = a.rwl AND b.tree = a.tree AND b.year BETWEEN a.year + 1 AND a.year + 10
    GROUP BY a.rwl, a.tree, a.year""",
)
query("resilience_site", "res_site", f"SELECT {out('rwl flag', 'pointer_year ' + RES_WHOLE, RES_REAL)} FROM res_site")
query("resilience_flags", "guards", "SELECT rwl, guard AS flag FROM guards WHERE guard IS NOT NULL")
_full = [
    f"(SELECT rwl, pointer_year, {n}, {n}_sd, {n}_series FROM res_year WHERE {n}_series > 0)"
    for n in RES_PARTS
]
query(
    "component_full_join",
    "res_year",
    f"SELECT {out('rwl', 'pointer_year ' + RES_WHOLE, RES_REAL)} FROM {_full[0]} a "
    + " ".join(f"FULL JOIN {p} p{k} USING (rwl, pointer_year)" for k, p in enumerate(_full[1:])),
)

# ---- climate --------------------------------------------------------------------------------

# Month labels in the order of the year.
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
view(
    "months",
    "",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i - 5}, '{_MONTHS[i - 1]}', {i}, true)" for i in range(6, 13))
    + ", "
    + ", ".join(f"({i + 7}, '{_MONTHS[i - 1].upper()}', {i}, false)" for i in range(1, 10))
    + ") AS t(month_order, label, month, is_prev)",
)
VARIABLES = "pre tmp tmn tmx".split()


def lagged(variables: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT rwl, year + (CASE WHEN is_prev THEN 1 ELSE 0 END) AS year, month_order, label AS month, is_prev,
        {i} AS var_order, '{v}' AS varname, {v} AS value FROM climate JOIN months USING (month)"""
        for i, v in enumerate(variables)
    )


view(
    "months_wide",
    "",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i - 8}, '{_MONTHS[i - 1]}', {i}, true)" for i in range(9, 13))
    + ", "
    + ", ".join(f"({i + 4}, '{_MONTHS[i - 1].upper()}', {i}, false)" for i in range(1, 13))
    + ") AS t(month_order, label, month, is_prev)",
)
view("lagged_wide", "climate months_wide", lagged(VARIABLES).replace("JOIN months ", "JOIN months_wide "))
view("lagged_spei_wide", "climate months_wide", lagged(["spei"]).replace("JOIN months ", "JOIN months_wide "))
view("lagged", "climate months", lagged(VARIABLES))
view("lagged_spei", "climate months", lagged(["spei"]))
view("lagged_all", "climate months", lagged([*VARIABLES, "spei"]))
COEF_KEYS = "rwl, var_order, varname, month_order, month, is_prev"
WINDOW = "varname || '.' || (CASE WHEN is_prev THEN 'prev' ELSE 'curr' END) || '.' || lower(month) AS window, var_order * 16 + month_order AS id"
for name, source in (
    ("coefs", "lagged"),
    ("spei_coefs", "lagged_spei"),
    ("coefs_wide", "lagged_wide"),
    ("spei_coefs_wide", "lagged_spei_wide"),
):
    view(
        name,
        f"chron {source}",
        f"""SELECT rwl, {WINDOW}, varname, month, month_order, coef, abs(coef) >= 0.2 AS significant,
            CAST(NULL AS DOUBLE) AS ci_lower, CAST(NULL AS DOUBLE) AS ci_upper
        FROM (SELECT {COEF_KEYS}, {correlation('value', 'std')} AS coef FROM {source} JOIN chron USING (rwl, year)
            WHERE std IS NOT NULL AND value IS NOT NULL GROUP BY ALL)""",
    )
for wide in ("", "_wide"):
    view(
        f"spei{wide}",
        f"spei_coefs{wide}",
        f"""SELECT rwl, "window" AS spei_window, id AS spei_id, varname AS spei_var, month AS spei_month, month_order,
            coef AS spei_coef, significant AS spei_significant, ci_lower AS spei_ci_lower, ci_upper AS spei_ci_upper
        FROM spei_coefs{wide}""",
    )
    view(
        f"placed{wide}",
        f"spei{wide} meta",
        f"""SELECT s.*, latitude, longitude FROM spei{wide} s JOIN meta USING (rwl)
        WHERE latitude IS NOT NULL AND longitude IS NOT NULL""",
    )
COEF = ('rwl "window" varname month significant', "id month_order", "coef ci_lower ci_upper")
SPEI = ("rwl spei_window spei_var spei_month spei_significant", "spei_id", "spei_coef spei_ci_lower spei_ci_upper")
query(
    "climate_long",
    "climate",
    f"SELECT {out('rwl', 'year month', 'pre tmp tmn tmx')} FROM climate",
)
view(
    "samples",
    "cells grid_monthly",
    """SELECT rwl, l.variable, c.row, c.col, l.layer, value
    FROM cells c CROSS JOIN (SELECT DISTINCT variable, layer FROM grid_monthly) l
    LEFT JOIN grid_monthly g ON g.row = c.row AND g.col = c.col AND g.variable = l.variable AND g.layer = l.layer""",
)
query(
    "climate_samples_long",
    "samples",
    """SELECT rwl, CAST(1901 + floor((layer - 1) / 12) AS BIGINT) AS year, CAST((layer + 119) % 12 + 1 AS BIGINT) AS month,
        round(max(value) FILTER (variable = 'pre'), 6) AS pre,
        round(max(value) FILTER (variable = 'spei' AND layer > 12), 6) AS spei
    FROM samples GROUP BY rwl, layer HAVING count(*) FILTER (variable = 'pre') > 0""",
)
_labels = [(k, f"{1901 + (k - 1) // 12}_{_MONTHS[(k - 1) % 12]}") for k in range(-35, 49)]
query(
    "climate_wide",
    "samples",
    "SELECT rwl, "
    + ", ".join(f'round(max(value) FILTER (layer = {k}), 6) AS "{label}"' for k, label in _labels)
    + " FROM samples WHERE variable = 'pre' GROUP BY rwl",
)
query(
    "climate_wide_to_long",
    "samples",
    f"""SELECT s.rwl, CAST(1901 + floor((k - 1) / 12) AS BIGINT) AS year, {_MONTHS!r}[(k + 119) % 12 + 1] AS month,
        round(value, 6) AS pre, CAST((k + 119) % 12 + 1 AS BIGINT) AS month_number
    FROM (SELECT DISTINCT rwl FROM samples WHERE variable = 'pre') s
    CROSS JOIN (SELECT unnest(generate_series(-35, 48)) AS k)
    LEFT JOIN samples v ON v.rwl = s.rwl AND v.layer = k AND v.variable = 'pre'""",
)
query(
    "lagged_months",
    "lagged",
    f"SELECT {out('rwl month is_prev varname', 'year month_order var_order', 'value')} FROM lagged",
)
query(
    "climate_response_flags",
    "chron lagged",
    """SELECT rwl, coalesce(n_years, 0) AS n_years, CASE WHEN n_years IS NULL THEN 'no year with all predictors'
        WHEN n_years < 30 THEN 'too few years with all predictors' WHEN sd = 0 THEN 'growth does not vary' END AS flag
    FROM (SELECT DISTINCT rwl FROM chron) LEFT JOIN (
        SELECT rwl, count(*) AS n_years, stddev_pop(std) AS sd FROM (
            SELECT rwl, year FROM lagged WHERE value IS NOT NULL GROUP BY rwl, year HAVING count(*) = 64)
        JOIN chron USING (rwl, year) WHERE std IS NOT NULL GROUP BY rwl) USING (rwl)
    WHERE n_years IS NULL OR n_years < 30 OR sd = 0""",
)
query("climate_correlation", "coefs", f"SELECT {out(*COEF)} FROM coefs")
query("spei_correlation", "spei", f"SELECT {out(*SPEI)} FROM spei")
view(
    "numbered",
    "chron lagged_all",
    f"""SELECT {COEF_KEYS}, value, std, row_number() OVER (PARTITION BY {COEF_KEYS} ORDER BY year) AS i,
        count(*) OVER (PARTITION BY {COEF_KEYS}) AS n
    FROM lagged_all JOIN chron USING (rwl, year) WHERE std IS NOT NULL AND value IS NOT NULL""",
)


def mixed(x: str) -> str:
    """The finaliser of MurmurHash3, step by step."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = f"list_transform([{x}], lambda h: (xor(h, h >> {shift}) * {factor}::UBIGINT) & 4294967295::UBIGINT)[1]"
    return f"list_transform([{x}], lambda h: xor(h, h >> 16))[1]"


def draws(source: str, replicates: int) -> str:
    """Years drawn for each site (with its number of years n), replicate and position; replicate 0 takes every year once."""
    return f"""SELECT rwl, n, b, i, CASE WHEN b = 0 THEN i ELSE CAST({mixed(f"xor(('0x' || substr(md5('1/' || rwl), 1, 8))::UBIGINT, m)")} % n AS BIGINT) + 1 END AS pick
    FROM (SELECT DISTINCT rwl, n FROM {source}),
        (SELECT b, i, {mixed(f"xor(b::UBIGINT, {mixed('i::UBIGINT')})")} AS m
            FROM (SELECT unnest(generate_series(0, {replicates})) AS b), (SELECT unnest(generate_series(1, 200)) AS i)) WHERE i <= n"""


view("draws", "numbered", f"SELECT * FROM ({draws('numbered', 100)}) WHERE b > 0")
view(
    "resampled",
    "draws",
    f"""SELECT {COEF_KEYS}, b, covar_pop(value, std) / sqrt(nullif(var_pop(value) * var_pop(std), 0)) AS r,
        var_pop(value) * var_pop(std) * v.n * v.n AS spread
    FROM numbered v JOIN draws d USING (rwl, n) WHERE v.i = d.pick GROUP BY {COEF_KEYS}, b, v.n, d.n""",
)
query(
    "bootstrap_ci",
    "resampled",
    f"""SELECT {out(*COEF)} FROM (SELECT rwl, {WINDOW}, varname, month, month_order, coef, lo AS ci_lower, hi AS ci_upper,
        lo > 0 OR hi < 0 AS significant FROM
        (SELECT {COEF_KEYS}, {correlation('value', 'std')} AS coef FROM numbered GROUP BY {COEF_KEYS})
        LEFT JOIN (SELECT {COEF_KEYS}, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM resampled
            WHERE sqrt(spread) > 1e-12 GROUP BY {COEF_KEYS}) USING ({COEF_KEYS}))""",
)


def standardised(prefix: str, source: str, replicates: int, least_years: int) -> None:
    """Correlations of all predictors (x, flat, by row) and of each with growth (y), of every site and resample."""
    size = 16
    view(
        f"{prefix}years",
        f"chron {source}",
        f"""SELECT rwl, std, x, row_number() OVER (PARTITION BY rwl ORDER BY year) AS i, count(*) OVER (PARTITION BY rwl) AS n FROM (
            SELECT rwl, year, std, list(value ORDER BY var_order, month_order) AS x FROM {source} JOIN chron USING (rwl, year)
            WHERE std IS NOT NULL AND value IS NOT NULL GROUP BY rwl, year, std HAVING count(*) = {size})""",
    )
    view(f"{prefix}draws", f"{prefix}years", draws(f"{prefix}years", replicates))
    view(
        f"{prefix}cells",
        f"{prefix}draws",
        f"""SELECT rwl, b, d.i, k, std, x[k] AS v, x FROM {prefix}years y JOIN {prefix}draws d USING (rwl, n), range(1, {size + 1}) r(k)
        WHERE y.i = d.pick AND n >= {least_years}""",
    )
    view(
        f"{prefix}correlations",
        f"{prefix}cells",
        f"""SELECT rwl, b, list(CASE WHEN isnan(r) THEN 0 ELSE r END ORDER BY k, j) AS x, list(CASE WHEN isnan(g) THEN 0 ELSE g END ORDER BY k) FILTER (j = 1) AS y,
            list(NOT isnan(g) ORDER BY k) FILTER (j = 1) AS varies FROM (
            SELECT rwl, b, k, j, coalesce(corr(v, x[j]), 'nan') AS r, coalesce(corr(v, std), 'nan') AS g FROM {prefix}cells, range(1, {size + 1}) r(j)
            GROUP BY rwl, b, k, j)
        GROUP BY rwl, b""",
    )


view("lagged_spei", "lagged_all", "SELECT * REPLACE (0 AS var_order) FROM lagged_all WHERE varname = 'spei'")
# All components kept is least squares: elimination of one predictor after another from the bordered matrix, by row.
standardised("all_", "lagged_spei", 0, 18)
view(
    "eliminated",
    "all_correlations",
    """SELECT rwl, b, 0 AS k, flatten(list_transform(range(1, 17), lambda r: list_append(x[16 * (r - 1) + 1 : 16 * r], y[r]))) AS m FROM all_correlations
    UNION ALL
    SELECT rwl, b, k + 1, list_transform(m, lambda v, ix: CASE WHEN (ix - 1) // 17 = k THEN v / m[18 * k + 1]
        ELSE v - m[17 * ((ix - 1) // 17) + k + 1] * m[17 * k + (ix - 1) % 17 + 1] / m[18 * k + 1] END) FROM eliminated WHERE k < 16""",
)
RESPONSE = f"SELECT rwl, {WINDOW}, varname, month, month_order, coef, ci_lower, ci_upper, ci_lower > 0 OR ci_upper < 0 AS significant"
query(
    "spei_regression",
    "eliminated lagged_spei",
    f"""SELECT {out(*COEF)} FROM ({RESPONSE} FROM (
        SELECT rwl, m[17 * month_order] AS coef, CAST(NULL AS DOUBLE) AS ci_lower, CAST(NULL AS DOUBLE) AS ci_upper,
            var_order, varname, month_order, month, is_prev
        FROM eliminated, (SELECT DISTINCT var_order, varname, month_order, month, is_prev FROM lagged_spei) WHERE k = 16))""",
)
# The response function itself: eigenvectors by Jacobi rotations of all pairs in turn, the matrix and the vectors in one flat list.
standardised("pc_", "lagged_spei", 4, 3)
_AT = "s[16 * {} + {} + 1]".format
_P, _Q = "CAST(e[1] AS INT)", "CAST(e[2] AS INT)"
_THETA = f"({_AT(_Q, _Q)} - {_AT(_P, _P)}) / (2 * {_AT(_P, _Q)})"
_ANGLE = f"CASE WHEN abs({_AT(_P, _Q)}) < 1e-150 THEN 0 ELSE atan(CASE WHEN {_THETA} >= 0 THEN 1 ELSE -1 END / (abs({_THETA}) + sqrt({_THETA} * {_THETA} + 1))) END"
_TURN = f"list_transform([{_ANGLE}], lambda a: [cos(a), sin(a), e[1], e[2]])[1]"
# Columns p and q of both halves are turned first, then rows p and q of the matrix.
_COLUMNS = """list_transform(s, lambda v, ix: CASE
    WHEN (ix - 1) % 16 = t[3] THEN t[1] * v - t[2] * s[ix + CAST(t[4] - t[3] AS INT)]
    WHEN (ix - 1) % 16 = t[4] THEN t[2] * s[ix - CAST(t[4] - t[3] AS INT)] + t[1] * v ELSE v END)"""
_ROWS = """list_transform(u, lambda v, ix: CASE
    WHEN ix <= 256 AND (ix - 1) // 16 = t[3] THEN t[1] * v - t[2] * u[ix + 16 * CAST(t[4] - t[3] AS INT)]
    WHEN ix <= 256 AND (ix - 1) // 16 = t[4] THEN t[2] * u[ix - 16 * CAST(t[4] - t[3] AS INT)] + t[1] * v ELSE v END)"""
_ROTATED = f"list_transform([{_TURN}], lambda t: list_transform([{_COLUMNS}], lambda u: {_ROWS})[1])[1]"
view(
    "rotated",
    "pc_correlations",
    f"""SELECT rwl, b, y, varies, list_reduce(list_prepend(list_concat(x, list_transform(range(256), lambda i: CASE WHEN i // 16 = i % 16 THEN 1.0::DOUBLE ELSE 0 END)),
        flatten(list_transform(range(8), lambda sweep: list_filter(flatten(list_transform(range(16), lambda p: list_transform(range(16),
            lambda q: [p::DOUBLE, q::DOUBLE]))), lambda e: e[1] < e[2])))), lambda s, e: {_ROTATED}) AS s FROM pc_correlations""",
)
view(
    "components",
    "rotated",
    """SELECT rwl, b, c, s[17 * (c - 1) + 1] AS value, list_transform(range(16), lambda r: s[256 + 16 * r + c]) AS vector, y, varies
    FROM rotated, range(1, 17) r(c)""",
)
view(
    "kept",
    "components pc_years",
    """SELECT rwl, b, value, vector, y, varies FROM (
        SELECT *, sum(ln(greatest(value, 1e-300))) OVER w AS falling, row_number() OVER w AS place FROM components
        JOIN (SELECT DISTINCT rwl, n FROM pc_years) USING (rwl) WINDOW w AS (PARTITION BY rwl, b ORDER BY value DESC))
    WHERE place <= greatest(1, n - 2) AND (falling > 0 OR place = 1)""",
)
view(
    "responses",
    "kept",
    """SELECT rwl, b, j AS month_order, CASE WHEN any_value(varies)[j] THEN sum(vector[j] * list_inner_product(vector, y) / nullif(value, 0)) END AS coef
    FROM kept, range(1, 17) r(j) GROUP BY rwl, b, j""",
)
query(
    "spei_response",
    "responses lagged_spei",
    f"""SELECT {out(*COEF)} FROM ({RESPONSE} FROM (
        SELECT rwl, month_order, any_value(coef) FILTER (b = 0) AS coef, quantile_cont(coef, 0.025) FILTER (b > 0) AS ci_lower,
            quantile_cont(coef, 0.975) FILTER (b > 0) AS ci_upper FROM responses GROUP BY rwl, month_order)
    JOIN (SELECT DISTINCT var_order, varname, month_order, month, is_prev FROM lagged_spei) USING (month_order))""",
)
query(
    "signature",
    "coefs",
    f"""SELECT {out('varname month mark_sig', 'month_order', 'mean_coef prop_sig')} FROM (
    SELECT varname, month, month_order, avg(coef) AS mean_coef, avg(CAST(significant AS DOUBLE)) AS prop_sig,
        avg(CAST(significant AS DOUBLE)) >= 0.1 AS mark_sig FROM coefs GROUP BY ALL)""",
)
query(
    "signature_wide_window",
    "coefs_wide",
    f"""SELECT {out('varname month mark_sig', 'month_order', 'mean_coef prop_sig')} FROM (
    SELECT varname, month, month_order, avg(coef) AS mean_coef, avg(CAST(significant AS DOUBLE)) AS prop_sig,
        avg(CAST(significant AS DOUBLE)) >= 0.1 AS mark_sig FROM coefs_wide GROUP BY ALL)""",
)
query("significant_coefs", "coefs", f"SELECT {out(*COEF)} FROM coefs WHERE significant IS NOT NULL")
query(
    "spei_mean_map",
    "placed",
    f"""SELECT {out('rwl', 'n_months', 'latitude longitude mean_coef')} FROM (SELECT rwl, latitude, longitude,
    avg(spei_coef) AS mean_coef, count(spei_coef) AS n_months FROM placed GROUP BY ALL)""",
)
query(
    "strongest_month",
    "placed",
    f"""SELECT {out(SPEI[0] + ' cor_sign', SPEI[1], SPEI[2] + ' latitude longitude')} FROM (SELECT *,
    CASE WHEN spei_coef >= 0 THEN 'Positive' WHEN spei_coef < 0 THEN 'Negative' END AS cor_sign,
    row_number() OVER (PARTITION BY rwl ORDER BY abs(spei_coef) DESC NULLS LAST, month_order) AS k FROM placed) WHERE k = 1""",
)
query(
    "strongest_month_wide_window",
    "placed_wide",
    f"""SELECT {out(SPEI[0] + ' cor_sign', SPEI[1], SPEI[2] + ' latitude longitude')} FROM (SELECT *,
    CASE WHEN spei_coef >= 0 THEN 'Positive' WHEN spei_coef < 0 THEN 'Negative' END AS cor_sign,
    row_number() OVER (PARTITION BY rwl ORDER BY abs(spei_coef) DESC NULLS LAST, month_order) AS k FROM placed_wide) WHERE k = 1""",
)
query(
    "significant_by_month",
    "placed",
    f"""SELECT {out('spei_month', 'n_sig n_total', 'prop_sig')} FROM (SELECT spei_month,
    count(*) FILTER (spei_significant) AS n_sig, count(spei_significant) AS n_total,
    count(*) FILTER (spei_significant) / nullif(count(spei_significant), 0) AS prop_sig FROM placed GROUP BY spei_month)""",
)
view(
    "boxes",
    "placed",
    """SELECT spei_month, count(spei_coef) AS n, quantile_cont(spei_coef, 0.25) AS q1, quantile_cont(spei_coef, 0.5) AS q2,
        quantile_cont(spei_coef, 0.75) AS q3 FROM placed GROUP BY spei_month""",
)
_INSIDE = "spei_coef BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
query(
    "month_distribution",
    "boxes",
    f"""SELECT {out('spei_month', 'n n_outliers', 'q1 q2 q3 whisker_low whisker_high')} FROM (
    SELECT spei_month, n, q1, q2, q3, min(spei_coef) FILTER ({_INSIDE}) AS whisker_low,
        max(spei_coef) FILTER ({_INSIDE}) AS whisker_high, count(*) FILTER (NOT ({_INSIDE})) AS n_outliers
    FROM placed JOIN boxes USING (spei_month) GROUP BY ALL)""",
)
ORACLE["month_distribution_distributed"] = ORACLE["month_distribution"]
ORACLE["month_distribution_brackets"] = ORACLE["month_distribution"]
query(
    "month_outliers",
    "boxes",
    f"SELECT {out('rwl spei_month', '', 'spei_coef')} FROM placed JOIN boxes USING (spei_month) WHERE NOT ({_INSIDE})",
)

# ---- grids ----------------------------------------------------------------------------------

query(
    "crop_grid",
    "grid_monthly",
    f"""SELECT {out('variable', 'row col layer', 'value')} FROM grid_monthly
    WHERE -10 + (col + 0.5) * 0.5 BETWEEN 0 AND 20 AND 75 - (row + 0.5) * 0.5 BETWEEN 40 AND 60""",
)
query("sample_grid", "samples", f"SELECT {out('rwl variable', 'row col layer', 'value')} FROM samples")
query(
    "distinct_points",
    "points",
    f"""SELECT {out('rwl', '', 'longitude latitude')} FROM (SELECT *, row_number() OVER
    (PARTITION BY longitude, latitude ORDER BY rwl) AS k FROM points) WHERE k = 1""",
)
query(
    "rasterize_last",
    "cells",
    f"""SELECT {out('', 'row col', 'value')} FROM (SELECT row, col, balance AS value, row_number() OVER
    (PARTITION BY row, col ORDER BY seq DESC) AS k FROM cells WHERE inside) WHERE k = 1""",
)
query(
    "resample_bilinear",
    "grid_static",
    f"""SELECT {out('layer', 'row col', 'value')} FROM (
    SELECT layer, tr AS row, tc AS col, sum(value * w) / sum(w) AS value FROM grid_static g JOIN (
        SELECT tr, tc, y0 + dy AS row, x0 + dx AS col,
            (1 - abs(y - (y0 + dy))) * (1 - abs(x - (x0 + dx))) AS w
        FROM (SELECT *, least(floor(y), 78) AS y0, least(floor(x), 88) AS x0 FROM (
            SELECT tr, tc, greatest(0, least(79, (tr + 0.5::DOUBLE) / 2 - 0.5)) AS y,
                greatest(0, least(89, (tc + 0.5::DOUBLE) / 2 - 0.5)) AS x
            FROM (SELECT unnest(generate_series(0, 159)) AS tr), (SELECT unnest(generate_series(0, 179)) AS tc))),
            (VALUES (0), (1)) AS a(dy), (VALUES (0), (1)) AS b(dx)) c USING (row, col)
    WHERE w > 0 GROUP BY layer, tr, tc)""",
)
_names = LAYERS.strip("[]").replace("'", "").split(",")
query(
    "site_covariates",
    "cells grid_static",
    "SELECT rwl, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, "
    + ", ".join(f"round(max(value) FILTER (layer = '{n}'), 6) AS {n}" for n in _names)
    + " FROM cells LEFT JOIN grid_static USING (row, col) GROUP BY rwl, longitude, latitude",
)
query(
    "point_casts",
    "points",
    """SELECT rwl, round(longitude, 6) AS lon, round(latitude, 6) AS lat,
        CASE WHEN seq % 3 <> 0 THEN CAST(seq AS DOUBLE) END AS mainc_code,
        CASE WHEN seq % 2 <> 0 THEN round(balance, 6) END AS kg FROM points""",
)

# ---- catalogue, text files, small reports ---------------------------------------------------

view(
    "studies",
    "",
    """SELECT c_custkey AS key, unnest(CASE WHEN c_custkey % 10 = 0 THEN [1, 2] ELSE [1] END) AS number, c_name,
        c_mktsegment, CASE WHEN c_custkey % 11 <> 0 THEN 'C' || c_custkey END AS code,
        CASE WHEN n_nationkey = 8 THEN 'Russia' ELSE n_name END AS country,
        'Continent>' || (CASE WHEN r_name = 'EUROPE' THEN 'Europe' ELSE r_name END) || '>'
            || (CASE WHEN n_nationkey = 8 THEN 'Eastern Europe>Russia' ELSE n_name END) AS location,
        1500 + c_custkey % 600 AS first_year, 1850 + c_custkey % 200 AS last_year,
        CAST(c_custkey % 40 + 35 AS DOUBLE) AS lat, CAST(c_custkey % 45 - 10 AS DOUBLE) AS lon
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
SPECIES = """CASE WHEN key % 2 = 0 THEN 'PISY, ' || substr(c_mktsegment, 1, 4) ELSE 'PISY' END AS species_code,
    CASE WHEN key % 2 = 0 THEN 'Pinus sylvestris, ' || c_mktsegment ELSE 'Pinus sylvestris' END AS species_name,
    CASE WHEN key % 5 <> 0 THEN CAST(key % 2000 AS DOUBLE) END AS elevation,
    CAST(first_year AS BIGINT) AS first_year, CAST(last_year AS BIGINT) AS last_year"""
query(
    "catalogue_explode",
    "studies",
    f"""SELECT CAST(key AS VARCHAR) AS NOAAStudyId, number || '-' || key AS NOAASiteId, c_name || ' ' || number AS siteName,
        code AS studyCode, c_mktsegment AS investigators, location AS locationName, country,
        CASE WHEN key % 7 = 0 THEN 'cal yr BP' ELSE 'CE' END AS date_type,
        CASE WHEN key % 3 = 0 THEN lat + 0.5::DOUBLE ELSE lat END AS latitude,
        CASE WHEN key % 3 = 0 THEN lon + 1 ELSE lon END AS longitude, {SPECIES},
        'first ' || c_name || '; second ' || c_name AS reference, 'doi:' || key AS doi,
        CAST(year(DATE '2000-01-01' + CAST(key % 3000 AS INT)) AS BIGINT) AS contr_year, 'link/' || key AS url
    FROM studies WHERE code IS NOT NULL""",
)
query(
    "catalogue_filter",
    "studies",
    f"""SELECT lower(code) AS rwl, country, lat AS latitude, lon AS longitude, {SPECIES} FROM studies
    WHERE key % 6 <> 0 AND location LIKE '%Continent>Europe%' AND country <> 'Russia' AND first_year <= 2026
        AND last_year BETWEEN 1900 AND 2026 AND code IS NOT NULL""",
)
_FILE = """CAST(key AS VARCHAR) AS NOAAStudyId, 'c' || key || '.rwl' AS linkText, 'file:c' || key || '.rwl' AS fileUrl,
    CAST(first_year AS BIGINT) AS first_year, 'physical property>width>total ring width' AS cvWhat, 'mm' AS cvUnit"""
query("raw_file_list", "studies", f"SELECT {_FILE} FROM studies WHERE key % 4 <> 0")
query(
    "usable_files",
    "studies",
    f"SELECT DISTINCT {_FILE}, 'Good' AS status FROM studies WHERE key % 4 <> 0 AND key % 13 <> 0",
)
query(
    "catalogue_variant",
    "studies",
    """SELECT CAST(key AS VARCHAR) AS NOAAStudyId, number || '-' || key AS NOAASiteId, c_name || CASE WHEN key % 6 = 0 THEN ' - other' ELSE ' - ITRDB' END AS studyName,
        CAST(key AS BIGINT) AS note, CAST(key % 4 <> 0 AND (number = 2 OR key % 6 NOT IN (1, 2, 3, 4)) AS BIGINT) AS n_files FROM studies""",
)
view("rings3", "ring_width", "SELECT rwl, tree, year, round(width, 3) AS width FROM ring_width")
_DECIMALS = "length(rtrim(split_part(CAST(CAST(width AS DECIMAL(38, 9)) AS VARCHAR), '.', 2), '0'))"
view(
    "precision",
    "rings3",
    f"""SELECT rwl, CASE WHEN arg_min(nd, tree) < 3 THEN 100 ELSE 1000 END AS per_mm FROM (
    SELECT rwl, tree, max({_DECIMALS}) AS nd FROM rings3 GROUP BY rwl, tree) GROUP BY rwl""",
)
query("site_precision", "precision", f"SELECT {out('rwl', 'per_mm')} FROM precision")
query(
    "ring_text_round_trip",
    "rings3 precision",
    """SELECT rwl, tree, CAST(year AS BIGINT) AS year, round(round(width * per_mm) / per_mm, 6) AS width
    FROM rings3 JOIN precision USING (rwl)""",
)
view(
    "decades",
    "ring_width",
    "SELECT DISTINCT rwl, tree, CAST(floor(year / 10) AS INT) AS decade FROM ring_width",
)
query(
    "ring_file_status",
    "decades",
    """SELECT rwl, CASE WHEN bad THEN 'Error' ELSE 'Good' END AS status, CASE WHEN bad THEN 0 ELSE n END AS n_data,
        CASE WHEN bad THEN n ELSE 0 END AS n_header, 0::BIGINT AS n_damaged, 0::BIGINT AS n_overlap
    FROM (SELECT rwl, CAST(substr(rwl, 2) AS INT) % 5 = 0 AS bad, count(*) AS n FROM decades GROUP BY rwl)""",
)
query(
    "ring_text_blank_fields",
    "ring_width",
    """SELECT rwl, tree, CAST(year AS BIGINT) AS year, round(round(width * 100) / 100, 6) AS width FROM ring_width
    WHERE year % 7 <> 3""",
)
query(
    "ring_text_damaged_lines",
    "decades",
    """SELECT rwl, CASE WHEN count(*) FILTER (bad) > 0 OR count(*) FILTER (NOT bad) = 0 THEN 'Error' ELSE 'Good' END AS status,
        count(*) FILTER (NOT bad) AS n_data, 3 + count(*) FILTER (bad AND alone) AS n_header,
        count(*) FILTER (bad AND NOT alone) AS n_damaged, 0::BIGINT AS n_overlap
    FROM (SELECT *, bool_and(bad) OVER (PARTITION BY rwl, tree) AS alone FROM
        (SELECT *, CAST(substr(tree, 2) AS INT) % 5 = 0 AND decade % 3 = 0 AS bad FROM decades)) GROUP BY rwl""",
)
query(
    "ring_text_long_variant",
    "ring_width",
    """SELECT rwl, tree, CAST(year - 5000 AS BIGINT) AS year, round(round(width * 100) / 100, 6) AS width FROM ring_width""",
)
query("width_decimals", "rings3", f"SELECT {_DECIMALS} AS n_decimals, count(*) AS n FROM rings3 GROUP BY 1")
query("species_table", "meta", "SELECT species_code, count(*) AS n FROM meta GROUP BY species_code")
query(
    "last_year_range",
    "meta",
    "SELECT CAST(min(last_year) AS BIGINT) AS lowest, CAST(max(last_year) AS BIGINT) AS highest FROM meta",
)
query(
    "filter_counts",
    "meta",
    "SELECT count(*) AS n_before, count(DISTINCT rwl) FILTER (species_code = 'EURO') AS n_after FROM meta",
)
query(
    "path_site_ids",
    "points",
    f"""SELECT rwl, rwl AS site, CAST(1901 + (seq % 1488) // 12 AS VARCHAR) || '_'
        || {_MONTHS!r}[CAST(seq % 1488 % 12 + 1 AS INT)] AS label FROM points""",
)

# ---- final tables ---------------------------------------------------------------------------

query(
    "extended_metadata",
    "meta",
    f"""SELECT {with_meta('rwl con_broad')} FROM meta LEFT JOIN (SELECT substr(r_name, 1, 4) AS species_code,
    CASE WHEN r_regionkey % 2 = 0 THEN 'conifer' ELSE 'broadleaf' END AS con_broad FROM region)
    USING (species_code)""",
)
query(
    "site_growth_data",
    "meta cor_site cv",
    f"""SELECT {with_meta('rwl', '', 'mean_cor mean_pval sd cv')} FROM meta LEFT JOIN cor_site USING (rwl)
    LEFT JOIN cv USING (rwl)""",
)
query(
    "single_site",
    "meta coefs",
    f"SELECT {with_meta(*COEF)} FROM meta LEFT JOIN coefs USING (rwl) WHERE rwl = 's15'",
)
query(
    "widths_dense",
    "ring_width",
    f"""SELECT {out('rwl tree', 'year', 'width')} FROM (SELECT DISTINCT rwl, tree FROM ring_width)
    JOIN (SELECT rwl, unnest(generate_series(min(year), max(year))) AS year FROM ring_width GROUP BY rwl) USING (rwl)
    LEFT JOIN ring_width USING (rwl, tree, year)""",
)
query("site_clim_correlation", "meta coefs", f"SELECT {with_meta(*COEF)} FROM meta LEFT JOIN coefs USING (rwl)")
query("site_spei_correlation", "meta spei", f"SELECT {with_meta(*SPEI)} FROM meta LEFT JOIN spei USING (rwl)")
query(
    "site_year_chronologies",
    "chron meta",
    f"SELECT {with_meta('rwl', 'year samp_depth', 'std')} FROM chron LEFT JOIN meta USING (rwl)",
)
query(
    "site_year_resilience",
    "res_site meta",
    f"""SELECT {with_meta('rwl flag', 'pointer_year ' + RES_WHOLE, RES_REAL)} FROM res_site
    LEFT JOIN meta USING (rwl)""",
)
query(
    "site_month_climate",
    "climate meta",
    f"""SELECT {with_meta('rwl', 'year month', 'pre tmp tmn tmx spei')} FROM climate
    LEFT JOIN meta USING (rwl)""",
)
query(
    "site_growth_trend",
    "site_slopes meta",
    f"""SELECT {with_meta('rwl', 'n_years')}, round(growth_slope, 8) + 0 AS growth_slope FROM site_slopes
    LEFT JOIN meta USING (rwl)""",
)
_TREE = ("rwl tree", "n_years", "res_cor p_val")
query(
    "tree_year_growth",
    "bai_dense ages cor_spearman",
    f"""SELECT {out('rwl tree', 'year n_years first last age rwl_totage', 'bai mean_growth growth_sd ar1 rwl_meanage res_cor p_val')},
    CAST(NULL AS VARCHAR) AS flag FROM bai_dense LEFT JOIN ages USING (rwl, tree) LEFT JOIN cor_spearman USING (rwl, tree)""",
)
query(
    "tree_growth_trend",
    "tree_slopes meta cor_spearman",
    f"""SELECT {with_meta('rwl tree', 'n_years', 'growth_slope res_cor p_val')} FROM tree_slopes
    LEFT JOIN meta USING (rwl) LEFT JOIN cor_spearman USING (rwl, tree)""",
)

# Stored otherwise, the same rows.
for _name, _stored in (("crop_grid", "crop_stored_grid"), ("sample_grid", "sample_stored_grid"), ("climate_samples_long", "climate_series_long")):
    ORACLE[_stored] = ORACLE[_name]

# ---- sources and sinks ----------------------------------------------------------------------

query(
    "ring_files_chosen",
    "rings3 precision meta",
    """SELECT rwl, tree, CAST(year AS BIGINT) AS year, round(round(width * per_mm) / per_mm, 6) AS width
    FROM rings3 JOIN precision USING (rwl) WHERE rwl IN (SELECT rwl FROM meta WHERE species_code = 'EURO')""",
)
query("ring_file_inventory", "ring_width", "SELECT DISTINCT rwl, true AS has_text FROM ring_width")
query(
    "rerun_after_failure",
    "ring_width",
    f"""SELECT {out('rwl tree', 'year n_versions n_rows', 'width')} FROM (SELECT *, 2 AS n_versions, count(*) OVER () AS n_rows FROM ring_width WHERE year >= 1950)""",
)
query(
    "csv_round_trip",
    "ring_width",
    f"""SELECT {out('rwl tree', 'year', 'width')} FROM (SELECT rwl, tree, year, CASE WHEN year % 25 = 0 OR (CAST(substr(tree, 2) AS BIGINT) % 10 = 0 AND year % 20 = 0)
        THEN NULL ELSE width END AS width FROM ring_width)""",
)
query(
    "grid_tables",
    "grid_monthly grid_static",
    f"""SELECT {out('name', 'n row col', 'total')} FROM (
        SELECT variable || ' ' || layer AS name, count(value) AS n, max(row) AS row, max(col) AS col, sum(value) AS total FROM grid_monthly GROUP BY 1
        UNION ALL SELECT layer, count(value), max(row), max(col), sum(value) FROM grid_static GROUP BY 1)""",
)
ORACLE["bucketed_tree_stats"] = ORACLE["tree_stats"]
