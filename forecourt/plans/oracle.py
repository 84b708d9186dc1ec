"""The named queries as plain SQL for an independent engine, to check results against."""

from __future__ import annotations

from forecourt.plans.oracle_linear import linear_oracles

# Quotes from the star schema, cleaned quotes with margins, sold quotes.
QUOTES = """
WITH sim AS (
  SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_type) AS n_sim FROM part),
b AS (
  SELECT l.*, o.o_orderpriority, p.p_brand, p.p_type, p.p_size, sim.n_sim, r.r_name,
    CAST(year(o.o_orderdate) AS INT) AS yr,
    abs(datediff('day', o.o_orderdate, l.l_shipdate)) AS dd,
    4000 - 40*p.p_size + 300*(CAST(year(o.o_orderdate) AS INT)-1995)
      + 7*CAST(l.l_orderkey % 100 AS INT) AS tot,
    CAST(floor(l.l_extendedprice) AS INT) + 10000 AS lp
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey JOIN sim ON sim.p_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
quotes AS MATERIALIZED (
  SELECT ((l_orderkey*8 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey AS quote_id,
    CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE yr END AS year,
    p_brand AS make, p_type AS model,
    CAST(p_size*2500 + l_linenumber*137 + l_partkey % 1000 AS INT) AS mileage,
    CAST(10000 + l_suppkey AS INT) AS location_zip,
    CAST(100 - 3*CAST(round(l_discount*100) AS INT) AS DOUBLE) / CAST(100 AS DOUBLE)
      AS percent_to_market,
    CAST(dd % 520 AS INT) AS market_avg_days_to_sell,
    CAST(n_sim AS INT) AS n_similar_vehicles_listed,
    concat('us/', lower(substr(r_name,1,3))) AS region_short_code,
    lp AS exact_list_price,
    CAST(CASE WHEN l_partkey % 89 = 0 THEN NULL WHEN l_partkey % 83 = 0 THEN 0
      ELSE lp - tot END AS INT) AS wholesale_price,
    CASE WHEN l_orderkey % 101 = 0 THEN NULL
      WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'iOS' ELSE 'web' END AS seller_source,
    CAST(CASE WHEN NOT (l_returnflag='R' AND l_linestatus='F') THEN 0
      WHEN l_partkey % 499 = 0 THEN 150000
      ELSE CAST(floor((tot*58)/CAST(100 AS DOUBLE)) AS INT)
        + CAST((l_partkey*37 + l_suppkey*11) % 4001 AS INT) - 2000 END AS INT) AS expected_margin
  FROM b),
priced AS (
  SELECT *, exact_list_price - wholesale_price AS total_margin,
    CAST(trunc(0.58*(exact_list_price - wholesale_price)) AS INT) AS calculated_margin
  FROM quotes),
margins AS (
  SELECT *, CASE WHEN expected_margin <> 0 THEN expected_margin ELSE calculated_margin END
    AS margin FROM priced)
"""

COMPLETE = (
    "year IS NOT NULL AND make IS NOT NULL AND model IS NOT NULL AND mileage IS NOT NULL "
    "AND location_zip IS NOT NULL AND percent_to_market IS NOT NULL "
    "AND market_avg_days_to_sell IS NOT NULL AND n_similar_vehicles_listed IS NOT NULL "
    "AND region_short_code IS NOT NULL AND seller_source IS NOT NULL"
)
PRICED = (
    "wholesale_price IS NOT NULL AND wholesale_price <> 0 "
    "AND exact_list_price IS NOT NULL AND exact_list_price <> 0"
)
MARGIN_RANGE = "expected_margin BETWEEN -50000 AND 100000"
PERCENT_RANGE = "percent_to_market BETWEEN 0.8 AND 1"
DAYS_RANGE = "market_avg_days_to_sell BETWEEN 1 AND 500"
STAGES = [COMPLETE, PRICED, MARGIN_RANGE, PERCENT_RANGE, DAYS_RANGE]

BASE = f"""{QUOTES},
clean AS MATERIALIZED (SELECT * FROM margins WHERE {" AND ".join(STAGES)}),
sold AS (SELECT * FROM clean WHERE expected_margin <> 0)
"""

RAW_COLUMNS = (
    "quote_id, year, make, model, mileage, location_zip, percent_to_market, "
    "market_avg_days_to_sell, n_similar_vehicles_listed, region_short_code, exact_list_price, "
    "wholesale_price, seller_source, expected_margin"
)


def bucket(key: str, n: int, stream: int = 0) -> str:
    """The hash bucket of a key, as in functions.columns.key_bucket."""
    multiplier = (48271, 69621, 39373)[stream]
    return f"CAST(((({key} % 2147483647) * {multiplier}) % 2147483647) % {n} AS INT)"


SPLIT = f"CASE WHEN {bucket('quote_id', 100)} < 70 THEN 'train' ELSE 'test' END"
FOLD = bucket("quote_id", 3, 1)
INNER = bucket("quote_id", 3, 2)


def log10(col: str) -> str:
    return f"CASE WHEN {col} > 0 THEN log10({col}) END"


LOGS = (
    f"round({log10('market_avg_days_to_sell')}, 6) AS market_avg_days_to_sell, "
    f"round({log10('n_similar_vehicles_listed')}, 6) AS n_similar_vehicles_listed"
)
FEATURES_LOG = f"year, mileage, {LOGS}, expected_margin"
FEATURES_RAW = (
    "year, mileage, market_avg_days_to_sell, n_similar_vehicles_listed, expected_margin AS label"
)

PNL = """
SELECT CAST(sum(expected_margin) FILTER (expected_margin < 0) AS BIGINT) AS total_loss,
  CAST(sum(expected_margin) FILTER (expected_margin > 0) AS BIGINT) AS total_gain,
  CAST(sum(expected_margin) AS BIGINT) AS total_profit,
  CAST(sum(margin) - sum(expected_margin) AS BIGINT) AS total_profit_lost,
  count(*) FILTER (expected_margin <> 0) AS num_sellers, count(*) AS num_inquiries,
  round(count(*) FILTER (expected_margin <> 0) / CAST(NULLIF(count(*), 0) AS DOUBLE), 6)
    AS conversion_rate
FROM clean"""

SUMMARY = """
SELECT CAST(trunc(avg(expected_margin)) AS INT) AS average_em,
  CAST(trunc(avg(total_margin)) AS INT) AS average_tm,
  CAST(sum(expected_margin) AS BIGINT) AS sum_em, CAST(sum(total_margin) AS BIGINT) AS sum_tm,
  round(avg(expected_margin) / NULLIF(avg(total_margin), 0), 6) AS em_div_tm
FROM sold"""

PCT = "avg(expected_margin) / NULLIF(avg(total_margin), 0)"


def rmse(actual: str, predicted: str, places: int = 6) -> str:
    return f"round(sqrt(avg(power(CAST({actual} AS DOUBLE) - {predicted}, 2))), {places}) AS rmse"


def group_stat(table: str, by: str, values: list[str], stat: str = "avg", expr: str = "") -> str:
    def one(v: str) -> str:
        body = f"round(avg({v}), 6)" if stat == "avg" else f"CAST(sum({v}) AS BIGINT)"
        return f"{body} AS {stat}_{v}"

    level = expr or by
    cols = ", ".join(one(v) for v in values)
    return f"SELECT {level} AS {by}, {cols}, count(*) AS n FROM {table} GROUP BY 1"


def histogram(table: str, col: str, bins: int = 20) -> str:
    return f"""
SELECT CAST(k.bin AS INT) AS bin, round(e.lo + k.bin * e.w, 6) AS lo,
  round(CASE WHEN k.bin = {bins - 1} THEN e.hi ELSE e.lo + (k.bin + 1) * e.w END, 6) AS hi,
  CAST(count(t.x) AS BIGINT) AS n
FROM range({bins}) k(bin)
CROSS JOIN (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi,
  (CAST(max({col}) AS DOUBLE) - CAST(min({col}) AS DOUBLE)) / {bins} AS w FROM {table}) e
LEFT JOIN (SELECT CAST({col} AS DOUBLE) AS x FROM {table}) t
  ON least(floor((t.x - e.lo) / e.w), {bins - 1}) = k.bin
GROUP BY k.bin, e.lo, e.hi, e.w"""


def box(table: str, by: str, col: str) -> str:
    return f"""
SELECT t.{by}, count(*) AS n, any_value(q.q1) AS q1, any_value(q.median) AS median,
  any_value(q.q3) AS q3,
  min(t.{col}) FILTER (t.{col} BETWEEN q.lo AND q.hi) AS whisker_low,
  max(t.{col}) FILTER (t.{col} BETWEEN q.lo AND q.hi) AS whisker_high,
  CAST(count(*) FILTER (NOT t.{col} BETWEEN q.lo AND q.hi) AS BIGINT) AS n_outliers
FROM {table} t JOIN (SELECT *, q1 - 1.5*(q3 - q1) AS lo, q3 + 1.5*(q3 - q1) AS hi FROM (
  SELECT {by}, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median,
    quantile_cont({col}, 0.75) AS q3 FROM {table} GROUP BY {by})) q USING ({by})
GROUP BY t.{by}"""


def points(table: str, x: str, y: str, x_step: str, y_step: str) -> str:
    return f"""
SELECT CAST(floor(CAST({x} AS DOUBLE) / {x_step}) AS BIGINT) AS x_cell,
  CAST(floor(CAST({y} AS DOUBLE) / {y_step}) AS BIGINT) AS y_cell, count(*) AS n
FROM {table} GROUP BY 1, 2"""


def loess(table: str, x: str, y: str, span: float = 0.3, grid: int = 50) -> str:
    return f""",
p AS (SELECT CAST({x} AS DOUBLE) AS x, count(*) AS n, CAST(sum({y}) AS DOUBLE) AS sy
  FROM {table} GROUP BY 1),
e AS (SELECT min(x) AS lo, max(x) AS hi, sum(n) AS total FROM p),
g AS (SELECT k.i, e.lo + k.i * ((e.hi - e.lo) / {grid - 1}) AS g, e.total, e.hi - e.lo AS w
  FROM range({grid}) k(i), e),
a AS (SELECT g.i, g.g, g.total, g.w, p.n, p.sy, p.x - g.g AS u, abs(p.x - g.g) AS d FROM g, p),
near AS (SELECT i, min(d) AS h FROM (
    SELECT i, d, total, sum(n) OVER (PARTITION BY i ORDER BY d) AS upto FROM a)
  WHERE upto >= ceil({span} * total) GROUP BY i),
k AS (SELECT a.*, power(1 - power(a.d / (near.h + a.w * 1e-9), 3), 3) AS wt
  FROM a JOIN near USING (i) WHERE a.d <= near.h),
s AS (SELECT i, g, sum(wt*n) AS w0, sum(wt*n*u) AS w1, sum(wt*n*u*u) AS w2,
  sum(wt*sy) AS y0, sum(wt*sy*u) AS y1 FROM k GROUP BY i, g)
SELECT CAST(i AS INT) AS i, round(g, 6) AS x,
  round(CASE WHEN w0*w2 - w1*w1 > 1e-9*w0*w2 THEN (w2*y0 - w1*y1) / (w0*w2 - w1*w1)
    ELSE y0 / w0 END, 6) AS smoothed
FROM s"""


def skew(col: str) -> str:
    """Population skewness from central moments."""
    m = f"(SELECT avg({col}) FROM sold)"
    return (
        f"(SELECT avg(power({col} - {m}, 3)) / NULLIF(power(avg(power({col} - {m}, 2)), 1.5), 0) "
        "FROM sold)"
    )


NUMERICS = ["year", "mileage", "market_avg_days_to_sell", "n_similar_vehicles_listed"]
REGIONS = ["us/afr", "us/ame", "us/asi", "us/eur"]
DUMMY = {f"region_{r}": f"CASE WHEN region_short_code = '{r}' THEN 1 ELSE 0 END" for r in REGIONS}
LOGGED = {
    "year": "year",
    "mileage": "mileage",
    "market_avg_days_to_sell": log10("market_avg_days_to_sell"),
    "n_similar_vehicles_listed": log10("n_similar_vehicles_listed"),
}
FEATURE_EXPRS = {**LOGGED, **DUMMY}


def corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / NULLIF(stddev_pop({x}) * stddev_pop({y}), 0)"


def _correlation_matrix() -> str:
    cols = {**LOGGED, "expected_margin": "expected_margin"}
    cols |= {f"region_short_code_{r}": e for r, e in zip(REGIONS, DUMMY.values())}
    wide = ", ".join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in cols.items())
    rows = " UNION ALL ".join(
        f"""SELECT '{a}' AS i, '{b}' AS j, round({corr(f'"{a}"', f'"{b}"')}, 6) AS r FROM w"""
        for a in cols
        for b in cols
    )
    return f", w AS (SELECT {wide} FROM sold) {rows}"


def _correlation_matrix_make() -> str:
    """Correlations of the numerics, the label, and the dummies of region and make, from values in a list."""
    cols = {**LOGGED, "expected_margin": "expected_margin"}
    cols |= {f"region_short_code_{r}": e for r, e in zip(REGIONS, DUMMY.values())}
    cols |= {f"make_Brand#{k}": f"CASE WHEN make = 'Brand#{k}' THEN 1 ELSE 0 END" for k in range(1, 26)}
    values = ", ".join(f"CAST({e} AS DOUBLE)" for e in cols.values())
    names = ", ".join(f"'{n}'" for n in cols)
    return f""", w AS (SELECT [{values}] AS v, [{names}] AS name FROM sold),
base AS (SELECT 'make_' || make AS b FROM sold GROUP BY make ORDER BY count(*), make DESC LIMIT 1),
m AS (SELECT any_value(name[i]) AS i, any_value(name[j]) AS j, round({corr("v[i]", "v[j]")}, 6) AS r
  FROM w, range(1, {len(cols) + 1}) a(i), range(1, {len(cols) + 1}) b(j) GROUP BY a.i, b.j)
SELECT i, j, r FROM m, base WHERE i <> b AND j <> b"""


METRICS = """count(*) AS num_inquiries, count(*) FILTER (expected_margin <> 0) AS num_sold,
  round(count(*) FILTER (expected_margin <> 0) / CAST(count(*) AS DOUBLE), 6) AS conversion_rate,
  round(avg(expected_margin) FILTER (expected_margin <> 0), 6) AS avg_margin,
  CAST(sum(expected_margin) FILTER (expected_margin <> 0) AS BIGINT) AS total_margin_earned"""


def best_in_zip(metric: str) -> str:
    return f"""
SELECT location_zip, make, model, {metric}, num_inquiries FROM (
  SELECT location_zip, make, model, {METRICS} FROM clean GROUP BY 1, 2, 3)
WHERE {metric} IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY location_zip ORDER BY {metric} DESC, make, model) = 1"""


CHECKS = {
    "year": "year BETWEEN 1900 AND 2100",
    "make": "length(trim(make)) > 0",
    "model": "length(trim(model)) > 0",
    "mileage": "mileage >= 0",
    "location_zip": "location_zip BETWEEN 1 AND 99999",
    "market_avg_days_to_sell": "market_avg_days_to_sell BETWEEN 1 AND 500",
    "n_similar_vehicles_listed": "n_similar_vehicles_listed >= 0",
    "region_short_code": "regexp_matches(region_short_code, '^[a-z]{2}/[a-z]{3}$')",
    "exact_list_price": "exact_list_price > 0",
    "wholesale_price": "wholesale_price > 0",
    "seller_source": "seller_source IN ('web', 'iOS')",
    "expected_margin": "expected_margin BETWEEN -50000 AND 100000",
}


def _clean_oracles() -> dict[str, str]:
    """Queries whose SQL starts from BASE."""
    seg = "make = 'Brand#8' AND model = 'PROMO'"
    makes = ", ".join(f"'Brand#{i}'" for i in (1, 2, 3, 5, 8, 13, 21))
    out: dict[str, str] = {}
    out["source_profile"] = (
        "SELECT count(*) AS n_rows, count(DISTINCT quote_id) AS n_keys, CAST(14 AS INT) AS n_columns"
        " FROM quotes"
    )
    out["csv_quotes_inferred"] = out["source_profile"]
    out["preview_quotes"] = f"SELECT {RAW_COLUMNS} FROM quotes ORDER BY quote_id LIMIT 5"
    out["csv_quotes"] = f"SELECT {RAW_COLUMNS} FROM quotes"
    out["registered_view"] = (
        "SELECT make, count(*) AS n, CAST(sum(margin) AS BIGINT) AS margin FROM clean GROUP BY make"
    )
    out["materialized_pnl"] = PNL
    stages = ["drop_incomplete", "drop_missing_prices", "clip_margin"]
    stages += ["clip_percent_to_market", "clip_days_to_sell"]
    for name, cond in zip(stages, STAGES):
        out[name] = f"SELECT {RAW_COLUMNS} FROM quotes WHERE {cond}"
    out["clean_quotes"] = f"SELECT {RAW_COLUMNS} FROM clean"
    steps = ["raw", "complete", "priced", "margin_in_range", "percent_in_range", "days_in_range"]
    out["cleaning_funnel"] = " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS step, '{s}' AS stage, count(*) AS n_rows FROM quotes "
        f"WHERE {' AND '.join(['true', *STAGES[:i]])}"
        for i, s in enumerate(steps)
    )
    for col in ("total_margin", "calculated_margin"):
        out[col] = f"SELECT quote_id, {col} FROM margins"
    out["imputed_margin"] = "SELECT quote_id, margin FROM margins"
    out["sold_quotes"] = "SELECT * FROM sold"
    out["segment_make_model"] = f"SELECT * FROM clean WHERE {seg}"
    out["segment_make"] = "SELECT * FROM clean WHERE make = 'Brand#8'"
    out["segment_in_makes"] = f"SELECT * FROM clean WHERE make IN ({makes})"
    out["drop_columns"] = (
        "SELECT * EXCLUDE (region_short_code, seller_source, location_zip) FROM clean"
    )

    out["pnl"] = PNL
    out["margin_summary"] = SUMMARY
    out["summary_sheet"] = f"SELECT * FROM ({PNL}) CROSS JOIN ({SUMMARY})"
    out["pct_to_market_fit"] = f"SELECT count(*) AS n_sold, round({PCT}, 6) AS pct FROM sold"
    out["pct_to_market_fit_by_make"] = (
        f"SELECT make, count(*) AS n_sold, round({PCT}, 6) AS pct FROM sold GROUP BY make"
    )
    out["pct_to_market_fit_by_segment"] = (
        "SELECT make, model, year, region_short_code, count(*) AS n_sold, "
        f"round({PCT}, 6) AS pct FROM sold GROUP BY 1, 2, 3, 4"
    )
    applied = "CAST(trunc(f.pct * total_margin) AS INT)"
    out["pct_to_market_applied"] = (
        f"SELECT count(*) AS n, {rmse('expected_margin', applied, 4)} FROM sold, "
        f"(SELECT {PCT} AS pct FROM sold) f"
    )
    out["pct_to_market_applied_by_make"] = (
        f"SELECT count(*) AS n, {rmse('expected_margin', applied, 4)} FROM sold JOIN "
        f"(SELECT make, {PCT} AS pct FROM sold GROUP BY make) f USING (make)"
    )
    out["pmm_rmse"] = f"SELECT count(*) AS n, {rmse('expected_margin', 'calculated_margin')} FROM sold"
    out["pmm_68_segment_rmse"] = (
        "SELECT count(*) AS n, "
        f"{rmse('expected_margin', 'CAST(trunc(0.68*total_margin) AS INT)')} FROM sold WHERE {seg}"
    )
    out["pmm_score"] = "SELECT quote_id, calculated_margin AS prediction FROM clean"

    none = "HAVING count(*) FILTER (expected_margin <> 0) = 0"
    out["makes_without_sale"] = f"SELECT make, count(*) AS num_inquiries FROM clean GROUP BY 1 {none}"
    out["cohorts_without_sale"] = (
        "SELECT make, model, location_zip, count(*) AS num_inquiries FROM clean "
        f"GROUP BY 1, 2, 3 {none}"
    )
    out["count_by_make"] = "SELECT make, count(*) AS num FROM sold GROUP BY make"
    out["count_by_make_model"] = (
        "SELECT make || '_' || model AS make_model, count(*) AS num FROM sold GROUP BY 1"
    )
    out["skewness"] = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round({skew(c)}, 6) AS skewness, abs({skew(c)}) > 0.5 AS is_skewed"
        for c in [*NUMERICS, "expected_margin"]
    )
    out["correlation_with_margin"] = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round({corr(f'CAST({e} AS DOUBLE)', 'expected_margin')}, 6) AS r "
        "FROM sold"
        for n, e in FEATURE_EXPRS.items()
    )
    out["correlation_matrix"] = _correlation_matrix()

    em, cm, tm = "expected_margin", "calculated_margin", "total_margin"
    days, similar = "market_avg_days_to_sell", "n_similar_vehicles_listed"
    miles = "CAST(floor(mileage / 5000.0) * 5000 AS INT)"
    out["chart_expected_margin_histogram"] = histogram("sold", em)
    out["chart_calculated_margin_histogram"] = histogram("clean", cm)
    out["chart_margins_by_make"] = group_stat("sold", "make", [em, tm])
    out["chart_calculated_margin_by_make"] = group_stat("clean", "make", [cm])
    out["chart_calculated_margin_box_by_make"] = box("clean", "make", cm)
    out["chart_total_margins_by_make"] = group_stat("clean", "make", [em, cm], "sum")
    out["chart_top_makes"] = (
        "SELECT make, CAST(sum(calculated_margin) AS BIGINT) AS sum_calculated_margin FROM clean "
        "GROUP BY make ORDER BY 2 DESC, 1 LIMIT 3"
    )
    out["chart_percent_to_market_histogram"] = histogram("clean", "percent_to_market")
    out["chart_percent_calculated_points"] = points("clean", "percent_to_market", cm, "0.01e0", "250e0")
    out["chart_percent_calculated_loess"] = loess("clean", "percent_to_market", cm)
    out["chart_percent_expected_points"] = points("sold", "percent_to_market", em, "0.01e0", "250e0")
    out["chart_percent_expected_loess"] = loess("sold", "percent_to_market", em)
    out["chart_calculated_margin_by_region"] = group_stat("clean", "region_short_code", [cm])
    out["chart_expected_margin_by_region"] = group_stat("sold", "region_short_code", [em])
    out["chart_total_expected_margin_by_source"] = group_stat("sold", "seller_source", [em], "sum")
    out["chart_expected_margin_by_source"] = group_stat("sold", "seller_source", [em])
    out["percent_box_by_make"] = box("clean", "make", "percent_to_market")
    out["profit_box_by_region"] = box(
        "(SELECT *, CAST(total_margin AS BIGINT) * 10000000000 AS big FROM clean)", "region_short_code", "big"
    )
    out["one_hot_zip_totals"] = (
        "SELECT 'zip_' || location_zip AS feature, count(*) AS n FROM sold GROUP BY location_zip "
        "QUALIFY row_number() OVER (ORDER BY count(*), location_zip DESC) > 1"
    )
    key = "make || '_' || model"
    dummies = "QUALIFY row_number() OVER (ORDER BY count(*), v DESC) > 1"
    out["one_hot_make_model_totals"] = f"SELECT 'make_model_' || v AS feature, count(*) AS n FROM (SELECT {key} AS v FROM sold) GROUP BY v {dummies}"
    for name, value, prefix in (("zip", "location_zip", "zip_"), ("make_model", key, "make_model_")):
        r = corr("CASE WHEN s.v = l.v THEN 1.0e0 ELSE 0 END", "s.em")
        out[f"correlation_with_margin_by_{name}"] = f""",
s AS (SELECT {value} AS v, CAST(expected_margin AS DOUBLE) AS em FROM sold),
l AS (SELECT v FROM s GROUP BY v {dummies})
SELECT '{prefix}' || l.v AS feature, round({r}, 6) AS r FROM s, l GROUP BY l.v"""
    out["correlation_matrix_make"] = _correlation_matrix_make()
    out["margin_box_by_make_sketched"] = (
        "SELECT make, count(calculated_margin) AS n, true AS within FROM clean GROUP BY make"
    )
    out["kmeans_settled"] = (
        "SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS n_astray, "
        "CAST(0 AS BIGINT) AS n_off_centre FROM sold"
    )
    raw = ["year", "mileage", "market_avg_days_to_sell", "n_similar_vehicles_listed"]
    cells = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, {corr(f'CAST({a} AS DOUBLE)', f'CAST({b} AS DOUBLE)')} AS r FROM sold"
        for i, a in enumerate(raw)
        for j, b in enumerate(raw)
    )
    # The sums of the powers of a matrix's eigenvalues are the traces of its powers.
    out["pca_projection"] = f""",
m AS MATERIALIZED ({cells}),
m2 AS (SELECT a.i, b.j, sum(a.r * b.r) AS r FROM m a JOIN m b ON a.j = b.i GROUP BY 1, 2),
m3 AS (SELECT a.i, b.j, sum(a.r * b.r) AS r FROM m2 a JOIN m b ON a.j = b.i GROUP BY 1, 2),
m4 AS (SELECT a.i, b.j, sum(a.r * b.r) AS r FROM m3 a JOIN m b ON a.j = b.i GROUP BY 1, 2)
SELECT CAST(0 AS INT) AS power, CAST(0 AS DOUBLE) AS total
""" + "".join(
        f" UNION ALL SELECT {k}, round(sum(r), 4) FROM {t} WHERE i = j" for k, t in ((1, "m"), (2, "m2"), (3, "m3"), (4, "m4"))
    )
    few = ", ".join(f"'Brand#{i}'" for i in (1, 2, 3, 5, 8, 13, 21))
    out["unseen_levels"] = (
        "SELECT 'make' AS feature, count(*) FILTER (make IS NULL) AS n_null, "
        f"count(*) FILTER (make NOT IN ({few})) AS n_unseen FROM sold UNION ALL "
        "SELECT 'region_short_code', 0, 0"
    )
    for name in ("kmeans_totals", "gaussian_mixture_totals"):
        out[name] = "SELECT count(*) AS n, round(avg(expected_margin), 4) AS avg_label FROM sold"
    out["forest_importance_total"] = (
        "SELECT 4 + count(DISTINCT region_short_code) - 1 AS n_features, CAST(1 AS DOUBLE) AS total FROM sold"
    )
    out["chart_calculated_margin_box_by_region"] = box("clean", "region_short_code", cm)
    out["chart_days_to_sell_histogram"] = histogram("clean", days)
    out["chart_expected_margin_by_days"] = group_stat("sold", days, [em])
    out["chart_calculated_margin_by_days"] = group_stat("clean", days, [cm])
    out["chart_mileage_histogram"] = histogram("clean", "mileage")
    out["chart_expected_margin_by_year"] = group_stat("sold", "year", [em])
    out["chart_calculated_margin_by_year"] = group_stat("clean", "year", [cm])
    out["chart_share_by_year"] = (
        "SELECT year, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM clean) AS DOUBLE), 6)"
        " AS fraction FROM clean GROUP BY year"
    )
    out["chart_expected_margin_by_mileage"] = group_stat("sold", "mileage", [em], expr=miles)
    out["chart_calculated_margin_by_mileage"] = group_stat("clean", "mileage", [cm], expr=miles)
    out["chart_expected_margin_by_similar"] = group_stat("sold", similar, [em])
    out["chart_calculated_margin_by_similar"] = group_stat("clean", similar, [cm])
    out["sorted_margin_by_make"] = group_stat("sold", "make", ["margin"])

    out["log10_features"] = f"SELECT quote_id, {LOGS} FROM sold"
    out["auto_log"] = "SELECT quote_id, " + ", ".join(
        f"round(CASE WHEN abs({skew(c)}) > 0.5 THEN {log10(c)} ELSE CAST({c} AS DOUBLE) END, 6) AS {c}"
        for c in NUMERICS
    ) + " FROM sold"
    out["feature_set_make"] = f"SELECT quote_id, region_short_code, make, {FEATURES_LOG} FROM sold"
    out["feature_set_segment"] = (
        f"SELECT quote_id, region_short_code, {FEATURES_LOG} FROM sold WHERE {seg}"
    )
    out["feature_set_make_raw"] = (
        f"SELECT quote_id, region_short_code, make, {FEATURES_RAW} FROM sold"
    )
    out["feature_set_segment_raw"] = (
        f"SELECT quote_id, region_short_code, {FEATURES_RAW} FROM sold WHERE {seg}"
    )
    out["feature_set_wide"] = (
        "SELECT quote_id, region_short_code, location_zip, seller_source, make, "
        f"make || '_' || model AS make_model, {FEATURES_LOG} FROM sold"
    )
    out["one_hot_region"] = "SELECT quote_id, " + ", ".join(
        f'CAST({e} AS INT) AS "{n}"' for n, e in DUMMY.items()
    ) + " FROM sold"
    out["one_hot_make"] = "SELECT quote_id, " + ", ".join(
        f"CAST(CASE WHEN make = 'Brand#{i}' THEN 1 ELSE 0 END AS INT) AS \"make_Brand#{i}\""
        for i in range(2, 26)
    ) + " FROM sold"
    out["one_hot_source"] = (
        "SELECT quote_id, CAST(CASE WHEN seller_source = 'web' THEN 1 ELSE 0 END AS INT) "
        "AS seller_web FROM sold"
    )
    scaled = ", ".join(
        f"round((x.{c} - s.{c}_m) / NULLIF(s.{c}_s, 0), 6) AS {c}" for c in NUMERICS
    )
    moments = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in NUMERICS)
    logged = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in LOGGED.items())
    out["standardized"] = f""",
x AS (SELECT quote_id, expected_margin, {SPLIT} AS split, {logged} FROM sold),
s AS (SELECT {moments} FROM x WHERE split = 'train')
SELECT x.quote_id, {scaled}, x.expected_margin, x.split FROM x, s"""
    out["hash_split"] = (
        f"SELECT {SPLIT} AS split, {FOLD} AS fold, count(*) AS n, "
        "CAST(sum(expected_margin) AS BIGINT) AS margin FROM sold GROUP BY 1, 2"
    )
    levels = (
        "SELECT region_short_code AS level, CAST(row_number() OVER "
        "(ORDER BY count(*) DESC, region_short_code) - 1 AS INT) AS idx, "
        f"CAST(count(*) OVER () - 1 AS INT) AS last FROM sold WHERE {SPLIT} = 'train' GROUP BY 1"
    )
    out["string_index"] = (
        f"SELECT level, idx, CASE WHEN idx < last THEN idx END AS slot FROM ({levels})"
    )
    out["scaler_deviation"] = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(stddev_samp({c}), 6) AS std FROM sold WHERE {SPLIT} = 'train'"
        for c in NUMERICS
    )
    slots = " UNION ALL ".join(
        f"SELECT {i} AS pos, avg({c}) / stddev_samp({c}) AS v FROM t" for i, c in enumerate(NUMERICS)
    )
    out["assembled_features"] = f""",
t AS (SELECT * FROM sold WHERE {SPLIT} = 'train'), lv AS ({levels})
SELECT idx AS slot, round((SELECT count(*) FROM t WHERE region_short_code = level)
    / CAST((SELECT count(*) FROM t) AS DOUBLE), 6) AS avg_value, (SELECT count(*) FROM t) AS n
FROM lv WHERE idx < last
UNION ALL
SELECT CAST(pos + (SELECT max(idx) FROM lv) AS INT), round(v, 6), (SELECT count(*) FROM t)
FROM ({slots})"""

    err = "CAST(expected_margin AS DOUBLE) - calculated_margin"
    out["pmm_evaluation"] = (
        f"SELECT count(*) AS n, {rmse('expected_margin', 'calculated_margin', 4)}, "
        f"round(1 - avg(power({err}, 2)) / var_pop(expected_margin), 4) AS r2 FROM sold"
    )
    out["pmm_fold_rmse"] = (
        "SELECT CAST(count(*) AS INT) AS folds, round(avg(e), 4) AS cv_rmse FROM "
        f"(SELECT sqrt(avg(power({err}, 2))) AS e FROM sold GROUP BY {FOLD})"
    )
    out["pmm_residuals"] = "SELECT quote_id, expected_margin - calculated_margin AS residual FROM sold"
    out["pmm_residual_summary"] = (
        f"SELECT count(*) AS n, round(avg({err}), 4) AS mean, round(stddev_pop({err}), 4) AS std, "
        "min(expected_margin - calculated_margin) AS lowest, "
        "max(expected_margin - calculated_margin) AS highest FROM sold"
    )
    out["pmm_actual_points"] = points("sold", em, cm, "250e0", "250e0")
    out["pmm_actual_line"] = (
        "SELECT count(*) AS n, round(regr_slope(calculated_margin, expected_margin), 6) AS slope, "
        "round(regr_intercept(calculated_margin, expected_margin), 6) AS intercept FROM sold"
    )

    out["cohort_table"] = f"SELECT location_zip, make, model, {METRICS} FROM clean GROUP BY 1, 2, 3"
    out["cohort_rollup"] = (
        "SELECT region_short_code, make, model, CAST(grouping(region_short_code) + grouping(make) "
        f"+ grouping(model) AS INT) AS level, {METRICS} FROM clean "
        "GROUP BY ROLLUP (region_short_code, make, model)"
    )
    out["best_margin_by_zip"] = best_in_zip("avg_margin")
    out["best_conversion_by_zip"] = best_in_zip("conversion_rate")
    arms = "CASE location_zip % 3 WHEN 0 THEN 0.58 WHEN 1 THEN 0.62 ELSE 0.68 END"
    out["price_test"] = (
        f"SELECT CAST(location_zip % 3 AS INT) AS arm, {METRICS}, "
        f"CAST(sum(CAST(trunc({arms} * total_margin) AS INT)) FILTER (expected_margin = 0) AS BIGINT) "
        "AS total_profit_lost, round(avg(market_avg_days_to_sell), 6) AS avg_days_to_sell "
        "FROM clean GROUP BY 1"
    )
    cols = "quote_id, region_short_code, make, model, calculated_margin"
    out["outreach_top"] = (
        f"SELECT {cols} FROM clean WHERE expected_margin = 0 "
        "ORDER BY calculated_margin DESC, quote_id LIMIT 100"
    )
    out["outreach_by_region"] = (
        f"SELECT {cols}, CAST(row_number() OVER (PARTITION BY region_short_code "
        "ORDER BY calculated_margin DESC, quote_id) AS INT) AS rank "
        "FROM clean WHERE expected_margin = 0 QUALIFY rank <= 20"
    )
    out["market_price_gap"] = """
SELECT quote_id, round(mp, 6) AS market_price, round(exact_list_price - mp, 6) AS price_gap,
  CASE WHEN exact_list_price - mp < -0.1e0 * mp THEN 'under'
    WHEN exact_list_price - mp > 0.1e0 * mp THEN 'over' ELSE 'at' END AS position
FROM (SELECT *, exact_list_price / percent_to_market AS mp FROM clean)"""

    out["validation"] = " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (NOT coalesce({ok}, false)) AS violations FROM quotes"
        for n, ok in CHECKS.items()
    )
    out["duplicate_cars"] = (
        "SELECT make, model, year, location_zip, count(*) AS n FROM quotes GROUP BY ALL HAVING count(*) > 1"
    )
    out["duplicate_quotes"] = (
        "SELECT quote_id, count(*) AS n FROM quotes GROUP BY 1 HAVING count(*) > 1"
    )
    known = "SELECT * FROM quotes WHERE market_avg_days_to_sell <> 0"
    med = "quantile_cont(market_avg_days_to_sell, 0.5) AS m"
    out["days_imputed"] = f""",
k AS ({known}),
m3 AS (SELECT make, model, year, {med} FROM k GROUP BY ALL),
m2 AS (SELECT make, model, {med} FROM k GROUP BY ALL),
m1 AS (SELECT make, {med} FROM k GROUP BY ALL)
SELECT q.quote_id, CAST(CASE WHEN q.market_avg_days_to_sell = 0
  THEN ceil(coalesce(m3.m, m2.m, m1.m, (SELECT {med} FROM k)))
  ELSE q.market_avg_days_to_sell END AS INT) AS imputed_days
FROM quotes q
LEFT JOIN m3 ON q.make = m3.make AND q.model = m3.model AND q.year IS NOT DISTINCT FROM m3.year
LEFT JOIN m2 ON q.make = m2.make AND q.model = m2.model
LEFT JOIN m1 ON q.make = m1.make"""
    fences = (
        "quantile_cont(expected_margin, 0.25) AS q1, quantile_cont(expected_margin, 0.75) AS q3"
    )
    inside = "expected_margin BETWEEN q1 - 1.5*(q3 - q1) AND q3 + 1.5*(q3 - q1)"
    out["margin_inliers"] = (
        f"SELECT quote_id, expected_margin FROM sold JOIN (SELECT make, {fences} FROM sold "
        f"GROUP BY make) USING (make) WHERE {inside}"
    )
    out["margin_inliers_narrow"] = out["margin_inliers"].replace("1.5*", "0.25*")
    out["margin_outliers"] = (
        f"SELECT quote_id, expected_margin FROM quotes, (SELECT {fences} FROM quotes "
        f"WHERE expected_margin <> 0) WHERE expected_margin <> 0 AND NOT {inside}"
    )
    out["margin_from_nearest"] = """,
donor AS (SELECT calculated_margin AS s, arg_min(expected_margin, quote_id) AS m
  FROM sold GROUP BY 1),
lo AS (SELECT c.quote_id, c.calculated_margin AS s, d.s AS ls, d.m AS lm FROM clean c
  ASOF LEFT JOIN donor d ON c.calculated_margin >= d.s),
hi AS (SELECT c.quote_id, d.s AS hs, d.m AS hm FROM clean c
  ASOF LEFT JOIN donor d ON c.calculated_margin <= d.s),
ids AS (SELECT quote_id, expected_margin, calculated_margin FROM clean),
lent AS (SELECT DISTINCT lo.s, CASE WHEN ls IS NOT NULL AND (hs IS NULL OR s - ls <= hs - s)
    THEN lm ELSE hm END AS m
  FROM lo JOIN hi USING (quote_id))
SELECT quote_id, CASE WHEN expected_margin <> 0 THEN expected_margin ELSE lent.m END
  AS imputed_margin
FROM ids JOIN lent ON ids.calculated_margin = lent.s"""
    return out


def oracles() -> dict[str, str]:
    """Query name to SQL text."""
    out = {name: BASE + sql for name, sql in _clean_oracles().items()}
    recursive = BASE.replace("WITH sim", "WITH RECURSIVE sim", 1)
    out.update({name: recursive + sql for name, sql in linear_oracles(SPLIT, FOLD, INNER).items()})
    return out
