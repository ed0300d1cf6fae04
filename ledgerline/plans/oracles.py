"""DuckDB oracle SQL for the registered queries (same column names and types)."""

from __future__ import annotations

from ..functions.dates import FEATURES
from ..sources.tables import FOREIGN_KEYS, dirty_sales_oracle_cte
from .common import R, with_sales

ORACLES: dict[str, str] = {}

# ---- star ---------------------------------------------------------------------------------

ORACLES["star_keys"] = "\nUNION ALL\n".join(
    f"""SELECT '{child}.{key}' AS foreign_key, count(*) AS n_rows,
  count(*) FILTER (WHERE {key} IS NULL OR {key} NOT IN (SELECT {target} FROM {parent} WHERE {target} IS NOT NULL)) AS missing,
  (SELECT count({target}) - count(DISTINCT {target}) FROM {parent}) AS repeated FROM {child}"""
    for (child, key), (parent, target) in FOREIGN_KEYS.items()
)

ORACLES["bucketed_monthly_regions"] = with_sales("""
SELECT strftime(date, '%Y-%m') AS month, region, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY ALL""")

# ---- dashboard ----------------------------------------------------------------------------

_KPI = """SELECT COALESCE(CAST(SUM(revenue) AS DOUBLE), 0) AS rev,
                 COALESCE(CAST(SUM(profit) AS DOUBLE), 0) AS prof, COUNT(*) AS n FROM sales"""

_KPI_SELECT = f"""SELECT {R('rev')} AS total_revenue, {R('prof')} AS total_profit, CAST(n AS BIGINT) AS total_orders,
       {R('CASE WHEN n = 0 THEN 0 ELSE rev / n END')} AS average_order_value,
       {R('CASE WHEN rev = 0 THEN 0 ELSE prof * 100 / rev END')} AS profit_margin
FROM ({_KPI}) k"""

ORACLES["kpi_totals"] = with_sales(_KPI_SELECT)

_MONTHLY = """SELECT strftime(date, '%Y-%m') AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM sales WHERE date IS NOT NULL GROUP BY 1"""

ORACLES["monthly_revenue"] = with_sales(_MONTHLY)

ORACLES["yearly_revenue"] = with_sales("""
SELECT CAST(year(date) AS BIGINT) AS year, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM sales WHERE date IS NOT NULL GROUP BY 1""")


def _ranked(direction: str, n: int) -> str:
    return with_sales(f"""
SELECT CAST(product_id AS VARCHAR) AS product, revenue, rank FROM (
  SELECT product_id, CAST(SUM(revenue) AS DOUBLE) AS revenue,
         CAST(row_number() OVER (ORDER BY CAST(SUM(revenue) AS DOUBLE) {direction}, product_id) AS BIGINT) AS rank
  FROM sales WHERE product_id IS NOT NULL GROUP BY product_id) t
WHERE rank <= {n}""")


ORACLES["top_products"] = _ranked("DESC", 10)
ORACLES["low_performers"] = _ranked("ASC", 5)

ORACLES["regional_breakdown"] = with_sales("""
SELECT region, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales WHERE region IS NOT NULL GROUP BY region""")

ORACLES["category_breakdown"] = with_sales("""
SELECT category, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales WHERE category IS NOT NULL GROUP BY category""")

ORACLES["dashboard_bundle"] = with_sales("""
SELECT * FROM (
  SELECT CASE WHEN GROUPING(month) = 0 THEN 'month' WHEN GROUPING(year) = 0 THEN 'year'
              WHEN GROUPING(product) = 0 THEN 'product' WHEN GROUPING(region) = 0 THEN 'region'
              WHEN GROUPING(category) = 0 THEN 'category' ELSE 'total' END AS dim,
         CASE WHEN GROUPING(month) = 0 THEN month WHEN GROUPING(year) = 0 THEN year
              WHEN GROUPING(product) = 0 THEN product WHEN GROUPING(region) = 0 THEN region
              WHEN GROUPING(category) = 0 THEN category END AS key,
         CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(profit) AS DOUBLE) AS profit,
         CAST(COUNT(*) AS BIGINT) AS n_rows
  FROM (SELECT strftime(date, '%Y-%m') AS month, CAST(year(date) AS VARCHAR) AS year,
               CAST(product_id AS VARCHAR) AS product, region, category, revenue, profit FROM sales) p
  GROUP BY GROUPING SETS ((), (month), (year), (product), (region), (category))) g
WHERE dim = 'total' OR key IS NOT NULL""")

ORACLES["sales_filter"] = with_sales("""
SELECT date, product_id, category, region, customer_id, quantity, CAST(revenue AS DOUBLE) AS revenue
FROM sales
WHERE date >= DATE '1997-01-01' AND date <= DATE '1998-12-31'
  AND category IN ('ECONOMY', 'STANDARD', 'SMALL') AND region IN ('ASIA', 'EUROPE')""")

ORACLES["last_12_months"] = with_sales(f"""
SELECT month, revenue FROM ({_MONTHLY}) m ORDER BY month DESC LIMIT 12""")

_GROWTH = f"""SELECT {R('''COALESCE(CASE WHEN n_months >= 2 AND prev <> 0 THEN (curr - prev) / prev * 100 END, 0)''')} AS revenue_growth
FROM (SELECT MAX(CASE WHEN rn = 1 THEN revenue END) AS curr, MAX(CASE WHEN rn = 1 THEN prev END) AS prev,
             COUNT(*) AS n_months
      FROM (SELECT revenue, lag(revenue) OVER (ORDER BY month) AS prev,
                   row_number() OVER (ORDER BY month DESC) AS rn FROM ({_MONTHLY}) m0) m1) m2"""

ORACLES["revenue_growth"] = with_sales(_GROWTH)

ORACLES["report_rows"] = with_sales(f"""
SELECT line, section, label, value FROM (
  SELECT 1::BIGINT AS line, 'kpi' AS section, 'Total Revenue' AS label, total_revenue AS value FROM k
  UNION ALL SELECT 2, 'kpi', 'Total Profit', total_profit FROM k
  UNION ALL SELECT 3, 'kpi', 'Total Orders', CAST(total_orders AS DOUBLE) FROM k
  UNION ALL SELECT 4, 'kpi', 'Average Order Value', average_order_value FROM k
  UNION ALL SELECT 5, 'kpi', 'Profit Margin %', profit_margin FROM k
  UNION ALL SELECT 6, 'kpi', 'Revenue Growth %', revenue_growth FROM g
  UNION ALL SELECT rank + 6, 'top_products', product, revenue FROM tp) u""",
    extra_ctes=f"""k AS ({_KPI_SELECT}),
g AS ({_GROWTH}),
tp AS (SELECT CAST(product_id AS VARCHAR) AS product, revenue, rank FROM (
  SELECT product_id, CAST(SUM(revenue) AS DOUBLE) AS revenue,
         row_number() OVER (ORDER BY CAST(SUM(revenue) AS DOUBLE) DESC, product_id) AS rank
  FROM sales GROUP BY product_id) t WHERE rank <= 10)""")

# ---- series ---------------------------------------------------------------------------------

_D0 = "d0 AS (SELECT date AS k, CAST(SUM(revenue) AS DOUBLE) AS y FROM sales WHERE date IS NOT NULL GROUP BY date)"
_DAILY = _D0 + """,
cal AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS k FROM (SELECT MIN(k) AS lo, MAX(k) AS hi FROM d0) b),
daily AS (SELECT cal.k AS ds, COALESCE(d0.y, 0) AS y FROM cal LEFT JOIN d0 ON cal.k = d0.k)"""


def with_daily(body: str, extra: str = "") -> str:
    return with_sales(body, _DAILY + (",\n" + extra if extra else ""))


ORACLES["daily_series"] = with_daily("SELECT ds, y FROM daily")

ORACLES["daily_series_by_region"] = with_sales("""
SELECT cal.region, cal.k AS ds, COALESCE(r0.y, 0) AS y FROM cal LEFT JOIN r0 ON cal.region = r0.region AND cal.k = r0.k""",
    """r0 AS (SELECT region, date AS k, CAST(SUM(revenue) AS DOUBLE) AS y FROM sales
         WHERE date IS NOT NULL AND region IS NOT NULL GROUP BY region, date),
cal AS (SELECT region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS k
        FROM (SELECT region, MIN(k) AS lo, MAX(k) AS hi FROM r0 GROUP BY region) b)""")

_WEEKLY = """w0 AS (SELECT date + (7 - isodow(date))::INTEGER AS k, CAST(SUM(revenue) AS DOUBLE) AS y
         FROM sales WHERE date IS NOT NULL GROUP BY 1),
wcal AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS k FROM (SELECT MIN(k) AS lo, MAX(k) AS hi FROM w0) b),
weekly AS (SELECT wcal.k AS ds, COALESCE(w0.y, 0) AS y FROM wcal LEFT JOIN w0 ON wcal.k = w0.k)"""

_MONTHLY_S = """m0 AS (SELECT CAST(date_trunc('month', date) AS DATE) AS k, CAST(SUM(revenue) AS DOUBLE) AS y
         FROM sales WHERE date IS NOT NULL GROUP BY 1),
mcal AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS k FROM (SELECT MIN(k) AS lo, MAX(k) AS hi FROM m0) b),
monthly AS (SELECT last_day(mcal.k) AS ds, COALESCE(m0.y, 0) AS y FROM mcal LEFT JOIN m0 ON mcal.k = m0.k)"""

ORACLES["weekly_series"] = with_sales("SELECT ds, y FROM weekly", _WEEKLY)
ORACLES["monthly_series"] = with_sales("SELECT ds, y FROM monthly", _MONTHLY_S)


def _cal(ds: str = "ds") -> str:
    return f"""CAST(isodow({ds}) - 1 AS INTEGER) AS day_of_week, CAST(dayofmonth({ds}) AS INTEGER) AS day_of_month,
  CAST(weekofyear({ds}) AS INTEGER) AS week_of_year, CAST(month({ds}) AS INTEGER) AS month,
  CAST(quarter({ds}) AS INTEGER) AS quarter, CAST(year({ds}) AS INTEGER) AS year,
  CAST(isodow({ds}) >= 6 AS INTEGER) AS is_weekend, CAST(dayofmonth({ds}) = 1 AS INTEGER) AS is_month_start,
  CAST({ds} = last_day({ds}) AS INTEGER) AS is_month_end,
  CAST({ds} = CAST(date_trunc('quarter', {ds}) AS DATE) AS INTEGER) AS is_quarter_start,
  CAST(dayofyear({ds}) AS INTEGER) AS day_of_year,
  {R(f'sin(2 * pi() * month({ds}) / 12)', 6)} AS month_sin, {R(f'cos(2 * pi() * month({ds}) / 12)', 6)} AS month_cos,
  {R(f'sin(2 * pi() * (isodow({ds}) - 1) / 7)', 6)} AS dow_sin, {R(f'cos(2 * pi() * (isodow({ds}) - 1) / 7)', 6)} AS dow_cos"""


def _lags() -> str:
    parts = [f"CAST(lag(y, {k}) OVER (ORDER BY ds) AS DOUBLE) AS lag_{k}" for k in (1, 7, 14, 30)]
    for n in (7, 14, 30):
        fr = f"(ORDER BY ds ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        parts.append(f"CASE WHEN count(y) OVER {fr} = {n} THEN {R(f'CAST(sum(y) OVER {fr} AS DOUBLE) / {n}.0', 2)} END AS rolling_mean_{n}")
        parts.append(f"CASE WHEN count(y) OVER {fr} = {n} THEN {R(f'stddev_samp(y) OVER {fr}', 2)} END AS rolling_std_{n}")
    return ",\n  ".join(parts)


ORACLES["calendar_features"] = with_daily(f"SELECT ds, y,\n  {_cal()}\nFROM daily")
_EXACT_DAILY = """e0 AS (SELECT date AS k, SUM(revenue) AS y FROM sales WHERE date IS NOT NULL GROUP BY date),
ecal AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS k FROM (SELECT MIN(k) AS lo, MAX(k) AS hi FROM e0) b),
edaily AS (SELECT ecal.k AS ds, COALESCE(e0.y, 0) AS y FROM ecal LEFT JOIN e0 ON ecal.k = e0.k)"""

ORACLES["lag_features"] = with_sales(f"SELECT ds, CAST(y AS DOUBLE) AS y,\n  {_lags()}\nFROM edaily", _EXACT_DAILY)

_FEATS = ["day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year", "is_weekend",
          "is_month_start", "is_month_end", "is_quarter_start", "day_of_year", "month_sin", "month_cos",
          "dow_sin", "dow_cos", "lag_1", "lag_7", "lag_14", "lag_30", "rolling_mean_7", "rolling_std_7",
          "rolling_mean_14", "rolling_std_14", "rolling_mean_30", "rolling_std_30"]

_FEATURE_TABLE = (
    f"SELECT * FROM (SELECT ds, CAST(y AS DOUBLE) AS y,\n  {_cal()},\n  {_lags()}\nFROM edaily) f WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _FEATS))
ORACLES["feature_table"] = with_sales(_FEATURE_TABLE, _EXACT_DAILY)

_PAIRED = [*FEATURES, "y"]
ORACLES["feature_correlations"] = with_sales(
    f"""SELECT l.name AS a, r.name AS b, {R('corr(l.v, r.v)', 6)} AS correlation
FROM long l JOIN long r ON l.ds = r.ds AND l.at < r.at GROUP BY 1, 2""",
    _EXACT_DAILY + f""",
ft AS ({_FEATURE_TABLE}),
long AS (
  SELECT ds, unnest({_PAIRED}) AS name, unnest(range({len(_PAIRED)})) AS at,
         unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in _PAIRED)}]) AS v FROM ft)""")

ORACLES["chrono_split"] = with_daily(
    "SELECT ds, y, row_number() OVER (ORDER BY ds) <= floor(0.8 * count(*) OVER ()) AS is_train FROM daily")

ORACLES["sequence_windows"] = with_daily("""
SELECT t.ds, t.y AS label, CAST(h.i - t.i + 31 AS INTEGER) AS pos, h.y AS value
FROM di t JOIN di h ON h.i BETWEEN t.i - 30 AND t.i - 1
WHERE t.i > 30""", "di AS (SELECT ds, y, row_number() OVER (ORDER BY ds) AS i FROM daily)")

ORACLES["scaled_series"] = with_daily(f"""
SELECT ds, y, {R('mu')} AS y_mean, {R('sd')} AS y_std, {R('CASE WHEN sd > 0 THEN (y - mu) / sd ELSE 0 END', 6)} AS y_scaled
FROM (SELECT ds, y, avg(y) OVER () AS mu, stddev_pop(y) OVER () AS sd FROM daily) z""")

# ---- seasonality and insights ------------------------------------------------------------------

ORACLES["month_profile"] = with_sales(
    f"SELECT CAST(month(ds) AS INTEGER) AS month, {R('avg(y)')} AS avg_value FROM monthly GROUP BY 1", _MONTHLY_S)

ORACLES["weekday_profile"] = with_daily(
    f"SELECT CAST(isodow(ds) - 1 AS INTEGER) AS dow, strftime(ds, '%a') AS day, {R('avg(y)')} AS avg_value FROM daily GROUP BY 1, 2")

ORACLES["weekday_profile_weekly"] = with_sales(
    f"SELECT CAST(isodow(ds) - 1 AS INTEGER) AS dow, strftime(ds, '%a') AS day, {R('avg(y)')} AS avg_value FROM weekly GROUP BY 1, 2",
    _WEEKLY)

ORACLES["weekday_names"] = with_daily(f"SELECT dayname(ds) AS day_name, {R('avg(y)')} AS avg_value FROM daily GROUP BY 1")

ORACLES["peak_periods"] = with_sales("""
SELECT (SELECT month FROM mp ORDER BY v DESC, month LIMIT 1) AS peak_month,
       (SELECT day FROM wp ORDER BY v DESC, dow LIMIT 1) AS peak_day""",
    _DAILY + ",\n" + _MONTHLY_S + """,
mp AS (SELECT CAST(month(ds) AS INTEGER) AS month, avg(y) AS v FROM monthly GROUP BY 1),
wp AS (SELECT isodow(ds) - 1 AS dow, strftime(ds, '%a') AS day, avg(y) AS v FROM daily GROUP BY 1, 2)""")

_NAIVE = """np AS (SELECT ds, y AS actual, lag(y, 7) OVER (ORDER BY ds) AS predicted,
                row_number() OVER (ORDER BY ds) AS rn, count(*) OVER () AS n FROM daily),
ev AS (SELECT actual, predicted, actual - predicted AS e FROM np
       WHERE rn > floor(0.8 * n) AND actual IS NOT NULL AND predicted IS NOT NULL)"""

_METRICS = f"""SELECT {R('avg(abs(e))', 4)} AS mae, {R('sqrt(avg(e * e))', 4)} AS rmse,
       {R('CASE WHEN var_pop(actual) * count(actual) > 0 THEN 1 - sum(e * e) / (var_pop(actual) * count(actual)) WHEN sum(e * e) = 0 THEN 1 ELSE 0 END', 4)} AS r2,
       {R('avg(abs(e / (actual + 1e-8))) * 100', 4)} AS mape FROM ev"""

ORACLES["forecast_metrics"] = with_daily(
    "SELECT " + ", ".join(f"CAST(printf('%.9e', {c}) AS DOUBLE) AS {c}" for c in ("mae", "rmse", "r2", "mape")) + f" FROM ({_METRICS}) m", _NAIVE)

_FMT1 = "printf('%.1f', CAST(ROUND(TRY_CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,10)), 1) AS DOUBLE))"
_FMT2 = "printf('%.2f', CAST(ROUND(TRY_CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,10)), 2) AS DOUBLE))"

ORACLES["insights"] = with_daily("""
SELECT CAST(row_number() OVER (ORDER BY rule) AS BIGINT) AS ordinal, text AS insight FROM rules WHERE text IS NOT NULL""",
    _MONTHLY_S + ",\n" + _NAIVE + f""",
mt AS ({_METRICS}),
mi AS (SELECT y, row_number() OVER (ORDER BY ds) AS i, count(*) OVER () AS n FROM monthly),
mf AS (SELECT max(n) AS n_months, max(CASE WHEN i = n THEN y END) AS last, max(CASE WHEN i = n - 1 THEN y END) AS prev,
              avg(CASE WHEN i > n - 3 THEN y END) AS q4, avg(CASE WHEN i BETWEEN 7 AND 9 THEN y END) AS q3 FROM mi),
dn AS (SELECT dayname(ds) AS day_name, avg(y) AS v FROM daily GROUP BY 1),
f AS (SELECT mf.*, (last - prev) / (prev + 1e-8) * 100 AS g,
             (SELECT day_name FROM dn ORDER BY v DESC, day_name LIMIT 1) AS best_day,
             (SELECT day_name FROM dn ORDER BY v ASC, day_name LIMIT 1) AS worst_day,
             COALESCE(mt.r2, 0) AS r2, COALESCE(mt.mape, 100) AS mape FROM mf, mt),
rules AS (
  SELECT 1 AS rule, CASE WHEN n_months >= 2 AND g > 10 THEN 'Strong month-over-month growth of ' || {_FMT1.format(x='g')} || '% — consider scaling inventory.'
                         WHEN n_months >= 2 AND g < -10 THEN 'Revenue declined ' || {_FMT1.format(x='abs(g)')} || '% MoM — review pricing and promotions.' END AS text FROM f
  UNION ALL SELECT 2, best_day || ' is your highest-performing day — optimize staffing and stock accordingly.' FROM f
  UNION ALL SELECT 3, worst_day || ' shows lowest sales — consider targeted promotions on this day.' FROM f
  UNION ALL SELECT 4, CASE WHEN n_months >= 12 AND q4 > q3 * 1.1 THEN 'Q4 shows strong seasonality — prepare 10-15% extra inventory for year-end.' END FROM f
  UNION ALL SELECT 5, CASE WHEN r2 > 0.85 THEN 'High forecast accuracy (R²>' || {_FMT2.format(x='r2')} || ') — rely on these predictions for procurement decisions.'
                           WHEN r2 < 0.5 THEN 'Forecast accuracy is moderate — consider collecting more feature-rich data for improvement.' END FROM f
  UNION ALL SELECT 6, CASE WHEN mape < 10 THEN 'MAPE under 10% indicates excellent forecast reliability for operational planning.' END FROM f)""")

# ---- customers and inventory ---------------------------------------------------------------------

_RFM = """rb0 AS (SELECT customer_id, max(date) AS last, CAST(count(date) AS BIGINT) AS frequency,
                COALESCE(CAST(sum(revenue) AS DOUBLE), 0) AS monetary FROM sales WHERE customer_id IS NOT NULL GROUP BY customer_id),
rb AS (SELECT customer_id, CAST(date_diff('day', last, (SELECT max(last) FROM rb0)) AS BIGINT) AS recency, frequency, monetary FROM rb0),
qe AS (SELECT quantile_cont(recency, 0.25) AS r1, quantile_cont(recency, 0.5) AS r2, quantile_cont(recency, 0.75) AS r3,
              quantile_cont(monetary, 0.25) AS m1, quantile_cont(monetary, 0.5) AS m2, quantile_cont(monetary, 0.75) AS m3,
              count(*) AS n FROM rb),
rs0 AS (SELECT rb.*, row_number() OVER (ORDER BY frequency, customer_id) AS f_rank FROM rb),
rs1 AS (SELECT customer_id, recency, frequency, monetary,
          CAST(CASE WHEN recency IS NULL THEN NULL WHEN recency <= r1 THEN 4 WHEN recency <= r2 THEN 3 WHEN recency <= r3 THEN 2 ELSE 1 END AS INTEGER) AS r_score,
          CAST(CASE WHEN f_rank <= 1 + (n - 1) * 0.25 THEN 1 WHEN f_rank <= 1 + (n - 1) * 0.5 THEN 2 WHEN f_rank <= 1 + (n - 1) * 0.75 THEN 3 ELSE 4 END AS INTEGER) AS f_score,
          CAST(CASE WHEN monetary IS NULL THEN NULL WHEN monetary <= m1 THEN 1 WHEN monetary <= m2 THEN 2 WHEN monetary <= m3 THEN 3 ELSE 4 END AS INTEGER) AS m_score
        FROM rs0, qe),
rs AS (SELECT *, CAST(COALESCE(r_score, 0) + COALESCE(f_score, 0) + COALESCE(m_score, 0) AS INTEGER) AS rfm_score,
         CASE WHEN COALESCE(r_score, 0) + COALESCE(f_score, 0) + COALESCE(m_score, 0) >= 10 THEN 'Champions'
              WHEN COALESCE(r_score, 0) + COALESCE(f_score, 0) + COALESCE(m_score, 0) >= 7 THEN 'Loyal Customers'
              WHEN COALESCE(r_score, 0) + COALESCE(f_score, 0) + COALESCE(m_score, 0) >= 4 THEN 'At Risk'
              ELSE 'Churned' END AS segment FROM rs1)"""

ORACLES["rfm_base"] = with_sales("SELECT customer_id, recency, frequency, monetary FROM rb", _RFM)
ORACLES["rfm_scores"] = with_sales("SELECT * FROM rs", _RFM)
ORACLES["rfm_segments"] = with_sales("""
SELECT CAST(count(*) AS BIGINT) AS total_customers,
       CAST(count(*) FILTER (WHERE segment = 'Champions') AS BIGINT) AS champions,
       CAST(count(*) FILTER (WHERE segment = 'Loyal Customers') AS BIGINT) AS loyal_customers,
       CAST(count(*) FILTER (WHERE segment = 'At Risk') AS BIGINT) AS at_risk,
       CAST(count(*) FILTER (WHERE segment = 'Churned') AS BIGINT) AS churned FROM rs""", _RFM)
ORACLES["rfm_summary"] = with_sales(f"""
SELECT {R('avg(monetary)')} AS avg_clv, {R('avg(frequency)')} AS avg_purchase_frequency, {R('avg(recency)', 1)} AS avg_recency_days FROM rb""", _RFM)
ORACLES["rfm_share"] = with_sales(f"""
SELECT segment, CAST(count(*) AS BIGINT) AS customers, {R('count(*) / (SELECT count(*) FROM rs) * 100', 0)} AS share_pct
FROM rs GROUP BY segment""", _RFM)

_INV = f"""rw AS (SELECT * FROM sales WHERE date >= (SELECT max(date) FROM sales) - INTERVAL 90 DAY),
ig AS (SELECT product_id, COALESCE(sum(quantity), 0) / 90 AS daily,
              CASE WHEN count(*) > 1 THEN stddev_samp(quantity) ELSE COALESCE(sum(quantity), 0) / 90 * 0.2 END AS sd
       FROM rw WHERE product_id IS NOT NULL GROUP BY product_id),
ic AS (SELECT product_id, daily, daily * 7 + 1.65 * sd * sqrt(7) AS safety FROM ig),
rec AS (SELECT product_id, CAST(product_id AS VARCHAR) AS product, {R('daily')} AS daily_avg_demand,
               {R('safety', 0)} AS safety_stock, {R('daily * 14 + safety', 0)} AS reorder_point,
               {R('daily * 30', 0)} AS recommended_order_qty,
               CASE WHEN daily > 0 AND daily * 30 > 0 THEN 'REORDER NOW' ELSE 'LOW DEMAND' END AS alert FROM ic),
top20 AS (SELECT CAST(row_number() OVER (ORDER BY daily_avg_demand DESC, product_id) AS BIGINT) AS rank, * EXCLUDE (product_id)
          FROM rec QUALIFY row_number() OVER (ORDER BY daily_avg_demand DESC, product_id) <= 20)"""

ORACLES["inventory_recommendations"] = with_sales("SELECT * FROM top20", _INV)
ORACLES["inventory_all_products"] = with_sales("SELECT * EXCLUDE (product_id) FROM rec", _INV)
ORACLES["inventory_alert_counts"] = with_sales("""
SELECT CAST(count(*) AS BIGINT) AS total_products, CAST(count(*) FILTER (WHERE alert = 'REORDER NOW') AS BIGINT) AS reorder_alerts,
       CAST(count(*) FILTER (WHERE alert = 'LOW DEMAND') AS BIGINT) AS low_demand FROM top20""", _INV)

# ---- dates, cleaning, profile ------------------------------------------------------------------------


_PY_FORMATS = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%B %d, %Y", "%b %d, %Y"]


def _parse_sql(raw_expr: str) -> str:
    fails = ", ".join(f"count(*) FILTER (WHERE try_strptime(raw, '{f}') IS NULL) AS f{i}" for i, f in enumerate(_PY_FORMATS))
    succ = ", ".join(f"count(*) FILTER (WHERE try_strptime(raw, '{f}') IS NOT NULL) AS s{i}" for i, f in enumerate(_PY_FORMATS))
    strict = " ".join(f"WHEN f{i} = 0 THEN {i}" for i in range(len(_PY_FORMATS)))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(_PY_FORMATS))) + ")"
    fb = " ".join(f"WHEN s{i} = {best} THEN {i}" for i in range(len(_PY_FORMATS)))
    parse = " ".join(f"WHEN {i} THEN try_strptime(raw, '{f}')" for i, f in enumerate(_PY_FORMATS))
    return f"""WITH raw AS (SELECT o_orderkey, {raw_expr} AS raw FROM orders),
st AS (SELECT {fails}, {succ} FROM raw WHERE raw IS NOT NULL),
pat AS (SELECT CASE {strict} ELSE CASE {fb} END END AS p FROM st)
SELECT * FROM (SELECT o_orderkey, raw, CAST(CASE p {parse} END AS DATE) AS parsed FROM raw, pat) x WHERE parsed IS NOT NULL"""


ORACLES["parse_dates"] = _parse_sql("strftime(o_orderdate, '%m/%d/%Y')")
ORACLES["parse_dates_mixed"] = _parse_sql(
    "CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END")
ORACLES["coerce_dates"] = """SELECT o_orderkey, raw, CAST(try_strptime(raw, '%Y-%m-%d') AS DATE) AS parsed
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders) o"""

_NUMS = ["product_id", "customer_id", "quantity", "unit_price", "revenue"]
_CLEAN = dirty_sales_oracle_cte() + """,
dd AS (SELECT DISTINCT * FROM dirty),
med AS (SELECT """ + ", ".join(f"median(CAST({c} AS DOUBLE)) AS m_{c}" for c in _NUMS) + """ FROM dd),
imp AS (SELECT date, COALESCE(CAST(product_id AS DOUBLE), m_product_id) AS product_id, category, region,
               COALESCE(CAST(customer_id AS DOUBLE), m_customer_id) AS customer_id,
               COALESCE(quantity, m_quantity) AS quantity, COALESCE(unit_price, m_unit_price) AS unit_price,
               COALESCE(revenue, m_revenue) AS revenue FROM dd, med),
fil AS (SELECT date, product_id, COALESCE(category, 'Unknown') AS category, COALESCE(region, 'Unknown') AS region,
               customer_id, quantity, unit_price, revenue FROM imp),
qb AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
    f"quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}" for c in _NUMS) + """ FROM imp),
cap AS (SELECT date, """ + ", ".join(
    f"least(greatest({c}, lo_{c}), hi_{c}) AS {c}" if c not in ("category", "region") else c
    for c in ["product_id", "category", "region", "customer_id", "quantity", "unit_price", "revenue"]) + """ FROM fil, qb)"""


def _rounded(tab: str) -> str:
    cols = ["date", "product_id", "category", "region", "customer_id", "quantity", "unit_price", "revenue"]
    return "SELECT " + ", ".join(f"{R(c, 6)} AS {c}" if c in _NUMS else c for c in cols) + f" FROM {tab}"


ORACLES["dedupe"] = "WITH " + dirty_sales_oracle_cte() + "\nSELECT DISTINCT * FROM dirty"
ORACLES["impute_median"] = "WITH " + _CLEAN + "\n" + _rounded("imp")
ORACLES["fill_unknown"] = "WITH " + _CLEAN + "\n" + _rounded("fil")
ORACLES["cap_outliers"] = "WITH " + _CLEAN + "\n" + _rounded("cap")

ORACLES["cleaning_report"] = "WITH " + _CLEAN + """,
rep AS (
  SELECT 'original_rows' AS issue, '*' AS "column", CAST(count(*) AS BIGINT) AS n FROM dirty
  UNION ALL SELECT 'final_rows', '*', CAST(count(*) AS BIGINT) FROM dd
  UNION ALL SELECT 'duplicates_removed', '*', CAST((SELECT count(*) FROM dirty) - (SELECT count(*) FROM dd) AS BIGINT)
""" + "".join(
    f"  UNION ALL SELECT 'missing_filled_median', '{c}', CAST(count(*) - count({c}) AS BIGINT) FROM dd\n" for c in _NUMS) + "".join(
    f"  UNION ALL SELECT 'missing_filled_unknown', '{c}', CAST(count(*) - count({c}) AS BIGINT) FROM dd\n" for c in ("category", "region")) + "".join(
    f"  UNION ALL SELECT 'outliers_capped', '{c}', CAST(count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c}) AS BIGINT) FROM imp, qb\n" for c in _NUMS) + """)
SELECT * FROM rep WHERE issue IN ('original_rows', 'final_rows') OR n > 0"""

_DIRTY_COLS = ["date", "product_id", "category", "region", "customer_id", "quantity", "unit_price", "revenue"]

ORACLES["numeric_profile"] = "WITH " + dirty_sales_oracle_cte() + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM dirty" for c in _NUMS) + f""")
SELECT "column", {R('avg(v)', 4)} AS mean, {R('median(v)', 4)} AS median, {R('stddev_samp(v)', 4)} AS std,
       {R('min(v)', 4)} AS min, {R('max(v)', 4)} AS max FROM long GROUP BY 1"""

ORACLES["categorical_profile"] = "WITH " + dirty_sales_oracle_cte() + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS v FROM dirty" for c in ("category", "region")) + """),
cnt AS (SELECT "column", v, CAST(count(*) AS BIGINT) AS n FROM long WHERE v IS NOT NULL GROUP BY 1, 2),
uq AS (SELECT "column", CAST(count(*) AS BIGINT) AS unique_count FROM cnt GROUP BY 1)
SELECT c."column", unique_count, rank, v AS value, n FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS BIGINT) AS rank FROM cnt) c
JOIN uq ON c."column" = uq."column" WHERE rank <= 5"""

ORACLES["categorical_top_values"] = f"SELECT * EXCLUDE (unique_count) FROM ({ORACLES['categorical_profile']})"

ORACLES["missing_counts"] = "WITH " + dirty_sales_oracle_cte() + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing FROM dirty" for c in _DIRTY_COLS)

ORACLES["dataset_shape"] = "WITH " + dirty_sales_oracle_cte() + "\nSELECT CAST(count(*) AS BIGINT) AS rows, CAST(8 AS BIGINT) AS columns FROM dirty"

ORACLES["date_range"] = with_sales("SELECT min(date) AS start, max(date) AS \"end\" FROM sales")

ORACLES["target_stats"] = with_sales(f"""
SELECT {R('COALESCE(sum(CAST(revenue AS DOUBLE)), 0)')} AS total, {R('avg(CAST(revenue AS DOUBLE))')} AS mean,
       {R('max(CAST(revenue AS DOUBLE))')} AS max, {R('min(CAST(revenue AS DOUBLE))')} AS min FROM sales""")

# ---- sources and sinks -------------------------------------------------------------------------------------

ORACLES["dataset_registry"] = with_sales("""
SELECT 'sales' AS name, CAST(count(*) AS BIGINT) AS row_count, CAST(12 AS BIGINT) AS column_count,
       min(date) AS date_start, max(date) AS date_end FROM sales""")

ORACLES["csv_roundtrip"] = "WITH " + dirty_sales_oracle_cte() + """
SELECT CAST(date AS VARCHAR) AS date, product_id, category, region, customer_id, quantity, unit_price, revenue FROM dirty"""

ORACLES["recent_sales"] = with_sales("""
SELECT date, product_id, customer_id, quantity, CAST(revenue AS DOUBLE) AS revenue FROM sales
WHERE date >= (SELECT max(date) FROM sales) - INTERVAL 90 DAY""")

ORACLES["weekly_series_by_region"] = with_sales("""
SELECT cal.region, cal.k AS ds, COALESCE(w.y, 0) AS y FROM cal LEFT JOIN w ON cal.region = w.region AND cal.k = w.k""",
    """w AS (SELECT region, date + (7 - isodow(date))::INTEGER AS k, CAST(SUM(revenue) AS DOUBLE) AS y
        FROM sales WHERE date IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2),
cal AS (SELECT region, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS k
        FROM (SELECT region, MIN(k) AS lo, MAX(k) AS hi FROM w GROUP BY region) b)""")

ORACLES["monthly_series_by_region"] = with_sales("""
SELECT cal.region, last_day(cal.k) AS ds, COALESCE(m.y, 0) AS y FROM cal LEFT JOIN m ON cal.region = m.region AND cal.k = m.k""",
    """m AS (SELECT region, CAST(date_trunc('month', date) AS DATE) AS k, CAST(SUM(revenue) AS DOUBLE) AS y
        FROM sales WHERE date IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2),
cal AS (SELECT region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS k
        FROM (SELECT region, MIN(k) AS lo, MAX(k) AS hi FROM m GROUP BY region) b)""")


ORACLES["parse_datetimes"] = """
SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + o_orderkey % 86400 AS seconds FROM orders"""

ORACLES["coerce_dates_inferred"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders"""

ORACLES["summary_us_dates"] = ORACLES["date_range"]

ORACLES["clean_nan"] = ORACLES["cleaning_report"]

ORACLES["rfm_timestamps"] = with_sales("""
SELECT customer_id AS customer, CAST(floor((epoch(snap) - epoch(last_at)) / 86400) AS BIGINT) AS recency, frequency, monetary
FROM (SELECT *, max(last_at) OVER () AS snap FROM base) b""",
    """base AS (SELECT customer_id, max(CAST(date AS TIMESTAMP) + (customer_id % 24) * INTERVAL 1 HOUR) AS last_at,
        CAST(count(*) AS BIGINT) AS frequency, CAST(sum(revenue) AS DOUBLE) AS monetary FROM sales GROUP BY 1)""")

ORACLES["forecast_frame"] = with_sales("""
SELECT region, ds, y, false AS is_future,
       row_number() OVER (PARTITION BY region ORDER BY ds) <= floor(0.8 * count(*) OVER (PARTITION BY region)) AS is_train
FROM days
UNION ALL
SELECT region, CAST(hi + CAST(k AS INTEGER) AS DATE), NULL, true, NULL
FROM (SELECT region, max(ds) AS hi FROM days GROUP BY region) m, range(1, 31) r(k)""",
    """t AS (SELECT region, date AS k, CAST(SUM(revenue) AS DOUBLE) AS y FROM sales
        WHERE date IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2),
cal AS (SELECT region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS k
        FROM (SELECT region, MIN(k) AS lo, MAX(k) AS hi FROM t GROUP BY region) b),
days AS (SELECT cal.region, cal.k AS ds, COALESCE(t.y, 0) AS y FROM cal LEFT JOIN t ON cal.region = t.region AND cal.k = t.k)""")
