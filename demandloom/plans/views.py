"""SQL text of the shared panels, later views may read earlier ones."""

from demandloom.plans.least_squares_sql import least_squares
from demandloom.sources.panels import CALENDAR_ROWS, LINEAR_FEATURES

_FIT = least_squares("(SELECT * FROM attribution_features WHERE date < DATE '2001-01-01')", [], {c: c for c in LINEAR_FEATURES}, "y")
_CALENDAR = ",\n".join(f"(DATE '{d}', {h}, {b}, {int(b > 0)})" for d, h, b in CALENDAR_ROWS)

VIEWS = {
    "sales": """
SELECT CAST(l.l_shipdate AS DATE) AS date, s.s_nationkey AS store_nbr,
       CAST(substr(p.p_brand, 7) AS INT) AS item_nbr, r.r_name AS province,
       CASE CAST(substr(p.p_brand, 7) AS INT) % 5 WHEN 0 THEN 'Staples' WHEN 1 THEN 'Dairy'
            WHEN 2 THEN 'Beverages' WHEN 3 THEN 'Household' ELSE 'Baby' END AS category,
       SUM(l.l_quantity) AS units
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY 1, 2, 3, 4, 5
""",
    "ship_days": "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem",
    "sales_dirty": """
SELECT date, store_nbr, item_nbr, province, category,
       CASE WHEN (day(date) * 31 + store_nbr * 7 + item_nbr * 13) % 101 = 0 THEN NULL
            WHEN (day(date) * 31 + store_nbr * 7 + item_nbr * 13) % 197 = 5 THEN units * 3
            ELSE units END AS units
FROM sales
""",
    "weather_raw": """
SELECT c.c_nationkey % 20 AS station_nbr, CAST(o.o_orderdate AS DATE) AS date,
       CASE WHEN (max(o.o_orderkey) % 23) = 0 THEN 'M'
            ELSE CAST(CAST(floor(max(o.o_totalprice) / 5000) AS INT) AS VARCHAR) END AS tmax,
       CASE WHEN (max(o.o_orderkey) % 29) = 0 THEN '-'
            ELSE CAST(CAST(floor(min(o.o_totalprice) / 5000) AS INT) AS VARCHAR) END AS tmin,
       CASE max(o.o_orderkey) % 11 WHEN 0 THEN '  T' WHEN 1 THEN 'T' WHEN 2 THEN 'M' WHEN 3 THEN '2' ELSE '0' END
         AS preciptotal,
       concat_ws(' ', max(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'RA' END),
                      max(CASE WHEN o.o_orderpriority = '2-HIGH' THEN 'SN' END),
                      max(CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN 'BR' END),
                      max(CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'FG+' END)) AS codesum
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2
""",
    "weather_numeric": """
SELECT station_nbr, date, TRY_CAST(tmax AS DOUBLE) AS tmax, TRY_CAST(tmin AS DOUBLE) AS tmin,
       CASE trim(preciptotal) WHEN 'T' THEN 0.01 ELSE TRY_CAST(preciptotal AS DOUBLE) END AS preciptotal
FROM weather_raw
""",
    "store_key": "SELECT n_nationkey AS store_nbr, n_nationkey % 20 AS station_nbr FROM nation",
    "climate": """
SELECT CAST(o.o_orderdate AS DATE) AS date, r.r_name AS province,
       CAST(max(o.o_orderkey) % 250 AS DOUBLE) / 10 + 10 AS temperature,
       CAST(min(o.o_orderkey) % 56 + 40 AS DOUBLE) AS humidity,
       CASE WHEN r.r_name = 'ASIA' THEN CASE WHEN month(CAST(o.o_orderdate AS DATE)) BETWEEN 5 AND 10 THEN 'wet' ELSE 'dry' END
            WHEN month(CAST(o.o_orderdate AS DATE)) IN (12, 1, 2) THEN 'winter'
            WHEN month(CAST(o.o_orderdate AS DATE)) IN (3, 4, 5) THEN 'spring'
            WHEN month(CAST(o.o_orderdate AS DATE)) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY 1, 2, 5
""",
    "calendar": f"SELECT * FROM (VALUES {_CALENDAR}) AS t(date, holiday, blackfriday, isbf)",
    "predictions": """
SELECT date, store_nbr, item_nbr, province, category, units AS y,
       avg(units) OVER (PARTITION BY store_nbr, item_nbr ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS yhat
FROM sales
""",
    "attribution_features": """
SELECT * FROM (
  SELECT concat_ws('_', store_nbr, item_nbr, strftime(s.date, '%Y-%m-%d')) AS row_id, s.date, units AS y,
         lag(units) OVER w AS sales_lag_1,
         avg(units) OVER (PARTITION BY store_nbr, item_nbr ORDER BY s.date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
           AS sales_mean_7d,
         CAST(isodow(s.date) - 1 AS DOUBLE) AS day_of_week, CAST(month(s.date) AS DOUBLE) AS month,
         c.temperature, CAST(store_nbr AS DOUBLE) AS store_nbr, CAST(item_nbr AS DOUBLE) AS item_nbr,
         CAST(quarter(s.date) AS DOUBLE) AS quarter
  FROM sales s JOIN climate c ON s.date = c.date AND s.province = c.province
  WINDOW w AS (PARTITION BY s.store_nbr, s.item_nbr ORDER BY s.date)
) t WHERE sales_lag_1 IS NOT NULL
""",
    "attribution_model": f"WITH {_FIT} SELECT "
    + ", ".join(f"round(b{i}, 4) AS b{i}" for i in range(len(LINEAR_FEATURES) + 1))
    + " FROM ols",
    "attribution": "\nUNION ALL\n".join(
        f"SELECT row_id, date, y, '{name}' AS feature, {name} AS value, (SELECT b{i} FROM attribution_model) "
        f"* ({name} - (SELECT avg({name}) FROM attribution_features)) AS phi FROM attribution_features"
        for i, name in enumerate(LINEAR_FEATURES, 1)
    ),
}
