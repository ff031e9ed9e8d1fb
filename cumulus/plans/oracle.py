"""Reference SQL (DuckDB dialect) for every registered query.

Written independently of the Spark plans, in the most literal form: plain joins
(including the pair-producing latitude join), ``list(... ORDER BY date)`` for
arrays, window functions for running totals and ordinals. The driver runs these
on the same Parquet tables (registered as views) and compares values.
"""

from __future__ import annotations

import datetime as _dt


def _lat(k: str) -> str:
    return (f"CAST(CASE WHEN {k} IN (3, 9) THEN 0.0 WHEN {k} = 24 THEN 23.5 "
            f"ELSE {k} * 4 - 45 END AS FLOAT)")


def _txt(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: coalesce(CAST(x AS VARCHAR), 'null')), ',')"


PLACES = f"""
p_seg AS (
  SELECT CAST(c_nationkey AS BIGINT) AS k, c_mktsegment AS seg, count(*) AS n
  FROM customer GROUP BY 1, 2
),
p_segidx AS (
  SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS seg_idx FROM (SELECT DISTINCT seg FROM p_seg) s
),
p_nat AS (SELECT k, sum(n) AS n FROM p_seg GROUP BY 1),
places AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS uid,
         'N' || CAST(n.n_nationkey AS VARCHAR) AS iso2,
         'NAT' || CAST(n.n_nationkey AS VARCHAR) AS iso3,
         CAST(n.n_nationkey + 100 AS INTEGER) AS code3,
         CAST(NULL AS BIGINT) AS FIPS,
         CAST(NULL AS VARCHAR) AS Admin2,
         CAST(NULL AS VARCHAR) AS region,
         n.n_name AS country,
         {_lat('n.n_nationkey')} AS latitude,
         CAST(n.n_nationkey * 7 - 84 AS FLOAT) AS longitude,
         n.n_name AS combined_key,
         CAST(CASE WHEN n.n_nationkey = 7 THEN NULL ELSE p.n * 1000 END AS BIGINT) AS population
  FROM nation n LEFT JOIN p_nat p ON p.k = n.n_nationkey
  UNION ALL
  SELECT CAST(1000 + s.k * 10 + i.seg_idx AS BIGINT),
         'N' || CAST(s.k AS VARCHAR), 'NAT' || CAST(s.k AS VARCHAR),
         CAST(s.k + 100 AS INTEGER),
         CAST(1000 + s.k * 10 + i.seg_idx AS BIGINT),
         CAST(NULL AS VARCHAR), s.seg, n.n_name,
         {_lat('s.k')}, CAST(s.k * 7 - 84 AS FLOAT),
         s.seg || ', ' || n.n_name,
         CAST(s.n * 1000 AS BIGINT)
  FROM p_seg s JOIN p_segidx i USING (seg) JOIN nation n ON n.n_nationkey = s.k
  WHERE s.k % 5 = 0
)"""

SERIES = """
ev AS (
  SELECT CASE WHEN (user_id % 25) % 5 = 0 THEN 'R' || CAST(user_id // 25 AS VARCHAR) END AS region,
         'NATION_' || CAST(user_id % 25 AS VARCHAR) AS country,
         CAST(ts AS DATE) AS date, event_type
  FROM events
),
daily AS (
  SELECT region, country, date,
         count(*) FILTER (WHERE event_type = 'view') AS confirmed,
         count(*) FILTER (WHERE event_type = 'error') AS deaths,
         count(*) FILTER (WHERE event_type = 'purchase') AS recovered
  FROM ev GROUP BY ALL
),
cal AS (SELECT min(date) AS lo, max(date) AS hi FROM daily),
grid AS (
  SELECT p.region, p.country, CAST(cal.lo + CAST(t.i AS INTEGER) AS DATE) AS date
  FROM (SELECT DISTINCT region, country FROM daily) p
  CROSS JOIN cal
  CROSS JOIN LATERAL (SELECT unnest(range(0, datediff('day', cal.lo, cal.hi) + 1)) AS i) t
),
series AS (
  SELECT g.region, g.country, g.date,
         CAST(sum(coalesce(d.confirmed, 0)) OVER w AS BIGINT) AS confirmed,
         CAST(sum(coalesce(d.deaths, 0)) OVER w AS BIGINT) AS deaths,
         CAST(sum(coalesce(d.recovered, 0)) OVER w AS BIGINT) AS recovered
  FROM grid g LEFT JOIN daily d
    ON g.region IS NOT DISTINCT FROM d.region AND g.country = d.country AND g.date = d.date
  WINDOW w AS (PARTITION BY g.region, g.country ORDER BY g.date
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
series_v AS (
  SELECT s.region, s.country,
         coalesce(p.latitude, CAST(0 AS FLOAT)) AS latitude,
         coalesce(p.longitude, CAST(0 AS FLOAT)) AS longitude,
         s.date, s.confirmed, s.deaths, s.recovered
  FROM series s LEFT JOIN places p ON p.country = s.country AND p.region IS NULL
),
v_confirmed AS (SELECT region, country, latitude, longitude, date, confirmed AS counts FROM series_v),
v_deaths AS (SELECT region, country, latitude, longitude, date, deaths AS counts FROM series_v
             WHERE country <> 'NATION_1'),
v_recovered AS (
  SELECT CASE WHEN country = 'NATION_0' THEN NULL ELSE region END AS region, country, latitude, longitude, date,
         CAST(sum(recovered) AS BIGINT) AS counts
  FROM series_v GROUP BY ALL
),
h_confirmed AS (SELECT region, country, latitude, longitude, list(counts ORDER BY date) AS counts
                FROM v_confirmed GROUP BY ALL),
h_deaths AS (SELECT region, country, latitude, longitude, list(counts ORDER BY date) AS counts
             FROM v_deaths GROUP BY ALL),
h_recovered AS (SELECT region, country, latitude, longitude, list(counts ORDER BY date) AS counts
                FROM v_recovered GROUP BY ALL),
merged_cd AS (
  SELECT coalesce(c.region, d.region) AS region, coalesce(c.country, d.country) AS country,
         coalesce(c.latitude, d.latitude) AS latitude, coalesce(c.longitude, d.longitude) AS longitude,
         c.counts AS confirmed, d.counts AS deaths
  FROM h_confirmed c FULL OUTER JOIN h_deaths d
    ON c.region IS NOT DISTINCT FROM d.region AND c.country IS NOT DISTINCT FROM d.country
),
merged AS (
  SELECT coalesce(m.region, r.region) AS region, coalesce(m.country, r.country) AS country,
         coalesce(m.latitude, r.latitude) AS latitude, coalesce(m.longitude, r.longitude) AS longitude,
         m.confirmed, m.deaths, r.counts AS recovered
  FROM merged_cd m FULL OUTER JOIN h_recovered r
    ON m.region IS NOT DISTINCT FROM r.region AND m.country IS NOT DISTINCT FROM r.country
)"""


def _ids(frame: str) -> str:
    return f"""
id_{frame} AS (
  SELECT region, country, row_number() OVER (ORDER BY country ASC NULLS FIRST, region ASC NULLS FIRST) - 1 AS id
  FROM (SELECT DISTINCT region, country FROM v_{frame}) q
),
vv_{frame} AS (
  SELECT i.id, v.region, v.country, v.latitude, v.longitude, v.date, v.counts
  FROM v_{frame} v JOIN id_{frame} i ON i.region IS NOT DISTINCT FROM v.region AND i.country = v.country
)"""


MERGED_VERTICAL = _ids("confirmed") + "," + _ids("deaths") + "," + _ids("recovered") + """,
mv_cd AS (
  SELECT coalesce(c.id, d.id) AS id, coalesce(c.region, d.region) AS region, coalesce(c.country, d.country) AS country,
         coalesce(c.latitude, d.latitude) AS latitude, coalesce(c.longitude, d.longitude) AS longitude,
         coalesce(c.date, d.date) AS date, c.counts AS confirmed, d.counts AS deaths
  FROM vv_confirmed c FULL OUTER JOIN vv_deaths d
    ON c.region IS NOT DISTINCT FROM d.region AND c.country IS NOT DISTINCT FROM d.country AND c.date = d.date
),
merged_v AS (
  SELECT coalesce(m.id, r.id) AS id, coalesce(m.region, r.region) AS region, coalesce(m.country, r.country) AS country,
         coalesce(m.latitude, r.latitude) AS latitude, coalesce(m.longitude, r.longitude) AS longitude,
         coalesce(m.date, r.date) AS date, m.confirmed, m.deaths, r.counts AS recovered
  FROM mv_cd m FULL OUTER JOIN vv_recovered r
    ON m.region IS NOT DISTINCT FROM r.region AND m.country IS NOT DISTINCT FROM r.country AND m.date = r.date
)"""

US = """
us_v AS (
  SELECT CAST(1000000 + CAST(substr(s.country, 8) AS BIGINT) + 25 * CAST(substr(s.region, 2) AS BIGINT) AS BIGINT) AS uid,
         p.iso2, p.iso3, p.code3,
         CAST(1000000 + CAST(substr(s.country, 8) AS BIGINT) + 25 * CAST(substr(s.region, 2) AS BIGINT) AS BIGINT) AS FIPS,
         s.region AS Admin2, s.region, s.country, s.latitude, s.longitude,
         s.region || ', ' || s.country AS combined_key,
         p.population, s.date, s.confirmed, s.deaths
  FROM series_v s LEFT JOIN places p ON p.country = s.country AND p.region IS NULL
  WHERE s.region IS NOT NULL
),
us_vc AS (SELECT uid, iso2, iso3, code3, FIPS, Admin2, region, country, latitude, longitude, combined_key,
                 date, confirmed AS counts, CAST(NULL AS BIGINT) AS population FROM us_v),
us_vd AS (SELECT uid, iso2, iso3, code3, FIPS, Admin2, region, country, latitude, longitude, combined_key,
                 date, deaths AS counts, population FROM us_v),
us_hc AS (SELECT uid, iso2, iso3, code3, FIPS, Admin2, region, country, latitude, longitude, combined_key,
                 list(counts ORDER BY date) AS counts FROM us_vc GROUP BY ALL),
us_hd AS (SELECT uid, iso2, iso3, code3, FIPS, Admin2, region, country, latitude, longitude, combined_key,
                 list(counts ORDER BY date) AS counts, population FROM us_vd GROUP BY ALL)"""

LOG = """
lg_j AS (
  SELECT c.c_mktsegment AS region, n.n_name AS country, CAST(o.o_orderdate AS DATE) AS observed_date,
         o.o_orderkey, o.o_orderstatus
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
),
lg_d AS (
  SELECT region, country, observed_date, CAST(min(o_orderkey) AS BIGINT) AS id, count(*) AS n,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS p
  FROM lg_j GROUP BY ALL
),
log AS (
  SELECT id, observed_date, region, country, observed_date AS last_updated,
         CAST(sum(n) OVER w AS BIGINT) AS confirmed,
         CAST(sum(f) OVER w AS BIGINT) AS deaths,
         CAST(sum(p) OVER w AS BIGINT) AS recovered
  FROM lg_d
  WINDOW w AS (PARTITION BY region, country ORDER BY observed_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


def _quarter(col: str, base: int = 1995) -> str:
    return f"CAST(quarter({col}) + 4 * (year({col}) - {base}) AS INTEGER)"


def _period(keys: str, measures: list[str], where: str = "") -> str:
    k = f"{keys}, " if keys else ""
    sums = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}_by_date" for m in measures)
    tots = ", ".join(f"max({m}_by_date) - min({m}_by_date) AS quarter_total_{m}" for m in measures)
    return f"""
bd AS (SELECT {k}observed_date, {sums} FROM log {where} GROUP BY ALL),
tot AS (SELECT {k}{_quarter('observed_date')} AS quarter, {tots} FROM bd GROUP BY ALL)"""


# The calendar of the given events, the same at every size.
FIRST_DAY, N_DAYS = _dt.date(2024, 1, 1), 30


def _unpacked() -> str:
    # One column per day, labelled like "Jan 01 '24".
    days = [FIRST_DAY + _dt.timedelta(days=i) for i in range(N_DAYS)]
    cols = ", ".join(f"max(v) FILTER (WHERE date = DATE '{d}') AS \"{d.strftime('%b %d')} '{d:%y}\"" for d in days)
    return f"SELECT country, latitude, longitude, {cols} FROM src GROUP BY country, latitude, longitude"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["global_percent_by_quarter"] = _with(PLACES, LOG, _period("country", ["confirmed"])) + """
SELECT t.country, t.quarter, t.quarter_total_confirmed,
       CAST(t.quarter_total_confirmed AS DOUBLE) / nullif(p.population, 0) AS quarter_total_confirmed_percent
FROM tot t JOIN (SELECT country, population FROM places WHERE region IS NULL) p ON p.country = t.country"""
    q["us_percent_by_quarter"] = _with(PLACES, LOG, _period("", ["confirmed"], "WHERE country = 'NATION_0'")) + """
SELECT quarter, quarter_total_confirmed,
       CAST(quarter_total_confirmed AS DOUBLE) / nullif((SELECT population FROM places WHERE uid = 0), 0)
         AS quarter_total_confirmed_percent
FROM tot"""
    ms = ["confirmed", "deaths", "recovered"]
    pct = ", ".join(
        f"CAST(quarter_total_{m} AS DOUBLE) / nullif((SELECT population FROM places WHERE uid = 0), 0) "
        f"AS quarter_total_{m}_percent" for m in ms)
    q["us_all_percent_by_quarter"] = _with(PLACES, LOG, _period("", ms, "WHERE country = 'NATION_0'")) + f"""
SELECT quarter, quarter_total_confirmed, quarter_total_deaths, quarter_total_recovered, {pct}
FROM tot"""
    q["incidence"] = _with(PLACES, SERIES) + """
SELECT g.country, CAST(g.counts[30] AS DOUBLE) / nullif(u.population, 0) AS incidence
FROM h_confirmed g JOIN places u ON g.country = u.country
WHERE u.region IS NULL"""
    q["tropical_vs_non_tropical"] = _with(PLACES, SERIES) + """
, pairs AS (
  SELECT CASE WHEN u.latitude < 23.5 AND u.latitude > -23.5 THEN 'tropical'
              WHEN u.latitude > 23.5 OR u.latitude < -23.5 THEN 'non-tropical' END AS climate,
         g.counts[30] AS c, u.population AS pop
  FROM h_confirmed g JOIN places u ON g.latitude = u.latitude
)
SELECT s.climate, CAST(sum(p.c) AS BIGINT) AS sum_confirmed, CAST(sum(p.pop) AS BIGINT) AS sum_population,
       CAST(sum(p.c) AS DOUBLE) / nullif(sum(p.pop), 0) AS incidence
FROM (VALUES ('tropical'), ('non-tropical')) s(climate) LEFT JOIN pairs p ON p.climate = s.climate
GROUP BY s.climate"""
    q["incidence_with_counts"] = _with(PLACES, SERIES) + """
SELECT g.country, CAST(g.counts[30] AS DOUBLE) / nullif(u.population, 0) AS incidence,
       g.counts[30] AS confirmed, u.population
FROM h_confirmed g JOIN places u ON g.country = u.country
WHERE u.region IS NULL"""
    q["tropical_vs_non_tropical_by_country"] = _with(PLACES, SERIES) + """
, pairs AS (
  SELECT CASE WHEN u.latitude < 23.5 AND u.latitude > -23.5 THEN 'tropical'
              WHEN u.latitude > 23.5 OR u.latitude < -23.5 THEN 'non-tropical' END AS climate,
         g.counts[30] AS c, u.population AS pop
  FROM h_confirmed g JOIN places u ON g.country = u.country
)
SELECT s.climate, CAST(sum(p.c) AS BIGINT) AS sum_confirmed, CAST(sum(p.pop) AS BIGINT) AS sum_population,
       CAST(sum(p.c) AS DOUBLE) / nullif(sum(p.pop), 0) AS incidence
FROM (VALUES ('tropical'), ('non-tropical')) s(climate) LEFT JOIN pairs p ON p.climate = s.climate
GROUP BY s.climate"""
    q["death_rates"] = _with(PLACES, SERIES) + """
SELECT d.country, d.date, d.counts AS deaths, c.counts AS cases,
       CAST(d.counts AS DOUBLE) / nullif(c.counts, 0) AS death_rate
FROM v_deaths d JOIN v_confirmed c
  ON d.region IS NOT DISTINCT FROM c.region AND d.country = c.country AND d.date = c.date
WHERE d.country IN ('NATION_0', 'NATION_2', 'NATION_3', 'NATION_9', 'NATION_10', 'NATION_24')"""
    q["merge_global"] = _with(PLACES, SERIES) + f"""
SELECT region, country, latitude, longitude, {_txt('confirmed')} AS confirmed, {_txt('deaths')} AS deaths,
       {_txt('recovered')} AS recovered
FROM merged"""
    q["merge_us"] = _with(PLACES, SERIES, US) + f"""
SELECT coalesce(c.uid, d.uid) AS uid, coalesce(c.iso2, d.iso2) AS iso2, coalesce(c.iso3, d.iso3) AS iso3,
       coalesce(c.code3, d.code3) AS code3, coalesce(c.FIPS, d.FIPS) AS FIPS, coalesce(c.Admin2, d.Admin2) AS Admin2,
       coalesce(c.region, d.region) AS region, coalesce(c.country, d.country) AS country,
       coalesce(c.latitude, d.latitude) AS latitude, coalesce(c.longitude, d.longitude) AS longitude,
       coalesce(c.combined_key, d.combined_key) AS combined_key,
       {_txt('c.counts')} AS confirmed, {_txt('d.counts')} AS deaths, d.population
FROM us_hc c FULL OUTER JOIN us_hd d ON c.uid IS NOT DISTINCT FROM d.uid"""
    q["merge_global_vertical"] = _with(PLACES, SERIES, MERGED_VERTICAL) + """
SELECT * FROM merged_v"""
    us_mv = """
SELECT coalesce(c.uid, d.uid) AS uid, coalesce(c.iso2, d.iso2) AS iso2, coalesce(c.iso3, d.iso3) AS iso3,
       coalesce(c.code3, d.code3) AS code3, coalesce(c.FIPS, d.FIPS) AS FIPS, coalesce(c.Admin2, d.Admin2) AS Admin2,
       coalesce(c.region, d.region) AS region, coalesce(c.country, d.country) AS country,
       coalesce(c.latitude, d.latitude) AS latitude, coalesce(c.longitude, d.longitude) AS longitude,
       coalesce(c.combined_key, d.combined_key) AS combined_key, coalesce(c.date, d.date) AS date,
       c.counts AS confirmed, d.counts AS deaths, coalesce(d.population, c.population) AS population
FROM us_vc c FULL OUTER JOIN us_vd d ON c.uid IS NOT DISTINCT FROM d.uid AND c.date = d.date"""
    q["merge_us_vertical"] = _with(PLACES, SERIES, US) + us_mv
    q["us_count_vertical"] = _with(PLACES, SERIES, US) + f"SELECT * EXCLUDE (country) FROM ({us_mv}) x"
    q["growth_vertical_us"] = _with(PLACES, SERIES, US) + f"""
SELECT *, deaths - lag(deaths) OVER (PARTITION BY uid ORDER BY date) AS deaths_growth FROM ({us_mv}) x"""
    q["global_count_vertical"] = _with(PLACES, SERIES, MERGED_VERTICAL) + """
SELECT id, country, latitude, longitude, date, confirmed FROM merged_v WHERE region IS NULL"""
    q["global_count_unpacked"] = _with(PLACES, SERIES) + """
, src AS (
  SELECT m.country, m.latitude, m.longitude, v.date, v.counts AS v
  FROM merged m LEFT JOIN v_confirmed v ON v.region IS NULL AND v.country = m.country
  WHERE m.region IS NULL
)
""" + _unpacked()
    q["growth_unpacked"] = _with(PLACES, SERIES) + """
, src AS (
  SELECT m.country, m.latitude, m.longitude, v.date,
         v.counts - lag(v.counts) OVER (PARTITION BY v.region, v.country ORDER BY v.date) AS v
  FROM merged m LEFT JOIN v_confirmed v ON v.region IS NULL AND v.country = m.country
  WHERE m.region IS NULL
)
""" + _unpacked()
    q["growth_horizontal"] = _with(PLACES, SERIES) + f"""
, g AS (
  SELECT region, country, date,
         counts - lag(counts) OVER (PARTITION BY region, country ORDER BY date) AS growth
  FROM v_confirmed
)
SELECT m.region, m.country,
       CASE WHEN m.confirmed IS NULL THEN NULL ELSE
         (SELECT {_txt('list(g.growth ORDER BY g.date)')} FROM g
          WHERE g.region IS NOT DISTINCT FROM m.region AND g.country = m.country) END AS confirmed_growth
FROM merged m"""
    q["growth_vertical"] = _with(PLACES, SERIES, MERGED_VERTICAL) + """
SELECT *, confirmed - lag(confirmed) OVER (PARTITION BY region, country ORDER BY date) AS confirmed_growth
FROM merged_v"""
    q["to_horizontal_global"] = _with(PLACES, SERIES) + f"""
SELECT region, country, latitude, longitude, {_txt('list(deaths ORDER BY date)')} AS counts
FROM series_v GROUP BY region, country, latitude, longitude"""
    q["to_horizontal_us"] = _with(PLACES, SERIES, US) + f"""
SELECT uid, iso2, iso3, code3, FIPS, Admin2, region, country, latitude, longitude, combined_key,
       {_txt('counts')} AS counts, population FROM us_hd"""
    q["to_vertical_global"] = _with(PLACES, SERIES, _ids("recovered")) + """
SELECT * FROM vv_recovered"""
    q["to_vertical_us"] = _with(PLACES, SERIES, US) + """
SELECT * FROM us_vd"""
    q["dense_ordinal"] = """
SELECT o_orderkey, o_custkey, o_orderdate,
       row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS id
FROM orders"""
    cal2 = "cal2 AS (SELECT CAST(datediff('day', lo, hi) + 1 AS BIGINT) AS n FROM cal)"
    f = "CAST('{}' AS FLOAT)"
    q["load_wide_csv"] = _with(PLACES, SERIES, cal2) + f"""
SELECT region, country, latitude, longitude, {_txt('counts')} AS counts FROM h_confirmed
UNION ALL SELECT NULL, 'Korea, South', {f.format(36)}, {f.format(128)}, {_txt('range(1, n + 1)')} FROM cal2
UNION ALL SELECT 'x "y" z', 'EDGE_B', {f.format(2)}, {f.format(3)}, {_txt('range(1, n + 1)')} FROM cal2
UNION ALL SELECT NULL, 'EDGE_A', {f.format(2)}, {f.format(3)}, {_txt('list_append(range(1, n), NULL)')} FROM cal2
UNION ALL SELECT NULL, 'EDGE_SHIP', {f.format(0)}, {f.format(0)}, {_txt('range(1, n + 1)')} FROM cal2"""
    q["parse_quoted_lines"] = _with(PLACES, SERIES, cal2) + """
SELECT CAST(4 + n AS INTEGER) AS n_fields, region, country, CAST(list_sum(counts) AS BIGINT) AS total
FROM h_confirmed, cal2
UNION ALL SELECT CAST(4 + n AS INTEGER), NULL, 'Korea, South', CAST(n * (n + 1) // 2 AS BIGINT) FROM cal2
UNION ALL SELECT CAST(4 + n AS INTEGER), 'x y z', 'EDGE_B', CAST(n * (n + 1) // 2 AS BIGINT) FROM cal2
UNION ALL SELECT CAST(4 + n AS INTEGER), NULL, 'EDGE_A', CAST((n - 1) * n // 2 AS BIGINT) FROM cal2
UNION ALL SELECT CAST(4 + n AS INTEGER), NULL, 'EDGE_SHIP', CAST(n * (n + 1) // 2 AS BIGINT) FROM cal2
UNION ALL SELECT CAST(4 + n AS INTEGER), NULL, ' Blank, Before', CAST(n * (n + 1) // 2 AS BIGINT) FROM cal2
UNION ALL SELECT CAST(4 + n AS INTEGER), 'abc x, y', 'INSIDE', CAST(n * (n + 1) // 2 AS BIGINT) FROM cal2
UNION ALL SELECT CAST(4 + n AS INTEGER), 'abc,d', 'TWICE', CAST(n * (n + 1) // 2 AS BIGINT) FROM cal2
UNION ALL SELECT CAST(4 + n AS INTEGER), repeat('x,', 50000), 'LONG', CAST(n * (n + 1) // 2 AS BIGINT) FROM cal2"""
    q["load_wide_csv_vertical"] = _with(PLACES, SERIES, cal2) + """
, edges AS (
  SELECT * FROM (VALUES (NULL, 'Korea, South', 36.0, 128.0, 0), ('x "y" z', 'EDGE_B', 2.0, 3.0, 0),
                        (NULL, 'EDGE_A', 2.0, 3.0, 1), (NULL, 'EDGE_SHIP', 0.0, 0.0, 0))
         e(region, country, lat, lon, short)
),
rows_v AS (
  SELECT region, country, latitude, longitude, date, counts FROM v_deaths
  UNION ALL
  SELECT e.region, e.country, CAST(e.lat AS FLOAT), CAST(e.lon AS FLOAT), CAST(cal.lo + CAST(t.i AS INTEGER) AS DATE),
         CASE WHEN e.short = 1 AND t.i = cal2.n - 1 THEN NULL ELSE CAST(t.i + 1 AS BIGINT) END
  FROM edges e CROSS JOIN cal CROSS JOIN cal2 CROSS JOIN LATERAL (SELECT unnest(range(0, cal2.n)) AS i) t
),
ids AS (
  SELECT region, country, row_number() OVER (ORDER BY country ASC NULLS FIRST, region ASC NULLS FIRST) - 1 AS id
  FROM (SELECT DISTINCT region, country FROM rows_v) q
)
SELECT i.id, r.region, r.country, r.latitude, r.longitude, r.date, r.counts
FROM rows_v r JOIN ids i ON i.region IS NOT DISTINCT FROM r.region AND i.country = r.country"""
    q["load_us_csv_vertical"] = _with(PLACES, SERIES, US) + """
SELECT * FROM us_vd"""
    q["load_us_csv"] = _with(PLACES, SERIES, US) + f"""
SELECT uid, iso2, iso3, code3, FIPS, Admin2, region, country, latitude, longitude, combined_key,
       {_txt('counts')} AS counts, population FROM us_hd"""
    q["clean_place_dim"] = _with(PLACES) + f"""
SELECT * FROM places
UNION ALL SELECT 9001, 'KR', 'KOR', 410, NULL, NULL, NULL, 'Korea, South', {f.format(36)}, {f.format(128)},
                 'Korea, South', 51269183
UNION ALL SELECT 9002, NULL, NULL, NULL, NULL, NULL, NULL, 'EDGE_SHIP', {f.format(0)}, {f.format(0)},
                 'EDGE_SHIP', NULL
UNION ALL SELECT 9003, 'US', 'USA', 840, 1001, 'Autauga', 'Alabama', 'US', {f.format(32.5)}, {f.format(-86.6)},
                 'Autauga, Alabama, US', 55869"""
    log_edges = """
UNION ALL SELECT * FROM (VALUES
  (1, DATE '2020-01-22', 'Diamond Princess', 'Others', DATE '2020-01-22', 12, 1, 0),
  (2, DATE '2020-01-22', NULL, 'St. Martin', DATE '2020-01-22', 12, 0, 0),
  (3, DATE '2020-01-23', NULL, 'Bahamas', DATE '2020-01-22', 3, NULL, 1),
  (4, DATE '2020-01-23', 'Grand Princess', 'Canada', DATE '2020-02-01', 5, 0, 0),
  (5, DATE '2020-01-24', NULL, 'NATION_3', DATE '2020-03-08', 7, 1, 2),
  (6, DATE '2020-01-24', 'Hubei', 'Gambia', NULL, 1, 0, 0),
  (7, DATE '2020-01-24', NULL, 'Spain', DATE '2020-01-22', 2, 0, 0)) e"""
    q["clean_observation_log"] = _with(LOG) + "SELECT * FROM log" + log_edges
    q["parse_update_dates"] = _with(LOG) + """
SELECT id,
       CASE id % 5 WHEN 0 THEN strftime(ts, '%-m/%-d/%Y %-H:%M')
                   WHEN 1 THEN strftime(ts, '%-m/%-d/%y %H:%M')
                   WHEN 2 THEN strftime(ts, '%-m/%-d/%y %-H:%M')
                   WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                   ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS last_update_text,
       observed_date AS last_updated
FROM (SELECT *, CAST(observed_date AS TIMESTAMP) + to_hours(CAST(id % 24 AS INTEGER))
                + to_minutes(CAST(id % 60 AS INTEGER)) AS ts FROM log) t
UNION ALL SELECT * FROM (VALUES
  (1, '1/22/2020 17:00', DATE '2020-01-22'), (2, '1/22/20 17:00', DATE '2020-01-22'),
  (3, '1/22/20 7:00', DATE '2020-01-22'), (4, '2020-02-01T19:53:03', DATE '2020-02-01'),
  (5, '2020-03-08 05:31:00', DATE '2020-03-08'), (6, 'Jan 22', NULL), (7, '1/22/20 0:30', DATE '2020-01-22')) e"""
    q["normalise_region"] = _with(LOG) + """
SELECT id, region AS region_raw, region FROM log
UNION ALL SELECT * FROM (VALUES
  (1, 'Diamond Princess cruise ship', 'Diamond Princess'), (2, 'None', NULL), (3, 'Unknown', NULL),
  (4, 'Grand Princess', 'Grand Princess'), (5, 'NATION_3', NULL), (6, ' Hubei ', 'Hubei'),
  (7, NULL, NULL)) e"""
    q["normalise_country"] = _with(LOG) + """
SELECT id, country AS country_raw, country FROM log
UNION ALL SELECT * FROM (VALUES
  (1, 'Others', 'Others'), (2, '(''St. Martin'',)', 'St. Martin'), (3, 'Bahamas, The', 'Bahamas'),
  (4, 'Canada', 'Canada'), (5, 'NATION_3', 'NATION_3'), (6, 'The Gambia', 'Gambia'),
  (7, '  Spain ', 'Spain')) e"""
    q["csv_round_trip"] = q["global_count_vertical"]
    q["global_count_unpacked_learned"] = _with(PLACES, SERIES) + """
, src AS (
  SELECT m.country, m.latitude, m.longitude, v.date, v.counts AS v
  FROM merged m LEFT JOIN v_deaths v ON v.region IS NULL AND v.country = m.country
  WHERE m.region IS NULL
)
""" + _unpacked()
    q["to_horizontal_sparse"] = _with(PLACES, SERIES) + f"""
SELECT g.region, g.country, {_txt('list(d.confirmed ORDER BY g.date)')} AS counts
FROM grid g JOIN (SELECT DISTINCT region, country FROM daily WHERE confirmed > 0) p
    ON p.region IS NOT DISTINCT FROM g.region AND p.country = g.country
  LEFT JOIN daily d ON d.region IS NOT DISTINCT FROM g.region AND d.country = g.country AND d.date = g.date
    AND d.confirmed > 0
GROUP BY g.region, g.country"""
    q["ordinal_file_order"] = "SELECT o_orderkey, o_orderdate, row_number() OVER () - 1 AS id FROM orders"
    us_edge = "9900001, 'EE', 'EDG', 0, 0, 'Edge, Town', 'EDGE_R', 'EDGE_US', CAST(0 AS FLOAT), CAST(0 AS FLOAT), 'Edge, Town, EDGE_US'"
    q["load_us_confirmed_csv"] = _with(PLACES, SERIES, US, cal2) + f"""
SELECT uid, iso2, iso3, code3, FIPS, Admin2, region, country, latitude, longitude, combined_key,
       {_txt('counts')} AS counts, CAST(NULL AS BIGINT) AS population FROM us_hc
UNION ALL SELECT {us_edge}, {_txt('range(1, n + 1)')}, NULL FROM cal2"""
    q["load_us_confirmed_csv_vertical"] = _with(PLACES, SERIES, US, cal2) + f"""
SELECT uid, iso2, iso3, code3, FIPS, Admin2, region, country, latitude, longitude, combined_key, population, date, counts
FROM us_vc
UNION ALL SELECT {us_edge}, NULL, CAST(cal.lo + CAST(t.i AS INTEGER) AS DATE), CAST(t.i + 1 AS BIGINT)
FROM cal CROSS JOIN cal2 CROSS JOIN LATERAL (SELECT unnest(range(0, cal2.n)) AS i) t"""
    q["bad_series_rows"] = """
SELECT * FROM (VALUES ('BAD_LATITUDE', false), ('BAD_COUNT', false), ('TOO_LONG', true), ('TOO_SHORT', true))
  e(country, malformed)"""
    q["menu_4_from_raw"] = q["incidence"]
    q["sql_over_views"] = _with(PLACES, SERIES) + """
SELECT g.country, count(*) AS n_places, CAST(sum(g.counts[30]) AS BIGINT) AS confirmed, max(u.population) AS population
FROM h_confirmed g JOIN places u ON g.country = u.country AND u.region IS NULL
GROUP BY g.country"""
    q["csv_without_header"] = _with(PLACES, SERIES) + """
SELECT country, region, date, confirmed FROM series_v"""
    q["growth_hot_key"] = """
SELECT *, o_custkey - lag(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS o_custkey_growth
FROM (SELECT o_orderstatus, o_orderdate, o_orderkey, o_custkey FROM orders) o"""
    # The older release's middle third is one too high; it alone has NATION_2.
    q["load_wide_releases"] = _with(PLACES, SERIES, cal2) + f"""
, days AS (
  SELECT v.*, CAST(datediff('day', cal.lo, v.date) AS BIGINT) AS i, cal2.n FROM v_confirmed v, cal, cal2
),
known AS (
  SELECT region, country, latitude, longitude, i,
         CASE WHEN country <> 'NATION_2' OR i < n // 3 THEN counts WHEN i < n - n // 3 THEN counts + 1 END AS v
  FROM days
)
SELECT region, country, latitude, longitude, {_txt('list(v ORDER BY i)')} AS counts
FROM known GROUP BY region, country, latitude, longitude"""
    q["load_multi_line_csv"] = """
SELECT doc_id, source, CAST(length(nullif(text, '')) AS BIGINT) AS n_chars, md5(nullif(text, '')) AS text_md5 FROM documents"""
    q["wide_csv_round_trip"] = _with(PLACES, SERIES, cal2) + f"""
SELECT m.country, m.latitude, m.longitude,
       CASE WHEN m.confirmed IS NULL THEN {_txt('list_transform(range(n), lambda x: NULL)')} ELSE {_txt('m.confirmed')} END AS counts
FROM merged m, cal2 WHERE m.region IS NULL"""
    q["csv_single_file"] = q["global_count_vertical"]
    cut = lambda c: (f"CASE WHEN length(CAST({c} AS VARCHAR)) > 8 THEN left(CAST({c} AS VARCHAR), 5) || '...' "  # noqa: E731
                     f"ELSE coalesce(CAST({c} AS VARCHAR), 'NULL') END AS {c}")
    log_columns = ["id", "observed_date", "region", "country", "last_updated", "confirmed", "deaths", "recovered"]
    q["preview_log"] = _with(LOG) + f"""
SELECT {', '.join(cut(c) for c in log_columns)}
FROM (SELECT * FROM log ORDER BY id, region, country LIMIT 20) t"""
    q["top_incidence"] = f"""
SELECT * FROM ({q['incidence']}) i ORDER BY incidence DESC NULLS LAST, country LIMIT 10"""
    q["death_rates_without_date"] = f"SELECT country, deaths, cases, death_rate FROM ({q['death_rates']}) d"
    q["unmatched_countries"] = f"""
SELECT DISTINCT l.country FROM ({q['clean_observation_log']}) l
WHERE l.country NOT IN (SELECT n_name FROM nation)"""
    return q
