"""Independent SQL texts (DuckDB dialect) for the correctness oracle.

The Spark side of each query is built with the DataFrame API in the
library; these texts restate the same semantics in plain SQL over the raw
test tables, so the two are checked against each other.
"""

from __future__ import annotations

FLIGHTS = """
flights AS (
  SELECT
    concat(lpad(cast(day(l_shipdate) AS VARCHAR), 2, '0'), '-',
           lpad(cast(month(l_shipdate) AS VARCHAR), 2, '0'), '-',
           cast(year(l_shipdate) AS VARCHAR)) AS Date,
    cast(1 + l_orderkey % 7 AS INTEGER) AS DayOfWeek,
    cast(CASE WHEN l_orderkey % 101 = 0 THEN NULL
              ELSE ((l_orderkey + l_linenumber) % 25) * 100 + l_partkey % 60 END AS INTEGER) AS DepTime,
    cast(((l_orderkey + 5) % 24) * 100 + l_suppkey % 60 AS INTEGER) AS ArrTime,
    cast(((l_orderkey + 3) % 24) * 100 + l_suppkey % 60 AS INTEGER) AS CRSArrTime,
    concat('C', cast(l_suppkey % 12 AS VARCHAR)) AS UniqueCarrier,
    cast(l_orderkey % 9999 AS INTEGER) AS FlightNum,
    CASE WHEN l_orderkey % 103 = 0 THEN NULL ELSE concat('N', cast(s_nationkey AS VARCHAR)) END AS Origin,
    concat('N', cast(c_nationkey AS VARCHAR)) AS Dest,
    cast(100 + ((s_nationkey * 13 + c_nationkey * 29) % 30) * 100
         + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS INTEGER) AS Distance,
    cast(40 + l_partkey % 300 AS INTEGER) AS CRSElapsedTime,
    cast(25 + l_partkey % 300 + l_suppkey % 41 AS INTEGER) AS ActualElapsedTime,
    cast(l_partkey % 300 - 5 AS INTEGER) AS AirTime,
    cast(3 + l_linenumber AS INTEGER) AS TaxiIn,
    cast(5 + l_partkey % 40 AS INTEGER) AS TaxiOut,
    CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_quantity * 4 - 60 END AS DepDelay,
    CASE WHEN l_orderkey % 89 = 0 THEN NULL
         ELSE l_quantity * 4 - 60 + l_linenumber * 3 + s_nationkey % 5 END AS ArrDelay,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1 ELSE 0 END AS Cancelled,
    CASE WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 1 ELSE 0 END AS Diverted,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'A' END AS CancellationCode,
    cast(l_linenumber AS INTEGER) AS CarrierDelay,
    cast(l_suppkey % 3 AS INTEGER) AS WeatherDelay,
    cast(l_partkey % 7 AS INTEGER) AS NASDelay,
    cast(0 AS INTEGER) AS SecurityDelay,
    cast(l_orderkey % 11 AS INTEGER) AS LateAircraftDelay
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey
)"""

# exploration table: status filter, DepHour, listed columns as double, non-null delays
EDA = """
eda AS (
  SELECT Date,
    cast(DayOfWeek AS DOUBLE) AS DayOfWeek, cast(DepTime AS DOUBLE) AS DepTime,
    cast(ArrTime AS DOUBLE) AS ArrTime, cast(CRSArrTime AS DOUBLE) AS CRSArrTime,
    UniqueCarrier, FlightNum, Origin, Dest,
    cast(Distance AS DOUBLE) AS Distance, cast(CRSElapsedTime AS DOUBLE) AS CRSElapsedTime,
    cast(ActualElapsedTime AS DOUBLE) AS ActualElapsedTime, cast(AirTime AS DOUBLE) AS AirTime,
    cast(TaxiIn AS DOUBLE) AS TaxiIn, cast(TaxiOut AS DOUBLE) AS TaxiOut,
    cast(DepDelay AS DOUBLE) AS DepDelay, cast(ArrDelay AS DOUBLE) AS ArrDelay,
    CancellationCode,
    cast(CarrierDelay AS DOUBLE) AS CarrierDelay, cast(WeatherDelay AS DOUBLE) AS WeatherDelay,
    cast(NASDelay AS DOUBLE) AS NASDelay, cast(SecurityDelay AS DOUBLE) AS SecurityDelay,
    cast(LateAircraftDelay AS DOUBLE) AS LateAircraftDelay,
    cast(floor(DepTime / 100) AS INTEGER) AS DepHour
  FROM flights
  WHERE Cancelled = 0 AND Diverted = 0 AND ArrDelay IS NOT NULL AND DepDelay IS NOT NULL
)"""

# derived columns without any null drop (status filter only)
DERIVED = """
derived AS (
  SELECT Date AS DateText,
    try_strptime(Date, '%d-%m-%Y')::DATE AS Date,
    DayOfWeek, DepTime, ArrTime, CRSArrTime, UniqueCarrier, FlightNum, Origin, Dest,
    Distance, CRSElapsedTime, ActualElapsedTime, AirTime, TaxiIn, TaxiOut,
    cast(DepDelay AS DOUBLE) AS DepDelay, cast(ArrDelay AS DOUBLE) AS ArrDelay,
    CancellationCode, CarrierDelay, WeatherDelay, NASDelay, SecurityDelay, LateAircraftDelay,
    cast(month(try_strptime(Date, '%d-%m-%Y')) AS INTEGER) AS Month,
    cast(day(try_strptime(Date, '%d-%m-%Y')) AS INTEGER) AS Day,
    cast(floor(DepTime / 100) AS INTEGER) AS DepHour,
    cast(floor(ArrTime / 100) AS INTEGER) AS ArrHour,
    CASE WHEN DayOfWeek IN (6, 7) THEN 1 ELSE 0 END AS IsWeekend,
    TaxiIn + TaxiOut AS TaxiTotal,
    CRSElapsedTime AS ScheduledFlightTime,
    ActualElapsedTime AS ActualFlightTime,
    ActualElapsedTime - CRSElapsedTime AS FlightTimeDiff,
    cast(floor(CRSArrTime / 100) AS BIGINT) AS CRSArrHour,
    CASE WHEN floor(DepTime / 100) BETWEEN 6 AND 11 THEN 'Morning'
         WHEN floor(DepTime / 100) BETWEEN 12 AND 17 THEN 'Afternoon'
         WHEN floor(DepTime / 100) BETWEEN 18 AND 21 THEN 'Evening'
         ELSE 'Night' END AS TimeOfDay,
    CASE WHEN Distance < 500 THEN 'Short'
         WHEN Distance BETWEEN 500 AND 1500 THEN 'Medium'
         ELSE 'Long' END AS DistanceCategory,
    concat_ws('-', Origin, Dest) AS Route
  FROM flights
  WHERE Cancelled = 0 AND Diverted = 0
)"""

REG = """
reg AS (
  SELECT * EXCLUDE (DateText) FROM derived
  WHERE ArrDelay IS NOT NULL AND DepDelay IS NOT NULL
    AND UniqueCarrier IS NOT NULL AND Origin IS NOT NULL AND Dest IS NOT NULL
)"""


def stats_ctes(base: str) -> str:
    return f"""
s_carrier AS (SELECT UniqueCarrier, avg(ArrDelay) AS AvgCarrierDelay,
                     count(*) AS CarrierFlightCount FROM {base} GROUP BY UniqueCarrier),
s_hour AS (SELECT DepHour, avg(ArrDelay) AS AvgHourDelay FROM {base} GROUP BY DepHour),
s_route AS (SELECT Route, avg(ArrDelay) AS AvgRouteDelay,
                   count(*) AS RouteFlightCount FROM {base} GROUP BY Route),
s_origin AS (SELECT Origin, avg(ArrDelay) AS AvgOriginDelay FROM {base} GROUP BY Origin),
s_dest AS (SELECT Dest, avg(ArrDelay) AS AvgDestDelay FROM {base} GROUP BY Dest),
s_ch AS (SELECT UniqueCarrier, DepHour, avg(ArrDelay) AS AvgCarrierHourDelay
         FROM {base} GROUP BY UniqueCarrier, DepHour)"""


def enriched_cte(base: str, name: str = "enriched") -> str:
    return f"""
{name} AS (
  SELECT b.*, 
    coalesce(c.AvgCarrierDelay, 0.0) AS AvgCarrierDelay, c.CarrierFlightCount,
    coalesce(h.AvgHourDelay, 0.0) AS AvgHourDelay,
    coalesce(r.AvgRouteDelay, 0.0) AS AvgRouteDelay, r.RouteFlightCount,
    coalesce(o.AvgOriginDelay, 0.0) AS AvgOriginDelay,
    coalesce(d.AvgDestDelay, 0.0) AS AvgDestDelay,
    coalesce(ch.AvgCarrierHourDelay, 0.0) AS AvgCarrierHourDelay,
    CASE WHEN b.DepHour BETWEEN 6 AND 9 OR b.DepHour BETWEEN 17 AND 20 THEN 1 ELSE 0 END AS IsRushHour
  FROM {base} b
  LEFT JOIN s_carrier c ON b.UniqueCarrier = c.UniqueCarrier
  LEFT JOIN s_hour h ON b.DepHour = h.DepHour
  LEFT JOIN s_route r ON b.Route = r.Route
  LEFT JOIN s_origin o ON b.Origin = o.Origin
  LEFT JOIN s_dest d ON b.Dest = d.Dest
  LEFT JOIN s_ch ch ON b.UniqueCarrier = ch.UniqueCarrier AND b.DepHour = ch.DepHour
)"""


# classification table: statistics over the status-filtered rows (null
# delays included), labels, then the late null drop
CLS = """
cls_base AS (SELECT * EXCLUDE (DateText) FROM derived),
""" + stats_ctes("cls_base").lstrip("\n") + "," + enriched_cte("cls_base", "cls_enriched") + """,
cls AS (
  SELECT *, CASE WHEN ArrDelay > 30 THEN 1 ELSE 0 END AS DelayOver30,
            CASE WHEN ArrDelay > 60 THEN 1 ELSE 0 END AS DelayOver60
  FROM cls_enriched
  WHERE ArrDelay IS NOT NULL AND UniqueCarrier IS NOT NULL AND Origin IS NOT NULL AND Dest IS NOT NULL
)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


BASE = with_ctes(FLIGHTS, EDA, DERIVED, REG)
ENRICHED = with_ctes(FLIGHTS, DERIVED, REG, stats_ctes("reg"), enriched_cte("reg"))
CLASSIFICATION = with_ctes(FLIGHTS, DERIVED, CLS)

ORACLE: dict[str, str] = {}

_EDA_NUMERIC = ["DayOfWeek", "DepTime", "ArrTime", "CRSArrTime", "Distance", "CRSElapsedTime",
                "ActualElapsedTime", "AirTime", "TaxiIn", "TaxiOut", "DepDelay", "ArrDelay",
                "DepHour"]

ORACLE["project"] = BASE + "SELECT UniqueCarrier, Origin, Dest, ArrDelay FROM flights"
ORACLE["project_existing"] = BASE + "SELECT ArrDelay, DepDelay, Distance, ActualElapsedTime FROM eda"
ORACLE["numeric_columns"] = BASE + f"SELECT {', '.join(_EDA_NUMERIC)} FROM eda"
ORACLE["cast_numeric"] = BASE + """
SELECT Date, cast(DayOfWeek AS DOUBLE) AS DayOfWeek, cast(DepTime AS DOUBLE) AS DepTime,
  cast(ArrTime AS DOUBLE) AS ArrTime, cast(CRSArrTime AS DOUBLE) AS CRSArrTime,
  UniqueCarrier, FlightNum, Origin, Dest,
  cast(Distance AS DOUBLE) AS Distance, cast(CRSElapsedTime AS DOUBLE) AS CRSElapsedTime,
  cast(ActualElapsedTime AS DOUBLE) AS ActualElapsedTime, cast(AirTime AS DOUBLE) AS AirTime,
  cast(TaxiIn AS DOUBLE) AS TaxiIn, cast(TaxiOut AS DOUBLE) AS TaxiOut,
  cast(DepDelay AS DOUBLE) AS DepDelay, cast(ArrDelay AS DOUBLE) AS ArrDelay, CancellationCode,
  cast(CarrierDelay AS DOUBLE) AS CarrierDelay, cast(WeatherDelay AS DOUBLE) AS WeatherDelay,
  cast(NASDelay AS DOUBLE) AS NASDelay, cast(SecurityDelay AS DOUBLE) AS SecurityDelay,
  cast(LateAircraftDelay AS DOUBLE) AS LateAircraftDelay
FROM flights WHERE Cancelled = 0 AND Diverted = 0"""
ORACLE["clean_flights"] = BASE + """
SELECT * EXCLUDE (Cancelled, Diverted) FROM flights WHERE Cancelled = 0 AND Diverted = 0"""
ORACLE["clean_eda"] = BASE + "SELECT * FROM eda"
ORACLE["clean_regression"] = BASE + "SELECT * REPLACE (cast(Date AS VARCHAR) AS Date) FROM reg"
ORACLE["clean_classification"] = CLASSIFICATION + "SELECT * REPLACE (cast(Date AS VARCHAR) AS Date) FROM cls"
ORACLE["row_counts"] = BASE + """
SELECT count(*) AS n_raw,
  count(*) FILTER (WHERE Cancelled = 0 AND Diverted = 0) AS n_operated,
  count(*) FILTER (WHERE Cancelled = 0 AND Diverted = 0 AND ArrDelay IS NOT NULL
                   AND DepDelay IS NOT NULL) AS n_eda,
  count(*) FILTER (WHERE Cancelled = 0 AND Diverted = 0 AND ArrDelay IS NOT NULL
                   AND DepDelay IS NOT NULL AND UniqueCarrier IS NOT NULL
                   AND Origin IS NOT NULL AND Dest IS NOT NULL) AS n_regression,
  count(*) FILTER (WHERE Cancelled = 0 AND Diverted = 0 AND ArrDelay IS NOT NULL
                   AND UniqueCarrier IS NOT NULL AND Origin IS NOT NULL
                   AND Dest IS NOT NULL) AS n_classification
FROM flights"""
ORACLE["range_filter"] = BASE + "SELECT UniqueCarrier, ArrDelay FROM eda WHERE ArrDelay BETWEEN -60 AND 180"
ORACLE["derive_features"] = BASE + """
SELECT DepTime, ArrTime, CRSArrTime, DepHour, ArrHour, CRSArrHour, IsWeekend, TaxiTotal,
  ScheduledFlightTime, ActualFlightTime, FlightTimeDiff FROM derived"""
ORACLE["calendar_parts"] = BASE + """
SELECT Date AS DateText, cast(try_strptime(Date, '%d-%m-%Y')::DATE AS VARCHAR) AS Date,
  cast(month(try_strptime(Date, '%d-%m-%Y')) AS INTEGER) AS Month,
  cast(day(try_strptime(Date, '%d-%m-%Y')) AS INTEGER) AS Day
FROM flights"""
ORACLE["time_of_day"] = BASE + """
SELECT DepHour,
  CASE WHEN DepHour BETWEEN 6 AND 11 THEN 'Morning' WHEN DepHour BETWEEN 12 AND 17 THEN 'Afternoon'
       WHEN DepHour BETWEEN 18 AND 21 THEN 'Evening' ELSE 'Night' END AS TimeOfDay,
  CASE WHEN DepHour BETWEEN 6 AND 9 OR DepHour BETWEEN 17 AND 20 THEN 1 ELSE 0 END AS IsRushHour,
  CASE WHEN DayOfWeek IN (6, 7) THEN 1 ELSE 0 END AS IsWeekend
FROM (SELECT cast(floor(DepTime / 100) AS INTEGER) AS DepHour, DayOfWeek FROM flights)"""
ORACLE["distance_band"] = BASE + """
SELECT Distance, CASE WHEN Distance < 500 THEN 'Short' WHEN Distance BETWEEN 500 AND 1500 THEN 'Medium'
  ELSE 'Long' END AS DistanceCategory FROM flights"""
ORACLE["route_key"] = BASE + """
SELECT Origin, Dest, concat_ws('-', Origin, Dest) AS Route, Origin || '-' || Dest AS RouteStrict
FROM flights"""
ORACLE["speed"] = BASE + """
SELECT Distance, Distance / (AirTime / 60) AS Speed_MPH, UniqueCarrier FROM eda WHERE AirTime > 0"""
ORACLE["delay_labels"] = BASE + """
SELECT ArrDelay, CASE WHEN ArrDelay > 30 THEN 1 ELSE 0 END AS DelayOver30,
  CASE WHEN ArrDelay > 60 THEN 1 ELSE 0 END AS DelayOver60
FROM flights WHERE Cancelled = 0 AND Diverted = 0"""

_STAT_SQL = {
    "carrier_stats": "SELECT UniqueCarrier, avg(ArrDelay) AS AvgCarrierDelay, count(*) AS CarrierFlightCount FROM reg GROUP BY UniqueCarrier",
    "hour_stats": "SELECT DepHour, avg(ArrDelay) AS AvgHourDelay FROM reg GROUP BY DepHour",
    "route_stats": "SELECT Route, avg(ArrDelay) AS AvgRouteDelay, count(*) AS RouteFlightCount FROM reg GROUP BY Route",
    "origin_stats": "SELECT Origin, avg(ArrDelay) AS AvgOriginDelay FROM reg GROUP BY Origin",
    "dest_stats": "SELECT Dest, avg(ArrDelay) AS AvgDestDelay FROM reg GROUP BY Dest",
    "carrier_hour_stats": "SELECT UniqueCarrier, DepHour, avg(ArrDelay) AS AvgCarrierHourDelay FROM reg GROUP BY UniqueCarrier, DepHour",
}
for _k, _v in _STAT_SQL.items():
    ORACLE[_k] = BASE + _v

ORACLE["all_stats_grouping_sets"] = BASE + """
SELECT UniqueCarrier, DepHour, Route, Origin, Dest,
  avg(ArrDelay) AS AvgDelay, count(*) AS FlightCount,
  CASE WHEN grouping(UniqueCarrier) = 0 AND grouping(DepHour) = 0 THEN 'carrier_hour_stats'
       WHEN grouping(UniqueCarrier) = 0 THEN 'carrier_stats'
       WHEN grouping(DepHour) = 0 THEN 'hour_stats'
       WHEN grouping(Route) = 0 THEN 'route_stats'
       WHEN grouping(Origin) = 0 THEN 'origin_stats'
       ELSE 'dest_stats' END AS level
FROM reg
GROUP BY GROUPING SETS ((UniqueCarrier), (DepHour), (Route), (Origin), (Dest), (UniqueCarrier, DepHour))"""

_ENRICH_SQL = {
    "enrich_carrier": ("s_carrier", "b.UniqueCarrier = s.UniqueCarrier", "s.AvgCarrierDelay, s.CarrierFlightCount"),
    "enrich_hour": ("s_hour", "b.DepHour = s.DepHour", "s.AvgHourDelay"),
    "enrich_route": ("s_route", "b.Route = s.Route", "s.AvgRouteDelay, s.RouteFlightCount"),
    "enrich_origin": ("s_origin", "b.Origin = s.Origin", "s.AvgOriginDelay"),
    "enrich_dest": ("s_dest", "b.Dest = s.Dest", "s.AvgDestDelay"),
    "enrich_carrier_hour": ("s_ch", "b.UniqueCarrier = s.UniqueCarrier AND b.DepHour = s.DepHour",
                            "s.AvgCarrierHourDelay"),
}
for _k, (_t, _on, _cols) in _ENRICH_SQL.items():
    ORACLE[_k] = ENRICHED + f"""
SELECT b.Origin, b.Dest, b.UniqueCarrier, b.DepHour, b.ArrDelay, {_cols}
FROM reg b LEFT JOIN {_t} s ON {_on}"""

ORACLE["enriched_flights"] = ENRICHED + "SELECT * REPLACE (cast(Date AS VARCHAR) AS Date) FROM enriched"
ORACLE["route_distances"] = BASE + """
SELECT Origin, Dest, min(Distance) AS Distance FROM flights
WHERE Origin IS NOT NULL AND Dest IS NOT NULL AND Distance IS NOT NULL GROUP BY Origin, Dest"""
ORACLE["distinct_routes"] = BASE + """
SELECT DISTINCT Origin, Dest, Distance FROM flights
WHERE Origin IS NOT NULL AND Dest IS NOT NULL AND Distance IS NOT NULL"""

ORACLE["delay_by_carrier"] = BASE + "SELECT UniqueCarrier, avg(ArrDelay) AS AvgDelay FROM eda GROUP BY UniqueCarrier"
ORACLE["delay_by_hour"] = BASE + "SELECT DepHour, avg(ArrDelay) AS AvgDelay FROM eda GROUP BY DepHour"
ORACLE["delay_by_day"] = BASE + "SELECT DayOfWeek, avg(ArrDelay) AS AvgDelay FROM eda GROUP BY DayOfWeek"
ORACLE["delay_by_day_named"] = BASE + """
SELECT DayOfWeek, avg(ArrDelay) AS AvgDelay,
  CASE cast(DayOfWeek AS INTEGER) WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed'
    WHEN 4 THEN 'Thu' WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' WHEN 7 THEN 'Sun' END AS DayName
FROM eda GROUP BY DayOfWeek"""
ORACLE["delay_day_hour"] = BASE + """
SELECT DayOfWeek, DepHour, avg(ArrDelay) AS AvgDelay FROM eda GROUP BY DayOfWeek, DepHour"""
ORACLE["pivot_day_hour"] = BASE + "SELECT DayOfWeek, " + ", ".join(
    f"avg(CASE WHEN DepHour = {h} THEN ArrDelay END) AS h{h}" for h in range(25)
) + """, avg(CASE WHEN DepHour IS NULL THEN ArrDelay END) AS h_null,
  avg(CASE WHEN DepHour < 0 OR DepHour > 24 THEN ArrDelay END) AS h_other FROM eda GROUP BY DayOfWeek"""
ORACLE["top_routes"] = BASE + """
SELECT Route, avg(ArrDelay) AS AvgDelay, count(*) AS FlightCount
FROM (SELECT Origin || '-' || Dest AS Route, ArrDelay FROM eda)
GROUP BY Route HAVING count(*) > 50
ORDER BY AvgDelay DESC, Route ASC NULLS FIRST LIMIT 10"""
ORACLE["top_taxi_out"] = BASE + """
SELECT Origin, avg(TaxiOut) AS AvgTaxiOut, count(*) AS FlightCount FROM eda
GROUP BY Origin HAVING count(*) > 1000
ORDER BY AvgTaxiOut DESC, Origin ASC NULLS FIRST LIMIT 20"""
ORACLE["label_balance"] = CLASSIFICATION + " UNION ALL ".join(
    f"SELECT '{lab}' AS label, {v} AS value, cast(count(*) FILTER (WHERE {lab} = {v}) AS BIGINT) AS count FROM cls"
    for lab in ("DelayOver30", "DelayOver60") for v in (0, 1))


def _summary_sql(cols):
    parts = []
    for c in cols:
        x = f"cast({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column, count({x}) AS count, avg({x}) AS mean, "
            f"round(stddev_samp({x}), 6) AS stddev, min({x}) AS min, "
            f"quantile_disc({x}, 0.25) AS p25, quantile_disc({x}, 0.5) AS p50, "
            f"quantile_disc({x}, 0.75) AS p75, max({x}) AS max FROM eda")
    return " UNION ALL ".join(parts)


ORACLE["summary_stats"] = BASE + _summary_sql(["ArrDelay", "DepDelay", "Distance", "ActualElapsedTime"])
_PAIRS = [(a, b) for a in _EDA_NUMERIC for b in _EDA_NUMERIC]
ORACLE["correlation_matrix"] = BASE + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({b}, {a}), 6) AS corr FROM eda" for a, b in _PAIRS)
ORACLE["speed_trend"] = BASE + """
SELECT round(regr_slope(s, d), 6) AS slope, round(regr_intercept(s, d), 6) AS intercept,
  round(regr_r2(s, d), 6) AS r2, cast(regr_count(s, d) AS BIGINT) AS n
FROM (SELECT Distance AS d, Distance / (AirTime / 60) AS s FROM eda WHERE AirTime > 0)"""
ORACLE["value_range"] = BASE + """
SELECT min(ArrDelay) AS min_ArrDelay, max(ArrDelay) AS max_ArrDelay,
  min(DepDelay) AS min_DepDelay, max(DepDelay) AS max_DepDelay FROM eda"""
ORACLE["late_share"] = BASE + """
SELECT round(avg(CASE WHEN ArrDelay > 15 THEN cast(1 AS DOUBLE) ELSE cast(0 AS DOUBLE) END), 9) AS late_share,
  count(*) AS n FROM eda"""
ORACLE["union_tagged"] = BASE + """
SELECT 'origin' AS tag, Origin AS airport, avg(ArrDelay) AS AvgDelay, count(*) AS FlightCount
FROM reg GROUP BY Origin
UNION ALL
SELECT 'dest' AS tag, Dest AS airport, avg(ArrDelay) AS AvgDelay, count(*) AS FlightCount
FROM reg GROUP BY Dest"""


def _hist_sql(values_sql: str, bins: int) -> str:
    return f"""
, v AS ({values_sql}),
r AS (SELECT variable, min(x) AS lo, max(x) AS hi FROM v GROUP BY variable),
b AS (SELECT v.variable,
        cast(least(coalesce(floor((x - lo) / ((hi - lo) / {bins})), 0), {bins - 1}) AS INTEGER) AS bin
      FROM v JOIN r ON v.variable = r.variable),
c AS (SELECT variable, bin, count(*) AS cnt FROM b GROUP BY variable, bin),
g AS (SELECT variable, cast(range AS INTEGER) AS bin, lo, hi FROM r, range({bins})),
h AS (SELECT g.variable, g.bin, lo + g.bin * ((hi - lo) / {bins}) AS bin_lo,
        lo + (g.bin + 1) * ((hi - lo) / {bins}) AS bin_hi, coalesce(cnt, 0) AS count
      FROM g LEFT JOIN c ON g.variable = c.variable AND g.bin = c.bin)
"""


ORACLE["histogram"] = BASE.rstrip("\n") + _hist_sql(
    "SELECT 'ArrDelay' AS variable, ArrDelay AS x FROM eda WHERE ArrDelay IS NOT NULL "
    "UNION ALL SELECT 'DepDelay', DepDelay FROM eda WHERE DepDelay IS NOT NULL", 50) + "SELECT * FROM h"
ORACLE["density_histogram"] = BASE.rstrip("\n") + _hist_sql(
    "SELECT 'ArrDelay' AS variable, ArrDelay AS x FROM eda WHERE ArrDelay BETWEEN -60 AND 180", 100) + """
SELECT h.*, round(count / ((SELECT count(*) FROM v) * (bin_hi - bin_lo)), 9) AS density FROM h"""

import math as _math

ORACLE["kde_curve"] = BASE.rstrip("\n") + f"""
, v AS (SELECT ArrDelay AS x FROM eda WHERE ArrDelay IS NOT NULL),
st AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, stddev_samp(x) AS sd FROM v),
p AS (SELECT lo, hi, n, sd * pow(cast(n AS DOUBLE), -0.2) AS bw, (hi - lo) / 99 AS step FROM st),
d AS (SELECT x, count(*) AS c FROM v GROUP BY x),
g AS (SELECT cast(range AS INTEGER) AS point, lo + range * step AS gx FROM p, range(100))
SELECT point, round(gx, 6) AS x,
  round(sum(c * exp(-0.5 * ((gx - x) / bw) * ((gx - x) / bw))) / (n * bw * cast('{_math.sqrt(2 * _math.pi)!r}' AS DOUBLE)), 9) AS density
FROM g, d, p GROUP BY point, gx, n, bw"""


def _box_sql(where: str, group: str | None) -> str:
    gsel = f"{group}, " if group else ""
    gby = f"GROUP BY {group}" if group else ""
    join = f"JOIN f ON v.{group} = f.{group}" if group else ", f"
    gkeys = f"f.{group}, " if group else ""
    return BASE.rstrip("\n") + f"""
, v AS (SELECT {gsel}ArrDelay AS x FROM eda WHERE ArrDelay IS NOT NULL {where}),
q AS (SELECT {gsel}quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
        quantile_cont(x, 0.75) AS q3, count(*) AS n FROM v {gby}),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS fence_lo, q3 + 1.5 * (q3 - q1) AS fence_hi FROM q)
SELECT {gkeys}q1, median, q3, iqr, n,
  min(x) FILTER (WHERE x BETWEEN fence_lo AND fence_hi) AS whisker_lo,
  max(x) FILTER (WHERE x BETWEEN fence_lo AND fence_hi) AS whisker_hi,
  count(*) FILTER (WHERE NOT (x BETWEEN fence_lo AND fence_hi)) AS outliers
FROM v {join}
GROUP BY {gkeys}q1, median, q3, iqr, n"""


ORACLE["box_stats"] = _box_sql("", None)
ORACLE["box_stats_by_carrier"] = _box_sql("AND ArrDelay BETWEEN -30 AND 180", "UniqueCarrier")

# ---------------------------------------------------------------- serving
REQUESTS = """
evs AS (SELECT event_id, user_id, value, cast(ts AS TIMESTAMP) AS ts FROM events),
strays AS (
  SELECT *, 0 AS k FROM evs
  UNION ALL SELECT *, 1 AS k FROM evs WHERE event_id % 10 = 3
  UNION ALL SELECT *, 2 AS k FROM evs WHERE event_id % 14 = 5
),
requests AS (
  SELECT
    CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 51 = 0 THEN ''
         ELSE 'r' || cast(event_id AS VARCHAR) END AS request_id,
    ts,
    CASE WHEN user_id % 3 = 0 THEN 'B' WHEN user_id % 3 = 1 THEN 'A' END AS model_type,
    CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'C' || cast(user_id % 14 AS VARCHAR) END AS UniqueCarrier,
    'N' || cast(user_id % 25 AS VARCHAR) AS Origin,
    'N' || cast(event_id % 27 AS VARCHAR) AS Dest,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE cast(event_id % 3000 AS INTEGER) END AS Distance,
    CASE WHEN event_id % 8 = 0 THEN NULL ELSE cast(event_id % 24 AS INTEGER) END AS DepHour,
    cast(1 + event_id % 7 AS INTEGER) AS DayOfWeek,
    cast(1 + event_id % 12 AS INTEGER) AS Month,
    cast(15 AS INTEGER) AS Day,
    cast(30 + user_id % 300 AS INTEGER) AS CRSElapsedTime,
    cast((event_id + 3) % 24 AS INTEGER) AS CRSArrHour,
    value - 20 AS DepDelay,
    cast(user_id % 30 AS INTEGER) AS TaxiOut
  FROM evs
),
vreq AS (SELECT * FROM requests WHERE coalesce(length(request_id), 0) > 0),
reg_resp AS (
  SELECT 'r' || cast(event_id AS VARCHAR) AS request_id,
    CASE WHEN k = 2 THEN ts - to_seconds(cast(2 AS BIGINT)) ELSE
      ts + to_seconds(cast(event_id % 13 + CASE WHEN event_id % 4 = 1 THEN 3600 ELSE 0 END
                           + CASE WHEN k = 1 THEN event_id % 3 ELSE 0 END AS BIGINT)) END AS ts,
    value + 100 * k AS predicted_delay_minutes,
    CASE WHEN user_id % 3 = 0 THEN 'B' ELSE 'A' END AS model_type,
    CASE WHEN event_id % 20 = 0 THEN 'error' ELSE 'success' END AS status,
    CASE WHEN event_id % 20 = 0 THEN 'invalid feature value' END AS error
  FROM strays
),
cls_resp AS (
  SELECT 'r' || cast(event_id AS VARCHAR) AS request_id,
    CASE WHEN k = 2 THEN ts - to_seconds(cast(2 AS BIGINT)) ELSE
      ts + to_seconds(cast(event_id % 12 + CASE WHEN event_id % 6 = 1 THEN 3600 ELSE 0 END
                           + CASE WHEN k = 1 THEN event_id % 3 ELSE 0 END AS BIGINT)) END AS ts,
    cast(event_id % 1000 AS DOUBLE) / 10 AS probability_over_30min,
    cast((event_id + k) % 700 AS DOUBLE) / 10 AS probability_over_60min,
    'success' AS status, cast(NULL AS VARCHAR) AS error
  FROM strays
),
reg_first AS (
  SELECT r.*, row_number() OVER (PARTITION BY q.request_id ORDER BY r.ts, r.status, r.error NULLS FIRST,
                                 r.model_type, r.predicted_delay_minutes) AS place
  FROM vreq q JOIN reg_resp r ON r.request_id = q.request_id
       AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 10 SECOND),
cls_first AS (
  SELECT c.*, row_number() OVER (PARTITION BY q.request_id ORDER BY c.ts, c.status, c.error NULLS FIRST,
                                 c.probability_over_30min, c.probability_over_60min) AS place
  FROM vreq q JOIN cls_resp c ON c.request_id = q.request_id
       AND c.ts >= q.ts AND c.ts <= q.ts + INTERVAL 10 SECOND),
merged AS (
  SELECT q.request_id,
    CASE WHEN r.status IS NOT NULL AND c.status IS NOT NULL THEN 'success'
         WHEN r.status IS NOT NULL OR c.status IS NOT NULL THEN 'partial' ELSE 'timeout' END AS status,
    r.status AS regression_status, r.error AS regression_error, r.model_type AS regression_model_type,
    r.predicted_delay_minutes, c.status AS classification_status, c.error AS classification_error,
    c.probability_over_30min, c.probability_over_60min
  FROM vreq q
  LEFT JOIN reg_first r ON q.request_id = r.request_id AND r.place = 1
  LEFT JOIN cls_first c ON q.request_id = c.request_id AND c.place = 1
),
form AS (
  SELECT 'r' || cast(event_id AS VARCHAR) AS request_id,
    lpad(cast(event_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(cast(user_id % 60 AS VARCHAR), 2, '0') AS dep_time,
    CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN cast(30 + user_id % 300 AS VARCHAR) || 'abc'
         WHEN event_id % 23 = 0 THEN '0' ELSE cast(30 + user_id % 300 AS VARCHAR) END AS duration_text,
    CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN ' ' || cast(event_id % 3000 AS VARCHAR)
         ELSE cast(event_id % 3000 AS VARCHAR) END AS distance_text,
    cast(cast(floor(value - 20) AS BIGINT) AS VARCHAR) AS dep_delay_text,
    cast(user_id % 30 AS VARCHAR) AS taxi_out_text
  FROM evs
)"""


def _parse_or(text: str, d: int) -> str:
    lead = f"regexp_extract({text}, '^\\s*([+-]?[0-9]+)', 1)"
    return f"coalesce(nullif(CASE WHEN {lead} <> '' THEN try_cast({lead} AS INTEGER) END, 0), {d})"


FORM_REQ = f"""
form_req AS (
  SELECT request_id,
    try_cast(split_part(dep_time, ':', 1) AS INTEGER) AS DepHour,
    try_cast(split_part(dep_time, ':', 2) AS INTEGER) AS DepMinute,
    {_parse_or('duration_text', 120)} AS CRSElapsedTime,
    {_parse_or('distance_text', 1000)} AS Distance,
    {_parse_or('dep_delay_text', 0)} AS DepDelay,
    {_parse_or('taxi_out_text', 15)} AS TaxiOut,
    15 AS Day
  FROM form
)"""

SERVE = with_ctes(FLIGHTS, DERIVED, REG, stats_ctes("reg"), REQUESTS, FORM_REQ)

ORACLE["valid_requests"] = SERVE + "SELECT * EXCLUDE (ts) FROM vreq"
ORACLE["request_features"] = SERVE + """
SELECT v.request_id, coalesce(v.model_type, 'A') AS model_type,
  coalesce(v.UniqueCarrier, 'WN') AS UniqueCarrier, coalesce(v.Origin, 'ORD') AS Origin,
  coalesce(v.Dest, 'LAX') AS Dest,
  CASE WHEN coalesce(v.DepHour, 12) BETWEEN 6 AND 11 THEN 'Morning'
       WHEN coalesce(v.DepHour, 12) BETWEEN 12 AND 17 THEN 'Afternoon'
       WHEN coalesce(v.DepHour, 12) BETWEEN 18 AND 21 THEN 'Evening' ELSE 'Night' END AS TimeOfDay,
  CASE WHEN coalesce(v.Distance, 1000) < 500 THEN 'Short'
       WHEN coalesce(v.Distance, 1000) BETWEEN 500 AND 1500 THEN 'Medium' ELSE 'Long' END AS DistanceCategory,
  coalesce(v.DayOfWeek, 1) AS DayOfWeek, coalesce(v.Month, 1) AS Month, coalesce(v.Day, 15) AS Day,
  coalesce(v.DepHour, 12) AS DepHour,
  CASE WHEN v.DayOfWeek IN (6, 7) THEN 1 ELSE 0 END AS IsWeekend,
  CASE WHEN coalesce(v.DepHour, 12) BETWEEN 6 AND 9 OR coalesce(v.DepHour, 12) BETWEEN 17 AND 20
       THEN 1 ELSE 0 END AS IsRushHour,
  coalesce(v.Distance, 1000) AS Distance, coalesce(v.CRSElapsedTime, 120) AS CRSElapsedTime,
  cast(coalesce(v.CRSArrHour, 14) AS BIGINT) AS CRSArrHour,
  coalesce(c.AvgCarrierDelay, 60.0) AS AvgCarrierDelay, coalesce(h.AvgHourDelay, 55.0) AS AvgHourDelay,
  coalesce(r.AvgRouteDelay, 58.0) AS AvgRouteDelay, coalesce(o.AvgOriginDelay, 57.0) AS AvgOriginDelay,
  coalesce(d.AvgDestDelay, 57.0) AS AvgDestDelay, coalesce(ch.AvgCarrierHourDelay, 58.0) AS AvgCarrierHourDelay,
  cast(10000 AS BIGINT) AS CarrierFlightCount, cast(5000 AS BIGINT) AS RouteFlightCount,
  cast(coalesce(v.DepDelay, 0.0) AS DOUBLE) AS DepDelay, coalesce(v.TaxiOut, 15) AS TaxiOut
FROM vreq v
LEFT JOIN s_carrier c ON v.UniqueCarrier = c.UniqueCarrier
LEFT JOIN s_hour h ON v.DepHour = h.DepHour
LEFT JOIN s_route r ON v.Origin || '-' || v.Dest = r.Route
LEFT JOIN s_origin o ON v.Origin = o.Origin
LEFT JOIN s_dest d ON v.Dest = d.Dest
LEFT JOIN s_ch ch ON v.UniqueCarrier = ch.UniqueCarrier AND v.DepHour = ch.DepHour"""
ORACLE["distance_lookup"] = SERVE + """
, rd AS (SELECT Origin, Dest, min(Distance) AS Distance FROM flights
         WHERE Origin IS NOT NULL AND Dest IS NOT NULL AND Distance IS NOT NULL GROUP BY Origin, Dest),
x AS (SELECT v.request_id, v.Origin, v.Dest, coalesce(f.Distance, b.Distance) AS dd
      FROM vreq v LEFT JOIN rd f ON f.Origin = v.Origin AND f.Dest = v.Dest
                  LEFT JOIN rd b ON b.Origin = v.Dest AND b.Dest = v.Origin)
SELECT request_id, Origin, Dest, coalesce(dd IS NOT NULL AND dd <> 0, false) AS found,
  CASE WHEN dd IS NOT NULL AND dd <> 0 THEN dd ELSE 1000 END AS distance FROM x"""
ORACLE["request_response_join"] = SERVE + """
SELECT request_id, CASE WHEN regression_status IS NOT NULL THEN 'success' ELSE 'timeout' END AS status,
  regression_status, regression_error, regression_model_type, predicted_delay_minutes FROM merged"""
ORACLE["classification_response_join"] = SERVE + """
SELECT request_id, CASE WHEN classification_status IS NOT NULL THEN 'success' ELSE 'timeout' END AS status,
  classification_status, classification_error, probability_over_30min, probability_over_60min FROM merged"""
ORACLE["merged_response"] = SERVE + "SELECT * FROM merged"
ORACLE["request_validation"] = SERVE + """
SELECT request_id, UniqueCarrier, Origin, Dest, CRSElapsedTime,
  coalesce(coalesce(length(UniqueCarrier), 0) > 0 AND coalesce(length(Origin), 0) > 0
    AND coalesce(length(Dest), 0) > 0 AND Origin <> Dest AND Distance IS NOT NULL
    AND DepHour IS NOT NULL AND CRSElapsedTime >= 10, false) AS is_valid
FROM requests"""
ORACLE["request_defaults_form"] = SERVE + """
SELECT request_id, DepHour, DepMinute, CRSElapsedTime,
  cast(floor(fmod((DepHour * 60 + DepMinute + CRSElapsedTime) / 60, 24)) AS INTEGER) AS CRSArrHour,
  Distance, DepDelay, TaxiOut, Day FROM form_req"""
ORACLE["arrival_hour"] = SERVE + """
SELECT request_id, DepHour, DepMinute, CRSElapsedTime,
  cast(floor(fmod((DepHour * 60 + DepMinute + CRSElapsedTime) / 60, 24)) AS INTEGER) AS CRSArrHour
FROM form_req"""


def _band_sql(m: str) -> str:
    return f"""CASE WHEN {m} IS NULL THEN NULL WHEN {m} <= 15 THEN 'on_time' WHEN {m} <= 45 THEN 'delayed' ELSE 'critical' END"""


def _risk_sql(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 25 THEN 'low' WHEN {p} < 50 THEN 'medium' ELSE 'high' END"


ORACLE["answer_bands"] = SERVE + f"""
SELECT request_id, status,
  {_band_sql('predicted_delay_minutes')} AS severity,
  CASE WHEN predicted_delay_minutes IS NULL THEN NULL ELSE
    (CASE WHEN predicted_delay_minutes > 0 THEN '+' ELSE '' END)
    || regexp_replace(cast(predicted_delay_minutes AS VARCHAR), '\\.0$', '') || ' min' END AS delay_text,
  {_risk_sql('probability_over_30min')} AS risk_30,
  {_risk_sql('probability_over_60min')} AS risk_60,
  printf('%.1f%%', probability_over_30min) AS p30_text,
  printf('%.1f%%', probability_over_60min) AS p60_text
FROM merged"""


def _half_up(x: str, d: int) -> str:
    # HALF_UP on the shortest decimal text of the double
    return f"cast(round(cast(cast({x} AS VARCHAR) AS DECIMAL(38, 20)), {d}) AS DOUBLE)"


ORACLE["round_outputs"] = SERVE + f"""
SELECT r.request_id, {_half_up('r.predicted_delay_minutes * cast(1.37 AS DOUBLE) - 20', 2)} AS predicted_delay_minutes,
  {_half_up('c.probability_over_30min * cast(0.987 AS DOUBLE)', 1)} AS probability_over_30min,
  {_half_up('c.probability_over_60min * cast(1.013 AS DOUBLE)', 1)} AS probability_over_60min
FROM reg_resp r JOIN cls_resp c ON r.request_id = c.request_id"""
ORACLE["json_requests"] = SERVE + "SELECT * EXCLUDE (ts) FROM vreq"

# ---------------------------------------------------------------- model twins
MODEL = with_ctes(FLIGHTS, DERIVED, REG, stats_ctes("reg"), enriched_cte("reg"),
                  "mt AS (SELECT * REPLACE (coalesce(DepHour, 12) AS DepHour) FROM enriched)")

ORACLE["string_index"] = MODEL + """
, cnt AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS label, count(*) AS count FROM mt GROUP BY {c}"
    for c in ["UniqueCarrier", "Origin", "Dest", "TimeOfDay", "DistanceCategory"]) + """)
SELECT col AS "column", label, count,
  cast(row_number() OVER (PARTITION BY col ORDER BY count DESC, label ASC) - 1 AS DOUBLE) AS index
FROM cnt"""

_NUMS_B = ['DayOfWeek', 'Month', 'Day', 'DepHour', 'IsWeekend', 'IsRushHour', 'Distance', 'CRSElapsedTime', 'CRSArrHour',
           'AvgCarrierDelay', 'AvgHourDelay', 'AvgRouteDelay', 'AvgOriginDelay', 'AvgDestDelay', 'AvgCarrierHourDelay',
           'CarrierFlightCount', 'RouteFlightCount', 'DepDelay', 'TaxiOut']
_SCALE_COLS = _NUMS_B
ORACLE["min_max_scale"] = MODEL + "SELECT " + ", ".join(_SCALE_COLS) + ", " + ", ".join(
    f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 "
    f"ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 9) AS {c}_scaled"
    for c in _SCALE_COLS) + " FROM mt"
ORACLE["standard_scale"] = MODEL + "SELECT " + ", ".join(_SCALE_COLS) + ", " + ", ".join(
    f"round(CASE WHEN stddev_samp({c}) OVER () = 0 THEN 0.0 "
    f"ELSE {c} / stddev_samp({c}) OVER () END, 9) AS {c}_scaled"
    for c in _SCALE_COLS) + " FROM mt"
ORACLE["regression_metrics"] = MODEL + """
, e AS (SELECT ArrDelay AS y, ArrDelay - AvgCarrierHourDelay AS err FROM enriched)
SELECT round(sqrt(sum(err * err) / count(*)), 6) AS rmse, round(sum(abs(err)) / count(*), 6) AS mae,
  round(1 - sum(err * err) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n FROM e"""
ORACLE["residuals"] = MODEL.rstrip("\n") + _hist_sql(
    "SELECT 'Residual' AS variable, ArrDelay - AvgCarrierHourDelay AS x FROM enriched", 50) + "SELECT * FROM h"
_CLS_BASE = with_ctes(FLIGHTS, DERIVED, CLS, """
b AS (SELECT DelayOver30 AS y, AvgCarrierHourDelay AS s,
        CASE WHEN AvgCarrierHourDelay > 30 THEN cast(1 AS DOUBLE) ELSE cast(0 AS DOUBLE) END AS p FROM cls)""")
ORACLE["auc_rank_sum"] = _CLS_BASE + """
, ps AS (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM b GROUP BY s),
r AS (SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM ps)
SELECT round(sum(pos * (nb + neg / cast(2 AS DOUBLE))) / (sum(pos) * sum(neg)), 9) AS auc,
  cast(sum(pos) AS BIGINT) AS positives, cast(sum(neg) AS BIGINT) AS negatives FROM r"""
ORACLE["auc_many_scores"] = with_ctes(FLIGHTS, DERIVED, """
b AS (SELECT CASE WHEN ArrDelay > 30 THEN 1 ELSE 0 END AS y,
        DepDelay + ((cast(FlightNum AS BIGINT) * 7919 + cast(AirTime AS BIGINT) * 104729
          + cast(ActualElapsedTime AS BIGINT) * 1299709 + cast(TaxiOut AS BIGINT) * 15485863) % 1000003)
          / cast(100003 AS DOUBLE) AS s
      FROM derived WHERE ArrDelay IS NOT NULL AND DepDelay IS NOT NULL AND UniqueCarrier IS NOT NULL
        AND Origin IS NOT NULL AND Dest IS NOT NULL)""") + """
, ps AS (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM b GROUP BY s),
r AS (SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM ps)
SELECT round(sum(pos * (nb + neg / cast(2 AS DOUBLE))) / (sum(pos) * sum(neg)), 9) AS auc,
  cast(sum(pos) AS BIGINT) AS positives, cast(sum(neg) AS BIGINT) AS negatives FROM r"""
ORACLE["accuracy"] = _CLS_BASE + """
SELECT round(avg(CASE WHEN cast(y AS DOUBLE) = p THEN cast(1 AS DOUBLE) ELSE cast(0 AS DOUBLE) END), 9) AS accuracy,
  count(*) AS n FROM b"""
ORACLE["stable_split"] = BASE + """
SELECT FlightNum, TaxiOut, AirTime, ArrDelay,
  CASE WHEN ((cast(coalesce(FlightNum, 0) AS BIGINT) + cast(coalesce(TaxiOut, 0) AS BIGINT) * 3
              + cast(coalesce(AirTime, 0) AS BIGINT) * 5) % 10 + 10) % 10 < 8
       THEN 'train' ELSE 'test' END AS split
FROM reg"""

ORACLE["model_input"] = MODEL + """
SELECT UniqueCarrier, Origin, Dest, TimeOfDay, DistanceCategory,
  DayOfWeek, Month, Day, DepHour, IsWeekend, IsRushHour, Distance, CRSElapsedTime, CRSArrHour,
  AvgCarrierDelay, AvgHourDelay, AvgRouteDelay, AvgOriginDelay, AvgDestDelay, AvgCarrierHourDelay,
  CarrierFlightCount, RouteFlightCount, DepDelay, TaxiOut, ArrDelay
FROM enriched"""
ORACLE["null_inputs"] = MODEL + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM enriched" for c in _NUMS_B)

_FOLDED = MODEL + """
, dealt AS (SELECT *, cast(cast('0x' || substr(md5(concat_ws('|', '42', UniqueCarrier, Origin, Dest, TimeOfDay,
    DistanceCategory, cast(Day AS VARCHAR), cast(DepHour AS VARCHAR), cast(Distance AS VARCHAR),
    cast(CRSElapsedTime AS VARCHAR))), 1, 8) AS BIGINT) % 3 AS INTEGER) AS fold FROM mt)
"""
ORACLE["fold_sizes"] = _FOLDED + "SELECT fold, count(*) AS n, round(sum(ArrDelay), 6) AS label_sum FROM dealt GROUP BY fold"


ORACLE["linear_one_input"] = MODEL + """
SELECT round(regr_slope(ArrDelay, DepDelay), 6) AS slope, round(regr_intercept(ArrDelay, DepDelay), 6) AS intercept FROM mt"""


def _stump_sql(model: str, label: str, classes: bool = False) -> str:
    """The flag whose split explains most of the label, and its two means.
    Leaves of one class are joined up again by the classifier."""
    groups = {f: f"(SELECT {f} AS k, count(*) AS n, avg({label}) AS m FROM mt GROUP BY {f})"
              for f in ("IsWeekend", "IsRushHour")}
    gain = {f: f"(SELECT sum(n * m * m) FROM {g})" for f, g in groups.items()}
    mean = {f: f"(SELECT m FROM {g} WHERE k = c.{f})" for f, g in groups.items()}
    if classes:
        mean = {f: f"(CASE WHEN (SELECT count(DISTINCT m > 0.5) FROM {groups[f]}) = 1 "
                   f"THEN (SELECT avg({label}) FROM mt) ELSE {m} END)" for f, m in mean.items()}
    return (f"SELECT '{model}' AS model, IsWeekend, IsRushHour, round(CASE WHEN {gain['IsWeekend']} >= {gain['IsRushHour']} "
            f"THEN {mean['IsWeekend']} ELSE {mean['IsRushHour']} END, 6) AS value FROM cases c")


ORACLE["stump_predictions"] = MODEL + ", cases AS (SELECT DISTINCT IsWeekend, IsRushHour FROM mt)\n" + " UNION ALL ".join(
    _stump_sql(m, y, m == "risk tree") for m, y in (
        ("boosted step", "ArrDelay"), ("forest tree", "ArrDelay"),
        ("risk tree", "CASE WHEN ArrDelay > 30 THEN cast(1 AS DOUBLE) ELSE cast(0 AS DOUBLE) END")))

_NUMS_A = [c for c in _NUMS_B if c not in ("DepDelay", "TaxiOut")]


def _fold_stages_sql() -> str:
    parts = []
    for k in range(3):
        for c in ("UniqueCarrier", "Origin", "Dest", "TimeOfDay", "DistanceCategory"):
            parts.append(f"SELECT {k} AS fold, '{c}' AS input, cast(count(*) AS INTEGER) AS labels, "
                         f"arg_min(v, struct_pack(a := -n, b := v)) AS top, cast(NULL AS DOUBLE) AS low, "
                         f"cast(NULL AS DOUBLE) AS high FROM (SELECT {c} AS v, count(*) AS n FROM dealt "
                         f"WHERE fold <> {k} AND {c} IS NOT NULL GROUP BY {c})")
        for c in _NUMS_A:
            parts.append(f"SELECT {k}, '{c}', NULL, NULL, cast(min({c}) AS DOUBLE), cast(max({c}) AS DOUBLE) "
                         f"FROM dealt WHERE fold <> {k}")
    return " UNION ALL ".join(parts)


ORACLE["fold_stages"] = _FOLDED + _fold_stages_sql()

_KEYED = BASE.rstrip("\n") + """
, numbered AS (SELECT Distance, ArrDelay,
    row_number() OVER (PARTITION BY Distance, ArrDelay) - 1 AS copy FROM eda),
keyed AS (SELECT Distance, ArrDelay, copy, cast('0x' || substr(md5(concat_ws('|', '42',
    coalesce(cast(Distance AS VARCHAR), '~'), coalesce(cast(ArrDelay AS VARCHAR), '~'), cast(copy AS VARCHAR))), 1, 15)
    AS BIGINT) AS key FROM numbered)
"""
ORACLE["sample_capped"] = _KEYED + "SELECT Distance, ArrDelay FROM keyed ORDER BY key, Distance, ArrDelay, copy LIMIT 5000"
ORACLE["sample_keyed"] = _KEYED + f"SELECT Distance, ArrDelay FROM keyed WHERE key < {int(0.1 * 2 ** 60)}"

# stream twins: the replayed streams must give exactly the batch answers
ORACLE["stream_merge_responses"] = ORACLE["merged_response"]
ORACLE["stream_single_response"] = ORACLE["request_response_join"]
ORACLE["stream_single_classification"] = ORACLE["classification_response_join"]
ORACLE["stream_answer_lag"] = SERVE + """
SELECT q.request_id, m.status, round(CASE WHEN m.status = 'success'
    THEN cast(epoch_us(greatest(r.ts, c.ts)) - epoch_us(q.ts) AS DOUBLE) / 1000000 ELSE 10.0 END, 6) AS sent_after
FROM vreq q JOIN merged m ON m.request_id = q.request_id
LEFT JOIN reg_first r ON q.request_id = r.request_id AND r.place = 1
LEFT JOIN cls_first c ON q.request_id = c.request_id AND c.place = 1"""

_CATS = ['UniqueCarrier', 'Origin', 'Dest', 'TimeOfDay', 'DistanceCategory']


def _index_ctes() -> str:
    parts = []
    for c in _CATS:
        parts.append(
            f"i_{c} AS (SELECT {c} AS label, cast(row_number() OVER (ORDER BY count(*) DESC, {c} ASC) - 1 AS INTEGER) AS idx, "
            f"cast(count(*) OVER () AS INTEGER) AS width FROM mt GROUP BY {c})")
    return ",\n".join(parts)


def _joined_index() -> str:
    return " ".join(f"JOIN i_{c} ON mt.{c} = i_{c}.label" for c in _CATS)


ORACLE["one_hot"] = MODEL + ", " + _index_ctes() + "\nSELECT " + ", ".join(
    f"mt.{c}, i_{c}.idx AS {c}Index, i_{c}.width AS {c}Width, i_{c}.idx + 1 AS {c}Hot" for c in _CATS
) + " FROM mt " + _joined_index()
ORACLE["indexed_rows"] = MODEL + ", " + _index_ctes() + "\nSELECT " + ", ".join(
    f"mt.{c}, i_{c}.idx AS {c}Index" for c in _CATS) + " FROM mt " + _joined_index()
ORACLE["assemble"] = MODEL + ", " + _index_ctes() + "\nSELECT " + " + ".join(
    f"i_{c}.width" for c in _CATS) + f" + {len(_NUMS_B)} AS width, {len(_CATS)} + " + " + ".join(
    f"(CASE WHEN mt.{n} <> 0 THEN 1 ELSE 0 END)" for n in _NUMS_B) + " AS nonzero, mt.ArrDelay FROM mt " + _joined_index()

ORACLE["feature_pipeline"] = MODEL + ", " + _index_ctes() + ", sc AS (SELECT *, " + ", ".join(
    f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 "
    f"ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END AS z_{c}" for c in _NUMS_B) + """
  FROM mt) SELECT UniqueCarrier, Origin, Dest, ArrDelay, """ + " + ".join(
    f"(SELECT max(width) FROM i_{c})" for c in _CATS) + f" + {len(_NUMS_B)} AS width, {len(_CATS)} + " + " + ".join(
    f"(CASE WHEN z_{n} <> 0 THEN 1 ELSE 0 END)" for n in _NUMS_B) + " AS nonzero, round(" + " + ".join(
    f"cast(z_{n} AS DOUBLE)" for n in _NUMS_B) + ", 6) AS numeric_sum FROM sc"
ORACLE["carrier_hour_key"] = BASE + """
SELECT UniqueCarrier, DepHour, avg(ArrDelay) AS AvgCarrierHourDelay,
  concat_ws('_', UniqueCarrier, cast(DepHour AS VARCHAR)) AS Key
FROM reg GROUP BY UniqueCarrier, DepHour"""

ORACLE["severity_band"] = SERVE + f"""
SELECT request_id, {_band_sql('predicted_delay_minutes')} AS severity,
  (CASE WHEN predicted_delay_minutes > 0 THEN '+' ELSE '' END)
    || regexp_replace(cast(predicted_delay_minutes AS VARCHAR), '\\.0$', '') || ' min' AS delay_text
FROM merged WHERE regression_status IS NOT NULL"""
ORACLE["risk_band"] = SERVE + f"""
SELECT request_id, {_risk_sql('probability_over_30min')} AS risk_30,
  {_risk_sql('probability_over_60min')} AS risk_60,
  printf('%.1f%%', probability_over_30min) AS p30_text,
  printf('%.1f%%', probability_over_60min) AS p60_text
FROM merged WHERE classification_status IS NOT NULL"""
ORACLE["error_rows"] = SERVE + """
SELECT request_id, status, regression_status, regression_error, classification_status FROM merged
WHERE regression_status = 'error' OR classification_status = 'error'"""
