"""DuckDB counterparts of the adapter tables, as common table expressions."""

from __future__ import annotations

import re

# The cantons of the three maps, and five without a region.
CANTON_LIST = "AI,AR,SG,GR,GL,FL,VD,FR,GE,NE,JU,BE,NW,OW,LU,UR,SZ,SO,TI,VS,ZH,AG,ZG,BL,TG"


# Fixed values in the next three texts: region by canton, elevation classes, region ids.
def region_case(canton: str, with_fl: bool) -> str:
    east = "'AI','AR','SG','GR','GL'" + (",'FL'" if with_fl else "")
    return (
        f"CASE WHEN {canton} IN ({east}) THEN 'Eastern Alps'"
        f" WHEN {canton} IN ('VD','FR','GE','NE','JU','BE') THEN 'Western Alps'"
        f" WHEN {canton} IN ('NW','OW','LU','UR','SZ','SO') THEN 'Central Alps'"
        f" WHEN {canton} IN ('TI','VS') THEN 'Southern Alps' ELSE 'NONE' END"
    )


ELEVATION_CASE = (
    "CASE WHEN elevation > 0 AND elevation <= 2000 THEN '2000' WHEN elevation > 2000 AND elevation <= 3000 THEN '3000'"
    " WHEN elevation > 3000 AND elevation <= 4000 THEN '4000' WHEN elevation > 4000 AND elevation <= 5000 THEN '5000' END"
)
REGION_ID_CASE = (
    "CAST(CASE alpine_region WHEN 'Western Alps' THEN 1 WHEN 'Central Alps' THEN 2 WHEN 'Southern Alps' THEN 3"
    " WHEN 'Eastern Alps' THEN 4 ELSE 0 END AS INT)"
)
HYEAR = (
    "CAST(CASE WHEN month(measure_date) >= 10 THEN year(measure_date) + 1 ELSE year(measure_date) END AS VARCHAR) AS hyear"
)
_PLACE = """concat('S', CAST(l_suppkey AS VARCHAR)) AS station_code, CAST(l_shipdate AS DATE) AS measure_date,
  46e0 + (l_suppkey * 7919 % 10007) * 12e-5 AS imis_latitude, 6e0 + (l_suppkey * 104729 % 10009) * 4e-4 AS imis_longitude"""

# Scale of the fixed model, published centres, the four features.
MEANS = [-6.0, 12.0, 150.0, 9.0]
STDS = [6.0, 5.0, 60.0, 11.0]
CENTRES = [
    (-6.285643591167421, 18.49483392827083, 129.78317827130851, 5.29066352758422),
    (-4.693894034805795, 10.408894581898466, 243.5435446762975, 5.236722316845473),
    (-10.16790828549601, 8.609725156561481, 122.30685158843053, 5.5427821349143445),
    (-0.5701687693371751, 8.813653415183442, 107.50668827781504, 2.718451822587358),
    (-8.102557921164715, 12.322565893350308, 177.4145874103066, 31.743459705916703),
]
FEATURES = ["air_temp_mean_stations", "wind_speed_max_stations", "snow_height_mean_stations", "new_snow_mean_stations"]


def _scored(source: str) -> str:
    z = ", ".join(
        f"({f} - CAST({m!r} AS DOUBLE)) / CAST({s!r} AS DOUBLE) AS z{i + 1}" for i, (f, m, s) in enumerate(zip(FEATURES, MEANS, STDS))
    )
    gaps = []
    for k, centre in enumerate(CENTRES):
        parts = []
        for i, (c, m, s) in enumerate(zip(centre, MEANS, STDS)):
            value = repr((c - m) / s)
            parts.append(f"(z{i + 1} - CAST('{value}' AS DOUBLE)) * (z{i + 1} - CAST('{value}' AS DOUBLE))")
        gaps.append(" + ".join(parts) + f" AS d{k}")
    whole = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
    label = " ".join(
        f"WHEN {' AND '.join(f'd{k} <= d{j}' for j in range(5) if j != k)} THEN {k}" for k in range(5)
    )
    return (
        f"SELECT * EXCLUDE (z1, z2, z3, z4, d0, d1, d2, d3, d4), 0.5e0 * z1 + 0.5e0 * z2 + 0.5e0 * z3 + 0.5e0 * z4 AS PCA1,"
        f" 0.5e0 * z1 - 0.5e0 * z2 + 0.5e0 * z3 - 0.5e0 * z4 AS PCA2, CAST(CASE {label} END AS INT) AS k_cluster"
        f" FROM (SELECT *, {', '.join(gaps)} FROM (SELECT *, {z} FROM {source} WHERE {whole}) z0) z9"
    )


VIEWS: dict[str, str] = {
    "v_stations": f"""
SELECT *, {region_case('canton_code', True)} AS alpine_region FROM (
  SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS code, s_name AS station_name,
    6e0 + (s_suppkey * 104729 % 10009) * 4e-4 AS lon, 46e0 + (s_suppkey * 7919 % 10007) * 12e-5 AS lat,
    CAST(1200 + s_suppkey * 53 % 4200 AS INT) AS elevation,
    CASE WHEN s_nationkey = 5 THEN 'LI' ELSE 'CH' END AS country_code,
    CASE WHEN s_suppkey % 3 = 0 THEN 'WIND' ELSE 'SNOW_FLAT' END AS type,
    split_part('{CANTON_LIST}', ',', s_nationkey + 1) AS canton_code
  FROM supplier) s0""",
    "v_measurements": """
SELECT event_id AS nr, concat('S', CAST(user_id AS VARCHAR)) AS station_code,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS measure_date, ts AS measure_ts, CAST(ts AS DATE) AS date,
  CASE WHEN event_type <> 'view' THEN value * 1.0173926451733e0 END AS HS,
  CASE WHEN event_type <> 'error' THEN value * 0.0973126457311e0 - 20e0 END AS TA_30MIN_MEAN,
  CAST(event_id % 101 AS DOUBLE) AS RH_30MIN_MEAN,
  value * 0.0831726459107e0 - 25e0 AS TSS_30MIN_MEAN,
  CASE WHEN event_type <> 'signup' THEN (event_id % 50) * 0.1029384756473e0 - 5e0 END AS TS0_30MIN_MEAN,
  (event_id % 40) / 10e0 - 4e0 AS TS25_30MIN_MEAN,
  (event_id % 30) / 10e0 - 3e0 AS TS50_30MIN_MEAN,
  (event_id % 20) / 10e0 - 2e0 AS TS100_30MIN_MEAN,
  CAST(event_id % 700 AS DOUBLE) AS RSWR_30MIN_MEAN,
  CASE WHEN event_type IN ('click', 'view', 'error') THEN value * 0.0517394820167e0 END AS VW_30MIN_MEAN,
  CASE WHEN event_type IN ('click', 'view', 'error') THEN value * 0.1013729104733e0 END AS VW_30MIN_MAX,
  CAST(event_id % 360 AS DOUBLE) AS DW_30MIN_MEAN, CAST(event_id % 45 AS DOUBLE) AS DW_30MIN_SD
FROM events""",
    "v_snow": f"""
SELECT *, {HYEAR} FROM (
  SELECT concat('S', CAST(user_id + 1 AS VARCHAR)) AS station_code, CAST(ts AS DATE) AS measure_date,
    max(value) FILTER (event_type IN ('purchase', 'signup', 'click')) * 1.0173926451733e0 AS HS,
    min(value) FILTER (event_type IN ('purchase', 'signup', 'click')) * 0.0983174629151e0 AS HN_1D
  FROM events GROUP BY user_id, CAST(ts AS DATE)) w0""",
    "v_accidents": f"""
SELECT *, {region_case('canton', False)} AS alpine_region FROM (
  SELECT o_orderkey AS acc_id, CAST(o_orderdate AS DATE) AS date,
    split_part('{CANTON_LIST}', ',', CAST(o_custkey % 25 AS INT) + 1) AS canton,
    concat('M', CAST(o_custkey % 500 AS VARCHAR)) AS municipality,
    46e0 + (o_orderkey * 7919 % 100003) * 12e-6 AS start_zone_coordinates_latitude,
    6e0 + (o_orderkey * 104729 % 100019) * 4e-5 AS start_zone_coordinates_longitude,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(1000 + o_orderkey * 67 % 3000 AS DOUBLE) END AS start_zone_elevation,
    CAST(o_orderkey % 3 AS INT) AS number_dead, CAST(o_orderkey % 6 + 1 AS INT) AS number_caught,
    CAST(o_orderkey % 4 AS INT) AS number_fully_buried,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN (o_orderkey * 37 % 451) / 10e0 - 30e0 END AS air_temp_mean_stations,
    (o_orderkey * 41 % 300) / 10e0 AS wind_speed_max_stations,
    CASE WHEN o_orderpriority <> '5-LOW' THEN (o_orderkey * 43 % 3500) / 10e0 END AS snow_height_mean_stations,
    (o_orderkey * 47 % 601) / 10e0 AS new_snow_mean_stations, CAST(o_orderkey * 31 % 13 % 5 AS INT) AS k_cluster
  FROM orders) a0""",
    "v_hist_weather": f"""
SELECT {_PLACE}, CASE WHEN l_returnflag <> 'R' THEN l_quantity - 25e0 END AS air_temp_day_mean,
  l_tax * 50e0 AS wind_speed_day_mean, l_tax * 100e0 AS wind_speed_day_max, l_quantity / 2e0 - 20e0 AS snow_surf_temp_day_mean,
  CASE WHEN l_linestatus = 'F' THEN l_linenumber / 4e0 - 1e0 END AS snow_ground_temp_day_mean
FROM lineitem""",
    "v_hist_snow": f"""
SELECT *, {HYEAR} FROM (SELECT {_PLACE}, l_discount * 1000e0 AS snow_height_cm,
  CASE WHEN l_returnflag <> 'A' THEN l_tax * 100e0 END AS new_snow_cm FROM lineitem) h0""",
    "v_training": "SELECT vec_id AS row_id, label, "
    + ", ".join(f"list_reduce([0e0] || list_transform(list_filter(embedding, lambda x, i: i % 4 = {(i + 1) % 4}), lambda x: CAST(x AS DOUBLE)), lambda a, x: a + x) AS f{i + 1}" for i in range(4))
    + " FROM embeddings",
    "v_daily": """
SELECT station_code, date AS measure_date, avg(TA_30MIN_MEAN) AS air_temp_mean_stations,
  max(VW_30MIN_MAX) AS wind_speed_max_stations, avg(TSS_30MIN_MEAN) AS snow_surf_temp_mean_stations,
  avg(TS0_30MIN_MEAN) AS snow_ground_temp_mean_stations
FROM v_measurements GROUP BY station_code, date""",
    "v_outer": """
SELECT coalesce(d.station_code, s.station_code) AS station_code, coalesce(d.measure_date, s.measure_date) AS measure_date,
  d.air_temp_mean_stations, d.wind_speed_max_stations, d.snow_surf_temp_mean_stations, d.snow_ground_temp_mean_stations,
  s.HS AS snow_height_mean_stations, s.HN_1D AS new_snow_mean_stations
FROM v_daily d FULL OUTER JOIN v_snow s ON d.station_code = s.station_code AND d.measure_date = s.measure_date""",
    "v_live": f"""
SELECT st.*, m.*, {REGION_ID_CASE.replace('alpine_region', 'st.alpine_region')} AS region_id, {ELEVATION_CASE} AS elevation_group
FROM v_stations st FULL OUTER JOIN v_outer m ON st.code = m.station_code WHERE st.alpine_region <> 'NONE'""",
    "v_scored": _scored("v_live"),
    "v_acc_scored": _scored("(SELECT * EXCLUDE (k_cluster) FROM v_accidents) a1"),
}

_NAMES = re.compile(r"\bv_[a-z_]+\b")


def with_views(sql: str) -> str:
    """Put the definitions of the views a text names (and of those they name) before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _NAMES.findall(text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    defined = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {defined},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {defined},\n{body[5:]}"
    return f"WITH {defined}\n{body}"
