"""The same queries as DuckDB SQL, over the views of ``views.py``."""

from __future__ import annotations

from checks import learning
from checks.views import ELEVATION_CASE, FEATURES, REGION_ID_CASE, region_case, with_views

RISK = ("CASE k_cluster WHEN 0 THEN '3 - moderate' WHEN 1 THEN '4 - considerable' WHEN 2 THEN '2 - low'"
        " WHEN 3 THEN '1 - very low' WHEN 4 THEN '5 - high' END")
CHARACTER = ("CASE k_cluster WHEN 0 THEN 'extreme_wind' WHEN 1 THEN 'extreme_wind_and_high_snow'"
             " WHEN 2 THEN 'low_wind_extreme_cold_air' WHEN 3 THEN 'low_snow_mild_air'"
             " WHEN 4 THEN 'extreme_wind_and_new_snow' END")


def colour(label: str, default: str) -> str:
    return (f"CASE {label} WHEN 0 THEN 'orange' WHEN 1 THEN 'lightcoral' WHEN 2 THEN 'yellow'"
            f" WHEN 3 THEN 'lightgreen' WHEN 4 THEN 'darkred' ELSE '{default}' END")


LABEL = ("concat(coalesce(canton_code, ''), ' - ', coalesce(code, ''), ' - ', coalesce(station_name, ''), ' - ',"
         " CAST(coalesce(elevation, 0) AS VARCHAR), ' m')")
LIVE_MEASURES = ["air_temp_mean_stations", "wind_speed_max_stations", "snow_surf_temp_mean_stations",
                 "snow_ground_temp_mean_stations", "snow_height_mean_stations", "new_snow_mean_stations"]
MEANS = ["TA_30MIN_MEAN", "RH_30MIN_MEAN", "TSS_30MIN_MEAN", "TS0_30MIN_MEAN", "TS25_30MIN_MEAN", "TS50_30MIN_MEAN",
         "TS100_30MIN_MEAN", "RSWR_30MIN_MEAN", "VW_30MIN_MEAN", "DW_30MIN_MEAN", "DW_30MIN_SD"]
LAT, LON = "start_zone_coordinates_latitude", "start_zone_coordinates_longitude"
MEASURE = {"temperature": "air_temp_mean_stations", "wind": "wind_speed_max_stations",
           "snow_height": "snow_height_mean_stations", "new_snow": "new_snow_mean_stations"}


def r8(names: list[str], source: str = "") -> str:
    return ", ".join(f"round({source}{n}, 8) AS {n}" for n in names)


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"2 * 6373e0 * asin(sqrt(least(1e0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
            f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))")


def near(view: str, measures: dict[str, str]) -> str:
    means = ", ".join(f"round(avg(w.{m}), 8) AS {name}" for m, name in measures.items())
    return f"""SELECT a.acc_id, {means} FROM v_accidents a LEFT JOIN {view} w ON a.date = w.measure_date
 AND {km('a.' + LAT, 'a.' + LON, 'w.imis_latitude', 'w.imis_longitude')} <= 10e0 GROUP BY a.acc_id"""


def heatmap(column: str, width: int | None) -> str:
    bin_ = f"CAST(floor({column} / {width}e0) * {width} AS BIGINT)" if width else f"CAST({column} AS BIGINT)"
    months = ", ".join(f"count(CASE WHEN month(date) = {m} THEN 1 END) AS m{m:02d}" for m in range(1, 13))
    return f"SELECT {bin_} AS bin, {months} FROM v_accidents WHERE year(date) = 1998 AND {column} IS NOT NULL GROUP BY 1"


def by_region(extra: str = "") -> str:
    columns = ", ".join(f"count(CASE WHEN k_cluster = {k} THEN 1 END) AS c{k}" for k in range(5))
    return (f"SELECT alpine_region, CAST(year(date) AS INT) AS year, {columns}, count(CASE WHEN k_cluster NOT BETWEEN 0 AND 4 THEN 1 END) AS other"
            f" FROM (SELECT * FROM v_accidents WHERE k_cluster IS NOT NULL) a1 {extra} GROUP BY 1, 2")


ROLLUP = f"""SELECT date, station_code, min(measure_date) AS measure_date, round(median(HS), 8) AS HS,
 {', '.join(f'round(avg({m}), 8) AS {m}' for m in MEANS)}, round(max(VW_30MIN_MAX), 8) AS VW_30MIN_MAX
FROM v_measurements GROUP BY date, station_code"""

DEDUPE = """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
   ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) x WHERE rn = 1"""

CLEAN = """SELECT acc_id, date, canton, municipality, start_zone_coordinates_latitude, start_zone_coordinates_longitude,
 start_zone_elevation, number_dead, number_caught, number_fully_buried FROM v_accidents WHERE date > DATE '1991-12-31'"""

NEIGHBOURS = f"""SELECT acc_id, neighbour, e, rank FROM (
 SELECT q.acc_id, d.acc_id AS neighbour, d.start_zone_elevation AS e, CAST(row_number() OVER (PARTITION BY q.acc_id ORDER BY
   (q.{LAT} - d.{LAT}) * (q.{LAT} - d.{LAT}) + (q.{LON} - d.{LON}) * (q.{LON} - d.{LON}), d.acc_id) AS INT) AS rank
 FROM v_accidents q CROSS JOIN v_accidents d
 WHERE q.start_zone_elevation IS NULL AND d.start_zone_elevation IS NOT NULL) n0 WHERE rank <= 3"""


def trend(measure: str, window: int, by_station: bool) -> str:
    column = MEASURE[measure]
    over = f"ORDER BY measure_date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW"
    if by_station:
        rows = f"SELECT station_code, measure_date, {column} AS value FROM v_live WHERE measure_date IS NOT NULL"
        keys, over = "station_code, measure_date", "PARTITION BY station_code " + over
    else:
        rows = f"SELECT measure_date, avg({column}) AS value FROM v_live WHERE measure_date IS NOT NULL GROUP BY measure_date"
        keys = "measure_date"
    return (f"SELECT {keys}, round(value, 8) AS value, CASE WHEN count(value) OVER w = {window}"
            f" THEN round(avg(value) OVER w, 8) END AS value_avg FROM ({rows}) t0 WINDOW w AS ({over})")


_WEATHER = {"air_temp_day_mean": "air_temp_mean_stations", "wind_speed_day_mean": "wind_speed_mean_stations", "wind_speed_day_max": "wind_speed_max_stations",
            "snow_surf_temp_day_mean": "snow_surf_temp_mean_stations", "snow_ground_temp_day_mean": "snow_ground_temp_mean_stations"}
_SNOW = {"snow_height_cm": "snow_height_mean_stations", "new_snow_cm": "new_snow_mean_stations"}
# fill, both radius joins, region and class, from the raw accidents
TRAINING = f"""SELECT acc_id, date, canton, start_zone_elevation, {', '.join([*_WEATHER.values(), *_SNOW.values()])}, alpine_region,
 {ELEVATION_CASE} AS elevation_group FROM (
 SELECT a.acc_id, a.date, a.canton, a.alpine_region, coalesce(a.start_zone_elevation, f.filled) AS start_zone_elevation,
  coalesce(a.start_zone_elevation, f.filled) AS elevation, {', '.join('w.' + c for c in _WEATHER.values())}, {', '.join('s.' + c for c in _SNOW.values())}
 FROM v_accidents a LEFT JOIN (SELECT acc_id, round(avg(e), 2) AS filled FROM ({NEIGHBOURS}) k0 GROUP BY acc_id) f ON a.acc_id = f.acc_id
 JOIN ({near('v_hist_weather', _WEATHER)}) w ON a.acc_id = w.acc_id JOIN ({near('v_hist_snow', _SNOW)}) s ON a.acc_id = s.acc_id
 WHERE a.date > DATE '1991-12-31') t0"""
TRAINING_MEANS = """SELECT k_cluster, round(avg(PCA1), 6) AS PCA1, round(avg(PCA2), 6) AS PCA2, count(*) AS n FROM v_acc_scored GROUP BY 1"""


SQL: dict[str, str] = {
    "scan_stations": "SELECT * FROM v_stations",
    "scan_csv": "SELECT * FROM v_accidents",
    "scan_live": f"SELECT code, station_code, measure_date, canton_code, region_id, {r8(FEATURES)} FROM v_live",
    "scan_trimmed": "SELECT nr, station_code, HS FROM v_measurements",
    "scan_history": "SELECT * FROM v_hist_weather",
    "ingest_json": "SELECT nr, station_code, measure_date, HS, TA_30MIN_MEAN FROM v_measurements",
    "load_raw_accidents": """SELECT acc_id AS avalanche_id, CAST(date AS VARCHAR) AS date, '0' AS date_quality, CAST(year(date) AS VARCHAR) AS hydrological_year, canton,
 municipality, start_zone_coordinates_latitude, start_zone_coordinates_longitude, '0' AS coordinates_quality, start_zone_elevation,
 CAST(NULL AS VARCHAR) AS start_zone_slope_aspect, CAST(NULL AS DOUBLE) AS start_zone_inclination, CAST(NULL AS VARCHAR) AS forecasted_dangerlevel_rating1,
 CAST(NULL AS VARCHAR) AS forecasted_dangerlevel_rating2, CAST(NULL AS VARCHAR) AS forecasted_most_dangerous_aspect_and_elevation,
 number_dead, number_caught, number_fully_buried, 'tour' AS activity FROM v_accidents""",
    "load_weather_history": """SELECT measure_date, imis_latitude, imis_longitude, air_temp_day_mean, wind_speed_day_mean, wind_speed_day_max,
 snow_surf_temp_day_mean, snow_ground_temp_day_mean FROM v_hist_weather""",
    "freshness_landed": "SELECT concat(CAST(max(date) AS VARCHAR), '-12:00') AS last_update FROM v_measurements",
    "future_marker": """SELECT CAST(y AS INT) AS first_year, 'No future data available' AS message FROM (SELECT unnest([2023, 2030]) AS y) y0
WHERE NOT EXISTS (SELECT 1 FROM v_scored WHERE year(measure_date) = y + 1 AND month(measure_date) = 1)""",
    "ingest_json_array": "SELECT nr, station_code, measure_date, HS, TA_30MIN_MEAN FROM v_measurements",
    "latest_date": "SELECT max(date) AS latest_date FROM v_measurements",
    "append_batch": "SELECT nr, station_code, date, HS FROM v_measurements",
    "rewrite_clean": DEDUPE,
    "ctas_clean": CLEAN,
    "preview": "SELECT nr, station_code, measure_date, HS FROM v_measurements ORDER BY measure_date, nr LIMIT 5",
    "project_measurements": """SELECT station_code, measure_date, TA_30MIN_MEAN AS air_temp_mean_stations,
 VW_30MIN_MAX AS wind_speed_max_stations, TSS_30MIN_MEAN AS snow_surf_temp_mean_stations,
 TS0_30MIN_MEAN AS snow_ground_temp_mean_stations FROM v_measurements""",
    "project_snow": """SELECT station_code, measure_date, HS AS snow_height_mean_stations, HN_1D AS new_snow_mean_stations
FROM v_snow""",
    "project_constants": "SELECT station_code, measure_date, HS, '001' AS nr, 'SNOW' AS imis_type FROM v_measurements",
    "more_measurements": """SELECT '001' AS nr, station_code, concat(left(measure_date, 10), 'T00:00:00Z') AS measure_date, HS,
 TA_30MIN_MEAN, RH_30MIN_MEAN, TSS_30MIN_MEAN, TS0_30MIN_MEAN, TS25_30MIN_MEAN, TS50_30MIN_MEAN, TS100_30MIN_MEAN,
 RSWR_30MIN_MEAN, VW_30MIN_MEAN, VW_30MIN_MAX, DW_30MIN_MEAN, DW_30MIN_SD FROM v_measurements WHERE date > DATE '2024-01-10'""",
    "more_snow": """SELECT '001' AS nr, station_code, concat(CAST(measure_date AS VARCHAR), 'T00:00:00') AS measure_date,
 snow_height_cm AS HS, new_snow_cm AS HN_1D FROM v_hist_snow WHERE hyear > '1997'""",
    "station_label": f"SELECT code, {LABEL} AS label FROM v_stations",
    "station_url": "SELECT code, concat('https://stationdocu.slf.ch/pdf/IMIS_', code, '_DE.pdf') AS url FROM v_stations",
    "live_label": "SELECT code, measure_date, canton_code || ' - ' || station_code || ' - ' || station_name AS label FROM v_live",
    "clean_accidents": CLEAN,
    "distinct_values": "SELECT DISTINCT alpine_region FROM v_accidents",
    "latest_slice": """SELECT nr, station_code, date, HS, TA_30MIN_MEAN FROM v_measurements
WHERE date = (SELECT max(date) FROM v_measurements)""",
    "filter_region": "SELECT acc_id, canton, date FROM v_accidents WHERE canton IN ('FL', 'GL', 'GR', 'SG')",
    "filter_canton": "SELECT acc_id, canton, date FROM v_accidents WHERE canton = 'GR'",
    "filter_stations": "SELECT nr, station_code, HS FROM v_measurements WHERE station_code IN ('S1', 'S2', 'S4')",
    "filter_date_range": "SELECT acc_id, date FROM v_accidents WHERE date BETWEEN DATE '1996-02-01' AND DATE '1998-03-31'",
    "filter_year_month": "SELECT acc_id, date FROM v_accidents WHERE year(date) IN (1996, 1997, 1999) AND month(date) = 2",
    "filter_season_month": "SELECT acc_id, date FROM v_accidents WHERE year(date) = 1998 AND month(date) = 1",
    "filter_date": "SELECT acc_id, date FROM v_accidents WHERE date = DATE '1998-02-10'",
    "filter_risk": f"""SELECT acc_id, k_cluster, risk_group FROM (SELECT *, {RISK} AS risk_group FROM v_accidents) r0
WHERE risk_group IN ('1 - very low', '4 - considerable')""",
    "drop_incomplete": f"""SELECT acc_id, {', '.join(FEATURES)} FROM v_accidents
WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}""",
    "split_missing": """SELECT acc_id, start_zone_elevation,
 CASE WHEN start_zone_elevation IS NULL THEN 'missing' ELSE 'known' END AS source FROM v_accidents""",
    "since_date": """SELECT station_code, measure_date, air_temp_day_mean FROM v_hist_weather WHERE measure_date > DATE '1997-12-31'""",
    "since_hyear": "SELECT station_code, measure_date, hyear, snow_height_cm FROM v_hist_snow WHERE hyear > '1998'",
    "outer_weather_snow": f"SELECT station_code, measure_date, {r8(LIVE_MEASURES)} FROM v_outer",
    "live_table": f"""SELECT code, station_name, lon, lat, elevation, country_code, type, canton_code, alpine_region, station_code,
 measure_date, {r8(LIVE_MEASURES)}, region_id, elevation_group FROM v_live""",
    "snow_enriched": """SELECT h.station_code, s.station_name, s.lon AS imis_longitude, s.lat AS imis_latitude,
 s.elevation AS imis_elevation, s.canton_code AS canton, 'SNOW' AS imis_type, h.measure_date, h.hyear, h.snow_height_cm, h.new_snow_cm
FROM v_hist_snow h JOIN v_stations s ON h.station_code = s.code WHERE h.measure_date > DATE '1997-12-31'""",
    "radius_weather": near("v_hist_weather", {
        "air_temp_day_mean": "air_temp_mean_stations", "wind_speed_day_mean": "wind_speed_mean_stations",
        "wind_speed_day_max": "wind_speed_max_stations", "snow_surf_temp_day_mean": "snow_surf_temp_mean_stations",
        "snow_ground_temp_day_mean": "snow_ground_temp_mean_stations"}),
    "radius_snow": near("v_hist_snow", {
        "snow_height_cm": "snow_height_mean_stations", "new_snow_cm": "new_snow_mean_stations"}),
    "knn_neighbours": f"SELECT acc_id, neighbour, rank FROM ({NEIGHBOURS}) k0",
    "knn_impute": f"""SELECT a.acc_id, coalesce(a.start_zone_elevation, f.filled) AS start_zone_elevation FROM v_accidents a
LEFT JOIN (SELECT acc_id, round(avg(e), 2) AS filled FROM ({NEIGHBOURS}) k0 GROUP BY acc_id) f ON a.acc_id = f.acc_id""",
    "risk_lookup": f"""SELECT acc_id, k_cluster, {RISK} AS risk_group, {CHARACTER} AS character,
 {colour('k_cluster', 'gray')} AS colour FROM v_accidents""",
    "training_rows": TRAINING,
    "training_means": TRAINING_MEANS,
    "dedupe_keep_first": DEDUPE,
    "daily_rollup": ROLLUP,
    "daily_rollup_split": """SELECT date, min(measure_date) AS measure_date, round(median(HS), 8) AS HS,
 round(avg(TA_30MIN_MEAN), 8) AS TA_30MIN_MEAN, round(max(VW_30MIN_MAX), 8) AS VW_30MIN_MAX FROM v_measurements GROUP BY date""",
    "trend_daily_mean": f"""SELECT measure_date, {', '.join(f'round(avg({f}), 8) AS {f}' for f in FEATURES)} FROM v_live
WHERE measure_date IS NOT NULL GROUP BY measure_date""",
    "scalar_stats": """SELECT round(min(TA_30MIN_MEAN), 8) AS min_value, round(max(TA_30MIN_MEAN), 8) AS max_value,
 round(avg(TA_30MIN_MEAN), 8) AS mean_value FROM v_measurements""",
    "map_centre": "SELECT round(avg(lat), 8) AS centre_lat, round(avg(lon), 8) AS centre_lon FROM v_stations",
    "accident_heatmap_elevation": heatmap("start_zone_elevation", 100),
    "accident_heatmap_snow_height": heatmap("snow_height_mean_stations", 10),
    "accident_heatmap_new_snow": heatmap("new_snow_mean_stations", 5),
    "accident_heatmap_temperature": heatmap("air_temp_mean_stations", 5),
    "accident_heatmap_wind": heatmap("wind_speed_max_stations", 5),
    "accident_heatmap_caught": heatmap("number_caught", None),
    "accidents_by_region": by_region(),
    "accidents_by_region_filtered": by_region("WHERE month(date) = 2 AND k_cluster IN (3, 1)"),
    "max_yearly_accidents": """SELECT max(n) AS max_accidents FROM (
 SELECT count(*) AS n FROM v_accidents GROUP BY alpine_region, year(date)) m0""",
    "risk_matrix_canton": f"""SELECT canton_code, measure_date, round(k, 8) AS k_mean, {colour('CAST(trunc(k) AS INT)', 'white')} AS colour
FROM (SELECT canton_code, measure_date, avg(k_cluster) AS k FROM v_scored
  WHERE measure_date >= DATE '2024-01-01' AND measure_date < DATE '2024-02-01' GROUP BY 1, 2) m0""",
    "risk_matrix_station": f"""SELECT station_code, measure_date, round(k, 8) AS k_mean, {colour('CAST(trunc(k) AS INT)', 'white')} AS colour
FROM (SELECT station_code, measure_date, avg(k_cluster) AS k FROM v_scored
  WHERE year(measure_date) IN (2023, 2024) GROUP BY 1, 2) m0""",
    "risk_matrix_class": f"""SELECT canton_code, measure_date, CAST(trunc(k) AS INT) AS k_class, {colour('CAST(trunc(k) AS INT)', 'white')} AS colour
FROM (SELECT canton_code, measure_date, avg(k_cluster) AS k FROM v_scored
  WHERE measure_date >= DATE '2024-01-01' AND measure_date < DATE '2024-02-01' AND canton_code IN ('BE', 'FR', 'VD') GROUP BY 1, 2) m0""",
    "risk_matrix_mode": f"""SELECT canton_code, measure_date, CAST(k_cluster AS DOUBLE) AS k_mean, {colour('k_cluster', 'white')} AS colour FROM (
 SELECT canton_code, measure_date, k_cluster, row_number() OVER (PARTITION BY canton_code, measure_date ORDER BY count(*) DESC, k_cluster) AS rn
 FROM v_scored WHERE measure_date >= DATE '2024-01-01' AND measure_date < DATE '2024-02-01' GROUP BY 1, 2, 3) m0 WHERE rn = 1""",
    "cluster_share": """SELECT k_cluster, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 8) AS percentage
FROM v_accidents GROUP BY k_cluster""",
    "cluster_mean_position": """SELECT k_cluster, round(avg(PCA1), 8) AS PCA1, round(avg(PCA2), 8) AS PCA2 FROM v_acc_scored
GROUP BY k_cluster""",
    "normalised_cluster_means": "WITH g AS (SELECT k_cluster, " + ", ".join(f"avg({f}) AS {f}" for f in FEATURES)
    + " FROM v_accidents GROUP BY k_cluster), x AS (SELECT "
    + ", ".join(f"min({f}) AS lo{i}, max({f}) AS hi{i}" for i, f in enumerate(FEATURES)) + " FROM v_accidents) SELECT k_cluster, "
    + ", ".join(f"round(CASE WHEN hi{i} > lo{i} THEN ({f} - lo{i}) / (hi{i} - lo{i}) ELSE 0e0 END, 8) AS {f}_norm"
                for i, f in enumerate(FEATURES)) + " FROM g CROSS JOIN x",
    "accidents_by_month": """SELECT CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year, count(*) AS n FROM v_accidents
WHERE month(date) IN (11, 12, 1, 2, 3, 4) GROUP BY 1, 2""",
    "row_count": "SELECT count(*) AS n FROM v_hist_snow",
    "moving_avg_global": "SELECT measure_date, " + r8(FEATURES) + ", "
    + ", ".join(f"CASE WHEN count({f}) OVER w = 7 THEN round(avg({f}) OVER w, 8) END AS {f}_avg" for f in FEATURES)
    + " FROM (SELECT measure_date, " + ", ".join(f"avg({f}) AS {f}" for f in FEATURES)
    + " FROM v_live WHERE measure_date IS NOT NULL GROUP BY measure_date) t0"
      " WINDOW w AS (ORDER BY measure_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
    "moving_avg_station": """SELECT station_code, measure_date, round(air_temp_mean_stations, 8) AS air_temp_mean_stations,
 CASE WHEN count(air_temp_mean_stations) OVER w = 3 THEN round(avg(air_temp_mean_stations) OVER w, 8) END AS air_temp_mean_stations_avg
FROM v_daily WINDOW w AS (PARTITION BY station_code ORDER BY measure_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "moving_avg_blocks": """SELECT nr, station_code, measure_ts, round(TSS_30MIN_MEAN, 8) AS TSS_30MIN_MEAN,
 CASE WHEN count(TSS_30MIN_MEAN) OVER w = 5 THEN round(avg(TSS_30MIN_MEAN) OVER w, 8) END AS TSS_30MIN_MEAN_avg
FROM v_measurements WINDOW w AS (PARTITION BY station_code ORDER BY measure_ts, nr ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "sorted_groups": "SELECT DISTINCT canton FROM v_accidents ORDER BY canton DESC",
    "sorted_risk_groups": f"SELECT DISTINCT {RISK} AS risk_group FROM v_accidents ORDER BY 1",
    "union_train_live": " UNION ALL ".join(
        f"SELECT {r8(FEATURES)}, '{name}' AS source FROM {view} WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
        for name, view in (("training", "v_accidents"), ("live", "v_live"))),
    "risk_scatter": f"""SELECT 'training' AS layer, round(PCA1, 8) AS PCA1, round(PCA2, 8) AS PCA2, k_cluster,
 {colour('k_cluster', 'gray')} AS colour, CAST(NULL AS VARCHAR) AS label FROM v_acc_scored
UNION ALL SELECT 'live', round(PCA1, 8), round(PCA2, 8), k_cluster, 'black', canton_code || ' - ' || station_code || ' - ' || station_name
FROM v_scored WHERE measure_date = (SELECT max(measure_date) FROM v_scored)
UNION ALL SELECT 'centre', round(p, 8), round(q, 8), k, 'darkblue', NULL FROM (VALUES
 (0, 0.2075432818595524e0, 1.2608999997331323e0), (1, 0.3945189001894583e0, -0.9640389400399944e0),
 (2, -0.07234834550791833e0, 0.1299359408960706e0), (3, -1.219745314830272e0, -0.2898365395452599e0),
 (4, 1.903858323010803e0, -0.2648304425879799e0)) c(k, p, q)""",
    "iso_day": "SELECT nr, CAST(left(measure_date, 10) AS DATE) AS day FROM v_measurements",
    "midnight_stamp": """SELECT nr, concat(left(measure_date, 10), 'T00:00:00Z') AS stamp,
 concat(left(measure_date, 10), 'T00:00:00') AS local_stamp FROM v_measurements""",
    "parse_ts": "SELECT nr, CAST(left(measure_date, 19) AS TIMESTAMP) AS t FROM v_measurements",
    "parse_ts_lenient": """SELECT nr, TRY_CAST(CASE WHEN HS IS NOT NULL THEN left(measure_date, 19) ELSE 'not a date' END AS TIMESTAMP) AS t
FROM v_measurements""",
    "format_date": """SELECT nr, strftime(date, '%d-%b-%Y') AS day_text, strftime(measure_ts, '%Y-%m-%d-%H:%M') AS minute_text
FROM v_measurements""",
    "default_range": """SELECT min(date) AS first_date, CAST(max(date) - INTERVAL 28 DAY AS DATE) AS start_date, max(date) AS end_date
FROM v_measurements""",
    "floor_bins": "SELECT acc_id, CAST(floor(air_temp_mean_stations / 5e0) * 5 AS BIGINT) AS bin FROM v_accidents",
    "elevation_group": f"SELECT code, elevation, {ELEVATION_CASE} AS elevation_group FROM v_stations",
    "alpine_region_live": f"SELECT code, {region_case('canton_code', True)} AS alpine_region FROM v_stations",
    "alpine_region_hist": f"SELECT acc_id, {region_case('canton', False)} AS alpine_region FROM v_accidents",
    "region_id": f"SELECT acc_id, {REGION_ID_CASE} AS region_id FROM v_accidents",
    "haversine": f"SELECT acc_id, round({km(LAT, LON, '46.5e0', '9.8e0')}, 8) AS km FROM v_accidents",
    "scaler_fit": " UNION ALL ".join(
        f"SELECT 'f{i}' AS feature, round(avg(f{i}), 8) AS mean, round(stddev_pop(f{i}), 8) AS std FROM v_training" for i in range(1, 5)),
    "scaler_apply": "SELECT row_id, " + ", ".join(
        f"round((f{i} - avg(f{i}) OVER ()) / stddev_pop(f{i}) OVER (), 8) AS z{i}" for i in range(1, 5)) + " FROM v_training",
    "kmeans_assign": """WITH c AS (SELECT label AS k, round(avg(f1), 6) AS c1, round(avg(f2), 6) AS c2, round(avg(f3), 6) AS c3,
  round(avg(f4), 6) AS c4 FROM v_training GROUP BY label),
r AS (SELECT row_id, k, row_number() OVER (PARTITION BY row_id ORDER BY
  (f1 - c1) * (f1 - c1) + (f2 - c2) * (f2 - c2) + (f3 - c3) * (f3 - c3) + (f4 - c4) * (f4 - c4), k) AS rn FROM v_training CROSS JOIN c)
SELECT row_id, k AS k_cluster FROM r WHERE rn = 1""",
    "inertia_fixed": """WITH c AS (SELECT label AS k, round(avg(f1), 6) AS c1, round(avg(f2), 6) AS c2, round(avg(f3), 6) AS c3,
  round(avg(f4), 6) AS c4 FROM v_training GROUP BY label)
SELECT round(sum(d), 8) AS inertia FROM (SELECT row_id, min(
  (f1 - c1) * (f1 - c1) + (f2 - c2) * (f2 - c2) + (f3 - c3) * (f3 - c3) + (f4 - c4) * (f4 - c4)) AS d
  FROM v_training CROSS JOIN c GROUP BY row_id) g""",
    "pca_apply": "WITH z AS (SELECT row_id, " + ", ".join(
        f"(f{i} - avg(f{i}) OVER ()) / stddev_pop(f{i}) OVER () AS z{i}" for i in range(1, 5)) + """ FROM v_training)
SELECT row_id, round(0.5e0 * z1 + 0.5e0 * z2 + 0.5e0 * z3 + 0.5e0 * z4, 8) AS PCA1,
 round(0.5e0 * z1 - 0.5e0 * z2 + 0.5e0 * z3 - 0.5e0 * z4, 8) AS PCA2 FROM z""",
    "centres_original": "SELECT label, " + ", ".join(f"round(avg(f{i}), 8) AS f{i}" for i in range(1, 5)) + " FROM v_training GROUP BY label",
    "cluster_profile": "SELECT label, " + ", ".join(f"round(avg(f{i}), 8) AS f{i}" for i in range(1, 5))
    + ", count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 8) AS percentage FROM v_training GROUP BY label",
    "station_options": f"SELECT {LABEL} AS label, code AS value FROM v_stations WHERE canton_code IN ('FL', 'GL', 'GR', 'SG')",
    "canton_options": """SELECT 'All Cantons' AS label, 'None' AS value, count(*) AS stations FROM v_stations
UNION ALL SELECT c, c, count(s.code) FROM (VALUES ('FL'), ('GL'), ('GR'), ('SG')) l(c)
LEFT JOIN v_stations s ON s.canton_code = l.c GROUP BY c""",
    "station_overview": f"""SELECT code, round(lat, 8) AS lat, round(lon, 8) AS lon, {LABEL} AS label,
 concat('https://stationdocu.slf.ch/pdf/IMIS_', code, '_DE.pdf') AS url FROM v_stations""",
    "weather_trend": f"""SELECT measure_date, {', '.join(f'round(avg({f}), 8) AS {f}' for f in FEATURES)} FROM v_live
WHERE canton_code IN ('FL', 'GL', 'GR', 'SG') AND measure_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' GROUP BY measure_date""",
    "stream_ingest": "SELECT nr, station_code, measure_date, date, HS FROM v_measurements",
    "stream_dedupe": """SELECT nr, station_code, hour, HS FROM (SELECT *, strftime(measure_ts, '%Y-%m-%d %H') AS hour,
  row_number() OVER (PARTITION BY station_code, strftime(measure_ts, '%Y-%m-%d %H') ORDER BY nr) AS rn FROM v_measurements) x WHERE rn = 1""",
    "stream_daily": ROLLUP,
    "stream_score": "SELECT station_code, measure_date, k_cluster, round(PCA1, 8) AS PCA1, round(PCA2, 8) AS PCA2 FROM v_scored",
}
SQL |= {"kmeans_fit": learning.kmeans(), "kmeans_fixpoint": learning.fixpoint(), "elbow": learning.elbow(), "pca_fit": learning.pca(), "pca_residual": learning.residual()}
SQL["load_snow_history"] = SQL["snow_enriched"]
for _m, _column in MEASURE.items():
    SQL[f"latest_map_{_m}"] = (f"SELECT code, round(lat, 8) AS lat, round(lon, 8) AS lon, round({_column}, 8) AS z FROM v_live"
                               " WHERE measure_date = (SELECT max(measure_date) FROM v_live)")
    SQL[f"trend_{_m}"] = trend(_m, 7, False)
    SQL[f"trend_{_m}_stations"] = trend(_m, 3, True)

ORACLE = {name: with_views(text) for name, text in SQL.items()}
