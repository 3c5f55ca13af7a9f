"""Fixed values that results depend on: canton maps, risk names, cluster centres, bins."""

from __future__ import annotations

# Canton -> region, for the live data (20 cantons).
LIVE_REGIONS = {
    "Eastern Alps": ["AI", "AR", "SG", "GR", "GL", "FL"],
    "Western Alps": ["VD", "FR", "GE", "NE", "JU", "BE"],
    "Central Alps": ["NW", "OW", "LU", "UR", "SZ", "SO"],
    "Southern Alps": ["TI", "VS"],
}

# The same for the accident history, where FL belongs to no region.
HISTORY_REGIONS = {
    **LIVE_REGIONS,
    "Eastern Alps": ["AI", "AR", "SG", "GR", "GL"],
}

# Cantons a panel offers per region (12 cantons).
PANEL_REGIONS = {
    "Entire Alpine Region": ["BE", "FR", "VD", "TI", "VS", "OW", "SZ", "UR", "FL", "GL", "GR", "SG"],
    "Western Alps": ["BE", "FR", "VD"],
    "Southern Alps": ["TI", "VS"],
    "Central Alps": ["OW", "SZ", "UR"],
    "Eastern Alps": ["FL", "GL", "GR", "SG"],
}

# The entries that stand for no choice and for no region.
WHOLE_REGION = "Entire Alpine Region"
ALL_CANTONS = "None"
NO_REGION = "NONE"

# Region -> id, 0 for anything else.
REGION_IDS = {"Western Alps": 1, "Central Alps": 2, "Southern Alps": 3, "Eastern Alps": 4}

# Elevation classes, open on the left and closed on the right.
ELEVATION_BINS = [(0, 2000, "2000"), (2000, 3000, "3000"), (3000, 4000, "4000"), (4000, 5000, "5000")]

# Cluster -> character, risk, colour class.
CLUSTER_CHARACTER = {
    0: "extreme_wind",
    1: "extreme_wind_and_high_snow",
    2: "low_wind_extreme_cold_air",
    3: "low_snow_mild_air",
    4: "extreme_wind_and_new_snow",
}
CLUSTER_RISK = {
    0: "3 - moderate",
    1: "4 - considerable",
    2: "2 - low",
    3: "1 - very low",
    4: "5 - high",
}
CLUSTER_COLOUR = {0: "orange", 1: "lightcoral", 2: "yellow", 3: "lightgreen", 4: "darkred"}

# The four features of the clusters, in order.
FEATURES = [
    "air_temp_mean_stations",
    "wind_speed_max_stations",
    "snow_height_mean_stations",
    "new_snow_mean_stations",
]

# Published cluster centres in the order of FEATURES.
CLUSTER_CENTRES = {
    0: (-6.285643591167421, 18.49483392827083, 129.78317827130851, 5.29066352758422),
    1: (-4.693894034805795, 10.408894581898466, 243.5435446762975, 5.236722316845473),
    2: (-10.16790828549601, 8.609725156561481, 122.30685158843053, 5.5427821349143445),
    3: (-0.5701687693371751, 8.813653415183442, 107.50668827781504, 2.718451822587358),
    4: (-8.102557921164715, 12.322565893350308, 177.4145874103066, 31.743459705916703),
}

# Published positions (PCA1, PCA2) of the centres.
CLUSTER_POSITIONS = {
    0: (0.2075432818595524, 1.2608999997331323),
    1: (0.3945189001894583, -0.9640389400399944),
    2: (-0.07234834550791833, 0.1299359408960706),
    3: (-1.219745314830272, -0.2898365395452599),
    4: (1.903858323010803, -0.2648304425879799),
}

# Published row counts of the clusters.
CLUSTER_COUNTS = {0: 476, 1: 445, 2: 703, 3: 639, 4: 292}

# Heat-map feature -> (column, bin width); width None means the value itself.
HEATMAP_FEATURES = {
    "elevation": ("start_zone_elevation", 100),
    "snow_height": ("snow_height_mean_stations", 10),
    "new_snow": ("new_snow_mean_stations", 5),
    "temperature": ("air_temp_mean_stations", 5),
    "wind": ("wind_speed_max_stations", 5),
    "caught": ("number_caught", None),
}

# Panel measure -> column.
PANEL_MEASURES = {
    "temperature": "air_temp_mean_stations",
    "wind": "wind_speed_max_stations",
    "snow_height": "snow_height_mean_stations",
    "new_snow": "new_snow_mean_stations",
}

# Choices of the panels. Month slider of a winter season, October to April.
SEASON_MONTHS = [10, 11, 12, 1, 2, 3, 4]
WINTER_MONTHS = [11, 12, 1, 2, 3, 4]
TREND_DAYS = 28

# Fixed value: shown in place of an empty panel.
NO_DATA = "No future data available"

# Radii and the address of a station's sheet.
EARTH_RADIUS_KM = 6373.0
STATION_RADIUS_KM = 10.0
STATION_URL = ("https://stationdocu.slf.ch/pdf/IMIS_", "_DE.pdf")

# Daily roll-up of the 30-minute measurements.
ROLLUP_MEDIANS = ["HS"]
ROLLUP_MEANS = [
    "TA_30MIN_MEAN", "RH_30MIN_MEAN", "TSS_30MIN_MEAN", "TS0_30MIN_MEAN", "TS25_30MIN_MEAN",
    "TS50_30MIN_MEAN", "TS100_30MIN_MEAN", "RSWR_30MIN_MEAN", "VW_30MIN_MEAN", "DW_30MIN_MEAN",
    "DW_30MIN_SD",
]
ROLLUP_MAXIMA = ["VW_30MIN_MAX"]

# Renames of the daily measurements and of the snow readings.
MEASUREMENT_NAMES = {
    "TA_30MIN_MEAN": "air_temp_mean_stations",
    "VW_30MIN_MEAN": "wind_speed_mean_stations",
    "VW_30MIN_MAX": "wind_speed_max_stations",
    "TSS_30MIN_MEAN": "snow_surf_temp_mean_stations",
    "TS0_30MIN_MEAN": "snow_ground_temp_mean_stations",
}
SNOW_NAMES = {"HS": "snow_height_mean_stations", "HN_1D": "new_snow_mean_stations"}

# Measure of the weather history -> column of the joined accident.
HISTORY_WEATHER = {
    "air_temp_day_mean": "air_temp_mean_stations",
    "wind_speed_day_mean": "wind_speed_mean_stations",
    "wind_speed_day_max": "wind_speed_max_stations",
    "snow_surf_temp_day_mean": "snow_surf_temp_mean_stations",
    "snow_ground_temp_day_mean": "snow_ground_temp_mean_stations",
}

# The same for the snow history.
HISTORY_SNOW = {"snow_height_cm": "snow_height_mean_stations", "new_snow_cm": "new_snow_mean_stations"}
