"""Every query by name, over the adapter tables of one data folder.

Floating sums are rounded to 8 digits: two engines add up in different orders.
"""

from __future__ import annotations

import datetime as dt
import re
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline import schemas
from firnline.functions import dates, labels, places
from firnline.operators import cleaning, clusters, counts, enrich, filters, lattice, moving, neighbours, radius, rollup, scaling, unions
from firnline.plans import adapters as A
from firnline.plans import history, maintained, panels
from firnline.plans.live import daily_features, daily_measurements, live, score_live
from firnline.session import lasting_folder, shared_folder
from firnline.sources import listing, loaders, readers, sinks
from firnline.sources.versions import VersionedTable
from firnline.streaming import jobs
from firnline.vocabulary import (
    FEATURES, HEATMAP_FEATURES, HISTORY_SNOW, HISTORY_WEATHER, PANEL_MEASURES, ROLLUP_MAXIMA, ROLLUP_MEANS, ROLLUP_MEDIANS,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 8) for c in columns})


def _live(spark: SparkSession, d: str) -> DataFrame:
    return live(A.stations(spark, d), A.measurements(spark, d), A.snow(spark, d))


def _by_day(spark: SparkSession, d: str) -> DataFrame:
    """The live table as the panels read it: kept by day for this application, and refreshed when its sources have changed."""
    path = lasting_folder(spark, f"live-{spark.sparkContext.applicationId}-{zlib.crc32(d.encode()):08x}")
    return maintained.follow(maintained.LiveTable(spark, path), f"{d}/supplier.parquet", f"{d}/events.parquet", A.as_stations, A.as_measurements, A.as_snow)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return score_live(A.fixed_model(), _by_day(spark, d))


def _scored_accidents(spark: SparkSession, d: str) -> DataFrame:
    return A.fixed_model().score(A.accidents(spark, d).drop("k_cluster"))


def _stored(rows: DataFrame, purpose: str, write: Callable[[DataFrame, str], None]) -> str:
    path = shared_folder(rows.sparkSession, purpose)
    write(rows, path)
    return path


# ---- sources and sinks ----

@query
def scan_stations(spark, d):
    """Station dimension through a ;-separated file with a fixed schema."""
    rows = A.stations(spark, d)
    path = _stored(rows, "stations", lambda r, p: r.write.csv(p, sep=";", header=True))
    return readers.read_csv(spark, path, rows.schema, sep=";")


@query
def scan_csv(spark, d):
    rows = A.accidents(spark, d)
    path = _stored(rows, "accidents", lambda r, p: r.write.csv(p, header=True))
    return readers.read_csv(spark, path, rows.schema)


@query
def scan_live(spark, d):
    path = _stored(_live(spark, d), "live", sinks.write_result)
    return rounded(spark.read.parquet(path).select(
        "code", "station_code", "measure_date", "canton_code", "region_id", *FEATURES), *FEATURES)


@query
def scan_trimmed(spark, d):
    """Keys padded with blanks and tabs, inside quotes."""
    rows = A.measurements(spark, d).select("nr", F.concat(F.lit(" \t"), "station_code", F.lit("\t ")).alias("station_code"), "HS")
    path = _stored(rows, "padded", lambda r, p: r.write.csv(
        p, header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return readers.trim_key(readers.read_csv(spark, path, rows.schema), "station_code")


@query
def scan_history(spark, d):
    path = _stored(A.hist_weather(spark, d), "history", sinks.write_result)
    return spark.read.parquet(path)


def _semicolon_file(rows: DataFrame, schema, purpose: str) -> str:
    """Rows as a ;-separated file with the columns of a schema; those that rows lack are empty."""
    cells = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType) for f in schema]
    named = rows.select(*[c.alias(f.name) for c, f in zip(cells, schema)])
    return _stored(named, purpose, lambda r, p: r.write.csv(p, sep=";", header=True))


@query
def load_raw_accidents(spark, d):
    path = _semicolon_file(A.raw_accidents(spark, d), schemas.ACCIDENTS_RAW, "raw-accidents")
    return loaders.load_raw_accidents(spark, path)


@query
def load_weather_history(spark, d):
    return loaders.load_weather_history(spark, _semicolon_file(A.hist_weather(spark, d), schemas.HISTORY_WEATHER, "raw-weather"))


@query
def load_snow_history(spark, d):
    return loaders.load_snow_history(spark, _semicolon_file(snow_enriched(spark, d), schemas.HISTORY_SNOW, "raw-snow"))


@query
def ingest_json(spark, d):
    rows = A.measurements(spark, d).select("nr", "station_code", "measure_date", "HS", "TA_30MIN_MEAN")
    path = _stored(rows, "landed", lambda r, p: r.write.json(p))
    return readers.clear_nan(spark.read.schema(rows.schema).json(path))


def _as_arrays(rows: DataFrame, path: str, file: str, order: str) -> None:
    """One file for each value of file, which holds one array of the records of that value."""
    along = Window.partitionBy(file).orderBy(order)
    lines = rows.select(file, F.concat(
        F.when(F.row_number().over(along) == 1, "[").otherwise(""), F.to_json(F.struct(*[c for c in rows.columns if c != file])),
        F.when(F.lead(order).over(along).isNull(), "]").otherwise(",")).alias("value"))
    lines.write.partitionBy(file).text(path)


@query
def ingest_json_array(spark, d):
    """Landed arrays, one file a day, each read by as many tasks as it has byte ranges."""
    rows = A.measurements(spark, d).select("nr", "station_code", "measure_date", "HS", "TA_30MIN_MEAN", "date")
    path = _stored(rows, "landed-arrays", lambda r, p: _as_arrays(r, p, "date", "nr"))
    return readers.read_json_array(spark, path, rows.drop("date").schema)


@query
def freshness(spark, d):
    return listing.freshness(listing.file_status(spark, f"{d}/events.parquet"))


@query
def freshness_landed(spark, d):
    """Files of a day each, last written at noon of their day."""
    rows = A.measurements(spark, d).select("nr", "date")
    path = _stored(rows, "landed-days", lambda r, p: r.hint("rebalance", "date").write.partitionBy("date").parquet(p))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in listing.file_status(spark, path).select("path").collect():  # a few for each calendar day
        noon = dt.datetime.fromisoformat(re.search(r"date=([0-9-]{10})", file.path)[1]).replace(hour=12, tzinfo=dt.UTC)
        fs.setTimes(hadoop(file.path), int(noon.timestamp() * 1000), -1)
    return listing.freshness(listing.file_status(spark, path))


@query
def latest_date(spark, d):
    return rollup.latest_day(A.measurements(spark, d), "date")


@query
def append_batch(spark, d):
    """Two batches appended to one table, partitioned by day."""
    rows = A.measurements(spark, d).select("nr", "station_code", "date", "HS")
    path = shared_folder(spark, "appended")
    sinks.append_batch(rows.where("HS IS NOT NULL"), path, ["date"])
    sinks.append_batch(rows.where("HS IS NULL"), path, ["date"])
    return spark.read.parquet(path).select("nr", "station_code", F.col("date").cast("date"), "HS")


@query
def rewrite_clean(spark, d):
    """A table de-duplicated in place, in ranges of its key."""
    table = VersionedTable(spark, shared_folder(spark, "arrivals"), "range")
    table.write(A.arrivals(spark, d).withColumn("range", F.expr("l_orderkey div 8192")))
    sinks.clean_in_place(table, _DUP_KEYS, _DUP_ORDER)
    return table.read().drop("range")


@query
def ctas_clean(spark, d):
    name = "accidents_clean_" + shared_folder(spark, "").rsplit("-", 1)[1]
    rows = history.clean_accidents(A.raw_accidents(spark, d))
    return sinks.create_table_as(rows, name, shared_folder(spark, "ctas"))


@query
def preview(spark, d):
    return sinks.preview(A.measurements(spark, d).select("nr", "station_code", "measure_date", "HS"), ["measure_date", "nr"])


# ---- projections ----

@query
def project_measurements(spark, d):
    return cleaning.project_measurements(A.measurements(spark, d))


@query
def project_snow(spark, d):
    return cleaning.project_snow(A.snow(spark, d))


@query
def project_constants(spark, d):
    rows = A.measurements(spark, d).select("station_code", "measure_date", "HS")
    return cleaning.with_constants(rows, nr="001", imis_type="SNOW")


@query
def more_measurements(spark, d):
    return history.more_measurements(A.measurements(spark, d), "2024-01-10")


@query
def more_snow(spark, d):
    return history.more_snow(A.raw_snow(spark, d), "1997")


@query
def station_label(spark, d):
    return A.stations(spark, d).select(
        "code", labels.station_label(F.col("canton_code"), F.col("code"), F.col("station_name"), F.col("elevation")).alias("label"))


@query
def station_url(spark, d):
    return A.stations(spark, d).select("code", labels.station_url(F.col("code")).alias("url"))


@query
def live_label(spark, d):
    return _live(spark, d).select(
        "code", "measure_date",
        labels.live_label(F.col("canton_code"), F.col("station_code"), F.col("station_name")).alias("label"))


@query
def clean_accidents(spark, d):
    return history.clean_accidents(A.raw_accidents(spark, d))


@query
def distinct_values(spark, d):
    return cleaning.distinct_values(A.accidents(spark, d), "alpine_region")


# ---- filters ----

@query
def latest_slice(spark, d):
    return filters.latest_slice(A.measurements(spark, d), "date").select("nr", "station_code", "date", "HS", "TA_30MIN_MEAN")


@query
def filter_region(spark, d):
    return filters.by_region(A.accidents(spark, d), "Eastern Alps", "canton").select("acc_id", "canton", "date")


@query
def filter_canton(spark, d):
    return filters.by_canton(A.accidents(spark, d), "GR", "canton").select("acc_id", "canton", "date")


@query
def filter_stations(spark, d):
    return filters.by_members(A.measurements(spark, d), "station_code", ["S1", "S2", "S4"]).select("nr", "station_code", "HS")


@query
def filter_date_range(spark, d):
    return filters.by_date_range(A.accidents(spark, d), "date", "1996-02-01", "1998-03-31").select("acc_id", "date")


@query
def filter_year_month(spark, d):
    rows = A.accidents(spark, d).where(dates.in_years(F.col("date"), [1996, 1997, 1999]) & dates.in_month(F.col("date"), 2))
    return rows.select("acc_id", "date")


@query
def filter_season_month(spark, d):
    """Slider position 3 (January) of the winter that starts in 1997."""
    year, month = dates.season_month(3, 1997)
    return A.accidents(spark, d).where(dates.in_month(F.col("date"), month, year)).select("acc_id", "date")


@query
def filter_date(spark, d):
    return filters.by_date(A.accidents(spark, d), "date", "1998-02-10").select("acc_id", "date")


@query
def filter_risk(spark, d):
    rows = A.accidents(spark, d).withColumn("risk_group", labels.cluster_risk(F.col("k_cluster")))
    return filters.by_members(rows, "risk_group", ["1 - very low", "4 - considerable"]).select("acc_id", "k_cluster", "risk_group")


@query
def drop_incomplete(spark, d):
    return filters.complete(A.accidents(spark, d)).select("acc_id", *FEATURES)


@query
def split_missing(spark, d):
    known, missing = filters.split_missing(A.accidents(spark, d).select("acc_id", "start_zone_elevation"), "start_zone_elevation")
    return unions.union_tagged(known=known, missing=missing)


@query
def since_date(spark, d):
    return filters.since(A.hist_weather(spark, d), "measure_date", "1997-12-31").select("station_code", "measure_date", "air_temp_day_mean")


@query
def since_hyear(spark, d):
    return filters.since_hyear(A.hist_snow(spark, d), "1998").select("station_code", "measure_date", "hyear", "snow_height_cm")


# ---- joins ----

@query
def outer_weather_snow(spark, d):
    rows = enrich.outer_weather_snow(daily_features(A.measurements(spark, d)), cleaning.project_snow(A.snow(spark, d)))
    return rounded(rows, *_LIVE_MEASURES)


@query
def live_table(spark, d):
    return rounded(_live(spark, d), *_LIVE_MEASURES)


@query
def snow_enriched(spark, d):
    recent = filters.since(cleaning.iso_days(A.raw_snow(spark, d)), "measure_date", "1997-12-31")
    return enrich.snow_enriched(recent, A.stations(spark, d))


@query
def radius_weather(spark, d):
    rows = radius.weather_near(_bare_accidents(spark, d), A.hist_weather(spark, d))
    return rounded(rows.select("acc_id", *HISTORY_WEATHER.values()), *HISTORY_WEATHER.values())


@query
def radius_snow(spark, d):
    rows = radius.snow_near(_bare_accidents(spark, d), A.hist_snow(spark, d))
    return rounded(rows.select("acc_id", *HISTORY_SNOW.values()), *HISTORY_SNOW.values())


def _bare_accidents(spark, d):
    return A.accidents(spark, d).select("acc_id", "date", history.LATITUDE, history.LONGITUDE)


@query
def training_rows(spark, d):
    """The historical pipeline from its raw table on: clean, fill, weather, snow, region, class."""
    rows = history.training_rows(history.clean_accidents(A.raw_accidents(spark, d)), A.hist_weather(spark, d), A.hist_snow(spark, d))
    names = [*HISTORY_WEATHER.values(), *HISTORY_SNOW.values()]
    return rounded(rows.select("acc_id", "date", "canton", "start_zone_elevation", *names, "alpine_region", "elevation_group"), *names)


@query
def training_means(spark, d):
    """Mean position and number of rows per cluster, of what a training run writes."""
    written = history.training_outputs(A.fixed_model(), history.classed(A.accidents(spark, d).drop("k_cluster")))
    counts_ = written["centres"].select(F.col("cluster").alias("k_cluster"), F.col("count").alias("n")).where("n > 0")
    means = written["means"].select("k_cluster", F.round("PCA1", 6).alias("PCA1"), F.round("PCA2", 6).alias("PCA2"))
    return means.join(counts_, "k_cluster")


@query
def knn_neighbours(spark, d):
    known, missing = filters.split_missing(A.accidents(spark, d), "start_zone_elevation")
    found = neighbours.nearest_neighbours(missing, known, 3, x=history.LATITUDE, y=history.LONGITUDE)
    return found.select("acc_id", "neighbour", "rank")


@query
def knn_impute(spark, d):
    rows = A.accidents(spark, d).select("acc_id", history.LATITUDE, history.LONGITUDE, "start_zone_elevation")
    return history.filled_accidents(rows).select("acc_id", "start_zone_elevation")


@query
def risk_lookup(spark, d):
    return enrich.with_risk(A.accidents(spark, d)).select("acc_id", "k_cluster", "risk_group", "character", "colour")


# ---- aggregations and windows ----

_DUP_KEYS = ["l_orderkey", "l_linenumber"]
_DUP_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_LIVE_MEASURES = [
    "air_temp_mean_stations", "wind_speed_max_stations", "snow_surf_temp_mean_stations", "snow_ground_temp_mean_stations",
    "snow_height_mean_stations", "new_snow_mean_stations",
]


@query
def dedupe_keep_first(spark, d):
    return cleaning.keep_first(A.arrivals(spark, d), _DUP_KEYS, _DUP_ORDER)


@query
def daily_rollup(spark, d):
    return rounded(daily_measurements(A.measurements(spark, d)), *ROLLUP_MEDIANS, *ROLLUP_MEANS, *ROLLUP_MAXIMA)


@query
def daily_rollup_split(spark, d):
    """The plan for groups with very many rows, here for every group above 10 rows."""
    rows = A.measurements(spark, d)
    rolled = rollup.daily_rollup(rows, ["date"], "measure_date", ["HS"], ["TA_30MIN_MEAN"], ["VW_30MIN_MAX"], hot_rows=10)
    return rounded(rolled, "HS", "TA_30MIN_MEAN", "VW_30MIN_MAX")


@query
def trend_daily_mean(spark, d):
    return rounded(rollup.means_per_day(_live(spark, d), "measure_date", FEATURES), *FEATURES)


@query
def scalar_stats(spark, d):
    return rounded(rollup.scalar_stats(A.measurements(spark, d), "TA_30MIN_MEAN"), "min_value", "max_value", "mean_value")


@query
def map_centre(spark, d):
    return rounded(rollup.map_centre(A.stations(spark, d)), "centre_lat", "centre_lon")


def _register_heatmap(feature: str) -> None:
    def run(spark, d):
        return counts.accident_heatmap(A.accidents(spark, d), 1998, feature)

    QUERIES[f"accident_heatmap_{feature}"] = run


for _feature in HEATMAP_FEATURES:
    _register_heatmap(_feature)


@query
def accidents_by_region(spark, d):
    return counts.accidents_by_region(A.accidents(spark, d))


@query
def accidents_by_region_filtered(spark, d):
    """One month and two risk groups, as the panel's controls choose them."""
    rows = A.accidents(spark, d).where(dates.in_month(F.col("date"), 2))
    rows = rows.withColumn("risk_group", labels.cluster_risk(F.col("k_cluster")))
    return counts.accidents_by_region(filters.by_members(rows, "risk_group", ["1 - very low", "4 - considerable"]))


@query
def max_yearly_accidents(spark, d):
    return counts.max_yearly_accidents(A.accidents(spark, d))


@query
def risk_matrix_canton(spark, d):
    return rounded(panels.risk_matrix(_scored(spark, d), 2023, 3), "k_mean")


@query
def risk_matrix_station(spark, d):
    return rounded(panels.risk_matrix(_scored(spark, d), 2023, group="station_code"), "k_mean")


@query
def risk_matrix_class(spark, d):
    cells = panels.risk_matrix(_scored(spark, d), 2023, 3, region="Western Alps")
    return cells.select("canton_code", "measure_date", F.col("k_mean").cast("int").alias("k_class"), "colour")


@query
def risk_matrix_mode(spark, d):
    """The option to take the most frequent label; ties go to the lowest."""
    return panels.risk_matrix(_scored(spark, d), 2023, 3, most_frequent=True)


@query
def cluster_share(spark, d):
    return rounded(counts.cluster_share(A.accidents(spark, d)), "percentage")


@query
def cluster_mean_position(spark, d):
    return rounded(counts.cluster_means(_scored_accidents(spark, d), ["PCA1", "PCA2"]), "PCA1", "PCA2")


@query
def normalised_cluster_means(spark, d):
    names = [f + "_norm" for f in FEATURES]
    return rounded(counts.normalised_cluster_means(A.accidents(spark, d), FEATURES), *names)


@query
def accidents_by_month(spark, d):
    return counts.accidents_by_month(A.accidents(spark, d))


@query
def row_count(spark, d):
    return rollup.row_count(A.hist_snow(spark, d))


@query
def moving_avg_global(spark, d):
    rows = rollup.means_per_day(_live(spark, d), "measure_date", FEATURES)
    rows = moving.moving_average(rows, FEATURES, 7, ["measure_date"])
    return rounded(rows, *FEATURES, *[f + "_avg" for f in FEATURES])


@query
def moving_avg_station(spark, d):
    rows = daily_features(A.measurements(spark, d)).select("station_code", "measure_date", "air_temp_mean_stations")
    rows = moving.moving_average(rows, ["air_temp_mean_stations"], 3, ["measure_date"], ["station_code"])
    return rounded(rows, "air_temp_mean_stations", "air_temp_mean_stations_avg")


@query
def moving_avg_blocks(spark, d):
    """Moving average over raw readings, whose groups may have any length."""
    rows = A.measurements(spark, d).select("nr", "station_code", "measure_ts", "TSS_30MIN_MEAN")
    rows = moving.moving_average(rows, ["TSS_30MIN_MEAN"], 5, ["measure_ts", "nr"], ["station_code"])
    return rounded(rows, "TSS_30MIN_MEAN", "TSS_30MIN_MEAN_avg")


@query
def sorted_groups(spark, d):
    return cleaning.sorted_groups(A.accidents(spark, d), "canton")


@query
def sorted_risk_groups(spark, d):
    rows = A.accidents(spark, d).withColumn("risk_group", labels.cluster_risk(F.col("k_cluster")))
    return cleaning.sorted_groups(rows, "risk_group", descending=False)


# ---- unions ----

@query
def union_train_live(spark, d):
    training = filters.complete(A.accidents(spark, d)).select(*FEATURES)
    today = filters.complete(_live(spark, d)).select(*FEATURES)
    return rounded(unions.union_tagged(training=training, live=today), *FEATURES)


@query
def risk_scatter(spark, d):
    rows = panels.risk_scatter(_scored_accidents(spark, d), _scored(spark, d), unions.stored_centres(spark))
    return rounded(rows, "PCA1", "PCA2")


# ---- scalar functions ----

@query
def iso_day(spark, d):
    return A.measurements(spark, d).select("nr", dates.iso_day(F.col("measure_date")).alias("day"))


@query
def midnight_stamp(spark, d):
    stamp = F.col("measure_date")
    return A.measurements(spark, d).select(
        "nr", dates.midnight_stamp(stamp).alias("stamp"), dates.midnight_stamp(stamp, zulu=False).alias("local_stamp"))


@query
def parse_ts(spark, d):
    return A.measurements(spark, d).select("nr", dates.parse_ts(F.substring("measure_date", 1, 19)).cast("timestamp_ntz").alias("t"))


@query
def parse_ts_lenient(spark, d):
    """Texts that are no timestamps (every value of HS that is missing) give NULL."""
    text = F.when(F.col("HS").isNotNull(), F.substring("measure_date", 1, 19)).otherwise("not a date")
    return A.measurements(spark, d).select("nr", dates.parse_ts_lenient(text).cast("timestamp_ntz").alias("t"))


@query
def format_date(spark, d):
    return A.measurements(spark, d).select(
        "nr", dates.day_text(F.col("date")).alias("day_text"), dates.minute_text(F.col("measure_ts")).alias("minute_text"))


@query
def default_range(spark, d):
    return panels.default_range(A.measurements(spark, d).withColumnRenamed("measure_date", "_t").withColumnRenamed("date", "measure_date"))


@query
def floor_bins(spark, d):
    """Bins of width 5 that go downwards below zero."""
    from firnline.functions.numbers import floor_bin

    return A.accidents(spark, d).select("acc_id", floor_bin(F.col("air_temp_mean_stations"), 5).alias("bin"))


@query
def elevation_group(spark, d):
    return A.stations(spark, d).select("code", "elevation", places.elevation_group(F.col("elevation")).alias("elevation_group"))


@query
def alpine_region_live(spark, d):
    return A.stations(spark, d).select("code", places.alpine_region_live(F.col("canton_code")).alias("alpine_region"))


@query
def alpine_region_hist(spark, d):
    return A.accidents(spark, d).select("acc_id", places.alpine_region_hist(F.col("canton")).alias("alpine_region"))


@query
def region_id(spark, d):
    return A.accidents(spark, d).select("acc_id", places.region_id(F.col("alpine_region")).alias("region_id"))


@query
def haversine(spark, d):
    """Distance of every accident from the point 46.5 N, 9.8 E."""
    km = places.haversine_km(F.col(history.LATITUDE), F.col(history.LONGITUDE), F.lit(46.5), F.lit(9.8))
    return rounded(A.accidents(spark, d).select("acc_id", km.alias("km")), "km")


# ---- scaling, clusters, projection ----

_F = A.TRAINING_FEATURES
_Z = ["z1", "z2", "z3", "z4"]


@query
def scaler_fit(spark, d):
    return rounded(scaling.scaler_fit(A.training(spark, d), _F), "mean", "std")


@query
def scaler_apply(spark, d):
    rows = A.training(spark, d)
    return rounded(scaling.Scaler.fit(rows, _F).apply(rows).select("row_id", *_Z), *_Z)


def _label_centres(rows: DataFrame) -> dict[int, list[float]]:
    """Class means as centres, rounded so that both engines start from the same numbers."""
    means = counts.cluster_means(rows, _F, "label")
    return {r["label"]: [r[f] for f in _F] for r in means.select("label", *[F.round(f, 6).alias(f) for f in _F]).collect()}


@query
def kmeans_assign(spark, d):
    rows = A.training(spark, d)
    return rows.select("row_id", clusters.nearest_centre(_F, _label_centres(rows)).alias("k_cluster"))


def _model(rows: DataFrame) -> clusters.RiskModel:
    return clusters.RiskModel.fit(rows, _F, k=5, stored=None, key=["row_id"])


@query
def kmeans_fit(spark, d):
    rows = A.training(spark, d)
    return _model(rows).score(rows).select("row_id", "k_cluster")


@query
def kmeans_fixpoint(spark, d):
    """One more step from the fitted centres: the rounded mean of each centre's rows, and whether it is the centre."""
    rows = A.training(spark, d)
    model = _model(rows)
    points = lattice.to_lattice(model.scaler.apply(rows), _Z, ["row_id"])
    most = lattice.limit(len(_Z))
    centres = [tuple(round(z * lattice.UNIT) + most for z in model.centres[n]) for n in sorted(model.centres)]
    return lattice.fixpoint(points, centres).select("k_cluster", "n", *[F.round((F.col(f"q{i + 1}") - most) / lattice.UNIT, 8).alias(z) for i, z in enumerate(_Z)], "fixed")


def _scaled_training(spark: SparkSession, d: str) -> DataFrame:
    rows = A.training(spark, d)
    return scaling.Scaler.fit(rows, _F).rounded().apply(rows)


@query
def pca_fit(spark, d):
    axes = clusters.pca_components(_scaled_training(spark, d), _Z)
    cells = [(i + 1, f, float(w)) for i, axis in enumerate(axes) for f, w in zip(_F, axis)]
    return rounded(spark.createDataFrame(cells, "component INT, feature STRING, loading DOUBLE"), "loading")


@query
def pca_residual(spark, d):
    """Eigenvalues, and what is left of covariance times loadings less eigenvalue times loadings."""
    matrix = clusters.covariance(_scaled_training(spark, d), _Z)
    cells = []
    for i, (value, axis) in enumerate(clusters.principal_axes(matrix)):
        left = [sum(c * w for c, w in zip(row, axis)) - value * w for row, w in zip(matrix, axis)]
        cells.append((i + 1, float(value), max(map(abs, left))))
    return spark.createDataFrame(cells, "component INT, eigenvalue DOUBLE, residual DOUBLE").withColumns(
        {"eigenvalue": F.round("eigenvalue", 8), "residual": F.round("residual", 8)})


@query
def pca_apply(spark, d):
    rows = A.training(spark, d)
    scaled = scaling.Scaler.fit(rows, _F).apply(rows)
    return rounded(scaling.project(scaled, _Z, A.AXES).select("row_id", "PCA1", "PCA2"), "PCA1", "PCA2")


@query
def elbow(spark, d):
    return rounded(clusters.elbow(_scaled_training(spark, d), _Z, key=["row_id"]), "inertia")


@query
def inertia_fixed(spark, d):
    """Cost of the class means as centres: what the elbow sweep reports for fitted ones."""
    rows = A.training(spark, d)
    return rounded(clusters.inertia(rows, _F, _label_centres(rows)), "inertia")


@query
def centres_original(spark, d):
    """Class centres in z-scores, taken back to original units."""
    rows = A.training(spark, d)
    scaler = scaling.Scaler.fit(rows, _F)
    z = counts.cluster_means(scaler.apply(rows), _Z, "label")
    back = z.select("label", *[scaler.restore_column(f, F.col(n)).alias(f) for f, n in zip(_F, _Z)])
    return rounded(back, *_F)


@query
def cluster_profile(spark, d):
    rows = A.training(spark, d)
    return rounded(clusters.cluster_profile(rows, _F, "label"), *_F, "percentage")


# ---- panels ----

@query
def station_options(spark, d):
    return panels.station_options(A.stations(spark, d), "Eastern Alps")


@query
def canton_options(spark, d):
    return panels.canton_options(A.stations(spark, d), "Eastern Alps")


@query
def station_overview(spark, d):
    rows = panels.station_overview(A.stations(spark, d), "Entire Alpine Region")
    return rounded(rows, "lat", "lon")


def _register_measure(measure: str) -> None:
    def latest(spark, d):
        return rounded(panels.latest_map(_by_day(spark, d), measure), "lat", "lon", "z")

    def overall(spark, d):
        return rounded(panels.trend(_by_day(spark, d), measure), "value", "value_avg")

    def by_station(spark, d):
        return rounded(panels.trend(_by_day(spark, d), measure, window=3, per_station=True), "value", "value_avg")

    QUERIES[f"latest_map_{measure}"] = latest
    QUERIES[f"trend_{measure}"] = overall
    QUERIES[f"trend_{measure}_stations"] = by_station


for _measure in PANEL_MEASURES:
    _register_measure(_measure)


@query
def weather_trend(spark, d):
    rows = panels.weather_trend(_by_day(spark, d), "Eastern Alps", start="2024-01-03", end="2024-01-25")
    return rounded(rows, *FEATURES)


@query
def future_marker(spark, d):
    """Seasons whose January has nothing to show."""
    seasons = [panels.empty_marker(panels.risk_matrix(_scored(spark, d), year, 3)).withColumn("first_year", F.lit(year)) for year in (2023, 2030)]
    return reduce(DataFrame.unionByName, seasons)


# ---- streaming ----

def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = A.table(spark, d, "events").schema
    # a pattern, so that the table may be one file or a folder of files
    return A.as_measurements(jobs.landed_files(spark, f"{d}/events.parque[t]", schema))


@query
def stream_ingest(spark, d):
    root = shared_folder(spark, "ingest")
    rows = _event_stream(spark, d).select("nr", "station_code", "measure_date", "date", "HS")
    jobs.append_stream(rows, f"{root}/table", f"{root}/checkpoint", ["date"])
    return spark.read.parquet(f"{root}/table").select("nr", "station_code", "measure_date", F.col("date").cast("date"), "HS")


@query
def stream_dedupe(spark, d):
    """First reading per station and hour."""
    root = shared_folder(spark, "dedupe")
    rows = _event_stream(spark, d).select(
        "nr", "station_code", F.date_format("measure_ts", "yyyy-MM-dd HH").alias("hour"), "date", "HS")
    jobs.dedupe_stream(rows, f"{root}/table", f"{root}/checkpoint", ["station_code", "date", "hour"], ["nr"], "date")
    return spark.read.parquet(f"{root}/table").select("nr", "station_code", "hour", "HS")


@query
def stream_daily(spark, d):
    root = shared_folder(spark, "daily")
    jobs.daily_stream(_event_stream(spark, d).drop("measure_ts"), f"{root}/readings", f"{root}/daily", f"{root}/checkpoint",
                      "date", daily_measurements)
    rows = spark.read.parquet(f"{root}/daily").withColumn("date", F.col("date").cast("date"))
    return rounded(rows, *ROLLUP_MEDIANS, *ROLLUP_MEANS, *ROLLUP_MAXIMA)


@query
def stream_score(spark, d):
    """New daily rows scored with the stored model."""
    root = shared_folder(spark, "score")
    model = A.fixed_model()
    model.save(spark, f"{root}/model")
    sinks.write_result(_live(spark, d), f"{root}/live")
    stream = jobs.landed_files(spark, f"{root}/live", spark.read.parquet(f"{root}/live").schema)
    jobs.score_stream(stream, clusters.RiskModel.load(spark, f"{root}/model"), f"{root}/scored", f"{root}/checkpoint")
    rows = spark.read.parquet(f"{root}/scored").select("station_code", "measure_date", "k_cluster", "PCA1", "PCA2")
    return rounded(rows, "PCA1", "PCA2")
