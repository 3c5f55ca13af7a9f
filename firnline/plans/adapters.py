"""Domain tables derived from the generic test tables, by arithmetic on their columns.

The test tables hold no coordinates, no NULLs and no cantons. Each adapter is a plain
projection of one table, so filters and column choices reach its Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from firnline.functions.places import alpine_region_hist, alpine_region_live
from firnline.operators.clusters import RiskModel
from firnline.operators.scaling import Scaler
from firnline.sources.readers import read_table
from firnline.vocabulary import CLUSTER_CENTRES, FEATURES

# 25 codes by nation number: the 20 that have a region, then 5 that have none
CANTONS = "AI,AR,SG,GR,GL,FL,VD,FR,GE,NE,JU,BE,NW,OW,LU,UR,SZ,SO,TI,VS,ZH,AG,ZG,BL,TG"

# a fixed model for row-wise scoring: scale, axes at right angles, published centres
SCALE_MEANS = [-6.0, 12.0, 150.0, 9.0]
SCALE_STDS = [6.0, 5.0, 60.0, 11.0]
AXES = [[0.5, 0.5, 0.5, 0.5], [0.5, -0.5, 0.5, -0.5]]


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; its schema is read from the files once per process."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = read_table(spark, folder, name, _SCHEMAS.get((folder, name)))
    _SCHEMAS.setdefault((folder, name), rows.schema)
    return rows


def stations(spark: SparkSession, folder: str) -> DataFrame:
    return as_stations(table(spark, folder, "supplier"))


def as_stations(supplier: DataFrame) -> DataFrame:
    rows = supplier.selectExpr(
        "concat('S', CAST(s_suppkey AS STRING)) AS code", "s_name AS station_name",
        "6e0 + (s_suppkey * 104729 % 10009) * 4e-4 AS lon", "46e0 + (s_suppkey * 7919 % 10007) * 12e-5 AS lat",
        "CAST(1200 + s_suppkey * 53 % 4200 AS INT) AS elevation",
        "CASE WHEN s_nationkey = 5 THEN 'LI' ELSE 'CH' END AS country_code",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'WIND' ELSE 'SNOW_FLAT' END AS type",
        f"split_part('{CANTONS}', ',', s_nationkey + 1) AS canton_code",
    )
    return rows.withColumn("alpine_region", alpine_region_live(F.col("canton_code")))


MEASUREMENT_COLUMNS = [
    "event_id AS nr", "concat('S', CAST(user_id AS STRING)) AS station_code",
    "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS measure_date", "ts AS measure_ts", "CAST(ts AS DATE) AS date",
    "CASE WHEN event_type <> 'view' THEN value * 1.0173926451733e0 END AS HS",
    "CASE WHEN event_type <> 'error' THEN value * 0.0973126457311e0 - 20e0 END AS TA_30MIN_MEAN",
    "CAST(event_id % 101 AS DOUBLE) AS RH_30MIN_MEAN",
    "value * 0.0831726459107e0 - 25e0 AS TSS_30MIN_MEAN",
    "CASE WHEN event_type <> 'signup' THEN (event_id % 50) * 0.1029384756473e0 - 5e0 END AS TS0_30MIN_MEAN",
    "(event_id % 40) / 10e0 - 4e0 AS TS25_30MIN_MEAN",
    "(event_id % 30) / 10e0 - 3e0 AS TS50_30MIN_MEAN",
    "(event_id % 20) / 10e0 - 2e0 AS TS100_30MIN_MEAN",
    "CAST(event_id % 700 AS DOUBLE) AS RSWR_30MIN_MEAN",
    "CASE WHEN event_type IN ('click', 'view', 'error') THEN value * 0.0517394820167e0 END AS VW_30MIN_MEAN",
    "CASE WHEN event_type IN ('click', 'view', 'error') THEN value * 0.1013729104733e0 END AS VW_30MIN_MAX",
    "CAST(event_id % 360 AS DOUBLE) AS DW_30MIN_MEAN",
    "CAST(event_id % 45 AS DOUBLE) AS DW_30MIN_SD",
]


def as_measurements(events: DataFrame) -> DataFrame:
    """Works on a table and on a stream."""
    return events.selectExpr(*MEASUREMENT_COLUMNS)


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    return as_measurements(table(spark, folder, "events"))


def snow(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a snow reading, some without a value; stations are those of the next user, so either side has unmatched ones."""
    return as_snow(table(spark, folder, "events"))


def as_snow(events: DataFrame) -> DataFrame:
    rows = events.selectExpr(
        "concat('S', CAST(user_id + 1 AS STRING)) AS station_code", "CAST(ts AS DATE) AS measure_date",
        "CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN value END AS value")
    daily = rows.groupBy("station_code", "measure_date").agg((F.max("value") * 1.0173926451733).alias("HS"), (F.min("value") * 0.0983174629151).alias("HN_1D"))
    return daily.selectExpr("*", _HYEAR)


_HYEAR = (
    "CAST(CASE WHEN month(measure_date) >= 10 THEN year(measure_date) + 1 ELSE year(measure_date) END AS STRING) AS hyear"
)


def accidents(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS acc_id", "CAST(o_orderdate AS DATE) AS date",
        f"split_part('{CANTONS}', ',', CAST(o_custkey % 25 AS INT) + 1) AS canton",
        "concat('M', CAST(o_custkey % 500 AS STRING)) AS municipality",
        "46e0 + (o_orderkey * 7919 % 100003) * 12e-6 AS start_zone_coordinates_latitude",
        "6e0 + (o_orderkey * 104729 % 100019) * 4e-5 AS start_zone_coordinates_longitude",
        "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(1000 + o_orderkey * 67 % 3000 AS DOUBLE) END"
        " AS start_zone_elevation",
        "CAST(o_orderkey % 3 AS INT) AS number_dead", "CAST(o_orderkey % 6 + 1 AS INT) AS number_caught",
        "CAST(o_orderkey % 4 AS INT) AS number_fully_buried",
        "CASE WHEN o_orderpriority <> '1-URGENT' THEN (o_orderkey * 37 % 451) / 10e0 - 30e0 END AS air_temp_mean_stations",
        "(o_orderkey * 41 % 300) / 10e0 AS wind_speed_max_stations",
        "CASE WHEN o_orderpriority <> '5-LOW' THEN (o_orderkey * 43 % 3500) / 10e0 END AS snow_height_mean_stations",
        "(o_orderkey * 47 % 601) / 10e0 AS new_snow_mean_stations",
        "CAST(o_orderkey * 31 % 13 % 5 AS INT) AS k_cluster",
    )
    return rows.withColumn("alpine_region", alpine_region_hist(F.col("canton")))


def raw_accidents(spark: SparkSession, folder: str) -> DataFrame:
    """Accidents with the further columns of the raw table."""
    return accidents(spark, folder).withColumns({
        "avalanche_id": F.col("acc_id"), "date_quality": F.lit("0"), "coordinates_quality": F.lit("0"),
        "hydrological_year": F.year("date").cast("string"), "activity": F.lit("tour"),
    })


_PLACE = [
    "concat('S', CAST(l_suppkey AS STRING)) AS station_code", "CAST(l_shipdate AS DATE) AS measure_date",
    "46e0 + (l_suppkey * 7919 % 10007) * 12e-5 AS imis_latitude",
    "6e0 + (l_suppkey * 104729 % 10009) * 4e-4 AS imis_longitude",
]


def hist_weather(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        *_PLACE, "CASE WHEN l_returnflag <> 'R' THEN l_quantity - 25e0 END AS air_temp_day_mean",
        "l_tax * 50e0 AS wind_speed_day_mean", "l_tax * 100e0 AS wind_speed_day_max",
        "l_quantity / 2e0 - 20e0 AS snow_surf_temp_day_mean",
        "CASE WHEN l_linestatus = 'F' THEN l_linenumber / 4e0 - 1e0 END AS snow_ground_temp_day_mean",
    )


def hist_snow(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").selectExpr(
        *_PLACE, "l_discount * 1000e0 AS snow_height_cm",
        "CASE WHEN l_returnflag <> 'A' THEN l_tax * 100e0 END AS new_snow_cm",
    )
    return rows.selectExpr("*", _HYEAR)


def raw_snow(spark: SparkSession, folder: str) -> DataFrame:
    """Snow history before it is joined with its stations; the date is an ISO text."""
    return hist_snow(spark, folder).selectExpr(
        "station_code", "concat(CAST(measure_date AS STRING), 'T06:00:00') AS measure_date", "hyear",
        "snow_height_cm AS HS", "new_snow_cm AS HN_1D",
    )


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose key (l_orderkey, l_linenumber) comes in several copies."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )


TRAINING_FEATURES = ["f1", "f2", "f3", "f4"]


def training(spark: SparkSession, folder: str) -> DataFrame:
    """Four features from the whole vector: sums of every fourth component."""
    part = "aggregate(filter(embedding, (x, i) -> i % 4 = {0}), 0D, (a, x) -> a + CAST(x AS DOUBLE)) AS f{1}"
    return table(spark, folder, "embeddings").selectExpr("vec_id AS row_id", "label", *[part.format(i, i + 1) for i in range(4)])


def fixed_model() -> RiskModel:
    scaler = Scaler(FEATURES, SCALE_MEANS, SCALE_STDS)
    centres = {
        n: [(v - m) / s for v, m, s in zip(c, SCALE_MEANS, SCALE_STDS)] for n, c in CLUSTER_CENTRES.items()
    }
    return RiskModel(scaler, centres, AXES)
