"""Equi-joins: weather with snow, measures with stations, cluster names."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.labels import cluster_character, cluster_colour, cluster_risk
from firnline.functions.places import alpine_region_live, elevation_group, region_id
from firnline.operators.filters import with_region
from firnline.session import HOT_ROWS, broadcast_if_small, stored

KEYS = ["station_code", "measure_date"]


def outer_weather_snow(weather: DataFrame, snow: DataFrame, one_snow_row_per_day: bool = False) -> DataFrame:
    """Full outer join on (station, day).

    ``weather`` holds one row per key. Two snow readings on one day give two rows, unless
    the option is set.
    """
    if one_snow_row_per_day:
        values = [c for c in snow.columns if c not in KEYS]
        snow = snow.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in values])
    return salted_outer(weather, snow, KEYS)


def salted_outer(single: DataFrame, many: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """Full outer join of ``single``, with one row per key, and ``many``, whose keys may repeat without bound.

    Spark cannot split a key of a full outer join. Keys of more than ``hot_rows`` rows are found by
    counting. Equal rows of such a key become one row with their number, rows are dealt by their hash over as many
    salts as the key fills, and the key's row of ``single`` is copied to each salt. A copy that meets no row
    is dropped: another one has, since the key is in ``many``. Rows with NULL in a key match nothing; they are
    dealt like any others, and never copied.
    """
    most = hot_rows or HOT_ROWS
    counted = many.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    if counted.isEmpty():
        return single.join(many, keys, "full_outer")
    # at most one row for every hot_rows rows of many
    hot = stored(counted.select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / most).cast("int").alias("_salts")), "hot-keys")
    columns = [*keys, *[c for side in (single, many) for c in side.columns if c not in keys]]
    hot, drop = broadcast_if_small(hot), [f"_{k}" for k in keys]
    same = lambda side: reduce(and_, [side[k].eqNullSafe(hot[f"_{k}"]) for k in keys])
    salt = F.pmod(F.xxhash64(*many.columns), "_salts").cast("int")
    heavy = many.join(hot, same(many)).drop(*drop).groupBy(*many.columns, "_salts").agg(F.count("*").cast("int").alias("_times")) \
        .withColumn("_salt", salt).drop("_salts")
    light = many.join(hot, same(many), "left_anti").withColumns({"_times": F.lit(1), "_salt": F.lit(0)})
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    copied = single.join(hot, same(single), "left").drop(*drop).withColumn("_hot", F.col("_salts").isNotNull() & whole)
    copied = copied.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))))
    joined = copied.drop("_salts").join(light.unionByName(heavy), [*keys, "_salt"], "full_outer")
    joined = joined.where(F.col("_times").isNotNull() | ~F.col("_hot"))
    return joined.withColumn("_time", F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1))))).select(*columns)


def measured_stations(stations: DataFrame, measures: DataFrame) -> DataFrame:
    """Measures with the columns of their station: the dimension is broadcast behind a size check, otherwise AQE splits hot stations."""
    side = broadcast_if_small(stations)
    matched = measures.join(side, measures["station_code"] == stations["code"], "inner")
    return matched.select(*[stations[c] for c in stations.columns], *[measures[c] for c in measures.columns])


def silent_stations(stations: DataFrame, seen: DataFrame) -> DataFrame:
    """Stations whose code is not among the station codes of ``seen``."""
    seen = seen.select(F.col("station_code").alias("_seen")).distinct()
    return stations.join(seen, stations["code"] == seen["_seen"], "left_anti")


def with_stations(stations: DataFrame, measures: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Stations LEFT JOIN measures, written so that the measures never move for a hot station.

    A left join with the dimension on the kept side cannot broadcast the dimension and
    cannot split a hot station. The same rows come from an inner join plus the stations
    that no measure names. ``seen`` gives the station codes of the measures where they can be
    had for less than the measures themselves.
    """
    silent = silent_stations(stations, measures if seen is None else seen)
    return measured_stations(stations, measures).unionByName(silent, allowMissingColumns=True)


def described_stations(stations: DataFrame) -> DataFrame:
    """Stations of a region, with its id and their elevation class."""
    described = stations.withColumn("alpine_region", alpine_region_live(F.col("canton_code")))
    return with_region(described).withColumns({
        "region_id": region_id(F.col("alpine_region")),
        "elevation_group": elevation_group(F.col("elevation")),
    })


def live_table(stations: DataFrame, weather: DataFrame, snow: DataFrame) -> DataFrame:
    """Stations with their daily weather and snow, region id and elevation class.

    Rows without a region are removed, and with them every measure that has no station:
    what starts as a full outer join is a left join from the stations. The region filter
    is applied to the stations, before the join.
    """
    # the codes alone need neither the join nor the aggregates below it
    seen = weather.select("station_code").union(snow.select("station_code"))
    return with_stations(described_stations(stations), outer_weather_snow(weather, snow), seen)


def snow_enriched(snow: DataFrame, stations: DataFrame) -> DataFrame:
    """Snow history with the columns of its station; readings without one drop out."""
    chosen = stations.select(
        "code", "station_name", F.col("lon").alias("imis_longitude"), F.col("lat").alias("imis_latitude"),
        F.col("elevation").alias("imis_elevation"), F.col("canton_code").alias("canton"),
    )
    side = broadcast_if_small(chosen)
    return snow.join(side, snow["station_code"] == chosen["code"]).select(
        "station_code", "station_name", "imis_longitude", "imis_latitude", "imis_elevation", "canton",
        F.lit("SNOW").alias("imis_type"), "measure_date", "hyear",
        F.col("HS").alias("snow_height_cm"), F.col("HN_1D").alias("new_snow_cm"),
    )


def with_risk(rows: DataFrame, cluster: str = "k_cluster", default_colour: str = "gray") -> DataFrame:
    """Risk, character and colour of a cluster label; five fixed names, so no join is needed."""
    label = F.col(cluster)
    return rows.withColumns({
        "risk_group": cluster_risk(label), "character": cluster_character(label),
        "colour": cluster_colour(label, default_colour),
    })
