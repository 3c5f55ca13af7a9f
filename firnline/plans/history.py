"""The historical pipeline: clean accidents, fill elevations, join weather and snow, train."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.dates import midnight_stamp
from firnline.functions.places import alpine_region_hist, elevation_group
from firnline.operators.clusters import RiskModel
from firnline.operators.counts import cluster_means, cluster_share
from firnline.operators.enrich import with_risk
from firnline.operators.filters import since, since_hyear
from firnline.operators.neighbours import impute_from_neighbours
from firnline.operators.radius import snow_near, unique_ids, weather_near
from firnline.schemas import ACCIDENT_COLUMNS, MEASURES
from firnline.session import unordered

LATITUDE, LONGITUDE = "start_zone_coordinates_latitude", "start_zone_coordinates_longitude"


def clean_accidents(raw: DataFrame, after: str = "1991-12-31") -> DataFrame:
    """The accident's number as acc_id and the nine columns in use, later than a day, in order of date.

    Rows of one day keep their order; as a second sort key it also lets a day with very
    many rows spread over several tasks.
    """
    chosen = since(raw, "date", after).select(F.col("avalanche_id").alias("acc_id"), *ACCIDENT_COLUMNS, F.monotonically_increasing_id().alias("_at"))
    return chosen.orderBy("date", "_at").drop("_at")


def more_measurements(history: DataFrame, after: str = "2022-12-31") -> DataFrame:
    """History rows in the shape of live readings: constant number, midnight stamp."""
    return since(history, "date", after).select(
        F.lit("001").alias("nr"), "station_code", midnight_stamp(F.col("measure_date")).alias("measure_date"), *MEASURES
    )


def more_snow(history: DataFrame, after: str = "2022") -> DataFrame:
    return since_hyear(history, after).select(
        F.lit("001").alias("nr"), "station_code", midnight_stamp(F.col("measure_date"), zulu=False).alias("measure_date"),
        "HS", "HN_1D",
    )


def filled_accidents(accidents: DataFrame, k: int = 3) -> DataFrame:
    return impute_from_neighbours(accidents, "start_zone_elevation", k, x=LATITUDE, y=LONGITUDE)


def joined_accidents(accidents: DataFrame, weather: DataFrame, snow: DataFrame, places_of: DataFrame | None = None) -> DataFrame:
    """Accidents with the seven station means and their region (NONE stays in).

    ``places_of``: the same accidents before they were filled. Searching from them does not fill them
    again, nor join their weather again for the snow.
    """
    known = {"places_of": places_of, "unique": unique_ids(accidents if places_of is None else places_of)}
    joined = snow_near(weather_near(accidents, weather, **known), snow, **known)
    return joined.withColumn("alpine_region", alpine_region_hist(F.col("canton")))


def training_rows(accidents: DataFrame, weather: DataFrame, snow: DataFrame) -> DataFrame:
    accidents = unordered(accidents)
    return classed(joined_accidents(filled_accidents(accidents), weather, snow, accidents))


def classed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("elevation_group", elevation_group(F.col("start_zone_elevation")))


def train(rows: DataFrame) -> RiskModel:
    return RiskModel.fit(rows)


def training_outputs(model: RiskModel, rows: DataFrame) -> dict[str, DataFrame]:
    """What a training run leaves: clustered rows, their positions, centres with number and share, and mean positions.

    Centres are those of the model; there are as many rows of centres and means as clusters.
    """
    scored = model.score(rows)
    kind = "cluster INT, " + ", ".join(f"{f} DOUBLE" for f in model.scaler.features) + ", PCA1 DOUBLE, PCA2 DOUBLE"
    centres = rows.sparkSession.createDataFrame(model.centre_rows(), kind)
    shares = cluster_share(scored).select(F.col("k_cluster").alias("cluster"), F.col("n").alias("count"), "percentage")
    named = with_risk(centres, "cluster")
    centres = named.join(shares, "cluster", "left").select(
        "cluster", "character", F.col("risk_group").alias("risk"), *model.scaler.features, F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("percentage", F.lit(0.0)).alias("percentage"), "PCA1", "PCA2")
    return {"clustered": scored.drop("PCA1", "PCA2"), "positions": pca_training(model, rows), "centres": centres,
            "means": cluster_means(scored, ["PCA1", "PCA2"])}


def run_training(rows: DataFrame, folder: str) -> RiskModel:
    """Fit a model and write it and its outputs below folder."""
    model = train(rows)
    model.save(rows.sparkSession, f"{folder}/model")
    for name, frame in training_outputs(model, rows).items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
    return model


def pca_training(model: RiskModel, rows: DataFrame) -> DataFrame:
    return model.score(rows).select(
        "municipality", "canton", "date", "alpine_region", "elevation_group", "PCA1", "PCA2", "k_cluster"
    )
