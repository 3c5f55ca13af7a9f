"""Texts shown to a reader, and cluster names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firnline.vocabulary import CLUSTER_CHARACTER, CLUSTER_COLOUR, CLUSTER_RISK, STATION_URL


def trimmed(text: Column) -> Column:
    """Strip blanks, tabs and line ends on both sides."""
    return F.btrim(text, F.lit(" \t\n\r"))


def station_label(canton: Column, code: Column, name: Column, elevation: Column) -> Column:
    """``GR - DAV2 - Name - 2558 m``; a missing part is empty, a missing elevation 0."""
    metres = F.coalesce(elevation, F.lit(0)).cast("int").cast("string")
    blank = F.lit("")
    return F.concat(
        F.coalesce(canton, blank), F.lit(" - "), F.coalesce(code, blank), F.lit(" - "),
        F.coalesce(name, blank), F.lit(" - "), metres, F.lit(" m"),
    )


def station_url(code: Column, parts: tuple[str, str] = STATION_URL) -> Column:
    return F.concat(F.lit(parts[0]), code, F.lit(parts[1]))


def live_label(canton: Column, code: Column, name: Column) -> Column:
    """NULL as soon as one part is missing."""
    return F.concat(canton, F.lit(" - "), code, F.lit(" - "), name)


def _lookup(cluster: Column, names: dict[int, str]) -> Column:
    case = F
    for number, name in names.items():
        case = case.when(cluster == number, name)
    return case


def cluster_risk(cluster: Column) -> Column:
    return _lookup(cluster, CLUSTER_RISK)


def cluster_character(cluster: Column) -> Column:
    return _lookup(cluster, CLUSTER_CHARACTER)


def cluster_colour(cluster: Column, default: str = "gray") -> Column:
    return _lookup(cluster, CLUSTER_COLOUR).otherwise(default)


def matrix_colour(mean_cluster: Column) -> Column:
    """Colour class of a matrix cell: the mean label cut to a whole number; white when unknown."""
    return cluster_colour(mean_cluster.cast("int"), "white")
