"""Z-scores with the population standard deviation, and fixed linear projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.operators.filters import present
from firnline.vocabulary import FEATURES


def scaler_fit(rows: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """One row per feature with its mean and population deviation, from one pass."""
    wide = present(rows, features).agg(
        *[e for f in features for e in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
    )
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("std"))
        for f in features
    ])
    return wide.select(F.inline(pairs))


@dataclass(frozen=True)
class Scaler:
    """Fitted means and deviations: two numbers per feature, held on the driver."""

    features: list[str]
    means: list[float]
    stds: list[float]

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str] = FEATURES) -> Scaler:
        fitted = {r.feature: r for r in scaler_fit(rows, features).collect()}
        return cls(list(features), [fitted[f].mean for f in features], [fitted[f].std for f in features])

    def rounded(self, digits: int = 9) -> Scaler:
        """The same without the last digits, which depend on the order in which rows were added up."""
        return Scaler(self.features, [round(m, digits) for m in self.means], [round(s, digits) for s in self.stds])

    def _divisors(self) -> list[float]:
        return [s if s else 1.0 for s in self.stds]

    def scaled(self, feature: str) -> Column:
        i = self.features.index(feature)
        return (F.col(feature) - F.lit(self.means[i])) / F.lit(self._divisors()[i])

    def apply(self, rows: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Add the z-scores, ``z1`` upwards in feature order."""
        names = names or [f"z{i + 1}" for i in range(len(self.features))]
        return rows.withColumns({n: self.scaled(f) for n, f in zip(names, self.features)})

    def restore(self, centre: list[float]) -> list[float]:
        """A point in z-scores back in original units."""
        return [float(z) * s + m for z, s, m in zip(centre, self._divisors(), self.means)]

    def restore_column(self, feature: str, z: Column) -> Column:
        i = self.features.index(feature)
        return z * F.lit(self._divisors()[i]) + F.lit(self.means[i])


def dot(columns: list[str], weights: list[float]) -> Column:
    total = F.lit(0.0)
    for name, weight in zip(columns, weights):
        total = total + F.col(name) * F.lit(float(weight))
    return total


def project(rows: DataFrame, columns: list[str], components: list[list[float]]) -> DataFrame:
    """Add PCA1, PCA2, … as dot products of z-scores with fitted components."""
    return rows.withColumns({f"PCA{i + 1}": dot(columns, c) for i, c in enumerate(components)})
