"""Risk clusters and principal components, with stable labels and signs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.operators import lattice
from firnline.operators.filters import present
from firnline.operators.lattice import from_lattice, to_lattice
from firnline.operators.scaling import Scaler, project
from firnline.vocabulary import CLUSTER_CENTRES, FEATURES

SWEEPS = 12  # Jacobi's rotations converge quadratically; a matrix of a few columns needs half as many


def nearest_centre(columns: list[str], centres: dict[int, list[float]]) -> Column:
    """Label of the nearest centre; ties go to the lower label. One expression, no join."""
    return _nearest(columns, centres)["k"]


def inertia(rows: DataFrame, columns: list[str], centres: dict[int, list[float]]) -> DataFrame:
    """Sum of the squared distances to the nearest centre."""
    return rows.agg(F.sum(_nearest(columns, centres)["d"]).alias("inertia"))


def _nearest(columns: list[str], centres: dict[int, list[float]]) -> Column:
    gaps = []
    for label in sorted(centres):
        squares = F.lit(0.0)
        for name, c in zip(columns, centres[label]):
            gap = F.col(name) - F.lit(float(c))
            squares = squares + gap * gap
        gaps.append(F.struct(squares.alias("d"), F.lit(int(label)).alias("k")))
    return F.array_min(F.array(*gaps))


def vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(rows)


def canonical_labels(centres: list[list[float]], stored: dict[int, list[float]] | None = None) -> dict[int, list[float]]:
    """Give fitted centres lasting labels: of the nearest stored centre, one to one; else in sorted order."""
    if not stored:
        return dict(enumerate(sorted([list(map(float, c)) for c in centres])))
    pairs = sorted(
        (sum((a - b) ** 2 for a, b in zip(centre, kept)), i, label)
        for i, centre in enumerate(centres) for label, kept in stored.items()
    )
    labelled: dict[int, list[float]] = {}
    used: set[int] = set()
    for _, i, label in pairs:
        if i not in used and label not in labelled:
            used.add(i)
            labelled[label] = [float(v) for v in centres[i]]
    spare = max(stored) + 1
    for i, centre in enumerate(centres):
        if i not in used:
            labelled[spare] = [float(v) for v in centre]
            spare += 1
    return labelled


def upright(components: list[list[float]]) -> list[list[float]]:
    """Fix the sign of each component: its largest loading is positive."""
    return [[-v for v in c] if max(c, key=abs) < 0 else list(c) for c in components]


def covariance(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Population covariances of a few columns, by one aggregation with a cell for each pair of them."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    found = rows.agg(*[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return [[float(found[f"c{max(i, j)}_{min(i, j)}"] or 0.0) for j in range(len(columns))] for i in range(len(columns))]


def principal_axes(matrix: list[list[float]]) -> list[tuple[float, list[float]]]:
    """Eigenvalues, largest first, with their vectors, by Jacobi's rotations: each makes one pair of a symmetric matrix zero."""
    n = len(matrix)
    a, v = [list(row) for row in matrix], [[float(i == j) for j in range(n)] for i in range(n)]
    for _ in range(SWEEPS):
        for p in range(n):
            for q in range(p + 1, n):
                if a[p][q] == 0.0:
                    continue
                tau = (a[q][q] - a[p][p]) / (2.0 * a[p][q])
                t = math.copysign(1.0, tau) / (abs(tau) + math.sqrt(1.0 + tau * tau))
                c = 1.0 / math.sqrt(1.0 + t * t)
                s = t * c
                for m in (a, v):  # columns p and q
                    for row in m:
                        row[p], row[q] = c * row[p] - s * row[q], s * row[p] + c * row[q]
                a[p], a[q] = [c * x - s * y for x, y in zip(a[p], a[q])], [s * x + c * y for x, y in zip(a[p], a[q])]
    return sorted(((a[i][i], [v[r][i] for r in range(n)]) for i in range(n)), key=lambda axis: -axis[0])


def pca_components(rows: DataFrame, columns: list[str], k: int = 2) -> list[list[float]]:
    """Loadings of the first k components of some columns."""
    return upright([axis for _, axis in principal_axes(covariance(rows, columns))[:k]])


def elbow(rows: DataFrame, columns: list[str], ks: range = range(1, 11), key: list[str] | None = None) -> DataFrame:
    """Cost of the fitted centres per k for z-scores; all k are fitted side by side, with one aggregation a step."""
    points = to_lattice(rows, columns, key or [])
    try:
        near = lattice.held(points)
        costs = lattice.cost(near, lattice.fit(near, list(ks)))
    finally:
        points.unpersist()
    return rows.sparkSession.createDataFrame(sorted(costs.items()), "k INT, inertia DOUBLE")


@dataclass(frozen=True)
class RiskModel:
    """Scaler, labelled centres (in z-scores) and projection: a few dozen numbers."""

    scaler: Scaler
    centres: dict[int, list[float]]
    components: list[list[float]]

    @classmethod
    def fit(cls, training: DataFrame, features: list[str] = FEATURES, k: int = 5,
            stored: dict[int, tuple] | None = CLUSTER_CENTRES, components: int = 2, key: list[str] | None = None) -> RiskModel:
        """Fit on the complete rows. ``stored`` holds centres in original units that name the clusters.

        ``key`` names columns that tell rows apart; without it rows of equal features are drawn together as seeds.
        """
        complete = present(training, features)
        scaler = Scaler.fit(complete, features).rounded()
        names = [f"z{i + 1}" for i in range(len(features))]
        scaled = scaler.apply(complete).select(*(key or []), *names)
        points = to_lattice(scaled, names, key or [])
        try:
            fitted = [from_lattice(c) for c in lattice.fit(lattice.held(points), [k])[k]]
        finally:
            points.unpersist()
        kept = None
        if stored:
            divisors = [s if s else 1.0 for s in scaler.stds]
            kept = {n: [(v - m) / s for v, m, s in zip(c, scaler.means, divisors)] for n, c in stored.items()}
        return cls(scaler, canonical_labels(fitted, kept), pca_components(scaled, names, components))

    @property
    def names(self) -> list[str]:
        return [f"z{i + 1}" for i in range(len(self.scaler.features))]

    def score(self, rows: DataFrame) -> DataFrame:
        """Complete rows with PCA1, PCA2 and k_cluster. Row by row, so it also runs on a stream."""
        ready = self.scaler.apply(present(rows, self.scaler.features))
        ready = project(ready, self.names, self.components)
        return ready.withColumn("k_cluster", nearest_centre(self.names, self.centres)).drop(*self.names)

    def centre_rows(self) -> list[tuple]:
        """(cluster, centre in original units…, position…) per cluster."""
        out = []
        for label in sorted(self.centres):
            z = self.centres[label]
            place = [sum(a * b for a, b in zip(z, axis)) for axis in self.components]
            out.append((label, *self.scaler.restore(z), *place))
        return out

    def save(self, spark, path: str) -> None:
        """Store the model as a small table, so that jobs and streams score alike."""
        rows = [("mean", 0, self.scaler.features, self.scaler.means), ("std", 0, self.scaler.features, self.scaler.stds)]
        rows += [("centre", n, self.scaler.features, c) for n, c in self.centres.items()]
        rows += [("component", i, self.scaler.features, c) for i, c in enumerate(self.components)]
        frame = spark.createDataFrame(rows, "part STRING, number INT, features ARRAY<STRING>, weights ARRAY<DOUBLE>")
        frame.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> RiskModel:
        parts: dict[str, dict[int, list[float]]] = {}
        features: list[str] = []
        for r in spark.read.parquet(path).collect():  # two rows, plus one per centre and component
            parts.setdefault(r.part, {})[r.number] = list(r.weights)
            features = list(r.features)
        axes = [c for _, c in sorted(parts["component"].items())]
        return cls(Scaler(features, parts["mean"][0], parts["std"][0]), parts["centre"], axes)


def cluster_profile(rows: DataFrame, features: list[str] = FEATURES, cluster: str = "k_cluster",
                    centres: dict[int, list[float]] | None = None) -> DataFrame:
    """Centre in original units, rows and percentage per cluster.

    At convergence a k-means centre is the mean of its rows, which one aggregation gives
    together with the counts; fitted ``centres`` (original units) take their place if given.
    """
    per = present(rows, [cluster]).groupBy(cluster).agg(
        *[F.avg(f).alias(f) for f in features], F.count("*").alias("n")
    )
    if centres:
        per = per.withColumns({
            f: F.create_map(*[F.lit(v) for n, c in centres.items() for v in (n, float(c[i]))])[F.col(cluster)]
            for i, f in enumerate(features)
        })
    return per.withColumn("percentage", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))

