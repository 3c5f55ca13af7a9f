"""k-means on a lattice of whole numbers: the same centres however rows are partitioned and ordered.

Scaled features are rounded to a millionth (1 / 2**20) of a deviation. Squared distances, sums and means are then whole numbers,
which do not depend on the order of addition, and random choices are hashes of the rows' keys. Seeds
come from k-means||: a few rounds each take rows with a probability in proportion to their squared distance from the rows taken
so far; the few dozen rows taken are weighed by the rows nearest to them, and seeds are chosen among them on the
driver, the heaviest first, then the one of largest weight times squared distance. Lloyd's steps for several k
share one aggregation over the rows.
"""

from __future__ import annotations

import uuid
from math import isqrt

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 1 << 20
#: Hashes are whole numbers below this.
HASHES = 1 << 52
ROUNDS, MAX_ROUNDS = 2, 50
#: A task takes at least so many rows in a pass.
TASK_ROWS = 50_000
MAX_ITER = 100

Point = tuple[int, ...]


def limit(dimensions: int) -> int:
    """Coordinates go from 0 to twice this, so that a squared distance fits 63 bits."""
    return isqrt((1 << 62) // dimensions) // 2


def to_lattice(rows: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """key (as one text), q1, q2, …: rows by whole numbers. What lies outside the lattice goes to its edge: 512 deviations from the mean for four columns."""
    most = limit(len(columns))
    near = [F.least(F.greatest(F.floor(F.col(c) * UNIT + 0.5), F.lit(-most)), F.lit(most)) + most for c in columns]
    return rows.select(F.concat_ws(",", *[F.col(c).cast("string") for c in key]).alias("key") if key else F.lit("").alias("key"),
                       *[q.cast("bigint").alias(f"q{i + 1}") for i, q in enumerate(near)])


def held(points: DataFrame) -> DataFrame:
    """Points kept for many short passes, in partitions by their counted number: few points are one task without a shuffle."""
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    return points.coalesce(max(1, -(-points.count() // TASK_ROWS)))


def from_lattice(point: Point) -> list[float]:
    return [(q - limit(len(point))) / UNIT for q in point]


def _names(points: DataFrame) -> list[str]:
    return [c for c in points.columns if c.startswith("q")]


def _hash(names: list[str], number: int) -> Column:
    """By key and coordinates: rows of equal keys are told apart as far as it matters."""
    text = F.concat_ws(",", "key", *[F.col(n).cast("string") for n in names], F.lit(str(number)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def _constant(centres: list[Point]) -> str:
    return "array(" + ", ".join("array(" + ", ".join(f"{v}L" for v in c) + ")" for c in centres) + ")"


def _nearest(names: list[str], centres: str) -> str:
    """SQL of the struct (d, j) of the nearest of some centres; ties go to the lower place.

    The centres are a constant array and no part of the generated code, which thus is compiled once for all steps.
    """
    squares = " + ".join(f"({n} - c[{i}]) * ({n} - c[{i}])" for i, n in enumerate(names))
    return f"array_min(transform({centres}, (c, j) -> named_struct('d', {squares}, 'j', j)))"


def candidates(points: DataFrame, k: int) -> list[Point]:
    """Rows taken by k-means||, about 2 * k in each round, in order of their coordinates; none if there are no rows.

    Rounds go on while fewer than k rows have been taken and others lie apart from them.
    """
    names = _names(points)
    first = points.agg(F.min(F.struct(_hash(names, 0).alias("h"), *names)).alias("m")).first().m
    if first is None:
        return []
    taken = {tuple(first)[1:]}
    for r in range(1, MAX_ROUNDS + 1):
        if r > ROUNDS and len(taken) >= k:
            break
        far = points.select(*names, _hash(names, r).alias("h"), F.expr(_nearest(names, _constant(sorted(taken))))["d"].alias("d"))
        total = far.agg(F.sum(F.col("d").cast("decimal(20,0)")).alias("t")).first().t
        if not total:
            break
        chance = F.col("d").cast("double") * F.lit(float(2 * k)) / F.lit(float(total)) * F.lit(float(HASHES))
        taken |= {tuple(p) for p in far.where(F.col("h") < chance).select(*names).distinct().collect()}  # about 2 * k rows
    return sorted(taken)


def seeds(points: DataFrame, k: int) -> list[Point]:
    """k starting centres, in the order they are chosen: the first n of them are those for n centres."""
    names, taken = _names(points), candidates(points, k)
    if not taken:
        return []
    weighed = points.groupBy(F.expr(_nearest(names, _constant(taken)))["j"].alias("j")).agg(F.count("*").alias("n")).collect()  # a row for each candidate
    weight = {r.j: r.n for r in weighed}
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    chosen = [max(range(len(taken)), key=lambda j: (weight.get(j, 0), -j))]
    while len(chosen) < k:
        score = [weight.get(j, 0) * min(gap(taken[j], taken[c]) for c in chosen) for j in range(len(taken))]
        chosen.append(max(range(len(taken)), key=lambda j: (score[j], -j)))
    return [taken[j] for j in chosen]


def lloyd(points: DataFrame, starts: dict[int, list[Point]], steps: int = MAX_ITER) -> dict[int, list[Point]]:
    """Centres for every k, each the rounded mean of its rows; a centre without rows stays where it is.

    One aggregation a step, over the k that still move; its result has a row for each centre.
    """
    names, centres = _names(points), {k: list(c) for k, c in starts.items()}
    moving, view = sorted(centres), f"lattice_{uuid.uuid4().hex}"
    points.createOrReplaceTempView(view)  # a step is one text, without a call for each of its expressions
    try:
        for _ in range(steps):
            if not moving:
                break
            every = ", ".join(f"named_struct('k', {k}, 'centres', {_constant(centres[k])})" for k in moving)
            at = f"explode(transform(array({every}), s -> named_struct('k', s.k, 'j', {_nearest(names, 's.centres')}.j)))"
            sums = ", ".join(f"sum(CAST({q} AS DECIMAL(20, 0))) AS {q}" for q in names)
            found = points.sparkSession.sql(f"SELECT at.k, at.j, count(*) AS n, {sums} FROM (SELECT {', '.join(names)}, {at} AS at FROM {view}) GROUP BY at.k, at.j")
            new = {k: list(centres[k]) for k in moving}
            for r in found.collect():
                new[r.k][r.j] = tuple((2 * int(r[q]) + r.n) // (2 * r.n) for q in names)
            moving = [k for k in moving if new[k] != centres[k]]
            centres.update(new)
    finally:
        points.sparkSession.catalog.dropTempView(view)
    return centres


def fit(points: DataFrame, ks: list[int]) -> dict[int, list[Point]]:
    """Centres for each k. Seeds are drawn once, for the largest."""
    drawn = seeds(points, max(ks))
    if not drawn:
        raise ValueError("no complete rows to fit on")
    return lloyd(points, {k: drawn[:k] for k in ks})


def cost(points: DataFrame, centres: dict[int, list[Point]]) -> dict[int, float]:
    """Sum of squared distances to the nearest centre, in squared deviations, for every k in one pass."""
    names = _names(points)
    sums = points.agg(*[F.sum(F.expr(_nearest(names, _constant(some)))["d"].cast("decimal(20,0)")).alias(f"k{k}") for k, some in centres.items()]).first()
    return {k: float(sums[f"k{k}"] or 0) / (UNIT * UNIT) for k in centres}


def fixpoint(points: DataFrame, centres: list[Point]) -> DataFrame:
    """k_cluster, n, q1, q2, … and fixed per centre with rows: the rounded mean of its rows, and whether that is the centre."""
    names = _names(points)
    sums = points.groupBy(F.expr(_nearest(names, _constant(centres)))["j"].alias("k_cluster")).agg(F.count("*").alias("n"), *[F.sum(F.col(q).cast("decimal(20,0)")).alias(q) for q in names])
    means = sums.withColumns({q: F.floor((2 * F.col(q) + F.col("n")) / (2 * F.col("n"))).cast("bigint") for q in names})
    home = F.create_map(*[x for j, c in enumerate(centres) for x in (F.lit(j), F.struct(*[F.lit(v).cast("bigint").alias(q) for q, v in zip(names, c)]))])[F.col("k_cluster")]
    return means.withColumn("fixed", F.struct(*names) == home)
