import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.operators import clusters, lattice
from firnline.operators.scaling import Scaler, scaler_fit
from firnline.vocabulary import FEATURES
from tests.conftest import rows

COLUMNS = ", ".join(f"{f} DOUBLE" for f in FEATURES)


def planted(n=60, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0, 0], [20, 0, 5, 1], [0, 30, 5, 2], [5, 5, 60, 3], [9, 9, 9, 90.0]])
    labels = np.repeat(np.arange(5), n)
    return centres[labels] + rng.normal(0, 0.5, (5 * n, 4)), labels


def frame_of(spark, data):
    return spark.createDataFrame([tuple(map(float, r)) for r in data], COLUMNS)


def test_scaler_takes_the_population_deviation(spark):
    frame = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (5.0, 7.0), (None, 8.0)], "a DOUBLE, b DOUBLE")
    assert rows(scaler_fit(frame, ["a", "b"]), "feature") == [("a", 3.0, pytest.approx(1.632993161855452)), ("b", 7.0, 0.0)]
    scaled = Scaler.fit(frame, ["a", "b"]).apply(frame.dropna()).orderBy("a").collect()
    assert [r.z2 for r in scaled] == [0.0, 0.0, 0.0], "no deviation: divide by one"
    assert scaled[0].z1 == pytest.approx(-1.224744871391589)


def test_kmeans_recovers_planted_clusters(spark):
    data, _ = planted()
    model = clusters.RiskModel.fit(frame_of(spark, data), stored=None)
    by_cluster = {}
    for r in model.score(frame_of(spark, data)).collect():
        by_cluster.setdefault(r.k_cluster, []).append([r[f] for f in FEATURES])
    assert [len(v) for v in by_cluster.values()] == [60] * 5
    assert all(np.ptp(v, axis=0).max() < 5 for v in by_cluster.values()), "no cluster mixes two planted ones"
    for label, *centre in model.centre_rows():
        assert np.allclose(np.mean(by_cluster[label], axis=0), centre[:4], atol=1e-4), "a centre is the mean of its rows"


def test_labels_follow_stored_centres(spark):
    data, _ = planted()
    stored = {10: (0, 30, 5, 2), 11: (9, 9, 9, 90), 12: (0, 0, 0, 0), 13: (20, 0, 5, 1), 14: (5, 5, 60, 3)}
    model = clusters.RiskModel.fit(frame_of(spark, data), stored=stored)
    for label, *centre in model.centre_rows():
        assert np.allclose(centre[:4], stored[label], atol=0.5)


def test_canonical_labels_are_one_to_one():
    got = clusters.canonical_labels([[0.1], [0.2], [5.0]], {0: [0.0], 1: [6.0], 2: [0.15]})
    assert sorted(got) == [0, 1, 2] and got[1] == [5.0]
    assert clusters.canonical_labels([[2.0], [1.0]]) == {0: [1.0], 1: [2.0]}


def test_pca_equals_svd(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    frame = frame_of(spark, data)
    model = clusters.RiskModel.fit(frame, stored=None)
    z = (data - data.mean(0)) / data.std(0)
    axes = np.linalg.svd(z, full_matrices=False)[2][:2]
    axes = np.array([a if a[np.argmax(np.abs(a))] > 0 else -a for a in axes])
    assert np.allclose(model.components, axes, atol=1e-8)
    got = sorted((r.PCA1, r.PCA2) for r in model.score(frame).collect())
    assert np.allclose(got, sorted(map(tuple, z @ axes.T)), atol=1e-8)


def test_a_fit_does_not_depend_on_partitions_and_order(spark):
    data, _ = planted(40)
    frame = frame_of(spark, data).withColumn("id", F.monotonically_increasing_id())
    models = [clusters.RiskModel.fit(f, stored=None, key=["id"]) for f in (frame.coalesce(1), frame.orderBy(F.rand(3)).repartition(7), frame.repartition(3, "id"))]
    assert models[0].centres == models[1].centres == models[2].centres
    assert models[0].scaler == models[1].scaler == models[2].scaler


def exact_lloyd(points, centres, steps=100):
    """The same steps on whole numbers in plain Python."""
    for _ in range(steps):
        groups = {}
        for p in points:
            j = min(range(len(centres)), key=lambda j: (sum((x - y) ** 2 for x, y in zip(p, centres[j])), j))
            groups.setdefault(j, []).append(p)
        new = [tuple((2 * sum(c) + len(groups[j])) // (2 * len(groups[j])) for c in zip(*groups[j])) if j in groups else centres[j] for j in range(len(centres))]
        if new == centres:
            break
        centres = new
    return centres


def test_steps_for_several_k_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(150, 3))
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id INT, a DOUBLE, b DOUBLE, c DOUBLE")
    points = lattice.to_lattice(frame, ["a", "b", "c"], ["id"])
    whole = [tuple(r)[1:] for r in points.collect()]
    assert np.allclose([lattice.from_lattice(p) for p in whole], data, atol=1e-5)
    starts = lattice.seeds(points, 6)
    assert len(set(starts)) == 6 and set(starts) <= set(whole)
    got = lattice.lloyd(points, {k: starts[:k] for k in (1, 2, 6)})
    for k in (1, 2, 6):
        assert got[k] == exact_lloyd(whole, starts[:k])
        assert all(r.fixed for r in lattice.fixpoint(points, got[k]).collect())
    exact = {k: sum(min(sum((x - y) ** 2 for x, y in zip(p, c)) for c in got[k]) for p in whole) / lattice.UNIT ** 2 for k in got}
    assert lattice.cost(points, got) == pytest.approx(exact, rel=1e-12)


def test_fewer_distinct_rows_than_centres_and_no_rows(spark):
    frame = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, -1.0)], "id INT, a DOUBLE")
    centres = lattice.fit(lattice.to_lattice(frame, ["a"], ["id"]), [3])[3]
    assert len(centres) == 3 and {lattice.from_lattice(c)[0] for c in centres} == {0.5, -1.0}
    with pytest.raises(ValueError, match="no complete rows"):
        lattice.fit(lattice.to_lattice(frame.limit(0), ["a"], []), [2])
    far = lattice.to_lattice(spark.createDataFrame([(1e300,), (-1e300,)], "a DOUBLE"), ["a"], [])
    assert {r.q1 for r in far.collect()} == {0, 2 * lattice.limit(1)}


def test_rotations_equal_the_library(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        m = rng.normal(size=(n, n))
        m = m + m.T
        values = np.linalg.eigvalsh(m)[::-1]
        axes = clusters.principal_axes(m.tolist())
        assert np.allclose([v for v, _ in axes], values)
        assert all(np.allclose(m @ np.array(w), v * np.array(w)) for v, w in axes)
    assert clusters.principal_axes([[2.0, 0.0], [0.0, 3.0]]) == [(3.0, [0.0, 1.0]), (2.0, [1.0, 0.0])]


def test_elbow(spark):
    data, _ = planted()
    cost = dict(rows(clusters.elbow(frame_of(spark, data), FEATURES, range(1, 7)), "k"))
    assert cost[1] == pytest.approx(len(data) * data.var(0).sum())
    assert list(cost) == [1, 2, 3, 4, 5, 6] and cost[5] < cost[1] / 20


def test_profile(spark):
    data, labels = planted()
    frame = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(data, labels)], COLUMNS + ", k_cluster INT")
    got = clusters.cluster_profile(frame).orderBy("k_cluster").collect()
    assert [r.n for r in got] == [60] * 5 and sum(r.percentage for r in got) == pytest.approx(100)
    assert np.allclose([got[3][f] for f in FEATURES], data[labels == 3].mean(0))
    named = clusters.cluster_profile(frame, centres={k: [float(k)] * 4 for k in range(5)}).orderBy("k_cluster").collect()
    assert [r[FEATURES[0]] for r in named] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_model_survives_storage(spark, tmp_path):
    data, _ = planted()
    model = clusters.RiskModel.fit(frame_of(spark, data))
    model.save(spark, f"{tmp_path}/model")
    assert clusters.RiskModel.load(spark, f"{tmp_path}/model") == model
