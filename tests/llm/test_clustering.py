from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from stylograph.llm import clustering


def brute(rows, k, rounds, width):
    kept = [(i, [int(1024 * x // 1) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in drawn[:k]]

    def assign():
        out = []
        for _, v in kept:
            distances = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((min(distances), distances.index(min(distances))))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            members = [v for (_, v), (_, own) in zip(kept, found) if own == c]
            if members:
                centroids[c] = [sum(column) // len(members) for column in zip(*members)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign())), key=repr), centroids


def sample(n, width, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(0, 2, (6, width))
    return [(i, (centres[i % 6] + random.normal(0, 0.7, width)).astype(np.float32).tolist()) for i in range(n)]


ODD = [(1000, None), (1001, [1.0, None, 0.0, 0.0]), (1002, [float("nan")] * 4), (1003, [float("-inf")] * 4), (1004, []), (1005, [0.5]), (1006, [1.0] * 5)]


def test_against_brute_force(spark):
    data = sample(400, 4, 1)
    rows = data + ODD + [(7, data[3][1]), (7, data[3][1]), (None, [0.0] * 4)] + [(2000 + i, [1.0, -1.0, 0.5, 0.0]) for i in range(200)]
    frame = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster int, id string, distance int").repartition(3)
    for k, rounds in ((8, 10), (3, 2), (1, 3), (5, 0)):
        for block in (16, 4096):
            found, centroids, work = clustering.k_means(clustering.integer_vectors(frame, "vec_id", "embedding", 4), k, rounds, block=block)
            want, wanted_centroids = brute(rows, k, rounds, 4)
            assert sorted((tuple(r) for r in found.collect()), key=repr) == want
            assert centroids.tolist() == wanted_centroids
            assert work[0] == (len(want), len(want)) and len(work) <= rounds + 1
    result = clustering.clusters(frame, width=4, k=3, rounds=2).collect()
    want, centroids = brute(rows, 3, 2, 4)
    spent = [sum(d for _, c, d in want if c == at) for at in range(3)]
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in result), key=repr) == want
    assert all((r.cluster_inertia, r.inertia, r.centroid) == (spent[r.cluster], sum(spent), centroids[r.cluster]) for r in result)


def test_ties_go_to_the_smaller_number_and_few_vectors(spark):
    rows = [(i, [float(i % 3)]) for i in range(9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (4, 20):
        found, centroids, _ = clustering.k_means(clustering.integer_vectors(frame, "vec_id", "embedding", 1), k, 3)
        want, wanted = brute(rows, k, 3, 1)
        assert sorted(map(tuple, found.collect())) == want and centroids.tolist() == wanted
    assert clustering.clusters(frame.where("false"), width=1).count() == 0
    assert clustering.clusters(frame, width=2).count() == 0


def test_too_large_components_end_the_job(spark):
    import pytest

    frame = spark.createDataFrame([(1, [1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        clustering.integer_vectors(frame, "vec_id", "embedding", 1).collect()


def test_drift_bounds_hold_and_are_tighter_than_the_drift():
    random = np.random.default_rng(5)
    tighter = 0
    for _ in range(300):
        old = random.normal(0, 10, (5, 6))
        new = old + random.normal(0, random.choice([0.01, 1, 8]), old.shape)
        radius = random.uniform(0.1, 12, 5)
        drift, loose = clustering.drift_bounds(old, new, radius)
        tighter += (loose < 0.95 * drift.max()).sum()
        for i in range(5):
            way = random.normal(0, 1, (200, 6))
            points = old[i] + radius[i] * way / np.linalg.norm(way, axis=1)[:, None] * random.uniform(0.5, 1, (200, 1))
            points[0] = old[i] + radius[i] * (new[(i + 1) % 5] - old[i]) / np.linalg.norm(new[(i + 1) % 5] - old[i])
            lost = np.linalg.norm(points[:, None] - old[None], axis=2) - np.linalg.norm(points[:, None] - new[None], axis=2)
            assert np.delete(lost, i, 1).max() <= loose[i] + 1e-9
    assert tighter > 300


def test_most_vectors_are_not_scanned_again(spark):
    frame = spark.createDataFrame(sample(3_000, 16, 2), "vec_id long, embedding array<float>")
    _, _, work = clustering.k_means(clustering.integer_vectors(frame, "vec_id", "embedding", 16), 6, 10)
    assert all(scanned <= measured for measured, scanned in work)
    assert sum(scanned for _, scanned in work[1:]) < 0.5 * 3_000 * max(1, len(work) - 1)
