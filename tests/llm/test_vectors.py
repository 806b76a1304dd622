import numpy as np

from tessera.llm.vectors import Search, VantagePointTree, most_similar, neighbour_pairs


def clustered(n, size, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, size))
    return (centres[rng.integers(len(centres), size=n)] + 0.25 * rng.normal(size=(n, size))).astype(np.float32)


def brute(points, k):
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    scores = unit.astype(np.float64) @ unit.T
    np.fill_diagonal(scores, -np.inf)
    return [set(np.argsort(-row)[:k]) for row in scores]


def frame(spark, points):
    return spark.createDataFrame([(f"v{i:04d}", p.tolist(), i) for i, p in enumerate(points)], "id string, vector array<float>, shard int")


def test_tree_is_exact_with_factor_one():
    points = clustered(300, 8, 0)
    unit = (points / np.linalg.norm(points, axis=1)[:, None]).astype(np.float32)
    _, rows = VantagePointTree(unit, 16).nearest(5, 1.0, np.full(300, np.inf), np.arange(300))
    assert [set(r) for r in rows] == brute(unit, 5)


def test_exact_search_over_shards(spark):
    points = clustered(600, 8, 1)
    found = most_similar(frame(spark, points), "id", "vector", Search(size=8, shard_rows=60, route_factor=1, tree_factor=1, bound_factor=float("inf"), half=False))
    got = {}
    for r in found.collect():
        got.setdefault(int(r.id[1:]), set()).add(int(r.neighbour[1:]))
    assert [got[i] for i in range(600)] == brute(points, 5)


def test_relaxed_search_has_the_stated_recall(spark):
    points = clustered(3000, 64, 2)
    got = {}
    for r in most_similar(frame(spark, points), "id", "vector").collect():
        got.setdefault(int(r.id[1:]), set()).add(int(r.neighbour[1:]))
    truth = brute(points, 5)
    assert sum(len(got[i] & truth[i]) for i in range(3000)) / 15_000 >= 0.9


def recall(spark, points):
    got = {}
    for r in most_similar(frame(spark, points), "id", "vector").collect():
        got.setdefault(int(r.id[1:]), set()).add(int(r.neighbour[1:]))
    truth = brute(points, 5)
    return sum(len(got.get(i, set()) & truth[i]) for i in range(len(points))) / (5 * len(points))


def test_factors_are_fitted_to_other_geometries(spark):
    rng = np.random.default_rng(3)
    plane = (rng.normal(size=(2500, 6)) @ rng.normal(size=(6, 64)) + 0.05 * rng.normal(size=(2500, 64))).astype(np.float32)
    assert recall(spark, plane) >= 0.95
    assert recall(spark, rng.normal(size=(2000, 64)).astype(np.float32)) >= 0.95


def test_similarities_are_near_the_true_ones(spark):
    points = clustered(1200, 64, 4)
    unit = points.astype(np.float64) / np.linalg.norm(points.astype(np.float64), axis=1)[:, None]
    for r in most_similar(frame(spark, points), "id", "vector", Search(shard_rows=100)).collect():
        assert abs(r.similarity - unit[int(r.id[1:])] @ unit[int(r.neighbour[1:])]) < 1e-4


def test_many_copies_are_found_at_either_side_of_the_switch(spark):
    for n in (7, 8, 9):
        points = np.concatenate([np.tile([[1.0, 2.0, 3.0, 4.0]], (n, 1)), clustered(40, 4, 5)]).astype(np.float32)
        of = {}
        for r in most_similar(frame(spark, points), "id", "vector", Search(size=4, hot_copies=8, route_factor=1, tree_factor=1)).collect():
            of.setdefault(int(r.id[1:]), {})[r["rank"]] = (int(r.neighbour[1:]), r.similarity)
        for i in range(n):
            found = [of[i][k + 1][0] for k in range(5)]
            assert i not in found and found == sorted(set(found)) and max(found) < n and all(abs(of[i][k + 1][1] - 1) < 1e-6 for k in range(5))


def test_unusable_few_and_equal_vectors(spark):
    nan, one = float("nan"), [1.0, 0.0]
    rows = [("a", one), ("a", one), ("b", [0.9, 0.1]), ("c", None), ("d", [0.0, 0.0]), ("e", [nan, 1.0]), ("f", [1.0]), (None, one), ("g", [1.0, None])]
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    search = Search(size=2)
    assert sorted((r.id, r.neighbour) for r in most_similar(df, "id", "vector", search).collect()) == [("a", "b"), ("b", "a")]
    assert most_similar(df.limit(0), "id", "vector", search).count() == 0
    same = spark.createDataFrame([(f"h{i:03d}", one) for i in range(40)] + [("x", [0.0, 1.0])], "id string, vector array<float>")
    found = most_similar(same, "id", "vector", Search(size=2, hot_copies=10)).collect()
    of = {}
    for r in found:
        of.setdefault(r.id, []).append(r.neighbour)
    assert len(of) == 41 and all(len(set(v)) == 5 for v in of.values())
    assert sorted(of["h030"]) == [f"h{i:03d}" for i in range(5)] and sorted(of["h002"]) == ["h000", "h001", "h003", "h004", "h005"]
    assert neighbour_pairs(most_similar(df, "id", "vector", search)).count() == 1
