"""Nearest-site search checked against a brute-force scan of every (point, site) pair."""

import numpy as np
import pytest

from urbanframe.operators.spatial import nearest_site

R = 6371.0


def haversine(lat1, lon1, lat2, lon2):
    dlat = np.radians(lat2 - lat1)
    dlon = np.radians(lon2 - lon1)
    a = np.sin(dlat / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(dlon / 2) ** 2
    return R * 2 * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a)))


def brute_force(points, sites):
    """id -> (distance, label) over all pairs; ties -> smallest label."""
    best = {}
    for pid, plat, plon in points:
        if plat is None or plon is None or (plat == 0 and plon == 0):
            continue
        for lab, slat, slon in sites:
            if slat is None or slon is None:
                continue
            d = float(haversine(plat, plon, slat, slon))
            cur = best.get(pid)
            if cur is None or (d, lab) < cur:
                best[pid] = (d, lab)
    return best


def check(spark, points, sites, **kw):
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    s = spark.createDataFrame(sites, "label string, lat double, lon double")
    got = {r["id"]: (r["distance_km"], r["label"]) for r in nearest_site(p, s, "id", "lat", "lon", "label", "lat", "lon", **kw).collect()}
    want = brute_force(points, sites)
    assert set(got) == set(want)
    for k, (d, lab) in want.items():
        assert abs(got[k][0] - d) <= 1e-9 * max(1.0, d), (k, got[k], (d, lab))
        if got[k][1] != lab:
            # only acceptable when both distances are equal to floating precision
            alt = [x for x in sites if x[0] == got[k][1]]
            assert any(abs(haversine(*[q for q in points if q[0] == k][0][1:], x[1], x[2]) - d) < 1e-9 for x in alt)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_clustered(spark, seed):
    rng = np.random.default_rng(seed)
    sites = [(f"S{i:03d}", float(34 + rng.normal(0, 0.05)), float(-118.3 + rng.normal(0, 0.05))) for i in range(40)]
    points = [(int(i % 700), float(34 + rng.normal(0, 0.2)), float(-118.3 + rng.normal(0, 0.2))) for i in range(1500)]
    check(spark, points, sites)


def test_global_spread_poles_and_dateline(spark):
    rng = np.random.default_rng(7)
    sites = [(f"G{i}", float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(25)]
    sites += [("N", 89.9, 10.0), ("W", 0.0, 179.99), ("E", 0.0, -179.99)]
    points = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(400)]
    points += [(1000, 90.0, 0.0), (1001, 0.0, 180.0), (1002, 0.0, -180.0), (1003, -90.0, 5.0)]
    check(spark, points, sites, strategy="merge")


def test_far_outlier_points_and_one_site(spark):
    sites = [("ONLY", 10.0, 10.0)]
    points = [(1, 10.0, 10.0001), (2, -70.0, -170.0), (3, 0.5, 0.5), (4, -10.0, -170.0)]
    check(spark, points, sites, strategy="shuffle_hash")


def test_exact_ties_and_duplicate_positions(spark):
    # points exactly midway between two sites; duplicate site positions keep the smaller label
    sites = [("B", 0.0, 0.0), ("A", 0.0, 1.0), ("C", 0.0, 1.0), ("D", 1.0, 0.5), ("E", -1.0, 0.5)]
    points = [(1, 0.0, 0.5), (2, 0.0, 0.5), (3, 0.5, 0.5), (4, 0.0, 0.75)]
    check(spark, points, sites, strategy="broadcast")


def test_hot_cell_of_sites(spark):
    # a third of the sites packed into a few metres: the cell size shrinks instead of
    # every nearby point meeting all of them
    rng = np.random.default_rng(3)
    hot = [(f"H{i:03d}", 34.0 + rng.uniform(0, 1e-5), -118.0 + rng.uniform(0, 1e-5)) for i in range(60)]
    rest = [(f"R{i:03d}", float(34 + rng.uniform(-1, 1)), float(-118 + rng.uniform(-1, 1))) for i in range(120)]
    points = [(i, float(34 + rng.uniform(-1.2, 1.2)), float(-118 + rng.uniform(-1.2, 1.2))) for i in range(600)]
    points += [(10_000 + i, 34.0 + rng.uniform(0, 1e-5), -118.0 + rng.uniform(0, 1e-5)) for i in range(50)]
    check(spark, points, hot + rest, max_sites_per_cell=8)


def test_no_sites_gives_empty(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0)], "id long, lat double, lon double")
    s = spark.createDataFrame([("X", None, None)], "label string, lat double, lon double")
    out = nearest_site(p, s, "id", "lat", "lon", "label", "lat", "lon")
    assert out.count() == 0
    assert out.columns == ["id", "distance_km", "label"]


def test_null_id_is_one_group_even_when_far(spark):
    # the NULL-id group needs more than one pass: it must not be lost on the way
    sites = [("A", 0.0, 0.0), ("B", 0.0, 0.01)]
    points = [(None, 40.0, 40.0), (None, 41.0, 41.0), (1, 0.0, 0.001)]
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    s = spark.createDataFrame(sites, "label string, lat double, lon double")
    got = {r["id"]: (r["distance_km"], r["label"]) for r in nearest_site(p, s, "id", "lat", "lon", "label", "lat", "lon").collect()}
    want_null = min((float(haversine(la, lo, sl, so)), lab) for _, la, lo in points[:2] for lab, sl, so in sites)
    assert set(got) == {None, 1}
    assert abs(got[None][0] - want_null[0]) < 1e-9 and got[None][1] == want_null[1]


def test_hot_id_holding_a_third_of_the_points(spark):
    rng = np.random.default_rng(5)
    sites = [(f"S{i:02d}", float(34 + rng.uniform(-0.3, 0.3)), float(-118 + rng.uniform(-0.3, 0.3))) for i in range(30)]
    points = [(7 if i % 3 == 0 else i, float(34 + rng.uniform(-0.5, 0.5)), float(-118 + rng.uniform(-0.5, 0.5)))
              for i in range(900)]
    check(spark, points, sites, strategy="merge")


def _pairs_per_point(spark, monkeypatch, points, sites):
    """Pairs of a point and a site whose distance is computed, per point: all of them, and the most for one id."""
    from pyspark.sql import functions as F

    from urbanframe.operators import spatial

    rounds = []
    original = spatial._best_near

    def counting(keyed, lists):
        out = original(keyed, lists)
        rounds.append(out.groupBy("_id").agg(F.count(F.lit(1)).alias("n")))
        return out

    monkeypatch.setattr(spatial, "_best_near", counting)
    check(spark, points, sites)
    each = [r["n"] for counted in rounds for r in counted.collect()]
    assert len(each) == len(points)  # every point meets one list
    return max(each)


def test_far_points_meet_few_sites(spark, monkeypatch):
    rng = np.random.default_rng(9)
    sites = [(f"L{i:04d}", float(34 + rng.uniform(0, 0.5)), float(-118 + rng.uniform(0, 0.5))) for i in range(2000)]
    points = [(i, float(39 + rng.uniform(0, 0.5)), float(-113 + rng.uniform(0, 0.5))) for i in range(1500)]
    assert _pairs_per_point(spark, monkeypatch, points, sites) <= 64


def test_clustered_sites_meet_their_neighbourhood_only(spark, monkeypatch):
    rng = np.random.default_rng(10)
    patch = [(f"C{i:04d}", float(34 + rng.uniform(0, 0.05)), float(-118 + rng.uniform(0, 0.05))) for i in range(1980)]
    spread = [(f"S{i:04d}", float(30 + rng.uniform(0, 10)), float(-125 + rng.uniform(0, 10))) for i in range(20)]
    points = [(i, float(34 + rng.uniform(0, 0.05)), float(-118 + rng.uniform(0, 0.05))) for i in range(1500)]
    assert _pairs_per_point(spark, monkeypatch, points, patch + spread) <= 64


def test_suburbs_of_a_dense_patch_meet_few_sites(spark, monkeypatch):
    # the points lie around the patch, where one wide cell would list all of it
    rng = np.random.default_rng(12)
    patch = [(f"C{i:04d}", float(34 + rng.uniform(0, 0.05)), float(-118 + rng.uniform(0, 0.05))) for i in range(1980)]
    spread = [(f"S{i:04d}", float(30 + rng.uniform(0, 10)), float(-125 + rng.uniform(0, 10))) for i in range(20)]
    angles, reach = rng.uniform(0, 2 * np.pi, 2000), rng.uniform(0.1, 0.15, 2000)
    points = [(i, float(34.025 + r * np.sin(a)), float(-117.975 + r * np.cos(a))) for i, (a, r) in enumerate(zip(angles, reach))]
    assert _pairs_per_point(spark, monkeypatch, points, patch + spread) <= 64


def test_sites_that_no_cell_can_tell_apart(spark):
    # 90 sites within centimetres, all nearly as near: the last level keeps them on one list
    sites = [(f"T{i:02d}", 34.0 + i * 1e-9, -118.0) for i in range(90)] + [("far", 35.0, -118.0)]
    points = [(i, 34.2 + i * 1e-3, -118.1) for i in range(20)]
    check(spark, points, sites)


def test_a_point_leaves_the_join_as_one_row(spark, monkeypatch):
    """Rows that go on to the argmin: one a point, however many sites its cell's list holds."""
    from urbanframe.operators import spatial

    counted, plain = [], spatial._best_near

    def counting(points, lists):
        best = plain(points, lists)
        counted.append(best.count())
        return best

    monkeypatch.setattr(spatial, "_best_near", counting)
    rng = np.random.default_rng(3)
    sites = [(f"S{i:02d}", float(34 + rng.normal(0, 0.05)), float(-118.3 + rng.normal(0, 0.05))) for i in range(30)]
    points = [(int(i % 90), float(34 + rng.normal(0, 0.2)), float(-118.3 + rng.normal(0, 0.2))) for i in range(600)]
    for strategy in ("broadcast", "merge"):
        counted.clear()
        check(spark, points, sites, strategy=strategy)
        assert sum(counted) == len(points)


def test_list_of_sites_within_centimetres_is_split(spark):
    sites = [(f"T{i:03d}", 34.0 + i * 1e-9, -118.3) for i in range(70)] + [("FAR", 35.0, -118.0)]
    points = [(i, 34.0 + (i % 7) * 1e-8, -118.3 - (i % 3) * 1e-4) for i in range(40)] + [(99, 35.0, -118.0)]
    check(spark, points, sites, strategy="merge", max_sites_per_cell=8)
