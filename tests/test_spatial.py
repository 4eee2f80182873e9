"""Spatial joins, clusters and routes against brute force."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilgrid.functions.columns import haversine
from perilgrid.operators import cluster, geo, risk, route, sphere
from perilgrid.operators.components import connected_components
from perilgrid.sources.frozen import Frozen


def metres(a, b):
    (y1, x1), (y2, x2) = a, b
    y1, x1, y2, x2 = map(math.radians, (y1, x1, y2, x2))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def places(spark, points, key="_row_id"):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], f"{key} long, lat double, lon double")


@pytest.mark.parametrize(("lat", "lon", "radius"), [(37.4, 126.9, 300), (-5.0, 10.0, 5000), (66.0, -30.0, 800)])
def test_within(spark, lat, lon, radius):
    rng = random.Random(1)
    spread = radius / 50000
    points = [(lat + rng.uniform(-spread, spread), lon + rng.uniform(-spread, spread) / math.cos(math.radians(lat))) for _ in range(200)]
    targets = points[:20] + [(lat + rng.uniform(-spread, spread), lon + rng.uniform(-spread, spread)) for _ in range(20)]
    got = geo.within(places(spark, points), places(spark, targets, "target_id"), radius)
    pairs = [(r["target_id"], r["_row_id"]) for r in got.collect()]
    want = {(t, i) for t, a in enumerate(targets) for i, b in enumerate(points) if metres(a, b) <= radius}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 20


def test_radius_counts_keep_lonely_targets(spark):
    got = geo.radius_counts(places(spark, [(37.4, 126.9)]), places(spark, [(37.4, 126.9), (37.45, 126.9)], "target_id"))
    assert {tuple(r) for r in got.collect()} == {(0, 1), (1, 0)}


def test_nearest(spark):
    rng = random.Random(2)
    zones = [(37.4 + rng.uniform(-1, 1) * s, 126.9 + rng.uniform(-1, 1) * s) for s in (0.01, 0.01, 0.3, 3.0)] + [(37.4, 126.9)]
    targets = [(37.4 + rng.uniform(-1, 1) * s, 126.9 + rng.uniform(-1, 1) * s) for s in (0.001, 0.1, 1, 8, 30)]
    got = dict(tuple(r) for r in geo.nearest(places(spark, zones), places(spark, targets, "target_id")).collect())
    for i, t in enumerate(targets):
        assert got[i] == pytest.approx(min(metres(t, z) for z in zones))


def test_far_targets(spark):
    points = places(spark, [(37.4, 126.9), (-33.9, 151.2), (51.5, -0.1)])
    targets = [(0.0, 0.0), (37.5, 127.0), (-40.0, -70.0), (60.0, 60.0)]
    got = {r["target_id"]: r["nearest_m"] for r in geo.nearest(points, places(spark, targets, "target_id")).collect()}
    for k, t in enumerate(targets):
        assert got[k] == pytest.approx(min(metres(t, p) for p in [(37.4, 126.9), (-33.9, 151.2), (51.5, -0.1)]))


def anywhere(rng, n):
    """Places over the whole globe: both sides of the antimeridian, poles, longitudes beyond 180 and crowds."""
    out = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]
    out += [(rng.uniform(-80, 80), s * (180 - rng.random() * 0.01)) for s in (1, -1) for _ in range(n // 4)]
    out += [(s * (90 - rng.random() * 0.01), rng.uniform(-180, 180)) for s in (1, -1) for _ in range(n // 4)]
    out += [(10 + rng.random() * 1e-3, 179.9995 + rng.random() * 1e-3) for _ in range(n)]
    return out + [(90.0, 0.0), (-90.0, 77.0), (10.0, 180.0), (10.0, -180.0), (0.0, 0.0), (0.0, 360.0), (1e-7, 1e-7)]


@pytest.mark.parametrize("radius", [0, 0.01, 30, 1000, 300_000, 9_000_000, 30_000_000])
def test_within_anywhere(spark, radius):
    rng = random.Random(int(radius))
    points, targets = anywhere(rng, 60), anywhere(rng, 24)
    got = geo.within(places(spark, points), places(spark, targets, "target_id"), radius)
    pairs = [(r["target_id"], r["_row_id"]) for r in got.select("target_id", "_row_id").collect()]
    want = {(t, i) for t, a in enumerate(targets) for i, b in enumerate(points) if metres(a, b) <= radius}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize(("n", "leaf", "start"), [(3, 48, 256), (150, 48, 256), (400, 4, 8), (400, 1, 1)])
def test_nearest_anywhere(spark, monkeypatch, n, leaf, start):
    monkeypatch.setattr(sphere, "LEAF", leaf)
    monkeypatch.setattr(sphere, "START", start)
    rng = random.Random(n)
    points, targets = anywhere(rng, n) if n > 3 else [(10.0, -179.999), (10.008, 179.999), (-89.99, 3.0)], anywhere(rng, 40)
    crowd = [(48.0 + rng.random() * 1e-6, 2.0 + rng.random() * 1e-6) for _ in range(n)] + [points[0]] * 9
    points = points + crowd
    rows = places(spark, points).unionByName(spark.createDataFrame([(-1, None, 1.0), (-2, 1.0, float("nan")), (-3, float("inf"), 0.0)], "_row_id long, lat double, lon double"))
    asked = places(spark, targets, "target_id").unionByName(spark.createDataFrame([(-1, None, 1.0), (-2, float("nan"), 1.0)], "target_id long, lat double, lon double"))
    got = dict(tuple(r) for r in geo.nearest(rows, asked).collect())
    assert len(got) == len(targets) + 2 and got[-1] is None and got[-2] is None
    for i, t in enumerate(targets):
        assert got[i] == pytest.approx(min(metres(t, z) for z in points), rel=1e-9, abs=1e-6), t


def test_antimeridian(spark):
    target, points = places(spark, [(10.0, 179.999)], "target_id"), places(spark, [(10.0, -179.999), (10.008, 179.999)])
    assert geo.nearest(points, target).first()["nearest_m"] == pytest.approx(metres((10, 179.999), (10, -179.999)))
    assert geo.radius_counts(points, target, 300).first()["n"] == 1


def test_nearest_without_zones(spark):
    got = geo.nearest(places(spark, [(1.0, 1.0)]).limit(0), places(spark, [(1.0, 1.0)], "target_id"))
    assert [tuple(r) for r in got.collect()] == [(0, None)]


def test_road_keys(spark):
    damage = spark.createDataFrame([(1.0, 1.0, " a ", "x"), (1.0, 1.0, "a", "x"), (1.0, 1.0, "", None), (1.0, 1.0, None, "y")], "lat double, lon double, node_link string, road_address string")
    assert geo.road_key(damage) == "node_link"
    assert {tuple(r) for r in geo.importance_table(damage).collect()} == {("a", 2)}
    assert geo.road_key(damage.withColumn("node_link", F.lit(None).cast("string"))) == "road_address"
    assert geo.road_key(damage.select("lat")) is None
    pairs = damage.withColumn("target_id", F.lit(1))
    assert [tuple(r) for r in geo.representative_roads(pairs, "node_link").collect()] == [(1, "")]  # the smallest of equals, untrimmed


def test_priority_without_zones_and_keys(spark):
    damage = places(spark, [(37.4, 126.9)] * 4)
    got = risk.priority(damage, places(spark, [(1.0, 1.0)]).limit(0), places(spark, [(37.4, 126.9), (37.45, 126.9)], "target_id")).collect()
    assert [r["target_id"] for r in got] == [0, 1]
    assert got[0]["risk"]["excluded"] == ["photo_severity", "school_zone", "road_importance"]
    assert got[0]["risk"]["total"] == 15.0  # 0.3 * 20 of 0.4


def test_photo_counts_at_its_place_only(spark):
    targets = places(spark, [(37.4, 126.9), (37.45, 126.9)], "target_id").withColumn("is_photo", F.col("target_id") == 1)
    got = risk.priority(places(spark, [(37.0, 126.9)]), places(spark, [(37.4, 126.9)]), targets, photo=80.0).collect()
    assert {r["target_id"]: r["photo_severity"] for r in got} == {0: None, 1: 80.0}


def test_photo_target_and_candidates(spark):
    targets = risk.with_photo_target(places(spark, [(1.0, 1.0)] * 7, "target_id"), 2.0, 3.0)
    assert [tuple(r)[:3] for r in targets.filter("is_photo").collect()] == [(7, 2.0, 3.0)]
    assert [r["target_id"] for r in risk.route_candidates(targets).collect()] == [0, 1, 2, 3, 4]


def brute_dbscan(points, eps, least):
    lat0 = math.radians(np.mean([p[0] for p in points]))
    size = max(eps / 4, 1)
    cells = [(math.floor(6371000 * math.radians(x) * math.cos(lat0) / size), math.floor(6371000 * math.radians(y) / size)) for y, x in points]
    names = sorted(set(cells))
    weight = {c: cells.count(c) for c in names}
    near = {c: [d for d in names if (c[0] - d[0]) ** 2 + (c[1] - d[1]) ** 2 <= (eps / size) ** 2 + 1e-9] for c in names}
    core = {c for c in names if sum(weight[d] for d in near[c]) >= max(2, least)}
    label, n = {}, 0
    for c in names:  # scan order
        if c in core and c not in label:
            waiting, label[c] = [c], n
            while waiting:
                for d in near[waiting.pop()]:
                    if d not in label:
                        label[d] = n
                        if d in core:
                            waiting.append(d)
            n += 1
    return [label.get(c, -1) for c in cells]


@pytest.mark.parametrize(("eps", "least", "seed"), [(150, 5, 1), (60, 3, 2), (3, 2, 3)])
def test_clusters(spark, eps, least, seed):
    rng = random.Random(seed)
    spread = eps / 40000
    hubs = [(37.4 + rng.uniform(-1, 1) * spread * 4, 126.9 + rng.uniform(-1, 1) * spread * 4) for _ in range(8)]
    points = [(y + rng.gauss(0, spread / 4), x + rng.gauss(0, spread / 4)) for y, x in hubs for _ in range(8)]
    points += [(37.4 + rng.uniform(-1, 1) * spread * 5, 126.9 + rng.uniform(-1, 1) * spread * 5) for _ in range(40)]
    got = cluster.cluster_points(spark, places(spark, points), eps, least)
    assert [r["cluster"] for r in got.orderBy("_row_id").collect()] == brute_dbscan(points, eps, least)


def test_too_few_points_are_noise(spark):
    got = cluster.cluster_points(spark, places(spark, [(37.4, 126.9)] * 3))
    assert [r["cluster"] for r in got.collect()] == [-1] * 3
    assert cluster.cluster_points(spark, places(spark, [(37.4, 126.9)]).limit(0), algorithm="hdbscan").count() == 0
    with pytest.raises(ValueError, match="no such algorithm"):
        cluster.cluster_points(spark, places(spark, [(37.4, 126.9)]), algorithm="x")


def test_offsets():
    assert len(cluster.offsets(150)) == 49 and len(cluster.offsets(500)) == 49 and len(cluster.offsets(2)) == 13


def test_summary(spark):
    rows = [(0, 0, "b", "t1"), (1, 0, "a", "t2"), (2, 0, None, "t1"), (3, 0, "a", None), (4, 0, "b", "t3"), (5, 1, None, None), (6, -1, "z", "z")]
    frame = spark.createDataFrame([(i, c, 1.0 * i, 2.0, r, t) for i, c, r, t in rows], "_row_id long, cluster long, lat double, lon double, road_address string, hazard_type string")
    got = [tuple(r) for r in cluster.top_clusters(cluster.cluster_summary(frame)).collect()]
    assert got == [(0, 5, 2.0, 2.0, "a", "t1, t2, t3"), (1, 1, 5.0, 2.0, "", "")]
    assert tuple(cluster.cluster_info(frame).first()) == (2, 1)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    rng.shuffle(edges)
    edges += [(7, 7), (None, 3), (1, 0)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Frozen(spark, "test")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in up} and len(got) == len(up)
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long"), Frozen(spark, "test")).count() == 0


STOPS = [(37.3943, 126.9568), (37.4009, 126.9220), (37.3810, 126.9330), (37.4100, 126.9500), (37.3900, 126.9700)]


def test_components_of_a_hub(spark, monkeypatch):
    from perilgrid.operators import components
    from perilgrid.sources.frozen import Frozen

    monkeypatch.setattr(components, "HEAVY", 5)
    rng = random.Random(3)
    edges = [(500, i) for i in range(300)] + [(i, 900) for i in range(0, 300, 7)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(2000 + rng.randrange(60), 2000 + rng.randrange(60)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Frozen(spark, "hub"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def stops(spark, points):
    return spark.createDataFrame([(1, i, *p) for i, p in enumerate(points)], "route_id long, pos int, lat double, lon double")


@pytest.mark.parametrize("closed", [False, True])
def test_routes(spark, closed):
    got = route.optimize(stops(spark, STOPS), closed).first()
    assert sorted(got["order"]) == [0, 1, 2, 3, 4] and got["order"][0] == 0 and got["is_approximate"]
    assert len(got["legs"]) == 4 + closed and got["total_m"] == pytest.approx(sum(got["legs"]))
    line = STOPS + STOPS[:1] if closed else STOPS
    assert got["total_m"] <= sum(metres(a, b) for a, b in zip(line, line[1:])) + 1e-6
    assert [r["from_pos"] for r in route.legs(route.optimize(stops(spark, STOPS), closed)).orderBy("step").collect()] == got["order"][: 4 + closed]


@pytest.mark.parametrize("n", [1, 2])
def test_short_routes(spark, n):
    got = route.optimize(stops(spark, STOPS[:n])).first()
    assert got["order"] == list(range(n)) and len(got["legs"]) == n - 1 and got["solver"] == ("none", "trivial")[n - 1]


def test_given_matrix(spark):
    matrix = geo.route_matrix(stops(spark, STOPS))
    plain = route.optimize(stops(spark, STOPS), matrix=matrix).first()
    doubled = route.optimize(stops(spark, STOPS), matrix=matrix.withColumn("dist_m", F.col("dist_m") * 2)).first()
    assert doubled["total_m"] == pytest.approx(2 * plain["total_m"]) and not plain["is_approximate"]
    with pytest.raises(Exception, match="matrix doesn't fit"):
        route.optimize(stops(spark, STOPS), matrix=matrix.filter("i < 3")).collect()


def test_two_opt_leaves_no_improvement():
    rng = np.random.default_rng(3)
    for n in (3, 4, 8):
        m = route.distances(37 + rng.random(n), 126 + rng.random(n))
        assert np.allclose(m, m.T) and not m.diagonal().any()
        order, _ = route.solve(m)
        best = route.length(m, order, False)
        for i in range(1, n - 1):
            for k in range(i + 1, n):
                other = order[:i] + order[i : k + 1][::-1] + order[k + 1 :]
                assert route.length(m, other, False) >= best - 1e-6


@pytest.mark.parametrize("closed", [False, True])
def test_changes_of_reversals(closed):
    """Against the lengths of whole routes, with distances that differ by direction."""
    rng = np.random.default_rng(4)
    m = rng.random((9, 9))
    np.fill_diagonal(m, 0)
    order = rng.permutation(9)
    for i in range(1, 8):
        for change, k in zip(route.reversal_changes(m, order, i, closed), range(i + 1, 9)):
            turned = np.r_[order[:i], order[i : k + 1][::-1], order[k + 1 :]]
            assert change == pytest.approx(route.length(m, turned, closed) - route.length(m, order, closed))


def test_long_routes():
    rng = np.random.default_rng(5)
    m = route.distances(37 + rng.random(300), 126 + rng.random(300))
    order, solver = route.solve(m, closed=True)
    assert sorted(order) == list(range(300)) and order[0] == 0 and solver == "nearest-neighbor+2opt"
    assert route.length(m, order, True) < route.length(m, route.nearest_first(m), True)
    assert route.solve(np.empty((0, 0))) == ([], "none") and route.solve(np.zeros((2, 2))) == ([0, 1], "trivial")


@pytest.mark.parametrize("closed", [False, True])
def test_guided_search(closed):
    rng = np.random.default_rng(4 + closed)
    for k in range(40):
        n = int(rng.integers(3, 8))
        m = route.distances(37 + rng.random(n) / 10, 126 + rng.random(n) / 10)
        if k % 3 == 2:  # one-way streets
            m = m * (1 + rng.random((n, n)) / 2)
            np.fill_diagonal(m, 0)
        if k % 5 == 4:
            m[1], m[:, 1] = m[0], m[:, 0]  # two stops at one place
            m[1, 1] = m[0, 1] = m[1, 0] = 0
        got, d = route.guided(m, closed), np.rint(m)
        assert sorted(got) == list(range(n)) and got[0] == 0 and got == route.guided(m, closed)
        best = min(route.length(d, np.array((0, *p)), closed) for p in itertools.permutations(range(1, n)))
        assert route.length(d, np.array(got), closed) == best


def test_guided_search_of_longer_routes():
    rng = np.random.default_rng(1)
    shorter = 0
    for n in (12, 20, 31):
        m = np.rint(route.distances(37 + rng.random(n) / 10, 126 + rng.random(n) / 10))
        two, found = route.solve(m)[0], route.solve(m, search=True)
        assert found[1] == "guided-local-search" and sorted(found[0]) == list(range(n))
        assert route.length(m, np.array(found[0]), False) <= route.length(m, np.array(two), False)
        shorter += route.length(m, np.array(found[0]), False) < route.length(m, np.array(two), False)
    assert shorter and route.solve(np.zeros((2, 2)), search=True) == ([0, 1], "trivial")


@pytest.mark.parametrize("closed", [False, True])
def test_few_stops_are_searched_in_full(spark, closed):
    """Routes of two to nine stops in one table, against all orders; a search of 4,000 routes of eight, one by one, took minutes."""
    rng = np.random.default_rng(12)
    rows = [(k, pos, 37.3 + float(a) / 100, 126.9 + float(b) / 100) for k in range(36) for pos, (a, b) in enumerate(rng.random((1 + k % 7, 2)))]
    got = {r["route_id"]: r for r in route.optimize(spark.createDataFrame(rows, "route_id long, pos int, lat double, lon double"), closed=closed, search=True).collect()}
    assert len(got) == 36
    for k, r in got.items():
        places = np.array([x[2:] for x in rows if x[0] == k])
        m = route.distances(places[:, 0], places[:, 1])
        d, n = np.rint(m), len(m)
        want = min(route.length(d, [0, *rest], closed) for rest in itertools.permutations(range(1, n)))
        assert sorted(r["order"]) == list(range(n)) and r["order"][0] == 0 and route.length(d, r["order"], closed) == want
        assert r["legs"] == pytest.approx(route.leg_lengths(m, np.array(r["order"]), closed)) and r["solver"] == ("none", "trivial", "exact")[min(n, 3) - 1]
    many = route.distances(rng.random((4000, 8)) / 10 + 37, rng.random((4000, 8)) / 10 + 126)
    start = time.monotonic()
    orders, _ = route.solve_all(many, closed, True)
    assert time.monotonic() - start < 20 and (np.sort(orders, axis=1) == np.arange(8)).all()


@pytest.mark.parametrize("radius", [0.0, 0.3, 40.0, 2500.0, 9e6, 20_015_000.0, 3e7])
def test_counts_of_heaps(spark, radius, monkeypatch):
    """Counts by cubes, against all pairs: heaps at a pole, at the antimeridian and elsewhere, copies, and rows without a place."""
    monkeypatch.setattr(sphere, "SOME", 4)
    rng = np.random.default_rng(6)
    heaps = [(89.99, 0.0, 0.02, 180.0), (10.0, 179.9995, 0.001, 0.001), (-40.0, 20.0, 0.05, 0.05), (0.0, 0.0, 90.0, 180.0)]
    places = [(min(90.0, float(y + a * h)), float((x + b * w + 180) % 360 - 180)) for y, x, h, w in heaps for a, b in rng.uniform(-1, 1, (150, 2))]
    places += places[:200] + [(None, 1.0), (float("nan"), 1.0)]
    targets = [(i, *places[i]) for i in range(0, len(places), 3)] + [(9999, None, None)]
    got = geo.radius_counts(spark.createDataFrame(places, "lat double, lon double"), spark.createDataFrame(targets, "target_id long, lat double, lon double"), radius)
    both = spark.createDataFrame(places, "lat double, lon double").crossJoin(spark.createDataFrame(targets, "target_id long, tlat double, tlon double"))
    dist = haversine(F.col("tlat"), F.col("tlon"), F.col("lat"), F.col("lon"))
    want = dict(both.filter("lat + tlat < 1e9").filter(dist <= radius).groupBy("target_id").count().collect())
    assert {r["target_id"]: r["n"] for r in got.collect()} == {t[0]: want.get(t[0], 0) for t in targets}


def test_counting_pairs_nothing_within(spark, monkeypatch):
    """20,000 targets amid 20,000 points: 400 million pairs, of which none is looked at."""
    monkeypatch.setattr(geo, "within", None)
    rows = spark.range(20_000).select(F.col("id").alias("target_id"), (F.lit(37.0) + F.col("id") * 1e-6).alias("lat"), F.lit(127.0).alias("lon"))
    start = time.monotonic()
    assert geo.radius_counts(rows, rows, 250_000.0).agg(F.min("n"), F.max("n"), F.count("*")).first()[:] == (20_000,) * 3
    assert time.monotonic() - start < 30


def test_nearest_of_few_places_as_down_the_tree(spark, monkeypatch):
    """Few places are compared in one pass without a shuffle; the tree gives the same distances."""
    rng = np.random.default_rng(9)
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300), strict=True)] + [(None, 1.0), (10.0, 180.0), (90.0, 0.0)]
    targets = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 700), rng.uniform(-180, 180, 700), strict=True))]
    targets += [(1000, None, 1.0), (1001, float("nan"), 1.0), (1002, 10.0, -180.0), (1003, -90.0, 5.0)]
    a, b = spark.createDataFrame(places, "lat double, lon double"), spark.createDataFrame(targets, "target_id long, lat double, lon double")
    few = geo.nearest(a, b)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    got = dict(few.collect())
    monkeypatch.setattr(geo, "FEW", 0)
    want = dict(geo.nearest(a, b).collect())
    assert got.keys() == want.keys() == {t[0] for t in targets} and got[1000] is got[1001] is None
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, abs=1e-6)
