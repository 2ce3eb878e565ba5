"""Operators on small regions and plain inputs, against expected values or a plain search."""

import heapq
import itertools
import random

from pyspark.sql import functions as F

from wayloom.functions import access, geo, text
from wayloom.operators import graph, lines, region, resolve, routing, search
from wayloom.streaming import state

INF = float("inf")


def small(spark, points, stretches):
    """A region from {id: (x, y, z)} and rows (a, b, class, extra columns as a dict)."""
    nodes = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, (x, y, z) in points.items()], "node long, x double, y double, z double")
    rows = []
    for i, (a, b, cls, more) in enumerate(stretches):
        (xa, ya, za), (xb, yb, zb) = points[a], points[b]
        rows.append((i, a, b, cls, float(((xa - xb) ** 2 + (ya - yb) ** 2) ** 0.5), float(max(zb - za, 0)), float(max(za - zb, 0)), more.get("sac", 0), more.get("sat_grade", 0), more.get("hike_ref", ""), more.get("ferrata", False), more.get("name", "")))
    st = spark.createDataFrame(rows, "st long, a long, b long, cls string, len double, up double, down double, sac int, sat_grade int, hike_ref string, ferrata boolean, name string")
    return region.Region(nodes, region.complete(st))


def ask(spark, r, stops, mode="hike", grade=3, alternatives=1, avoid=()):
    q = spark.createDataFrame([(1, list(stops), mode, grade, alternatives, list(avoid))], "id long, stops array<long>, mode string, grade int, alternatives int, avoid array<long>")
    return routing.route(r, q).first()


def test_two_modes_change_at_the_trailhead(spark):
    r = small(spark, {0: (0, 0, 100), 1: (1000, 0, 400), 2: (2000, 0, 900)}, [(0, 1, "residential", {}), (1, 2, "path", {})])
    got = ask(spark, r, [0, 2], "car+hike").routes[0]
    assert [(leg.mode, leg.meters, leg.ascent) for leg in got.legs] == [("car", 1000, 300), ("hike", 1000, 500)]
    assert abs(got.seconds - sum(leg.seconds for leg in got.legs) - access.SWITCH_S) < 1e-6
    assert got.ascent == 800


def test_grade_limits_and_what_would_do(spark):
    r = small(spark, {0: (0, 0, 0), 1: (1000, 0, 0)}, [(0, 1, "path", {"sac": 4, "sat_grade": 4, "ferrata": True})])
    refused = ask(spark, r, [0, 1], grade=3)
    assert not refused.routes and refused.needed_grade == 4 and "EEA" in refused.reason
    assert len(ask(spark, r, [0, 1], grade=4).routes) == 1


def test_walking_clock(spark):
    points = {0: (0, 0, 0), 1: (1000, 0, 0)}
    for cls, more, seconds in (("path", {"hike_ref": "1"}, 810), ("path", {}, 1080), ("track", {}, 1080), ("primary", {}, 1350)):
        assert round(ask(spark, small(spark, points, [(0, 1, cls, more)]), [0, 1]).routes[0].seconds) == seconds


def test_alternatives_are_distinct_and_avoided_ways_are_avoided(spark):
    points = {0: (0, 0, 0), 1: (3000, 0, 0), 2: (6000, 0, 0), 3: (6000, 1500, 0), 4: (6000, -2500, 0), 5: (9000, 0, 0)}
    ways = [(0, 1), (1, 2), (2, 5), (1, 3), (3, 5), (1, 4), (4, 5)]
    r = small(spark, points, [(a, b, "residential", {}) for a, b in ways])
    found = ask(spark, r, [0, 5], "car", alternatives=3).routes
    assert len(found) == 3 and found[0].seconds < found[1].seconds < found[2].seconds
    assert 1 not in ask(spark, r, [0, 5], "car", avoid=[1]).routes[0].legs[0].stretches
    assert ask(spark, r, [0, 5], "car", avoid=[0]).reason == "no route without the ways to avoid"


def test_a_named_stop_is_where_the_car_stays(spark):
    r = small(spark, {0: (0, 0, 0), 1: (1000, 0, 0), 2: (2000, 0, 0)}, [(0, 1, "residential", {}), (1, 2, "residential", {}), (1, 2, "path", {})])
    assert [leg.mode for leg in ask(spark, r, [0, 1, 2], "car+hike").routes[0].legs] == ["car", "hike"]
    assert [leg.mode for leg in ask(spark, r, [0, 2], "car+hike").routes[0].legs] == ["car"]


def test_malformed_requests_get_reasons(spark):
    r = small(spark, {0: (0, 0, 0), 1: (1000, 0, 0)}, [(0, 1, "path", {})])
    assert ask(spark, r, []).reason and ask(spark, r, [0]).reason and ask(spark, r, [0, 99]).reason
    assert ask(spark, r, [0, 1], "car").reason


def random_edges(seed, n=40, m=120):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), i, float(r.randrange(1, 30))) for i in range(m)]


def plain_distances(edges, start):
    out, heap = {}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in out:
            continue
        out[u] = d
        for a, b, _, w in edges:
            if a == u and b not in out:
                heapq.heappush(heap, (d + w, b))
    return out


def test_distances_by_kernel_and_by_rounds(spark):
    rows = random_edges(1)
    e = spark.createDataFrame(rows, "src long, dst long, st long, w double")
    want = {(s, n): d for s in (0, 3) for n, d in plain_distances(rows, s).items()}
    sources = spark.createDataFrame([(0,), (3,)], "source long")
    assert {(r.source, r.node): r.dist for r in graph.distances(e, sources).collect()} == want
    assert {(r.source, r.node): r.dist for r in graph.relax(e, sources.select("source", F.col("source").alias("node"))).collect()} == want


def test_components_both_ways(spark):
    rows = random_edges(2, n=90, m=60)
    e = spark.createDataFrame(rows, "src long, dst long, st long, w double")
    label = {n: n for r in rows for n in r[:2]}
    for _ in label:
        for a, b, *_ in rows:
            label[a] = label[b] = min(label[a], label[b])
    for f in (graph.components, graph.label_components):
        assert {r.node: r.component for r in f(e).collect()} == label


def test_a_graph_beyond_the_bound_is_not_broadcast(spark):
    e = spark.createDataFrame(random_edges(3), "src long, dst long, st long, w double")
    try:
        graph.arrays(e, limit=10)
    except graph.TooLarge:
        return
    raise AssertionError


def test_step_folding_keeps_totals_and_modes():
    steps = [{"name": f"n{i}", "mode": "hike", "meters": m, "seconds": m} for i, m in enumerate((90, 10, 30, 4200, 120, 2000))]
    out = lines.fold_steps(steps)
    assert [s["name"] for s in out] == ["n3", "n5"] and sum(s["meters"] for s in out) == 6450
    mixed = [{"name": "a", "mode": "car", "meters": 10, "seconds": 1}, {"name": "b", "mode": "hike", "meters": 10, "seconds": 1}]
    assert lines.fold_steps(mixed) == mixed
    assert len(lines.fold_steps([{"name": str(i), "mode": "hike", "meters": 200 + i, "seconds": 1} for i in range(120)])) <= 40


def test_simplify():
    assert lines.simplify([(0, 0), (5, 0.5), (10, 0)], 1) == [(0, 0), (10, 0)]
    assert lines.simplify([(0, 0), (5, 3), (10, 0)], 1) == [(0, 0), (5, 3), (10, 0)]
    ring = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert lines.simplify(ring, 1) == ring


def test_profile_and_climb(spark):
    d = spark.createDataFrame([([0.0, 100.0, 200.0], [0.0, 100.0, 200.0])], "cum array<double>, z array<double>")
    assert [(p.d, p.z) for p in d.select(lines.profile("cum", "z", 50.0).alias("p")).first().p] == [(0, 0), (50, 50), (100, 100), (150, 150), (200, 200)]
    z = spark.createDataFrame([([0.0, 5.0, 30.0, 25.0, 5.0],), ([1.0],), ([1.0, None],)], "z array<double>")
    assert [tuple(r.c) for r in z.select(geo.climb("z", 10).alias("c")).collect()] == [(30, 25), (0, 0), (0, 0)]


def test_trail_numbers(spark):
    yes, no = ["trail SF", "trail E401A", "102", "SAT 102", "cai 5"], ["Via Vallesinella", "Strada Provinciale 87 di Peio", "Trailfoot Road"]
    d = spark.createDataFrame([(n,) for n in yes + no], "n string")
    assert [r[0] for r in d.select(text.is_trail_number(F.col("n"))).collect()] == [True] * len(yes) + [False] * len(no)


def test_hilbert_order(spark):
    want = {(0, 0, 0): 0, (1, 0, 0): 1, (1, 0, 1): 2, (1, 1, 1): 3, (1, 1, 0): 4, (2, 0, 0): 5}
    d = spark.createDataFrame(list(want), "z int, x int, y int")
    assert {(r.z, r.x, r.y): r.t for r in d.withColumn("t", geo.hilbert_id("z", "x", "y")).collect()} == want
    every = spark.createDataFrame([(z, x, y) for z in range(5) for x in range(1 << z) for y in range(1 << z)], "z int, x int, y int")
    got = sorted(r.t for r in every.select(geo.hilbert_id("z", "x", "y").alias("t")).collect())
    assert got == list(range(len(got)))


def test_merge_is_greedy_and_not_transitive(spark):
    rows = [(1, "Rifugio Alto", 0.0, 0.0, 1.0), (2, "Alto", 50.0, 0.0, None), (3, "Alto Vecchio", 100.0, 0.0, None), (4, "Other", 10.0, 0.0, None)]
    d = spark.createDataFrame(rows, "id long, name string, x double, y double, ele double")
    assert {r.id: r.keep_id for r in resolve.merge_huts(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_limiter():
    step, s = state.limiter(), None
    for i in range(60):
        s, o = step(s, {"at": float(i) / 10})
        assert o["allowed"]
    s, o = step(s, {"at": 30.0})
    assert not o["allowed"] and 1 <= o["retry_after"] <= 61
    s, o = step(s, {"at": 60.0})
    assert o["allowed"]
    s, n = None, 0
    for minute in range(11):
        for _ in range(60):
            s, o = step(s, {"at": minute * 60.0})
            n += o["allowed"]
    assert n == 600


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [(u, float(t), i) for i, (u, t) in enumerate(itertools.product(("a", "b"), range(0, 40, 10)))]
    d = spark.createDataFrame(rows, "user string, at double, n long").coalesce(1)
    d.write.parquet(str(tmp_path / "in"))
    args = ("user", ["at", "n"], state.limiter(2, 3), "allowed boolean, retry_after int", ["at"])
    want = sorted(map(tuple, state.over_batch(d, *args).collect()))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = state.over_stream(stream, *args, idle_s=None).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("limited").collect())) == want


def test_dedup_stream(spark, tmp_path):
    d = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:00:30'), ('b', timestamp'2024-01-01 00:00:00') AS t(txn, at)")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = state.dedup_stream(stream, ["txn"], "at").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.txn for r in spark.table("once").collect()) == ["a", "b"]


def test_search_has_three_tiers(spark):
    names = ["Bolzano", "Via Bolzano", "Rifugio Pedrotti", "Malga Zirm", "Monte Olza", "Passo San Pellegrino", "Cima Dodici"]
    found = search.entries(spark.createDataFrame([(i, n, "peak", 1.0) for i, n in enumerate(names)], "id long, name string, kind string, weight double"))
    asked = {1: "olzano", 2: "bolz", 3: "Rifugio Firenze", 4: "o", 5: "xyz firenze", 6: "ellegri pass", 7: "xx olza", 8: "--", 9: "n p", 10: "qirm zirm"}
    queries = spark.createDataFrame(list(asked.items()), "qid long, q string")

    def best(limit):
        rows = search.search(found, queries, limit).collect()
        return {q: [(r.id, r.rank) for r in sorted(rows, key=lambda r: r.position) if r.qid == q] for q in asked}

    got = best(10)
    assert got[1] == [(0, 1), (1, 1)]  # only inside words
    assert got[2] == [(0, 3), (1, 2)]
    assert got[3] == [(2, 0)]  # no name holds both: the rarest word that any name holds
    assert got[4] == [(4, 2)] + [(i, 1) for i in (0, 6, 1, 2, 5)]
    assert got[5] == got[8] == [] and got[6] == [(5, 0)] and got[7] == [(0, 0), (4, 0), (1, 0)]
    assert got[9] == [(5, 1)] and got[10] == [(3, 0)]
    assert {q: v[:1] for q, v in got.items()} == best(1)
