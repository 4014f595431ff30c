"""Validity, repair, contact and location of shapes with several parts and holes."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from terralume.functions import geometry as geo
from terralume.operators import spatial, topology


def ring(*points):
    return "(" + ", ".join(f"{x} {y}" for x, y in [*points, points[0]]) + ")"


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def multi(*parts):
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(p) + ")" for p in parts) + ")"


UNIT, INNER = box(0, 0, 1, 1), box(0.25, 0.25, 0.75, 0.75)
# Text, reason (None: valid), area of what the shape covers.
CASES = {
    "square": (multi([UNIT]), None, 1),
    "hole": (multi([UNIT, INNER]), None, 0.75),
    "two apart": (multi([UNIT], [box(2, 0, 3, 1)]), None, 2),
    "corner contact": (multi([UNIT], [box(1, 1, 2, 2)]), None, 2),
    "shell in hole": (multi([UNIT, INNER], [box(0.4, 0.4, 0.6, 0.6)]), None, 0.79),
    "hole touches shell": (multi([UNIT, ring((0, 0), (0.5, 0.2), (0.2, 0.5))]), None, 1 - 0.105),
    "hole touches an edge": (multi([UNIT, ring((0.5, 0), (0.7, 0.5), (0.3, 0.5))]), None, 0.9),
    "clockwise": (multi([ring((0, 0), (0, 1), (1, 1), (1, 0))]), None, 1),
    "repeated vertex": (multi([ring((0, 0), (0, 0), (1, 0), (1, 1), (0, 1))]), None, 1),
    "nested shells": (multi([UNIT], [INNER]), topology.NESTED, 1),
    "equal parts": (multi([UNIT], [UNIT]), topology.SHARED, 1),
    "hole elsewhere": (multi([UNIT, box(3, 3, 4, 4)]), topology.NESTED, 1),
    "hole in hole": (multi([UNIT, INNER, box(0.4, 0.4, 0.6, 0.6)]), topology.NESTED, 0.75),
    "shared side": (multi([UNIT], [box(1, 0, 2, 1)]), topology.SHARED, 2),
    "part of a side": (multi([UNIT], [box(1, 0.25, 2, 0.5)]), topology.SHARED, 1.25),
    "overlap": (multi([UNIT], [box(0.5, 0.5, 1.5, 1.5)]), topology.CROSSING, 1.75),
    "hole across": (multi([UNIT, box(0.5, 0.5, 1.5, 0.75)]), topology.CROSSING, 0.875),
    "bow-tie": (multi([ring((0, 0), (1, 1), (1, 0), (0, 1))]), topology.CROSSING, 0.5),
    "eight at a vertex": (multi([ring((0, 0), (1, 0), (0.5, 0.5), (1, 1), (0, 1), (0.5, 0.5))]), topology.TOUCHING, 0.5),
    "spike": (multi([ring((0, 0), (1, 0), (1, 1), (1, 2), (1, 1), (0, 1))]), topology.SHARED, 1),
    "diamond on midpoints": (multi([UNIT], [ring((0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5))]), topology.NESTED, 1),
    "hole cuts in two": (multi([UNIT, ring((0.5, 0), (0.75, 0.5), (0.5, 1), (0.25, 0.5))]), topology.SPLIT, 0.75),
    "two holes cut in two": (
        multi([UNIT, ring((0.5, 0), (0.6, 0.25), (0.5, 0.5), (0.4, 0.25)), ring((0.5, 0.5), (0.6, 0.75), (0.5, 1), (0.4, 0.75))]),
        topology.SPLIT, 0.9,
    ),
    "three parts": (multi([UNIT], [box(0.5, 0, 1.5, 1)], [box(0.75, -1, 1.25, 2)]), topology.CROSSING, 2.5),
    "line": (multi([ring((0, 0), (1, 1), (2, 2))]), topology.RING, 0),
}


@pytest.fixture(scope="module")
def repaired(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in CASES.items()], "name string, t string")
    df = df.select("name", geo.from_wkt(F.col("t"), 4674).alias("geometry"))
    return topology.repaired(df, "name").cache()


def test_faults_and_areas(repaired):
    rows = repaired.select("name", "fault", geo.planar_area(F.col("geometry")).alias("area"), F.col("geometry.srid").alias("srid")).collect()
    got = {r["name"]: (r["fault"], pytest.approx(r["area"], abs=1e-12)) for r in rows}
    assert got == {k: (fault, area) for k, (_, fault, area) in CASES.items() if area}
    assert {r["srid"] for r in rows} == {4674}


def test_repaired_shapes_are_valid(repaired):
    again = topology.repaired(repaired.select("name", "geometry"), "name")
    assert [r["name"] for r in again.where("fault is not null").collect()] == []
    assert again.count() == sum(area > 0 for _, _, area in CASES.values())


def test_simple_small_rings_are_recognised(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in CASES.items()], "name string, t string")
    sure = {r["name"] for r in df.where(topology.surely_valid(geo.from_wkt(F.col("t")))).collect()}
    assert {"square", "clockwise"} <= sure <= {k for k, (_, fault, _) in CASES.items() if fault is None}


def test_random_parts_cover_what_points_say(spark):
    rng = random.Random(4)
    rows = {}
    for k in range(6):
        parts = []
        for _ in range(rng.randint(1, 4)):
            n = rng.randint(3, 7)
            parts.append([ring(*[(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(n)]) for _ in range(rng.randint(1, 2))])
        rows[f"s{k}"] = (multi(*parts), parts)
    df = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "name string, t string")
    made = {r["name"]: r["g"] for r in topology.repaired(df.select("name", geo.from_wkt(F.col("t")).alias("geometry")), "name").select("name", F.col("geometry").alias("g")).collect()}

    def odd(path, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(path, path[1:])) % 2 == 1

    read = lambda t: [tuple(map(float, p.split())) for p in t.strip("()").split(", ")]
    for name, (_, parts) in rows.items():
        out = [[[(p["x"], p["y"]) for p in r] for r in part] for part in (made[name]["parts"] if name in made else [])]
        for _ in range(300):
            x, y = rng.uniform(0, 12), rng.uniform(0, 12)
            want = any(odd(read(p[0]), x, y) and not any(odd(read(h), x, y) for h in p[1:]) for p in parts)
            assert want == (sum(odd(r, x, y) for p in out for r in p) % 2 == 1), (name, x, y)


def test_a_large_ring_takes_seconds(spark):
    n = 100_000
    points = [((2 + math.sin(40 * t)) * math.cos(t), (2 + math.sin(40 * t)) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
    points[n // 2], points[n // 2 + 1] = points[n // 2 + 1], points[n // 2]
    df = spark.createDataFrame([("big", "POLYGON (" + ring(*points) + ")")], "name string, t string")
    df = df.select("name", geo.from_wkt(F.col("t")).alias("geometry"))
    from terralume.session import materialize

    df = materialize(df, "large")
    start = time.time()
    faults, edges = topology.examined(df, "name")
    assert [r["fault"] for r in faults.collect()] == [topology.CROSSING]
    assert edges.count() > n
    assert time.time() - start < 60


def test_union_has_no_inner_borders(spark):
    n = 12
    rows = [(f"k{(x + y) % 2}" if k else "all", multi([box(x, y, x + 1, y + 1)])) for x in range(n) for y in range(n) if (x, y) != (5, 5) for k in (0, 1)]
    rows += [("all", multi([box(2, 2, 4, 4)])), ("all", multi([box(20, 0, 21, 1)])), ("none", multi([ring((0, 0), (1, 1), (2, 2))]))]
    df = spark.createDataFrame(rows, "key string, t string").select("key", geo.from_wkt(F.col("t")).alias("geometry"))
    got = {r["key"]: (r["parts"], r["rings"], r["points"], r["area"]) for r in topology.dissolved(df.repartition(3), "key").select(
        "key", F.size("geometry.parts").alias("parts"), F.size(geo.rings(F.col("geometry"))).alias("rings"),
        F.size(geo.vertices(F.col("geometry"))).alias("points"), geo.planar_area(F.col("geometry")).alias("area")).collect()}
    assert got["all"] == (2, 3, 15, pytest.approx(n * n - 1 + 1))
    assert got["k1"] == (72, 72, 360, pytest.approx(72))
    assert got["k0"][3] == pytest.approx(71) and "none" not in got


def shaped(spark, rows):
    df = spark.createDataFrame(rows, "id string, t string").select("id", geo.from_wkt(F.col("t")).alias("geometry"))
    return spatial.with_shape(df)


def test_contact_sees_every_part_and_slice(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CHUNK", 3)
    left = {"apart": multi([box(0, 0, 1, 1)], [box(10, 10, 11, 11)]), "hole": multi([box(30, 30, 40, 40), box(31, 31, 39, 39)]), "corner": multi([box(8, 8, 9, 9)])}
    right = {
        "around second": multi([box(9, 9, 12, 12)]), "in hole": multi([box(33, 33, 34, 34)]), "on hole": multi([box(31, 33, 32, 34)]),
        "far": multi([box(-9, -9, -8, -8)], [box(35, 35, 36, 36)]), "inside": multi([box(-20, -20, -19, -19)], [box(30.2, 30.2, 30.4, 30.4)]),
    }
    a, b = shaped(spark, list(left.items())), shaped(spark, list(right.items()))
    met = spatial.shape_contacts(spatial.valid_shapes(a), spatial.valid_shapes(b))
    names = met.join(a.select(F.col("shape").alias("a"), F.col("id").alias("l")), "a").join(b.select(F.col("shape").alias("b"), F.col("id").alias("r")), "b")
    assert sorted((r["l"], r["r"]) for r in names.collect()) == [
        ("apart", "around second"), ("corner", "around second"), ("hole", "inside"), ("hole", "on hole"),
    ]


def test_overlaps_count_an_area_once(spark):
    rows = [("nested", multi([UNIT], [INNER])), ("twice", multi([UNIT], [UNIT])), ("hole elsewhere", multi([UNIT, box(3, 3, 4, 4)]))]
    side = spatial.valid_shapes(shaped(spark, rows))
    areas = {r["shape"]: r["m2"] for r in spatial.shape_areas(side).collect()}
    assert len(areas) == 3 and all(m == pytest.approx(12_308_463_894, rel=1e-9) for m in areas.values())
    other = spatial.valid_shapes(shaped(spark, [("half", multi([box(0, 0, 0.5, 1)]))]))
    assert all(r["area_m2"] == pytest.approx(6_154_231_947, rel=1e-9) for r in spatial.shape_overlaps(side, other).collect())


def test_points_in_banded_and_small_shapes_agree(spark, monkeypatch):
    rng = random.Random(9)
    star = ring(*[((4 + rng.random()) * math.cos(t), (4 + rng.random()) * math.sin(t)) for t in (2 * math.pi * i / 60 for i in range(60))])
    rows = [("star", multi([star, box(-1, -1, 1, 1)], [box(-0.5, -0.5, 0.5, 0.5)])), ("box", multi([box(-3, -3, 3, 3)])), ("twin", multi([UNIT], [UNIT]))]
    side = shaped(spark, rows).withColumn("bbox", geo.bbox(F.col("geometry")))
    spots = [(f"p{i}", rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(300)]
    spots += [("edge", 1.0, 0.0), ("corner", 3.0, 3.0), ("center", 0.0, 0.0), ("ring", 0.75, 0.0), ("null", None, 1.0)]
    points = spark.createDataFrame(spots, "id string, x double, y double")
    found = []
    for chunk in (10_000, 4):
        monkeypatch.setattr(spatial, "CHUNK", chunk)
        hits = spatial.points_in_shapes(points, side, "id").join(side.select("shape", F.col("id").alias("name")), "shape")
        found.append(sorted((r["id"], r["name"]) for r in hits.collect()))
    assert found[0] == found[1]
    assert {n for i, n in found[0] if i == "center"} == {"star", "box", "twin"} and {n for i, n in found[0] if i == "ring"} == {"box", "twin"}
    assert {n for i, n in found[0] if i == "edge"} == {"star", "box", "twin"} and not [1 for i, _ in found[0] if i == "null"]


def test_small_shapes_in_their_row_and_joined_edges_agree(spark, monkeypatch):
    rng = random.Random(7)
    texts = {k: t for k, (t, _, _) in CASES.items()}
    for k in range(12):
        texts[f"r{k}"] = multi(*[[ring(*[(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(3, 6))]) for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 3))])
    df = spark.createDataFrame(list(texts.items()), "name string, t string").select("name", geo.from_wkt(F.col("t"), 4674).alias("geometry"))
    joined_edges, calls, found = topology.meetings, [], []
    monkeypatch.setattr(topology, "meetings", lambda *a: calls.append(a) or joined_edges(*a))
    flat = lambda g: [[[(round(p["x"], 9), round(p["y"], 9)) for p in r] for r in part] for part in g["parts"]]
    for few in (topology.FEW, 0):
        monkeypatch.setattr(topology, "FEW", few)
        fixed = {r["name"]: (r["fault"], r["geometry"]["srid"], flat(r["geometry"])) for r in topology.repaired(df, "name").collect()}
        wrong = sorted(topology.faults(df, "name").collect())
        united = {r["name"]: flat(r["geometry"]) for r in topology.dissolved(df, "name").collect()}
        found.append((fixed, wrong, united, len(calls)))
    assert found[0][:3] == found[1][:3]
    # No edges of small shapes are joined.
    assert found[0][3] == 0 and found[1][3] == 3
