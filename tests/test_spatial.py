import math
import random

import pytest
from pyspark.sql import functions as F

from limnos.operators import spatial as SP
from limnos.sources.geo import polygons_from_vertices, read_geojson
from pyspark.sql import types as T
from tests.conftest import rows

def fl(x):
    return [fl(v) for v in x] if isinstance(x, list) else float(x)


SQUARE_WITH_HOLE = fl([[[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]])
TWO_PARTS = fl([[[[5, 0], [6, 0], [6, 1], [5, 1], [5, 0]]], [[[7, 0], [8, 0], [8, 1], [7, 1], [7, 0]]]])
DIAMOND = fl([[[[0, 2], [2, 4], [4, 2], [2, 0]]]])  # unclosed on purpose


def layer(spark):
    return spark.createDataFrame([(1, SQUARE_WITH_HOLE), (2, TWO_PARTS), (3, DIAMOND)],
                                 T.StructType([T.StructField("pid", T.IntegerType()),
                                               T.StructField("polys", SP.POLYS)]))


def brute_inside(px, py, polys):
    n = 0
    for part in polys:
        for ring in part:
            ring = ring + [ring[0]] if ring[0] != ring[-1] else ring
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                    n += 1
    return n % 2 == 1


def test_point_in_polygon_matches_brute_force(spark):
    pts = [(i, 0.37 * (i % 23) - 0.3, 0.29 * (i // 23) - 0.2) for i in range(23 * 17)]
    p = spark.createDataFrame(pts, "id int, x double, y double")
    got = set(rows(SP.point_in_polygon(p, "id", "x", "y", layer(spark), "pid", tile=0.5)))
    polys = {1: SQUARE_WITH_HOLE, 2: TWO_PARTS, 3: DIAMOND}
    want = {(i, k) for i, x, y in pts for k, poly in polys.items() if brute_inside(x, y, poly)}
    assert got == want and len(want) > 20


def test_first_match_keeps_lowest_polygon(spark):
    p = spark.createDataFrame([(1, 2.0, 2.5), (2, 3.0, 0.5), (3, 10.0, 10.0)], "id int, x double, y double")
    lyr = layer(spark).withColumn("name", F.concat(F.lit("P"), F.col("pid").cast("string")))
    out = dict(rows(SP.first_match_join(p, "id", "x", "y", lyr, "pid", ["name"]), "id", "name"))
    assert out == {1: "P1", 2: "P1", 3: None}


def test_rasterize_matches_cell_centres(spark):
    cells = set(rows(SP.rasterize(layer(spark), "pid", 0.0, 0.0, 0.25)))
    polys = {1: SQUARE_WITH_HOLE, 2: TWO_PARTS, 3: DIAMOND}
    want = set()
    for k, poly in polys.items():
        for i in range(-2, 40):
            for j in range(-2, 20):
                if brute_inside(0.0 + (i + 0.5) * 0.25, 0.0 + (j + 0.5) * 0.25, poly):
                    want.add((k, i, j))
    assert cells == want


def test_largest_overlap_60_40(spark):
    child = spark.createDataFrame([(1, fl([[[[0, 0], [10, 0], [10, 1], [0, 1], [0, 0]]]])),
                                   (2, fl([[[[50, 50], [51, 50], [51, 51], [50, 50]]]]))],
                                  T.StructType([T.StructField("cid", T.IntegerType()),
                                                T.StructField("polys", SP.POLYS)]))
    parent = spark.createDataFrame([(7, fl([[[[0, -1], [6, -1], [6, 2], [0, 2], [0, -1]]]]), "west"),
                                    (8, fl([[[[6, -1], [10, -1], [10, 2], [6, 2], [6, -1]]]]), "east")],
                                   T.StructType([T.StructField("ppid", T.IntegerType()),
                                                 T.StructField("polys", SP.POLYS),
                                                 T.StructField("name", T.StringType())]))
    out = dict(rows(SP.largest_overlap(child, "cid", parent, "ppid", 0.0, 0.0, 0.1, ["name"]),
                    "cid", "name"))
    assert out == {1: "west", 2: None}


def star(rng, cx, cy, n, lo=0.2, hi=1.5):
    """A closed ring around (cx, cy) with n vertices at random distances."""
    v = [[cx + r * math.cos(t), cy + r * math.sin(t)] for t, r in
         ((2 * math.pi * k / n, rng.uniform(lo, hi)) for k in range(n))]
    return v + v[:1]


def star_layer(spark, seed, n=12):
    """Overlapping star polygons, some with a hole (in either direction) and a second part."""
    rng = random.Random(seed)
    polys = {}
    for k in range(n):
        cx, cy = rng.uniform(0, 6), rng.uniform(-3, 3)
        part = [star(rng, cx, cy, rng.randrange(3, 60), 0.5)]
        if k % 3 == 0:
            hole = star(rng, cx, cy, rng.randrange(3, 20), 0.1, 0.2)
            part.append(hole[::-1] if k % 2 else hole)
        if k % 5 == 0:
            part[0] = part[0][::-1]
        polys[k] = [part] + ([[star(rng, cx + 20, cy, 5)]] if k % 4 == 0 else [])
    df = spark.createDataFrame(list(polys.items()), T.StructType([T.StructField("pid", T.IntegerType()),
                                                                  T.StructField("polys", SP.POLYS)]))
    return df, polys


@pytest.mark.parametrize("tile", [0.07, 0.4, 3.0])
def test_tile_index_agrees_with_rays(spark, tile):
    # tiles far smaller and larger than the polygons; points on vertices and edges too
    lyr, polys = star_layer(spark, 1)
    rng = random.Random(2)
    pts = [(k, rng.uniform(-2, 28), rng.uniform(-5, 5)) for k in range(400)]
    pts += [(1000 + k, x, y) for k, (x, y) in enumerate(v for p in polys.values() for v in p[0][0][:6])]
    pts += [(2000, None, 1.0), (2001, 1.0, None)]
    got = set(rows(SP.point_in_polygon(spark.createDataFrame(pts, "id int, x double, y double"), "id", "x", "y", lyr, "pid", tile)))
    want = {(i, k) for i, x, y in pts if x is not None and y is not None
            for k, poly in polys.items() if brute_inside(x, y, poly)}
    assert got == want and len(want) > 100


def test_points_meet_few_index_rows(spark):
    # many polygons in one latitude band: a point meets those of its own tile only
    n = 200
    lyr = spark.createDataFrame([(k, [[[[2.0 * k, 0.0], [2.0 * k + 1.5, 0.0], [2.0 * k + 1.5, 1.0], [2.0 * k, 1.0]]]])
                                 for k in range(n)],
                                T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("polys", SP.POLYS)]))
    pts = spark.range(2000).select("id", (F.col("id") * 0.2 + 0.05).alias("x"), F.lit(0.51).alias("y"))
    met = SP.tile_matches(pts, "x", "y", SP.tile_index(lyr, "pid", 0.1), 0.1)
    inside = SP.point_in_polygon(pts, "id", "x", "y", lyr, "pid", 0.1).count()
    assert inside == 1600 and inside <= met.count() <= 1.2 * inside      # by latitude alone: 2 * 200 * 2000


def test_inner_tiles_come_as_wide_ones(spark):
    lyr = spark.createDataFrame([(1, fl([[[[0, 0], [100, 0], [100, 1], [0, 1]]]]))],
                                T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("polys", SP.POLYS)]))
    index = SP.tile_index(lyr, "pid", 0.1).where("size(segs) = 0")
    assert index.where("level = 0").count() <= 126 * 11
    assert index.where("level > 0").count() >= 9 * 14


def test_spans_share_the_same_cells(spark):
    a, _ = star_layer(spark, 3)
    b, _ = star_layer(spark, 4, 7)
    grid = (-3.0, -5.0, 0.05)
    got = set(rows(SP.shared_cells(SP.row_spans(a, "pid", *grid), SP.row_spans(b, "pid", *grid), "pid", "pid", block=3)))
    ca, cb = SP.rasterize(a, "pid", *grid), SP.rasterize(b, "pid", *grid).withColumnRenamed("pid", "q")
    want = set(rows(ca.join(cb, ["i", "j"]).groupBy("pid", "q").count()))
    assert got == want and len(want) > 10


def clipped_area(ring, xl, yl, xh, yh):
    """Area of a ring inside a box, by clipping at its four sides (signed by the ring)."""
    pts = ring[:-1]
    for axis, bound, keep in ((0, xl, 1), (0, xh, -1), (1, yl, 1), (1, yh, -1)):
        out = []
        for (p, q) in zip(pts, pts[1:] + pts[:1]):
            a, b = (p[axis] - bound) * keep, (q[axis] - bound) * keep
            if a >= 0:
                out.append(p)
            if (a < 0) != (b < 0):
                t = a / (a - b)
                out.append([p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])])
        pts = out
        if not pts:
            return 0.0
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(pts, pts[1:] + pts[:1])) / 2


@pytest.mark.parametrize("cell", [0.13, 0.9])
def test_coverage_is_exact(spark, cell):
    lyr, polys = star_layer(spark, 5, 6)
    x0, y0 = -3.05, -5.02
    got = {}
    for pid, j, i0, i1, frac in rows(SP.coverage_spans(lyr, "pid", x0, y0, cell)):
        for i in range(i0, i1 + 1):
            assert (pid, i, j) not in got
            got[pid, i, j] = frac
    for pid, poly in polys.items():
        cells = {(i, j) for p, i, j in got if p == pid}
        area = 0.0
        for part in poly:
            for k, ring in enumerate(part):
                area += (-1 if k else 1) * abs(clipped_area(ring, -100, -100, 100, 100))
        assert abs(sum(got[pid, i, j] for i, j in cells) * cell * cell - area) < 1e-9
        for i, j in random.Random(6).sample(sorted(cells), min(150, len(cells))):
            box = (x0 + i * cell, y0 + j * cell, x0 + (i + 1) * cell, y0 + (j + 1) * cell)
            want = sum((-1 if k else 1) * abs(clipped_area(ring, *box)) for part in poly for k, ring in enumerate(part))
            assert abs(got[pid, i, j] - want / (cell * cell)) < 1e-9


def test_cells_meet_the_polygons_that_cover_them(spark):
    sq = spark.createDataFrame([(1, fl([[[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]]))],
                               T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("polys", SP.POLYS)]))
    cells = spark.createDataFrame([(i, j, 10.0) for i in range(-2, 3) for j in range(-2, 3)], "i long, j long, w double")
    spans = SP.coverage_spans(sq, "pid", 0.5, 0.5, 1.0)
    got = {(i, j): f for i, j, f in rows(SP.cover_cells(cells, spans, ["pid"]), "i", "j", "frac")}
    assert got == {(-1, -1): 0.25, (0, -1): 0.25, (-1, 0): 0.25, (0, 0): 0.25}


def test_transverse_mercator_roundtrip(spark):
    # Central meridian maps to the false easting; inverse restores lon/lat
    df = spark.createDataFrame([(-90.0, 44.0), (-92.5, 46.7), (-87.1, 42.6)], "lon double, lat double")
    x, y = SP.tm_forward("lon", "lat")
    fw = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = SP.tm_inverse(F.col("x"), F.col("y"))
    back = rows(fw.select("lon", "lat", "x", lon.alias("lon2"), lat.alias("lat2")))
    assert abs(back[0][2] - 520000.0) < 1e-6
    for lo, la, _, lo2, la2 in back:
        assert abs(lo - lo2) < 1e-8 and abs(la - la2) < 1e-8


def test_tm_against_krueger_series(spark):
    # an independent formulation (Krueger series) agrees to a millimetre
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    n = f / (2 - f)
    A = a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    al = [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240]
    e = math.sqrt(f * (2 - f))

    def kr(lon, lat):
        phi, lam = math.radians(lat), math.radians(lon + 90.0)
        t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
        xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
        x = eta + sum(al[j] * math.cos(2 * (j + 1) * xi) * math.sinh(2 * (j + 1) * eta) for j in range(3))
        y = xi + sum(al[j] * math.sin(2 * (j + 1) * xi) * math.cosh(2 * (j + 1) * eta) for j in range(3))
        return 520000.0 + k0 * A * x, -4480000.0 + k0 * A * y

    pts = [(-92.4, 46.5), (-87.2, 42.7), (-90.0, 45.0)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    x, y = SP.tm_forward("lon", "lat")
    for (lo, la), (gx, gy) in zip(pts, rows(df.select(x, y))):
        kx, ky = kr(lo, la)
        assert abs(gx - kx) < 1e-3 and abs(gy - ky) < 1e-3


def test_layer_stats_and_vertices(spark):
    st = SP.layer_stats(layer(spark)).first()
    assert (st["features"], st["rings"], st["vertices"]) == (3, 5, 24)
    v = spark.createDataFrame([(1, 0, 0, i, float(x), float(y)) for i, (x, y) in
                               enumerate([(0, 0), (1, 0), (1, 1), (0, 0)])],
                              "pid int, part int, ring int, i int, x double, y double")
    assert polygons_from_vertices(v, "pid").first()["polys"] == [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]


def test_geojson_reader(spark, tmp):
    import json
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"COUNTY_NAME": "A", "DNR_REGION_NAME": "N"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"COUNTY_NAME": "B", "DNR_REGION_NAME": "S"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[2, 2], [3, 2], [3, 3], [2, 2]]]]}}]}
    with open(f"{tmp}/c.geojson", "w") as fh:
        json.dump(fc, fh)
    props = T.StructType([T.StructField("COUNTY_NAME", T.StringType()),
                          T.StructField("DNR_REGION_NAME", T.StringType())])
    df = read_geojson(spark, f"{tmp}/c.geojson", props)
    assert df.columns == ["CountyName", "DnrRegionName", "polys"]
    got = {r["CountyName"]: r["polys"] for r in df.collect()}
    assert got["A"] == [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]
    assert got["B"] == [[[[2.0, 2.0], [3.0, 2.0], [3.0, 3.0], [2.0, 2.0]]]]


def test_albers_origin_and_scale(spark):
    # EPSG:5070 puts (lon0, lat0) = (-96, 23) at the origin; x grows eastward
    df = spark.createDataFrame([(-96.0, 23.0), (-90.0, 44.0)], "lon double, lat double")
    x, y = SP.albers_forward("lon", "lat")
    (x0, y0), (x1, y1) = rows(df.select(x, y))
    assert abs(x0) < 1e-6 and abs(y0) < 1e-6
    assert 400000 < x1 < 600000 and 2200000 < y1 < 2500000
