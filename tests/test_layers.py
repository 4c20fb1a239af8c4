"""Polygon files, thinning with shared borders, ordered numbering."""

import glob
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.catalog import standins as S
from limnos.catalog.queries import _layer
from limnos.operators import spatial as SP
from limnos.operators.ordering import nth_largest, numbered
from limnos.operators.topology import junctions, ring_arcs, thin
from limnos.plans import watersheds as W
from limnos.sources import geo as G
from tests.conftest import SF_SMALL, rows

LAYER = T.StructType([T.StructField("pid", T.LongType()), T.StructField("polys", SP.POLYS)])
PROPS = T.StructType([T.StructField("pid", T.LongType()), T.StructField("name", T.StringType())])


def square(x, y, side=1.0):
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]


def collection(n, indent=None, name=lambda k: f"N{k}"):
    return json.dumps({"type": "FeatureCollection", "name": "layer", "features": [
        {"type": "Feature", "properties": {"pid": k, "name": name(k)},
         "geometry": {"type": "Polygon", "coordinates": [square(float(k), 0.5)]} if k % 50 else None}
        for k in range(n)]}, indent=indent)


# ---- reading ----

@pytest.mark.parametrize("indent", [None, 0, 2])
def test_one_collection_is_read_by_many_tasks(spark, tmp, indent):
    with open(f"{tmp}/layer.geojson", "w") as fh:
        fh.write(collection(3000, indent, lambda k: f'He said "Feature" {k} }}, {{ "type": '))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = G.read_geojson(spark, f"{tmp}/layer.geojson", PROPS)
        assert df.rdd.getNumPartitions() >= 8
        got = {r["Pid"]: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == list(range(3000))
    assert got[7]["polys"] == [[square(7.0, 0.5)]] and got[50]["polys"] is None
    assert got[8]["Name"] == 'He said "Feature" 8 }, { "type": '


def test_a_property_that_looks_like_a_feature_fails(spark, tmp):
    with open(f"{tmp}/layer.geojson", "w") as fh:
        fh.write(collection(3, name=lambda k: "Feature"))
    with pytest.raises(Exception, match="does not end where a feature ends|MALFORMED|malformed"):
        G.read_geojson(spark, f"{tmp}/layer.geojson", PROPS).collect()


def test_newline_delimited_features(spark, tmp):
    with open(f"{tmp}/layer.jsonl", "w") as fh:
        for f in json.loads(collection(5))["features"]:
            fh.write(json.dumps(f) + "\n")
    assert G.read_geojson(spark, f"{tmp}/layer.jsonl", PROPS, features_per_line=True).count() == 5


# ---- writing ----

def test_written_collections_are_valid(spark, tmp):
    clockwise, hole = square(0.0, 0.0, 4.0)[::-1], square(1.0, 1.0)
    polys = {1: [[clockwise, hole]], 2: [[square(0.0, 0.0)[:-1]], [square(5.0, 5.0)]], 3: [],
             4: None, 5: [[[[0.0, 0.0], [1.0, 1.0]]], [square(2.0, 2.0)]]}
    df = spark.createDataFrame(list(polys.items()), LAYER).withColumn("name", F.lit('a "b"\n'))
    G.write_geojson(df, f"{tmp}/out", ["pid", "name"], features_per_file=2)
    files = glob.glob(f"{tmp}/out/file=*/part-*")
    assert len(files) == 3
    feats = {}
    for path in files:
        with open(path) as fh:
            fc = json.load(fh)
        assert fc["type"] == "FeatureCollection"
        feats.update({f["properties"]["pid"]: f for f in fc["features"]})
    assert sorted(feats) == [1, 2, 3, 4, 5] and feats[1]["properties"]["name"] == 'a "b"\n'

    def turned(r):
        assert r[0] == r[-1]
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))
    outer, inner = feats[1]["geometry"]["coordinates"]
    assert feats[1]["geometry"]["type"] == "Polygon" and turned(outer) > 0 > turned(inner)
    assert feats[2]["geometry"]["type"] == "MultiPolygon"
    assert all(turned(p[0]) > 0 for p in feats[2]["geometry"]["coordinates"])
    assert feats[3]["geometry"] is None and feats[4]["geometry"] is None
    assert feats[5]["geometry"]["coordinates"] == [square(2.0, 2.0)]     # no area: left out
    back = {r["Pid"]: r["polys"] for r in G.read_geojson(spark, f"{tmp}/out", PROPS).collect()}
    assert back[1] == [[outer, inner]] and len(back[2]) == 2


def test_empty_layer_is_one_empty_collection(spark, tmp):
    G.write_geojson(spark.createDataFrame([], LAYER), f"{tmp}/out", ["pid"])
    path, = glob.glob(f"{tmp}/out/file=*/part-*")
    with open(path) as fh:
        assert json.load(fh)["features"] == []
    assert G.read_geojson(spark, f"{tmp}/out", PROPS).count() == 0


def test_cells_with_bounds_skip_strips(spark, tmp):
    cells = spark.range(10_000).selectExpr("cast(id % 100 as double) x", "cast(id div 100 as double) y", "cast(id % 5 as int) class",
                                           "1.0D cell_area")
    path = G.write_cells(cells, f"{tmp}/cells", 10.0)
    got = G.read_cells(spark, path, (10.0, 25.0, 19.0, 31.0), 10.0)
    assert got.count() == 10 * 7 and {r["y"] for r in got.collect()} == set(map(float, range(25, 32)))
    assert "PartitionFilters: [isnotnull(strip" in got._jdf.queryExecution().executedPlan().toString()
    assert G.read_cells(spark, path).count() == 10_000


# ---- thinning ----

def segments(polys):
    for part in polys or []:
        for ring in part:
            assert ring[0] == ring[-1]
            for a, b in zip(ring, ring[1:]):
                yield tuple(a), tuple(b)


def test_neighbours_keep_a_common_border(spark):
    layer = _layer(spark, SF_SMALL, S.BASIN_VERTICES, S.BASIN_ATTRS).select("pid", "polys")
    n = layer.count()
    before = Counter(frozenset(s) for p, in rows(layer, "polys") for s in segments(p))
    out = thin(layer, "pid", 0.3)
    after = Counter(frozenset(s) for p, in rows(out, "polys") for s in segments(p))
    assert out.count() == n and sum(after.values()) < 0.6 * sum(before.values())
    # borders held by one polygon only are the outline, as before; no gap opens inside
    ends = lambda c: {v for s, k in c.items() if k == 1 for v in s}
    assert set(after.values()) <= {1, 2} and ends(after) <= ends(before)
    area = lambda df: df.select(F.sum(SP.planar_area())).first()[0]
    outline = sum(1 for k in after.values() if k == 1)
    assert abs(area(out) - area(layer)) < 0.02 * outline       # only the outline's bends count


def visvalingam(pts):
    """Effective areas by brute force."""
    live, out, least = list(range(len(pts))), {}, 0.0
    while len(live) > 2:
        tri = [abs((pts[b][0] - pts[a][0]) * (pts[c][1] - pts[a][1]) - (pts[c][0] - pts[a][0]) * (pts[b][1] - pts[a][1])) / 2
               for a, b, c in zip(live, live[1:], live[2:])]
        k = tri.index(min(tri))
        least = max(least, tri[k])
        out[live.pop(k + 1)] = least
    return out


def test_ring_without_neighbours_keeps_the_largest_areas(spark):
    rng = random.Random(8)
    ring = [[math.cos(t / 10) * rng.uniform(0.8, 1.2), math.sin(t / 10) * rng.uniform(0.8, 1.2)] for t in range(62)]
    start = ring.index(min(ring))
    turned = ring[start:] + ring[:start]
    want = visvalingam([*turned, turned[0]])
    for keep in (0.1, 0.5, 1.0):
        out = thin(spark.createDataFrame([(1, [[[*ring, ring[0]]]])], LAYER), "pid", keep).first()["polys"][0][0]
        limit = sorted(want.values(), reverse=True)[max(1, round(keep * len(want))) - 1]
        kept = {tuple(turned[k]) for k, a in want.items() if a >= limit} | {tuple(turned[0])}
        assert set(map(tuple, out)) == kept and out[0] == out[-1]


def test_island_in_a_hole_stays_a_triangle_at_least(spark):
    circle = [[math.cos(t / 5), math.sin(t / 5)] for t in range(31)]
    hole = [*circle, circle[0]]
    layer = spark.createDataFrame([(1, [[square(-3.0, -3.0, 6.0), hole[::-1]]]), (2, [[hole]]), (3, None), (4, [])], LAYER)
    assert junctions(_rings(layer)).count() == 0
    arcs = ring_arcs(layer, "pid")
    assert arcs.count() == 3 and arcs.select("arc").distinct().count() == 2     # the hole and the island are one arc
    out = dict(rows(thin(layer, "pid", 0.01), "pid", "polys"))
    assert out[3] is None and not out[4]
    assert len(out[2][0][0]) >= 4 and {tuple(v) for v in out[2][0][0]} == {tuple(v) for v in out[1][0][1]}


def _rings(layer):
    from limnos.operators.topology import ring_vertices
    return ring_vertices(layer, "pid").groupBy("pid", "part", "ring").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.struct("x", "y").alias("v")))), lambda s: s["v"]).alias("vs"))


def test_two_polygons_with_a_common_side(spark):
    # the common border winds between two junctions; both keep the same vertices of it
    mid = [[1.0, 0.0], [1.2, 0.3], [0.9, 0.5], [1.01, 0.7], [1.0, 1.0]]
    left = [[0.0, 0.0], *mid, [0.0, 1.0], [0.0, 0.0]]
    right = [*mid[::-1], [2.0, 0.0], [2.0, 1.0], [1.0, 1.0]]
    layer = spark.createDataFrame([(1, [[left]]), (2, [[right]])], LAYER)
    out = dict(rows(thin(layer, "pid", 0.4), "pid", "polys"))
    a, b = ({tuple(v) for v in out[k][0][0] if 0.5 < v[0] < 1.5} for k in (1, 2))
    assert a == b and {(1.0, 0.0), (1.0, 1.0), (1.2, 0.3)} <= a and len(a) < 5


def test_display_layers_leave_lakes_alone(spark):
    lakes = _layer(spark, SF_SMALL, S.LAKE_VERTICES, S.LAKE_ATTRS)
    assert W.display_layer(lakes, "waterbodies") is lakes
    top = W.major_lakes(lakes, 3)
    assert top.count() == 3 and top.agg(F.min("Area")).first()[0] > 0


# ---- numbering ----

def test_numbered_equals_a_sort(spark):
    rng = random.Random(9)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), k) for k in range(500)]
    df = spark.createDataFrame(data, "a int, b string, k int").repartition(7)
    got = {r["k"]: r["row"] for r in numbered(df, "a", "b", desc=("a",), partitions=5).collect()}
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or "", r[2]))
    assert [got[k] for _, _, k in order] == list(range(1, 501))


def test_nth_largest_by_digits(spark):
    rng = random.Random(10)
    values = [rng.choice([0, 5, 1 << 20, rng.getrandbits(62)]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    order = sorted(values, reverse=True)
    for n in (1, 2, 150, 300):
        assert nth_largest(df, "v", n) == order[n - 1]
    assert nth_largest(df, "v", 999) == order[-1]
