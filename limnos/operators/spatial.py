"""Spatial operators built from DataFrame joins and array functions.

Layers are DataFrames with an id column and ``polys``:
``array<array<array<array<double>>>>`` = polygon parts -> rings -> vertices
-> (x, y).  Polygon and MultiPolygon share that type; holes are extra rings.

* ``edges`` turns rings into segments inside each row (no shuffle).
* ``point_in_polygon`` is an equi-join on the tiles of a two-level grid: only
  tiles that a ring touches need its segments.  A hot tile is split by AQE's
  skew join.
* ``row_spans`` is a scanline fill: per polygon and grid row, the sorted
  crossings give runs of covered cells.  The largest-overlap join (G3) is span
  arithmetic on them; no row is made per cell.
* ``coverage_spans`` gives the exact covered share of grid cells (G5): one row per
  cell that a ring touches, one span for those between.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.operators.groups import keep_first
from limnos.operators.joins import join_ns

POLYS = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))

# Expressions over whole geometries are written as SQL text: one call to the JVM
# each, where column operators would take one a symbol.


def _d(x: float) -> str:
    """A double literal."""
    return f"({float(x)!r}D)"


# --- geometry basics --------------------------------------------------------------

_CLOSED = ("CASE WHEN size(r) > 0 AND (get(get(r, 0), 0) <> get(get(r, size(r) - 1), 0) "
           "OR get(get(r, 0), 1) <> get(get(r, size(r) - 1), 1)) THEN concat(r, array(get(r, 0))) ELSE r END")


def close_ring(r: Column) -> Column:
    """The ring with its first vertex repeated at the end."""
    first, last = F.get(r, F.lit(0)), F.get(r, F.size(r) - 1)
    return F.when((F.size(r) > 0) & ((first[0] != last[0]) | (first[1] != last[1])),
                  F.concat(r, F.array(first))).otherwise(r)


def edges(layer: DataFrame, id_col: str) -> DataFrame:
    """(id, x1, y1, x2, y2) for every ring segment, computed within the row."""
    segments = ("flatten(transform(transform(flatten(polys), r -> " + _CLOSED + "), r -> "
                "transform(sequence(1, greatest(size(r) - 1, 1)), i -> named_struct("
                "'x1', get(get(r, i - 1), 0), 'y1', get(get(r, i - 1), 1), 'x2', get(get(r, i), 0), 'y2', get(get(r, i), 1)))))")
    return layer.selectExpr(f"`{id_col}`", f"inline({segments})").where("x2 is not null")


def _x_at(y: str, s: str = "") -> str:
    """x where the segment crosses the horizontal line at y."""
    return f"(({s}x2 - {s}x1) * ({y} - {s}y1) / ({s}y2 - {s}y1) + {s}x1)"


def _crosses(y: str, s: str = "") -> str:
    """Half-open straddle test, so a vertex on the line counts once."""
    return f"(({s}y1 > {y}) <> ({s}y2 > {y}))"


# twice the signed area of a closed ring r, positive when counter-clockwise
_TURNED = ("aggregate(sequence(1, greatest(size(r) - 1, 1)), 0.0D, (n, i) -> n + coalesce("
           "get(get(r, i - 1), 0) * get(get(r, i), 1) - get(get(r, i), 0) * get(get(r, i - 1), 1), 0.0D))")
_ORIENTED = (f"transform(transform(polys, part -> transform(part, r -> {_CLOSED})), part -> transform(part, (r, k) -> "
             f"CASE WHEN ({_TURNED} < 0) = (k = 0) THEN reverse(r) ELSE r END))")


def oriented() -> Column:
    """``polys`` with closed rings, the first of a part counter-clockwise and the
    others (holes) clockwise."""
    return F.expr(_ORIENTED)


def planar_area() -> Column:
    """Area of ``polys``: outer rings less holes, in square units of the layer."""
    return F.expr(f"aggregate(flatten({_ORIENTED}), 0.0D, (n, r) -> n + {_TURNED}) / 2")


def layer_stats(layer: DataFrame) -> DataFrame:
    """Features and vertices of a layer."""
    return layer.agg(F.count(F.lit(1)).alias("features"),
                     F.sum(F.size(F.flatten(F.flatten("polys")))).alias("vertices"),
                     F.sum(F.size(F.flatten("polys"))).alias("rings"))


# --- point in polygon (G2) ------------------------------------------------------------

TILE = 0.05             # side of a tile, in the layer's units
WIDE = 6                # log2 of the tiles in a wide tile
# share of a tile by which the grid is shifted, so that the round coordinates of
# vertices and points do not lie on its lines
_SHIFT = 0.3819660112501051

_PIECES = "array<struct<level:int,at:bigint>>"
_SEGMENTS = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _grid(tile: float) -> tuple[str, str]:
    """Side of a tile and origin of the grid (both axes)."""
    return _d(tile), _d(tile * _SHIFT)


def tile_index(layer: DataFrame, poly_id: str, tile: float = TILE, wide: int = WIDE) -> DataFrame:
    """Two-level grid over a layer: (poly_id, level, band, at, corner, segs).

    A tile (band, at) that a ring touches is an *edge* tile: it holds the
    segments that touch it and the polygon's parity (inside = 1) at its lower
    right corner.  Tiles no ring touches are all inside or all outside; those
    inside come as runs between edge tiles, cut into whole wide tiles (level
    ``wide``) and the single tiles left over at their ends (level 0), without
    segments.  Everything is grouped by (polygon, band): one shuffle, and no group
    larger than one polygon's segments in one band.
    """
    t, o = _grid(tile)
    key, low, high, bottom = f"`{poly_id}`", "least(y1, y2)", "greatest(y1, y2)", f"({o} + band * {t})"
    e = edges(layer, poly_id).selectExpr(
        "*", f"explode(sequence(floor(({low} - {o}) / {t}), floor(({high} - {o}) / {t}))) AS band")
    e = e.selectExpr(
        "*", f"CASE WHEN y1 = y2 THEN x1 ELSE {_x_at(f'greatest({low}, {bottom})')} END AS xa",
        f"CASE WHEN y1 = y2 THEN x2 ELSE {_x_at(f'least({high}, {bottom} + {t})')} END AS xz",
        f"CASE WHEN {_crosses(bottom)} THEN {_x_at(bottom)} END AS c")
    # a hair wider, so that rounding leaves out no tile a segment touches
    e = e.selectExpr(key, "band", "x1", "y1", "x2", "y2", "c", f"floor((least(xa, xz) - {o}) / {t} - 1e-7D) AS first",
                     f"floor((greatest(xa, xz) - {o}) / {t} + 1e-7D) AS last").repartition(poly_id, "band")
    rows = e.groupBy(poly_id, "band").agg(F.expr("collect_list(c) AS crossings"))
    touched = (e.selectExpr(key, "band", "x1", "y1", "x2", "y2", "explode(sequence(first, last)) AS at")
                .groupBy(poly_id, "band", "at").agg(F.expr("collect_list(struct(x1, y1, x2, y2)) AS segs")))
    parity = lambda x: f"(size(filter(crossings, c -> c >= {x})) % 2)"
    edge = touched.join(rows, [poly_id, "band"]).selectExpr(
        key, "0 AS level", "band", "at", f"{parity(f'{o} + (at + 1) * {t}')} AS corner", "segs")

    runs = touched.groupBy(poly_id, "band").agg(F.expr("sort_array(collect_list(at)) AS ts")).join(rows, [poly_id, "band"])
    gaps = ("filter(transform(ts, (t, k) -> named_struct('a', t + 1, 'z', get(ts, k + 1) - 1)), "
            f"g -> g.a <= g.z AND {parity(f'{o} + (g.a + 0.5D) * {t}')} = 1)")
    runs = runs.selectExpr(key, "band", f"inline({gaps})").selectExpr(
        "*", f"shiftright(a + {(1 << wide) - 1}, {wide}) AS wa", f"shiftright(z + 1, {wide}) - 1 AS wz")

    def span(level: int, lo: str, hi: str) -> str:
        return (f"CASE WHEN {lo} <= {hi} THEN transform(sequence({lo}, {hi}), t -> named_struct('level', {level}, 'at', t)) "
                f"ELSE cast(array() AS {_PIECES}) END")
    # with no whole wide tile inside, the run is one stretch of single tiles
    pieces = (f"CASE WHEN wa > wz THEN {span(0, 'a', 'z')} ELSE concat({span(wide, 'wa', 'wz')}, "
              f"{span(0, 'a', f'(shiftleft(wa, {wide}) - 1)')}, {span(0, f'shiftleft(wz + 1, {wide})', 'z')}) END")
    inner = runs.selectExpr(key, "band", f"inline({pieces})").selectExpr(
        key, "level", "band", "at", "1 AS corner", f"cast(array() AS {_SEGMENTS}) AS segs")
    return edge.unionByName(inner)


def tile_matches(points: DataFrame, x: str, y: str, index: DataFrame, tile: float = TILE, wide: int = WIDE) -> DataFrame:
    """Each point with the index rows of its tile: an equi-join on (level, band,
    at).  A point meets one row of each polygon that has its tile, at most."""
    t, o = _grid(tile)
    place = f"floor((`{x}` - {o}) / {t})"
    p = points.where(f"`{x}` is not null and `{y}` is not null").selectExpr(
        "*", f"floor((`{y}` - {o}) / {t}) AS band",
        f"inline(array(named_struct('level', 0, 'at', {place}), named_struct('level', {wide}, 'at', shiftright({place}, {wide}))))")
    return p.join(index, ["level", "band", "at"])


def _inside_tile(px: str, py: str, tile: float) -> str:
    """Even-odd test of a point against the segments of its tile.

    The ray from the point to the right is followed to the tile's right side;
    beyond it the parity is that of the tile's lower right corner, changed by
    every segment that the side crosses between the corner and the ray.  Both parts
    use the same crossing formula as a ray over all segments, so they agree with it.
    """
    t, o = _grid(tile)
    right, bottom = f"({o} + (at + 1) * {t})", f"({o} + band * {t})"
    lo, hi = f"greatest(least(s.y1, s.y2), {bottom})", f"least(greatest(s.y1, s.y2), {py})"
    here = f"{_crosses(py, 's.')} AND {px} < {_x_at(py, 's.')} AND {_x_at(py, 's.')} < {right}"
    side = f"{lo} < {hi} AND ({_x_at(lo, 's.')} >= {right}) <> ({_x_at(hi, 's.')} >= {right})"
    flat = f"s.y1 > {bottom} AND s.y1 <= {py} AND (s.x1 >= {right}) <> (s.x2 >= {right})"
    changes = (f"CASE WHEN s.y1 = s.y2 THEN CASE WHEN {flat} THEN 1 ELSE 0 END "
               f"ELSE CASE WHEN {here} THEN 1 ELSE 0 END + CASE WHEN {side} THEN 1 ELSE 0 END END")
    return f"aggregate(segs, corner, (n, s) -> n + {changes}) % 2 = 1"


def point_in_polygon(points: DataFrame, point_id: str, x: str, y: str,
                     layer: DataFrame, poly_id: str, tile: float = TILE) -> DataFrame:
    """(point_id, poly_id) for every point inside (even-odd rule) a polygon.

    Points meet the tile index of the layer: a tile wholly inside needs no
    segment, an edge tile only its own.  One shuffle of the points, no grouping
    afterwards; a tile that many points share is a skewed side AQE can split.
    """
    p = points.select(F.col(point_id).alias("__pid"), F.col(x).alias("__px"), F.col(y).alias("__py"))
    met = tile_matches(p, "__px", "__py", tile_index(layer, poly_id, tile), tile)
    return met.where(_inside_tile("__px", "__py", tile)).select(F.col("__pid").alias(point_id), poly_id)


def first_match_join(points: DataFrame, point_id: str, x: str, y: str, layer: DataFrame,
                     poly_id: str, attrs: list[str], tile: float = TILE) -> DataFrame:
    """Left spatial join keeping one polygon per point (lowest polygon id),
    as the reference's chained ``st_join`` followed by a keep-first dedup."""
    pairs = point_in_polygon(points, point_id, x, y, layer, poly_id, tile)
    first = pairs.groupBy(point_id).agg(F.min(poly_id).alias(poly_id))
    first = join_ns(first, layer.select(poly_id, *attrs), [poly_id], "left").drop(poly_id)
    return join_ns(points, first, [point_id], "left")


# --- grid rows as spans (G3) --------------------------------------------------------------

BLOCK = 6               # log2 of the cells in a block of a grid row


def row_spans(layer: DataFrame, poly_id: str, x0: float, y0: float, cell: float) -> DataFrame:
    """(poly_id, j, i0, i1): runs of grid cells whose centre lies inside the polygon.

    Cell (i, j) has its centre at (x0 + (i + .5) * cell, y0 + (j + .5) * cell).
    Per polygon and grid row the crossing x values are sorted; consecutive
    pairs bound the covered centres (the same even-odd rule as
    ``point_in_polygon``).  The spans of one polygon and row are disjoint.
    """
    key, c, x_0, y_0 = f"`{poly_id}`", _d(cell), _d(x0), _d(y0)
    yc = f"({y_0} + (j + 0.5D) * {c})"
    e = edges(layer, poly_id).where("y1 <> y2").selectExpr(
        "*", f"explode(sequence(ceil((least(y1, y2) - {y_0}) / {c} - 0.5D) - 1, "
             f"floor((greatest(y1, y2) - {y_0}) / {c} - 0.5D) + 1)) AS j").where(_crosses(yc))
    xs = e.selectExpr(key, "j", f"{_x_at(yc)} AS x").groupBy(poly_id, "j").agg(F.expr("array_sort(collect_list(x)) AS xs"))
    pairs = xs.selectExpr(key, "j", "inline(transform(sequence(0, cast(size(xs) / 2 AS int) - 1), "
                                    "k -> named_struct('a', xs[k * 2], 'b', xs[k * 2 + 1])))")

    def first(x: str) -> str:
        """The first cell whose centre is at or after x: the division may round
        to a neighbour, the centres themselves decide."""
        near = f"ceil(({x} - {x_0}) / {c} - 0.5D)"
        centre = lambda i: f"{x_0} + ({i} + 0.5D) * {c}"
        return f"CASE WHEN {centre(f'({near} - 1)')} >= {x} THEN {near} - 1 WHEN {centre(near)} >= {x} THEN {near} ELSE {near} + 1 END"
    return pairs.selectExpr(key, "j", f"{first('a')} AS i0", f"{first('b')} - 1 AS i1").where("i0 <= i1")


def in_blocks(spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """The spans cut at the blocks of their row, with the block's number (``blk``)."""
    rest = [f"`{c}`" for c in spans.columns if c not in ("i0", "i1")]
    cut = spans.selectExpr("*", f"explode(sequence(shiftright(i0, {block}), shiftright(i1, {block}))) AS blk")
    return cut.selectExpr(*rest, f"greatest(i0, shiftleft(blk, {block})) AS i0",
                          f"least(i1, shiftleft(blk + 1, {block}) - 1) AS i1", "blk")


def rasterize(layer: DataFrame, poly_id: str, x0: float, y0: float, cell: float) -> DataFrame:
    """(poly_id, i, j) for every grid cell whose centre lies inside the polygon."""
    return row_spans(layer, poly_id, x0, y0, cell).select(poly_id, F.explode(F.sequence("i0", "i1")).alias("i"), "j")


def shared_cells(child: DataFrame, parent: DataFrame, child_id: str, parent_id: str, block: int = BLOCK) -> DataFrame:
    """(child_id, parent, cells): grid cells that spans of both layers cover.

    An overlap join by span arithmetic: spans are cut at fixed blocks of their
    grid row, so two that overlap meet by equality of (row, block); the length
    of the common part is added up.  No row is made per cell.
    """
    a, b = in_blocks(child, block).alias("a"), in_blocks(parent, block).alias("b")
    common = F.least("a.i1", "b.i1") - F.greatest("a.i0", "b.i0") + 1
    met = a.join(b, (F.col("a.j") == F.col("b.j")) & (F.col("a.blk") == F.col("b.blk")))
    return met.select(F.col(f"a.{child_id}").alias(child_id), F.col(f"b.{parent_id}").alias("parent"), common.alias("n")) \
              .where("n > 0").groupBy(child_id, "parent").agg(F.sum("n").alias("cells"))


def best_parent(child: DataFrame, parent: DataFrame, child_id: str = "pid",
                parent_id: str = "pid") -> DataFrame:
    """(child_id, parent): the parent sharing most cells with each child (ties:
    lowest parent id).  Span tables come from ``row_spans`` on one grid."""
    shared = shared_cells(child, parent, child_id, parent_id)
    best = keep_first(shared, [child_id], order=["cells", "parent"], desc=("cells",))
    return best.drop("cells")


def largest_overlap(child: DataFrame, child_id: str, parent: DataFrame, parent_id: str,
                    x0: float, y0: float, cell: float, parent_attrs: list[str] = ()) -> DataFrame:
    """``st_join(child, parent, largest = TRUE)`` approximated on a grid:
    the parent sharing most cell centres with the child (ties: lowest parent
    id); children without any shared cell keep NULL parent attributes."""
    best = best_parent(row_spans(child, child_id, x0, y0, cell), row_spans(parent, parent_id, x0, y0, cell),
                       child_id, parent_id).withColumnRenamed("parent", parent_id)
    attrs = parent.select(parent_id, *parent_attrs)
    return join_ns(child.drop("polys"), join_ns(best, attrs, [parent_id], "left"), [child_id], "left")


# --- exact coverage of grid cells (G5) -------------------------------------------------------

def coverage_spans(layer: DataFrame, poly_id: str, x0: float, y0: float, cell: float) -> DataFrame:
    """(poly_id, j, i0, i1, frac): the exact share of grid cells that a polygon covers.

    Signed areas are accumulated along each grid row.  A ring segment is cut at
    the grid's lines; each piece changes the coverage of all cells right of it
    by its height, and that of its own cell by its height times the part of the
    cell right of it.  The running sum over the cells that segments touch gives
    their shares; between two of them the share is constant, so inner cells stay
    one span.  Rows: the touched cells and the spans between them.
    """
    key, c = f"`{poly_id}`", _d(cell)
    clamp = lambda x, lo: f"least(greatest({x}, {lo}), {lo} + 1)"
    e = edges(layer.select(poly_id, oriented().alias("polys")), poly_id).selectExpr(
        key, *[f"({v} - {_d(o)}) / {c} AS {n}" for v, n, o in
               (("x1", "u1", x0), ("y1", "v1", y0), ("x2", "u2", x0), ("y2", "v2", y0))]).where("v1 <> v2")
    e = e.selectExpr("*", "explode(sequence(floor(least(v1, v2)), floor(greatest(v1, v2)))) AS j")
    e = e.selectExpr("*", f"{clamp('v1', 'double(j)')} AS va", f"{clamp('v2', 'double(j)')} AS vb").where("va <> vb")
    e = e.selectExpr(key, "j", "vb - va AS dv", *[f"u1 + (u2 - u1) * ({v} - v1) / (v2 - v1) AS {u}"
                                                  for v, u in (("va", "ua"), ("vb", "ub"))])
    e = e.selectExpr("*", "explode(sequence(floor(least(ua, ub)), floor(greatest(ua, ub)))) AS i")
    e = e.selectExpr("*", f"{clamp('ua', 'double(i)')} AS ca", f"{clamp('ub', 'double(i)')} AS cb")
    e = e.selectExpr(key, "j", "i", "CASE WHEN ua = ub THEN -dv ELSE -dv * (cb - ca) / (ub - ua) END AS h",
                     "1 - ((ca + cb) / 2 - i) AS w")
    cells = e.groupBy(poly_id, "j", "i").agg(F.expr("sum(h) AS h"), F.expr("sum(h * w) AS a"))
    # one polygon's touched cells in one grid row
    along = f"OVER (PARTITION BY {key}, j ORDER BY i"
    run = cells.selectExpr(
        "*", f"coalesce(sum(h) {along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0D) AS before",
        f"lead(i) {along}) AS next")
    return run.selectExpr(key, "j", "inline(array(named_struct('i0', i, 'i1', i, 'frac', round(before + a, 12)), "
                                    "named_struct('i0', i + 1, 'i1', next - 1, 'frac', round(before + h, 12))))") \
              .where("i0 <= i1 and frac > 0")


def cover_cells(cells: DataFrame, spans: DataFrame, keys: list[str], block: int = 4) -> DataFrame:
    """The cells (with i, j) joined to the polygons (``keys``) that cover them, with the covered share ``frac``.

    The spans of a polygon in a block of a grid row are one row: a cell
    meets one row of each polygon near it, by equality of (row, block).
    """
    blocks = in_blocks(spans, block).groupBy(*keys, "j", "blk").agg(F.expr("collect_list(struct(i0, i1, frac)) AS spans"))
    met = cells.selectExpr("*", f"shiftright(i, {block}) AS blk").join(blocks, ["j", "blk"])
    return met.selectExpr("*", "get(filter(spans, s -> s.i0 <= i AND i <= s.i1), 0).frac AS frac") \
              .where("frac is not null").drop("spans", "blk")


def cell_index(cells: DataFrame, x: str, y: str, x0: float, y0: float, cell: float) -> DataFrame:
    return cells.withColumns({"i": F.floor((F.col(x) - x0) / cell),
                              "j": F.floor((F.col(y) - y0) / cell)})


# --- reprojection (G4) ----------------------------------------------------------------

# GRS80 ellipsoid and the projections used by the layers
# (Wisconsin Transverse Mercator, EPSG:3071; CONUS Albers, EPSG:5070).
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
WTM = {"lon0": -90.0, "k0": 0.9996, "fe": 520000.0, "fn": -4480000.0}
ALBERS = {"lat1": 29.5, "lat2": 45.5, "lat0": 23.0, "lon0": -96.0, "fe": 0.0, "fn": 0.0}

_E2 = GRS80_F * (2 - GRS80_F)
_EP2 = _E2 / (1 - _E2)


def _tm_terms(lon: str, lat: str, p: dict) -> dict[str, str]:
    """The quantities the Transverse Mercator series is made of."""
    e2, e4, e6 = _E2, _E2 ** 2, _E2 ** 3
    phi = f"radians({lat})"
    arc = " ".join(f"{_d(k)} * {f}" for k, f in (
        (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256, f"{phi} -"), (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024, f"sin(2 * {phi}) +"),
        (15 * e4 / 256 + 45 * e6 / 1024, f"sin(4 * {phi}) -"), (35 * e6 / 3072, f"sin(6 * {phi})")))
    return {"n": f"{_d(GRS80_A)} / sqrt(1 - {_d(_E2)} * pow(sin({phi}), 2))", "tan": f"tan({phi})", "t": f"pow(tan({phi}), 2)",
            "c": f"{_d(_EP2)} * pow(cos({phi}), 2)", "a": f"radians({lon} - {_d(p['lon0'])}) * cos({phi})",
            "m": f"{_d(GRS80_A)} * ({arc})"}


def _tm_sum(q: dict, p: dict) -> tuple[str, str]:
    n, tan, t, c, a, m = (f"({q[k]})" for k in ("n", "tan", "t", "c", "a", "m"))
    k0, ep2 = _d(p["k0"]), _d(_EP2)
    x = (f"{k0} * {n} * ({a} + (1 - {t} + {c}) * pow({a}, 3) / 6 "
         f"+ (5 - 18 * {t} + pow({t}, 2) + 72 * {c} - 58 * {ep2}) * pow({a}, 5) / 120) + {_d(p['fe'])}")
    y = (f"{k0} * ({m} + {n} * {tan} * (pow({a}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * pow({c}, 2)) * pow({a}, 4) / 24 "
         f"+ (61 - 58 * {t} + pow({t}, 2) + 600 * {c} - 330 * {ep2}) * pow({a}, 6) / 720)) + {_d(p['fn'])}")
    return x, y


def tm_forward(lon: str, lat: str, p: dict = WTM) -> tuple[Column, Column]:
    """Transverse Mercator (series to 6th order) of two columns, degrees -> metres."""
    x, y = _tm_sum(_tm_terms(lon, lat, p), p)
    return F.expr(x), F.expr(y)


def tm_inverse(x: Column, y: Column, p: dict = WTM) -> tuple[Column, Column]:
    """Inverse Transverse Mercator, metres -> degrees (footpoint latitude)."""
    k0 = p["k0"]
    m = (y - p["fn"]) / k0
    mu = m / (GRS80_A * (1 - _E2 / 4 - 3 * _E2 ** 2 / 64 - 5 * _E2 ** 3 / 256))
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    phi1 = (mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * F.sin(2 * mu)
            + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * F.sin(4 * mu)
            + (151 * e1 ** 3 / 96) * F.sin(6 * mu) + (1097 * e1 ** 4 / 512) * F.sin(8 * mu))
    c1 = _EP2 * F.cos(phi1) ** 2
    t1 = F.tan(phi1) ** 2
    n1 = GRS80_A / F.sqrt(1 - _E2 * F.sin(phi1) ** 2)
    r1 = GRS80_A * (1 - _E2) / (1 - _E2 * F.sin(phi1) ** 2) ** 1.5
    d = (x - p["fe"]) / (n1 * k0)
    lat = phi1 - (n1 * F.tan(phi1) / r1) * (
        d ** 2 / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 ** 2 - 9 * _EP2) * d ** 4 / 24
        + (61 + 90 * t1 + 298 * c1 + 45 * t1 ** 2 - 252 * _EP2 - 3 * c1 ** 2) * d ** 6 / 720)
    lon = (d - (1 + 2 * t1 + c1) * d ** 3 / 6
           + (5 - 2 * c1 + 28 * t1 - 3 * c1 ** 2 + 8 * _EP2 + 24 * t1 ** 2) * d ** 5 / 120
           ) / F.cos(phi1)
    return F.degrees(lon) + p["lon0"], F.degrees(lat)


def _albers_q(phi: float) -> float:
    e, s = math.sqrt(_E2), math.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - (1 / (2 * e)) * math.log((1 - e * s) / (1 + e * s)))


def _albers_terms(lon: str, lat: str, p: dict) -> dict[str, str]:
    """Radius and angle of the conic, and the radius of the origin."""
    p1, p2, p0 = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    m1 = math.cos(p1) / math.sqrt(1 - _E2 * math.sin(p1) ** 2)
    m2 = math.cos(p2) / math.sqrt(1 - _E2 * math.sin(p2) ** 2)
    q1, q2, q0 = _albers_q(p1), _albers_q(p2), _albers_q(p0)
    n = (m1 ** 2 - m2 ** 2) / (q2 - q1)
    c = m1 ** 2 + n * q1
    e, s = math.sqrt(_E2), f"sin(radians({lat}))"
    q = (f"{_d(1 - _E2)} * ({s} / (1 - {_d(_E2)} * {s} * {s}) "
         f"- {_d(1 / (2 * e))} * ln((1 - {_d(e)} * {s}) / (1 + {_d(e)} * {s})))")
    return {"rho": f"{_d(GRS80_A)} * sqrt({_d(c)} - {_d(n)} * {q}) / {_d(n)}", "theta": f"{_d(n)} * radians({lon} - {_d(p['lon0'])})",
            "rho0": _d(GRS80_A * math.sqrt(c - n * q0) / n)}


def _albers_sum(q: dict, p: dict) -> tuple[str, str]:
    return (f"{_d(p['fe'])} + ({q['rho']}) * sin({q['theta']})",
            f"{_d(p['fn'])} + {q['rho0']} - ({q['rho']}) * cos({q['theta']})")


def albers_forward(lon: str, lat: str, p: dict = ALBERS) -> tuple[Column, Column]:
    """Albers equal-area conic (ellipsoidal) of two columns, degrees -> metres."""
    x, y = _albers_sum(_albers_terms(lon, lat, p), p)
    return F.expr(x), F.expr(y)


_TERMS = {tm_forward: (_tm_terms, _tm_sum, WTM), albers_forward: (_albers_terms, _albers_sum, ALBERS)}


def project(layer: DataFrame, fn=tm_forward) -> DataFrame:
    """A lon/lat layer in metres (Wisconsin Transverse Mercator unless told otherwise).

    Each vertex's terms are worked out once, in a pass of their own: an expression
    inside an array function is not shared, so a formula that uses a term several
    times would compute it as often."""
    terms, total, p = _TERMS[fn]
    names = terms("get(v, 0)", "get(v, 1)", p)
    parts = ", ".join(f"'{k}', {e}" for k, e in names.items())
    x, y = total({k: f"q.{k}" for k in names}, p)
    polys = (f"transform(polys, part -> transform(part, ring -> transform("
             f"transform(ring, v -> named_struct({parts})), q -> array({x}, {y}))))")
    return layer.withColumn("polys", F.expr(polys))
