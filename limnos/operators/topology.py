"""Thinning polygon layers for display without tearing shared borders.

Borders that two polygons share are cut out once as *arcs* (chains of vertices
between junctions, the vertices with other than two neighbours in the layer), and thinned
once, so neighbours keep a common border.  Vertices go in the order of
their *effective area*: again and again the vertex whose triangle with its present
neighbours is smallest is removed.  A layer keeps the given share of its
removable vertices: those of the largest effective areas in the whole layer.

Everything but the removal order is joins, grouping and array functions; the
order inside one arc is sequential and is worked arc by arc in Arrow batches.
No group is larger than one ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.operators.ordering import nth_largest
from limnos.operators.spatial import close_ring
from limnos.session import materialize

def ring_vertices(layer: DataFrame, poly_id: str) -> DataFrame:
    """(poly_id, part, ring, pos, x, y): the vertices of each ring, without the closing one."""
    parts = layer.select(poly_id, F.posexplode("polys").alias("part", "p"))
    rings = parts.select(poly_id, "part", F.posexplode("p").alias("ring", "r")).withColumn("r", close_ring(F.col("r")))
    v = rings.select(poly_id, "part", "ring", F.posexplode(F.slice("r", F.lit(1), F.greatest(F.size("r") - 1, F.lit(0)))).alias("pos", "v"))
    return v.select(poly_id, "part", "ring", "pos", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))


def junctions(rings: DataFrame) -> DataFrame:
    """(x, y) of the vertices that have other than two neighbours in the layer.
    ``rings``: rows with an array ``vs`` of vertices (x, y)."""
    v = rings.select(F.explode(F.transform("vs", lambda p, k: F.struct(
        p["x"].alias("x"), p["y"].alias("y"),
        F.get("vs", F.pmod(k + 1, F.size("vs"))).alias("next"), F.get("vs", F.pmod(k - 1, F.size("vs"))).alias("last")))).alias("p"))
    near = v.select("p.x", "p.y", F.explode(F.array("p.next", "p.last")).alias("q")).distinct()
    return near.groupBy("x", "y").agg(F.count("*").alias("n")).where("n <> 2").select("x", "y")


def ring_arcs(layer: DataFrame, poly_id: str) -> DataFrame:
    """(poly_id, part, ring, k, n_arcs, flipped, arc): the arcs of each ring in
    order; an arc is stored in one direction for all rings that hold it."""
    vertices = ring_vertices(layer, poly_id)
    point = F.struct("x", "y")
    rings = materialize(vertices.groupBy(poly_id, "part", "ring").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", point.alias("v")))), lambda s: s["v"]).alias("vs")), "rings")
    at = rings.select(poly_id, "part", "ring", F.posexplode("vs").alias("pos", "v")).select(poly_id, "part", "ring", "pos", "v.x", "v.y")
    cuts = at.join(junctions(rings), ["x", "y"]).groupBy(poly_id, "part", "ring").agg(F.sort_array(F.collect_list("pos")).alias("cuts"))
    keys = [poly_id, "part", "ring"]
    r = rings.join(cuts, keys, "left")
    # a ring without junction is one arc, from its smallest vertex
    start = F.array_position("vs", F.array_min("vs")).cast("int") - 1
    r = r.withColumn("cuts", F.coalesce("cuts", F.array(start)))
    n = F.size("vs")
    twice = F.concat("vs", "vs")
    arcs = F.transform("cuts", lambda a, k: F.slice(
        twice, a + 1, F.coalesce(F.get("cuts", k + 1), F.get("cuts", F.lit(0)) + n) - a + 1))
    r = r.select(*keys, F.size("cuts").alias("n_arcs"), F.posexplode(arcs).alias("k", "a"))
    back = F.reverse("a")
    return r.select(*keys, "k", "n_arcs", (back < F.col("a")).alias("flipped"), F.least("a", back).alias("arc"))


def effective_areas(arcs: DataFrame) -> DataFrame:
    """``arcs`` with ``areas``: for each inner vertex of column ``arc`` its effective
    area, as the bits of a double (ordered like the doubles, which are not negative)."""
    def run(batches):
        # all it needs is inside, so executors want no copy of this package
        import heapq

        import numpy as np
        import pyarrow as pa

        def areas(x, y):
            n = len(x)
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            alive, version, found = [True] * n, [0] * n, [0.0] * n

            def triangle(k):
                a, c = left[k], right[k]
                return abs((x[k] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[k] - y[a])) / 2
            heap = [(triangle(k), k, 0) for k in range(1, n - 1)]
            heapq.heapify(heap)
            least = 0.0
            while heap:
                area, k, v = heapq.heappop(heap)
                if not alive[k] or v != version[k]:
                    continue
                # never less than that of a vertex removed before
                least = found[k] = max(least, area)
                alive[k] = False
                a, c = left[k], right[k]
                right[a], left[c] = c, a
                for m in (a, c):
                    if 0 < m < n - 1:
                        version[m] += 1
                        heapq.heappush(heap, (triangle(m), m, version[m]))
            return found[1:-1]

        for batch in batches:
            lists = batch.column("arc").to_pylist()
            out = [np.array(areas([p["x"] for p in a], [p["y"] for p in a]), np.float64).view(np.int64).tolist()
                   for a in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))],
                                             names=[*batch.schema.names, "areas"])
    schema = arcs.withColumn("areas", F.array().cast("array<bigint>")).schema
    return arcs.mapInArrow(run, schema)


def thin(layer: DataFrame, poly_id: str, keep: float) -> DataFrame:
    """The layer with thinned ``polys`` (all other columns as they are).

    ``keep``: share of the removable vertices that stay, at least; vertices whose
    effective areas tie with the last of them stay too.  Junctions stay, and each arc
    keeps so many of its largest that no ring falls below a triangle.
    Rings of fewer than three distinct vertices are left out.
    """
    arcs = materialize(ring_arcs(layer, poly_id), "arcs")
    # each border once, with the vertices it must keep for the ring with the fewest arcs
    single = arcs.groupBy("arc").agg(F.max(F.greatest(3 - F.col("n_arcs"), F.lit(0))).alias("need"))
    weighed = materialize(effective_areas(single), "weighed")
    inner = weighed.select(F.explode("areas").alias("a"))
    total = inner.count()
    limit = nth_largest(inner, "a", max(1, round(total * keep))) if total else 0
    ranked = F.sort_array(F.transform("areas", lambda a, k: F.struct((-a).alias("a"), k.alias("k"))))
    needed = F.transform(F.slice(ranked, F.lit(1), F.greatest("need", F.lit(1))), lambda s: s["k"])
    stay = F.filter("arc", lambda p, k: (k == 0) | (k == F.size("arc") - 1) | (F.get("areas", k - 1) >= F.lit(limit))
                    | ((F.col("need") > 0) & F.array_contains("needed", k - 1)))
    thinned = weighed.withColumn("needed", needed).select("arc", stay.alias("line"))
    placed = arcs.join(thinned, "arc").withColumn("line", F.when(F.col("flipped"), F.reverse("line")).otherwise(F.col("line")))
    # arcs share their ends: each gives all but its last vertex
    steps = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))),
                                  lambda s: F.slice(s["line"], F.lit(1), F.size(s["line"]) - 1)))
    rings = placed.groupBy(poly_id, "part", "ring").agg(steps.alias("vs")).where(F.size(F.array_distinct("vs")) >= 3)
    closed = F.concat("vs", F.array(F.get("vs", F.lit(0))))
    rings = rings.select(poly_id, "part", "ring", F.transform(closed, lambda p: F.array(p["x"], p["y"])).alias("r"))
    return layer.drop("polys").join(_as_polys(rings, poly_id), poly_id, "left")


def _as_polys(rings: DataFrame, poly_id: str) -> DataFrame:
    def listed(name: str, value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col(value).alias("v")))), lambda s: s["v"])
    parts = rings.groupBy(poly_id, "part").agg(listed("ring", "r").alias("p"), F.min("ring").alias("outer")).where("outer = 0")
    return parts.groupBy(poly_id).agg(listed("part", "p").alias("polys"))
