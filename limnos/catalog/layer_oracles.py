"""DuckDB oracles of the layer queries."""

from __future__ import annotations

from limnos.catalog import duck as D
from limnos.catalog import standins as S
from limnos.catalog.oracles import _cte2, _dbl
from limnos.catalog.tables import duck_sql


def _ring_rows(p: str, v: str) -> dict[str, str]:
    """{p}_r: a row per ring with its vertices (without the closing one) and signed area."""
    return {
        f"{p}_l": f"SELECT pid, part, ring, max(i) AS last FROM {v} GROUP BY pid, part, ring",
        f"{p}_s": f"SELECT a.pid, a.part, a.ring, sum(a.x * b.y - b.x * a.y) / 2 AS turned FROM {v} a JOIN {v} b "
                  "ON a.pid = b.pid AND a.part = b.part AND a.ring = b.ring AND b.i = a.i + 1 GROUP BY ALL",
        f"{p}_r": f"SELECT pid, part, ring, list(struct_pack(x := x, y := y) ORDER BY i) AS vs, any_value(turned) AS turned "
                  f"FROM {v} JOIN {p}_l USING (pid, part, ring) JOIN {p}_s USING (pid, part, ring) "
                  "WHERE i < last GROUP BY pid, part, ring",
    }


_MEASURES = """CAST(count(*) AS INT) AS rings, CAST(sum(len(vs)) AS INT) AS vertices,
       round(sum(list_sum(list_transform(vs, lambda p: p.x))), 6) AS sum_x,
       round(sum(list_sum(list_transform(vs, lambda p: p.y))), 6) AS sum_y,
       round(sum(CASE WHEN ring = 0 THEN abs(turned) ELSE -abs(turned) END), 6) AS area"""


def _layer_rows(name: str, p: str, attrs: str, column: str) -> str:
    return (f"SELECT '{name}' AS layer, r.pid, any_value(a.{column}) AS name, {_MEASURES} "
            f"FROM {p}_r r JOIN {attrs} a ON a.pid = r.pid GROUP BY r.pid")


LAYERS_GEOJSON_ROUNDTRIP = _cte2({
    "vc": S.COUNTY_VERTICES, "vd": S.REGION_VERTICES, "vl": S.LAKE_VERTICES,
    "ac": S.COUNTY_ATTRS, "ad": S.DNR_ATTRS, "al": S.LAKE_ATTRS,
    **_ring_rows("c", "vc"), **_ring_rows("d", "vd"), **_ring_rows("l", "vl"),
}) + "\n" + "\nUNION ALL\n".join([
    _layer_rows("counties", "c", "ac", "CountyName"), _layer_rows("dnr_watersheds", "d", "ad", "DnrWatershedName"),
    _layer_rows("lakes", "l", "al", "LakeName")])

DNR_WATERSHED_LAYER = _cte2({"ab": S.BASIN_ATTRS, "vb": S.BASIN_VERTICES}) + """
SELECT WSHED_CODE AS "DnrWatershedCode", WSHED_NAME AS "DnrWatershedName",
       round(WATERSHED_SIZE_ACRES_AMT, 6) AS "SizeAcres", round(WATERSHED_SIZE_SQ_MILES_AMT, 6) AS "SizeSqMiles",
       TOTAL_LAKE_ACRES_AMT AS "TotalLakeAcres", TOTAL_WETLAND_ACRES_AMT AS "TotalWetlandAcres",
       CAST(n AS INT) AS vertices
FROM ab JOIN (SELECT pid, count(*) AS n FROM vb GROUP BY pid) USING (pid)"""


def thinned(p: str, v: str, keep: float) -> dict[str, str]:
    """{p}_x: a row per ring of the layer with its vertices after thinning: arcs
    between junctions, each thinned by repeated removal of the least triangle
    (a recursive query), those of the largest effective areas kept."""
    area = ("abs((pts[k].x - pts[k - 1].x) * (pts[k + 1].y - pts[k - 1].y) "
            "- (pts[k + 1].x - pts[k - 1].x) * (pts[k].y - pts[k - 1].y)) / 2")
    areas = f"list_transform(range(2, len(pts)), lambda k: {area})"
    return {
        **_ring_rows(p, v),
        f"{p}_e": f"SELECT pid, part, ring, k, vs[k] AS a, vs[(k % len(vs)) + 1] AS b "
                  f"FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS k FROM {p}_r)",
        f"{p}_n": f"SELECT DISTINCT a, b FROM (SELECT a, b FROM {p}_e UNION ALL SELECT b, a FROM {p}_e)",
        f"{p}_j": f"SELECT a FROM {p}_n GROUP BY a HAVING count(*) <> 2",
        f"{p}_k": f"SELECT pid, part, ring, list(k ORDER BY k) AS cuts FROM {p}_e WHERE a IN (SELECT a FROM {p}_j) GROUP BY pid, part, ring",
        f"{p}_c": f"SELECT r.*, coalesce(cuts, [list_position(vs, list_min(vs))]) AS cuts FROM {p}_r r "
                  f"LEFT JOIN {p}_k USING (pid, part, ring)",
        f"{p}_u": f"SELECT *, unnest(range(1, len(cuts) + 1)) AS q FROM {p}_c",
        f"{p}_a": "SELECT pid, part, ring, q, len(cuts) AS n_arcs, "
                  "list_concat(vs, vs)[cuts[q]:CASE WHEN q < len(cuts) THEN cuts[q + 1] ELSE cuts[1] + len(vs) END] AS line "
                  f"FROM {p}_u",
        f"{p}_o": f"SELECT *, CASE WHEN list_reverse(line) < line THEN list_reverse(line) ELSE line END AS arc FROM {p}_a",
        f"{p}_d": f"SELECT arc, max(greatest(3 - n_arcs, 0)) AS need, row_number() OVER (ORDER BY arc) AS id FROM {p}_o GROUP BY arc",
        f"{p}_w": f"SELECT id, arc AS pts, CAST(NULL AS STRUCT(x DOUBLE, y DOUBLE)) AS gone, CAST(0 AS BIGINT) AS place, "
                  f"CAST(0.0 AS DOUBLE) AS w, range(1, len(arc) + 1) AS places FROM {p}_d\n"
                  "UNION ALL\n"
                  "SELECT id, list_concat(pts[:m], pts[m + 2:]), pts[m + 1], places[m + 1], greatest(w, areas[m]), "
                  "list_concat(places[:m], places[m + 2:]) "
                  "FROM (SELECT *, list_position(areas, list_min(areas)) AS m FROM "
                  f"(SELECT *, {areas} AS areas FROM {p}_w WHERE len(pts) > 2))",
        f"{p}_g": f"SELECT id, place, gone, w, row_number() OVER (PARTITION BY id ORDER BY w DESC, place) AS rank "
                  f"FROM {p}_w WHERE gone IS NOT NULL",
        f"{p}_t": f"SELECT coalesce((SELECT w FROM {p}_g ORDER BY w DESC LIMIT 1 OFFSET "
                  f"(SELECT greatest(CAST(round_even(count(*) * {_dbl(keep)}, 0) AS BIGINT), 1) - 1 FROM {p}_g)), 0) AS least",
        f"{p}_h": f"SELECT id, list(gone) AS inner_vs FROM {p}_g JOIN {p}_d USING (id), {p}_t "
                  "WHERE w >= least OR rank <= need GROUP BY id",
        # the vertices of a ring, in no particular order: the start of each arc and what stays of it
        f"{p}_y": f"SELECT o.pid, o.part, o.ring, list_concat([line[1]], coalesce(inner_vs, [])) AS vs "
                  f"FROM {p}_o o JOIN {p}_d d ON o.arc = d.arc LEFT JOIN {p}_h h ON h.id = d.id",
        f"{p}_x": f"SELECT pid, part, ring, flatten(list(vs)) AS vs FROM {p}_y GROUP BY pid, part, ring",
    }


def _recursive(parts: dict[str, str]) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({duck_sql(v)})" for k, v in parts.items())


_PLACED = """CAST(count(*) AS INT) AS rings, CAST(sum(len(vs)) AS INT) AS vertices,
       round(sum(list_sum(list_transform(vs, lambda p: p.x))), 6) AS sum_x,
       round(sum(list_sum(list_transform(vs, lambda p: p.y))), 6) AS sum_y"""

DISPLAY_LAYERS_EXPORT = _recursive({
    "vb": S.BASIN_VERTICES, "vl": S.LAKE_VERTICES, **thinned("b", "vb", 0.15), **_ring_rows("l", "vl"),
}) + f""",
big AS (SELECT pid, sum(CASE WHEN ring = 0 THEN abs(turned) ELSE -abs(turned) END) AS area FROM l_r GROUP BY pid),
rows AS (
  SELECT 'dnr_watersheds' AS layer, pid, {_PLACED} FROM b_x GROUP BY pid
  UNION ALL
  SELECT 'waterbodies', pid, {_PLACED} FROM l_r
  WHERE pid IN (SELECT pid FROM big WHERE area >= (SELECT min(area) FROM (SELECT area FROM big ORDER BY area DESC LIMIT 50)))
  GROUP BY pid)
SELECT layer, pid, rings, vertices, sum_x, sum_y, CAST(c AS INT) AS "copy" FROM rows, range(2) t(c)"""

_DISPLAY = {"huc6": (S.HUC6_VERTICES, None), "huc8": (S.REGION_VERTICES, 0.5), "huc10": (S.COUNTY_VERTICES, 0.5),
            "huc12": (S.HUC12_VERTICES, 0.5), "counties": (S.COUNTY_VERTICES, 0.25), "dnr_watersheds": (S.REGION_VERTICES, 0.15)}


def _display_parts() -> dict[str, str]:
    out = {}
    for k, (name, (v, keep)) in enumerate(_DISPLAY.items()):
        out[f"v{k}"] = v
        out.update(_ring_rows(f"t{k}", f"v{k}") if keep is None else thinned(f"t{k}", f"v{k}", keep))
    return out


DISPLAY_LAYER_STATS = _recursive(_display_parts()) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS layer, count(DISTINCT pid) AS features, CAST(sum(len(vs) + 1) AS BIGINT) AS vertices, "
    f"count(*) AS rings FROM t{k}_{'r' if keep is None else 'x'}" for k, (name, (_, keep)) in enumerate(_DISPLAY.items()))

LANDCOVER_CELLS_ROUNDTRIP = _cte2({"c": S.LANDCOVER_CELLS}) + """
SELECT class, count(*) AS n, CAST(sum(cell_area) AS DOUBLE) AS area,
       CAST(min(floor((x - 270000.0) / 2500.0)) AS BIGINT) AS i0, CAST(max(floor((y - 2100000.0) / 2500.0)) AS BIGINT) AS j1
FROM c WHERE x BETWEEN 400000 AND 700000 AND y BETWEEN 2200000 AND 2500000 GROUP BY class"""


def _sentence(c: str) -> str:
    return D.sentence_case(f"trim(regexp_replace({c}, '[\\r\\n]', '', 'g'))")


NKE_PLANS = _cte2({"plans": S.NKE_PLANS}) + f"""
SELECT PlanId AS "PlanId", {_sentence('PlanName')} AS nke_plan_name, {_sentence('PurposeDe')} AS nke_plan_purpose,
       {_sentence('Objective')} AS nke_plan_objective, CAST(StartDate AS VARCHAR) AS nke_start,
       CAST(EndDate AS VARCHAR) AS nke_end
FROM plans WHERE PlanId IS NOT NULL"""
