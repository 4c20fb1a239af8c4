"""Polygon layers: watershed hierarchy (T10), station attribution (T9),
plan attributes (T14), display layers (T15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import sentence_case, strip_line_breaks
from limnos.operators.joins import join_ns
from limnos.operators.groups import top_n_with_ties
from limnos.operators.spatial import TILE, best_parent, layer_stats, planar_area, point_in_polygon, project, row_spans
from limnos.operators.topology import thin
from limnos.session import materialize
from limnos.sources.geo import write_geojson

# Vertex share kept when thinning each layer for display.
KEEP_SHARE = {"counties": 0.25, "plans": 0.25, "huc8": 0.5, "huc10": 0.5, "huc12": 0.5,
              "dnr_watersheds": 0.15}

# Source column -> output column of the plan and watershed layers.
NKE_COLUMNS = {"PlanName": "nke_plan_name", "PurposeDe": "nke_plan_purpose", "Objective": "nke_plan_objective",
               "StartDate": "nke_start", "EndDate": "nke_end"}
DNR_COLUMNS = {"WshedCode": "DnrWatershedCode", "WshedName": "DnrWatershedName", "WatershedSizeAcresAmt": "SizeAcres",
               "WatershedSizeSqMilesAmt": "SizeSqMiles", "TotalLakeAcresAmt": "TotalLakeAcres",
               "TotalWetlandAcresAmt": "TotalWetlandAcres"}

STATION_OUTPUT = ["station_id", "station_name", "latitude", "longitude", "county_name",
                  "dnr_region", "wbic", "waterbody", "huc12", "sub_watershed", "huc10",
                  "watershed", "dnr_watershed_name", "dnr_watershed_code", "huc8", "sub_basin",
                  "major_basin"]


def watershed_hierarchy(huc6: DataFrame, huc8: DataFrame, huc10: DataFrame, huc12: DataFrame,
                        x0: float, y0: float, cell: float) -> dict[str, DataFrame]:
    """Each level takes the attributes of the parent it overlaps most.

    Lon/lat layers (pid, polys, attributes) are projected to metres (EPSG:3071) and
    laid on a grid of ``cell`` metres, once each: the row spans of a level are
    written and serve as child and as parent.  Overlaps are span arithmetic; the
    attributes are then carried down through small id tables, so no level's plan
    is nested in the next one's.
    """
    spans = {n: materialize(row_spans(project(l.select("pid", "polys")), "pid", x0, y0, cell)) for n, l in
             (("huc6", huc6), ("huc8", huc8), ("huc10", huc10), ("huc12", huc12))}
    link8 = best_parent(spans["huc8"], spans["huc6"])
    link10 = best_parent(spans["huc10"], spans["huc8"])
    link12 = best_parent(spans["huc12"], spans["huc10"])

    def attach(layer, link, parent_attrs):
        base = layer.drop("polys")
        with_parent = join_ns(base, link, ["pid"], "left")
        return join_ns(with_parent, parent_attrs.withColumnRenamed("pid", "parent"), ["parent"],
                       "left").drop("parent")

    h8 = attach(huc8, link8, huc6.select("pid", "MajorBasin"))
    h10 = attach(huc10, link10, h8.select("pid", "Huc8Code", "Huc8Name", "MajorBasin"))
    h12 = attach(huc12, link12, h10.select("pid", "Huc10Code", "Huc10Name", "Huc8Code",
                                           "Huc8Name", "MajorBasin"))
    return {"huc8": h8, "huc10": h10, "huc12": h12}


def attribute_stations(stations: DataFrame, counties: DataFrame, huc12: DataFrame,
                       dnr: DataFrame, tile: float = TILE) -> DataFrame:
    """T9 second half: county, sub-watershed (with its hierarchy) and DNR
    watershed of each station, first match per layer.

    The layers' tile indexes are stacked, so the stations meet all layers in one
    join; a station's lowest polygon of each layer comes from one aggregate, and
    the polygons' attributes are joined by id.
    """
    layers = [
        (counties, {"CountyName": "county_name", "DnrRegion": "dnr_region"}),
        (huc12, {"Huc12Code": "huc12", "Huc12Name": "sub_watershed", "Huc10Code": "huc10",
                 "Huc10Name": "watershed", "Huc8Code": "huc8", "Huc8Name": "sub_basin",
                 "MajorBasin": "major_basin"}),
        (dnr, {"DnrWatershedName": "dnr_watershed_name",
               "DnrWatershedCode": "dnr_watershed_code"}),
    ]
    stacked, tables = None, []
    for k, (layer, attrs) in enumerate(layers):
        if "polys" not in layer.columns:
            raise ValueError("attribute_stations: layers need a polys column")
        have = [a for a in attrs if a in layer.columns]
        tables.append(layer.select(F.col("pid").alias(f"__poly{k}"), *[F.col(a).alias(attrs[a]) for a in have]))
        one = layer.select(F.struct(F.lit(k).alias("layer"), F.col("pid").cast("string").alias("pid")).alias("__shape"), "polys")
        stacked = one if stacked is None else stacked.unionByName(one)
    pairs = point_in_polygon(stations, "station_id", "longitude", "latitude", stacked, "__shape", tile)
    kinds = [dict(layer.dtypes)["pid"] for layer, _ in layers]
    first = pairs.groupBy("station_id").agg(*[
        F.min(F.when(F.col("__shape.layer") == k, F.col("__shape.pid").cast(kind))).alias(f"__poly{k}")
        for k, kind in enumerate(kinds)])
    out = join_ns(stations, first, ["station_id"], "left")
    for k, table in enumerate(tables):
        out = join_ns(out, table, [f"__poly{k}"], "left").drop(f"__poly{k}")
    return out.select(*[c for c in STATION_OUTPUT if c in out.columns])


def plan_attributes(plans: DataFrame, text_cols: list[str]) -> DataFrame:
    """Line breaks removed, trimmed, sentence case (whole texts)."""
    return plans.withColumns({c: sentence_case(F.trim(strip_line_breaks(c))) for c in text_cols})


def nke_data(plans: DataFrame) -> DataFrame:
    """Plans with an id; names, purposes and objectives as sentences
    without line breaks, the dates as they are."""
    kept = plans.where(F.col("PlanId").isNotNull()).select("PlanId", *[F.col(a).alias(b) for a, b in NKE_COLUMNS.items()])
    texts = [f.name for f in kept.schema.fields if f.dataType.simpleString() == "string" and f.name in NKE_COLUMNS.values()]
    return plan_attributes(kept, texts)


def dnr_layer(raw: DataFrame) -> DataFrame:
    """The DNR watersheds with codes, names, sizes and lake and wetland acres."""
    return raw.select(*[F.col(a).alias(b) for a, b in DNR_COLUMNS.items()], "polys")


def major_lakes(lakes: DataFrame, n: int = 1000) -> DataFrame:
    """The n largest waterbodies by area (ties stay)."""
    return top_n_with_ties(lakes.withColumn("Area", planar_area()), "Area", n)


def display_layer(layer: DataFrame, name: str) -> DataFrame:
    """Copy of a layer for maps, thinned with its shared borders; layers
    without a share, such as the lakes, as they are."""
    return thin(layer, "pid", KEEP_SHARE[name]) if name in KEEP_SHARE else layer


def export_layers(layers: dict[str, DataFrame], targets: list[str]) -> list[str]:
    """Every layer to every target folder as ``<name>.geojson``; a layer is worked once."""
    written = []
    for name, layer in layers.items():
        once = materialize(layer, "layer")
        for target in targets:
            written.append(write_geojson(once, f"{target.rstrip('/')}/{name}.geojson", [c for c in once.columns if c != "polys"]))
    return written


def layer_summary(layers: dict[str, DataFrame]) -> DataFrame:
    """A16 for several layers: (layer, features, vertices, rings)."""
    out = None
    for name, lyr in layers.items():
        s = layer_stats(lyr).select(F.lit(name).alias("layer"), "*")
        out = s if out is None else out.unionByName(s)
    return out
