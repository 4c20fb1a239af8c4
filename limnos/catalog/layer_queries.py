"""Registered queries on polygon layers: files, display copies, cell tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.catalog import standins as S
from limnos.catalog.queries import LC_GRID, _layer, _layers, portable
from limnos.catalog.tables import spark_sql
from limnos.operators.spatial import planar_area
from limnos.plans import watersheds as W
from limnos.sources import geo as G
from limnos.sources import sinks as SK

FEATURES_PER_FILE = 400


def _measures(layer: DataFrame, name: str, *keep: str) -> DataFrame:
    """Counts and sums over the vertices of each polygon, without the closing ones."""
    rings = F.transform(F.flatten("polys"), lambda r: F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))))
    v = F.flatten(rings)
    total = lambda axis: F.round(F.aggregate(v, F.lit(0.0), lambda n, p: n + p[axis]), 6)
    return layer.select(F.lit(name).alias("layer"), *keep, F.size(F.flatten("polys")).alias("rings"), F.size(v).alias("vertices"),
                        total(0).alias("sum_x"), total(1).alias("sum_y"), F.round(planar_area(), 6).alias("area"))


def _basins(spark: SparkSession, sf: str) -> DataFrame:
    return _layer(spark, sf, S.BASIN_VERTICES, S.BASIN_ATTRS)


def _lakes(spark: SparkSession, sf: str) -> DataFrame:
    return _layer(spark, sf, S.LAKE_VERTICES, S.LAKE_ATTRS)


def layers_geojson_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Layers written as FeatureCollections and read back by byte
    ranges; holes, several parts and texts that need escaping included."""
    parts = []
    for name, layer, column in (("counties", _layers(spark, sf)["counties"], "CountyName"),
                                ("dnr_watersheds", _layers(spark, sf)["dnr_watersheds"], "DnrWatershedName"),
                                ("lakes", _lakes(spark, sf), "LakeName")):
        path = G.write_geojson(layer, SK.scratch_path(spark, name), ["pid", column], FEATURES_PER_FILE)
        props = T.StructType([T.StructField("pid", T.LongType()), T.StructField(column, T.StringType())])
        back = G.read_geojson(spark, path, props).withColumnsRenamed({"Pid": "pid", column: "name"})
        parts.append(_measures(back, name, "pid", "name"))
    return reduce(DataFrame.unionByName, parts)


def dnr_watershed_layer(spark: SparkSession, sf: str) -> DataFrame:
    """DNR watersheds from a file with the source's property names."""
    basins = _basins(spark, sf)
    names = [c for c in basins.columns if c not in ("pid", "polys")]
    path = G.write_geojson(basins, SK.scratch_path(spark, "dnr"), names, FEATURES_PER_FILE)
    props = T.StructType([T.StructField(c, basins.schema[c].dataType) for c in names])
    layer = W.dnr_layer(G.read_geojson(spark, path, props))
    return portable(layer.withColumn("vertices", F.size(F.flatten(F.flatten("polys")))).drop("polys"),
                    round_cols=("SizeAcres", "SizeSqMiles"))


def display_layers_export(spark: SparkSession, sf: str) -> DataFrame:
    """Display layers (thinned with their shared borders; the largest lakes as
    they are) exported to two folders, all copies read back."""
    layers = {"dnr_watersheds": W.display_layer(_basins(spark, sf).select("pid", "polys"), "dnr_watersheds"),
              "waterbodies": W.major_lakes(_lakes(spark, sf), 50).select("pid", "polys")}
    base = SK.scratch_path(spark, "display")
    parts = []
    for k, path in enumerate(W.export_layers(layers, [f"{base}/a", f"{base}/b"])):
        back = G.read_geojson(spark, path, T.StructType([T.StructField("pid", T.LongType())]))
        name = list(layers)[k // 2]
        parts.append(_measures(back.withColumnRenamed("Pid", "pid"), name, "pid").drop("area").withColumn("copy", F.lit(k % 2)))
    return reduce(DataFrame.unionByName, parts)


CELL_BOUNDS = (400_000.0, 2_200_000.0, 700_000.0, 2_500_000.0)
CELL_STRIP = 50_000.0


def landcover_cells_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Land-cover cells written in strips, those of a region read back."""
    path = G.write_cells(spark_sql(spark, sf, S.LANDCOVER_CELLS), SK.scratch_path(spark, "cells"), CELL_STRIP)
    cells = G.read_cells(spark, path, CELL_BOUNDS, CELL_STRIP)
    x0, y0, side = LC_GRID
    return cells.groupBy("class").agg(F.count("*").alias("n"), F.sum("cell_area").alias("area"),
                                      F.min(F.floor((F.col("x") - x0) / side)).alias("i0"),
                                      F.max(F.floor((F.col("y") - y0) / side)).alias("j1"))


def nke_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Plans with an id, their texts as sentences, and their dates."""
    return portable(W.nke_data(spark_sql(spark, sf, S.NKE_PLANS)))
