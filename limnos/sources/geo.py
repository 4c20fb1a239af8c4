"""S4 polygon layers (GeoJSON, read and written), S5 land-cover cells, vertex tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.functions.text import big_camel_name, snake_name, unique_names
from limnos.operators.spatial import POLYS, oriented
from limnos.session import materialize

_GEOMETRY = T.StructType([T.StructField("type", T.StringType()),
                          T.StructField("coordinates", T.StringType())])


def _feature_schema(properties: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("type", T.StringType()),
                         T.StructField("properties", properties),
                         T.StructField("geometry", _GEOMETRY)])


def _polys(geometry_type: str, coordinates: str):
    # coordinates stay raw JSON text in the read schema; a Polygon is wrapped
    # in one more array so Polygon and MultiPolygon share one type
    text = F.when(F.col(geometry_type) == "Polygon",
                  F.concat(F.lit("["), F.col(coordinates), F.lit("]"))).otherwise(F.col(coordinates))
    return F.from_json(text, POLYS)


# Fixed values of the format: the member that every feature, and nothing else
# in a collection, starts with
_FEATURE = '"Feature"'
_NEXT_START = r'\s*,?\s*\{\s*"type"\s*:\s*$'
TAIL = 200              # characters looked at for the start of the next feature


def _collection_features(spark: SparkSession, path: str, feature: T.StructType) -> DataFrame:
    """The features of FeatureCollections, each file read by byte ranges.

    The text is cut at the value ``"Feature"`` of every feature's ``type`` member, which
    is a record separator for Spark's text reader: a split starts at the first
    separator inside it, so one large file is read by many tasks.  A record is
    the rest of one feature and the start of the next.  Features must begin with
    their type, as writers put it; a record that does not fit, such as one cut at
    a property with the value "Feature", fails the job.
    """
    lines = spark.read.option("lineSep", _FEATURE).text(path).select("value")
    rest = lines.where(~F.ltrim("value").startswith("{"))        # what stands before the first feature
    tail = F.regexp_extract(F.right("value", F.lit(TAIL)), _NEXT_START, 0)
    ends = (tail != "") | F.rtrim(F.regexp_replace(F.right("value", F.lit(TAIL)), r"\s+$", "")).endswith("}")
    body = F.when(ends, F.substring("value", F.lit(1), F.length("value") - F.length(tail))).otherwise(
        F.raise_error(F.lit(f"{path}: a record does not end where a feature ends")))
    whole = F.concat(F.lit('{"type":"Feature"'), body)
    return rest.select(F.from_json(whole, feature, {"mode": "FAILFAST"}).alias("f")).select("f.*")


def read_geojson(spark: SparkSession, path: str, properties: T.StructType,
                 features_per_line: bool = False, case: str = "big_camel") -> DataFrame:
    """Polygon layer -> (properties..., polys).

    FeatureCollections and, with ``features_per_line``, newline-delimited features;
    either is split over tasks within a file.  Property names are normalised
    (``clean_names``).
    """
    schema = _feature_schema(properties)
    feats = (spark.read.schema(schema).json(path) if features_per_line
             else _collection_features(spark, path, schema))
    fn = big_camel_name if case == "big_camel" else snake_name
    names = unique_names([fn(f.name) for f in properties.fields])
    props = [F.col(f"properties.{f.name}").alias(n) for f, n in zip(properties.fields, names)]
    return feats.select(*props, _polys("geometry.type", "geometry.coordinates").alias("polys"))


FEATURES_PER_FILE = 100_000


def geometry_json() -> Column:
    """``polys`` as a Polygon or MultiPolygon: rings closed, outer rings counter-clockwise
    and holes clockwise; rings that are no area (fewer than four positions) are
    left out, and a part without an outer ring with them.  NULL without parts."""
    shaped = F.transform(oriented(), lambda part: F.when(
        F.size(F.get(part, F.lit(0))) >= 4, F.filter(part, lambda r: F.size(r) >= 4)))
    parts = F.filter(shaped, lambda p: p.isNotNull())
    one = F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.get(parts, F.lit(0))), F.lit("}"))
    many = F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(parts), F.lit("}"))
    return F.when(F.size(parts) == 1, one).when(F.size(parts) > 1, many)


def write_geojson(layer: DataFrame, path: str, properties: list[str],
                  features_per_file: int = FEATURES_PER_FILE) -> str:
    """A polygon layer as FeatureCollections, one valid document in each
    ``file=<n>`` folder of ``path``, of about ``features_per_file`` features ordered by their properties.

    Files are dealt by a hash of the feature, so each is written by one task and
    holds a bounded number of features; nothing passes through the driver.  An
    empty layer is one empty collection.
    """
    spark = layer.sparkSession
    names = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}) if properties else F.lit("{}")
    features = layer.select(names.alias("p"), F.coalesce(geometry_json(), F.lit("null")).alias("g"))
    features = materialize(features, "features")
    files = max(1, -(-features.count() // features_per_file))
    dealt = features.withColumn("file", F.pmod(F.xxhash64("p", "g"), F.lit(files)).cast("int"))
    # one file's features
    place = F.row_number().over(Window.partitionBy("file").orderBy("p", "g"))
    comma = F.when(F.col("n") > 1, F.lit(",")).otherwise(F.lit(""))
    rows = dealt.withColumn("n", place).select("file", "n", F.concat(
        comma, F.lit('{"type":"Feature","properties":'), F.col("p"), F.lit(',"geometry":'), F.col("g"), F.lit("}")).alias("value"))
    frame = spark.range(files).select(F.col("id").cast("int").alias("file"), F.explode(F.array(
        F.struct(F.lit(0).alias("n"), F.lit('{"type":"FeatureCollection","features":[').alias("value")),
        F.struct(F.lit(2 ** 31 - 1).alias("n"), F.lit("]}").alias("value")))).alias("r")).select("file", "r.n", "r.value")
    # the sort begins with the partition column, so the writer keeps the order of lines
    (rows.unionByName(frame).repartition(files, "file").sortWithinPartitions("file", "n")
         .select("file", "value").write.mode("overwrite").partitionBy("file").text(path))
    return path


def polygons_from_vertices(vertices: DataFrame, id_col: str, part: str = "part",
                           ring: str = "ring", order: str = "i", x: str = "x",
                           y: str = "y") -> DataFrame:
    """Vertex rows (id, part, ring, i, x, y) -> (id, polys).  Each collect is
    bounded by one ring / one feature, never a whole layer."""
    r = (vertices.groupBy(id_col, part, ring)
                 .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"),
                                                           F.col(x).alias("x"),
                                                           F.col(y).alias("y")))).alias("v")))
    r = r.select(id_col, part, ring, F.transform("v", lambda p: F.array(p["x"], p["y"])).alias("r"))
    p = (r.groupBy(id_col, part)
          .agg(F.array_sort(F.collect_list(F.struct(F.col(ring).alias("k"), F.col("r")))).alias("rs"))
          .select(id_col, part, F.transform("rs", lambda s: s["r"]).alias("p")))
    return (p.groupBy(id_col)
             .agg(F.array_sort(F.collect_list(F.struct(F.col(part).alias("k"), F.col("p"))))
                  .alias("ps"))
             .select(id_col, F.transform("ps", lambda s: s["p"]).alias("polys")))


def write_cells(cells: DataFrame, path: str, side: float, mode: str = "overwrite") -> str:
    """Land-cover cells as Parquet, one folder for each strip of ``side`` map
    units of y, ordered by x within, so that a reader with bounds skips strips and pages."""
    strips = cells.select("x", "y", "class", "cell_area", F.floor(F.col("y") / side).alias("strip"))
    (strips.repartitionByRange("strip", "x", "y").sortWithinPartitions("strip", "x", "y")
           .write.mode(mode).partitionBy("strip").parquet(path))
    return path


def read_cells(spark: SparkSession, path: str, bounds: tuple | None = None, side: float | None = None) -> DataFrame:
    """Land-cover cells ``(x, y, class, cell_area)`` stored as Parquet; with
    ``bounds`` (x0, y0, x1, y1) those inside.  ``side``: that of ``write_cells``, for
    the strips to be skipped."""
    df = spark.read.parquet(path)
    if bounds:
        x0, y0, x1, y1 = bounds
        df = df.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
        if side:
            df = df.where(F.col("strip").between(int(y0 // side), int(y1 // side)))
    return df.select(F.col("x").cast("double"), F.col("y").cast("double"), F.col("class").cast("int"),
                     F.col("cell_area").cast("double"))
