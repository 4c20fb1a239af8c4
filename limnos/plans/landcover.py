"""Land-cover shares per watershed (T11) and comparison with the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import percent, signed_percent
from limnos.operators.aggregates import strict_mean
from limnos.operators.joins import join_ns, lookup
from limnos.operators.sets import bind_rows
from limnos.operators.spatial import albers_forward, cell_index, cover_cells, coverage_spans, project

# Land-cover legend (class code, name, display colour).
CLASSES = [
    (11, "Open Water", "#466b9f"),
    (12, "Perennial Ice/Snow", "#d1def8"),
    (21, "Developed, Open Space", "#dec5c5"),
    (22, "Developed, Low Intensity", "#d99282"),
    (23, "Developed, Medium Intensity", "#eb0000"),
    (24, "Developed, High Intensity", "#ab0000"),
    (31, "Barren Land", "#b3ac9f"),
    (41, "Deciduous Forest", "#68ab5f"),
    (42, "Evergreen Forest", "#1c5f2c"),
    (43, "Mixed Forest", "#b5c58f"),
    (52, "Shrub/Scrub", "#ccb879"),
    (71, "Grassland/Herbaceous", "#dfdfc2"),
    (81, "Pasture/Hay", "#dcd939"),
    (82, "Cultivated Crops", "#ab6c28"),
    (90, "Woody Wetlands", "#b8d9eb"),
    (95, "Emergent Herbaceous Wetlands", "#6c9fb8"),
]
NO_DATA_CLASS = 0
NO_DATA_AS = 11
SQ_MI_PER_SQ_KM = 0.3861


def class_table(spark) -> DataFrame:
    """The legend with its first-appearance order (``fct_inorder``)."""
    return spark.createDataFrame(
        [(c, n, h, i) for i, (c, n, h) in enumerate(CLASSES)],
        "class int, class_name string, hex string, class_order int")


def class_shares_levels(cells: DataFrame, layers: dict, x0: float, y0: float, cell: float) -> DataFrame:
    """G5 + A9 for several watershed levels in one pass over the cells.

    Lon/lat layers are projected to the cells' system (EPSG:5070).  A cell counts
    for a watershed with the exact share that the watershed covers; inner cells
    meet a span, only cells on a border a share of their own.  The spans of all
    levels are stacked and the cell table (the largest input) is joined to them
    once, instead of once per level.  Output: (huc_level, pid, class, area, total_area, pct_area).
    """
    spans = None
    for level, layer in layers.items():
        s = coverage_spans(project(layer, albers_forward), "pid", x0, y0, cell).withColumn("huc_level", F.lit(level))
        spans = s if spans is None else spans.unionByName(s)
    c = cell_index(cells, "x", "y", x0, y0, cell)
    weighted = cover_cells(c, spans, ["huc_level", "pid"]).select(
        "huc_level", "pid", "class", (F.col("cell_area") * F.col("frac")).alias("a"))
    area = weighted.groupBy("huc_level", "pid", "class").agg(F.sum("a").alias("area"))
    total = area.groupBy("huc_level", "pid").agg(F.sum("area").alias("total_area"))
    out = area.join(total, ["huc_level", "pid"])
    return out.withColumn("pct_area", F.col("area") / F.col("total_area"))


def landscape_from_shares(attrs: DataFrame, shares: DataFrame) -> DataFrame:
    """T11 from stacked attributes (huc_level, pid, huc, huc_name) and
    ``class_shares_levels`` output; class 0 becomes 11 afterwards."""
    df = join_ns(attrs, shares, ["huc_level", "pid"], "left").drop("pid")
    return df.withColumn("class", F.when(F.col("class") == NO_DATA_CLASS, F.lit(NO_DATA_AS))
                         .otherwise(F.col("class")))


def area_summary(landscape_df: DataFrame) -> DataFrame:
    """Mean watershed area per level (mean over watersheds of their
    total), count, in km² and mi².  Means are NA-strict, as R's ``mean``."""
    per = landscape_df.groupBy("huc_level", "huc").agg(strict_mean("total_area").alias("mean_area"))
    out = per.groupBy("huc_level").agg(strict_mean("mean_area").alias("mean_area"),
                                       F.count(F.lit(1)).alias("n"))
    return out.withColumns({"sq_km": F.col("mean_area") / 1e6}).withColumn(
        "sq_mi", F.col("sq_km") * SQ_MI_PER_SQ_KM)


def state_means(landscape_df: DataFrame, classes: DataFrame, level: int = 12) -> DataFrame:
    """A10: mean share per class over the watersheds of one level that have
    the class (no zero fill)."""
    df = lookup(landscape_df.where(F.col("huc_level") == level), classes, ["class"])
    return (df.groupBy("class_name", "hex", "class_order")
              .agg(strict_mean("pct_area").alias("pct_area")))


def watershed_vs_state(landscape_df: DataFrame, classes: DataFrame, level: int = 12) -> DataFrame:
    """A11 for every watershed of a level: its share of each state class
    minus the state mean, with labels.

    As in the reference's left join, a class present twice in a watershed
    (class 0 remapped to 11) gives two rows, and a state class absent from
    the watershed gives one row with share 0.  The state table has at most
    one row per legend class, so it is broadcast; the absent classes come
    from each watershed's class set (also bounded by the legend), never
    from pairing every watershed with every class by a cross join."""
    state = (state_means(landscape_df, classes, level).where(F.col("class_name").isNotNull())
             .drop("class_order"))
    ws = (lookup(landscape_df.where(F.col("huc_level") == level), classes, ["class"])
          .where(F.col("class_name").isNotNull())
          .select("huc", "class_name", F.col("pct_area").alias("pct_area2")))
    present = ws.join(F.broadcast(state), "class_name")
    state_arr = state.select(F.collect_list(F.struct("class_name", "hex", "pct_area"))).scalar()
    seen = ws.groupBy("huc").agg(F.collect_set("class_name").alias("seen"))
    absent = (seen.select("huc", "seen", F.explode(state_arr).alias("s"))
                  .where(~F.array_contains("seen", F.col("s.class_name")))
                  .select("huc", F.col("s.class_name").alias("class_name"),
                          F.lit(0.0).alias("pct_area2"), F.col("s.hex").alias("hex"),
                          F.col("s.pct_area").alias("pct_area")))
    out = present.unionByName(absent)
    out = out.withColumn("diff", F.col("pct_area2") - F.col("pct_area"))
    out = out.withColumns({
        "label": signed_percent("diff"),
        "label_pos": F.when(F.col("diff") == 0, F.lit(0.0))
                      .otherwise(-1 * F.signum("diff") * 0.00001),
    })
    # The wording of the chart's hover text
    return out.withColumn("hovertext", F.concat(
        F.lit("Current watershed: "), percent("pct_area2"), F.lit("<br>State average: "),
        percent("pct_area"), F.lit("<br>Difference: "), F.col("label")))


def diff_axis_range(diffs: DataFrame) -> DataFrame:
    """Chart axis range, 1.25 x the smallest and largest difference."""
    return diffs.agg((F.min("diff") * 1.25).alias("lo"), (F.max("diff") * 1.25).alias("hi"))
