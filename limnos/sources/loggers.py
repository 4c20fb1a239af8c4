"""S3: temperature-logger CSV folders, one file per logger (``<serial>.csv``).

A file may start with a banner line (plot title), then a header whose third
column names the unit ("Temp, °F (...)"), then data rows ``n, datetime,
temp, ...``.  The whole folder is one text scan; each line is classified on
its own, so files are split across tasks freely.  The unit is found per
file from its header line and joined back (one row per file).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from limnos.functions import as_numeric, na_tokens
from limnos.session import materialize
from limnos.sources.files import text_lines

# The unit is the first stand-alone F or C in the header's
# third column (the degree sign may arrive mis-encoded, so it is not used).
UNIT_PATTERN = r"(?<![A-Za-z])([FC])(?![A-Za-z])"
BANNER_WORD = "Plot"
SERIAL_PATTERN = r"([^/]+)\.csv$"
FIELDS = "c1 string, c2 string, c3 string"


def classify_lines(lines: DataFrame, value: str = "value", file: str = "file",
                   serial_pattern: str = SERIAL_PATTERN) -> DataFrame:
    """(file, line) -> (file, logger_sn, raw_datetime, raw_temp, unit).

    A header's third field names a unit and is no number; a banner has fewer
    than three fields and holds the word of a plot title.  Every other line
    that is not blank is a data row, whatever stands in its first field.
    """
    f = F.from_csv(F.col(value), FIELDS)
    df = lines.select(F.col(file).alias("file"), F.col(value).alias("line"), f.alias("f"))
    is_header = F.coalesce(as_numeric("f.c3").isNull() & F.col("f.c3").rlike(UNIT_PATTERN), F.lit(False))
    is_banner = F.col("f.c3").isNull() & F.coalesce(F.col("line").contains(BANNER_WORD), F.lit(False))
    is_data = ~is_header & ~is_banner & (F.trim("line") != "")
    units = (df.where(is_header)
               .groupBy("file")
               .agg(F.max(F.nullif(F.regexp_extract("f.c3", UNIT_PATTERN, 1), F.lit("")))
                    .alias("unit")))
    data = df.where(is_data).select(
        "file",
        as_numeric(F.regexp_extract("file", serial_pattern, 1)).alias("logger_sn"),
        na_tokens("f.c2").alias("raw_datetime"),
        na_tokens("f.c3").alias("raw_temp"))
    return data.join(units, "file", "left")


def read_logger_folder(spark: SparkSession, path: str, pattern: str = "*.csv",
                       serial_pattern: str = SERIAL_PATTERN) -> DataFrame:
    """Read every logger CSV in ``path``; error if there is none.  The serial
    comes from the file name (``<serial>.csv``) unless ``serial_pattern``
    says otherwise (e.g. a ``logger_sn=<serial>/`` folder)."""
    try:
        lines = text_lines(spark, path, pattern)
    except AnalysisException as e:  # no such folder
        raise FileNotFoundError(f"{path}: holds no logger file that matches {pattern}") from e
    if lines is None:
        raise FileNotFoundError(f"{path}: holds no logger file that matches {pattern}")
    # read three times below and by ``assert_units``: many small files are opened once
    lines = materialize(lines, "lines")
    return classify_lines(lines, serial_pattern=serial_pattern)


def read_logger_years(spark: SparkSession, base: str, pattern: str = "*/*.csv",
                      serial_pattern: str = SERIAL_PATTERN, folder_pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """The logger files of several folders (``2022``, ``2023``, ``2023_partner`` ...) in one
    scan, with the folder's name in ``folder``."""
    raw = read_logger_folder(spark, base, pattern, serial_pattern)
    return raw.withColumn("folder", F.regexp_extract("file", folder_pattern, 1))


def unit_problems(raw: DataFrame) -> DataFrame:
    """QC table of the files whose header names no unit: (file, code)."""
    return raw.where(F.col("unit").isNull()).select("file").distinct().withColumn("code", F.lit("no_unit"))


def assert_units(raw: DataFrame) -> None:
    """Fail when any file has no recognisable unit (``unit_problems`` lists them)."""
    n = unit_problems(raw).count()
    if n:
        raise ValueError(f"{n} logger file(s) without F or C in the temperature header")
