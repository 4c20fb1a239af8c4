"""S1/S2 delimited exports, S6 weather JSON, folders of many text files."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.functions import clean_names, na_tokens
from limnos.operators.ordering import natural_path_order
from limnos.session import materialize, shared_folder


def file_position() -> Column:
    """Where a row of a scan stands: file (natural order of its path), block and
    place in the block.  Comparable over the whole table and the same on every
    run: a block's rows are read in order by one task, whatever the block's task.
    Take it directly from a reader, before any shuffle."""
    return F.struct(natural_path_order(F.col("_metadata.file_path")).alias("file"),
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_delimited(spark: SparkSession, path: str, na=("", "NA"), case: str = "snake", sep: str = ",",
                   encoding: str = "UTF-8", multi_line: bool = False, position: str | None = None) -> DataFrame:
    """A delimited export as text columns named by its header, names
    normalised, NA tokens -> NULL, values trimmed.

    No type inference: every column arrives as text (one pass, no sampling
    job) and jobs type it explicitly with the lenient casts.  Files split
    across tasks; ``multi_line`` reads fields with line breaks, at the price
    of one task per file.  ``position`` names a column for ``file_position``.
    """
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("multiLine", multi_line).option("sep", sep).option("encoding", encoding)
          .option("mode", "PERMISSIVE").csv(path))
    place = [file_position().alias(position)] if position else []
    names = clean_names(df, case).columns
    return df.select(*[na_tokens(F.col(f"`{c}`"), na).alias(n) for c, n in zip(df.columns, names)], *place)


def typed(df: DataFrame, types: dict) -> DataFrame:
    """Apply ``{column: Column-function}`` conversions by name (``col_types``)."""
    return df.withColumns({c: fn(c) for c, fn in types.items() if c in df.columns})


URI_HEAD = "^[^/:]+:(//[^/]*)?"     # scheme and host of a path


def deep_files(reader: DataFrameReader, path: str, pattern: str,
               load: Callable[[DataFrameReader, str], DataFrame]) -> DataFrame | None:
    """The files ``<path>/<pattern>``, None when no file matches; ``load`` names the format.

    A pattern such as ``*/*.txt`` has one file a folder and many folders: the folder
    is listed by Spark tasks and each file looked up once, where a glob would list
    every folder on the driver and then look up every file again.
    """
    base, *levels = path.rstrip("/"), *pattern.split("/")
    if any(c in base for c in "*?[{") or any(x != "*" for x in levels[:-1]):
        return load(reader, f"{base}/{pattern}")
    df = load(reader.option("recursiveFileLookup", len(levels) > 1).option("pathGlobFilter", levels[-1]), base)
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    depth = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).depth() + len(levels)
    below = F.regexp_replace(F.col("_metadata.file_path"), URI_HEAD, "")
    df = df.where(F.length(below) - F.length(F.replace(below, F.lit("/"), F.lit(""))) == depth)
    if df.isEmpty() and not any(re.sub(URI_HEAD, "", f).count("/") == depth for f in df.inputFiles()):
        return None
    return df


PLAIN_FILES = r"[^?\[\]{}\\^]*\.(csv|txt|dat)"       # not compressed, no pattern but ``*``
# what Spark writes as %XX in the path of a file
QUOTED = "[\x00-\x20\"#%<>?\\[\\\\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLOCK = 64 << 20    # a longer file is read by several tasks
BOM = b"\xef\xbb\xbf"


def text_lines(spark: SparkSession, path: str, pattern: str, block: int = BLOCK) -> DataFrame | None:
    """The lines (``value``) of the text files ``<path>/<pattern>`` with the path of their ``file``, as Spark's
    text reader gives them; None when no file matches.

    On a mounted folder the tasks list the folders and read the files themselves: Spark's readers spend
    some milliseconds on each file, and keep a record of each on the driver.
    """
    folder, levels = shared_folder(spark, path), pattern.split("/")
    if (folder is None or not os.path.isdir(folder) or any(c in path for c in "*?[{")
            or any(x != "*" for x in levels[:-1]) or not re.fullmatch(PLAIN_FILES, levels[-1])):
        df = deep_files(spark.read, path, pattern, lambda r, p: r.text(p))
        return None if df is None else df.select("value", F.col("_metadata.file_path").alias("file"))
    shown = levels[-1]

    def entries(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with os.scandir(name) as found:
                    # Spark's rule of names that are no data
                    yield [e for e in found if not (e.name.startswith(".") or e.name.endswith("._COPYING_")
                                                    or e.name.startswith("_") and "=" not in e.name)]

    def folders(batches):
        for found in entries(batches):
            yield pa.record_batch([pa.array([e.path for e in found if e.is_dir()], pa.string())], names=["name"])

    def pieces(batches):
        for found in entries(batches):
            rows = [(e.path, a, a + block) for e in found if fnmatchcase(e.name, shown) and e.is_file()
                    for a in range(0, max(e.stat().st_size, 1), block)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                   pa.array([r[2] for r in rows], pa.int64())], names=["name", "start", "stop"])

    def chunks(name, start, stop):
        """Whole lines that begin in the piece; a line break before ``start`` ends the one before."""
        with open(name, "rb") as data:
            if start:
                data.seek(start - 1)
                data.readline()
            at = data.tell()
            while at < stop and (chunk := data.read(min(1 << 20, stop - at))):
                if not chunk.endswith(b"\n"):
                    chunk += data.readline()
                yield (chunk[len(BOM):] if at == 0 and chunk.startswith(BOM) else chunk).splitlines()
                at += len(chunk)

    def read(batches):
        lines, files = [], []
        batch = lambda: pa.record_batch([pa.array(lines, pa.binary()), pa.array(files, pa.string())], names=["value", "file"])
        for b in batches:
            for name, start, stop in zip(*[c.to_pylist() for c in b.columns]):
                uri = "file:" + re.sub(QUOTED, lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), name)
                for some in chunks(name, start, stop):
                    lines += some
                    files += [uri] * len(some)
                    if len(lines) >= 10_000:
                        yield batch()
                        lines, files = [], []
        yield batch()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = spark.createDataFrame([(folder,)], "name string")
    for _ in levels[:-1]:
        names = names.mapInArrow(folders, "name string").repartition(n)
    # written once: read for whether there is any, and for the lines
    files = materialize(names.mapInArrow(pieces, "name string, start bigint, stop bigint"), "files")
    if files.isEmpty():
        return None
    read_lines = files.repartition(n).mapInArrow(read, "value binary, file string")
    return read_lines.select(F.col("value").cast("string").alias("value"), "file")


WEATHER_RECORD = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("min_temp", T.DoubleType()),
    T.StructField("avg_temp", T.DoubleType()),
    T.StructField("max_temp", T.DoubleType()),
])


def read_weather(spark: SparkSession, path: str, key_pattern: str = r"([^/]+)\.json$",
                 record: T.StructType = WEATHER_RECORD, pattern: str | None = None) -> DataFrame:
    """Weather answers ``{"data": [{...}, ...]}``, one file per request,
    the request key taken from the file name -> one row per record.  ``pattern``
    (as ``*/*.txt``) names the files below the folder ``path``."""
    schema = T.StructType([T.StructField("data", T.ArrayType(record))])
    reader = spark.read.option("multiLine", True).schema(schema)
    raw = deep_files(reader, path, pattern, lambda r, p: r.json(p)) if pattern else reader.json(path)
    if raw is None:
        raise FileNotFoundError(f"{path}: holds no file that matches {pattern}")
    df = raw.select(F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1).alias("key"),
                    F.inline("data"))
    return df.withColumn("date", F.to_date("date"))


def parse_json_records(df: DataFrame, col: str, record: T.StructType) -> DataFrame:
    """A JSON text column holding an array of records -> one row each."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.inline(F.from_json(col, T.ArrayType(record))))


def json_columns(df: DataFrame, col: str, schema: T.StructType | str) -> DataFrame:
    """R3 for one JSON object per row: its fields become columns."""
    parsed = F.from_json(F.col(col), schema)
    fields = schema.fieldNames() if isinstance(schema, T.StructType) else None
    out = df.withColumn("__json", parsed)
    names = fields or [f.name for f in out.schema["__json"].dataType.fields]
    return out.select(*[c for c in df.columns if c != col],
                      *[F.col(f"__json.{n}").alias(n) for n in names])
