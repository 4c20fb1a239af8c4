"""Exact dedup (operator 13): two-pass Bloom filtering.

Texts are equal when identical after lower-casing A-Z only; of equal texts the
row with the largest doc_id stays.

* Every whole text is read once and becomes a narrow row: doc_id, row number
  and SHA-256 of the normalised text.
* Pass one builds a Bloom filter with counters that saturate at two.  A task
  reduces its rows to slots hit once and slots hit more often, packed by block
  of ``BLOCK`` slots; per block the contributions are added up and only the bits
  of slots hit at least twice are kept.
* Pass two probes: a row both of whose slots were hit twice is possibly
  repeated.  Only such rows are shuffled; all others are groups of one and pass
  straight through.

Possibly repeated rows are grouped on the whole digest, so a false positive
costs a shuffled row and no result.  The group's largest row and size are a
partial aggregate, joined back through a written table, so a group with a third
of all rows is reduced where it is read and the join can split it.

The filter has ``SLOTS`` slots a row and the broadcast at most ``MOST_SLOTS`` bits
(32 MB).  A larger table takes more rounds, each over one range of the digests,
whose rows the narrow table keeps together in its files.

Defined cases: NULL text is the empty text and equals it.  NULL doc_id is
smaller than any other; rows that tie in doc_id and text are one group, of
which exactly one row stays.  Texts of any length are hashed whole.  An empty
table gives no rows.  ``exact_groups`` reads doc_id and text only;
``drop_copies`` returns all columns, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import scratch, stored
from limnos.llm.similarity import id_filter, passes
from limnos.llm.vectors import text_buffer

SLOTS = 16              # slots of the filter for every row
BLOCK = 1 << 16         # slots that are summed together
MOST_SLOTS = 1 << 28    # bits broadcast at most
FLUSH = 1 << 20         # rows a task holds before it emits its slots

HASHED = "doc_id bigint, sha binary, h bigint, a bigint, b bigint"
_SIGN = np.uint64(1 << 63)


def digests(column: pa.Array) -> list[bytes]:
    """SHA-256 of every text with A-Z in lower case; null is the empty text."""
    data, offsets = text_buffer(pc.ascii_lower(column.fill_null("")))
    view, at = memoryview(data), offsets.tolist()
    return [hashlib.sha256(view[a:z]).digest() for a, z in zip(at[:-1], at[1:])]


def _hash_rows(batches):
    for batch in batches:
        sha = digests(batch.column("text"))
        parts = np.frombuffer(b"".join(sha), "<u8").reshape(-1, 4)
        order = (parts[:, 0] ^ _SIGN).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(sha, pa.binary()), pa.array(order, pa.int64()),
             pa.array(parts[:, 1].copy().view(np.int64)), pa.array(parts[:, 2].copy().view(np.int64))],
            names=["doc_id", "sha", "h", "a", "b"])


def hashed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, sha, h (first 8 bytes, as an ordered number), a, b (the next two),
    uid (number of the row), one row per input row, written once."""
    rows = docs.select("doc_id", "text").mapInArrow(_hash_rows, HASHED) \
        .withColumn("uid", F.monotonically_increasing_id())
    # each file in digest order: a round reads only the pages of its range
    return stored(rows.sortWithinPartitions("h"), "digests")


def _slots(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return a.view(np.uint64) % np.uint64(size), b.view(np.uint64) % np.uint64(size)


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)


def _pack_slots(a: np.ndarray, b: np.ndarray, size: int) -> pa.RecordBatch:
    """block, once, more: the slots that rows hit, with a count of one or more."""
    x, y = _slots(a, b, size)
    slots, counts = np.unique(np.concatenate([x, y[x != y]]), return_counts=True)
    block = (slots // np.uint64(BLOCK)).astype(np.int32)
    place = (slots % np.uint64(BLOCK)).astype("<u2")
    cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    once, more = [], []
    for lo, hi in zip(cuts, [*cuts[1:], len(block)]):
        single = counts[lo:hi] == 1
        once.append(place[lo:hi][single].tobytes())
        more.append(place[lo:hi][~single].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int32()), pa.array(once, pa.binary()),
                                       pa.array(more, pa.binary())], names=["block", "once", "more"])


def _count_slots(size: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(_columns(batch))
            n += batch.num_rows
            if n >= FLUSH:
                yield _pack_slots(*map(np.concatenate, zip(*held)), size)
                held, n = [], 0
        if n:
            yield _pack_slots(*map(np.concatenate, zip(*held)), size)
    return run


def _add_block(group: pa.Table) -> pa.Table:
    """Bits of the slots that were hit at least twice."""
    total = np.zeros(BLOCK, np.uint8)
    for once, more in zip(group.column("once").to_pylist(), group.column("more").to_pylist()):
        hit = np.frombuffer(once, "<u2")
        total[hit] = np.minimum(total[hit] + 1, 2)
        total[np.frombuffer(more, "<u2")] = 2
    bits = np.packbits(total == 2, bitorder="little").tobytes()
    return pa.table([pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([bits], pa.binary())],
                    names=["block", "bits"])


def build_filter(rows: DataFrame, size: int) -> np.ndarray:
    """Pass one: the bits (size / 8 bytes) of all slots hit at least twice."""
    blocks = rows.select("a", "b").mapInArrow(_count_slots(size), "block int, once binary, more binary") \
        .groupBy("block").applyInArrow(_add_block, "block int, bits binary").toArrow()
    table = np.zeros(size // 8, np.uint8)
    for block, bits in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist()):
        table[block * (BLOCK // 8):(block + 1) * (BLOCK // 8)] = np.frombuffer(bits, np.uint8)
    return table


def possibly_repeated(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pass two: which rows have all their slots hit twice (none is missed)."""
    found = np.ones(len(a), bool)
    for slot in _slots(a, b, 8 * len(table)):
        found &= (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def filter_size(n_rows: int, slots: int = SLOTS) -> int:
    return max(1, -(-n_rows * slots // BLOCK)) * BLOCK


def marked_rows(rows: DataFrame, most_slots: int = MOST_SLOTS) -> DataFrame:
    """The hashed rows with ``maybe``, round by round, from a written table."""
    spark = rows.sparkSession
    n = rows.count()
    rounds = max(1, -(-n * SLOTS // most_slots))
    path = scratch(spark, "marked")
    fields = "doc_id bigint, sha binary, uid bigint, maybe boolean"
    for k in range(rounds):
        low, high = ((k << 64) // rounds) - (1 << 63), (((k + 1) << 64) // rounds) - (1 << 63) - 1
        part = rows.where(F.col("h").between(low, high)) if rounds > 1 else rows
        bits = spark.sparkContext.broadcast(build_filter(part, filter_size(-(-n // rounds))))

        def probe(batches, bits=bits):
            for batch in batches:
                maybe = possibly_repeated(bits.value, *_columns(batch))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha"), batch.column("uid"),
                                                  pa.array(maybe)], names=["doc_id", "sha", "uid", "maybe"])
        part.mapInArrow(probe, fields).write.parquet(f"{path}/round={k}")
        bits.unpersist()
    return spark.read.schema(fields + ", round int").parquet(path).drop("round")


def repeated_groups(marked: DataFrame) -> DataFrame:
    """sha, best (doc_id and uid of the row that stays), n of the groups of more than one."""
    return stored(marked.where("maybe").groupBy("sha").agg(
        F.max(F.struct("doc_id", "uid")).alias("best"), F.count("*").alias("n")).where("n > 1"), "groups")


def exact_groups(docs: DataFrame, most_slots: int = MOST_SLOTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every input row."""
    marked = marked_rows(hashed_rows(docs), most_slots)
    groups = repeated_groups(marked)
    alone = marked.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha")
    shuffled = marked.where("maybe").join(groups, "sha", "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("uid") == F.col("best.uid"), F.lit(True)).alias("kept"), "sha")
    return alone.unionByName(shuffled).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, most_slots: int = MOST_SLOTS) -> DataFrame:
    """The documents that stay, with all their columns; the copies go.

    Rows outside the repeated groups stay where they are read; the others meet
    by digest, one row for each group and task at most.
    """
    groups = repeated_groups(marked_rows(hashed_rows(docs), most_slots))
    prefix = F.conv(F.substring(F.hex("sha"), 1, 16), 16, -10).cast("long")
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(groups.select(prefix.alias("id"))))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def probe(batches):
        table = np.frombuffer(bits.value, np.int64)
        for batch in batches:
            sha = digests(batch.column("row").field("text"))
            ids = np.frombuffer(b"".join(x[:8] for x in sha), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sha, pa.binary()), pa.array(passes(table, ids))],
                                             names=["row", "sha", "maybe"])
    marked = whole.mapInArrow(probe, f"row {whole.schema['row'].dataType.simpleString()}, sha binary, maybe boolean")
    kept = marked.where("maybe").groupBy("sha").agg(F.max_by("row", F.struct("row.doc_id")).alias("row"))
    return marked.where("not maybe").select("row.*").unionByName(kept.select("row.*"))


# The groups in DuckDB SQL, for whole tables.
GROUPS_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
WINDOW same AS (PARTITION BY t)
"""
