"""Best-fit packing (operator 1): conflict-constrained best-fit decreasing.

Documents (in words) are packed into sequences of ``CAPACITY``.  A document
longer than that fills whole sequences of its own; its remainder is an item
like any other.  Bins are kept in the order of their residual space and carry
two bitmaps, of the sources and of the duplicate clusters they hold.  An item
goes to the tightest bin that is compatible: the search starts at the first
bin with enough room and steps to the successor while the bin already holds
the item's source or cluster; with none left a bin is opened.  A cluster is a
set of documents with the same words, letter case aside.

Items are dealt by a salted hash over groups of about ``GROUP`` items, whose
number follows the table; each group is packed in one task, longest first
(then by doc_id).  So a source or cluster with a third of all rows is spread
over all groups, and a task holds lengths and keys only, never texts.

Defined cases: NULL, empty or blank text has no words and no bin (bin_id and
start are NULL).  A NULL source or doc_id is a value like others.  Each input
row is packed, repeated rows too: they share a cluster and so never a bin.  An
empty table gives no rows.  Only doc_id, text and the source column are read.  The
groups, and so the bins, follow from the order of rows as they were read and written
once; any layout gives bins that keep all the rules.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import stored, words

CAPACITY = 2048
GROUP = 4096

RESULT = "doc_id bigint, piece bigint, n_words bigint, bin_id bigint, start bigint"


def best_fit(items: list[tuple], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Bin and start of each (length, source, cluster) item, in the given order."""
    order: list[tuple[int, int]] = []          # (residual, bin), ascending
    held: list[tuple[int, int]] = []           # per bin: source bitmap, cluster bitmap
    bit_of: tuple[dict, dict] = ({}, {})
    counts: dict = {}
    for _, _, cluster in items:
        counts[cluster] = counts.get(cluster, 0) + 1
    placed = []
    for length, source, cluster in items:
        s = 1 << bit_of[0].setdefault(source, len(bit_of[0]))
        # a cluster of one item conflicts with nothing and needs no bit
        c = 1 << bit_of[1].setdefault(cluster, len(bit_of[1])) if counts[cluster] > 1 else 0
        at = bisect_left(order, (length, -1))
        while at < len(order) and (held[order[at][1]][0] & s or held[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
            held[b] = (held[b][0] | s, held[b][1] | c)
        else:
            room, b = capacity, len(held)
            held.append((s, c))
        placed.append((b, capacity - room))
        if room > length:
            insort(order, (room - length, b))
    return placed


def items(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, n (words), source, cluster, salt of each row."""
    w = docs.select("doc_id", F.col(source).cast("string").alias("source"), words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), "source",
                    F.xxhash64(F.lower(F.array_join("w", " "))).alias("cluster"),
                    F.xxhash64(F.monotonically_increasing_id()).alias("salt"))


def pack_documents(docs: DataFrame, source: str = "source", capacity: int = CAPACITY,
                   group_items: int = GROUP) -> DataFrame:
    """doc_id, piece, n_words, bin_id, start: one row per piece of a document."""
    rows = stored(items(docs, source), "items")      # fixes the salt
    full = rows.where("n > 0")
    groups = max(1, -(-full.count() // group_items))

    def pack(group: pa.Table) -> pa.Table:
        cols = [group.column(c).to_pylist() for c in ("n", "doc_id", "source", "cluster", "salt", "g")]
        order = sorted(zip(*cols), key=lambda r: (-(r[0] % capacity), r[1] is not None, r[1] or 0, r[2] or "", r[0], r[4]))
        rest = [r for r in order if r[0] % capacity]
        base = cols[5][0] << 32
        out, used = [], 0
        for (b, start), r in zip(best_fit([(r[0] % capacity, r[2], r[3]) for r in rest], capacity), rest):
            out.append((r[1], r[0] // capacity, r[0] % capacity, base + b, start))
            used = max(used, b + 1)
        for r in order:                         # whole sequences of one document
            for piece in range(r[0] // capacity):
                out.append((r[1], piece, capacity, base + used, 0))
                used += 1
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)],
                        names=["doc_id", "piece", "n_words", "bin_id", "start"])
    packed = full.withColumn("g", F.pmod("salt", F.lit(groups))).groupBy("g").applyInArrow(pack, RESULT)
    none = F.lit(None).cast("long")
    empty = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.col("n").alias("n_words"),
                                       none.alias("bin_id"), none.alias("start"))
    return packed.unionByName(empty)
