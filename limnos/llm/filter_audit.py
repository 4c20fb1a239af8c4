"""Filter interaction audit (operator 11): existential self-join and bit sets.

Five filters fail a document: A, fewer than ``MIN_WORDS`` words; B, fewer distinct
words than half its words; C, more than 2 % capitals A-Z; D, a symbol of
``SYMBOLS``; E, a text identical to that of a smaller doc_id, anywhere in the table.

* One scan of the whole texts gives every row's key (doc_id, part, 128-bit hash
  of the text) and its bits A to D.
* E is an existential self-join: rows whose hash occurs more than once are left-semi
  joined on hash, exact text and smaller doc_id.  The right side is reduced
  to the smallest doc_id of each text before the shuffle; both sides are written
  tables, so a text that a third of all rows share is split over tasks.
* The keys that E marks are united with the other failing keys; the bit sets are
  or-ed per key and counted per part and combination (32 at most).

All orders of the filters follow from the combinations: what a filter removes
after others is a sum over the combinations that hold its bit and none of theirs.
So the audit costs the same whatever the number of orders.

Defined cases: NULL text is the empty text (fails A); NULL part is the empty
string.  A NULL doc_id is smaller than none and none is smaller than it: such a
row never fails E and makes no other row fail.  Rows equal in doc_id do not mark
each other.  Each input row counts, repeated ones too.  Labels: a document is
good or toxic if any of its label rows says so; NULL labels and labels without
document do not count.  Texts of any length are read whole.  An empty table
gives no part and no row.  Other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import stored
from limnos.llm.similarity import id_filter, passes
from limnos.llm.vectors import text_buffer

FILTERS = "ABCDE"
MIN_WORDS = 200
CAPITALS = bytes(range(65, 91))
SYMBOLS = re.compile(rb"[#$%&*|]")
COPY = 1 << FILTERS.index("E")

KEY = ["doc_id", "part", "h1", "h2"]


def text_bits(raw: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()             # bytes split at ASCII white space only
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((len(words) < MIN_WORDS) + 2 * (100 * len(set(words)) < 50 * len(words))
            + 4 * (100 * capitals > 2 * n_chars) + 8 * (SYMBOLS.search(raw) is not None))


def _raw_texts(column: pa.Array):
    data, offsets = text_buffer(column)
    at = offsets.tolist()
    return [data[a:z].tobytes() for a, z in zip(at[:-1], at[1:])]


def _hash(raw: list[bytes]) -> np.ndarray:
    """Two int64 columns of the 128-bit hash of each text."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), "<i8").reshape(-1, 2)


def _measure(batches):
    for batch in batches:
        raw = _raw_texts(batch.column("text"))
        h = _hash(raw)
        chars = pc.utf8_length(batch.column("text").fill_null("")).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("part"), pa.array(h[:, 0].copy()),
             pa.array(h[:, 1].copy()), pa.array([text_bits(t, n) for t, n in zip(raw, chars)], pa.int32())],
            names=[*KEY, "bits"])


def measured(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, h1, h2, bits of every row, from one scan of the texts."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(_measure, "doc_id bigint, part string, h1 bigint, h2 bigint, bits int")


def copies(docs: DataFrame, rows: DataFrame, part: str = "source") -> DataFrame:
    """The keys of all rows that fail E.  ``rows``: what ``measured`` gave."""
    again = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("id"))
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(again))

    def candidates(batches):
        table = np.frombuffer(bits.value, np.int64)
        for batch in batches:
            h = _hash(_raw_texts(batch.column("text")))
            keep = np.flatnonzero(passes(table, h[:, 0].copy()))
            picked = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [picked.column("doc_id").cast(pa.int64()), picked.column("part"), pa.array(h[keep, 0]),
                 pa.array(h[keep, 1]), picked.column("text").fill_null("")], names=[*KEY, "text"])
    texts = docs.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    fields = "doc_id bigint, part string, h1 bigint, h2 bigint, text string"
    return with_smaller_copy(stored(texts.mapInArrow(candidates, fields), "texts"))


def with_smaller_copy(left: DataFrame) -> DataFrame:
    """The keys of the rows (doc_id, part, h1, h2, text) for which another row has the
    same hash, the same text and a smaller doc_id."""
    right = stored(left.groupBy("h1", "h2", "text").agg(F.min("doc_id").alias("first")), "first")
    d, e = left.alias("d"), right.alias("e")
    return d.join(e, (F.col("d.h1") == F.col("e.h1")) & (F.col("d.h2") == F.col("e.h2"))
                  & (F.col("d.text") == F.col("e.text")) & (F.col("e.first") < F.col("d.doc_id")), "left_semi").select(*KEY)


def failure_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, h1, h2, mask, n: bit set of failed filters, and number of rows, of each key."""
    rows = stored(measured(docs, part), "bits")
    failed = copies(docs, rows, part).distinct().select(*KEY, F.lit(COPY).alias("bits"), F.lit(0).alias("n"))
    return rows.withColumn("n", F.lit(1)).unionByName(failed) \
        .groupBy(*KEY).agg(F.bit_or("bits").alias("mask"), F.sum("n").alias("n"))


def combinations(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: rows of each combination of failed filters."""
    true = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    flags = stored(labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
                   .agg(true("quality").alias("good"), true("toxic").alias("toxic"))
                   .where("good + toxic > 0"), "flags")
    zero = F.lit(0)
    return failure_masks(docs, part).join(flags, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", zero)).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", zero)).alias("toxic"))


def _orders() -> str:
    """Rows of a table (filter_order, step, x: bit of the step's filter, before: bits of the filters already applied)."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            x = 1 << FILTERS.index(letter)
            rows.append(f"('{''.join(order)}', {step}, {x}, {before})")
            before |= x
    return ", ".join(rows)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step and the counts, for all orders of the filters."""
    spark = docs.sparkSession
    combos = stored(combinations(docs, labels, part), "combinations")
    bits = [1 << k for k in range(len(FILTERS))]
    # a step is a filter and the set of those before it: 80 pairs
    steps = [(x, before) for x in bits for before in range(1 << len(FILTERS)) if not before & x]
    placed = combos.select("*", F.explode(F.array(*[F.lit(s[0] * 32 + s[1]) for s in steps])).alias("at")).select(
        "part", "mask", "n", "good", "toxic", F.shiftright("at", 5).alias("x"), F.col("at").bitwiseAND(31).alias("before"))
    has = F.col("mask").bitwiseAND(F.col("x")) != 0
    free = F.col("mask").bitwiseAND(F.col("before")) == 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    n_orders = len(list(permutations(FILTERS)))
    counted = placed.groupBy("part", "x", "before").agg(
        count(~has & free).alias("kept"), count(has & free).alias("removed"), count(has & ~free).alias("redundant"),
        count(F.col("mask") == F.col("x")).alias("unique_fails"), count(has & free, "good").alias("good_lost"),
        count(has & free, "toxic").alias("toxic_lost"),
        # of all orders, a share of one by the number of failed filters has this one first
        F.sum(F.when(has, F.expr(f"n * ({n_orders} div bit_count(mask))")).otherwise(0)).cast("long").alias("shapley"))
    # one row for each order and step: a table of fixed size
    orders = F.broadcast(spark.sql(f"SELECT * FROM VALUES {_orders()} AS t(filter_order, step, x, before)"))
    return counted.join(orders, ["x", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


# The audit in DuckDB SQL, for whole tables.
AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (
  SELECT doc_id, part,
    CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS INT) AS mask
  FROM w),
flags AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN flags USING (doc_id) GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(l, b)),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS x, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step))
SELECT part, filter_order, step,
  CAST(sum(CASE WHEN mask & x = 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & x <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & x <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = x THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & x <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & x <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & x <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM c, steps GROUP BY part, filter_order, step
"""
