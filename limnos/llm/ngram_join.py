"""N-gram Jaccard join (operator 7) by vertical partitioning.

A document's set is its distinct 5-word shingles; documents with equal sets
form a class and only classes are joined.  The n-gram order is global: by
document frequency, then hash.  It is cut into fragments (ranges of the hash)
in which frequencies and partial overlaps are counted separately; partial
overlaps are summed per pair, and pairs that reach the threshold are links.
Components of links come from a distributed union-find.

Most documents have no partner.  ``candidate_classes`` finds those that can:
a set with a link has at most floor(0.2 n) shingles of its own, so among any
part of the hash order it must share all but as many.  The part examined is
the lowest 40 % of the order (all of it for small sets).  This is exact: a set
below the bound has no link.

Defined cases: words are lower-cased A-Z and cut at ASCII white space.  Fewer
than five words: the whole sequence is one shingle.  NULL, empty or blank text
has the empty set and links with nothing, not even its equals; its component
is its own doc_id.  Each input row is a result row; equal rows get equal
results.  A NULL doc_id takes part with its text, but is never a component id
unless all members are NULL.  Very long texts are hashed in blocks.  Shingles
are compared by 64-bit hashes.  An empty table gives no rows.  ``keep_one`` returns
all columns, whatever their names; the others read doc_id and text only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import marked, stored
from limnos.llm.similarity import (BATCH_KEYS, FRAGMENT_KEYS, PACKED, id_filter, link, measured, pack, packed_batch,
                                   passes, prefix_keys, set_minus, set_postings, shared_ids)
from limnos.llm.vectors import shingles, text_buffer, word_hashes

WORDS = 5
PERCENT = 80


def _bound(n: np.ndarray) -> np.ndarray:
    """Upper hash bound of the shingles a set of n emits (falls with n)."""
    share = np.where(n <= 64, 1.0, np.maximum(0.4, 64 / np.maximum(n, 1)))
    return np.where(share >= 1, np.uint64(0xFFFFFFFFFFFFFFFF),
                    (share * 2.0 ** 53).astype(np.uint64) << np.uint64(11))


def _own_bound(n: np.ndarray) -> np.ndarray:
    """Bound up to which every possible partner (at most 5/4 n) emits."""
    return _bound((n * 5) // 4 + 1)


def _sets(column: pa.Array, size: int):
    data, offsets = text_buffer(column)
    words, at = word_hashes(data, offsets)
    return shingles(words, at, size)


def _class_id(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def _slices(batches, size: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def document_classes(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, th (text hash), n (set size), cls (64-bit id of the set; NULL when
    empty), own (shingles within the set's own bound)."""
    def run(batches):
        for batch in _slices(batches):
            n, cls, own = [], [], []
            for g in _sets(batch.column("text"), size):
                n.append(len(g))
                cls.append(_class_id(g) if len(g) else None)
                own.append(int(np.searchsorted(g, _own_bound(np.array([len(g)]))[0], "right")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("th"), pa.array(n, pa.int64()),
                 pa.array(cls, pa.int64()), pa.array(own, pa.int64())], names=["doc_id", "th", "n", "cls", "own"])
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text") \
        .mapInArrow(run, "doc_id bigint, th bigint, n bigint, cls bigint, own bigint")


def _packed(fragments: int, size: int):
    def run(batches):
        seen, sets, total = set(), [], 0
        for batch in _slices(batches):
            for g in _sets(batch.column("text"), size):
                i = _class_id(g) if len(g) else None
                if i is None or i in seen:
                    continue
                seen.add(i)
                sets.append((i, len(g), g[:np.searchsorted(g, _bound(np.array([len(g)]))[0], "right")]))
                total += len(sets[-1][2])
                if total >= BATCH_KEYS or len(sets) >= 60_000:
                    yield _flush(sets, fragments)
                    seen, sets, total = set(), [], 0
        if sets:
            yield _flush(sets, fragments)
    return run


def _flush(sets: list, fragments: int) -> pa.RecordBatch:
    ids = np.array([x[0] for x in sets], np.int64)
    until = _own_bound(np.array([x[1] for x in sets], np.int64))
    keys = [x[2] for x in sets]
    return packed_batch(pack(ids, until, np.array(list(map(len, keys))), np.concatenate(keys), fragments))


def candidate_classes(docs: DataFrame, classes: DataFrame, size: int = WORDS) -> DataFrame:
    """id, n of the classes that may have a link."""
    sizes = classes.where("cls is not null").groupBy(F.col("cls").alias("id")) \
        .agg(F.max("n").alias("n"), F.max("own").alias("own"))
    total, rows = classes.agg(F.coalesce(F.sum("own"), F.lit(0)), F.count("*")).first()
    fragments = max(1, -(-total // FRAGMENT_KEYS))
    packed = docs.select("text").mapInArrow(_packed(fragments, size), PACKED)
    shared = shared_ids(packed, rows)
    need = F.col("own") - F.floor(F.col("n") * (100 - PERCENT) / 100)
    return sizes.join(shared, "id", "left").where(F.coalesce("shared", F.lit(0)) >= need).select("id", "n")


def class_sets(docs: DataFrame, wanted: DataFrame, size: int = WORDS) -> DataFrame:
    """id, n, part of the wanted classes, from one scan of the texts."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(id_filter(wanted.select("id")))

    def run(batches):
        table = np.frombuffer(bits.value, np.int64)
        seen: set = set()
        for batch in _slices(batches):
            ids, parts = [], []
            for g in _sets(batch.column("text"), size):
                if not len(g):
                    continue
                i = _class_id(g)
                if i in seen or not passes(table, np.array([i], np.int64))[0]:
                    continue
                if len(seen) < 100_000:
                    seen.add(i)
                ids.append(i)
                parts.append(g.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())],
                                             names=["id", "part"])
    found = docs.select("text").mapInArrow(run, "id bigint, part binary")
    return wanted.join(found, "id").groupBy("id").agg(F.first("n").alias("n"), F.first("part").alias("part"))


def ngram_groups(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, th, n_shingles, component_id, grp (id of the component; NULL for
    an empty set) per input row."""
    classes = stored(document_classes(docs, size), "classes")
    wanted = stored(candidate_classes(docs, classes, size), "wanted")
    sets = stored(class_sets(docs, wanted, size), "sets")
    keys = stored(prefix_keys(sets, percent), "prefix")
    comps = link(keys, lambda pairs: measured(pairs, sets), lambda rows: set_minus(rows, sets),
                 lambda grams: set_postings(grams, sets), percent)

    members = classes.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"))
    placed = members.join(comps.withColumnRenamed("id", "cls"), "cls", "left") \
        .withColumn("grp", F.coalesce("comp", "cls"))
    smallest = placed.groupBy("grp").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "grp").select("cls", "grp", "component_id")
    return classes.join(named, "cls", "left").select(
        "doc_id", "th", F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "grp")


def ngram_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id per input row."""
    return ngram_groups(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of every component (smallest doc_id, then text hash), with
    all its columns; documents without words stay.  Rows equal in doc_id and
    text are one document."""
    groups = stored(ngram_groups(docs, size, percent).select("doc_id", "th", "grp"), "groups")
    first = groups.where("grp is not null").groupBy("grp").agg(F.min(F.struct("doc_id", "th")).alias("one")) \
        .select("one.*").unionByName(groups.where("grp is null").select("doc_id", "th"))
    kept = marked(docs, first, F.xxhash64("text"), "left_semi")
    return kept.select("row.*")


# The components in DuckDB SQL, for whole tables with distinct doc_ids.
COMPONENTS_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= 80 * (i.n + j.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents
      UNION SELECT r.x, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""
