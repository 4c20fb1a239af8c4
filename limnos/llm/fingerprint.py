"""Document fingerprints (operator 5): homomorphic multiset hash of paragraphs.

A paragraph is a non-empty piece between line breaks or sentence ends (one rule for
pieces of any length), so that texts written in one piece compare by their parts
too.  A paragraph's SHA-256 seeds ``WORDS`` 64-bit hashes whose bytes are a
vector of ``LANES`` signed 8-bit values, scaled by the paragraph's length; a
text's fingerprint is the sum of its paragraphs' vectors, each lane modulo
2^32.  So the order of paragraphs does not matter, equal multisets of
paragraphs have equal fingerprints, and paragraphs are inserted or deleted by
adding or subtracting their vectors (``combine``) without the rest of the text.
Since lanes are zero-mean, the inner product of two fingerprints estimates
the length-weighted overlap of their paragraphs; ``likeness`` is
2<a,b> / (<a,a> + <b,b>), cut to 0..1.

A row's fingerprint is worked out once, before the texts are shuffled, and serves
as its own and as that of somebody's next document.  That of an edited text comes
from it: the paragraphs from the cut on are deleted, those of the new ending inserted.

Everything is DataFrame expressions over one row; the neighbour of a document
is found by a windowed lead over ranges of doc_id, whose number follows the
table, and the only texts that move are one copy by doc_id and the replaced prefixes.

Defined cases: NULL text is the empty text; the empty text has the zero
fingerprint, likeness 1 to another empty text and 0 to any other.  The next
document of a row is the one of the next smaller doc_id (after the smallest:
the largest, which is the row's own when there is one doc_id only).  If rows
repeat a doc_id, each is a result row, and as somebody's next document the
one with the smallest text stands for all.  A row with NULL doc_id has no next
document: its edited text loses its tail and gains nothing, its near_next is
0.  An empty table gives an empty result.  Only doc_id and text are read, whatever
the other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.common import stored

LANES = 128
WORDS = LANES // 8      # hashes of a paragraph, eight lanes each
MODULUS = 1 << 32
RANGE = 1 << 20         # doc_ids in a range of the neighbour search, about

# Fixed rule: line breaks, and the blanks after the end of a sentence
BREAK = r"\n|(?<=[.!?]) +"


TEXT = "coalesce(text, '')"


def pieces(text: str) -> str:
    """SQL: the text cut at its breaks, empty pieces included."""
    return f"split({text}, r'{BREAK}', -1)"


def vectors(array: str) -> str:
    """SQL: for each non-empty piece its hashes (h) and length in code points (n)."""
    seeds = (f"transform(filter({array}, p -> p <> ''), p -> named_struct("
             "'d', unhex(sha2(cast(p AS binary), 256)), 'n', cast(length(p) AS bigint)))")
    return f"transform({seeds}, x -> named_struct('h', transform(sequence(1, {WORDS}), w -> xxhash64(x.d, w)), 'n', x.n))"


def lanes(column: str) -> str:
    """SQL: sum of the vectors in a column, modulo 2^32 per lane.

    Per hash the paragraphs' lengths and that hash are laid side by side once; each
    of its eight lanes is then a sum of length times byte, less 128 times all lengths.
    The column stands several times in it, so the planner keeps it as a column of
    its own instead of copying its expression into the loop over lanes.
    """
    sides = (f"transform(sequence(0, {WORDS - 1}), w -> named_struct("
             f"'p', transform({column}, x -> named_struct('n', x.n, 'k', get(x.h, w))), "
             f"'m', 128L * aggregate({column}, 0L, (s, x) -> s + x.n)))")
    one = "aggregate(q.p, 0L, (s, y) -> s + y.n * (shiftright(y.k, b) & 255L)) - q.m"
    every = f"flatten(transform({sides}, q -> transform(array(0, 8, 16, 24, 32, 40, 48, 56), b -> pmod({one}, {MODULUS}L))))"
    return f"CASE WHEN size({column}) = 0 THEN array_repeat(0L, {LANES}) ELSE {every} END"


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint after inserting (sign 1) or deleting (-1) what ``b`` hashes."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS)))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda a: F.lpad(F.lower(F.hex(a)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Likeness of two columns of fingerprints."""
    centred = lambda x: f"cast(CASE WHEN {x} >= {MODULUS // 2}L THEN {x} - {MODULUS}L ELSE {x} END AS double)"
    sums = (f"aggregate(zip_with({a}, {b}, (x, y) -> named_struct('x', {centred('x')}, 'y', {centred('y')})), "
            "named_struct('xy', 0.0D, 'size', 0.0D), (s, v) -> named_struct("
            "'xy', s.xy + v.x * v.y, 'size', s.size + v.x * v.x + v.y * v.y), "
            "s -> CASE WHEN s.size = 0 THEN 1.0D ELSE least(1.0D, greatest(0.0D, 2 * s.xy / s.size)) END)")
    return F.expr(sums)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint (array of lanes) per row."""
    rows = docs.selectExpr("doc_id", f"{TEXT} AS text")
    return rows.selectExpr("doc_id", "cast(length(text) AS bigint) AS n_chars", f"{vectors(pieces('text'))} AS v") \
        .selectExpr("doc_id", "n_chars", f"{lanes('v')} AS fingerprint")


def next_ids(ids: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, next_id over distinct doc_ids in descending order, wrapping.

    ids are cut into ranges; the lead within a range is a window, and the
    largest id of every range (one row a range) closes the gaps between them.
    """
    spark = ids.sparkSession
    parts = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // RANGE))
    # written once: range bounds are sampled per execution
    placed = stored(ids.repartitionByRange(parts, "doc_id").select("doc_id", F.spark_partition_id().alias("range")), "ranges")
    tops = placed.groupBy("range").agg(F.max("doc_id").alias("top"))
    below = F.lag("top").over(Window.orderBy("top"))
    after = tops.select("range", F.coalesce(below, F.max("top").over(Window.partitionBy())).alias("after"))
    lead = F.lead("doc_id").over(Window.partitionBy("range").orderBy(F.col("doc_id").desc()))
    return placed.withColumn("lead", lead).join(F.broadcast(after), "range") \
        .select("doc_id", F.coalesce("lead", "after").alias("next_id"))


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each row with its fingerprint, the edited text's and their likeness."""
    base = docs.selectExpr("doc_id", f"{TEXT} AS text", f"{vectors(pieces(TEXT))} AS v") \
        .selectExpr("doc_id", "text", f"transform({lanes('v')}, a -> cast(a - {MODULUS // 2}L AS int)) AS fp")
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id") \
        .agg(F.expr("max(cast(floor(coalesce(length(text), 0) / 3) AS int)) AS k"))
    asked = next_ids(ids.select("doc_id"), ranges).join(ids, "doc_id") \
        .select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("receiver"), "k")
    given = base.join(asked, "doc_id").selectExpr("receiver", "named_struct('head', left(text, k), 'fp', fp) AS next") \
        .groupBy("receiver").agg(F.min("next").alias("next"))
    # both joins read the same rows in the same layout, so one exchange of the
    # texts serves them; rows without doc_id have no neighbour to join
    known = base.where(F.col("doc_id").isNotNull()).join(given, F.col("doc_id") == F.col("receiver"), "left") \
        .select("doc_id", "text", "fp", "next")
    lone = base.where(F.col("doc_id").isNull()).withColumn("next", F.lit(None).cast(given.schema["next"].dataType))
    own = known.unionByName(lone).selectExpr("doc_id", "text", "fp", "next", "length(text) AS n", "cast(floor(length(text) / 3) AS int) AS k")
    edited = own.selectExpr("doc_id", "text", "n", "fp", "next.fp AS nfp", "left(text, n - k) AS stem",
                            "concat(left(text, n - k), coalesce(left(next.head, k), '')) AS edited")
    # the pieces before the cut are the same in both texts: all of the stem's but its last
    cut = edited.selectExpr("doc_id", "n", "fp", "nfp", "edited", f"{pieces('text')} AS old", f"{pieces('edited')} AS new",
                            f"size({pieces('stem')}) AS at")
    tails = cut.selectExpr("doc_id", "cast(n AS bigint) AS n_chars", "sha2(cast(edited AS binary), 256) AS edited_sha256", "fp", "nfp",
                           f"{vectors('slice(old, at, greatest(size(old) - at + 1, 0))')} AS gone",
                           f"{vectors('slice(new, at, greatest(size(new) - at + 1, 0))')} AS come")
    wide = lambda c: f"transform({c}, a -> cast(a AS bigint) + {MODULUS // 2}L)"
    summed = tails.selectExpr("doc_id", "n_chars", "edited_sha256", f"{wide('fp')} AS fp", f"{wide('nfp')} AS nfp",
                              f"{lanes('gone')} AS gone", f"{lanes('come')} AS come")
    changed = summed.withColumn("efp", combine(combine(F.col("fp"), F.col("gone"), -1), F.col("come")))
    return changed.select(
        "doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"),
        F.when(F.col("nfp").isNull(), F.lit(0.0)).otherwise(likeness("fp", "nfp")).alias("near_next"))
