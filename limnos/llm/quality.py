"""Quality rules (operator 2): hashed n-gram log-likelihood ratio.

Two multinomials over hashed word 1- and 2-grams are counted over whole
tables: the *target* over the documents labelled as good, the *raw* one over
all documents.  A document's score is the sum over its n-grams of
log p_target - log p_raw, divided by the number of n-grams.  A document is
kept when it passes the base rules and its score reaches the threshold.

The rules are DataFrame work; the n-grams are counted in numpy, as their rows
do not fit the limits in a native form (README).  The number of buckets grows with the corpus: one
for every ``LOAD`` distinct n-grams, at every size.  With a fixed number
collisions pull all ratios towards 0 as the vocabulary grows; with a bucket for
each n-gram, those seen in one document only decide, and good documents outside
the target are rejected.

1. A sketch of the distinct n-grams sets the number of buckets.
2. Counts are added up per batch of documents, then, packed, per fragment (range
   of buckets).  Raw counts need no labels; for the target counts the labelled
   documents' texts, compressed, meet their labels in a merge join.
3. A batch's occurrences travel packed to the ratios of each fragment, the partial
   sums of its documents back to the batch.  Only hot buckets, each at least
   1/``HOT`` of all occurrences and so at most ``HOT``, are broadcast and summed
   where they are read.

Fragments are salted, so neither a hot source nor a hot word nor a large corpus
makes a large group (``ngram_counts``).  Ratios are fixed-point integers: sums do
not depend on the order of addition, so the verdict is the same on every run.
Batches are numbered by partition and order, so ``docs`` must be a table read
from files (store a computed one first): a task that runs again sees the same rows.

Defined cases: NULL or empty text has no words and fails the base rules with
score 0.  Rows that repeat a doc_id are judged one by one; equal rows get
equal results.  A NULL doc_id or label joins with nothing.  With no labelled
document the ratio is uniform smoothing on the target side.  Conflicting
labels of one doc_id: good if any row says so.  An empty table gives no rows.  Only
``doc_id`` and ``text`` are read; ``keep_good`` returns all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm import ngram_counts as counts
from limnos.llm.common import marked, stored, words
from limnos.llm.similarity import id_filter

LOAD = 8                # distinct n-grams a bucket
HOT = 1 << 18           # buckets broadcast at most
THRESHOLD = -0.25       # mean log ratio per n-gram
MIN_WORDS = 50
SCALE = 1 << 20         # fixed-point unit of a log ratio
SYMBOLS = "#*$%&|<>"


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash) and the rule inputs, one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    staged = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", words(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("ln"))
    # hash of the 3-word window at each position (the last two are cut off)
    grams = staged.withColumn("g", F.when(F.size("w") >= 3, F.slice(F.transform(
        "w", lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2))),
        F.lit(1), F.greatest(F.size("w") - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    # windows in hash order; only rows with a repeated hash pay for the sort
    ordered = grams.withColumn("s", F.when(
        F.size(F.array_distinct("g")) < F.size("g"),
        F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    repeated = ordered.withColumn("p", F.sort_array(F.filter(F.transform(
        "s", lambda x, j: F.when(
            F.coalesce(F.get("s", j - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get("s", j + 1)["h"] == x["h"], F.lit(False)), x["i"])),
        lambda i: i.isNotNull())))
    # words covered by repeated windows: each adds up to the next one's start
    covered = F.aggregate(
        F.transform("p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1), p + 3) - p)),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return repeated.select(
        "doc_id", text_hash().alias("th"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"))


def corpus_sketch(docs: DataFrame) -> tuple[int, int]:
    """Distinct n-grams, by a sketch, and the number of all n-grams of ``docs``."""
    top = docs.select("text").mapInArrow(counts.sketch, "register long, rank long, n long") \
        .groupBy("register").agg(F.max("rank").alias("rank"), F.sum("n").alias("n")).toArrow()
    return counts.distinct(top.column("rank").to_numpy()), sum(top.column("n").to_pylist())


def bucket_count(docs: DataFrame) -> int:
    """Buckets for the n-grams of ``docs``, from a sketch of their distinct number."""
    return max(1, corpus_sketch(docs)[0] // LOAD)


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int, total: int) -> DataFrame:
    """Packed raw and target counts of all buckets in use, one row a fragment.

    ``trusted`` holds the doc_ids of the target documents.  Raw counts need no
    labels; for the target counts only documents whose id may be in a bitmap of
    the labelled ids travel to their labels.
    """
    good = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(good.select(F.xxhash64("doc_id").alias("id"))))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", F.xxhash64("doc_id").alias("id"), "text") \
        .mapInArrow(counts.candidates(bits), "doc_id long, packed binary")
    # one way to join at every size: labels grow with the documents
    target = narrow.join(good.hint("merge"), "doc_id", "left_semi").select("packed").mapInArrow(counts.unpacked, "text string")
    parts = counts.salts(total, buckets)
    both = docs.select("text").mapInArrow(counts.count_batches(buckets, parts, False), counts.COUNTS).unionByName(
        target.mapInArrow(counts.count_batches(buckets, parts, True), counts.COUNTS))
    summed = both.groupBy("frag", "salt").applyInArrow(counts.sum_counts(buckets), counts.COUNTS)
    if parts > 1:
        summed = summed.groupBy("frag").applyInArrow(counts.sum_counts(buckets), counts.COUNTS)
    return stored(summed.groupBy("frag").applyInArrow(counts.both_sides, counts.RATIOS), "buckets")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """bucket, r, hot: fixed-point log(p_target / p_raw), one row per bucket in use."""
    table = bucket_counts(docs, trusted, buckets, corpus_sketch(docs)[1])
    return table.mapInArrow(counts.ratio_rows(buckets, *totals(table), SCALE, HOT), "bucket long, r long, hot boolean")


def totals(table: DataFrame) -> tuple[int, int]:
    found = table.agg(F.sum("t_raw"), F.sum("t_target")).first()
    return found[0] or 0, found[1] or 0


def score_documents(docs: DataFrame, table: DataFrame, buckets: int) -> DataFrame:
    """doc_id, th, llr: mean log ratio per n-gram (0 without words), from ``bucket_counts``."""
    sums = totals(table)
    parts = counts.salts(sums[0], buckets)
    hot = table.mapInArrow(counts.ratio_rows(buckets, *sums, SCALE, HOT), "bucket long, r long, hot boolean") \
        .where("hot").toArrow().sort_by("bucket")
    shared = docs.sparkSession.sparkContext.broadcast((hot.column("bucket").to_numpy(), hot.column("r").to_numpy()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text")
    rows = texts.mapInArrow(counts.occurrences(buckets, parts, shared), counts.MEET)
    ratios = table.mapInArrow(counts.packed_ratios(buckets, *sums, SCALE, parts), counts.MEET)
    found = rows.unionByName(ratios).groupBy("frag", "salt").applyInArrow(counts.partial_sums(buckets), counts.MEET)
    scores = found.groupBy("batch").applyInArrow(counts.document_scores, counts.SCORES)
    # rows equal in doc_id and text have the same score
    return scores.groupBy("doc_id", "th").agg(F.first(F.col("s") / F.greatest("n", F.lit(1)) / SCALE).alias("llr"))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: rule inputs, llr, base_failed and kept."""
    distinct, total = corpus_sketch(docs)
    buckets = buckets or max(1, distinct // LOAD)
    scores = score_documents(docs, bucket_counts(docs, trusted, buckets, total), buckets)
    f, s = base_features(docs).alias("f"), scores.alias("s")
    joined = f.join(s, F.col("f.doc_id").eqNullSafe(F.col("s.doc_id"))
                    & (F.col("f.th") == F.col("s.th")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    llr = F.coalesce(F.col("s.llr"), F.lit(0.0))
    return joined.select(
        F.col("f.doc_id").alias("doc_id"), F.col("f.th").alias("th"), "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", llr.alias("llr"), failed.alias("base_failed"),
        (~failed & (llr >= F.lit(threshold))).alias("kept"))


def keep_good(docs: DataFrame, trusted: DataFrame, buckets: int | None = None,
              threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns."""
    # written first: a filter on the verdict would be pushed into the rule
    # expressions, which the optimizer then evaluates once per word
    verdicts = stored(quality_rules(docs, trusted, buckets, threshold).select("doc_id", "th", "kept"), "verdicts")
    kept = marked(docs, verdicts.where("kept"), text_hash(), "left_semi")
    return kept.select("row.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality") == 1).select("doc_id")
