"""Secret scans (operator 8): base patterns plus corpus-wide ownership frequency.

Every whole text is scanned for three base kinds (assign, access, hex) and for
further candidates: long mixed-case tokens.  The values found are hashed and
counted over the whole corpus by distinct repositories and distinct owners.  A
value seen at few owners and in few repositories looks like a live credential of
its owner; one that many owners carry, or that is spread over many
repositories, even of one owner, is a copied example.  Base spans always stay; a
token candidate is added as a span of kind ``token`` when its value is
owner-specific and it overlaps no base span.

The texts are scanned once: spans and value hashes are written, and the counts and
verdicts are worked out from that narrow table.

All expressions are DataFrame functions.  Positions follow from the pieces
between matches (split) and the matches (regexp_extract_all) of one pattern.
Only values (hashes) are shuffled, after a distinct per task, so a value that
a third of all rows carry is reduced before it moves; the counts are joined
back by value hash, and the spans of a row by (doc_id, text hash).

Defined cases: NULL or empty text has no spans.  Rows that repeat doc_id and
text get equal results.  NULL owner or repository counts as one owner or
repository of its own.  Lengths are never cut; offsets are code points, end
exclusive.  Columns other than doc_id, text and the two named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import stored

# The base patterns (the minimum length is applied afterwards to
# `assign`, whose failing matches still consume their text).
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
MIN_VALUE = 6
KINDS = ["assign", "access", "hex", "token"]
COPY_OWNERS = 3         # a value at this many owners is a copied example,
COPY_REPOSITORIES = 6   # as is one in this many repositories

SPAN = "array<struct<s:int,k:int,e:int,v:bigint>>"


def spans(text: Column, pattern: str, kind: int, group: int = 0, keep=None) -> Column:
    """Kept matches as (start, kind, end, value hash), in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    parts = F.zip_with(F.arrays_zip(found.alias("m"), value.alias("x")), gaps, lambda a, g: F.struct(
        F.length(g).alias("g"), F.length(a["m"]).alias("n"), F.xxhash64(a["x"]).alias("v"),
        (keep(a["x"]) if keep else F.lit(True)).alias("ok")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    walked = F.aggregate(parts, empty, lambda acc, x: F.struct(
        (acc["at"] + x["g"] + x["n"]).alias("at"),
        F.when(x["ok"], F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + x["g"]).alias("s"), F.lit(kind).alias("k"),
            (acc["at"] + x["g"] + x["n"]).alias("e"), x["v"].alias("v"))))).otherwise(acc["out"]).alias("out")))
    return F.when(text.rlike(pattern), walked["out"]).otherwise(F.array().cast(SPAN))


def as_text(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "repository") -> DataFrame:
    """doc_id, th, owner, repository, base and candidate spans of each row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.col(owner).cast("string").alias("o"), F.col(repository).cast("string").alias("r"))
    text = F.col("text")
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")
    found = rows.select(
        "doc_id", F.xxhash64("text").alias("th"), "o", "r",
        spans(text, ASSIGN, 0, 2, lambda x: F.length(x) >= MIN_VALUE).alias("a"),
        spans(text, ACCESS, 1).alias("c"), spans(text, HEX, 2).alias("h"),
        spans(text, TOKEN, 3, 0, mixed).alias("t"))
    based = found.select("doc_id", "th", "o", "r", F.size("a").alias("n_assign"), F.size("c").alias("n_access"),
                         F.size("h").alias("n_hex"), F.array_sort(F.concat("a", "c", "h")).alias("base"), "t")
    return based.withColumn("extra", F.filter("t", lambda x: ~F.exists(
        "base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))).drop("t")


def ownership(scanned: DataFrame) -> DataFrame:
    """v (value hash), n_owners, n_repositories, n_seen over the whole corpus."""
    values = scanned.select(F.explode_outer(F.concat("base", "extra")).alias("x"), "o", "r") \
        .select(F.col("x.v").alias("v"), "o", "r").where(F.col("v").isNotNull())
    # NULL owners and repositories are groups of their own
    places = values.groupBy("v", "o", "r").agg(F.count("*").alias("n"))
    by_owner = places.groupBy("v", "o").agg(F.sum("n").alias("n")) \
        .groupBy("v").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_seen"))
    by_repository = places.groupBy("v", "r").agg(F.count("*").alias("n")).groupBy("v").agg(F.count("*").alias("n_repositories"))
    return by_owner.join(by_repository, "v")


def secret_scan(docs: DataFrame, owner: str = "source", repository: str = "repository",
                copy_owners: int = COPY_OWNERS, copy_repositories: int = COPY_REPOSITORIES) -> DataFrame:
    """One row per input row: counts, base and final spans, owner-specific and
    widely copied values, and the most owners and repositories of any of its values."""
    scanned = stored(scan(docs, owner, repository), "secrets")
    freq = ownership(scanned)
    one = scanned.select("doc_id", "th", F.explode_outer(F.concat("base", "extra")).alias("x")).distinct() \
        .withColumn("v", F.col("x.v")).where(F.col("v").isNotNull())
    live = (F.col("n_owners") < copy_owners) & (F.col("n_repositories") < copy_repositories)
    judged = one.join(freq, "v").groupBy("doc_id", "th").agg(
        F.count(F.when(live, 1)).alias("n_live"), F.count(F.when(~live, 1)).alias("n_copied"),
        F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"),
        F.collect_list(F.when(live & (F.col("x.k") == 3), F.col("x"))).alias("added"))
    s, j = scanned.alias("s"), judged.alias("j")
    joined = s.join(j, F.col("s.doc_id").eqNullSafe(F.col("j.doc_id")) & (F.col("s.th") == F.col("j.th")), "left")
    none = F.array().cast(SPAN)
    zero = F.lit(0).cast("long")
    return joined.select(
        F.col("s.doc_id").alias("doc_id"), F.col("n_assign").cast("long").alias("n_assign"),
        F.col("n_access").cast("long").alias("n_access"), F.col("n_hex").cast("long").alias("n_hex"), "base",
        F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_copied", "most_owners", "most_repositories")])
