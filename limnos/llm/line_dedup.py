"""Line dedup (operator 6): fuzzy lines by MinHash, one line per component.

A line is a piece between line breaks that holds a word; equal lines are one
item, named by the 64-bit hash of its text.  Items get MinHash signatures over
their 6-character shingles, cut into 16 bands of 6: a pair of similarity 0.8
shares a band with probability 0.99.  Lines of at most ``FEW`` distinct shingles
get a full MinHash, one hash function per value; longer ones one permutation
(empty bins are filled from the next one), which is as good only where few bins
stay empty.  Lines of 0.8 ``FEW`` to ``FEW`` get both, so similar lines have one in
common.  Items that share a band are compared exactly on their
shingle sets and those of Jaccard similarity 0.8 or more are linked; union-find
gives the components.  Of every component the first line (smallest doc_id,
then text hash, then position) stays, the others go.

Band keys travel packed and only to find the items that share one; the lines
themselves are gathered for those items alone.  A common line is one item from the
first batch on, its occurrences are reduced by partial aggregation, and the
kept line is joined back to them (a skewed side that can be split).

Defined cases: NULL text stays NULL and has no lines.  Blank lines are never
removed.  A document all of whose lines go is dropped by ``dedup_lines``.  Rows
equal in doc_id and text are kept or cut alike.  NULL doc_ids sort first.
Lines shorter than 6 characters match only when equal.  Long texts and lines
are hashed in blocks.  Other columns pass through, whatever their names.  An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import marked, stored
from limnos.llm.similarity import (FRAGMENT_KEYS, PACKED, bitmaps, id_filter, link, pack, packed_batch, passes,
                                   shared_ids)
from limnos.llm.vectors import _Q, U, char_shingles, mix

CHARS = 6
BANDS = 16
ROWS = 6
BINS = BANDS * ROWS
FEW = 125               # distinct shingles of a line that gets a full MinHash
FULL = 90               # filled bins from which a line has more than FEW
CHUNK = 1 << 15
PERCENT = 80
BLANK = " \t\n\x0b\x0c\r"
EMPTY = U(0xFFFFFFFFFFFFFFFF)
FLUSH_CHARS = 1 << 21


def line_id(line: str) -> int:
    """Equals Spark's xxhash64 of the line."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def windows(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line numbers of the characters ``c`` (from 0, a break belongs to the line after it), and
    hashes and places of the windows of CHARS characters of one line, as in ``char_shingles``."""
    breaks = c == 10
    number = np.cumsum(breaks)
    m = max(0, len(c) - CHARS + 1)
    whole = np.flatnonzero((number[:m] == number[CHARS - 1:]) & ~breaks[:m])
    wide = c.astype(np.uint64)
    h = wide[:m] * _Q[1]
    for k in range(1, CHARS):
        h += wide[k:m + k] * _Q[k + 1]
    return number, mix(h[whole]), whole


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation MinHash over character shingles, one row per line, and
    the number of bins that were filled by the line's own shingles."""
    sig = np.full(len(lines) * BINS, EMPTY, np.uint64)
    code = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    line = 0
    for at in range(0, len(code), CHUNK):
        c = code[at:at + CHUNK + CHARS - 1]
        number, h, whole = windows(c)
        number += line
        line = int(number[min(CHUNK, len(c)) - 1])
        # 24 bits: their remainder is the same in 32 bits, where it costs less
        bins = (h >> U(40)).astype(np.uint32) % np.uint32(BINS)
        np.minimum.at(sig, number[whole] * BINS + bins, h)
    sig = sig.reshape(len(lines), BINS)
    for i in np.flatnonzero((sig == EMPTY).all(axis=1)).tolist():
        sig[i, 0] = char_shingles(lines[i], CHARS)[0]
    filled = (sig != EMPTY).sum(axis=1)
    todo = np.flatnonzero(filled < BINS)
    while len(todo):
        part = sig[todo]
        right = np.roll(part, -1, axis=1)
        fill = (part == EMPTY) & (right != EMPTY)
        part[fill] = right[fill] + _Q[50]
        sig[todo] = part
        todo = todo[(part == EMPTY).any(axis=1)]
    return sig, filled


def band_keys(sig: np.ndarray) -> np.ndarray:
    # a band takes bins far apart: neighbours may have been filled from one value
    parts = (sig.reshape(len(sig), ROWS, BANDS) * _Q[1:1 + ROWS, None]).sum(axis=1)
    return mix(parts + np.arange(1, BANDS + 1, dtype=np.uint64) * _Q[51])


_random = np.random.default_rng(20240601)
_XOR = _random.integers(0, 1 << 63, BINS, dtype=np.uint64) * U(2)
_TIMES = _random.integers(1, 1 << 63, BINS, dtype=np.uint64) | U(1)


def line_shingles(lines: list[str]):
    """(from, to, hashes, sizes): the shingles of ``char_shingles`` of all lines, some lines at
    a time: distinct in each line, one line after the other, and their number per line."""
    # whole lines of about CHUNK characters, so that the work stays in the cache
    ends = np.cumsum([len(x) + 1 for x in lines])
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        c = np.frombuffer("\n".join(lines[at:to]).encode("utf-32-le", "surrogatepass"), np.uint32)
        number, h, whole = windows(c)
        line = number[whole]
        short = [i for i in range(at, to) if len(lines[i]) < CHARS]
        if short:
            h = np.concatenate([h, *[char_shingles(lines[i], CHARS) for i in short]])
            line = np.concatenate([line, np.array(short, np.int64) - at])
        # equal shingles of a line side by side: both in one number
        both = h + line.astype(np.uint64) * _Q[53]
        order = np.argsort(both)
        both = both[order]
        first = np.ones(len(h), bool)
        first[1:] = both[1:] != both[:-1]
        chosen = np.sort(order[first])
        if short:
            chosen = chosen[np.argsort(line[chosen], kind="stable")]
        yield at, to, h[chosen], np.bincount(line[chosen], minlength=to - at)
        at = to


def few_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles of every line, and the full MinHash, one row per line."""
    sizes = np.zeros(len(lines), np.int64)
    sig = np.full((len(lines), BINS), EMPTY, np.uint64)
    for at, to, h, n in line_shingles(lines):
        sizes[at:to] = n
        h, rows = h[np.repeat(n <= FEW, n)], at + np.flatnonzero(n <= FEW)
        if not len(rows):
            continue
        starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
        for k in range(BINS):
            sig[rows, k] = np.minimum.reduceat((h ^ _XOR[k]) * _TIMES[k], starts)
    return sizes, sig


def line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of all lines, one line after the other, and their number per line."""
    sig, filled = signatures(lines)
    long = band_keys(sig)
    few = np.flatnonzero(filled < FULL)
    sizes, full = few_shingles([lines[i] for i in few.tolist()])
    use = np.ones((len(lines), 2 * BANDS), bool)
    use[:, BANDS:] = False
    use[few[sizes <= FEW], BANDS:] = True
    use[few[100 * sizes < PERCENT * FEW], :BANDS] = False
    keys = np.zeros((len(lines), 2 * BANDS), np.uint64)
    keys[:, :BANDS] = long
    keys[few, BANDS:] = mix(band_keys(full) + _Q[52])
    return keys[use], use.sum(axis=1)


def _lines(batches, table: np.ndarray | None = None):
    """Dicts of id to line of distinct lines, about FLUSH_CHARS at a time; with
    a filter ``table``, of the lines that pass it."""
    seen: dict[int, str] = {}
    total = 0
    for batch in batches:
        lines = [x for text in batch.column("text").to_pylist() if text for x in text.split("\n") if x.strip(BLANK)]
        ids = [line_id(x) for x in lines]
        if table is not None and ids:
            good = np.flatnonzero(passes(table, np.array(ids, np.int64))).tolist()
            ids, lines = [ids[k] for k in good], [lines[k] for k in good]
        for i, line in zip(ids, lines):
            if i not in seen:
                seen[i] = line
                total += len(line)
                if total >= FLUSH_CHARS or len(seen) >= 60_000:
                    yield seen
                    seen, total = {}, 0
    if seen:
        yield seen


def _packed(fragments: int):
    def run(batches):
        for found in _lines(batches):
            ids, lines = np.array(list(found), np.int64), list(found.values())
            keys, counts = line_keys(lines)
            yield packed_batch(pack(ids, np.full(len(ids), EMPTY), counts, keys, fragments))
    return run


def line_occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash), pos, id of every line that holds a word."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"),
                       F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line")) \
        .where(F.col("line").rlike("[^ \\t\\n\\x0B\\f\\r]")) \
        .select("doc_id", "th", "pos", F.xxhash64("line").alias("id"))


def _known(cache: dict, line: str) -> np.ndarray:
    if line not in cache:
        if len(cache) >= 5_000:
            cache.clear()
        cache[line] = char_shingles(line, CHARS)
    return cache[line]


def _overlap(batches):
    """a, na, b, nb, lead with the number of shingles that lines ta and tb share."""
    cache: dict[str, np.ndarray] = {}
    for batch in batches:
        common = [len(np.intersect1d(_known(cache, x), _known(cache, y), assume_unique=True))
                  for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())]
        kept = batch.drop_columns(["ta", "tb"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(common, pa.int64())], names=[*kept.schema.names, "common"])


def line_components(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """id, comp of every line that has a similar but different line.

    ``counted``: id and number of occurrences (c); the most frequent line of a
    band leads its star.
    """
    n_lines = counted.count()
    fragments = max(1, -(-n_lines * BANDS // FRAGMENT_KEYS))
    shared = shared_ids(docs.select("text").mapInArrow(_packed(fragments), PACKED), n_lines).select("id")
    wanted = stored(counted.join(shared, "id").select("id", (-F.col("c")).alias("rank")), "lines")
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("id")))

    def build(batches):
        for found in _lines(batches, np.frombuffer(bits.value, np.int64)):
            lines = list(found.values())
            sizes, bits_of = [], []
            for _, _, h, n in line_shingles(lines):
                sizes += n.tolist()
                bits_of += bitmaps(h, n)
            keys, counts = line_keys(lines)
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()),
                                             pa.array(keys.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array(sizes, pa.int64()), pa.array(lines, pa.string()),
                 bands,
                 pa.array(bits_of, pa.list_(pa.int64()))], names=["id", "n", "line", "bands", "bits"])
    built = docs.select("text").mapInArrow(
        build, "id bigint, n bigint, line string, bands array<bigint>, bits array<bigint>")
    items = stored(built.join(wanted, "id").groupBy("id").agg(
        F.first("n").alias("n"), F.first("line").alias("line"), F.first("bands").alias("bands"),
        F.first("bits").alias("bits"), F.first("rank").alias("rank")), "items")
    keys = stored(items.select(F.explode("bands").alias("key"), "id", "n", F.col("n").alias("m"), "rank").distinct(), "bands")
    texts = items.select("id", "line")

    def measure(pairs):
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("ta")), "a") \
            .join(texts.select(F.col("id").alias("b"), F.col("line").alias("tb")), "b").select(*pairs.columns, "ta", "tb")
        fields = ", ".join(f"{c} bigint" for c in [*pairs.columns, "common"])
        return both.sortWithinPartitions("a").mapInArrow(_overlap, fields)
    return link(keys, measure, percent=PERCENT, bits=items.select("id", "bits", F.col("bands").alias("keys")))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, removed: positions of the lines that go, for documents that
    lose any."""
    lines = stored(line_occurrences(docs), "occurrences")
    where = F.struct("doc_id", "th", "pos")
    counted = stored(lines.groupBy("id").agg(F.min(where).alias("first"), F.count("*").alias("c")), "counted")
    comps = line_components(docs, counted)
    # the kept occurrence of every line that occurs again or has a similar line
    again = counted.join(comps, "id", "left").where("c > 1 or comp is not null") \
        .select("id", F.coalesce("comp", "id").alias("g"), "first")
    again = stored(again, "again")
    kept = again.join(again.groupBy("g").agg(F.min("first").alias("kept")), "g").select("id", "kept")
    return lines.join(kept, "id").where(~where.eqNullSafe(F.col("kept"))) \
        .groupBy("doc_id", "th").agg(F.collect_set("pos").alias("removed"))


def cut_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (all columns as they were), text (cut) and removed (positions of the lines that went, or NULL)."""
    found = marked(docs, removed_lines(docs), F.xxhash64("text"), "left", gone="removed")
    kept = F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    return found.select("row.doc_id", "row", F.col("gone").alias("removed"), F.when(F.col("gone").isNull(), F.col("row.text"))
                        .otherwise(F.array_join(kept, "\n")).alias("text"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with cut texts; those left without any word are dropped."""
    cut = cut_lines(docs).where(F.col("removed").isNull() | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    own = {"text": F.col("text"), "n_chars": F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(
        F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    return cut.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
