"""Packed n-gram counts and scores for the quality rules (operator 2).

Word 1- and 2-grams are hashed as Spark's ``xxhash64`` does, in numpy on whole
Arrow buffers, and fall into ``buckets`` by their hash.  Buckets are cut into
fragments (ranges); what travels is one row per fragment and batch of documents:

* counts: the batch's distinct buckets as differences and their counts;
* occurrences: (document, bucket) in order, as differences;
* partial sums of a fragment: documents of the batch and their sums.

Numbers are laid out byte by byte and compressed, one to two bytes an entry.
Fragments are salted by batch, so a group's size does not grow with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext

from limnos.llm.similarity import passes
from limnos.llm.vectors import _WS, U, _blocks, mix, span_blocks, text_buffer

GRAMS = 1 << 20             # n-grams of one batch of documents, about: an executor holds one a core
FRAGMENT = 1 << 18          # buckets of a fragment at least
FRAGMENTS = 1 << 10         # fragments, until they would be larger than
LARGEST = 1 << 22           # this many buckets
GROUP = 1 << 24             # entries of a salted fragment, about
REGISTERS = 14              # log2 of the sketch's registers
SEED = 42                   # of Spark's xxhash64

# The primes of XXH64.
P1, P2, P3, P4, P5 = (U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x85EBCA77C2B2AE63),
                      U(0x27D4EB2F165667C5))


def fragment_size(buckets: int) -> int:
    return min(max(FRAGMENT, -(-buckets // FRAGMENTS)), LARGEST)


def salts(total: int, buckets: int) -> int:
    """Parts of every fragment, so that each gets about GROUP of all entries."""
    return max(1, -(-total // (GROUP * -(-buckets // fragment_size(buckets)))))


def _turn(h: np.ndarray, left: int) -> np.ndarray:
    return (h << U(left)) | (h >> U(64 - left))


def _lane(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _turn(h ^ (_turn(word * P2, 31) * P1), 27) * P1 + P4


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


def span_xxhash(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: list, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of each span of ``b`` with its own seed; spans are taken by length."""
    n = ends - starts
    out = np.empty(len(n), np.uint64)
    size = np.minimum(n, 32).astype(np.uint8)
    order = np.argsort(size, kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(size, minlength=33)))
    for length in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[length]:cuts[length + 1]]
        if length == 32:
            for i in at.tolist():
                out[i] = xxhash.xxh64_intdigest(b[starts[i]:ends[i]].tobytes(), int(seeds[i]))
            continue
        h = seeds[at] + (P5 + U(length))
        for k in range(length // 8):
            h = _lane(h, blocks[k][at])
        rest = length % 8
        if rest:
            tail = blocks[length // 8][at]
            if rest >= 4:
                h ^= (tail & U(0xFFFFFFFF)) * P1
                h = _turn(h, 23) * P2 + P3
                tail >>= U(32)
            for k in range(rest % 4):
                h ^= ((tail >> U(8 * k)) & U(255)) * P5
                h = _turn(h, 11) * P1
        out[at] = _finish(h)
    return out


def grams(column: pa.Array):
    """(hashes, rows): 1- and 2-gram hashes of the texts, block by block."""
    data, offsets = text_buffer(column)
    before, row_before = U(0), -1
    for lo, hi in _blocks(data, offsets):
        b = data[lo:hi]
        word = ~_WS[b]
        edge = np.zeros(hi - lo + 1, bool)
        edge[offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi, "right")] - lo] = True
        edge[0] = edge[-1] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            continue
        row = np.searchsorted(offsets, starts + lo, "right") - 1
        blocks = span_blocks(b, starts, ends)
        one = span_xxhash(b, starts, ends, blocks, np.full(len(starts), SEED, np.uint64))
        # the second word is hashed with the first word's hash as its seed
        pair = np.flatnonzero(np.append(row_before, row[:-1]) == row)
        two = span_xxhash(b, starts[pair], ends[pair], [x[pair] for x in blocks], np.append(before, one[:-1])[pair])
        before, row_before = one[-1], row[-1]
        yield np.concatenate([one, two]), np.concatenate([row, row[pair]])


def sketch(batches):
    """register, rank, n: a HyperLogLog sketch of a task's distinct n-grams and their
    number, with the registers that Spark's approx_count_distinct has at an error of 0.01."""
    top, n = np.zeros(1 << REGISTERS, np.int32), 0
    for batch in batches:
        for h, _ in grams(batch.column("text")):
            n += len(h)
            h = _finish(_lane(np.full(1, U(SEED + 8) + P5), h))
            low = (h << U(REGISTERS)) | U(1 << (REGISTERS - 1))
            np.maximum.at(top, (h >> U(64 - REGISTERS)).astype(np.int64), 65 - np.frexp(low.astype(np.float64))[1])
    at = np.flatnonzero(top)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(top[at], pa.int64()),
                                          pa.array(np.append(n, np.zeros(len(at) - 1, np.int64)), pa.int64())],
                                         names=["register", "rank", "n"])


def distinct(ranks: np.ndarray) -> int:
    """The sketch's estimate from the ranks of the registers in use."""
    m = 1 << REGISTERS
    empty = m - len(ranks)
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (empty + np.exp2(-ranks.astype(np.float64)).sum())
    return round(m * np.log(m / empty) if raw <= 2.5 * m and empty else raw)


def squeeze(values: np.ndarray) -> bytes:
    """Non-negative integers: number of bytes each, then byte by byte, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def widen(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :raw[0]] = planes.T
    return out.reshape(-1).view("<i8")


def gaps(ordered: np.ndarray) -> bytes:
    return squeeze(np.diff(ordered, prepend=0))


def ungap(raw: bytes) -> np.ndarray:
    return np.cumsum(widen(raw))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return h.view(np.int64) % buckets               # the sign of the divisor, as pmod


def _gathered(batches, *columns: str):
    """(rows' columns, hashes, row numbers) of about GRAMS n-grams at a time."""
    held, hashes, rows, at, n = [[] for _ in columns], [], [], 0, 0
    for batch in batches:
        for c, x in zip(columns, held):
            x.append(batch.column(c))
        for h, r in grams(batch.column("text")):
            hashes.append(h)
            rows.append(r + at)
            n += len(h)
        at += batch.num_rows
        if n >= GRAMS:
            yield _taken(held, hashes, rows)
            held, at, n = [[] for _ in columns], 0, 0
    if at:
        yield _taken(held, hashes, rows)


def _taken(held: list, hashes: list, rows: list):
    """One batch, joined; the lists are emptied, so that its parts do not stay in memory beside it."""
    none = np.zeros(0, np.int64)
    h, r = np.concatenate([none.view(np.uint64), *hashes]), np.concatenate([none, *rows])
    hashes.clear()
    rows.clear()
    return [pa.chunked_array(x) for x in held], h, r


def _batch_ids():
    part = TaskContext.get().partitionId()
    k = 0
    while True:
        yield (part << 32) | k
        k += 1


def _salt(batch: int, parts: int) -> int:
    return int(mix(np.array([batch], np.uint64))[0] % U(parts))


def _pieces(ordered: np.ndarray, size: int):
    """(fragment, from, to) of ordered values cut at multiples of ``size``."""
    frag = ordered // size
    cuts = np.flatnonzero(np.diff(frag, prepend=-1)).tolist()
    for a, z in zip(cuts, [*cuts[1:], len(ordered)]):
        yield int(frag[a]), a, z


COUNTS = "frag long, salt long, target boolean, places binary, counts binary"


def _counts_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()),
         pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=["frag", "salt", "target", "places", "counts"])


def count_batches(buckets: int, parts: int, target: bool):
    """Counts of the distinct buckets of every batch of documents."""
    size = fragment_size(buckets)

    def run(batches):
        for batch, (_, h, _) in zip(_batch_ids(), _gathered(batches)):
            found, n = np.unique(bucket_of(h, buckets), return_counts=True)
            salt = _salt(batch, parts)
            yield _counts_batch([(f, salt, target, gaps(found[a:z] - f * size), squeeze(n[a:z] - 1))
                                 for f, a, z in _pieces(found, size)])
    return run


def sum_counts(buckets: int):
    """Counts of a group, added up: one row for each side."""
    size = fragment_size(buckets)

    def run(group: pa.Table) -> pa.Table:
        out = []
        frag = group.column("frag")[0].as_py()
        for side in (False, True):
            total = np.zeros(size, np.int64)
            for t, p, c in zip(*(group.column(x).to_pylist() for x in ("target", "places", "counts"))):
                if t == side:
                    total[ungap(p)] += widen(c) + 1
            at = np.flatnonzero(total)
            if len(at):
                out.append((frag, 0, side, gaps(at), squeeze(total[at] - 1)))
        return pa.Table.from_batches([_counts_batch(out)])
    return run


RATIOS = "frag long, places binary, raw binary, target binary, t_raw long, t_target long"


def both_sides(group: pa.Table) -> pa.Table:
    """One row per fragment: its buckets in use with their raw and target counts."""
    sides = {t: (ungap(p), widen(c) + 1)
             for t, p, c in zip(*(group.column(x).to_pylist() for x in ("target", "places", "counts")))}
    at, raw = sides[False]
    target = np.zeros(len(at), np.int64)
    if True in sides:
        target[np.searchsorted(at, sides[True][0])] = sides[True][1]
    return pa.table([pa.array([group.column("frag")[0].as_py()], pa.int64()), pa.array([gaps(at)], pa.binary()),
                     pa.array([squeeze(raw)], pa.binary()), pa.array([squeeze(target)], pa.binary()),
                     pa.array([int(raw.sum())], pa.int64()), pa.array([int(target.sum())], pa.int64())],
                    names=["frag", "places", "raw", "target", "t_raw", "t_target"])


def fixed_ratios(raw: np.ndarray, target: np.ndarray, t_raw: int, t_target: int, buckets: int, scale: int) -> np.ndarray:
    """Fixed-point log(p_target / p_raw), both smoothed by one."""
    return np.rint(np.log((target + 1) / float(t_target + buckets) / ((raw + 1) / float(t_raw + buckets))) * scale).astype(np.int64)


def ratio_rows(buckets: int, t_raw: int, t_target: int, scale: int, hot: int):
    """bucket, r, hot: the rows of a packed table of counts."""
    size = fragment_size(buckets)

    def run(batches):
        for batch in batches:
            for f, p, x, y in zip(*(batch.column(c).to_pylist() for c in ("frag", "places", "raw", "target"))):
                raw = widen(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ungap(p) + f * size, pa.int64()),
                     pa.array(fixed_ratios(raw, widen(y), t_raw, t_target, buckets, scale), pa.int64()),
                     pa.array(raw * hot >= t_raw, pa.bool_())], names=["bucket", "r", "hot"])
    return run


# One schema for all that meets in a fragment: ``keys`` and ``sums`` of a batch's
# occurrences, of a fragment's ratios (batch -1) or, as fragment -1, of the documents.
MEET = "frag long, salt long, batch long, keys binary, sums binary, ids binary, texts binary"


def _meet_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.binary()) for c in cols[3:]],
                                      names=["frag", "salt", "batch", "keys", "sums", "ids", "texts"])


def _signed(values: np.ndarray) -> bytes:
    return squeeze((values << 1) ^ (values >> 63))


def _unsigned(raw: bytes) -> np.ndarray:
    v = widen(raw)
    return (v >> 1) ^ -(v & 1)


def packed_ratios(buckets: int, t_raw: int, t_target: int, scale: int, parts: int):
    """A fragment's ratios, once for each of its salts."""
    def run(batches):
        for batch in batches:
            for f, p, x, y in zip(*(batch.column(c).to_pylist() for c in ("frag", "places", "raw", "target"))):
                r = _signed(fixed_ratios(widen(x), widen(y), t_raw, t_target, buckets, scale))
                yield _meet_batch([(f, salt, -1, p, r, None, None) for salt in range(parts)])
    return run


def occurrences(buckets: int, parts: int, hot):
    """Rows of MEET: the occurrences outside the hot buckets by fragment, and the
    documents with the sums of their hot n-grams.  ``hot``: broadcast hot buckets,
    in order, and their ratios."""
    size = fragment_size(buckets)
    mask = (1 << 22) - 1

    def run(batches):
        hot_buckets, hot_ratios = hot.value
        maybe = np.zeros(mask + 1, bool)
        maybe[hot_buckets & mask] = True
        for batch, ((ids, texts), h, row) in zip(_batch_ids(), _gathered(batches, "doc_id", "th")):
            docs = len(ids)
            found = bucket_of(h, buckets)
            del h
            near = np.flatnonzero(maybe[found & mask])
            at = np.minimum(np.searchsorted(hot_buckets, found[near]), max(0, len(hot_buckets) - 1))
            is_hot = hot_buckets[at] == found[near] if len(hot_buckets) else np.zeros(len(near), bool)
            total = np.bincount(row[near[is_hot]], weights=hot_ratios[at[is_hot]], minlength=docs).astype(np.int64) \
                if len(hot_buckets) else np.zeros(docs, np.int64)
            n = np.bincount(row, minlength=docs)
            rare = np.ones(len(found), bool)
            rare[near[is_hot]] = False
            found, row = found[rare], row[rare]
            del near, at, is_hot, rare
            # fragment, then document, then bucket in one number:
            # (found // size) * (docs * size) + row * size + found % size, in place
            keys = found // size
            keys *= (docs - 1) * size
            keys += found
            row *= size
            keys += row
            del found, row
            keys.sort()
            salt = _salt(batch, parts)
            known = ids.is_valid().to_numpy().astype(np.uint8)
            yield _meet_batch([(f, salt, batch, gaps(keys[a:z] - f * (docs * size)), None, None, None)
                               for f, a, z in _pieces(keys, docs * size)])
            yield _meet_batch([(-1, batch, batch, squeeze(n), _signed(total),
                                known.tobytes() + ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                                texts.to_numpy().astype("<i8").tobytes())])
    return run


def partial_sums(buckets: int):
    """Rows of MEET: for every batch the documents with n-grams in the fragment
    and the sums of their ratios.  Rows of documents go through."""
    size = fragment_size(buckets)

    def run(group: pa.Table) -> pa.Table:
        if group.column("frag")[0].as_py() == -1:
            return group
        batch, keys, sums = (group.column(c).to_pylist() for c in ("batch", "keys", "sums"))
        ratio = np.zeros(size, np.int64)
        here = batch.index(-1)
        ratio[ungap(keys[here])] = _unsigned(sums[here])
        out = []
        for i, k in zip(batch, keys):
            if i >= 0:
                key = ungap(k)
                doc = key // size
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                out.append((0, 0, i, gaps(doc[first]), _signed(np.add.reduceat(ratio[key % size], first)), None, None))
        return pa.Table.from_batches([_meet_batch(out)])
    return run


SCORES = "doc_id bigint, th bigint, s bigint, n bigint"


def document_scores(group: pa.Table) -> pa.Table:
    """doc_id, th, sum of the ratios and number of n-grams of a batch's documents."""
    frag, keys, sums, ids, texts = (group.column(c).to_pylist() for c in ("frag", "keys", "sums", "ids", "texts"))
    here = frag.index(-1)
    n, total = widen(keys[here]), _unsigned(sums[here])
    for f, k, s in zip(frag, keys, sums):
        if f != -1:
            total[ungap(k)] += _unsigned(s)
    known = np.frombuffer(ids[here], np.uint8, len(n)).astype(bool)
    return pa.table([pa.array(np.frombuffer(ids[here], "<i8", len(n), len(n)), pa.int64(), mask=~known),
                     pa.array(np.frombuffer(texts[here], "<i8"), pa.int64()), pa.array(total, pa.int64()),
                     pa.array(n, pa.int64())], names=["doc_id", "th", "s", "n"])


def candidates(good):
    """doc_id, packed: the documents whose hashed id may be in the filter, text
    compressed.  ``good``: the broadcast filter."""
    def run(batches):
        table = np.frombuffer(good.value, np.int64)
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            some = batch.filter(pa.array(passes(table, batch.column("id").to_numpy())))
            texts = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(texts, pa.binary())],
                                             names=["doc_id", "packed"])
    return run


def unpacked(batches):
    """text: the texts of ``candidates``."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = [unpack.decompress(x) for x in batch.column("packed").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string())], names=["text"])
