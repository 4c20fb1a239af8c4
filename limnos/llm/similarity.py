"""Exact Jaccard links between hashed sets, from candidate keys to components.

Two sets are compared only if they share a key (a prefix n-gram, a MinHash
band).  The work is arranged so that no key, however common, makes all pairs
of its group:

A set's *own* n-grams (those no other set has) bound its overlaps, so pairs
are sifted by size and by n-grams that are not own before anything is compared.

1. ``shared_ids``: which sets have enough keys that some other set has too.
   Keys travel packed (4 bytes and a 2-byte row number), by hash range; a key
   is reduced to one entry per distinct set and batch before the shuffle.
2. ``link``: first each set is compared with one set of each of its key groups,
   the one with the fewest n-grams of its own (a star, linear in the number of
   keys), and the verified links are united.  Then, for every key whose sets are in several components, the sets outside
   the key's largest component are compared with those of other components.
   A pair inside one component can add nothing, so no link between components
   is lost and groups of copies cost a star.
3. ``overlaps``: sets are cut into fragments of the global hash order; partial
   overlaps are counted per fragment and summed per pair.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.common import stored
from limnos.llm.components import components
from limnos.llm.vectors import mix

BATCH_KEYS = 1 << 20        # keys packed into one row group at most
FRAGMENT_KEYS = 1 << 20     # keys meant to meet in one hash range
BUCKET_IDS = 50_000         # ids whose partial counts are summed together, about
PIECES = 4                  # fragments of the hash order for partial overlaps
FILTER_BITS = 26            # log2 of the bits of an id filter (8 MB)

PACKED = "frag int, keys binary, rows binary, ids binary, until binary"


def pack(ids: np.ndarray, until: np.ndarray, lengths: np.ndarray, keys: np.ndarray, fragments: int):
    """Packed rows of PACKED from the concatenated 64-bit ``keys`` of sets.

    ``until``: keys up to this bound count for the set, larger ones only for
    others.  Sets are at most 65,536 a call.
    """
    row = np.repeat(np.arange(len(ids), dtype=np.uint16), lengths)
    high = (keys >> np.uint64(32)).astype(np.uint64)
    frag = ((high * np.uint64(fragments)) >> np.uint64(32)).astype(np.int32)
    # the key within its fragment: 32 bits below the fragment's share of the order
    low = (keys >> np.uint64(12)).astype(np.uint32)
    order = np.argsort(frag, kind="stable")
    frag, low, row, keys = frag[order], low[order], row[order], keys[order]
    cuts = np.flatnonzero(np.diff(frag, prepend=-1))
    out = []
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(frag)]):
        used, local = np.unique(row[a:z], return_inverse=True)
        # a key counts for its set when it lies within the set's bound
        counts = keys[a:z] <= until[row[a:z]]
        out.append((int(frag[a]), low[a:z].tobytes(), local.astype(np.uint16).tobytes(),
                    ids[used].tobytes(), np.packbits(counts).tobytes()))
    return out


def packed_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
        names=["frag", "keys", "rows", "ids", "until"])


def _count_shared(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a fragment with shared keys, and how many."""
    keys, ids, counts = [], [], []
    for k, r, i, u in zip(*(group.column(c).to_pylist() for c in ("keys", "rows", "ids", "until"))):
        key = np.frombuffer(k, np.uint32)
        keys.append(key)
        ids.append(np.frombuffer(i, np.int64)[np.frombuffer(r, np.uint16)])
        counts.append(np.unpackbits(np.frombuffer(u, np.uint8), count=len(key)).astype(bool))
    keys, ids, counts = np.concatenate(keys), np.concatenate(ids), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, ids, counts = keys[order], ids[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
    shared = np.repeat(several, np.diff(np.append(starts, len(keys)))) & counts
    return np.unique(ids[shared], return_counts=True)


def _packed_counts(buckets: int):
    def count(group: pa.Table) -> pa.Table:
        ids, n = _count_shared(group)
        at = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        at, ids, n = at[order], ids[order], n[order].astype(np.int32)
        cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
        spans = list(zip(cuts, [*cuts[1:], len(at)]))
        return pa.table([pa.array([int(at[a]) for a, _ in spans], pa.int32()),
                         pa.array([ids[a:z].tobytes() for a, z in spans], pa.binary()),
                         pa.array([n[a:z].tobytes() for a, z in spans], pa.binary())], names=["bucket", "ids", "n"])
    return count


def _sum_counts(group: pa.Table) -> pa.Table:
    read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()])
    ids, inverse = np.unique(read("ids", np.int64), return_inverse=True)
    total = np.bincount(inverse, weights=read("n", np.int32)).astype(np.int64)
    return pa.table([pa.array(ids, pa.int64()), pa.array(total, pa.int64())], names=["id", "shared"])


def shared_ids(packed: DataFrame, n_ids: int) -> DataFrame:
    """id, shared: number of the set's counted keys that another set has.

    Partial counts of a fragment travel packed, by buckets of about BUCKET_IDS
    of the ``n_ids`` ids.
    """
    buckets = max(1, -(-n_ids // BUCKET_IDS))
    return packed.groupBy("frag").applyInArrow(_packed_counts(buckets), "bucket int, ids binary, n binary") \
        .groupBy("bucket").applyInArrow(_sum_counts, "id bigint, shared bigint")


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A fixed-size bitmap (2^bits bits) that holds two bits of every 64-bit
    id.  It only spares work: what passes is joined exactly afterwards, so a
    full bitmap costs time and no result.  At most 2^(bits-6) rows come to the
    driver, whatever the number of ids."""
    mask = (1 << bits) - 1
    at = ids.select(F.explode(F.array(F.col("id").bitwiseAND(mask),
                                      F.shiftrightunsigned("id", 32).bitwiseAND(mask))).alias("p"))
    words = at.select(F.shiftright("p", 6).alias("w"), F.col("p").bitwiseAND(63).cast("int").alias("s")) \
        .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("m"))
    table = np.zeros(1 << (bits - 6), np.int64)
    got = words.toArrow()
    table[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return table.tobytes()


def passes(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which int64 ids may be in the filter (no false negatives)."""
    mask = np.uint64(len(table) * 64 - 1)
    u = ids.view(np.uint64)
    ok = np.ones(len(u), bool)
    for p in (u & mask, (u >> np.uint64(32)) & mask):
        ok &= (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)).astype(np.int64)) & 1 == 1
    return ok


def _segments(batches):
    """id, frag, part: each set cut at fixed points of the hash order."""
    cuts = np.array([(f << 64) // PIECES for f in range(1, PIECES)], np.uint64)
    for batch in batches:
        ids, frags, parts = [], [], []
        for i, raw in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist()):
            h = np.frombuffer(raw, np.uint64)
            at = [0, *np.searchsorted(h, cuts).tolist(), len(h)]
            for f in range(PIECES):
                if at[f + 1] > at[f]:
                    ids.append(i)
                    frags.append(f)
                    parts.append(h[at[f]:at[f + 1]].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(frags, pa.int32()), pa.array(parts, pa.binary())],
            names=["id", "frag", "part"])


def _partial_overlaps(batches):
    for batch in batches:
        common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                  for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64())],
                                         names=["a", "b", "common"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common: size of the intersection, as a sum over fragments."""
    parts = sets.select("id", "part").mapInArrow(_segments, "id bigint, frag int, part binary")
    first = pairs.select("a", "b").distinct().join(parts.select(F.col("id").alias("a"), "frag", F.col("part").alias("pa")), "a")
    both = first.join(parts.select(F.col("id").alias("b"), "frag", F.col("part").alias("pb")), ["b", "frag"])
    return both.select("a", "b", "pa", "pb").mapInArrow(_partial_overlaps, "a bigint, b bigint, common bigint") \
        .groupBy("a", "b").agg(F.sum("common").alias("common"))


def _compatible(a: str, b: str, percent: int):
    """Whether sizes (n) and numbers of n-grams not own (m) allow a link."""
    na, nb, ma, mb = (F.col(c) for c in (f"{a}.n", f"{b}.n", f"{a}.m", f"{b}.m"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) \
        & ((100 + percent) * F.least(ma, mb) >= percent * (na + nb))


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, na, b, nb) with the exact size of their intersection (common)."""
    return pairs.join(overlaps(pairs, sets), ["a", "b"])


def _reaches(common, na, nb, percent: int):
    """Jaccard similarity of percent, from sizes."""
    return (100 + percent) * F.col(common) >= percent * (F.col(na) + F.col(nb))


WORDS_OF_BITS = 32          # 64-bit words of a set's bitmap


def bitmaps(grams: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """Per set a bitmap of 64 * WORDS_OF_BITS buckets of its n-grams; the sets stand one
    after the other in ``grams``."""
    at = (grams >> np.uint64(20)) % np.uint64(64 * WORDS_OF_BITS)
    words = np.zeros((len(sizes), WORDS_OF_BITS), np.uint64)
    place = np.repeat(np.arange(len(sizes)) * WORDS_OF_BITS, sizes) + (at >> np.uint64(6)).astype(np.int64)
    np.bitwise_or.at(words.reshape(-1), place, np.uint64(1) << (at & np.uint64(63)))
    return words.view(np.int64).tolist()


def _bound(x: str, y: str, percent: int):
    """Whether bitmaps allow a link: each bucket that only one set fills holds an
    n-gram that the other lacks, which bounds the intersection from above."""
    def lacking(p, q):
        parts = [F.bit_count(F.col(f"{p}.b{k}").bitwiseAND(F.bitwise_not(F.col(f"{q}.b{k}")))) for k in range(WORDS_OF_BITS)]
        return reduce(lambda a, b: a + b, parts)
    most = F.least(F.col(f"{x}.n") - lacking(x, y), F.col(f"{y}.n") - lacking(y, x))
    return (100 + percent) * most >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def link(keys: DataFrame, measure, minus=None, postings=None, percent: int = 80, bits: DataFrame | None = None) -> DataFrame:
    """id, comp of every set that has a link (sets without one are absent).

    ``keys`` (written): key, id, n, m, rank; two linked sets share a key, m is
    at least the number of n-grams that other sets have too, the lowest rank
    leads a key's star.  ``measure(pairs)`` adds ``common`` to pairs that have
    any n-gram in common.  ``minus(rows)`` gives gram, id for rows (id, lead):
    the n-grams of id that lead lacks.  ``postings(grams)`` gives gram, id, n, m
    of all sets that have one of the grams.

    After the star, a set x that its leader L does not reach has at most
    |x & L| n-grams in common with any set it shares none of its others with.  So
    it can link with a set whose size asks for more only through an n-gram that L
    lacks: such pairs come from those n-grams, which are rare, and not from the
    keys that a whole group of near copies shares.  Without ``minus`` all pairs
    come from the keys; ``bits`` (id, array of a set's bitmap words, array of its
    keys) then sifts them inside the join.
    """
    lead = keys.groupBy("key").agg(F.min(F.struct("rank", "id", "n", "m")).alias("lead"), F.count("*").alias("c")) \
        .where("c > 1").select("key", "lead.*")
    x, y = lead.alias("x"), keys.alias("y")
    star = x.join(y, F.col("x.key") == F.col("y.key")) \
        .where((F.col("x.id") != F.col("y.id")) & _compatible("x", "y", percent))
    tested = stored(measure(stored(_pairs(star, "x.id"), "star")), "tested")
    linked = stored(tested.where(_reaches("common", "na", "nb", percent)).select("a", "b"), "links")
    comps = components(linked)

    # the closest leader of each set, and how much is shared with it
    side = lambda i, j: tested.where(f"lead = {j}").select(F.col(i).alias("id"), F.struct("common", F.col(j).alias("lead")).alias("s"))
    near = side("a", "b").unionByName(side("b", "a")).groupBy("id").agg(F.max("s").alias("s")) \
        .select("id", F.col("s.lead").alias("lead"), F.col("s.common").alias("held"))
    ids = keys.select("id", "n", "m").distinct().join(comps, "id", "left") \
        .withColumn("comp", F.coalesce("comp", "id")).join(near, "id", "left")
    # n-grams that a set no larger than its partner needs beyond those it shares
    # with its closest leader; where it needs some, the leader decides
    ids = stored(ids.withColumn("more", F.floor((2 * percent * F.col("n") + 99 + percent) / F.lit(100 + percent)) - F.col("held")), "ids")
    apart = (F.col("x.comp") != F.col("y.comp")) & _compatible("x", "y", percent)
    rules = lambda p, q: F.coalesce((F.col(f"{p}.more") >= 1) & (F.col(f"{p}.n") <= F.col(f"{q}.n")), F.lit(False))
    covered = (rules("x", "y") | rules("y", "x")) if minus else F.lit(False)

    # pairs that a set's closest leader does not rule out: by the keys
    placed = stored(keys.select("key", "id").join(ids.drop("lead"), "id"), "keys")
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    split = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")) \
        .where("comps > 1").select("key", F.col("top.comp").alias("top"))
    mixed = placed.join(split, "key")
    if bits is not None:
        mixed = mixed.join(bits.select("id", "keys", *[F.col("bits")[k].alias(f"b{k}") for k in range(WORDS_OF_BITS)]), "id")
        # each pair at one of its common keys only
        apart = apart & _bound("x", "y", percent) & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))
    mixed = stored(mixed, "keys")
    x, y = mixed.where("comp != top").alias("x"), mixed.alias("y")
    crossed = _pairs(x.join(y, F.col("x.key") == F.col("y.key")).where(
        apart & ~covered & ((F.col("y.comp") == F.col("y.top")) | (F.col("x.id") < F.col("y.id")))))

    if minus:
        crossed = crossed.unionByName(_pairs_beyond(ids.where("lead is not null and more >= 1"), ids, minus, postings, percent))
    fresh = stored(crossed.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "cross")
    more = measure(fresh).where(_reaches("common", "na", "nb", percent)).select("a", "b")
    return components(linked.union(more))


def _pairs_beyond(ruled: DataFrame, ids: DataFrame, minus, postings, percent: int) -> DataFrame:
    """Pairs by n-grams that the closest leader lacks: a set that needs ``more``
    of them has one of its rarest (all but more - 1) in common with a partner."""
    grams = stored(minus(ruled.select("id", "lead")), "beyond")
    held = stored(postings(grams.select("gram")), "postings")
    counted = grams.join(held.groupBy("gram").agg(F.count("*").alias("c")), "gram").join(ruled, "id")
    place = F.row_number().over(Window.partitionBy("id").orderBy("c", "gram"))       # within one set
    size = F.count("*").over(Window.partitionBy("id"))
    x = counted.withColumn("place", place).withColumn("size", size) \
        .where((F.col("c") > 1) & (F.col("place") <= F.col("size") - F.col("more") + 1)).alias("x")
    y = held.join(ids.select("id", "comp", "n", "m"), "id").alias("y")
    return _pairs(x.join(y, F.col("x.gram") == F.col("y.gram")).where(
        (F.col("x.id") != F.col("y.id")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.n") <= F.col("y.n"))
        & _compatible("x", "y", percent)))


def _pairs(joined: DataFrame, lead: str | None = None) -> DataFrame:
    """a, na, b, nb with a < b (and lead, one of them), each once, from rows of x and y."""
    swap = F.col("x.id") > F.col("y.id")
    return joined.select(
        F.least("x.id", "y.id").alias("a"), F.when(swap, F.col("y.n")).otherwise(F.col("x.n")).alias("na"),
        F.greatest("x.id", "y.id").alias("b"), F.when(swap, F.col("x.n")).otherwise(F.col("y.n")).alias("nb"),
        *([F.col(lead).alias("lead")] if lead else [])).distinct()


def set_minus(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """gram, id: the n-grams of id that lead lacks, for rows (id, lead)."""
    def run(batches):
        for batch in batches:
            ids, grams = [], []
            for i, x, y in zip(*(batch.column(c).to_pylist() for c in ("id", "px", "pl"))):
                g = np.setdiff1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)
                ids.append(np.full(len(g), i))
                grams.append(g.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams), pa.int64()),
                                                  pa.array(np.concatenate(ids), pa.int64())], names=["gram", "id"])
    return rows.join(sets.select("id", F.col("part").alias("px")), "id") \
        .join(sets.select(F.col("id").alias("lead"), F.col("part").alias("pl")), "lead") \
        .select("id", "px", "pl").mapInArrow(run, "gram bigint, id bigint")


def set_postings(grams: DataFrame, sets: DataFrame) -> DataFrame:
    """gram, id of the sets that hold one of the grams."""
    bits = sets.sparkSession.sparkContext.broadcast(id_filter(grams.select(F.col("gram").alias("id"))))

    def run(batches):
        table = np.frombuffer(bits.value, np.int64)
        for batch in batches:
            ids, found = [], []
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist()):
                h = np.frombuffer(raw, np.int64)
                h = h[passes(table, h)]
                ids.append(np.full(len(h), i))
                found.append(h)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()),
                                                  pa.array(np.concatenate(ids), pa.int64())], names=["gram", "id"])
    held = sets.select("id", "part").mapInArrow(run, "gram bigint, id bigint")
    return held.join(grams.select("gram").distinct(), "gram", "left_semi")


def _global_order(group: pa.Table) -> pa.Table:
    """Per set the n-grams of this fragment that several sets have, with counts."""
    sets = [np.frombuffer(x, np.uint64) for x in group.column("part").to_pylist()]
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    df = counts[inverse]
    at = np.cumsum([0, *map(len, sets)])
    h, c = [], []
    for x, a, z in zip(sets, at[:-1].tolist(), at[1:].tolist()):
        keep = df[a:z] > 1
        h.append(x[keep].tobytes())
        c.append(df[a:z][keep].astype(np.int64).tobytes())
    return pa.table({"id": group.column("id"), "n": group.column("n"),
                     "part": pa.array(h, pa.binary()), "df": pa.array(c, pa.binary())})


def _fragments(count: int):
    cuts = np.array([(f << 64) // count for f in range(1, count)], np.uint64)

    def cut(batches):
        for batch in batches:
            out = []
            for i, n, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "part"))):
                h = np.frombuffer(raw, np.uint64)
                at = [0, *np.searchsorted(h, cuts).tolist(), len(h)]
                out += [(f, i, n, h[a:z].tobytes()) for f, (a, z) in enumerate(zip(at, at[1:])) if z > a]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.binary())], names=["frag", "id", "n", "part"])
    return cut


def _prefix(percent: int):
    def pick(group: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("part").to_pylist()])
        df = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("df").to_pylist()])
        i, n = group.column("id")[0].as_py(), group.column("n")[0].as_py()
        # the prefix of n - ceil(t n) + 1 n-grams, rarest first; those that no
        # other set has come first of all and find no partner
        length = n + (-n * percent // 100) + 1 - (n - len(h))
        keys = h[np.lexsort((h, df))][:max(0, length)].view(np.int64)
        return pa.table({"key": pa.array(keys, pa.int64()), "id": pa.array(np.full(len(keys), i), pa.int64()),
                         "n": pa.array(np.full(len(keys), n), pa.int64()),
                         "m": pa.array(np.full(len(keys), len(h)), pa.int64())})
    return pick


def _counted(sets: DataFrame) -> DataFrame:
    """id, n, part, df: per set and fragment the n-grams that several sets have."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // FRAGMENT_KEYS))
    return sets.select("id", "n", "part").mapInArrow(_fragments(count), "frag int, id bigint, n bigint, part binary") \
        .groupBy("frag").applyInArrow(_global_order, "id bigint, n bigint, part binary, df binary")


def prefix_keys(sets: DataFrame, percent: int = 80) -> DataFrame:
    """key, id, n, m, rank: the prefix of each set in the global order of n-grams (by
    number of sets that hold it, then hash).  Linked sets share a prefix key."""
    return _counted(sets).groupBy("id").applyInArrow(_prefix(percent), "key bigint, id bigint, n bigint, m bigint") \
        .withColumn("rank", F.col("n") - F.col("m"))
