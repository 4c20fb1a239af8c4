"""Periodic run detection (operator 12): Lyndon roots from Baier's grouping.

A run is a maximal stretch of words with smallest period q and length of at
least 2 q (here also ``MIN_LENGTH``).  Every run has a Lyndon root, a Lyndon word of
length q, under the order of words in which the word after the run is smaller than
the one q before it; and at each place where such a root starts (the run's
first word aside) it is the longest Lyndon word that starts there.  So the
Lyndon arrays under an order and its reverse hold the roots of all runs.

* ``lyndon_lengths``: phase one of Baier's suffix sorter.  Suffixes are grouped by
  their first word; groups are taken from the highest down, and the nearest
  earlier suffixes of lower groups are regrouped by how many members of the group
  they precede.  When a group is taken, its context, the prefix its members share,
  is the longest Lyndon prefix of each: phase one alone gives the array, in
  linear time, and once per order.
* ``runs_of``: a root is extended to both sides through longest common
  extensions of the sequence and itself shifted by the root's length.  A root
  inside a stretch already extended with the same period is skipped.

Only words that can be in a run are sorted.  In a run of period q and length L
>= max(12, 2 q) each of the L - q first words equals the one q later, and L - q
>= 6: so every word of it lies in a window of six words that occurs twice in the text
(its first L - q words in a window that occurs again q later, its last L - q in
one that occurred q before).  A run therefore lies in one stretch of words
covered by such windows, and so does any extension of it; stretches are worked
apart.  Windows are compared by hash: a collision costs work and no result.

Texts are dealt by rows; one text is worked in one task, in memory linear in its words.

Defined cases: NULL or empty text has no words, no run and the empty collapsed
text.  Words are compared byte by byte.  Rows that repeat a doc_id are worked
one by one.  A NULL doc_id is a value like others.  An empty table gives no
rows.  ``find_runs`` reads doc_id and text only; ``collapse`` returns all columns
(n_chars follows the text).
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12         # words a run has at least
WINDOW = MIN_LENGTH // 2
BATCH_BYTES = 4 << 20
VOCABULARY = 1 << 20    # distinct words a task remembers

_MIX = np.random.default_rng(20250101).integers(1, 1 << 63, WINDOW + 1, dtype=np.uint64) | np.uint64(1)

FOUND = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"


def lyndon_lengths(ranks: list[int], n_ranks: int, descending: bool = True) -> list[int]:
    """Length of the longest Lyndon word that starts at each place.

    ``ranks`` are 0 .. n_ranks - 1; with ``descending`` rank 0 is the smallest,
    else the largest.
    """
    n = len(ranks)
    group = list(ranks)
    members: list[list[int]] = [[] for _ in range(n_ranks)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    size = [len(m) for m in members]
    length = [1] * n_ranks                  # of each group's context
    # neighbours in the order of groups; -1 is the end
    down, up = [r - 1 for r in range(n_ranks)], [r + 1 for r in range(n_ranks - 1)] + [-1]
    lower, higher = (down, up) if descending else (up, down)
    found = [0] * n
    left = list(range(n + 1))               # left[i + 1]: shortcut towards the last suffix <= i not yet taken
    g = n_ranks - 1 if descending else 0
    while g >= 0:
        context = length[g]
        taken = [i for i in members[g] if group[i] == g] if size[g] != len(members[g]) else members[g]
        for i in taken:
            left[i + 1] = i
            found[i] = context
        if len(taken) == 1:
            j = taken[0]
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            hits = {j: 1} if j else {}
        else:
            hits = {}
            for i in taken:
                j = i
                while left[j] != j:
                    left[j] = left[left[j]]
                    j = left[j]
                if j:
                    hits[j] = hits.get(j, 0) + 1
        if hits:
            if len(hits) == 1:
                (j, times), = hits.items()
                regrouped = {group[j - 1]: {times: [j - 1]}}
            else:
                regrouped = {}
                for j, times in hits.items():
                    regrouped.setdefault(group[j - 1], {}).setdefault(times, []).append(j - 1)
            for old, by_times in regrouped.items():
                # new groups stand right above their old one, more repeats higher
                for times in sorted(by_times, reverse=True):
                    moved = by_times[times]
                    if len(moved) == size[old]:
                        length[old] += times * context      # the whole group moves: it stays in place
                        continue
                    new = len(length)
                    length.append(length[old] + times * context)
                    members.append(moved)
                    size.append(len(moved))
                    size[old] -= len(moved)
                    for i in moved:
                        group[i] = new
                    above = higher[old]
                    lower.append(old)
                    higher.append(above)
                    lower[above] = higher[old] = new
        g = lower[g]
    return found


def common_extension(w: np.ndarray, i: int, j: int, back: bool = False) -> int:
    """Number of equal words from i and j (i < j) on to the right, or to the
    left, compared in blocks of growing size."""
    n, done, step = len(w), 0, 16
    while True:
        room = i + 1 - done if back else n - j - done
        m = min(step, room)
        if m <= 0:
            return done
        if back:
            x, y = w[i + 1 - done - m:i + 1 - done][::-1], w[j + 1 - done - m:j + 1 - done][::-1]
        else:
            x, y = w[i + done:i + done + m], w[j + done:j + done + m]
        differ = x != y
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += m
        step *= 2


def runs_of(w: np.ndarray, least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    n = len(w)
    if n < least:
        return []
    distinct, ranks = np.unique(w, return_inverse=True)
    listed = ranks.tolist()
    at = np.arange(n)
    found: set[tuple[int, int, int]] = set()
    covered: dict[int, tuple[int, int]] = {}        # by period: the stretch last extended
    for descending in (True, False):
        covered.clear()
        period = np.array(lyndon_lengths(listed, len(distinct), descending))
        after, before = at + period, at - 1
        # a run goes on beyond its root on one side at least
        right = (after < n) & (ranks[np.minimum(after, n - 1)] == ranks)
        left = (before >= 0) & (ranks[before] == ranks[after - 1])
        for i in np.flatnonzero(right | left).tolist():
            p = int(period[i])
            lo, hi = covered.get(p, (0, -1))
            if lo <= i and i + p <= hi:
                continue
            r = common_extension(ranks, i, i + p)
            k = common_extension(ranks, i - 1, i + p - 1, back=True)
            if k + r >= p:
                covered[p] = (i - k, i + p + r)
                if k + r + p >= least:
                    found.add((i - k, k + r + p, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def stretches(ids: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per text (words at[k] .. at[k + 1] of ids) the stretches of words that
    lie in windows which occur twice in the text."""
    m = len(ids) - WINDOW + 1
    result: list[list[tuple[int, int]]] = [[] for _ in range(len(at) - 1)]
    if m <= 0:
        return result
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    wide = ids.astype(np.uint64)
    h = owner[:m].astype(np.uint64) * _MIX[WINDOW]
    for k in range(WINDOW):
        h += (wide[k:m + k] + np.uint64(1)) * _MIX[k]
    whole = np.flatnonzero(owner[:m] == owner[WINDOW - 1:])
    order = np.argsort(h[whole])
    h = h[whole][order]
    same = h[1:] == h[:-1]
    again = np.zeros(len(h), bool)
    again[1:] |= same
    again[:-1] |= same
    starts = whole[order][again]
    depth = np.zeros(len(ids) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + WINDOW, -1)
    inside = np.cumsum(depth[:-1]) > 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    edge_in = np.flatnonzero(inside[1:] & inside[:-1] & (owner[1:] != owner[:-1])) + 1      # texts meet inside
    begins = np.sort(np.concatenate([np.flatnonzero(edge == 1), edge_in]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), edge_in]))
    for a, z in zip(begins.tolist(), ends.tolist()):
        if z - a >= MIN_LENGTH:
            k = int(owner[a])
            result[k].append((a - int(at[k]), z - int(at[k])))
    return result


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: all but those after the first period of a run."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def _blocks(raw: list[bytes]):
    at, total = 0, 0
    for k, t in enumerate(raw):
        total += len(t)
        if total >= BATCH_BYTES or k + 1 == len(raw):
            yield at, k + 1
            at, total = k + 1, 0


class Finder:
    """Runs of texts; words are numbered once for all texts of a task."""

    def __init__(self, edit=None):
        self.edit = edit
        self.numbers: defaultdict = defaultdict(count().__next__)

    def find(self, doc_ids: list, raw: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
        if len(self.numbers) > VOCABULARY:
            self.numbers = defaultdict(count().__next__)
        texts = [t.split() for t in raw]            # bytes split at ASCII white space only
        if self.edit:
            texts = [self.edit(i, t) for i, t in zip(doc_ids, texts)]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        number = self.numbers.__getitem__
        ids = np.fromiter((number(w) for t in texts for w in t), np.int64, int(at[-1]))
        out = []
        for k, found in enumerate(stretches(ids, at)):
            own = ids[at[k]:at[k + 1]]
            out.append((texts[k], [(a + s, n, p) for a, z in found for s, n, p in runs_of(own[a:z])]))
        return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, edit=None) -> DataFrame:
    """doc_id, runs (by start, then period), text (the words that stay, joined
    by one blank) of every input row.  ``edit(doc_id, words)`` may change the words of a text first."""
    def run(batches):
        finder = Finder(edit)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            listed = ids.to_pylist()
            raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, z in _blocks(raw):
                found = finder.find(listed[a:z], raw[a:z])
                flat = np.array([r for _, runs in found for r in runs], np.int64).reshape(-1, 3)
                offsets = np.cumsum([0, *(len(runs) for _, runs in found)])
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(c)) for c in flat.T], names=["start", "length", "period"]))
                texts = pa.array([collapsed(*x) for x in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), runs, texts], names=["doc_id", "runs", "text"])
    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def collapse(docs: DataFrame) -> DataFrame:
    """The documents with collapsed texts; texts without a run stay as they are."""
    names = docs.columns
    place = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        finder = Finder()
        for batch in batches:
            old = batch.column(place).to_pylist()
            raw = [(t or "").encode() for t in old]
            new: list = []
            for a, z in _blocks(raw):
                new += [collapsed(w, runs).decode() if runs else t
                        for t, (w, runs) in zip(old[a:z], finder.find([None] * (z - a), raw[a:z]))]
            cols = list(batch.columns)
            cols[place] = pa.array(new, cols[place].type)
            if chars is not None:
                cols[chars] = pa.array([len(y) if x != y else c for x, y, c in zip(old, new, cols[chars].to_pylist())],
                                       cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return docs.mapInArrow(run, docs.schema)


def longest(runs: Column) -> Column:
    """The longest run; of equals the one with the smallest start, then period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(F.size(runs) > 0, F.struct((-best["s"]).alias("start"), best["length"].alias("length"),
                                             (-best["p"]).alias("period")))


def as_text(runs: Column) -> Column:
    """`start,length,period` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
