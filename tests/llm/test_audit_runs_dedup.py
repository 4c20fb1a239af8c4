"""Filter audit, periodic runs and exact dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.llm import exact_dedup, filter_audit, periodic_runs
from limnos.llm.common import documents
from limnos.llm.queries import op12_periodic_runs, planted_period
from tests.conftest import SF_SMALL
from tests.llm.conftest import EDGE, frame, row_dicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LABELS = "doc_id bigint, quality int, toxic int"


# ---- filter audit ----

def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    masks = defaultdict(list)
    for i, text, _, source, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows):
            fails.add("E")
        masks[source or ""].append((i, fails))
    out = {}
    for part, docs in masks.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [i for i, f in docs if x in f and not f & before]
                removed_by[x] += len(gone)
                out[part, "".join(order), step] = [
                    sum(not f & (before | {x}) for _, f in docs), len(gone),
                    sum(x in f and bool(f & before) for _, f in docs), sum(f == {x} for _, f in docs),
                    sum(i in good for i in gone), sum(i in toxic for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows():
    rng = random.Random(3)
    rows = list(EDGE)
    words = ["w%d" % k for k in range(300)] + ["Cap", "CAPS"]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 199, 200, 250, 400)]
    base += ["a b " * 150, "# " + base[3], "A" * 3 + base[4]]
    for k in range(150):
        rows.append((rng.choice([None, *range(40)]), rng.choice(base), "en", rng.choice([None, "", "s0", "s1"]), 0))
    return rows


@pytest.mark.parametrize("extra", [False, True])
def test_audit_equals_brute_force(shipped, extra):
    rows = audit_rows()
    labels = [(k, k % 2, k % 3 // 2) for k in range(30)] + [(4, None, 1), (None, 1, 1), (99, 1, 1), (5, 0, None), (6, 1, 0)]
    docs = frame(shipped, rows, extra)
    got = filter_audit.audit(docs, shipped.createDataFrame(labels, LABELS))
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in row_dicts(got)}
    assert found == brute_audit(rows, labels)


def test_audit_of_nothing(nothing, shipped):
    assert filter_audit.audit(nothing, shipped.createDataFrame([], LABELS)).count() == 0


def test_copies_need_the_exact_text(shipped):
    # with all hashes equal, only equal texts with a smaller doc_id count
    rows = shipped.createDataFrame(
        [(1, "s", 0, 0, "x"), (2, "s", 0, 0, "y"), (3, "s", 0, 0, "x"), (3, "t", 0, 0, "x"), (None, "s", 0, 0, "x")],
        "doc_id bigint, part string, h1 bigint, h2 bigint, text string")
    found = filter_audit.with_smaller_copy(rows)
    assert sorted((r["doc_id"], r["part"]) for r in row_dicts(found)) == [(3, "s"), (3, "t")]


# ---- periodic runs ----

def brute_runs(w, least=12):
    w, n, best = np.unique(np.array(w), return_inverse=True)[1] if len(w) else np.zeros(0, int), len(w), {}
    for p in range(1, n // 2 + 1):
        same = np.concatenate([[False], w[p:] == w[:-p], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if z - a + p >= max(least, 2 * p):
                best.setdefault((a, z - a + p), p)
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def next_smaller(s):
    n = len(s)
    return [next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) - i for i in range(n)]


def random_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(1, 50)
    s = [rng.randrange(k) for _ in range(n)]
    period = [rng.randrange(k) for _ in range(rng.randrange(1, 9))]
    return s[:rng.randrange(n)] + (period * 20)[:rng.randrange(40)] + s


def test_grouping_gives_both_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(400):
        s = np.unique(random_words(rng), return_inverse=True)[1].tolist()
        m = max(s) + 1
        assert periodic_runs.lyndon_lengths(s, m) == next_smaller(s)
        assert periodic_runs.lyndon_lengths(s, m, descending=False) == next_smaller([-x for x in s])


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(2)
    for _ in range(400):
        s = random_words(rng)
        assert periodic_runs.runs_of(np.array(s), least) == brute_runs(s, least)


def test_texts_next_to_each_other_do_not_mix():
    rng = random.Random(4)
    words = [[b"w%d" % x for x in random_words(rng)] for _ in range(300)]
    found = periodic_runs.Finder().find([None] * 300, [b" ".join(w) for w in words])
    for w, (got, runs) in zip(words, found):
        assert got == w and runs == brute_runs(w)


def test_long_period_and_one_word_texts():
    w = [b"w%d" % k for k in range(5000)]
    finder = periodic_runs.Finder()
    (_, one), (_, two), (_, three) = finder.find([0] * 3, [b" ".join(w + w), b"x " * 20_000, b" ".join(w + w[:4999])])
    assert one == [(0, 10_000, 5000)] and two == [(0, 20_000, 1)] and three == []


def check_runs(rows, got):
    want = Counter()
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        w = [x.decode() for x in planted_period(i, [x.encode() for x in w])]
        runs = brute_runs(w)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want[(i, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
              hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
              hashlib.sha256(brute_collapse(w, runs).encode()).hexdigest())] += 1
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r[c] for c in names) for r in row_dicts(got)) == want


def test_op12_on_edge_rows(shipped, tmp):
    rng = random.Random(5)
    rows = EDGE + [(100 + k, " \n".join("w%d" % x for x in random_words(rng)), "en", "s", 0) for k in range(200)]
    frame(shipped, rows, extra=True).write.parquet(f"{tmp}/documents.parquet")
    check_runs(rows, op12_periodic_runs(shipped, tmp))


def test_op12_on_documents(shipped):
    rows = [(r["doc_id"], r["text"]) for r in documents(shipped, SF_SMALL).collect()]
    check_runs(rows, op12_periodic_runs(shipped, SF_SMALL))


def test_collapse_keeps_other_columns(shipped):
    docs = frame(shipped, EDGE + [(50, "a b " * 10 + "end", "en", "s", 43)], extra=True)
    got = {(r["doc_id"], r["source"]): r for r in row_dicts(periodic_runs.collapse(docs))}
    assert got[50, "s"]["text"] == "a b end" and got[50, "s"]["n_chars"] == 7 and got[50, "s"]["comp"] == "c"
    assert got[7, "s0"]["text"] == "word" and got[3, "s0"]["text"] is None
    assert got[9, "s2"]["text"] == EDGE[11][1]


def test_runs_of_nothing(nothing):
    assert periodic_runs.find_runs(nothing).count() == 0
    assert periodic_runs.collapse(nothing).count() == 0


# ---- exact dedup ----

def dedup_rows():
    rng = random.Random(7)
    texts = [None, "", "Same TEXT", "same text", "sAme text", "É", "é", "x" * 5000, "X" * 5000]
    rows = list(EDGE) + [(rng.choice([None, *range(30)]), rng.choice(texts), "en", "s%d" % (k % 3), k) for k in range(200)]
    return rows + [(1000 + k, "unique %d" % k, "en", "s", 0) for k in range(300)]


def brute_groups(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(i)
    want, kept = Counter(), Counter()
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept[keep, sha] += 1
        for i in ids:
            want[i, keep, len(ids), sha] += 1
    return want, kept


@pytest.mark.parametrize("most_slots", [exact_dedup.MOST_SLOTS, 1 << 10])
def test_groups_equal_brute_force(shipped, most_slots):
    rows = dedup_rows()
    got = row_dicts(exact_dedup.exact_groups(frame(shipped, rows, extra=True), most_slots))
    want, kept = brute_groups(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter((r["doc_id"], r["text_sha256"]) for r in got if r["kept"]) == kept


def test_drop_copies_keeps_one_whole_row(shipped):
    rows = dedup_rows()
    docs = frame(shipped, rows, extra=True)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    _, kept = brute_groups(rows)
    found = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").translate(LOWER).encode()).hexdigest())
                    for r in row_dicts(got))
    assert found == kept
    assert {tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in row_dicts(got)} <= set(rows)


def test_filter_lets_few_single_rows_through(shipped):
    docs = shipped.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 19_990).alias("text"))
    marked = exact_dedup.marked_rows(exact_dedup.hashed_rows(docs))
    maybe = marked.where("maybe").count()
    assert 20 <= maybe < 1200                      # 20 rows are in pairs


def test_dedup_of_nothing(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).count() == 0
