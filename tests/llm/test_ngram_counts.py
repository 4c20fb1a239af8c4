"""Packed n-gram counts against brute force: hashes, packing, scores over
several fragments, salts and batches."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from limnos.llm import ngram_counts, quality, vectors
from tests.llm.conftest import frame, row_dicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_grams(text):
    w = [x.encode() for x in WORD.findall(text or "")]
    h = [xxhash.xxh64_intdigest(x, 42) for x in w]
    return h + [xxhash.xxh64_intdigest(y, a) for a, y in zip(h, w[1:])]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_grams_are_xxhash64_of_words_and_pairs(monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcÄé日$#X") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 90])))
    texts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None, "  a\n\tb ", "x" * 500]
    got = Counter((i, g) for h, r in ngram_counts.grams(pa.array(texts)) for i, g in zip(r.tolist(), h.tolist()))
    assert got == Counter((i, g) for i, t in enumerate(texts) for g in brute_grams(t))


def test_numbers_survive_packing():
    rng = np.random.default_rng(1)
    for top in (1, 200, 1 << 20, 1 << 52):
        x = np.sort(rng.integers(0, top, 1000))
        assert (ngram_counts.ungap(ngram_counts.gaps(x)) == x).all()
        assert (ngram_counts._unsigned(ngram_counts._signed(x - top // 2)) == x - top // 2).all()
    none = np.zeros(0, np.int64)
    assert len(ngram_counts.widen(ngram_counts.squeeze(none))) == 0


def test_sketch_is_near_the_exact_number():
    for n in (0, 1, 5_000, 200_000):
        texts = pa.array([" ".join(f"w{k}" for k in range(a, min(n, a + 1000))) for a in range(0, n, 1000)], pa.string())
        found = list(ngram_counts.sketch([pa.RecordBatch.from_arrays([texts], names=["text"])] * 2))
        exact = len({g for t in texts.to_pylist() for g in brute_grams(t)})
        ranks = found[0].column("rank").to_numpy() if found else np.zeros(0)
        assert ngram_counts.distinct(ranks) == pytest.approx(exact, rel=0.03)


def test_scores_over_fragments_salts_and_batches(shipped, tmp, monkeypatch):
    rng = random.Random(5)
    rows = [(k % 37 if k < 38 else (k if k % 7 else None), " ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randrange(90))),
             "en", "s", 0) for k in range(120)] + [(500, None, "en", "s", 0), (501, "  ", "en", "s", 0)]
    rows += [(600, rows[3][1], "en", "s", 0)] * 3
    for part in range(4):
        frame(shipped, rows[part::4]).coalesce(1).write.mode("append").parquet(f"{tmp}/docs")
    docs = shipped.read.parquet(f"{tmp}/docs").repartition(4)
    docs.write.parquet(f"{tmp}/spread")
    docs = shipped.read.parquet(f"{tmp}/spread")
    buckets, good = 1000, {*range(0, 20), 600}
    monkeypatch.setattr(ngram_counts, "FRAGMENT", 70)
    monkeypatch.setattr(ngram_counts, "FRAGMENTS", 10)
    monkeypatch.setattr(ngram_counts, "GROUP", 200)
    monkeypatch.setattr(quality, "HOT", 400)
    total = sum(len(brute_grams(t)) for _, t, *_ in rows)
    assert ngram_counts.salts(total, buckets) > 2 and -(-buckets // ngram_counts.fragment_size(buckets)) == 10
    bucket = lambda g: (g - (1 << 64) if g >> 63 else g) % buckets
    raw = Counter(bucket(g) for _, t, *_ in rows for g in brute_grams(t))
    target = Counter(bucket(g) for i, t, *_ in rows if i in good for g in brute_grams(t))
    trusted = shipped.createDataFrame([(i,) for i in good] * 2 + [(None,)], "doc_id bigint")
    a, b = total + buckets, sum(target.values()) + buckets
    ratio = {g: round(np.log((target[g] + 1) / b / ((raw[g] + 1) / a)) * quality.SCALE) for g in raw}
    table = {r["bucket"]: r for r in row_dicts(quality.log_ratios(docs, trusted, buckets))}
    assert {g: r["r"] for g, r in table.items()} == ratio
    assert {g for g, r in table.items() if r["hot"]} == {g for g in raw if raw[g] * 400 >= total} != set()
    out = sorted(((r["doc_id"], r["llr"]) for r in row_dicts(quality.quality_rules(docs, trusted, buckets))), key=repr)
    want = sorted(((i, sum(ratio[bucket(g)] for g in brute_grams(t)) / max(1, len(brute_grams(t))) / quality.SCALE)
                   for i, t, *_ in rows), key=repr)
    assert out == want
