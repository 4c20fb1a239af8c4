"""Findings of round 3 on the corpus operators."""

import random
import zlib

import numpy as np
import pyarrow as pa

from limnos.llm import toxicity
from tests.llm.conftest import frame, row_dicts

LABELS = "doc_id bigint, quality int, toxic int"


def trained_on(i):
    return zlib.crc32(str(i).encode()) % 4 != toxicity.HELD_OUT


def test_training_takes_every_labelled_row_and_whole_texts(shipped):
    n = 9000
    rows = [(i, f"text {i}", "en", "s", 0) for i in range(n)] + [(n + 3, "long " * 20_000, "en", "s", 0), (n + 4, None, "en", "s", 0)]
    labels = shipped.createDataFrame([(r[0], 1, int(r[0] % 10 > 5)) for r in rows], LABELS)
    got = {r["doc_id"]: r for r in row_dicts(toxicity.training_sample(frame(shipped, rows), labels))}
    assert set(got) == {r[0] for r in rows if trained_on(r[0])}
    assert all(got[r[0]]["text"] == (r[1] or "") for r in rows if trained_on(r[0]))


def small_corpus(shipped, n=160):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["calm", "river", "stone"]) + rng.choice("abcd") for _ in range(rng.randrange(1, 30)))
             + (" grumbak" if i % 3 == 0 else ""), "en", "s", 0) for i in range(n)]
    return rows, frame(shipped, rows), shipped.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(n)], LABELS)


def test_document_frequencies_and_averaged_steps(shipped):
    rows, docs, labels = small_corpus(shipped)
    train = toxicity.training_sample(docs, labels).selectExpr("doc_id", "cast(y as int) y", "lang", "text")
    texts = [(r[0], int(r[0] % 3 == 0), f) for r in rows if trained_on(r[0]) for f in toxicity.cut_features(pa.array([r[1]]))]
    seen = np.zeros((2, toxicity.BUCKETS + 1))
    for _, y, f in texts:
        seen[y, np.unique(f)] += 1
    assert np.array_equal(toxicity.document_frequencies(train), seen)

    sizes = tuple(int(sum(t[1] == y for t in texts)) for y in (0, 1))
    shard = {r["doc_id"]: r["s"] for r in row_dicts(train.selectExpr("doc_id", "pmod(xxhash64(doc_id), 3) s"))}
    assert set(shard.values()) == {0, 1, 2}
    model, parts = toxicity.Model(), []
    model.start_from(seen, np.array(sizes))
    for s in range(3):
        own = [t for t in texts if shard[t[0]] == s]
        m = toxicity.Model()
        m.start_from(seen, np.array(sizes))
        m.fit([t[2] for t in own], np.array([t[1] for t in own]), sizes=sizes)
        parts.append(m)
    change = np.stack([m.emb - model.emb for m in parts])
    touched = np.maximum(1, change.any(axis=2).sum(axis=0))
    want = model.emb + change.sum(axis=0) / touched[:, None]
    layers = np.mean([m.layers() for m in parts], axis=0)
    toxicity.averaged_fit(train, model, 3, sizes)
    assert np.allclose(model.emb, want, atol=1e-5)
    assert np.allclose(model.layers(), layers, atol=1e-5)


def test_model_does_not_depend_on_partitions(shipped, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 2000)
    _, docs, labels = small_corpus(shipped)
    assert toxicity.shard_count(docs) > 2
    (a, cuts), (b, other) = (toxicity.train(docs.repartition(p), labels) for p in (1, 7))
    assert cuts == other and np.array_equal(a.emb, b.emb) and np.array_equal(a.layers(), b.layers())
