"""Operators over many texts: n-gram join, line dedup, BPE, token files,
toxicity, packing, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.llm import bpe, line_dedup, ngram_join, packing, token_files, toxicity
from limnos.llm.common import documents, scratch
from limnos.llm.components import components
from limnos.llm.queries import tokenizer_path
from tests.conftest import SF_SMALL
from tests.llm.conftest import EDGE, frame, row_dicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_copies(seed=0, groups=6, copies=25):
    """Groups of variants of a text with a common passage in all, so that
    similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(12)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(60)] + passage
        for c in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = "new%d" % rng.randrange(10 ** 6)
            rows.append((1000 - len(rows), " ".join(w).upper() if c % 7 == 3 else " ".join(w), "en", "s", 0))
    return rows


def shingle_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    union = Union(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                union.join(a, b)
    first = {}
    for k, (i, *_) in enumerate(rows):
        r = union.find(k)
        if sets[k] and i is not None:
            first[r] = min(i, first.get(r, i))
    return Counter((i, len(sets[k]), first.get(union.find(k)) if sets[k] else i) for k, (i, *_) in enumerate(rows))


def test_components_of_paths_and_stars(shipped):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["id"]: r["comp"] for r in row_dicts(components(shipped.createDataFrame(edges, "a bigint, b bigint")))}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}


@pytest.mark.parametrize("seed", [0, 1])
def test_ngram_components_match_all_pairs(shipped, seed):
    rows = near_copies(seed) + [(5000 + k, t, l, s, n) for k, (_, t, l, s, n) in enumerate(EDGE)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"])
                  for r in row_dicts(ngram_join.ngram_components(frame(shipped, rows, extra=True))))
    assert got == shingle_components(rows)


def test_ngram_edges_and_empty(edge, nothing):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in row_dicts(ngram_join.ngram_components(edge)))
    assert got == shingle_components(EDGE)
    assert ngram_join.ngram_components(nothing).count() == 0
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns and {r["doc_id"] for r in row_dicts(kept)} >= {3, 4, 5, 6, 7, 8, 9, 10, None}


def fuzzy_lines(rows):
    lines = {}
    for _, t, *_ in rows:
        for x in (t or "").split("\n"):
            if x.strip(line_dedup.BLANK):
                lines.setdefault(x, len(lines))
    k = line_dedup.CHARS
    sets = [frozenset(x[j:j + k] for j in range(max(1, len(x) - k + 1))) for x in lines]
    union = Union(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                union.join(a, b)
    return lines, union


def test_line_dedup_keeps_one_line_per_component(shipped):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = [" ".join(word() for _ in range(14)) for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for x in rng.sample(base, 4):
            w = x.split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = word()
            text.append(" ".join(w))
        rows.append((i, "\n".join([*text, "", " ".join(word() for _ in range(9))]), "en", "s", 0))
    docs = frame(shipped, rows, extra=True)
    hash_of = {r["doc_id"]: r["th"] for r in row_dicts(docs.select("doc_id", F.xxhash64("text").alias("th")))}
    lines, union = fuzzy_lines(rows)
    first = {}
    for i, t, *_ in rows:
        for p, x in enumerate(t.split("\n")):
            if x.strip():
                c = union.find(lines[x])
                first[c] = min(first.get(c, (i, hash_of[i], p)), (i, hash_of[i], p))
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n"))
                         if not x.strip() or first[union.find(lines[x])] == (i, hash_of[i], p)) for i, t, *_ in rows}
    got = {r["doc_id"]: r["text"] for r in row_dicts(line_dedup.cut_lines(docs))}
    assert got == want


@pytest.mark.parametrize("low,high", [(15, 30), (31, 60), (100, 150)])
def test_line_keys_find_pairs_at_the_threshold(low, high):
    rng = random.Random(low)
    letters = "abcdefghijklmnopqrstuvwxyz "
    pairs = []
    while len(pairs) < 1500:
        x = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        y = x[:-rng.randint(1, max(1, len(x) // 6))] + rng.choice(["", "7", "42"])
        a, b = ({t[k:k + 6] for k in range(len(t) - 5)} for t in (x, y))
        if 0.8 <= len(a & b) / len(a | b) <= 0.88:
            pairs.append((x, y))
    keys, counts = line_dedup.line_keys([t for p in pairs for t in p])
    parts = np.split(keys, np.cumsum(counts)[:-1])
    found = sum(len(np.intersect1d(parts[2 * k], parts[2 * k + 1])) > 0 for k in range(len(pairs)))
    assert found >= 0.985 * len(pairs)


def test_line_dedup_edges_and_empty(edge_extra, nothing):
    out = line_dedup.dedup_lines(edge_extra)
    assert out.columns == edge_extra.columns
    got = Counter(r["doc_id"] for r in row_dicts(out))
    assert got[1] == 2 and got[3] == got[4] == got[5] == 1      # equal rows alike, blank texts stay
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_ids_equal_sparks(shipped):
    for x in ("a", "héllo 😀", "x" * 100):
        assert shipped.sql(f"select xxhash64('{x}') h").first().h == line_dedup.line_id(x)


ALPHABET = [*"abc THE'sS!?.-_019  \n\tßİσς", "é", "é", "́", "가", "ᅡ", "😀", "你", "<|endoftext|>", "'re", " ",
            "　", "ﬁ", "aaaa", "the", "ing"]


@pytest.mark.parametrize("name,rule", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_tree_concatenation_equals_the_library(name, rule):
    rng, enc = random.Random(9), bpe.Encoder(tokenizer_path(name), rule)
    for n in range(300):
        letters = ALPHABET if n % 2 else rng.sample(ALPHABET, 4)
        text = "".join(rng.choice(letters) for _ in range(rng.choice([3, 60, 700, 2000])))
        want = enc.plain(text)
        assert enc.encode([text])[0].tolist() == want
        pieces = bpe.halves(text, 150)
        assert bpe.join_tree(enc, pieces, enc.encode(pieces)).tolist() == want
    unsplit = "ab" * 5000
    pieces = bpe.halves(unsplit, 700)
    assert bpe.join_tree(enc, pieces, enc.encode(pieces)).tolist() == enc.plain(unsplit)


def test_encode_decode_rows(edge, nothing):
    path = tokenizer_path("word_bpe_49k.json")
    enc = bpe.Encoder(path, "words")
    got = Counter(tuple(r.values()) for r in row_dicts(bpe.encode_decode(edge, path, leaf=9000)))
    want = Counter()
    for i, t, *_ in EDGE:
        ids = enc.plain(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256(enc.library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want
    assert bpe.encode_decode(nothing, path).count() == 0


def test_token_files_round_trip_and_random_access(edge, nothing):
    spark, path = edge.sparkSession, tokenizer_path("byte_bpe_50k.json")
    enc = bpe.Encoder(path, "bytes")
    manifest = token_files.write_shards(edge, path, scratch(spark, "test"))
    got = sorted(row_dicts(token_files.read_shards(spark, manifest)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in EDGE), key=lambda i: (i is not None, i or 0))
    tokens = Counter()
    for i, t, *_ in EDGE:
        ids = np.array([*enc.plain(t or ""), 0], "<u4")
        tokens[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == tokens
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    for r in manifest.collect():
        reader = token_files.ShardReader(r.path)
        for _, i, ids in reader.documents({9}):
            assert ids.tolist() == [*enc.plain(EDGE[11][1]), 0] and i == 9
        reader.close()
    assert token_files.write_and_read(nothing, path).count() == 0


def test_token_file_detects_a_broken_frame(tmp_path):
    name = str(tmp_path / "a.zst")
    writer = token_files.ShardWriter(open(name, "wb"))
    for i in range(30):
        writer.add(i, np.arange(i * 9000, dtype=np.uint32))
    writer.close()
    reader = token_files.ShardReader(name)
    assert all(ids.tolist() == list(range(k * 9000)) for k, _, ids in reader.documents())
    reader.sums = reader.sums.copy()
    reader.sums[1] ^= 1
    reader._frame = -1
    with pytest.raises(ValueError, match="checksum"):
        list(reader.documents())


def test_toxicity_held_out_accuracy_and_edges(shipped, edge_extra, nothing):
    rng = random.Random(2)
    clean = ["calm", "river", "stone", "walks", "under", "green", "light", "every", "morning", "story"]
    rude = ["grumbak", "snorvil", "plonkerd"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(clean) + rng.choice("abcdefgh") for _ in range(rng.randrange(5, 80))]
        y = i % 3 == 0
        for _ in range(2 * y):
            w.insert(rng.randrange(len(w)), rng.choice(rude) + rng.choice(["", "s", "en"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(y)))
    labels = shipped.createDataFrame(labels + [(None, 1, 1), (1, 1, None), (10 ** 9, 0, 1)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in row_dicts(toxicity.toxicity(frame(shipped, rows, extra=True), labels))}
    held = [i for i in out if out[i]["held_out"]]
    assert set(held) == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [out[i]["predicted"] == int(i % 3 == 0) for i in held]
    assert np.mean(right) > 0.95
    assert toxicity.toxicity(edge_extra, labels).count() == len(EDGE)
    assert toxicity.toxicity(nothing, labels.limit(0)).count() == 0
    scores = {r["doc_id"]: r["score"] for r in row_dicts(toxicity.toxicity(edge_extra, labels.limit(0)))}
    assert scores[3] == scores[4] and all(0 <= s <= 1 for s in scores.values())


def naive_best_fit(items, capacity):
    bins, placed = [], []
    for length, source, cluster in items:
        fits = [(room, b) for b, (room, sources, clusters) in enumerate(bins)
                if room >= length and source not in sources and cluster not in clusters]
        if fits:
            room, b = min(fits)
        else:
            room, b = capacity, len(bins)
            bins.append((capacity, set(), set()))
        bins[b] = (room - length, bins[b][1] | {source}, bins[b][2] | {cluster})
        placed.append((b, capacity - room))
    return placed


def test_best_fit_against_scanning_all_bins():
    rng = random.Random(3)
    for _ in range(40):
        items = sorted(((rng.randrange(1, 100), rng.choice("aaabcdef"), rng.randrange(40)) for _ in range(150)), reverse=True)
        assert packing.best_fit(items, 100) == naive_best_fit(items, 100)


def test_packing_invariants_and_edges(shipped, edge_extra, nothing):
    rows = [(i, " ".join(["w%d" % (i % 50)] * (i % 37 + 1)), "en", "hot" if i % 3 else f"s{i % 11}", 0) for i in range(900)]
    out = row_dicts(packing.pack_documents(frame(shipped, rows), capacity=64, group_items=200))
    assert Counter(r["doc_id"] for r in out) == Counter(range(900))
    bins = defaultdict(list)
    for r in out:
        bins[r["bin_id"]].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["start"])
        assert held[0]["start"] == 0 and sum(r["n_words"] for r in held) <= 64
        assert all(a["start"] + a["n_words"] == b["start"] for a, b in zip(held, held[1:]))
        assert len({rows[r["doc_id"]][3] for r in held}) == len(held) == len({rows[r["doc_id"]][1] for r in held})
    out = row_dicts(packing.pack_documents(edge_extra))
    words = Counter()
    for r in out:
        words[r["doc_id"]] += r["n_words"]
    want = Counter()
    for i, t, *_ in EDGE:
        want[i] += len(WORD.findall(t or ""))
    assert words == want and all(r["bin_id"] is None for r in out if r["doc_id"] in (3, 4, 5))
    assert packing.pack_documents(nothing).count() == 0


def test_pipeline_stages_chain(shipped, nothing):
    import corpus_pipeline
    docs = documents(shipped, SF_SMALL)
    before = {r["doc_id"]: r["text"] for r in row_dicts(docs)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(shipped, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        docs = out.cache()
        assert 0 < docs.count() <= len(before)
    lengths = {r["doc_id"]: len(WORD.findall(r["text"])) for r in row_dicts(docs)}
    packed = Counter()
    for r in row_dicts(corpus_pipeline.STAGES[-1][1](shipped, docs, SF_SMALL)):
        packed[r["doc_id"]] += r["n_words"]
    assert dict(packed) == lengths
    for name, stage in corpus_pipeline.STAGES:
        assert stage(shipped, nothing, SF_SMALL).count() == 0, name


def thue_morse(n=2048):
    """The sequence and its complement: equal under any sum of powers modulo 2^64."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[k] for k in bits), "".join("ba"[k] for k in bits)


@pytest.mark.parametrize("name, rule", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_cache_never_mixes_chunks(name, rule, monkeypatch):
    x, y = thue_morse()
    texts = [x, y, x + " " + y, "alpha beta", "gamma " + "long" * 20 + " beta", "long" * 20]
    enc = bpe.Encoder(tokenizer_path(name), rule)
    plain = [enc.plain(t) for t in texts]
    assert [t.tolist() for t in enc.encode(texts)] == plain
    # with one hash for all chunks, the bytes alone tell them apart
    monkeypatch.setattr(bpe, "span_hashes", lambda b, starts, ends, blocks: np.zeros(len(starts), np.uint64))
    enc = bpe.Encoder(tokenizer_path(name), rule)
    for _ in range(2):
        assert [t.tolist() for t in enc.encode(texts)] == plain


def test_words_with_equal_sums_are_no_copies(shipped):
    x, y = thue_morse()
    rows = [(1, x, "en", "s", 0), (2, y, "en", "s", 0), (3, x.upper(), "en", "s", 0)]
    got = {r["doc_id"]: r["component_id"] for r in row_dicts(ngram_join.ngram_components(frame(shipped, rows)))}
    assert got == {1: 1, 2: 2, 3: 1}
