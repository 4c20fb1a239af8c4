"""Personal data in other spelling, secrets by repository, the classifier and the
pipeline against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from limnos.llm import line_dedup, ngram_join, packing, pii, quality, secrets, toxicity
from tests.llm.conftest import EDGE, frame, row_dicts
from tests.llm.test_corpus_operators import LOWER, WORD, Union, naive_best_fit

LABELS = "doc_id bigint, quality int, toxic int"


# ---- personal data ----

def personal_texts(n, seed):
    rng = random.Random(seed)
    fill = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(k))

    def card():
        d = [rng.randrange(1, 10) for _ in range(15)]
        return next(s for s in ("".join(map(str, d)) + str(k) for k in range(10)) if pii.luhn(s))
    make = [lambda: f"{fill(1)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
            card, lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"]
    noise = [lambda: f"version {rng.randrange(9)}.{rng.randrange(9)}", lambda: f"{rng.getrandbits(64):016x}", lambda: str(rng.randrange(2100)),
             lambda: "".join(str(rng.randrange(10)) for _ in range(20))]
    return [f"{fill(12)} {make[k % 4]()} {fill(8)} {rng.choice(noise)()} {fill(6)}" for k in range(n)]


@pytest.fixture(scope="module")
def tagger():
    windows = [w for t in personal_texts(300, 1) for w in pii.training_windows(t)]
    model = pii.Tagger()
    model.fit(np.stack([a for a, _ in windows]), np.stack([b for _, b in windows]))
    return model


def test_model_finds_data_in_other_spellings(tagger):
    rng, hit, total, wrong = random.Random(9), 0, 0, 0
    for text in personal_texts(200, 2):
        new, spans = pii.rewritten(text, pii.base_spans(text), rng)
        (base, added), = pii.find_spans(tagger, [new])
        want = set(spans) - set(base)
        hit, total, wrong = hit + len(want & set(added)), total + len(want), wrong + len(set(added) - want)
    print(f"held-out spans in other spellings: recall {hit / total:.3f}, precision {hit / max(1, hit + wrong):.3f}")
    assert total > 150 and hit >= 0.9 * total and wrong <= 0.05 * total


@pytest.mark.parametrize("text, found", [
    ("please dial (212) 555-0199 today ok", [(3, "(212) 555-0199")]),
    ("the host at 10[.]20[.]30[.]40 fails", [(1, "10[.]20[.]30[.]40")]),
    ("abe dah +1 (826) 555-4081 190.137.223.204 cab fed", [(3, "+1 (826) 555-4081")]),    # the base pattern takes both numbers
    ("abc cde fgh 12.5.2024 and 3.14 then 99", []), ("abcd 04dbebab91ab85687d33eeaaf9ac699e1188 efgh", []),
    ("abc 300[.]20[.]30[.]40 def", []), ("", [])])
def test_added_spans_by_hand(tagger, text, found):
    (_, added), = pii.find_spans(tagger, [text])
    assert [(k, text[a:z]) for k, a, z in added] == found


def test_added_spans_reach_the_result(shipped):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(personal_texts(240, 3))]
    rows += [(1000 + k, f"abc def {200 + k} 555 {1000 + k} gh cab", "en", "s", 0) for k in range(20)]
    rows += [(0, "other texts 7 under a sampled id " + str(k), "en", "s", 0) for k in range(50)]
    got = row_dicts(pii.personal_data(frame(shipped, rows, extra=True)))
    added = {r["doc_id"]: r["n_added"] for r in got if r["doc_id"] >= 1000}
    assert sum(added.values()) >= 16
    assert all(r["n_spans"] == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"] for r in got)


# ---- secrets ----

def test_values_in_many_repositories_are_copies(shipped):
    spread, own = "Zq3vB9xK2mN7pR5tW8yA1cD4", "Qw8eR5tY2uI9oP6aS3dF7gH1"
    rows = [(k, f"see {spread} there", f"l{k}", "a", 0) for k in range(50)] + [(100, f"key {own} x", "l", "b", 0), (101, f"key {own}", "m", "b", 0)]
    docs = frame(shipped, rows).withColumn("repository", F.concat_ws("/", "source", "lang"))
    out = {r["doc_id"]: r for r in row_dicts(secrets.secret_scan(docs))}
    assert (out[0]["n_live"], out[0]["n_copied"], out[0]["most_owners"], out[0]["most_repositories"]) == (0, 1, 1, 50)
    assert out[0]["spans"] == [] and len(out[100]["spans"]) == 1 and out[100]["most_repositories"] == 2


def test_no_owner_is_not_the_empty_owner(shipped):
    value = "Zq3vB9xK2mN7pR5tW8yA1cD4"
    docs = frame(shipped, [(k, f"see {value}", "en", s, 0) for k, s in enumerate([None, "", None, "a"])]).withColumn("repository", F.lit("r"))
    assert {r["most_owners"] for r in row_dicts(secrets.secret_scan(docs))} == {3}


# ---- classifier ----

def naive_score(model, rows):
    """Convolution and pooling, window by window."""
    x = [sum((model.emb[k].astype(np.float64) for k in row), np.zeros(toxicity.DIMS)) for row in rows.tolist()]
    total = float(model.offset)
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max((sum(x[a + j] @ model.conv[k][j, :, f].astype(np.float64) for j in range(w)) + model.bias[k][f]
                        for a in range(len(x) - w + 1)), default=0.0)
            total += float(model.out[k * toxicity.FILTERS + f]) * max(0.0, best)
    return 1 / (1 + np.exp(-total))


def small_model(seed=4):
    rng, model = np.random.default_rng(seed), toxicity.Model()
    model.emb = rng.normal(0, 0.6, model.emb.shape).astype(np.float32)
    model.emb[0] = 0
    model.conv = [rng.normal(0, 0.5, c.shape).astype(np.float32) for c in model.conv]
    model.out = rng.normal(0, 0.5, model.out.shape).astype(np.float32)
    return model


def test_scores_equal_window_by_window_convolution():
    import pyarrow as pa
    model, rng = small_model(), random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "be", "gammas", "delta9", "Éa", "x"]) for _ in range(n)) for n in (0, 1, 2, 3, 7, 60)]
    rows, at = toxicity.features(pa.array([*texts, None]))
    got = model.scores(rows, at)
    want = [naive_score(model, rows[a:z]) for a, z in zip(at[:-1], at[1:])]
    assert got == pytest.approx(want, abs=1e-5)
    # blocks shorter than a text give the same maxima
    assert np.allclose(model.pooled(rows, at, block=5), model.pooled(rows, at))


def test_training_step_follows_the_numerical_gradient():
    import pyarrow as pa
    rows, _ = toxicity.features(pa.array(["alpha beta gamma delta alpha epsilon"]))
    def loss(m, y):
        p = naive_score(m, rows)
        return -np.log(p if y else 1 - p)
    for y in (0, 1):
        model, rate = small_model(), 1e-4
        before = small_model()
        model.fit([rows], np.array([y]), epochs=1, rate=rate)
        weight = 0.5                        # each class weighs half of all rows
        for k in range(len(toxicity.WIDTHS)):
            for f in range(2):
                eps = 1e-2
                up, down = small_model(), small_model()
                up.bias[k][f] += eps
                down.bias[k][f] -= eps
                slope = (loss(up, y) - loss(down, y)) / (2 * eps)
                step = (before.bias[k][f] - model.bias[k][f]) / rate
                assert step == pytest.approx(weight * slope, abs=2e-2), (y, k, f)


def test_sample_takes_one_text_of_a_doc_id(shipped):
    rows = [(1, f"text {k}", "en", "s", 0) for k in range(500)] + [(2, "b", "en", "s", 0)]
    labels = shipped.createDataFrame([(k, 1, k % 2) for k in range(1, 40)], LABELS)
    got = toxicity.training_sample(frame(shipped, rows), labels)
    assert Counter(r["doc_id"] for r in row_dicts(got)) == {k: 1 for k in (1, 2) if zlib.crc32(str(k).encode()) % 4 != 2}


# ---- clashing names ----

CLASHING = ["_doc", "_th", "_hash", "_removed", "row", "i", "h", "j", "g", "gone", "kept", "removed", "grp", "th"]


def test_stages_take_columns_of_any_name(shipped):
    docs = frame(shipped, EDGE)
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    trusted = shipped.createDataFrame([(1,)], "doc_id bigint")
    for out in (quality.keep_good(docs, trusted), line_dedup.dedup_lines(docs), ngram_join.keep_one(docs)):
        assert out.columns == docs.columns
        for r in row_dicts(out):
            assert all(r[c] == f"own {c}" for c in CLASHING)


# ---- pipeline ----

def corpus():
    rng = random.Random(11)
    words = ["w%d" % k for k in range(200)]
    long = lambda n=70: " ".join(rng.choice(words) for _ in range(n))
    line = long(12)
    rows = [(k, f"{long(60)}\n{line}\n{long(30)}", "en", f"s{k % 3}", 0) for k in range(12)]        # a line in all
    rows += [(20 + k, f"{long(60)}\n{line[:-1]}x\n{long(20)}", "en", "s0", 0) for k in range(3)]     # a similar one
    base = long(120).split(" ")
    rows += [(30 + k, "\n".join(" ".join(base[a:a + 17 + 6 * k]) for a in range(0, 120, 17 + 6 * k)) + f"\ntail{k}", "en", "s1", 0)
             for k in range(4)]                                                                      # near copies, broken elsewhere
    rows += [(40 + k, "junk$$ spam%% " + " ".join(rng.choice(["buy", "now", "cheap", "click"]) + str(rng.randrange(60)) for _ in range(90)), "en", "s2", 0)
             for k in range(8)]                                                                      # bad ones
    rows += [(60, long(60) + " write to abe.34@mail7.example.com or 97.51.17.173", "en", "s0", 0), (61, "short", "en", "s0", 0),
             (62, None, "en", "s0", None), (63, long(60) + " " + long(2500), "en", None, 0)]
    labels = [(k, 1, 0) for k in (*range(12), *range(20, 24), *range(30, 34), 60, 63)] + [(k, 0, 0) for k in range(40, 48)]
    return [(i, t, g, s, len(t) if t else n) for i, t, g, s, n in rows], labels


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_quality(rows, labels, buckets):
    good = {i for i, q, _ in labels if q == 1}
    grams = {}
    for i, t, *_ in rows:
        w = [x.encode() for x in WORD.findall(t or "")]
        h = [xxhash.xxh64_intdigest(x, 42) for x in w]
        h += [xxhash.xxh64_intdigest(y, xxhash.xxh64_intdigest(x, 42)) for x, y in zip(w, w[1:])]
        grams[i] = [signed(x) % buckets for x in h]
    raw = Counter(g for gs in grams.values() for g in gs)
    target = Counter(g for i, gs in grams.items() if i in good for g in gs)
    a, b = sum(raw.values()) + buckets, sum(target.values()) + buckets
    kept = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        three = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        seen, covered = Counter(three), set()
        for k, g in enumerate(three):
            covered |= {k, k + 1, k + 2} if seen[g] > 1 else set()
        score = np.mean([np.log((target[g] + 1) / b * a / (raw[g] + 1)) for g in grams[r[0]]]) if grams[r[0]] else 0
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and score >= quality.THRESHOLD:
            kept.append(r)
    return kept


def grams_of(line):
    return {line[k:k + 6] for k in range(len(line) - 5)} or {line}


def brute_lines(rows):
    at = [(r[0], xxhash_text(r[1]), k, x) for r in rows for k, x in enumerate((r[1] or "").split("\n")) if WORD.search(x)]
    lines = sorted({x for *_, x in at})
    sets, u = [grams_of(x) for x in lines], Union(len(lines))
    for a in range(len(lines)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u.join(a, b)
    first = {}
    for i, th, k, x in sorted(at):
        first.setdefault(u.find(lines.index(x)), (i, k))
    gone = {(i, k) for i, _, k, x in at if first[u.find(lines.index(x))] != (i, k)}
    out = []
    for i, t, g, s, n in rows:
        lost = [k for k in range(len((t or "").split("\n"))) if (i, k) in gone]
        new = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost) if lost else t
        if not lost or WORD.search(new):
            out.append((i, new, g, s, len(new) if lost else n))
    return out


def xxhash_text(t):
    return signed(xxhash.xxh64_intdigest((t or "").encode(), 42))


def brute_near(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    u = Union(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u.join(a, b)
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        first.setdefault(u.find(k), k)
    return [r for k, r in enumerate(rows) if first[u.find(k)] == k]


def test_pipeline_equals_brute_force_stage_by_stage(shipped, tmp):
    import corpus_pipeline
    rows, labels = corpus()
    frame(shipped, rows).write.parquet(f"{tmp}/documents.parquet")
    shipped.createDataFrame(labels, LABELS).write.parquet(f"{tmp}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    order = lambda rs: sorted(rs, key=lambda r: r[0])

    def run(name, given):
        docs = frame(shipped, given)
        return order([tuple(r) for r in stages[name](shipped, docs, tmp).collect()])
    kept = order(brute_quality(rows, labels, quality.bucket_count(frame(shipped, rows))))
    assert run("quality_rules", rows) == kept and 15 < len(kept) < len(rows) - 8
    cut = order(brute_lines(kept))
    assert run("line_dedup", kept) == cut != kept
    one = order(brute_near(cut))
    assert run("ngram_jaccard_join", cut) == one and len(one) < len(cut)
    hidden = run("personal_data", one)
    base = order([(i, pii.masked(t, pii.base_spans(t)), g, s, n) for i, t, g, s, n in one])
    assert [r[:1] + r[2:4] for r in hidden] == [r[:1] + r[2:4] for r in base]
    assert [r[1] for r in hidden] == [r[1] for r in base]          # no other spelling of personal data in these texts
    assert all(r[4] == len(r[1]) for r in hidden) and "<EMAIL>" in dict((r[0], r[1]) for r in hidden)[60]
    # all stages in one run: the same documents packed, every bin within the rules of best fit
    packed = corpus_pipeline.run(shipped, tmp).collect()
    words = Counter()
    for r in packed:
        words[r["doc_id"]] += r["n_words"]
    assert words == {i: len(WORD.findall(t)) for i, t, *_ in hidden}
    items = sorted(((len(WORD.findall(t)) % packing.CAPACITY, i, s) for i, t, _, s, _ in hidden), key=lambda x: (-x[0], x[1]))
    bins = naive_best_fit([(n, s, i) for n, i, s in items if n], packing.CAPACITY)
    whole = sum(len(WORD.findall(t)) // packing.CAPACITY for _, t, *_ in hidden)
    assert len({r["bin_id"] for r in packed}) == len({b for b, _ in bins}) + whole


def test_copies_of_a_long_text_are_encoded_once(shipped, monkeypatch):
    from limnos.llm import bpe
    from limnos.llm.queries import tokenizer_path
    path, text = tokenizer_path("word_bpe_49k.json"), "some words and longwordwithoutbreaks" * 40
    rows = [(1, text, "en", "s", 0)] * 7 + [(2, text, "en", "s", 0), (None, text, "en", "s", 0), (3, "short", "en", "s", 0)]
    monkeypatch.setattr(bpe, "COPIES", 3)
    got = row_dicts(bpe.encode_decode(frame(shipped, rows), path, leaf=100))
    assert Counter(r["doc_id"] for r in got) == {1: 7, 2: 1, None: 1, 3: 1}
    assert {r["n_tokens"] for r in got if r["doc_id"] != 3} == {len(bpe.Encoder(path, "words").plain(text))}
