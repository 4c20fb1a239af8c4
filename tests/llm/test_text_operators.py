"""Operators on single texts against brute force: quality rules, fingerprints,
secret scans, personal data."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.llm import fingerprint, pii, quality, secrets
from limnos.llm.common import documents, labels
from tests.conftest import SF_SMALL
from tests.llm.conftest import EDGE, frame, row_dicts

SF_MEDIUM = "/root/testdata/sf0.01"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    seen, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_features_match_brute_force(edge_extra):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                  for r in row_dicts(quality.base_features(edge_extra)))
    want = Counter((i, *rules(t)[:5]) for i, t, *_ in EDGE)
    assert got == want


def test_quality_score_is_the_mean_log_ratio(shipped):
    rows = [(k, " ".join(["good", "plain", "text"] * 30), "en", "s", 0) for k in range(4)] \
        + [(k, " ".join(["bad$$", "junk##", "spam%%"] * 30), "en", "s", 0) for k in range(4, 8)] + [(9, None, "en", "s", 0)]
    docs = frame(shipped, rows)
    trusted = shipped.createDataFrame([(0,), (1,), (None,)], "doc_id bigint")
    out = {r["doc_id"]: r for r in row_dicts(quality.quality_rules(docs, trusted, buckets=64))}
    grams = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        grams[i] = [(a,) for a in w] + list(zip(w, w[1:]))
    names = sorted({g for gs in grams.values() for g in gs})
    hashed = {}
    for g in names:
        expr = "xxhash64(" + ", ".join(f"'{x}'" for x in g) + ")"
        hashed[g] = shipped.sql(f"select pmod({expr}, 64) b").first().b
    raw = Counter(hashed[g] for gs in grams.values() for g in gs)
    good = Counter(hashed[g] for i in (0, 1) for g in grams[i])
    n_raw, n_good = sum(raw.values()), sum(good.values())
    for i in (0, 5):
        want = np.mean([np.log((good[hashed[g]] + 1) / (n_good + 64)) - np.log((raw[hashed[g]] + 1) / (n_raw + 64))
                        for g in grams[i]])
        assert out[i]["llr"] == pytest.approx(want, abs=1e-5)
    assert out[0]["llr"] > 0 > out[5]["llr"] and out[9]["kept"] is False
    assert all(r["base_failed"] for r in out.values())          # repeated windows all over


def test_quality_buckets_grow_with_the_corpus(shipped, monkeypatch):
    def corpus(n):
        rows = [(k, " ".join(f"w{k}x{j}" for j in range(100)), "en", "s", 0) for k in range(n)]
        return frame(shipped, rows + [(n + k, "junk spam " * 40, "en", "s", 0) for k in range(3)])
    small, large = (quality.bucket_count(corpus(n)) for n in (20, 200))
    assert small == pytest.approx(20 * 199 / quality.LOAD, rel=0.05)
    assert large == pytest.approx(200 * 199 / quality.LOAD, rel=0.05)
    # the default is that count; ratios joined by shuffle and by broadcast agree
    docs, trusted = corpus(20), shipped.createDataFrame([(k,) for k in range(10)], "doc_id bigint")
    every = {r["doc_id"]: r["llr"] for r in row_dicts(quality.quality_rules(docs, trusted))}
    want = {r["doc_id"]: r["llr"] for r in row_dicts(quality.quality_rules(docs, trusted, buckets=small))}
    monkeypatch.setattr(quality, "HOT", 64)
    ratios = quality.log_ratios(docs, trusted, small)
    assert 0 < ratios.where("hot").count() <= 64 < ratios.where("not hot").count()
    assert {r["doc_id"]: r["llr"] for r in row_dicts(quality.quality_rules(docs, trusted))} == every == want


def test_quality_rejects_bad_and_keeps_unseen_good_documents(shipped):
    docs, marks = documents(shipped, SF_MEDIUM), labels(shipped, SF_MEDIUM).select("doc_id", "quality").distinct()
    held = F.expr("quality = 1 and pmod(xxhash64(doc_id), 5) = 0")
    trusted = quality.trusted_ids(marks.where(~held))
    out = quality.quality_rules(docs, trusted).join(marks, "doc_id").where("n_words >= 50")
    low = F.col("llr") < quality.THRESHOLD
    bad = out.where("quality = 0").agg(F.avg(low.cast("int"))).first()[0]
    good = out.where(held).agg(F.avg(low.cast("int"))).first()[0]
    assert bad >= 0.95 and good <= 0.05


def test_quality_edges_and_empty(edge_extra, nothing, shipped):
    trusted = shipped.createDataFrame([(1,)], "doc_id bigint")
    assert quality.quality_rules(edge_extra, trusted).count() == len(EDGE)
    assert quality.quality_rules(nothing, trusted).count() == 0
    assert quality.keep_good(nothing, trusted).columns == nothing.columns


MIXED = [(50 + k, t, "en", "s", 0) for k, t in enumerate([
    "One sentence. Another one!  A third?\nA line\n\nlast", "cut. " * 30, "No break at all " * 9, "a.b.c. d.\n" * 12,
    "Ends with blanks.     ", "   ", "x", "äöü. ß? 😀! 你好.  end", "One sentence. Another one!  A third?\nA line\n\nlast"])]


def lanes_of(text, spark, known={}):  # noqa: B006
    """Fingerprint by brute force: one hash call a lane group and piece."""
    total = np.zeros(fingerprint.LANES, np.int64)
    for p in re.split(r"\n|(?<=[.!?]) +", text):
        if p:
            if p not in known:
                d = hashlib.sha256(p.encode()).hexdigest()
                calls = ", ".join(f"xxhash64(unhex('{d}'), {w})" for w in range(1, 17))
                h = np.array(spark.sql(f"select array({calls}) h").first().h, np.int64)
                known[p] = ((h[:, None] >> (8 * np.arange(8))) & 255).reshape(-1) - 128
            total += len(p) * known[p]
    return total


def exact_likeness(a, b):
    size = float((a * a).sum() + (b * b).sum())
    return 1.0 if size == 0 else min(1.0, max(0.0, 2 * float((a * b).sum()) / size))


def test_fingerprints_of_texts_edits_and_neighbours(shipped):
    rows = [r for r in EDGE if r[0] not in (7, 8)] + MIXED
    texts = {}
    for i, t, *_ in rows:
        if i is not None:
            texts.setdefault(i, []).append(t or "")
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    want = []
    for i, t, *_ in rows:
        t = t or ""
        k = len(t) // 3
        follow = "" if i is None else min(texts[after[i]], key=lambda x: x[:max(len(y) // 3 for y in texts[i])])
        own, edited = lanes_of(t, shipped), lanes_of(t[:len(t) - k] + follow[:k], shipped)
        near = 0.0 if i is None else exact_likeness(own, lanes_of(follow, shipped))
        want.append((i, len(t), (own % 2 ** 32).tolist(), (edited % 2 ** 32).tolist(), round(exact_likeness(own, edited), 9), round(near, 9)))
    got = [(r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9))
           for r in row_dicts(fingerprint.edited_fingerprints(frame(shipped, rows, extra=True), ranges=3))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fingerprint_edit_and_neighbour(edge):
    rows = row_dicts(fingerprint.edited_fingerprints(edge, ranges=3))
    assert len(rows) == len(EDGE)
    texts = {}
    for i, t, *_ in EDGE:
        if i is not None:
            texts.setdefault(i, []).append(t or "")
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    want = []
    for i, t, *_ in EDGE:
        t = t or ""
        k = len(t) // 3
        # the prefix that was moved is cut at the longest need of the receiver's rows
        follow = "" if i is None else min(texts[after[i]], key=lambda x: x[:max(len(y) // 3 for y in texts[i])])
        want.append((i, len(t), hashlib.sha256((t[:len(t) - k] + follow[:k]).encode()).hexdigest()))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == Counter(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_fingerprint_is_a_multiset_hash(shipped):
    df = frame(shipped, [(1, "a b\nc d\ne", "", "", 0), (2, "e\na b\n\nc d", "", "", 0), (3, "a b\nc d", "", "", 0),
                         (4, "e", "", "", 0), (5, "", "", "", 0), (6, None, "", "", 0)])
    fp = {r["doc_id"]: r["fingerprint"] for r in row_dicts(fingerprint.fingerprints(df))}
    assert fp[1] == fp[2] != fp[3] and fp[5] == fp[6] == [0] * fingerprint.LANES
    both = shipped.createDataFrame([(fp[3], fp[4], fp[1])], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = both.select(fingerprint.combine(F.col("a"), F.col("b")).alias("plus"),
                    fingerprint.combine(F.col("c"), F.col("b"), -1).alias("minus"),
                    fingerprint.likeness("c", "c").alias("same")).first()
    assert r.plus == fp[1] and r.minus == fp[3] and r.same == 1.0


def test_fingerprint_likeness_is_near_the_exact_overlap(shipped):
    def text(k, side, shared):
        own = [f"p{k} {side} {j} {'x' * (j % 7 + 5)}" for j in range(shared, 42)]
        return "\n".join([f"p{k} both {j} {'x' * (j % 7 + 5)}" for j in range(shared)] + own)
    pairs = [(k, text(k, "a", n), text(k, "b", n)) for k in range(600) for n in [28 * (k % 2)]]
    fp = [{r["doc_id"]: r["fingerprint"] for r in row_dicts(fingerprint.fingerprints(
        frame(shipped, [(p[0], p[side], "", "", 0) for p in pairs])))} for side in (1, 2)]
    got = {r["k"]: r["near"] for r in row_dicts(shipped.createDataFrame(
        [(p[0], fp[0][p[0]], fp[1][p[0]]) for p in pairs], "k int, a array<bigint>, b array<bigint>").select(
        "k", fingerprint.likeness("a", "b").alias("near")))}
    errors = {0: [], 1: []}
    for k, a, b in pairs:
        x, y = (Counter(t.split("\n")) for t in (a, b))
        size = sum(c * c * len(p) ** 2 for z in (x, y) for p, c in z.items())
        exact = 2 * sum(c * y[p] * len(p) ** 2 for p, c in x.items()) / size
        errors[k % 2].append(got[k] - exact)
    assert np.quantile(errors[0], 0.95) <= 0.17         # unrelated texts
    assert np.std(errors[1]) <= 0.078                   # two thirds in common


def test_fingerprint_empty_table(nothing):
    assert fingerprint.edited_fingerprints(nothing).count() == 0


SECRET = [(0, re.compile(secrets.ASSIGN.replace("(?i:", "(?ai:")), lambda m: len(m[2]) >= 6),
          (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
          (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def secret_spans(text):
    return sorted((m.start(), k, m.end()) for k, p, ok in SECRET for m in p.finditer(text) if ok(m))


def test_secret_base_spans(edge_extra):
    rows = EDGE + [(20, "PassWord='é😀'; api-key token=\"tok\" token = 'abcdef' secret==a.b/c+d= password=token: abcdefgh", "", "s", 0)]
    docs = frame(edge_extra.sparkSession, rows).withColumn("repository", F.lit("r"))
    got = Counter((r["doc_id"], tuple((x["s"], x["k"], x["e"]) for x in r["base"]))
                  for r in row_dicts(secrets.secret_scan(docs)))
    assert got == Counter((i, tuple(secret_spans(t or ""))) for i, t, *_ in rows)


def test_secret_ownership_separates_copies(shipped):
    live, copied = "Zq3vB9xK2mN7pR5tW8yA1cD4", "AbCdEfGh1234567890IjKlMn"
    rows = [(1, f"key {live} end", "", "a", 0), (2, f"my {live}", "", "a", 0)] \
        + [(10 + k, f"see {copied} there", "", f"o{k}", 0) for k in range(5)]
    docs = frame(shipped, rows).withColumn("repository", F.col("source"))
    out = {r["doc_id"]: r for r in row_dicts(secrets.secret_scan(docs))}
    assert [(x["s"], x["e"]) for x in out[1]["spans"]] == [(4, 28)] and out[1]["n_live"] == 1
    assert out[10]["spans"] == [] and out[10]["n_copied"] == 1


def test_secret_empty(nothing):
    assert secrets.secret_scan(nothing.withColumn("repository", F.lit("r"))).count() == 0


def personal(text):
    out = [(0, m.start(), m.end()) for m in pii.EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in pii.CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        odd = sum(int(c) for c in d[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
        if 13 <= len(d) <= 19 and odd % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in pii.PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_personal_base_spans_and_edges(edge_extra, nothing):
    rows = EDGE + [(30, "4111 1111 1111 1111 and 4111-1111-1111-1112, 1.2.3.4.5 300.1.1.1 0001.02.3.4 +1 (555) 123-4567 a@b", "", "", 0)]
    docs = frame(edge_extra.sparkSession, rows)
    got = Counter((r["doc_id"], r["base"]) for r in row_dicts(pii.personal_data(docs)))
    assert got == Counter((i, pii.as_text(personal(t or ""))) for i, t, *_ in rows)
    assert pii.personal_data(nothing).count() == 0
    hidden = {r["doc_id"]: r for r in row_dicts(pii.mask(edge_extra))}
    assert hidden[9]["text"].endswith("mail@x.y <PHONE>") or "<EMAIL>" in hidden[9]["text"]
    assert hidden[9]["n_chars"] == len(hidden[9]["text"]) and hidden[3]["text"] is None and hidden[6]["n_chars"] == 3


def test_tagger_gradients():
    model, rng = pii.Tagger(), np.random.default_rng(0)
    ids, tags = rng.integers(0, pii.CLASSES, (2, 7)), rng.integers(0, pii.TAGS, (2, 7))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, grad = model.loss(ids, tags)
    for name, value in model.p.items():
        at = (ids[0, 3], 2) if name == "emb" else tuple(rng.integers(0, s) for s in value.shape)
        keep = value[at]
        value[at] = keep + 1e-3
        up = model.loss(ids, tags)[0]
        value[at] = keep - 1e-3
        down = model.loss(ids, tags)[0]
        value[at] = keep
        assert (up - down) / 2e-3 == pytest.approx(float(grad[name][at]), abs=2e-4), name


def test_tagger_learns_spans_and_windows_agree(shipped):
    rng = np.random.default_rng(1)
    def text(k):
        fill = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
        some = [f"{''.join(rng.choice(list('klmn'), 6))}@{''.join(rng.choice(list('opq'), 5))}.org",
                ".".join(str(x) for x in rng.integers(1, 255, 4)), f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"]
        return f"{fill(20)} {some[k % 3]} {fill(20)} {rng.integers(1, 99)} {fill(3)}"
    texts = [text(k) for k in range(240)]
    found = [w for t in texts[:180] for w in pii.training_windows(t)]
    model = pii.Tagger()
    model.fit(np.stack([a for a, _ in found]), np.stack([b for _, b in found]), steps=250)
    hit = total = wrong = 0
    for t in texts[180:]:
        cls = pii.classes(t)
        starts = pii.window_starts(t, cls)
        whole = pii.reconcile(len(t), starts, model.decode(pii.cut(cls, starts)))
        gold = set(pii.base_spans(t))
        mine = set(pii.decoded_spans(whole))
        hit, total, wrong = hit + len(gold & mine), total + len(gold), wrong + len(mine - gold)
    assert hit >= 0.9 * total and wrong <= 0.1 * total


def test_entry_queries_on_small_tables(shipped):
    from limnos.llm.queries import QUERIES
    n = shipped.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    for name in ("op2_quality_rules", "op4_personal_data", "op5_fingerprints", "op8_secret_scans"):
        assert QUERIES[name](shipped, SF_SMALL).count() == n, name
