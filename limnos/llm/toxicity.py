"""Toxicity (operator 10): convolutional text classifier on hashed embeddings.

A word's embedding is the sum of four hashed rows: of the word and of its
first 4, 5 and 6 bytes, so that inflected forms share a stem.  Filters of widths
1, 2 and 3 slide over the words, each filter's maximum over the whole text is
taken, and a logistic layer gives the score.  Training is plain numpy: the
first embedding column starts as the smoothed log odds of a feature between
toxic and clean training texts, the rest at random; then all layers are
trained by gradient steps, the maximum passing its gradient to one window.

The model is fitted on every labelled row outside the held-out fold, whole texts
included; a tenth of them, picked by hash of doc_id, calibrates a threshold per
language instead.  Document frequencies are counted over all of them in one job.
The gradient steps run as parallel SGD: rows are dealt to shards by hash of
doc_id, each shard starts from the same model and takes its steps, and the
changes are averaged, those of an embedding over the shards that changed it.
Changes are summed as fixed-point integers and shards follow from doc_id and the
size of the table alone, so the model does not depend on partitions.
Scores depend on the text alone.  Every whole text is scored in blocks; only the
fixed-size model passes through the driver and is broadcast.

Defined cases: NULL or empty text has the score of no word at all.  A doc_id
with several labels is toxic if any row says so; NULL labels do not count.
Labels without document and documents without label are fine.  Without
training rows of both labels the untrained model gives low scores.  Rows that
repeat a doc_id are scored one by one; training takes one text of each doc_id.
held_out of a NULL doc_id is false.  An empty table gives no rows.  doc_id, text and
lang (NULL is a language like others) are read and lang chooses the threshold of the verdict by
language only, never a score; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import stored
from limnos.llm.vectors import U, text_buffer, word_hashes

SHARD_BYTES = 16 << 20  # text outside the held-out fold, labelled or not, a shard of the training
CHECKED = 10            # one labelled row in so many calibrates thresholds
BUCKETS = 1 << 18
DIMS = 8
FILTERS = 4
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
EPOCHS = 5
RARE = 3
EMB_RATE = 1.0          # step of the embeddings against that of the filters
UNIT = 1 << 24          # fixed-point unit of a change
HELD_OUT = 2            # remainder of crc32(doc_id as text) mod 4
THRESHOLD = 0.3

BREAKS = np.zeros(256, bool)
BREAKS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of four embedding indices, one row per word, and word offsets."""
    hashes, at = word_hashes(*text_buffer(column), breaks=BREAKS, prefixes=PREFIXES)
    salt = np.arange(1, 1 + hashes.shape[1], dtype=np.uint64) << U(40)
    rows = (((hashes ^ salt) >> U(20)) % U(BUCKETS)).astype(np.int32) + 1
    rows[hashes == 0] = 0                          # row 0 stays zero: no such prefix
    return rows, at


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.02, (BUCKETS + 1, DIMS)).astype(np.float32)
        self.emb[0] = 0
        self.conv = [rng.normal(0, 0.1, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.offset = np.float32(-1.1)

    def windows(self, x: np.ndarray, k: int) -> np.ndarray:
        """Filter responses at each window of width WIDTHS[k]."""
        w = WIDTHS[k]
        m = len(x) - w + 1
        y = x[:m] @ self.conv[k][0]
        for j in range(1, w):
            y += x[j:m + j] @ self.conv[k][j]
        return y + self.bias[k]

    def embed(self, rows: np.ndarray) -> np.ndarray:
        x = self.emb[rows[:, 0]]
        for c in range(1, rows.shape[1]):
            x = x + self.emb[rows[:, c]]
        return x

    def pooled(self, rows: np.ndarray, at: np.ndarray, block: int = 1 << 17) -> np.ndarray:
        """Maximum of every filter over each text (0 at least)."""
        out = np.zeros((len(at) - 1, len(self.out)), np.float32)
        lengths = np.diff(at)
        text = np.repeat(np.arange(len(lengths)), lengths)
        for lo in range(0, len(rows), block):
            x = self.embed(rows[lo:lo + block + WIDTHS[-1] - 1])
            owner = text[lo:lo + len(x)]
            for k, w in enumerate(WIDTHS):
                m = min(block, len(x) - w + 1)
                if m <= 0:
                    continue
                y = self.windows(x, k)[:m]
                inside = owner[:m] == owner[w - 1:w - 1 + m]
                y, who = y[inside], owner[:m][inside]
                if not len(who):
                    continue
                cuts = np.flatnonzero(np.diff(who, prepend=-1))
                best = np.maximum.reduceat(y, cuts, axis=0)
                ids, part = who[cuts], slice(k * FILTERS, (k + 1) * FILTERS)
                out[ids, part] = np.maximum(out[ids, part], best)
        return out

    def scores(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(rows, at) @ self.out + self.offset, -30, 30)))

    def start_from(self, seen: np.ndarray, n: np.ndarray) -> None:
        """First embedding column: smoothed log odds of document frequencies.
        ``seen``: texts of each label (row) that hold each feature; ``n``: texts of each label."""
        n = np.maximum(1, n)
        odds = np.log((seen[1] + 0.25) / (n[1] + 1)) - np.log((seen[0] + 0.25) / (n[0] + 1))
        odds[(odds > 0) & (seen[1] < RARE)] = 0       # a word of one text says nothing
        self.emb[:, 0] = np.clip(odds, -4, 8) / 4
        self.emb[0] = 0
        for k in range(len(WIDTHS)):
            self.conv[k][0, 0] = 1.0
            self.bias[k][:] = -1.5

    def layers(self) -> np.ndarray:
        """All numbers but the embeddings, in rows of DIMS (the last padded with 0)."""
        flat = np.concatenate([*[c.ravel() for c in self.conv], *self.bias, self.out, [self.offset]])
        return np.pad(flat, (0, -len(flat) % DIMS)).reshape(-1, DIMS)

    def set_layers(self, rows: np.ndarray) -> None:
        flat, at = rows.ravel().astype(np.float32), 0
        for part in [*self.conv, *self.bias, self.out]:
            part[...] = flat[at:at + part.size].reshape(part.shape)
            at += part.size
        self.offset = np.float32(flat[at])

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05,
            seed: int = 11, sizes: tuple | None = None) -> None:
        """Gradient steps over the texts; ``sizes``: rows of label 0 and 1 in the whole
        training, when these are a part of it."""
        rng = np.random.default_rng(seed)
        n0, n1 = sizes or (int((1 - labels).sum()), int(labels.sum()))
        weight = np.where(labels == 1, 0.5 / max(1, n1), 0.5 / max(1, n0)) * (n0 + n1)
        for _ in range(epochs):
            for t in rng.permutation(len(texts)).tolist():
                rows = texts[t]
                x = self.embed(rows)
                hit, value = [], np.zeros(len(self.out), np.float32)
                for k, w in enumerate(WIDTHS):
                    if len(x) < w:
                        hit.append(None)
                        continue
                    y = self.windows(x, k)
                    hit.append(y.argmax(axis=0))
                    value[k * FILTERS:(k + 1) * FILTERS] = np.maximum(0, y[hit[-1], np.arange(FILTERS)])
                p = 1 / (1 + np.exp(-np.clip(value @ self.out + self.offset, -30, 30)))
                err = np.float32(min(2.0, weight[t]) * (p - labels[t]) * rate)
                back = err * self.out * (value > 0)
                self.out -= err * value
                self.offset -= err
                for k, w in enumerate(WIDTHS):
                    if hit[k] is None:
                        continue
                    g = back[k * FILTERS:(k + 1) * FILTERS]
                    live = np.flatnonzero(g)
                    if not len(live):
                        continue
                    g, at = g[live, None], hit[k][live]
                    for j in range(w):
                        step = EMB_RATE * g * self.conv[k][j][:, live].T
                        self.conv[k][j][:, live] -= (g * x[at + j]).T
                        used = rows[at + j]
                        np.subtract.at(self.emb, used.ravel(), np.repeat(step, used.shape[1], axis=0))
                    self.bias[k][live] -= g[:, 0]
                self.emb[0] = 0                        # no such prefix


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, y, lang, text of all labelled rows outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != HELD_OUT)) \
        .groupBy("doc_id").agg(F.max("toxic").alias("y"))
    texts = docs.where(fold() != HELD_OUT).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    found = texts.join(known, "doc_id")
    # of a doc_id that many rows repeat, one text
    one = F.min_by(F.struct("y", "lang", "text"), F.struct(F.xxhash64("text"), F.col("lang"), F.col("text")))
    return found.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.y", "r.lang", "r.text")


def shard_count(docs: DataFrame) -> int:
    size = docs.where(fold() != HELD_OUT).agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
    return max(1, math.ceil((size or 0) / SHARD_BYTES))


def cut_features(column: pa.Array):
    """Feature rows of each text, computed for a few texts at a time."""
    for a in range(0, len(column), 128):
        rows, at = features(column.slice(a, 128))
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            yield rows[lo:hi]


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Texts of label 0 and of label 1 that hold each feature."""
    def count(batches):
        seen = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for text, y in zip(cut_features(batch.column("text")), batch.column("y").to_pylist()):
                seen[y, np.unique(text)] += 1
        used = np.flatnonzero(seen.any(axis=0))
        for a in range(0, len(used), 1 << 14):
            part = used[a:a + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0, part]), pa.array(seen[1, part])], names=["bucket", "n0", "n1"])
    found = rows.select("y", "text").mapInArrow(count, "bucket long, n0 long, n1 long") \
        .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    seen = np.zeros((2, BUCKETS + 1))
    seen[:, found.column("bucket").to_numpy()] = [found.column("n0").to_numpy(), found.column("n1").to_numpy()]
    return seen


def averaged_fit(rows: DataFrame, model: Model, shards: int, sizes: tuple) -> None:
    """Every shard's gradient steps from ``model``; their average change is added to it.
    Changed rows of the embeddings have their numbers, other layers numbers below 0."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"d{k}" for k in range(DIMS)]

    def fit_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        texts = [t for chunk in table.column("text").chunks for t in cut_features(chunk)]
        m, start = Model(), shared.value
        m.emb[...] = start.emb
        m.set_layers(start.layers())
        m.fit(texts, table.column("y").to_numpy().astype(np.int64), sizes=sizes)
        layers, change = m.layers() - start.layers(), m.emb - start.emb
        used = np.flatnonzero(change.any(axis=1))
        change = np.rint(np.concatenate([layers, change[used]]).astype(np.float64) * UNIT).astype(np.int64)
        bucket = np.concatenate([-1 - np.arange(len(layers)), used])
        return pa.table([pa.array(bucket), *[pa.array(np.ascontiguousarray(c)) for c in change.T]], names=["bucket", *names])
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    found = rows.select(shard, F.col("doc_id").cast("long").alias("doc_id"), "y", "text").groupBy("shard") \
        .applyInArrow(fit_shard, ", ".join(f"{c} long" for c in ["bucket", *names])) \
        .groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
    bucket = found.column("bucket").to_numpy()
    mean = np.stack([found.column(c).to_numpy() for c in names], axis=1) / (found.column("n").to_numpy()[:, None] * UNIT)
    layers, below = model.layers().astype(np.float64), bucket < 0
    layers[-1 - bucket[below]] += mean[below]
    model.set_layers(layers)
    model.emb[bucket[~below]] += mean[~below].astype(np.float32)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict]:
    """Model and thresholds by language, from all labelled rows outside the held-out fold."""
    check = F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(CHECKED)) == 0
    rows = stored(training_sample(docs, labels).select("doc_id", F.col("y").cast("int").alias("y"), "lang", "text", check.alias("check")), "training")
    fit = rows.where("not check")
    sizes = {r["y"]: r["n"] for r in fit.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = Model()
    if set(sizes) != {0, 1}:
        return model, {}
    sizes = sizes[0], sizes[1]
    model.start_from(document_frequencies(fit), np.array(sizes))
    averaged_fit(fit, model, shard_count(docs), sizes)
    return model, calibrate(model, rows.where("check"))


def calibrate(model: Model, rows: DataFrame) -> dict:
    """Per language the threshold of the best F1 on the calibration rows; the
    fixed one where they have no toxic row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                score = shared.value.scores(*features(part.column("text"))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("name"), part.column("y"), pa.array(score)], names=["name", "y", "score"])
    cuts = [THRESHOLD, *np.round(np.arange(0.05, 1, 0.05), 2).tolist()]
    scored = rows.select(F.coalesce("lang", F.lit("")).alias("name"), "y", "text").mapInArrow(run, "name string, y int, score double")
    counts = scored.groupBy("name").agg(
        F.sum("y").alias("toxic"), F.array(*[F.count_if(F.col("score") >= c) for c in cuts]).alias("over"),
        F.array(*[F.count_if((F.col("score") >= c) & (F.col("y") == 1)) for c in cuts]).alias("hit")).collect()
    found = {}
    for r in counts:
        best = (0.0, THRESHOLD)
        for cut, over, hit in zip(cuts, r["over"], r["hit"]):
            f1 = 2 * hit / max(1, over + r["toxic"])
            if f1 > best[0]:
                best = (f1, cut)
        found[r["name"]] = float(best[1])
    return found


def score_texts(docs: DataFrame, model: Model, thresholds: dict) -> DataFrame:
    """doc_id, score and the verdict by the language's own threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model, thresholds))

    def run(batches):
        m, cuts = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                score = m.scores(*features(part.column("text"))).astype(np.float64)
                cut = [cuts.get(x or "", THRESHOLD) for x in part.column("lang").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(score), pa.array(score >= np.array(cut))],
                    names=["doc_id", "score", "toxic_for_language"])
    return docs.select("doc_id", "text", "lang").mapInArrow(
        run, "doc_id bigint, score double, toxic_for_language boolean")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model, thresholds = train(docs, labels)
    return score_texts(docs, model, thresholds).select(
        "doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "toxic_for_language")
