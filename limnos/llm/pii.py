"""Personal data (operator 4): base patterns and a character BiLSTM-CRF.

The base patterns (email, ip, card, phone) give spans that always stay.  A
character-level bidirectional LSTM with CRF transitions, trained in numpy, finds
what they miss: the same data in other spelling (national phone numbers, blanks or
brackets around dots and @, other separators) or swallowed by a longer match that
failed its check.  It learns from windows around base spans, as they are and
rewritten in such spellings (``respelled``), and around other digits.

Every whole text is cut into overlapping windows.  An added span holds a digit
or an @ in any spelling (``plausible`` asks for one), so a window without either gives
none and is not decoded; all others are (Viterbi).
Where windows overlap, the tag of the window in which a character lies farther
from the edge counts, so the decision is one per character of the text; runs
of tags become spans.  A decoded span is added when it touches no accepted base
span and passes the check of its kind: four numbers up to 255, 13 to 19 digits
with a Luhn sum, 9 to 15 digits, a name and a domain around one @.

The sample is bounded by parameters: windows of at most ``DOCS`` rows with
and as many without a base pattern's trigger, ``PER_DOC`` windows each and as many
rewritten, chosen by hash of doc_id and text.  Only the fixed-size model is broadcast.

Defined cases: NULL text is empty and has no span.  Each input row is a result
row, repeated doc_ids included.  Texts of any length are decoded window by
window in blocks.  With no labelled window (an empty table, say) the model is untrained
and adds nothing.  ``scan`` reads doc_id and text only; other columns pass through ``mask``.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCS = 500
PER_DOC = 3
WINDOW = 96
STRIDE = 48
DIM, HIDDEN = 10, 16
STEPS = 400             # gradient steps of a training run
BATCH = 48

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + 2 * len(KINDS)           # outside, then begin and inside of each kind
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def base_matches(text: str):
    """(kind, start, end, accepted) of all base matches, kind by kind."""
    if "@" in text:
        for m in EMAIL.finditer(text):
            yield 0, m.start(), m.end(), True
    for m in IP.finditer(text):
        yield 1, m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                                         for p in m[0].split("."))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue                # too few digits to matter here or as a rejected match
        d = _digits(m[0])
        yield 2, m.start(), m.end(), 13 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield 3, m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return [(k, a, z) for k, a, z, ok in base_matches(text) if ok]


# character classes: 0 is padding
_CLASS = np.full(0x250, 5, np.int64)
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[0xC0:0x250] = 4
_PUNCT = " \n\t.@+-()/:;,_%#=\"'&!?*"
for _k, _c in enumerate(_PUNCT):
    _CLASS[ord(_c)] = 6 + _k
CLASSES = 6 + len(_PUNCT)


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 0x250, _CLASS[np.minimum(code, 0x24F)], 4)


def window_starts(text: str, cls: np.ndarray) -> list[int]:
    """Starts of the windows to decode: every STRIDE, where a trigger is in reach."""
    hot = (cls == 3) | (cls == 6 + _PUNCT.index("@"))
    at = np.flatnonzero(hot)
    if not len(at):
        return []
    last = at // STRIDE
    first = np.maximum(0, -(-(at - WINDOW + 1) // STRIDE))
    picked = np.unique(np.concatenate([first, last]))     # WINDOW = 2 STRIDE: two windows hold each character
    return (picked * STRIDE).tolist()


def cut(cls: np.ndarray, starts: list[int]) -> np.ndarray:
    out = np.zeros((len(starts), WINDOW), np.int64)
    for k, a in enumerate(starts):
        part = cls[a:a + WINDOW]
        out[k, :len(part)] = part
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Tagger:
    """Character BiLSTM with a linear-chain CRF."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": rng.normal(0, 0.5, (CLASSES, DIM)).astype(np.float32),
                  "out": g(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS, np.float32),
                  "tr": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"wx{d}": g(DIM, 4 * HIDDEN), f"wh{d}": g(HIDDEN, 4 * HIDDEN),
                       f"b{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}
        self.trained = False

    def _run(self, x, d, keep=None):
        """Hidden states of one direction; order of time as given."""
        n, length, _ = x.shape
        xw = x @ self.p["wx" + d] + self.p["b" + d]
        wh = self.p["wh" + d]
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, length, HIDDEN), np.float32)
        for t in range(length):
            z = xw[:, t] + h @ wh
            s = _sigmoid(z[:, :3 * HIDDEN])
            u = np.tanh(z[:, 3 * HIDDEN:])
            before, prev = c, h
            c = s[:, HIDDEN:2 * HIDDEN] * c + s[:, :HIDDEN] * u
            tc = np.tanh(c)
            h = s[:, 2 * HIDDEN:] * tc
            out[:, t] = h
            if keep is not None:
                keep.append((s, u, before, tc, prev))
        return out

    def emissions(self, ids, keep=None):
        x = self.p["emb"][ids]
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._run(x, "f", kf)
        hb = self._run(x[:, ::-1], "b", kb)[:, ::-1]
        h = np.concatenate([hf, hb], axis=2)
        if keep is not None:
            keep.update(x=x, kf=kf, kb=kb, h=h)
        return h @ self.p["out"] + self.p["ob"]

    def _back(self, dh, kept, x, d, grad):
        n, length, _ = x.shape
        wh = self.p["wh" + d]
        dz = np.empty((n, length, 4 * HIDDEN), np.float32)
        nh = np.zeros((n, HIDDEN), np.float32)
        nc = np.zeros((n, HIDDEN), np.float32)
        gwh = np.zeros_like(wh)
        for t in range(length - 1, -1, -1):
            s, u, before, tc, prev = kept[t]
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            g = dh[:, t] + nh
            dc = nc + g * o * (1 - tc * tc)
            z = dz[:, t]
            z[:, :HIDDEN] = dc * u * i * (1 - i)
            z[:, HIDDEN:2 * HIDDEN] = dc * before * f * (1 - f)
            z[:, 2 * HIDDEN:3 * HIDDEN] = g * tc * o * (1 - o)
            z[:, 3 * HIDDEN:] = dc * i * (1 - u * u)
            gwh += prev.T @ z
            nh, nc = z @ wh.T, dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        grad["wh" + d] = gwh
        grad["wx" + d] = x.reshape(-1, DIM).T @ flat
        grad["b" + d] = flat.sum(axis=0)
        return dz @ self.p["wx" + d].T

    def loss(self, ids, tags):
        """Negative log likelihood and gradients of a batch."""
        keep: dict = {}
        e = self.emissions(ids, keep).astype(np.float64)
        n, length, _ = e.shape
        tr = self.p["tr"].astype(np.float64)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            m = alpha[:, t - 1, :, None] + tr
            top = m.max(axis=1)
            alpha[:, t] = e[:, t] + top + np.log(np.exp(m - top[:, None]).sum(axis=1))
        for t in range(length - 2, -1, -1):
            m = tr + (e[:, t + 1] + beta[:, t + 1])[:, None]
            top = m.max(axis=2)
            beta[:, t] = top + np.log(np.exp(m - top[:, :, None]).sum(axis=2))
        top = alpha[:, -1].max(axis=1)
        z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(axis=1))
        de = np.exp(alpha + beta - z[:, None, None])
        pair = np.zeros_like(tr)
        for t in range(1, length):
            pair += np.exp(alpha[:, t - 1, :, None] + tr + (e[:, t] + beta[:, t] - z[:, None])[:, None]).sum(axis=0)
        rows, cols = np.arange(n)[:, None], np.arange(length)
        gold = e[rows, cols, tags].sum() + tr[tags[:, :-1], tags[:, 1:]].sum()
        de[rows, cols, tags] -= 1
        np.subtract.at(pair, (tags[:, :-1], tags[:, 1:]), 1)
        de = (de / n).astype(np.float32)
        grad = {"tr": (pair / n).astype(np.float32), "out": keep["h"].reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS),
                "ob": de.sum(axis=(0, 1))}
        dh = de @ self.p["out"].T
        dx = self._back(dh[:, :, :HIDDEN], keep["kf"], keep["x"], "f", grad)
        dx = dx + self._back(dh[:, ::-1, HIDDEN:], keep["kb"], keep["x"][:, ::-1], "b", grad)[:, ::-1]
        grad["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grad["emb"], ids.reshape(-1), dx.reshape(-1, DIM))
        return (z.sum() - gold) / n, grad

    def fit(self, ids, tags, steps: int = STEPS, rate: float = 0.02, seed: int = 3) -> list[float]:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, history = 0, []
        while step < steps:
            order, total = rng.permutation(len(ids)), 0.0
            for a in range(0, len(ids), BATCH):
                pick = order[a:a + BATCH]
                loss, grad = self.loss(ids[pick], tags[pick])
                total += loss * len(pick)
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
            history.append(total / len(ids))
        self.trained = True
        return history

    def decode(self, ids) -> np.ndarray:
        """Viterbi tags of each window."""
        e = self.emissions(ids)
        n, length, _ = e.shape
        tr = self.p["tr"]
        back = np.empty((length, n, TAGS), np.int8)
        score = e[:, 0]
        for t in range(1, length):
            m = score[:, :, None] + tr
            back[t] = m.argmax(axis=1)
            score = np.take_along_axis(m, back[t][:, None].astype(np.int64), axis=1)[:, 0] + e[:, t]
        tags = np.empty((n, length), np.int8)
        tags[:, -1] = score.argmax(axis=1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t][rows, tags[:, t]]
        return tags


def gold_tags(text: str, spans: list) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for k, a, z in spans:
        tags[a:z] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def respelled(kind: int, found: str, rng: random.Random) -> str:
    """A base span in another spelling, outside the base patterns."""
    if kind == 0:
        name, domain = found.split("@")
        return rng.choice([f"{name} @ {domain}", f"{name}@ {domain}", f"{name}@{domain.replace('.', ' . ')}",
                           f"{name}@{domain.replace('.', '[.]')}", f"{name}[@]{domain}", f"{name}(@){domain}"])
    if kind == 1:
        return rng.choice(["[.]", "(.)", " . ", ". "]).join(found.split("."))
    digits = _digits(found)
    if kind == 2:
        sep = rng.choice([".", "/", "_", "  ", " - "])
        return sep.join(digits[k:k + 4] for k in range(0, len(digits), 4))
    last = digits[-10:]
    return rng.choice(["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "0{0}/{1}{2}", "00" + digits[:-10] + " {0} {1} {2}"]) \
        .format(last[:3], last[3:6], last[6:])


def rewritten(text: str, spans: list, rng: random.Random) -> tuple[str, list]:
    """The text with its base spans in other spellings, and their places."""
    out, moved, at, size = [], [], 0, 0
    for k, a, z in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        swallowed = k == 3 and rng.random() < 0.3
        new = text[a:z] if swallowed else respelled(k, text[a:z], rng)
        out += [text[at:a], new]
        size += a - at
        moved.append((k, size, size + len(new)))
        size, at = size + len(new), z
        if swallowed:               # an address right after: the base pattern takes both for one number
            ip = ".".join(str(rng.randrange(100, 256)) for _ in range(4))
            out.append(" " + ip)
            moved.append((1, size + 1, size + 1 + len(ip)))
            size += 1 + len(ip)
    return "".join([*out, text[at:]]), moved


def _cut_windows(text: str, spans: list, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    cls = classes(text)
    starts = window_starts(text, cls)
    near = [a for a in starts if any(a <= s and z <= a + WINDOW for _, s, z in spans)]
    rest = [a for a in starts if not any(a < z and s < a + WINDOW for _, s, z in spans)]
    picked = (near + rest)[:limit]
    tags = gold_tags(text, spans)
    ids, out = cut(cls, picked), np.zeros((len(picked), WINDOW), np.int64)
    for k, a in enumerate(picked):
        part = tags[a:a + WINDOW]
        out[k, :len(part)] = part
    return list(zip(ids, out))


def training_windows(text: str, limit: int = PER_DOC) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to ``limit`` windows of a text, those with spans first, and as many of
    the text with its spans in other spellings."""
    spans = base_spans(text)
    found = _cut_windows(text, spans, limit)
    if spans:
        found += _cut_windows(*rewritten(text, spans, random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))), limit)
    return found


def train(docs: DataFrame, n_docs: int = DOCS) -> Tagger:
    text, th = F.col("text"), F.xxhash64("text")
    keyed = docs.select("doc_id", th.alias("th"), F.xxhash64("doc_id", th).alias("h"),
                        text.rlike("@[A-Za-z0-9-]+\\.|\\+[0-9]|[0-9]\\.[0-9]|[0-9][0-9 -]{11,}[0-9]").alias("likely"),
                        text.rlike("[0-9@]").alias("hot")).where("hot")
    rows = keyed.where("likely").orderBy("h", "doc_id").limit(n_docs) \
        .unionByName(keyed.where("not likely").orderBy("h", "doc_id").limit(n_docs)).select("doc_id", "th").distinct()
    # at most 2 * n_docs keys: a proven bound for the broadcast

    def windows(batches):
        for batch in batches:
            found = [w for t in batch.column("text").to_pylist() for w in training_windows(t or "")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i.astype(np.int16).tobytes() for i, _ in found], pa.binary()),
                 pa.array([g.astype(np.int16).tobytes() for _, g in found], pa.binary())], names=["ids", "tags"])
    # rows equal in doc_id and text give the same windows, which are reduced to one where they are made
    picked = docs.select("doc_id", "text", th.alias("th")).join(F.broadcast(rows), ["doc_id", "th"], "left_semi")
    got = picked.select("text").mapInArrow(windows, "ids binary, tags binary").distinct().orderBy("ids", "tags").toArrow()
    model = Tagger()
    if got.num_rows:
        read = lambda c: np.stack([np.frombuffer(x, np.int16) for x in got.column(c).to_pylist()]).astype(np.int64)
        model.fit(read("ids"), read("tags"))
    return model


def reconcile(length: int, starts: list[int], tags: np.ndarray) -> np.ndarray:
    """One tag per character: of the window in which it lies farthest from the edge."""
    out = np.zeros(length, np.int8)
    depth = np.full(length, -1, np.int64)
    inner = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for a, row in zip(starts, tags):
        z = min(length, a + WINDOW)
        # the text's own borders are no window edge
        d = np.where(np.arange(a, z) < STRIDE, WINDOW, inner[:z - a]) if a == 0 else inner[:z - a].copy()
        if a + WINDOW >= length:
            d = np.maximum(d, np.where(np.arange(z - a) >= STRIDE // 2, WINDOW, 0))
        better = d > depth[a:z]
        out[a:z][better] = row[:z - a][better]
        depth[a:z][better] = d[better]
    return out


def decoded_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one kind; a begin tag after another starts a new span."""
    spans, kind, start = [], -1, 0
    hot = np.flatnonzero(tags)
    previous = -2
    for p in hot.tolist():
        k, begins = (int(tags[p]) - 1) // 2, int(tags[p]) % 2 == 1
        if p != previous + 1 or k != kind or (begins and (int(tags[p - 1]) % 2 == 0)):
            if kind >= 0:
                spans.append((kind, start, previous + 1))
            kind, start = k, p
        previous = p
    if kind >= 0:
        spans.append((kind, start, previous + 1))
    return spans


def plausible(kind: int, found: str) -> bool:
    """The check of its kind for an added span, whatever the spelling."""
    if "\n" in found:
        return False
    if kind == 0:
        name, _, domain = (x.strip(" []()") for x in found.partition("@"))
        parts = re.split(r" ?[\[(]?\.[\])]? ?", domain)
        return found.count("@") == 1 and " " not in name and len(name) > 0 and len(parts) > 1 \
            and all(re.fullmatch("[A-Za-z0-9-]+", x) for x in parts)
    if any(ch.isalpha() for ch in found):
        return False
    digits = _digits(found)
    if kind == 1:
        parts = re.split(r"[^0-9]+", found.strip(" .()[]"))
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts if x) and all(parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def find_spans(model: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """Base spans and added spans of each text."""
    matches = [list(base_matches(t)) for t in texts]
    pieces, owners = [], []
    for n, t in enumerate(texts):
        if model.trained and TRIGGER.search(t):
            cls = classes(t)
            starts = window_starts(t, cls)
            owners.append((n, starts))
            pieces.append(cut(cls, starts))
    added: list[list] = [[] for _ in texts]
    if pieces:
        ids = np.concatenate(pieces)
        tags = np.concatenate([model.decode(ids[a:a + 1024]) for a in range(0, len(ids), 1024)])
        at = 0
        for n, starts in owners:
            whole = reconcile(len(texts[n]), starts, tags[at:at + len(starts)])
            at += len(starts)
            if whole.any():
                taken = [(a, z) for _, a, z, ok in matches[n] if ok]
                for k, a, z in decoded_spans(whole):
                    while a < z and texts[n][a] in " \n,;:":
                        a += 1
                    while a < z and texts[n][z - 1] in " \n.,;:":
                        z -= 1
                    if a < z and plausible(k, texts[n][a:z]) and not any(a < y and x < z for x, y in taken):
                        added[n].append((k, a, z))
    return [([(k, a, z) for k, a, z, ok in m if ok], extra) for m, extra in zip(matches, added)]


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in sorted(spans))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every maximal covered stretch replaced by its first kind."""
    out, at = [], 0
    for a, z, k in sorted((a, z, k) for k, a, z in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def _blocks(texts: list[str], chars: int = 2 << 20):
    at, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= chars or k + 1 == len(texts):
            yield at, k + 1
            at, total = k + 1, 0


def scan(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans (as texts), n_spans, n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, z in _blocks(texts):
                found = find_spans(shared.value, texts[a:z])
                counts = [pa.array([sum(k == c for k, _, _ in b) for b, _ in found], pa.int64()) for c in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, z - a).cast(pa.int64()), *counts, pa.array([as_text(b) for b, _ in found]),
                     pa.array([as_text(b + x) for b, x in found]), pa.array([len(b) + len(x) for b, x in found], pa.int64()),
                     pa.array([len(x) for _, x in found], pa.int64())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_spans", "n_added"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, "
        "n_spans bigint, n_added bigint")


def personal_data(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs))


def mask(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The documents with all spans replaced by <KIND> (n_chars follows)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    names = docs.columns
    place = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            new = []
            for a, z in _blocks([t or "" for t in texts]):
                part = texts[a:z]
                for t, (b, x) in zip(part, find_spans(shared.value, [t or "" for t in part])):
                    new.append(masked(t, b + x) if b or x else t)
            cols = list(batch.columns)
            cols[place] = pa.array(new, cols[place].type)
            if chars is not None:
                cols[chars] = pa.array([len(n) if n is not None and n != t else c for n, t, c in
                                        zip(new, texts, cols[chars].to_pylist())], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return docs.mapInArrow(run, docs.schema)
