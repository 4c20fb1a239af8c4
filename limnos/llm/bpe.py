"""BPE encoding and decoding (operator 3) by tree concatenation.

A text of more than ``LEAF`` code points is halved until every piece is short
enough; the pieces are rows of their own and are encoded in parallel on any
task.  Neighbouring pieces are then joined pairwise up the tree: a window around the
join is encoded anew and grows until both sides agree exactly, that is until
the left tokens end with the window's left part encoded alone, the right
tokens begin with its right part encoded alone, and the window's own first and
last token are theirs.  Beyond such a token nothing can change: a BPE sequence is the
encoding of its text exactly if each adjacent pair of tokens is.  The last
resort is a window over the whole pair.

Pieces are cut further where the tokenizer cuts too (white space), and each
distinct chunk is encoded by the library once per worker, not once per
occurrence; the cache is emptied at ``CACHE`` chunks.  A chunk is taken from the
cache only if its bytes equal those it was encoded from.

Defined cases: NULL or empty text has no tokens and decodes to the empty text.
Each input row is a result row, repeated doc_ids included.  Special tokens in
a text are recognised as the library does by default; padding and truncation
of the tokenizer file are switched off.  An empty table gives no rows.  Only
doc_id and text are read, whatever the other columns are called.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.vectors import BLOCKS, span_blocks, span_hashes, text_buffer

LEAF = 32_768           # code points a piece has at most
WINDOW = 64             # first window on either side of a join
CACHE = 1_000_000       # distinct chunks a worker remembers
BATCH_CHARS = 2 << 20
COPIES = 65_536         # equal rows that are listed together

# Chunk rules: text is cut where the tokenizer always cuts.
#   words: at every blank or line break (the tokenizer drops white space)
#   bytes: before a single blank or line break between two other characters
RULES = ("words", "bytes")
LONG_TEXT = 1 << 20     # code points beyond which a text is cut before it is hashed
_CUT = re.compile(r"\S[ \n](?=\S)")

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
# White space characters beyond ASCII.
_WIDE_SPACE = "\u0085\u00a0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _space(b: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    space = _ASCII_SPACE[b]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        if (b == lead).any():
            for ch in _WIDE_SPACE:
                raw = ch.encode()
                if raw[0] == lead:
                    at = np.flatnonzero(b[:len(b) - len(raw) + 1] == lead)
                    for k in range(1, len(raw)):
                        at = at[b[at + k] == raw[k]]
                    for k in range(len(raw)):
                        space[at + k] = True
    return space


def chunk_spans(b: np.ndarray, offsets: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the chunks of texts stored back to back."""
    first = np.zeros(len(b) + 1, bool)
    first[offsets] = True                           # also the end of the last text
    separator = (b == 0x20) | (b == 0x0A)
    if rule == "words":
        inside = ~separator
        begin = inside.copy()
        begin[1:] &= separator[:-1] | first[1:-1]
        end = inside
        end[:-1] &= separator[1:] | first[1:-1]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1
    solid = ~_space(b)
    begin = first[:-1].copy()
    begin[1:-1] |= separator[1:-1] & solid[:-2] & solid[2:] & ~first[1:-2] & ~first[2:-1]
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], len(b))


class Encoder:
    """Library tokenizer with a cache of distinct chunks.

    Chunks are found by a 64-bit hash, but only equal bytes share an entry: every
    occurrence is compared with the chunk that the entry was made from, and one
    that differs from it goes to a table keyed by the bytes themselves."""

    def __init__(self, path: str, rule: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.rule = rule
        self.sizes = self._token_sizes()
        self._reset()

    def _token_sizes(self) -> np.ndarray:
        """Bytes of (normalised) text that each token id stands for: a byte-level
        vocabulary writes one character per byte."""
        added = self.library.get_added_tokens_decoder()
        sizes = np.zeros(self.library.get_vocab_size(with_added_tokens=True) + 1, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            sizes[i] = len(token.encode()) if i in added else len(token.removesuffix("</w>"))
        return sizes

    def _reset(self):
        self.keys = np.zeros(0, np.uint64)          # sorted hashes of known chunks
        self.slot = np.zeros(0, np.int64)           # and their place in the store
        self.head = np.zeros((0, BLOCKS + 1), np.uint64)    # first bytes and length of the chunk in each place
        self.long: dict[int, bytes] = {}            # all bytes of the longer ones
        self.odd: dict[bytes, int] = {}             # places of chunks whose hash another chunk has
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1, np.int64)             # start of chunk i; at[i + 1] its end
        self.used = 0

    def plain(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _apart(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum())), lengths

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and token counts of chunks, encoded as one text: between chunks
        the tokenizer cuts anyway, and the byte sizes of the tokens tell where.
        Chunks that do not line up are encoded apart."""
        between = " " if self.rule == "words" else ""
        text = between.join(chunks)
        plain = self.library.normalizer.normalize_str(text).split(" ") if between else chunks
        ids = np.array(self.plain(text), np.uint32)
        ends = np.cumsum([len(p.encode()) for p in plain])
        reach = np.cumsum(self.sizes[ids])
        stop = np.searchsorted(reach, ends)
        if len(plain) != len(chunks) or not len(ids) or stop[-1] != len(ids) - 1 or not (reach[stop] == ends).all():
            return self._apart(chunks)
        return ids, np.diff(stop, prepend=-1)

    def _store(self, chunks: list[str]) -> np.ndarray:
        """Encode chunks and put their ids in the store; their order there."""
        whole = np.fromiter(map(self._plain_chunk, chunks), bool, len(chunks))
        order = np.concatenate([np.flatnonzero(whole), np.flatnonzero(~whole)])
        parts = []
        for a in range(0, int(whole.sum()), 256):
            parts.append(self._together([chunks[k] for k in order[a:min(a + 256, int(whole.sum()))].tolist()]))
        if not whole.all():
            parts.append(self._apart([chunks[k] for k in order[int(whole.sum()):].tolist()]))
        encoded, lengths = (np.concatenate(x) for x in zip(*parts))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
        end = int(self.at[-1])
        while len(self.flat) < end:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:end] = encoded
        self.used = end
        return order

    def _learn(self, raw: list[bytes], keys: np.ndarray, head: np.ndarray) -> None:
        first = len(self.at) - 1
        order = self._store([r.decode() for r in raw])
        slots = first + np.arange(len(raw))
        grown = np.zeros((first + len(raw), BLOCKS + 1), np.uint64)
        grown[:len(self.head)] = self.head
        grown[first:] = head[order]
        self.head = grown
        self.long.update((first + k, raw[i]) for k, i in enumerate(order.tolist()) if len(raw[i]) > 8 * BLOCKS)
        up = np.argsort(keys[order])
        keys, slots = keys[order][up], slots[up]
        where = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, where, keys), np.insert(self.slot, where, slots)

    def _slot_of(self, raw: bytes) -> int:
        """Place of a chunk whose hash belongs to another one."""
        if raw not in self.odd:
            self.odd[raw] = len(self.at) - 1
            self._store([raw.decode()])
        return self.odd[raw]

    def _plain_chunk(self, chunk: str) -> bool:
        """Whether a chunk may stand among others in one text."""
        solid = len(chunk) > 1 and not chunk[1].isspace() and not chunk[-1].isspace()
        return solid and (chunk[0] in " \n" if self.rule == "bytes" else not chunk[0].isspace())

    def _cut(self, text: str) -> list[str]:
        """A very long text in parts that encode apart."""
        parts = []
        while len(text) > LONG_TEXT:
            found = None
            for found in _CUT.finditer(text, 0, LONG_TEXT):
                pass
            found = found or _CUT.search(text, LONG_TEXT - 2)
            if found is None:
                break
            parts.append(text[:found.start() + 1])
            text = text[found.start() + 1:]
        return [*parts, text]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if any(len(t) > LONG_TEXT for t in texts):
            return [np.concatenate([self._encode([p])[0] for p in self._cut(t)]) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.keys) > CACHE:
            self._reset()
        b, offsets = text_buffer(pa.array(texts, pa.large_string()))
        b, offsets = b[offsets[0]:offsets[-1]], offsets - offsets[0]
        starts, ends = chunk_spans(b, offsets, self.rule) if len(b) else (offsets[:0], offsets[:0])
        blocks = span_blocks(b, starts, ends)
        keys = span_hashes(b, starts, ends, blocks)
        head = np.stack([*blocks, (ends - starts).astype(np.uint64)], axis=1)
        distinct, one, inverse = np.unique(keys, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inner = where < len(self.keys)
        known[inner] = self.keys[where[inner]] == distinct[inner]
        raw = memoryview(b)
        if not known.all():
            new = one[~known]
            self._learn([bytes(raw[a:z]) for a, z in zip(starts[new].tolist(), ends[new].tolist())], distinct[~known], head[new])
            where = np.searchsorted(self.keys, distinct)
        slot = self.slot[where][inverse] if len(distinct) else np.zeros(0, np.int64)
        same = (self.head[slot] == head).all(axis=1) if len(slot) else np.zeros(0, bool)
        for i in np.flatnonzero(same & (head[:, BLOCKS] > 8 * BLOCKS)).tolist():
            same[i] = self.long.get(int(slot[i])) == raw[starts[i]:ends[i]]
        for i in np.flatnonzero(~same).tolist():
            slot[i] = self._slot_of(bytes(raw[starts[i]:ends[i]]))
        begin = self.at[slot]
        lengths = self.at[slot + 1] - begin
        stop = np.cumsum(lengths)
        ids = self.flat[np.repeat(begin - (stop - lengths), lengths) + np.arange(int(stop[-1]) if len(stop) else 0)]
        bounds = np.concatenate([[0], stop])[np.searchsorted(starts, offsets)]
        return [ids[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """Tokens of left + right from the tokens of each."""
        size = WINDOW
        while True:
            i, j = self._start(left, size), self._end(right, size)
            tail, head = self.plain(left[i:]), self.plain(right[:j])
            window = self.plain(left[i:] + right[:j])
            ends_with = len(tail) <= len(a) and a[len(a) - len(tail):].tolist() == tail
            begins_with = b[:len(head)].tolist() == head
            left_ok = i == 0 or (tail and window and ends_with and window[0] == tail[0])
            right_ok = j == len(right) or (head and window and begins_with and window[-1] == head[-1])
            if left_ok and right_ok:
                return np.concatenate([a[:0] if i == 0 else a[:len(a) - len(tail)], np.array(window, np.uint32),
                                       b[:0] if j == len(right) else b[len(head):]])
            size *= 2

    def _start(self, text: str, size: int) -> int:
        """Where a window that holds the last ``size`` characters may begin:
        after white space, else at a token of the unsplit run."""
        at = len(text) - size
        if at <= 0:
            return 0
        space = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at))
        if self.rule == "words" and space >= at - 4 * size:
            return space + 1
        run = self.library.encode(text[space + 1:], add_special_tokens=False)
        done, best = 0, 0
        for begin, end in run.offsets:
            place = space + 1 + begin
            if begin >= done and place <= at and not unicodedata.combining(text[place]):
                best = place
            done = max(done, end)
        return best

    def _end(self, text: str, size: int) -> int:
        """Where a window that holds the first ``size`` characters may end."""
        if size >= len(text):
            return len(text)
        found = [p for p in (text.find(" ", size), text.find("\n", size)) if p >= 0]
        space = min(found, default=len(text))
        if self.rule == "words" and space <= 5 * size:
            return space
        offsets = self.library.encode(text[:space], add_special_tokens=False).offsets
        later, best = space, space
        for begin, end in reversed(offsets):
            if end <= later and end >= size and (end == len(text) or not unicodedata.combining(text[end])):
                best = end
            later = min(later, begin)
        return best


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, rule: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if (path, rule) not in _encoders:
        _encoders[path, rule] = Encoder(path, rule)
    return _encoders[path, rule]


def text_batches(batches, names: list[str], text: str = "text"):
    """(columns as lists, texts) about BATCH_CHARS at a time."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        others = [batch.column(n).to_pylist() for n in names]
        at, total = 0, 0
        for k, t in enumerate(texts):
            total += len(t)
            if total >= BATCH_CHARS or k + 1 == len(texts):
                yield [o[at:k + 1] for o in others], texts[at:k + 1]
                at, total = k + 1, 0


def _digest(ids: np.ndarray, text: str):
    return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode("utf-8")).hexdigest())


RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _result(ids: list, tokens: list, decoded: list) -> pa.RecordBatch:
    cols = list(zip(*(_digest(t, d) for t, d in zip(tokens, decoded)))) or [[]] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
         pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def decode(enc: Encoder, tokens: list[np.ndarray]) -> list[str]:
    return enc.library.decode_batch([t.tolist() for t in tokens], skip_special_tokens=False) if tokens else []


def encode_short(docs: DataFrame, path: str, rule: str) -> DataFrame:
    def run(batches):
        enc = encoder(path, rule)
        for (ids,), texts in text_batches(batches, ["doc_id"]):
            tokens = enc.encode(texts)
            yield _result(ids, tokens, decode(enc, tokens))
    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def halves(text: str, leaf: int) -> list[str]:
    """The leaves of the halving tree, in order; their number is a power of two."""
    pieces = [text]
    while max(map(len, pieces)) > leaf:
        pieces = [p for t in pieces for p in (t[:len(t) // 2], t[len(t) // 2:])]
    return pieces


def join_tree(enc: Encoder, texts: list[str], tokens: list[np.ndarray]) -> np.ndarray:
    """Join the encoded leaves pairwise until one sequence is left."""
    while len(texts) > 1:
        tokens = [enc.join(texts[k], tokens[k], texts[k + 1], tokens[k + 1]) for k in range(0, len(texts), 2)]
        texts = [texts[k] + texts[k + 1] for k in range(0, len(texts), 2)]
    return tokens[0]


def encode_long(docs: DataFrame, path: str, rule: str, leaf: int) -> DataFrame:
    """Tree concatenation of the given (long) texts; rows equal in doc_id and text
    are one text with a number of copies, reduced where they are read."""
    def split(batches):
        for batch in batches:
            for i, key, copies, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "copies", "text"))):
                pieces = halves(text, leaf)
                m = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * m, pa.int64()), pa.array([key] * m, pa.string()), pa.array([copies] * m, pa.int64()),
                     pa.array(range(m), pa.int32()), pa.array(pieces, pa.string())],
                    names=["doc_id", "row", "copies", "leaf", "text"])

    def leaves(batches):
        enc = encoder(path, rule)
        for (ids, keys, copies, numbers), texts in text_batches(batches, ["doc_id", "row", "copies", "leaf"]):
            tokens = enc.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(copies, pa.int64()), pa.array(numbers, pa.int32()),
                 pa.array(texts, pa.string()), pa.array([t.tobytes() for t in tokens], pa.binary())],
                names=["doc_id", "row", "copies", "leaf", "text", "tokens"])

    def join(group: pa.Table) -> pa.Table:
        enc = encoder(path, rule)
        order = np.argsort(group.column("leaf").to_numpy())
        texts, tokens = (group.column(c).to_pylist() for c in ("text", "tokens"))
        whole = join_tree(enc, [texts[k] for k in order], [np.frombuffer(tokens[k], np.uint32) for k in order])
        i, copies = (group.column(c)[0].as_py() for c in ("doc_id", "copies"))
        table = pa.Table.from_batches([_result([i], [whole], decode(enc, [whole]))])
        return table.append_column("copies", pa.array([copies], pa.int64()))

    schema = "doc_id bigint, row string, copies bigint, leaf int, text string"
    named = docs.select("doc_id", F.concat_ws(":", "doc_id", F.sha2(F.col("text").cast("binary"), 256)).alias("row"), "text")
    distinct = named.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    pieces = distinct.select("doc_id", "row", "copies", "text").mapInArrow(split, schema).repartition("row", "leaf")
    joined = pieces.mapInArrow(leaves, schema + ", tokens binary").groupBy("row").applyInArrow(join, RESULT + ", copies bigint")
    # one result row a copy, in blocks, so that no long list is made of many copies
    blocks = joined.selectExpr("*", f"explode(sequence(0, (copies - 1) div {COPIES})) AS block")
    return blocks.selectExpr(*[c.split(" ")[0] for c in RESULT.split(", ")],
                             f"explode(sequence(1, least({COPIES}, copies - block * {COPIES}))) AS copy").drop("copy")


def encode_decode(docs: DataFrame, path: str, rule: str = "words", leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per input row."""
    long = F.coalesce(F.length("text") > leaf, F.lit(False))
    rows = docs.select("doc_id", "text")
    return encode_short(rows.where(~long), path, rule).unionByName(encode_long(rows.where(long), path, rule, leaf))
