"""Token-ID output (operator 9): independent zstandard frames with a seek table.

A shard file follows the public *zstd seekable format*: independent frames,
then a skippable frame that holds the seek table (compressed size, plain size
and the low 32 bits of XXH64 of the plain bytes for every frame) and ends
with the table's magic number.  Before the seek table stands a skippable frame
with the document index (doc_id, presence flag, number of tokens), which has an entry of
plain size 0 in the table.  The plain
bytes are the token ids of the shard's documents as little-endian unsigned
32-bit integers, each document closed by the end id.  A frame holds about
``FRAME`` tokens: whole documents, or a part of one that is longer.  A reader
takes the tail of a file, then only the frames of the documents it wants, and
checks their checksums.

Writing: documents are range-partitioned by (doc_id, text hash), so a doc_id
that many rows carry still spreads; each task streams its partition into one
file in the shared folder under a name of its own attempt, and its manifest
row (shard number, path, tokens) is committed by Spark.  Files of lost or
repeated attempts are never named by the manifest.  Shard starts are a running
sum over the manifest, one row a shard.

Defined cases: NULL or empty text is the end id alone.  NULL doc_ids come
first, rows that repeat a doc_id follow each other by text hash and text.  An
empty table gives no shard and no row.  Only doc_id and text are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limnos.llm.bpe import encoder, text_batches
from limnos.llm.common import scratch, stored

FRAME = 65_536
END = 0
LEVEL = 3

# Fixed values of the zstd seekable format.
SKIPPABLE_TABLE = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A5D
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

INDEX = np.dtype([("doc_id", "<i8"), ("known", "<u8"), ("n_tokens", "<u8")])


class ShardWriter:
    def __init__(self, out):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=LEVEL)
        self.table, self.index, self.held, self.count, self.total = [], [], [], 0, 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, doc_id is not None, len(ids)))
        self.total += len(ids)
        for at in range(0, len(ids), FRAME):
            part = ids[at:at + FRAME]
            if self.count and self.count + len(part) > FRAME:
                self.flush()
            self.held.append(part)
            self.count += len(part)

    def flush(self) -> None:
        if self.held:
            plain = np.concatenate(self.held).astype("<u4").tobytes()
            packed = self.zstd.compress(plain)
            self.out.write(packed)
            self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.held, self.count = [], 0

    def close(self) -> None:
        self.flush()
        index = np.array(self.index, INDEX).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        # the table lists every frame before it; this one holds no plain bytes
        self.table.append((8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *x) for x in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table) + len(foot)) + table + foot)
        self.out.close()


class ShardReader:
    """Random access to one shard: ``documents(wanted)`` decompresses only the
    frames that hold wanted documents."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        frames, flag, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError(f"{path}: no seek table")
        table = np.frombuffer(self.file.read_at(12 * frames, size - 9 - 12 * frames), "<u4").reshape(-1, 3)[:-1]
        self.sums = table[:, 2]
        self.offset = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.token = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64) // 4])
        at = int(self.offset[-1])
        magic, length = struct.unpack("<II", self.file.read_at(8, at))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"{path}: no document index")
        self.index = np.frombuffer(self.file.read_at(length, at + 8), INDEX)
        self.start = np.concatenate([[0], np.cumsum(self.index["n_tokens"].astype(np.int64))])
        self._frame, self._plain = -1, None

    def frame(self, k: int) -> np.ndarray:
        if k != self._frame:
            a, z = int(self.offset[k]), int(self.offset[k + 1])
            plain = zstandard.ZstdDecompressor().decompress(self.file.read_at(z - a, a))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k}: checksum differs")
            self._frame, self._plain = k, np.frombuffer(plain, "<u4")
        return self._plain

    def tokens(self, row: int) -> np.ndarray:
        a, z = int(self.start[row]), int(self.start[row + 1])
        parts, k = [], int(np.searchsorted(self.token, a, "right")) - 1
        while a < z:
            base, end = int(self.token[k]), int(self.token[k + 1])
            parts.append(self.frame(k)[a - base:min(z, end) - base])
            a, k = min(z, end), k + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def documents(self, wanted=None):
        """(row, doc_id or None, ids) of the wanted doc_ids, or of all."""
        for row, (i, known, _) in enumerate(self.index.tolist()):
            if wanted is None or (known and i in wanted):
                yield row, i if known else None, self.tokens(row)

    def close(self):
        self.file.close()


MANIFEST = "shard int, path string, n_docs bigint, n_tokens bigint"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, rule: str = "bytes", end_id: int = END) -> DataFrame:
    """Write the shards; returns the committed manifest."""
    def run(batches):
        enc = encoder(tokenizer, rule)
        shard, writer = TaskContext.get().partitionId(), None
        fs, base = pafs.FileSystem.from_uri(folder)
        name = f"shard-{shard:08d}-{uuid.uuid4().hex}.zst"
        for (ids,), texts in text_batches(batches, ["doc_id"]):
            if writer is None:
                fs.create_dir(base, recursive=True)
                writer = ShardWriter(fs.open_output_stream(f"{base}/{name}", compression=None))
            for i, tokens in zip(ids, enc.encode(texts)):
                writer.add(i, np.append(tokens, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.index)], pa.int64()),
                 pa.array([writer.total], pa.int64())], names=["shard", "path", "n_docs", "n_tokens"])
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).repartitionByRange("doc_id", "th") \
        .sortWithinPartitions("doc_id", "th", "text").select("doc_id", "text")
    return stored(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                reader = ShardReader(path)
                rows = [(i, first + int(reader.start[k]), len(t), zlib.crc32(t.astype("<u4").tobytes()))
                        for k, i, t in reader.documents()]
                reader.close()
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    shards = max(1, manifest.count())
    return placed.repartition(shards, "shard").select("path", "first") \
        .mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, tokenizer, scratch(spark, "tokens")))
