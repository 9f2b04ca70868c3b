"""Token sequences in training order, as shards of fixed stride.

Documents are encoded with a byte-level BPE vocabulary (or as UTF-8 bytes), each followed by an end
id; the documents of a partition form a stream that is cut into sequences of equal length, the last
filled with a pad id. Sequences are numbered 0..N-1 and a keyed Feistel network, walking its cycles
until a number falls below N, permutes the numbers into slots: the training order, known for any
sequence without a shuffle table and invertible. Slots are dealt by range to shards, in order, each
sequence a record of fixed size, so that the place of a slot is a file and an offset.

A record is the sequence's ids (little-endian, 1, 2 or 4 bytes each) and one closing newline byte,
which the writer puts there.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphspan.llm import textarrays as ta
from graphspan.llm.token_counts import encoder, vocabulary
from graphspan.session import discard, materialise, scratch

_ROUNDS = 6


class Ids:
    """What documents are encoded to: ids of a vocabulary file, or bytes (ids 0-247 as UTF-8 uses them)."""

    def __init__(self, ranks_path: str | None = None):
        self.raw, n = None, 254
        if ranks_path:
            with open(ranks_path, "rb") as f:
                self.raw = f.read()
            n = 1 + max(int(x.split()[1]) for x in self.raw.splitlines() if x.strip())
        self.pad, self.end = n, n + 1
        self.kind = np.dtype("<u1" if n < 1 << 8 else "<u2" if n < (1 << 16) - 1 else "<u4")

    def encode(self, texts: pa.Array) -> np.ndarray:
        """The ids of all texts, one after the other, with the end id after each."""
        if self.raw is None:
            data, bounds = ta.text_bytes(texts)
            own = np.full(len(data) + len(texts), self.end, self.kind)
            body = np.ones(len(own), bool)
            body[bounds[1:] + np.arange(len(texts))] = False
            own[body] = data
            return own
        encode, out = encoder(self.raw).encode_ordinary, []
        for text in texts.to_pylist():
            out.extend(encode(text or ""))
            out.append(self.end)
        return np.array(out, self.kind)


def _halves(n: int) -> int:
    return max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))


def _feistel(x: np.ndarray, half: int, key: int, rounds: range) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    forward = rounds.step > 0
    for r in rounds:
        salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) & (2**64 - 1))
        if forward:
            left, right = right, left ^ (ta.mix(right + salt) & mask)
        else:
            left, right = right ^ (ta.mix(left + salt) & mask), left
    return left << shift | right


def _walk(x: np.ndarray, n: int, key: int, rounds: range) -> np.ndarray:
    out = np.asarray(x, np.uint64).copy()
    left = np.arange(len(out))
    while len(left):
        out[left] = _feistel(out[left], _halves(n), key, rounds)
        left = left[out[left] >= np.uint64(n)]
    return out.astype(np.int64)


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each sequence number among n, a bijection of 0..n-1 for each key."""
    return _walk(numbers, n, key, range(_ROUNDS))


def numbers(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """The sequence number in each slot: the inverse of slots()."""
    return _walk(at, n, key, range(_ROUNDS - 1, -1, -1))


def write_training_order(
    docs: DataFrame, path: str, text_col: str = "text", ranks_path: str | None = None, length: int = 2048, key: int = 20240229, shard_rows: int = 4096
) -> dict[str, int]:
    """Write shards under path; returns what a reader needs: n, length, width, pad, stride, shard_rows, key.

    Texts are encoded once, with the vocabulary of ranks_path (none: as bytes), and their sequences
    written with the number of the partition and their place in it; how many each partition has
    passes the driver, which schedules them anyway. Null texts are empty documents (an end id only).
    Repeated rows are documents like others; other columns are not read. No shards for no documents.
    A reader holds a shard whole (17 MB by default), so shard_rows bounds its memory.
    """
    spark, ids = docs.sparkSession, Ids(ranks_path)
    shared = spark.sparkContext.broadcast(ids)
    cut = materialise(docs.select(text_col).mapInArrow(lambda batches: _cut(batches, shared.value, length), "part int, place long, tokens binary"), "sequences", "zstd", 9)
    bases, n = {}, 0
    for part, some in sorted(map(tuple, cut.groupBy("part").agg(F.max("place") + 1).collect())):
        bases[part] = n
        n += some
    told = {"n": n, "length": length, "width": ids.kind.itemsize, "pad": ids.pad, "stride": length * ids.kind.itemsize + 1, "shard_rows": shard_rows, "key": key}
    if n:
        starts = spark.sparkContext.broadcast(bases)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                kinds, where = np.unique(part, return_inverse=True)
                base = np.array([starts.value[x] for x in kinds.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slots(base[where] + place, n, key)), batch.column(2)], names=["slot", "tokens"])

        made = cut.mapInArrow(placed, "slot long, tokens binary")
        made = made.repartitionById(-(-n // shard_rows), F.floor(F.col("slot") / shard_rows).cast("int")).sortWithinPartitions("slot")
        made.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", "\n").text(path)
    discard(cut)
    return told


def _cut(batches: Iterator[pa.RecordBatch], ids: Ids, length: int) -> Iterator[pa.RecordBatch]:
    """The sequences of one partition's stream of documents."""
    from pyspark import TaskContext

    part, number, rest = TaskContext.get().partitionId(), 0, np.zeros(0, ids.kind)

    def sequences(stream: np.ndarray) -> pa.RecordBatch:
        nonlocal number
        count = len(stream) // length
        tokens = pa.Array.from_buffers(pa.binary(length * ids.kind.itemsize), count, [None, pa.py_buffer(np.ascontiguousarray(stream))])
        at = number + np.arange(count)
        number += count
        return pa.RecordBatch.from_arrays([pa.array(np.full(count, part, np.int32)), pa.array(at), tokens.cast(pa.binary())], names=["part", "place", "tokens"])

    for batch in batches:
        for lo in range(0, len(batch), 500):
            stream = np.concatenate((rest, ids.encode(batch.column(0).slice(lo, 500))))
            whole = len(stream) // length * length
            if whole:
                yield sequences(stream[:whole])
            rest = stream[whole:]
    if len(rest):
        yield sequences(np.concatenate((rest, np.full(length - len(rest), ids.pad, ids.kind))))


def shard_files(spark: SparkSession, path: str, first_shard: int = 0) -> list[str]:
    """The files of shards from first_shard on, in order: a shard is the number in its file's name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = [str(x.getPath().toString()) for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    named = {int(m[1]): x for x in listed if (m := re.match(r"part-(\d+)", x.rpartition("/")[2]))}
    return [named[k] for k in sorted(named) if k >= first_shard]


def read_training_order(spark: SparkSession, path: str, told: dict[str, int], first_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, tokens) from first_slot on, shard by shard as written.

    Files are listed first and shards before first_slot's are not opened; its own is read whole, and
    what lies before the slot's byte offset is left out. tokens has told["width"] bytes an id.
    """
    stride, per = told["stride"], told["shard_rows"]
    shape = "slot long, shard int, byte_offset long, tokens binary"
    wanted = shard_files(spark, path, first_slot // per) if told["n"] > first_slot else []
    if not wanted:
        return spark.createDataFrame([], shape)
    files = spark.read.format("binaryFile").load(wanted)
    files = files.withColumn("shard", F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                begin = max(0, first_slot - shard * per)
                for lo in range(begin, len(raw), 1024):
                    part = np.ascontiguousarray(raw[lo : lo + 1024, :-1])
                    at = np.arange(lo, lo + len(part))
                    tokens = pa.Array.from_buffers(pa.binary(stride - 1), len(part), [None, pa.py_buffer(part)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(shard * per + at), pa.array(np.full(len(part), shard, np.int32)), pa.array(at * stride), tokens], names=["slot", "shard", "byte_offset", "tokens"])

    return files.select("shard", "content").mapInArrow(run, shape)


def checked_order(spark: SparkSession, path: str, told: dict[str, int], first_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, sequence, n_tokens, crc32) as read back: the sequence in each slot,
    its ids without padding, and a checksum of its bytes."""
    shape = "slot long, shard int, byte_offset long, sequence long, n_tokens int, crc32 long"
    n, key, pad, kind = told["n"], told["key"], told["pad"], np.dtype(f"<u{told['width']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [x.as_py() for x in batch.column(3)]
            filled = [int((np.frombuffer(t, kind) != pad).sum()) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(numbers(batch.column(0).to_numpy(), n, key)), pa.array(filled, pa.int32()), pa.array([zlib.crc32(t) for t in tokens], pa.int64())],
                names=["slot", "shard", "byte_offset", "sequence", "n_tokens", "crc32"],
            )

    return read_training_order(spark, path, told, first_slot).mapInArrow(run, shape)


def op5(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "training-order")
    told = write_training_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, ranks_path=vocabulary(spark))
    return checked_order(spark, path, told)
