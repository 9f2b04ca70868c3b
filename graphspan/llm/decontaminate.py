"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

A benchmark item's windows are its runs of n consecutive words (n = 10), or all its words if it has
fewer. Their hashes go to the executors as sorted arrays beside the words themselves. Every text's
words pass once: windows whose hash is in the set are compared with the item's words, byte by byte,
so that a hit is never a matter of hashing.

The benchmark's size is checked first. Up to max_bytes of text its set is broadcast whole. A larger
one is split by item into blocks of about that size; documents are then written once with a row
number, each block adds the marks of the documents that it hits, and the marks join the documents
at the end, so that texts move once whatever the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from graphspan.llm import textarrays as ta
from graphspan.llm.chunks import emit, with_fields
from graphspan.session import materialise

_WORD = [c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)]
_NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in _WORD)
_FOLD = np.frombuffer(_NORMAL, np.uint8)
_GAP = np.array([c == 0x20 for c in _NORMAL])
_STEP = 500
_SIEVE = 1 << 22
ROW, MARKS, ITEMS = "__gs_row", "__gs_marks", "__gs_items"


def normal_words(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words of 0-9, a-z and everything outside ASCII."""
    raw = (text or "").encode() if not isinstance(text, bytes) else text
    return raw.translate(_NORMAL).split()


class _Words:
    """Normalised bytes of some texts, their words and the words' hashes."""

    def __init__(self, texts: pa.Array):
        data, self.bounds = ta.text_bytes(texts)
        self.data = _FOLD[data]
        self.starts, self.ends, self.first = ta.words(self.data, self.bounds, _GAP)
        self.hashes = ta.word_hashes(self.data, self.starts, self.ends)

    def window(self, at: int, width: int) -> list[bytes]:
        return self.data[self.starts[at] : self.ends[at + width - 1]].tobytes().split()


class Windows:
    """The windows of some items: for each width, sorted hashes and where in the words each begins."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.words = _Words(pa.array([text for _, text in items], pa.string()))
        self.ids = [item for item, _ in items]
        sizes = np.diff(self.words.first)
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), sizes)
        self.widths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in np.unique(np.minimum(sizes[sizes > 0], n)).tolist():
            h = ta.window_hashes(self.words.hashes, width)
            at = np.arange(len(h))
            own = self.item[at]
            fits = (np.minimum(sizes[own], n) == width) & (self.item[at + width - 1] == own)
            at = at[fits].astype(np.int32)
            order = np.argsort(h[at], kind="stable")
            sieve = np.zeros(_SIEVE, bool)
            sieve[(h[at] % np.uint64(_SIEVE)).astype(np.int64)] = True
            self.widths[width] = (h[at][order], at[order], sieve)

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, set[str | None]]]:
        """Which words of the texts are hit, each text's first word, and its items by text number."""
        own = _Words(texts)
        hit, found = np.zeros(len(own.starts), bool), {}
        doc = np.repeat(np.arange(len(own.first) - 1), np.diff(own.first))
        for width, (known, place, sieve) in self.widths.items():
            h = ta.window_hashes(own.hashes, width)
            maybe = np.flatnonzero(sieve[(h % np.uint64(_SIEVE)).astype(np.int64)])
            maybe = maybe[doc[maybe] == doc[maybe + width - 1]]
            lo, hi = np.searchsorted(known, h[maybe], "left"), np.searchsorted(known, h[maybe], "right")
            for at, a, b in zip(maybe[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                words = own.window(at, width)
                same = [x for x in place[a:b].tolist() if self.words.window(x, width) == words]
                if same:
                    hit[at : at + width] = True
                    found.setdefault(int(doc[at]), set()).update(self.ids[self.item[x]] for x in same)
        return hit, own.first, found


def _blocks(items: DataFrame, item_col: str, text_col: str, max_bytes: int) -> tuple[int, Iterator[list[tuple[str | None, str | None]]]]:
    """How many blocks of about max_bytes of text the benchmark has, and the blocks, by a hash of the item."""
    size = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, -(-size // max_bytes))
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    own = lambda i: [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == i).distinct().collect()]
    return parts, (own(i) for i in range(parts))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 10,
    max_bytes: int = 8 << 20,
    with_text: bool = True,
) -> DataFrame:
    """docs with n_words, n_hit, items (ids as sorted strings), contaminated and (with_text) clean_text.

    A word is hit if some occurrence of a benchmark window covers it. clean_text is the text with
    the bytes from the first to the last word of every run of hit words replaced by one space; it is
    the text itself where nothing was hit. Null texts have no words; null or empty benchmark items
    have no windows; repeated items count once; an item without an id hits like any other and stands
    as null, last, in items; an empty benchmark leaves every document clean. Repeated rows and null
    ids of documents are rows like others. Input columns named like an output give way to it; others
    pass through.
    """
    spark = docs.sparkSession
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("contaminated", T.BooleanType()),
        *([T.StructField("clean_text", T.StringType())] if with_text else []),
    ]
    schema = with_fields(docs.schema, fields)
    parts, blocks = _blocks(benchmark, item_col, item_text_col, max_bytes)
    if parts == 1:
        shared = spark.sparkContext.broadcast(Windows(next(blocks), n))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                yield from emit(part, schema, _told(part[text_col], *shared.value.scan(part[text_col]), with_text)).to_batches()

        return docs.mapInArrow(whole, schema)

    rows = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    marks = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(Windows(block, n))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                hit, first, found = shared.value.scan(part[text_col])
                at = sorted(found)
                bits = [np.packbits(hit[first[d] : first[d + 1]]).tobytes() for d in at]
                items = pa.array([list(found[d]) for d in at], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part[ROW].combine_chunks().take(pa.array(at, pa.int64())), pa.array(bits, pa.binary()), items], names=[ROW, MARKS, ITEMS])

        one = materialise(rows.select(ROW, text_col).mapInArrow(find, f"{ROW} long, {MARKS} binary, {ITEMS} array<string>"), "marks")
        marks = one if marks is None else marks.union(one)
        shared.unpersist()
    marks = marks.groupBy(ROW).agg(F.collect_list(MARKS).alias(MARKS), F.array_distinct(F.flatten(F.collect_list(ITEMS))).alias(ITEMS))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            first = _Words(part[text_col]).first
            hit, found = np.zeros(first[-1], bool), {}
            for d, (bits, items) in enumerate(zip(part[MARKS].to_pylist(), part[ITEMS].to_pylist(), strict=True)):
                for x in bits or ():
                    hit[first[d] : first[d + 1]] |= np.unpackbits(np.frombuffer(x, np.uint8), count=first[d + 1] - first[d]).astype(bool)
                if items:
                    found[d] = set(items)
            yield from emit(part, schema, _told(part[text_col], hit, first, found, with_text)).to_batches()

    return rows.join(marks, ROW, "left").mapInArrow(united, schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        for lo in range(0, len(batch), _STEP):
            yield pa.Table.from_batches([batch.slice(lo, _STEP)])


def _told(texts: pa.ChunkedArray, hit: np.ndarray, first: np.ndarray, found: dict[int, set[str | None]], with_text: bool) -> dict[str, pa.Array]:
    upto = np.concatenate(([0], np.cumsum(hit)))
    n_hit = upto[first[1:]] - upto[first[:-1]]
    items = [sorted(found.get(d, ()), key=lambda x: (x is None, x)) for d in range(len(n_hit))]
    new = {
        "n_words": pa.array(np.diff(first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
        "items": pa.array(items, pa.list_(pa.string())), "contaminated": pa.array(n_hit > 0),
    }
    if with_text:
        clean = texts.cast(pa.large_binary()).to_pylist() if n_hit.any() else None
        for d in np.flatnonzero(n_hit).tolist():
            clean[d] = _without(clean[d], hit[first[d] : first[d + 1]])
        new["clean_text"] = texts if clean is None else pa.array(clean, pa.large_binary()).cast(pa.string())
    return new


def _without(text: bytes, hit: np.ndarray) -> bytes:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = ta.words(data, np.array([0, len(data)]), _GAP)
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    pieces, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        pieces.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b" ".join([*pieces, text[at:]])


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_text=False)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
