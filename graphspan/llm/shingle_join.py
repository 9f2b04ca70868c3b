"""Exact joins of texts by the Jaccard similarity of their shingle sets.

Every set is put in one order over all shingles, rare ones first. Two sets whose similarity is t or
more then share a shingle among the first few of each: of the larger set (n shingles) the first
n - ceil(t n) + 1, of the smaller the first n - ceil(2 t n / (1 + t)) + 1, and where they first meet
leaves room for the overlap they need. So pairs are proposed by equality on those shingles alone and
none is missed, whatever the order; rare shingles first means that few are proposed in vain.

How rare a shingle is comes from counts in slots of its hash, a table of 64 MB at most. Proposed
pairs are compared on their whole sets. A group of many copies costs comparisons with one pivot, and
those that its links have not joined; pairs that are not compared are connected already. The pivot
is the set whose first shingles are the most frequent ones: among edited copies of a text that is the
one with the fewest edits, to which all those are alike that are alike to any.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphspan.llm import textarrays as ta
from graphspan.operators.components import connected_components
from graphspan.operators.skew import split_hot
from graphspan.session import clearing, kept, materialise

_STEP = 500
_RANGES = 64
_WORDS = 8  # longs of a set's bitmap
_BEFORE = 64  # shingles before a place by which a pair is known to have met already
_EPS = 1e-9


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit hashes of each text's width-word shingles, rising, and where each text's begin.

    Words are lower-cased in A-Z; fewer words than width are one shingle; a text without words has none.
    """
    data, bounds = ta.text_bytes(column)
    data = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
    starts, ends, first = ta.words(data, bounds)
    counts = np.diff(first)
    hashes = ta.word_hashes(data, starts, ends)
    windows = np.minimum(counts, np.maximum(1, counts - width + 1))
    begin = np.cumsum(windows) - windows
    at = np.repeat(first[:-1] - begin, windows) + np.arange(windows.sum())
    own = ta.window_hashes(np.concatenate((hashes, np.zeros(width, np.uint64))), width)[at]
    for d in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        own[begin[d]] = ta.window_hashes(hashes[first[d] : first[d + 1]], int(counts[d]))[0]
    doc = np.repeat(np.arange(len(counts)), windows)
    order = np.lexsort((own, doc))
    own, doc = own[order], doc[order]
    once = np.flatnonzero((np.diff(own, prepend=np.uint64(0)) != 0) | (np.diff(doc, prepend=-1) != 0))
    return own[once], np.searchsorted(doc[once], np.arange(len(counts) + 1))


def _set_words(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each set of hashes; zero for an empty one."""
    filled = np.flatnonzero(np.diff(first))
    out = np.zeros((2, len(first) - 1), np.uint64)
    for i in range(2 if len(filled) else 0):
        out[i, filled] = ta.mix(np.add.reduceat(ta.mix(own + np.uint64(i + 1)), first[filled]))
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_col)


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, len(batch), _STEP):
            part = batch.slice(lo, _STEP)
            yield part, *shingle_sets(part.column(1), width)


def set_prints(docs: DataFrame, bits: int, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, f0, f1, slots, counts): 128 bits that stand for a text's set of shingles.

    Each task ends with rows in which slots, numbers below 2**bits, have how many of its sets held a
    shingle of the slot; id there is the slots' range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.uint32)
        none = lambda n: [pa.nulls(n, pa.binary())] * 2
        names = ["id", "f0", "f1", "slots", "counts"]
        for part, own, first in _batches(batches, width):
            at, n = np.unique(own >> np.uint64(64 - bits), return_counts=True)
            seen[at.astype(np.int64)] += n.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.view(np.int64)) for x in _set_words(own, first)), *none(len(part))], names=names)
        held = np.flatnonzero(seen)
        cut = np.searchsorted(held, np.arange(_RANGES + 1) << max(0, bits - 6))
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if a < b:
                row = [[i], [0], [0], [ta.pack_rising(held[a:b].astype(np.uint64))], [seen[held[a:b]].astype("<u4").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, f0 long, f1 long, slots binary, counts binary")


def rarity(prints: DataFrame, bits: int) -> np.ndarray:
    """How frequent the shingles of each slot are, as levels (four to a doubling) in a byte a slot."""
    span = 1 << max(0, bits - 6)

    def add(table: pa.Table) -> pa.Table:
        low, total = table["id"][0].as_py() * span, np.zeros(span, np.int64)
        for slots, counts in zip(table["slots"], table["counts"], strict=True):
            total[ta.unpack_rising(slots.as_py()).astype(np.int64) - low] += np.frombuffer(counts.as_py(), "<u4")
        return pa.table({"id": [low], "levels": [np.minimum(255, 4 * np.log2(total + 1)).astype(np.uint8).tobytes()]})

    out = np.zeros(1 << bits, np.uint8)
    for low, levels in prints.filter("slots is not null").select("id", "slots", "counts").groupBy("id").applyInArrow(add, "id long, levels binary").collect():
        out[low : low + span] = np.frombuffer(levels, np.uint8)
    return out


def _needed(n: np.ndarray | Column, share: float):
    up = np.ceil if isinstance(n, np.ndarray) else F.ceil
    return up(n * share - _EPS)


def _prefixes(docs: DataFrame, nodes: DataFrame, levels: np.ndarray, bits: int, similarity: float, id_col: str, text_col: str, width: int, vote: Callable) -> DataFrame:
    """(node, n, print, common, first, bits): of each node (node, f0, f1) the size of its set, its SimHash fingerprint, how frequent its
    first shingles are (mean level), those shingles, and the set as a bitmap of hashes in _WORDS longs."""
    known = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own, first in _batches(batches, width):
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            level = known.value[(own >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.lexsort((own, level, doc))
            take = np.where(n > 0, n - _needed(n, similarity).astype(np.int64) + 1, 0)
            offsets = np.concatenate(([0], np.cumsum(take)))
            at = np.repeat(first[:-1] - offsets[:-1], take) + np.arange(offsets[-1])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(own[order][at].view(np.int64)))
            sums = np.concatenate(([0], np.cumsum(level[order][at], dtype=np.int64)))[offsets]
            common = np.diff(sums) / np.maximum(take, 1)
            prints = [pa.array(x.view(np.int64)) for x in _set_words(own, first)]
            held = np.zeros(len(n) * 64 * _WORDS, bool)
            held[doc * (64 * _WORDS) + (own & np.uint64(64 * _WORDS - 1)).astype(np.int64)] = True
            bitmap = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * _WORDS), pa.array(np.packbits(held, bitorder="little").view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), *prints, pa.array(n.astype(np.int32)), pa.array(vote(own, n).view(np.int64)), pa.array(common), lists, bitmap], names=["node", "f0", "f1", "n", "print", "common", "first", "bits"])

    made = _texts(docs, id_col, text_col).mapInArrow(run, "node long, f0 long, f1 long, n int, print long, common double, first array<long>, bits array<long>")
    return made.filter("n > 0").join(nodes, ["node", "f0", "f1"], "left_semi").dropDuplicates(["node", "f0", "f1"]).select("node", "n", "print", "common", "first", "bits")


def _sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, own): the shingle sets, as arrays, of nodes (node, f0, f1), which are ids of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own, first in _batches(batches, width):
            sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(own.view(np.int64)))
            prints = [pa.array(x.view(np.int64)) for x in _set_words(own, first)]
            yield pa.RecordBatch.from_arrays([part.column(0), *prints, sets], names=["node", "f0", "f1", "own"])

    texts = _texts(docs, id_col, text_col).withColumnRenamed("id", "node").join(nodes.select("node").distinct(), "node", "left_semi")
    made = texts.mapInArrow(run, "node long, f0 long, f1 long, own array<long>")
    return made.join(nodes, ["node", "f0", "f1"], "left_semi").dropDuplicates(["node", "f0", "f1"]).select("node", "own")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float, total: int) -> DataFrame:
    """The pairs (u, v) whose sets' Jaccard similarity is at least `similarity`, counted from the sets themselves.

    u may be in many pairs and is then broadcast with its set; v is in few.
    """
    counts = pairs.groupBy("u").agg(F.count("*").alias("m"))
    theirs = pairs.join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    known = sets.select(F.col("node").alias("u"), F.col("own").alias("a")).join(counts, "u")
    hot, cold = split_hot(theirs, known, "u", "m", total, 1000)
    both = F.size(F.array_intersect("a", "b"))
    met = hot.select("u", "v", "a", "b").union(cold.select("u", "v", "a", "b"))
    return met.filter(both / (F.size("a") + F.size("b") - both) >= similarity).select("u", "v").distinct()


def _may(similarity: float) -> Column:
    """Whether two rows (u, un, up and v, vn, vp: node, size, place) of one shingle may be a pair whose first common one it is."""
    un, vn = F.col("un"), F.col("vn")
    low = _needed(F.greatest("un", "vn"), similarity) <= F.least("un", "vn")
    room = 1 + F.least(un - 1 - F.col("up"), vn - 1 - F.col("vp")) >= _needed(un + vn, similarity / (1 + similarity))
    smaller_is_early = F.when(un < vn, _early(un, F.col("up"), similarity)).when(un > vn, _early(vn, F.col("vp"), similarity))
    return (F.col("u") != F.col("v")) & low & room & smaller_is_early.otherwise(_early(un, F.col("up"), similarity) | _early(vn, F.col("vp"), similarity))


def _share_enough(similarity: float) -> Column:
    """Whether two sets (un shingles with bitmap us, vn with vs) may share what the similarity needs: a
    bit that one set has and the other hasn't stands for a shingle that isn't shared."""
    needed = _needed(F.col("un") + F.col("vn"), similarity / (1 + similarity))

    def alone(a: str, b: str) -> Column:
        return reduce(Column.__add__, [F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(i))))) for i in range(_WORDS)])

    return (F.col("un") - alone("us", "vs") >= needed) & (F.col("vn") - alone("vs", "us") >= needed)


def _early(n: Column, place: Column, similarity: float) -> Column:
    """Whether a place is among those by which a set meets one that is as large or larger."""
    return place <= n - _needed(n, 2 * similarity / (1 + similarity))


def jaccard_links(docs: DataFrame, nodes: DataFrame, levels: np.ndarray, bits: int, similarity: float, id_col: str, text_col: str, width: int, vote: Callable, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v) links that span all pairs of nodes (node, f0, f1) whose sets are alike.

    vote makes fingerprints of sets; linked gives the links between fingerprints (node, f0), which are
    compared first. The join on rare shingles proposes the pairs that they have not connected.
    """
    with clearing():
        first = materialise(_prefixes(docs, nodes, levels, bits, similarity, id_col, text_col, width, vote), "prefixes")
        rows = first.select("node", "n", "common", F.posexplode("first").alias("p", "key")).withColumn("early", _early(F.col("n"), F.col("p"), similarity))
        pivot = F.min(F.when(F.col("early"), F.struct((-F.col("common")).alias("rare"), F.xxhash64("node").alias("h"), "node", "n", "p"))).alias("pivot")
        groups = materialise(rows.groupBy("key").agg(F.count("*").alias("m"), pivot).filter("m > 1 and pivot is not null"), "groups")
        total = first.agg(F.sum(F.size("first"))).first()[0] or 0
        cols = ["key", "node", "n", "p", "early", "pivot"]
        hot, cold = split_hot(rows, groups, "key", "m", total)
        members = materialise(hot.select(*cols).union(cold.select(*cols)), "members")

        def compared(pairs: DataFrame) -> DataFrame:
            with clearing():
                pairs = materialise(pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "u", "v").dropDuplicates(["a", "b"]).select("u", "v"), "pairs")
                ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
                sets = materialise(_sets_of(docs, nodes.join(ends, "node", "left_semi"), id_col, text_col, width), "sets")
                return kept(materialise(_alike(pairs, sets, similarity, pairs.count()), "links"))

        star = members.select(F.col("pivot.node").alias("u"), F.col("pivot.n").alias("un"), F.col("pivot.p").alias("up"), F.col("node").alias("v"), F.col("n").alias("vn"), F.col("p").alias("vp"))
        leads = materialise(first.groupBy("print").agg(F.min("node").alias("lead")), "leads")
        near = linked(leads.select(F.col("print").alias("node"), F.col("print").alias("f0")))
        ends = [leads.select(F.col("print").alias(x), F.col("lead").alias(f"{x}_lead")) for x in ("u", "v")]
        near = near.join(ends[0], "u").join(ends[1], "v").select(F.col("u_lead").alias("u"), F.col("v_lead").alias("v"))
        same = first.select("node", "print").join(leads, "print").filter("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
        anchored = compared(near.union(same))
        known = materialise(connected_components(anchored), "anchored")
        at = [known.select(F.col("id").alias(x), F.col("component").alias(f"{x}_at")) for x in ("u", "v")]
        star = star.filter(_may(similarity)).join(at[0], "u", "left").join(at[1], "v", "left").filter(F.coalesce("u_at", "u") != F.coalesce("v_at", "v"))
        links = materialise(anchored.union(compared(star)), "links")
        parts = materialise(connected_components(links), "parts").withColumnRenamed("id", "node")
        placed = members.filter(F.col("node") != F.col("pivot.node")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = materialise(placed.drop("pivot"), "placed")
        sizes = placed.groupBy("key", "component").agg(F.count("*").alias("m"), F.max("early").alias("early"))
        split = sizes.groupBy("key").agg(F.count("*").alias("k"), F.max_by("component", F.struct("m", "component")).alias("main"), F.sum("m").alias("m"), F.max("early").alias("any"))
        split = materialise(split.filter("k > 1 and any").select("key", "main", "m"), "split")
        hot, cold = split_hot(placed, split, "key", "m", total)
        cols = ["key", "node", "n", "p", "early", "component", "main"]
        before = F.slice("first", F.lit(1), F.least("p", F.lit(_BEFORE))).alias("before")
        open_rows = hot.select(*cols).union(cold.select(*cols)).join(first.select("node", "first", "bits"), "node")
        open_rows = materialise(open_rows.select(*cols, before, "bits"), "open")
        strays = open_rows.filter("component <> main").select("key", F.col("node").alias("u"), F.col("n").alias("un"), F.col("p").alias("up"), F.col("early").alias("ue"), F.col("component").alias("own"), F.col("before").alias("ub"), F.col("bits").alias("us"))
        rest = open_rows.select("key", F.col("node").alias("v"), F.col("n").alias("vn"), F.col("p").alias("vp"), F.col("early").alias("ve"), "component", (F.col("component") == F.col("main")).alias("whole"), F.col("before").alias("vb"), F.col("bits").alias("vs"))
        once = F.col("whole") | (F.col("own") < F.col("component"))  # of two strays each sees the other
        apart = (F.col("own") != F.col("component")) & once & _may(similarity) & ~F.arrays_overlap("ub", "vb") & _share_enough(similarity)  # those that overlap have met at an earlier shingle
        more = strays.filter("ue").join(rest, "key").filter(apart).select("u", "v").union(strays.filter("not ue").join(rest.filter("ve"), "key").filter(apart).select("u", "v"))
        return kept(materialise(links.union(compared(more)), "links"))


def table_bits(docs: DataFrame, text_col: str) -> int:
    """Slots of the rarity table: one for every 256 bytes of text, 2**26 at most."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return min(26, max(12, math.ceil(math.log2(size / 256 + 1))))
