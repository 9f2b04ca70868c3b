"""Runs of periodic words in every text by partition refinement over equal factors.

Positions of a text are equal at length l if the l words from each on are. The classes of length 1
are refined length by length: at each length only the pieces that split off at the one before, all
but the largest of each class, look at the positions before them (the smaller-half strategy), so that
n words cost n log n. Each class keeps its positions linked in order. A position and the next one of
its class, g apart, are a square with a root of g words if they are neighbours at length g; such
roots are primitive, and squares of one period at consecutive positions make up a run.

All texts of a block are refined together: a text's words and its end mark are its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from graphspan.llm.chunks import emit, with_fields
from graphspan.llm.textarrays import text_bytes, words

_BITS = 21
_FEW = 48
_WORDS = 1 << 20  # words of a block, unless one text has more
_COPY = 1 << 20  # bytes copied at once
_RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


def _sorted_touched(c: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions q ordered by class c, then s, then position."""
    if max(int(c.max()), int(s.max()), int(q.max())) < 1 << _BITS:
        packed = np.sort((c << (2 * _BITS)) | (s << _BITS) | q)
        low = (1 << _BITS) - 1
        return packed >> (2 * _BITS), (packed >> _BITS) & low, packed & low
    order = np.lexsort((q, s, c))
    return c[order], s[order], q[order]


class Refinement:
    """Classes of equal factors of several texts, refined from length 1 on.

    ids are word numbers, bounds the texts' first words (n + 1 offsets). Positions count the words
    and one end mark after each text. squares() gives (position, period) of all primitive squares.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        sizes = np.diff(bounds)
        text = np.repeat(np.arange(len(sizes)), sizes)
        word_at = np.arange(len(ids)) + text  # the position of each word
        self.n = n = len(ids) + len(sizes)
        self.longest = int(sizes.max()) if len(sizes) else 0
        self.first = np.zeros(n + 1, bool)
        self.first[bounds[:-1] + np.arange(len(sizes))] = True
        _, key = np.unique(ids, return_inverse=True)
        key = text * (int(key.max()) + 1 if len(key) else 1) + key
        order = np.argsort(key, kind="stable")
        key, self.perm = key[order], word_at[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        of = np.cumsum(new) - 1
        # at most n classes ever exist, since they only split; end marks have one each
        self.classes = len(begin) + len(sizes)
        self.size, self.begin = np.ones(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.size[: len(begin)], self.begin[: len(begin)] = size, begin
        self.cls = np.full(n, -1)
        self.cls[self.perm] = of
        ends = bounds[1:] + np.arange(len(sizes))
        self.cls[ends] = len(begin) + np.arange(len(sizes))
        self.where = np.zeros(n, np.int64)
        self.where[self.perm] = np.arange(len(self.perm))
        self.next, self.prev = np.full(n + 1, n), np.full(n + 1, n)  # n: none
        same = np.flatnonzero(~new)
        self.next[self.perm[same - 1]], self.prev[self.perm[same]] = self.perm[same], self.perm[same - 1]
        self.born = np.ones(n + 1, np.int64)
        self.mark = np.zeros(n + 1, bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        # of each text's words all but its most frequent one are small
        large = np.zeros(self.classes + 1, bool)
        if len(begin):
            owner = text[order][begin]
            by_size = np.lexsort((size, owner))
            large[by_size[np.append(np.flatnonzero(np.diff(owner[by_size])), len(by_size) - 1)]] = True
        self.small = np.flatnonzero(~large[self.cls])

    def _died(self, x: np.ndarray, level: int) -> None:
        """Neighbours x and next[x] part at this length: a square if they were ones at length next[x] - x."""
        gap = self.next[x] - x
        square = (self.next[x] < self.n) & (self.born[x] <= gap) & (gap < level)
        if square.any():
            self.found.append((x[square], gap[square]))

    def _refine(self, level: int) -> None:
        """From length level - 1 to level."""
        small = np.asarray(self.small)
        p = small[~self.first[small]]
        q = p - 1
        c = self.cls[q]
        wide = self.size[c] > 1
        self.small = p[:0]
        if not wide.any():
            return
        c, s, q = _sorted_touched(c[wide], self.cls[p[wide]], q[wide])
        turn_c = np.ones(len(c), bool)
        turn_c[1:] = c[1:] != c[:-1]
        turn = turn_c.copy()
        turn[1:] |= s[1:] != s[:-1]
        at, at_c = np.flatnonzero(turn), np.flatnonzero(turn_c)
        count, total = np.diff(np.append(at, len(c))), np.diff(np.append(at_c, len(c)))
        group_class = np.cumsum(turn_c)[at] - 1  # each group's class, numbered among those touched
        left = self.size[c[at_c]] - total
        most = np.maximum.reduceat(count, np.searchsorted(at, at_c))
        split = (left > 0) | (most < total)
        if not split.all():
            stay = split[np.repeat(np.arange(len(total)), total)]
            if not stay.any():
                return
            c, q = c[stay], q[stay]
            in_split = split[group_class]
            group_class = (np.cumsum(split) - 1)[group_class[in_split]]
            count, total, left, most = count[in_split], total[split], left[split], most[split]
            at, at_c = np.cumsum(count) - count, np.cumsum(total) - total
        classes = c[at_c]
        self._unlink(c, q, left, total, level)
        self._move(q, classes, left, total)
        # the first largest group of a class, if it is larger than what is left
        largest = np.zeros(len(count), bool)
        peak = np.flatnonzero(count == most[group_class])
        largest[peak[np.unique(group_class[peak], return_index=True)[1]]] = True
        largest &= (most > left)[group_class]
        keeps = largest & (left == 0)[group_class]  # nothing is left: the largest keeps the number
        fresh = ~keeps
        number = classes[group_class]
        number[fresh] = self.classes + np.arange(int(fresh.sum()))
        self.classes += int(fresh.sum())
        self.cls[q] = np.repeat(number, count)
        some = left > 0
        self.size[classes[some]] = left[some]
        self.size[number] = count
        self.begin[number] = self.where[q[at]]
        listed = [q[np.repeat(~largest, count)]]
        rest = np.flatnonzero((most > left) & some)
        if len(rest):
            n = left[rest]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            listed.append(self.perm[np.repeat(self.begin[classes[rest]], n) + step])
        self.small = np.concatenate(listed)
        # links within each group
        after, before = np.full(len(q), self.n), np.full(len(q), self.n)
        inner = np.ones(len(q), bool)
        inner[at] = False
        inner = np.flatnonzero(inner)
        after[inner - 1], before[inner] = q[inner], q[inner - 1]
        changed = after != self.next[q]
        x = q[changed]
        self._died(x, level)
        self.next[x], self.born[x] = after[changed], level
        self.prev[q] = before

    def _unlink(self, c: np.ndarray, q: np.ndarray, left: np.ndarray, total: np.ndarray, level: int) -> None:
        """Close the gaps that positions q leave among those that stay in their classes."""
        out = q[np.repeat(left > 0, total)]
        if not len(out):
            return
        c = c[np.repeat(left > 0, total)]
        out = out[np.lexsort((out, c))] if len(out) > 1 else out
        self.mark[out] = True
        head, tail = out[~self.mark[self.prev[out]]], out[~self.mark[self.next[out]]]
        self.mark[out] = False
        before, after = self.prev[head], self.next[tail]
        there = before < self.n
        x = before[there]
        self._died(x, level)
        self.next[x], self.born[x] = after[there], level
        there = after < self.n
        self.prev[after[there]] = before[there]

    def _move(self, q: np.ndarray, classes: np.ndarray, left: np.ndarray, total: np.ndarray) -> None:
        """Bring positions q to the ends of their classes' stretches of perm, in the order of q."""
        start = np.repeat(self.begin[classes] + left, total)
        slots = start + np.arange(len(q)) - np.repeat(np.cumsum(total) - total, total)
        self.mark[q] = True
        held = self.perm[slots]
        movers = held[~self.mark[held]]
        self.mark[q] = False
        holes = self.where[q]
        holes = holes[holes < start]
        self.perm[holes], self.where[movers] = movers, holes
        self.perm[slots], self.where[q] = q, slots

    def _refine_few(self, level: int, small: list[int]) -> list[int]:
        """_refine() without arrays, for the many lengths at which a handful of positions moves."""
        n, cls, size, begin = self.n, memoryview(self.cls), memoryview(self.size), memoryview(self.begin)
        nxt, prv, born, perm, where = (memoryview(x) for x in (self.next, self.prev, self.born, self.perm, self.where))
        pieces: dict[int, dict[int, list[int]]] = {}
        for p in sorted(small):
            if not self.first[p] and size[c := cls[p - 1]] > 1:
                pieces.setdefault(c, {}).setdefault(cls[p], []).append(p - 1)
        listed, ended = [], []
        for c, groups in pieces.items():
            touched = {q for group in groups.values() for q in group}
            left, most = size[c] - len(touched), max(map(len, groups.values()))
            if not left and len(groups) == 1:
                continue
            for q in touched if left else ():
                if prv[q] in touched:
                    continue
                tail = q
                while nxt[tail] in touched:
                    tail = nxt[tail]
                before, after = prv[q], nxt[tail]
                if before < n:
                    ended.append((before, q - before, born[before]))
                    nxt[before], born[before] = after, level
                if after < n:
                    prv[after] = before
            slot, start, large = begin[c] + left, begin[c], most > left
            for group in groups.values():
                keeps, number = large and len(group) == most, self.classes
                large = large and not keeps
                if keeps and not left:
                    number = c
                else:
                    self.classes += 1
                begin[number], size[number] = slot, len(group)
                for i, q in enumerate(group):
                    held, at = perm[slot], where[q]
                    perm[at], where[held], perm[slot], where[q] = held, at, q, slot
                    slot += 1
                    cls[q], prv[q] = number, group[i - 1] if i else n
                    after = group[i + 1] if i + 1 < len(group) else n
                    if after != nxt[q]:
                        if nxt[q] < n:
                            ended.append((q, nxt[q] - q, born[q]))
                        nxt[q], born[q] = after, level
                if not keeps:
                    listed += group
            if left:
                size[c] = left
                if most > left:
                    listed += perm[start : start + left].tolist()
        if square := [(x, gap) for x, gap, since in ended if since <= gap < level]:
            self.found.append((np.array([x for x, _ in square]), np.array([g for _, g in square])))
        return listed

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        level = 1
        while len(self.small) and level <= self.longest // 2:
            level += 1
            if len(self.small) > _FEW:
                self._refine(level)
            else:
                self.small = self._refine_few(level, [int(x) for x in self.small])
        alive = np.flatnonzero(self.next[: self.n] < self.n)
        self._died(alive, level + 1)
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in self.found]), np.concatenate([g for _, g in self.found])


def find_runs(ids: np.ndarray, bounds: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of at least `least` words, by text, start, period.

    A run is as long as twice its smallest period at least, and no word beside it keeps that period.
    """
    long_enough = np.flatnonzero(np.diff(bounds) >= max(2, least))
    sizes = np.diff(bounds)[long_enough]
    own = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.arange(own[-1]) + np.repeat(bounds[:-1][long_enough] - own[:-1], sizes)
    at, period = Refinement(ids[inside], own).squares()
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    start, q = at[begin], period[begin]
    length = count - 1 + 2 * q
    starts = own[:-1] + np.arange(len(sizes))
    text = np.searchsorted(starts, start, "right") - 1
    start = start - starts[text]
    keep = np.flatnonzero(length >= least)
    keep = keep[np.lexsort((q[keep], start[keep], text[keep]))]
    return long_enough[text[keep]], start[keep], length[keep], q[keep]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> pa.Array:
    """The words at starts:ends of each of n texts (their numbers rise), joined by one space."""
    size = ends - starts
    gap = np.zeros(len(text), np.int64)
    gap[:-1] = text[1:] == text[:-1]
    to = np.cumsum(size + gap) - (size + gap)
    total = int(to[-1] + size[-1]) if len(to) else 0
    out = np.full(total, 0x20, np.uint8)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(to, to[i] + _COPY)))
        if j == i + 1:  # one word may be very long
            out[to[i] : to[i] + size[i]] = data[starts[i] : ends[i]]
        else:
            own = size[i:j]
            step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            out[np.repeat(to[i:j], own) + step] = data[np.repeat(starts[i:j], own) + step]
        i = j
    bytes_of = np.bincount(text, size + gap, n).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(bytes_of)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def _word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Equal numbers for equal words."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    np.subtract.at(inside, ends, 1)
    raw = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    column = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _block(texts: pa.ChunkedArray, seeds: list | None, rewrite: Callable | None, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each text the number of words, its runs, and the text without what they repeat."""
    data, bounds = text_bytes(texts)
    starts, ends, first = words(data, bounds)
    n = len(first) - 1
    source = np.arange(len(starts))
    for i, seed in enumerate(seeds or []):
        size = int(first[i + 1] - first[i])
        changed = rewrite(seed, size) if seed is not None and size else None
        if changed:
            a, p = changed
            source[first[i] + a : first[i + 1]] = first[i] + a + np.arange(size - a) % p
    text, start, length, period = find_runs(_word_numbers(data, starts, ends, len(starts))[source], first, least)
    over = np.zeros(len(starts) + 1, np.int64)
    np.add.at(over, first[text] + start + period, 1)
    np.add.at(over, first[text] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(over[:-1]) == 0)
    owner = np.repeat(np.arange(n), np.diff(first))[kept]
    collapsed = _joined(data, starts[source[kept]], ends[source[kept]], owner, n)
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_ARROW_RUN))
    by_text = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(by_text), runs), collapsed


def periodic_runs(
    docs: DataFrame, text_col: str = "text", least: int = 12, seed: Column | None = None, rewrite: Callable[[int, int], tuple[int, int] | None] | None = None,
) -> DataFrame:
    """docs with n_words, runs (array of start, length, period, by start, then period) and collapsed.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, numbered from 0. A run is a stretch of words with
    smallest period q, at least max(least, 2 q) long, that no neighbouring word extends. collapsed is
    the text, words joined by one space, without the words that lie in a run after its first q.
    A null or empty text has no words and no runs. Rows are independent of each other: ids may be null,
    repeated or missing, every column of docs passes through, but for those with the new names (in
    any case). With rewrite, a text whose seed isn't null and for which rewrite(seed, n_words) is
    (a, p) is read as if each word i >= a were word a + (i - a) % p.

    Nothing is shuffled: a task takes its texts in blocks of a million words, a longer one alone.
    """
    long = T.LongType()
    fields = [T.StructField("n_words", long), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]
    schema = with_fields(docs.schema, fields)
    text, own = "__gs_text", "__gs_seed"
    rows = docs.withColumn(text, F.col(text_col).cast("string")).withColumn(own, (F.lit(None) if seed is None else seed).cast("long"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            size = np.cumsum(np.diff(text_bytes(table[text])[1]))
            i = 0
            while i < len(table):
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + 6 * _WORDS, "right")))
                part = table.slice(i, j - i)
                n, runs, collapsed = _block(part[text], part[own].to_pylist() if rewrite else None, rewrite, least)
                yield from emit(part, schema, {"n_words": n, "runs": runs, "collapsed": collapsed}).combine_chunks().to_batches()
                i = j

    return rows.mapInArrow(found, schema)


def op12_rule(h: int, n: int) -> tuple[int, int] | None:
    """fixed rule of the query: which texts repeat from which word on, and with which period"""
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op12(spark, sf_dir: str) -> DataFrame:
    """A null doc_id has no checksum, so its text is taken as it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs, seed=F.crc32(F.col("doc_id").cast("string")), rewrite=op12_rule)
    rank = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    best = F.array_max(F.transform("runs", rank))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
