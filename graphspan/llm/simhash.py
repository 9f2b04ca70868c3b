"""SimHash near-duplicates by anchor-point covering.

A fingerprint's bits are majority votes over the hashes of a document's shingles. To find all
fingerprints that differ in few bits, their bits are cut into blocks of up to 31, enough of them
that two linked fingerprints differ in at most one bit of some block. The words of the perfect
single-error-correcting code of length 31 are the anchors of a block: each word lies within
covering radius 1 of exactly one anchor, its home. A fingerprint goes to every anchor within
radius plus threshold, 1 + 1 = 2, of its block (16 at most); two linked fingerprints so meet at
the home of either, where they are compared in full.

Only distinct fingerprints take part, so a group of exact copies is one row, and an anchor emits a
spanning forest of the links it finds, never all pairs. Components then form over these edges.

near_duplicates() links texts by the similarity of their shingle sets itself. Fingerprints of the sets
are linked by their anchors, and the pairs compared on the sets. No covering of a fingerprint's bits
reaches all pairs at similarity 0.8 (a bit differs with probability 0.15, so that a block of 31 is
within one bit in 4 % of such pairs), so shingle_join proposes those that anchors have not connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from graphspan.llm import shingle_join as sj
from graphspan.operators.components import connected_components
from graphspan.operators.skew import split_hot
from graphspan.session import clearing, kept, materialise

_PLACES = np.arange(1, 32, dtype=np.uint64)
_PARITY = [np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1)) for b in range(5)]
#: for each syndrome, the patterns of two bits that have it, less the syndrome's own bit
_PAIRS = {s: np.array([1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s], np.uint64) for s in range(1, 32)}
_LANES = np.uint64(0x0101010101010101)
_SMALL = 64


def vote(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] 64-bit hashes, the bits that are set in over half of them."""
    begin = np.concatenate(([0], np.cumsum(counts)))
    runs = -(-counts // 255)
    at = np.repeat(begin[:-1], runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    filled = np.flatnonzero(counts)
    votes = np.zeros((len(counts), 8, 8), np.int64)
    if len(at):
        groups = np.cumsum(runs[filled]) - runs[filled]
        for s in range(8):
            lanes = np.add.reduceat((hashes >> np.uint64(s)) & _LANES, at)
            votes[filled, s] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), groups, axis=0)
    bits = 2 * votes > counts[:, None, None]
    return np.packbits(bits.transpose(0, 2, 1).reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()


def _shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, f0): the 64-bit fingerprint of width-word shingles, repeats included, lower-cased in A-Z.

    A shingle's hash is XXH64 of its words joined by one space. Fewer words than width are one
    shingle; a text without words, or null, has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, len(batch), 500):
                texts = batch.column(1).slice(lo, 500).cast(pa.large_binary()).to_pylist()
                hashes = [np.array(_shingle_hashes(t or b"", width, seed), np.uint64) for t in texts]
                prints = vote(np.concatenate(hashes), np.array([len(h) for h in hashes]))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 500), pa.array(prints.view(np.int64))], names=["id", "f0"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, f0 long")


def _anchored(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, home) of every anchor that a block's word is dealt to."""
    rows, keys, homes = [], [], []
    for number, block in enumerate(blocks):
        tag = np.uint64(number << 32)
        syndrome = np.zeros(len(block), np.uint64)
        for b, mask in enumerate(_PARITY):
            syndrome |= (np.bitwise_count(block & mask) & 1).astype(np.uint64) << np.uint64(b)
        own = np.where(syndrome > 0, block ^ (np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1))), block)
        rows.append(np.arange(len(block)))
        keys.append(own | tag)
        homes.append(np.ones(len(block), bool))
        for s in range(1, 32):
            at = np.flatnonzero(syndrome == s)
            near = (block[at, None] ^ _PAIRS[s][None, :]) | tag
            rows.append(np.repeat(at, near.shape[1]))
            keys.append(near.ravel())
            homes.append(np.zeros(near.size, bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _blocks(words: np.ndarray) -> list[np.ndarray]:
    """The lower 31 bits of each half of each 64-bit word."""
    mask = np.uint64(0x7FFFFFFF)
    return [(words[:, i] >> np.uint64(s)) & mask for i in range(words.shape[1]) for s in (0, 32)]


def _distance(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)


def _forest(key: np.ndarray, home: np.ndarray, node: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys; of a large run a spanning forest of its links."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[at, len(key)])
    size = np.repeat(sizes, sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    few = size <= _SMALL
    for step in range(1, _SMALL):
        a = np.flatnonzero((key[step:] == key[:-step]) & few[step:] & (home[step:] | home[:-step]))
        if not len(a) and not (sizes > step).any():
            break
        hit = a[_distance(prints, a, a + step) <= most]
        found.append((node[hit], node[hit + step]))
    for lo, n in zip(at[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        mine, own = prints[lo : lo + n], node[lo : lo + n]
        label = np.arange(n)
        for h in np.flatnonzero(home[lo : lo + n]).tolist():
            near = label[np.bitwise_count(mine ^ mine[h]).sum(axis=1, dtype=np.int64) <= most]
            if (near != near[0]).any():
                met = np.zeros(n, bool)
                met[near] = True
                label[met[label]] = near.min()
        moved = np.flatnonzero(label != np.arange(n))
        found.append((own[moved], own[label[moved]]))
    return np.concatenate([x for x, _ in found] or [node[:0]]), np.concatenate([x for _, x in found] or [node[:0]])


def linked(prints: DataFrame, most: int, crowd: int = 20_000) -> DataFrame:
    """(u, v) edges that span all links, at most `most` <= 3 differing bits, between nodes.

    prints has one row per distinct fingerprint: node, f0. Of 64 bits two blocks of 31 are covered;
    of three differing bits at most one is in one of them, so every linked pair meets at an anchor.

    An anchor of more than `crowd` rows is split: its fingerprints go to most + 1 parts by as many
    runs of the 33 bits that the anchor's block leaves free, of which two linked ones have one in
    common; a part that is still larger, once more by runs of the other free bits.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                node, f0 = (x.to_numpy(zero_copy_only=False) for x in batch.slice(lo, 2000).columns)
                row, key, home = _anchored(_blocks(f0.view(np.uint64)[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(home), pa.array(node[row]), pa.array(f0[row])], names=["key", "home", "node", "f0"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def links(key, part, home, node, f0) -> pa.RecordBatch:
            run = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            pairs = _forest(run, home, node, f0.view(np.uint64)[:, None], most)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], names=["u", "v"])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(held[0]):
                continue
            other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            whole = int(other[-1]) + 1 if len(other) else 0  # the last run may go on
            if whole:
                yield links(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield links(*held)

    dealt = materialise(prints.select("node", "f0").mapInArrow(deal, "key long, home boolean, node long, f0 long"), "anchors")
    at = max(crowd, -(-32 * prints.count() // 10_000))
    rows = _parts(dealt, at, most)
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(meet, "u long, v long").filter("u <> v").distinct()


_FREE, _LEVELS = 33, 2


def _parts(dealt: DataFrame, at: int, most: int) -> DataFrame:
    """(key, part, home, node, f0): the rows of each anchor, in parts where they are more than `at`."""
    free = F.when(F.shiftright("key", 32) == 0, F.shiftrightunsigned("f0", 31)).otherwise(F.col("f0").bitwiseAND(F.lit((1 << 32) - 1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned("f0", 63), 32)))
    rows, done = dealt.withColumns({"free": free, "part": F.lit(0).cast("long"), "left": F.lit(_FREE)}), []
    for _ in range(_LEVELS):
        crowded = F.broadcast(materialise(rows.groupBy("key", "part").agg(F.count("*").alias("m")).filter(F.col("m") > at).select("key", "part"), "crowded"))  # 40,000 at most
        done.append(rows.join(crowded, ["key", "part"], "left_anti"))
        rows = rows.join(crowded, ["key", "part"], "left_semi").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(most)))).select(
            "key", "home", "node", "f0", *_split("free", "left", F.col("run"), most + 1), F.xxhash64("part", "run", _run("free", "left", F.col("run"), most + 1)).alias("part")
        )
    for more in done:
        rows = rows.unionByName(more)
    return rows.select("key", "part", "home", "node", "f0")


def _edges(left: str, run: Column, n: int) -> tuple[Column, Column]:
    """Where the run-th of n runs of the `left` lowest bits begins and ends."""
    return F.floor(F.col(left) * run / n), F.floor(F.col(left) * (run + 1) / n)


def _shift(name: str, x: Column | str, by: Column) -> Column:
    return F.call_function(name, F.col(x) if isinstance(x, str) else x, by.cast("int"))


def _ones(n: Column) -> Column:
    return _shift("shiftleft", F.lit(1).cast("long"), n) - 1


def _run(bits: str, left: str, run: Column, n: int) -> Column:
    low, high = _edges(left, run, n)
    return _shift("shiftrightunsigned", bits, low).bitwiseAND(_ones(high - low))


def _split(bits: str, left: str, run: Column, n: int) -> list[Column]:
    """The bits without the run, and how many they are."""
    low, high = _edges(left, run, n)
    rest = F.col(bits).bitwiseAND(_ones(low)).bitwiseOR(_shift("shiftleft", _shift("shiftrightunsigned", bits, high), low))
    return [rest.alias(bits), (F.col(left) - (high - low)).cast("int").alias(left)]


def _grouped(prints: DataFrame, same: list[str], links: Callable[[DataFrame], DataFrame], node: str = "least") -> DataFrame:
    """prints (id and fingerprints per document) with component_id, the smallest id reachable.

    links gives (u, v) edges between nodes, of a table of node, fingerprints and n. A node is the
    smallest id of its fingerprint (`least`), or the fingerprint itself, if node names it.
    """
    with clearing():
        prints = kept(materialise(prints.select("id", *same), "prints"))
        stats = prints.groupBy(*same).agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.col(node))
        stats = materialise(stats, "distinct")
        edges = materialise(links(stats), "links")
        parts = materialise(connected_components(edges), "parts").withColumnRenamed("id", "node")
        smallest = parts.join(stats.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
        known = stats.join(parts.join(smallest, "component"), "node", "left").select(
            F.struct(*same).alias("__print"), F.coalesce("smallest", "least").alias("component_id"), "n"
        )
        known = kept(materialise(known, "classes"))
    rows = prints.withColumn("__print", F.struct(*same))
    hot, cold = split_hot(rows, known, "__print", "n", prints.count())
    columns = ["id", *same, "component_id"]
    return hot.select(*columns).union(cold.select(*columns))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3, seed: int = 42) -> DataFrame:
    """(id, f0, component_id) per document: groups of fingerprints linked at `most` <= 3 bits.

    Exact: every pair of fingerprints within `most` bits is linked. Ids are integers; of a row with
    a null id the component is that of its fingerprint (null if no id is known). Documents without
    words all have fingerprint zero and are one group. Repeated rows are kept. What links are
    fingerprints: an id on unlike texts is in the group of each, and joins neither to the other.
    """
    if most > 3:
        raise ValueError("two blocks of a 64-bit fingerprint cover three differing bits")
    prints = fingerprints(docs, id_col, text_col, width, seed)
    return _grouped(prints, ["f0"], lambda stats: linked(stats.filter("least is not null"), most), "f0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) per document: groups of texts whose width-word shingles are alike.

    Two texts link if the Jaccard similarity of their sets of shingles, told apart by 64 bits, is
    at least `similarity`; every such pair is found (see shingle_join) and none other. Texts without
    words have equal sets and are one group; so are repeated rows. A null id is no node: its row has
    the component of its set, null if no other row has that set.
    """
    with clearing():
        bits = sj.table_bits(docs, text_col)
        prints = kept(materialise(sj.set_prints(docs, bits, id_col, text_col, width), "set-prints"))
        levels = sj.rarity(prints, bits)
    nodes = lambda stats: stats.filter("least is not null").select("node", "f0", "f1")
    found = _grouped(prints.filter("slots is null"), ["f0", "f1"], lambda stats: sj.jaccard_links(docs, nodes(stats), levels, bits, similarity, id_col, text_col, width, vote, lambda prints: linked(prints, 3)))
    return found.select("id", "component_id")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id"
    )
