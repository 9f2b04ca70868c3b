"""Exact removal of repeated passages by compaction of a De Bruijn graph of word k-mers.

Every k consecutive words of a document (k = 13) are an edge between the (k-1)-mers at its ends.
An edge is repeated if its words start in more than one document; its source is the place of its
first start (smallest document id). The graph of repeated edges is kept run by run, not edge by edge:

1. each chunk of documents offers 32-bit residues of its edges per bucket; a bucket answers with
   one bit for each, set where the residue came up in two documents (all repeated edges and a few
   in ten thousand others);
2. edges with that bit are sent under 96 bits of hash with their first place in the chunk; a bucket
   answers with the source of every edge whose source lies in an earlier document;
3. runs of edges whose sources follow each other are walks along one source. Where a walk passes on
   to another source, a (k-1)-mer has a second successor or predecessor: it branches, and its place
   in either source is a cut. Distinct walks join the cuts of their source, which leaves paths
   without a branch inside, each known by source coordinates and length;
4. the sources' chunks digest the words of each path, once however many documents repeat it, and the
   digests join the walks;
5. a document's words go where its own words have the digest of the source's. So no word goes by
   hash of a window alone.

An edge leaves a chunk once, however often it occurs there, so a passage that very many documents
share costs each bucket one entry a chunk. Documents are dealt once, to a table in buckets of chunks that every pass reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from graphspan.llm import textarrays as ta
from graphspan.llm.chunks import CHUNK, dealt, emit, growth, in_order, restored, with_fields
from graphspan.operators.skew import split_hot
from graphspan.session import bucketed, materialise

_MASK = np.uint64(0xFFFFFFFF)
_SALT = 0x5851F42D4C957F2D

SPAN = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("source_start", T.LongType()),
    ]
)


class _Edges:
    """The k-mers of one chunk: first word of each, its document, its 64 and 32 bits of hash."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, k: int, wide: bool = True, hashed: bool = True):
        self.data, self.bounds = ta.text_bytes(table[text_col])
        self.starts, self.ends, self.first = ta.words(self.data, self.bounds)
        if not hashed:
            return
        ids = table[id_col].combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        hashes = ta.word_hashes(self.data, self.starts, self.ends)
        n = max(0, len(doc) - k + 1)
        self.word = np.flatnonzero((doc[:n] == doc[k - 1 :]) & known[doc[:n]]) if n else np.zeros(0, np.int64)
        self.doc = doc[self.word]
        self.h1 = ta.window_hashes(hashes, k)[self.word]
        self.h2 = (ta.window_hashes(hashes, k, _SALT)[self.word] & _MASK) if wide else None

    def keys(self, buckets: int) -> np.ndarray:
        """Bucket in the upper, residue in the lower 32 bits."""
        return ((((self.h1 >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32)) | (self.h1 & _MASK)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """An order that puts equal edges together, first place first; where each group begins."""
        return _equal(self.h1, self.h2, ())


def _equal(h1: np.ndarray, h2: np.ndarray, ties: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((*ties, h2, h1))
    a, b = h1[order], h2[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(fresh)


def _cuts(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True))


def _residues(table: pa.Table, id_col: str, text_col: str, k: int, buckets: int) -> pa.Table:
    table = in_order(table, id_col, text_col)
    edges = _Edges(table, id_col, text_col, k, wide=False)
    keys = edges.keys(buckets)
    order = np.argsort(keys)
    keys, ids = keys[order], edges.ids[edges.doc[order]]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at) if len(at) else np.zeros(0, bool)
    keys = keys[at]
    cuts = _cuts(keys)
    return pa.table(
        {
            "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
            "chunk": pa.array([table[CHUNK][0].as_py()] * len(cuts), pa.int32()),
            "residues": pa.array([ta.pack_rising(keys[i:j] & _MASK) for _, i, j in cuts], pa.binary()),
            "several": pa.array([np.packbits(several[i:j]).tobytes() for _, i, j in cuts], pa.binary()),
        }
    )


def _repeated_bits(table: pa.Table) -> pa.Table:
    lists = [ta.unpack_rising(x.as_py()) for x in table["residues"]]
    several = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(r)).astype(bool) for x, r in zip(table["several"], lists, strict=True)]
    every = np.sort(np.concatenate([*lists, *(r[s] for r, s in zip(lists, several, strict=True))]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    bits = []
    for r in lists:
        at = np.minimum(np.searchsorted(twice, r), max(0, len(twice) - 1))
        bits.append(np.packbits(twice[at] == r if len(twice) else np.zeros(len(r), bool)).tobytes())
    return pa.table({CHUNK: table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})


def _candidates(table: pa.Table, answers: pa.Table, id_col: str, text_col: str, k: int, buckets: int) -> pa.Table:
    bits = dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True))
    if not len(table) or not bits:
        return _ENTRIES.empty_table()
    table = in_order(table, id_col, text_col)
    edges = _Edges(table, id_col, text_col, k)
    keys = edges.keys(buckets)
    distinct, inverse = np.unique(keys, return_inverse=True)
    flags = np.concatenate([np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i) for b, i, j in _cuts(distinct)]).astype(bool)
    keep = np.flatnonzero(flags[inverse])
    order, at = _equal(edges.h1[keep], edges.h2[keep], ())
    first = np.sort(keep[order[at]])  # a group's first place; in place order
    first = first[np.argsort(keys[first] >> np.uint64(32), kind="stable")]
    cuts = _cuts(keys[first])
    doc, word = edges.doc[first], edges.word[first]
    begin = edges.first[doc]
    cut = lambda x, kind: pa.array([np.ascontiguousarray(x[i:j]).astype(kind).tobytes() for _, i, j in cuts], pa.binary())
    return pa.table(
        {
            "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
            "chunk": pa.array([table[CHUNK][0].as_py()] * len(cuts), pa.int32()),
            "h1": cut(edges.h1[first], "<u8"),
            "h2": cut(edges.h2[first], "<u4"),
            "ids": cut(edges.ids[doc], "<i8"),
            "begin": cut(begin, "<i8"),
            "word": pa.array([ta.pack_rising(word[i:j]) for _, i, j in cuts], pa.binary()),
        },
        _ENTRIES,
    )


_ENTRIES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *((x, pa.binary()) for x in ("h1", "h2", "ids", "begin", "word"))])


def _sources(table: pa.Table) -> pa.Table:
    whole = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    h1, h2, ids = whole("h1", "<u8"), whole("h2", "<u4"), whole("ids", "<i8")
    words = [ta.unpack_rising(x.as_py()).astype(np.int64) for x in table["word"]]
    place, chunk = np.concatenate(words), np.repeat(table["chunk"].to_numpy().astype(np.int32), [len(w) for w in words])
    order, at = _equal(h1, h2, (chunk, place - whole("begin", "<i8"), ids))
    source = np.empty(len(h1), np.int64)
    source[order] = np.repeat(order[at], np.diff(np.r_[at, len(order)]))
    out, i = [], 0
    for own_chunk, w in zip(table["chunk"].to_pylist(), words, strict=True):
        own = np.arange(i, i + len(w))
        i += len(w)
        hit = ids[source[own]] < ids[own]
        if hit.any():
            s = source[own[hit]]
            out.append((own_chunk, ta.pack_rising(w[hit]), ids[s].tobytes(), chunk[s].tobytes(), place[s].tobytes()))
    return pa.table(
        {
            CHUNK: pa.array([x[0] for x in out], pa.int32()),
            **{n: pa.array([x[c] for x in out], pa.binary()) for c, n in ((1, "word"), (2, "source"), (3, "where"), (4, "place"))},
        }
    )


_WALK = "chunk int, word long, src_chunk int, src_word long, src_id long, edges long"


def _walks(table: pa.Table, answers: pa.Table, id_col: str, text_col: str, k: int) -> pa.Table:
    """The runs of this chunk's removable edges along one source; and, with edges 0, cuts of sources."""
    names = ["chunk", "word", "src_chunk", "src_word", "src_id", "edges"]
    shape = pa.schema(list(zip(names, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)))
    if not len(table):
        return shape.empty_table()
    own_chunk = table[CHUNK][0].as_py()
    edges = _Edges(in_order(table, id_col, text_col), id_col, text_col, k)
    order, at = edges.groups()
    lead = np.repeat(order[at], np.diff(np.r_[at, len(order)]))  # first place in this chunk of each edge
    source_id, place, where = np.empty(len(order), np.int64), np.empty(len(order), np.int64), np.full(len(order), own_chunk, np.int32)
    source_id[order], place[order] = edges.ids[edges.doc[lead]], edges.word[lead]
    if len(answers):
        word = np.concatenate([ta.unpack_rising(x.as_py()) for x in answers["word"]]).astype(np.int64)
        told = np.argsort(word)
        word = word[told]
        first = np.empty(len(order), np.int64)
        first[order] = edges.word[lead]
        hit = np.minimum(np.searchsorted(word, first), len(word) - 1)
        known = word[hit] == first
        for mine, name, kind in ((source_id, "source", np.int64), (where, "where", np.int32), (place, "place", np.int64)):
            mine[known] = np.frombuffer(b"".join(answers[name].to_pylist()), kind)[told][hit[known]]
    gone = np.flatnonzero(source_id < edges.ids[edges.doc])
    word, doc, src, where, place = edges.word[gone], edges.doc[gone], source_id[gone], where[gone], place[gone]
    on = np.zeros(len(gone), bool)  # whether an edge follows the one before it in its document
    on[1:] = (np.diff(word) == 1) & (np.diff(doc) == 0)
    along = np.zeros(len(gone), bool)  # ... and in its source
    along[1:] = on[1:] & (np.diff(place) == 1) & (np.diff(where) == 0)
    at = np.flatnonzero(~along)
    length = np.diff(np.r_[at, len(gone)])
    turn = np.flatnonzero(on & ~along)  # a branch: a cut after the edge before, and one before this edge
    cuts = np.unique(np.stack([np.r_[where[turn - 1], where[turn]].astype(np.int64), np.r_[place[turn - 1] + 1, place[turn]], np.r_[src[turn - 1], src[turn]]], axis=1), axis=0)
    n, m = len(at), len(cuts)
    columns = [np.full(n + m, own_chunk, np.int32), np.r_[word[at], np.zeros(m, np.int64)], np.r_[where[at], cuts[:, 0]].astype(np.int32), np.r_[place[at], cuts[:, 1]], np.r_[src[at], cuts[:, 2]], np.r_[length, np.zeros(m, np.int64)]]
    return pa.Table.from_arrays([pa.array(x) for x in columns], schema=shape)


def _words_of(edges: _Edges, raw: bytes, word: int, count: int) -> bytes:
    return b" ".join(raw[edges.starts[word] : edges.ends[word + count - 1]].split())


def _digests(table: pa.Table, paths: pa.Table, id_col: str, text_col: str, k: int) -> pa.Table:
    """A digest of the words of each path of this chunk, and its first word's place in its document."""
    shape = pa.schema([("src_chunk", pa.int32()), ("at", pa.int64()), ("edges", pa.int64()), ("place", pa.int64()), ("digest", pa.binary())])
    if not len(paths) or not len(table):
        return shape.empty_table()
    edges = _Edges(in_order(table, id_col, text_col), id_col, text_col, k, hashed=False)
    raw, at, n = edges.data.tobytes(), paths["at"].to_numpy(), paths["edges"].to_numpy()
    doc = np.searchsorted(edges.first, at, "right") - 1
    digest = [xxhash.xxh3_128_digest(_words_of(edges, raw, w, m + k - 1)) for w, m in zip(at.tolist(), n.tolist(), strict=True)]
    return pa.Table.from_arrays([paths["src_chunk"].cast(pa.int32()), pa.array(at), pa.array(n), pa.array(at - edges.first[doc]), pa.array(digest, pa.binary())], schema=shape)


def _cleaned(table: pa.Table, told: pa.Table, id_col: str, text_col: str, k: int, schema: T.StructType, with_text: bool) -> pa.Table:
    if not len(table):
        return pa.table({f.name: pa.array([], _arrow(f)) for f in schema.fields})
    table = in_order(table, id_col, text_col)
    edges = _Edges(table, id_col, text_col, k, hashed=False)
    raw = edges.data.tobytes()
    delta = np.zeros(len(edges.starts) + 1, np.int32)
    found: list[tuple[int, int, int, int]] = []
    for start, source, parts in zip(told["word"].to_pylist(), told["src_id"].to_pylist(), told["parts"].to_pylist(), strict=True):
        for x in parts:
            word, count = start + x["offset"], x["edges"] + k - 1
            if xxhash.xxh3_128_digest(_words_of(edges, raw, word, count)) == x["digest"]:
                delta[word] += 1
                delta[word + count] -= 1
                found.append((word, count, source, x["place"]))
    removed = np.cumsum(delta)[:-1] > 0
    upto = np.concatenate(([0], np.cumsum(removed)))
    n_removed = upto[edges.first[1:]] - upto[edges.first[:-1]]
    spans = np.array(sorted(found), np.int64).reshape(-1, 4)
    doc = np.searchsorted(edges.first, spans[:, 0], "right") - 1
    items = pa.StructArray.from_arrays([pa.array(x) for x in (spans[:, 0] - edges.first[doc], spans[:, 1], spans[:, 2], spans[:, 3])], names=[f.name for f in SPAN.fields])
    new = {
        "n_words": pa.array(np.diff(edges.first), pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()),
        "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(table) + 1)), pa.int32()), items),
    }
    if with_text:
        kept = []
        for d, (lo, hi) in enumerate(zip(edges.bounds[:-1].tolist(), edges.bounds[1:].tolist(), strict=True)):
            own = raw[lo:hi].split()
            if n_removed[d]:
                stay = np.flatnonzero(~removed[edges.first[d] : edges.first[d + 1]])
                own = [own[x] for x in stay.tolist()]
            kept.append(b" ".join(own))
        new["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
    return emit(table, schema, new)


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, with_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, spans and (with_text) kept_text.

    A word goes if a window of k words that covers it also starts in a document with a smaller id;
    windows are judged on the input. kept_text joins the other words by one space. spans lists the
    paths removed: start and length in words, source_id and source_start; they overlap by k - 1 words
    where they meet.

    Ids are integers. A null text has no words. A row with a null id keeps its words and is no
    source. Rows of one id are copies neither of each other nor of later ones only: they count as
    one document. Input columns named like an output give way to it; others pass through.
    Edges meet by 96 bits of hash; their words are then compared with the source's by 128 bits.
    """
    rows, _, total = dealt(docs.withColumn(id_col, docs[id_col].cast("long")), id_col, text_col)
    rows = bucketed(rows, [CHUNK], "dealt", "zstd")[0]  # each pass below reads the chunks where they lie
    buckets = max(1, -(-total // int((8 << 20) * min(4, growth(total)))))
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(SPAN)),
        *([T.StructField("kept_text", T.StringType())] if with_text else []),
    ]
    schema = with_fields(rows.schema, fields)
    bits = (
        rows.groupBy(CHUNK)
        .applyInArrow(lambda t: _residues(t, id_col, text_col, k, buckets), "bucket int, chunk int, residues binary, several binary")
        .groupBy("bucket")
        .applyInArrow(_repeated_bits, f"{CHUNK} int, bucket int, bits binary")
    )
    places = (
        rows.groupBy(CHUNK)
        .cogroup(bits.groupBy(CHUNK))
        .applyInArrow(lambda a, b: _candidates(a, b, id_col, text_col, k, buckets), "bucket int, chunk int, h1 binary, h2 binary, ids binary, begin binary, word binary")
        .groupBy("bucket")
        .applyInArrow(_sources, f"{CHUNK} int, word binary, source binary, where binary, place binary")
    )
    walks = rows.groupBy(CHUNK).cogroup(places.groupBy(CHUNK)).applyInArrow(lambda a, b: _walks(a, b, id_col, text_col, k), _WALK)
    told = _compacted(rows, walks, total, id_col, text_col, k)
    return restored(rows.groupBy(CHUNK).cogroup(told.groupBy("chunk")).applyInArrow(lambda a, b: _cleaned(a, b, id_col, text_col, k, schema, with_text), schema))


def _compacted(rows: DataFrame, walks: DataFrame, total: int, id_col: str, text_col: str, k: int) -> DataFrame:
    """(chunk, word, src_id, parts): each walk as its paths, with their digests from the source.

    Walks of equal coordinates are one until the end, so that a source with many copies is joined
    with its cuts once; the walks of a hot one are then met by broadcast.
    """
    walks = materialise(walks, "walks")
    coordinates = ["src_chunk", "src_word", "edges"]
    kinds = walks.filter("edges > 0").groupBy(*coordinates).agg(F.count("*").alias("n"))
    cuts = walks.filter("edges = 0").select("src_chunk", F.col("src_word").alias("cut")).distinct()
    inside = (kinds["src_chunk"] == cuts["src_chunk"]) & (cuts["cut"] > kinds["src_word"]) & (cuts["cut"] < kinds["src_word"] + kinds["edges"])
    begins = F.array_sort(F.concat(F.array("src_word"), F.collect_set("cut")))
    walk = kinds.join(cuts, inside, "left").select(kinds["*"], "cut").groupBy(*coordinates, "n").agg(begins.alias("begins"))
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.col("src_word") + F.col("edges")))
    pieces = walk.select(*coordinates, "n", F.explode(F.arrays_zip(F.col("begins").alias("a"), ends.alias("b"))).alias("p"))
    pieces = materialise(pieces.select(*coordinates, "n", F.col("p.a").alias("at"), (F.col("p.b") - F.col("p.a")).alias("m")), "pieces")
    paths = pieces.select("src_chunk", "at", F.col("m").alias("edges")).distinct()
    shape = "src_chunk int, at long, edges long, place long, digest binary"
    digests = rows.groupBy(CHUNK).cogroup(paths.groupBy("src_chunk")).applyInArrow(lambda a, b: _digests(a, b, id_col, text_col, k), shape)
    met = pieces.join(digests.withColumnRenamed("edges", "m"), ["src_chunk", "at", "m"])
    part = F.struct((F.col("at") - F.col("src_word")).alias("offset"), F.col("m").alias("edges"), "place", "digest")
    known = met.groupBy(*coordinates, "n").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    known = materialise(known.select(F.struct(*coordinates).alias("walk"), "n", "parts"), "paths")
    left = walks.filter("edges > 0").select("chunk", "word", "src_id", F.struct(*coordinates).alias("walk"))
    hot, cold = split_hot(left, known, "walk", "n", max(1, total >> 10))
    return hot.select("chunk", "word", "src_id", "parts").union(cold.select("chunk", "word", "src_id", "parts"))


def repeated_paths(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(source_id, source_start, length, n_docs, n_places): each path that was removed, where it
    stands in its source and how many documents and places repeat it."""
    spans = cleaned.select(F.col(id_col), F.explode("spans").alias("s")).select(id_col, "s.*")
    return spans.groupBy("source_id", "source_start", "length").agg(F.countDistinct(id_col).alias("n_docs"), F.count("*").alias("n_places"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
