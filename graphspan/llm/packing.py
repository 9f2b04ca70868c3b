"""Variable-capacity best-fit packing of documents into training sequences.

Texts are encoded once; their lengths are dealt into shards of bounded size, and each shard is
packed on its own. The longest piece left opens a bin. For every permitted size that holds it, the
bin is filled best fit first (always the longest piece left that still fits), and the size that
costs least for each token it holds is opened. At the end a bin shrinks to the smallest permitted
size that holds its contents. Pieces of equal length are alike to the packer, so a fill is a walk
over lengths. Sequences are then assembled from the pieces of the encoded texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphspan.llm.chunks import COPIES, restored
from graphspan.llm.token_counts import vocabulary
from graphspan.llm.training_order import Ids
from graphspan.session import materialise

KEY = "__gs_row"


def encoded(docs: DataFrame, ranks_path: str | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, tokens), written once: every text's ids and an end id, in a vocabulary or as bytes.

    row is unique, also among repeated rows. So that every document has a length, a null or empty
    text is an end id alone.
    """
    ids = docs.sparkSession.sparkContext.broadcast(Ids(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, row = ids.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                flat = known.encode(part.column(1))
                ends = (np.flatnonzero(flat == known.end) + 1) * known.kind.itemsize
                offsets = pa.py_buffer(np.concatenate(([0], ends)).astype("<i8"))
                tokens = pa.Array.from_buffers(pa.large_binary(), len(part), [None, offsets, pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(part))), part.column(0), tokens], names=["row", "id", "tokens"])
                row += len(part)

    return materialise(docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "row long, id long, tokens binary"), "encoded", "zstd")


def lengths_of(texts: DataFrame, ranks_path: str | None) -> DataFrame:
    """(row, id, length) of encoded()."""
    return texts.select("row", "id", F.floor(F.octet_length("tokens") / Ids(ranks_path).kind.itemsize).alias("length"))


def plan(lengths: list[int], capacities: list[int], costs: list[float]) -> list[tuple[int, int, list[int]]]:
    """(capacity, used, indices of lengths in place order) of each bin; no length exceeds the largest."""
    waiting: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(lengths[i], []).append(i)
    left = {n: len(x) for n, x in waiting.items()}
    mask = 0
    for n in left:
        mask |= 1 << n
    sizes = sorted(zip(capacities, costs, strict=True))
    bins = []
    while mask:
        longest = mask.bit_length() - 1
        best = None
        for capacity, cost in sizes:
            if capacity < longest:
                continue
            fill, room, open_, taken = [], capacity, mask, {}
            while room and (fits := open_ & ((2 << room) - 1)):
                n = fits.bit_length() - 1
                fill.append(n)
                room -= n
                taken[n] = taken.get(n, 0) + 1
                if taken[n] == left[n]:
                    open_ ^= 1 << n
            used = capacity - room
            price = next(c for size, c in sizes if size >= used) / used
            if best is None or price < best[0]:
                best = (price, used, fill)
        _, used, fill = best
        for n in fill:
            left[n] -= 1
            if not left[n]:
                mask ^= 1 << n
        bins.append((next(size for size, _ in sizes if size >= used), used, [waiting[n].pop() for n in fill]))
    return bins


def pack(
    lengths: DataFrame, capacities: tuple[int, ...] = (512, 1024, 2048, 4096), costs: tuple[float, ...] | None = None,
    id_col: str = "id", length_col: str = "length", key_col: str | None = None, shard_pieces: int = 20_000,
) -> DataFrame:
    """Pieces with their bins: id, piece, start, length, bin_id, bin_offset, capacity, used.

    A document longer than the largest capacity is cut into pieces of that size and a rest; no token
    is dropped. Lengths that are null or under 1 take no place and give no row. costs defaults to
    the capacities, that is to counting padding; of sizes that cost the same the smaller is opened,
    and of pieces of one length any may come first. Repeated ids are packed like any other rows (rows
    alike in id and length are counted first, so that they spread over the shards); a null id stays
    null. Other columns are not read. bin_id is unique over all shards. key_col names a column that
    tells rows apart; it is then returned, too, as `key`.
    """
    largest = max(capacities)
    prices = list(costs or map(float, capacities))
    key = F.col(key_col).cast("long") if key_col else F.lit(None).cast("long")
    sound = lengths.select(F.col(id_col).cast("long").alias("id"), F.col(length_col).cast("long").alias("n"), key.alias("key")).filter("n >= 1")
    alike = sound.withColumn(KEY, F.lit(0).cast("long")) if key_col else restored(sound.groupBy("id", "n", "key").agg(F.count("*").alias(COPIES)), number=KEY)
    pieces = alike.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("int"), ((F.col("n") - 1) / largest).cast("int"))))
    start = F.col("piece").cast("long") * largest
    pieces = pieces.select("id", "key", KEY, "piece", start.alias("start"), F.least(F.lit(largest), F.col("n") - start).cast("int").alias("length"))
    count = sound.agg(F.sum(F.ceil(F.col("n") / largest))).first()[0] or 0
    shards = max(1, -(-count // shard_pieces))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("key", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        length = table["length"].to_pylist()
        shard = table["shard"][0].as_py()
        order, bin_id, offset, capacity, used = [], [], [], [], []
        for number, (size, full, own) in enumerate(plan(length, list(capacities), prices)):
            at = 0
            for i in own:
                order.append(i)
                bin_id.append(shard << 32 | number)
                offset.append(at)
                capacity.append(size)
                used.append(full)
                at += length[i]
        out = table.select(["id", "piece", "start", "length", *(["key"] if key_col else [])]).take(pa.array(order, pa.int64()))
        more = {"bin_id": (bin_id, pa.int64()), "bin_offset": (offset, pa.int32()), "capacity": (capacity, pa.int32()), "used": (used, pa.int32())}
        for name, (values, kind) in more.items():
            out = out.append_column(name, pa.array(values, kind))
        return out.select(names)

    shape = "id long, piece int, start long, length int, bin_id long, bin_offset int, capacity int, used int" + (", key long" if key_col else "")
    names = [x.split()[0] for x in shape.split(", ")]
    shard = F.pmod(F.xxhash64("id", "key", KEY, "piece", "length"), F.lit(shards)).cast("int")
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(run, shape)


def assembled(pieces: DataFrame, texts: DataFrame, ranks_path: str | None) -> DataFrame:
    """(bin_id, capacity, used, ids, tokens): the sequences, padded to their capacity, and whose
    pieces they hold, in order. pieces are pack()'s with key_col="row", texts encoded()'s.

    A text is cut into its pieces where it lies, and only pieces move, so that a text of any length
    costs what its bytes cost.
    """
    ids = Ids(ranks_path)
    width, pad = ids.kind.itemsize, ids.pad.to_bytes(ids.kind.itemsize, "little").hex()
    largest = pieces.filter("piece = 1").agg(F.max("start")).first()[0]  # null: every text is one piece
    step = largest * width if largest else (1 << 31) - 1
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.octet_length("tokens") / step)).cast("int") - 1)
    parts = F.transform(numbers, lambda i: F.substring("tokens", i * step + 1, F.lit(step)))
    own = texts.filter("tokens is not null").select(F.col("row").alias("key"), F.posexplode(parts).alias("piece", "tokens"))
    cut = pieces.join(own, ["key", "piece"])
    bins = cut.groupBy("bin_id", "capacity", "used").agg(F.array_sort(F.collect_list(F.struct("bin_offset", "id", "tokens"))).alias("parts"))
    whole = F.reduce(F.col("parts"), F.lit(b""), lambda so_far, x: F.concat(so_far, x["tokens"]))
    return bins.select("bin_id", "capacity", "used", F.col("parts.id").alias("ids"), whole.alias("tokens")).withColumn("tokens", F.expr(f"rpad(tokens, capacity * {width}, X'{pad}')"))


def op3(spark, sf_dir: str) -> DataFrame:
    ranks = vocabulary(spark)
    texts = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks)
    pieces = materialise(pack(lengths_of(texts, ranks), id_col="id", key_col="row"), "pieces")
    out = assembled(pieces, texts, ranks)
    return out.select("bin_id", "capacity", "used", F.size("ids").alias("n_pieces"), F.col("ids").alias("doc_ids"), F.crc32("tokens").alias("tokens_crc32"))
