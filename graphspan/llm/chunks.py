"""Documents dealt into chunks of bounded size, and table helpers the operators share."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

CHUNK = "__gs_chunk"
COPIES = "__gs_copies"
_HASH = "__gs_hash"


def growth(total: int) -> float:
    """By how much chunks and buckets grow with the bytes of text: as the root beyond 1 GB, up to 8.

    The pieces that chunks send to buckets number chunks times buckets, so both must grow for a
    piece to stay more than a few entries.
    """
    return min(8.0, max(1.0, math.sqrt(total / (1 << 30))))


def dealt(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = 2 << 20) -> tuple[DataFrame, int, int]:
    """docs with a chunk number and COPIES, the number of chunks, and the total bytes of text.

    A chunk is a hash of the whole row, so that no id and no text can crowd one; their number follows
    the bytes of text. Rows equal in every column cannot be told apart by a hash: where there are
    many of them (a million kinds at most, whose hashes are broadcast) they become one row, and
    COPIES says for how many it stands; restored() gives them back. Rows that hold a map cannot be
    compared and stay as they are. What reaches the driver first is three numbers.
    """
    plain = [f.name for f in docs.schema.fields if _comparable(f.dataType)]
    docs = docs.withColumn(_HASH, F.xxhash64(*[docs[c] for c in plain]))
    kinds = docs.groupBy(_HASH).agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("b"))
    size = kinds.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("n").alias("most")).first()
    n, total = size["n"] or 0, size["b"] or 0
    chunks = max(1, math.ceil(total / (chunk_bytes * growth(total))), math.ceil(n / 20_000))
    many = max(64, n // 1_000_000)
    rows = docs.withColumn(COPIES, F.lit(1).cast("long"))
    if (size["most"] or 0) > many and len(plain) + 1 == len(docs.columns):
        hot = F.broadcast(kinds.filter(F.col("n") > many).select(_HASH))
        few = rows.join(hot, _HASH, "left_anti")
        rows = few.unionByName(docs.join(hot, _HASH, "left_semi").groupBy(*docs.columns).agg(F.count("*").alias(COPIES)))
    return rows.withColumn(CHUNK, F.pmod(F.col(_HASH), F.lit(chunks)).cast("int")).drop(_HASH), chunks, total


def _comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def restored(rows: DataFrame, count: str = COPIES, number: str | None = None) -> DataFrame:
    """Every row as many times as its `count` says; numbered from 0 in the column `number` if given."""
    block, own = "__gs_block", number or "__gs_copy"
    last = F.col(count) - 1
    whole = F.shiftright(last, 12)
    out = rows.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), whole)))
    start = F.shiftleft(F.col(block), 12)
    out = out.withColumn(own, F.explode(F.sequence(start, F.least(start + 4095, last))))
    return out.drop(block, count, *([] if number else [own]))


def in_order(table: pa.Table, id_col: str, text_col: str) -> pa.Table:
    """A chunk's rows in the same order at every read: by id, then text; null ids last."""
    return table.sort_by([(id_col, "ascending"), (text_col, "ascending")])


def with_fields(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    """schema plus fields; an input column of the same name (in any case) gives way to the new one."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name != CHUNK and f.name.lower() not in new] + fields)


def emit(table: pa.Table, schema: T.StructType, new: dict[str, pa.Array]) -> pa.Table:
    """The table's columns with the new ones, in the order of schema."""
    return pa.table({f.name: new[f.name] if f.name in new else table[f.name] for f in schema.fields})


def ascii_lower(text: str | Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
