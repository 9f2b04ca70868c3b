"""Token counts for every context limit from one exact length histogram.

Documents are grouped by encoded length. Sums from the longest length down then answer, for each
limit, how many documents exceed it, how many tokens stay and how many are cut; sums from the
shortest up give quantiles. They are taken within blocks of lengths and over the blocks' totals, so
that no task sees the whole histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphspan.session import materialise

BLOCK = 512
#: the setting that names the queries' vocabulary file, and its folder and name if it is unset
SETTING, FOLDER, NAME = "spark.graphspan.vocabulary", "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: fixed value: how the vocabulary above splits text before byte pairs are merged
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[int, object] = {}


def vocabulary(spark: SparkSession) -> str:
    """The vocabulary file of the queries."""
    return spark.conf.get(SETTING, None) or f"{FOLDER}/{NAME}"


def encoded_lengths(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, length): tokens of the whole text in a byte-level BPE vocabulary, special tokens as text.

    The driver reads the vocabulary (a few MB at most) and broadcasts it. A null or empty text has no
    tokens. Repeated rows and null ids are rows like others; other columns are not read.
    """
    with open(ranks_path, "rb") as f:
        raw = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode_ordinary
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                n = [len(encode(t)) if t else 0 for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["id", "length"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, length long")


def encoder(raw: bytes):
    """The vocabulary's encoder, made once a worker."""
    import tiktoken

    if hash(raw) not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encoders[hash(raw)] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[hash(raw)]


def length_histogram(lengths: DataFrame, length_col: str = "length") -> DataFrame:
    """(length, n_docs) of lengths that are not null."""
    return lengths.filter(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """What each context limit costs, one row for each length that occurs.

    context_limit, n_docs (of this length), n_upto, n_longer, tokens_total, tokens_kept (every
    document cut to the limit), tokens_cut, quantile (share of documents of at most this length).
    Documents of equal length are one row. Any other limit is answered by at_limit(). Nothing for an empty histogram.
    """
    cells = materialise(histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs")), "lengths")
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum("tokens").alias("bt"))
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t_before"),
        F.sum("bn").over(every).alias("n_all"), F.sum("bt").over(every).alias("tokens_total"),
    )
    upto = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cells.join(blocks, "block").select(
        F.col("length").alias("context_limit"), "n_docs", (F.sum("n_docs").over(upto) + F.col("n_before")).alias("n_upto"),
        (F.sum("tokens").over(upto) + F.col("t_before")).alias("t_upto"), "n_all", "tokens_total",
    )
    kept = F.col("t_upto") + F.col("context_limit") * (F.col("n_all") - F.col("n_upto"))
    return out.select(
        "context_limit", "n_docs", "n_upto", (F.col("n_all") - F.col("n_upto")).alias("n_longer"), "tokens_total", kept.alias("tokens_kept"),
        (F.col("tokens_total") - kept).alias("tokens_cut"), (F.col("n_upto") / F.col("n_all")).alias("quantile"),
    )


def at_limit(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_longer, tokens_kept) for any given limits, straight from the histogram."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "context_limit long")
    rows = histogram.select("*", F.explode(F.array(*(F.lit(x) for x in limits))).alias("context_limit"))
    sums = rows.groupBy("context_limit").agg(
        F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("n_longer"),
        F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("tokens_kept"),
    )
    return asked.join(sums.withColumn("context_limit", F.col("context_limit").cast("long")), "context_limit", "left").fillna(0)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return limit_table(length_histogram(encoded_lengths(docs, vocabulary(spark))))
