"""Language-model scores of whole documents: a unigram base and a gated recurrent network.

Counts of every token of every training document are grouped by word: chunks of documents offer
their distinct word hashes per bucket, a bucket adds the counts up over all chunks and answers each
with the corpus count of its words. So no task holds the vocabulary, which grows with the corpus.
The network's vocabulary, classes and biases come from the same counts. Its weights are trained by
rounds of local passes over groups of documents whose weights are averaged. Each round has chunks of
its own and together they have all, so that every training document is learned from once. Then every
document is scored from its first token to its end token with the state carried on.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from graphspan.llm import gated_lm as lm, textarrays as ta
from graphspan.llm.chunks import CHUNK, COPIES, dealt, emit, growth, in_order, restored, with_fields
from graphspan.llm.language_id import fold
from graphspan.session import materialise

END = np.uint64(0x1D8E4E27C47D124F)  # the end token's hash
HELD, PART = "__gs_held", "__gs_part"


class _Tokens:
    """The tokens of a chunk: hash, document, and the first token of each document."""

    def __init__(self, table: pa.Table, text_col: str):
        data, bounds = ta.text_bytes(table[text_col])
        data = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
        starts, ends, first = ta.words(data, bounds)
        n = len(table)
        self.first = first + np.arange(n + 1)
        self.hash = np.full(len(starts) + n, END, np.uint64)
        body = np.ones(len(self.hash), bool)
        body[self.first[1:] - 1] = False
        self.hash[body] = ta.word_hashes(data, starts, ends)
        held = table[HELD].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        self.held = held
        self.copies = table[COPIES].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct, self.word = np.unique(self.hash, return_inverse=True)
        each = np.repeat(np.where(held, 0, self.copies), np.diff(self.first))
        self.learned = np.bincount(self.word, each, len(self.distinct)).astype(np.int64)

    def cuts(self, buckets: int) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of the distinct hashes, which are sorted and so are their buckets."""
        bucket = (((self.distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True))


def _offers(table: pa.Table, id_col: str, text_col: str, buckets: int) -> pa.Table:
    tokens = _Tokens(in_order(table, id_col, text_col), text_col)
    cuts = tokens.cuts(buckets)
    return pa.table(
        {
            "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
            "chunk": pa.array([table[CHUNK][0].as_py()] * len(cuts), pa.int32()),
            "words": pa.array([ta.pack_rising(tokens.distinct[i:j]) for _, i, j in cuts], pa.binary()),
            "counts": pa.array([tokens.learned[i:j].astype("<i8").tobytes() for _, i, j in cuts], pa.binary()),
        }
    )


_ANSWER = f"{CHUNK} int, bucket int, counts binary, tokens long, types long, top_words array<long>, top_counts array<long>, band_types array<long>, band_tokens array<long>"


def _totals(table: pa.Table, top: int) -> pa.Table:
    words = [ta.unpack_rising(x.as_py()) for x in table["words"]]
    counts = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table["counts"]])
    distinct, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, counts, len(distinct)).astype(np.int64)
    known = total[total > 0]
    band = np.frexp(known.astype(np.float64))[1] - 1
    most = np.lexsort((distinct, -total))[:top]
    most = most[total[most] > 0]
    n, answers, i = len(words), [], 0
    for w in words:
        answers.append(total[at[i : i + len(w)]].astype("<i8").tobytes())
        i += len(w)
    once = lambda x, kind: pa.array([x, *[None] * (n - 1)], kind)
    many = pa.list_(pa.int64())
    return pa.table(
        {
            CHUNK: table["chunk"], "bucket": table["bucket"], "counts": pa.array(answers, pa.binary()),
            "tokens": once(int(known.sum()), pa.int64()), "types": once(len(known), pa.int64()),
            "top_words": once(distinct[most].view(np.int64).tolist(), many), "top_counts": once(total[most].tolist(), many),
            "band_types": once(np.bincount(band, minlength=lm.BANDS).tolist(), many),
            "band_tokens": once(np.bincount(band, known, lm.BANDS).astype(np.int64).tolist(), many),
        }
    )


def _vocabulary(answers: DataFrame, top: int) -> lm.Vocabulary:
    """From the buckets' sums: a few numbers and the `top` most frequent words reach the driver."""
    told = answers.filter("tokens is not null")
    sums = [F.sum(F.element_at(c, i + 1)).alias(f"{c}{i}") for c in ("band_types", "band_tokens") for i in range(lm.BANDS)]
    row = told.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), *sums).first()
    best = told.select(F.explode(F.arrays_zip("top_words", "top_counts")).alias("x")).select("x.top_words", "x.top_counts")
    words = [(r[0] % (1 << 64), r[1]) for r in best.orderBy(F.desc("top_counts"), "top_words").limit(top).collect()]
    bands = [np.array([row[f"{c}{i}"] or 0 for i in range(lm.BANDS)]) for c in ("band_types", "band_tokens")]
    return lm.Vocabulary(words, *bands, row["n"] or 0, row["v"] or 0)


def _counted(tokens: _Tokens, answers: pa.Table) -> np.ndarray:
    """Corpus count of every token of a chunk."""
    parts = dict(zip(answers["bucket"].to_pylist(), answers["counts"].to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(parts[b], "<i8") for b in sorted(parts)])[tokens.word]


def _summed(parts: DataFrame, n: int, fan_in: int = 64) -> DataFrame:
    """Sums of parts numbered below n, `fan_in` rows of weights a group at a time, until one group is left."""
    shape = pa.schema([(PART, pa.int32()), ("tokens", pa.int64()), ("weights", pa.binary())])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["weights"][0].as_py()) // 4)
        for x in table["weights"]:
            total += np.frombuffer(x.as_py(), "<f4")
        return pa.table({PART: [table[PART][0].as_py()], "tokens": [sum(table["tokens"].to_pylist())], "weights": [total.astype("<f4").tobytes()]}, shape)

    while n > 1:
        n = -(-n // fan_in)
        parts = parts.withColumn(PART, F.pmod(PART, F.lit(n)).cast("int")).groupBy(PART).applyInArrow(added, f"{PART} int, tokens long, weights binary")
    return parts


def _fit(
    rows: DataFrame, answers: DataFrame, vocabulary: lm.Vocabulary, embed: int, hidden: int, rounds: int, chunks: int, seed: int, id_col: str, text_col: str
) -> dict[str, np.ndarray]:
    """Rounds of local passes, each over chunks of its own and together over all, from the mean of the last round's weights."""
    weights = lm.fresh(vocabulary, embed, hidden, seed)
    session = rows.sparkSession
    known = session.sparkContext.broadcast(vocabulary)
    for number in range(rounds):
        start, stop = number * chunks // rounds, (number + 1) * chunks // rounds
        if start == stop:
            continue
        now = session.sparkContext.broadcast(weights)

        def local(table: pa.Table, told: pa.Table) -> pa.Table:
            shape = pa.schema([(PART, pa.int32()), ("tokens", pa.int64()), ("weights", pa.binary())])
            if not len(table) or not len(told):
                return shape.empty_table()
            part = table[CHUNK][0].as_py() - start
            tokens = _Tokens(in_order(table, id_col, text_col), text_col)
            use = np.flatnonzero(~tokens.held)
            if not len(use):
                return shape.empty_table()
            counts = _counted(tokens, told)
            inputs, group, _ = known.value.find(tokens.hash, counts)
            unseen = (counts == 1) & (tokens.hash & np.uint64(1)).astype(bool)
            sizes = np.diff(tokens.first)[use]
            keep = np.repeat(tokens.first[:-1][use], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            times = np.repeat(tokens.copies[use], sizes)
            own = lm.train(now.value, known.value, inputs[keep], group[keep], np.concatenate(([0], np.cumsum(sizes))), seed + number, unseen=unseen[keep], mass=times)
            mass = int(times.sum())
            return pa.table({PART: pa.array([part], pa.int32()), "tokens": [mass], "weights": [(lm.flat(own).astype(np.float64) * mass).astype("<f4").tobytes()]}, shape)

        within = (F.col(CHUNK) >= start) & (F.col(CHUNK) < stop)
        sample = rows.filter(within).select(CHUNK, COPIES, id_col, text_col, HELD)
        made = sample.groupBy(CHUNK).cogroup(answers.filter(within).groupBy(CHUNK)).applyInArrow(local, f"{PART} int, tokens long, weights binary")
        for sums in _summed(made, stop - start).collect():  # one row at most
            weights = lm.shaped(np.frombuffer(sums["weights"], "<f4") / sums["tokens"], weights)
        now.unpersist()
    return weights


def lm_scores(
    docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", top: int = 1024, embed: int = 12, hidden: int = 16,
    rounds: int = 3, seed: int = 7, chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """docs with held_out, n_tokens, n_known, train_tokens, base_score and score.

    held_out (a condition; none: nothing) marks documents that are scored but not learned from.
    base_score is the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))) with the token's
    count c, all counts N and distinct tokens V of the training documents; score is the network's
    log10 probability of the text. Gradients are taken on every training document, once each, in
    `rounds` rounds over disjoint documents.

    A null text is empty: its only token is the end. Rows that are equal count each, are learned
    from each (as one document that weighs as many) and are scored each; so is a row with a null id,
    which no fold holds out. Among equally frequent words those of smaller hash are in the
    vocabulary. Input columns named like an output give way, others pass through; ids are integers.
    No documents give no rows.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows, chunks, size = dealt(docs.withColumn(HELD, held), id_col, text_col, chunk_bytes)
    buckets = max(1, -(-size // int((16 << 20) * min(4, growth(size)))))
    offers = rows.select(CHUNK, COPIES, id_col, text_col, HELD).groupBy(CHUNK).applyInArrow(lambda t: _offers(t, id_col, text_col, buckets), "bucket int, chunk int, words binary, counts binary")
    answers = materialise(offers.groupBy("bucket").applyInArrow(lambda t: _totals(t, top), _ANSWER), "word-counts")
    vocabulary = _vocabulary(answers, top)
    counts = answers.select(CHUNK, "bucket", "counts")

    weights = _fit(rows, counts, vocabulary, embed, hidden, rounds, chunks, seed, id_col, text_col)

    base = math.log10(vocabulary.total + 0.1 * (vocabulary.distinct + 1))
    fields = [T.StructField(n, k) for n, k in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))]
    schema = with_fields(rows.drop(HELD).schema, fields)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def scored(table: pa.Table, told: pa.Table) -> pa.Table:
        known, w = shared.value
        if not len(table):
            return pa.table({f.name: pa.array([], _kind(f)) for f in schema.fields})
        table = in_order(table, id_col, text_col)
        tokens = _Tokens(table, text_col)
        count = _counted(tokens, told)
        first = tokens.first
        sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every document has its end token
        inputs, group, share = known.find(tokens.hash, count)
        n = np.diff(first)
        new = {
            "held_out": pa.array(tokens.held), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(sums((count > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(n), known.total, np.int64)), "base_score": pa.array(sums(np.log10(count + 0.1)) - n * base),
            "score": pa.array(lm.score(w, inputs, group, first) + sums(share)),
        }
        return emit(table, schema, new)

    return restored(rows.groupBy(CHUNK).cogroup(counts.groupBy(CHUNK)).applyInArrow(scored, schema))


def _kind(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = lm_scores(docs, fold("doc_id", 10) == 0)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
