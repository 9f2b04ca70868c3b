"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of the lower-cased letters of every labelled document, per language
and fold, in one grouped sum, and writes a vector of counts for each. The smoothed log-probabilities
of up to `block` languages form a matrix of languages times buckets, which is broadcast: 64 MB at
most, whatever the number of labels. Scoring gathers the rows of a document's n-grams and sums them
in numpy; with more languages than a block holds, texts pass the blocks one after the other and carry
the best language so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from graphspan.llm.chunks import emit, with_fields
from graphspan.session import discard, materialise

UNKNOWN = "und"
_STEP = 1 << 19
_CELLS = 1 << 21  # log-probabilities gathered at once
_HELD = 256  # languages whose counts a task holds before it passes them on
_cache: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point, its lower-case letter, or 0 if it is no letter."""
    if "letters" not in _cache:
        found = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                found[c] = ord(low) if len(low) == 1 else c
        _cache["letters"] = found
    return _cache["letters"]


def _runs(text: str) -> Iterator[np.ndarray]:
    """A text's lower-cased letters, a run of others as one gap (0), with a gap at either end; in blocks."""
    before = 0
    for lo in range(0, len(text), _STEP):
        low = _letters()[np.frombuffer(text[lo : lo + _STEP].encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = low > 0
        keep[1:] |= low[:-1] > 0
        keep[0] |= before > 0
        before = int(low[-1])
        yield np.concatenate((low[:0] if lo else np.zeros(1, low.dtype), low[keep]))
    if before:
        yield np.zeros(1, np.uint32)


def _grams(text: str, bits: int, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of _runs(), each once however long the text is."""
    rest = np.zeros(0, np.uint64)
    for block in _runs(text):
        low = np.concatenate((rest, block.astype(np.uint64)))
        for n in orders:
            own = low[max(0, len(rest) - n + 1) :]  # those that end in this block
            if len(own) < n:
                continue
            h = own[: len(own) - n + 1].copy()
            for i in range(1, n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + own[i : len(own) - n + 1 + i]
            h = (h + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            yield (h >> np.uint64(64 - bits)).astype(np.int64)
        rest = low[max(0, len(low) - max(orders) + 1) :]


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class _Block:
    """Some languages in order of name, and the log-probability of each bucket in each of them."""

    def __init__(self, langs: list[str], prior: np.ndarray, table: np.ndarray, bits: int, orders: tuple[int, ...]):
        self.langs, self.prior, self.table, self.bits, self.orders = langs, prior, table, bits, orders

    def best(self, text: str) -> tuple[str, float, float]:
        """The most probable language, its log-probability, and the sum of all languages' as multiples of its."""
        total, step = self.prior.copy(), max(1, _CELLS // len(self.langs))
        for at in _grams(text, self.bits, self.orders):
            for lo in range(0, len(at), step):
                total += self.table[at[lo : lo + step]].sum(axis=0, dtype=np.float64)
        i = int(np.argmax(total))
        return self.langs[i], float(total[i]), float(np.exp(total - total[i]).sum())


class LanguageModel:
    """Counts of n-grams by fold and language, a table, and which fold is left out.

    The driver holds the names of the languages and how many documents each has.
    """

    def __init__(self, counts: DataFrame, bits: int, orders: tuple[int, ...], smoothing: float, block: int, without: int | None = None):
        self.counts = counts if without is None else counts.filter(F.col("fold") != without)
        self.bits, self.orders, self.smoothing, self.block = bits, orders, smoothing, block
        told = self.counts.groupBy("lang").agg(F.sum("docs").alias("docs")).collect()
        self.docs = dict(sorted((r["lang"], r["docs"]) for r in told))

    def __len__(self) -> int:
        """How many blocks of languages there are."""
        return -(-len(self.docs) // self.block)

    def part(self, i: int) -> _Block:
        """The i-th block of languages."""
        langs = list(self.docs)[i * self.block : (i + 1) * self.block]
        at = {lang: j for j, lang in enumerate(langs)}
        table = np.zeros((1 << self.bits, len(langs)))
        for r in self.counts.filter(F.col("lang").between(langs[0], langs[-1])).toLocalIterator():
            table[:, at[r["lang"]]] += np.frombuffer(r["counts"], np.int64)
        table += self.smoothing
        prior = np.log(np.array([self.docs[x] for x in langs]) / sum(self.docs.values()))
        return _Block(langs, prior, np.log(table / table.sum(axis=0)).astype(np.float32), self.bits, self.orders)


def _counted(docs: DataFrame, fold: Column, lang_col: str, text_col: str, bits: int, orders: tuple[int, ...]) -> DataFrame:
    """(fold, lang, docs, counts): documents, and how often they hold each bucket, as 2**bits longs."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def told(sums: dict[tuple, np.ndarray], docs_of: dict[tuple, int]) -> Iterator[pa.RecordBatch]:
        for (part, lang), own in sums.items():
            at = np.flatnonzero(own)
            columns = [[part] * (len(at) + 1), [lang] * (len(at) + 1), np.append(at, -1), np.append(own[at], docs_of[part, lang])]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["fold", "lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        docs_of: dict[tuple, int] = {}
        waiting: dict[tuple, list[np.ndarray]] = {}

        def settle(key: tuple) -> None:
            sums[key] += np.bincount(np.concatenate(waiting[key]), minlength=1 << bits)
            waiting[key] = [np.zeros(0, np.int64)]

        def flush() -> Iterator[pa.RecordBatch]:
            for key in sums:
                settle(key)
            yield from told(sums, docs_of)
            for x in (sums, docs_of, waiting):
                x.clear()

        for batch in batches:
            for part, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                key = (part, lang)
                if key not in sums:
                    if len(sums) == _HELD:
                        yield from flush()
                    sums[key], docs_of[key], waiting[key] = np.zeros(1 << bits, np.int64), 0, [np.zeros(0, np.int64)]
                docs_of[key] += 1
                for at in _grams(text.as_py(), bits, orders):
                    waiting[key].append(at)
                if len(waiting[key]) > 200 or len(waiting[key][-1]) > _STEP // 2:
                    settle(key)
        yield from flush()

    def dense(rows: pa.Table) -> pa.Table:
        bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
        own = np.zeros((1 << bits) + 1, np.int64)
        own[bucket] = n  # -1, the number of documents, is last
        return pa.table({"fold": rows["fold"].slice(0, 1), "lang": rows["lang"].slice(0, 1), "docs": own[-1:], "counts": pa.array([own[:-1].tobytes()], pa.binary())})

    rows = labelled.select(fold.cast("int").alias("fold"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(count, "fold int, lang string, bucket long, n long").groupBy("fold", "lang", "bucket").agg(F.sum("n").alias("n"))
    return materialise(counts.groupBy("fold", "lang").applyInArrow(dense, "fold int, lang string, docs long, counts binary"), "ngrams")


def train(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", bits: int = 16, orders: tuple[int, ...] = (1, 2, 3),
    smoothing: float = 0.5, block: int = 256,
) -> LanguageModel:
    """Fit on every document with a language and a text; any number of languages.

    A task holds vectors of 2**bits counts for _HELD languages, the driver those of one block. Rows
    without a label or a text are passed over, repeated rows count each time, of no rows no language is
    learned. Languages of equal probability: the first in order of name is predicted.
    """
    return LanguageModel(_counted(docs, F.lit(0), lang_col, text_col, bits, orders), bits, orders, smoothing, block)


def train_folds(
    docs: DataFrame, fold: Column, folds: int, lang_col: str = "lang", text_col: str = "text", bits: int = 16, orders: tuple[int, ...] = (1, 2, 3),
    smoothing: float = 0.5, block: int = 256,
) -> list[LanguageModel]:
    """train() for every fold without its rows, and last for all rows, from one count of the n-grams.

    fold is a number from 0 to folds - 1, never null.
    """
    counts = _counted(docs, fold, lang_col, text_col, bits, orders)
    return [LanguageModel(counts, bits, orders, smoothing, block, i) for i in (*range(folds), None)]


_BEST, _LOG, _SUM = "__gs_best", "__gs_log", "__gs_sum"


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior of lang_pred, read from whole texts alone.

    A null text, or one without letters, is `und` with score 0; so is every text if the model knows
    no language. Input columns of these names give way; others pass through. Where the model has
    several blocks of languages, the texts and what is known of them are written after each but the last.
    """
    if not len(model):
        schema = with_fields(docs.schema, [])
        return docs.select(*[c for c in schema.names if c.lower() not in ("lang_pred", "score")], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for i in range(len(model) - 1):
        done = materialise(_past(docs, model, i, text_col), "languages")
        if i:
            discard(docs)
        docs = done
    return _past(docs, model, len(model) - 1, text_col)


def _past(docs: DataFrame, model: LanguageModel, i: int, text_col: str) -> DataFrame:
    """docs past the i-th block: with the best so far, or with lang_pred and score after the last."""
    last = i == len(model) - 1
    names = ["lang_pred", "score"] if last else [_BEST, _LOG, _SUM]
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType()]
    came = T.StructType([f for f in docs.schema.fields if f.name not in (_BEST, _LOG, _SUM)])
    schema = with_fields(came, [T.StructField(n, k) for n, k in zip(names, kinds)])
    shared = docs.sparkSession.sparkContext.broadcast(model.part(i))

    def better(text: str | None, before: tuple) -> tuple:
        if not has_letters(text):
            return None, None, None
        lang, log, total = shared.value.best(text)
        if before[0] is None:
            return lang, log, total
        if log > before[1]:
            return lang, log, total + before[2] * math.exp(before[1] - log)
        return before[0], before[1], before[2] + total * math.exp(log - before[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            before = zip(*(part[x].to_pylist() for x in (_BEST, _LOG, _SUM)), strict=True) if i else [(None, None, None)] * len(batch)
            found = [better(x.as_py(), y) for x, y in zip(batch.column(batch.schema.names.index(text_col)), before, strict=True)]
            if last:
                found = [(UNKNOWN, 0.0) if lang is None else (lang, 1 / total) for lang, _, total in found]
            new = {n: pa.array([x[j] for x in found], k) for j, (n, k) in enumerate(zip(names, (pa.string(), pa.float64(), pa.float64())))}
            yield from emit(part, schema, new).to_batches()

    return docs.mapInArrow(run, schema)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = train(docs.filter(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
