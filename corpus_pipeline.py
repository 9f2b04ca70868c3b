"""Documents from raw to packed, in five stages over the `documents` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents. Columns
beyond doc_id, text and lang travel in one struct past the operators, so that none of them, whatever
its name, is taken for an operator's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphspan.llm import decontaminate as decontamination, language_id, packing, simhash, substring_dedup
from graphspan.llm.token_counts import vocabulary
from graphspan.session import clearing, discard, kept, materialise

#: a document without a label is rejected if its language has less than this
LEAST_SCORE = 0.5
#: a label gives way to a language that has at least this where the model hasn't seen the document
OVERRULING = 0.9999
#: labelled documents are judged by counts from the other folds
FOLDS = 2
#: the setting that names the languages that stay, with commas; unset, all that the labels name
LANGUAGES = "spark.graphspan.languages"

_REST, _NAMED = "__gs_rest", "__gs_named"


def _slim(docs: DataFrame, *used: str) -> DataFrame:
    """The columns an operator uses, and the others as one."""
    rest = [F.col(c) for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(None).cast("boolean")).alias(_REST))


def _whole(out: DataFrame, docs: DataFrame, *used: str, **new: Column) -> DataFrame:
    """out, made from _slim(), with the columns of docs; new gives values to some."""
    value = lambda c: new[c].cast(docs.schema[c].dataType) if c in new else F.col(c if c in used else f"{_REST}.`{c}`")
    return out.select(*[value(c).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is wanted (LANGUAGES), with `lang` filled and corrected.

    Labelled documents are dealt into folds by their text, so that copies share one, and judged by a
    model of the other folds. A label stays unless that model knows it and gives another language
    OVERRULING or more. Documents without a label get the most probable language of the model of all
    labels, and go if its score is under LEAST_SCORE. Texts that are null or without letters go. Without any
    labels nothing can be told and every document goes. Null ids and repeated rows are rows like others.
    """
    own = F.when(F.col("lang").isNotNull(), F.pmod(F.xxhash64("text"), F.lit(FOLDS))).otherwise(FOLDS)
    models = language_id.train_folds(docs, own, FOLDS)
    judged = []
    for i, model in enumerate(models):
        found = language_id.identify(_slim(docs.filter(own == i), "text", "lang"), model)
        known = F.col("lang").isin(list(model.docs)) if i < FOLDS else F.lit(False)
        stays = F.col("lang").isNotNull() & ~(known & (F.col("score") >= OVERRULING))
        sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
        judged.append(found.withColumn(_NAMED, F.when(stays, F.col("lang")).when(sure, F.col("lang_pred"))))
    named = reduce(DataFrame.unionByName, judged)
    wanted = [x.strip() for x in (spark.conf.get(LANGUAGES, None) or "").split(",") if x.strip()]
    stay = F.col(_NAMED).isin(wanted) if wanted else F.col(_NAMED).isNotNull()
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return _whole(named.filter(stay & lettered), docs, "text", lang=F.col(_NAMED))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts alike in their five-word shingles.

    Rows of one id are one document: it stays if a text of it leads a group, as its row of smallest
    hash. Rows without an id belong to no group and stay. Other columns take no part.
    """
    groups = simhash.near_duplicates(docs)
    first = groups.filter("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    own = F.xxhash64("doc_id", "text")
    best = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("__gs_own")).join(first, "doc_id", "left_semi")
    named = docs.withColumn("__gs_own", own).join(best, ["doc_id", "__gs_own"], "left_semi").dropDuplicates(["doc_id", "__gs_own"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; what was nothing else goes.

    n_chars follows the text. Rows with a null id keep their text and are no source; rows of one id
    are one document, of which no row is a copy of another.
    """
    out = substring_dedup.substring_dedup(_slim(docs, "doc_id", "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _changed(left, docs, text, "n_removed")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that held nothing else go.

    n_chars follows the text. Null ids and repeated rows are rows like others.
    """
    out = decontamination.decontaminate(_slim(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    left = out.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return _changed(left, docs, F.col("clean_text"), "n_hit")


def _changed(out: DataFrame, docs: DataFrame, text: Column, count: str) -> DataFrame:
    if "n_chars" not in docs.columns:
        return _whole(out, docs, "doc_id", "text", text=text)
    n_chars = F.when(F.col(count) > 0, F.length(text)).otherwise(F.col(f"{_REST}.n_chars"))
    return _whole(out, docs, "doc_id", "text", text=text, n_chars=n_chars)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces stand in training sequences of several lengths, in token ids.

    A null or empty text is an end id alone. Null ids and repeated rows are packed like others.
    """
    ranks = vocabulary(spark)
    with clearing():
        lengths = kept(materialise(packing.lengths_of(packing.encoded(docs, ranks), ranks), "lengths"))
    return packing.pack(lengths, key_col="row").drop("key").withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontaminate", decontaminate),
    ("packing", pack),
]

#: SQL can express neither the trained classifier nor the packer; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with clearing():
            done = kept(materialise(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
