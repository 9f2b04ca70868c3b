import inspect
import os

import pytest
from fixtures import ALNUM, LOWER, SCHEMA, bytes_words, corpus
from pyspark.sql import functions as F
from test_documents import BENCH, brute_links, label_of

import __spark_entry__ as driver
import corpus_pipeline as pipeline
from graphspan.llm import queries


def test_stages_in_order(spark, docs, tmp_path):
    spark.createDataFrame(BENCH[1:2], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns, name
        seen.append({r["doc_id"]: r["text"] for r in now.collect()})
    known, apart, cut, clean = seen
    lettered = {i for i, t, *_ in corpus() if t is not None and any(map(str.isalpha, t))}
    assert set(known) <= lettered and {i for i in lettered if i is not None and i < 60} <= set(known)
    named = sorted((i, t) for i, t in known.items() if i is not None)
    leads = {i for i, (at, _) in enumerate(named) if label_of(len(named), brute_links(named))[i] == i}
    assert {i for i in apart if i is not None} == {named[i][0] for i in leads}
    languages = {r["doc_id"]: r["lang"] for r in pipeline.identify_language(spark, docs, str(tmp_path)).collect()}
    assert None not in languages.values() and any(lang is None and i in languages for i, _, lang, *_ in corpus())
    windows = {}
    for i, t in cut.items():
        for j in range(len(w := bytes_words(t)) - 12):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(i)
    assert all(len(x) == 1 or None in x for x in windows.values())
    bench = ALNUM.findall(BENCH[1][1].translate(LOWER))
    for t in clean.values():
        w = ALNUM.findall((t or "").translate(LOWER))
        assert not any(w[j : j + 10] == bench[k : k + 10] for j in range(len(w) - 9) for k in range(3))
    packed = pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(clean)
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, packed))


def test_queries_are_registered():
    names = set(driver.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in pipeline.STAGES)


CLASHES = {"score": 42.0, "lang_pred": "mine", "n_words": -1, "n_removed": -2, "spans": "s", "kept_text": "k", "n_hit": -3, "items": "i", "contaminated": "c", "clean_text": "t", "id": 9, "component_id": 8, "bucket": 7}


@pytest.mark.parametrize("name, stage", pipeline.STAGES[:-1])
def test_columns_of_users_pass_unchanged(spark, docs, tmp_path, name, stage):
    spark.createDataFrame(BENCH[1:2], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    more = docs.withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    out = stage(spark, more, str(tmp_path)).collect()
    assert out and all(r[k] == v for r in out for k, v in CLASHES.items())
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["lang"], r["n_chars"]) for r in out))) == sorted(
        map(repr, ((r["doc_id"], r["text"], r["lang"], r["n_chars"]) for r in stage(spark, docs, str(tmp_path)).collect()))
    )


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_take_empty_tables(spark, nothing, tmp_path, name, stage):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, nothing, str(tmp_path))
    assert out.count() == 0 and (name == "packing" or out.columns == nothing.columns)


def test_rows_of_one_id_are_one_document(spark, tmp_path):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "other words in here", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1)]
    out = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "None", "None"]


def test_a_run_leaves_only_its_last_tables(spark, docs, tmp_path):
    from graphspan.session import shared_dir

    spark.createDataFrame(BENCH[1:2], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert pipeline.run(spark, str(tmp_path)).count()
    assert len([x for x in set(os.listdir(folder)) - before if x.startswith("graphspan-")]) <= 2


def test_language_stage_rejects_corrects_and_fills(spark, tmp_path):
    """Unwanted languages go, wrong labels are corrected, missing ones filled, rare ones kept."""
    en, fr, de = "the weather in the north was fine this week number{}", "le temps est beau dans toute la région cette semaine {}", "das wetter ist schön und der wind weht über die straße {}"
    rows = [(i, " ".join((en, fr, de)[i % 3].format(i * 10 + j) for j in range(4)), ("en", "fr", "de")[i % 3], "s", 9) for i in range(90)]
    rows[3] = (3, rows[3][1], "fr", "s", 9)  # English under another label
    rows[4] = (4, rows[4][1], None, "s", 9)
    rows[5] = (5, rows[5][1], None, "s", 9)
    rows += [(100, "one text in a language of its own", "rare", "s", 9), (101, None, "en", "s", 9), (102, "12 34", "en", "s", 9), (103, "", None, "s", 9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    told = {r["doc_id"]: r["lang"] for r in pipeline.identify_language(spark, df, str(tmp_path)).collect()}
    assert told == {i: ("en", "fr", "de")[i % 3] for i in range(90)} | {100: "rare"}
    spark.conf.set(pipeline.LANGUAGES, "en, fr")
    try:
        some = {r["doc_id"]: r["lang"] for r in pipeline.identify_language(spark, df, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(pipeline.LANGUAGES)
    assert some == {i: lang for i, lang in told.items() if lang in ("en", "fr")}
