import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import ALNUM, LOWER, SCHEMA, bytes_words, corpus
from pyspark.sql import functions as F

from graphspan.llm import decontaminate as decon, language_id, lm_scoring, packing, simhash, substring_dedup, textarrays, token_counts, training_order
from graphspan.llm.chunks import ascii_lower, dealt
from graphspan.session import clearing, scratch

VOCABULARY = f"{token_counts.FOLDER}/{token_counts.NAME}"


def test_words_and_hashes_follow_bytes():
    import pyarrow as pa

    texts = [None, "", " a b\tc\x0bd e ", "x" * 10, "a b", "b a"]
    data, bounds = textarrays.text_bytes(pa.array(texts))
    starts, ends, first = textarrays.words(data, bounds)
    got = [[bytes(data[s:e]).decode() for s, e in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [bytes_words(t) for t in texts]
    h = textarrays.word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len({w for t in texts for w in bytes_words(t)})
    w = textarrays.window_hashes(h, 2)
    assert w[-3] != w[-1] and len(textarrays.window_hashes(h, 99)) == 0
    values = np.unique(np.random.default_rng(1).integers(0, 2**62, 100).astype(np.uint64))
    assert (textarrays.unpack_rising(textarrays.pack_rising(values)) == values).all()


def test_substring_dedup_matches_brute_force(docs):
    rows = corpus()
    first = {}
    for i, text, *_ in rows:
        w = bytes_words(text)
        for j in range(len(w) - 12) if i is not None else ():
            key = tuple(w[j : j + 13])
            first[key] = min(i, first.get(key, i))
    want = []
    for i, text, *_ in rows:
        w = bytes_words(text)
        gone = [False] * len(w)
        for j in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    out = substring_dedup.substring_dedup(docs)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(w[2] for w in want) and out.columns[:5] == docs.columns


def test_spans_point_at_equal_words_of_their_source(docs):
    texts = {}
    for i, text, *_ in corpus():
        texts.setdefault(i, set()).add(tuple(bytes_words(text)))
    out = substring_dedup.substring_dedup(docs)
    spans = out.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").collect()
    paths = substring_dedup.repeated_paths(out).collect()
    assert sum(p["n_places"] for p in paths) == len(spans) and max(p["n_docs"] for p in paths) > 1
    assert spans and all(s["source_id"] < s["doc_id"] and s["length"] >= 13 for s in spans)
    for s in spans:
        mine = {t[s["start"] : s["start"] + s["length"]] for t in texts[s["doc_id"]]}
        assert mine & {t[s["source_start"] : s["source_start"] + s["length"]] for t in texts[s["source_id"]]}


def test_clashing_and_extra_columns_and_empty_tables(spark, docs, nothing):
    clash = docs.withColumns({"N_Words": F.lit("x"), "bucket": F.lit(1), "chunk": F.lit(2), "word": F.lit("w")})
    out = substring_dedup.substring_dedup(clash)
    assert out.schema["n_words"].dataType.simpleString() == "bigint" and {"bucket", "chunk", "word"} <= set(out.columns)
    assert out.count() == docs.count()
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    marked = decon.decontaminate(docs.withColumns({"items": F.lit(3), "score": F.lit(1)}), bench)
    assert marked.schema["items"].dataType.simpleString() == "array<string>" and "score" in marked.columns
    for empty in (
        substring_dedup.substring_dedup(nothing), simhash.simhash_groups(nothing), simhash.near_duplicates(nothing), decon.decontaminate(nothing, bench),
        language_id.identify(nothing, language_id.train(nothing)), packing.pack(packing.lengths_of(packing.encoded(nothing, None), None)), lm_scoring.lm_scores(nothing),
        token_counts.limit_table(token_counts.length_histogram(token_counts.encoded_lengths(nothing, VOCABULARY))),
    ):
        assert empty.count() == 0


def _print(text):
    w = (text or "").translate(LOWER)
    w = [x.encode() for x in bytes_words(w)]
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def test_simhash_groups_match_brute_force(docs):
    rows = [(i, _print(t)) for i, t, *_ in corpus()]
    prints = sorted({p for _, p in rows})
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, p in rows:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    got = simhash.simhash_groups(docs).collect()
    assert sorted((r["id"], r["f0"] % 2**64, r["component_id"]) for r in got if r["id"] is not None) == sorted((i, p, least[find(p)]) for i, p in rows if i is not None)
    assert len(got) == len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_anchors_miss_no_link(seed):
    """Random fingerprints and neighbours at 0 to 3 bits, against all pairs; large runs too."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) if k else b for b in base for k in (1, 2, 3, 3)]
    crowd = [base[0] ^ (np.uint64(1) << np.uint64(32 + i % 32)) ^ (np.uint64(1) << np.uint64(32 + (i * 7 + 3) % 32)) for i in range(90)]
    prints = np.unique(np.array([*base, *near, *crowd], np.uint64))
    row, key, home = simhash._anchored(simhash._blocks(prints[:, None]))
    order = np.argsort(key, kind="stable")
    u, v = simhash._forest(key[order], home[order], row[order], prints[row[order]][:, None], 3)

    def groups(edges):
        label = list(range(len(prints)))

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in edges:
            label[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(prints))]

    every = [(a, b) for a in range(len(prints)) for b in range(a) if (int(prints[a]) ^ int(prints[b])).bit_count() <= 3]
    assert groups(zip(u.tolist(), v.tolist())) == groups(every)
    assert all((int(prints[a]) ^ int(prints[b])).bit_count() <= 3 for a, b in zip(u.tolist(), v.tolist())) 


def test_crowded_anchors_are_split_without_loss(spark):
    rng = np.random.default_rng(2)
    half = np.array([sum(1 << int(b) for b in rng.choice(31, 2, replace=False)) for _ in range(1500)], np.uint64)
    prints = np.unique(half | rng.integers(0, 1 << 12, 1500, dtype=np.uint64) << np.uint64(40))
    links = [(a, b) for b in range(len(prints)) for a in np.flatnonzero(np.bitwise_count(prints[:b] ^ prints[b]) <= 3).tolist()]
    table = spark.createDataFrame([(i, int(x)) for i, x in enumerate(prints)], "node long, f0 long")
    for crowd in (50, 20_000):
        got = [tuple(r) for r in simhash.linked(table, 3, crowd).collect()]
        assert set(map(tuple, map(sorted, got))) <= set(links)
        assert label_of(len(prints), got) == label_of(len(prints), links)


def test_parts_of_a_crowded_anchor_are_small(spark):
    """50,000 fingerprints with one lower block: its anchors hold them all, their parts do not."""
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 1 << 33, 50_000, dtype=np.uint64) << np.uint64(31) | np.uint64(12345))
    row, key, home = simhash._anchored(simhash._blocks(prints[:, None]))
    at = np.flatnonzero(key >> np.uint64(32) == 0)
    columns = {"key": key[at].astype(np.int64), "home": home[at], "node": row[at], "f0": prints[row[at]].view(np.int64)}
    parts = simhash._parts(spark.createDataFrame(pa.table(columns)), 2000, 3).groupBy("key", "part").count().toPandas()
    assert parts["count"].max() <= 2000 and parts["count"].sum() == 4 * len(at)


def test_fingerprints_link_and_not_the_ids_they_share(spark):
    a, b = "one two three four five six", "completely other words in this text here"
    for other in (8, 3):
        rows = [(5, a), (7, a), (5, b), (other, b)]
        got = sorted((r["id"], r["component_id"]) for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == sorted([(5, 5), (7, 5), (5, min(5, other)), (other, min(5, other))])


def test_a_text_of_nine_megabytes_is_packed_whole(spark):
    text = " ".join(f"w{i:07d}" for i in range(1_000_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    texts = packing.encoded(docs, None)
    pieces = packing.pack(packing.lengths_of(texts, None), (512, 4096), key_col="row")
    ids = training_order.Ids(None)
    placed = {(r["id"], r["piece"]): (r["bin_id"], r["bin_offset"], r["length"]) for r in pieces.collect()}
    bins = {r["bin_id"]: np.frombuffer(r["tokens"], ids.kind) for r in packing.assembled(pieces, texts, None).collect()}
    mine = [placed[1, i] for i in range(sum(d == 1 for d, _ in placed))]
    got = np.concatenate([bins[b][at : at + n] for b, at, n in mine])
    assert len(got) == len(text) + 1 and got[:-1].astype(np.uint8).tobytes() == text.encode() and got[-1] == ids.end
    assert placed[3, 0][2] == 1 and placed[2, 0][2] == 6


def test_query_tells_fingerprints_in_hex(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["fingerprint"]) for r in simhash.op2(spark, str(tmp_path)).collect()}
    assert got == {(i, f"{_print(t):016x}") for i, t, *_ in corpus()}


def test_near_duplicates_join_copies_and_near_copies_only(docs):
    group = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs.filter("doc_id is not null")).collect()}
    rows = [r for r in corpus() if r[0] is not None]
    by_text = {}
    for r in rows:
        by_text.setdefault(r[1], set()).add(group[r[0]])
    assert all(len(g) == 1 for g in by_text.values())
    long_texts = [r[0] for r in rows if r[0] < 60 and len((r[1] or "").split()) >= 120]
    assert len({group[i] for i in long_texts}) == len(long_texts)
    pairs = [(rows[i][0], rows[i + 1][0]) for i in range(60, 72, 2)]
    assert sum(group[a] == group[b] for a, b in pairs) >= 5


def edited_copies(seed=5):
    """(id, text): texts and their copies, cut off, extended or with a block or scattered words replaced, at similarity 0.55 to 0.95."""
    rng = np.random.default_rng(seed)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for s in np.linspace(0.55, 0.95, 41):
        for kind in range(4):
            base = some(int(rng.integers(120, 400)))
            n = len(base)
            new = int(n * (1 - s) / (1 + s))
            at = int(rng.integers(0, n - new))
            copy = [base[: int(n * s)], base + some(int(n / s) - n), base[:at] + some(new) + base[at + new :], list(base)][kind]
            for i in rng.choice(n, max(1, new // 5), replace=False) if kind == 3 else ():
                copy[i] = "new"
            texts += [base, copy]
    line = some(700)  # each like the next ones only
    texts += [line[i : i + 300] for i in range(0, 400, 8)]
    crowd = some(200)  # all like the base, most not like each other
    for _ in range(60):
        at = int(rng.integers(0, 180))
        texts.append(crowd[:at] + some(19) + crowd[at + 19 :])
    return [(i, " ".join(t)) for i, t in enumerate([*texts, crowd, ["few", "words"], ["Few", "words"], ["few", "others"]])]


def brute_links(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (bytes_words(t.translate(LOWER)) for _, t in rows)]
    return {(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def label_of(n, links):
    label = np.arange(n)
    for a, b in links:
        label[label == max(label[a], label[b])] = min(label[a], label[b])
    return label.tolist()


def test_near_duplicates_find_every_kind_of_edit(spark):
    """No pair at 0.8 and more stays apart, wherever the texts differ."""
    rows = edited_copies()
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert sum(got[a] != got[b] for a, b in brute_links(rows)) == 0


def test_near_duplicates_link_nothing_less_alike(spark):
    """Groups are the components of the pairs at 0.8 and more, no larger, down to the last text; ids may repeat."""
    rows = edited_copies()
    want = label_of(len(rows), brute_links(rows))
    again = [(rows[0][0], rows[0][1].upper()), (rows[1][0], ""), (None, rows[2][1]), (None, "an unknown text")]
    got = simhash.near_duplicates(spark.createDataFrame([*rows, *again], "doc_id long, text string").repartition(5)).collect()
    assert {(r["id"], r["component_id"]) for r in got if r["id"] is not None} == set(enumerate(want))
    assert sorted(map(str, (r["component_id"] for r in got if r["id"] is None))) == sorted(["None", str(want[2])])


BENCH = [(1, "one two three"), (2, " ".join(f"Common{i}" for i in range(12))), (3, None), (4, "--"), (2, " ".join(f"Common{i}" for i in range(12))), (10, "changed"), (None, "x")]


@pytest.mark.parametrize("max_bytes", [1 << 20, 60])
def test_decontamination_matches_brute_force(spark, docs, max_bytes):
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in BENCH:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[j : j + n]), set()).add(None if i is None else str(i))
    want = []
    for i, text, *_ in corpus():
        w = words(text)
        hit, items = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    hit[j : j + n] = [True] * n
                    items |= found
        want.append((i, len(w), sum(hit), sorted(items, key=lambda x: (x is None, x)), any(hit)))
    out = decon.decontaminate(docs, spark.createDataFrame(BENCH, "item_id long, text string"), max_bytes=max_bytes).collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(w[4] for w in want)
    for r in out:
        assert r["clean_text"] == r["text"] if not r["n_hit"] else len(words(r["clean_text"])) == r["n_words"] - r["n_hit"]


def test_decontamination_with_an_empty_benchmark(spark, docs):
    assert decon.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0


def test_language_id_on_held_out_documents(spark):
    rows = [(i + 1000, *r[1:]) for i, r in enumerate(corpus(300, 9)[:300])]
    df = spark.createDataFrame(rows, SCHEMA)
    held = language_id.fold("doc_id", 4) == 2
    model = language_id.train(df.filter(~held))
    got = language_id.identify(df.filter(held), model).filter("length(text) > 20").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def _plain_letters(text):
    low, gap = [0], True
    for c in text:
        x = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else None
        if x is None and gap:
            continue
        gap = x is None
        low.append(ord(x) if x else 0)
    return low if gap else [*low, 0]


@pytest.mark.parametrize("step", [1 << 19, 7])
def test_language_id_matches_brute_force(spark, docs, step, monkeypatch):
    """Naive Bayes told plainly; also where a text spans many blocks of letters."""
    monkeypatch.setattr(language_id, "_STEP", step)
    word = (1 << 64) - 1

    def grams(text):
        low = _plain_letters(text) if text else []
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                h = 0
                for x in low[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + x) & word
                yield (((h + n) * 0xD6E8FEB86659FD93) & word) >> 48

    texts = [(t, lang) for _, t, lang, *_ in corpus() if t is not None]
    for t, _ in texts:
        assert Counter(np.concatenate(list(language_id._grams(t, 16, (1, 2, 3))) or [np.zeros(0)]).astype(int).tolist()) == Counter(grams(t))
    if step == 7:
        return
    counts, prior = {}, Counter()
    for t, lang in texts:
        if lang:
            counts.setdefault(lang, Counter()).update(grams(t))
            prior[lang] += 1
    model = language_id.train(docs)
    got = language_id.identify(docs, model).collect()
    total = {k: sum(c.values()) + 0.5 * 65536 for k, c in counts.items()}
    for r in got:
        if not language_id.has_letters(r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = {k: math.log(prior[k] / sum(prior.values())) + sum(math.log((c[g] + 0.5) / total[k]) for g in grams(r["text"])) for k, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert r["lang_pred"] == best and abs(r["score"] - 1 / sum(math.exp(x - logs[best]) for x in logs.values())) < 1e-3


def test_any_number_of_languages(spark, docs, monkeypatch):
    """A thousand labels, in blocks and from tasks that hold few, and one block against many."""
    monkeypatch.setattr(language_id, "_HELD", 64)
    rows = [(i, " ".join(chr(0x4E00 + 7 * i + j) * 3 for j in range(5)), f"l{i:04}") for i in range(1000)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with clearing():
        model = language_id.train(many, bits=12, block=300)
        assert len(model) == 4
        got = language_id.identify(many, model).collect()
        assert len(got) == 1000 and all(r["lang"] == r["lang_pred"] and 0.99 < r["score"] <= 1 for r in got)
        tell = lambda block: sorted((str(r["doc_id"]), r["text"] or "", r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs, language_id.train(docs, block=block)).collect())
        assert tell(1) == tell(2) == tell(256)


def test_language_folds_leave_their_rows_out(spark, docs):
    """Each model of train_folds() is that of the rows outside the fold, the last that of all rows."""
    part = F.pmod(F.xxhash64("text"), F.lit(3))
    with clearing():
        tell = lambda model: sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs, model).collect())
        models = language_id.train_folds(docs, part, 3)
        assert len(models) == 4 and tell(models[-1]) == tell(language_id.train(docs))
        for i in range(3):
            assert tell(models[i]) == tell(language_id.train(docs.filter(part != i)))


def test_a_very_long_text_has_a_language(spark):
    long = "the weather in the north is fine " * 270_000  # 8.9 MB
    rows = [(1, long, "en"), (2, "le temps est beau dans le nord " * 40, "fr"), (3, long[:2000], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with clearing():
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, language_id.train(df)).collect()}
    assert got[1] == ("en", 1.0) and got[2][0] == "fr" and got[3][0] == "en"


def test_language_id_without_letters(docs):
    model = language_id.train(docs)
    for r in language_id.identify(docs.withColumn("score", F.lit("x")), model).collect():
        letters = r["text"] is not None and any(map(str.isalpha, r["text"]))
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0.0)
        assert letters is False or r["lang_pred"] in {"en", "fr", "de"}


@pytest.mark.parametrize("ranks", [None, "vocabulary"])
def test_packing_assembles_every_token(docs, ranks):
    ranks = ranks and VOCABULARY
    texts = packing.encoded(docs, ranks)
    lengths = packing.lengths_of(texts, ranks)
    pieces = packing.pack(lengths, (16, 32, 64), key_col="row", shard_pieces=10)
    out = pieces.collect()
    ids = training_order.Ids(ranks)
    want = sorted([*((r["text"] or "").encode() if ranks is None else _bpe(r["text"] or "")), ids.end] for r in docs.collect())
    sequences = {r["bin_id"]: r for r in packing.assembled(pieces, texts, ranks).collect()}
    bins, whole = {}, {}
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r)
    assert set(bins) == set(sequences)
    for b, rows in bins.items():
        used, at = sum(r["length"] for r in rows), 0
        tokens = np.frombuffer(sequences[b]["tokens"], ids.kind)
        rows = sorted(rows, key=lambda r: r["bin_offset"])
        assert sequences[b]["ids"] == [r["id"] for r in rows] and len(tokens) == rows[0]["capacity"] and (tokens[used:] == ids.pad).all()
        for r in rows:
            assert r["bin_offset"] == at and r["used"] == used
            whole.setdefault(r["key"], {})[r["piece"]] = tokens[at : at + r["length"]].tolist()
            at += r["length"]
        assert rows[0]["capacity"] == min(c for c in (16, 32, 64) if c >= used)
    assert sorted(sum((x[i] for i in sorted(x)), []) for x in whole.values()) == want


def test_packing_follows_its_rule():
    """Against the rule told plainly: longest piece opens, every size is filled best fit, the cheapest token wins."""
    rng = np.random.default_rng(8)
    sizes, costs = [16, 32, 64], [10.0, 17.0, 40.0]
    for n in (1, 7, 60, 200):
        lengths = [int(x) for x in rng.integers(1, 65, n)]
        left, bins = sorted(lengths, reverse=True), []
        while left:
            tries = []
            for size in (x for x in sizes if x >= left[0]):
                rest, fill = list(left), []
                while fits := [x for x in rest if x <= size - sum(fill)]:
                    fill.append(fits[0])
                    rest.remove(fits[0])
                small = next(x for x in sizes if x >= sum(fill))
                tries.append((costs[sizes.index(small)] / sum(fill), small, fill))
            _, small, fill = min(tries, key=lambda x: x[0])
            bins.append((small, sorted(fill)))
            for x in fill:
                left.remove(x)
        got = packing.plan(lengths, sizes, costs)
        assert sorted((c, sorted(lengths[i] for i in own)) for c, _, own in got) == sorted(bins)
        assert sorted(i for *_, own in got for i in own) == list(range(n))


def test_equal_lengths_of_one_id_spread_over_shards(spark):
    rows = spark.range(30_000).selectExpr("cast(3 as bigint) as id", "cast(9 as bigint) as length")
    out = packing.pack(rows, (16, 32), shard_pieces=1000).selectExpr("bin_id >> 32 as shard")
    assert out.count() == 30_000 and out.distinct().count() > 20


def test_packing_costs_no_more_than_one_size_first_fit():
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in np.minimum(64, rng.geometric(0.08, 400))]
    mine = sum(c for c, _, _ in packing.plan(lengths, [16, 32, 64], [16.0, 32.0, 64.0]))
    room = []
    for n in sorted(lengths, reverse=True):
        for i, r in enumerate(room):
            if r >= n:
                room[i] -= n
                break
        else:
            room.append(64 - n)
    assert sum(lengths) <= mine <= 64 * len(room)
    assert packing.plan([], [16], [16.0]) == []


def test_unusable_lengths_give_no_row(spark):
    rows = spark.createDataFrame([(1, None), (2, 0), (3, -5), (None, 4), (4, 130)], "id long, length long")
    assert sorted((r["id"] or -1, r["piece"], r["start"], r["length"]) for r in packing.pack(rows, (64,)).collect()) == [(-1, 0, 0, 4), (4, 0, 0, 64), (4, 1, 64, 64), (4, 2, 128, 2)]


@pytest.mark.parametrize("ranks", [None, VOCABULARY])
def test_training_order_matches_brute_force(spark, docs, ranks):
    """The query's columns, and a resume, under a path that itself looks like a shard's name."""
    path = scratch(spark, "order") + "/part-7/order"
    told = training_order.write_training_order(docs.coalesce(1), path, ranks_path=ranks, length=32, shard_rows=16)
    ids, stream = training_order.Ids(ranks), []
    for r in docs.coalesce(1).collect():
        own = list((r["text"] or "").encode()) if ranks is None else list(_bpe(r["text"] or ""))
        stream += [*own, ids.end]
    n = -(-len(stream) // 32)
    rows = np.array(stream + [ids.pad] * (32 * n - len(stream)), ids.kind).reshape(n, 32)
    slot = training_order.slots(np.arange(n), n, told["key"])
    want = {int(s): (int(s) // 16, int(s) % 16 * told["stride"], i, int((rows[i] != ids.pad).sum()), zlib.crc32(rows[i].tobytes())) for i, s in enumerate(slot)}
    got = training_order.checked_order(spark, path, told).collect()
    assert told["n"] == n and {r["slot"]: tuple(r)[1:] for r in got} == want and len(got) == n
    at = 40
    rest = training_order.read_training_order(spark, path, told, at)
    assert {r["slot"] for r in rest.collect()} == set(range(at, n))
    assert len(training_order.shard_files(spark, path, at // 16)) == -(-n // 16) - at // 16
    assert len(rest.inputFiles()) == -(-n // 16) - at // 16
    assert training_order.read_training_order(spark, path, told, n).count() == 0


def test_training_order_of_nothing(spark, nothing):
    assert training_order.write_training_order(nothing, scratch(spark, "order"))["n"] == 0


def _bpe(text):
    """Byte pairs merged one by one, lowest rank first."""
    import base64

    import regex

    if not _ranks:
        _ranks.update((base64.b64decode(a), int(b)) for a, b in (x.split() for x in open(VOCABULARY, "rb").read().splitlines()))
    for piece in regex.findall(token_counts.PATTERN, text):
        parts = [bytes([x]) for x in piece.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: _ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in _ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        yield from (_ranks[x] for x in parts)


_ranks: dict[bytes, int] = {}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 257, 1000])
def test_slots_are_a_keyed_bijection(n):
    at = training_order.slots(np.arange(n), n, 7)
    assert sorted(at.tolist()) == list(range(n))
    assert (training_order.numbers(at, n, 7) == np.arange(n)).all()
    if n >= 100:
        assert (at != np.arange(n)).any() and (at != training_order.slots(np.arange(n), n, 8)).any()


def test_token_counts_for_every_limit(docs):
    lengths = token_counts.encoded_lengths(docs, VOCABULARY)
    own = np.array([r["length"] for r in lengths.collect()])
    assert sorted(own.tolist()) == sorted(len(list(_bpe(r["text"] or ""))) for r in docs.collect())
    out = token_counts.limit_table(token_counts.length_histogram(lengths)).collect()
    assert sorted(r["context_limit"] for r in out) == sorted(set(own.tolist()))
    for r in out:
        limit = r["context_limit"]
        assert r["tokens_kept"] == np.minimum(own, limit).sum() and r["tokens_cut"] == own.sum() - r["tokens_kept"] and r["tokens_total"] == own.sum()
        assert r["n_docs"] == (own == limit).sum() and r["n_longer"] == (own > limit).sum() and abs(r["quantile"] - (own <= limit).mean()) < 1e-12
    asked = token_counts.at_limit(token_counts.length_histogram(lengths), [0, 7, 10**6]).collect()
    assert {(r["context_limit"], r["n_longer"], r["tokens_kept"]) for r in asked} == {(x, int((own > x).sum()), int(np.minimum(own, x).sum())) for x in (0, 7, 10**6)}


def test_lm_scores_base_and_training_help(docs):
    held = language_id.fold("doc_id", 10) == 0
    got = lm_scoring.lm_scores(docs, held, chunk_bytes=20_000).collect()
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {}
    counts = Counter()
    for i, t, *_ in corpus():
        own = [*bytes_words((t or "").translate(LOWER)), ""]
        tokens.setdefault((i, t), own)
        if not fold(i):
            counts.update(own)
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(corpus())
    for r in got:
        own = tokens[(r["doc_id"], r["text"])]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"]), len(own), sum(counts[w] > 0 for w in own), total)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)) < 1e-6 * len(own)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_sums_of_weights(spark):
    parts = spark.createDataFrame([(i, 2, np.full(5, i, "<f4").tobytes()) for i in range(150)], f"{lm_scoring.PART} int, tokens long, weights binary")
    (total,) = lm_scoring._summed(parts, 150, fan_in=4).collect()
    assert total["tokens"] == 300 and np.frombuffer(total["weights"], "<f4").tolist() == [sum(range(150))] * 5


def test_lm_scores_follow_from_the_weights(spark, docs, monkeypatch):
    """score is what a plain walk over words gives for the fitted weights, and it beats the base on documents held out."""
    from graphspan.llm import gated_lm as lm

    kept, fit = [], lm_scoring._fit
    monkeypatch.setattr(lm_scoring, "_fit", lambda rows, answers, vocabulary, *rest: kept.append((vocabulary, fit(rows, answers, vocabulary, *rest))) or kept[0][1])
    rng = np.random.default_rng(4)
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(1200):
        own, at = [], int(rng.integers(60))
        for _ in range(int(rng.integers(5, 120))):
            own.append(words[at])
            at = (at * 7 + int(rng.integers(3))) % 60
        rows.append((i, " ".join(own)))
    rows[3] = (3, None)
    rows.append((5000, "odd words never met before"))
    held = language_id.fold("doc_id", 10) == 0
    got = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), held, chunk_bytes=20_000).collect()
    out = [r for r in got if r["held_out"]]
    assert len(out) > 60 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out) * 0.95
    (vocabulary, w), counts = kept[0], Counter()
    hashes = lambda t: [*(int(x) for x in _word_hashes(t)), int(lm_scoring.END)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    for i, t in rows:
        if not fold(i):
            counts.update(hashes(t))
    top = {int(h): int(p) for h, p in zip(vocabulary.hashes, vocabulary.place, strict=True)}
    per, some = vocabulary.per_class, {0, 3, 10, 5000, *[i for i, _ in rows[:200] if fold(i)]}
    of = {r["doc_id"]: r["score"] for r in got}
    sig = lambda x: 1 / (1 + np.exp(-x))
    w = {k: x.astype(np.float64) for k, x in w.items()}
    for i, t in rows:
        if i not in some:
            continue
        h, total, size = np.zeros(w["u"].shape[0]), 0.0, w["u"].shape[0]
        for x in hashes(t):
            place, c = top.get(x), counts[x]
            band = c.bit_length() - 1 if c else vocabulary.bands
            group = place // per if place is not None else vocabulary.classes + band
            logits = h @ w["wc"] + w["bc"]
            total += logits[group] - np.log(np.exp(logits).sum())
            if place is not None:
                inner = h @ w["win"][group] + w["bin"][group]
                total += inner[place % per] - np.log(np.exp(inner).sum())
            else:
                total += math.log((c + 0.1) / vocabulary.band_mass[band] if c else 1 / (len(counts) + 1))
            x_in = w["emb"][place if place is not None else vocabulary.classes * per + band] @ w["wx"] + w["bx"]
            back = h @ w["u"]
            z, r = sig(x_in[:size] + back[:size]), sig(x_in[size : 2 * size] + back[size : 2 * size])
            new = np.tanh(x_in[2 * size :] + r * back[2 * size :])
            h = new + z * (h - new)
        assert abs(of[i] - total / math.log(10)) < 1e-3 * max(1, abs(of[i])), i


def _word_hashes(text):
    from graphspan.llm import textarrays as ta

    data, bounds = ta.text_bytes(pa.array([text], pa.string()))
    starts, ends, _ = ta.words(data, bounds)
    return ta.word_hashes(data, starts, ends)


@pytest.mark.parametrize("op", ["lm", "substring"])
def test_equal_rows_are_dealt_as_one(spark, op):
    rows = spark.range(20_000).selectExpr("cast(7 as bigint) as doc_id", "repeat('a b c d ', 8) as text").unionByName(spark.range(50).selectExpr("id + 100 as doc_id", "concat('x', id, ' y z') as text"))
    dealt_rows, _, _ = dealt(rows, "doc_id", "text")
    assert dealt_rows.count() == 51
    if op == "lm":
        got = lm_scoring.lm_scores(rows, rounds=1)
        assert got.count() == 20_050 and got.first()["train_tokens"] == 20_000 * 33 + 50 * 4
    else:
        got = substring_dedup.substring_dedup(rows)
        assert got.count() == 20_050 and got.filter("n_removed > 0").count() == 0


@pytest.mark.parametrize("chunk_bytes", [5_000, 20_000, 1 << 22])
def test_lm_learns_from_every_training_document_once(docs, chunk_bytes, monkeypatch):
    learned, summed = [], lm_scoring._summed

    def seen(parts, n):
        out = summed(parts, n)
        learned.extend(r["tokens"] for r in out.collect())
        return out

    monkeypatch.setattr(lm_scoring, "_summed", seen)
    got = lm_scoring.lm_scores(docs, language_id.fold("doc_id", 10) == 0, chunk_bytes=chunk_bytes).collect()
    assert sum(learned) == got[0]["train_tokens"]


def test_network_gradients_and_learning():
    from graphspan.llm import gated_lm as lm

    rng = np.random.default_rng(0)
    # words 0..7 in a fixed cycle: the next word is certain, a unigram model can't know it
    stream = np.tile(np.arange(8), 40)
    hashes = np.arange(1, 9, dtype=np.uint64) * np.uint64(2**40)
    counts = np.bincount(stream)
    vocabulary = lm.Vocabulary([(int(h), int(c)) for h, c in zip(hashes, counts)], np.bincount([5] * 8, minlength=lm.BANDS), np.bincount([5] * 8, weights=counts, minlength=lm.BANDS), 320, 8, per_class=4)
    inputs, group, share = vocabulary.find(hashes[stream], counts[stream])
    assert (share == 0).all()
    first = np.arange(0, 321, 40)
    w = lm.fresh(vocabulary, 6, 8, 1)
    grid = lambda x: np.stack([x[i : i + 5] for i in first[:-1]], axis=1)
    grads, _ = lm._window({k: x.astype(np.float64) for k, x in w.items()}, grid(inputs), grid(group), np.ones((5, 8)), np.ones((5, 8)), np.zeros((8, 8)))

    def loss(weights):
        at = (first[:-1][:, None] + np.arange(5)).ravel()
        return -lm.score(weights, inputs[at], group[at], np.arange(0, 41, 5)).sum() * math.log(10) / 40

    for k in ("emb", "wx", "u", "wc", "win", "bc"):
        spot = np.unravel_index(np.argmax(np.abs(grads[k])), grads[k].shape)
        moved = {n: x.astype(np.float64).copy() for n, x in w.items()}
        moved[k][spot] += 1e-4
        up = loss(moved)
        moved[k][spot] -= 2e-4
        assert abs((up - loss(moved)) / 2e-4 - grads[k][spot]) < 2e-3 + 0.02 * abs(grads[k][spot])
    before = lm.score(w, inputs, group, first).sum()
    for r in range(30):
        w = lm.train(w, vocabulary, inputs, group, first, int(rng.integers(99)))
    assert lm.score(w, inputs, group, first).sum() > 0.5 * before


def test_ascii_lower(spark):
    assert spark.range(1).select(ascii_lower(F.lit("ABC É ß Z"))).first()[0] == "abc É ß z"


def test_digest_of_kept_words(spark, tmp_path):
    rows = [(1, "a b", "en", "s", 3), (2, None, "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.op1(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_near_duplicates_go_through_anchors(spark, monkeypatch):
    """Links of fingerprints are proposed by anchors, and compared on the sets."""
    seen, linked = [], simhash.linked
    monkeypatch.setattr(simhash, "linked", lambda prints, most, *a: seen.append(most) or linked(prints, most, *a))
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == [(0, 0), (1, 0), (2, 2)]
    assert seen == [3]
