"""Near-duplicates in groups of edited copies; hashes of many words."""

from __future__ import annotations

import random

import numpy as np
from fixtures import SCHEMA

from graphspan.llm import shingle_join, simhash, textarrays as ta


def _edited(copies: int) -> list[tuple]:
    """Copies of one text with 0 to 9 words replaced, most of them unlike each other."""
    draw = random.Random(5)
    words = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(copies):
        mine = list(words)
        for place in draw.sample(range(150), i % 10):
            mine[place] = f"x{draw.randrange(10**9)}"
        rows.append((i, " ".join(mine), "en", "s", 0))
    return rows


def _groups(rows: list[tuple], similarity: float) -> dict[int, int]:
    sets = {r[0]: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in rows for w in [r[1].split()]}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in (b for b in sets if b > a and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    return label


def test_a_group_of_edited_copies_makes_few_pairs(spark, monkeypatch):
    rows, compared, plain = _edited(300), [], shingle_join.materialise

    def counting(df, name="table", *more, **named):
        out = plain(df, name, *more, **named)
        compared.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(shingle_join, "materialise", counting)
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {r.id: r.component_id for r in found.collect()} == _groups(rows, 0.8)
    assert sum(compared) < 2 * len(rows), compared


def test_word_hashes_need_short_power_tables():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 1_500_000).astype(np.uint8)
    data[rng.integers(0, len(data), 200_000)] = 32
    starts, ends, _ = ta.words(data, np.array([0, len(data)]))
    ta._powers.clear()
    hashes = ta.word_hashes(data, starts, ends)
    held = ta._powers[ta._BASE]
    assert len(held[0]) < 1 << 20
    for i in (0, 1, 1000, len(held[0]) - 1):
        assert int(held[0][i]) == pow(ta._BASE, i, 1 << 64) and int(held[0][i]) * int(held[1][i]) % (1 << 64) == 1
    alone = [ta.word_hashes(data[s:e], np.array([0]), np.array([e - s]))[0] for s, e in zip(starts[-50:], ends[-50:], strict=True)]
    assert alone == hashes[-50:].tolist()
