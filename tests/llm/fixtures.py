"""A small corpus with copies, near copies, shared passages, nulls and odd texts."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n: int = 60, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    syllables = {"en": ["the", "th", "ing", "wh", "ou", "er"], "fr": ["é", "eau", "ent", "le", "ou", "è"], "de": ["sch", "ß", "ung", "ei", "ü", "en"]}
    rows, passage = [], " ".join(f"common{i}" for i in range(60))
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        words = ["".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.choice([1, 2, 5, 40, 120, 300]))]
        text = rng.choice([" ", "\n", "  "]).join(words)
        if i % 7 == 0:
            text += " " + passage + " tail " + words[0]
        rows.append((i, text.capitalize(), lang, f"s{i % 3}", len(text)))
    long_texts = [r for r in rows if len(r[1].split()) >= 120]
    for j, r in enumerate(long_texts[:6]):
        own = r[1].split()
        own[len(own) // 2] = "changed"
        rows.append((n + 2 * j, r[1], r[2], "copy", r[4]))
        rows.append((n + 2 * j + 1, " ".join(own), r[2], "near", r[4]))
    k = n + 100
    odd = [None, "", " \t\n", "12 34 !!", "x", "a\x00b c", "É é ß Ünïcode 漢字 漢字", "same " * 40, "A" * 5000, " nbsp em"]
    rows += [(k + i, t, None if i % 2 else "en", None, None) for i, t in enumerate(odd)]
    rows.append(rows[3])
    rows.append((None, rows[8][1], "en", "s", 1))
    return rows


def bytes_words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
