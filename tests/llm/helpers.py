"""Small tables with the odd cases that every operator has to take."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STEMS = {
    "en": ["the", "river", "carried", "stones", "toward", "quiet", "harbor", "while", "farmers", "watched", "morning"],
    "de": ["der", "Fluss", "trug", "schwere", "Steine", "langsam", "zum", "stillen", "Hafen", "während", "Morgen"],
}


def prose(rng: random.Random, lang: str = "en", words: int = 60) -> str:
    """Sentences of made-up prose."""
    out, line = [], []
    for i in range(words):
        word = rng.choice(STEMS[lang]) + (rng.choice(["", "s", "n", "t"]) if rng.random() < 0.4 else "")
        line.append(word + str(rng.randrange(40)) if rng.random() < 0.2 else word)
        if len(line) == 12 or i == words - 1:
            out.append(" ".join(line) + ".")
            line = []
    return "\n".join(out)


def documents(n: int = 40, seed: int = 1) -> list[tuple]:
    """``n`` rows of prose, then null, empty and blank texts, copies, repeated rows, nulls in every column, a long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        text = prose(rng, lang)
        rows.append((i, text, lang, f"s{0 if i % 2 else i % 5}", len(text)))
    rows += [
        (n, None, "en", "s0", None),
        (n + 1, "", "en", None, 0),
        (n + 2, " \t\n ", None, "s1", 4),
        (n + 3, "one", "en", "s1", 3),
        (n + 4, "... 123 !!!", "de", "s1", 11),
        (n + 5, rows[0][1], None, None, None),
        (n + 6, rows[1][1] + " tail", "en", "s2", None),
        (n + 7, prose(rng, "en", 6000), "en", "s3", None),
        rows[2],
        rows[2],
        (None, rows[3][1], "de", "s4", None),
    ]
    return rows


def frame(spark, rows, schema: str = DOCS, parts: int = 3):
    return spark.createDataFrame(rows, schema).repartition(parts)
