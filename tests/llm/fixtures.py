"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

WORDS = "red blue green stone river cloud paper glass wind lamp ocean metal forest candle mirror".split()


def prose(seed: int, words: int) -> str:
    chance = random.Random(seed)
    return " ".join(chance.choice(WORDS) + str(chance.randrange(40)) for _ in range(words))


def documents(spark, rows):
    """Rows ``(doc_id, text)`` with columns whose names the operators use themselves."""
    full = [(i, t, "en", f"src{k % 3}", len(t or ""), k, None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fingerprint long, tag string")
