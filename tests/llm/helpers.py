"""Small fixtures for the tests of the llm package."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def documents(spark, texts, first_id: int = 0):
    """A documents table of the given texts (None stays null)."""
    rows = [(first_id + k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "and", "of"]) if rng.random() < 0.2 else
                    rng.choice(["stone", "river", "light", "walk", "green"]) + rng.choice(["", "er", "ing", "s"])
                    + str(rng.randrange(60)) for _ in range(n))


def changed(text: str, times: int, seed: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)
