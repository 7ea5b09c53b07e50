"""Small awkward tables for the operators of readweaver.llm."""
from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text2 string, length long, chunk string"


def awkward_texts(seed: int = 1, n: int = 60) -> list[str | None]:
    """Nulls, empty, blank, long, repeated and mixed-script texts."""
    rng = random.Random(seed)
    alphabet = list("  \n\t\x0b\x0c\r'sdtmrevl aAbB09!?é\u00a0\u3000ßΣ漢字🙂٣½\u0301İ#*$%&|<>-_=:\"/+.") + ["'s", "'RE", "  ", "\n\n", "<|endoftext|>", "the ", "and "]
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    out: list[str | None] = [None, "", " ", "\n", "x", "x", "a b c", "!" * 300, "long " * 5000, "ab" * 4000, "é" * 64, "A" * 64, "A" * 63]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(n)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    out += ["one line\nother line\none line\n\n one line", "w1 w2 w3 w4 w5 w1 w2 w3 w4 w5 w6 w7"]
    return out


def docs(spark, texts, ids=None, parts: int = 3):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1, "clash") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
