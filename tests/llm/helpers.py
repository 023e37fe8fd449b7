"""Small inputs and plain-Python references shared by the tests of the training-data operators."""

from __future__ import annotations

import random
import re

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
# names that the operators use inside, to show that a clash does no harm
CLASHES = ["id", "node", "key", "label", "size", "s", "rest", "task", "score", "start", "words", "own", "path", "u", "v", "value", "before"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(ASCII_LOWER) if lower else text)


def shingles(text, k, short=True):
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w and short else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def docs_df(spark, rows):
    """rows of (doc_id, text[, lang, source, n_chars])."""
    full = []
    for r in rows:
        r = tuple(r) + ("en", "src", 0)[len(r) - 2:]
        full.append((*r, *["x"] * len(CLASHES)))
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


def near_copies(seed=1, groups=6, size=7):
    """(id, text) with near copies whose similarity lies on both sides of 0.8, exact copies and odd texts."""
    rng = random.Random(seed)
    rows, k = [], 0
    for g in range(groups):
        base = prose(rng, rng.choice([30, 120, 600]), 5000).split()
        for i in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8, 16]) * len(w) // 150 + (i > 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \n\t"), (k + 3, "one"), (k + 4, "One"), (k + 5, "two words"), (None, rows[0][1]), (None, None),
             (k + 6, " ".join(["again"] * 3000)), (k + 7, "AGAIN again Again again"), (3, rows[3][1]), (k + 8, prose(rng, 9000, 300))]
    return rows
