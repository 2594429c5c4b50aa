"""Small document tables with the edge cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WIDE = SCHEMA + ", id long, val string, shard int, size string, _src string"


def words(rng: random.Random, n: int, vocabulary: int = 300) -> list[str]:
    return [f"w{int(vocabulary * rng.random() ** 2)}x" for _ in range(n)]


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    out: list[str | None] = []
    for i in range(n):
        own = words(rng, rng.choice([0, 1, 2, 3, 8, 40, 120, 400]))
        body = " ".join(own)
        if i % 5 == 1:
            body = f"{body}\n{passage} end{i}"
        if i % 7 == 2 and out and out[-1]:
            body = out[-1]  # exact copy
        if i % 11 == 3 and out and out[-1] and len(out[-1].split()) > 30:
            near = out[-1].split()
            near[len(near) // 2] = f"edit{i}"
            body = " ".join(near)
        out.append(body)
    long_ = " ".join(words(rng, 6000))
    return [*out, None, "", "   \n\t", "Été À la über x " * 30, "ab" * 400, "a" * 3000, "rep eat " * 200, long_, long_, "A B\vC\fD"]


def documents(spark, seed: int = 1, n: int = 60, wide: bool = False):
    """Texts with ties, copies, null and empty ones, null sources and languages; ids are unique (see odd_rows for others)."""
    rows = []
    for i, t in enumerate(texts(seed, n)):
        rows.append((i * 3, t, [None, "en", "fr"][i % 3], [None, "s0", "s0", "s0", "s1", "s2"][i % 6], None if t is None else len(t)))
    if not wide:
        return spark.createDataFrame(rows, SCHEMA)
    return spark.createDataFrame([(*r, 1, "v", 7, "z", "q") for r in rows], WIDE)


def odd_rows(seed: int = 4, n: int = 24) -> list[tuple]:
    """Rows with repeated rows, one id on different texts, and several null ids, with equal and other texts."""
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s0", "s1"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts(seed, n))]
    rows += [rows[5], rows[5], (5, rows[8][1], "en", "s0", 1), (5, "other words " * 40, "en", "s0", 1), (6, None, None, None, None)]
    return rows + [(None, rows[9][1], "en", "s0", 1), (None, rows[9][1], "en", "s0", 1), (None, "quite other words here " * 30, "fr", None, 1), (None, None, None, None, None)]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
