from __future__ import annotations

import random

import pytest

WORDS = "the of and river stone light under over garden winter summer letter music paper window silver copper yellow orange distant quiet market".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    words = [rnd.choice(WORDS) + rnd.choice(["", "", "", "s", "ing", "ed", ","]) for _ in range(n)]
    return " ".join(words).capitalize() + "."


#: Columns whose names operators use inside.
CLASHING = "row string, body string, node long, h long, who string, dk long, label string, part int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, null and repeated ids, extra columns with clashing names."""
    passage = prose(99, 60)
    texts = [
        (1, prose(1, 80)), (2, prose(1, 80)), (3, prose(2, 50)), (3, prose(3, 50)), (4, None), (5, ""), (6, "  \n\t "), (None, prose(4, 40)), (None, None),
        (7, "One"), (8, "one"), (9, prose(5, 20_000)), (10, prose(6, 30) + "\n" + passage), (11, passage + " " + prose(7, 30)), (12, prose(8, 70)), (12, prose(8, 70)), (13, "é ü ß 你好 \u00a0 x\u2003y 🎉🎉"),
    ]
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 2}", None, "r", None, k, k, None, k, "l", 0) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def components(n: int, linked) -> list[int]:
    """Brute force: for each of 0..n-1 the smallest index reachable over ``linked(i, j)``."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
