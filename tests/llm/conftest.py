from __future__ import annotations

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, size int, kept string"
CLASHING = ("k", 1, "x")


def sentence(rng: random.Random, words: int) -> str:
    return " ".join(
        "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)
    )


def corpus() -> list[tuple]:
    """Texts with nulls, empties, copies, near copies, shared passages, long and odd ones."""
    rng = random.Random(5)
    passage = sentence(rng, 60)
    common = "All rights reserved by the people of this page."
    rows = []
    for i in range(60):
        body = "\n".join(sentence(rng, rng.randint(3, 30)) + "." for _ in range(rng.randint(1, 6)))
        if i % 4 == 0:
            body = common + "\n" + body
        if i % 7 == 0:
            body += " " + passage + " " + sentence(rng, 5)
        rows.append((i, body))
    rows += [(100 + i, rows[i][1]) for i in range(12)]  # copies
    for i in range(12):  # near copies: one word changed
        words = rows[20 + i][1].split(" ")
        words[len(words) // 2] = f"changed{i}"
        rows.append((200 + i, " ".join(words)))
    long = "\n".join(sentence(rng, 12) for _ in range(2500))
    rows += [
        (300, None), (301, ""), (302, " "), (303, "\n\n"), (304, "one"), (305, "two words"), (306, "one"),
        (307, "日本語のテキスト  ▁ and é ﬁ\t\r\nnext"), (308, "a" * 3000), (309, "ab " * 800), (310, long), (311, long),
        (312, "x" * 49), (313, "x" * 50), (314, "x" * 50), (315, "UPPER lower MiXed case here"),
        (316, "upper LOWER mixed CASE here"), (None, rows[3][1]), (None, "text without an id"), (5, rows[5][1]),
        (6, "the same id with another text"),
    ]
    return [
        (i, t, "en", ("src0" if n % 3 else None) if n % 5 else f"src{n % 4}", len(t or ""), *CLASHING)
        for n, (i, t) in enumerate(rows)
    ]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
