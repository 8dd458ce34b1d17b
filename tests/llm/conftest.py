from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is was for on with river stone light paper window garden silver winter music market number letter mountain".split()


def prose(rng: random.Random, n: int) -> str:
    out, line = [], []
    for _ in range(n):
        line.append(rng.choice(WORDS) + rng.choice(["", "", "", "s", "er"]))
        if rng.random() < 0.05:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join([*out, " ".join(line)])


def odd_texts() -> list[tuple]:
    """(doc_id, text): nulls, empties, a very long text, repeats, ties and signs from outside the first plane."""
    rng = random.Random(11)
    base = prose(rng, 120)
    rows = [(None, "no id here"), (1, None), (2, ""), (3, "   \n\t \r\n"), (4, base), (5, base), (6, base + " end"), (7, base.replace("the", "a")), (7, base.replace("the", "a")), (8, "é𝒳😀 " * 40 + "\n" + "ABC def"), (9, "word " * 30000), (10, "x" * 70000), (11, "\n\n\n"), (12, "One line"), (13, "one LINE  "), (14, "a.b@mail.example.com +1 (269) 555-3296 4524132264652876"), (15, "<|endoftext|> 1.2.3.4")]
    return rows + [(100 + i, prose(rng, rng.randrange(1, 200))) for i in range(40)]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with further columns, some named like what operators work with inside."""
    rows = [(d, t, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 5 else None, len(t or ""), i, "z") for i, (d, t) in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int, fp string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
