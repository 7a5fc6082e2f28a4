import random

import pytest

SCHEMA = "uid string, doc_id long, text string, lang string, source string, bucket int, spans string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and further columns whose names operators use."""
    base = prose(1, 120)
    rows = [
        ("x", 5, base, "en", "src1", 1, "s"), ("x", 2, base, "en", "src2", 1, "s"), ("x", 2, base, "en", "src2", 1, "s"), (None, 3, None, None, None, None, None),
        ("x", 4, "", "de", "src3", 1, "s"), ("x", 6, " \t\n\x0b", "de", "src3", 1, "s"), ("x", None, base + " end", "fr", "src4", 1, "s"), ("x", 7, base.replace(" ", "  "), "fr", "src4", 1, "s"),
        ("x", 8, prose(2, 20000), "en", "src1", 1, "s"), ("x", 9, "one two", "en", "src1", 1, "s"), ("x", 10, "one two", None, "src1", 1, "s"), ("x", 11, "Ünï çødé " * 30, "de", "src5", 1, "s"),
        ("x", 12, prose(3, 60) + " " + base[:400] + " " + prose(4, 60), "en", "src1", 1, "s"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rng_docs(spark):
    """A few hundred random documents with exact and near copies and shared passages."""
    r = random.Random(7)
    texts = [prose(100 + i, r.randint(1, 90)) for i in range(120)]
    passage = prose(99, 55)
    for i in range(60):
        words = texts[r.randrange(120)].split()
        for _ in range(r.randint(0, 3)):
            if words:
                words[r.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    texts += [prose(500 + i, 20) + " " + passage + " " + prose(600 + i, 20) for i in range(20)]
    texts += [texts[k] for k in range(0, 60, 7)]
    rows = [("u", i, t, "en", f"src{i % 7}", 0, "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)
