import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Null and empty texts, a null id, copies, near copies, shared passages, a long text, odd white space and signs."""
    passage = words(99, 40)
    base = words(1, 120)
    out = [
        (1, base), (2, base), (3, base.replace(base.split()[60], "changed", 1)), (4, None), (5, ""), (6, " \n\t "), (7, words(2, 3)),
        (8, words(3, 80) + " " + passage + " " + words(4, 80)), (9, words(5, 60) + " " + passage), (10, passage + "\n" + words(6, 70)),
        (11, "a" * 450), (12, "Ünï cödé 你好 " * 30), (13, "x " * 3000), (14, words(7, 4000)), (15, "A  B▁ c <|endoftext|>  d\n e "),
        (None, words(8, 55)), (16, base + " " + words(9, 30)), (17, "tail " + words(10, 300)),
    ]
    return [(i, t, "en" if (i or 0) % 3 else None, "src0" if (i or 0) % 2 else None, len(t or "")) for i, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def many(spark):
    """A few hundred documents with copies, near copies and passages, for brute force."""
    rng = random.Random(4)
    texts = [words(100 + i, rng.randint(20, 120)) for i in range(120)]
    for i in range(60):
        t = texts[rng.randrange(len(texts))].split(" ")
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = "swap"
        texts.append(" ".join(t))
    for i in range(60):
        a = texts[rng.randrange(120)]
        texts.append(words(900 + i, 20) + " " + a[rng.randrange(40) :] + " " + words(800 + i, 10))
    rng.shuffle(texts)
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(4)
