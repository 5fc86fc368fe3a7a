import random

import pytest

WORDS = [a + b + c for a in "kmst" for b in "aeio" for c in "nrlx"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (id, text) with copies, near copies, shared passages, odd texts, nulls and repeats."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 260)) for _ in range(60)]
    passage = " ".join(rng.choice(WORDS) for _ in range(70))
    texts = list(base)
    texts += [base[0]] * 30 + [base[1].upper(), base[1]]
    for b in base[2:8]:
        for _ in range(12):
            words = b.split(" ")
            for _ in range(rng.randint(1, 9)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 30)}" for _ in range(25)]
    texts += [None, "", " \n\t ", "one", "one two", "ONE TWO", "a b c d", "a b c d e", "é\x0bÉ 日本 " * 20, "x" * 5000, "w " * 3000, "a\x1cb\x85c  d"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [rows[3], rows[3], (None, base[0]), (None, "alone here")]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as documents, with extra columns of clashing names."""
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in corpus], SCHEMA).repartition(5)
    return df.selectExpr("*", "1 AS key", "2 AS id", "'x' AS kept", "3 AS value", "4 AS bucket", "5 AS sha", "6 AS lost", "7 AS again", "8 AS __id", "9 AS __hot", "10 AS lost_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
