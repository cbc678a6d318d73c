import random

import pytest

WORDS = "the of and to in that was with river stone light paper green windy field mirror copper garden valley thunder silver".split()
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, piece int, row long, node long, token long, block long, bucket int, label string, score double"


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) + (draw.choice(WORDS) if draw.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(id, text): nulls, empty and odd texts, copies and near copies, one very long text."""
    draw = random.Random(5)
    rows = [(k, sentence(draw, draw.randint(12, 120))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "One"), (105, "a\x1cb  é́ ﬁ <|endoftext|> it's 12,5!? \x85x y"), (None, "no id at all here")]
    base = sentence(draw, 200).split()
    rows += [(200 + k, " ".join(base)) for k in range(4)]
    for k in range(12):
        words = list(base)
        for _ in range(k):
            words[draw.randrange(200)] = f"x{draw.random()}"
        rows.append((300 + k, " ".join(words)))
    rows += [(3, rows[3][1]), (7, "another text with a used id")]
    rows.append((400, sentence(draw, 30_000)))
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents with columns whose names operators use themselves."""
    rows = [(i, t, "en", "src", len(t or ""), 1, 2, 3, 4, 5, 6, "x", 0.5) for i, t in texts]
    return spark.createDataFrame(rows, CLASHING).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], CLASHING)
