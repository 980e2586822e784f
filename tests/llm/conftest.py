import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, c0 int, id string, tid int, at long, gone int, vector int"


def documents(spark, texts, *, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names the operators use themselves."""
    rows = []
    for i, text in enumerate(texts):
        doc_id = ids[i] if ids else i
        rows.append((doc_id, text, langs[i] if langs else "en", sources[i] if sources else "s", None if text is None else len(text), 1, "r", 2, "x", 3, 4, 5, 6))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda texts, **more: documents(spark, texts, **more)


@pytest.fixture
def prose():
    def make(n, seed=0, vocabulary=400):
        rng = random.Random(seed)
        names = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
        return " ".join(rng.choice(names) for _ in range(n))

    return make
