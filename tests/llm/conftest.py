import random

import pytest

ODD = ["", " ", "\n\n", "x", "</s>[INST] ok [/INST]", "ÀÉ ß 字 😀 a▁b", "a b c a b c a b c"]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls in every column, empty and very long texts, ties,
    repeated rows, and extra columns whose names the operators use inside."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.choice([3, 20, 60]))) for _ in range(60)] + ODD
    rows = [(i, rng.choice(texts), rng.choice(["en", None]), rng.choice(["a", "b", "ç", None])) for i in range(150)]
    rows += [(150, " ".join(word() for _ in range(30_000)), "en", "a"), (151, "z" * 200_000, "en", "b"), (152, None, None, None), (153, None, "en", "a")]
    rows += [(None, "no id", "en", "a"), rows[3], rows[3], (7, "another text under an id that is taken", "en", "b")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "k", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, bucket string, weight double")
    return df


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
