import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, "en", "s0" if sources is None else sources[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, repeated, accented, very long, tabbed and upper-case texts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(vocabulary) for _ in range(60_000))
    body = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 8, 40, 90, 200)]
    return [None, "", " \n\t ", "a", "A", "a b", "Été été x", long, *body, *body[2:], body[3].upper(), body[4].replace(" ", "\t\n"), body[4] + " extra"]
