import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}x{draw.randrange(9)}" for _ in range(n))


@pytest.fixture
def make(spark):
    """A documents table from (doc_id, text) or full rows."""

    def build(rows, schema=DOCS, parts=3):
        full = [tuple(r) + ("en", "a", None)[len(r) - 2 :] if len(r) < 5 and schema == DOCS else tuple(r) for r in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return build


#: What real tables hold besides plain texts.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one two three four five six"),
    (None, None), (6, "é ü 日本 \U0001f600 " * 30), (7, words(7, 6000)), (8, "a" * 3000), (9, "x y " * 800),
]
