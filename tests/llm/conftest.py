import os
import random

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def prose():
    """A function: n words of invented prose, the same for the same seed."""
    def make(n, seed=0, alphabet="thereonsted"):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(n))

    return make


@pytest.fixture
def docs_of(spark):
    """Rows (doc_id, text) as a table with further columns whose names operators might use inside."""
    def make(rows):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        extra = ("id", "cut", "found", "tokens", "key", "lang", "raw", "t1", "n_bytes", "group", "size")
        return df.selectExpr("*", *(f"'x' AS {c}" for c in extra))

    return make
