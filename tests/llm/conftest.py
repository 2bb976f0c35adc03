import random

import pytest

WORDS = ("river stone cloud lantern harbour maple winter signal copper garden mirror thunder velvet orchard "
         "pepper window castle meadow silver bridge candle forest puzzle rocket ladder basket engine violin").split()


@pytest.fixture(scope="session")
def prose():
    """A function that makes n words of text from a seed."""
    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "er", "ing", "ed"]) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents with clashing extra columns, from (doc_id, text) pairs."""
    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", -1, "x") for i, t in rows],
                                     "doc_id bigint, text string, lang string, source string, pack bigint, score string")
    return make
