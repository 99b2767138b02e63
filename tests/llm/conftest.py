import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    """Random texts of distinct-looking words, by seed and length."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Documents that are null, empty, blank, short, very long, tied and repeated, with a null id and with
    columns whose names operators use themselves."""
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one TWO"), (6, prose(1, 300)), (7, prose(1, 300)), (7, prose(1, 300)),
        (8, prose(2, 40_000)), (None, prose(3, 50)), (None, None), (9, "naïve ＡＢＣ 你好 🙂  two  spaces <|endoftext|> end"), (10, prose(4, 5)),
        (11, prose(1, 299) + " changed"), (12, prose(5, 80)), (12, prose(6, 80)),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, held_out string, key string, words int"
    return spark.createDataFrame([(i, t, "en", None, None, None, "x", "k", 1) for i, t in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
