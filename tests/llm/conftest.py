import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns with the names that operators use inside.
CLASHING = "doc_id bigint, text string, blk int, n int, hash bigint, words string, keys int, node string, span string, label string, ids string, key string, at int, score string"


def rows(texts, first=0):
    return [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    def make(texts, ids=None):
        own = [(i, t, None, None, None) for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(own, SCHEMA)

    return make


@pytest.fixture(scope="session")
def clashing(spark):
    def clashing(texts):
        return spark.createDataFrame([(i, t, *[None] * 12) for i, t in enumerate(texts)], CLASHING)

    return clashing


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, no ASCII, repeated rows, near copies, a very long text and shared passages."""
    rng = random.Random(4)
    vocabulary = ["ala", "Béta", "gam-ma", "the", "of", "日本", "x1", "Θ", "end.", "zz"]
    word = lambda: rng.choice(vocabulary) + rng.choice(["", "", rng.choice(vocabulary)])
    passage = [word() for _ in range(40)]
    texts = [None, "", "  \t\n ", "日本 日本", "one", "a\x0bb\x0cc\rd", "!!! ...", "a b c"]
    base = [word() for _ in range(120)]
    for k in range(8):
        near = list(base)
        near[rng.randrange(120)] = "edit%d" % k
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 3
    for _ in range(6):
        own = [word() for _ in range(rng.randrange(1, 90))]
        own[rng.randrange(len(own)) : 0] = passage[rng.randrange(10) : rng.randrange(20, 40)]
        texts.append(rng.choice([" ", "\n", "  "]).join(own))
    texts.append(" ".join(word() for _ in range(30_000)))
    texts.append(" ".join(["same"] * 300))
    return texts
