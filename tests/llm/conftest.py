import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, kept boolean, score double, doc long, copy long, runs string, n long"


def make_texts() -> list:
    """Texts with exact and near copies, shared passages, repeats within a text, odd characters and odd lengths."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(70)
    base = prose(200)
    texts = [None, "", " ", "\t\n", "one", "One", "two words", "a b c d e", "A B c d E", "x" * 3000, "ab" * 400, prose(3000), "\x00nul\x00 byte", "日本語 テキスト 👍🏽 é", "▁ literal  two   spaces ", "<s> </s> <|endoftext|> it's 'S 12.5,x"]
    texts += [base, base.upper(), base.replace(" ", "  "), base + " tail"]
    for _ in range(12):
        w = base.split()
        for k in rng.sample(range(len(w)), 2):
            w[k] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [prose(40) + " " + passage + " " + prose(30) for _ in range(5)]
    texts += [passage + " " + passage, prose(120) + "\n" + prose(120), "line\n" * 80]
    texts += [prose(rng.randint(1, 120)) for _ in range(30)]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Extra columns clash with names that operators use; ids are shuffled."""
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = [(t, d, "en" if d % 3 else None, "s", len(t or ""), True, 0.5, 7, 7, "r", 1) for t, d in zip(texts, ids, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, one id for two texts."""
    long = "lorem ipsum dolor sit amet " * 30
    rows = [(long, None, None, None, None, None, None, None, None, None, None)] * 2 + [(long, 5, "en", "s", 1, True, 0.0, 1, 1, "", 1)] * 2 + [("other " + long, 5, "en", "s", 1, True, 0.0, 1, 1, "", 1), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
