import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, oid long, token string, _row string, h string"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=5):
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, blanks, one very long text."""
    rng = random.Random(seed)
    rows = []
    passage = sentence(rng, 60)
    for k in range(40):
        rows.append((k, f"{sentence(rng, rng.randrange(5, 90))}\n{sentence(rng, 12)}\n{sentence(rng, 9)}", rng.choice(["en", "fr", None]), f"s{k % 3}"))
    for k in range(40, 60):
        rows.append((k, f"{sentence(rng, rng.randrange(0, 30))} {passage} {sentence(rng, rng.randrange(0, 30))}", "en", "s0"))
    base = sentence(rng, 120).split()
    for k in range(60, 90):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(words), "fr", None))
    rows += [(90 + k, rows[60][1].replace(" ", "  "), "en", "s1") for k in range(5)]
    rows += [(100, None, "en", "s1"), (101, "", None, None), (102, " \n\t ", "en", "s2"), (103, "...", "en", "s2"), (None, "no id here at all", "en", "s2"), (None, None, None, None)]
    rows += [(104, " ".join(["again"] * 500), "en", "s9"), (105, sentence(rng, 12_000, 50_000), "en", "s1"), (106, "é" * 3000 + " " + "é" * 900, "fr", "s1")]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, "t", "r", "h") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
