import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, label int, spans string, salt int, token string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def made(n=40, seed=0):
    """(doc_id, text, lang, source): copies, near copies, shared passages, blank and null texts, one very long text."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(k))
    passage, base = prose(30), prose(120).split()
    texts = [None, "", " \n\t ", "one", "one two three four", "one two three four", "ONE two three four", prose(20000), prose(20), "café \U0001f600 naïve   x " * 7]
    texts += [" ".join(base)] * 3
    for k in range(6):
        near = list(base)
        near[10 + k * 15] = f"changed{k}"
        texts.append(" ".join(near))
    texts += [f"{prose(15)} {passage} {prose(15)}" for _ in range(6)]
    texts.append(f"{passage} {passage}")
    texts += [prose(rng.randint(1, 80)) for _ in range(n - len(texts))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3, texts[k], rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with further columns, whose names operators use themselves."""
    full = [(i, t, g, s, len(t or ""), 1, 2, "x", 3, "y") for i, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
