import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, edge cases and repeated rows."""
    rng = random.Random(7)
    out = []

    def add(text, source=None):
        out.append((len(out), text, "en", source if source is not None else f"s{len(out) % 5}", len(text or "")))

    passage = " ".join(words(rng, 60))
    for _ in range(12):
        add(" ".join(words(rng, rng.randint(60, 300))))
    base = words(rng, 200)
    for k in range(12):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = f"edit{rng.randrange(1000)}"
        add(" ".join(near))
    for _ in range(6):
        add(" ".join(base))
    for _ in range(8):
        add(" ".join([*words(rng, 40), passage, *words(rng, 50)]), "hot")
    for n in (1, 2, 3, 4, 5, 6, 7, 9, 14, 30, 48, 49, 52, 64, 66):
        short = words(rng, n)
        add(" ".join(short))
        add(" ".join([*short[:-1], "changed"]))
        add(" ".join([*short, "more"]))
    for text in (None, "", "   \n\t ", "été \U0001f600 ß", "a" * 130, "x\x00y " * 30, "- - -\n- - -\n", "LONG " * 4000):
        add(text)
    out.append(out[3])
    out.append((None, base and " ".join(base), "en", None, 1))
    out.append((None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    # columns whose names clash with the operators' own
    return spark.createDataFrame(rows, DOCUMENTS).withColumns({c: F.lit(1) for c in ("size", "words", "shard", "bucket", "n", "spans", "key")}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
