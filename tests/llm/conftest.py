import random

import pytest

from wattlane.session import ship_package

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with exact and near copies, shared passages, short,
    empty, null, long and oddly spaced texts, and repeated rows."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(30, 120)) for _ in range(40)]
    passage = words(rng, 45)
    rows = list(enumerate(base))
    for i in range(40):
        w = base[i % 5].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((100 + i, "  ".join(w) if i % 3 else "\n".join(w)))
    for i in range(30):
        rows.append((200 + i, words(rng, 20) + " " + passage + "\t" + words(rng, i)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "ONE"), (305, "One two three"), (306, "one TWO three"),
             (307, "a " * 500), (308, "a " * 3000), (309, "x"), (310, "x" * 20000), (311, "É e é E"), (312, "a\u00a0b c\u2003d e f g")]
    rows += [(rows[0][0], rows[0][1]), (400, base[7] + " " + base[7])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with clashing extra columns and nulls in all columns."""
    rows = [(i, t, "en", f"s{i % 3}", 0, 1.0, "p", "k", 5) for i, t in corpus] + [(None, "no id " * 30, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA + ", score double, pack string, key string, n_tokens int").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
