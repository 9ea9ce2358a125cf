import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
#: Names that operators use inside, or give to their results.
CLASHES = "id row n digest text_ score _score h key line start d1 d2 number size block kept host path label".split()


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def messy_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, copies and near copies."""
    long, base = words(4000, 1), words(120, 2).split()
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "a b c"), (7, long), (8, long),
            (9, " ".join(base)), (10, " ".join([*base[:60], "CHANGED", *base[61:]])),
            (11, "  ".join(base)), (12, " ".join(base).upper()), (None, "no id here"), (None, None),
            (15, "x" * 3000), (16, "aaaa " * 400), (17, "é" * 500 + " ü 漢字 🙂 " + "é" * 500),
            (18, words(80, 3) + "\n" + " ".join(base[:70]) + "\n" + words(30, 4)),
            (19, "mail bob@x.example.org, card 4644348398010899 and 4644.3483.9801.0899, +1 (706) 555-3138, 10.0.0.256 1.2.3.4")]
    rows += [(20 + i, words(40 + i, 50 + i)) for i in range(12)]
    rows += [(40, words(30, 60)), (40, words(30, 60)), (41, words(30, 61)), (41, words(35, 62))]
    return [(i, t, "en", None if k % 7 == 3 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def messy(spark):
    """The messy table with further columns whose names clash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in messy_rows()], schema).repartition(3)


@pytest.fixture(scope="session")
def plain():
    return [r[:2] for r in messy_rows()]
