import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th string, spans string"


def prose(r, n):
    return " ".join(r.choice("the of and to in is rain wind stone river quick brown deep light house garden table winter summer north".split()) + r.choice(("", "", "", "s", "ed")) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Copies exact and near, shared passages and lines, empty, null and long texts, ties and odd characters."""
    r = random.Random(5)
    base, passage = prose(r, 120), prose(r, 90)
    out = [prose(r, r.randint(1, 200)) for _ in range(40)]
    out += [base, base, base.replace("river", "lake", 1), base + " end", base.upper(), passage + "\n" + prose(r, 60), prose(r, 70) + " " + passage, passage, passage[:399], passage[:410]]
    out += ["", None, " \n\t\n", "one", "one", "a b c d", "A B C d", "a b c d e", "line one is long enough\nshort\nLine One is long enough \nother", "x\nline one is long enough", "x\nx\nx", "\x0bLINE one is long enough\x0c\n" * 3]
    out += ["ab" * 900, "x" * 1500, "é" * 500, "é" * 500 + "z", "#*$%&|<> " * 30, prose(r, 3000), "\n".join(prose(r, 8) for _ in range(300))]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    """(doc_id, text): with a repeated row, a repeated id and null ids."""
    out = list(enumerate(texts))
    return out + [out[0], (3, "another text of a repeated id that is long enough"), (None, texts[40]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    r = random.Random(1)
    langs, sources = ("en", "de", None), ("a", "b", None)
    full = [(i, t, r.choice(langs), r.choice(sources), len(t or ""), 7, "th", "s") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
