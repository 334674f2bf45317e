import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, frag int, kept boolean, word string, part string, _host string, cls long"


def words(rng, n, base=4000):
    return [f"w{int(base * rng.random() ** 3)}" for _ in range(n)]


def small_corpus():
    """Prose with copies, near copies, shared passages and shared lines, and rows of every odd kind."""
    rng = random.Random(11)
    out = []
    passage = " ".join(words(rng, 90))
    line = "All rights reserved to nobody."
    for k in range(60):
        body = [" ".join(words(rng, rng.randrange(5, 40))) + "." for _ in range(rng.randrange(1, 8))]
        if k % 5 == 0:
            body.insert(rng.randrange(len(body) + 1), passage)
        if k % 3 == 0:
            body.append(line)
        out.append("\n".join(body))
    for k in range(20):  # near copies
        w = out[k % 7].split(" ")
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    out += [out[3], out[3], out[3], out[8]]
    out += [None, "", " \n\t ", "one", "two words", "ab" * 900, "xyz " * 700, "é ü 漢字 ß x", "#### || $$ " * 40, "1234 5678", "a\x1cb c", passage, "long " + " ".join(words(rng, 30000))]
    langs = ["en", "fr", None, "de"]
    rows = [(i, t, langs[i % 4], f"s{i % 3}" if i % 10 else None, len(t or "")) for i, t in enumerate(out)]
    rows += [rows[5], (None, out[2], "en", "s0", 1), (None, None, None, None, None)]
    return [(*r, 1, 2, True, "w", "p", "h", 3) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return small_corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
