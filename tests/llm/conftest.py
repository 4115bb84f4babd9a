"""Small tables for the training-text operators: ordinary cases and odd ones."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, id string, bucket string, n string, v string"


def _sentence(seed: int, n: int) -> str:
    """Invented words, the same for a seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join("bcdfgklmnprst"[(x >> s) % 13] + "aeiou"[(x >> (s + 3)) % 5] for s in (4, 9, 14)))
    return " ".join(out)


def odd_rows() -> list[tuple]:
    """Null, empty and white-space texts, ties, copies, near copies, a long
    text, accents; columns that clash with the operators' own names."""
    base = _sentence(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    shared = _sentence(2, 45)
    long = " ".join(_sentence(100 + i, 200) for i in range(60))
    texts = [
        base, base, base.replace(" ", "\t \n"), near, base + " tail", base.upper(),
        _sentence(3, 40) + " " + shared + " " + _sentence(4, 30), _sentence(5, 20) + "\n" + shared, shared + " end",
        None, "", " \t\n ", "one", "one", "one two three four", "a b c d e", "é ü ñ 漢字 🙂 " * 30, "é ü ñ 漢字 🙂 " * 30,
        long, long + " x", "same " * 300, "same " * 200, "x" * 5000, "x" * 99, "x" * 100, "x" * 101,
        _sentence(6, 300), _sentence(7, 34), _sentence(8, 35), _sentence(8, 35) + " " + _sentence(8, 35),
    ]
    return [(i * 3 + 5, t, None if i % 4 else "en", "id", "b", None, "v") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_ids(spark):
    """Null and repeated ids."""
    a = _sentence(1, 80)
    return spark.createDataFrame([(None, a), (None, a), (7, a), (7, a), (7, "other"), (None, None), (9, "other")],
                                 "doc_id long, text string")


def texts_of(rows) -> dict[int, str]:
    return {r[0]: r[1] or "" for r in rows}
