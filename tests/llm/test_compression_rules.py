"""Counts against brute force; bands against texts made for them."""

from __future__ import annotations

import random
import re

import pytest

from ibex.llm.compression_rules import COUNTS, Bands, quality_rules

from .conftest import SCHEMA, _sentence
from .oracle_read import SF_SMALL, documents

WORD = r"[^\x20\x09-\x0D]+"


def base_of(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(WORD, text)
    seen, where = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            where |= {i + k for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(where))


def failed(base: tuple) -> bool:
    return base[0] < 10 or 100 * base[4] > 20 * base[0]


def check(frame, rows) -> dict:
    got = {r.id: r for r in frame.collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base = base_of(text)
        assert tuple(got[i][c] for c in COUNTS) == base, (i, text and text[:80])
        assert got[i].base_failed == failed(base)
        assert got[i].kept == (got[i].reason is None) and not (got[i].kept and got[i].base_failed)
    return got


def test_odd_rows(odd, rows):
    check(quality_rules(odd), [(r[0], r[1]) for r in rows])


def test_random_texts_in_small_slices(spark):
    rng = random.Random(4)
    bits = ["a", "b", "é", "漢", "\n", "\n", " ", "\t", "#", "x|y", "\r\n", "\x0b", " ", " "]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choices(bits, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, "".join(rng.choices(bits, k=rng.randint(0, 60)))) for i in range(300)]
    check(quality_rules(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batch_bytes=200), rows)


def test_registered_query(spark):
    from ibex.llm.queries import QUERIES


    got = QUERIES["op11_compression_rules"](spark, SF_SMALL)
    assert got.columns[:8] == ["doc_id", *COUNTS, "base_failed", "kept"]
    check(got.withColumnRenamed("doc_id", "id"), documents(SF_SMALL))


def test_bands(spark):
    rng = random.Random(9)
    prose = [_sentence(1000 + i, n) for i, n in enumerate((12, 40, 200, 900, 4000))]
    noise = " ".join("".join(rng.choices("".join(map(chr, range(33, 127))), k=9)) for _ in range(600))
    sandwich = _sentence(77, 1500) + " " + "ab" * 9000 + " " + _sentence(78, 1500)
    texts = [*prose, noise, sandwich]
    got = {r.id: r for r in quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i].kept for i in range(len(prose)))
    assert got[5].reason == "incompressible" and not got[5].base_failed
    # no window of five words comes twice in it: only its chunks tell
    assert got[6].reason == "repetitive" and not got[6].base_failed and got[6].n_low_chunks >= 4
    # limits follow the length: the same words fail under narrower bands only
    narrow = Bands(whole=((128, 0.6, 1.1), (4096, 0.01, 1.0)), chunk=((4096, 0.0, 1.0),))
    tight = {r.id: r.reason for r in quality_rules(spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string"), bands=narrow).collect()}
    assert tight[2] == "repetitive" and tight[4] is None


def test_null_ids_empty_table_and_parameters(spark, no_ids, nothing):
    assert quality_rules(no_ids).count() == 7
    assert quality_rules(nothing).collect() == []
    assert quality_rules(spark.createDataFrame([], SCHEMA)).columns[0] == "id"
    with pytest.raises(ValueError):
        Bands(whole=((512, 0.1, 1.0), (128, 0.1, 1.0)))
    with pytest.raises(ValueError):
        Bands(chunk_bytes=0)


def test_one_very_long_text(spark):
    text = " ".join(_sentence(i, 500) for i in range(400))
    check(quality_rules(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")), [(1, text), (2, "a b")])
