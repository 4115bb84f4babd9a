"""Runs against a comparison of all periods at all places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ibex.llm import periodic_runs as pr

from .oracle_read import SF_SMALL, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = "doc_id long, text string"


def runs_of(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period), every period compared over the whole text."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.array([codes[x] for x in words], dtype=np.int64)
    best = {}
    for q in range(1, len(w) // 4 + 1):
        differ = np.flatnonzero(w[q:] != w[:-q])
        bounds = np.concatenate(([-1], differ, [len(w) - q]))
        for k in np.flatnonzero(np.diff(bounds) - 1 + q >= max(6, 4 * q)):
            start, length = int(bounds[k]) + 1, int(bounds[k + 1] - bounds[k]) - 1 + q
            best.setdefault((start, length), q)  # periods come in order: the smallest stays
    return sorted((s, n, q) for (s, n), q in best.items())


def collapsed(words: list[str], runs) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(got, texts) -> int:
    rows = sorted((r.id is not None, r.id, r.collapsed_sha256, r) for r in got.collect())
    assert len(rows) == len(texts)
    found = 0
    by = {r[1]: r[3] for r in rows}
    for i, text in texts:
        words = WORD.findall(text or "")
        runs = runs_of(words)
        found += len(runs)
        r = by[i]
        assert r.n_words == len(words)
        assert [(x.start, x.length, x.period) for x in r.runs] == runs, i
        kept = collapsed(words, runs)
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        if "collapsed" in got.columns:
            assert r.collapsed == kept
    return found


def made(rng: random.Random) -> str:
    """Words of a small alphabet, with stretches that repeat."""
    letters = rng.choice(["ab", "abc", "abcdefgh", "éü漢x"])
    out = []
    while len(out) < rng.randint(0, 260):
        unit = rng.choices(letters, k=rng.randint(1, 13))
        out += (unit * 9)[:rng.randint(1, 5 * len(unit) + 3)]
        out += rng.choices(letters, k=rng.randint(0, 4))
    return rng.choice([" ", "\n", " \t"]).join(out)


def test_random_texts(spark):
    rng = random.Random(8)
    texts = [(i, made(rng)) for i in range(400)]
    frame = spark.createDataFrame(texts, TEXTS).repartition(4)
    assert check(pr.periodic_runs(frame, batch_bytes=3000), texts) > 300
    assert check(pr.periodic_runs(frame, keep_text=False), texts) > 300


def test_tiles_of_every_scale(spark):
    """Runs that cross many tiles, of one-word and of very long periods."""
    rng = random.Random(3)
    long = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(3000)]
    texts = [(0, " ".join(long[:2500] * 5)), (1, " ".join(["w"] * 9000)), (2, " ".join((long[:700] * 6)[:3333] + ["x"] + long[:64] * 40)),
             (3, " ".join(long)), (4, " ".join(["a", "b", "c"] * 3000 + ["a", "c"] * 2000)), (5, " ".join(long[:1024] * 4)),
             (6, " ".join((long[:1024] * 4)[:-1])), (7, " ".join(["z"] + long[:1023] * 4 + ["z"]))]
    assert check(pr.periodic_runs(spark.createDataFrame(texts, TEXTS)), texts) == 8


def test_small_tiles_are_stitched():
    """The same fragments, stitched by hand, whatever the tile's size."""
    rng = random.Random(5)
    words = np.array([rng.randint(0, 2) for _ in range(40)] * 12 + [5] * 90 + [1, 2, 3] * 50)
    first = np.array([0, len(words)])
    for size in (1, 7, 64, 4096):
        spans = {}
        old, pr.TILE_WORDS = pr.TILE_WORDS, size
        try:
            for _, octave, at, w, picks in pr._tiles(words, first):
                for p, a, z in pr.solve(octave, w.tolist(), picks.tolist()):
                    spans.setdefault(p, []).append((a + at, z + at))
        finally:
            pr.TILE_WORDS = old
        got = set()
        for p, s in spans.items():
            s.sort()
            lo, hi = s[0]
            for a, z in [*s[1:], (10**9, 10**9)]:
                if a <= hi:
                    hi = max(hi, z)
                    continue
                if hi - lo + p >= max(6, 4 * p):
                    got.add((lo, hi - lo + p, p))
                lo, hi = a, z
        least = {}
        for s, n, p in got:
            least[s, n] = min(p, least.get((s, n), p))
        assert sorted((s, n, p) for (s, n), p in least.items()) == runs_of([str(x) for x in words])


def test_odd_rows_null_ids_and_empty_tables(spark, odd, rows, no_ids, nothing):
    check(pr.periodic_runs(odd), [(r[0], r[1]) for r in rows])
    assert pr.periodic_runs(nothing).collect() == []
    many = " ".join(["again and"] * 20)
    got = pr.periodic_runs(no_ids.union(spark.createDataFrame([(None, many), (7, many)], TEXTS))).collect()
    assert len(got) == 9 and sum(len(r.runs) for r in got) == 2
    assert sorted(r.collapsed for r in got if r.runs) == ["again and"] * 2


def test_strongest_run_breaks_ties_by_start_then_period(spark):
    kind = "array<struct<start:long,length:long,period:long>>"
    frame = spark.createDataFrame([(0, []), (1, [(0, 8, 2), (9, 4, 1), (20, 12, 3)]), (2, [(3, 9, 2), (3, 13, 3)]),
                                   (3, [(5, 12, 3), (5, 16, 4), (30, 9, 2)])], f"i int, runs {kind}")
    got = {r.i: r.b for r in frame.select("i", pr.strongest(F.col("runs")).alias("b")).collect()}
    assert got[0] is None and got[1].start == 0 and got[2].period == 2 and got[3].start == 30


def planted(i: int, text: str | None) -> list[str]:
    words = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    return words


@pytest.mark.parametrize("folder", [SF_SMALL])
def test_registered_query(spark, folder):
    from ibex.llm.queries import QUERIES

    texts = dict(documents(folder))
    got = QUERIES["op12_periodic_runs"](spark, folder).collect()
    assert len(got) == len(texts)
    some = 0
    for r in got:
        words = planted(r.doc_id, texts[r.doc_id])
        runs = runs_of(words)
        some += bool(runs)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == want
    assert some > 5
