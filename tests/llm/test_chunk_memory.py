"""What a worker remembers of chunks is bounded in bytes."""

from __future__ import annotations

from ibex.llm import textbytes as tb
from ibex.llm.chunks import Memory


def test_values_are_right_and_the_size_bounded():
    memory, asked = Memory(limit=50_000), []

    def solve(chunks):
        asked.extend(chunks)
        return [c.upper().encode() for c in chunks]

    for k in range(200):
        distinct = [f"common{i}" for i in range(20)] + [f"w{k}x{i}" for i in range(30)]
        assert memory.of(distinct, solve) == [c.upper().encode() for c in distinct]
        assert len(memory.young) + len(memory.old) < 700
    # chunks in use stay known
    assert sum(c.startswith("common") for c in asked) == 20
    memory.rest()
    assert not memory.old and memory.of(["common3"], solve) == [b"COMMON3"]


def test_long_chunks_are_solved_but_not_kept():
    memory = Memory()
    long = ["漢" * 2000 + str(i) for i in range(50)]
    assert memory.of(long + ["a"], lambda new: [(len(c), 0.0) for c in new])[0] == (2001, 0.0)
    assert list(memory.young) == ["a"]
    assert memory.of([], lambda new: []) == []


def test_trimmed_yields_what_the_work_yields():
    assert list(tb.trimmed(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3]
    tb.trim()
