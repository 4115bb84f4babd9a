"""The trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from ibex.llm import conversation_trie as ct

from .oracle_read import SF_SMALL

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
ROWS = "conv_id long, turn long, role string, text string"


def expected(conversations: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or int(not children[node])
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[k] for k in children[node])
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(conversations[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def table(spark, conversations):
    rows = [(c, t, role, text) for c, turns in conversations.items() for t, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, ROWS).repartition(3)


def check(got, conversations):
    have = sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=lambda r: r[:2])
    assert have == expected(conversations)


def made(seed: int, n: int) -> dict[int, list[tuple[str, str]]]:
    """A few turns in many orders; a third of the conversations are one and
    the same, a third begin with one turn."""
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", ""]), "".join(rng.choices("aé漢🙂 ", k=rng.randint(0, 9)))) for _ in range(7)]
    out = {}
    for c in rng.sample(range(100_000), n):
        if c % 3 == 0:
            out[c] = turns[:5]
        else:
            out[c] = turns[:1] * (c % 3 == 1) + rng.choices(turns, k=rng.randint(1, 6))
    return out


@pytest.mark.parametrize("options", [{}, {"block_turns": 9}, {"block_turns": 1}, {"block_turns": 40, "broadcast_nodes": 0}])
def test_blocks_of_any_size(spark, options):
    conversations = made(3, 260)
    check(ct.conversation_trie(table(spark, conversations), **options), conversations)


def test_many_partitions_and_small_chunks(spark, monkeypatch):
    conversations = made(5, 200)
    monkeypatch.setattr(ct, "IDS_PER_CHUNK", 1000)
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        check(ct.conversation_trie(table(spark, conversations), block_turns=30), conversations)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_turnless_conversations_and_one_long(spark):
    long = [("user", f"t{i % 50}") for i in range(3000)]
    conversations = {5: [], 3: [], 9: long, 11: long[:2999], 12: [("user", "x")]}
    paths = ct.turn_paths(table(spark, conversations))
    paths = paths.unionByName(spark.createDataFrame([(5,), (3,)], "conv long").selectExpr(
        "conv", "array() as path").withColumn("path", F.col("path").cast(paths.schema["path"].dataType)))
    check(ct.trie_nodes(paths, block_turns=1000), conversations)
    only = paths.where("conv in (3, 5)")
    check(ct.trie_nodes(only), {3: [], 5: []})


def test_nulls_ties_repeated_rows_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, "b"), (1, 1, "x", None), (None, 0, "user", "nobody"), (None, 1, "user", "nobody"),
            (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 0, "user", "b"), (3, 0, "user", "a"), (4, 0, "user", "a"), (4, 0, "user", "b")]
    frame = spark.createDataFrame([(*r, "s", 1, "p") for r in rows], ROWS + ", shared string, n int, path string")
    tie = sorted([("user", "a"), ("user", "b")], key=lambda t: hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest())
    check(ct.conversation_trie(frame), {1: [("user", "first"), ("", "b"), ("x", "")], 2: [("user", "same")] * 2, 3: tie, 4: tie})
    assert ct.conversation_trie(frame.limit(0)).collect() == []
    assert ct.conversation_trie(frame.where("conv_id IS NULL")).collect() == []


def test_double_array_accepts_its_paths_and_no_others():
    rng = random.Random(11)
    paths = sorted({tuple(rng.choices(range(60), k=rng.randint(0, 5))) for _ in range(2000)})
    begin = np.append(0, np.cumsum([len(p) for p in paths]))
    cells = np.array([c for p in paths for c in p], dtype=np.int64)
    trie = ct.DoubleArray(cells, begin)
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert int((trie.check >= 0).sum()) == len(prefixes)
    assert (trie.walk(cells, begin) > 0).all()
    others = [p for p in (tuple(rng.choices(range(70), k=4)) for _ in range(3000)) if p not in prefixes]
    at = trie.walk(np.array(others).ravel(), np.arange(len(others) + 1) * 4).reshape(-1, 4)
    for path, states in zip(others, at.tolist()):
        inside = max(d for d in range(5) if path[:d] in prefixes)
        assert [s > 0 for s in states] == [d < inside for d in range(4)]
    # a slot has one parent, and most slots are used
    assert (trie.check >= 0).mean() * len(trie.check) / trie._top > 0.5


def rebuilt(rows) -> dict[int, list[tuple[str, str]]]:
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1])):
        own[c].append((role or "", text or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def test_registered_query(spark):
    from ibex.llm.queries import QUERIES

    t = ds.dataset(f"{SF_SMALL}/conversations.parquet").to_table().to_pydict()
    check(QUERIES["op13_conversation_trie"](spark, SF_SMALL), rebuilt(zip(t["conv_id"], t["turn"], t["role"], t["text"])))


def test_query_without_the_base_conversation(spark, tmp_path):
    from ibex.llm.queries import QUERIES

    rows = [(c, t, "user", f"w{t * c % 4}") for c in [*range(101, 160), *range(300, 330)] for t in range(c % 5 + 1)]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    want = rebuilt(rows)
    assert any(not turns for turns in want.values())
    check(QUERIES["op13_conversation_trie"](spark, str(tmp_path)), want)
