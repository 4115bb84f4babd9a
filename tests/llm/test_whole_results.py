"""Operators against brute force where a shortcut could lose results."""

from __future__ import annotations

import random
from itertools import combinations

from ibex.llm import decontaminate as dc
from ibex.llm.near_dedup import NearDedup, near_dedup

from .conftest import _sentence
from .test_dedup import near_expected
from .test_models import words


# --- decontamination -------------------------------------------------------

def pairs_by_brute_force(docs, items, passage=48, share=0.75):
    """Every passage of every document against every item (items without an
    answer of ``min_answer`` words)."""
    out = set()
    for i, text in docs:
        body = words(text)
        have = set(body)
        for k, item in items:
            n = len(item)
            if sum(w in have for w in item) < share * n:
                continue
            for at in range(0, len(body), passage // 2):
                near = body[max(0, at - n):at + passage + n]
                if sum(w in near for w in item) >= share * n and dc.common_subsequence(dc._masks(item), n, near) / n >= share:
                    out.add((i, k))
                    break
    return out


def test_many_items_short_ones_included(spark):
    rng = random.Random(12)
    weights = [1 / (k + 3) for k in range(6000)]

    def text(n):
        return [f"w{k}" for k in rng.choices(range(6000), weights, k=n)]

    items = [(k, text(rng.randint(5, 59))) for k in range(1100)]
    docs = []
    for k, item in items:
        loose = [w for w in item if rng.random() > 0.15]
        for copy in (item, loose)[:1 + (k % 4 == 0)]:
            docs.append((len(docs), " ".join(text(rng.randint(0, 90)) + copy + text(rng.randint(0, 90)))))
    want = pairs_by_brute_force(docs, items)
    assert len(want) > 1200
    table = spark.createDataFrame([(k, " ".join(item)) for k, item in items], "item_id long, text string")
    # an item's words are one sentence, so its answer would be the whole of it
    got = dc.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), table, min_answer=1000)
    assert {(r.id, r.item_id) for r in got.collect()} == want


def test_items_with_null_and_repeated_ids(spark):
    items = [_sentence(50 + k, 30) for k in range(8)]
    docs = [(k, _sentence(90 + k, 40) + " " + t + " " + _sentence(70 + k, 40)) for k, t in enumerate(items)]
    ids = [None, None, 3, 3, 3, 4, 5, 6]
    table = spark.createDataFrame([*zip(ids, items), (9, items[7]), *[(6, items[7])] * 50], "item_id long, text string")
    want = {(k, i) for k, i in enumerate(ids)} | {(7, 9)}
    got = dc.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    assert len(got) == len(want) and {(r.id, r.item_id) for r in got} == want


def test_equal_items_are_sent_to_the_driver_once(spark, monkeypatch):
    seen = []
    made = dc._items
    monkeypatch.setattr(dc, "_items", lambda rows, *a: seen.append(len(rows)) or made(rows, *a))
    text = _sentence(50, 30)
    table = spark.createDataFrame([(k, text) for k in range(300)], "item_id long, text string")
    got = dc.contaminated_pairs(spark.createDataFrame([(1, text)], "doc_id long, text string"), table)
    assert {r.item_id for r in got.collect()} == set(range(300)) and seen == [1]


# --- near dedup ------------------------------------------------------------

def test_a_large_last_node_is_dealt_in_bounded_tasks(spark):
    join = NearDedup(node_limit=10, block_rows=20, max_depth=1)
    component = {k: 1000 if k < 90 else k for k in range(400)}  # one group of 90, singletons
    mixed = [(7, 0, k, c, 400) for k, c in component.items()] + [(8, 0, k, k, 5) for k in range(5)]
    rows = join._grouped(spark.createDataFrame(mixed, "node long, root int, id long, component long, size long"), 1).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault((r.node, r.salt), []).append(r)
    assert max(len(t) for t in tasks.values()) <= 100  # two blocks of about 20
    pairs = []
    for (node, _), task in tasks.items():
        for x, y in combinations(task, 2):
            if node == 7 and x.component != y.component and (x.wide != y.wide if x.apart else x.wide or y.wide):
                pairs.append((min(x.id, y.id), max(x.id, y.id)))
    want = {(x, y) for x, y in combinations(component, 2) if component[x] != component[y]}
    assert len(pairs) == len(want) and set(pairs) == want


def test_many_documents_with_a_shared_passage(spark):
    shared, docs = _sentence(1, 100), []
    for k in range(120):
        docs.append((k, shared + " " + _sentence(200 + k, 24 - k % 8)))  # similarity 0.66 to 0.74, few linked
    docs += [(200 + k, docs[k][1] + " " + _sentence(900 + k, 3)) for k in range(0, 120, 10)]
    rng = random.Random(3)
    rng.shuffle(docs)
    expected = {i: x[1] for i, x in near_expected(docs).items()}
    assert len(set(expected.values())) >= 100
    got = near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), node_limit=8, block_rows=16, max_depth=2).collect()
    assert {r.id: r.component_id for r in got} == expected
