"""The pipeline's stages decide row by row where ids repeat or are null, and
take one very long text."""

from __future__ import annotations

import pytest

import corpus_pipeline
from ibex.llm import decontaminate as dc
from ibex.llm.decontaminate import contaminated_pairs, drop_contaminated
from ibex.llm.exact_dedup import drop_copies
from ibex.llm.near_dedup import drop_near_copies

from .conftest import _sentence

A, B, C = (_sentence(300 + k, 60) for k in range(3))
NEAR = A.replace(A.split()[30], "other", 1)
SCHEMA = "doc_id long, text string, __row int, note string"


def texts(frame) -> list:
    return sorted((r.text or "" for r in frame.collect()))


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(5, B, 0, "x"), (7, A, 1, "x"), (7, B, 2, "x"), (7, A, 3, "y"), (None, A, 4, "x"), (None, C, 5, None), (None, C, 6, "x"), (9, None, 7, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_exact_dedup_keeps_one_row_of_each_text(mixed):
    kept = drop_copies(mixed)
    assert kept.columns == mixed.columns
    assert texts(kept) == sorted(["", A, B, C])
    assert {r.doc_id for r in kept.where("text is not null").collect()} == {5, 7, None}


def test_near_dedup_keeps_one_row_of_each_group(spark, mixed):
    more = mixed.unionByName(spark.createDataFrame([(7, NEAR, 8, "x"), (2, NEAR, 9, "x")], SCHEMA))
    kept = drop_near_copies(more)
    assert kept.columns == mixed.columns
    assert texts(kept) == sorted(["", NEAR, B, C]) and [r.doc_id for r in kept.where("__row = 9").collect()] == [2]


def test_decontamination_drops_contaminated_rows_only(spark, mixed):
    benchmark = spark.createDataFrame([(1, B), (None, C)], "item_id long, text string")
    kept = drop_contaminated(mixed, benchmark)
    assert kept.columns == mixed.columns
    assert texts(kept) == sorted(["", A, A, A])


def test_distinct_ids_are_used_as_they_are(spark):
    frame = spark.createDataFrame([(5, B, 0, "x"), (7, A, 1, "x"), (8, B, 2, "x")], SCHEMA)
    assert {r.doc_id for r in drop_copies(frame).collect()} == {5, 7}


def test_all_stages_on_repeated_and_null_ids(spark, mixed, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, C)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = mixed
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == mixed.columns, name
    assert texts(docs) == sorted(["", A, B])


def test_one_very_long_text_is_searched_in_pieces(spark, monkeypatch):
    parts = [_sentence(5000 + k, 400) for k in range(150)]
    items = [(k, _sentence(700 + k, 40)) for k in range(4)]
    long = " ".join(parts[:60] + [items[0][1]] + parts[60:120] + [items[1][1]] + parts[120:] + [items[3][1]])
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, parts[0] + " " + items[2][1])], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 0), (1, 1), (1, 3), (3, 2)}
    assert {(r.id, r.item_id) for r in contaminated_pairs(docs, table).collect()} == want
    monkeypatch.setattr(dc, "BATCH_BLOCKS", 7)
    monkeypatch.setattr(dc, "BATCH_BYTES", 50)
    one = {(r.id, r.item_id): round(r.cosine, 4) for r in contaminated_pairs(docs, table).collect()}
    assert set(one) == want
