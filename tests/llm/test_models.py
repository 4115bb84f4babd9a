"""Quality classifier, decontamination and the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ibex.llm import decontaminate as dc, quality as q

from .conftest import _sentence
from .test_dedup import exact_expected, near_expected

public = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"


def held(i) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


# --- quality ---------------------------------------------------------------

def test_statistics_by_hand():
    x = q.statistics(pa.array(["Ab ab AB!! x|", None, "a b\nc"]))
    f = {n: i for i, n in enumerate(q.FEATURES)}
    assert np.isfinite(x).all() and x.shape == (3, len(q.FEATURES))
    assert x[0, f["log_words"]] == pytest.approx(np.log(5)) and x[1, f["log_words"]] == 0
    assert x[0, f["exclaim"]] == pytest.approx(np.log(2.1 / 23)) and x[0, f["bar"]] == pytest.approx(np.log(1.1 / 23))
    assert x[0, f["upper"]] == pytest.approx(np.log(3.1 / 17)) and x[0, f["caps_words"]] == pytest.approx(np.log(1.1 / 14))
    assert x[2, f["line_words"]] == pytest.approx(np.log(4 / 2))


def test_statistics_do_not_depend_on_the_batch(odd):
    column = pa.array([r.text for r in odd.select("text").collect()])
    alone = np.vstack([q.statistics(column.slice(i, 1)) for i in range(len(column))])
    assert np.allclose(q.statistics(column), alone)


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    x0, x1 = rng.normal(0, 1, (4000, 3)), rng.normal([1, 0, 2], [1, 2, 0.5], (8000, 3))
    m = q.discriminant([4000, 8000], [x0.sum(0), x1.sum(0)], [x0.T @ x0, x1.T @ x1], pooling=0.0, ridge=0.0)
    at = rng.normal(0, 2, (200, 3))

    def log(x, s):
        c, d = np.cov(s.T, bias=True), x - s.mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1] + np.log(len(s))

    assert np.allclose(m.score(at), 1 / (1 + np.exp(log(at, x0) - log(at, x1))))


def test_too_few_labels_give_a_constant(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in q.quality_scores(odd, none).collect()} == {1.0}
    ids = [r.doc_id for r in odd.collect() if not held(r.doc_id)][:4]
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(None, 0), (ids[0], 5)], "doc_id long, quality int")
    assert {r.score for r in q.quality_scores(odd, labels).collect()} == {1.0}
    assert q.drop_low_quality(odd, none).count() == odd.count()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.id: r for r in q.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())
    told = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if held(r.doc_id)]
    low = [p for p, y in told if y == 0]
    assert len(told) > 1000 and np.mean([p == y for p, y in told]) > 0.98 and np.mean(low) < 0.05


def test_held_out_labels_are_not_used(spark, nothing):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(doc_id as string)), 3) = 1 then 1 - quality else quality end as quality")
    a, b = ({r.id: r.score for r in q.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)
    assert q.quality_scores(nothing, labels).count() == 0


def test_quality_with_odd_rows(spark, odd, no_ids):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert Counter(r.id for r in q.quality_scores(odd, labels).collect()) == Counter(r.doc_id for r in odd.collect())
    assert q.quality_scores(no_ids, labels).count() == no_ids.count()
    assert q.drop_low_quality(odd, labels).columns == odd.columns


# --- decontamination -------------------------------------------------------

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert dc.common_subsequence(dc._masks(a), len(a), b) == lcs(a, b)


def words(text):
    return [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (text or "").lower()) if w]


def benchmark_rows():
    return [(k, _sentence(1000 + k, 15 + 4 * k) + ". " + _sentence(2000 + k, 8) + ".") for k in range(10)]


def leak_rows():
    rng, items, out = random.Random(9), benchmark_rows(), []
    for k, text in items:
        body = words(text)
        dropped = [w for w in body if rng.random() > 0.12]
        out += [
            (10 * k, _sentence(3000 + k, 60 * k) + " " + text + " " + _sentence(4000 + k, 100), True),  # verbatim
            (10 * k + 1, _sentence(5000 + k, 31) + "\n" + " ".join(dropped).upper(), True),  # words dropped, other case
            (10 * k + 2, _sentence(6000 + k, 50) + " " + " ".join(body[:len(body) // 3]), False),  # a third of it
            (10 * k + 3, _sentence(7000 + k, 300), False),
        ]
    return out


def test_leaks_are_found_and_clean_documents_left(spark):
    rows = leak_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "y"), (901, "", "z")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(*r, "e") for r in benchmark_rows()] + [(77, None, "f"), (78, " .. ", "g")], "item_id long, text string, id string")
    want = {(i, i // 10) for i, _, leak in rows if leak}
    for options in ({}, {"block_items": 3}):
        got = {(r.id, r.item_id): r for r in dc.contaminated_pairs(docs, items, **options).collect()}
        assert got.keys() == want
        for i, t, _ in rows:
            if i % 10 == 0:
                assert got[i, i // 10].share == 1.0 and got[i, i // 10].answer
    kept = {r.doc_id for r in dc.drop_contaminated(docs, items).collect()}
    assert kept == {i for i, _, leak in rows if not leak} | {None, 901}


def test_decontamination_of_empty_tables(spark, nothing, odd):
    items = spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated_pairs(nothing, items).count() == 0
    assert dc.contaminated_pairs(odd, none).count() == 0
    assert dc.contaminated_pairs(odd, items).count() == 0


def test_an_answer_column(spark):
    text, answer = _sentence(31, 40), _sentence(32, 6)
    body = words(text)
    loose = " ".join(w if k % 3 else f"other{k}" for k, w in enumerate(body))
    others = [(100 + k, _sentence(9000 + k, 40)) for k in range(200)]  # word weights need a corpus
    docs = spark.createDataFrame([(1, loose + " " + answer), (2, loose), *others], "doc_id long, text string")
    items = spark.createDataFrame([(5, text, answer)], "item_id long, text string, answer string")
    assert [(r.id, r.answer) for r in dc.contaminated_pairs(docs, items, answer_col="answer").collect()] == [(1, True)]


def test_planted_passages_of_the_tables(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    item = [(r.item_id, " " + " ".join(words(r.text)) + " ") for r in items.collect()]
    want = {(r.doc_id, k) for r in docs.collect() for t in [" " + " ".join(words(r.text)) + " "] for k, i in item if i in t}
    got = {(r.id, r.item_id) for r in dc.contaminated_pairs(docs, items).collect()}
    assert want and want <= got
    assert {d for d, _ in got} == {d for d, _ in want}


# --- pipeline --------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "exact dedup", "near dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    stages = dict(cp.STAGES)
    kept = {r.doc_id for r in stages["quality"](spark, docs, SMALL).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert sum((i in kept) == bool(y) for i, y in labels.items()) / len(labels) > 0.95
    kept = {i for i, x in exact_expected([(i, text[i]) for i in kept]).items() if x[2]}
    kept = {i for i, x in near_expected([(i, text[i]) for i in kept]).items() if x[2]}
    items = [" " + " ".join(words(r.text)) + " " for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {i for i in kept if not any(x in " " + " ".join(words(text[i])) + " " for x in items)}
    rows = cp.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == kept
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
        assert r.offset + r.length <= 1024
    assert all(total[r.doc_id] == r.doc_tokens for r in rows)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
