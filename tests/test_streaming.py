"""Streaming scoring equals batch scoring on the same files."""

import shutil

from conftest import SF_SMALL
from ibex.operators import vib_math as M
from ibex.plans.queries import _vocab
from ibex.sources import corpus as C
from ibex.streaming.score import score_documents, score_stream_once


def test_stream_equals_batch(spark, tmp_path):
    _, vocab = _vocab(spark, SF_SMALL)
    spec = M.text_spec(units=(4,), embed_dim=2)
    p = M.init_params(spec, 0)
    (tmp_path / "src").mkdir()
    shutil.copy(f"{SF_SMALL}/documents.parquet", tmp_path / "src")
    res = score_stream_once(spark, str(tmp_path / "src"), str(tmp_path / "sink"), vocab, spec, p)
    batch = score_documents(C.read_documents(spark, SF_SMALL), vocab, spec, p)
    a = sorted((r["doc_id"], r["pos"], r["pred"]) for r in res.collect())
    b = sorted((r["doc_id"], r["pos"], r["pred"]) for r in batch.collect())
    assert a == b and len(a) > 0
