"""Text operators on hand-written fixtures, checked against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from ibex.functions.text import TOKEN_FILTERS, clean_text, tokenize
from ibex.operators import labels as L
from ibex.operators import vocab as V
from ibex.operators.paragraphs import paragraphs
from ibex.sources import corpus as C


def py_clean(t):
    t = re.sub(r"\W", " ", t)
    t = re.sub(r"\s+", " ", t)
    return t.strip()


def py_tokens(t):
    t = t.lower().translate(str.maketrans({c: " " for c in TOKEN_FILTERS}))
    return [w for w in t.split(" ") if w]


CLEAN_CASES = [
    "Héllo, wörld!", "snake_case_word and__double", "digits 123 4.5 ²½", "emoji 😀 here",
    "combining é mark", "!!! ??? ...", "", "  lead and trail  ", "tab\tand\nnewline\r\nx",
    "Ärger — über · Straße", "日本語のテキスト、句読点。",
]


def test_clean_text_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN_CASES)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", clean_text("t").alias("c")).collect()}
    for i, t in enumerate(CLEAN_CASES):
        assert got[i] == py_clean(t), (t, got[i], py_clean(t))


def test_tokenize_matches_python(spark):
    cases = CLEAN_CASES + ["a_b c-d e.f", "UPPER lower MiXeD", "x\ty\nz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["k"] for r in df.select("i", tokenize("t").alias("k")).collect()}
    for i, t in enumerate(cases):
        assert got[i] == py_tokens(t), t
    assert got[len(CLEAN_CASES)] == ["a", "b", "c", "d", "e", "f"]


def _book(n):
    return ("w%d " % n) * 120  # 360 characters


def test_text_files_lf_and_crlf_give_same_paragraphs(spark, tmp_path):
    exact300 = "x" * 300
    exact301 = "y" * 301
    body = "\n\n".join([_book(1), "short", exact300, exact301, _book(2)]) + "\n\n\n" + _book(3)
    (tmp_path / "lf").mkdir()
    (tmp_path / "crlf").mkdir()
    (tmp_path / "lf" / "b.txt").write_bytes(body.encode())
    (tmp_path / "crlf" / "b.txt").write_bytes(body.replace("\n", "\r\n").encode())
    out = {}
    for kind in ("lf", "crlf"):
        corpus = C.read_text_files(spark, str(tmp_path / kind / "b.txt"))
        out[kind] = [(r["pos"], r["text"]) for r in paragraphs(corpus, clean=False).orderBy("pos").collect()]
    assert out["lf"] == out["crlf"]
    py = [(i, p) for i, p in enumerate(body.split("\n\n")) if len(p) > 300]
    assert out["lf"] == py
    texts = [t for _, t in out["lf"]]
    assert exact301 in texts and exact300 not in texts
    assert any(t.startswith("\n") for t in texts)  # three newlines leave one on the next piece


def test_vocabulary_ties_by_token(spark):
    rows = [(1, ["b", "a", "c", "c"]), (2, ["d", "a", "b", "e"])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    v = V.vocabulary(df, num_words=5).orderBy("id").collect()
    assert [(r["token"], r["n"], r["id"]) for r in v] == [("a", 2, 2), ("b", 2, 3), ("c", 2, 4)]


def test_encode_and_pad(spark):
    vocab = spark.createDataFrame([("a", 3, 2), ("b", 2, 3)], "token string, n bigint, id int")
    rows = [(0, []), (1, ["a", "zz", "b"]), (2, ["a"] * 4), (3, ["b"] * 5), (4, ["q", "r"]), (5, None)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    enc = V.encode_tokens(df, vocab, maxlen=4).withColumn("padded", V.pad_sequences("ids", 4))
    got = {r["k"]: (r["ids"], r["padded"]) for r in enc.collect()}
    assert got[0] == ([], [0, 0, 0, 0])
    assert got[1] == ([2, 1, 3], [2, 1, 3, 0])
    assert got[2] == ([2, 2, 2, 2], [2, 2, 2, 2])
    assert got[3] == ([3, 3, 3, 3], [3, 3, 3, 3])
    assert got[4] == ([1, 1], [1, 1, 0, 0])
    assert got[5][0] is None


def test_encode_arrow_equals_join(spark):
    from conftest import SF_SMALL
    from ibex.plans.queries import _vocab

    tok, vocab = _vocab(spark, SF_SMALL)
    a = V.encode_tokens(tok, vocab, 50).select("doc_id", "pos", "ids")
    b = V.encode_tokens_join(tok, vocab, ["doc_id", "pos"], 50).select("doc_id", "pos", "ids")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_encode_falls_back_to_join_beyond_the_bound(spark, monkeypatch):
    from conftest import SF_SMALL
    from ibex.plans.queries import _vocab

    tok, vocab = _vocab(spark, SF_SMALL)
    a = sorted(map(tuple, V.encode_tokens(tok, vocab, 50).select("doc_id", "pos", "ids").collect()))
    monkeypatch.setattr(V, "MAX_BROADCAST_VOCAB", 5)
    b = V.encode_tokens(tok, vocab, 50, key=["doc_id", "pos"]).select("doc_id", "pos", "ids")
    assert sorted(map(tuple, b.collect())) == a
    with pytest.raises(ValueError):
        V.encode_tokens(tok, vocab, 50)


def test_one_hot_out_of_range(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (2,)], "label int")
    got = [r["o"] for r in L.with_one_hot(df, 2, out="o").orderBy("label").collect()]
    assert got == [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]


def test_label_by_manifest_and_category(spark):
    rows = spark.createDataFrame([(1, "a", "t"), (2, "b", "t"), (3, "c", "t")], "doc_id long, source string, text string")
    man = L.manifest_frame(spark, {"a": 1729, "b": 1800})
    got = {r["doc_id"]: r["label"] for r in L.label_by_manifest(rows, man).collect()}
    assert got == {1: 0, 2: 1}  # c is not listed
    msgs = spark.createDataFrame([("ham",), ("spam",), (None,)], "category string")
    assert [r["label"] for r in L.label_by_category(msgs).collect()] == [0, 1, 1]


def test_messages_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('Category,Message\nham,"hello, there"\nspam,"multi\nline"\n')
    df = C.read_messages_csv(spark, str(p))
    rows = sorted((r["category"], r["text"]) for r in df.collect())
    assert rows == [("ham", "hello, there"), ("spam", "multi\nline")]


def test_tokenizer_names():
    from ibex.plans.text import check_tokenizer

    assert check_tokenizer("WORD") == "word"
    assert check_tokenizer("tf") == "word" and check_tokenizer("BERT") == "subword"
    with pytest.raises(ValueError):
        check_tokenizer("no-such-tokenizer")


def test_subword_branch_of_the_text_plan(spark):
    from conftest import SF_SMALL
    from ibex.plans import text as TP
    from ibex.plans.queries import _split, _subword_encoded

    cfg = TP.TextConfig(tokenizer="bert", maxlen=512)
    enc, vocab = TP.encoded(_split(spark, SF_SMALL), cfg)
    got = sorted((r["doc_id"], r["pos"], tuple(r["ids"])) for r in enc.collect())
    want = sorted((r["doc_id"], r["pos"], tuple(r["input_ids"])) for r in _subword_encoded(spark, SF_SMALL).collect())
    assert got == want and len(got) > 0
    assert set(vocab.columns) == {"piece", "id"}


def test_normalize_center_scale(spark):
    from ibex.operators.vectors import center_vector, scale_vector

    df = spark.createDataFrame([([0.0, 127.5, 255.0],)], "x array<double>")
    r = df.select(scale_vector("x").alias("s")).first()["s"]
    assert r == [0.0, 0.5, 1.0]
    r = df.select(center_vector(scale_vector("x")).alias("c")).first()["c"]
    assert r == [-1.0, 0.0, 1.0]
    ids = spark.createDataFrame([([0, 5, 999],)], "ids array<int>")
    assert ids.select(V.normalize_ids("ids", 1000).alias("n")).first()["n"] == [0.0, 0.005, 0.999]
    assert ids.select(V.attention_mask("ids").alias("m")).first()["m"] == [0, 1, 1]


def test_read_listed_files_only(spark, tmp_path):
    for name, body in (("a.txt", "x" * 400), ("b.txt", "y" * 400), ("c.txt", "z" * 400)):
        (tmp_path / name).write_text(body)
    man = L.manifest_frame(spark, {"a.txt": 1750, "c.txt": 1850})
    corpus = C.read_listed_files(spark, str(tmp_path), man)
    assert sorted(r["source"] for r in corpus.collect()) == ["a.txt", "c.txt"]
    lab = L.label_by_manifest(paragraphs(corpus), man)
    assert sorted((r["source"], r["label"]) for r in lab.collect()) == [("a.txt", 0), ("c.txt", 1)]


def test_model_inputs_parquet_round_trip(spark, tmp_path):
    from ibex.operators.model_inputs import model_inputs, write_model_inputs

    df = spark.createDataFrame([(1, [3, 4], 1)], "k int, ids array<int>, label int")
    m = model_inputs(df, maxlen=4, k=2)
    write_model_inputs(m, str(tmp_path / "mi"))
    r = spark.read.parquet(str(tmp_path / "mi")).first()
    assert r["input_ids"] == [3, 4, 0, 0] and r["attention_mask"] == [1, 1, 0, 0] and r["labels"] == [0.0, 1.0]


def test_trial_encodings_equal_one_split_pipelines(spark):
    from conftest import SF_SMALL
    from ibex.operators import split as S
    from ibex.operators import vocab as V
    from ibex.plans import text as TP
    from ibex.plans.queries import _labelled

    cfg = TP.TextConfig(num_words=60, maxlen=40)
    rows = _labelled(spark, SF_SMALL)
    enc, vocabs = TP.trial_encoded(rows, ["doc_id", "pos"], [0, 3], cfg)
    got = {(r["doc_id"], r["pos"]): (r["ids_t0"], r["ids_t3"]) for r in enc.collect()}
    for i, t in enumerate([0, 3]):
        one, vocab = TP.encoded(S.split_hash(rows, ["doc_id", "pos"], cfg.test_fraction, seed=t), cfg)
        want = {(r["doc_id"], r["pos"]): r["ids"] for r in one.collect()}
        assert {k: v[i] for k, v in got.items()} == want
        tv = {(r["token"], r["id"]) for r in vocabs.where(f"trial = {t}").collect()}
        assert tv == {(r["token"], r["id"]) for r in vocab.collect()}


def test_clean_and_tokenize_agree_with_python_on_every_assigned_code_point(spark):
    # word characters and case mappings follow the JVM's Unicode tables;
    # code points assigned in later Unicode versions than the JVM knows are
    # the only ones allowed to differ from Python
    cps = [c for c in range(0x110000) if not (0xD800 <= c <= 0xDFFF)]
    df = spark.createDataFrame([(c, "A" + chr(c) + "b") for c in cps], "cp int, t string")
    out = df.select("cp", clean_text("t").alias("c"), tokenize("t").alias("k"),
                    F.col("t").substr(2, 1).rlike(r"^\p{Cn}$").alias("unassigned"))
    bad = []
    for r in out.collect():
        t = "A" + chr(r["cp"]) + "b"
        if r["c"] != py_clean(t) or r["k"] != py_tokens(t):
            bad.append((r["cp"], r["unassigned"]))
    assert all(unassigned for _, unassigned in bad), [hex(c) for c, u in bad if not u][:20]


def test_manifest_join_runs_before_the_explode(spark):
    from conftest import SF_SMALL
    from ibex.plans.queries import _labelled

    plan = _labelled(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    generate = next(i for i, line in enumerate(lines) if "Generate posexplode" in line)
    join = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    assert join > generate  # printed deeper: the join feeds the explode
