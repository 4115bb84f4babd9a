"""Multi-line CSV cut anywhere against the reader that takes a file in one
task; tokens of any frequency against the shipped vocabulary."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ibex.operators import vocab as V
from ibex.sources import corpus as C
from ibex.sources import split_csv as SC

SCHEMA = "Category string, Message string"


def one_task(spark, path):
    return (spark.read.schema(SCHEMA).option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"')
            .csv(str(path)))


def written(rng: random.Random, n: int, line_end: str) -> str:
    bits = ["a", "b c", '""', ",", "\n", "\n\n", "é漢", "x" * 30, ", ", "word", '"",""']
    out = ["Category,Message"]
    for _ in range(n):
        row = []
        for _ in range(2):
            text = "".join(rng.choices(bits, k=rng.randint(0, 8)))
            row.append(f'"{text}"' if any(c in text for c in '",\n') or rng.random() < 0.3 else text)
        out.append(",".join(row))
    return line_end.join(out) + line_end * rng.randint(0, 2)


@pytest.fixture
def splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0")]
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [37, 200, 5000])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_rows_of_the_one_task_reader(spark, tmp_path, splits, size, line_end):
    rng = random.Random(size)
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(written(rng, 60, line_end), newline="")
    want = sorted(map(tuple, one_task(spark, tmp_path).collect()), key=repr)
    splits(size)
    lines = SC._lines(spark, str(tmp_path))
    if size < 1000:
        assert lines.rdd.getNumPartitions() > 8
    got = sorted(map(tuple, SC.read_csv_split(spark, str(tmp_path), SCHEMA).collect()), key=repr)
    assert got == want


def test_a_record_over_many_splits_and_empty_files(spark, tmp_path, splits):
    long = "\n".join(f"line {i}, with ''quotes''" for i in range(400))
    (tmp_path / "a.csv").write_text(f'Category,Message\nham,"{long}"\nspam,short\n"h\nam","{long}"')
    (tmp_path / "b.csv").write_text("Category,Message\n")
    (tmp_path / "c.csv").write_text("")
    splits(500)
    got = sorted(map(tuple, SC.read_csv_split(spark, str(tmp_path), SCHEMA).collect()))
    assert got == sorted([("ham", long), ("spam", "short"), ("h\nam", long)])
    records = SC.csv_records(spark, str(tmp_path))
    order = [r.record[:4] for r in records.where("file like '%a.csv'").orderBy("split", "seq").collect()]
    assert order == ["Cate", "ham,", "spam", '"h\na']


def test_messages_do_not_depend_on_the_reader(spark, tmp_path, splits):
    (tmp_path / "m.csv").write_text(written(random.Random(1), 80, "\n"))
    want = sorted(map(tuple, C.read_messages_csv(spark, str(tmp_path), split=False).collect()))
    splits(64)
    assert sorted(map(tuple, C.read_messages_csv(spark, str(tmp_path)).collect())) == want


# --- tokens beyond the shipped vocabulary ----------------------------------------

def tokens_frame(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        words = [rng.choice(["the", "unseen", f"w{rng.randint(0, 400)}", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 30))]
        rows.append((i, None if i == 7 else words))
    return spark.createDataFrame(rows, "k int, tokens array<string>").repartition(3)


def test_join_gives_the_ids_of_the_shipped_vocabulary(spark, monkeypatch):
    frame = tokens_frame(spark)
    vocab = V.vocabulary(frame.select(F.array_remove("tokens", "unseen").alias("tokens")), 300)
    want = {r.k: r.ids or [] for r in V.encode_tokens(frame, vocab, 20).collect()}
    assert {r.k: r.ids for r in V.encode_tokens_join(frame, vocab, ["k"], 20).collect()} == want
    monkeypatch.setattr(V, "MAX_BROADCAST_VOCAB", 10)  # beyond the bound, with and without a key
    assert {r.k: r.ids for r in V.encode_tokens(frame, vocab, 20, key=["k"]).collect()} == want
    unkeyed = V.encode_tokens(frame, vocab, 20)
    assert unkeyed.columns == ["k", "tokens", "ids"] and {r.k: r.ids for r in unkeyed.collect()} == want


def test_no_token_fills_a_shuffle_partition(spark):
    frame = tokens_frame(spark)
    exploded = frame.select("k", F.explode("tokens").alias("token"))
    hot = {r.token for r in V.hot_tokens(exploded, 16).collect()}
    counts = {r.token: r.n for r in exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    assert {"the", "unseen"} <= hot and len(hot) <= 64
    assert all((counts[t] >= total / 64) == (t in hot) for t in counts)
    cold = exploded.where(~F.col("token").isin(list(hot))).repartition(16, "token").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in cold)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert V.hot_tokens(exploded.limit(0), 16).collect() == []
