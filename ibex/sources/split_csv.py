"""CSV files whose quoted fields span lines, read by many tasks.

A line starts a record if the quotes before it, from the start of its file,
are even in number.  So a file can be cut anywhere:

1. every split counts its quotes, and notes whether a record starts in it if
   the quotes before are even, and if they are odd;
2. the splits' counts, one small row each, are added up in order: each split
   then knows the parity it begins with, and in which earlier split a record
   that it goes on with has begun;
3. every split emits its whole records and the pieces of those that cross its
   ends; pieces are put together by the split where their record begins.

The text is scanned twice and never shuffled, but for records that cross a
split.  Quotes must be what the format says: a field with a quote is quoted,
and its quotes are doubled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECES = "file string, split long, seq long, place long, record string"


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines with the split they lie in, in order within it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _runs(batches):
    """Batches cut where the split changes: (file, split, lines)."""
    for b in batches:
        if not b.num_rows:
            continue
        split, file = b.column("split").to_numpy(), b.column("file").dictionary_encode()
        code = file.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(split) != 0) | (np.diff(code) != 0)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:]):
            yield file.dictionary[int(code[a])].as_py(), int(split[a]), b.slice(a, z - a)


def _quotes(lines: pa.RecordBatch) -> np.ndarray:
    return pc.count_substring(lines.column("value"), '"').to_numpy(zero_copy_only=False).astype(np.int64)


def split_parities(lines: DataFrame) -> DataFrame:
    """(file, split, odd, owner): whether an odd number of quotes lies before
    the split, and the last earlier split in which a record starts."""
    def count(batches):
        now, total, starts = None, 0, [False, False]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([total % 2]), pa.array([starts[0]]),
                                               pa.array([starts[1]])], names=["file", "split", "quotes", "even", "odd"])

        for file, split, part in _runs(batches):
            if (file, split) != now:
                if now:
                    yield row()
                now, total, starts = (file, split), 0, [False, False]
            quotes = _quotes(part)
            before = (total + np.cumsum(quotes) - quotes) % 2
            starts = [starts[0] or bool((before == 0).any()), starts[1] or bool((before == 1).any())]
            total += int(quotes.sum())
        if now:
            yield row()

    counted = lines.mapInArrow(count, "file string, split long, quotes long, even boolean, odd boolean")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    known = counted.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    known = known.withColumn("starts", F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd")))
    owner = F.last(F.when(F.col("starts"), F.col("split")), ignorenulls=True).over(before)
    return known.select("file", "split", F.col("inside").cast("int").alias("odd"), owner.alias("owner"))


def csv_records(spark: SparkSession, path) -> DataFrame:
    """(file, split, seq, record): the text of every record of the CSV files,
    without its line end; ``(split, seq)`` orders a file's records.  Blank
    lines between records are left out."""
    from ibex.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    lines = _lines(spark, path)
    parities = split_parities(lines).checkpoint()  # a row for each split
    known = lines.join(F.broadcast(parities), ["file", "split"])

    def cut(batches):
        now = None
        for file, split, part in _runs(batches):
            if (file, split) != now:
                if now and held:
                    yield _piece(now, first, place, held)
                now, parity, seq, held = (file, split), part.column("odd")[0].as_py(), 0, []
                # what is held: lines of the record that (first, place) name
                first, place = ((part.column("owner")[0].as_py(), None), split) if parity else ((split, 0), 0)
            values, quotes = part.column("value"), _quotes(part)
            before = (parity + np.cumsum(quotes) - quotes) % 2
            begin = np.flatnonzero(before == 0)
            parity = int((parity + quotes.sum()) % 2)
            if not len(begin):
                held += values.to_pylist()
                continue
            held += values.slice(0, int(begin[0])).to_pylist()
            if held:
                yield _piece(now, first, place, held)
            ends = np.append(begin[1:], len(values))
            open_ = begin[-1]  # the last record may go on in the next batch
            whole = begin[:-1]
            seqs = seq + np.arange(len(whole))
            alone = ends[:-1] - whole == 1
            if alone.any():
                n = int(alone.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n), pa.array([split] * n, pa.int64()), pa.array(seqs[alone]), pa.array([0] * n, pa.int64()),
                     values.take(pa.array(whole[alone]))], names=["file", "split", "seq", "place", "record"])
            for s, a, z in zip(seqs[~alone].tolist(), whole[~alone].tolist(), ends[:-1][~alone].tolist()):
                yield _piece(now, (split, s), 0, values.slice(a, z - a).to_pylist())
            seq += len(whole)
            held, first, place = values.slice(int(open_)).to_pylist(), (split, seq), 0
            seq += 1
        if now and held:
            yield _piece(now, first, place, held)

    pieces = known.mapInArrow(cut, PIECES).checkpoint()
    # a piece from a later split names the split where its record begins, whose last record it is
    crossing = pieces.where("place > 0").select("file", "split").distinct()
    last = (pieces.where("place = 0").join(F.broadcast(crossing), ["file", "split"]).groupBy("file", "split").agg(F.max("seq").alias("last")))
    tails = pieces.where("place > 0").drop("seq").join(last.withColumnRenamed("last", "seq"), ["file", "split"])
    heads = pieces.where("place = 0").join(F.broadcast(last), ["file", "split"], "left")
    open_heads = heads.where("seq = last").drop("last")
    joined = (open_heads.unionByName(tails.select(*open_heads.columns)).groupBy("file", "split", "seq")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "record"))), lambda p: p["record"]), "\n").alias("record")))
    rest = heads.where("last IS NULL OR seq <> last").select("file", "split", "seq", "record")
    records = rest.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return records.where(F.length(F.trim("record")) > 0)


def _piece(now, first, place, held) -> pa.RecordBatch:
    file, _ = now
    return pa.RecordBatch.from_arrays(
        [pa.array([file]), pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int64()), pa.array([place], pa.int64()),
         pa.array(["\n".join(held)])], names=["file", "split", "seq", "place", "record"])


def read_csv_split(spark: SparkSession, path, schema: str, header: bool = True) -> DataFrame:
    """The columns of CSV files as Spark's multi-line reader gives them, read
    by as many tasks as there are splits."""
    records = csv_records(spark, path)
    if header:
        records = records.where("NOT (split = 0 AND seq = 0)")
    parsed = F.from_csv("record", schema, {"quote": '"', "escape": '"', "multiLine": "true"})
    return records.select(parsed.alias("r")).select("r.*")
