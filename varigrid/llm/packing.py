"""Best-fit packing planned on the histogram of piece lengths (operator 4 and a pipeline stage)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varigrid.llm.common import steps, written
from varigrid.llm.tokens import each, encoder, with_end

#: Rows that share a rank group, at most about; a length's rows are dealt over as many groups as a shuffle has partitions, or more.
GROUP_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end: int, size: int, remembered: int | None = None) -> DataFrame:
    """A row per piece of at most ``size`` ids; of a longer document, the first piece takes what is left over."""

    def cut(batches):
        encode = encoder(path, remembered)
        for batch in steps(batches):
            ids, sizes = with_end(*encode(batch.column("text").to_pylist()), end)
            many = (sizes + size - 1) // size
            piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            first = np.repeat(sizes - size * (many - 1), many)
            length = np.where(piece == 0, first, size)
            start = np.where(piece == 0, 0, first + (piece - 1) * size)
            crc = [zlib.crc32(x) for x in each(ids.astype("<u4"), length)]
            doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(many)), many)))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], size: int) -> pd.DataFrame:
    """Best fit, longest first, over counts: ``length, rank, n, per, sequence, offset``.

    A row places the ``n`` pieces of ``length`` from rank ``rank`` on: ``per`` in each of as many sequences
    from number ``sequence`` on, side by side from ``offset``. Sequences that are filled alike are one open group.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of (first sequence, how many)
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                per = size // length
                first, many, room = sequences, -(-left // per), size
                sequences += many
            else:
                first, many = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                per = room // length
            whole = min(many, left // per)
            over = left - whole * per if whole < many else 0
            for begin, runs, each_ in ((first, whole, per), (first + whole, 1 if over else 0, over)):
                if runs:
                    rows.append((length, rank, runs * each_, each_, begin, size - room))
                    rank, left = rank + runs * each_, left - runs * each_
                    if room - each_ * length:
                        open_.setdefault(room - each_ * length, []).append((begin, runs))
            unused = many - whole - bool(over)
            if unused:
                open_.setdefault(room, []).append((first + whole + bool(over), unused))
    return pd.DataFrame(rows, columns=["length", "rank", "n", "per", "sequence", "offset"]).astype("int64")


def packed(docs: DataFrame, path: str, end: int = 2, size: int = 1024, group_rows: int = GROUP_ROWS, remembered: int | None = None) -> DataFrame:
    """Every document's pieces with their sequence and offset.

    The plan needs only counts by length: at most ``size`` rows reach the driver. Pieces are then ranked within
    their length (a length's rows are dealt over hashed groups, so that none is large) and take planned slots
    by that rank. ``remembered`` bounds the bytes of the words that a worker keeps (:func:`varigrid.llm.tokens.encoder`). Null text is empty: one id; a very long text becomes pieces like any other. Rows that repeat a doc_id are packed as they come; an empty
    table gives no rows; other columns are ignored.
    """
    rows = written(pieces(docs, path, end, size, remembered), "pieces")
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(1, rows.count()) // group_rows))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    lengths = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(lengths, size)
    before = counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    key = (slots["length"].to_numpy() << 42) + slots["rank"].to_numpy()
    order = np.argsort(key)
    key, slots = key[order], slots.iloc[order].to_numpy()

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        _, first, _, per, sequence, offset = slots[np.searchsorted(key, (length.to_numpy() << 42) + rank.to_numpy(), side="right") - 1].T
        within = rank.to_numpy() - first
        return pd.DataFrame({"sequence_id": sequence + within // per, "offset": offset + within % per * length.to_numpy()})

    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(before, ["length", "salt"]).withColumn("slot", slot("length", F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
