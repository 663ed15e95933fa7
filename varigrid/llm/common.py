"""Helpers shared by the corpus operators: shared storage, batching and held-out folds."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text and rows that one step of a Python worker handles at once; a longer document is a step of its own.
STEP_BYTES, STEP_ROWS = 2 << 20, 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset, a temporary folder of this
    machine, if all tasks run in the driver's process; on a cluster an error, as executors would not see each other's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="varigrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator returns itself; names differ in more than case."""
    return df.drop(*(c for c in df.columns if c.lower() in {n.lower() for n in names}))


def numbered(df: DataFrame, *more: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its columns but those of ``keep`` named ``c0, c1, ...``, so that none clashes with a working column, and ``more``."""
    return df.select(*(F.col(quoted(c)).alias(c.lower() if c.lower() in keep else f"c{i}") for i, c in enumerate(df.columns)), *more)


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def bounded(df: DataFrame, rows: int, *keys: str, total: int | None = None) -> DataFrame:
    """At most about ``rows`` rows, chosen by the hash of ``keys``: the documented bound of a training sample. ``total``
    may give a number that ``df`` does not exceed (a file's number of rows, which costs no scan), or its rows are counted."""
    n = df.count() if total is None else total
    if n <= rows:
        return df
    return df.where(F.shiftrightunsigned(F.xxhash64(F.lit(17), *keys), 1) < (rows << 63) // n)  # of all 63 bits: a share may be as small as one row in 2^63


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a step has at most ``rows`` rows and ``limit`` bytes of strings, or is one string."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = size = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > limit or i - begin >= rows:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        yield batch.slice(begin)
    give_back()


def give_back() -> None:
    """A worker lives on after its task; what the task has freed goes back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
