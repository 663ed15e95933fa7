"""Token-id files under one canonical length-limited Huffman code (operator 5).

A file is a Parquet table with a row per document in ascending ``doc_id`` order: ``part`` (the file's number),
``doc_id``, ``local_start`` (ids before the document in its file), ``n_tokens``, ``payload`` (the codes, most
significant bit first, padded to whole bytes) and ``checkpoints`` (little-endian unsigned 64-bit bit offsets
of every block of :data:`BLOCK` ids). Blocks decode independently of each other. The table ``codebook`` beside
it holds ``id`` and ``bits``; canonical codes follow from these two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.common import dropped, new_path, steps, written
from varigrid.llm.tokens import each, encoder, with_end

BLOCK = 256
#: Longest code; 2**MAX_BITS must be at least the number of distinct ids.
MAX_BITS = 18
#: Bytes, about, of the words that a worker remembers: nothing else of this operator's stages needs its memory.
REMEMBERED = 120 << 20
#: Ids in one file, about.
FILE_IDS = 16 << 20
IDS = "doc_id long, n_tokens long, ids binary, tally binary"
#: How often a task met each id.
TALLY = np.dtype([("id", "<u4"), ("n", "<u8")])
FILE = "part int, doc_id long, n_tokens long, payload binary, checkpoints binary"


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each row of ``docs``, and a row with ``tally`` alone for each task; null text is empty.

    ``ids`` are little-endian and unsigned, of 16 bits where the vocabulary and ``end`` fit, or of 32. Counting reads the
    tallies, not the ids.
    """

    def ids_of(batches):
        encode = encoder(path, REMEMBERED)
        known = max(len(encode.id_bytes), end + 1)
        total = np.zeros(known, np.int64)
        for batch in steps(batches):
            ids, sizes = with_end(*encode(batch.column("text").to_pylist()), end)
            total += np.bincount(ids, minlength=known)
            rows = [x.tobytes() for x in each(ids.astype("<u2" if known <= 1 << 16 else "<u4"), sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary())], ["doc_id", "n_tokens", "ids", "tally"])
        used = np.flatnonzero(total)
        tally = np.zeros(len(used), TALLY)
        tally["id"], tally["n"] = used, total[used]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([tally.tobytes()], pa.binary())], ["doc_id", "n_tokens", "ids", "tally"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(ids_of, IDS)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight, item = counts[used].astype(np.float64), []
    row = weight
    for _ in range(limit):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1) if item else np.zeros(0)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        item.append(order < len(weight))
        row = both[order]
    take = 2 * len(used) - 2
    for is_item in reversed(item):
        n = int(is_item[:take].sum())
        out[used[:n]] += 1
        take = 2 * (take - n)
    return out


class Code:
    """Canonical codes of the given lengths, with the table that decodes them."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int64)
        used = np.flatnonzero(bits)
        used = used[np.lexsort((used, bits[used]))]
        self.width = max(1, int(bits.max(initial=1)))
        steps_ = np.int64(1) << (self.width - self.bits[used])
        begin = np.cumsum(steps_) - steps_
        self.codes = np.zeros(len(bits), np.uint64)
        self.codes[used] = (begin >> (self.width - self.bits[used])).astype(np.uint64)
        self.symbol = np.zeros(1 << self.width, np.int32)
        self.length = np.ones(1 << self.width, np.uint8)
        self.symbol[: steps_.sum()] = np.repeat(used, steps_)
        self.length[: steps_.sum()] = np.repeat(self.bits[used], steps_)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Payload and checkpoints of each document."""
        bits, ends = self.bits[ids], np.cumsum(sizes)
        if not len(ids):
            return [b""] * len(sizes), [b""] * len(sizes)
        total = np.concatenate([[0], np.cumsum(bits)])
        edges = total[np.concatenate([[0], ends])]
        whole = (np.diff(edges) + 7) // 8
        base = np.concatenate([[0], np.cumsum(whole)])
        at = total[:-1] + np.repeat(8 * base[:-1] - edges[:-1], sizes)
        word, room = at >> 6, 64 - (at & 63) - bits
        code = self.codes[ids]
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(base[-1] // 8) + 2, np.uint64)
        out[word[first]] = np.add.reduceat(high, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        data = out.byteswap().tobytes()
        rank = np.arange(len(ids)) - np.repeat(ends - sizes, sizes)
        mark = np.flatnonzero(rank % BLOCK == 0)
        doc = np.repeat(np.arange(len(sizes)), sizes)[mark]
        offsets = (at[mark] - 8 * base[doc]).astype("<u8")
        cuts = np.searchsorted(doc, np.arange(len(sizes) + 1))
        return [data[a:b] for a, b in zip(base[:-1], base[1:], strict=True)], [offsets[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, payloads: list[bytes], checkpoints: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """All ids in a row: every block is a lane, and all lanes advance together."""
        data = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        sizes = np.asarray(sizes, np.int64)
        base = np.concatenate([[0], np.cumsum([len(x) for x in payloads])])[:-1] * 8
        lanes = (sizes + BLOCK - 1) // BLOCK
        doc = np.repeat(np.arange(len(sizes)), lanes)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.frombuffer(b"".join(checkpoints), "<u8").astype(np.int64) + base[doc]
        to = (np.cumsum(sizes) - sizes)[doc] + within * BLOCK
        left = np.minimum(BLOCK, sizes[doc] - within * BLOCK)
        order = np.argsort(-left, kind="stable")
        at, to = at[order], to[order]
        active = np.searchsorted(-left[order], -np.arange(BLOCK), side="left")
        out = np.empty(int(sizes.sum()), np.int32)
        mask = np.uint32((1 << self.width) - 1)
        for t, n in enumerate(active.tolist()):
            if not n:
                break
            now = at[:n]
            look = (window[now >> 3] >> (32 - self.width - (now & 7)).astype(np.uint32)) & mask
            out[to[:n] + t] = self.symbol[look]
            now += self.length[look]
        return out


def write_files(docs: DataFrame, path: str, end: int, folder: str, max_bits: int = MAX_BITS, file_ids: int = FILE_IDS) -> None:
    """Tokenize ``docs`` (``doc_id``, ``text``) and write the files and their code book under ``folder``.

    A file is a range of ids and, among rows of one id, of their places in the stored table: however many rows share an id,
    or have none, they fill several files. The ranges come from Spark's own sample of the keys, of a bounded size.
    Null texts are empty (one id, ``end``); rows that repeat a doc_id stay rows, in any order among
    themselves; null doc_ids come first; an empty table gives empty files; other columns are ignored.
    """
    spark = docs.sparkSession
    stored = written(tokenized(docs, path, end), "token-ids")
    rows = stored.where("tally is null").drop("tally")

    def counted(batches):
        for batch in batches:
            for tally in batch.column("tally").to_pylist():
                found = np.frombuffer(tally, TALLY)
                yield pa.RecordBatch.from_arrays([pa.array(found["id"].astype(np.int32)), pa.array(found["n"].astype(np.int64))], ["id", "n"])

    tallies = stored.select("tally").where("tally is not null")
    counts = tallies.mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by_id = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    by_id[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    bits = code_lengths(by_id, max_bits)
    spark.createDataFrame([(int(i), int(by_id[i]), int(bits[i])) for i in np.flatnonzero(bits)], "id int, n long, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    files = max(1, -(-int(by_id.sum()) // file_ids))
    ranked = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def encoded(batches):
        code, part, at = Code(bits), TaskContext.get().partitionId(), 0
        for batch in steps(batches, "ids", 2 << 20):
            sizes = batch.column("n_tokens").to_numpy()
            data = b"".join(batch.column("ids").to_pylist())
            ids = np.frombuffer(data, f"<u{len(data) // int(sizes.sum())}").astype(np.int64)
            payload, marks = code.encode(ids, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part, np.int32)), batch.column("doc_id"), batch.column("n_tokens"), pa.array(payload, pa.binary()), pa.array(marks, pa.binary()), pa.array(at + np.cumsum(sizes) - sizes)],
                ["part", "doc_id", "n_tokens", "payload", "checkpoints", "local_start"],
            )
            at += int(sizes.sum())

    ranked.drop("tie").mapInArrow(encoded, f"{FILE}, local_start long").write.option("compression", "none").parquet(f"{folder}/data")
    dropped(stored)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the documents in the files under ``folder``."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    bits = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.int64)
    bits[book["id"].to_numpy()] = book["bits"].to_numpy()
    data = spark.read.schema(f"{FILE}, local_start long").parquet(f"{folder}/data")
    totals = dict(data.groupBy("part").agg(F.sum("n_tokens")).collect())  # a row for each file
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]

    def decoded(batches):
        code = Code(bits)
        for batch in steps(batches, "payload"):
            sizes = batch.column("n_tokens").to_numpy()
            ids = code.decode(batch.column("payload").to_pylist(), batch.column("checkpoints").to_pylist(), sizes)
            start = batch.column("local_start").to_numpy() + np.array([base[p] for p in batch.column("part").to_pylist()], np.int64)
            rows = [x.tobytes() for x in each(ids.astype("<u4"), sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(start), batch.column("n_tokens"), pa.array(rows, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return data.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "token-files")
    write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 2, folder)
    return read_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
