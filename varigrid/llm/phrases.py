"""Phrase collocation mining: bucket counts of the next length in every pass, bitmaps, Apriori pruning, exact counts (operator 13)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varigrid.llm.common import dropped, steps, written
from varigrid.llm.shingles import GOLDEN, Rolling, mixed

LONGEST, LEAST, TOP = 5, 100, 2000
#: Buckets of a pass: a task keeps a small counter for each, and the driver a bit. It bounds memory, not the result.
BUCKETS = 1 << 22
#: Counters that travel in one row.
SLICE = 1 << 16
#: Bytes of text of a step.
STEP = 4 << 20
BREAK = b"\xff"  # no byte of UTF-8
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + BREAK * 10)
PARTIAL = "lang string, phrase string, n long, part int, cells binary"


def read(texts: list[str | None]) -> bytes:
    """All texts in a row: A-Z lowered, words apart by spaces, pieces and texts by breaks."""
    return BREAK.join((t or "").encode() for t in texts).translate(_TABLE)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end places of the words in ``data``, their hashes, and the numbers of their pieces."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 32) & (raw != BREAK[0])
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    return begin, end, Rolling(raw).of(begin, end), np.searchsorted(np.flatnonzero(raw == BREAK[0]), begin)


def seed_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=1))


def grams(hashes: np.ndarray, seed: np.uint64, n: int) -> np.ndarray:
    """Hashes of ``n`` words from each place on (none where too few follow)."""
    out = mixed(hashes ^ seed)
    for k in range(1, n):
        out = mixed(out[:-1] * GOLDEN + hashes[k:])
    return out


def bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(7)) & np.uint64(buckets - 1)


def lit(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Whether a bitmap holds each hash; without a bitmap, all."""
    if bits is None:
        return np.ones(len(hashes), bool)
    at = bucket(hashes, len(bits) * 8)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


class Counters:
    """Bucket counts that stop at ``least``."""

    def __init__(self, buckets: int, least: int):
        self.cells, self.least = np.zeros(buckets, np.min_scalar_type(2 * least)), least

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique(bucket(hashes, len(self.cells)), return_counts=True)
        self.cells[at] = np.minimum(self.cells[at] + np.minimum(n, self.least), self.least)

    def parts(self) -> Iterator[tuple[int, bytes]]:
        size = min(SLICE, len(self.cells))
        for i in range(0, len(self.cells), size):
            part = self.cells[i : i + size]
            if part.any():
                yield i // size, part.tobytes()


def merged(partial: DataFrame, buckets: int, least: int) -> np.ndarray:
    """A bit for each bucket whose counters sum to ``least`` over all tasks; ``buckets / 8`` bytes reach the driver.

    A task adds the rows that it scans to one set of counters, and the few that tasks give meet by ``part``, row by row.
    """
    dtype, size = np.min_scalar_type(2 * least), min(SLICE, buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells"), strict=True):
                more = np.frombuffer(cells.as_buffer(), dtype)
                sums[part] = np.minimum(sums[part] + more, least).astype(dtype) if part in sums else more.copy()
        for part, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["part", "cells"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in add(batches):
            full = np.packbits(np.frombuffer(batch.column("cells")[0].as_buffer(), dtype) >= least, bitorder="little")
            yield batch.set_column(1, "cells", pa.array([full.tobytes()], pa.binary()))

    schema = "part int, cells binary"
    met = partial.where("part is not null").select("part", "cells").mapInArrow(add, schema).repartition("part").mapInArrow(bits, schema)
    out = np.zeros((buckets // size, size // 8), np.uint8)
    for r in met.collect():
        out[r["part"]] = np.frombuffer(r["cells"], np.uint8)
    return out.reshape(-1)


def counted(docs: DataFrame, n: int, least: int, buckets: int, longest: int, known, full) -> DataFrame:
    """A pass: partial counts of phrases of ``n`` words, and bucket counts of those of ``n + 1``.

    ``known`` (a broadcast bitmap of the frequent phrases of ``n - 1`` words) and ``full`` (of the buckets of ``n`` words that
    are frequent) may let others through, never hold back a frequent phrase. A phrase is counted if both its parts of n - 1 words are
    known and its bucket is full; a phrase of n + 1 goes to the buckets if both its parts were counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(buckets, least)
        below, here = (None if b is None else np.frombuffer(b.value, np.uint8) for b in (known, full))
        for batch in steps(batches, limit=STEP, rows=1 << 20):
            rows: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                rows.setdefault(lang, []).append(i)
            for lang, own in rows.items():
                data = read(batch.column("text").take(pa.array(own)).to_pylist())
                seed = seed_of(lang)
                begin, end, hashes, piece = words_of(data)
                together = np.ones(len(hashes), bool)
                for k in range(1, n):
                    together = together[:-1] & (piece[k:] == piece[:-k])
                if n > 1:
                    ok = lit(below, grams(hashes, seed, n - 1))
                    together &= ok[: len(together)] & ok[1 : len(together) + 1]
                together &= lit(here, grams(hashes, seed, n))
                if n == 1:
                    found = Counter(data.replace(BREAK, b" ").split())
                else:
                    at = np.flatnonzero(together)
                    found = Counter([data[a:b] for a, b in zip(begin[at].tolist(), end[at + n - 1].tolist(), strict=True)])
                if found:
                    phrase = [b" ".join(x.split()).decode() for x in found]
                    nothing = pa.nulls(len(phrase), pa.int32()), pa.nulls(len(phrase), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase)), pa.array(phrase), pa.array(list(found.values()), pa.int64()), *nothing], ["lang", "phrase", "n", "part", "cells"])
                if n < longest:
                    next_ = together[:-1] & together[1:] & (piece[n:] == piece[:-n])
                    counters.add(grams(hashes, seed, n + 1)[next_])
        for part, cells in counters.parts():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([cells], pa.binary())], ["lang", "phrase", "n", "part", "cells"])

    return docs.mapInArrow(count, PARTIAL)


def marked(frequent: DataFrame, n: int, buckets: int) -> DataFrame:
    """Counters in which the buckets of the phrases of ``n`` words are lit."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(buckets, 1)
        for batch in batches:
            hashes = words_of(BREAK.join(p.encode() for p in batch.column("phrase").to_pylist()))[2].reshape(-1, n)
            seeds = np.array([seed_of(x) for x in batch.column("lang").to_pylist()], np.uint64)
            g = mixed(hashes[:, 0] ^ seeds)
            for k in range(1, n):
                g = mixed(g * GOLDEN + hashes[:, k])
            counters.add(g)
        for part, cells in counters.parts():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([cells], pa.binary())], ["part", "cells"])

    return frequent.select("lang", "phrase").mapInArrow(mark, "part int, cells binary")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of 1 to ``longest`` words with ``f >= least``, and ``lang, n``: all words by lang."""
    spark = docs.sparkSession
    own = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    found: list[DataFrame] = []
    totals, known, full = None, None, None
    for n in range(1, longest + 1):
        partial = written(counted(own, n, least, buckets, longest, known, full), "phrase-counts", "zstd")
        counts = partial.where("part is null")
        if totals is None:
            totals = written(counts.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
        sums = counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        found.append(written(sums.select("lang", "phrase", F.lit(n).alias("words"), "f"), "phrases"))
        for old in (known, full):
            if old is not None:
                old.destroy()
        if n < longest:
            full = spark.sparkContext.broadcast(merged(partial, buckets, least).tobytes())
            known = spark.sparkContext.broadcast(merged(marked(found[-1], n, buckets), buckets, 1).tobytes())
        dropped(partial)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, buckets: int = BUCKETS, whole: int = 100, salts: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each lang's ``top`` phrases of 2 to ``longest`` words, of ``docs`` (``text, lang``).

    A phrase (``a`` occurrences, at least ``least``) is cut in two where the score floor(1000 a n / (l r)) is lowest, ties to the
    earliest cut; n counts the lang's words. It goes if a longer one that holds it reaches ``whole`` hundredths of ``a``.

    Pass k tokenises every text again and counts phrases of k words exactly, of those that both bitmaps let through: the
    buckets filled in pass k - 1 (which stop counting at ``least``) and the frequent phrases of k - 1 words. Bitmaps have
    ``buckets`` bits whatever the input; the more phrases share a bucket, the fewer are held back, and the counts stay exact.
    Counts are summed in each task before they are shuffled, by lang and phrase. A lang's phrases are ranked in ``salts`` groups
    first, whose first ``top`` meet.

    Null texts are empty, a null lang is ``und``, rows that repeat count each time, other columns are ignored, an empty table
    gives no rows. A text longer than a step (4 MiB) is a step of its own, with some 25 bytes of memory for each of its own.
    """
    spark = docs.sparkSession
    phrases, totals = frequent_phrases(docs, least, longest, buckets)
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda begin, many: F.array_join(F.slice("w", begin, many), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    left, right = (phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(c)) for side, c in (("left", "l"), ("right", "r")))
    met = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    big = {c: f"cast({c} as decimal(19,0))" for c in "alrn"}  # products of up to 38 digits are exact, and so is their quotient
    met = met.withColumn("score", F.expr(f"(1000BD * {big['a']} * {big['n']}) div ({big['l']} * {big['r']})"))
    best = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r", "n")).alias("cut"))
    places = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda b: part(b, m)))))
    inner = candidates.where("words > 2").select("lang", places.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < whole * F.col("a")))
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    first = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 6) t(m))),
freq AS MATERIALIZED (SELECT lang, m, phrase, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE m > 1),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, k, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = lp JOIN freq y ON y.lang = c.lang AND y.phrase = rp JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[b:b + k - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS b FROM (SELECT *, unnest(range(2, m)) AS k FROM cand)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000"""
