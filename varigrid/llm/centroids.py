"""Exact integer k-means: float32 screening with rounding-error intervals, exact sums and distances (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.common import quoted, written

#: Components up to which squared distances over 64 dimensions stay below 2^63; vectors beyond are handled in Python integers.
SMALL = 1 << 27
LARGEST = np.finfo(np.float32).max
#: Vectors that are screened at once.
AT_ONCE = 8192
#: Sums travel as digits of LIMB bits, the last one signed: 160 bits hold a float's 2^136, and 2^20 partial sums fit a long.
LIMB, LIMBS = 40, 4
UNIT = 2.0**-24
MOST = (1 << 63) - 1


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite doubles: int64 where all are below 2^62, else Python integers."""
    scaled = np.floor(values * 256.0)
    return scaled.astype(np.int64) if not scaled.size or np.abs(scaled).max() < 2.0**62 else np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)


def kept(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values (doubles) of the vectors with ``dim`` components, all finite floats."""
    column = batch.column("embedding")
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    values = pa.compute.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(invalid="ignore"):
        good = (np.abs(values) <= LARGEST).all(axis=1)
    return at[good], values[good]


class Screen:
    """The nearest centroid of integer vectors, exactly.

    |x - c|^2 - |x|^2 = |c|^2 - 2 x.c. The products x.c come from one float32 matrix product. A sum of d products of
    float32 numbers, in whatever order and with or without fused steps, is off by at most d u / (1 - d u) times |x||c|
    (u = 2^-24); rounding x and c to float32 adds 2 u + u^2 each way. Doubling that bound covers the rounding of the
    intervals' own double arithmetic as well. A vector whose lowest interval lies apart from all others is settled; those
    whose intervals overlap it are computed again in integers, and the smallest number wins a tie. The fast path holds
    for components up to 2^27, where all integer steps fit 64 bits; rows beyond are compared in Python integers only.
    """

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        self.small = all(abs(x) <= SMALL for c in centroids for x in c)
        if self.small:
            self.ints = np.array(centroids, np.int64)
            self.floats = self.ints.astype(np.float32).T.copy()
            self.squares = (self.ints * self.ints).sum(axis=1)
            dim = self.ints.shape[1]
            self.slack = 2 * 2 * ((dim + 4) * UNIT / (1 - (dim + 4) * UNIT)) * np.sqrt(self.squares.astype(np.float64)) * (1 + 2.0**-40)
        self.compared = 0

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances (at most 2^63 - 1)."""
        if self.small and x.dtype == np.int64 and (not x.size or np.abs(x).max() <= SMALL):
            return self.fast(x)
        fits = np.array([self.small and all(abs(int(v)) <= SMALL for v in row) for row in x], bool)
        label, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
        if fits.any():
            label[fits], distance[fits] = self.fast(x[fits].astype(np.int64))
        for i in np.flatnonzero(~fits):
            row = [int(v) for v in x[i]]
            best, label[i] = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), k) for k, c in enumerate(self.exact))
            distance[i] = min(best, MOST)
        return label, distance

    def fast(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = self.squares - 2.0 * (x.astype(np.float32) @ self.floats).astype(np.float64)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 2.0**-40)
        # what the products may be off, and a unit in the last place for the doubles' own sums
        off = norms[:, None] * self.slack[None, :] + (np.abs(score) + self.squares) * 2.0**-50
        bound = (score + off).min(axis=1)
        near = score - off <= bound[:, None]
        label = near.argmax(axis=1).astype(np.int32)
        open_ = np.flatnonzero(near.sum(axis=1) > 1)
        row, number = np.nonzero(near[open_])
        if len(row):
            self.compared += len(row)
            gap = x[open_[row]] - self.ints[number]
            exact = (gap * gap).sum(axis=1)
            order = np.lexsort((number, exact, row))
            first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
            label[open_[row[first]]] = number[first]
        gap = x - self.ints[label]
        return label, (gap * gap).sum(axis=1)


def limbs(total: int) -> list[int]:
    """``total`` in digits of LIMB bits from the lowest; the last is signed."""
    return [(total >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)] + [total >> (LIMB * (LIMBS - 1))]


def drawn(vectors: DataFrame, k: int, dim: int, seed: int) -> list[list[int]]:
    """The first centroids: ``k`` rows at most reach the driver."""
    usable = (F.size("embedding") == dim) & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(float(LARGEST)), F.lit(False)))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    values = F.transform("embedding", lambda x: x.cast("double")).alias("v")
    rows = vectors.where(usable).select(rank.alias("rank"), values).orderBy(F.asc_nulls_last("rank"), "v").limit(k).collect()
    return [[int(x) for x in row] for row in whole(np.array([r["v"] for r in rows], np.float64).reshape(-1, dim))]


def moved(vectors: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """The centroids after a round: floors of exact means. Partial sums, a row a task and centroid, meet by number."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        totals, counts = [[0] * dim for _ in range(k)], [0] * k
        for _, x in read(batches, dim):
            label, _ = screen(x)
            for c in np.unique(label):
                members = x[label == c]  # at most AT_ONCE rows: their sum fits where no component passes SMALL
                part = members.sum(axis=0) if x.dtype == np.int64 and np.abs(members).max() <= SMALL else members.astype(object).sum(axis=0)
                totals[c] = [a + int(b) for a, b in zip(totals[c], part, strict=True)]
                counts[c] += len(members)
        some = [c for c in range(k) if counts[c]]
        digits = pa.array([[d for t in totals[c] for d in limbs(t)] for c in some], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counts[c] for c in some], pa.int64()), digits], ["cluster", "n", "digits"])

    parts = vectors.select("embedding").mapInArrow(sums, "cluster int, n long, digits array<long>")
    met = parts.select("cluster", "n", F.posexplode("digits").alias("place", "digit")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("digit").alias("digit"))
    out = [list(c) for c in centroids]
    found: dict[int, list[int]] = {}
    many: dict[int, int] = {}
    for r in met.collect():  # k * dim * LIMBS rows
        found.setdefault(r["cluster"], [0] * dim)[r["place"] // LIMBS] += r["digit"] << (LIMB * (r["place"] % LIMBS))
        many[r["cluster"]] = r["n"]
    for c, total in found.items():
        out[c] = [t // many[c] for t in total]
    return out


def read(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches' usable rows and their integers."""
    for batch in batches:
        for begin in range(0, batch.num_rows, AT_ONCE):
            piece = batch.slice(begin, AT_ONCE)
            at, values = kept(piece, dim)
            if len(at):
                yield piece.take(pa.array(at)), whole(values)


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: a row per vector (``vec_id, embedding``) with
    exactly ``dim`` components, none null or non-finite; others go. A component is the integer floor(256 x).

    The first centroids are the ``k`` vectors with the smallest sha256 of ``seed:vec_id`` (null ids last, rows of one id by
    their values; fewer vectors, fewer centroids). Each of ``rounds`` rounds assigns every vector to the nearest centroid, ties
    to the smaller number, and moves each centroid that has vectors to the floors of their exact means; then vectors are
    assigned once more. A round reads the vectors once and shuffles a partial sum a task and centroid; only centroids reach
    the driver. Whatever cluster holds most rows, no row moves. Distances and their sums beyond 2^63 - 1 are given as
    that; doubles beyond the range of floats count as non-finite. Rows that repeat stay rows; an empty table gives no rows.
    """
    names = {c.lower(): c for c in vectors.columns}
    own = vectors.select(F.col(quoted(names["vec_id"])).cast("long").alias("vec_id"), F.col(quoted(names["embedding"])).alias("embedding"))
    centroids = drawn(own, k, dim, seed)
    if centroids:
        for _ in range(rounds):
            centroids = moved(own, centroids, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if centroids:
            screen = Screen(centroids)
            for rows, x in read(batches, dim):
                label, distance = screen(x)
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(label, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = written(own.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    pick = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>"), at) if values else F.lit(None).cast(kind)
    return assigned.select(
        "vec_id", "cluster", "distance",
        pick([min(sums.get(c, 0), MOST) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"),
        pick(hashes, "string").alias("centroid_sha256"),
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle_sql(k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> str:
    """SQL over ``embeddings`` of few rows: every round joins all vectors with all centroids by component."""
    out = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"v AS MATERIALIZED (SELECT row, i, v[i] AS x FROM kept, range(1, {dim + 1}) t(i))",
        f"first AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
        f"c0 AS MATERIALIZED (SELECT c, i, v[i] AS y FROM first, range(1, {dim + 1}) t(i))",
    ]
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT row, min({{'d': d, 'c': c}}) AS best FROM (SELECT row, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM v JOIN c{r} USING (i) GROUP BY row, c) GROUP BY row)"
    for r in range(rounds):
        out.append(near(r))
        out.append(f"m{r} AS MATERIALIZED (SELECT best.c AS c, i, CAST(sum(x) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n FROM a{r} JOIN v USING (row) GROUP BY ALL)")
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{r} LEFT JOIN m{r} USING (c, i))")
    out.append(near(rounds))
    out.append(f"h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"WITH {', '.join(out)} SELECT vec_id, CAST(c AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (row) JOIN h ON h.c = best.c"


ORACLE_SQL = oracle_sql()
