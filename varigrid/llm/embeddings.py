"""Near-duplicate embeddings over a robust-pruned flat graph (operator 1).

Vectors are dealt to their nearest cluster centres, so shards overlap. Each shard builds a robust-pruned graph;
the lists of a vector in several shards are united. Every vector then searches each of its shards: greedily
from the medoids of the graph's parts, and outwards from every hit for as long as vectors in range are found.
The search stays in its shard; pairs of vectors that share no shard are compared exactly, in blocks of cells, but
for cells that lie too far from a vector to hold any in range. Links are verified in double precision. An audit compares the links of a sample of linked vectors with brute force,
each vector counting alike; where recall falls short, the graph is built anew, wider, and at last every pair is
compared exactly.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.common import bounded, dropped, written
from varigrid.llm.components import components

COSINE = 0.95
#: Vectors of a shard, about, and at most; a larger cluster is dealt in blocks, and every pair of blocks is a shard.
SHARD, LARGEST = 1000, 2000
#: Bounds: vectors that centres are fitted on, centres, linked queries of an audit, classes drawn to find these.
SAMPLE, CENTRES, AUDITED, DRAWN = 20_000, 2048, 256, 16_384
#: Bytes of a block of vectors that are compared exactly, and the least number of blocks.
BLOCK, BLOCKS = 10 << 20, 3
RECALL = 0.97
ALPHA = 1.2


def directions(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length; the largest component is taken out first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over the sample."""
    out = sample[np.random.Generator(np.random.Philox(key=1)).permutation(len(sample))[:k]]
    for _ in range(rounds):
        near = (sample @ out.T).argmax(1)
        sums = np.stack([np.bincount(near, sample[:, j], minlength=len(out)) for j in range(sample.shape[1])], 1)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), out)
    return out


def pruned(vectors: np.ndarray, degree: int, alpha: float = ALPHA, pool: int = 128) -> list[np.ndarray]:
    """Robust pruning of each vector's ``pool`` nearest: take the nearest left, drop what it stands before."""
    close = vectors @ vectors.T
    np.fill_diagonal(close, -2)
    pool = min(pool, len(vectors) - 1)
    near = np.argpartition(-close, pool - 1, axis=1)[:, :pool] if pool else np.zeros((len(vectors), 0), np.int64)
    out = []
    for i, nearest in enumerate(near):
        nearest = nearest[np.argsort(-close[i, nearest], kind="stable")]
        to_i = np.sqrt(np.maximum(0, 2 - 2 * close[i, nearest]))
        chosen: list[int] = []
        while len(nearest) and len(chosen) < degree:
            best = nearest[0]
            chosen.append(int(best))
            between = np.sqrt(np.maximum(0, 2 - 2 * close[best, nearest]))
            keep = alpha * between > to_i
            keep[0] = False
            nearest, to_i = nearest[keep], to_i[keep]
        out.append(np.array(chosen, np.int64))
    return out


def parts(neighbours: list[np.ndarray]) -> np.ndarray:
    """A number for each connected part of a graph."""
    label = np.full(len(neighbours), -1)
    for i in range(len(neighbours)):
        if label[i] < 0:
            label[i], stack = i, [i]
            while stack:
                for j in neighbours[stack.pop()]:
                    if label[j] < 0:
                        label[j] = i
                        stack.append(j)
    return label


def in_range(vectors: np.ndarray, neighbours: list[np.ndarray], entries: np.ndarray, query: int, cosine: float, beam: int, slack: float = 0.03) -> np.ndarray:
    """Greedy search with a beam from the entries nearest to the query, then outwards from all that is in or
    nearly in range, until nothing new is."""
    q = vectors[query]
    seen = np.zeros(len(vectors), bool)
    seen[entries] = True
    close = np.full(len(vectors), -2, np.float32)
    close[entries] = vectors[entries] @ q
    ahead = [(-float(close[e]), int(e)) for e in entries[np.argsort(-close[entries])[:8]]]
    best = sorted(c for c, _ in ahead)
    heapq.heapify(ahead)
    done = np.zeros(len(vectors), bool)
    while ahead:
        c, node = heapq.heappop(ahead)
        if len(best) >= beam and c > best[beam - 1]:
            break
        done[node] = True
        new = neighbours[node]
        new = new[~seen[new]]
        if len(new):
            seen[new] = True
            close[new] = vectors[new] @ q
            some = new[close[new] >= -best[beam - 1]] if len(best) >= beam else new
            for c, e in zip((-close[some]).tolist(), some.tolist(), strict=True):
                heapq.heappush(ahead, (c, e))
                bisect.insort(best, c)
            del best[beam:]
    while len(edge := np.flatnonzero((close >= cosine - slack) & ~done)):
        done[edge] = True
        new = np.unique(np.concatenate([neighbours[e] for e in edge]))
        new = new[~seen[new]]
        seen[new] = True
        close[new] = vectors[new] @ q
    hits = np.flatnonzero(close >= cosine)
    return hits[hits != query]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links ``a, b``: the smallest row that links reach."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (jump := label[label]).tolist() != label.tolist():
            label = jump
    return label


def compared(held: DataFrame, middle: np.ndarray, dimension: int, cosine: float, apart: bool = True) -> DataFrame:
    """``v, found, pairs, least`` by exact comparison, by pairs of blocks: of the pairs of vectors that share no cell, or
    of all pairs. A block is a run of home cells, or a part of a large one; each pair of vectors meets once.

    A vector goes to a block only where a cell of it can hold a vector in range. What lies in the cell of centre c
    is not nearer to the home's centre h than to c, so the sine of the angle to the plane between both,
    v (h - c) / |h - c|, bounds the angle to all of it from below.
    """
    counts = {int(r["home"]): int(r["count"]) for r in held.groupBy("home").count().collect()}  # a row per centre at most
    rows = max(1, min(BLOCK // (8 * dimension), -(-sum(counts.values()) // BLOCKS)))
    first, many, block, filled = np.zeros(len(middle), np.int64), np.ones(len(middle), np.int64), 0, 0
    for c in range(len(middle)):
        n = counts.get(c, 0)
        if filled and filled + n > rows:
            block, filled = block + 1, 0
        first[c], many[c] = block, max(1, -(-n // rows))
        block, filled = (block + int(many[c]), 0) if many[c] > 1 else (block, filled + n)
    sine = float(np.sqrt(1 - cosine * cosine)) + 1e-6 if cosine > 0 else 2.0
    spread = np.maximum(0, (middle * middle).sum(1)[:, None] + (middle * middle).sum(1) - 2 * middle @ middle.T)

    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            home = batch.column("home").to_numpy()
            near = directions(np.stack([np.frombuffer(x) for x in batch.column("vector").to_pylist()])) @ middle.T
            reach = near[np.arange(len(home)), home][:, None] - near <= sine * np.sqrt(spread[home]) + 1e-9
            reach[np.arange(len(home)), home] = not apart
            own, pairs = [], []
            for i, (v, h) in enumerate(zip(batch.column("v").to_pylist(), home.tolist(), strict=True)):
                own.append(int(first[h]) + xxhash.xxh3_64_intdigest(str(v)) % int(many[h]))
                cells = np.flatnonzero(reach[i])
                met = set(first[cells].tolist())
                for c in cells[many[cells] > 1].tolist():
                    met.update(range(int(first[c]), int(first[c] + many[c])))
                pairs.append([f"{min(b, own[-1]):09d}.{max(b, own[-1]):09d}" for b in sorted(met)])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("v", "n", "vector", "cells")), pa.array(own, pa.int64()), pa.array(pairs, pa.list_(pa.string()))], ["v", "n", "vector", "cells", "block", "pairs"])

    def met(table: pa.Table) -> pa.Table:
        table = table.sort_by("v")
        ids, count, block = (table.column(x).to_numpy() for x in ("v", "n", "block"))
        exact = directions(np.stack([np.frombuffer(x) for x in table.column("vector").to_pylist()]))
        cells = np.array(table.column("cells").to_pylist())
        vectors = exact.astype(np.float32)
        low, high = map(int, table.column("pair")[0].as_py().split("."))
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        total, pairs, label = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i in range(0, len(left), 1024):
            for j in range(0, len(right), 4096):
                if low == high and right[j : j + 4096][-1] <= left[i]:
                    continue
                a, b = np.nonzero(vectors[left[i : i + 1024]] @ vectors[right[j : j + 4096]].T >= cosine - 1e-4)
                a, b = left[i + a], right[j + b]
                if low == high:
                    a, b = a[a < b], b[a < b]
                if apart:
                    alone = np.ones(len(a), bool)
                    for x in range(cells.shape[1]):
                        alone &= (cells[a, x][:, None] != cells[b]).all(1)
                    a, b = a[alone], b[alone]
                good = np.concatenate([np.zeros(0, bool), *((exact[a[k : k + 8192]] * exact[b[k : k + 8192]]).sum(1) >= cosine for k in range(0, len(a), 8192))])
                a, b = a[good], b[good]
                for x, y in ((a, b), (b, a)):
                    np.add.at(total, x, count[y])
                    np.add.at(pairs, x, 1)
                label = joined(label, a, b)
        some = np.flatnonzero(pairs)
        return pa.table({"v": pa.array(ids[some]), "found": pa.array(total[some]), "pairs": pa.array(pairs[some]), "least": pa.array(ids[label[some]])})

    each = held.mapInArrow(placed, "v long, n long, vector binary, cells array<long>, block long, pairs array<string>")
    return each.select("v", "n", "vector", "cells", "block", F.explode("pairs").alias("pair")).groupBy("pair").applyInArrow(met, "v long, found long, pairs long, least long")


def links(classes: DataFrame, dimension: int, cosine: float, overlap: int, degree: int, beam: int, exact: bool = False) -> DataFrame:
    """``v, found, pairs, least``: for each class, its number of linked vectors and of linked classes, and the smallest class that links within
    its shard, or pair of blocks, reach, by shard or pair. With ``exact`` no graph is built, and every pair is compared."""
    n = classes.count()
    rows = min(SAMPLE, max(1000, (24 << 20) // (8 * dimension)))
    sample = bounded(classes, rows, "v").select("vector").toPandas()["vector"]
    unit = directions(np.stack([np.frombuffer(x) for x in sample])) if len(sample) else np.zeros((1, dimension))
    middle = centres(unit, int(min(CENTRES, len(unit), max(1, -(-n * overlap // SHARD)))))
    take = min(overlap, len(middle))

    def dealt(batches):
        for batch in batches:
            if batch.num_rows:
                close = directions(np.stack([np.frombuffer(x) for x in batch.column("vector").to_pylist()])) @ middle.T
                near = np.argpartition(-close, take - 1, axis=1)[:, :take]
                home = near[np.arange(len(near)), np.take_along_axis(close, near, 1).argmax(1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.tolist(), pa.int64()), pa.array(np.sort(near, 1).tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "home", "cells"])

    held = written(classes.mapInArrow(dealt, "v long, n long, vector binary, home long, cells array<long>"), "cells")
    if exact:
        out = written(compared(held, middle, dimension, cosine, apart=False), "vector-links")
        dropped(held)
        return out
    large = held.select(F.explode("cells").alias("cell")).groupBy("cell").count().where(F.col("count") > LARGEST).collect()  # a row per centre at most
    blocks = {int(r["cell"]): -(-2 * int(r["count"]) // LARGEST) for r in large}

    def shards(batches):
        """Shards of each vector: its cells, or the pairs of blocks that its own block belongs to."""
        for batch in batches:
            out = []
            for v, cells in zip(batch.column("v").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                own = []
                for cell in cells:
                    m = blocks.get(cell, 1)
                    b = xxhash.xxh3_64_intdigest(str(v)) % m
                    own += [f"{cell:06d}.{min(b, j):06d}.{max(b, j):06d}" for j in range(m)]
                out.append(sorted(own))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], [*batch.schema.names, "shards"])

    sharded = written(held.mapInArrow(shards, "v long, n long, vector binary, home long, cells array<long>, shards array<string>").drop("home", "cells"), "shards")
    each = sharded.select("v", "n", "vector", "shards", F.explode("shards").alias("shard"))

    def built(table: pa.Table) -> pa.Table:
        ids = table.column("v").to_numpy()
        vectors = directions(np.stack([np.frombuffer(x) for x in table.column("vector").to_pylist()])).astype(np.float32)
        return pa.table({"v": pa.array(ids), "near": pa.array([ids[x].tolist() for x in pruned(vectors, degree)], pa.list_(pa.int64()))})

    graph = each.select("v", "vector", "shard").groupBy("shard").applyInArrow(built, "v long, near array<long>")
    united = written(graph.groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

    def searched(table: pa.Table) -> pa.Table:
        table = table.sort_by("v")
        shard, ids, count = table.column("shard")[0].as_py(), table.column("v").to_numpy(), table.column("n").to_numpy()
        exact = directions(np.stack([np.frombuffer(x) for x in table.column("vector").to_pylist()]))
        vectors = exact.astype(np.float32)
        lists: list[set[int]] = [set() for _ in ids]
        for i, near in enumerate(table.column("near").to_pylist()):
            near = np.array(near, np.int64)
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            for j in at[ids[at] == near].tolist():
                lists[i].add(j)
                lists[j].add(i)
        neighbours = [np.array(sorted(x), np.int64) for x in lists]
        label = parts(neighbours)
        entries = np.array([m[(vectors[m] @ vectors[m].mean(0)).argmax()] for m in (np.flatnonzero(label == p) for p in np.unique(label))])
        own = [set(x) for x in table.column("shards").to_pylist()]
        found: list[set[int]] = [set() for _ in ids]
        for i in range(len(ids)):
            for j in in_range(vectors, neighbours, entries, i, cosine - 1e-4, beam).tolist():
                found[i].add(j)
                found[j].add(i)
        total, pairs, linked = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), [np.zeros(0, np.int64)] * len(ids)
        for i, hits in enumerate(found):
            j = np.array(sorted(hits), np.int64)
            linked[i] = j = j[exact[j] @ exact[i] >= cosine]
            here = [int(count[x]) for x in j.tolist() if min(own[i] & own[x]) == shard]
            total[i], pairs[i] = sum(here), len(here)
        least = ids[parts(linked)]  # ids ascend, so the part's first is its smallest
        some = np.flatnonzero((total > 0) | (least < ids))
        return pa.table({"v": pa.array(ids[some]), "found": pa.array(total[some]), "pairs": pa.array(pairs[some]), "least": pa.array(least[some])})

    found = each.join(united, "v").groupBy("shard").applyInArrow(searched, "v long, found long, pairs long, least long")
    if take < len(middle):
        found = found.unionByName(compared(held, middle, dimension, cosine))
    out = written(found, "vector-links")
    dropped(held, sharded, united)
    return out


def brute(classes: DataFrame, queries: list[tuple[int, bytes]], cosine: float) -> dict[int, int]:
    """Numbers of linked classes of a bounded list of classes, against all classes in blocks."""
    ids = np.array([v for v, _ in queries], np.int64)
    unit = directions(np.stack([np.frombuffer(x) for _, x in queries]))

    def counted(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                near = directions(np.stack([np.frombuffer(x) for x in part.column("vector").to_pylist()])) @ unit.T >= cosine
                near &= part.column("v").to_numpy()[:, None] != ids
                total += near.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["v", "links"])

    return {r["v"]: r["links"] for r in classes.mapInArrow(counted, "v long, links long").groupBy("v").agg(F.sum("links").alias("links")).collect()}


def audit(classes: DataFrame, dimension: int, cosine: float) -> tuple[dict[int, int], bool]:
    """True numbers of linked classes of at most ``AUDITED`` classes that have a link besides equal vectors, and whether
    they can tell the recall. Classes are drawn, ever more of them, until so many are linked or the bound of the draw
    is met; fewer come back then, and none tell the recall only where all classes were drawn."""
    most = max(AUDITED, min(DRAWN, (24 << 20) // (8 * dimension)))
    n, drawn = classes.count(), min(most, 4 * AUDITED)
    while True:
        queries = [(r["v"], r["vector"]) for r in bounded(classes, drawn, "v").select("v", "vector").collect()]
        linked = {v: t for v, t in (brute(classes, queries, cosine) if queries else {}).items() if t}
        if len(linked) >= AUDITED or drawn >= min(n, most):
            return dict(sorted(linked.items(), key=lambda x: xxhash.xxh3_64_intdigest(str(x[0])))[:AUDITED]), bool(linked) or n <= drawn
        drawn = min(most, 4 * drawn)


def near_vectors(rows: DataFrame, cosine: float = COSINE, overlap: int = 2, degree: int = 24, beam: int = 24, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept, audited_recall`` of every row of ``rows`` (``vec_id, embedding``).

    Equal vectors are one class and link with each other. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Vectors of different lengths do not link. Rows that repeat a
    vec_id with the same vector count once and each come back; null ids are kept and link with nothing. An
    empty table gives no rows; other columns are ignored. ``audited_recall`` is the mean share of links found over the
    audited vectors (1 where there is no link to find, or every pair was compared because no audited vector had any).
    """

    def read(batches):
        for batch in batches:
            keys, vectors = [], []
            for x, v in zip(batch.column("embedding").to_pylist(), batch.column("vec_id").to_pylist(), strict=True):
                a = np.array([np.nan if y is None else y for y in x], np.float64) if x else np.zeros(0)
                good = v is not None and len(a) > 0 and bool(np.isfinite(a).all()) and bool(a.any())
                vectors.append((a + 0.0).tobytes() if good else None)  # -0.0 is 0.0
                keys.append(xxhash.xxh3_128_digest(vectors[-1]) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "key", "vector"])

    all_ = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(read, "vec_id long, key binary, vector binary"), "vectors")
    good = all_.where("key is not null")
    classes = written(good.groupBy("key").agg(F.min("vec_id").alias("v"), F.countDistinct("vec_id").alias("n"), F.first("vector").alias("vector")).drop("key").withColumn("d", F.octet_length("vector") / 8), "vector-classes")
    total, least, audited = None, None, None
    for d in sorted(int(r["d"]) for r in classes.select("d").distinct().collect()):
        own = classes.where(F.col("d") == d).drop("d")
        truth, tells = audit(own, d, cosine)
        for wide in (1, 2, 3, 0) if tells else (0,):  # 0: every pair is compared
            got = links(own, d, cosine, overlap + wide - 1, degree * wide, beam * wide) if wide else links(own, d, cosine, overlap, degree, beam, exact=True)
            counts = got.groupBy("v").agg(F.sum("found").alias("found"), F.sum("pairs").alias("pairs"))
            seen = {r["v"]: r["pairs"] for r in counts.where(F.col("v").isin(list(truth))).collect()}
            counts = counts.drop("pairs")
            reached = float(np.mean([min(seen.get(v, 0) / t, 1) for v, t in truth.items()])) if truth else 1.0
            if reached >= recall or not wide:
                break
            dropped(got)
        audited = reached if audited is None else min(audited, reached)
        ends = got.select(F.col("v").alias("a"), F.col("least").alias("b"))
        total = counts if total is None else total.unionByName(counts)
        least = ends if least is None else least.unionByName(ends)
    out = all_.select("vec_id", "key")
    if total is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audited_recall"))
    known = good.groupBy("key").agg(F.min("vec_id").alias("v"), F.countDistinct("vec_id").alias("n"))
    roots = components(least).withColumnRenamed("a", "v")
    known = known.join(total, "v", "left").join(roots, "v", "left").select(F.col("key").alias("_key"), (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("_links"), F.coalesce("root", "v").alias("_root"))
    out = out.join(known, F.col("key") == F.col("_key"), "left")
    component = F.coalesce("_root", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(float(audited)).alias("audited_recall"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
