"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification (operator 3, a stage)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.common import dropped, numbered, steps, written
from varigrid.llm.components import components
from varigrid.llm.shingles import GOLDEN, mixed, shingle_sets

REGISTERS, ROWS = 216, 6  # 36 bands of 6: a pair of similarity 0.8 meets with probability 1 - 2e-5
SIMILARITY = 0.8
#: Pairs whose signatures agree in less are not compared by their shingles: more than seven standard errors below a similarity
#: of 0.8 (0.027 for 216 registers), so a link is lost with a chance below 1e-11, a millionth of what the bands lose.
LIKELY = 0.6
#: Members of a bucket that one task joins with what is known of the bucket; a larger bucket is dealt by salt.
SALTED = 1024
#: Members of a bucket that one task compares; a larger bucket is dealt in blocks, and each pair of blocks is a task's.
BLOCK = 256
#: Bytes of a task's shingles up to which its pairs are bounded all at once; in larger ones they are compared one by one.
SHINGLES = 32 << 20


def signatures(sets: list[tuple[np.ndarray, np.ndarray, bytes]], registers: int = REGISTERS) -> np.ndarray:
    """A row of ``registers`` per set; two sets agree in one with the probability Jaccard of their weights.

    An element of weight w arrives at random registers in a Poisson process of rate w, and a register keeps
    the element that came first. All elements of a batch take their next arrival together; an element drops
    out once it is later than every register of its set.
    """
    sizes = np.array([len(h) for h, _, _ in sets])
    key = np.concatenate([h for h, _, _ in sets]) if len(sets) else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w, _ in sets]).astype(np.float64) if len(sets) else np.zeros(0)
    owner = np.repeat(np.arange(len(sets)), sizes)
    first = np.full(len(sets) * registers, np.inf)
    kept = np.zeros(len(sets) * registers, np.uint64)
    time, turn = np.zeros(len(key)), 0
    while len(key):
        many = min(64, max(1, (1 << 15) // len(key)))  # a few elements take several arrivals at once
        turns = np.array([2 * t * int(GOLDEN) & (1 << 64) - 1 for t in range(turn + 1, turn + many + 1)], np.uint64)
        turn += many
        draw = mixed(key[:, None] + turns)
        arrival = time[:, None] - np.cumsum(np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), 1) / weight[:, None]
        place = owner[:, None] * registers + (mixed(draw + GOLDEN) >> np.uint64(33)).astype(np.int64) % registers
        np.minimum.at(first, place.ravel(), arrival.ravel())
        won = arrival == first[place]
        kept[place[won]] = np.broadcast_to(key[:, None], won.shape)[won]
        time = arrival[:, -1]
        present = owner[np.concatenate([[True], owner[1:] != owner[:-1]])]
        last = np.zeros(len(sets))
        last[present] = first.reshape(-1, registers)[present].max(1)
        go = time < last[owner]
        key, weight, owner, time = key[go], weight[go], owner[go], time[go]
    return kept.reshape(-1, registers)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each run of ``rows`` registers, different from band to band."""
    n, m = signature.shape
    parts = signature.reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64) * GOLDEN, (n, m // rows)).copy()
    for j in range(rows):
        out = mixed(out ^ parts[:, :, j]) * np.uint64(0x2545F4914F6CDD1D)
    return out.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i): the Jaccard of sets if all weights are 1."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.searchsorted(ratio, ratio, side="left")
    x_rest = a[1].sum() - np.concatenate([[0], np.cumsum(x)])[below]
    y_rest = b[1].sum() - y.sum() + np.concatenate([[0], np.cumsum(y)])[below]
    return float((1 / (x_rest / x + y_rest / y)).sum())


def likely(signature: np.ndarray, root: np.ndarray, band: int, block: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different roots that look similar and whose first shared band is ``band``.

    Members of two blocks meet only across the blocks; a block alone meets itself.
    """
    m = signature.shape[1]
    across = block.min() != block.max()
    rest = np.flatnonzero(block == block.max()) if across else np.arange(len(block))
    own = np.flatnonzero(block == block.min()) if across else rest
    ahead, behind = [none := np.zeros(0, np.int64)], [none]
    for a in range(0, len(own), 64):
        one, other = own[a : a + 64], rest if across else rest[a:]
        same = signature[one, None, :] == signature[None, other, :]
        ok = np.count_nonzero(same, 2) >= LIKELY * m
        ok &= root[one, None] != root[other]
        if not across:
            ok &= one[:, None] < other
        i, j = np.nonzero(ok)
        if len(i):
            shared = same[i, j].reshape(len(i), m // rows, rows).all(2)
            mine = shared.argmax(1) == band
            ahead.append(one[i[mine]])
            behind.append(other[j[mine]])
    return np.concatenate(ahead), np.concatenate(behind)


def ruled_out(sets: list[tuple[np.ndarray, np.ndarray]], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of places surely have a similarity below ``least``, from one product of matrices for all pairs.

    Of weights that sum to X and Y, let P and Q be those of the shared shingles. The probability Jaccard is at most
    1 / (X / P + Y / Q - 1): with r the ratio of an element's weights x and y, its term is x / D(r), and D(r) is at least
    X + rY - min(P, rQ); that is concave in 1 / r, so by Jensen's inequality all terms together are at most those of one
    ratio P / Q. Equal where shared weights have one ratio, as in sets. Rounding is far below 1e-9. No pair is ruled out
    where the shingles take more than ``SHINGLES`` bytes, or where pairs are fewer than sets.
    """
    sizes = np.array([len(h) for h, _ in sets])
    if len(i) < len(sets) or 8 * sizes.sum() > SHINGLES:
        return np.zeros(len(i), bool)
    _, number, often = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)
    kept = np.flatnonzero(often[number] > 1)  # a shingle of one member is shared by no pair
    column, row = (np.cumsum(often > 1) - 1)[number[kept]], np.repeat(np.arange(len(sets)), sizes)[kept]
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)[kept]
    order = np.argsort(column, kind="stable")
    column, row, weight = column[order], row[order], weight[order]
    shared = np.zeros((len(sets), len(sets)))  # of the row's weights, those of shingles that the column's set holds too
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        part = slice(*np.searchsorted(column, (a, a + 2048)))
        counts = np.zeros((len(sets), 2048))
        counts[row[part], column[part] - a] = weight[part]
        shared += counts @ (counts > 0).T.astype(np.float64)
    total = np.array([w.sum() for _, w in sets], np.float64)
    with np.errstate(divide="ignore"):
        return 1 / (total[i] / shared[i, j] + total[j] / shared[j, i] - 1) < least - 1e-9


def of_band(members: DataFrame, facts: DataFrame, large: int = SALTED) -> DataFrame:
    """``members`` joined with ``facts``, a row per ``band``; both have ``n``, the members of the band.

    A band of more than ``large`` members is dealt over several groups by salt, to each of which its facts are sent."""
    parts = F.ceil(F.col("n") / F.lit(large)).cast("int")
    dealt = members.withColumn("_salt", F.pmod(F.xxhash64(F.lit(9), "v"), parts).cast("int"))
    sent = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(sent, ["band", "_salt"]).drop("_salt")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``doc_id, text_key, component_id, kept`` for every row: the smallest doc_id of its group, and whether the group is left to it.

    A document is a doc_id with a text; ``text_key`` is the text's MD5, so rows that repeat both are one document, and an
    id with several texts is several documents. Of a group one document is kept: the one of the smallest doc_id
    (a null id comes last), and of the smallest key among its texts.

    Texts with the same words are one vertex. Vertices that share a band are candidates. Each bucket's hub, the
    member that meets most others over all bands, is compared with all its members first: a line of comparisons,
    not a square, and it joins the groups of copies. In buckets that still hold several groups, blocks of the
    members outside the largest group meet each other and blocks of the largest group, which does not meet
    itself, each pair in the first band it shares: first by signatures, then those that look similar by their
    shingles (a bound for all pairs at once rules out most), and only links that join groups leave a task. Links have a probability Jaccard of counted
    five-word shingles of at least ``similarity``, computed exactly. No bucket is cut.

    Null and empty texts, and texts without words, link with nothing and are kept. Rows without an id are documents
    like others; the ``component_id`` of a group without any id is null. Texts of any length are read whole. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return _grouped(docs, similarity, block)[0]


def _grouped(docs: DataFrame, similarity: float, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """:func:`near_duplicates`, and the tables that its rows are read from."""

    def sketched(batches):
        for batch in steps(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            signed = signatures(sets)
            hashed, short = bands(signed), mixed(signed).astype("<u2")
            some = [len(h) > 0 for h, _, _ in sets]
            rows = [x if s else [] for x, s in zip(hashed.tolist(), some, strict=True)]
            keys = [d if s else None for (_, _, d), s in zip(sets, some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64())), pa.array([x.tobytes() for x in short], pa.binary())], ["doc_id", "text_key", "words", "bands", "signature"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    rows = written(texts.mapInArrow(sketched, "doc_id long, text_key binary, words binary, bands array<long>, signature binary"), "signatures")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    vertices = rows.where("words is not null").groupBy("words").agg(F.min(one).alias("one"), F.first(F.struct("bands", "signature")).alias("s"))
    vertices = written(vertices.select("words", "one", "s.bands", "s.signature").withColumn("v", F.monotonically_increasing_id()), "vertices")
    met = vertices.select("v", F.posexplode("bands").alias("i", "band"))
    shared = met.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(shared, "bucket-sizes")
    members = written(met.join(shared, "band"), "buckets")
    central = members.groupBy("v").agg(F.sum("n").alias("score"))
    hubs = members.select("band", "v", "n").join(central, "v").groupBy("band").agg(F.max("n").alias("n"), F.max(F.struct("score", (-F.col("v")).alias("v"))).alias("hub")).select("band", "n", (-F.col("hub.v")).alias("hub"))
    stars = written(of_band(members.select("band", "v", "n"), hubs).where("v <> hub").select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct(), "stars")

    def hashed(batches):
        for batch in steps(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array([h.tobytes() for h, _, _ in sets], pa.binary()), pa.array([packed(w) for _, w, _ in sets], pa.binary())], ["v", "h", "w"])

    wanted = vertices.select("v", F.col("one.doc_id").alias("_d"), F.col("one.text_key").alias("_k")).join(central.select("v"), "v", "left_semi")
    own = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k"))).select("v", "text")
    sets = written(own.mapInArrow(hashed, "v long, h binary, w binary").dropDuplicates(["v"]), "shingles")

    def compared(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                left, right = ([unpacked(h, w) for h, w in zip(part.column(f"h{k}").to_pylist(), part.column(f"w{k}").to_pylist(), strict=True)] for k in (1, 2))
                s = [probability_jaccard(x, y) for x, y in zip(left, right, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s, pa.float64())], ["a", "b", "s"])

    both = stars.join(sets.select(F.col("v").alias("a"), F.col("h").alias("h1"), F.col("w").alias("w1")).hint("merge"), "a").join(sets.select(F.col("v").alias("b"), F.col("h").alias("h2"), F.col("w").alias("w2")).hint("merge"), "b")
    links = written(both.mapInArrow(compared, "a long, b long, s double").where(F.col("s") >= similarity).select("a", "b"), "links")
    roots = written(components(links).withColumnRenamed("a", "v"), "roots")
    grouped = members.join(roots, "v", "left").select("band", "i", "v", "n", F.coalesce("root", "v").alias("root"))
    grouped = written(grouped.where("n > 2"), "grouped")
    counts = grouped.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
    split = counts.groupBy("band").agg(F.max_by("root", F.struct("k", (-F.col("root")).alias("r"))).alias("top"), F.max("k").alias("nd"), F.sum("k").alias("n")).where("nd < n")
    stray = F.col("root") != F.col("top")
    split = split.select("band", "n", "top", *(F.ceil(c / F.lit(max(1, block // 2))).cast("int").alias(name) for name, c in (("ds", F.col("n") - F.col("nd")), ("dd", F.col("nd")))))
    left = of_band(grouped, split).withColumn("block", F.pmod(F.xxhash64("v"), F.when(stray, F.col("ds")).otherwise(F.col("dd"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    key = lambda one, other: F.struct(one.cast("int").alias("b1"), other.cast("int").alias("b2"))
    among = F.transform(upto("ds"), lambda j: key(F.least("block", j), -1 - F.greatest("block", j)))
    keys = F.when(stray, F.concat(among, F.transform(upto("dd"), lambda j: key(F.col("block"), j)))).otherwise(F.transform(upto("ds"), lambda j: key(j, F.col("block"))))
    left = left.select("band", "i", "v", "root", F.when(stray, F.col("block")).otherwise(F.lit(-1)).alias("block"), keys.alias("keys")).join(vertices.select("v", "signature"), "v")
    tasks = left.withColumn("key", F.explode("keys")).select("band", "key.b1", "key.b2", "i", "v", "root", "block", "signature")

    def groups(batches, columns):
        """Rows of one task after another; they stand in a row."""
        key, group = None, []
        for batch in batches:
            for now, *row in zip(zip(*(batch.column(c).to_pylist() for c in ("band", "b1", "b2")), strict=True), *(batch.column(c).to_pylist() for c in columns), strict=True):
                if now != key and group:
                    yield key, [list(x) for x in zip(*group, strict=True)]
                    group = []
                key = now
                group.append(row)
        if group:
            yield key, [list(x) for x in zip(*group, strict=True)]

    def alike(i, root, part, signed):
        return likely(np.frombuffer(b"".join(signed), "<u2").reshape(len(signed), -1), np.array(root), i[0], np.array(part))

    def met_in(batches):
        """The members of a task that look similar to one of another group."""
        for key, (i, v, root, part, signed) in groups(batches, ("i", "v", "root", "block", "signature")):
            some = np.unique(np.concatenate(alike(i, root, part, signed))) if len(v) > 1 else ()
            if len(some):
                yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, i[k], v[k], root[k], part[k]), strict=True)) for k in some.tolist()], schema)

    def linked_in(batches):
        """Links that join groups of a task; pairs that are joined already are passed over."""
        for _, (i, v, root, part, signed, h, w) in groups(batches, ("i", "v", "root", "block", "signature", "h", "w")):
            joined = {r: r for r in root}

            def find(x):
                while joined[x] != x:
                    x = joined[x]
                return x

            sets = [unpacked(a, b) for a, b in zip(h, w, strict=True)]
            ahead, behind = alike(i, root, part, signed)
            left = ~ruled_out(sets, ahead, behind, similarity) if len(ahead) else slice(0)
            out = []
            for a, b in zip(ahead[left].tolist(), behind[left].tolist(), strict=True):
                x, y = find(root[a]), find(root[b])
                if x != y and probability_jaccard(sets[a], sets[b]) >= similarity:
                    joined[max(x, y)] = min(x, y)
                    out.append((v[a], v[b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    names = ("band", "b1", "b2", "i", "v", "root", "block")
    schema = pa.schema([("band", pa.int64()), ("b1", pa.int32()), ("b2", pa.int32()), ("i", pa.int32()), ("v", pa.int64()), ("root", pa.int64()), ("block", pa.int32())])
    task = ["band", "b1", "b2"]
    close = written(tasks.repartition(*task).sortWithinPartitions(*task).mapInArrow(met_in, "band long, b1 int, b2 int, i int, v long, root long, block int"), "likely")
    full = close.join(vertices.select("v", "signature"), "v").join(sets.hint("merge"), "v")
    more = written(full.repartition(*task).sortWithinPartitions(*task).mapInArrow(linked_in, "a long, b long"), "links")
    ends = written(components(links.unionByName(more)).withColumnRenamed("a", "v"), "roots")
    dropped(members, stars, sets, links, roots, grouped, close, more, shared)
    least = vertices.select("v", "one").join(ends, "v").groupBy("root").agg(F.min("one").alias("least"))
    whole = vertices.select("words", "v", "one").join(ends, "v", "left").join(least, "root", "left")
    whole = whole.select(F.col("words").alias("_words"), F.coalesce("least", "one").alias("head"))
    out = rows.select("doc_id", "text_key", "words").join(whole, F.col("words") == F.col("_words"), "left")
    head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("text_key").eqNullSafe(F.col("head.text_key"))
    component = F.when(F.col("head").isNotNull(), F.col("head.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", component.alias("component_id"), (F.col("head").isNull() | head).alias("kept")), [rows, vertices, ends]


def packed(counts: np.ndarray) -> bytes:
    """Counts as bytes; none where each is 1."""
    return counts.astype("<u4").tobytes() if (counts > 1).any() else b""


def unpacked(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes, np.uint64)
    return h, np.frombuffer(counts, "<u4") if counts else np.ones(len(h), np.uint32)


def text_key(text: Column) -> Column:
    """The text's MD5; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all its columns.

    It is a row of the document that :func:`near_duplicates` keeps; of rows that repeat an id and a text, null or not, one
    stays. Documents that are like no other stay, empty texts with an id of their own among them.
    """
    rows, tables = _grouped(docs, similarity, BLOCK)
    marks = rows.groupBy("doc_id", "text_key").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    marks = written(marks.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("kept").alias("_kept")), "near-copies")
    dropped(*tables)
    named = numbered(docs, F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_key"))
    same = F.col("_id").eqNullSafe(F.col("_d")) & F.col("_key").eqNullSafe(F.col("_k"))
    plain = named.join(marks.hint("merge"), same, "left_anti")
    again = named.join(marks.where("_kept").hint("merge"), same)
    columns = [f"c{i}" for i in range(len(docs.columns))]
    first = again.groupBy("_id", "_key").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return plain.select(*columns).unionByName(first).toDF(*docs.columns)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
