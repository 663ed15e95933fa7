"""Removal of passages that repeat anywhere in the corpus (operator 10).

Every string of ``size`` bytes holds an anchor: the leftmost smallest of the hashes of its 32-byte strings.
Equal strings have equal anchors, so only suffixes that begin at an anchor are sorted, and only with those
that begin with the same 32 bytes. An anchor serves a run of window starts; its context is the bytes of all
their windows. An anchor's contexts form a small enhanced suffix array, in which a context that recurs whole stands once: a
stack scan of its common prefixes yields the interval tree, and in each interval the interval tree of the reversed
left sides yields the strings of at least ``size`` bytes around the anchor. A string whose occurrences neither all
go on to the left with one byte nor all to the right is a maximal repeat of the contexts, and its group has all its
occurrences (:func:`groups`). Contexts that recur whole are groups at once, by a count of their 128-bit digests. A bucket of too many different contexts is dealt anew by a longer shared core (the windows' range of
offsets is halved), down to one offset, where a bucket is one string: nothing is cut off. Contexts are cut to
what windows of the halved range can reach; those that are then alike repeat each other whole, and one of them
stands for all further on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.common import dropped, steps, written
from varigrid.llm.shingles import Rolling

SIZE, ANCHOR = 200, 32
HALVED = "key binary, lo int, hi int, k long, c binary, left binary, right binary"
#: Different contexts that one suffix array holds; larger buckets are dealt by a longer core.
BUCKET = 256


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by block-wise running minima from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(texts: list[bytes], size: int = SIZE, anchor: int = ANCHOR, block: int = 1 << 20) -> dict[str, np.ndarray | list[bytes]]:
    """Runs of windows with one anchor: ``doc`` (its place in ``texts``), ``pos``, ``low`` and ``high`` (the
    window starts before it, as distances), ``k`` (the anchor's hash) and ``c`` (the context's digest).

    Window starts are read in blocks, so that besides the rolling sums memory does not grow with a text."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    rolling = Rolling(data)
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(data) - size + 1, block):
        b = min(a + block, len(data) - size + 1)
        hashes = rolling.runs(a, b + size - anchor, anchor)
        keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        start = np.arange(a, b)
        doc = np.searchsorted(ends, start, side="right")
        inside = start + size <= ends[doc]
        at = (window_least(keyed, size - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[inside]
        start, doc = start[inside], doc[inside]
        if not len(start):
            continue
        first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        last = np.append(first[1:], len(at)) - 1
        pos, from_, to, doc = at[first] + a, start[first], start[last], doc[first]
        if found and found[-1][0][-1] == pos[0] and found[-1][3][-1] == doc[0]:  # the block's end cut a run
            found[-1][2][-1] = to[0]
            pos, from_, to, doc, first = pos[1:], from_[1:], to[1:], doc[1:], first[1:]
        if len(pos):
            found.append((pos, from_, to, doc, hashes[at[first]]))
    pos, from_, to, doc = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(4))
    k = np.concatenate([x[4] for x in found]) if found else np.zeros(0, np.uint64)
    shape = zip((pos - from_).tolist(), (to - from_).tolist(), strict=True)
    c = [xxhash.xxh3_128_digest(joined[x : y + size], p << 20 | w) for x, y, (p, w) in zip(from_.tolist(), to.tolist(), shape, strict=True)]
    return {"doc": doc, "pos": pos - begins[doc], "low": pos - to, "high": pos - from_, "k": k.view(np.int64), "c": c}


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(strings: list[bytes], members: list[int]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """``members`` in the order of their strings, and (common prefix, first, last) of each interval of two or more by a
    stack scan, deepest first."""
    order = sorted(members, key=strings.__getitem__)
    prefix = [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
    stack, found = [(0, 0)], []
    for i, p in enumerate([*prefix, 0], 1):
        begin = i - 1
        while stack[-1][0] > p:
            depth, begin = stack.pop()
            found.append((depth, begin, i - 1))
        if stack[-1][0] < p:
            stack.append((p, begin))
    if len(order) > 1 and (not prefix or min(prefix) == 0):
        found.append((0, 0, len(order) - 1))
    return order, found


def maximal(left: list[bytes], right: list[bytes], size: int = SIZE) -> list[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, members) of the maximal repeats of ``size`` bytes or more around a shared
    anchor. ``left`` is what stands before the anchor, ``right`` what begins with it.

    An interval of the right sides is right-diverse: its members do not all go on with one byte. An interval of the
    reversed left sides of its members is left-diverse; if its members all lie in one child of the right interval, they
    go on together and the string is found there, longer.
    """
    back = [x[::-1] for x in left]
    order, found = intervals(right, list(range(len(right))))
    out = []
    for depth, first, last in found:
        by_left, inner = intervals(back, order[first : last + 1])
        for reach, a, b in inner:
            if reach + depth >= size:
                members = by_left[a : b + 1]
                if len({right[m][depth : depth + 1] for m in members}) > 1 or any(len(right[m]) == depth for m in members):
                    out.append((reach, depth, members))
    return out


def _arrow(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def groups(docs: DataFrame, size: int = SIZE, bucket: int = BUCKET) -> DataFrame:
    """``group, doc_id, th, begin, end``: all occurrences of the repeats of at least ``size`` bytes in ``docs``
    (``doc_id, th, text``; ``th`` tells the texts of one id apart), as byte ranges.

    A group is one string around one anchor: ``group`` is its digest with the anchor's place in it. Strings reach as far as the
    windows of their anchor, so a longer passage is covered by the groups of its anchors. Null and empty texts and texts
    shorter than ``size`` have none; the occurrences of one group may overlap, and so may groups.
    """
    width = size - ANCHOR

    def found(batches):
        for batch in steps(batches):
            runs = anchors([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], size)
            doc = pa.array(runs["doc"])
            yield _arrow({"doc_id": batch.column("doc_id").take(doc), "th": batch.column("th").take(doc), "pos": pa.array(runs["pos"].astype(np.int32)), "low": pa.array(runs["low"].astype(np.int16)), "high": pa.array(runs["high"].astype(np.int16)), "k": pa.array(runs["k"]), "c": pa.array(runs["c"], pa.binary())})

    all_runs = written(docs.mapInArrow(found, "doc_id long, th long, pos int, low short, high short, k long, c binary"), "anchors")
    # a table: a join that reads it can deal a very frequent anchor over several tasks
    again = written(all_runs.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1").select("k", (F.col("c0") != F.col("c1")).alias("differ")), "anchors-again")
    runs = written(all_runs.join(again, "k"), "repeated-anchors")
    dropped(all_runs, again)
    contexts = written(runs.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.first("differ").alias("differ"), F.min(F.struct("doc_id", "th", "pos", "low", "high")).alias("one")), "contexts")
    whole = runs.join(contexts.where("n > 1").select("k", "c"), ["k", "c"], "left_semi").select(F.col("c").alias("group"), "doc_id", "th", (F.col("pos") - F.col("high")).alias("begin"), (F.col("pos") - F.col("low") + size).alias("end"))

    wanted = contexts.where("differ").select(F.col("one.doc_id").alias("_d"), F.col("one.th").alias("_t"), F.struct("one.pos", "one.low", "one.high", "k", "c").alias("x"))
    wanted = wanted.groupBy("_d", "_t").agg(F.collect_list("x").alias("xs"))
    wanted = written(wanted, "wanted")

    def cut(batches):
        for batch in steps(batches):
            rows = []
            for text, xs in zip(batch.column("text").to_pylist(), batch.column("xs").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                rows += [(x["k"], x["c"], data[x["pos"] - x["high"] : x["pos"]], data[x["pos"] : x["pos"] - x["low"] + size]) for x in xs]
            k, c, left, right = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield _arrow({"k": pa.array(k, pa.int64()), "c": pa.array(c, pa.binary()), "left": pa.array(left, pa.binary()), "right": pa.array(right, pa.binary())})

    sides = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("text", "xs").mapInArrow(cut, "k long, c binary, left binary, right binary").dropDuplicates(["k", "c"])
    level = written(sides.select(F.col("k").cast("string").cast("binary").alias("key"), F.lit(0).alias("lo"), F.lit(width).alias("hi"), "k", "c", "left", "right"), "sides")
    shape = level.schema

    def digest(left: bytes, right: bytes) -> bytes:
        return xxhash.xxh3_128_digest(left + right, len(left))

    def scanned(batches):
        """Buckets stand in a row; each is scanned when the next begins."""
        key, members = None, []

        def result():
            hits = []
            for reach, depth, some in maximal([m[2] for m in members], [m[3] for m in members], size) if len(members) > 1 else ():
                left, right = members[some[0]][2:]
                group = digest(left[len(left) - reach :], right[:depth])
                hits += [(*members[i][:2], -reach, depth, group) for i in some]
            columns = zip(*hits, strict=True) if hits else ([], [], [], [], [])
            return _arrow({n: pa.array(x, t) for n, x, t in zip(("k", "c", "from", "to", "group"), columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)})

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("key", "k", "c", "left", "right")), strict=True):
                if row[0] != key:
                    if len(members) > 1:
                        yield result()
                    key, members = row[0], []
                members.append(row[1:])
        yield result()

    def halved(batches):
        for batch in batches:
            rows = []
            for lo, hi, k, c, left, right in zip(*(batch.column(x).to_pylist() for x in ("lo", "hi", "k", "c", "left", "right")), strict=True):
                for a, b in ((lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)):
                    if a <= len(left) and len(right) >= size - b and a <= b:
                        l, r = left[max(0, len(left) - b) :], right[: size - a]
                        core = l[len(l) - a :] + r[: size - b]
                        rows.append((xxhash.xxh3_128_digest(core) + bytes([a % 256, b % 256]), a, b, k, c, l, r, digest(l, r)))
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            yield _arrow({n: pa.array(x, t) for n, x, t in zip((*shape.names, "same"), columns, (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)})

    partial = None
    while True:
        sizes = written(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
        small = level.join(sizes.where((F.col("n") <= bucket)).select("key"), "key", "left_semi")
        scans = small.repartition("key").sortWithinPartitions("key").mapInArrow(scanned, "k long, c binary, `from` int, `to` int, `group` binary")
        large = level.join(sizes.where(F.col("n") > bucket).select("key"), "key", "left_semi")
        single = large.where("lo = hi").select("k", "c", (-F.col("lo")).alias("from"), (F.lit(size) - F.col("lo")).alias("to"), F.col("key").alias("group"))
        now = written(scans.unionByName(single), "extents")
        partial = now if partial is None else partial.unionByName(now)
        halves = written(large.where("lo < hi").mapInArrow(halved, f"{HALVED}, same binary"), "halves")
        alike = written(halves.groupBy("key", "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "c", "lo", "hi", "left", "right")).alias("one")), "alike")
        whole_ranges = halves.join(alike.where("n > 1").select("key", "same"), ["key", "same"], "left_semi")
        partial = partial.unionByName(written(whole_ranges.select("k", "c", (-F.octet_length("left")).alias("from"), F.octet_length("right").alias("to"), F.col("same").alias("group")), "extents"))
        more = written(alike.select("key", "one.lo", "one.hi", "one.k", "one.c", "one.left", "one.right"), "sides")
        dropped(level, halves, alike)
        level = more
        if not level.take(1):
            break
    parts = runs.where("differ").join(partial.distinct(), ["k", "c"]).select("group", "doc_id", "th", (F.col("pos") + F.col("from")).alias("begin"), (F.col("pos") + F.col("to")).alias("end"))
    return whole.unionByName(parts)


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that remain) of every row.

    A byte goes if a string of ``size`` bytes that covers it also starts anywhere else in the corpus, the
    same document included: the ranges are those of all members of :func:`groups`. Null and empty texts have no bytes;
    texts shorter than ``size`` stay whole; repeated rows are repeats of each other; rows without an id are documents
    like others; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    spans = groups(rows, size).groupBy("doc_id", "th").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    spans = written(spans, "spans").withColumnsRenamed({"doc_id": "_d", "th": "_t"})

    def removed(batches):
        for batch in steps(batches):
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept, end, gone, n = [], 0, 0, 0
                for a, b in sorted((x["begin"], x["end"]) for x in found or ()):
                    if a > end or not n:
                        kept.append(data[end:a])
                        n, end = n + 1, a
                    gone += max(0, b - end)
                    end = max(end, b)
                kept = b"".join([*kept, data[end:]])
                out.append((len(data), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True))
            yield _arrow({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3]), "kept": pa.array(cols[4], pa.binary())})

    both = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left").select("doc_id", "text", "spans")
    return both.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
