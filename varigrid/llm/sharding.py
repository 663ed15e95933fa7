"""Shards of near-equal bytes by a minimax partition of ordered groups of equal texts (operator 11). DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varigrid.llm.common import dropped, written

#: Bits of a group's key (leading bits of the text's sha-256), of the first segments, and that a segment's parts have more.
KEY_BITS, FIRST_BITS, MORE_BITS = 60, 12, 8
#: Segments whose parts are read in one round; with FIRST_BITS and MORE_BITS it bounds the rows that reach the driver.
AT_ONCE = 128


class Line:
    """Segments of groups in the order of their keys, side by side on a line of bytes.

    A segment holds the groups whose keys begin with its ``bits`` bits; one that holds a single group is whole. ``fluid``
    cuts may fall anywhere in a segment that is not whole, others only between segments: what a true cut can reach lies
    between the two, and they agree where all segments beside it are whole.
    """

    def __init__(self, segments: dict[tuple[int, int], tuple[int, int, int]]):
        order = sorted(segments, key=lambda s: s[1] << (KEY_BITS - s[0]))
        self.segments = order
        self.keys = [prefix << (KEY_BITS - bits) for bits, prefix in order] + [1 << KEY_BITS]
        self.edges = [0]
        for s in order:
            self.edges.append(self.edges[-1] + segments[s][0])
        self.whole = [segments[s][1] == 1 for s in order]
        self.most = max((segments[s][2] for s in order), default=0)
        self.total = self.edges[-1]

    def around(self, place: int) -> int | None:
        """The segment inside which a true edge may be found about ``place``: none if it is an edge or in a whole segment."""
        i = bisect_right(self.edges, place) - 1
        return None if self.edges[i] == place or place >= self.total or self.whole[i] else i

    def reach(self, begin: int, capacity: int, fluid: bool) -> int:
        """The furthest cut of a shard from ``begin`` on."""
        end = begin + capacity
        if end >= self.total:
            return self.total
        i = bisect_right(self.edges, end) - 1
        return end if fluid and not self.whole[i] else max(begin, self.edges[i])

    def path(self, capacity: int, shards: int, fluid: bool) -> list[int]:
        """The greedy cuts."""
        out = [0]
        for _ in range(shards):
            out.append(self.reach(out[-1], capacity, fluid))
        return out[1:]

    def least(self, shards: int, low: int, fluid: bool) -> int:
        """The smallest capacity from ``low`` on whose greedy cuts reach the end, by binary search."""
        high = self.total
        while low < high:
            mid = (low + high) // 2
            if self.path(mid, shards, fluid)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def between(self, capacity: int, shards: int) -> set[int]:
        """Segments that are not whole where the true greedy cuts may lie."""
        out: set[int] = set()
        for a, b in zip(self.path(capacity, shards, False), self.path(capacity, shards, True), strict=True):
            out.update(i for i in range(max(0, bisect_right(self.edges, a) - 1), min(bisect_left(self.edges, b), len(self.whole))) if not self.whole[i])
        return out

    def cuts(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """Edges (by number) between shards of at most ``capacity``, and the segments that must be known closer first.

        Each cut is the edge nearest to an even share of what is left, of those that keep this shard and the rest within
        the capacity; of two as near, the first.
        """
        unknown: set[int] = set()

        def edge(place: int, after: bool) -> int:
            i = self.around(place)
            if i is not None:
                unknown.add(i)
            return bisect_left(self.edges, place) if after else bisect_right(self.edges, place) - 1

        last = [len(self.edges) - 1]  # of the edges from which so many shards suffice, the first
        for _ in range(shards - 1):
            last.append(edge(max(0, self.edges[last[-1]] - capacity), True))
        out, at = [], 0
        for left in range(shards, 1, -1):
            begin = self.edges[at]
            high = edge(min(self.total, begin + capacity), False)
            share = begin + (self.total - begin) // left
            near = edge(share, False)
            off = lambda i: abs(left * (self.edges[i] - begin) - (self.total - begin))  # noqa: B023, E731
            near = min((i for i in (near, near + 1) if i < len(self.edges)), key=lambda i: (off(i), i))
            at = min(max(near, last[left - 1]), high)
            out.append(at)
        return out, unknown


def _parts(groups: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """``(bits, prefix)`` of the parts of the wanted segments, with their bytes, groups and largest group."""
    levels = {bits: [p for b, p in wanted if b == bits] for bits in {b for b, _ in wanted}}
    prefix = lambda bits: F.shiftright("key", KEY_BITS - bits)
    inside = {bits: prefix(bits).isin(some) if bits else F.lit(True) for bits, some in levels.items()}
    deeper = {bits: min(KEY_BITS, bits + MORE_BITS) if bits else FIRST_BITS for bits in levels}
    part = reduce(lambda rest, bits: F.when(inside[bits], F.struct(F.lit(deeper[bits]).alias("bits"), prefix(deeper[bits]).alias("prefix"))).otherwise(rest), levels, F.lit(None))
    found = groups.where(reduce(lambda a, b: a | b, inside.values())).groupBy(part.alias("part"))
    rows = found.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("most"))
    return {(r["part"]["bits"], r["part"]["prefix"]): (r["bytes"], r["n"], r["most"]) for r in rows.collect()}


def planned(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for which ``groups`` (``key, bytes``), in the order of their keys, fill ``shards`` contiguous
    shards, and the first key of every shard but the first (2^60: the shard is empty).

    Sizes are first known by segment of the key space. The greedy check runs over segments with cuts kept between them and
    with cuts let into them; while the two capacities differ, segments between the cuts of both are replaced by their
    parts. The answer is exact as soon as they agree. A round reads at most ``AT_ONCE`` segments' parts (32,768 rows), or
    the 4,096 first segments, whatever the number of groups; there are a few rounds more than the logarithm of that number
    in steps of 8 bits.
    """
    segments = _parts(groups, [(0, 0)])
    while True:
        line = Line(segments)
        low = line.least(shards, max(line.most, -(-line.total // shards)), True)
        high = line.least(shards, low, False)
        edges, unknown = line.cuts(low, shards) if low == high else ([], line.between(low, shards))
        if not unknown:
            return low, [line.keys[i] for i in edges]
        largest = sorted(unknown, key=lambda i: (line.edges[i] - line.edges[i + 1], i))[:AT_ONCE]
        wanted = [line.segments[i] for i in largest]
        parts = _parts(groups, wanted)
        segments = {s: v for s, v in segments.items() if s not in set(wanted)} | parts


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """A row per row of ``docs`` (``doc_id, text``): ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Equal texts are one group, which stays in one shard; groups stand in the order of the first 60 bits of their sha-256
    (texts that share these by chance stay together too). Shards are contiguous in that order: their largest size is the
    smallest possible, and within that bound each takes an even share of what is left. A group with a third of all rows is
    summed before the exchange, and is never gathered: a row's shard follows from comparing its key with the cuts, and
    slots come from a range exchange by (key, doc_id, row), which splits a group's rows over many partitions. Slots number a
    shard's rows from 0 in the order of key and doc_id. Texts are read once; only ids, sizes and keys are shuffled.

    A null text has size 1, crc32 0, and stands with the empty ones. Rows that repeat stay rows; null ids come first in
    their group. Fewer groups than shards leave shards empty, and an empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, KEY_BITS // 4), 16, 10).cast("long")
    size = F.octet_length(text).cast("long") + 1
    rows = written(docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, firsts = planned(groups, shards)
    shard = reduce(lambda a, b: a + b, ((F.col("key") >= F.lit(k)).cast("int") for k in firsts), F.lit(0))
    order = ["key", "doc_id", "row"]
    placed = rows.withColumn("shard", shard).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at")), "shard-places")
    dropped(rows, groups)
    numbered = placed.withColumn("part", F.shiftright("at", 33))
    counts = numbered.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    met = numbered.join(F.broadcast(before), ["part", "shard"])  # a row for each partition of the exchange and cut
    return met.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS remainders FROM bits WHERE k = 8),
r AS (SELECT doc_id, strlen(t) + 1 AS size, hex(encode(t)) AS bytes, CAST('0x' || substr(sha256(t), 1, 15) AS BIGINT) AS key FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
summed AS (SELECT doc_id, size, key, xor(list_reduce(list_transform(range(size - 1), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM r, crcs),
g AS (SELECT key, n, CAST(sum(n) OVER (ORDER BY key) AS BIGINT) AS upto FROM (SELECT key, CAST(sum(size) AS BIGINT) AS n FROM r GROUP BY key)),
e AS (SELECT list(upto ORDER BY upto) AS edges, max(upto) AS total, max(n) AS most FROM g),
search(low, high) AS (SELECT greatest(most, (total + 7) // 8), total FROM e UNION ALL
 SELECT CASE WHEN fits THEN low ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE high END FROM (SELECT low, high, (low + high) // 2 AS mid, total, list_reduce(range(8), lambda p, i: coalesce(list_max(list_filter(edges, lambda x: x <= p + (low + high) // 2)), 0), 0) >= total AS fits FROM search, e WHERE low < high)),
cap AS (SELECT min(high) AS c FROM search),
need(j, p) AS (SELECT 0, total FROM e UNION ALL SELECT j + 1, list_min(list_filter(list_prepend(0, edges), lambda x: x >= p - c)) FROM need, e, cap WHERE j < 7),
cut(j, p) AS (SELECT 0, CAST(0 AS BIGINT) UNION ALL
 SELECT j + 1, least(greatest(near, least_), most_) FROM (SELECT cut.j, list_min(list_transform(list_prepend(0, edges), lambda x: {'d': abs((8 - cut.j) * (x - cut.p) - (total - cut.p)), 'x': x})).x AS near,
 need.p AS least_, coalesce(list_max(list_filter(edges, lambda x: x <= cut.p + c)), 0) AS most_ FROM cut, e, cap, need WHERE need.j = 7 - cut.j AND cut.j < 7)),
dealt AS (SELECT key, CAST(count(cut.j) AS INT) AS shard FROM g LEFT JOIN cut ON cut.j > 0 AND cut.p <= upto - n GROUP BY key)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM summed JOIN dealt USING (key)"""
