"""A keyed bijection of 0..n-1 as a column expression: shuffling without a sort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of the residues that the rounds compute in, and the multipliers and shifts of the rounds (fixed values; any would do).
PRIME = 2_147_483_647
ROUNDS = ((48_271, 11), (69_621, 1_303), (16_807, 92_821), (39_373, 433_024_223), (62_089_911, 7_919), (41_358, 1_299_709))
#: Times that a place beyond n is sent on.
WALKS = 32


def permuted(index: Column, n: Column, seed: int = 0) -> Column:
    """The place of ``index`` in a permutation of 0..n-1 that ``seed`` draws.

    A Feistel network over the cells of a rectangle a x b, with a = ceil(sqrt(n)) and b = ceil(n / a): each round adds to one
    coordinate a hash of the other, modulo its length, and swaps them. The rectangle has fewer than a cells beyond n;
    an index that falls on one is sent through the network again (cycle walking), which keeps a bijection. ``WALKS`` turns
    always suffice up to n = 1,000; above, one in 31^32 indices at most would need more.
    """
    n = n.cast("long")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")
    rounds = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit((seed * 7_368_787 + s) % PRIME).cast("long").alias("s")) for m, s in ROUNDS))

    def hashed(v: Column, k: Column) -> Column:
        t = (v * k["m"] + k["s"]) % PRIME
        return (t * t) % PRIME

    def turn(state: Column, k: Column) -> Column:
        moved = (state["u"] + hashed(state["v"], k)) % state["a"]
        return F.struct(state["v"].alias("u"), moved.alias("v"), state["b"].alias("a"), state["a"].alias("b"))

    def through(x: Column) -> Column:
        first = F.struct(F.floor(x / b).cast("long").alias("u"), F.pmod(x, b).alias("v"), a.alias("a"), b.alias("b"))
        return F.aggregate(rounds, first, turn, lambda state: state["u"] * b + state["v"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), through(index.cast("long")), lambda x, _: F.when(x < n, x).otherwise(through(x)))


def permuted_sql(source: str, key: str, index: str, n: str, seed: int = 0) -> str:
    """Recursive expressions over ``source`` (``key, index, n``), the last named ``walked`` (``key, place``), for another engine."""

    def through(rows: str) -> str:
        out = f"SELECT k, n, a, b, x // b AS u, x % b AS v, a AS p, b AS q FROM ({rows})"
        for m, s in ROUNDS:
            t = f"((v * {m} + {(seed * 7_368_787 + s) % PRIME}) % {PRIME})"
            out = f"SELECT k, n, a, b, v AS u, (u + ({t} * {t}) % {PRIME}) % p AS v, q AS p, p AS q FROM ({out})"
        return f"SELECT k, n, a, b, u * b + v AS x FROM ({out})"

    start = f"SELECT *, (n + a - 1) // a AS b FROM (SELECT {key} AS k, CAST({index} AS BIGINT) AS x, CAST({n} AS BIGINT) AS n, CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT) AS a FROM {source})"
    return f"walk AS (SELECT * FROM ({through(start)}) UNION ALL SELECT * FROM ({through('SELECT * FROM walk WHERE x >= n')})), walked AS (SELECT k AS {key}, x AS place FROM walk WHERE x < n)"
