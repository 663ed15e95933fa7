"""Benchmark decontamination by template canonicalisation, in DataFrame functions only (operator 9, a stage).

Numbers, names (runs of capitalised words, of which one stands inside a sentence; a run is one placeholder) and
units after numbers become typed placeholders, so a
re-parameterised question has the windows of its template. Windows of five words are hash-joined; hits on one
diagonal (document position less item position), or on a band of neighbouring ones where words were added or
dropped, say how many of the item's words the document covers. On covered items the values in the slots must map
one to one onto the item's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.common import numbered, written

WINDOW = 5
COVERAGE = 0.8
#: Any diagonals within this share of an item's words (and at least LEAST_BAND) are in one band, which is twice as wide.
BAND, LEAST_BAND = 0.1, 2
#: Windows of the benchmark up to which they are broadcast (about 40 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
BROADCAST_CANDIDATES = 200_000
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: Stands for the point within a number.
POINT = "\ue003"
#: Units that may follow a number.
UNITS = "km|cm|mm|m|kg|mg|g|l|ml|s|ms|h|min|mph|kmh|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|feet|inches|dollars?|euros?|cents?|percent|degrees?|liters?|litres?|grams?|pounds?"
#: A word of a name, and the blank between two of them that are marked.
NAME_WORD = r"((?<=[\p{L}\p{N},;:] )\p{Lu}\p{L}{1,255}(?!\p{L})|(?<![\p{L}\p{N}])\p{Lu}\p{L}{1,255}(?= \p{Lu}\p{L}{1,255}(?!\p{L})))"
NAME_BLANK = rf" (?={NAME}\p{{L}})(?<={NAME}\p{{L}}{{2,256}} )"
#: Names as the SQL has them.
NAME_PATTERN = r"([\p{L}\p{N},;:] )(\p{Lu}\p{L}+)"
NUMBER_PATTERN = r"(\p{N}+(?:[.,]\p{N}+)*)"
SEPARATOR = rf"[^\p{{L}}\p{{N}}{NAME}-{POINT}]+"


def tokens(text: Column, raw: bool = False) -> Column:
    """Canonical words; with ``raw``, as many words in which each placeholder is followed by what it stands for."""
    keep = "$1" if raw else ""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), NAME_WORD, f"{NAME}{keep}")
    out = F.regexp_replace(out, *((NAME_BLANK, "") if raw else (f"{NAME}(?: {NAME})+", NAME)))
    number = f"{NUMBER}{keep}"
    out = F.regexp_replace(out, NUMBER_PATTERN, number)
    if raw:  # parts of one number stay one word: a comma before three digits says nothing, any other sign is a point
        out = F.regexp_replace(out, rf"(?<=\p{{N}}),(?=\p{{N}}{{3}}(?!\p{{N}}))", "")
        out = F.regexp_replace(out, rf"(?<=\p{{N}})[.,](?=\p{{N}})", POINT)
        out = F.regexp_replace(out, rf"({NUMBER}[\p{{N}}{POINT}]*) ?({UNITS})\b", f"$1 {UNIT}$2")
    else:
        out = F.regexp_replace(out, rf"({NUMBER}) ?({UNITS})\b", f"$1 {UNIT}")
    return F.filter(F.split(F.lower(out), SEPARATOR), lambda w: w != "")


def template(raw: Column) -> Column:
    """The canonical words of words with values: a placeholder stands alone."""
    return F.transform(raw, lambda w: F.when(w >= NAME, F.substring(w, 1, 1)).otherwise(w))  # letters beyond stay apart in both


def bare(words: Column, i: Column, k: int) -> Column:
    """Whether the window at ``i`` has placeholders only."""
    return reduce(lambda a, b: a & b, (F.get(words, i + j) >= NAME for j in range(k)))


def windows(words: Column, raw: Column, sizes: list[int]) -> Column:
    """Array of (position, hash) of every window of each size. A window of placeholders alone has the hash of its values:
    its template is that of every list of numbers."""

    def hashed(k: int) -> Column:
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.expr("cast(array() as array<int>)"))
        of = lambda kind, some, i: F.xxhash64(F.lit(kind), *(F.get(some, i + j) for j in range(k)))
        return F.transform(starts, lambda i: F.struct(i.alias("i"), F.when(bare(words, i, k), of(-k, raw, i)).otherwise(of(k, words, i)).alias("h")))

    return F.concat(*map(hashed, sizes))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row, however often and within whatever function it is used."""
    values = F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias("_once")
    return df.select(*(c for c in df.columns if c not in columns), values).select(*(c for c in df.columns if c not in columns), "_once.*")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """A row per document and benchmark item that the document contains.

    ``doc_id, item_id, coverage`` (share of the item's words under matching windows), ``n_slots`` and
    ``changed`` (slots with another value than the item's). A document is a row's id and text: rows that share an id, or have
    none, are judged each by itself, and the best of an id counts. An item of fewer words than ``window`` matches as
    one window. A window of placeholders alone seeds a match only with the item's own values, so numbers meet no other
    numbers; beside a seed with a word, on its diagonals, such windows count whatever their values. An item without words
    matches nothing, and one of placeholders alone only what has its values. Null and empty texts match nothing; empty
    tables give no rows; other columns are ignored. A name begins inside a sentence or is followed by another capitalised
    word, and its words have at most 256 letters; a single one at the beginning of a sentence stays a word.
    """
    items = benchmark.select("item_id", F.col("text").alias("_t")).distinct().select("item_id", tokens(F.col("_t"), raw=True).alias("raw")).where(F.size("raw") > 0)
    items = once(items, w=template(F.col("raw")))
    items = items.withColumn("literal", F.exists("w", lambda w: w < NAME)).withColumn("k", F.least(F.size("w"), F.lit(window)))
    items = written(items, "benchmark")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect()) or [window]  # at most `window` values
    inside = lambda at, k: F.array_distinct(F.flatten(F.transform(at, lambda j: F.sequence(j, j + k - 1))))
    parts = []
    for k in sizes:
        starts = F.sequence(F.lit(0), F.size("w") - k)
        some = once(items.where(F.col("k") == k), bare=F.when(F.col("literal"), F.filter(starts, lambda i: bare(F.col("w"), i, k))).otherwise(F.expr("cast(array() as array<int>)")))  # noqa: B023
        parts.append(some.withColumn("x", windows(F.col("w"), F.col("raw"), [k])))
    items = written(reduce(DataFrame.unionByName, parts), "benchmark-windows")
    # item words that may match by placeholders alone
    of_items = items.select("item_id", F.size("w").alias("n"), "k", "literal", F.size(inside(F.col("bare"), F.col("k"))).alias("spare"), F.explode("x").alias("x"))
    of_items = of_items.select("item_id", "n", "k", "literal", "spare", F.col("x.i").alias("j"), F.col("x.h").alias("h"))
    if of_items.count() <= BROADCAST_WINDOWS:
        of_items = F.broadcast(of_items)
    named = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"), "text")
    key = ["doc_id", "md5"]
    of_docs = named.select(*key, tokens(F.col("text"), raw=True).alias("raw")).select(*key, "raw", template(F.col("raw")).alias("w")).select(*key, F.explode(windows(F.col("w"), F.col("raw"), sizes)).alias("x"))
    hits = of_docs.select(*key, F.col("x.i").alias("i"), F.col("x.h").alias("h")).join(of_items, "h")
    diagonal, half = F.col("i") - F.col("j"), F.greatest(F.lit(LEAST_BAND), F.ceil(F.col("n") * BAND)).cast("int")
    band = F.floor(diagonal / half).cast("int")
    part = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"))
    hits = hits.select(*key, "item_id", "n", "k", "literal", "spare", "j", diagonal.alias("d"), F.explode(F.array(part(0, diagonal), part(1, band), part(1, band - 1))).alias("part"))
    found = hits.groupBy(*key, "item_id", "part").agg(*(F.max(c).alias(c) for c in ("n", "k", "literal", "spare")), F.collect_set(F.struct("j", "d")).alias("at"))
    found = once(found, words=F.size(inside(F.transform("at", lambda x: x["j"]), F.col("k"))))
    share = lambda words: F.round(words / F.col("n"), 6)
    found = written(found.where(share(F.col("words") + F.col("spare")) >= coverage), "leak-candidates")
    marked = F.filter(F.transform(F.sequence(F.lit(0), F.size("raw") - 1), lambda p: F.struct(p.alias("p"), F.get("raw", p).alias("v"))), lambda s: s["v"] >= NAME)
    slotted = items.select("item_id", "bare", F.col("w").alias("iw"), marked.alias("slots")).where(F.size("slots") > 0)
    plain = found.join(slotted, "item_id", "left_anti").select("doc_id", "item_id", share(F.col("words")).alias("coverage"), F.lit(0).alias("n_slots"), F.lit(0).alias("changed"))
    to_check = found.join(slotted, "item_id")
    if found.count() <= BROADCAST_CANDIDATES:
        to_check = F.broadcast(to_check)
    met = named.select(F.col("doc_id").alias("_id"), F.col("md5").alias("_md5"), "text").join(to_check, (F.col("_md5") == F.col("md5")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    met = once(met.select(*key, "item_id", "n", "k", "literal", "bare", "iw", "slots", "at", "text"), raw=tokens(F.col("text"), raw=True)).drop("text")
    met = once(met, w=template(F.col("raw")), ds=F.array_distinct(F.transform("at", lambda x: x["d"])))
    # windows of placeholders alone, on the diagonals of the seeds
    alike = lambda j, d: F.forall(F.sequence(F.lit(0), F.col("k") - 1), lambda t: F.coalesce(F.get("w", j + d + t) == F.get("iw", j + t), F.lit(False)))
    more = F.flatten(F.transform("ds", lambda d: F.transform(F.filter("bare", lambda j: (j + d >= 0) & alike(j, d)), lambda j: F.struct(j.alias("j"), d.alias("d")))))
    met = once(met, at=F.array_union("at", more))
    met = once(met, at=F.transform("at", lambda x: F.struct(x["j"], x["d"], F.size(F.filter("at", lambda y: y["d"] == x["d"])).alias("full"))), coverage=share(F.size(inside(F.transform("at", lambda x: x["j"]), F.col("k")))))
    # a slot lies on the diagonal of the windows over it, or else of the nearest window; of several, on the fullest
    gap = lambda x, p: F.greatest(F.lit(0), x["j"] - p, p - x["j"] - F.col("k") + 1)
    place = lambda p: F.array_max(F.transform("at", lambda x: F.struct((-gap(x, p)).alias("near"), x["full"], x["d"])))["d"]
    value = lambda q: F.when(q >= 0, F.get("raw", q))
    pairs = F.filter(F.transform("slots", lambda s: F.struct(s["v"].alias("a"), value(s["p"] + place(s["p"])).alias("b"))), lambda x: x["b"] >= NAME)
    met = once(met.where(F.col("coverage") >= coverage), pairs=pairs)
    many = lambda some: F.size(F.array_distinct(some))
    one_side = lambda c: many(F.transform("pairs", lambda x: x[c]))
    changed = F.size(F.filter("pairs", lambda x: x["a"] != x["b"]))
    consistent = (many(F.col("pairs")) == one_side("a")) & (many(F.col("pairs")) == one_side("b")) & (F.col("literal") | (changed == 0))
    judged = met.where(consistent).select("doc_id", "item_id", "coverage", F.size("pairs").alias("n_slots"), changed.alias("changed")).unionByName(plain)
    best = F.max(F.struct("coverage", (-F.col("changed")).alias("unchanged"), "n_slots")).alias("b")
    return judged.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.coverage", F.col("b.n_slots").cast("long").alias("n_slots"), (-F.col("b.unchanged")).cast("long").alias("changed"))


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item, all other rows with all their columns.

    A document is an id with a text (its MD5 is compared): of an id with several texts only those that hold an item go,
    and with them their repeated rows. Null and empty texts stay; empty tables change nothing.
    """
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    named = numbered(docs, F.struct("doc_id", key.alias("k")).alias("_key"), keep=("text",))
    bad = written(leaks(named.select(F.col("_key").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_bad")).distinct(), "leaking")
    if bad.count() <= BROADCAST_CANDIDATES:
        bad = F.broadcast(bad)
    kept = named.join(bad, F.col("_key").eqNullSafe(F.col("_bad")), "left_anti")
    return kept.drop("_key").toDF(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql(text: str, raw: bool) -> str:
    out = f"regexp_replace(coalesce({text}, ''), '{NAME_PATTERN}', '\\1{NAME}{chr(92) + '2' if raw else ''}', 'g')"
    out = f"regexp_replace({out}, '{NUMBER_PATTERN}', '{NUMBER}{chr(92) + '1' if raw else ''}', 'g')"
    if not raw:
        out = f"regexp_replace({out}, '({NUMBER}) ?({UNITS})\\b', '\\1 {UNIT}', 'g')"
    return f"list_filter(string_split_regex(lower({out}), '{SEPARATOR}'), lambda w: w <> '')"


#: The benchmark's items have no slots in the tables that the SQL runs over, so it counts none; tests cover slots.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_sql('text', False)} AS w FROM documents),
 b AS (SELECT item_id, {_sql('text', False)} AS w FROM benchmark),
 dw AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) AS i FROM d)),
 bw AS (SELECT item_id, n, j, array_to_string(w[j + 1:j + {WINDOW}], ' ') AS h FROM (SELECT item_id, w, len(w) AS n, unnest(range(0, len(w) - {WINDOW - 1})) AS j FROM b)),
 hits AS (SELECT DISTINCT doc_id, item_id, i - j AS diagonal, n, unnest(range(j, j + {WINDOW})) AS p FROM dw JOIN bw USING (h)),
 cov AS (SELECT doc_id, item_id, diagonal, round(CAST(count(*) AS DOUBLE) / max(n), 6) AS coverage FROM hits GROUP BY ALL)
SELECT doc_id, item_id, max(coverage) AS coverage, CAST(0 AS BIGINT) AS n_slots, CAST(0 AS BIGINT) AS changed
FROM cov WHERE coverage >= {COVERAGE} GROUP BY doc_id, item_id"""
