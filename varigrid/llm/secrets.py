"""Secret scans with corpus-wide ownership frequency (operator 8 and a pipeline stage).

Candidates are found in whole texts; each value's hash is aggregated over the corpus by owners and by their distinct
repositories. A value that at most ``max_owners`` owners hold looks live, and so does one that others hold too, if half of
the repositories it stands in are one owner's (a credential and its forks). One held more widely and evenly is an
example that was copied around. Base kinds are always reported; the further kinds only where they look live.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.common import numbered, steps, written
from varigrid.llm.language import ddl

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Equal to the runs of `[0-9a-f]+` that have 32 characters or more.
HEX = re.compile(r"[0-9a-f]{32,}")
#: The words that a text with an assignment has, in lower case.
WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Further kinds, each with the string that a text with one has and its pattern.
FURTHER = (
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("pem", "PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")),
    ("bearer", "earer ", re.compile(r"[Bb]earer [A-Za-z0-9._~+/-]{20,}=*")),
)
COUNTS = ("n_assign", "n_access", "n_hex")
KINDS = ("assign", "access", "hex", *(k for k, _, _ in FURTHER))
MAX_OWNERS, OWN_SHARE = 2, 0.5
FOUND = "found array<struct<start:long,rank:int,end:long,vstart:long,vend:long,hash:string>>"
SPANS = "array<struct<start:long,rank:int,end:long,vstart:long,vend:long,hash:string,live:boolean,owners:long,repositories:long>>"


def candidates(text: str | None) -> list[tuple[int, int, int, int, int, str]]:
    """(start, kind's rank, end, start and end of the value, the value's hash), in order."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for rank, (_, sign, pattern) in enumerate(FURTHER, 3):
        if sign in text:
            out += [(m.start(), rank, m.end(), m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    return [(*x[:5], hashlib.sha256(x[5].encode("utf-8", "surrogatepass")).hexdigest()[:32]) for x in sorted(out)]


def scanned(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) and their counts by base kind, ``base_sha256`` and candidates as ``found``."""
    fields = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("vstart", pa.int64()), ("vend", pa.int64()), ("hash", pa.string())])
    names = ["start", "rank", "end", "vstart", "vend", "hash"]

    def scan(batches):
        for batch in steps(batches):
            found = [candidates(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(3)]
            base = [hashlib.sha256(",".join(f"{KINDS[x[1]]}:{x[0]}:{x[2]}" for x in f if x[1] < 3).encode()).hexdigest() for f in found]
            spans = pa.array([[dict(zip(names, x, strict=True)) for x in f] for f in found], pa.list_(fields))
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, pa.array(base), spans], [*batch.schema.names, *COUNTS, "base_sha256", "found"])

    return rows.mapInArrow(scan, f"{ddl(rows)}, n_assign long, n_access long, n_hex long, base_sha256 string, {FOUND}")


def ownership(each: DataFrame, max_owners: int = MAX_OWNERS, share: float = OWN_SHARE) -> DataFrame:
    """``hash, owners, repositories, live`` from ``hash, repo, owner`` of every candidate.

    Copies are reduced before each exchange, so a value that stands in a third of all rows meets as few rows as
    it has owners and repositories. A null repository or owner is one unknown one.
    """
    held = each.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    told = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"), F.max("n").alias("most"))
    return told.select("hash", "owners", "repositories", ((F.col("owners") <= max_owners) | (F.col("most") >= share * F.col("repositories"))).alias("live"))


def told(docs: DataFrame, repository: Column, owner: Column, max_owners: int = MAX_OWNERS, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """:func:`scanned` rows without candidates, and those with some: the columns of ``docs`` as ``c0, c1, ...``
    (the text as ``text``, or left out), ``COUNTS``, ``base_sha256`` and ``spans``; see :func:`judged`."""
    rows = numbered(docs, repository.cast("string").alias("repo"), owner.cast("string").alias("owner"), keep=("text",))
    found = scanned(rows) if keep_text else scanned(rows).drop("text")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    none = F.expr(f"cast(array() as {SPANS})")
    one = found.where(F.size("found") > 0)
    each = one.select("row", "repo", "owner", F.explode("found").alias("f")).select("row", "repo", "owner", "f.*")
    owned = written(ownership(each, max_owners), "owned-values")  # a table, so that a value of very many rows is a skewed join's key
    judged_ = each.drop("repo", "owner").join(owned, "hash").where("live or rank < 3")
    spans = judged_.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "vstart", "vend", "hash", "live", "owners", "repositories"))).alias("spans"))
    with_some = one.join(spans, "row", "left").withColumn("spans", F.coalesce("spans", none))
    gone = ["found", "row", "repo", "owner"]
    return found.where(F.size("found") == 0).withColumn("spans", none).drop(*gone), with_some.drop(*gone)


def judged(docs: DataFrame, keep: list[str], repository: Column, owner: Column, max_owners: int = MAX_OWNERS) -> DataFrame:
    """The columns ``keep`` of ``docs``, :data:`COUNTS`, ``base_sha256`` and ``spans``: every reported candidate, with
    ``live`` and its numbers of owners and repositories.

    Null and empty texts have none; whole texts are scanned, whatever their length; a null repository or owner counts as
    one unknown one. Repeated rows and rows without an id stay and count once per owner. An empty table gives no rows. A
    kept column that has a result's name gives way to it; other columns are ignored, whatever their names.
    """
    keep = [k for k in keep if k.lower() not in (*COUNTS, "base_sha256", "spans")]
    plain, some = told(docs.select(*keep, F.col("text").alias("text"), repository.alias("_r"), owner.alias("_o")), F.col("_r"), F.col("_o"), max_owners)
    names = [*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *COUNTS, "base_sha256", "spans"]
    return plain.unionByName(some).select(*names)


def owner_of(source: Column) -> Column:
    """The part of a repository's name before the first slash."""
    return F.substring_index(source, "/", 1)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = judged(docs, ["doc_id"], F.col("source"), owner_of(F.col("source")))
    kind = F.array(*map(F.lit, KINDS))
    named = F.transform("spans", lambda x: F.concat_ws(":", F.get(kind, x["rank"]), x["start"], x["end"]))
    live = F.size(F.filter("spans", lambda x: x["live"])).cast("long")
    return rows.select("doc_id", *COUNTS, "base_sha256", F.array_join(named, ",").alias("spans"), live.alias("n_live"), (F.size("spans") - live).alias("n_copied"))


def redacted(docs: DataFrame, repository: Column, owner: Column, max_owners: int = MAX_OWNERS, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with the value of each live-looking secret replaced by ``mark``; overlapping values become one.

    Every row stays, with all its columns; ``n_chars``, if there is one, is that of the new text. Null and empty texts
    stay as they are, repeated rows are changed alike, and an empty table gives no rows.
    """
    plain, some = told(docs, repository, owner, max_owners, keep_text=True)
    names = numbered(docs, keep=("text",)).columns

    def one(text: str | None, found: list[dict] | None) -> str | None:
        out, at = [], 0
        for a, b in sorted((x["vstart"], x["vend"]) for x in found or () if x["live"]):
            if b > at:
                out += [text[at:a], mark] if a >= at else []
                at = b
        return "".join(out) + text[at:] if at else text

    def cover(batches):
        for batch in steps(batches):
            texts = [one(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    changed = some.select(*names, "spans").mapInArrow(cover, ddl(some.select(*names)))
    for n, c in zip(names, docs.columns, strict=True):
        if c.lower() == "n_chars":
            changed = changed.withColumn(n, F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema[c].dataType)))
    return plain.select(*names).unionByName(changed.select(*names)).toDF(*docs.columns)
