"""Verdicts as keyed rows, the gates that write them, and contracts on inputs."""

from __future__ import annotations

import csv
import io
import json
import math
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varigrid.config import GateConfig
from varigrid.functions.text import first_token

COLUMNS = ["hypothesis", "statistic", "value", "threshold", "verdict", "note"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


def verdict_row(hypothesis: str, statistic: str, value: str, threshold: str, verdict: str, note: str = "") -> dict[str, str]:
    """One verdict; the first word of ``hypothesis`` is its tag."""
    return dict(zip(COLUMNS, (hypothesis, statistic, value, threshold, verdict, note), strict=True))


def upsert(existing: DataFrame, new: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows of ``existing`` whose tag is not among those of ``new``, then all of ``new``."""
    tag = key if key is not None else first_token(F.col("hypothesis"))
    tags = new.select(tag.alias("_tag")).distinct()
    kept = existing.withColumn("_key", tag).join(tags, F.col("_key") == F.col("_tag"), "left_anti").drop("_key")
    return kept.unionByName(new)


#: Times that a writer begins anew because another was faster.
TURNS = 50


class Versions:
    """The versions of a ledger: ``_versions/<number>.csv`` below its folder, each the whole ledger and never changed.

    A version is written under another name and committed by a rename that fails if its number is taken; what a broken
    writer leaves is never read. Beside them the folder itself holds the newest version for other readers of CSV.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.folder.getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        where = self.at(folder) if folder else self.folder
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def newest(self) -> int:
        """The highest number; 0 if there is none."""
        return max((int(n[:-4]) for n in self.names("_versions") if n[:-4].isdigit() and n.endswith(".csv")), default=0)

    def read(self, number: int) -> DataFrame:
        """A version; number 0 is what stands in the folder without any."""
        if not number and not any(n.endswith(".csv") for n in self.names("")):
            return self.spark.createDataFrame([], SCHEMA)
        path = f"{self.path}/_versions/{number:08d}.csv" if number else self.path
        return self.spark.read.schema(SCHEMA).csv(path, header=True, multiLine=True, escape='"').fillna("")

    def write(self, name: str, rows: Sequence[tuple]) -> None:
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows([COLUMNS, *rows])
        stream = self.fs.create(self.at(name), False)
        stream.write(bytearray(text.getvalue().encode()))
        stream.close()

    def commit(self, number: int, rows: Sequence[tuple]) -> bool:
        """Whether ``rows`` became version ``number``."""
        own = f"_versions/.{uuid.uuid4().hex}"
        self.write(own, rows)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.at(own), self.at(f"_versions/{number:08d}.csv"), self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as refused:
            if "FileAlreadyExistsException" not in refused.java_exception.toString():
                raise
            self.fs.delete(self.at(own), False)
            return False
        return True

    def show(self, number: int, rows: Sequence[tuple]) -> None:
        """Version ``number`` in the folder itself, unless a newer one is there; older ones go."""
        shown = f"verdicts-{number:08d}.csv"
        if shown not in self.names(""):
            self.write(shown, rows)
        there = [n for n in self.names("") if n.endswith(".csv")]
        newest = max(n for n in there if n.startswith("verdicts-"))
        for name in {*there, "_SUCCESS"} - {newest}:
            self.fs.delete(self.at(name), False)


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the ledger at ``path``; no rows if there is none."""
    versions = Versions(spark, path)
    return versions.read(versions.newest())


def record(spark: SparkSession, path: str, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """Upsert ``rows`` into the ledger at ``path`` (a folder) and return it, existing rows first.

    The result is a new version (:class:`Versions`). If another writer has taken its number meanwhile, the upsert is done
    again on what that one has written, so no verdict is lost. The ledger has a row a hypothesis, so a version is read whole.
    """
    new = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)
    versions = Versions(spark, path)
    for _ in range(TURNS):
        number = versions.newest()
        merged = [tuple(r) for r in upsert(versions.read(number), new).collect()]
        if versions.commit(number + 1, merged):
            versions.show(number + 1, merged)
            return spark.createDataFrame(merged, SCHEMA)
    raise RuntimeError(f"other writers were faster {TURNS} times at {path}")


def write_metrics(df: DataFrame, path: str, keys: Sequence[str]) -> dict:
    """A nested JSON document of the rows of a small summary, keyed by ``keys`` joined with ``/``; NaN and null are null."""
    out = {}
    for r in df.collect():
        row = r.asDict(recursive=True)
        out["/".join(str(row.pop(k)) for k in keys)] = {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in row.items()}
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(json.dumps(out, indent=2, default=str).encode()))
    stream.close()
    return out


def fetch_gate(files: DataFrame, expected: Sequence[str], config: GateConfig = GateConfig()) -> dict[str, str]:
    """G0 over ``files`` (``scene, opens, n_valid``): all expected scenes are there, open, and have valid pixels enough."""
    rows = {r["scene"]: r for r in files.collect()}
    bad = [s for s in expected if s not in rows or not rows[s]["opens"] or (rows[s]["n_valid"] or 0) < config.min_valid_pixels]
    return verdict_row("G0 every input opens and holds valid water", "files that open; valid pixels", f"{len(expected) - len(bad)} of {len(expected)}", f">= {config.min_valid_pixels} pixels", "FAIL" if bad else "PASS", ", ".join(bad))


def grid_gate(margins: DataFrame, config: GateConfig = GateConfig()) -> dict[str, str]:
    """V1 over :func:`varigrid.operators.spectral.bbox_margin`."""
    r = margins.agg(F.max("worst_shortfall_px").alias("worst"), F.max("widest_margin_px").alias("widest")).first()
    ok = r["worst"] is not None and r["worst"] < config.corner_slack_px
    return verdict_row("V1 the grid contains the declared box", "worst shortfall in pixels", "-" if r["worst"] is None else f"{r['worst'] + 0.0:.2f}", f"< {config.corner_slack_px:g}", "PASS" if ok else "FAIL", "" if r["widest"] is None else f"widest margin {r['widest']:.2f}")


def water_gate(checks: DataFrame, config: GateConfig = GateConfig()) -> dict[str, str]:
    """V0 over :func:`varigrid.operators.spectral.water_check`."""
    r = checks.agg(F.min("water_share").alias("share"), F.min("green_over_nir").alias("ratio")).first()
    ok = r["share"] is not None and r["ratio"] is not None and r["share"] >= config.min_water_share and r["ratio"] >= config.min_green_over_nir
    return verdict_row("V0 the mask lies on water", "least water share; least green over near infrared", f"{r['share']}; {r['ratio']}", f">= {config.min_water_share}; >= {config.min_green_over_nir}", "PASS" if ok else "FAIL")


def agreement_verdict(gates: DataFrame, config: GateConfig = GateConfig()) -> dict[str, str]:
    """V2 over the scenes of :func:`varigrid.operators.agreement.agreement_gate`; NOT ASSESSABLE where no band could be compared."""
    from varigrid.operators.agreement import furthest_from_one

    r = gates.agg(F.min("worst_correlation").alias("r"), furthest_from_one(F.col("worst_spread")).alias("f")).first()
    told = r["r"] is not None and r["f"] is not None
    ok = told and r["r"] >= config.min_correlation and abs(math.log(r["f"])) <= math.log(config.max_spread)
    verdict = "NOT ASSESSABLE" if not told else "PASS" if ok else "FAIL"
    return verdict_row("V2 fine means agree with the coarse sensor", "worst gated correlation; worst spread", f"{r['r']}; {r['f']}" if told else "-", f">= {config.min_correlation}; within x{config.max_spread}", verdict)


def structure_verdict(scores: DataFrame, keys: Sequence[str], config: GateConfig = GateConfig()) -> dict[str, str]:
    """V3: PASS, MIXED or NOT ASSESSABLE, never FAIL."""
    rows = scores.orderBy(*keys).collect()
    name = lambda r: "/".join(str(r[k]) for k in keys)
    told = [r for r in rows if r["assessable"] and r["ratio"] is not None]
    above = [name(r) for r in told if r["ratio"] > config.max_structure_ratio]
    verdict = "NOT ASSESSABLE" if not told else "MIXED" if above else "PASS"
    return verdict_row("V3 variability inside cells is structured", "adjacent difference over the same after a shuffle", "; ".join(f"{name(r)} {r['ratio']:.2f}" for r in told), f"<= {config.max_structure_ratio} where assessable", verdict, ", ".join(above))


def noise_verdict(multiples: DataFrame, keys: Sequence[str], config: GateConfig = GateConfig()) -> dict[str, str]:
    """V4 over :func:`varigrid.operators.windows2d.noise_multiple`."""
    rows = [r for r in multiples.orderBy(*keys).collect() if r["multiple"] is not None]
    ok = bool(rows) and min(r["multiple"] for r in rows) >= config.min_noise_multiple
    return verdict_row("V4 variability exceeds the noise floor", "median within-cell CV over the declared floor", "; ".join(f"{'/'.join(str(r[k]) for k in keys)} {r['multiple']:.1f}x" for r in rows), f">= {config.min_noise_multiple}x everywhere", "PASS" if ok else "FAIL")


def answer_verdict(summary: DataFrame, keys: Sequence[str]) -> dict[str, str]:
    """V5: reported either way."""
    rows = summary.orderBy(*keys).collect()
    value = f"{sum(r['n_passing'] for r in rows)}; " + "; ".join(f"{'/'.join(str(r[k]) for k in keys)} {r['within_over_between'] or float('nan'):.1f}x, {r['frac_any_above'] or 0.0:.1%}" for r in rows)
    return verdict_row("V5 the filter accepts boxes with variable interiors", "passing boxes; within over between; share with a variable cell", value, "reported either way", "ANSWERED")


def coverage_verdict(n_floats: int, n_stations: int, nearest_km: float | None = None, max_km: float | None = None) -> dict[str, str]:
    """V6: the best box has floats and the proposed one stations; with ``max_km``, no scene may be that near."""
    ok = n_floats > 0 and n_stations > 0 and (max_km is None or (nearest_km is not None and nearest_km > max_km))
    return verdict_row("V6 there is a box worth a scene", "floats in the best box; stations in the proposed one", f"{n_floats}; {n_stations}", "> 0; > 0", "PASS" if ok else "FAIL", "" if nearest_km is None else f"nearest scene {nearest_km:.0f} km")


def enforce(spark: SparkSession, path: str, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """Record the verdicts first, then raise if one is FAIL."""
    out = record(spark, path, rows)
    failed = [r["hypothesis"] for r in rows if r["verdict"] == "FAIL"]
    if failed:
        raise RuntimeError("; ".join(failed))
    return out


def schema_check(df: DataFrame, expected: Mapping[str, str]) -> list[str]:
    """What is missing from ``df`` or has another type than ``expected`` (names to simple types)."""
    found = dict(df.dtypes)
    return [f"{c} is missing" if c not in found else f"{c} is {found[c]}, not {t}" for c, t in expected.items() if found.get(c) != t]


def band_monotonic(bands: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``n_bands, increasing``: whether wavelengths rise strictly with the band index."""
    w = W.partitionBy(*keys).orderBy("band_index")
    steps = bands.withColumn("_up", F.col("wavelength_nm") > F.lag("wavelength_nm").over(w))
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bands"), F.coalesce(F.bool_and("_up"), F.lit(True)).alias("increasing"))


def merge_first_wins(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of both tables by ``keys``; of columns that both have, the left one's stay."""
    extra = [c for c in right.columns if c in keys or c not in left.columns]
    return left.join(right.select(*extra), list(keys), "left")
