"""``python -m varigrid STAGE``: runs a stage over Parquet tables and writes Parquet."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import functions as F

from varigrid.config import SearchConfig
from varigrid.operators import ledger, variance
from varigrid.plans import stages
from varigrid.session import session
from varigrid.sources import tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="varigrid", description=__doc__)
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--ledger", help="folder of the verdicts; gates are recorded and enforced if given")
    parser.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    parser.add_argument("--log-dir", help="folder of the stages' logs on this machine; each run begins its stage's log anew")
    commands = parser.add_subparsers(dest="stage", required=True)
    fetch = commands.add_parser("fetch", help="gate G0 of the scenes' files")
    fetch.add_argument("--opened", required=True, help="scene, opens, n_valid")
    fetch.add_argument("--scenes", nargs="+", required=True, help="those expected")
    check = commands.add_parser("check", help="gates V0 and V1 of scenes")
    check.add_argument("--pixels", required=True, help="scene, row, col, green, nir, uncertainty, and water or else flags")
    check.add_argument("--grids", required=True, help="JSON: the grid header of each scene")
    check.add_argument("--boxes", required=True, help="scene, west, south, east, north")
    check.add_argument("--flags", nargs="*", default=[], help="columns of cloud and cirrus flags")
    aggregate = commands.add_parser("aggregate", help="bin fine samples to the cells of coarse sensors")
    aggregate.add_argument("--pixels", help="scene, x, y, water and the bands' columns")
    aggregate.add_argument("--centres", help="scene, sensor, coarse_index, cx and cy or lon, lat and epsg or zone, retrievals; with n_rows and n_cols the granules' shapes are recorded")
    aggregate.add_argument("--bands", nargs="*", default=[], help="wavelength=column")
    aggregate.add_argument("--coarse", nargs="*", default=[], help="wavelength=column of the frame, for V2")
    aggregate.add_argument("--scenes", nargs="*")
    aggregate.add_argument("--sensors", nargs="*")
    aggregate.add_argument("--verify-only-gate", action="store_true", help="only V2, over the frame written before")
    compare = commands.add_parser("compare", help="box statistics of aggregate frames")
    compare.add_argument("--frame", required=True)
    compare.add_argument("--shapes", help="JSON of the granules' shapes, as the aggregate stage records them")
    compare.add_argument("--rows", type=int, help="of all granules' grids, in place of --shapes")
    compare.add_argument("--cols", type=int)
    compare.add_argument("--floors", help="scene, floor (and sensor, if it tells): the declared noise, for V4")
    compare.add_argument("--scenes", nargs="*")
    compare.add_argument("--sensors", nargs="*")
    tasking = commands.add_parser("tasking", help="densest boxes of a profile index")
    tasking.add_argument("--index", required=True)
    tasking.add_argument("--scenes-json", required=True)
    tasking.add_argument("--top-n", type=int, default=SearchConfig().top_n)
    tasking.add_argument("--stations", help="CSV of stations: adds the proposed box, the stations' gaps and V6")
    tasking.add_argument("--footprints", help="west, south, east, north of the existing scenes")
    tasking.add_argument("--centre", type=float, nargs=2, metavar=("LON", "LAT"), help="of the proposed box")
    tasking.add_argument("--weekly", default="weekly", help="the stations' kind that is counted apart")
    tasking.add_argument("--max-km", type=float)
    split = commands.add_parser("variance", help="variance between and within cells")
    split.add_argument("--samples", help="scene, row, col and the scalars")
    split.add_argument("--scalars", nargs="*", default=[])
    split.add_argument("--pixels", help="scene, row, col, water and the bands' columns: pedestal, ratio and window are made first")
    split.add_argument("--bands", nargs="*", default=[], help="wavelength=column")
    split.add_argument("--patch", type=int, default=480)
    split.add_argument("--factors", type=int, nargs="+", default=[18, 40])
    args = parser.parse_args(argv)
    if args.stage == "tasking" and args.stations and not (args.footprints and args.centre):
        parser.error("--stations needs --footprints and --centre")
    if args.stage == "compare" and bool(args.shapes) == bool(args.rows and args.cols):
        parser.error("compare needs either --shapes or --rows and --cols")
    if args.stage == "variance" and bool(args.samples) == bool(args.pixels):
        parser.error("variance needs either --samples with --scalars or --pixels with --bands")
    if args.stage == "fetch" and not args.ledger:
        parser.error("fetch records a gate: it needs --ledger")
    logging.basicConfig(level=args.log_level, force=True, format="%(asctime)s %(levelname)s %(message)s", handlers=_handlers(args.log_dir, args.stage))
    log = logging.getLogger("varigrid")
    log.info("%s begins", args.stage)
    spark = session()
    pairs = lambda xs: {float(a): b for a, b in (x.split("=", 1) for x in xs)}
    if args.stage == "fetch":
        stages.fetch_stage(spark.read.parquet(args.opened), args.scenes, args.ledger)
    elif args.stage == "check":
        pixels = tables.aggregates(spark, args.pixels)
        if "water" not in pixels.columns:
            pixels = stages.mask_stage(pixels, "green", "nir", flags=args.flags)
        headers = json.loads(spark.read.text(args.grids, wholetext=True).first()[0])
        corners = tables.corners_frame(spark, {k: tables.grid_header(h) for k, h in headers.items()})
        stages.check_stage(pixels, corners, spark.read.parquet(args.boxes), args.ledger).write.mode("overwrite").parquet(f"{args.out}/checks")
        ledger.write_metrics(spark.read.parquet(f"{args.out}/checks"), f"{args.out}/checks.json", ["scene"])  # a row a scene
    elif args.stage == "aggregate":
        bands = pairs(args.bands)
        if not args.verify_only_gate:
            centres = tables.aggregates(spark, args.centres)
            for column, chosen in (("scene", args.scenes), ("sensor", args.sensors)):
                if chosen:
                    centres = centres.where(F.col(column).isin(*chosen))
            if {"n_rows", "n_cols"} <= set(centres.columns):
                ledger.write_metrics(centres.select(*stages.KEYS, "n_rows", "n_cols").distinct(), f"{args.out}/shapes.json", stages.KEYS)  # a row a granule
            tables.write_aggregates(stages.aggregate_stage(tables.aggregates(spark, args.pixels), centres, bands), f"{args.out}/frame")
        frame = tables.aggregates(spark, f"{args.out}/frame")
        for column, chosen in (("scene", args.scenes), ("sensor", args.sensors)):
            if chosen:
                frame = frame.where(F.col(column).isin(*chosen))
        if args.coarse:
            fine = {nm: f"rrs_mean_{nm:.0f}" for nm in bands if f"rrs_mean_{nm:.0f}" in frame.columns}
            stages.agreement_stage(frame, fine, pairs(args.coarse), args.ledger).write.mode("overwrite").parquet(f"{args.out}/agreement")
    elif args.stage == "compare":
        frame = tables.aggregates(spark, args.frame)
        for column, chosen in (("scene", args.scenes), ("sensor", args.sensors)):
            if chosen:
                frame = frame.where(F.col(column).isin(*chosen))
        shapes = tables.coarse_shapes(spark, args.shapes) if args.shapes else (args.rows, args.cols)
        floors = spark.read.parquet(args.floors) if args.floors else None
        for name, result in zip(("boxes", "summary", "structure"), stages.compare_stage(frame, shapes, floors=floors, ledger_path=args.ledger), strict=True):
            result.write.mode("overwrite").parquet(f"{args.out}/{name}")
    elif args.stage == "tasking":
        index, scenes = tables.load_index(spark, args.index), tables.inventory(spark, args.scenes_json)
        config = SearchConfig(top_n=args.top_n)
        recent = F.col("time") >= F.lit(config.recent_since).cast("timestamp")
        if args.stations:
            stations, feet = tables.stations(spark, args.stations), spark.read.parquet(args.footprints)
            boxes, gaps = stages.proposal_stage(index, scenes, stations, feet, recent=recent, centre=tuple(args.centre), weekly=args.weekly, ledger_path=args.ledger, config=config, max_km=args.max_km)
            gaps.write.mode("overwrite").parquet(f"{args.out}/gaps")
        else:
            boxes = stages.tasking_stage(index, scenes, recent, config)
        boxes.write.mode("overwrite").parquet(f"{args.out}/boxes")
    elif args.pixels:
        inside = stages.ladder_patch(tables.aggregates(spark, args.pixels), pairs(args.bands), patch=args.patch)
        told = variance.variance_ladder(inside, "row", "col", {"ratio": "ratio", "band": "band"}, args.factors, args.patch, args.patch, ["scene"], args.patch)
        told.write.mode("overwrite").parquet(f"{args.out}/variance")
    else:
        samples = tables.aggregates(spark, args.samples)
        stages.variance_stage(samples, {c: c for c in args.scalars}, patch=args.patch, factors=args.factors).write.mode("overwrite").parquet(f"{args.out}/variance")
    log.info("%s ends", args.stage)


def _handlers(folder: str | None, stage: str) -> list[logging.Handler]:
    if not folder:
        return [logging.StreamHandler()]
    os.makedirs(folder, exist_ok=True)
    return [logging.StreamHandler(), logging.FileHandler(os.path.join(folder, f"{stage}.log"), mode="w", encoding="utf-8")]


if __name__ == "__main__":
    main()
