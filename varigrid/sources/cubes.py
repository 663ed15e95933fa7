"""Data sources for arrays kept as ``.npy`` files: spectral cubes (``npycube``) and swaths (``npyswath``).

A *cube* is an array (band, row, column): one file, or a folder of strips of rows (``strip-<first row>.npy``) as written by
:func:`write_cube`. A *swath* is a folder of groups of arrays (line, pixel): ``navigation_data/latitude.npy`` and
``longitude.npy``, and the retrievals as ``geophysical_data/<name>.npy``. ``path`` takes several, separated by commas, as local
paths or addresses of a file system that pyarrow knows (``file://``, ``hdfs://``, ``s3://``); the last part of an
address, less its ending, is the row's ``scene`` or ``granule``.

A task reads one strip or block by offset, never a whole array. Comparisons of single columns with constants are pushed
down: on scene, row, col, x and y they choose files, strips and columns before anything is read; on granule and line blocks,
and on lat and lon a block's retrievals are read only where its positions pass. A schema given to the reader prunes columns:
of a cube ``b0, b1, ...`` are single bands and only bands asked for are read, of a swath only retrievals asked for.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

CUBE_SCHEMA = "scene string, row int, col int, x double, y double, valid boolean, sr array<float>"
HEADER = "cube.json"
TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, In: lambda x, some: np.isin(x, list(some))}


def system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def stem(uri: str) -> str:
    return uri.rstrip("/").rpartition("/")[2].removesuffix(".npy")


@dataclass
class Array:
    """A C-ordered array in a file, known by its header."""

    uri: str

    def __post_init__(self) -> None:
        fs, path = system(self.uri)
        with fs.open_input_file(path) as f:
            version = np.lib.format.read_magic(f)
            self.shape, fortran, self.dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            self.offset = f.tell()
        if fortran:
            raise ValueError(f"{self.uri} is in Fortran order")

    def read(self, begin: Sequence[int], count: int) -> np.ndarray:
        """``count`` values, as they lie in the file, from each place of ``begin`` on."""
        fs, path = system(self.uri)
        with fs.open_input_file(path) as f:
            return np.stack([np.frombuffer(f.read_at(count * self.dtype.itemsize, self.offset + b * self.dtype.itemsize), self.dtype) for b in begin])


@dataclass
class Piece(InputPartition):
    """Rows (or lines) ``first`` to ``last`` of a file or folder whose own first is ``origin``."""

    uri: str
    name: str
    origin: int
    first: int
    last: int


class Reader(DataSourceReader):
    """What both readers share: options, the schema's columns, and comparisons pushed down."""

    tested: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.uris = [p.strip() for p in options["path"].split(",")]
        self.fill = float(options.get("fill", "-9999"))
        self.rows = int(options.get("rows", "16"))
        self.schema = schema
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in self.tested and (type(f) in TESTS or isinstance(f, IsNotNull)):
                self.tests.append((name, type(f), getattr(f, "value", None)))
            else:
                yield f

    def passed(self, name: str, values: np.ndarray) -> np.ndarray:
        """Which of a column's values pass all comparisons; a missing number passes none."""
        out = np.ones(len(values), bool)
        for column, kind, value in self.tests:
            if column == name:
                out &= (values == values) if kind is IsNotNull else TESTS[kind](values, value)
        return out

    def cut(self, uri: str, name: str, origin: int, chosen: np.ndarray) -> list[Piece]:
        """Pieces of at most ``rows`` rows of a file that hold a chosen one, without others at their ends."""
        at = np.flatnonzero(chosen)
        groups = np.split(at, np.flatnonzero(np.diff(at // self.rows)) + 1) if len(at) else []
        return [Piece(uri, name, origin, int(g[0]), int(g[-1]) + 1) for g in groups]

    def batch(self, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] for f in self.schema], [f.name for f in self.schema])


class CubeReader(Reader):
    tested = ("scene", "row", "col", "x", "y")

    def __init__(self, options: dict[str, str], schema: T.StructType):
        super().__init__(options, schema)
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.origin = {k: float(options.get(k, d)) for k, d in (("x0", "0"), ("y0", "0"), ("dx", "30"), ("dy", "-30"))}
        unknown = {f.name for f in schema} - {"scene", "row", "col", "x", "y", "valid", "sr"}
        if any(not (n[0] == "b" and n[1:].isdigit()) for n in unknown):
            raise ValueError(f"a cube has no columns {sorted(unknown)}; single bands are b0, b1, ...")
        self.single = sorted(int(n[1:]) for n in unknown)

    def along(self, axis: str, index: np.ndarray, origin: dict[str, float]) -> np.ndarray:
        return origin[f"{axis}0"] + (index + 0.5) * origin[f"d{axis}"]

    def partitions(self) -> list[Piece]:
        out = []
        for uri in self.uris:
            if not self.passed("scene", np.array([stem(uri)], object))[0]:
                continue
            fs, path = system(uri)
            if fs.get_file_info(path).type == pafs.FileType.Directory:
                header = json.loads(fs.open_input_file(f"{path}/{HEADER}").read())
                strips = [(first, f"{uri.rstrip('/')}/strip-{first:08d}.npy", last) for first, last in header["strips"]]
            else:
                strips = [(0, uri, Array(uri).shape[1])]
            for first, file, last in strips:
                row = np.arange(first, last)
                out += self.cut(file, stem(uri), first, self.passed("row", row) & self.passed("y", self.along("y", row, self.origin)))
        return out

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what a scan without partitions gets
            return
        array = Array(partition.uri)
        n_bands, n_rows, n_cols = array.shape
        bands = self.bands if self.bands is not None else list(range(n_bands))
        whole = any(f.name in ("sr", "valid") for f in self.schema)
        read = sorted({*(bands if whole else []), *self.single})
        col = np.arange(n_cols)
        taken = np.flatnonzero(self.passed("col", col) & self.passed("x", self.along("x", col, self.origin)))
        if not len(taken):
            return
        many = partition.last - partition.first
        strip = array.read([(b * n_rows + partition.first) * n_cols for b in read], many * n_cols).reshape(len(read), many, n_cols) if read else np.zeros((0, many, n_cols))
        number = np.arange(partition.first, partition.last) + partition.origin
        y = self.along("y", number, self.origin)
        for i in np.flatnonzero(self.passed("row", number) & self.passed("y", y)):
            values = strip[:, i, taken].astype(np.float32)
            bad = ~np.isfinite(values) | (values == self.fill)
            n = len(taken)
            columns = {"scene": pa.array([partition.name] * n), "row": pa.array(np.full(n, number[i], np.int32)), "col": pa.array(taken.astype(np.int32)), "x": pa.array(self.along("x", taken, self.origin)), "y": pa.array(np.full(n, y[i]))}
            for b in self.single:
                columns[f"b{b}"] = pa.array(values[read.index(b)], mask=bad[read.index(b)])
            if whole:
                own = [read.index(b) for b in bands]
                columns["valid"] = pa.array(~bad[own].all(0))
                columns["sr"] = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(own) + 1, len(own)), pa.int32()), pa.array(values[own].T.ravel(), mask=bad[own].T.ravel()))
            yield self.batch(columns)


class SwathReader(Reader):
    tested = ("granule", "line", "pixel", "lat", "lon")

    def partitions(self) -> list[Piece]:
        out = []
        for uri in self.uris:
            if self.passed("granule", np.array([stem(uri)], object))[0]:
                lines = Array(f"{uri}/navigation_data/latitude.npy").shape[0]
                out += self.cut(uri, stem(uri), 0, self.passed("line", np.arange(lines)))
        return out

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return

        def block(name: str) -> np.ndarray:
            array = Array(f"{partition.uri}/{name}.npy")
            width = array.shape[1]
            return array.read([partition.first * width], (partition.last - partition.first) * width)[0].astype(np.float64)

        lat, lon = block("navigation_data/latitude"), block("navigation_data/longitude")
        width = len(lat) // (partition.last - partition.first)
        line, pixel = np.arange(len(lat)) // width + partition.first, np.arange(len(lat)) % width
        lat, lon = (np.where(np.isfinite(v) & (v != self.fill), v, np.nan) for v in (lat, lon))
        columns = {"line": line, "pixel": pixel, "lat": lat, "lon": lon}
        taken = np.flatnonzero(np.logical_and.reduce([self.passed(k, v) for k, v in columns.items()]))
        if not len(taken):
            return
        out = {"granule": pa.array([partition.name] * len(taken)), "coarse_index": pa.array((line * width + pixel)[taken])}
        out |= {"line": pa.array(line[taken], pa.int32()), "pixel": pa.array(pixel[taken], pa.int32())}
        out |= {k: pa.array(columns[k][taken], mask=np.isnan(columns[k][taken])) for k in ("lat", "lon")}
        for f in self.schema:
            if f.name not in out:
                values = block(f"geophysical_data/{f.name}")[taken]
                out[f.name] = pa.array(values, mask=~np.isfinite(values) | (values == self.fill))
        yield self.batch(out)


class CubeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npycube"

    def schema(self) -> str:
        return CUBE_SCHEMA

    def reader(self, schema: T.StructType) -> CubeReader:
        return CubeReader(dict(self.options), schema)


class SwathSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npyswath"

    def schema(self) -> str:
        """Positions and every retrieval of the first granule."""
        fs, path = system(self.options["path"].split(",")[0].strip())
        files = fs.get_file_info(pafs.FileSelector(f"{path}/geophysical_data"))
        names = sorted(f.base_name.removesuffix(".npy") for f in files if f.base_name.endswith(".npy"))
        return ", ".join(["granule string, line int, pixel int, coarse_index bigint, lat double, lon double", *(f"`{n}` double" for n in names)])

    def reader(self, schema: T.StructType) -> SwathReader:
        return SwathReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes both sources known to the session, and lets it hand comparisons to them."""
    spark.dataSource.register(CubeSource)
    spark.dataSource.register(SwathSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_cube(cells: DataFrame, path: str, bands: Sequence[str], n_rows: int, n_cols: int, *, rows: int = 64, fill: float = -9999.0) -> None:
    """A cube folder from unique ``row, col`` and the columns ``bands``; absent cells and nulls become ``fill``.

    A task writes a strip of ``rows`` rows under a name that follows from its first row, so a repeated task writes the same
    file again. The header that names the strips comes last: a folder without one is unfinished.
    """

    def strip(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * rows
        last = min(n_rows, first + rows)
        out = np.full((len(bands), last - first, n_cols), fill, np.float32)
        part = part[part["col"].notna()].astype({"col": int})
        for b, name in enumerate(bands):
            out[b, part["row"].to_numpy() - first, part["col"].to_numpy()] = part[name].astype("float64").fillna(fill).to_numpy()
        fs, folder = system(path)
        with fs.open_output_stream(f"{folder}/strip-{first:08d}.npy") as f:
            np.lib.format.write_array(f, out, allow_pickle=False)
        return pd.DataFrame({"first": [first], "last": [last]})

    fs, folder = system(path)
    fs.create_dir(folder)
    spark = cells.sparkSession
    inside = cells.where(F.col("row").between(0, n_rows - 1) & F.col("col").between(0, n_cols - 1)).select(F.col("row").cast("int"), F.col("col").cast("int"), *bands)
    firsts = spark.range(0, n_rows, rows).select(F.col("id").cast("int").alias("row"), F.lit(None).cast("int").alias("col"))  # strips without cells too
    every = inside.unionByName(firsts, allowMissingColumns=True)
    strips = every.groupBy(F.floor(F.col("row") / rows).alias("strip")).applyInPandas(strip, "first int, last int").collect()  # a row a strip
    with fs.open_output_stream(f"{folder}/{HEADER}") as f:
        f.write(json.dumps({"bands": list(bands), "strips": sorted([r["first"], r["last"]] for r in strips)}).encode())


def write_swath(cells: DataFrame, path: str, names: Sequence[str], n_lines: int, n_pixels: int, *, fill: float = -9999.0) -> list[str]:
    """Swath folders below ``path``, one for each ``granule``, from its unique ``line, pixel``, ``lat, lon`` and retrievals ``names``; their
    addresses. A granule is as much as one file of its kind holds, and one task writes it; absent cells and nulls become ``fill``."""

    def granule(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        fs, folder = system(f"{path}/{key[0]}")
        for group, columns in (("navigation_data", {"lat": "latitude", "lon": "longitude"}), ("geophysical_data", {n: n for n in names})):
            fs.create_dir(f"{folder}/{group}")
            for column, file in columns.items():
                out = np.full((n_lines, n_pixels), fill)
                out[part["line"].to_numpy(), part["pixel"].to_numpy()] = part[column].astype("float64").fillna(fill).to_numpy()
                with fs.open_output_stream(f"{folder}/{group}/{file}.npy") as f:
                    np.lib.format.write_array(f, out, allow_pickle=False)
        return pd.DataFrame({"granule": [key[0]]})

    own = cells.select("granule", "line", "pixel", "lat", "lon", *names)
    return sorted(f"{path}/{r['granule']}" for r in own.groupBy("granule").applyInPandas(granule, "granule string").collect())  # a row a granule
