"""Chunk files as a data source: months of gridded bars in compressed arrays, and a catalogue that is their index.

`spark.read.format("chunks").load(path)` reads them, `write_chunks` writes them. The catalogue names each chunk's
first second and length, so a scan opens only those that a filter on ts, or on series, leaves: one partition for each. Chunks are
decoded to Arrow batches. A write makes new files in parallel tasks; its commit writes a new catalogue and puts it in the place of the
old one by a rename, so readers see the store before or after it; an abort takes the new files away. Paths are those that
pyarrow's file systems open (local and shared folders, HDFS, object stores)."""

from __future__ import annotations

import io
import json
import uuid
from dataclasses import dataclass, field
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.codec import INT_MAX, OFFSET_CAP, PRICE_SCALE, RATIO_SCALE, TRADES_CAP, VOLUME_SCALE

#: Fixed values of the format: its version, the catalogue's name, and the arrays of a chunk.
VERSION, CATALOGUE = 4, "MANIFEST.json"
ARRAYS = ("close_delta", "open_off", "high_off", "low_off", "vwap_off", "volume_i", "trades_u16", "tb_ratio_u8", "gap_bits")
SCHEMA = (
    "series string, ts long, open double, high double, low double, close double, volume double, "
    "quote_volume double, trades long, taker_buy_base double, gap boolean"
)
BATCH = 65_536


def _opened(path: str):
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def pack_chunk(t0: int, bars: dict) -> bytes:
    """One chunk file from columns of consecutive bars (arrays by name)."""
    cents = {c: np.rint(bars[c] * PRICE_SCALE).astype(np.int64) for c in ("open", "high", "low", "close")}
    close, volume = bars["close"], bars["volume"]
    traded = volume > 0
    some = np.where(traded, volume, 1.0)
    vwap = np.where(traded, bars["quote_volume"] / some, cents["close"] / PRICE_SCALE)
    ratio = np.where(traded, np.clip(bars["taker_buy_base"] / some, 0, 1), 0.5)
    wide = {f"{c}_off": cents[c] - cents["close"] for c in ("open", "high", "low")}
    wide["close_delta"] = np.diff(cents["close"], prepend=0)
    wide["vwap_off"] = np.clip(np.rint((vwap - cents["close"] / PRICE_SCALE) * PRICE_SCALE), -OFFSET_CAP, OFFSET_CAP)
    wide["volume_i"] = np.rint(volume * VOLUME_SCALE)
    for name, x in wide.items():
        if len(x) and np.abs(x).max() > INT_MAX:
            raise OverflowError(f"{name} needs more than 32 bits: {np.abs(x).max()}")
    told = {"schema": np.int32(VERSION), "t0": np.int64(t0), "n": np.int64(len(close)), "price_scale": np.int32(PRICE_SCALE), "vol_scale": np.int32(VOLUME_SCALE)}
    told |= {name: x.astype(np.int32) for name, x in wide.items()}
    told["trades_u16"] = np.clip(bars["trades"], 0, TRADES_CAP).astype(np.uint16)
    told["tb_ratio_u8"] = np.rint(ratio * RATIO_SCALE).astype(np.uint8)
    told["gap_bits"] = np.packbits(bars["gap"].astype(bool))
    out = io.BytesIO()
    np.savez_compressed(out, **told)
    return out.getvalue()


def unpack_chunk(content: bytes, seconds: int) -> dict:
    """The columns of a chunk, prices exact to the cent."""
    with np.load(io.BytesIO(content)) as z:
        if int(z["schema"]) != VERSION:
            raise ValueError(f"a chunk of version {int(z['schema'])}; {VERSION} is known")
        n, price, size = int(z["n"]), float(z["price_scale"]), float(z["vol_scale"])
        x = {name: z[name] for name in ARRAYS}
        t0 = int(z["t0"])
    close = np.cumsum(x["close_delta"], dtype=np.int64)
    volume = x["volume_i"] / size
    out = {"ts": t0 + seconds * np.arange(n, dtype=np.int64)}
    out |= {c: (close + x[f"{c}_off"]) / price for c in ("open", "high", "low")}
    return out | {
        "close": close / price,
        "volume": volume,
        "quote_volume": volume * (close / price + x["vwap_off"] / price),
        "trades": x["trades_u16"].astype(np.int64),
        "taker_buy_base": volume * x["tb_ratio_u8"] / RATIO_SCALE,
        "gap": np.unpackbits(x["gap_bits"])[:n].astype(bool),
    }


def read_catalogue(path: str) -> dict:
    """The catalogue of a store; an error if there is none, or none of its chunks."""
    files, at = _opened(path)
    if files.get_file_info(f"{at}/{CATALOGUE}").type != fs.FileType.File:
        raise FileNotFoundError(f"no catalogue: {path}/{CATALOGUE}")
    with files.open_input_stream(f"{at}/{CATALOGUE}") as f:
        found = json.loads(f.read())
    if not found.get("chunks"):
        raise ValueError(f"empty catalogue: {path}/{CATALOGUE}")
    return found


def _step(catalogue: dict) -> int:
    """Seconds of a cell."""
    return int(catalogue.get("seconds", 1))


def _own(chunk: dict, catalogue: dict) -> str:
    return chunk.get("series") or catalogue.get("symbol", "")


@dataclass
class ChunkPartition(ds.InputPartition):
    file: str
    series: str
    seconds: int


class ChunkReader(ds.DataSourceReader):
    """Partitions come from the catalogue: no chunk is opened to find out whether it is needed."""

    def __init__(self, path: str):
        self.path, self.lo, self.hi, self.series = path, None, None, None

    def pushFilters(self, filters):
        """Bounds of ts and the series that chunks must have; Spark still applies all filters to the rows."""
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if name == "ts" and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo, ds.EqualNullSafe)):
                low = value + isinstance(f, ds.GreaterThan)
                self.lo = low if self.lo is None else max(self.lo, low)
            if name == "ts" and isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo, ds.EqualNullSafe)):
                high = value + (not isinstance(f, ds.LessThan))
                self.hi = high if self.hi is None else min(self.hi, high)
            if name == "series" and isinstance(f, (ds.EqualTo, ds.EqualNullSafe, ds.In)):
                has = set(value) if isinstance(f, ds.In) else {value}
                self.series = has if self.series is None else self.series & has
            yield f

    def partitions(self):
        catalogue = read_catalogue(self.path)
        step = _step(catalogue)
        return [
            ChunkPartition(c["file"], _own(c, catalogue), step)
            for c in catalogue["chunks"]
            if (self.hi is None or c["t0"] < self.hi)
            and (self.lo is None or c["t0"] + c["n"] * step > self.lo)
            and (self.series is None or _own(c, catalogue) in self.series)
        ]

    def read(self, partition):
        if not isinstance(partition, ChunkPartition):  # no chunk is needed
            return
        files, at = _opened(self.path)
        with files.open_input_stream(f"{at}/{partition.file}") as f:
            columns = unpack_chunk(f.read(), partition.seconds)
        n = len(columns["ts"])
        for lo in range(0, n, BATCH):
            part = {c: pa.array(x[lo : lo + BATCH]) for c, x in columns.items()}
            series = pa.array([partition.series] * len(part["ts"]), pa.string())
            yield pa.RecordBatch.from_pydict({"series": series, **part})


@dataclass
class ChunksWritten(ds.WriterCommitMessage):
    chunks: list = field(default_factory=list)


class ChunkWriter(ds.DataSourceArrowWriter):
    """Rows arrive with a month of a series together, in the order of ts; a hole in the grid begins a new chunk."""

    def __init__(self, path: str, seconds: int, symbol: str, overwrite: bool):
        self.path, self.seconds, self.symbol, self.overwrite, self.write_id = path, seconds, symbol, overwrite, uuid.uuid4().hex[:8]

    def write(self, iterator):
        files, at = _opened(self.path)
        out, held = [], []

        def flush():
            if not held:
                return
            table = pa.Table.from_batches(held)
            held.clear()
            t0, series = table.column("ts")[0].as_py(), table.column("series")[0].as_py()
            columns = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("series", "ts", "month")}
            content = pack_chunk(t0, columns)
            # a task that runs again writes the same file again
            folder = quote(str(series), safe="")
            name = f"{folder}/{table.column('month')[0].as_py()}-{t0}-{self.write_id}.npz"
            files.create_dir(f"{at}/{folder}", recursive=True)
            with files.open_output_stream(f"{at}/{name}.tmp") as f:
                f.write(content)
            files.move(f"{at}/{name}.tmp", f"{at}/{name}")
            out.append({"file": name, "t0": t0, "n": table.num_rows, "bytes": len(content), "series": series})

        last = None
        for batch in iterator:
            ts = batch.column(batch.schema.get_field_index("ts")).to_numpy()
            own = [batch.column(batch.schema.get_field_index(c)).dictionary_encode() for c in ("series", "month")]
            codes = [x.indices.to_numpy() for x in own]
            new = np.ones(len(ts), bool)
            new[1:] = (np.diff(ts) != self.seconds) | (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)
            names = [x.to_pylist() for x in own]
            for a, b in zip(np.flatnonzero(new).tolist(), [*np.flatnonzero(new)[1:].tolist(), len(ts)]):
                if last != (names[0][a], names[1][a], ts[a] - self.seconds):
                    flush()
                held.append(batch.slice(a, b - a))
                last = (names[0][b - 1], names[1][b - 1], ts[b - 1])
        flush()
        return ChunksWritten(out)

    def commit(self, messages):
        files, at = _opened(self.path)
        new = [c for m in messages if m is not None for c in m.chunks]
        if not self.overwrite and files.get_file_info(f"{at}/{CATALOGUE}").type == fs.FileType.File:
            new += read_catalogue(self.path)["chunks"]
        new.sort(key=lambda c: (c["t0"], c.get("series") or ""))
        told = {
            "schema": VERSION, "symbol": self.symbol, "seconds": self.seconds, "columns": [c.split()[0] for c in SCHEMA.split(", ")],
            "n_chunks": len(new), "n_seconds": sum(c["n"] for c in new), "t_start": min((c["t0"] for c in new), default=0),
            "t_end": max((c["t0"] + c["n"] * self.seconds for c in new), default=0), "bytes": sum(c["bytes"] for c in new), "chunks": new,
        }
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{CATALOGUE}.{self.write_id}") as f:
            f.write(json.dumps(told).encode())
        files.move(f"{at}/{CATALOGUE}.{self.write_id}", f"{at}/{CATALOGUE}")

    def abort(self, messages):
        files, at = _opened(self.path)
        for m in messages:
            for c in m.chunks if m is not None else ():
                files.delete_file(f"{at}/{c['file']}")


class ChunkSource(ds.DataSource):
    """Options: path; for writing, seconds (of a cell) and symbol."""

    @classmethod
    def name(cls):
        return "chunks"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return ChunkReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool):
        return ChunkWriter(self.options["path"], int(self.options.get("seconds", 1)), self.options.get("symbol", ""), overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ChunkSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_chunks(bars: DataFrame, path: str, seconds: int, symbol: str = "", append: bool = False) -> None:
    """Gridded bars as chunk files, a month of a series in each (more, where the grid has holes), and their catalogue."""
    _registered(bars.sparkSession)
    d = bars.select(*[c.split()[0] for c in SCHEMA.split(", ")], F.date_format(F.timestamp_seconds("ts"), "yyyy-MM").alias("month"))
    d = d.repartition("series", "month").sortWithinPartitions("series", "ts")
    d.write.format("chunks").option("seconds", seconds).option("symbol", symbol).mode("append" if append else "overwrite").save(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All bars of a store; filters on ts and series choose the chunks that are opened."""
    return _registered(spark).read.format("chunks").load(path)


def chunk_range(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """Bars of [lo, hi) as far as the store goes; an error if there are none. Bounds and files come from the catalogue alone."""
    catalogue = read_catalogue(path)
    step = _step(catalogue)
    met = [c for c in catalogue["chunks"] if c["t0"] < hi and c["t0"] + c["n"] * step > lo]
    if lo >= hi or not met:
        raise ValueError(f"no bars in [{lo}, {hi})")
    return read_chunks(spark, path).where((F.col("ts") >= lo) & (F.col("ts") < hi))
