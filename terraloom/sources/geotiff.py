"""GeoTIFF rasters as tables of pixels, and tables of pixels as folders of GeoTIFF tiles.

A file's directory is read first, on an executor; then its blocks (strips or tiles) are rows that tasks read and decode one by one, so a raster of any
size is read in parallel, and a window reads only the blocks that it touches. Files must lie where every executor can open them by path. Read are
unsigned, signed and floating samples without compression or with deflate, LZW or PackBits, with or without a predictor. Tiles are written with
deflate, one file for each tile, which holds a bounded number of pixels."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels on a side of a written tile.
TILE = 512
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}


@dataclass
class Info:
    """What a file's first directory says."""

    path: str
    width: int
    height: int
    bands: int
    kind: str
    compression: int
    predictor: int
    planar: int
    block: tuple[int, int]
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    x0: float = 0.0
    y0: float = 0.0
    size_x: float = 1.0
    size_y: float = 1.0
    nodata: float | None = None
    epsg: int | None = None

    def across(self) -> int:
        return -(-self.width // self.block[1])

    def down(self) -> int:
        return -(-self.height // self.block[0])


def local_path(path: str) -> str:
    if re.match(r"[a-z][a-z0-9+.-]+:", path) and not path.startswith("file:"):
        raise ValueError(f"{path} can't be opened by path; put it where executors can")
    return re.sub(r"^file:(//)?", "", path)


def read_info(path: str) -> Info:
    with open(local_path(path), "rb") as f:
        mark = f.read(4)
        if mark[:2] not in (b"II", b"MM"):
            raise ValueError(f"{path} is no TIFF")
        e = "<" if mark[:2] == b"II" else ">"
        big = struct.unpack(e + "H", mark[2:])[0] == 43
        if big:
            f.read(4)
        at = struct.unpack(e + ("Q" if big else "I"), f.read(8 if big else 4))[0]
        f.seek(at)
        n = struct.unpack(e + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        entry = 20 if big else 12
        raw = f.read(n * entry)
        tags: dict[int, tuple | bytes] = {}
        for i in range(n):
            r = raw[i * entry : (i + 1) * entry]
            tag, kind = struct.unpack(e + "HH", r[:4])
            count = struct.unpack(e + ("Q" if big else "I"), r[4 : 12 if big else 8])[0]
            if kind not in _SIZES:
                continue
            code, width = _SIZES[kind]
            held = r[12:] if big else r[8:]
            if width * count > len(held):
                f.seek(struct.unpack(e + ("Q" if big else "I"), held)[0])
                held = f.read(width * count)
            tags[tag] = held[:count] if kind == 2 else struct.unpack(f"{e}{count * len(code)}{code[0]}", held[: width * count])
    get = lambda t, d=None: tags.get(t, d)
    width, height, bands = get(256)[0], get(257)[0], get(277, (1,))[0]
    bits, sample = get(258, (8,))[0], get(339, (1,))[0]
    kind = e + {1: "u", 2: "i", 3: "f"}.get(sample, "u") + str(bits // 8)
    tiled = 322 in tags
    block = (get(323)[0], get(322)[0]) if tiled else (min(get(278, (height,))[0], height), width)
    info = Info(path, width, height, bands, kind, get(259, (1,))[0], get(317, (1,))[0], get(284, (1,))[0], block, list(get(324 if tiled else 273)), list(get(325 if tiled else 279)))
    if 33550 in tags and 33922 in tags:
        sx, sy = get(33550)[:2]
        i, j, _, x, y, _ = get(33922)[:6]
        info.x0, info.y0, info.size_x, info.size_y = x - i * sx, y + j * sy, sx, sy
    elif 34264 in tags:
        m = get(34264)
        info.x0, info.y0, info.size_x, info.size_y = m[3], m[7], m[0], -m[5]
    if 42113 in tags:
        text = bytes(get(42113)).split(b"\0")[0].strip()
        info.nodata = float(text) if text else None
    if 34735 in tags:
        keys = get(34735)
        for i in range(4, len(keys), 4):
            if keys[i] in (3072, 2048) and keys[i + 1] == 0 and (keys[i] == 3072 or info.epsg is None):
                info.epsg = keys[i + 3]
    return info


def unpack_lzw(data: bytes) -> bytes:
    out, table, width, bits, held = bytearray(), [], 9, 0, 0
    before = b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            now = table[code] if code < len(table) else before + before[:1]
            out += now
            if before:
                table.append(before + now[:1])
            before = now
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + n + 2]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n) if n > 128 else b""
            i += 2 if n > 128 else 1
    return bytes(out)


def block_values(info: Info, number: int, data: bytes) -> tuple[int, int, np.ndarray]:
    """First row and column of a block, and its values (bands, rows, columns), cut at the raster's edge."""
    per = info.across() * info.down()
    at = number % per
    down, across = at // info.across() * info.block[0], at % info.across() * info.block[1]
    if info.compression in (8, 32946):
        data = zlib.decompress(data)
    elif info.compression == 5:
        data = unpack_lzw(data)
    elif info.compression == 32773:
        data = unpack_bits(data)
    elif info.compression != 1:
        raise ValueError(f"compression {info.compression} isn't read")
    tall = info.block[0] if info.block[1] < info.width or len(info.offsets) == 1 else min(info.block[0], info.height - down)
    bands = 1 if info.planar == 2 else info.bands
    kind = np.dtype(info.kind)
    count = tall * info.block[1] * bands
    if info.predictor == 3:
        rows = np.frombuffer(data, np.uint8)[: count * kind.itemsize].reshape(tall, -1)
        rows = np.cumsum(rows.reshape(tall, -1, bands), axis=1, dtype=np.uint8).reshape(tall, kind.itemsize, -1)
        values = np.ascontiguousarray(rows.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(tall, info.block[1], bands)
    else:
        values = np.frombuffer(data, kind)[:count].reshape(tall, info.block[1], bands)
        if info.predictor == 2:
            values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
    values = values[: info.height - down, : info.width - across]
    return down, across, np.moveaxis(values, 2, 0)


SCHEMA = "path string, band int, row long, col long, value double"


def read_geotiff(spark: SparkSession, paths: str | list[str], window: tuple[int, int, int, int] | None = None, bands: list[int] | None = None) -> DataFrame:
    """(path, band, row, col, value) of the pixels; missing ones (nodata, NaN) are null. window: first row, first column, row and column after the
    last; only blocks that it touches are read. Bands count from 1."""
    files = [paths] if isinstance(paths, str) else list(paths)
    listed = [os.path.join(p, n) for p in files for n in sorted(os.listdir(local_path(p))) if n.lower().endswith((".tif", ".tiff"))] if all(os.path.isdir(local_path(p)) for p in files) else files
    named = spark.createDataFrame([(p,) for p in listed], "path string").repartition(max(1, min(len(listed), 64)))

    def plan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                info = read_info(path)
                n = len(info.offsets)
                per = info.across() * info.down()
                keep = []
                for k in range(n):
                    down, across = k % per // info.across() * info.block[0], k % per % info.across() * info.block[1]
                    inside = window is None or (down < window[2] and down + info.block[0] > window[0] and across < window[3] and across + info.block[1] > window[1])
                    if inside and (info.planar == 1 or bands is None or k // per + 1 in bands):
                        keep.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(keep)), pa.array(keep, pa.int64())], ["path", "block"])

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Info] = {}
        for batch in batches:
            for path, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path not in known:
                    known = {path: read_info(path)}
                info = known[path]
                with open(local_path(path), "rb") as f:
                    f.seek(info.offsets[k])
                    data = f.read(info.lengths[k])
                down, across, values = block_values(info, k, data)
                first = k // (info.across() * info.down()) + 1 if info.planar == 2 else 1
                for b, layer in enumerate(values, first):
                    if bands is not None and b not in bands:
                        continue
                    r, c = np.indices(layer.shape)
                    r, c, v = (r + down).ravel(), (c + across).ravel(), layer.astype(float).ravel()
                    if window is not None:
                        at = (r >= window[0]) & (r < window[2]) & (c >= window[1]) & (c < window[3])
                        r, c, v = r[at], c[at], v[at]
                    gone = ~np.isfinite(v) if info.nodata is None else ~np.isfinite(v) | (v == info.nodata)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(v)), pa.array(np.full(len(v), b, np.int32)), pa.array(r.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(v, mask=gone)], ["path", "band", "row", "col", "value"])

    blocks = named.mapInArrow(plan, "path string, block long").repartition(spark.sparkContext.defaultParallelism, "path", F.floor(F.col("block") / 8))
    return blocks.mapInArrow(decode, SCHEMA)


def raster_info(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a file: size, bands, origin, pixel size, nodata, EPSG code."""
    rows = [asdict(read_info(p)) for p in paths]
    keep = ("path", "width", "height", "bands", "x0", "y0", "size_x", "size_y", "nodata", "epsg")
    return spark.createDataFrame([tuple(r[k] for k in keep) for r in rows], "path string, width long, height long, bands int, x0 double, y0 double, size_x double, size_y double, nodata double, epsg int")


def encode(values: np.ndarray, x0: float, y0: float, size: float, nodata: float = -9999.0, epsg: int | None = None, kind: str = "<f4") -> bytes:
    """A GeoTIFF of (bands, rows, columns), in one deflated strip for each band; missing values become nodata."""
    bands, height, width = values.shape
    made = np.where(np.isfinite(values), values, nodata).astype(kind)
    strips = [zlib.compress(np.ascontiguousarray(b).tobytes(), 6) for b in made]
    sample = {"u": 1, "i": 2, "f": 3}[np.dtype(kind).kind]
    tags: list[tuple[int, int, tuple | bytes]] = [
        (256, 4, (width,)), (257, 4, (height,)), (258, 3, (np.dtype(kind).itemsize * 8,) * bands), (259, 3, (8,)), (262, 3, (1,)), (273, 4, (0,) * bands), (277, 3, (bands,)), (278, 4, (height,)),
        (279, 4, tuple(map(len, strips))), (284, 3, (2,)), (339, 3, (sample,) * bands), (33550, 12, (size, size, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0, y0, 0.0)),
    ]
    if epsg:
        key = 2048 if epsg in (4326, 4258, 4269) else 3072
        tags.append((34735, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if key == 2048 else 1, key, 0, 1, epsg)))
    tags.append((42113, 2, f"{nodata:g}\0".encode()))
    head = 8 + 2 + 12 * len(tags) + 4
    body, entries, at = b"", [], head
    packed = []
    for tag, t, v in tags:
        code = _SIZES[t][0]
        raw = bytes(v) if t == 2 else struct.pack(f"<{len(v)}{code}", *v)
        packed.append((tag, t, len(v), raw))
    extra = sum(len(r) + len(r) % 2 for _, _, _, r in packed if len(r) > 4)
    starts = tuple(head + extra + sum(map(len, strips[:i])) for i in range(bands))
    for tag, t, n, raw in packed:
        if tag == 273:
            raw = struct.pack(f"<{bands}I", *starts)
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", tag, t, n, at + len(body)))
            body += raw + b"\0" * (len(raw) % 2)
        else:
            entries.append(struct.pack("<HHI", tag, t, n) + raw.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(entries) + struct.pack("<I", 0) + body + b"".join(strips)


def write_geotiff_tiles(raster: DataFrame, folder: str, x0: float, y0: float, size: float, bands: list[str] = ["value"], nodata: float = -9999.0, epsg: int | None = None, tile: int = TILE) -> DataFrame:  # noqa: B006
    """Pixels (row, col, a column for each band) as files tile_R_C.tif in a folder, each by the task that has its pixels, and their index (name, first
    row, first column, pixels), which is returned, in its folder `index`. A file is written beside its place and moved there, so a repeated task
    leaves a whole file."""
    where = local_path(folder)

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        down, across = int(frame["_tr"].iloc[0]) * tile, int(frame["_tc"].iloc[0]) * tile
        made = np.full((len(bands), tile, tile), np.nan)
        for i, b in enumerate(bands):
            made[i, frame["row"] - down, frame["col"] - across] = frame[b]
        name = f"tile_{down // tile}_{across // tile}.tif"
        os.makedirs(where, exist_ok=True)
        part = os.path.join(where, f".{name}.{os.getpid()}")
        with open(part, "wb") as f:
            f.write(encode(made, x0 + across * size, y0 - down * size, size, nodata, epsg))
        os.replace(part, os.path.join(where, name))
        return pd.DataFrame([(name, down, across, int(np.isfinite(made[0]).sum()))], columns=["name", "row", "col", "pixels"])

    placed = raster.select("row", "col", *bands, F.floor(F.col("row") / tile).cast("long").alias("_tr"), F.floor(F.col("col") / tile).cast("long").alias("_tc"))
    index = placed.groupBy("_tr", "_tc").applyInPandas(write, "name string, row long, col long, pixels long")
    index.write.mode("overwrite").parquet(f"file:{where}/index")
    return raster.sparkSession.read.parquet(f"file:{where}/index")


def declare_nodata(raster: DataFrame, value: float, column: str = "value") -> DataFrame:
    """A raster without a declared nodata value, with that value as missing."""
    return raster.withColumn(column, F.nullif(F.col(column), F.lit(float(value))))


def window_of(raster: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Pixels of a window (half-open); on a partitioned table the predicate reaches the scan."""
    return raster.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))
