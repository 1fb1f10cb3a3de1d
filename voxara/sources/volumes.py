"""VOL, TIFF and Zarr volumes, file information, and reads and writes of blocks.

A Zarr array is a folder of chunks, so every task writes and reads whole chunks of its own; VOL and TIFF are single
files, decoded by one task and written slice by slice through the driver.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from itertools import product
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.raster import AXES, Image
from voxara.sources import files, raw
from voxara.store import kept

_PIXELS = "x bigint, y bigint, z bigint, v double"
#: Bytes of a file that hold any header.
HEADER = 65_536


def _head(spark: SparkSession, path: str, size: int = HEADER) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size)).first()[0])


# VOL


def vol_header(data: bytes) -> tuple[tuple[int, int, int], str, bool, int]:
    """(dimensions, pixel type, big-endian, header bytes): lines of key: value up to one that is empty or a full stop."""
    fields, at = {}, 0
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("No VOL header")
        line, at = data[at:end].decode("ascii", "replace").strip(), end + 1
        if line in ("", "."):
            break
        key, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[A-Za-z0-9 :-]+", line):
            raise ValueError(f"No VOL header line: {line}")
        fields[key.strip().lower()] = value.strip()
    size = fields.get("voxel-size") or fields.get("lvoxel-size")
    kinds = {"1": "uint8", "2": "uint16", "4": "uint32"}
    if size not in kinds or fields.get("int-endian", "0123") not in ("0123", "1032"):
        raise ValueError("VOL files of this voxel size or byte order aren't supported")
    return tuple(int(fields[a]) for a in AXES), kinds[size], fields.get("int-endian") == "1032", at


def read_vol(spark: SparkSession, path: str) -> Image:
    dims, dtype, big, start = vol_header(_head(spark, path))
    kind = np.dtype(dtype).newbyteorder(">" if big else "<")

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield from files.slices_of(content, dims, kind.itemsize, start)

    return Image(files.decoded(spark.read.format("binaryFile").load(path).select("content").mapInPandas(runs, files.RUNS), dims, kind), dims, dtype)


# TIFF: grey, uncompressed, one strip for each slice

_TIFF_KINDS = {("uint8", 1): 8, ("uint16", 1): 16, ("uint32", 1): 32, ("int8", 2): 8, ("int16", 2): 16, ("int32", 2): 32, ("float32", 3): 32}


def tiff_pages(data: bytes) -> tuple[list[tuple[int, int, str, list[int], list[int]]], str]:
    """(width, height, pixel type, strip offsets, strip sizes) of every page, and the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("No TIFF")
    pages, at = [], struct.unpack(order + "I", data[4:8])[0]
    while at:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("", 0))
            if code:
                place = at + 10 + 12 * i
                if count * size > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
        if tags.get(259, [1]) != [1] or tags.get(277, [1]) != [1]:
            raise ValueError("Only uncompressed grey TIFF files are supported")
        bits, form = tags.get(258, [8])[0], tags.get(339, [1])[0]
        dtype = next((d for (d, f), b in _TIFF_KINDS.items() if f == form and b == bits), None)
        if dtype is None:
            raise ValueError(f"TIFF pixels of {bits} bits and format {form} aren't supported")
        pages.append((tags[256][0], tags[257][0], dtype, tags[273], tags[279]))
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return pages, order


def read_tiff(spark: SparkSession, path: str) -> Image:
    """Pages of one size are slices. Page tables may stand anywhere, so they are parsed where the file is, and the sizes alone come to the driver."""
    source = spark.read.format("binaryFile").load(path).select("content")

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                pages, _ = tiff_pages(content)
                if len({p[:3] for p in pages}) != 1:
                    raise ValueError("TIFF pages differ in size or type")
                yield pd.DataFrame({"w": [pages[0][0]], "h": [pages[0][1]], "d": [len(pages)], "t": [pages[0][2]]})

    size = source.mapInPandas(sizes, "w int, h int, d int, t string").first()

    dims, kind = (size.w, size.h, size.d), np.dtype(size.t)
    many = max(1, raw.SPAN // (size.w * size.h))

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                pages, order = tiff_pages(content)
                for z in range(0, len(pages), many):
                    data = [np.frombuffer(b"".join(content[s : s + n] for s, n in zip(p[3], p[4], strict=True)), kind.newbyteorder(order), size.w * size.h) for p in pages[z : z + many]]
                    yield pd.DataFrame({"z": [z], "data": [np.concatenate(data).astype(kind).tobytes()]})

    return Image(files.decoded(source.mapInPandas(runs, files.RUNS), dims, kind), dims, size.t)


def write_tiff(image: Image, path: str) -> None:
    """One page for each slice, whose lines tasks write; the driver adds the page tables. Files stay under 4 GB by the format."""
    w, h, d = image.dims
    (form, bits) = next(((f, b) for (t, f), b in _TIFF_KINDS.items() if t == image.dtype), (0, 0))
    if not form:
        raise ValueError(f"TIFF files don't hold {image.dtype}")
    size, table = w * h * bits // 8, 2 + 12 * 10 + 4
    if 8 + d * (size + table) >= 1 << 32:
        raise ValueError("TIFF files hold less than 4 GB")
    raw.put_lines(image, path, 8 + d * (size + table), 8)
    with open(path.removeprefix("file://"), "r+b") as f:
        f.write(struct.pack("<2sHI", b"II", 42, 8 + d * size))
        f.seek(8 + d * size)
        for z in range(d):
            at = 8 + d * size + z * table
            entries = [(256, 4, w), (257, 4, h), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, 8 + z * size), (277, 3, 1), (278, 4, h), (279, 4, size), (339, 3, form)]
            f.write(struct.pack("<H", 10) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in entries) + struct.pack("<I", at + table if z + 1 < d else 0))


# Zarr, version 3: regular chunks, default keys, codecs bytes and zstd


def _zarr_meta(image_dims: tuple, dtype: str, chunk: tuple, zstd: bool) -> dict:
    codecs: list[dict] = [{"name": "bytes", "configuration": {"endian": "little"}}]
    if zstd:
        codecs.append({"name": "zstd", "configuration": {"level": 3, "checksum": False}})
    return {
        "zarr_format": 3, "node_type": "array", "shape": list(image_dims), "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": codecs, "attributes": {},
    }


def write_zarr(image: Image, folder: str, chunk: tuple[int, int, int] = (64, 64, 64), zstd: bool = True) -> DataFrame:
    """A chunk for each block of pixels, written by the task that has it, so folder must be shared by all executors; returns the chunks' keys. Axes are x, y, z."""
    dims, dtype, kind = image.dims, image.dtype, np.dtype(image.dtype).newbyteorder("<")
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "zarr.json").write_text(json.dumps(_zarr_meta(dims, dtype, chunk, zstd)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [int(pdf[f"c{a}"].iloc[0]) for a in AXES]
        block = np.zeros(chunk, kind)
        block[tuple(pdf[a].to_numpy() - k * n for a, k, n in zip(AXES, key, chunk, strict=True))] = pdf["v"].to_numpy()
        data = block.tobytes()
        if zstd:
            import zstandard

            data = zstandard.ZstdCompressor(level=3).compress(data)
        at = Path(folder, "c", *map(str, key))
        at.parent.mkdir(parents=True, exist_ok=True)
        part = at.with_name(f".{at.name}-{id(pdf)}")
        part.write_bytes(data)
        part.replace(at)  # a repeated task writes the same chunk again
        return pd.DataFrame({"key": ["/".join(map(str, key))]})

    keys = [F.floor(F.col(a) / n).alias(f"c{a}") for a, n in zip(AXES, chunk, strict=True)]
    out = image.df.select(*AXES, "v", *keys).groupBy("cx", "cy", "cz").applyInPandas(run, "key string")
    return kept(out)


def zarr_meta(spark: SparkSession, folder: str) -> tuple[tuple[int, int, int], str, tuple[int, int, int], list[str]]:
    """(dimensions, pixel type, chunk shape, codecs)."""
    meta = json.loads(_head(spark, f"{folder}/zarr.json", 1 << 20))
    names = [c["name"] for c in meta["codecs"]]
    if meta.get("zarr_format") != 3 or any(n not in ("bytes", "zstd") for n in names) or meta["chunk_key_encoding"]["name"] != "default":
        raise ValueError(f"Zarr arrays with codecs {names} aren't supported")
    shape = tuple((*meta["shape"], 1, 1)[:3])
    return shape, meta["data_type"], tuple((*meta["chunk_grid"]["configuration"]["chunk_shape"], 1, 1)[:3]), names


def read_zarr(spark: SparkSession, folder: str, position: tuple | None = None, size: tuple | None = None) -> Image:
    """An array, or a box of it whose chunks alone are read. Missing chunks are 0."""
    dims, dtype, chunk, codecs = zarr_meta(spark, folder)
    start, extent = tuple(position or (0, 0, 0)), tuple(size or dims)
    kind = np.dtype(dtype).newbyteorder("<")
    ranges = [range(p // n, (p + e - 1) // n + 1) for p, e, n in zip(start, extent, chunk, strict=True)]
    keys = spark.createDataFrame([k for k in product(*ranges)], "cx int, cy int, cz int")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/c").select(*[F.regexp_extract("path", r"/c/(\d+)/(\d+)/(\d+)$", i).cast("int").alias(c) for i, c in enumerate(("cx", "cy", "cz"), 1)], "content")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for *key, data in zip(f["cx"], f["cy"], f["cz"], f["content"], strict=True):
                if data is None:
                    block = np.zeros(chunk, kind)
                else:
                    if "zstd" in codecs:
                        import zstandard

                        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(np.prod(chunk)) * kind.itemsize)
                    block = np.frombuffer(data, kind).reshape(chunk)
                low = [max(p, k * n) for p, k, n in zip(start, key, chunk, strict=True)]
                high = [min(p + e, (k + 1) * n) for p, e, k, n in zip(start, extent, key, chunk, strict=True)]
                part = block[tuple(slice(a - k * n, b - k * n) for a, b, k, n in zip(low, high, key, chunk, strict=True))]
                at = np.indices(part.shape).reshape(3, -1)
                yield pd.DataFrame({a: at[i] + low[i] - start[i] for i, a in enumerate(AXES)} | {"v": part.ravel().astype(float)})

    df = keys.join(content, ["cx", "cy", "cz"], "left").mapInPandas(decode, _PIXELS)
    return Image(df, extent, dtype)


# What a file is, and blocks


def file_info(spark: SparkSession, path: str, dtype: str = "") -> tuple[tuple[int, int, int], str] | None:
    """(dimensions, pixel type) of any file that read_image reads; None for others."""
    try:
        if path.rstrip("/").endswith(".zarr"):
            return zarr_meta(spark, path)[:2]
        if path.endswith(".raw"):
            dims = raw.dims_of(path)
            size = spark.read.format("binaryFile").load(path).select("length").first()[0]
            bytes_each = size // (dims[0] * dims[1] * dims[2])
            kind = dtype or {1: "uint8", 2: "uint16", 4: "float32", 8: "uint64"}.get(bytes_each)
            return (dims, kind) if kind and np.dtype(kind).itemsize == bytes_each else None
        if path.endswith(".vol"):
            return vol_header(_head(spark, path))[:2]
        if path.endswith((".tif", ".tiff", ".nrrd", ".png")):
            image = read_image(spark, path)
            return image.dims, image.dtype
    except Exception as error:  # noqa: BLE001 - a probe of unknown files
        if "PATH_NOT_FOUND" in str(error) or isinstance(error, (ValueError, KeyError, struct.error, TypeError)):
            return None
        raise
    return None


def read_image(spark: SparkSession, path: str, dtype: str = "") -> Image:
    """By the name: Zarr, VOL, TIFF, NRRD, PNG or a pattern of PNGs, else raw with dimensions in the name."""
    if path.rstrip("/").endswith(".zarr"):
        return read_zarr(spark, path)
    if path.endswith(".vol"):
        return read_vol(spark, path)
    if path.endswith((".tif", ".tiff")):
        return read_tiff(spark, path)
    if path.endswith(".raw") and not dtype and (info := file_info(spark, path)):
        return raw.read_raw(spark, path, info[1])
    return files.read_image(spark, path, dtype or "uint8")


def read_block(spark: SparkSession, path: str, position: tuple, size: tuple, dtype: str = "") -> Image:
    """A box of a file. Zarr reads the box's chunks alone; of other formats the filter drops pixels while they are decoded."""
    if path.rstrip("/").endswith(".zarr"):
        return read_zarr(spark, path, position, size)
    image = read_image(spark, path, dtype)
    df = image.df
    for a, p, n in zip(AXES, position, size, strict=True):
        df = df.filter((F.col(a) >= p) & (F.col(a) < p + n))
    return Image(df.select(*[(F.col(a) - p).alias(a) for a, p in zip(AXES, position, strict=True)], "v"), tuple(size), image.dtype)


def write_raw_block(image: Image, path: str, position: tuple = (0, 0, 0), dims: tuple | None = None) -> None:
    """Writes an image at a position of a raw file, which is made of zeros where it is missing; lines go to their byte ranges."""
    w, h, d = dims or raw.dims_of(path)
    n = np.dtype(image.dtype).itemsize
    raw.put_lines(image, path, w * h * d * n, ((position[2] * h + position[1]) * w + position[0]) * n, w * n, w * h * n)
