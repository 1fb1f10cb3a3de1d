"""Single-file image formats: NRRD and PNG, and slices of a PNG sequence read in parallel.

NRRD lines have fixed places, so tasks write them where they lie; a PNG is compressed as a whole and written by one task.
Readers cut a file in one task into runs of slices, which other tasks decode.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.raster import AXES, Image
from voxara.sources import raw

#: Pixel types by their names in NRRD headers.
NRRD_TYPES = {
    "uchar": "uint8", "unsigned char": "uint8", "uint8": "uint8", "uint8_t": "uint8", "signed char": "int8", "int8": "int8", "ushort": "uint16", "unsigned short": "uint16", "uint16": "uint16", "short": "int16", "int16": "int16",
    "uint": "uint32", "unsigned int": "uint32", "uint32": "uint32", "int": "int32", "int32": "int32", "ulonglong": "uint64", "uint64": "uint64", "longlong": "int64", "int64": "int64", "float": "float32", "double": "float64",
}
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
PIXELS = "x bigint, y bigint, z bigint, v double"
RUNS = "z bigint, data binary"
#: Bytes of files that one task reads at most, unless one file has more.
READ = 1 << 25


def _pixels(a: np.ndarray, z: int = 0) -> pd.DataFrame:
    """Pixels of an array [z, y, x], slices from z on."""
    at = np.indices(a.shape).reshape(3, -1)
    return pd.DataFrame({"x": at[2], "y": at[1], "z": at[0] + z, "v": a.ravel().astype(float)})


def slices_of(data: bytes, dims: tuple[int, int, int], itemsize: int, start: int = 0) -> Iterator[pd.DataFrame]:
    """Rows z, data of runs of slices of about raw.SPAN pixels: bytes from start on that are too few for dims raise an error."""
    w, h, d = dims
    size, many = w * h * itemsize, max(1, raw.SPAN // (w * h))
    if len(data) < start + d * size:
        raise ValueError(f"{len(data) - start} bytes of {d * size} for an image of {dims}")
    for z in range(0, d, many):
        yield pd.DataFrame({"z": [z], "data": [data[start + z * size : start + min(z + many, d) * size]]})


def decoded(runs: DataFrame, dims: tuple[int, int, int], kind: np.dtype) -> DataFrame:
    """The pixels of rows z, data, dealt over tasks."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for z, data in zip(f["z"], f["data"], strict=True):
                yield _pixels(np.frombuffer(data, kind).reshape(-1, dims[1], dims[0]), z)

    return runs.repartition("z").mapInPandas(decode, PIXELS)


def parse_nrrd_header(text: bytes) -> tuple[dict[str, str], int]:
    """Header fields in lower case, and where the data start."""
    end = re.search(rb"\r?\n\r?\n", text)
    if not text.startswith(b"NRRD") or not end:
        raise ValueError("No NRRD header")
    fields = {}
    for line in text[: end.start()].decode("ascii", "replace").splitlines()[1:]:
        if not line.startswith("#") and ": " in line:
            key, value = line.split(": ", 1)
            fields[key.strip().lower()] = value.strip()
    return fields, end.end()


def read_nrrd(spark: SparkSession, path: str) -> Image:
    """Raw or gzip encoding, data in the same file."""
    head = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536)).first()[0])
    fields, start = parse_nrrd_header(head)
    if "data file" in fields or fields.get("encoding") not in ("raw", "gzip", "gz"):
        raise ValueError("NRRD files with detached data or another encoding than raw and gzip aren't supported")
    sizes = [int(n) for n in fields["sizes"].split()]
    dims = tuple((sizes + [1, 1])[:3])
    dtype = NRRD_TYPES[fields["type"]]
    kind = np.dtype(dtype).newbyteorder(">" if fields.get("endian") == "big" else "<")
    zipped = fields["encoding"] != "raw"

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                data = gzip.decompress(content[start:]) if zipped else content[start:]
                yield from slices_of(data, dims, kind.itemsize)

    df = decoded(spark.read.format("binaryFile").load(path).select("content").mapInPandas(runs, RUNS), dims, kind)
    return Image(df, dims, "float32" if dtype == "float64" else dtype)


def write_nrrd(image: Image, path: str) -> None:
    name = {v: k for k, v in NRRD_TYPES.items() if k in ("uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64", "float")}[image.dtype]
    sizes = " ".join(str(n) for n in image.dims)
    head = f"NRRD0004\ntype: {name}\ndimension: 3\nsizes: {sizes}\nendian: little\nencoding: raw\n\n".encode()
    raw.put_lines(image, path, len(head) + image.count * np.dtype(image.dtype).itemsize, len(head))
    with open(path.removeprefix("file://"), "r+b") as f:
        f.write(head)


def encode_png(a: np.ndarray) -> bytes:
    """A grey image [y, x] of 8 or 16 bits."""
    rows = a.astype(">u2") if a.dtype.itemsize == 2 else a.astype("u1")
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], rows.dtype.itemsize * 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in rows))) + chunk(b"IEND", b"")


def png_size(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a grey, not interlaced PNG."""
    if data[:8] != PNG_MAGIC or len(data) < 29:
        raise ValueError("No PNG")
    w, h, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", data[16:29])
    if colour or laced or bits not in (8, 16):
        raise ValueError("Only grey PNGs of 8 or 16 bits without interlacing are supported")
    return w, h, bits


def decode_png(data: bytes) -> np.ndarray:
    w, h, bits = png_size(data)
    packed, at = [], 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    flat = zlib.decompress(b"".join(packed))
    step, out, above = bits // 8, [], np.zeros(w * bits // 8, np.uint8)
    for y in range(h):
        kind, line = flat[y * (len(above) + 1)], np.frombuffer(flat, np.uint8, len(above), y * (len(above) + 1) + 1).copy()
        if kind == 2:
            line += above
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).ravel()
        elif kind in (3, 4):
            left, up = bytearray(len(line)), above.tolist()
            for i, c in enumerate(line.tolist()):
                a, b, d = (left[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                guess = (a + b) // 2 if kind == 3 else min(((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d)))[2]
                left[i] = (c + guess) & 255
            line = np.frombuffer(bytes(left), np.uint8)
        above = line
        out.append(line)
    rows = np.stack(out)
    return rows.copy().view(">u2").astype(np.uint16) if bits == 16 else rows


def write_png(image: Image, path: str) -> None:
    """One slice, encoded and written by one task, so path must be shared by all executors."""
    if image.dims[2] != 1 or image.dtype not in ("uint8", "uint16"):
        raise ValueError("PNG files hold images of one slice and of 8 or 16 bits")
    write_slices(image, lambda z: path.removeprefix("file://")).count()


def write_sequence(image: Image, folder: str) -> DataFrame:
    """One PNG for each slice, written by the tasks, so folder must be shared by all executors; returns z and path."""
    digits = len(str(image.dims[2]))
    if image.dtype not in ("uint8", "uint16"):
        raise ValueError("PNG files hold 8 or 16 bits")
    return write_slices(image, lambda z: f"{folder}/{z:0{digits}}.png")


def write_slices(image: Image, path_of: Callable[[int], str]) -> DataFrame:
    """z and path of each slice, which a task writes as a PNG."""
    w, h, _ = image.dims
    kind = np.dtype(image.dtype)

    many = max(1, raw.SPAN // (w * h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, slices = None, np.zeros((many, h, w), kind)
        used = np.zeros(many, bool)
        for b in batches:
            x, y, z = (b.column(a).to_numpy() for a in AXES)
            first = int(z[0]) // many * many if first is None else first
            slices[z - first, y, x], used[z - first] = b.column("v").to_numpy().astype(kind), True
        numbers = [first + int(i) for i in np.flatnonzero(used)]
        for z in numbers:
            with open(path_of(z), "wb") as f:
                f.write(encode_png(slices[z - first]))
        yield pa.RecordBatch.from_pydict({"z": numbers, "path": [path_of(z) for z in numbers]})

    return image.df.groupBy(F.floor(F.col("z") / many).alias("run")).applyInArrow(run, "z bigint, path string")


def read_sequence(spark: SparkSession, pattern: str) -> Image:
    """PNG slices in the natural order of their names; each is decoded by the task that read it."""
    folder, _, name = pattern.rpartition("/")
    reader = spark.read.format("binaryFile")
    # Of a pattern Spark lists every match by a task; a folder is listed once.
    listed = folder and re.search(r"[*?\[{]", name) and not re.search(r"[*?\[{\\]", folder)
    files = reader.option("pathGlobFilter", name).load(folder) if listed else reader.load(pattern)
    natural = lambda p: [int(s) if s.isdigit() else s for s in re.split(r"(\d+)", p)]
    # Spark deals small files as if each had megabytes, a task for some thirty of them.
    tasks = 4 * spark.sparkContext.defaultParallelism
    found = files.select("path", "length").coalesce(tasks).collect()
    if not found:
        raise ValueError(f"No image matches {pattern}")
    names = sorted((r.path for r in found), key=natural)
    tasks = max(tasks, -(-sum(r.length for r in found) // READ))
    alone = spark.read.format("binaryFile").load(re.sub(r"([\[\]{}*?\\])", r"\\\1", names[0]))
    w, h, bits = png_size(bytes(alone.select(F.substring("content", 1, 64)).first()[0]))
    order = {p: z for z, p in enumerate(names)}
    many = max(1, raw.SPAN // (w * h))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for start in range(0, len(f), many):
                made = []
                for path, content in zip(f["path"][start : start + many], f["content"][start : start + many], strict=True):
                    a = decode_png(content)
                    if a.shape != (h, w):
                        raise ValueError(f"{path} has another size than {names[0]}")
                    made.append(a)
                out = _pixels(np.stack(made))
                yield out.assign(z=np.array([order[p] for p in f["path"][start : start + many]])[out["z"]])

    return Image(files.select("path", "content").coalesce(tasks).mapInPandas(decode, PIXELS), (w, h, len(names)), "uint16" if bits == 16 else "uint8")


def read_image(spark: SparkSession, path: str, dtype: str = "uint8") -> Image:
    """By the name: NRRD, a PNG or a pattern of PNGs, else raw with dimensions in the name."""
    if path.endswith(".nrrd"):
        return read_nrrd(spark, path)
    if path.endswith(".png"):
        return read_sequence(spark, path)
    return raw.read_raw(spark, path, dtype)
