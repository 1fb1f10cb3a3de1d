"""Commands of the session itself: values, metadata, files' information, help, settings, timing and background scripts."""

from __future__ import annotations

import json
import sys
import threading
from collections.abc import Callable
from typing import TYPE_CHECKING

import pyspark
from pyspark.sql import functions as F

from voxara.operators import analyzers
from voxara.raster import AXES, Image, new_image, pix, pixel_round
from voxara.sources import volumes
from voxara.store import kept

if TYPE_CHECKING:
    from voxara.plans.script import Session

Value = str | float | bool | tuple
#: Types of values and what makes one of a text.
KINDS: dict[str, Callable[[Value], Value]] = {"string": str, "int": int, "real": float, "bool": lambda x: str(x).lower() in ("true", "1")}


def new_value(s: Session, name: str, kind: str = "string", value: Value = "") -> None:
    if kind not in KINDS:
        raise ValueError(f"No value type {kind}; there are {', '.join(KINDS)}")
    s.values[name] = KINDS[kind](value if value != "" or kind == "string" else 0)


def set_(s: Session, name: str, value: Value, *rest: Value) -> None:
    """A value; or all pixels of an image, one pixel at a position, the pixels at a table's positions, or those of another image."""
    if name not in s.images:
        s.values[name] = type(s.values[name])(value) if name in s.values and not isinstance(value, tuple) else value
        return
    im = s.images[name]
    if isinstance(value, tuple):
        at = F.lit(True)
        for a, p, o in zip(AXES, value, rest[1] if len(rest) > 1 else (0, 0, 0), strict=True):
            at = at & (F.col(a) == p - o)
        s.images[name] = im.map(F.when(at, F.lit(float(rest[0]))).otherwise(pix()))
    elif value in s.images:
        other = s.images[value]
        s.images[name] = Image(other.df, other.dims, other.dtype).map(pix(), im.dtype)
    elif value in s.tables:
        points = s.tables[value].select(*[F.round(F.col(a)).cast("bigint").alias(a) for a in AXES], F.col("v").cast("double").alias("w")).groupBy(*AXES).agg(F.max("w").alias("w"))
        s.images[name] = im.with_rows(im.df.join(points, list(AXES), "left").select(*AXES, pixel_round(F.coalesce("w", "v"), im.dtype).alias("v")))
    else:
        s.images[name] = im.map(F.lit(float(value)))


def list_(s: Session) -> None:
    for name, im in sorted(s.images.items()):
        s.say(f"{name}, {im.dims[0]} x {im.dims[1]} x {im.dims[2]}, {im.dtype}")
    for name, value in sorted(s.values.items()):
        s.say(f"{name} = {value}")


def ensure_size(s: Session, name: str, *size: Value) -> None:
    """A new image of zeros where the size differs."""
    dims = tuple(size[0]) if size and isinstance(size[0], tuple) else tuple((*size, 1, 1, 1)[:3])
    im = s.image(name)
    if im.dims != dims:
        s.images[name] = new_image(s.spark, dims, im.dtype)


def new_like_file(s: Session, name: str, path: str, dtype: str = "", *size: Value) -> None:
    dims, kind = _info(s, path)
    given = size[0] if size and isinstance(size[0], tuple) else (*size, 0, 0, 0)[:3]
    s.images[name] = new_image(s.spark, tuple(n or m for n, m in zip(given, dims, strict=True)), dtype or kind)


def set_meta(s: Session, image: str, key: str, value: Value, column: int = 0, row: int = 0) -> None:
    """Rows and columns between those that are set are empty texts."""
    s.image(image)
    rows = s.meta.setdefault(image, {}).setdefault(key, [])
    rows += [[] for _ in range(row + 1 - len(rows))]
    rows[row] += [""] * (column + 1 - len(rows[row]))
    rows[row][column] = str(value)


def get_meta(s: Session, image: str, key: str, target: str, column: int = 0, row: int = 0, default: str = "") -> None:
    """An item's text at a row and column, the default where it is missing; the whole item where row or column is negative."""
    rows = s.meta.get(image, {}).get(key)
    if rows is None:
        s.values[target] = default
    elif row < 0 or column < 0:
        s.values[target] = "\n".join(", ".join(r) for r in rows)
    else:
        s.values[target] = rows[row][column] if row < len(rows) and column < len(rows[row]) else default


def meta_column_count(s: Session, image: str, key: str, row: int, target: str) -> None:
    rows = s.meta.get(image, {}).get(key, [])
    s.values[target] = len(rows[row]) if row < len(rows) else 0


def copy_meta(s: Session, source: str, target: str) -> None:
    s.meta[target] = {k: [list(r) for r in rows] for k, rows in s.meta.get(source, {}).items()}


def write_meta(s: Session, image: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(s.meta.get(image, {}), f, ensure_ascii=False)


def read_meta(s: Session, image: str, path: str) -> None:
    s.image(image)
    s.meta[image] = json.loads("\n".join(r.value for r in s.spark.read.text(path).collect()))


def _info(s: Session, path: str) -> tuple[tuple[int, int, int], str]:
    info = volumes.file_info(s.spark, path)
    if info is None:
        raise ValueError(f"{path} isn't an image file that can be read")
    return info


def file_info(s: Session, path: str, target: str = "") -> None:
    """Says a file's size and type, or sets an image of width, height, depth and the type's number (0 for no image)."""
    kinds = ["", "uint8", "uint16", "uint32", "uint64", "float32", "complex32", "int8", "int16", "int32", "int64"]
    info = volumes.file_info(s.spark, path)
    if target:
        numbers = [*info[0], kinds.index(info[1])] if info else [0, 0, 0, 0]
        s.images[target] = Image(s.spark.createDataFrame([(i, 0, 0, float(n)) for i, n in enumerate(numbers)], "x bigint, y bigint, z bigint, v double"), (4, 1, 1), "uint32")
    else:
        s.say(f"{info[0][0]} x {info[0][1]} x {info[0][2]}, {info[1]}" if info else "Not an image file.")


def is_image_file(s: Session, path: str, target: str) -> None:
    s.values[target] = found = volumes.file_info(s.spark, path) is not None
    s.images[target] = new_image(s.spark, (1, 1, 1), "uint8", float(found))


def say_headers(s: Session, names: str, target: str = "") -> None:
    text = ", ".join(analyzers.headers(tuple(n for n in names.replace(",", " ").split()))[1:])
    if target:
        s.values[target] = text
    else:
        s.say(text)


def help_(s: Session, topic: str = "", form: str = "text") -> None:
    """All commands, or those whose names hold the topic, with what they do."""
    for name, f in sorted(s.commands.items()):
        if topic.lower() in name:
            said = (f.__doc__ or "").strip().split("\n")[0]
            s.say(f"`{name}` {said}".rstrip() if form == "rst" else f"{name}: {said}" if said else name)


def timing(s: Session) -> None:
    for line in _times(s):
        s.say(line)


def _times(s: Session) -> list[str]:
    return [f"{name}: {len(t)} times, {sum(t):.3f} s" for name, t in sorted(s.times.items())]


def save_timing(s: Session, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(_times(s)) + "\n")


def submit_job(s: Session, script: str, _kind: str = "normal") -> None:
    """Runs a script in a thread; Spark schedules its jobs beside others."""
    job = threading.Thread(target=s.run, args=(script.replace("; ", "\n").replace(";", "\n"),))
    job.start()
    s.jobs.append(job)


def wait_for_jobs(s: Session) -> None:
    while s.jobs:
        s.jobs.pop().join()


def materialize(s: Session, image: str) -> None:
    """The image as a stored table."""
    im = s.image(image)
    s.images[image] = Image(kept(im.df), im.dims, im.dtype)


def _option(name: str, default: Value) -> Callable:
    def run(s: Session, *value: Value) -> None:
        s.options[name] = (value[0] if len(value) == 1 else value) if value else default

    run.__doc__ = f"Sets the option {name}; Spark plans and distributes by itself."
    return run


def _memory(s: Session, target: str) -> None:
    """Executor memory in bytes, as the session is configured."""
    conf = s.spark.sparkContext.getConf()
    text = conf.get("spark.executor.memory", None) or conf.get("spark.driver.memory", "1g")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    s.values[target] = float(s.options["maxmemory"] or (int(text[:-1]) * units[text[-1].lower()] if text[-1].isalpha() else int(text)))


def commands() -> dict[str, Callable]:
    """The session's own commands by name."""
    return {
        "newvalue": new_value, "set": set_, "list": list_, "ensuresize": ensure_size, "newlikefile": new_like_file, "setmeta": set_meta, "getmeta": get_meta, "copymeta": copy_meta, "metacolumncount": meta_column_count,
        "listmeta": lambda s, image, target: s.values.__setitem__(target, ", ".join(s.meta.get(image, {}))), "clearmeta": lambda s, image: s.meta.pop(image, None),
        "metarowcount": lambda s, image, key, target: s.values.__setitem__(target, len(s.meta.get(image, {}).get(key, []))), "writemeta": write_meta, "readmeta": read_meta,
        "fileinfo": file_info, "rawinfo": file_info, "sequenceinfo": file_info, "isimagefile": is_image_file, "getmapfile": lambda s, image, target: s.values.__setitem__(target, s.files.get(image, "")),
        "listanalyzers": lambda s: s.say(", ".join(analyzers.COLUMNS)), "headers": say_headers, "help": help_, "commandreference": help_, "timing": timing, "savetiming": save_timing, "resettiming": lambda s: s.times.clear(),
        "submitjob": submit_job, "waitforjobs": wait_for_jobs, "nop": materialize, "endconcurrentwrite": lambda s, image: None, "getmaxmemory": _memory,
        "print": lambda s, text="": s.say(str(text)), "hello": lambda s, name="there": s.say(f"Hello {name}!"), "license": lambda s: s.say("See the repository's licence."),
        "info": lambda s: s.say(f"Spark {pyspark.__version__}, Python {sys.version.split()[0]}, {s.spark.sparkContext.defaultParallelism} cores"), "waitreturn": lambda s: input(),
        "echo": lambda s, commands=True, timing=False: s.options.__setitem__("echo", commands),
        **{name: _option(name, default) for name, default in {"distribute": "", "delaying": True, "maxmemory": 0, "maxjobs": 0, "chunksize": (1536, 1536, 1536), "printscripts": True}.items()},
    }
