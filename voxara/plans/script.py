"""The command language: lines of name(argument, argument, ...), each of which builds on named images.

Images are lazy plans; a command replaces the image its first argument names, or sets the one its output argument
names, and nothing runs until a result is read. Texts may be quoted, vectors are [a, b, c], # starts a comment.
"""

from __future__ import annotations

import math
import re
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.operators import cross_sections, fourier, heights, skeletons, structure, analyzers, distance, generate, neighbourhood, pointwise, reconstruction, regions, registration, statistics, stitching, surfaces, tomography, transforms
from voxara.plans import session_commands, table_commands
from voxara.raster import Image, new_image
from voxara.sources import files, raw, volumes
from voxara.store import kept

_CALL = re.compile(r"\s*(\w+)\s*\((.*)\)\s*;?\s*$", re.S)
_PART = re.compile(r'\s*("(?:[^"\\]|\\.)*"|\[[^\]]*\]|[^,"\[\]]*)\s*(?:,|$)')
Value = str | float | bool | tuple


def _value(text: str) -> Value:
    if text.startswith('"'):
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    if text.startswith("["):
        return tuple(_value(t.strip()) for t in text[1:-1].split(","))
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text


def parse(line: str) -> tuple[str, list[Value]] | None:
    """(command, arguments); None for an empty line or a comment."""
    line = re.sub(r'^((?:[^"#]|"(?:[^"\\]|\\.)*")*)#.*$', r"\1", line).strip()
    if not line:
        return None
    call = _CALL.match(line)
    if not call:
        raise ValueError(f"No command: {line}")
    rest, arguments = call[2].strip(), []
    while rest:
        part = _PART.match(rest)
        if not part or not part[1].strip():
            raise ValueError(f"No argument at: {rest}")
        arguments.append(_value(part[1].strip()))
        rest = rest[part.end() :]
    return call[1].lower(), arguments


def _vector(x: Value) -> tuple:
    return x if isinstance(x, tuple) else (x,) * 3


class Session:
    """Named images, tables and values, and the commands that act on them. What commands say is kept in output and printed where printing is on."""

    def __init__(self, spark: SparkSession, printing: bool = False):
        self.spark = spark
        self.images: dict[str, Image] = {}
        self.tables: dict[str, DataFrame] = {}
        self.values: dict[str, Value] = {}
        #: Metadata of each image: rows of columns for each key.
        self.meta: dict[str, dict[str, list[list[str]]]] = {}
        self.files: dict[str, str] = {}
        self.options: dict[str, Value] = {"distribute": "spark", "delaying": True, "printscripts": False, "echo": False, "chunksize": (64, 64, 64), "maxmemory": 0, "maxjobs": 0}
        self.output: list[str] = []
        self.times: dict[str, list[float]] = {}
        self.jobs: list[threading.Thread] = []
        self.printing = printing
        self.commands = _commands() | session_commands.commands() | table_commands.commands()

    def say(self, text: str) -> None:
        self.output.append(text)
        if self.printing:
            print(text)

    def image(self, name: Value) -> Image:
        if name not in self.images:
            raise ValueError(f"No image named {name}")
        return self.images[name]

    def run(self, script: str) -> Session:
        for line in script.splitlines():
            if call := parse(line):
                name, arguments = call
                if name not in self.commands:
                    raise ValueError(f"No command named {name}")
                if self.options["echo"]:
                    self.say(line.strip())
                began = time.perf_counter()
                self.commands[name](self, *arguments)
                self.times.setdefault(name, []).append(time.perf_counter() - began)
        return self


def _commands() -> dict[str, Callable]:
    out: dict[str, Callable] = {}

    def in_place(name: str, f: Callable) -> None:
        def run(s: Session, image: str, *rest: Value) -> None:
            s.images[image] = f(s.image(image), *rest)

        out[name] = run

    def into(name: str, f: Callable) -> None:
        def run(s: Session, source: str, target: str, *rest: Value) -> None:
            s.images[target] = f(s.image(source), *rest)

        out[name] = run

    def table(name: str, f: Callable) -> None:
        def run(s: Session, source: str, target: str, *rest: Value) -> None:
            s.tables[target] = f(s.image(source), *rest)

        out[name] = run

    for name in pointwise.UNARY:
        in_place(name, lambda im, n=name: pointwise.unary(n, im))
    for name in pointwise.BINARY:

        def binary(s: Session, image: str, other: Value, broadcast: bool = False, n: str = name) -> None:
            a = s.image(image)
            s.images[image] = pointwise.with_image(n, a, s.image(other), broadcast) if isinstance(other, str) else pointwise.with_number(n, a, other)

        out[name] = binary
    for name, f in {
        "thresholdrange": pointwise.threshold_range, "thresholdperiodic": pointwise.threshold_periodic, "doublethreshold": pointwise.double_threshold, "linmap": pointwise.linmap, "replace": pointwise.replace_value,
        "clamp": pointwise.clamp, "ensurefinite": pointwise.ensure_finite, "swapbyteorder": pointwise.swap_byte_order, "setedges": generate.set_edges, "ramp": generate.ramp, "ramp3": generate.ramp3, "noise": generate.noise,
        "box": generate.box, "sphere": generate.sphere, "ellipsoid": generate.ellipsoid, "capsule": generate.capsule, "normalizez": statistics.normalize_z, "flip": transforms.flip, "rounddistanceridge2": distance.round_ridge,
        "floodfill": regions.flood_fill, "grow": regions.grow, "dualthreshold": regions.dual_threshold, "regionremoval": lambda im, least=600, c="Nearest": regions.remove_small(im, least, c),
        "label": regions.label, "openingfilter": lambda im, r=1, kind="Ellipsoidal", b="Nearest": neighbourhood.opening(im, _vector(r), kind, b), "closingfilter": lambda im, r=1, kind="Ellipsoidal", b="Nearest": neighbourhood.closing(im, _vector(r), kind, b),
        "autothreshold": lambda im, method="Otsu": pointwise.with_number("threshold", im, statistics.auto_threshold_value(im, method)),
    }.items():
        in_place(name, f)
    for name in neighbourhood.REDUCTIONS:
        into(name, lambda im, r=1, kind="Ellipsoidal", b="Nearest", n=name: neighbourhood.rank_filter(n, im, _vector(r), kind, b))
    for name in statistics.PROJECTIONS:
        into(name, lambda im, d=2, n=name: statistics.project(n, im, d))
    for name, f in {
        "copy": lambda im: im, "crop": transforms.crop, "rot90cw": transforms.rotate_cw, "rot90ccw": transforms.rotate_ccw, "reslice": transforms.reslice, "rotate": transforms.rotate, "translate": transforms.shift,
        "scale": lambda im, f: transforms.scale(im, _vector(f)), "montage": transforms.montage, "bin": lambda im, f, kind="mean": statistics.bin_image(im, _vector(f), kind), "maskedbin": statistics.masked_bin,
        "dmap": distance.distance, "dmap2": distance.squared_distance, "drawspheres2": distance.draw_spheres, "finalizetmap": distance.finalize_thickness, "tmap": distance.thickness, "localmaxima": regions.local_maxima,
        "gaussfilter": lambda im, s, b="Nearest": neighbourhood.gaussian(im, _vector(s), boundary=b), "highpassfilter": lambda im, s, shift=0.0: neighbourhood.high_pass(im, _vector(s), shift),
        "vawefilter": lambda im, r, noise, kind="Ellipsoidal", b="Nearest": neighbourhood.vawe(im, _vector(r), noise, kind, b), "bilateralfilter": lambda im, s, r, b="Nearest": neighbourhood.bilateral(im, _vector(s), r, b),
        "derivative": lambda im, s, first, second=-1: neighbourhood.derivative(im, _vector(s), first, second), "gradientmagnitude": neighbourhood.gradient_magnitude,
        "localthreshold": lambda im, r=1, method="Otsu": neighbourhood.local_threshold(im, _vector(r), method),
    }.items():
        into(name, f)
    for name, f in {
        "growlabels": regions.grow_labels, "greedycoloring": regions.greedy_coloring, "inpaintn": distance.inpaint_nearest, "cylindricality": structure.cylindricality, "canny": structure.canny, "cannypart1": structure.canny_classes,
        "cannypart2": structure.canny_edges, "bandpassfilter": fourier.band_pass, "surfacethin": skeletons.surface_thin, "linethin": skeletons.line_thin, "surfaceskeleton": skeletons.surface_skeleton,
        "lineskeleton": skeletons.line_skeleton, "classifyskeleton": skeletons.classify_skeleton, "line": generate.line, "prepareanalyzeparticles": lambda im, colour=1.0: im.map(F.when(F.col("v") != 0, float(colour)).otherwise(0.0)),
        "preparedmap": lambda im, background=0.0: im.map(F.when(F.col("v") == background, 0.0).otherwise(distance.FAR), "float32"),
    }.items():
        in_place(name, f)
    in_place("deadpixelremoval", tomography.remove_dead_pixels)
    for name, f in {
        "satofilter": structure.sato, "frangifilter": lambda im, s, scale=0.0, c=0.25, gamma=0.0, a=0.5, b=0.5: structure.frangi(im, s, scale, c, a, b), "danielsson2": distance.maximal_balls, "bilateralfilterapprox": neighbourhood.bilateral_sampled, "meancurvature": structure.mean_curvature,
    }.items():
        into(name, f)

    def with_other(name: str, f: Callable) -> None:
        def run(s: Session, image: str, other: str, *rest: Value) -> None:
            s.images[image] = f(s.image(image), s.image(other), *rest)

        out[name] = run

    for name, f in {
        "morphorec": regions.morphological_reconstruction, "labelmaxima": regions.label_maxima, "drawheightmap": heights.draw_height_map, "setbeforeheightmap": heights.set_before,
        "setafterheightmap": heights.set_after, "shiftz": heights.shift_z,
    }.items():
        with_other(name, f)

    def clean_maxima(s: Session, image: str, maxima: str, multiplier: float = 1.0) -> None:
        s.images[maxima] = regions.clean_maxima(s.image(image), s.image(maxima), multiplier)

    def seeded(s: Session, seeds: str, geometry: str, target: str, connectivity: str = "All") -> None:
        s.images[target] = distance.seeded_distance(s.image(seeds), s.image(geometry), connectivity)

    def gradient(s: Session, image: str, sigma: float, *targets: Value) -> None:
        im = s.image(image)
        for i, t in enumerate(targets[:3]):
            s.images[t] = neighbourhood.derivative(im, (sigma,) * 3, i)

    def orientation(f: Callable) -> Callable:
        def run(s: Session, image: str, phi: str, theta: str, *sigmas: float) -> None:
            s.images[image], s.images[phi], s.images[theta] = f(s.image(image), *sigmas)

        return run

    def difference(s: Session, phi: str, theta: str, target: str, phim: float, thetam: float) -> None:
        s.images[target] = structure.orientation_difference(s.image(phi), s.image(theta), phim, thetam)

    def main_color(s: Session, geometry: str, phi: str, theta: str, phim: float, thetam: float, *rgb: str) -> None:
        for name, im in zip(rgb, structure.main_orientation_color(s.image(geometry), s.image(phi), s.image(theta), phim, thetam), strict=True):
            s.images[name] = im

    def axelsson(s: Session, geometry: str, phi: str, theta: str, *rgb: str) -> None:
        for name, im in zip(rgb, structure.axelsson_color(s.image(geometry), s.image(phi), s.image(theta)), strict=True):
            s.images[name] = im

    def fft(s: Session, image: str, target: str) -> None:
        s.tables[target] = fourier.fft(s.image(image))

    def ifft(s: Session, transform: str, target: str) -> None:
        s.images[target] = fourier.ifft(s.tables[transform], s.image(target).dims)

    def threshold_value(s: Session, image: str, target: str, method: str = "Otsu") -> None:
        value = statistics.auto_threshold_value(s.image(image), method)
        s.values[target] = value
        s.images[target] = new_image(s.spark, (1, 1, 1), "float32", value)

    def trace(s: Session, image: str, vertices: str, edges: str) -> None:
        s.tables[vertices], s.tables[edges] = skeletons.trace_skeleton(s.image(image))

    def network(f: Callable) -> Callable:
        def run(s: Session, vertices: str, edges: str, *rest: Value) -> None:
            s.tables[vertices], s.tables[edges] = f(s.tables[vertices], s.tables[edges], *[s.tables.get(r, r) if isinstance(r, str) else r for r in rest])

        return run

    def lines(s: Session, vertices: str, edges: str, points: str, target: str) -> None:
        s.tables[points], s.tables[target] = skeletons.points_and_lines(s.tables[vertices], s.tables[edges])

    def fill(s: Session, image: str, edges: str, column: str = "length") -> None:
        s.images[image] = skeletons.fill_skeleton(s.image(image), s.tables[edges], column)

    def fill_particles(s: Session, image: str, results: str, colour: float, connectivity: str = "Nearest") -> None:
        s.images[image] = regions.fill_particles(s.image(image), s.tables[results], colour, connectivity)

    def ellipsoids(s: Session, image: str, results: str, colour: float, kind: str = "principal") -> None:
        s.images[image] = regions.draw_ellipsoids(s.image(image), s.tables[results], colour, kind)

    def graph(s: Session, image: str, vertices: str, edges: str, radius: float = 2.0, vertex: float = 1.0, edge: float = 1.0) -> None:
        s.images[image] = generate.draw_graph(s.image(image), s.tables[vertices], s.tables[edges], radius, vertex, edge)

    def generic(s: Session, image: str, target: str, position: tuple, reference: str, deformed: str, exponent: float = 2.5) -> None:
        points = lambda name: [tuple(r) for r in s.tables[name].select("x", "y", "z").collect()]
        s.images[target] = transforms.generic_transform(s.image(image), s.image(target).dims, position, points(reference), points(deformed), exponent)

    def fbp_filter(s: Session, target: str, size: int = 100, kind: str = "Ramp", cut_off: float = 1.0) -> None:
        s.images[target] = tomography.create_filter(s.spark, size, kind, cut_off)

    def match_tiles(s: Session, pixels: str, tiles: str, target: str, step: tuple, radius: tuple, search: tuple) -> None:
        points = stitching.grid_points(s.tables[tiles], stitching.overlaps(s.tables[tiles], max(search)), step, radius)
        s.tables[target] = kept(stitching.match(s.tables[pixels], points, search, radius))

    def world_to_local(s: Session, tiles: str, matches: str, placed: str, fields: str, step: tuple, local: bool = True) -> None:
        s.tables[placed] = kept(stitching.place(s.tables[tiles], s.tables[matches]))
        s.tables[fields] = kept(stitching.world_to_local(s.tables[placed], s.tables[matches], step, local))

    def stitched(s: Session, target: str, goodness: str, pixels: str, placed: str, fields: str, step: tuple, *rest: Value) -> None:
        """rest: x, y, z, width, height, depth of the part that is put out; normalize, circle mask diameter, and whether zeros are missing."""
        where, size, more = tuple(rest[:3]), tuple(rest[3:6]), rest[6:]
        dtype = s.image(target).dtype if target in s.images else "float32"
        image, good = stitching.stitch(s.tables[pixels], s.tables[placed], s.tables[fields], step, size, dtype, where, *more)
        s.images[target] = image
        if goodness:
            s.images[goodness] = good

    def csa(s: Session, original: str, energy: str, phi: str, theta: str, target: str, radius: int = 40, count: int = 1000, seed: int = 123, slices: str = "", drawn: str = "", length: str = "") -> None:
        im = s.image(original)
        found = kept(cross_sections.cross_sections(im, s.image(energy), s.image(phi), s.image(theta), radius, count, seed, s.image(length) if length else None))
        s.tables[target] = found.select("number", *cross_sections.headers(bool(length)))
        if slices:
            s.images[slices] = cross_sections.slices(found, radius, found.count())
        if drawn:
            s.images[drawn] = cross_sections.marked(im, found, radius, 127.0)

    def surface_area(s: Session, image: str, target: str, level: float = 1.0) -> None:
        value = surfaces.surface_area(s.image(image), level).first()["v"]
        s.values[target] = value
        s.images[target] = new_image(s.spark, (1, 1, 1), "float32", value)

    def curvature(s: Session, image: str, radius: float, kappa1: str, kappa2: str, boundary: str = "Nearest", elsewhere: float = math.nan) -> None:
        s.images[kappa1], s.images[kappa2] = surfaces.curvature(s.image(image), radius, boundary, elsewhere)

    def default_settings(s: Session, image: str) -> None:
        s.image(image)
        s.meta.setdefault(image, {}).update(reconstruction.Settings().to_meta())

    def preprocess(s: Session, image: str, target: str) -> None:
        """Settings stay with the projections, so that fbp finds them in the metadata of what it gets."""
        meta = s.meta.get(image, {})
        s.images[target] = reconstruction.preprocess(s.image(image), reconstruction.Settings.from_meta(meta))
        s.meta.setdefault(target, {}).update(meta)

    def back_project(s: Session, image: str, target: str, gpu: bool = True) -> None:
        s.images[target] = reconstruction.back_project(s.image(image), reconstruction.Settings.from_meta(s.meta.get(image, {})))

    def block_match(s: Session, reference: str, deformed: str, points: str, target: str, search: tuple = (5, 5, 5), radius: tuple = (25, 25, 25)) -> None:
        s.tables[target] = registration.block_match(s.image(reference), s.image(deformed), s.tables[points], search, radius)

    out |= {
        "createfbpfilter": fbp_filter, "csa": csa, "csaheaders": lambda s: s.say(", ".join(cross_sections.headers(True))), "matchtiles": match_tiles, "determine_world_to_local": world_to_local, "stitch_ver2": lambda s, target, *a: stitched(s, target, "", *a), "stitch_ver3": stitched, "surfacearea": surface_area, "curvature": curvature, "defaultrecsettings": default_settings, "fbppreprocess": preprocess, "fbp": back_project, "blockmatch": block_match, "cleanmaxima": clean_maxima, "sdmap": seeded, "gradient": gradient, "cylinderorientation": orientation(structure.cylinder_orientation), "plateorientation": orientation(structure.plate_orientation),
        "orientationdifference": difference, "mainorientationcolor": main_color, "axelssoncolor": axelsson, "fft": fft, "ifft": ifft, "autothresholdvalue": threshold_value, "tracelineskeleton": trace,
        "cleanskeleton": network(skeletons.clean_network), "pruneskeleton": network(skeletons.prune_network), "removeedges": network(skeletons.remove_edges), "getpointsandlines": lines, "fillskeleton": fill,
        "fillparticles": fill_particles, "drawellipsoids": ellipsoids, "drawgraph": graph, "generictransform": generic,
        "writevtk": lambda s, points, lines, path: skeletons.write_vtk(s.tables[points], s.tables[lines], path),
    }
    for name in statistics.STATISTICS:
        table(name, lambda im, n=name: statistics.statistic(n, im))
    table("maskedmean", statistics.masked_mean)
    table("hist", lambda im, low=0.0, high=256.0, bins=256: statistics.histogram(im, low, high, bins))
    names = lambda text: tuple(a for a in re.split(r"[^A-Za-z0-9]+", text) if a)
    table("analyzelabels", lambda im, *a: analyzers.analyze(im, names(" ".join(a)) or ("coordinates", "volume")))
    table("analyzeparticles", lambda im, *a: regions.analyze_particles(im, names(" ".join(a)) or ("coordinates", "volume")))

    def create(s: Session, name: str, dtype: str = "uint8", *size: Value) -> None:
        w, h, d = size[0] if size and isinstance(size[0], tuple) else (*size, 1, 1, 1)[:3]
        s.images[name] = new_image(s.spark, (w, h, d), dtype)

    def like(s: Session, name: str, template: str, dtype: str = "", *size: Value) -> None:
        im = s.image(template)
        size = size[0] if size and isinstance(size[0], tuple) else (*size, 0, 0, 0)[:3]
        s.images[name] = new_image(s.spark, tuple(n or m for n, m in zip(size, im.dims, strict=True)), dtype or im.dtype)

    def convert(s: Session, image: str, *rest: str) -> None:
        s.images[rest[0] if len(rest) > 1 else image] = pointwise.convert(s.image(image), rest[-1])

    def evaluate(s: Session, expression: str, image: str, *others: str) -> None:
        s.images[image] = pointwise.evaluate(expression, s.image(image), *map(s.image, others))

    def clear(s: Session, name: str = "") -> None:
        for held in (s.images, s.tables):
            held.pop(name, None) if name else held.clear()
        for held in (s.values, s.meta, s.files):
            held.pop(name, None) if name else held.clear()

    def read(s: Session, name: str, path: str, dtype: str = "", *size: Value) -> None:
        if size:
            dims = size[0] if isinstance(size[0], tuple) else tuple((*size, 1, 1)[:3])
            s.images[name] = raw.read_raw(s.spark, path, dtype or "uint8", dims)
        else:
            s.images[name] = volumes.read_image(s.spark, path, dtype)
        s.files[name] = path

    def read_block(s: Session, name: str, path: str, *rest: Value) -> None:
        if isinstance(rest[0], tuple):
            position, size, *more = rest
        else:
            position, size, more = rest[:3], rest[3:6], rest[6:]
        s.images[name] = volumes.read_block(s.spark, path, tuple(position), tuple(size), more[0] if more else "")

    def write_block(s: Session, image: str, path: str, position: tuple = (0, 0, 0), dims: tuple = (0, 0, 0)) -> None:
        volumes.write_raw_block(s.image(image), path, position, dims if any(dims) else None)

    out |= {"newimage": create, "newlike": like, "convert": convert, "eval": evaluate, "clear": clear, "writerawblock": write_block}
    out |= dict.fromkeys(("read", "readraw", "readsequence", "readvol", "mapraw"), read) | dict.fromkeys(("readblock", "readrawblock", "readsequenceblock"), read_block)
    writers = {
        "writeraw": raw.write_raw, "writenrrd": files.write_nrrd, "writepng": files.write_png, "writetif": volumes.write_tiff, "writesequence": lambda im, folder: files.write_sequence(im, folder).count(),
        "writezarr": lambda im, folder, chunk=(64, 64, 64): volumes.write_zarr(im, folder, tuple(chunk)),
    }
    for name, f in writers.items():
        out[name] = lambda s, image, path, f=f: f(s.image(image), path)
    return out
