"""Filtered back-projection of cone-beam scans.

A projection image has x along the detector, y up it and z counting projections. Lines of the detector are weighted and
filtered where they lie; each is then cut into the pieces that blocks of the volume see of it, pieces meet in the tasks
of their blocks in the order of projections, and a block is summed as they stream by. A task holds one block and one
projection's piece of it, whatever the number of projections and the size of the volume.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields, replace
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.operators import neighbourhood, pointwise, statistics, transforms
from voxara.operators.blocks import BLOCK
from voxara.operators.tomography import projection_filter, remove_dead_pixels
from voxara.raster import AXES, Image, new_image, pix

Vector = tuple[float, float, float]
#: Pixels, padding included, of the detector lines of one group while they are filtered, unless one line has more.
PIXELS = 131_072
#: Values of the pieces of lines that leave a task at once.
VALUES = 1_000_000
#: Transmissions are kept this far from 0 and 1.
MARGIN = 0.00001
#: Pixels of padding at each side of a line, at least.
LEAST_PADDING = 10
#: Blocks that a shape of blocks is judged by, and how many pixels a piece of a line costs beside its own.
JUDGED, PIECE = 500, 8
#: A volume of fewer blocks than this is summed in up to PARTS parts a block, so that its projections are shared out.
FEW_BLOCKS, PARTS = 64, 8


@dataclass(frozen=True)
class Settings:
    """Of a scan and its reconstruction; lengths in pixels, angles in degrees. Names are those of the metadata."""

    source_to_ra: float = 0.0
    rotation_direction: str = "Clockwise"
    bhc: float = 0.0
    rec_as_180_deg_scan: bool = True
    central_angle: float = 0.0
    hswp: float = 1.0
    rotation: float = 0.0
    roi_center: Vector = (0, 0, 0)
    roi_size: Vector = (0, 0, 0)
    crop_size: tuple[int, int] = (0, 0)
    binning: int = 1
    angular_binning: int = 1
    remove_dead_pixels: bool = False
    dead_pixel_median_radius: int = 1
    dead_pixel_std_dev_count: float = 20.0
    center_shift: float = 0.0
    camera_z_shift: float = 0.0
    camera_rotation: float = 0.0
    rotation_axis_tilt: float = 0.0
    cs_angle_slope: float = 0.0
    angle_tweak: float = 0.0
    pad_type: str = "Mirror"
    pad_size: float = 0.5
    filter_type: str = "Ramp"
    filter_cut_off: float = 1.0
    phase_mode: str = "Absorption"
    phase_pad_type: str = "Mirror"
    phase_pad_size: float = 0.5
    propagation_distance: float = 1000.0
    delta: float = 5e-16
    mu: float = 1e-7
    range_min: float = 0.0
    range_max: float = 1.0
    shift_scale: float = 1.0
    use_shifts: bool = True
    ra_h_shift_tilt: float = 0.0
    ra_v_shift_tilt: float = 0.0
    ring_algorithm: str = "None"
    ring_kernel_size: int = 1
    pre_smoothing: str = "None"
    pre_smoothing_kernel_size: float = 1.0
    angles: tuple[float, ...] = ()
    sample_shifts: tuple[Vector, ...] = ()
    source_shifts: tuple[Vector, ...] = ()
    camera_shifts: tuple[Vector, ...] = ()
    rotation_axis_shifts: tuple[Vector, ...] = ()

    def to_meta(self) -> dict[str, list[list[str]]]:
        """Metadata: rows of columns for each name; lists have a row for each entry."""
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            rows = value if f.name in LISTS else [value]
            out[f.name] = [[str(c) for c in (row if isinstance(row, tuple) else (row,))] for row in rows]
        return out

    @staticmethod
    def from_meta(meta: dict[str, list[list[str]]]) -> Settings:
        """Settings of metadata; names that it lacks keep their defaults, and other names are ignored."""
        given = {}
        for f in fields(Settings):
            if f.name in meta:
                rows, like = meta[f.name], f.default
                if f.name == "angles":
                    given[f.name] = tuple(float(c) for row in rows for c in row)
                elif f.name in LISTS:
                    given[f.name] = tuple(tuple(float(c) for c in row) for row in rows)
                elif isinstance(like, tuple):
                    given[f.name] = tuple(type(like[0])(float(c)) for c in rows[0])
                else:
                    text = rows[0][0]
                    given[f.name] = text.strip().lower() in ("true", "1") if isinstance(like, bool) else int(float(text)) if isinstance(like, int) else type(like)(text)
        return Settings(**given)

    def binned(self) -> Settings:
        """Settings for projections that were cropped and binned: lengths shrink, and each group of projections has its mean angle and shifts."""
        b, n = self.binning, self.angular_binning
        means = lambda rows: tuple(tuple(np.mean(rows[i : i + n], axis=0)) for i in range(0, len(rows) - n + 1, n))
        shrunk = lambda rows: tuple(tuple(c / b for c in row) for row in means(rows))
        shifts = {name: shrunk(getattr(self, name)) for name in LISTS if name != "angles"}
        size = tuple(0 if c == 0 else max(1, int(c // b)) for c in self.roi_size)
        return replace(
            self, **shifts, angles=tuple(a for (a,) in means([(a,) for a in self.angles])), binning=1, angular_binning=1, crop_size=(0, 0), roi_center=tuple(int(c / b) for c in self.roi_center), roi_size=size,
            **{name: getattr(self, name) / b for name in ("camera_z_shift", "center_shift", "cs_angle_slope", "propagation_distance", "source_to_ra")}, delta=self.delta * b, mu=self.mu * b,
        )

    def half_cone(self, width: int) -> float:
        """The largest angle between a ray of the middle line and the optical axis."""
        return math.degrees(math.atan2(width / 2, self.source_to_ra))

    def middle_angle(self, width: int) -> float:
        """central_angle, moved so that half a turn and the cone fit among the angles."""
        room = 90 + self.half_cone(width)
        return min(max(self.central_angle, min(self.angles) + room), max(self.angles) - room)


#: Settings with an entry for each projection.
LISTS = ("angles", "sample_shifts", "source_shifts", "camera_shifts", "rotation_axis_shifts")
CHOICES = {
    "rotation_direction": ("Clockwise", "Counterclockwise"), "pad_type": ("Mirror", "Nearest"), "phase_pad_type": ("Mirror", "Nearest"), "phase_mode": ("Absorption", "Paganin", "Direct"),
    "ring_algorithm": ("None", "Harjupatana-Gamma"), "pre_smoothing": ("None", "Gauss", "Median"),
}


def checked(projections: Image, s: Settings) -> None:
    """Raises ValueError where settings don't suit the projections."""
    count = projections.dims[2]
    for name in LISTS:
        if len(getattr(s, name)) not in ((count,) if name == "angles" else (0, count)):
            raise ValueError(f"{count} projections, but {len(getattr(s, name))} {name}")
    for name in ("source_to_ra", "binning", "angular_binning", "ring_kernel_size", "pre_smoothing_kernel_size"):
        if getattr(s, name) <= 0:
            raise ValueError(f"{name} must be positive")
    for name, known in CHOICES.items():
        if getattr(s, name) not in known:
            raise ValueError(f"{name} is one of {', '.join(known)}")


def flat_field(projections: Image, flats: Image, darks: Image) -> Image:
    """Transmissions of counts: less the mean of dark images, over the mean of flat ones less that; NaN where those are equal."""
    flat, dark = (statistics.project("meanproject", im).df.select("x", "y", F.col("v").alias(n)) for im, n in ((flats, "f"), (darks, "d")))
    both = projections.df.join(flat.join(dark, ["x", "y"]), ["x", "y"])
    gap = F.col("f") - F.col("d")
    return projections.with_rows(both.select(*AXES, F.when(gap != 0, (pix() - F.col("d")) / gap).otherwise(float("nan")).alias("v")), dtype="float32")


def transmissions(projections: Image, s: Settings) -> Image:
    """Projections without dead pixels, cropped, binned, smoothed and as -log or phase; of too few left for a group of angular_binning none stays."""
    if s.remove_dead_pixels:
        projections = remove_dead_pixels(projections, s.dead_pixel_median_radius, s.dead_pixel_std_dev_count)
    w, h, d = projections.dims
    cx, cy = s.crop_size
    size = ((w - 2 * cx) // s.binning, (h - 2 * cy) // s.binning, d // s.angular_binning)
    if min(size) < 1:
        raise ValueError("Nothing is left after cropping and binning")
    im = replace(projections, dtype="float32")
    if cx or cy:
        im = transforms.crop(im, (cx, cy, 0), (w - 2 * cx, h - 2 * cy, d))
    if s.binning > 1 or s.angular_binning > 1:
        im = statistics.bin_image(im, (s.binning, s.binning, s.angular_binning))
    if s.phase_mode != "Direct":
        im = im.map(F.least(F.greatest(pix(), F.lit(MARGIN)), F.lit(1 - MARGIN)))
    r = s.pre_smoothing_kernel_size
    if s.pre_smoothing == "Gauss":
        im = neighbourhood.gaussian(im, (r, r, 0))
    elif s.pre_smoothing == "Median":
        im = neighbourhood.rank_filter("medianfilter", im, (round(r), round(r), 0))
    if s.phase_mode == "Absorption":
        return im.map(-F.log(pix()))
    return paganin(im, s.binned()) if s.phase_mode == "Paganin" else im


def paganin(im: Image, s: Settings) -> Image:
    """-log of each projection after a low-pass that turns phase contrast of one material into thickness; a task has whole projections.

    The filter's frequencies are those of the padded projection, in cycles along it.
    """
    w, h, _ = im.dims
    px, py = round(s.phase_pad_size * w), round(s.phase_pad_size * h)
    mode = "symmetric" if s.phase_pad_type == "Mirror" else "edge"
    scale = (s.propagation_distance + s.source_to_ra) / s.source_to_ra
    fx, fy = np.arange(w + 2 * px), np.arange(h + 2 * py)
    square = np.minimum(fx, w + 2 * px - fx)[:, None] ** 2 + np.minimum(fy, h + 2 * py - fy)[None, :] ** 2
    passed = 1 / (1 + 4 * math.pi**2 * s.propagation_distance * s.delta / s.mu * square / scale)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((w, h))
        a[pdf["x"], pdf["y"]] = pdf["v"]
        out = np.fft.ifft2(np.fft.fft2(np.pad(a, ((px, px), (py, py)), mode=mode) * scale**2) * passed).real[px : px + w, py : py + h]
        x, y = np.indices((w, h)).reshape(2, -1)
        return pd.DataFrame({"x": x, "y": y, "z": pdf["z"].iloc[0], "v": -np.log(out.ravel())})

    return im.with_rows(im.df.groupBy("z").applyInPandas(run, "x bigint, y bigint, z bigint, v double"))


def without_rings(im: Image, size: int) -> Image:
    """Each detector pixel times what its mean over all projections lacks to the median of the means around it, within -0.5 and 1.5."""
    mean = statistics.project("meanproject", im)
    median = neighbourhood.rank_filter("medianfilter", mean, (size, size, 0), "Rectangular")
    gain = pointwise.ensure_finite(pointwise.clamp(pointwise.with_image("divide", median, mean), -0.5, 1.5), 1.0)
    return pointwise.with_image("multiply", im, gain, True)


def scan_weight(beta: np.ndarray, gamma: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of rays at gamma from the optical axis in a projection at beta, where half a turn and a cone of most to each side are used.

    Opposite rays' weights add up to 1: a rising square sine, a flat part and a falling one; beta counts modulo a turn.
    """
    square = lambda t: np.sin(np.radians(45 * t)) ** 2
    rises = lambda b: (-most <= b) & (b <= most - 2 * gamma)
    flat = lambda b: (most - 2 * gamma <= b) & (b <= 180 - most - 2 * gamma)
    falls = lambda b: (180 - most - 2 * gamma <= b) & (b <= 180 + most)
    with np.errstate(divide="ignore", invalid="ignore"):
        up = [square((b + most) / (most - gamma)) for b in (beta, beta - 360)]
        down = [square((180 + most - b) / (most + gamma)) for b in (beta, beta + 360)]
    level = flat(beta) | flat(beta + 360) | flat(beta - 360)
    return np.select([rises(beta), rises(beta - 360), level, falls(beta), falls(beta + 360)], [*up, 1.0, *down], 0.0)


def line_weights(s: Settings, dims: tuple[int, int, int], projection: int, rows: np.ndarray) -> np.ndarray:
    """Weights (rows x width) of a projection's pixels: the ray's obliqueness, and the share of its projection in the scan."""
    width, height, _ = dims
    angle, middle, cone = s.angles[projection], s.middle_angle(width), s.half_cone(width)
    up = (rows - height / 2 - s.camera_z_shift)[:, None]
    across = (np.arange(width) - width / 2 - (s.center_shift + (angle - middle) * s.cs_angle_slope))[None, :]
    oblique = s.source_to_ra / np.sqrt(s.source_to_ra**2 + across**2 + up**2)
    if not s.rec_as_180_deg_scan:
        step = s.angles[1] - s.angles[0] if len(s.angles) > 1 else 0.0
        return oblique * (0.0 if abs(angle - s.angles[0]) - (360 - step) > 0.1 * abs(step) else 1.0)
    far = np.abs(up / (0.5 * height))
    most = (1 - far) * cone + far * s.hswp * cone
    gamma = np.degrees(np.arctan2(across, s.source_to_ra))
    return oblique * scan_weight(angle - (middle - 90), gamma + 0 * up, most + 0 * across)


def filtered_lines(im: Image, s: Settings) -> DataFrame:
    """angle, row, line of every detector line of -log projections: hardening corrected, weighted and filtered."""
    width, dims = im.dims[0], im.dims
    pad = max(LEAST_PADDING, round(min(max(s.pad_size, 0.0), 1.0) * width))
    group = max(1, PIXELS // (width + 2 * pad))
    response = projection_filter((width + 2 * pad) // 2 + 1, s.filter_type, s.filter_cut_off)
    mode = "symmetric" if s.pad_type == "Mirror" else "edge"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        projection, first = int(pdf["z"].iloc[0]), int(pdf["y"].min())
        rows = np.arange(first, int(pdf["y"].max()) + 1)
        lines = np.zeros((len(rows), width))
        lines[pdf["y"] - first, pdf["x"]] = pdf["v"]
        if s.bhc:
            lines = lines + s.bhc * lines * lines
            lines[~np.isfinite(lines)] = 0
        lines = np.pad(lines * line_weights(s, dims, projection, rows), ((0, 0), (pad, pad)), mode=mode)
        out = np.fft.irfft(np.fft.rfft(lines, axis=1) * response, lines.shape[1], axis=1)[:, pad : pad + width]
        return pd.DataFrame({"angle": projection, "row": rows, "line": list(out)})

    return im.df.groupBy("z", F.floor(F.col("y") / group).alias("_rows")).applyInPandas(run, "angle bigint, row bigint, line array<double>")


def preprocess(projections: Image, s: Settings) -> Image:
    """Transmission projections as back_project takes them: -log or phase, corrected, weighted and filtered, of the size after cropping and binning."""
    checked(projections, s)
    im, small = transmissions(projections, s), s.binned()
    if s.ring_algorithm != "None":
        im = without_rings(im, s.ring_kernel_size)
    lines = filtered_lines(im, small).select(F.posexplode("line").alias("x", "v"), F.col("row").alias("y"), F.col("angle").alias("z"))
    return im.with_rows(lines)


def _turned(v: np.ndarray, axis: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Rows of v turned about rows of axis (unit vectors) by angle in radians."""
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    return v * c + np.cross(axis, v) * s + axis * (axis * v).sum(1, keepdims=True) * (1 - c)


@dataclass(frozen=True)
class Geometry:
    """For each projection where the source and the detector's middle are, the detector's right and up over the magnification, and its normal."""

    source: np.ndarray
    detector: np.ndarray
    right: np.ndarray
    up: np.ndarray
    normal: np.ndarray

    def seen(self, i: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where rays through points p meet projection i's detector, in pixels from its middle, and how far towards it p lie from the source."""
        ray = p - self.source[i]
        depth = ray @ self.normal[i]
        offset = self.source[i] - self.detector[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = offset + (-(offset @ self.normal[i]) / np.where(depth == 0, np.nan, depth))[:, None] * ray
            return hit @ self.right[i], hit @ self.up[i], depth


def geometry(s: Settings, width: int) -> Geometry:
    n = len(s.angles)
    filled = lambda rows: np.array(rows or np.zeros((n, 3)), float).reshape(n, 3) * (s.shift_scale if s.use_shifts else 0.0)
    unit = lambda *v: np.tile(np.array(v, float), (n, 1))
    angles = np.array(s.angles, float)
    span = angles.max() - angles.min()
    sign = -1.0 if s.rotation_direction == "Counterclockwise" else 1.0
    turn = np.radians(sign * (1 + (s.angle_tweak / span if span else 0.0)) * angles + s.rotation)
    tilt = np.full(n, math.radians(s.rotation_axis_tilt))
    magnification = 1 + s.propagation_distance / s.source_to_ra
    a, b = math.radians(s.ra_h_shift_tilt), math.radians(s.ra_v_shift_tilt)
    axis = filled(s.rotation_axis_shifts)
    axis = np.stack([axis[:, 0], axis[:, 1] * math.cos(a) - axis[:, 2] * math.sin(b), axis[:, 1] * math.sin(a) + axis[:, 2] * math.cos(b)], axis=1)
    tilted_about = _turned(unit(0, 1, 0), unit(0, 0, 1), turn)
    place = lambda v: _turned(_turned(v, unit(0, 0, 1), turn), tilted_about, tilt)
    right, up = place(unit(0, 1, 0)), place(unit(0, 0, 1))
    normal = np.cross(right, up)
    sample = filled(s.sample_shifts)
    source = place(unit(-s.source_to_ra, 0, 0) - axis + filled(s.source_shifts)) - sample
    detector = place(unit(s.propagation_distance, 0, 0) - axis + filled(s.camera_shifts)) - sample
    slope = (angles - s.middle_angle(width)) * s.cs_angle_slope
    detector = detector - unit(0, 0, s.camera_z_shift * magnification) - right * ((s.center_shift + slope) * magnification)[:, None]
    camera = np.full(n, math.radians(s.camera_rotation))
    return Geometry(source, detector, _turned(right, normal, camera) / magnification, _turned(up, normal, camera) / magnification, normal)


def mean_factor(s: Settings) -> float:
    """What sums over projections are multiplied by."""
    count = len(s.angles)
    if s.rec_as_180_deg_scan:
        count *= 180 / (max(s.angles) - min(s.angles))
    return math.pi / 2 / count


@dataclass(frozen=True)
class Grid:
    """Blocks of the volume; block numbers count along x, then y, then z. Voxel centres lie about the crossing of the axes."""

    dims: tuple[int, int, int]
    center: Vector
    block: tuple[int, int, int]

    @property
    def shape(self) -> list[int]:
        return [-(-d // b) for d, b in zip(self.dims, self.block, strict=True)]

    def ranges(self, number: int) -> list[range]:
        nx, ny, _ = self.shape
        at = (number % nx, number // nx % ny, number // nx // ny)
        return [range(i * b, min((i + 1) * b, d)) for i, b, d in zip(at, self.block, self.dims, strict=True)]

    def points(self, index: np.ndarray) -> np.ndarray:
        return index - np.array(self.dims) / 2 + np.array(self.center, float) + 0.5

    def voxels(self, number: int) -> np.ndarray:
        """Indices (n x 3) of a block's voxels."""
        return np.stack(np.meshgrid(*self.ranges(number), indexing="ij"), axis=-1).reshape(-1, 3)

    def corners(self, numbers: Iterable[int] | None = None) -> np.ndarray:
        """Points of the 8 outermost voxels of blocks, every one without numbers (blocks x 8 x 3)."""
        ends = [[(r[0], r[-1]) for r in self.ranges(int(n))] for n in (range(math.prod(self.shape)) if numbers is None else numbers)]
        return self.points(np.array([[[x, y, z] for x in e[0] for y in e[1] for z in e[2]] for e in ends]))


def footprints(g: Geometry, i: int, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """First and last column and row (blocks x 4) of projection i that a block's voxels may read; last before first where none is.

    Points between the corners of a block in front of the source are seen between theirs; a block beside the source may read all.
    """
    u, v, depth = (a.reshape(corners.shape[:2]) for a in g.seen(i, corners.reshape(-1, 3)))
    whole = (depth.min(1) <= 1e-9 * max(1.0, abs(depth).max())) & (depth.max(1) >= 0)
    low = lambda a, half: np.where(whole, 0, np.floor(np.nan_to_num(a.min(1)) + half))
    high = lambda a, half, n: np.where(whole, n - 1, np.floor(np.nan_to_num(a.max(1)) + half) + 1)
    box = np.stack([low(u, width / 2), high(u, width / 2, width), low(v, height / 2), high(v, height / 2, height)], axis=1)
    return np.clip(box, [0, -1, 0, -1], [width, width - 1, height, height - 1]).astype(int)


def fitted_block(g: Geometry, dims: tuple[int, int, int], center: Vector, width: int, height: int) -> tuple[int, int, int]:
    """The shape of blocks, of at most as many voxels as BLOCK has, that together see the fewest pixels, judged by a few blocks and projections.

    Far from the middle along z rays are oblique, so that a flat block sees rows in proportion to its distance and not to its voxels.
    """
    most, shapes = math.prod(BLOCK), {}
    for edge in (BLOCK[0] >> i for i in range(BLOCK[0].bit_length())):
        x, y = min(edge, dims[0]), min(edge, dims[1])
        shape = (x, y, min(dims[2], most // (x * y)))
        grid = Grid(dims, center, shape)
        count = math.prod(grid.shape)
        numbers = np.unique(np.linspace(0, count - 1, min(count, JUDGED)).astype(int))
        corners = grid.corners(numbers)
        boxes = np.concatenate([footprints(g, int(i), corners, width, height) for i in np.unique(np.linspace(0, len(g.source) - 1, 8).astype(int))])
        columns, rows = (np.maximum(boxes[:, i + 1] - boxes[:, i] + 1, 0) for i in (0, 2))
        shapes.setdefault(shape, ((columns + PIECE) * rows).sum() * count / len(numbers))
    return min(shapes, key=shapes.get)


def back_project(projections: Image, s: Settings, block: tuple[int, int, int] | None = None) -> Image:
    """The volume of preprocessed projections, whose settings are s (of the scan before binning), by blocks of a shape or, without it, of the fitting one."""
    s = s.binned()
    checked(projections, s)
    width, height, count = projections.dims
    dims = tuple(int(c) if c > 0 else n for c, n in zip(s.roi_size, (width, width, height), strict=True))
    g, factor = geometry(s, width), mean_factor(s)
    grid = Grid(dims, s.roi_center, block or fitted_block(g, dims, s.roi_center, width, height))
    blocks = math.prod(grid.shape)
    share = -(-count // min(PARTS, count, -(-FEW_BLOCKS // blocks)))
    lines = projections.df.groupBy(F.col("z").alias("angle"), F.col("y").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"]).alias("line"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corners, known = grid.corners(), {}
        for batch in batches:
            angles, rows = (batch.column(i).to_numpy() for i in range(2))
            offsets, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            order = np.lexsort((rows, angles))
            for mine in np.split(order, np.flatnonzero(np.diff(angles[order])) + 1) if len(order) else []:
                angle = int(angles[mine[0]])
                if angle not in known:
                    if len(known) > 64:
                        known.clear()
                    known[angle] = footprints(g, angle, corners, width, height)
                box = known[angle]
                low, high = np.searchsorted(rows[mine], box[:, 2]), np.searchsorted(rows[mine], box[:, 3], "right")
                seen = np.where(box[:, 0] <= box[:, 1], np.maximum(high - low, 0), 0)
                number = np.repeat(np.arange(blocks), seen)
                line = mine[np.arange(len(number)) - np.repeat(np.cumsum(seen) - seen - low, seen)]
                most = max(1, VALUES // width)
                for at in range(0, len(number), most):
                    n, i = number[at : at + most], line[at : at + most]
                    size = box[n, 1] - box[n, 0] + 1
                    ends = np.r_[0, np.cumsum(size)]
                    piece = values[np.arange(ends[-1]) + np.repeat(offsets[i] + box[n, 0] - ends[:-1], size)]
                    columns = [pa.array(c, pa.int64()) for c in (n, np.full(len(n), angle // share), np.full(len(n), angle), rows[i], box[n, 0])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(piece))], names=["block", "part", "angle", "row", "start", "piece"])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in zip(*(pdf[c] for c in ("block", "part", "angle", "row", "start", "piece")), strict=True))
        for (number, part), mine in groupby(rows, key=lambda r: r[:2]):
            p = grid.points(grid.voxels(number))
            total = np.zeros(len(p))
            for angle, pieces in groupby(mine, key=lambda r: r[2]):
                if angle < 0:
                    continue
                pieces = list(pieces)
                first, start = pieces[0][3], pieces[0][4]
                patch = np.zeros((pieces[-1][3] - first + 3, len(pieces[0][5]) + 2))  # zeros all around
                for _, _, _, row, _, values in pieces:
                    patch[row - first + 1, 1:-1] = values
                u, v, depth = g.seen(angle, p)
                u, v = u + width / 2 - start + 1, v + height / 2 - first + 1
                near = np.isfinite(u) & np.isfinite(v) & (u >= 0) & (v >= 0) & (u < patch.shape[1] - 1) & (v < patch.shape[0] - 1)
                u, v = u[near], v[near]
                i, j = u.astype(int), v.astype(int)
                t, r = u - i, v - j
                read = (patch[j, i] * (1 - t) + patch[j, i + 1] * t) * (1 - r) + (patch[j + 1, i] * (1 - t) + patch[j + 1, i + 1] * t) * r
                total[near] += read * (s.source_to_ra / (s.source_to_ra + p[near] @ g.normal[angle])) ** 2
            yield pd.DataFrame({"block": [number], "part": [part], "total": [total]})

    def volume(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, z = grid.voxels(int(pdf["block"].iloc[0])).T
        total = np.sum(pdf.sort_values("part")["total"].to_list(), axis=0) * factor
        return pd.DataFrame({"x": x, "y": y, "z": z, "v": (total - s.range_min) / (s.range_max - s.range_min)})

    pieces = lines.mapInArrow(route, "block bigint, part bigint, angle bigint, row bigint, start bigint, piece array<double>")
    named = projections.df.sparkSession.range(blocks).selectExpr("id AS block", "0L AS part", "-1L AS angle", "0L AS row", "0L AS start", "cast(array() AS array<double>) AS piece")
    ordered = pieces.union(named).repartition("block", "part").sortWithinPartitions("block", "part", "angle", "row")
    found = ordered.mapInPandas(sums, "block bigint, part bigint, total array<double>").groupBy("block").applyInPandas(volume, "x bigint, y bigint, z bigint, v double")
    return Image(found, dims, "float32")


def project_volume(image: Image, angles: tuple[float, ...], width: int) -> Image:
    """Sums of the volume along parallel rays across z, at angles about its middle: x along the detector, y up it, z counts angles.

    A pixel's value goes to the two detector pixels beside its place.
    """
    w, h, depth = image.dims
    turns = F.array(*[F.struct(F.lit(i).cast("bigint").alias("a"), F.lit(math.cos(math.radians(t))).alias("c"), F.lit(math.sin(math.radians(t))).alias("s")) for i, t in enumerate(angles)])
    each = image.df.select("z", "v", "x", "y", F.explode(turns).alias("t"))
    place = F.round((F.col("y") - (h - 1) / 2) * F.col("t.c") - (F.col("x") - (w - 1) / 2) * F.col("t.s") + width / 2, 9)
    at = each.select(F.col("t.a").alias("a"), "z", "v", place.alias("p")).select("a", "z", "v", F.floor("p").alias("u"), (F.col("p") - F.floor("p")).alias("f"))
    both = F.array(F.struct(F.col("u").alias("u"), (1 - F.col("f")).alias("w")), F.struct((F.col("u") + 1).alias("u"), F.col("f").alias("w")))
    shared = at.select("a", "z", "v", F.explode(both).alias("q")).select(F.col("q.u").alias("x"), F.col("z").alias("y"), F.col("a").alias("z"), (F.col("v") * F.col("q.w")).alias("v"))
    summed = shared.filter((F.col("x") >= 0) & (F.col("x") < width)).groupBy(*AXES).agg(F.sum("v").alias("s"))
    every = new_image(image.df.sparkSession, (width, depth, len(angles)), "float32").df
    return Image(every.join(summed, list(AXES), "left").select(*AXES, F.coalesce("s", "v").alias("v")), (width, depth, len(angles)), "float32")
