"""Filtered back-projection against whole-array versions and known bodies."""

import math

import numpy as np
import pytest
from test_raster import array_of, image_of

from voxara.operators import reconstruction, tomography
from voxara.operators.reconstruction import Settings
from voxara.plans.script import Session


def turn(v, axis, angle):
    """Rodrigues' formula for one vector."""
    axis = np.array(axis, float)
    return v * math.cos(angle) + np.cross(axis, v) * math.sin(angle) + axis * (axis @ v) * (1 - math.cos(angle))


def brute_volume(a, s, dims):
    """Each voxel's sum over projections, one after the other; no shifts but sample, source, camera and axis ones."""
    w, h, n = a.shape
    m = 1 + s.propagation_distance / s.source_to_ra
    out = np.zeros(dims)
    sign = -1 if s.rotation_direction == "Counterclockwise" else 1
    span = max(s.angles) - min(s.angles)
    for i, angle in enumerate(s.angles):
        t = math.radians(sign * (1 + s.angle_tweak / span) * angle + s.rotation)
        tilt = math.radians(s.rotation_axis_tilt)
        rows = {name: np.array(getattr(s, name)[i] if getattr(s, name) else (0, 0, 0), float) * s.shift_scale * s.use_shifts for name in ("sample_shifts", "source_shifts", "camera_shifts", "rotation_axis_shifts")}
        alpha, beta = math.radians(s.ra_h_shift_tilt), math.radians(s.ra_v_shift_tilt)
        x, y, z = rows["rotation_axis_shifts"]
        moved = np.array([x, y * math.cos(alpha) - z * math.sin(beta), y * math.sin(alpha) + z * math.cos(beta)])
        tilt_axis = turn(np.array([0.0, 1, 0]), (0, 0, 1), t)
        place = lambda v: turn(turn(np.array(v, float), (0, 0, 1), t), tilt_axis, tilt)  # noqa: B023, E731
        source = place(np.array([-s.source_to_ra, 0, 0]) - moved + rows["source_shifts"]) - rows["sample_shifts"]
        detector = place(np.array([s.propagation_distance, 0, 0]) - moved + rows["camera_shifts"]) - rows["sample_shifts"]
        right, up = place((0, 1, 0)), place((0, 0, 1))
        normal = np.cross(right, up)
        room = 90 + math.degrees(math.atan2(w / 2, s.source_to_ra))
        middle = min(max(s.central_angle, min(s.angles) + room), max(s.angles) - room)
        detector = detector + np.array([0, 0, -s.camera_z_shift * m]) - right * (s.center_shift + (angle - middle) * s.cs_angle_slope) * m
        c = math.radians(s.camera_rotation)
        right, up = turn(right, normal, c), turn(up, normal, c)
        for at in np.ndindex(*dims):
            p = np.array(at) - np.array(dims) / 2 + np.array(s.roi_center) + 0.5
            ray = p - source
            if abs(ray @ normal) < 1e-12:
                continue
            hit = source + ray * ((detector - source) @ normal) / (ray @ normal) - detector
            u, v = hit @ right / m + w / 2, hit @ up / m + h / 2
            iu, iv = math.floor(u), math.floor(v)
            value = sum(a[iu + du, iv + dv, i] * (1 - abs(u - iu - du)) * (1 - abs(v - iv - dv)) for du in (0, 1) for dv in (0, 1) if 0 <= iu + du < w and 0 <= iv + dv < h)
            out[at] += value * (s.source_to_ra / (s.source_to_ra + p @ normal)) ** 2
    count = len(s.angles) * (180 / span if s.rec_as_180_deg_scan else 1)
    return (out * math.pi / 2 / count - s.range_min) / (s.range_max - s.range_min)


SHIFTS = tuple((0.3 * i, -0.2 * i, 0.1 * i) for i in range(5))
SCANS = {
    "plain": Settings(source_to_ra=40.0, propagation_distance=10.0, angles=(0, 50, 100, 150, 200)),
    "full turn": Settings(source_to_ra=30.0, propagation_distance=0.0, rec_as_180_deg_scan=False, rotation_direction="Counterclockwise", rotation=20.0, angles=(0, 72, 144, 216, 288), roi_size=(5, 6, 4), roi_center=(1, -1, 0), range_min=0.5, range_max=3.0),
    "misplaced": Settings(source_to_ra=25.0, propagation_distance=12.0, center_shift=0.7, camera_z_shift=-0.4, camera_rotation=6.0, rotation_axis_tilt=4.0, cs_angle_slope=0.01, angle_tweak=3.0, angles=(0, 50, 100, 150, 200), sample_shifts=SHIFTS, source_shifts=SHIFTS[::-1], camera_shifts=SHIFTS, rotation_axis_shifts=SHIFTS, ra_h_shift_tilt=5.0, ra_v_shift_tilt=-3.0, shift_scale=0.5),
    "source within": Settings(source_to_ra=3.0, propagation_distance=9.0, angles=(0, 50, 100, 150, 200)),
}


@pytest.mark.parametrize("name", SCANS)
@pytest.mark.parametrize("block", [(3, 4, 2), (64, 64, 64)])
def test_back_projection_equals_sums_over_voxels(spark, name, block):
    s = SCANS[name]
    a = np.random.default_rng(3).normal(size=(7, 5, 5))
    dims = tuple(c or n for c, n in zip(s.roi_size, (7, 7, 5), strict=True))
    got = array_of(reconstruction.back_project(image_of(spark, a), s, block))
    want = brute_volume(a, s, dims)
    near = np.isfinite(want) & (abs(want) < 1e6)
    assert np.allclose(got[near], want[near], atol=1e-9)


def brute_lines(a, s):
    """Corrected, weighted and filtered projections as circular convolutions."""
    w, h, n = a.shape
    pad = max(10, round(s.pad_size * w))
    size = w + 2 * pad
    response = tomography.projection_filter(size // 2 + 1, s.filter_type, s.filter_cut_off)
    full = np.array([response[min(k, size - k)] for k in range(size)])
    taps = np.fft.ifft(full).real
    mode = "symmetric" if s.pad_type == "Mirror" else "edge"
    out = np.zeros_like(a)
    for i in range(n):
        weights = reconstruction.line_weights(s, a.shape, i, np.arange(h))
        for y in range(h):
            line = np.pad((a[:, y, i] + s.bhc * a[:, y, i] ** 2) * weights[y], pad, mode=mode)
            out[:, y, i] = [sum(line[k] * taps[(x + pad - k) % size] for k in range(size)) for x in range(w)]
    return out


@pytest.mark.parametrize("more", [{}, {"bhc": 0.2, "pad_type": "Nearest", "filter_type": "Hann", "filter_cut_off": 0.7, "hswp": 2.0}, {"rec_as_180_deg_scan": False, "pad_size": 1.0}])
def test_preprocessing_equals_whole_lines(spark, more):
    s = Settings(source_to_ra=30.0, propagation_distance=5.0, angles=tuple(range(0, 220, 20)), center_shift=0.5, **more)
    a = np.random.default_rng(4).uniform(0.01, 1.2, (6, 20, 11))
    got = array_of(reconstruction.preprocess(image_of(spark, a), s))
    assert np.allclose(got, brute_lines(-np.log(np.clip(a, 1e-5, 1 - 1e-5)), s), atol=1e-9)


def test_binning_cropping_smoothing_and_direct_mode(spark):
    a = np.random.default_rng(5).uniform(0, 2, (10, 8, 12))
    s = Settings(source_to_ra=60.0, propagation_distance=8.0, angles=tuple(range(0, 240, 20)), crop_size=(1, 2), binning=2, angular_binning=2, phase_mode="Direct", pre_smoothing="Median")
    small = a[1:9, 2:6].reshape(4, 2, 2, 2, 6, 2).mean((1, 3, 5))
    padded = np.pad(small, ((1, 1), (1, 1), (0, 0)), mode="edge")
    cross = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    smooth = np.median([padded[1 + i : 5 + i, 1 + j : 3 + j] for i, j in cross], axis=0)
    b = s.binned()
    assert b.source_to_ra == 30 and b.angles == tuple(range(10, 240, 40)) and b.binning == 1
    assert np.allclose(array_of(reconstruction.preprocess(image_of(spark, a), s)), brute_lines(smooth, b), atol=1e-9)


@pytest.mark.parametrize("gamma", [-5.0, -1.0, 0.0, 3.0])
def test_opposite_rays_share_their_weight(gamma):
    beta = np.linspace(-6, 6 - 2 * gamma, 20)[1:-1]
    weight = lambda b, g: reconstruction.scan_weight(b, np.full_like(b, g), np.full_like(b, 6.0))
    assert np.allclose(weight(beta, gamma) + weight(beta + 180 + 2 * gamma, -gamma), 1, atol=1e-9)
    assert np.all(weight(np.linspace(6 - 2 * gamma, 174 - 2 * gamma, 9), gamma) == 1)
    assert np.all(weight(np.array([-7.0, 187.0, 250.0]), gamma) == 0)


def disc(size, radius, value):
    at = np.indices((size, size)) - (size - 1) / 2
    return np.where((at**2).sum(0) < radius**2, value, 0.0)


def test_a_disc_comes_back(spark):
    a = np.repeat(disc(16, 5, 0.05)[:, :, None], 3, axis=2)
    angles = tuple(np.arange(0, 360, 6.0))
    sums = reconstruction.project_volume(image_of(spark, a), angles, 24)
    s = Settings(source_to_ra=1000.0, propagation_distance=0.0, rec_as_180_deg_scan=False, angles=angles, roi_size=(16, 16, 3))
    waves = sums.with_rows(sums.df.selectExpr("x", "y", "z", "exp(-v) AS v"))
    got = array_of(reconstruction.back_project(reconstruction.preprocess(waves, s), s, (8, 8, 8)))[:, :, 1]
    assert abs(got[6:10, 6:10].mean() - 0.05) < 0.004
    assert abs(got[disc(16, 7.5, 1) == 0].mean()) < 0.004


def test_flat_field(spark):
    raw = np.array([[[30.0, 60.0]], [[20.0, 10.0]]])
    flats, darks = np.array([[[100.0, 120.0]], [[10.0, 10.0]]]), np.array([[[10.0]], [[10.0]]])
    got = array_of(reconstruction.flat_field(image_of(spark, raw), image_of(spark, flats), image_of(spark, darks)))
    assert np.allclose(got[0], [[0.2, 0.5]]) and np.isnan(got[1]).all()


def test_paganin_without_a_filter_is_a_logarithm(spark):
    a = np.random.default_rng(6).uniform(0.2, 0.9, (6, 4, 2))
    s = Settings(source_to_ra=1e12, propagation_distance=1.0, delta=0.0, phase_mode="Paganin", angles=(0.0, 1.0))
    assert np.allclose(array_of(reconstruction.transmissions(image_of(spark, a), s)), -np.log(a), atol=1e-8)
    blurred = array_of(reconstruction.transmissions(image_of(spark, a), Settings(source_to_ra=1e12, propagation_distance=1.0, delta=1.0, mu=0.1, phase_mode="Paganin", angles=(0.0, 1.0))))
    assert blurred.std() < 0.2 * np.log(a).std()


def test_rings_are_evened_out(spark):
    a = np.full((7, 5, 4), 2.0)
    a[3] *= 1.4
    got = array_of(reconstruction.without_rings(image_of(spark, a), 1))
    assert np.allclose(got, 2.0)


def test_settings_travel_as_metadata():
    s = SCANS["misplaced"]
    assert Settings.from_meta(s.to_meta()) == s
    assert Settings.from_meta({"other": [["1"]]}) == Settings()


def test_settings_must_suit(spark):
    a = image_of(spark, np.ones((2, 2, 2)))
    for s in (Settings(angles=(0, 90)), Settings(source_to_ra=5, angles=(0,)), Settings(source_to_ra=5, angles=(0, 90), pad_type="None"), Settings(source_to_ra=5, angles=(0, 90), camera_shifts=((0, 0, 0),))):
        with pytest.raises(ValueError):
            reconstruction.preprocess(a, s)


def test_commands(spark):
    s = SCANS["plain"]
    a = np.random.default_rng(7).uniform(0.1, 0.9, (7, 5, 5))
    session = Session(spark)
    session.images["p"] = image_of(spark, a)
    session.run("defaultrecsettings(p)")
    assert session.meta["p"]["filter_type"] == [["Ramp"]]
    session.meta["p"] = s.to_meta()
    session.run("fbppreprocess(p, q)\nfbp(q, r, false)")
    want = reconstruction.back_project(reconstruction.preprocess(image_of(spark, a), s), s)
    assert np.allclose(array_of(session.images["r"]), array_of(want))


def test_blocks_see_rows_in_proportion_to_a_long_volume():
    """The pixels that blocks of a volume along z see grow no faster than its voxels, though the cone's rays are oblique there."""
    s = Settings(source_to_ra=200.0, propagation_distance=50.0, angles=tuple(30.0 * i for i in range(12)), center_shift=0.5)
    g, each = reconstruction.geometry(s, 14), []
    for depth in (50_000, 600_000, 4_000_000):
        dims = (8, 8, depth)
        shape = reconstruction.fitted_block(g, dims, s.roi_center, 14, depth)
        grid = reconstruction.Grid(dims, s.roi_center, shape)
        assert math.prod(shape) <= math.prod(reconstruction.BLOCK)
        box = reconstruction.footprints(g, 1, grid.corners(), 14, depth)
        each.append(((box[:, 1] - box[:, 0] + 1) * (box[:, 3] - box[:, 2] + 1)).sum() / depth)
    assert max(each) < 100, each
    assert min(reconstruction.fitted_block(g, (512, 512, 512), s.roi_center, 512, 512)) >= 16


def test_lines_are_filtered_and_cut_in_bounded_groups(spark, monkeypatch):
    """A group of lines is bounded by its pixels, and few pieces leave a task at once; the volume is the same for all bounds."""
    w, h, n = 9, 40, 6
    s = Settings(source_to_ra=30.0, propagation_distance=10.0, rec_as_180_deg_scan=False, angles=tuple(60.0 * i for i in range(n)), roi_size=(6, 6, 40))
    im = image_of(spark, np.random.default_rng(3).uniform(0.2, 0.9, (w, h, n)), "float32")
    found = []
    for pixels, values in ((reconstruction.PIXELS, reconstruction.VALUES), (1, 1), (200, 50)):
        monkeypatch.setattr(reconstruction, "PIXELS", pixels)
        monkeypatch.setattr(reconstruction, "VALUES", values)
        lines = reconstruction.preprocess(im, s)
        assert np.allclose(array_of(lines), found[0][0] if found else array_of(lines))
        found += [(array_of(lines), array_of(reconstruction.back_project(lines, s, block))) for block in (None, (4, 3, 5))]
    assert all(np.allclose(a, found[0][1]) for _, a in found)
