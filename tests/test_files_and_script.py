"""File formats' round trips and the command language."""

import numpy as np
import pytest
from test_raster import array_of, image_of

from voxara.plans import script
from voxara.raster import Image
from voxara.sources import files, raw


def test_nrrd_round_trip(spark, tmp_path):
    a = np.arange(24.0).reshape(4, 3, 2) * 1000
    path = str(tmp_path / "a.nrrd")
    files.write_nrrd(image_of(spark, a, "uint16"), path)
    back = files.read_image(spark, path)
    assert back.dtype == "uint16" and (array_of(back) == a).all()


@pytest.mark.parametrize("dtype", ["uint8", "uint16"])
def test_png_sequence_round_trip(spark, tmp_path, dtype):
    a = np.random.default_rng(1).integers(0, 256 if dtype == "uint8" else 65536, (5, 4, 11)).astype(float)
    assert files.write_sequence(image_of(spark, a, dtype), str(tmp_path)).count() == 11
    back = files.read_image(spark, f"{tmp_path}/*.png")
    assert back.dtype == dtype and (array_of(back) == a).all()


@pytest.mark.parametrize("bits", [8, 16])
def test_png_line_filters(bits):
    import struct
    import zlib

    a = np.random.default_rng(2).integers(0, 2**bits, (5, 6)).astype(np.uint8 if bits == 8 else np.uint16)
    plain = [r.astype(">u2" if bits == 16 else "u1").tobytes() for r in a]
    step, rows, above = bits // 8, b"", bytes(len(plain[0]))
    for kind, line in enumerate(plain):
        rows += bytes([kind])
        for i, c in enumerate(line):
            left, up, corner = (line[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
            p = left + up - corner
            near = left if abs(p - left) <= min(abs(p - up), abs(p - corner)) else up if abs(p - up) <= abs(p - corner) else corner
            rows += bytes([(c - [0, left, up, (left + up) // 2, near][kind]) % 256])
        above = line
    data = files.encode_png(a)
    size = struct.unpack(">I", data[33:37])[0]
    packed = zlib.compress(rows)
    assert (files.decode_png(data[:33] + struct.pack(">I", len(packed)) + b"IDAT" + packed + b"\0\0\0\0" + data[45 + size :]) == a).all()


def test_png_needs_one_slice(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write_png(image_of(spark, np.zeros((2, 2, 2)), "uint8"), str(tmp_path / "a.png"))


def test_parse():
    assert script.parse('eval("x0 + 1, #", img, [1, 2.5, 3], true) # note') == ("eval", ["x0 + 1, #", "img", (1, 2.5, 3), True])
    assert script.parse("  # nothing") is None and script.parse("clear()") == ("clear", [])
    for bad in ("add(a,", "add(a,,b)", "no command"):
        with pytest.raises(ValueError):
            script.parse(bad)


def test_script(spark, tmp_path):
    s = script.Session(spark).run(f"""
        newimage(a, uint8, 6, 5, 2)
        ramp(a, 0)
        add(a, 3)      # a number
        copy(a, b)
        add(a, b)
        crop(a, c, [1, 0, 0], [2, 5, 1])
        sum(c, total)
        writenrrd(a, "{tmp_path}/a.nrrd")
        read(d, "{tmp_path}/a.nrrd")
    """)
    assert s.tables["total"].first().v == 5 * (8 + 10)
    assert (array_of(s.image("d"))[:, 0, 0] == [6, 8, 10, 12, 14, 16]).all()
    for bad in ("frobnicate(a)", "add(nothing, 1)"):
        with pytest.raises(ValueError):
            s.run(bad)


def test_tasks_write_lines_to_their_places(spark, tmp_path):
    a = np.random.default_rng(12).integers(0, 60000, (5, 4, 6)).astype(float)
    im = image_of(spark, a, "uint16")
    raw.put_lines(im, f"file://{tmp_path}/x", 7 + 2 * a.size, 7)
    raw.put_lines(im, f"{tmp_path}/x", 7 + 2 * a.size, 7)  # again, as after a lost executor
    data = (tmp_path / "x").read_bytes()
    assert data[:7] == bytes(7) and np.array_equal(np.frombuffer(data[7:], "<u2").reshape(6, 4, 5).T, a)
    raw.put_lines(im, f"{tmp_path}/b", 2 * 9 * 8 * 7, 2 * ((1 * 8 + 2) * 9 + 3), 2 * 9, 2 * 9 * 8)
    box = np.frombuffer((tmp_path / "b").read_bytes(), "<u2").reshape(7, 8, 9).T
    assert np.array_equal(box[3:8, 2:6, 1:7], a) and box.sum() == a.sum()
    with pytest.raises(ValueError):
        raw.put_lines(Image(im.df.filter("z < 3"), im.dims, im.dtype), f"{tmp_path}/y", 2 * a.size)
