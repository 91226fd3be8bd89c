import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuweave.operators import images
from skuweave.operators.pages import Pages
from skuweave.shared import new_path


def test_pages_equal_slices(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, "a", "b", "c", "é"])) for i in range(237)]
    df = spark.createDataFrame(rows, "id long, name string")
    store = Pages(spark, new_path(spark, "pages"))
    store.write(df, F.desc("name"), F.col("id"), ranges=7)
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, [-ord(x) for x in r[1] or ""], r[0]))]
    for number, limit in ((1, 10), (3, 50), (24, 10), (25, 10), (1, 500), (2, 1)):
        got = store.page(number, limit).collect()
        assert [r.id for r in got] == want[(number - 1) * limit : number * limit] and all(r.total == 237 and r.total_pages == -(-237 // limit) for r in got)
    assert [r.id for r in store.after(33, 40).collect()] == want[33:73] and store.after(237, 5).count() == 0
    plan = store.page(2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "(_range#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    with pytest.raises(ValueError):
        store.page(0, 5)
    empty = Pages(spark, new_path(spark, "pages"))
    empty.write(df.limit(0).unionByName(df.filter("id = 1")), F.col("id"))
    assert empty.page(1, 5).count() == 1 and empty.page(2, 5).count() == 0


def webp(kind, width, height):
    if kind == b"VP8 ":
        body = b"\x10\x00\x00\x9d\x01\x2a" + width.to_bytes(2, "little") + height.to_bytes(2, "little")
    elif kind == b"VP8L":
        body = b"\x2f" + ((width - 1) | (height - 1) << 14).to_bytes(4, "little") + b"\x00" * 9
    else:
        body = b"\x10\x00\x00\x00" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBP" + kind + len(body).to_bytes(4, "little") + body


def test_sides_of_webp_files(spark, tmp_path):
    cases = {f"{k.decode().strip()}-{w}x{h}.webp": webp(k, w, h) for k in (b"VP8 ", b"VP8L", b"VP8X") for w, h in ((50, 60), (16383, 49), (1, 700), (640, 16000))}
    cases |= {"short.webp": webp(b"VP8X", 70, 70)[:24], "odd.webp": webp(b"VP8 ", 70, 70).replace(b"\x9d", b"\x00")}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([(n,) for n in cases], "path string")
    for r in images.audit(manifest, str(tmp_path)).collect():
        if "x" in r.path.split("-")[-1] and "-" in r.path:
            w, h = map(int, r.path.split("-")[1].removesuffix(".webp").split("x"))
            assert (r.width, r.height, r.error_code) == (w, h, "IMAGE_TOO_SMALL" if min(w, h) < 50 else None)
        else:
            assert r.error_code == "CORRUPTED_IMAGE" and r.width is None


def test_moments_by_exact_arithmetic():
    """Of an L of pixels, in fractions."""
    g = np.zeros((12, 15), np.uint8)
    g[2:10, 3:6], g[7:10, 6:13] = 200, 200
    at = [(int(x), int(y)) for y, x in zip(*np.nonzero(g), strict=True)]
    n = Fraction(len(at)) * 255
    mx, my = (Fraction(sum(p[i] for p in at), len(at)) for i in (0, 1))
    e = {(p, q): float(sum(255 * (x - mx) ** p * (y - my) ** q for x, y in at)) / float(n) ** (1 + (p + q) / 2) for p in range(4) for q in range(4) if 2 <= p + q <= 3}
    a, b, c, d = e[3, 0] + e[1, 2], e[2, 1] + e[0, 3], e[3, 0] - 3 * e[1, 2], 3 * e[2, 1] - e[0, 3]
    hu = [e[2, 0] + e[0, 2], (e[2, 0] - e[0, 2]) ** 2 + 4 * e[1, 1] ** 2, c * c + d * d, a * a + b * b]
    assert images.shape_moments(g)[:4] == pytest.approx([-np.log10(x + 1e-10) for x in hu], rel=1e-5)


def test_colour_bins_of_plain_images():
    """Hue, saturation and value of plain colours fall into known bins of 8 x 8 x 4."""
    for bgr, place in (((0, 0, 255), (0, 7, 3)), ((0, 255, 0), (2, 7, 3)), ((255, 0, 0), (5, 7, 3)), ((0, 255, 255), (1, 7, 3)), ((128, 128, 128), (0, 0, 2)), ((0, 0, 0), (0, 0, 0)), ((60, 60, 120), (0, 4, 1))):
        h = images.color_histogram(np.full((4, 5, 3), bgr, np.uint8)).reshape(8, 8, 4)
        assert h[place] == pytest.approx(1, abs=1e-5) and h.sum() == pytest.approx(1, abs=1e-5)


def test_texture_of_a_plain_image():
    """Inside, all neighbours are as bright: 24 bits without a change; at the edges less is around."""
    h = images.texture_histogram(np.full((20, 30), 90, np.uint8)) * 600
    assert h[24] == pytest.approx(14 * 24, abs=0.01) and h.sum() == pytest.approx(600, abs=0.01) and h[26:].sum() == 0
