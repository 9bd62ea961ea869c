"""Pixel hashes and statistics against brute force, on images that Spark's source decodes from files."""

import math
import random
import struct
from collections import Counter

from pyspark.sql import functions as F

from siftlake.operators import images as I

IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def bmp(width, height, pixel):
    """A 24-bit bitmap; pixel(x, y) gives red, green, blue."""
    pad = b"\0" * (-width * 3 % 4)
    rows = b"".join(b"".join(bytes(reversed(pixel(x, y))) for x in range(width)) + pad for y in reversed(range(height)))
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(rows), 0, 0, 54, 40, width, height, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def brute(width, height, pixel):
    grey = [[0.299 * r + 0.587 * g + 0.114 * b for r, g, b in (pixel(x, y) for x in range(width))] for y in range(height)]
    n, flat = I.SIDE, [v for row in grey for v in row]
    part = lambda at, size, i: max(0.0, min((at + 1) * size / n, i + 1) - max(at * size / n, i))
    small = [[sum(part(a, height, y) * part(b, width, x) * grey[y][x] for y in range(height) for x in range(width)) * n * n / width / height for b in range(n)] for a in range(n)]
    wave = lambda k, i: math.cos(math.pi * k * (2 * i + 1) / (2 * n))
    rows = [[sum(wave(v, x) * small[y][x] for x in range(n)) for v in range(1, 9)] for y in range(n)]
    found = [round(sum(wave(u, y) * rows[y][v] for y in range(n)) * 2 / n, 9) for u in range(1, 9) for v in range(8)]
    middle = sum(sorted(found)[31:33]) / 2
    h = sum(1 << i for i, c in enumerate(found) if c > middle)
    counts = Counter(round(v) for v in flat)
    return h if h < 1 << 63 else h - (1 << 64), sum(flat) / len(flat), -sum(k / len(flat) * math.log2(k / len(flat)) for k in counts.values())


def test_files_equal_brute_force(spark, tmp_path):
    rng, want = random.Random(5), {}
    for i, (w, h) in enumerate([(8, 8), (9, 5), (16, 12), (16, 12)]):
        cells = {(x, y): tuple(rng.randrange(256) for _ in range(3)) for x in range(w) for y in range(h)}
        pixel = lambda x, y, cells=cells: cells[x, y]
        (tmp_path / f"{i}.bmp").write_bytes(bmp(w, h, pixel))
        want[f"{i}.bmp"] = brute(w, h, pixel)
    (tmp_path / "broken.bmp").write_bytes(b"BM nothing")
    files = spark.read.format("image").load(str(tmp_path))
    got = {r.origin.rsplit("/", 1)[1]: r for r in I.pixel_features(files).collect()}
    for name, (h, mean, entropy) in want.items():
        assert got[name].p_hash == h and math.isclose(got[name].mean, mean) and math.isclose(got[name].entropy, entropy)
    assert "broken.bmp" not in got or got["broken.bmp"].p_hash is None


def test_hashes_stay_near_under_scale_and_brightness(spark):
    rng = random.Random(1)
    cells = {(x, y): rng.randrange(200) for x in range(8) for y in range(8)}

    def image(name, scale, more):
        data = bytes(cells[x // scale, y // scale] + more for y in range(8 * scale) for x in range(8 * scale))
        return ((name, 8 * scale, 8 * scale, 1, 0, data),)

    got = {r.origin: r for r in I.pixel_features(spark.createDataFrame([image("a", 1, 0), image("b", 4, 0), image("c", 5, 30)], IMAGE)).collect()}
    assert got["a"].p_hash == got["b"].p_hash == got["c"].p_hash and math.isclose(got["c"].mean, got["a"].mean + 30)


def test_what_is_not_decoded_has_no_features(spark):
    rows = [(None,), (("short", 2, 2, 3, 16, b"123"),), (("mode", 1, 1, 1, -1, b"1"),), (("none", 0, 0, 3, 16, b""),), (("two", 1, 1, 2, 0, b"12"),), (("null", 1, 1, 1, 0, None),), (("flat", 1, 1, 4, 24, b"\x05\x05\x05\x00"),)]
    got = {r.origin: (r.p_hash, r["mean"], r.entropy) for r in I.pixel_features(spark.createDataFrame(rows, IMAGE)).collect()}
    assert {k: v for k, v in got.items() if k != "flat"} == dict.fromkeys([None, "short", "mode", "none", "two", "null"], (None, None, None))
    assert got["flat"][0] == 0 and math.isclose(got["flat"][1], 5) and got["flat"][2] == 0
    assert I.pixel_features(spark.createDataFrame([], IMAGE)).count() == 0


def test_the_query_over_grids_equals_its_pixels(spark):
    from siftlake.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    grids = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {r.vec_id: r for r in QUERIES["image_hashes"](spark, sf).collect()}
    assert got.keys() == grids.keys()
    for i in list(grids)[:5]:
        cells = [min(max(math.floor(128 + 127 * v), 0), 255) for v in grids[i]]
        h, mean, _ = brute(8, 8, lambda x, y, cells=cells: (cells[8 * y + x],) * 3)
        assert got[i].p_hash == h and math.isclose(got[i].mean, mean, abs_tol=1e-6)
