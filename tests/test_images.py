"""Image kernels against plain versions, pixel by pixel."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from lectern.functions import fixed
from lectern.operators import imaging
from lectern.operators import pixels as P


def noisy(seed, h, w, low=0, high=255):
    r = random.Random(seed)
    return np.array([[r.randint(low, high) for _ in range(w)] for _ in range(h)], np.int64)


def clip(v):
    return max(0, min(255, v))


# ------------------------------------------------------------------ contrast
def plain_stretch(plane):
    counts = [0] * 256
    for v in plane.reshape(-1).tolist():
        counts[v] += 1
    for order in (range(256), range(255, -1, -1)):
        cut = int(plane.size * 0.5 // 100)
        for v in order:
            gone = min(cut, counts[v])
            counts[v] -= gone
            cut -= gone
    left = [v for v in range(256) if counts[v]]
    low, high = left[0], left[-1]
    if high <= low:
        return plane
    f = 255.0 / (high - low)
    return np.array([[clip(int(v * f + -low * f)) for v in row] for row in plane.tolist()])


def plain_smooth(plane):
    h, w = plane.shape
    out = plane.copy()
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            total = sum(int(plane[y + dy, x + dx]) * (5 if dx == dy == 0 else 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
            out[y, x] = clip(int(total / 13.0 + 0.5))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tone(seed):
    plane = noisy(seed, 12 + seed, 31, 60 if seed % 2 else 0, 200)
    plane[0, :5] = 255
    stretched = plain_stretch(plane)
    assert (P.stretch(plane[None])[0] == stretched).all()
    lifted = np.array([[min(255, round(255.0 * (v / 255.0) ** 0.85)) for v in row] for row in stretched.tolist()])
    soft = plain_smooth(lifted)
    assert (P.smooth(lifted[None])[0] == soft).all()
    sharp = np.array([[int(clip(s + 1.35 * (v - s))) for s, v in zip(a, b, strict=True)] for a, b in zip(soft.tolist(), lifted.tolist(), strict=True)])
    assert (P.toned(plane[None])[0] == sharp).all()


def test_flat_and_tiny_planes():
    for shape in ((1, 1), (1, 5), (2, 2), (3, 3)):
        plane = np.full(shape, 77)
        assert (P.stretch(plane[None])[0] == 77).all()
        assert P.toned(plane[None]).shape == (1, *shape)
        assert (P.noise_field(np.zeros((1, *shape), int)) is not None)


# ------------------------------------------------------------------ blur and size
def test_blur_is_a_plain_convolution():
    plane, sigma = noisy(3, 9, 11), 1.6
    reach = int(3 * sigma + 0.999)
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(taps)
    h, w = plane.shape
    want = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            for i, a in enumerate(taps):
                for j, b in enumerate(taps):
                    want[y, x] += a * b / total / total * plane[min(max(y + i - reach, 0), h - 1), min(max(x + j - reach, 0), w - 1)]
    assert np.allclose(P.blur(plane[None], sigma)[0], want)


def plain_resample(plane, w, h, kind):
    def share(x):
        if abs(x) >= 3:
            return 0.0
        return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)

    def line(values, out):
        scale, made = len(values) / out, []
        for i in range(out):
            if kind == "area":
                ws = [max(0.0, min(k + 1, (i + 1) * scale) - max(k, i * scale)) for k in range(len(values))]
            else:
                ws = [share((k + 0.5 - (i + 0.5) * scale) / max(1.0, scale)) for k in range(len(values))]
            made.append(clip(math.floor(sum(a * b for a, b in zip(ws, values, strict=True)) / sum(ws) + 0.5)))
        return made

    across = [line(row, w) for row in plane.tolist()]
    return np.array([line(column, h) for column in zip(*across, strict=True)]).T


@pytest.mark.parametrize("kind", ["area", "lanczos"])
@pytest.mark.parametrize("size", [(5, 4), (3, 7), (17, 13), (30, 2), (1, 1), (17, 40)])
def test_resampling(kind, size):
    plane = noisy(size[0], 13, 17)
    got, want = P.resample(plane[None], *size, kind)[0], plain_resample(plane, *size, kind)
    assert got.shape == want.shape
    assert np.abs(got - want).max() <= 1  # a value halfway between two may round either way
    assert (got != want).mean() < 0.02


def test_sizes_on_a_panel():
    fills = P.on_panel(noisy(1, 75, 50), 53, 79)
    assert fills.shape == (79, 53)
    small = P.on_panel(noisy(2, 20, 20), 53, 79)
    assert small.shape == (30, 30)  # enlarged by half at most
    assert P.within(noisy(3, 100, 50)[None], 30, 30).shape == (1, 30, 15)
    assert P.within(noisy(3, 10, 5)[None], 30, 30).shape == (1, 10, 5)
    plane = noisy(4, 6, 12)
    assert (P.covering(plane[None], 6, 6)[0] == plane[:, 3:9]).all()


def test_crop():
    plane = noisy(5, 6, 8)
    assert (P.crop(plane, 2, 1, 5, 4) == plane[1:4, 2:5]).all()
    out = P.crop(plane, -2, -1, 3, 2)
    assert out.shape == (3, 5)
    assert (out[1:, 2:] == plane[:2, :3]).all()
    assert not out[0].any()
    assert not out[:, :2].any()


# ------------------------------------------------------------------ noise
def test_noise_has_mean_nothing_and_no_coarse_scales():
    planes = np.stack([noisy(k, 64, 64) for k in range(3)])
    noise = P.noise_field(planes)
    assert np.abs(noise.mean(axis=(1, 2))).max() < 1e-9
    assert np.allclose(noise.std(axis=(1, 2)), 0.4)
    assert not np.allclose(noise[0], noise[1])
    blocks = noise.reshape(3, 8, 8, 8, 8).mean(axis=(2, 4))
    assert blocks.std() < 0.4 / 8 / 2  # white noise would have an eighth of its deviation


def test_noise_depends_on_the_image_alone(spark):
    rows = [(k, 16, 12, noisy(k % 5, 12, 16).reshape(-1).tolist()) for k in range(20)]
    images = spark.createDataFrame(rows, "image long, w int, h int, pixels array<int>")
    made = [sorted((r.image, bytes(r.content)) for r in imaging.wallpapers(images.repartition(n), "floyd", "waves", 40, 60).collect()) for n in (1, 7)]
    assert made[0] == made[1]
    assert made[0][0][1] == made[0][5][1]  # equal images under other keys
    noise = {r.image: r.noise for r in imaging.finish(images.repartition(5), "noise").collect()}
    assert all(np.allclose(noise[k], P.noise_field(noisy(k % 5, 12, 16)[None])[0].reshape(-1)) for k in range(20))


def test_flat_tones_become_grain():
    tones = [t for t in range(4, 256, 6) if abs(math.sin(2 * math.pi * t / 85.0)) > 0.5]
    levels = imaging.quantised(np.stack([np.full((56, 56), t) for t in tones]), "floyd")
    assert max(imaging.repeat_score(x) for x in levels) < 0.25
    plain = imaging.serpentine_planes(np.stack([np.full((56, 56), float(t)) for t in tones]), np.zeros((len(tones), 56, 56)), "floyd")
    assert max(imaging.repeat_score(x) for x in plain) > 0.25
    for level in fixed.LEVELS:
        assert len(np.unique(imaging.quantised(np.full((1, 48, 48), level), "floyd"))) == 1


@pytest.mark.parametrize("algorithm", ["floyd", "device"])
def test_ramp_keeps_its_tone(algorithm):
    ramp = np.repeat(np.minimum(255, np.arange(96) * 255 // 96)[:, None], 64, axis=1)[None]
    shown = np.array(fixed.LEVELS)[imaging.quantised(ramp, algorithm)]
    assert abs(shown.mean() - ramp.mean()) < 12


# ------------------------------------------------------------------ mats
def plain_side(x, y, w, h, left, top, pw, ph):
    far = [(top - y) / top if top else 0, (y - (top + h) + 1) / (ph - top - h) if ph - top - h else 0, (left - x) / left if left else 0, (x - (left + w) + 1) / (pw - left - w) if pw - left - w else 0]
    return far.index(max(far))


def plain_waves(plane, left, top, pw, ph):
    h, w = plane.shape
    seed = int.from_bytes(hashlib.blake2b(struct.pack("<2q", h, w) + bytes(plane.reshape(-1).tolist()), digest_size=8).digest(), "little")
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    uniform = [(mix((mix(seed) + k * 0x9E3779B97F4A7C15) & mask) >> 11) / (1 << 53) for k in range(1, 13)]
    deep = max(1, min(3, w // 2, h // 2))
    mean = lambda values: int(sum(values) / len(values) + 0.5)
    lines = [[mean([int(plane[k, x]) for k in range(deep)]) for x in range(w)], [mean([int(plane[h - 1 - k, x]) for k in range(deep)]) for x in range(w)]]
    lines += [[mean([int(plane[y, k]) for k in range(deep)]) for y in range(h)], [mean([int(plane[y, w - 1 - k]) for k in range(deep)]) for y in range(h)]]
    walks = []
    for side in range(4):
        periods = [90 + u * 130 for u in uniform[side * 3 : side * 3 + 3]]
        at, walk = 0, []
        for d in range(max(pw, ph) + 1):
            goal = round(sum(p * 0.35 / (2 * math.pi) * math.sin(2 * math.pi * d / p) for p in periods))
            at += 1 if goal > at else -1 if goal < at else 0
            walk.append(at)
        walks.append(walk)
    out = np.zeros((ph, pw), np.int64)
    for y in range(ph):
        for x in range(pw):
            k = plain_side(x, y, w, h, left, top, pw, ph)
            d = [top - y, y - (top + h - 1), left - x, x - (left + w - 1)][k]
            place = (x - left if k < 2 else y - top) + walks[k][d if 0 <= d < len(walks[k]) else 0]
            out[y, x] = lines[k][min(max(place, 0), len(lines[k]) - 1)]
    out[top : top + h, left : left + w] = plane
    return out


@pytest.mark.parametrize("size", [(10, 14), (1, 1), (40, 20), (30, 60), (7, 2)])
def test_waves_mat(size):
    plane = noisy(sum(size), size[1], size[0])
    got = imaging.matted(plane, 40, 60, "waves")
    assert (got == plain_waves(plane, (40 - size[0]) // 2, (60 - size[1]) // 2, 40, 60)).all()


def test_strands_stay_together():
    for seed in range(20):
        walk = P.strand(np.uint64(seed), seed % 4, 400)
        assert np.abs(np.diff(walk)).max() <= 1
        assert np.abs(walk).max() > 3


def test_blur_mat():
    plane = noisy(8, 12, 20)
    got = imaging.matted(plane, 40, 30, "blur")
    wide = P.covering(plane[None], 40, 30)[0]
    soft = np.floor(P.blur(wide[None], 40 / 12)[0] + 0.5)
    mean = math.floor(soft.mean() + 0.5)
    want = np.array([[int(clip(mean + 0.55 * (v - mean))) for v in row] for row in soft.tolist()])
    want[9:21, 10:30] = plane
    assert (got == want).all()
    assert got[:9].std() < plane.std() / 2


def test_other_mats():
    plane = noisy(9, 6, 6)
    assert set(imaging.matted(plane, 12, 12, "none")[0].tolist()) == {255}
    assert set(imaging.matted(plane, 12, 12, "black")[0].tolist()) == {0}
    with pytest.raises(KeyError):
        imaging.matted(plane, 12, 12, "plaid")


def test_flow_counts_by_a_distance(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(imaging.flow(F.array(*map(F.lit, range(5))), F.array(*map(F.lit, (0, 1, 2))), 5, 4, 0, lambda i: 2 - i).alias("f")).first()
    assert row.f == [2, 3, 4, 4, 4] + [1, 2, 3, 4, 4] + [0, 1, 2, 3, 4] * 2


# ------------------------------------------------------------------ PNG
def png(samples, w, h, depth, colour, kinds=(0,), interlaced=False, palette=None, clear=None):
    """A file of samples (h x w x per), with the given filters in turn."""
    per = samples.shape[2]
    step = max(1, per * depth // 8)

    def lines(part):
        out, last = b"", None
        for y in range(part.shape[0]):
            if depth == 16:
                raw = b"".join(struct.pack(">H", v) for v in part[y].reshape(-1).tolist())
            elif depth == 8:
                raw = bytes(part[y].reshape(-1).tolist())
            else:
                bits = "".join(f"{v:0{depth}b}" for v in part[y].reshape(-1).tolist())
                bits += "0" * (-len(bits) % 8)
                raw = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
            up, kind = last or bytes(len(raw)), kinds[y % len(kinds)]
            made = []
            for x, v in enumerate(raw):
                a, b, c = raw[x - step] if x >= step else 0, up[x], up[x - step] if x >= step else 0
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                made.append((v - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
            out += bytes([kind, *made])
            last = raw
        return out

    if interlaced:
        steps = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
        data = b"".join(lines(samples[y::dy, x::dx]) for x, y, dx, dy in steps if samples[y::dy, x::dx].size)
    else:
        data = lines(samples)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced)))
    if palette:
        out += chunk(b"PLTE", bytes(palette))
    if clear:
        out += chunk(b"tRNS", clear)
    whole = zlib.compress(data)
    return out + chunk(b"IDAT", whole[:7]) + chunk(b"IDAT", whole[7:]) + chunk(b"IEND", b"")


def grey(r, g, b):
    return (19595 * r + 38470 * g + 7471 * b + 32768) >> 16


def over(v, a):
    return (v * a + 255 * (255 - a) + 127) // 255


@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("interlaced", [False, True])
def test_png_filters(kinds, interlaced):
    for colour, per in ((0, 1), (2, 3), (4, 2), (6, 4)):
        samples = noisy(colour, 11, 9 * per).reshape(11, 9, per)
        plane, error = P.decode_png(png(samples, 9, 11, 8, colour, kinds, interlaced))
        assert error is None
        for y in range(11):
            for x in range(9):
                v = samples[y, x].tolist()
                rgb, a = (v[:3] if per > 2 else v[:1] * 3), v[-1] if per in (2, 4) else 255
                assert plane[y, x] == grey(*(over(c, a) for c in rgb))


@pytest.mark.parametrize("depth", [1, 2, 4, 16])
def test_png_depths(depth):
    top = (1 << depth) - 1
    samples = noisy(depth, 7, 13, 0, top).reshape(7, 13, 1)
    plane, error = P.decode_png(png(samples, 13, 7, depth, 0, (1, 4)))
    assert error is None
    assert (plane == (samples[:, :, 0] >> 8 if depth == 16 else samples[:, :, 0] * 255 // top)).all()
    if depth < 16:
        palette = [random.Random(k).randrange(256) for k in range(3 * (top + 1))]
        plane, error = P.decode_png(png(samples, 13, 7, depth, 3, (0, 2), palette=palette, clear=b"\x80"))
        for y in range(7):
            for x in range(13):
                v = int(samples[y, x, 0])
                assert plane[y, x] == grey(*(over(c, 128 if v == 0 else 255) for c in palette[3 * v : 3 * v + 3]))


def test_png_round_trip_and_errors():
    plane = noisy(1, 20, 30)
    whole = imaging.encode_png(plane, 30, 20)
    assert (P.decode_png(whole)[0] == plane).all()
    for n in (0, 5, 8, 20, 40, len(whole) - 13, len(whole) - 1):
        got = P.decode_png(whole[:n])
        assert got[0] is None
        assert got[1] in ("truncated", "not a PNG")
    assert P.decode_png(None) == (None, "not a PNG")
    assert P.decode_png(whole, most_pixels=100) == (None, "too large")
    flipped = bytearray(whole)
    flipped[50] ^= 1
    assert P.decode_png(bytes(flipped)) == (None, "bad checksum")
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    sign, end = b"\x89PNG\r\n\x1a\n", chunk(b"IEND", b"")
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0))
    assert P.decode_png(sign + end) == (None, "no header")
    assert P.decode_png(sign + head + chunk(b"IDAT", b"no") + end) == (None, "bad data")
    assert P.decode_png(sign + head + chunk(b"IDAT", zlib.compress(b"\x00a")) + end) == (None, "truncated")
    assert P.decode_png(sign + head + chunk(b"IDAT", zlib.compress(b"\x09ab\x00ab")) + end) == (None, "bad filter")
    assert P.decode_png(sign + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 3, 0, 0, 0, 0)) + end) == (None, "bad header")


def test_covers_and_figures(spark):
    big, small = noisy(1, 30, 60), noisy(2, 4, 5)
    rows = [(1, 60, 30, big.reshape(-1).tolist()), (2, 5, 4, small.reshape(-1).tolist())]
    images = spark.createDataFrame(rows, "image int, w int, h int, pixels array<int>")
    got = {r.image: r for r in imaging.covers(images, 20, 20).collect()}
    assert (got[1].w, got[1].h, got[2].w, got[2].h) == (20, 10, 5, 4)
    assert (np.array(got[1].pixels).reshape(10, 20) == P.resample(big[None], 20, 10)[0]).all()
    assert got[2].pixels == small.reshape(-1).tolist()
    boxes = spark.createDataFrame([("a", 1, 1, (50, 20, 70, 30), 20, 10), ("b", 1, 1, (0, 0, 40, 20), 20, 10), ("c", 1, 9, (0, 0, 4, 4), 4, 4), ("d", 1, 1, (5, 5, 5, 9), 1, 4)], "book string, n int, image int, box struct<x0:int,top:int,x1:int,bottom:int>, width int, height int")
    figures = {r.book: r for r in imaging.figure_pixels(boxes, images, ["book", "n"], ["image"]).collect()}
    assert set(figures) == {"a", "b"}  # c has no raster, d an empty box
    assert (np.array(figures["a"].pixels).reshape(10, 20)[:, :10] == big[20:, 50:]).all()
    assert (np.array(figures["b"].pixels).reshape(10, 20) == P.resample(big[:20, :40][None], 20, 10)[0]).all()
