"""Kernels on planes of grey values: contrast, sharpening, blur, resampling, reproducible noise, and PNG scan lines.

Planes are stacked (n x h x w), so that images of one size are worked on together. Each step gives whole numbers
from 0 to 255, as a chain of 8-bit filters would; only noise is a fraction.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np

from lectern.functions import fixed

_U = np.uint64


def _whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values + 0.5).clip(0, 255).astype(np.int64)


# ------------------------------------------------------------------ contrast
def stretch(planes: np.ndarray, percent: float = fixed.CUTOFF) -> np.ndarray:
    """The range that is left after ``percent`` of the pixels are cut off at each end becomes 0 to 255; a flat plane stays."""
    n = planes.shape[1] * planes.shape[2]
    cut = int(n * percent // 100)
    order = np.sort(planes.reshape(len(planes), n), axis=1)
    low, high = (order[:, k].astype(float)[:, None, None] for k in (cut, n - 1 - cut))
    factor = 255.0 / np.where(high > low, high - low, 1)
    out = np.trunc(planes * factor + -low * factor).clip(0, 255).astype(np.int64)
    return np.where(high > low, out, planes)


def gamma(planes: np.ndarray, power: float = fixed.GAMMA) -> np.ndarray:
    table = np.array([min(255, round(255.0 * (i / 255.0) ** power)) for i in range(256)])
    return table[planes]


def smooth(planes: np.ndarray) -> np.ndarray:
    """Each inner pixel is the mean of its 3 x 3 neighbourhood, itself weighing five; the border stays."""
    out = np.array(planes, np.int64)
    h, w = planes.shape[1:]
    if h > 2 and w > 2:
        total = sum(planes[:, dy : h - 2 + dy, dx : w - 2 + dx] for dy in range(3) for dx in range(3)) + 4 * planes[:, 1:-1, 1:-1]
        out[:, 1:-1, 1:-1] = _whole(total / 13.0)
    return out


def blend(base: np.ndarray, planes: np.ndarray, factor: float) -> np.ndarray:
    """From ``base`` (factor 0) to the planes (1) and beyond, cut to whole numbers."""
    return np.trunc((base + factor * (planes - base)).clip(0, 255)).astype(np.int64)


def sharpen(planes: np.ndarray, factor: float = fixed.SHARPNESS) -> np.ndarray:
    return blend(smooth(planes), planes, factor)


def contrast(planes: np.ndarray, factor: float) -> np.ndarray:
    mean = np.floor(planes.mean(axis=(1, 2)) + 0.5)[:, None, None]
    return blend(mean, planes, factor)


def toned(planes: np.ndarray) -> np.ndarray:
    """Stretched, lifted by the gamma curve, and sharpened."""
    return sharpen(gamma(stretch(planes)))


# ------------------------------------------------------------------ blur and size
def blur(planes: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, first along columns, then along rows; edges repeat. Fractions are kept."""
    reach = max(1, int(3 * sigma + 0.999))
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    taps /= taps.sum()
    out = planes.astype(float)
    for axis in (1, 2):
        n = out.shape[axis]
        held = np.pad(out, [(reach, reach) if k == axis else (0, 0) for k in range(3)], mode="edge")
        out = sum(t * np.take(held, np.arange(k, k + n), axis=axis) for k, t in enumerate(taps))
    return out


def weights(size: int, out: int, kind: str, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Shares (out x size) of the source's places in each new place, for the part of the source from ``low`` to ``high``.

    'area': by how much a source place and the new place overlap, exactly. 'lanczos': a windowed sine of three lobes,
    widened when the plane shrinks. Each row adds up to 1.
    """
    high = size if high is None else high
    scale = (high - low) / out
    place, new = np.arange(size), np.arange(out)[:, None]
    if kind == "area":
        begin, end = low + new * scale, low + (new + 1) * scale
        share = (np.minimum(place + 1, end) - np.maximum(place, begin)).clip(0, None)
    else:
        wide = max(1.0, scale)
        x = (place + 0.5 - (low + (new + 0.5) * scale)) / wide
        share = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return share / share.sum(1, keepdims=True)


def resample(planes: np.ndarray, w: int, h: int, kind: str = "lanczos", box: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """Planes of w x h of all, or of what lies in ``box`` (left, top, right, bottom): along rows, then along columns."""
    height, width = planes.shape[1:]
    left, top, right, bottom = box or (0, 0, width, height)
    if (w, h) == (width, height) and (left, top, right, bottom) == (0, 0, width, height):
        return planes.astype(np.int64)
    across, down = weights(width, w, kind, left, right), weights(height, h, kind, top, bottom)
    return _whole(np.einsum("yr,nrx->nyx", down, _whole(planes @ across.T).astype(float)))


def covering(planes: np.ndarray, w: int, h: int, kind: str = "lanczos") -> np.ndarray:
    """The largest centred part of the planes' shape w : h, resampled to w x h."""
    height, width = planes.shape[1:]
    wide, high = (h and height * w / h, height) if width * h >= height * w else (width, width * h / w)
    left, top = (width - wide) / 2, (height - high) / 2
    return resample(planes, w, h, kind, (left, top, left + wide, top + high))


def within(planes: np.ndarray, w: int, h: int, most: float = 1.0) -> np.ndarray:
    """Fitted into w x h, enlarged by ``most`` at most."""
    height, width = planes.shape[1:]
    scale = min(w / width, h / height, most)
    return resample(planes, max(1, round(width * scale)), max(1, round(height * scale)))


def on_panel(plane: np.ndarray, panel_w: int, panel_h: int) -> np.ndarray:
    """One plane at the size it has on a panel: filling it unless that would enlarge too much and leave a visible mat."""
    h, w = plane.shape
    enlarge = max(panel_w / w, panel_h / h)
    scale = min(panel_w / w, panel_h / h, fixed.MAX_UPSCALE)
    mat = 1 - max(1, round(w * scale)) * max(1, round(h * scale)) / (panel_w * panel_h)
    if enlarge <= fixed.MAX_UPSCALE or mat < fixed.MIN_MAT_AREA:
        return covering(plane[None], panel_w, panel_h)[0]
    return within(plane[None], panel_w, panel_h, fixed.MAX_UPSCALE)[0]


def crop(plane: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    """What lies in the box; 0 outside the plane."""
    h, w = plane.shape
    out = np.zeros((max(0, bottom - top), max(0, right - left)), np.int64)
    x0, x1, y0, y1 = max(0, left), min(w, right), max(0, top), min(h, bottom)
    if x1 > x0 and y1 > y0:
        out[y0 - top : y1 - top, x0 - left : x1 - left] = plane[y0:y1, x0:x1]
    return out


# ------------------------------------------------------------------ noise and waves
def mix(x: np.ndarray) -> np.ndarray:
    """A number that looks random for each counter."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seed_of(plane: np.ndarray) -> np.uint64:
    """From the image's values alone, so that one image always gets the same noise, wherever it is worked on."""
    shape = struct.pack("<2q", *plane.shape)
    return np.frombuffer(hashlib.blake2b(shape + plane.astype(np.uint8).tobytes(), digest_size=8).digest(), "<u8")[0]


def draws(seed: np.uint64, n: int) -> np.ndarray:
    """The first n of a seed's numbers: each depends on its place only, not on those before."""
    return mix(mix(np.full(1, seed, _U)) + np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def noise_field(planes: np.ndarray, sigma: float = fixed.NOISE_SIGMA) -> np.ndarray:
    """Blue noise for each plane: random values without what a blur leaves of them, mean 0, deviation 1 / 2.5."""
    n, h, w = planes.shape
    white = np.stack([(draws(seed_of(p), h * w) >> _U(56)).astype(float).reshape(h, w) for p in planes]) if n else np.zeros((0, h, w))
    fine = white - blur(white, sigma)
    fine -= fine.mean(axis=(1, 2), keepdims=True)
    spread = fine.std(axis=(1, 2), keepdims=True)
    return np.where(spread > 1e-12, fine / np.where(spread > 1e-12, 2.5 * spread, 1), 0.0)


def steps(goals: np.ndarray) -> list[int]:
    """A walk from 0 toward each rounded goal in turn, by one at most."""
    at, out = 0, []
    for goal in np.rint(goals).astype(int).tolist():
        at += (goal > at) - (goal < at)
        out.append(at)
    return out


def strand(seed: np.uint64, side: int, span: int) -> np.ndarray:
    """How far a strand of a side has wandered at each distance from 0 to ``span``: a walk along a sum of sines."""
    u = (draws(seed, fixed.WAVES * 4) >> _U(11)).astype(float)[side * fixed.WAVES : (side + 1) * fixed.WAVES] / (1 << 53)
    period = fixed.WAVE_PERIOD[0] + u * (fixed.WAVE_PERIOD[1] - fixed.WAVE_PERIOD[0])
    height = period * fixed.WAVE_SLOPE / (2 * np.pi)
    d = np.arange(span + 1)[:, None]
    return np.array(steps((height * np.sin(2 * np.pi * d / period)).sum(1)))


def sectors(w: int, h: int, left: int, top: int, panel_w: int, panel_h: int) -> np.ndarray:
    """For each panel pixel the side (0 top, 1 bottom, 2 left, 3 right) from whose edge it is farthest, in proportion to its margin."""
    y, x = np.mgrid[0:panel_h, 0:panel_w]
    margin = ((top - y, top), (y - (top + h) + 1, panel_h - top - h), (left - x, left), (x - (left + w) + 1, panel_w - left - w))
    return np.stack([distance / max(1, size) if size > 0 else np.zeros_like(x, float) for distance, size in margin]).argmax(0)


def waves(plane: np.ndarray, left: int, top: int, panel_w: int, panel_h: int) -> np.ndarray:
    """A panel on which each edge of the plane travels outward, shifted by a strand of its own; the line's ends go on beyond it."""
    h, w = plane.shape
    deep = max(1, min(fixed.WAVE_DEPTH, w // 2, h // 2))
    lines = [_whole(part.mean(axis)) for part, axis in ((plane[:deep], 0), (plane[h - deep :], 0), (plane[:, :deep], 1), (plane[:, w - deep :], 1))]
    y, x = np.mgrid[0:panel_h, 0:panel_w]
    away = (top - y, y - (top + h - 1), left - x, x - (left + w - 1))
    along = (x - left, x - left, y - top, y - top)
    seed, span = seed_of(plane), max(panel_w, panel_h)
    out = np.zeros((panel_h, panel_w), np.int64)
    side = sectors(w, h, left, top, panel_w, panel_h)
    for k, line in enumerate(lines):
        walk = strand(seed, k, span)
        mine = side == k
        distance = away[k][mine]
        shift = walk[np.where((distance >= 0) & (distance < len(walk)), distance, 0)]
        out[mine] = line[(along[k][mine] + shift).clip(0, len(line) - 1)]
    return out


def washed(plane: np.ndarray, panel_w: int, panel_h: int) -> np.ndarray:
    """A panel covered by the plane, blurred and flattened."""
    return contrast(_whole(blur(covering(plane[None], panel_w, panel_h), panel_w / fixed.BLUR_DIVISOR)), fixed.BLUR_CONTRAST)[0]


# ------------------------------------------------------------------ PNG
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def unfilter(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray | None:
    """Scan lines (a filter's number, then ``stride`` bytes) as bytes; ``step`` bytes lie between a byte and its left one."""
    out = np.zeros((rows + 1, stride), np.uint8)  # row 0 is the empty line above the first
    for y in range(rows):
        at = y * (stride + 1)
        kind, line, above = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1), out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(np.pad(line, (0, -stride % step)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            now, up, data = bytearray(stride), above.tolist(), line.tolist()
            for x in range(stride):
                a, b = now[x - step] if x >= step else 0, up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[x - step] if x >= step else 0
                    far = {2: abs(a + b - 2 * c), 1: abs(a - c), 0: abs(b - c)}  # of the upper left, upper and left byte
                    guess = a if far[0] <= far[1] and far[0] <= far[2] else b if far[1] <= far[2] else c
                now[x] = (data[x] + guess) & 255
            out[y + 1] = np.frombuffer(bytes(now), np.uint8)
        else:
            return None
    return out[1:]


def _samples(lines: np.ndarray, w: int, depth: int, per: int) -> np.ndarray:
    """rows x w x per samples of a depth of 1 to 16 bits; of 16 bits the higher eight."""
    if depth == 16:
        return lines[:, ::2].reshape(len(lines), w, per).astype(np.int64)
    if depth == 8:
        return lines.reshape(len(lines), w, per).astype(np.int64)
    each = 8 // depth
    bits = (lines[:, :, None] >> (8 - depth * (1 + np.arange(each)))) & ((1 << depth) - 1)
    return bits.reshape(len(lines), -1)[:, :w, None].astype(np.int64)


def decode_png(content: bytes | None, most_pixels: int = 64_000_000) -> tuple[np.ndarray | None, str | None]:
    """Grey values (h x w) of a PNG flattened onto white, or None and the reason."""
    if not content or content[:8] != b"\x89PNG\r\n\x1a\n":
        return None, "not a PNG"
    head, palette, clear, data, at = None, b"", b"", [], 8
    while True:
        if at + 12 > len(content):
            return None, "truncated"
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if at + 12 + size > len(content):
            return None, "truncated"
        if zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            return None, "bad checksum"
        at += 12 + size
        if kind == b"IHDR" and size == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None:
        return None, "no header"
    w, h, depth, colour, method, filters, interlaced = head
    fine = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
    if not w or not h or depth not in fine.get(colour, ()) or method or filters or interlaced > 1 or (colour == 3 and not palette):
        return None, "bad header"
    if w * h > most_pixels:
        return None, "too large"
    per = _SAMPLES[colour]
    step = max(1, per * depth // 8)
    passes = [(x, y, -(-(w - x) // dx), -(-(h - y) // dy), dx, dy) for x, y, dx, dy in _PASSES] if interlaced else [(0, 0, w, h, 1, 1)]
    passes = [(*p, (p[2] * per * depth + 7) // 8) for p in passes if p[2] > 0 and p[3] > 0]
    need = sum(p[3] * (p[6] + 1) for p in passes)
    try:
        raw = zlib.decompressobj().decompress(b"".join(data), need)
    except zlib.error:
        return None, "bad data"
    if len(raw) < need:
        return None, "truncated"
    pixels, at = np.zeros((h, w, per), np.int64), 0
    for x, y, columns, rows, dx, dy, stride in passes:
        lines = unfilter(raw[at : at + rows * (stride + 1)], rows, stride, step)
        if lines is None:
            return None, "bad filter"
        pixels[y::dy, x::dx] = _samples(lines, columns, depth, per)
        at += rows * (stride + 1)
    return flattened(pixels, depth, colour, palette, clear), None


def flattened(pixels: np.ndarray, depth: int, colour: int, palette: bytes, clear: bytes) -> np.ndarray:
    """Samples as grey values: colours by their luma, what is transparent by as much white."""
    full = (1 << min(depth, 8)) - 1
    alpha = np.full(pixels.shape[:2], 255)
    if colour == 3:
        table = np.zeros((256, 3), np.int64)
        listed = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)[:256]
        table[: len(listed)] = listed
        opaque = np.full(256, 255)
        opaque[: len(clear)] = np.frombuffer(clear, np.uint8)[:256]
        alpha, rgb = opaque[pixels[:, :, 0]], table[pixels[:, :, 0]]
    else:
        scaled = pixels * 255 // full
        if colour in (4, 6):
            alpha = scaled[:, :, -1]
        elif len(clear) >= 2 * pixels.shape[2]:
            key = np.array(struct.unpack(f">{pixels.shape[2]}H", clear[: 2 * pixels.shape[2]])) >> (8 if depth == 16 else 0)
            alpha = np.where((pixels == key).all(2), 0, 255)
        rgb = scaled[:, :, :3] if colour in (2, 6) else np.repeat(scaled[:, :, :1], 3, axis=2)
    over = (rgb * alpha[:, :, None] + 255 * (255 - alpha[:, :, None]) + 127) // 255
    return (over @ np.array(fixed.GREY) + (1 << 15)) >> 16
