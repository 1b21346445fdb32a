"""Well-known binary of points, boxes and polygons, and tests of points against polygons."""

from __future__ import annotations

import struct

import numpy as np


def point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def polygon(*rings) -> bytes:
    """Rings of (x, y); each is closed if it isn't."""
    out = [struct.pack("<BII", 1, 3, len(rings))]
    for ring in rings:
        ring = [*ring] if tuple(ring[0]) == tuple(ring[-1]) else [*ring, ring[0]]
        out.append(struct.pack("<I", len(ring)) + np.asarray(ring, "<f8").tobytes())
    return b"".join(out)


def box(xmin, ymin, xmax, ymax) -> bytes:
    return polygon([(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)])


def decode(data: bytes) -> list[np.ndarray]:
    """Rings of a polygon, or of all polygons of a multipolygon; a point is one ring of one point."""
    at = 0

    def read() -> list[np.ndarray]:
        nonlocal at
        e = "<" if data[at] == 1 else ">"
        kind = struct.unpack_from(e + "I", data, at + 1)[0] & 0xFF
        at += 5
        if kind == 1:
            at += 16
            return [np.frombuffer(data, e + "f8", 2, at - 16).reshape(1, 2)]
        n = struct.unpack_from(e + "I", data, at)[0]
        at += 4
        if kind == 3:
            rings = []
            for _ in range(n):
                m = struct.unpack_from(e + "I", data, at)[0]
                rings.append(np.frombuffer(data, e + "f8", 2 * m, at + 4).reshape(m, 2))
                at += 4 + 16 * m
            return rings
        if kind in (4, 5, 6, 7):
            return [r for _ in range(n) for r in read()]
        raise ValueError(f"geometry type {kind} is not read")

    return read()


def bounds(data: bytes) -> tuple[float, float, float, float]:
    p = np.concatenate(decode(data))
    return float(p[:, 0].min()), float(p[:, 1].min()), float(p[:, 0].max()), float(p[:, 1].max())


def inside(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings, so holes are outside."""
    odd = np.zeros(np.shape(x), bool)
    for ring in rings:
        a, b = ring[:-1], ring[1:]
        for (x0, y0), (x1, y1) in zip(a, b, strict=True):
            cross = (y0 > y) != (y1 > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= cross & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return odd


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2
