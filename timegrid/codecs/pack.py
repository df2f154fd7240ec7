"""Packed arrays of 5-bit and 4-bit numbers, most significant bits first."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray, bits: int, group: int) -> bytes:
    """Numbers of `bits` bits each, filled up with zeros to a multiple of `group` numbers."""
    v = np.asarray(values, np.uint8)
    if len(v) and int(v.max()) >> bits:
        raise ValueError(f"a value needs more than {bits} bits")
    v = np.pad(v, (0, -len(v) % group))
    return np.packbits(np.unpackbits(v[:, None], axis=1)[:, 8 - bits :]).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n numbers of `bits` bits."""
    raw = np.unpackbits(np.frombuffer(data, np.uint8))
    if len(raw) < n * bits:
        raise ValueError("packed data is too short")
    weights = 1 << np.arange(bits - 1, -1, -1)
    return (raw[: n * bits].reshape(n, bits) @ weights).astype(np.uint8)


def pack_glyphs(values: np.ndarray) -> bytes:
    return pack(values, 5, 8)


def pack_colours(values: np.ndarray) -> bytes:
    return pack(values, 4, 2)


def plane_sizes(cells: int) -> tuple[int, int, int]:
    """Bytes of the packed glyph and colour planes."""
    colours = (cells + 1) // 2
    return (cells + 7) // 8 * 5, colours, colours


def pack_planes(glyph: np.ndarray, fg: np.ndarray, bg: np.ndarray) -> bytes:
    return pack_glyphs(glyph) + pack_colours(fg) + pack_colours(bg)


def unpack_planes(data: bytes, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, c = plane_sizes(cells)
    return unpack(data[:a], 5, cells), unpack(data[a : a + b], 4, cells), unpack(data[a + b : a + b + c], 4, cells)
