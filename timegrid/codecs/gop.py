"""Segments of frames: a head, a palette, a keyframe, then units that change, repeat or recolour."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from timegrid.codecs import entropy, pack
from timegrid.model import COLOURS, GLYPHS, MAX_DURATION

PALETTE, RAW, DELTA, REPEAT, CODED = "palette", "raw", "delta", "repeat", "coded"
#: Fixed values of the format: flag of a frame unit, its encodings, bytes of a palette, the first glyph's character.
FRAME, KINDS, PALETTE_BYTES, GLYPH_BASE = 0x80, (RAW, DELTA, REPEAT, CODED), 48, 0x80
MAX_SPAN = 255


@dataclass
class Frame:
    """A frame in effect: its planes, the palette that it is shown with, and how long it lasts."""

    glyph: np.ndarray
    fg: np.ndarray
    bg: np.ndarray
    palette: bytes
    duration: int


def cells(frame: Frame) -> np.ndarray:
    """Two bytes a cell, as a delta writes it."""
    return np.stack([frame.glyph + GLYPH_BASE, frame.bg << 4 | frame.fg], 1).astype(np.uint8)


def spans(old: Frame, new: Frame, width: int) -> list[tuple[int, int]]:
    """(start, length) of stretches of cells that differ; none crosses a row's end or exceeds MAX_SPAN."""
    changed = np.flatnonzero((cells(old) != cells(new)).any(1))
    if not len(changed):
        return []
    edge = np.concatenate([[True], (np.diff(changed) > 1) | (changed[1:] % width == 0)])
    first = np.flatnonzero(edge)
    out = []
    for a, b in zip(first, np.append(first[1:], len(changed)), strict=True):
        out += [(int(changed[k]), int(min(MAX_SPAN, b - k))) for k in range(a, b, MAX_SPAN)]
    return out


def _unit(kind: str, duration: int, body: bytes = b"") -> bytes:
    return bytes([FRAME | KINDS.index(kind) << 4]) + duration.to_bytes(2, "little") + body


def encode(frames: Sequence[Frame], width: int, height: int, coded: bool = False) -> bytes:
    """The payload of frames: a keyframe, then for each one the smallest unit that leads to it, recoloured where needed."""
    out = [width.to_bytes(2, "little"), height.to_bytes(2, "little")]
    old = None
    for frame in frames:
        left = frame.duration
        if old is None or frame.palette != old.palette:
            out.append(b"\x00" + frame.palette)
        packed = pack.pack_planes(frame.glyph, frame.fg, frame.bg)
        if old is None:
            kind, body = RAW, packed
            if coded:
                planes = ((frame.glyph, GLYPHS), (frame.fg, COLOURS), (frame.bg, COLOURS))
                body = b"".join(entropy.encode_plane(p, n, width) for p, n in planes)
                kind, body = CODED, len(body).to_bytes(3, "little") + body
        else:
            found, data = spans(old, frame, width), cells(frame)
            delta = len(found).to_bytes(2, "little") + b"".join(s.to_bytes(2, "little") + bytes([n]) + data[s : s + n].tobytes() for s, n in found)
            kind, body = (REPEAT, b"") if not found else (DELTA, delta) if len(delta) < len(packed) else (RAW, packed)
        out.append(_unit(kind, min(left, MAX_DURATION), body))
        left -= min(left, MAX_DURATION)
        while left > 0:
            out.append(_unit(REPEAT, min(left, MAX_DURATION)))
            left -= min(left, MAX_DURATION)
        old = frame
    return b"".join(out)


def units(payload: bytes, strict: bool = True) -> list[dict]:
    """The units of a payload as dicts of timegrid.model.UNIT. strict refuses palettes that no frame follows."""
    width, height = int.from_bytes(payload[:2], "little"), int.from_bytes(payload[2:4], "little")
    n, at, out = width * height, 4, []
    if not n:
        raise ValueError("an empty grid")

    def take(size: int) -> bytes:
        nonlocal at
        if at + size > len(payload):
            raise ValueError("the unit ends early")
        at += size
        return payload[at - size : at]

    keyed = painted = False
    while at < len(payload):
        flags = take(1)[0]
        unit = dict.fromkeys(("kind", "duration", "palette", "glyph", "fg", "bg", "spans"))
        if not flags & FRAME:
            if strict and out and out[-1]["kind"] == PALETTE:
                raise ValueError("a palette follows a palette")
            out.append(unit | {"kind": PALETTE, "palette": take(PALETTE_BYTES)})
            painted = True
            continue
        number = flags >> 4 & 7
        if number >= len(KINDS):
            raise ValueError(f"unknown encoding {number}")
        unit |= {"kind": KINDS[number], "duration": int.from_bytes(take(2), "little")}
        if not painted:
            raise ValueError("a frame without palette")
        if unit["kind"] == RAW:
            planes = pack.unpack_planes(take(sum(pack.plane_sizes(n))), n)
        elif unit["kind"] == CODED:
            body, planes, place = take(int.from_bytes(take(3), "little")), [], 0
            for symbols in (GLYPHS, COLOURS, COLOURS):
                plane, place = entropy.decode_plane(body, place, n, symbols, width)
                planes.append(plane)
        if unit["kind"] in (RAW, CODED):
            keyed = True
            unit |= {k: p.tobytes() for k, p in zip(("glyph", "fg", "bg"), planes, strict=True)}
        elif not keyed:
            raise ValueError("a change before the keyframe")
        elif unit["kind"] == DELTA:
            unit["spans"] = []
            for _ in range(int.from_bytes(take(2), "little")):
                start, size = int.from_bytes(take(2), "little"), take(1)[0]
                if start % width + size > width or start + size > n:
                    raise ValueError("a span crosses a row's end")
                unit["spans"].append({"start": start, "cells": take(2 * size)})
        out.append(unit)
    if not keyed:
        raise ValueError("no keyframe")
    if strict and out[-1]["kind"] == PALETTE:
        raise ValueError("a palette ends the units")
    return out


def decode(payload: bytes, strict: bool = True) -> list[Frame]:
    """Every frame in effect: deltas are replayed, a palette counts from the next frame on."""
    now, palette, out = None, b"", []
    for unit in units(payload, strict):
        if unit["kind"] == PALETTE:
            palette = unit["palette"]
            continue
        if unit["glyph"] is not None:
            now = [np.frombuffer(unit[k], np.uint8).copy() for k in ("glyph", "fg", "bg")]
        for span in unit["spans"] or ():
            pairs = np.frombuffer(span["cells"], np.uint8).reshape(-1, 2)
            at = slice(span["start"], span["start"] + len(pairs))
            now[0][at], now[1][at], now[2][at] = pairs[:, 0] - GLYPH_BASE, pairs[:, 1] & 15, pairs[:, 1] >> 4
        out.append(Frame(*[p.copy() for p in now], palette, unit["duration"]))
    return out
