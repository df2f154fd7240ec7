"""Audio payloads: a codec and a role, then samples; and how roles are cut from a source's channels."""

from __future__ import annotations

import numpy as np

from timegrid.codecs import onebit

PCM8, ONEBIT = 0, 1
LOW_FREQUENCY = 3
#: The source channels that can stand for a role, in order; any other role is the downmix.
SOURCES = {1: (0,), 2: (1,), 3: (2,), 4: (3,), 5: (4, 0), 6: (5, 1), 7: (6, 4, 0), 8: (7, 5, 1)}


def source_channel(role: int, channels: int) -> int | None:
    return next((c for c in SOURCES.get(role, ()) if c < channels), None)


def downmix(samples: np.ndarray) -> np.ndarray:
    """The mean of a frame's channels without low frequencies, halves up; samples: (n, channels), 0 to 255."""
    keep = np.arange(samples.shape[1]) != (LOW_FREQUENCY if samples.shape[1] > LOW_FREQUENCY else -1)
    total, n = samples[:, keep].astype(int).sum(1), int(keep.sum())
    return ((total + n // 2) // n).astype(np.uint8)


def cut_roles(samples: np.ndarray, mask: int) -> dict[int, np.ndarray]:
    """The samples of each role of a mask (of none: mono)."""
    roles = [r for r in range(9) if mask >> r & 1] or [0]
    found = {r: source_channel(r, samples.shape[1]) for r in roles}
    return {r: downmix(samples) if c is None else samples[:, c] for r, c in found.items()}


def payload(role: int, codec: int, samples: bytes) -> bytes:
    if not 0 <= role < 16 or codec not in (PCM8, ONEBIT):
        raise ValueError("no such role or codec")
    return bytes([codec << 4 | role]) + (onebit.encode(samples) if codec == ONEBIT else samples)


def parse(data: bytes) -> tuple[int, int, bytes]:
    """(role, codec, samples from 0 to 255)."""
    if not data:
        raise ValueError("no audio head")
    codec, role = data[0] >> 4, data[0] & 15
    if codec not in (PCM8, ONEBIT):
        raise ValueError(f"unknown codec {codec}")
    return role, codec, onebit.decode(data[1:]) if codec == ONEBIT else data[1:]


def widened(samples: bytes) -> np.ndarray:
    """Unsigned 8-bit samples as signed 16-bit ones."""
    return ((np.frombuffer(samples, np.uint8).astype(np.int16) - 128) * 256).astype(np.int16)
