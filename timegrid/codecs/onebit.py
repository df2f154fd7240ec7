"""Audio of one bit a sample: each bit says whether to go up or down from an adaptive prediction."""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: fractional bits and floor of the step, and the decoder's low-pass weight.
PRECISION, FLOOR, SMOOTH = 10, 8, 140


class Predictor:
    """The state that both sides keep: a level and how strongly a bit moves it."""

    __slots__ = ("level", "force", "up")

    def __init__(self) -> None:
        self.level, self.force, self.up = 0, 0, False

    def move(self, up: bool) -> None:
        goal = 127 if up else -128
        level = self.level + (self.force * (goal - self.level) + (1 << PRECISION - 1) >> PRECISION)
        if level == self.level != goal:
            level += 1 if up else -1
        steady = up == self.up
        if steady:
            force = min(self.force + 1, (1 << PRECISION) - 1)
        else:
            force = max(self.force - 1, 0)
        self.level, self.force, self.up = level, max(force, FLOOR), up


def encode(samples: bytes) -> bytes:
    """Unsigned 8-bit samples as bits, the first one lowest; silence fills the last byte. State starts anew."""
    levels = np.frombuffer(samples, np.uint8).astype(int) - 128
    state, bits = Predictor(), []
    for level in np.pad(levels, (0, -len(levels) % 8)).tolist():
        up = level > state.level or level == state.level == 127
        bits.append(up)
        state.move(up)
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


def decode(data: bytes) -> bytes:
    """The samples of encode(), eight a byte, smoothed at turns and by a low-pass."""
    state, low, out = Predictor(), 0, []
    for up in np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(bool).tolist():
        before, turned = state.level, up != state.up
        state.move(up)
        heard = (state.level + before + 1) >> 1 if turned else state.level
        low += (heard - low) * SMOOTH + 128 >> 8
        out.append(low)
    return (np.clip(np.array(out, int), -128, 127) + 128).astype(np.uint8).tobytes()
