"""Entropy-coded planes of small symbols: spatial prediction, run lengths, and a range coder of 12-bit frequencies."""

from __future__ import annotations

import math

import numpy as np

#: Fixed values of the format: filters, modes, the frequencies' sum, the coder's lower bound.
PLAIN, LEFT, UP = 0, 1, 2
RUNS, CELLS = 0, 1
TOTAL, LOWER = 4096, 1 << 16


def shares(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to TOTAL in proportion to counts, at least 1 for each symbol that occurs."""
    counts = np.asarray(counts, np.int64)
    some = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(some):
        return out
    ideal = counts[some] * (TOTAL / counts.sum())
    f = np.maximum(1, np.floor(ideal)).astype(np.int64)
    rank = np.lexsort((some, -counts[some]))
    short = TOTAL - int(f.sum())
    if short > 0:
        whole, rest = divmod(short, len(some))
        f += whole
        f[rank[:rest]] += 1
    while short < 0:
        can = rank[f[rank] > 1][:-short]
        f[can] -= 1
        short += len(can)
    out[some] = f
    return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of maximal runs."""
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[edges], np.diff(np.append(edges, len(values)))


class Table:
    """Symbols in the order of their frequencies, the highest first, with their intervals."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = np.asarray(symbols, np.int64), np.asarray(freq, np.int64)
        if int(self.freq.sum()) != TOTAL:
            raise ValueError("frequencies don't add up")
        self.start = np.cumsum(self.freq) - self.freq

    @classmethod
    def of(cls, stream: np.ndarray) -> Table:
        freq = shares(np.bincount(stream))
        some = np.flatnonzero(freq)
        order = some[np.lexsort((some, -freq[some]))]
        return cls(order, freq[order])

    def head(self) -> bytes:
        body = b"".join(bytes([s]) + int(f).to_bytes(2, "little") for s, f in zip(self.symbols, self.freq, strict=True))
        return bytes([len(self.symbols)]) + body

    def encode(self, stream: np.ndarray) -> bytes:
        place = {int(s): (int(f), int(b)) for s, f, b in zip(self.symbols, self.freq, self.start, strict=True)}
        state, tail = LOWER, bytearray()
        for symbol in reversed(stream.tolist()):
            f, b = place[symbol]
            while state >= f << 12:
                tail.append(state & 255)
                state >>= 8
            q, r = divmod(state, f)
            state = q * TOTAL + b + r
        return state.to_bytes(4, "big") + bytes(reversed(tail))

    def decode(self, data: bytes, n: int) -> np.ndarray:
        slots = np.repeat(np.arange(len(self.symbols)), self.freq).tolist()
        freq, start, symbols = self.freq.tolist(), self.start.tolist(), self.symbols.tolist()
        if len(data) < 4:
            raise ValueError("no coder state")
        state, at, out = int.from_bytes(data[:4], "big"), 4, bytearray()
        try:
            for _ in range(n):
                high, slot = divmod(state, TOTAL)
                k = slots[slot]
                out.append(symbols[k])
                state = freq[k] * high + slot - start[k]
                while state < LOWER:
                    state = state << 8 | data[at]
                    at += 1
        except IndexError as e:
            raise ValueError("the coded symbols end early") from e
        return np.frombuffer(bytes(out), np.uint8)


def predicted(plane: np.ndarray, width: int, how: int, match: int) -> np.ndarray:
    """The plane with `match` where a cell equals its left or upper neighbour."""
    if how == PLAIN:
        return plane
    rows = plane.reshape(-1, width)
    out = rows.copy()
    if how == LEFT:
        out[:, 1:][rows[:, 1:] == rows[:, :-1]] = match
    else:
        out[1:][rows[1:] == rows[:-1]] = match
    return out.ravel()


def restored(plane: np.ndarray, width: int, how: int, match: int) -> np.ndarray:
    """predicted() undone: each match takes the last cell before it, along its row or column, that is none."""
    if how == PLAIN:
        return plane
    rows = plane.reshape(-1, width)
    rows = rows.T if how == UP else rows
    source = np.where(rows != match, np.arange(rows.shape[1]), 0)
    out = np.take_along_axis(rows, np.maximum.accumulate(source, axis=1), 1)
    return np.ascontiguousarray(out.T if how == UP else out).ravel()


def entropy_bits(values: np.ndarray) -> float:
    """Order-0 entropy of all values together, in bits."""
    n = np.bincount(values)
    n = n[n > 0]
    return float(-(n * np.log2(n / n.sum())).sum()) if len(n) else 0.0


def estimate(stream: np.ndarray) -> int:
    """About how many bytes the stream takes in the better mode."""
    def size(x: np.ndarray) -> int:
        return 5 + 3 * len(np.unique(x)) + math.ceil(entropy_bits(x) / 8)

    values, lengths = runs(stream)
    return min(size(stream), size(values) + len(lengths))


def _body(stream: np.ndarray) -> bytes:
    def coded(x: np.ndarray) -> bytes:
        table = Table.of(x)
        data = table.encode(x)
        return table.head() + len(data).to_bytes(3, "little") + data

    values, lengths = runs(stream)
    tokens = b"".join(bytes([n]) if n < 255 else b"\xff" + int(n).to_bytes(2, "little") for n in lengths.tolist())
    options = [bytes([RUNS]) + coded(values) + tokens, bytes([CELLS]) + coded(stream)]
    return min(options, key=len)


def encode_plane(plane: np.ndarray, symbols: int, width: int = 0) -> bytes:
    """A plane of numbers below `symbols`. Predictors need rows of two cells, and two of them; runs are 65,535 long at most."""
    plane = np.asarray(plane, np.uint8)
    if not len(plane):
        raise ValueError("an empty plane")
    ways = [PLAIN, LEFT, UP] if width >= 2 and len(plane) >= 2 * width else [PLAIN]
    streams = [predicted(plane, width, how, symbols) for how in ways]
    best = min(range(len(ways)), key=lambda i: estimate(streams[i]))
    return bytes([ways[best]]) + _body(streams[best])


def decode_plane(data: bytes, at: int, n: int, symbols: int, width: int = 0) -> tuple[np.ndarray, int]:
    """The n cells of the plane at a place, and where it ends."""
    try:
        how, mode, k = data[at : at + 3]
        rows = np.frombuffer(data, np.dtype([("s", "u1"), ("f", "<u2")]), k, at + 3)
        at += 3 + 3 * k
        size = int.from_bytes(data[at : at + 3], "little")
    except ValueError as e:
        raise ValueError("the plane ends early") from e
    coded, at = data[at + 3 : at + 3 + size], at + 3 + size
    table = Table(rows["s"], rows["f"])
    if mode == CELLS:
        stream = table.decode(coded, n)
    else:
        lengths, total = [], 0
        while total < n:
            if at >= len(data):
                raise ValueError("run lengths end early")
            run, at = data[at], at + 1
            if run == 255:
                run, at = int.from_bytes(data[at : at + 2], "little"), at + 2
            lengths.append(run)
            total += run
        stream = np.repeat(table.decode(coded, len(lengths)), lengths)
        if total != n:
            raise ValueError("runs exceed the plane")
    return restored(stream, width, how, symbols), at
