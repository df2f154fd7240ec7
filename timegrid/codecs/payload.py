"""Compression of whole payloads: the size as a 32-bit number, then the stream."""

from __future__ import annotations

import bz2

from timegrid.model import BROTLI, BZIP2, LZ4, NONE

try:
    import brotli
except ImportError:
    brotli = None


def lz4_block(data: bytes) -> bytes:
    """A raw LZ4 block: greedy matches of four bytes or more, found by a table of their last places."""
    out, seen, at, lit, n = bytearray(), {}, 0, 0, len(data)
    # the format wants the last five bytes as literals, and no match to begin in the last twelve
    while at < n - 12:
        key = data[at : at + 4]
        back = seen.get(key)
        seen[key] = at
        if back is None or at - back > 65535:
            at += 1
            continue
        end = at + 4
        while end < n - 5 and data[end] == data[back + end - at]:
            end += 1
        _sequence(out, data[lit:at], end - at, at - back)
        at = lit = end
    _sequence(out, data[lit:], 0, 0)
    return bytes(out)


def _sequence(out: bytearray, literals: bytes, match: int, offset: int) -> None:
    def more(n: int) -> None:
        if n >= 15:
            out.extend(b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255]))

    long = match - 4 if match else 0
    out.append(min(15, len(literals)) << 4 | min(15, long))
    more(len(literals))
    out.extend(literals)
    if match:
        out.extend(offset.to_bytes(2, "little"))
        more(long)


def unlz4_block(data: bytes, size: int) -> bytes:
    """The bytes of a raw LZ4 block of `size` bytes; ValueError if it is damaged."""
    out, at = bytearray(), 0

    def length(n: int) -> int:
        nonlocal at
        step = 255 if n == 15 else 0
        while step == 255:
            step = data[at]
            at += 1
            n += step
        return n

    try:
        while at < len(data):
            token = data[at]
            at += 1
            n = length(token >> 4)
            if at + n > len(data):
                raise ValueError("literals end early")
            out += data[at : at + n]
            at += n
            if at == len(data):
                break
            offset = data[at] | data[at + 1] << 8
            at += 2
            n = length(token & 15) + 4
            if not 0 < offset <= len(out) or len(out) + n > size:
                raise ValueError("a match lies outside")
            piece = bytes(out[-offset:]) if offset >= n else bytes(out[-offset:]) * (n // offset + 1)
            out += piece[:n]
    except IndexError as e:
        raise ValueError("the block ends early") from e
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return bytes(out)


def compress(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if how == LZ4:
        stream = lz4_block(data)
    elif how == BZIP2:
        stream = bz2.compress(data)
    elif how == BROTLI and brotli:
        stream = brotli.compress(data)
    else:
        raise ValueError(f"compression {how} isn't available")
    return len(data).to_bytes(4, "little") + stream


def decompress(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if len(data) < 4:
        raise ValueError("no size")
    size, stream = int.from_bytes(data[:4], "little"), data[4:]
    if how == LZ4:
        return unlz4_block(stream, size)
    try:
        out = bz2.decompress(stream) if how == BZIP2 else brotli.decompress(stream) if how == BROTLI and brotli else None
    except OSError as e:
        raise ValueError("a damaged stream") from e
    if out is None:
        raise ValueError(f"compression {how} isn't available")
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return out
