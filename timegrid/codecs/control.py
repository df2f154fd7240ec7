"""Control frames: requests, capabilities, status, and what members of a shared room agree on."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from timegrid.codecs import gop
from timegrid.model import BROTLI, BZIP2, LZ4, MAX_PTS, NONE, VIDEO
from timegrid.sources.chunks import HEAD, MARK, read_head

#: Fixed values of the protocol: opcodes and states.
ROOM, CAPS, START, QUIT, ACK, ERROR, STATUS = range(1, 8)
WAITING, PLAYING, ENDED = range(3)
#: Which compression a type of chunk would rather have, the best first.
PREFERENCE = {0: (BROTLI, BZIP2, LZ4, NONE), 1: (BZIP2, BROTLI, LZ4, NONE)}


@dataclass(frozen=True)
class Room:
    url: str
    start: int | None = None
    end: int | None = None
    loop: bool = False
    sync: bool = False

    def pack(self) -> bytes:
        flags = self.loop | self.sync << 1 | (self.start is not None) << 2 | (self.end is not None) << 3
        times = b"".join(struct.pack("<I", t) for t in (self.start, self.end) if t is not None)
        return bytes([flags]) + times + self.url.encode()

    @classmethod
    def parse(cls, body: bytes) -> Room:
        flags, at, times = body[0], 1, []
        for bit in (4, 8):
            times.append(struct.unpack_from("<I", body, at)[0] if flags & bit else None)
            at += 4 * bool(flags & bit)
        return cls(body[at:].decode(), *times, bool(flags & 1), bool(flags & 2))

    def key(self) -> tuple:
        """What members of a shared room have in common."""
        return self.url, self.start, self.end, self.loop


_CAPS = "<BBBHBHHB"


@dataclass(frozen=True)
class Caps:
    want_video: bool = True
    want_audio: bool = True
    video: int = 0
    audio: int = 1
    channels: int = 1
    compress: int = 1
    width: int = 0
    height: int = 0
    fps: int = 0

    def pack(self) -> bytes:
        flags = self.want_video | self.want_audio << 1
        return struct.pack(_CAPS, flags, self.video, self.audio, self.channels, self.compress, self.width, self.height, self.fps)

    @classmethod
    def parse(cls, body: bytes) -> Caps:
        flags, *rest = struct.unpack_from(_CAPS, body)
        return cls(bool(flags & 1), bool(flags & 2), *rest)


def frame(opcode: int, body: bytes = b"") -> bytes:
    if opcode == MARK or not 0 <= opcode < 256 or len(body) > 0xFFFF:
        raise ValueError("no such opcode, or too long a body")
    return struct.pack("<BH", opcode, len(body)) + body


def status(state: int, origin: int | None = None) -> bytes:
    """A status frame; the clock's origin goes with PLAYING, and only then."""
    if (origin is not None) != (state == PLAYING) or origin is not None and not 0 <= origin <= MAX_PTS:
        raise ValueError("an origin goes with playing")
    return frame(STATUS, bytes([state]) + (origin.to_bytes(6, "little") if origin is not None else b""))


def printable(text: str) -> bytes:
    """An error's text as Latin-1, without what can't be shown."""
    return "".join(c if " " <= c <= "~" or "\xa0" <= c <= "\xff" else "?" for c in text).encode("latin-1")


def parse(message: bytes) -> dict:
    """A message as a dict: `kind`, and what it holds. A chunk is its own message."""
    if not message:
        raise ValueError("an empty message")
    if message[0] == MARK:
        pts, size, ctype, comp = read_head(message)
        if len(message) != HEAD + size:
            raise ValueError("not one chunk")
        return {"kind": "media", "pts": pts, "ctype": ctype, "comp": comp, "payload": message[HEAD:]}
    if len(message) < 3:
        raise ValueError("no frame head")
    opcode, size = struct.unpack_from("<BH", message)
    body = message[3 : 3 + size]
    if len(body) != size:
        raise ValueError("the frame ends early")
    try:
        if opcode == ROOM:
            return {"kind": "room"} | asdict(Room.parse(body))
        if opcode == CAPS:
            return {"kind": "caps"} | asdict(Caps.parse(body))
    except (IndexError, struct.error) as e:
        raise ValueError("the body ends early") from e
    if opcode == STATUS and size in (1, 7):
        return {"kind": "status", "state": body[0], "origin": int.from_bytes(body[1:], "little") if size == 7 else None}
    names = {START: "start", QUIT: "quit", ACK: "ack", ERROR: "error"}
    if opcode not in names:
        raise ValueError(f"unknown opcode {opcode}")
    return {"kind": names[opcode]} | ({"text": body.decode("latin-1")} if opcode == ERROR else {})


def agreed(members: Iterable[Caps]) -> dict:
    """What a shared room serves: roles that anyone wants, codings and compressions that all can take."""
    members = list(members)
    roles, inflate = 0, -1
    for m in members:
        roles |= m.channels if m.want_audio else 0
        inflate &= m.compress
    inflate = (inflate if members else 0) | 1
    coded = bool(members) and all(m.video & 1 for m in members)
    return {"roles": roles, "coded": coded} | {f"compress_{t}": next(c for c in order if inflate >> c & 1) for t, order in PREFERENCE.items()}


def carries_coded(ctype: int, comp: int, payload: bytes) -> bool:
    """Whether a chunk's keyframe is entropy coded, seen from its first bytes only."""
    if ctype != VIDEO or comp != NONE or len(payload) < 5:
        return False
    at = 4
    while at < len(payload) and not payload[at] & gop.FRAME:
        at += 1 + gop.PALETTE_BYTES
    return at < len(payload) and payload[at] >> 4 & 7 == gop.KINDS.index(gop.CODED)
