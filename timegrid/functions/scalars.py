"""Scalar functions of the engine, as column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, lo: int, hi: int, default: int) -> Column:
    """v within [lo, hi]; 0 stands for the default."""
    return F.when(v == 0, F.lit(default)).otherwise(F.greatest(F.lit(lo), F.least(v, F.lit(hi))))


def first_fault(rules: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first rule that a row breaks, null if none."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for broken, name in rules[1:]:
        out = out.when(broken, F.lit(name))
    return out


def preferred(mask: Column, order: Sequence[tuple[int, int]], none: int) -> Column:
    """The first choice whose bits are in the mask; order: (bits, choice)."""
    out = F.when(mask.bitwiseAND(order[0][0]) > 0, F.lit(order[0][1]))
    for bits, choice in order[1:]:
        out = out.when(mask.bitwiseAND(bits) > 0, F.lit(choice))
    return out.otherwise(F.lit(none))


def psnr(mse: Column, peak: float = 255.0) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / mse))


def rounded_mean(v: Column) -> Column:
    """Integer mean, halves up: (sum + n div 2) div n, towards minus infinity."""
    n = F.count(F.lit(1))
    return F.floor((F.sum(v) + F.floor(n / 2)) / n)


def truncated_mean(v: Column) -> Column:
    """Integer mean towards zero."""
    mean = F.sum(v) / F.count(F.lit(1))
    return F.when(mean < 0, F.ceil(mean)).otherwise(F.floor(mean))


def timecode(s: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = s.cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600), F.floor(s / 60)
    long = F.concat(hours.cast("string"), F.lit(":"), two(F.pmod(minutes, F.lit(60))), F.lit(":"), two(F.pmod(s, F.lit(60))))
    return F.when(s >= 3600, long).otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(F.pmod(s, F.lit(60)))))


def parse_duration(text: Column) -> Column:
    """Milliseconds of `90`, `90s`, `1m30s`, `3h2m`; null if nothing or zero is meant."""
    unit = lambda u: F.coalesce(F.regexp_extract(text, rf"(\d+){u}", 1).try_cast("long"), F.lit(0))
    plain = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
    parts = F.when(text.rlike(r"^(\d+h)?(\d+m)?(\d+s)?$"), unit("h") * 3600 + unit("m") * 60 + unit("s"))
    return F.nullif(F.coalesce(plain, parts) * 1000, F.lit(0))


def sanitize(name: Column, most: int = 120) -> Column:
    """A file name: reserved characters become _, ends are trimmed, `most` characters stay."""
    return F.substring(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]+', "_")), 1, most)


def printable(text: Column) -> Column:
    """Characters that Latin-1 can't print become ?."""
    return F.regexp_replace(text, r"[^\x20-\x7E\xA0-\xFF]", "?")


def linear(channel: Column) -> Column:
    """An 8-bit sRGB channel as linear light."""
    c = channel / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


#: Linear sRGB to cone responses, and their cube roots to OKLab.
CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def oklab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """OKLab coordinates of an 8-bit sRGB colour."""
    rgb = [linear(r), linear(g), linear(b)]
    dot = lambda m, v: sum((F.lit(x) * y for x, y in zip(m[1:], v[1:], strict=True)), F.lit(m[0]) * v[0])
    roots = [F.cbrt(dot(m, rgb)) for m in CONES]
    return {name: dot(m, roots) for name, m in zip("lab", OKLAB, strict=True)}


def noise(x: Column, y: Column) -> Column:
    """Interleaved gradient noise in [0, 1) of a cell."""
    fract = lambda v: v - F.floor(v)
    return fract(F.lit(52.9829189) * fract(F.lit(0.06711056) * x + F.lit(0.00583715) * y))


def little_endian(data: Column, at: int, n: int) -> Column:
    """The unsigned integer in n bytes from a 0-based place; null beyond the end."""
    bytes_ = [F.conv(F.hex(F.substring(data, at + i + 1, 1)), 16, 10).cast("long") for i in range(n)]
    return sum((b * (1 << (8 * i)) for i, b in enumerate(bytes_[1:], 1)), bytes_[0])


def plane_bytes(cells: Column) -> Column:
    """Bytes of three packed planes: 5-bit glyphs, eight in five bytes, and two of 4-bit colours."""
    return F.floor((cells + 7) / 8) * 5 + 2 * F.floor((cells + 1) / 2)


def stride(cost: Column, fps: int, headroom: float = 1.15) -> Column:
    """How many frames pass while one is worked on: every stride-th can be kept."""
    return F.greatest(F.lit(1), F.least(F.lit(fps), F.ceil(cost * fps * headroom))).cast("int")


def fraction(at: Column, whole: Column) -> Column:
    """at / whole within [0, 1]; 0 of nothing."""
    return F.coalesce(F.least(F.greatest(at / F.nullif(whole, F.lit(0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def positive_integer(text: Column) -> Column:
    """The number if the text is digits only and at least 1."""
    return F.when(text.rlike("^[0-9]+$") & (text.try_cast("long") >= 1), text.try_cast("long"))


def size(text: Column, names: dict[str, tuple[int, int]]) -> tuple[Column, Column]:
    """Width and height of a name or of `WxH`; nulls if it is neither."""
    out = []
    for k in (0, 1):
        known = F.create_map(*[F.lit(x) for name, wh in names.items() for x in (name, wh[k])])
        out.append(F.coalesce(known[text], F.regexp_extract(text, r"^(\d+)x(\d+)$", k + 1).try_cast("int")))
    return out[0], out[1]


def filled(pattern: str, **values: Column) -> Column:
    """A text with {name} replaced by each value."""
    out = F.lit(pattern)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def convolved(value: str, kernel: Sequence[float], window) -> Column:
    """A value's weighted sum with its neighbours in a window's order; beyond the ends the row itself stands in."""
    middle = len(kernel) // 2
    terms = [F.lit(k) * (F.coalesce(F.lag(value, middle - i).over(window), F.col(value)) if i != middle else F.col(value)) for i, k in enumerate(kernel)]
    return sum(terms[1:], terms[0])


def packed(v: Column, n: int) -> Column:
    """A number as n bytes, the lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)]))
