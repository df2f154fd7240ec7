"""Pictures as grids of two-colour cells: adaptive palettes, encoding, rendering, and perceptual distance."""

from __future__ import annotations

import numpy as np

from timegrid.codecs.gop import GLYPH_BASE
from timegrid.functions.scalars import CONES
from timegrid.functions.scalars import OKLAB as ROOTS

COLOURS, DITHER = 16, 0.25
ROWS, COLS = 3, 2


def linear(rgb: np.ndarray) -> np.ndarray:
    c = np.asarray(rgb, float) / 255
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)


def oklab(rgb: np.ndarray) -> np.ndarray:
    return np.cbrt(linear(rgb) @ np.array(CONES).T) @ np.array(ROOTS).T


def split_palette(points: np.ndarray, weight: np.ndarray, sums: np.ndarray, squares: np.ndarray, colours: int = COLOURS) -> np.ndarray:
    """Colours that stand for a histogram: boxes split where it lowers the sum of squared errors most, as weighted means.

    points: histogram cells (n, 3); weight, sums (n, 3), squares: each cell's count, channel sums and sum of squares. All
    are what operators.aggregates.moments gives for colours shifted right by four bits, so there are 4096 cells at most
    however many pixels were counted. Means are rounded half to even; fewer boxes than colours repeat the last.
    """
    def best_cut(box: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
        found = None
        total_w, total_s = weight[box].sum(), sums[box].sum(0)
        base = (total_s**2).sum() / total_w
        for axis in range(3):
            order = box[np.argsort(points[box, axis], kind="stable")]
            at = points[order, axis]
            cuts = np.flatnonzero(at[1:] != at[:-1])
            if not len(cuts):
                continue
            w, s = weight[order].cumsum()[cuts], sums[order].cumsum(0)[cuts]
            gain = (s**2).sum(1) / w + ((total_s - s) ** 2).sum(1) / (total_w - w) - base
            k = int(gain.argmax())
            if found is None or gain[k] > found[0]:
                found = (float(gain[k]), order[: cuts[k] + 1], order[cuts[k] + 1 :])
        return found

    weight, sums = np.asarray(weight, float), np.asarray(sums, float)
    boxes = [np.arange(len(points))] if len(points) else []
    cuts = [best_cut(b) for b in boxes]
    while boxes and len(boxes) < colours:
        k = max(range(len(boxes)), key=lambda i: (cuts[i][0] if cuts[i] else -1.0, -i))
        if not cuts[k] or cuts[k][0] <= 0:
            break
        _, a, b = cuts[k]
        boxes[k : k + 1], cuts[k : k + 1] = [a, b], [best_cut(a), best_cut(b)]
    means = [np.rint(sums[b].sum(0) / weight[b].sum()) for b in boxes] or [np.zeros(3)]
    return np.array(means + [means[-1]] * (colours - len(means))).astype(np.uint8)


def palette_of(rgb: np.ndarray, colours: int = COLOURS) -> np.ndarray:
    """The palette of one picture."""
    flat = np.asarray(rgb).reshape(-1, 3).astype(np.int64)
    cell = (flat >> 4) @ [256, 16, 1]
    keys, inverse, weight = np.unique(cell, return_inverse=True, return_counts=True)
    sums = np.stack([np.bincount(inverse, flat[:, c]) for c in range(3)], 1)
    squares = np.bincount(inverse, (flat**2).sum(1))
    return split_palette(np.stack([keys >> 8, keys >> 4 & 15, keys & 15], 1), weight, sums, squares, colours)


def noise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Thresholds in [0, 1) that depend on the place only."""
    v = 52.9829189 * np.modf(0.06711056 * x + 0.00583715 * y)[0]
    return np.modf(v)[0]


def encode_cells(rgb: np.ndarray, palette: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(glyph, fg, bg) of each cell of 3 x 2 pixels, in rows. glyph is 0 to 31; the last pixel always shows bg.

    A cell takes the pair of palette colours whose mixture, pixel by pixel, comes nearest in OKLab: squared distance to the
    line between them plus DITHER times the spread that mixing brings. All pairs are tried, `block` cells at a time. The
    mixture is taken in linear light and set against the place's threshold.
    """
    h, w = rgb.shape[0] // ROWS, rgb.shape[1] // COLS
    sub = rgb[: h * ROWS, : w * COLS].reshape(h, ROWS, w, COLS, 3).transpose(0, 2, 1, 3, 4).reshape(-1, ROWS * COLS, 3)
    y, x = np.divmod(np.arange(h * w), w)
    place = np.arange(ROWS * COLS)
    thr = noise(x[:, None] * COLS + place % COLS, y[:, None] * ROWS + place // COLS)
    tones, light = oklab(palette), linear(palette)
    first, second = np.triu_indices(len(palette))
    a, d = tones[first], tones[second] - tones[first]
    length = (d**2).sum(1)
    out = [np.empty(h * w, np.uint8) for _ in range(3)]
    for lo in range(0, h * w, block):
        part = slice(lo, min(lo + block, h * w))
        q = oklab(sub[part])[:, :, None] - a
        t = np.clip((q * d).sum(-1) / np.where(length == 0, 1, length), 0, 1)
        off = ((q - t[..., None] * d) ** 2).sum(-1)
        best = (off + DITHER * t * (1 - t) * length).sum(1).argmin(1)
        i, j = first[best], second[best]
        line = light[j] - light[i]
        norm = (line**2).sum(1)
        mix = ((linear(sub[part]) - light[i][:, None]) * line[:, None]).sum(-1) / np.where(norm == 0, 1, norm)[:, None]
        on = np.clip(mix, 0, 1) > thr[part]
        swap = on[:, -1].copy()
        on ^= swap[:, None]
        out[0][part] = (on[:, :-1] << np.arange(5)).sum(1)
        out[1][part], out[2][part] = np.where(swap, i, j), np.where(swap, j, i)
    return out[0], out[1], out[2]


def render_cells(glyph: np.ndarray, fg: np.ndarray, bg: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """The picture that a grid of cells shows."""
    on = (glyph.astype(int)[:, None] % GLYPH_BASE >> np.arange(6)) & (np.arange(6) < 5)
    shown = np.asarray(palette)[np.where(on, fg[:, None], bg[:, None])]
    return shown.reshape(-1, width, ROWS, COLS, 3).transpose(0, 2, 1, 3, 4).reshape(-1, width * COLS, 3).astype(np.uint8)


#: Fixed values of S-CIELAB: sRGB to XYZ, white, XYZ to opponent colours, and each channel's (half-width in degrees, weight).
XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])
OPPONENT = np.array([[0.2787336, 0.7218031, -0.1065520], [-0.4487736, 0.2898056, 0.0771569], [0.0859513, -0.5899859, 0.5011089]])
BLURS = (
    ((0.0500, 1.00327), (0.2250, 0.114416), (7.0000, -0.117686)),
    ((0.0685, 0.616725), (0.8260, 0.383275)),
    ((0.0920, 0.567885), (0.6451, 0.432115)),
)


def _blurred(plane: np.ndarray, terms: tuple, per_degree: float) -> np.ndarray:
    widths = [max(half * per_degree - 1, 1e-6) / (2 * np.sqrt(np.log(2))) for half, _ in terms]
    reach = min(int(np.ceil(3 * max(widths))), min(plane.shape) - 1)
    x = np.arange(-reach, reach + 1)
    bells = [np.exp(-((x / s) ** 2)) for s in widths]
    kernel = sum(weight * b / b.sum() for b, (_, weight) in zip(bells, terms, strict=True))
    for axis in (0, 1):
        edge = [(reach, reach) if axis == k else (0, 0) for k in (0, 1)]
        views = np.lib.stride_tricks.sliding_window_view(np.pad(plane, edge, mode="edge"), len(kernel), axis)
        plane = views @ kernel[::-1]
    return plane


def perceived(rgb: np.ndarray, per_degree: float = 14.0) -> np.ndarray:
    """CIELAB of a picture seen from afar: each opponent channel blurred as the eye does."""
    opponent = linear(rgb) @ (OPPONENT @ XYZ).T
    seen = np.stack([_blurred(opponent[..., k], BLURS[k], per_degree) for k in range(3)], -1)
    v = seen @ np.linalg.inv(OPPONENT).T / WHITE
    f = np.where(v > (6 / 29) ** 3, np.cbrt(v), v * (29 / 6) ** 2 / 3 + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def mean_difference(a: np.ndarray, b: np.ndarray, per_degree: float = 14.0) -> float:
    """The mean perceptual distance of two pictures."""
    return float(np.sqrt(((perceived(a, per_degree) - perceived(b, per_degree)) ** 2).sum(-1)).mean())
