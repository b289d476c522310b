"""Array kernels on images and boxes: numpy on (h, w) or (h, w, c) arrays.

No images come with the engine's tables, so these are tested on made-up arrays. They
run inside Arrow or Pandas UDFs, one image or one group of boxes at a time.
"""

from __future__ import annotations

import numpy as np


def grey(image: np.ndarray) -> np.ndarray:
    """BGR to luminance."""
    return image.astype(np.float64) if image.ndim == 2 else image[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])


def crop(image: np.ndarray, y: int, h: int, x: int, w: int) -> np.ndarray:
    """A region, clamped to the image."""
    rows, cols = image.shape[:2]
    return image[max(0, y) : min(rows, y + h), max(0, x) : min(cols, x + w)]


def channels(image: np.ndarray) -> np.ndarray:
    """The image as (h, w, c) floats."""
    return np.atleast_3d(image).astype(np.float64)


def conv(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with a small kernel, edges mirrored."""
    kh, kw = kernel.shape
    wide = np.pad(image.astype(np.float64), ((kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2)), mode="reflect" if min(image.shape) > max(kh, kw) // 2 else "edge")
    windows = np.lib.stride_tricks.sliding_window_view(wide, (kh, kw))
    return np.einsum("ijkl,kl->ij", windows, kernel)


SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
#: Second derivative in both directions: strong at corners and diagonal strokes.
MIXED = np.array([[1, 0, -1], [0, 0, 0], [-1, 0, 1]], float)


def edges(image: np.ndarray) -> np.ndarray:
    """Gradient magnitude."""
    return np.hypot(conv(image, SOBEL), conv(image, SOBEL.T))


def window_extreme(image: np.ndarray, h: int, w: int, least: bool) -> np.ndarray:
    """Least or greatest value in the h x w window around each pixel; what lies outside doesn't count."""
    fill = np.inf if least else -np.inf
    wide = np.pad(image.astype(np.float64), ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)), constant_values=fill)
    take = np.min if least else np.max
    rows = take(np.lib.stride_tricks.sliding_window_view(wide, h, axis=0), axis=-1)
    return take(np.lib.stride_tricks.sliding_window_view(rows, w, axis=1), axis=-1)


def erode(image: np.ndarray, h: int, w: int) -> np.ndarray:
    return window_extreme(image, h, w, True)


def dilate(image: np.ndarray, h: int, w: int) -> np.ndarray:
    return window_extreme(image, h, w, False)


def opened(mask: np.ndarray, h: int, w: int) -> np.ndarray:
    """What of a mask an h x w box fits into."""
    thin = erode(mask, h, w)
    return dilate(thin[::-1, ::-1], h, w)[::-1, ::-1] > 0  # mirrored: even boxes lie the other way round their centre


def spread_to(image: np.ndarray, low: float = 0, high: float = 255) -> np.ndarray:
    """Values moved and scaled to low..high; a flat image becomes low."""
    least, most = float(image.min()), float(image.max())
    return np.full(image.shape, float(low)) if most <= least else low + (image - least) * ((high - low) / (most - least))


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, separable."""
    r = max(1, int(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    return conv(conv(np.pad(image, r, mode="edge"), k[None, :]), k[:, None])[r:-r, r:-r]


def ncc(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Mean-centred normalised correlation, over a mask where given; 0 where one is flat."""
    x, y = (v.astype(np.float64)[mask] if mask is not None else v.astype(np.float64).ravel() for v in (a, b))
    if not x.size:
        return 0.0
    x, y = x - x.mean(), y - y.mean()
    norm = np.sqrt((x**2).sum() * (y**2).sum())
    return float((x * y).sum() / norm) if norm > 0 else 0.0


def edge_ncc(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Correlation of the mixed derivatives of two images, not centred; masked pixels don't count."""
    x, y = (conv(grey(v), MIXED) * (1.0 if mask is None else mask) for v in (a, b))
    return float((x * y).sum() / (np.sqrt((x**2).sum() * (y**2).sum()) + 1e-6))


def iou(a: np.ndarray, b: np.ndarray, threshold: float = 127) -> float:
    x, y = a > threshold, b > threshold
    return float((x & y).sum() / ((x | y).sum() + 1e-6))


def hu_moments(image: np.ndarray) -> np.ndarray:
    """The seven moments that shift, scale and rotation don't change."""
    m = image.astype(np.float64)
    total = m.sum()
    if total == 0:
        return np.zeros(7)
    y, x = np.mgrid[: m.shape[0], : m.shape[1]]
    x, y = x - (x * m).sum() / total, y - (y * m).sum() / total
    eta = lambda p, q: (x**p * y**q * m).sum() / total ** (1 + (p + q) / 2)
    n20, n02, n11, n30, n03, n21, n12 = (eta(*pq) for pq in ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2)))
    a, b, c, d = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    return np.array(
        [n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, c**2 + d**2, a**2 + b**2, c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2), (n20 - n02) * (a**2 - b**2) + 4 * n11 * a * b, d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2)]
    )


def hu_distance(a: np.ndarray, b: np.ndarray, threshold: float = 127) -> float:
    """Sum of differences of the moments, on a log scale, of the pixels above threshold."""
    logs = [-np.sign(h) * np.log10(np.abs(h) + 1e-10) for h in (hu_moments(a > threshold), hu_moments(b > threshold))]
    return float(np.abs(logs[0] - logs[1]).sum())


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7, span: float = 255) -> float:
    """Structural similarity: mean over all windows that lie inside, and over channels."""
    x, y = channels(a), channels(b)
    window = min(window, *x.shape[:2])
    n, box = window * window, np.ones((window, window))
    mean = lambda v: np.stack([correlate(v[..., c], box) for c in range(v.shape[2])], -1) / n
    mx, my, unbiased = mean(x), mean(y), n / max(1, n - 1)
    vx, vy, cov = unbiased * (mean(x * x) - mx * mx), unbiased * (mean(y * y) - my * my), unbiased * (mean(x * y) - mx * my)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def resampling(n: int, to: int, area: bool) -> np.ndarray:
    """A (to, n) matrix: each new pixel as the mean of those it covers, or between its two neighbours."""
    size = n / to
    if area:
        low, high = np.arange(to)[:, None] * size, (np.arange(to)[:, None] + 1) * size
        return np.clip(np.minimum(np.arange(n) + 1, high) - np.maximum(np.arange(n), low), 0, None) / size
    at = np.clip((np.arange(to) + 0.5) * size - 0.5, 0, n - 1)
    return np.clip(1 - np.abs(at[:, None] - np.arange(n)), 0, None)


def resize(image: np.ndarray, h: int, w: int, nearest: bool = False) -> np.ndarray:
    """Smaller by area, larger between neighbours; or the nearest pixel, for masks."""
    rows, cols = image.shape[:2]
    if nearest:
        return image[np.arange(h) * rows // h][:, np.arange(w) * cols // w]
    down, across = resampling(rows, h, h < rows), resampling(cols, w, w < cols)
    out = np.einsum("ij,jkc,lk->ilc", down, channels(image), across)
    return out if image.ndim == 3 else out[..., 0]


def local_maxima(scores: np.ndarray, threshold: float) -> np.ndarray:
    """(row, col) of scores that no neighbour exceeds and that reach threshold."""
    return np.argwhere((scores == dilate(scores, 3, 3)) & (scores >= threshold))


def correlate(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sum of products at each place where kernel fits into image."""
    spectrum = np.fft.rfft2(image) * np.conj(np.fft.rfft2(kernel, s=image.shape))
    return np.fft.irfft2(spectrum, s=image.shape)[: image.shape[0] - kernel.shape[0] + 1, : image.shape[1] - kernel.shape[1] + 1]


def match_scores(image: np.ndarray, template: np.ndarray, mask: np.ndarray | None = None, centred: bool = True) -> np.ndarray:
    """Correlation of a template at each place it fits, over all channels; masked pixels don't count, flat places score 0."""
    x, t = channels(image), channels(template)
    keep = np.ones(t.shape[:2]) if mask is None else mask.astype(np.float64)
    n, top, energy, own = keep.sum(), 0.0, 0.0, 0.0
    for c in range(t.shape[2]):
        part = (t[..., c] - (t[..., c] * keep).sum() / n if centred else t[..., c]) * keep
        squares, total = correlate(x[..., c] ** 2, keep), correlate(x[..., c], keep)
        top = top + correlate(x[..., c], part)
        energy = energy + (squares - total**2 / n if centred else squares)
        own += (part**2).sum()
    norm = np.sqrt(np.clip(energy, 0, None) * own)
    return np.clip(np.divide(top, norm, out=np.zeros_like(norm), where=norm > 1e-3), -1, 1)


def linspace(low: float, high: float, n: int) -> list[float]:
    return [low] if n == 1 else [low + i * (high - low) / (n - 1) for i in range(n)]


def scales_of(image_height: int, template_height: int, low: float, high: float, steps: int) -> list[float]:
    """Scales at which a template is low to high of the image's height."""
    if not steps:
        raise ValueError("the number of scales is needed")
    return linspace(image_height * low / template_height, image_height * high / template_height, steps)


def match_template(image, template, mask=None, threshold=0.7, scales=(1.0,), overlap=0.3, least_pixels=10, least_share=0.15, centred=True, least_edges=0.3):
    """(x1, y1, x2, y2, score, scale, edge score) of a template at several scales, best first, overlaps removed.

    With a mask, places whose edges correlate less than least_edges are left out.
    """
    found = []
    for s in scales:
        h, w = round(template.shape[0] * s), round(template.shape[1] * s)
        if h < 3 or w < 3 or h > image.shape[0] or w > image.shape[1]:
            continue
        t, m = resize(template, h, w), None if mask is None else resize(mask.astype(bool), h, w, nearest=True)
        if m is not None and (m.sum() < least_pixels or m.mean() < least_share):
            continue
        scores = match_scores(image, t, m, centred)
        for y, x in local_maxima(scores, threshold).tolist():
            alike = 0.0 if m is None else edge_ncc(image[y : y + h, x : x + w], t, m)
            if m is None or alike >= least_edges:
                found.append((x, y, x + w, y + h, float(scores[y, x]), s, alike))
    return [found[i] for i in nms([f[:4] for f in found], [f[4] for f in found], overlap)]


def prepared(image: np.ndarray, margin: tuple[int, int]) -> tuple[np.ndarray, np.ndarray | None]:
    """A reference image without its margins (rows, columns), and the mask of its opaque pixels where it has alpha."""
    rows, cols = image.shape[:2]
    inner = image[margin[0] : rows - margin[0], margin[1] : cols - margin[1]]
    return (inner[..., :3], inner[..., 3] > 10) if image.ndim == 3 and image.shape[2] == 4 else (inner, None)


def nms(boxes, scores, overlap: float = 0.3) -> list[int]:
    """Indices kept: best score first (ties by place); a box goes if over overlap of its own area is under a kept one."""
    left, kept = sorted(range(len(boxes)), key=lambda i: (-scores[i], i)), []
    while left:
        top, *rest = left
        kept.append(top)
        a = boxes[top]
        left = []
        for i in rest:
            b = boxes[i]
            inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            area = (b[2] - b[0]) * (b[3] - b[1])
            if not (area > 0 and inter / area > overlap):
                left.append(i)
    return kept


def labelled(mask: np.ndarray) -> list[tuple[tuple[int, int, int, int, int], list[tuple[int, int, int]]]]:
    """((x, y, w, h, area), its runs (y, from, to)) of each 8-connected blob, by its first pixel."""
    parent: list[int] = []

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs, before = [], []
    for y, row in enumerate(mask.astype(bool)):
        bounds = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        here = []
        for a, z in zip(bounds[::2].tolist(), bounds[1::2].tolist(), strict=True):
            k = len(parent)
            parent.append(k)
            for pa, pz, pk in before:
                if pa <= z and a <= pz:
                    parent[find(max(find(k), find(pk)))] = min(find(k), find(pk))
            here.append((a, z, k))
            runs.append((y, a, z, k))
        before = here
    own: dict[int, list[tuple[int, int, int]]] = {}
    for y, a, z, k in runs:
        own.setdefault(find(k), []).append((y, a, z))
    out = []
    for r in own.values():
        x, y = min(a for _, a, _ in r), r[0][0]
        out.append(((x, y, max(z for *_, z in r) - x, r[-1][0] + 1 - y, sum(z - a for _, a, z in r)), r))
    return out


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of each 8-connected blob, by its first pixel."""
    return [box for box, _ in labelled(mask)]


def fits(box: tuple, total: int, least: float, most: float, fill: float, large: float, wide: float, tall: float) -> bool:
    """Whether a blob's share of the image, its filled share of its box and, if it is large times least, its proportions are in bounds."""
    _, _, w, h, area = box
    share, ratio = area / total, max(w, h) / max(1, min(w, h))
    return least <= share <= most and area / (w * h) >= fill and not (share > least * large and ratio > (wide if w >= h else tall))


def blobs(mask: np.ndarray, least: float, most: float, fill: float = 0.0, large: float = 5.0, wide: float = np.inf, tall: float = np.inf) -> list[tuple]:
    """The blobs that fit."""
    return [box for box in components(mask) if fits(box, mask.size, least, most, fill, large, wide, tall)]


def blob_mask(mask: np.ndarray, least: float, most: float, fill: float = 0.0, large: float = 5.0, wide: float = np.inf, tall: float = np.inf) -> np.ndarray:
    """The mask of the blobs that fit."""
    out = np.zeros(mask.shape, bool)
    for box, runs in labelled(mask):
        if fits(box, mask.size, least, most, fill, large, wide, tall):
            for y, a, z in runs:
                out[y, a:z] = True
    return out


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Pixels that the outside can't reach."""
    free = np.pad(~mask.astype(bool), 1, constant_values=True)
    outside = np.zeros_like(free)
    outside[0, 0] = True
    while True:
        grown = outside.copy()
        grown[1:] |= outside[:-1]
        grown[:-1] |= outside[1:]
        grown[:, 1:] |= outside[:, :-1]
        grown[:, :-1] |= outside[:, 1:]
        grown &= free
        if (grown == outside).all():
            return ~outside[1:-1, 1:-1]
        outside = grown


def saliency(image: np.ndarray) -> np.ndarray:
    """How much a pixel is like an arrow's, 0 to 255: sqrt(dominance * whiteness^0.4 * diagonal^0.6).

    Dominance is brightness above that of the blurred darkest surroundings; whiteness
    falls with the spread of the channels; diagonal is the gradient's strength, above its
    first percentile, where it points neither along nor across.
    """
    bgr, bright = image[..., :3].astype(np.float64), grey(image)
    white = np.floor(np.exp((bgr.min(-1) - bgr.max(-1)) / 40) * 255)
    dominance = np.clip(bright - blur(erode(bright, 5, 5), 7), 0, None)
    gx, gy = np.abs(conv(bright, SOBEL)), np.abs(conv(bright, SOBEL.T))
    strength = np.hypot(gx, gy)
    strength = np.clip(strength - np.percentile(strength, 1), 0, None)
    diagonal = np.floor(spread_to(strength * np.sin(2 * np.arctan2(gy, gx))))
    return np.floor(spread_to(np.sqrt(dominance * white**0.4 * diagonal**0.6)))


def ability_mask(image: np.ndarray, sigma: float = 7, threshold: float = 30) -> np.ndarray:
    """What stands out of its blurred surroundings."""
    return spread_to(np.clip(grey(image) - blur(grey(image), sigma), 0, None)) > threshold


def nearest_colour(colour: np.ndarray, colours: list) -> int:
    """The nearest of colours; ties go to the later one."""
    d = [float(np.linalg.norm(colour - np.array(c))) for c in colours]
    return max(range(len(d)), key=lambda i: (-d[i], i))


def side_colour(image: np.ndarray, box: tuple, offset: int = 10, width: int = 2) -> np.ndarray:
    """Mean colour of the strips left and right of a box, offset away from it."""
    x1, y1, x2, y2 = box[:4]
    rows = image[max(0, y1) : min(image.shape[0], y2)]
    left, right = rows[:, max(0, x1 - offset - width) : max(0, x1 - offset)], rows[:, min(image.shape[1], x2 + offset) : x2 + offset + width]
    if not left.size or not right.size:
        raise ValueError(f"no strip beside {box[:4]}")
    return (left[..., :3].mean((0, 1)) + right[..., :3].mean((0, 1))) / 2


def white_text(image: np.ndarray, bright: float = 200) -> np.ndarray:
    """Blobs of white text: bright strokes, joined along the line, of a text's size and proportions."""
    strokes = opened(grey(image) > bright, 2, 2)
    return blob_mask(dilate(strokes, 2, 8) > 0, 0.001, 0.02, fill=0.7, large=5, wide=11, tall=1)


def lab(image: np.ndarray) -> np.ndarray:
    """BGR to CIE L*a*b* (D65), each channel 0 to 255."""
    c = image[..., 2::-1].astype(np.float64) / 255
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = linear @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    return np.stack([light * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)


def horizontal_edges(image: np.ndarray, percent: float = 95, least: int = 12) -> np.ndarray:
    """Where colour or, less so, light changes most from row to row, in stretches of at least `least` pixels."""
    parts = lab(image)
    strength = sum(w * np.abs(conv(parts[..., k], SOBEL.T)) for k, w in enumerate((0.3, 1.2, 1.2)))
    return opened(strength > np.percentile(strength, percent), 1, least)


def lines_of(edges: np.ndarray, least: int = 30, most_height: int = 4, near: float = 5, extend: float = 1.5) -> list[tuple[int, int, int]]:
    """(x1, x2, y) of lines: long flat blobs, those of a row extended to both sides and united."""
    found = [(x, y, x + w, y + h) for x, y, w, h, _ in components(opened(edges, 1, least)) if w >= least and h <= most_height]
    found.sort(key=lambda s: (s[1], s[0]))
    centres = [(y1 + y2) // 2 for _, y1, _, y2 in found]
    rows = first_fit_rows(centres, near)
    out = []
    for row in range(max(rows, default=-1) + 1):
        own = [k for k, r in enumerate(rows) if r == row]
        y = int(sum(centres[k] for k in own) / len(own))
        reach = sorted((max(0, x1 - int((x2 - x1) * extend)), min(edges.shape[1], x2 + int((x2 - x1) * extend))) for x1, _, x2, _ in (found[k] for k in own))
        first, last = reach[0]
        for a, z in reach[1:]:
            if a > last:
                out.append((first, last, y))
                first, last = a, z
            last = max(last, z)
        out.append((first, last, y))
    return out


def text_density(text: np.ndarray, line: tuple, sideways: int = 20, reach: int = 24) -> float:
    """Share of text pixels around a line (x1, x2, y)."""
    x1, x2, y = line
    zone = text[max(0, y - reach) : y + reach, max(0, x1 - sideways) : x2 + sideways]
    return float(zone.mean()) if zone.size else 0.0


def canny(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thin edges: pixels along which the gradient is greatest, above low and joined to one above high."""
    parts = channels(image)
    gx, gy = (np.stack([conv(parts[..., c], k) for c in range(parts.shape[2])]) for k in (SOBEL, SOBEL.T))
    best = (np.abs(gx) + np.abs(gy)).argmax(0)[None]
    gx, gy = np.take_along_axis(gx, best, 0)[0], np.take_along_axis(gy, best, 0)[0]
    size = np.abs(gx) + np.abs(gy)
    wide = np.pad(size, 1)
    around = lambda dy, dx: wide[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    steep, flat, same = np.abs(gy) > 2.4142 * np.abs(gx), np.abs(gy) < 0.4142 * np.abs(gx), gx * gy > 0
    before = np.where(flat, around(0, -1), np.where(steep, around(-1, 0), np.where(same, around(-1, -1), around(-1, 1))))
    after = np.where(flat, around(0, 1), np.where(steep, around(1, 0), np.where(same, around(1, 1), around(1, -1))))
    thin = (size > low) & (size > before) & (size >= after)
    out = np.zeros(thin.shape, bool)
    for _, runs in labelled(thin):
        if any((size[y, a:z] > high).any() for y, a, z in runs):
            for y, a, z in runs:
                out[y, a:z] = True
    return out


def anchored_groups(values: list[float], threshold: float) -> list[int]:
    """Group numbers of ascending values: a new group where the distance to the group's first exceeds threshold."""
    out, first, group = [], None, -1
    for v in values:
        if first is None or v - first > threshold:
            first, group = v, group + 1
        out.append(group)
    return out


def first_fit_rows(centres: list[float], threshold: float) -> list[int]:
    """Row of each centre in turn: the first whose mean, cut to an integer, is near enough, else a new one."""
    rows: list[list[float]] = []
    out = []
    for c in centres:
        k = next((i for i, own in enumerate(rows) if abs(c - own[0]) <= threshold), len(rows))
        if k == len(rows):
            rows.append([c, 0.0, 0])
        rows[k][1:] = rows[k][1] + c, rows[k][2] + 1
        if rows[k][2] > 1:
            rows[k][0] = int(rows[k][1] / rows[k][2])
        out.append(k)
    return out


def brightness(image: np.ndarray, frame: int) -> list[tuple[int, float]]:
    """A job's function: the frame and its region's mean."""
    return [(frame, float(image.mean()))]
