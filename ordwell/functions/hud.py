"""The older layout's detectors: players' icons along the top, and kill rows by their edges.

Arguments are crops of a frame (BGR arrays, boxes cut by the configuration's positions)
and reference images by name; thresholds are the configuration's values, by keyword. All
functions are pure, so they run in an Arrow function.
"""

from __future__ import annotations

import numpy as np

from ordwell.functions import kernels as k

WHITE = np.array([255, 255, 255])


def place(image: np.ndarray, reference: np.ndarray) -> tuple[float, int, int]:
    """(score, row, column) of the place most like the reference; the first of equals."""
    scores = k.match_scores(image, reference)
    at = int(scores.argmax())
    return float(scores.flat[at]), *map(int, np.unravel_index(at, scores.shape))


def patch(image: np.ndarray, reference: np.ndarray, y: int, x: int) -> np.ndarray:
    return image[y : y + reference.shape[0], x : x + reference.shape[1]]


def two_places(scores: np.ndarray, left: int, right: int) -> list[tuple[float, int]]:
    """(score, column) of the best place, and of the best one outside the columns from left before it to right after it."""
    first = int(scores.max(axis=0).argmax())
    rest = scores.max(axis=0)
    best = float(rest[first])
    rest[max(0, first - left) : first + right] = -1
    second = int(rest.argmax())
    return [(best, first), (float(rest[second]), second)]


def ult_ready(icon: np.ndarray, reference: np.ndarray, brightest: float = 230, even: float = 15, least: float = 0.7, alike: float = 0.6) -> bool:
    """An evenly bright icon, as it flashes when it gets ready, or one like the reference in place and structure."""
    icon, reference = k.grey(icon), k.grey(reference)
    if icon.mean() > brightest and icon.std() < even:
        return True
    score, y, x = place(icon[:-1] if icon.shape[0] > reference.shape[0] else icon, reference)
    return score > least and k.ssim(patch(icon, reference, y, x), reference) > alike


def hero(avatar: np.ndarray, observed: np.ndarray, references: dict[str, np.ndarray], references_observed: dict[str, np.ndarray]) -> tuple[str | None, float]:
    """(name, score) of the hero whose picture is most like the avatar in either size; of equals the first."""
    best: tuple[str | None, float] = (None, 0.0)
    for name, large in references_observed.items():
        both = []
        for image, reference in ((observed, large), (avatar, references[name])):
            score, y, x = place(image, reference)
            both.append((score, k.ssim(patch(image, reference, y, x), reference)))
        score = 0.4 * max(b[0] for b in both) + 0.6 * max(b[1] for b in both)
        if score > best[1]:
            best = name, score
    return best


def observed_now(strip: np.ndarray, colour: np.ndarray, ready: bool, most: float = 40) -> bool:
    """The strip beside an avatar is all of the team's colour, and no ready sign lies over it."""
    return not ready and float(np.linalg.norm(strip.reshape(-1, 3) - np.asarray(colour, float), axis=1).max()) < most


def dead(avatar: np.ndarray, reference: np.ndarray, limit: float = 45) -> bool:
    """The avatar's range of brightness differs from the reference's: it has gone dim."""
    ranges = [float(np.ptp(x[..., :3].astype(float).mean(-1))) for x in (avatar, reference)]
    return abs(ranges[1] - ranges[0]) > limit


def sheared(image: np.ndarray, factor: float) -> np.ndarray:
    """Rows moved to the right by factor times their number; what comes in repeats the edge."""
    columns = np.clip(np.arange(image.shape[1])[None] - np.round(np.arange(image.shape[0]) * factor).astype(int)[:, None], 0, image.shape[1] - 1)
    return np.take_along_axis(image, columns, 1)


def digit(image: np.ndarray, references: list[np.ndarray]) -> tuple[int, float]:
    """(digit, score) of the reference most like the image in place and structure; -1 where none scores."""
    best = -1, 0.0
    for value, reference in enumerate(references):
        short = [max(0, reference.shape[i] - image.shape[i]) for i in (0, 1)]
        wide = np.pad(image, [(s // 2, s - s // 2) for s in short], mode="edge")
        score, y, x = place(wide, reference)
        score += k.ssim(patch(wide, reference, y, x), reference, 3)
        if score > best[1]:
            best = value, score
    return best


def gap_column(image: np.ndarray, limit: float = 0.25) -> int:
    """The rightmost column whose range of brightness is lower by limit than three columns to either side; -1 without one."""
    spans = image.max(0) - image.min(0)
    columns = [i for i in range(4, len(spans) - 3) if min(spans[i - 3], spans[i + 3]) - spans[i] > limit]
    return max(columns, default=-1)


def ult_charge(image: np.ndarray, references: list[np.ndarray], ready: bool = False, shear: float = 0.25396, limit: float = 0.25, least: float = 0.55, width: int = 8) -> int:
    """The charge that one or two slanted digits show; 100 where the ultimate is ready, -1 where no digit is found."""
    if ready:
        return 100
    upright = k.spread_to(sheared(k.grey(image), shear), 0, 1)
    if upright[0].mean() < 0.6:
        upright = 1 - upright
    scaled, gap = upright * 255, gap_column(upright, limit)
    if gap >= 0:
        (left, a), (right, b) = digit(scaled[:, max(0, gap - width) : gap + 1], references), digit(scaled[:, gap : gap + width + 1], references)
        if a >= least and b >= least:
            return 10 * left + right
    return digit(scaled, references)[0]


def icon_columns(row: np.ndarray, height: int = 21, span: int = 33, left: float = 0.7, right: float = 0.7) -> np.ndarray:
    """Where a portrait may start: tall vertical edges near the column and near span to its right."""
    tall = k.canny(row, 100, 200).sum(0).astype(float)
    tall = (tall + np.roll(tall, 1)) / height
    near = np.array([tall[max(0, i - 2) : i + 2].max() for i in range(len(tall))])
    out = np.zeros(len(tall), bool)
    stop = len(tall) - span - 5
    out[2:stop] = (near[2:stop] >= left) & (near[2 + span + 2 : stop + span + 2] >= right)
    return out


def icons(row: np.ndarray, references: dict[str, np.ndarray], starts: np.ndarray, width: int = 31, gap: int = 30, least: float = 0.6, alike: float = 0.35) -> list[dict]:
    """Heroes whose icons stand in a row: up to two places each, on possible starts, alike in structure too."""
    out = []
    for name, icon in references.items():
        scores = k.match_scores(row, icon)
        reach = gap + width - 5
        for score, x in two_places(scores, reach, reach + 1):
            y = int(scores[:, x].argmax())
            if score > least and starts[max(0, x - 2) : x + 2].any() and k.ssim(patch(row, icon, y, x), icon) >= alike:
                out.append({"hero": name, "score": score, "x": x})
    return out


def at_the_ends(found: list[dict], apart: float = 51, near: float = 15) -> list[dict]:
    """Of three or more icons those near the first or last; near the first only with another far from or close to them."""
    if len(found) < 2:
        return found
    first, last = min(f["x"] for f in found), max(f["x"] for f in found)
    distance = lambda a, b: abs(a["x"] - b["x"])
    paired = [last - first > apart and any(distance(f, g) > apart or distance(f, g) < 10 for g in found) for f in found]
    return [f for f, ok in zip(found, paired, strict=True) if ok and f["x"] - first < near or last - f["x"] < near]


def kill_players(row: np.ndarray, references: dict[str, np.ndarray], colours: list, width: int = 31, gap: int = 30, right_part: int = 140, colour_y: int = 2, colour_dx: int = 10) -> tuple[dict | None, dict | None]:
    """(killer, victim) of a row as hero, x and team; (None, None) where the victim isn't in the row's right part."""
    found = at_the_ends(icons(row, references, icon_columns(row), width, gap), gap + width - 10)
    if not found:
        return None, None
    middle = sum(f["x"] for f in found) / len(found)
    left, right = [f for f in found if f["x"] < middle], [f for f in found if f["x"] >= middle]
    mean = lambda own: sum(f["x"] for f in own) / len(own)
    edge = row.shape[1] - right_part
    if mean(right) < edge:
        return None, None

    def made(own: dict, side: int) -> dict:
        x = int(np.clip(own["x"] - colour_dx if side == 0 else own["x"] + width + colour_dx, 0, row.shape[1] - 1))
        return {"hero": own["hero"], "x": own["x"], "team": k.nearest_colour(row[colour_y, x].astype(float), colours)}

    best = lambda own: max(own, key=lambda f: f["score"])
    if not left or mean(right) - mean(left) < width - 7:
        return None, made(best(found), 1) if best(found)["x"] >= edge else None
    return made(best(left), 0), made(best(right), 1)


def coloured_like(icon: np.ndarray, colour: np.ndarray, most: float = 80) -> np.ndarray:
    """255 where a pixel is near a colour, else 0."""
    return np.where(np.linalg.norm(icon.astype(float) - np.asarray(colour, float), axis=-1) < most, 255.0, 0.0)


def ability(row: np.ndarray, killer_x: int, victim_x: int, references: dict[str, np.ndarray], width: int = 31, gap: int = 30, step: int = 18, size: int = 30, dx: int = -23, y: int = 2, least: float = 0.4) -> str | None:
    """The ability whose icon stands before the victim: there is one if the distance isn't the arrow's and whole assists'."""
    if (victim_x - killer_x - width - gap) % step <= 5:
        return None
    x = victim_x + dx - size
    icon = k.crop(row, y, size, x, size)
    seen = coloured_like(icon, row[y + size // 2, x + size - 2])
    best = None, least
    for name, reference in references.items():
        score, top, left = place(seen, reference)
        score += float(k.match_scores(patch(seen, reference, top, left), reference)[0, 0])
        if score > best[1]:
            best = name, score
    return best[0]


def assists(row: np.ndarray, killer_x: int, victim_x: int, references: dict[str, np.ndarray], width: int = 31, gap: int = 30, step: int = 18, size: tuple[int, int] = (18, 12), dx: int = 8, y: int = 6, least: float = 0.6) -> list[str]:
    """Heroes who assisted, from the left: as many as tall edges after the killer leave room for."""
    first, after = killer_x + width + 4, victim_x - gap
    if after - first < step:
        return []
    tall = np.flatnonzero(k.canny(row, 300, 500)[:, first:after].sum(0) >= row.shape[0] * least)
    out = []
    for n in range(round(float(tall[-1]) / step) if len(tall) else 0):
        icon = k.crop(row, y, size[0], killer_x + width + dx + n * step, size[1])
        scored = [(k.ssim(icon, reference), -i, name) for i, (name, reference) in enumerate(references.items()) if reference.shape == icon.shape]
        out.append(max(scored)[2] if scored else "empty")
    return out


def headshot(row: np.ndarray, victim_x: int, size: int = 30, dx: int = -23, y: int = 2, limit: float = 50) -> bool:
    """The arrow before the victim isn't white."""
    pixel = row[y + size // 2, victim_x + dx + 2]
    return float(np.linalg.norm(pixel.astype(float) - WHITE)) > limit


def team_colours(frame: np.ndarray, left: tuple[int, int] = (53, 40), right: tuple[int, int] = (54, 1183)) -> list[np.ndarray]:
    """The colours at two pixels (row, column) of a frame."""
    return [frame[left], frame[right]]


def fused(pictures: dict[str, np.ndarray], colour: np.ndarray, small: tuple[int, int] = (26, 33)) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Transparent pictures laid over a team's colour, and the same scaled to small (height, width)."""
    large = {}
    for name, p in pictures.items():
        share = p[..., 3:].astype(float) / 255
        large[name] = p[..., :3] * share + np.asarray(colour, float) * (1 - share)
    return large, {name: k.resize(p, *small) for name, p in large.items()}


def valid_frame(corner: np.ndarray, replay_icons: list[np.ndarray], replay_reference: np.ndarray, living: bool, std: float = 10, mean: float = 230, replay: float = 0.5) -> tuple[bool, bool]:
    """(valid, replay): a living player, a white corner, and no replay sign in either place."""
    parts = corner[..., :3].reshape(-1, 3).astype(float)
    if not living or parts.std(0).max() >= std or parts.mean() <= mean:
        return False, False
    shown = max(k.ssim(icon, replay_reference) for icon in replay_icons) >= replay
    return not shown, shown
