"""Made-up pictures: heroes, icons, the arrow and kill-feed regions, for queries and tests, as no images exist here."""

from __future__ import annotations

import numpy as np

from ordwell.dims import TEAM_COLOURS
from ordwell.functions import kernels as k
from ordwell.functions.killfeed import ASSIST_MARGIN, MAIN_MARGIN, References

WIDTH, HEIGHT = 346, 180


def portrait(number: int) -> np.ndarray:
    """A round portrait of its own pattern on a transparent ground (BGRA)."""
    rnd, size = np.random.default_rng(1000 + number), 60
    image = np.zeros((size + 2 * MAIN_MARGIN[0], size + 2 * MAIN_MARGIN[1], 4), np.uint8)
    inner = np.kron(np.where(rnd.random((6, 6, 3)) < 0.5, 10, 245), np.ones((10, 10, 1))).astype(np.uint8)
    y, x = np.mgrid[:size, :size] - (size - 1) / 2
    alpha = np.where(np.hypot(x, y) <= size / 2, 255, 0).astype(np.uint8)
    image[MAIN_MARGIN[0] : -MAIN_MARGIN[0], MAIN_MARGIN[1] : -MAIN_MARGIN[1]] = np.dstack([inner, alpha])
    return image


def icon(number: int) -> np.ndarray:
    """An opaque sign of strokes on a transparent ground (BGRA)."""
    rnd = np.random.default_rng(2000 + number)
    cells = rnd.integers(0, 2, (4, 4)) | np.eye(4, dtype=int)
    shape = np.kron(cells, np.ones((8, 8), int)).astype(bool)
    return np.dstack([np.full((32, 32, 3), 255, np.uint8), np.where(shape, 255, 0).astype(np.uint8)])


def arrow() -> np.ndarray:
    """A chevron that points right (BGRA)."""
    y, x = np.mgrid[:28, :28]
    shape = np.abs(x - (20 - np.abs(y - 13.5) * 1.1)) < 6
    return np.dstack([np.full((28, 28, 3), 255, np.uint8), np.where(shape, 255, 0).astype(np.uint8)])


def references(heroes: int, abilities: int = 1) -> References:
    names = [f"h{i}" for i in range(heroes)]
    return References(
        {n: portrait(i) for i, n in enumerate(names)},
        {n: [("ability", f"a{i * abilities + j}", icon(i * abilities + j)) for j in range(abilities)] for i, n in enumerate(names)},
        arrow(),
    )


def put(image: np.ndarray, picture: np.ndarray, x: int, y: int, h: int, w: int) -> None:
    """Draw a picture with alpha into image at (x, y), scaled to h x w."""
    small = k.resize(picture.astype(float), h, w)
    share = small[..., 3:] / 255
    image[y : y + h, x : x + w] = image[y : y + h, x : x + w] * (1 - share) + small[..., :3] * share


def draw_row(image: np.ndarray, y: int, killer: tuple[int, int], victim: tuple[int, int], assist: int | None = None, sign: int | None = None) -> None:
    """A kill row around line y: (hero, team) of killer and victim, maybe an assisting hero and an ability's sign."""
    top, bottom = y - 13, y + 13
    killer_x = 90
    middle = killer_x + 50 + (30 if assist is not None else 0) + (24 if sign is not None else 0)
    victim_x = middle + 34
    image[top:bottom, 20 : killer_x + 38] = TEAM_COLOURS[killer[1]]
    image[top:bottom, victim_x - 14 : WIDTH - 14] = TEAM_COLOURS[victim[1]]
    inner = slice(MAIN_MARGIN[0], -MAIN_MARGIN[0]), slice(MAIN_MARGIN[1], -MAIN_MARGIN[1])
    put(image, portrait(killer[0])[inner], killer_x, y - 11, 22, 22)
    put(image, portrait(victim[0])[inner], victim_x, y - 11, 22, 22)
    if assist is not None:
        rows, cols = ASSIST_MARGIN
        put(image, portrait(assist)[rows:-rows, cols:-cols], killer_x + 40, y - 10, 20, 10)
    if sign is not None:
        put(image, icon(sign), middle - 24, y - 8, 16, 16)
    put(image, arrow(), middle, y - 7, 14, 14)
    for x0, x1 in ((26, 80), (victim_x + 40, WIDTH - 22)):
        for x in range(x0, x1, 8):  # a name in white strokes
            image[y - 4 : y + 4, x : x + 5] = 245


def region(rows: list[dict], seed: int = 0) -> np.ndarray:
    """A kill-feed region with the given rows, newest last on the screen, on a dim ground."""
    image = np.random.default_rng(seed).normal(70, 2, (HEIGHT, WIDTH, 3))
    for n, row in enumerate(rows):
        draw_row(image, 150 - 35 * n, **row)
    return np.clip(image, 0, 255).astype(np.uint8)
