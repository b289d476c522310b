"""Kill rows in an image of the kill feed's region: presence, arrows, portraits, abilities, entries.

All functions take BGR arrays and are pure, so they run in an Arrow function, a region at
a time. Reference images come as References, prepared once in a worker.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from ordwell.dims import TEAM_COLOURS
from ordwell.functions import kernels as k

#: Where in the region arrows are sought, and the share of its height that a row takes.
ARROW_ZONE = (0.3, 0.8, 0.1)
ROW_HEIGHT = 0.15


@dataclass(frozen=True)
class Search:
    """How a kind of picture is sought: its least score, its height as a share of the image's, scales, least edge score."""

    threshold: float
    low: float
    high: float
    steps: int | None = None
    edges: float = 0.3

    def scales(self, image: np.ndarray, template: np.ndarray) -> list[float]:
        steps = self.steps or int((self.high - self.low) * image.shape[0])
        return k.scales_of(image.shape[0], template.shape[0], self.low, self.high, steps) if steps else []


#: The searches and margins of portraits, ability icons and the arrow.
MAIN, MAIN_MARGIN = Search(0.92, 0.8, 0.9), (50, 50)
ASSIST, ASSIST_MARGIN = Search(0.88, 0.6, 0.8, edges=0.45), (20, 50)
UNMASKED = 0.8
ABILITY, ULTIMATE, ENVIRONMENT = Search(0.7, 0.5, 0.7), Search(0.7, 0.7, 0.8), Search(0.7, 0.9, 1.0, 2)
ARROW = Search(0.6, 0.085, 0.086, 1)


@dataclass(frozen=True)
class Found:
    """A picture found: its name, box (x1, y1, x2, y2) and score; for portraits the team."""

    name: str
    box: tuple[int, int, int, int]
    score: float
    team: int = -1
    category: str | None = None

    @property
    def x(self) -> int:
        return (self.box[0] + self.box[2]) // 2

    @property
    def y(self) -> int:
        return (self.box[1] + self.box[3]) // 2

    def moved(self, dx: int, dy: int, **change) -> Found:
        x1, y1, x2, y2 = self.box
        return Found(**{**self.__dict__, "box": (x1 + dx, y1 + dy, x2 + dx, y2 + dy), **change})


@dataclass
class References:
    """The pictures to look for: heroes' portraits, abilities by hero as (category, name, icon), arrow and environment."""

    portraits: dict[str, np.ndarray]
    abilities: dict[str, list[tuple[str, str, np.ndarray]]] = field(default_factory=dict)
    arrow: np.ndarray | None = None
    environment: np.ndarray | None = None

    @cached_property
    def main(self) -> dict[str, tuple]:
        return {name: k.prepared(image, MAIN_MARGIN) for name, image in self.portraits.items()}

    @cached_property
    def assist(self) -> dict[str, tuple]:
        return {name: k.prepared(image, ASSIST_MARGIN) for name, image in self.portraits.items()}

    @cached_property
    def arrow_mask(self) -> np.ndarray:
        image, mask = k.prepared(self.arrow, (0, 0))
        return (k.grey(image) > 127 if mask is None else mask) * 255.0


def present(region: np.ndarray) -> bool:
    """Long horizontal lines where colours change, with white text near one of them."""
    text = k.white_text(region)
    return any(k.text_density(text, line) >= 0.05 for line in k.lines_of(k.horizontal_edges(region)))


def arrows(zone: np.ndarray, mask: np.ndarray) -> list[Found]:
    """The arrow of each kill row, from the top; rows beyond a gap of 50 pixels are left out."""
    seen = k.blob_mask(k.saliency(zone) > 50, 0.0007, 0.01, fill=0.2, large=0, wide=3, tall=5) * 255.0
    found = sorted(k.match_template(seen, mask, threshold=ARROW.threshold, scales=ARROW.scales(zone, mask)), key=lambda f: f[1])
    rows: dict[int, list[tuple]] = {}
    for group, f in zip(k.anchored_groups([f[1] for f in found], 22), found, strict=True):
        x1, y1, x2, y2 = f[:4]
        alike = k.iou(seen[y1:y2, x1:x2], k.resize(mask, y2 - y1, x2 - x1, nearest=True))
        rows.setdefault(group, []).append((round(alike / 0.03), f[4], alike, f))
    best = [max(own, key=lambda c: c[:2]) for own in rows.values()]
    kept = sorted((Found("arrow", f[:4], f[4]) for _, _, alike, f in best if alike >= 0.4), key=lambda a: a.y)
    gap = next((i for i in range(1, len(kept)) if kept[i].y - kept[i - 1].y > 50), len(kept))
    return kept[:gap]


def kill_rows(region: np.ndarray, mask: np.ndarray) -> list[tuple[np.ndarray, Found]]:
    """(row's image, its arrow) of each kill row, the lowest, which is the newest, first."""
    h, w = region.shape[:2]
    x1, x2, y1 = int(w * ARROW_ZONE[0]), int(w * ARROW_ZONE[1]), int(h * ARROW_ZONE[2])
    half = int(h * ROW_HEIGHT / 2)
    out = []
    for a in sorted(arrows(region[y1:, x1:x2], mask), key=lambda a: -a.y):
        a = a.moved(x1, y1)
        top = max(0, a.y - half)
        out.append((region[top : a.y + half], a.moved(0, -top)))
    return out


def portraits(row: np.ndarray, prepared: dict[str, tuple], search: Search, teams: bool) -> list[Found]:
    """Heroes whose portraits stand in a row, from the left; the row's first 8 % don't count. teams: by the colour beside them."""
    left = round(0.08 * row.shape[1])
    out = []
    for name, (template, mask) in prepared.items():
        threshold = UNMASKED if mask is None else search.threshold
        for f in k.match_template(row[:, left:], template, mask, threshold, search.scales(row, template), centred=mask is None, least_edges=search.edges):
            here = Found(name, f[:4], f[4]).moved(left, 0)
            out.append(here.moved(0, 0, team=k.nearest_colour(k.side_colour(row, here.box), TEAM_COLOURS)) if teams else here)
    return sorted(out, key=lambda f: f.x)


def ability(part: np.ndarray, icons: list[tuple[str, str, np.ndarray]], search: Search | None = None) -> Found | None:
    """The one ability whose icon stands in part of a row, also mirrored; ultimates are drawn inverted. Two are an error."""
    seen, found = k.ability_mask(part) * 255.0, []
    for category, name, icon in icons:
        image, mask = k.prepared(icon, (0, 0))
        shape = k.grey(image) > 127 if mask is None else mask
        shape = (~shape if category == "ultimate" else shape) * 255.0
        how = search or (ULTIMATE if category == "ultimate" else ABILITY)
        scales = how.scales(part, shape)
        hits = k.match_template(seen, shape, threshold=how.threshold, scales=scales) or k.match_template(seen, shape[:, ::-1], threshold=how.threshold, scales=scales)
        found += [Found(name, f[:4], f[4], category=category) for f in hits]
    if len(found) > 1:
        raise ValueError(f"several abilities in a kill row: {[f.name for f in found]}")
    return found[0] if found else None


def player(found: Found, team: int | None = None) -> dict:
    return {"team": found.team if team is None else team, "hero": found.name}


def entry(row: np.ndarray, arrow: Found, references: References, frame: int, number: int) -> dict | None:
    """A kill row's detection; None where no victim is found. More than two heroes are an error.

    Left of the arrow stands the killer, right of it the victim; of several the rightmost
    counts. Wide gaps hold more: between killer and arrow assists, an ability and a critical
    sign, between arrow and victim an environment's icon.
    """
    heroes = portraits(row, references.main, MAIN, True)
    if len(heroes) > 2:
        raise ValueError(f"more than two heroes in a kill row: {[h.name for h in heroes]}")
    killer = max((h for h in heroes if h.x < arrow.x), key=lambda h: h.x, default=None)
    victim = max((h for h in heroes if h.x >= arrow.x), key=lambda h: h.x, default=None)
    if victim is None:
        return None
    out = {"frame": frame, "row": number, "player1": None, "player2": player(victim), "assists": [], "ability": None, "is_critical": False, "is_environmental": False}
    wide = arrow.box[2] - arrow.box[0]
    if killer is not None:
        out["player1"] = player(killer)
        out |= beside_killer(row[:, killer.box[2] : arrow.box[0]], wide, killer, references)
    if victim.box[0] - arrow.box[2] >= 2 * wide and references.environment is not None:
        part = row[:, arrow.box[2] : victim.box[0]]
        out["is_environmental"] = ability(part, [("ability", "environment", references.environment)], ENVIRONMENT) is not None
    return out


def beside_killer(part: np.ndarray, wide: int, killer: Found, references: References) -> dict:
    """What stands between killer and arrow; each thing needs its width to be looked for."""
    if part.shape[1] < 2.5 * wide:
        return {}
    out: dict = {}
    helpers = portraits(part, references.assist, ASSIST, False)
    if helpers:
        out["assists"] = [player(h, killer.team) for h in helpers]
        part = part[:, helpers[-1].box[2] :]
        if part.shape[1] < 1.5 * wide:
            return out
    used = ability(part, references.abilities.get(killer.name, []))
    if used:
        out["ability"] = {"category": used.category, "name": used.name}
    out["is_critical"] = used is None or part.shape[1] - used.box[2] >= wide
    return out


def detect(region: np.ndarray, frame: int, references: References) -> list[dict]:
    """All kill rows of a region, numbered from the newest."""
    if not present(region):
        return []
    found = (entry(image, arrow, references, frame, n) for n, (image, arrow) in enumerate(kill_rows(region, references.arrow_mask)))
    return [e for e in found if e is not None]
