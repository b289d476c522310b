"""Detection on made-up pictures: kill rows, the older layout's icons, image files, and their Arrow functions."""

import json

import numpy as np
import pytest
from ordwell.functions import hud, kernels, killfeed
from ordwell.operators import detection
from ordwell.sources import drawn, files, frames, images


def entry(n, frame, killer, victim, assist=None, sign=None):
    return {
        "frame": frame, "row": n, "player1": {"team": killer[1], "hero": f"h{killer[0]}"}, "player2": {"team": victim[1], "hero": f"h{victim[0]}"},
        "assists": [] if assist is None else [{"team": killer[1], "hero": f"h{assist}"}],
        "ability": None if sign is None else {"category": "ability", "name": f"a{sign}"}, "is_critical": assist is not None, "is_environmental": False,
    }


def cases():
    """Rows as they can be: plain, with an ability, with an assist; a wide gap without an ability shows a critical sign."""
    for seed in range(12):
        rnd = np.random.default_rng(seed)
        rows = []
        for _ in range(1 + seed % 2):
            a, b = (int(x) for x in rnd.choice(4, 2, replace=False))
            rows.append({"killer": (a, int(rnd.integers(2))), "victim": (b, int(rnd.integers(2))), "assist": (a + 2) % 4 if seed % 3 == 2 else None, "sign": a if seed % 3 == 1 else None})
        yield seed, rows


def test_kill_rows_are_found_as_drawn():
    references = drawn.references(4)
    for seed, rows in cases():
        assert killfeed.detect(drawn.region(rows, seed), seed, references) == [entry(n, seed, **r) for n, r in enumerate(rows)], seed
    assert killfeed.detect(drawn.region([], 1), 0, references) == []


def test_too_much_in_a_row_is_an_error(spark):
    references = drawn.references(4)
    image = drawn.region([{"killer": (0, 0), "victim": (1, 1), "assist": None, "sign": None}], 3)
    row, arrow = killfeed.kill_rows(image, references.arrow_mask)[0]
    doubled = np.concatenate([row, row], axis=1)
    with pytest.raises(ValueError):
        killfeed.entry(doubled, arrow, references, 0, 0)
    part = np.zeros((26, 90, 3), np.uint8)
    drawn.put(part, drawn.icon(0), 5, 5, 16, 16)
    drawn.put(part, drawn.icon(0), 50, 5, 16, 16)
    with pytest.raises(ValueError):
        killfeed.ability(part, [("ability", "a0", drawn.icon(0))])


def test_ability_is_found_mirrored():
    part = np.zeros((26, 40, 3), np.uint8)
    drawn.put(part, drawn.icon(3)[:, ::-1], 10, 5, 16, 16)
    assert killfeed.ability(part, [("ability", "a3", drawn.icon(3))]).name == "a3"


def test_frames_to_detections(spark, tmp_path):
    """A made-up video through the source, one scan for two jobs, and detections from its regions."""
    references = drawn.references(4)
    rows = [r for _, r in cases()][:4]
    h, w = drawn.HEIGHT * 4, round(drawn.WIDTH / 0.27)
    video = np.full((8, h, w, 3), 60, np.uint8)
    x = w - drawn.WIDTH
    for k, r in enumerate(rows):
        video[2 * k, : drawn.HEIGHT, x:] = drawn.region(r, k)
    np.save(tmp_path / "v.npy", video)
    dispatcher = frames.Dispatcher(spark, str(tmp_path / "v.npy"))
    dispatcher.register(frames.Job("killfeed", (x / w, 0.0, 1.0, 0.25), 2, kernels.brightness)).register(frames.Job("all", (0.0, 0.0, 1.0, 1.0), 4, kernels.brightness))
    scanned = dispatcher.frames()
    assert sorted((r.job, r.frame) for r in scanned.collect()) == sorted([("killfeed", f) for f in (0, 2, 4, 6)] + [("all", f) for f in (0, 4)])
    regions = scanned.where("job = 'killfeed'").selectExpr("7L AS match_id", "*")
    got = detection.detect_rows(regions, references).collect()
    want = [entry(n, 2 * k, **r) for k, own in enumerate(rows) for n, r in enumerate(own)]
    plain = lambda r: {k: v for k, v in r.asDict(True).items() if k != "match_id"}
    assert sorted(map(json.dumps, map(plain, got))) == sorted(map(json.dumps, want)) and {r.match_id for r in got} == {7}
    assert detection.detect_rows(regions.limit(0), references).count() == 0
    values = {n: df.count() for n, df in dispatcher.run().items()}
    assert values == {"killfeed": 4, "all": 2}


def test_references_from_files(spark, tmp_path):
    known = drawn.references(2)
    (tmp_path / "kinds").mkdir()
    rows = [("portrait", f"h{i}", None, None, drawn.portrait(i)) for i in range(2)] + [("ability", f"h{i}", "ability", f"a{i}", drawn.icon(i)) for i in range(2)] + [("arrow", None, None, None, drawn.arrow())]
    for n, r in enumerate(rows):
        (tmp_path / "kinds" / f"{n}.png").write_bytes(images.encode(r[4]))
    read = spark.read.format("binaryFile").load(str(tmp_path / "kinds")).selectExpr("cast(regexp_extract(path, '([0-9]+).png', 1) as int) AS n", "content")
    named = spark.createDataFrame([(n, *r[:4]) for n, r in enumerate(rows)], "n int, kind string, hero string, category string, name string")
    pictures = read.join(named, "n").select("kind", "hero", "category", "name", images.decoded("content").alias("image"))
    found = detection.references_of(pictures)
    assert all(np.array_equal(found.portraits[h], known.portraits[h]) for h in ("h0", "h1")) and np.array_equal(found.arrow, known.arrow)
    assert [x[:2] for x in found.abilities["h1"]] == [("ability", "a1")]
    with pytest.raises(ValueError):
        detection.references_of(pictures, 100)


def test_image_files(spark, tmp_path):
    rnd = np.random.default_rng(0)
    for shape in ((5, 7), (6, 5, 3), (4, 9, 4)):
        image = rnd.integers(0, 256, shape, dtype=np.uint8)
        assert np.array_equal(images.decode(images.encode(image)), image)
    grey = rnd.integers(0, 256, (3, 4), dtype=np.uint8)
    assert np.array_equal(images.decode(b"P5\n# made up\n4 3\n255\n" + grey.tobytes()), grey)
    assert np.array_equal(images.decode(b"P6 4 1 255 " + bytes(range(12)))[0, 0], [2, 1, 0])
    for kind in range(5):  # a line in each filtered form comes back as it was
        line, above = rnd.integers(0, 256, (2, 12), dtype=np.uint8)
        shifted = lambda v: np.concatenate([np.zeros(3, int), v[:-3].astype(int)])
        a, b, c = shifted(line), above.astype(int), shifted(above)
        p = a + b - c
        paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = [np.zeros(12, int), a, b, (a + b) // 2, paeth][kind]
        assert np.array_equal(images._unfiltered(kind, ((line - guess) % 256).astype(np.uint8), above, 3), line)
    for broken in (b"", b"GIF89a", images.encode(grey)[:40]):
        with pytest.raises(ValueError):
            images.decode(broken)
    for folder, name in (("avatars", "ana"), ("digits", "7"), ("other", "x")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{name}.png").write_bytes(images.encode(grey))
    got = images.read_families(spark, str(tmp_path)).collect()
    assert {(r.family, r.name) for r in got} == {("avatar", "ana"), ("digit", "7")} and np.array_equal(images.array_of(got[0].image), grey)
    (tmp_path / "h" / "ana").mkdir(parents=True)
    (tmp_path / "h" / "ana" / "Nade@Ability@e.png").write_bytes(b"x")
    assert [tuple(a) for a in files.read_heroes(spark, str(tmp_path / "h")).first().abilities] == [("ability", "Nade", "e"), files.SHARED]


def test_clips_through_spark(spark, tmp_path):
    video = np.arange(6 * 2 * 3, dtype=np.uint8).reshape(6, 2, 3, 1)
    np.save(tmp_path / "m_0.npy", video[:4])
    np.save(tmp_path / "m_4.npy", video[4:])
    got = {r.frame: bytes(r.data) for r in frames.clips(spark, str(tmp_path)).collect()}
    assert got == {f: video[f].tobytes() for f in range(6)}


def picture(seed, h=30, w=38):
    return np.kron(np.random.default_rng(seed).integers(0, 255, (h // 5 + 1, w // 5 + 1, 3)), np.ones((5, 5, 1)))[:h, :w].astype(np.uint8)


def test_older_icons():
    names = ["ana", "mei", "zarya"]
    large = {n: picture(k) for k, n in enumerate(names)}
    small = {n: kernels.resize(p, 26, 33) for n, p in large.items()}
    for n in names:
        seen, far = np.full((30, 45, 3), 90.0), np.full((26, 39, 3), 90.0)
        seen[:, 4:42] = large[n]
        assert hud.hero(far, seen, small, large)[0] == n
        far[:, 3:36] = small[n]
        assert hud.hero(far, np.full((30, 45, 3), 90.0), small, large)[0] == n
    assert hud.dead(large["ana"] // 4, large["ana"]) and not hud.dead(large["ana"], large["ana"])
    sign = picture(9, 20, 20)
    icon = np.full((30, 33, 3), 40.0)
    icon[4:24, 6:26] = sign
    assert hud.ult_ready(icon, sign) and hud.ult_ready(np.full((30, 33, 3), 250.0), sign) and not hud.ult_ready(picture(10, 30, 33), sign)
    assert hud.observed_now(np.full((4, 28, 3), 100), (100, 100, 100), False) and not hud.observed_now(np.full((4, 28, 3), 100), (100, 100, 160), False)
    colour = np.array([10, 200, 30])
    clear = np.dstack([large["mei"], np.zeros((30, 38), np.uint8)])
    over, less = hud.fused({"mei": clear}, colour)
    assert np.allclose(over["mei"], colour) and less["mei"].shape == (26, 33, 3)
    frame = np.zeros((60, 1200, 3), np.uint8)
    frame[53, 40], frame[54, 1183] = (1, 2, 3), (4, 5, 6)
    assert [c.tolist() for c in hud.team_colours(frame)] == [[1, 2, 3], [4, 5, 6]]
    white, replay = np.full((15, 70, 3), 250), picture(11, 66, 74)
    assert hud.valid_frame(white, [picture(12, 66, 74)] * 2, replay, True) == (True, False) and hud.valid_frame(white, [replay, replay], replay, True) == (False, True)
    assert hud.valid_frame(white, [replay], replay, False) == hud.valid_frame(white // 2, [replay], replay, True) == (False, False)


def digits():
    return [np.kron(np.random.default_rng(50 + d).integers(0, 2, (8, 3)), np.ones((2, 2))) * 215 + 20 for d in range(10)]


def test_older_charges():
    references = digits()

    def shown(*values):
        """Digits side by side, dark on white, a plain column between them, slanted against the shear."""
        image = np.full((20, 4 + 9 * len(values)), 235.0)
        for n, v in enumerate(values):
            image[2:18, 3 + 9 * n : 9 + 9 * n] = references[v]
        wide = np.pad(image, ((0, 0), (0, 8)), mode="edge")
        at = np.clip(np.arange(wide.shape[1])[None] + np.round(np.arange(20) * 0.25396).astype(int)[:, None], 0, wide.shape[1] - 1)
        return np.take_along_axis(wide, at, 1)

    assert hud.ult_charge(shown(3), references, ready=True) == 100
    for v in (0, 4, 7):
        assert hud.ult_charge(shown(v), references) == v
    right = sum(hud.ult_charge(shown(a, b), references) == 10 * a + b for a, b in ((1, 2), (4, 7), (9, 5), (3, 8)))
    assert right >= 3
    assert hud.gap_column(np.tile(np.repeat([1.0, 0.0, 1.0], [6, 1, 6]), (2, 1)) * np.array([[0], [1]])) == 6


def test_older_kill_rows():
    heroes = {n: picture(20 + k, 21, 31) for k, n in enumerate(["ana", "mei", "zarya"])}
    colours = [np.array([220, 60, 20]), np.array([20, 60, 220])]

    def row(killer, victim, a=60, b=200):
        image = np.full((27, 320, 3), 128, np.uint8)
        for x, name, colour, side in ((a, killer, 0, -10), (b, victim, 1, 41)):
            image[3:24, x : x + 31] = heroes[name]
            image[2, max(0, x + side)] = colours[colour]
            image[:, [x - 1, x + 31]] = 0
        return image

    for a, b in (("ana", "mei"), ("zarya", "ana"), ("mei", "zarya")):
        killer, victim = hud.kill_players(row(a, b), heroes, colours)
        assert (killer["hero"], killer["team"], victim["hero"], victim["team"]) == (a, 0, b, 1)
        assert abs(killer["x"] - 60) <= 1 and abs(victim["x"] - 200) <= 1
    assert hud.kill_players(np.full((27, 320, 3), 128, np.uint8), heroes, colours) == (None, None)
    found = [{"x": x, "hero": "h"} for x in (60, 63, 120, 200, 202)]
    assert [f["x"] for f in hud.at_the_ends(found)] == [60, 63, 200, 202]
    scores = np.zeros((2, 120))
    scores[1, 40], scores[0, 44], scores[1, 100] = 0.9, 0.8, 0.7
    assert hud.two_places(scores, 20, 20) == [(0.9, 40), (0.7, 100)]


def test_older_abilities_assists_and_headshots():
    signs = {"e": (np.kron(np.random.default_rng(70).integers(0, 2, (6, 6)), np.ones((4, 4))) * 255), "shift": (np.kron(np.random.default_rng(71).integers(0, 2, (6, 6)), np.ones((4, 4))) * 255)}
    helpers = {n: picture(80 + k, 18, 12) for k, n in enumerate(["lucio", "mercy"])}
    killer_x, size = 20, 31
    for sign, names in (("e", []), ("shift", ["mercy"]), (None, ["lucio"]), (None, [])):
        gap = 30 + 18 * len(names) + (26 if sign else 4 if names else 0)
        victim_x = killer_x + size + gap
        row = np.full((27, 320, 3), 30, np.uint8)
        if sign:
            x = victim_x - 23 - 30
            row[5:27, x + 3 : x + 27][signs[sign][:22] > 0] = 255
            row[17, x + 28] = 255
        for n, name in enumerate(names):
            x = killer_x + size + 8 + 18 * n
            row[6:24, x : x + 12] = helpers[name]
            row[:, x + 13] = 255
        assert hud.ability(row, killer_x, victim_x, {k: v[:22] for k, v in signs.items()}) == sign
        assert hud.assists(row, killer_x, victim_x, helpers)[: len(names)] == names
    row = np.full((27, 320, 3), 255, np.uint8)
    assert not hud.headshot(row, 200)
    row[17, 179] = (0, 0, 255)
    assert hud.headshot(row, 200)
