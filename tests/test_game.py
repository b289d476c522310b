"""The match pipeline against a plain restatement, and the paged source."""

import random

import pytest
from ordwell.operators import game, killrows
from ordwell.operators import states as s
from ordwell.sources import paged

RULES = game.Rules(mech_hero="h0")


def made(seed, matches=2, frames=36):
    rnd = random.Random(seed)
    states, flags, kills = [], [], []
    for m in range(matches):
        for f in range(frames):
            flags.append((m, f, f * 0.5, rnd.random() > 0.08, rnd.random() < 0.04))
            for slot in range(12):
                charge = min(100, (f * 4 + slot * 3) % 104)
                states.append((m, slot, f, f * 0.5, f"h{(slot + (rnd.random() < 0.15)) % 6}", False, charge >= 100, charge))
            for row in range(rnd.choice([0, 0, 1, 2])):
                res, side = rnd.random() < 0.2, rnd.randint(0, 1)
                killer = None if rnd.random() < 0.1 else f"h{rnd.randint(0, 6)}"
                victim = "meka" if not res and rnd.random() < 0.3 else f"h{rnd.randint(0, 6)}"
                kills.append((m, f, row, side if res else 1 - side, killer, side, victim, res and killer is not None))
    return states, flags, kills


def series(rows):
    """Rows of each (match, slot) in order of frames."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["m"], r["slot"], r["f"])):
        out.setdefault((r["m"], r["slot"]), []).append(r)
    return out


def plain(states, flags, kills):
    """All passes over lists of dicts, one after the other."""
    keep = set()
    for m in {x[0] for x in flags}:
        own = sorted(x for x in flags if x[0] == m)
        bad = set()
        for i in range(5, len(own)):
            if not own[i][3] and not own[i - 5][3]:
                bad |= set(range(i - 5, i + 1))
        for i, x in enumerate(own):
            if x[3] and i not in bad and not (i >= 4 and any(y[4] for y in own[max(0, i - 4) : i + 1])):
                keep.add((m, x[1]))
    st = [dict(zip(("m", "slot", "f", "t", "hero", "dead", "ready", "charge"), x, strict=True)) for x in states if (x[0], x[2]) in keep]
    ks = [dict(zip(("m", "f", "row", "kt", "killer", "vt", "victim", "res"), x, strict=True)) for x in kills if (x[0], x[1]) in keep]

    def smooth():
        for own in series(st).values():
            for r, h in zip(own, s.smooth_list([r["hero"] for r in own]), strict=True):
                r["hero"] = h

    def freeze():
        for own in series(st).values():
            held = None
            for i, r in enumerate(own):
                if i == 0 or not r["dead"]:
                    held = (r["hero"], r["charge"], r["ready"])
                r["hero"], r["charge"], r["ready"] = held

    def rematch(alive):
        for k in ks:
            for role, side in (("killer", "kt"), ("victim", "vt")):
                seen = [r for r in st if r["m"] == k["m"] and r["f"] <= k["f"] and (r["slot"] >= 6) == (k[side] == 1) and r["hero"] == ("h0" if k[role] == "meka" else k[role]) and not (alive and r["dead"])]
                last = max((r["f"] for r in seen), default=None)
                k[role + "_slot"] = min((r["slot"] for r in seen if r["f"] == last), default=-1)

    smooth()
    rematch(False)
    for (m, slot), own in series(st).items():
        each = [[("res" if k["res"] else "kill") for k in sorted(ks, key=lambda k: k["row"]) if (k["m"], k["victim_slot"], k["f"]) == (m, slot, r["f"]) and k["victim"] != "meka"] for r in own]
        for r, d in zip(own, s.death_states([r["t"] for r in own], each, 0.5), strict=True):
            r["dead"] = d
    freeze()
    rematch(True)
    smooth()
    freeze()
    down = {(k["m"], k["victim_slot"], k["f"]) for k in ks if k["victim"] == "meka"}
    for key, own in series(st).items():
        status, ready, second = s.mech_states([r["hero"] for r in own], [r["ready"] for r in own], [r["charge"] for r in own], [(*key, r["f"]) in down for r in own], 2, "h0")
        charge, ready = s.repair_charge([r["charge"] for r in own], ready, [r["hero"] for r in own], status, 2, "h0")
        for r, *x in zip(own, status, second, charge, ready, strict=True):
            r["mech"], r["second"], r["charge"], r["ready"] = x
    smooth()
    by = {(r["m"], r["slot"], r["f"]): r for r in st}
    order = {key: [r["f"] for r in own] for key, own in series(st).items()}
    left, last = [], {}
    for k in sorted(ks, key=lambda k: (k["m"], k["f"], k["row"])):
        pair, before = (k["kt"], k["killer"], k["vt"], k["victim"]), last.get(k["m"])
        last[k["m"]] = (k["f"], pair)
        if before and before[0] < k["f"] and before[1] == pair:
            continue
        frames = order.get((k["m"], k["victim_slot"]), [])
        i = frames.index(k["f"]) if k["f"] in frames else -1
        if i >= 2:
            two = by[k["m"], k["victim_slot"], frames[i - 2]]
            if two["dead"] and not k["res"] and k["victim"] != "meka" and by[k["m"], k["victim_slot"], k["f"]]["t"] - two["t"] <= 1.2:
                continue
        left.append(k)
    return st, left


@pytest.mark.parametrize("seed", [1, 2])
def test_passes_match_a_plain_restatement(spark, seed):
    states, flags, kills = made(seed)
    g = game.Game(
        spark.createDataFrame(states, "match_id long, slot int, frame int, time double, hero string, is_dead boolean, is_ult_ready boolean, ult_charge int"),
        spark.createDataFrame(flags, "match_id long, frame int, time double, is_valid boolean, is_replay boolean"),
        spark.createDataFrame(kills, "match_id long, frame int, row int, killer_team int, killer string, victim_team int, victim string, is_res boolean"),
        RULES,
    )
    out = g.analyse()
    st, ks = plain(states, flags, kills)
    got = {(r.match_id, r.slot, r.frame): (r.hero, r.is_dead, r.is_ult_ready, r.ult_charge, r.mech_status, r.is_secondary_ult_ready) for r in out["player_frames"].collect()}
    assert got == {(r["m"], r["slot"], r["f"]): (r["hero"], r["dead"], r["ready"], r["charge"], r["mech"], r["second"]) for r in st}
    found = {(r.match_id, r.frame, r.row): (r.killer_slot, r.victim_slot) for r in out["kills"].collect()}
    assert found == {(k["m"], k["f"], k["row"]): (k["killer_slot"], k["victim_slot"]) for k in ks}
    events = out["timeline"].collect()
    assert sum(e.phase == 1 for e in events) == len(ks) and {e.action for e in events if e.phase == 1} <= {"Resurrect", "Demech", "Suicide", "Eliminate"}
    assert sum(e.action == "Demech" for e in events) == sum(k["victim"] == "meka" for k in ks) > 0
    by = {(r["m"], r["slot"], r["f"]): r for r in st}
    ups = [by[e.match_id, e.subject, e.frame] for e in events if e.action == s.MECH_UP]
    assert all(r["hero"] == "h0" and r["mech"] == 1 and not r["ready"] for r in ups)
    assert out["lineups"].count() == 24 and all(len(r.players) == 12 for r in out["states"].collect())


def test_a_mech_goes_down_and_its_pilot_lives(spark):
    """One pilot, one row with the mech as victim: no death, no mech from there on, Demech in the timeline."""
    states = [(1, slot, f, f * 0.5, "dva" if slot == 7 else f"x{slot}", False, False, 10) for slot in range(12) for f in range(10)]
    g = game.Game(
        spark.createDataFrame(states, "match_id long, slot int, frame int, time double, hero string, is_dead boolean, is_ult_ready boolean, ult_charge int"),
        spark.createDataFrame([(1, f, f * 0.5, True, False) for f in range(10)], "match_id long, frame int, time double, is_valid boolean, is_replay boolean"),
        spark.createDataFrame([(1, 4, 0, 0, "x2", 1, "meka", False), (1, 6, 0, 0, "x3", 1, "turret", False)], "match_id long, frame int, row int, killer_team int, killer string, victim_team int, victim string, is_res boolean"),
    )
    out = g.analyse()
    own = sorted((r.frame, r.mech_status, r.is_dead) for r in out["player_frames"].where("slot = 7").collect())
    assert own == [(f, int(f >= 4), False) for f in range(10)]
    assert sorted((e.action, e.subject, e.object) for e in out["timeline"].collect()) == [("Demech", 2, 7), ("Eliminate", 3, -1)]


def test_parameters():
    killrows.sampling_parameters(0, 0, 2, 0)
    killrows.sampling_parameters(1.5, 20, 0.5, 1)
    for wrong in ((5, 1, 2, 0), (-1, 3, 2, 0), (0, 1, 0, 0), (0, 1, -2, 1), (0, 1, 2, 7)):
        with pytest.raises(ValueError):
            killrows.sampling_parameters(*wrong)


class Service:
    """A paged service that is busy every other time."""

    def __init__(self):
        self.asked = 0

    def __call__(self, token, limit):
        self.asked += 1
        if self.asked % 2:
            raise paged.Busy(0)
        return paged.made_up(token, limit, "25")


def test_pages_are_asked_for_again():
    service, slept, rows, token = Service(), [], [], ""
    while token is not None:
        more, token = paged.one_page(service, token, 10, 3, slept.append)
        rows += more
    assert len(rows) == 25 and len(slept) == 3 and service.asked == 6
    with pytest.raises(paged.Busy):
        paged.one_page(Service(), "", 10, 1)


def test_paged_table_and_resumed_stream(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    options = {"fetch": "ordwell.sources.paged:made_up", "fetch.rows": "95", "page": "20"}
    want = {f"Picture_{i:06d}.png" for i in range(95)}
    assert {r.name for r in spark.read.format("ordwell_paged").options(**options).load().collect()} == want
    reader = paged.PagedStream(options)
    at, seen, pages = reader.initialOffset(), [], 0
    while not at["end"]:
        start = at
        rows, at = reader.read(start)
        rows = list(rows)
        again = list(paged.PagedStream(options).readBetweenOffsets(start, at))  # as after a restart
        assert rows == again
        seen += rows
        pages += 1
    assert pages == 5 and [r[0] for r in seen] == sorted(want)

    def take(seconds):
        q = spark.readStream.format("ordwell_paged").options(**options).load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        q.awaitTermination(seconds)
        q.stop()

    take(6)
    take(6)
    got = [r.name for r in spark.read.schema("name string, url string").parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 20
