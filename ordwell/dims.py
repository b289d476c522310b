"""Fixed values of the domain: heroes, objects, ability codes, labels."""

from __future__ import annotations

#: Objects that can be destroyed, and the hero each belongs to.
OBJECT_HERO = {"meka": "dva", "riptire": "junkrat", "shield": "symmetra", "supercharger": "orisa", "teleporter": "symmetra", "turret": "torbjon"}
#: Names whose display form isn't the capitalised one.
DISPLAY = {"dva": "D. Va", "meka": "MEKA", "soldier76": "Soldier: 76"}
#: Ability codes.
ABILITIES = {0: "Plain Attack", 1: "Shift", 2: "E", 3: "Ultimate 1", 4: "Ultimate 2", 5: "Right Click", 6: "Passive", 7: "E2"}
#: Comments by action.
COMMENTS = {"Resurrect": "Resurrect", "Demech": "MEKA destroyed", "Eliminate": "", "Suicide": ""}
WITH_MECH, WITHOUT_MECH, NO_MECH = 0, 1, 2
SLOTS = 12
MAX_ROWS = 6
FIGHT_GAP = 14.0
FIGHT_TAIL = 7.0
RESPAWN = 10.0
SWITCH_DELAY = 1.5
#: Colours (BGR) of the kill feed's boxes for team 0 and team 1.
TEAM_COLOURS = ((40, 40, 220), (220, 220, 40))
