"""Byte-level BPE as finite-state machines, compiled from a vocabulary file as texts need them.

For every prefix of a pre-token the last token of its encoding is unique, and a
token u may follow a token t exactly if no merge joins the end of t to the start
of u before either is complete. So the encoding of a growing prefix is a path of
back-pointers, and what the future can still see of it is finite: the longest
suffix that begins some token, and at each position in it the parts of the last token
that may yet join what follows. That is a state; reading a byte moves to another state.
Transitions are made when first met.

Counter's states also hold counts relative to the newest, and its transitions add to the
number of tokens (the annotation may be negative, where tokens join). Pre-tokens of many
texts step through it side by side. A long text is cut at any byte; what each chunk does
to a state is a map (StateMap), and maps compose, in a tree.

Transducer's transitions name the newest token, and it emits tokens once they are stable.
"""

from __future__ import annotations

import codecs
import gc
import json
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

#: Bytes of text worked on at a time; a pre-token longer than LONG is walked through alone.
CHUNK = 1 << 20
LONG = 48
#: Bytes of a chunk whose state map is made for counts.
MAPPED = 1 << 12
#: Bytes on both sides of a stretch that decide where pre-tokens start in it: four characters.
EDGE = 16
#: States a worker keeps, transitions and pre-tokens that it keeps for single walks, and answers about edges.
STATES = 250_000
WALKS = 100_000
WORDS = 200_000
KNOWN = 150_000
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            skip = 0x800 * (m.start() >= 0xD800)
            out[m.start() + skip : m.end() + skip] = kind
    return out


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a byte-level BPE file."""

    def __init__(self, path: str, known: int | None = None):
        self.most_known = known or KNOWN
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        model, names = doc["model"], byte_names()
        pre = doc["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or doc["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        self.special = {t["content"]: t["id"] for t in doc["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {}
        self.ids: dict[bytes, int] = {}
        for name, i in model["vocab"].items():
            if name in self.special:
                continue
            raw = bytes(names[c] for c in name)
            self.bytes_of[i] = raw
            self.ids[raw] = i
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((bytes(names[c] for c in a), bytes(names[c] for c in b)), k)
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        strings = sorted((x.encode() for x in self.special), key=len, reverse=True)
        self.special_re = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        self.made_of = {a + b: (a, b) for a, b in reversed(self.rank)}
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.reachable: set[bytes] = set()
        for raw in self.ids:  # only what the merges themselves arrive at can be in an encoding
            a, b = self.made_of.get(raw, (b"", b""))
            if len(raw) == 1 or a in self.reachable and b in self.reachable and not self.crossed(a, b, self.rank[a, b]):
                self.reachable.add(raw)
        self.longest = max(map(len, self.reachable))
        #: How many bytes back a later token can begin: over the longest proper beginning of a token that merges arrive at.
        #: So with so many bytes read on, nothing further back is decided anew but by what those positions' paths share.
        self.lookahead = self.longest - 1
        self.prefixes: dict[bytes, int] = {}
        for raw in self.reachable:
            for k in range(len(raw) + 1):
                self.prefixes.setdefault(raw[:k], len(self.prefixes))
        self.partners: dict[bytes, set[bytes]] = {}
        for a, b in self.rank:
            self.partners.setdefault(a, set()).add(b)
        self.edges: list[tuple] = [()]  # edge 0: a start, or an end that nothing joins
        self.edge_of: dict[tuple, int] = {(): 0}
        self.known: tuple[dict, dict, dict] = ({}, {}, {})
        self.begun: dict[bytes, frozenset[bytes]] = {}
        self.intern = {raw: raw for raw in self.reachable}

    def spine(self, raw: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of a token along one edge (0 left, 1 right), each with the rank of the merge that takes it up."""
        found = self.spines.get((raw, side))
        if found is None:
            found, part, until = [], raw, 1 << 60
            while True:
                found.append((part, until))
                if part not in self.made_of:
                    break
                until = self.rank[self.made_of[part]]
                part = self.made_of[part][side]
            self.spines[raw, side] = found
        return found

    def crossed(self, left: bytes, right: bytes, until: int = 1 << 60) -> bool:
        """Whether a merge below rank until joins the end of left to the start of right.

        It does if both of its parts are there when its turn comes: neither edge part has
        been taken up by then. At equal rank the merge further left comes first.
        """
        return self.joined(self.spine(left, 1), right, until)

    def joined(self, edge, right: bytes, until: int) -> bool:
        for x, x_until in edge:
            for y, y_until in self.spine(right, 0):
                r = self.rank.get((x, y))
                if r is not None and r < until and r < x_until and r <= y_until:
                    return True
        return False

    def edge(self, parts: tuple) -> int:
        """The number of an edge: parts at the end of a token that may yet join what follows."""
        found = self.edge_of.get(parts)
        if found is None:
            found = self.edge_of[parts] = len(self.edges)
            self.edges.append(parts)
        return found

    def edge_after(self, token: bytes) -> int:
        """The edge of a token."""
        known = self.known[0]
        if token not in known:
            known[token] = self.edge(tuple(x for x in self.spine(token, 1) if x[0] in self.partners))
        return known[token]

    def narrowed(self, edge: int, ahead: bytes) -> int:
        """The edge's parts that a token which goes on with ahead can still join: equal edges make equal states."""
        known, key = self.known[1], edge << 32 | self.prefixes[ahead]
        found = known.get(key)
        if found is None:
            if len(known) > self.most_known:
                known.clear()
            begun = [ahead[:k] for k in range(1, len(ahead) + 1)]
            parts = tuple(x for x in self.edges[edge] if ahead in self.beginnings(x[0]) or any(y in self.partners[x[0]] for y in begun))
            found = known[key] = self.edge(parts)
        return found

    def beginnings(self, part: bytes) -> frozenset[bytes]:
        """All beginnings of what part can be joined with."""
        found = self.begun.get(part)
        if found is None:
            found = self.begun[part] = frozenset(y[:k] for y in self.partners[part] for k in range(len(y) + 1))
        return found

    def adjoins(self, edge: int, token: bytes) -> bool:
        """Whether token may follow in an encoding: no merge joins a part of the edge to the token's start in time."""
        known, key = self.known[2], edge << 32 | self.ids[token]
        found = known.get(key)
        if found is None:
            if len(known) > self.most_known:
                known.clear()
            found = known[key] = not self.joined(self.edges[edge], token, 1 << 60)
        return found


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 belongs to."""
    table = kinds()
    out = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
            at = lead[(first >= low) & (first < high)]
            if not len(at):
                continue
            point = data[at].astype(np.int32) & (0xFF >> (size + 1))
            for k in range(1, size):
                point = point << 6 | (data[at + k] & 0x3F)
            kind = table[point]
            for k in range(size):
                out[at + k] = kind
    return out


def pretokens(data: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of data start. parts: where texts start in it, in order, the first at 0.

    The rules of the byte-level pattern: runs of letters, of numbers and of other signs,
    each with one blank before it if there is one; of white space before such a run, all
    but its last character; the contractions 's 't 're 've 'm 'll 'd where a sign run of
    one apostrophe starts without a blank.
    """
    n = len(data)
    kind = byte_kinds(data)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[parts] = True
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], n)
    own = kind[runs]
    opens = np.zeros(n + 1, bool)  # a text starts here
    opens[parts] = opens[n] = True
    mark = np.zeros(n + 1, bool)
    word = own != BLANK
    at = runs[word]
    spaced = (at > 0) & ~opens[at] & (data[at - 1] == 32)
    mark[at - spaced] = True
    at, end = runs[~word], ends[~word]
    before = ~opens[end]  # a word of the same text follows
    last = end - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    blank = data[end - 1] == 32
    mark[at[~before | (last > at) | ~blank]] = True
    mark[last[before & ~blank]] = True
    alone = np.flatnonzero((own == OTHER) & (ends - runs == 1) & (data[runs] == 39) & mark[runs])
    alone = alone[alone + 1 < len(runs)]
    alone = alone[(own[alone + 1] == LETTER) & ~opens[ends[alone]]]
    if len(alone):
        at, size = ends[alone], (ends - runs)[alone + 1]
        one, two = data[at], np.where(size > 1, data[np.minimum(at + 1, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        taken = np.where(short, 1, np.where(pair, 2, 0))
        at, size, taken = at[taken > 0], size[taken > 0], taken[taken > 0]
        mark[at] = False
        mark[(at + taken)[taken < size]] = True
    return np.flatnonzero(mark[:n])


def starts_in(data: bytes, a: int, b: int) -> np.ndarray:
    """Where the pre-tokens of a whole text start between a and b, from those bytes and a few around them."""
    low, high = max(0, a - EDGE), min(len(data), b + EDGE)
    while low and data[low] & 0xC0 == 0x80:
        low -= 1
    while high < len(data) and data[high] & 0xC0 == 0x80:
        high += 1
    marks = pretokens(np.frombuffer(data, np.uint8, high - low, low), np.zeros(1, np.int64)) + low
    return marks[(marks >= a) & (marks < b)]


@dataclass(frozen=True)
class StateMap:
    """What the bytes from start to stop of a text do to the machine's state.

    Up to head they belong to a pre-token that began before start, so what they do depends
    on the state they meet. If a pre-token starts among them (exit is not None), all from
    there on is a constant: total tokens, and the state exit at stop.
    """

    start: int
    head: int
    stop: int
    total: int
    exit: bytes | None


class Counter:
    """Deterministic transitions over bytes, each with the change of the token count.

    A state is (suffix, edges, behind): the longest end of the input that begins a
    token; at each position in it from which a token could go on, the edge of the last
    token of the encoding up to there (what of its end later bytes may still join), and
    its count less the newest count. Transitions lie in
    an open hash table of arrays, so that many inputs can step at once.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.walked: dict[int, tuple[int, int]] = {}
        self.state(b"", [0], [0])
        self.table(18, np.empty(0, np.int64), np.empty((2, 0), np.int32))

    def table(self, bits: int, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros((2, 1 << bits), np.int32)  # next state, change
        self.insert(keys, values)

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put new keys into the table; larger before it is half full."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.append(self.keys[old], keys), np.append(self.values[:, old], values, axis=1)
            return self.table(self.bits + 1, keys, values)
        self.used += len(keys)
        slot = self.hash(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of those that meet in a slot one stays
            here = self.keys[slot] == keys
            self.values[:, slot[here]] = values[:, here]
            keys, values, slot = keys[~here], values[:, ~here], (slot[~here] + 1) & (len(self.keys) - 1)
        return None

    def hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def state(self, suffix: bytes, edges: list[int], behind: list[int]) -> int:
        """The number of a state, which is kept packed."""
        return self.numbered(suffix + struct.pack(f"<{len(edges)}i{len(behind)}h", *edges, *behind))

    def numbered(self, packed: bytes) -> int:
        found = self.number.get(packed)
        if found is None:
            found = self.number[packed] = len(self.states)
            self.states.append(packed)
        return found

    def step(self, key: int) -> tuple[int, int]:
        """The transition of state key >> 8 on byte key & 255: next state and change of the count."""
        packed = self.states[key >> 8]
        n = len(packed) // 7  # suffix of n bytes, n + 1 edges of 4, n + 1 counts of 2
        both = struct.unpack_from(f"<{n + 1}i{n + 1}h", packed, n)
        run, edges, behind, change, _ = advance(self.vocabulary, packed[:n], both[: n + 1], both[n + 1 :], key & 255)
        return self.state(run, edges, behind), change

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; transitions met for the first time are made."""
        while True:
            slot, wait = self.hash(keys), np.arange(len(keys))
            missing = []
            while len(wait):
                there = self.keys[slot[wait]]
                missing.append(wait[there < 0])
                wait = wait[(there != keys[wait]) & (there >= 0)]
                slot[wait] = (slot[wait] + 1) & (len(self.keys) - 1)
            gone = np.concatenate(missing) if missing else wait
            if not len(gone):
                return slot
            new = np.unique(keys[gone])
            self.insert(new, np.array([self.step(k) for k in new.tolist()], np.int32).T)

    def run(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All stretches of data side by side, from the first state: the count and the last state of each."""
        if len(self.states) > STATES:
            self.clear()
        size = stops - starts
        counts, states = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        alone: dict[int, bytes] = {}  # packed, as a walk may forget states' numbers
        for k in np.flatnonzero(size > LONG).tolist():
            last, counts[k] = self.walk(0, data[starts[k] : stops[k]].tobytes())
            alone[k] = self.states[last]
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -LONG) :]
        begin, size_of = starts[order], size[order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int32)
        for j in range(int(size_of[0]) if len(size_of) else 0):
            a = int(np.searchsorted(-size_of, -j))  # those longer than j
            slot = self.find(state[:a] << 8 | data[begin[:a] + j])
            state[:a], change = self.values[:, slot]
            count[:a] += change
        counts[order], states[order] = count, state
        for k, packed in alone.items():
            states[k] = self.numbered(packed)
        return counts, states

    def walk(self, state: int, raw: bytes) -> tuple[int, int]:
        """The state and the change of the count after raw, from any state."""
        walked, total = self.walked, 0
        for byte in raw:
            key = state << 8 | byte
            found = walked.get(key)
            if found is None:
                if len(self.states) > STATES:  # a walk alone may forget: it needs its own state only
                    packed = self.states[state]
                    self.clear()
                    walked, key = self.walked, self.numbered(packed) << 8 | byte
                if len(walked) > WALKS:
                    walked.clear()
                found = walked[key] = self.step(key)
            state, change = found
            total += change
        return state, total

    def maps_of(self, data: bytes, cuts: np.ndarray, starts: np.ndarray) -> list[StateMap]:
        """The maps of the chunks between neighbouring cuts, made side by side; each rests on its own bytes alone.

        starts: where pre-tokens start from the first cut on. The pre-token that a cut goes through
        belongs to its chunk up to the cut; what comes after is for compose.
        """
        if len(cuts) < 2:
            return []
        starts = starts[(starts >= cuts[0]) & (starts < cuts[-1])]
        first = np.searchsorted(starts, cuts)  # of the chunks' pre-tokens
        stops = np.minimum(np.append(starts[1:], cuts[-1]), cuts[np.searchsorted(cuts, starts, "right")]) if len(starts) else starts
        counts, states = self.run(np.frombuffer(data, np.uint8), starts, stops)
        total, heads = np.diff(np.append(0, np.cumsum(counts))[first]).tolist(), np.append(starts, 0)[first[:-1]].tolist()
        exits, edges, bounds = states.tolist(), cuts.tolist(), first.tolist()
        return [
            StateMap(a, heads[k], b, total[k], self.states[exits[bounds[k + 1] - 1]]) if bounds[k] < bounds[k + 1] else StateMap(a, b, b, 0, None)
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        ]

    def map_of(self, data: bytes, a: int, b: int) -> StateMap:
        """The map of the bytes a to b of a text; they may be cut anywhere."""
        return self.maps_of(data, np.array([a, b]), starts_in(data, a, b))[0]

    def compose(self, data: bytes, f: StateMap, g: StateMap) -> StateMap:
        """First f, then g, which begins where f stops. Composition is associative."""
        if f.exit is None:
            return StateMap(f.start, g.head, g.stop, g.total, g.exit)
        state, n = self.walk(self.numbered(f.exit), data[g.start : g.head])
        return StateMap(f.start, f.head, g.stop, f.total + n + g.total, self.states[state] if g.exit is None else g.exit)

    def scan(self, data: bytes, maps: list[StateMap]) -> StateMap:
        """All maps of a text's chunks composed, neighbours first, as in a parallel scan."""
        while len(maps) > 1:
            maps = [self.compose(data, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]


def advance(v: Vocabulary, suffix: bytes, edges, behind, byte: int):
    """One byte on: the new suffix, edges and counts, the change of the count, and the newest token."""
    run = suffix + bytes((byte,))
    for k in range(len(run)):  # longest candidate first; a single byte always fits
        token = run[k:]
        if token in v.reachable and v.adjoins(edges[k], token):
            break
    else:
        raise ValueError(f"the vocabulary has no token for byte {byte}")
    token, change = v.intern[token], behind[k] + 1
    edges, behind = [*edges, v.edge_after(token)], [*behind, change]
    while run not in v.prefixes:
        run = run[1:]
    edges, behind = edges[-len(run) - 1 :], behind[-len(run) - 1 :]
    for k in range(len(run)):
        if run[k:] in v.prefixes:
            edges[k] = v.narrowed(edges[k], run[k:])
            behind[k] -= change
        else:
            edges[k], behind[k] = 0, 0  # no token can go on from here
    behind[-1] = 0
    return run, edges, behind, change, token


class Transducer:
    """Emits the tokens of pre-tokens that are read byte by byte, each once no later byte can change it.

    A state is (suffix, edges), as Counter's without counts; a transition names the newest
    token. What later bytes can still reach are the positions in the suffix, at most the
    vocabulary's lookahead back. The part of the back-pointer path that all of them share is
    stable: it is emitted and forgotten. That is tested each time twice the lookahead is
    held, so the cost of a byte is constant, and what is held is bounded by the lookahead,
    not by the input's length.
    """

    def __init__(self, vocabulary: Vocabulary, states: int | None = None, words: int | None = None):
        self.vocabulary, self.most_states, self.most_words = vocabulary, states or STATES, words or WORDS
        self.sizes = [len(vocabulary.bytes_of.get(i, b"")) for i in range(max(vocabulary.bytes_of) + 1)]
        self.clear()

        self.words: dict[bytes, bytes] = {}

    def clear(self) -> None:
        """Drop all states and transitions, and what was read."""
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.moves: dict[int, int] = {}
        self.numbered(struct.pack("<i", 0))
        self.reset()

    def numbered(self, packed: bytes) -> int:
        """The number of a state, which is kept packed: its suffix, then n + 1 edges for n bytes."""
        found = self.number.get(packed)
        if found is None:
            found = self.number[packed] = len(self.states)
            self.states.append(packed)
        return found

    def reset(self) -> None:
        self.now, self.held, self.due = 0, [], 2 * self.vocabulary.lookahead

    def move(self, key: int) -> int:
        """Next state and, in the last 24 bits, newest token of state key >> 8 on byte key & 255."""
        packed = self.states[key >> 8]
        n = (len(packed) - 4) // 5
        edges = struct.unpack_from(f"<{n + 1}i", packed, n)
        run, edges, _, _, token = advance(self.vocabulary, packed[:n], edges, (0,) * len(edges), key & 255)
        found = self.numbered(run + struct.pack(f"<{len(edges)}i", *edges))
        self.moves[key] = found << 24 | self.vocabulary.ids[token]
        return self.moves[key]

    def feed(self, raw: bytes) -> list[int]:
        """Read on in the open pre-token; the ids that became stable."""
        out: list[int] = []
        moves, now, held = self.moves, self.now, self.held
        for byte in raw:
            key = now << 8 | byte
            found = moves.get(key)
            if found is None:
                found = self.move(key)
            now = found >> 24
            held.append(found & 0xFFFFFF)
            if len(held) >= self.due:
                done = shared([self.sizes[t] for t in held], (len(self.states[now]) - 4) // 5)
                out += self.path(held[:done])
                del held[:done]
                self.due = len(held) + 2 * self.vocabulary.lookahead
                if len(self.states) > self.most_states or len(moves) > 2 * self.most_states:
                    now = self.forget(now)
                    moves = self.moves
        self.now = now
        return out

    def end(self) -> list[int]:
        """Close the pre-token; the ids that were held."""
        out = self.path(self.held)
        self.reset()
        return out

    def path(self, held: list[int]) -> list[int]:
        """The ids of the encoding of what held's tokens end at, by the back-pointers."""
        out, end, sizes = [], len(held), self.sizes
        while end > 0:
            token = held[end - 1]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out

    def forget(self, now: int) -> int:
        """Drop all states but one, and return its new number."""
        kept, held, due = self.states[now], self.held, self.due
        self.clear()
        self.held, self.due = held, due
        return self.numbered(kept)

    def word(self, raw: bytes) -> bytes:
        """The packed ids of a whole pre-token; those of short ones are kept."""
        if len(self.states) > self.most_states or len(self.moves) > 2 * self.most_states:
            self.forget(0)
        if len(raw) > LONG:
            return array("I", self.feed(raw) + self.end()).tobytes()
        moves, now, held = self.moves, 0, []
        for byte in raw:  # as feed, for less than a lookahead
            found = moves.get(now << 8 | byte)
            if found is None:
                found = self.move(now << 8 | byte)
            now = found >> 24
            held.append(found & 0xFFFFFF)
        if len(self.words) >= self.most_words:
            self.words.clear()
        packed = self.words[raw] = array("I", self.path(held)).tobytes()
        return packed

    def read(self, text: bytes, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """Packed ids of a stretch of text that has no special string, chunk by chunk; a pre-token may span chunks."""
        raw = text if stop is None else text[start:stop]
        get, is_open = self.words.get, False
        for a in range(0, len(raw), CHUNK):
            b = min(len(raw), a + CHUNK)
            starts = starts_in(raw, a, b).tolist()
            out = []
            if is_open:
                ids = self.feed(raw[a : starts[0] if starts else b])
                if starts or b == len(raw):
                    ids += self.end()
                    is_open = False
                out.append(array("I", ids).tobytes())
            if starts:
                stops = [*starts[1:], b]
                if b < len(raw):  # the last pre-token may go on
                    stops.pop()
                for piece in [raw[x:y] for x, y in zip(starts, stops, strict=False)]:
                    out.append(get(piece) or self.word(piece))
                if b < len(raw):
                    ids, is_open = self.feed(raw[starts[-1] : b]), True
                    out.append(array("I", ids).tobytes())
            yield b"".join(out)


def shared(sizes: list[int], live: int) -> int:
    """The furthest position on the back-pointer paths of all of the last live positions; sizes: of the newest token at each."""
    ends = set(range(max(0, len(sizes) - live), len(sizes) + 1))
    while len(ends) > 1:
        top = max(ends)
        ends.discard(top)
        ends.add(top - sizes[top - 1])
    return max(0, *ends)


class Decoder:
    """Incremental byte-to-text machine: between blocks of ids it keeps at most three bytes of an unfinished character."""

    def __init__(self, vocabulary: Vocabulary):
        self.get, self.machine = vocabulary.bytes_of.__getitem__, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        """The text of packed ids so far; bytes that are no UTF-8 become U+FFFD."""
        return self.machine.decode(b"".join(map(self.get, np.frombuffer(packed, "<u4").tolist())))

    def end(self) -> str:
        return self.machine.decode(b"", True)


class Tokenizer:
    """Token counts, ids and texts for one vocabulary. share: the part of the usual memory for what is kept."""

    def __init__(self, path: str, share: float = 1.0):
        own = lambda most: max(1, int(most * share))
        self.vocabulary = Vocabulary(path, own(KNOWN))
        self.counter = Counter(self.vocabulary)
        self.transducer = Transducer(self.vocabulary, own(STATES), own(WORDS))

    def rest(self) -> None:
        """Forget what was made as texts needed it; it is made again when they need it."""
        self.counter.clear()
        self.transducer.clear()
        self.transducer.words.clear()
        for known in self.vocabulary.known:
            known.clear()

    def stretches(self, text: bytes) -> Iterator[tuple[int, int, int | None]]:
        """(start, stop, special id or None) of a text: special strings and what stands between them."""
        at = 0
        for m in self.vocabulary.special_re.finditer(text) if self.vocabulary.special_re else ():
            if m.start() > at:
                yield at, m.start(), None
            yield m.start(), m.end(), self.vocabulary.special[m[0].decode()]
            at = m.end()
        if at < len(text):
            yield at, len(text), None

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        own: list[int] = []
        group: list[bytes] = []
        held = 0

        def work():
            """Stretches end to end, cut wherever MAPPED bytes are full, and at their ends; a stretch's maps are composed in a tree."""
            size = np.array([len(x) for x in group])
            parts, data = np.cumsum(size) - size, b"".join(group)
            cuts = np.union1d(np.append(parts, len(data)), np.arange(0, len(data), MAPPED))
            maps = self.counter.maps_of(data, cuts, pretokens(np.frombuffer(data, np.uint8), parts))
            bounds = np.searchsorted(cuts, np.append(parts, len(data))).tolist()
            for i, a, b in zip(own, bounds, bounds[1:], strict=False):
                out[i] += self.counter.scan(data, maps[a:b]).total
            own.clear()
            group.clear()

        for i, text in enumerate(texts):
            for start, stop, special in self.stretches(text):
                if special is not None:
                    out[i] += 1
                elif stop - start > CHUNK:  # maps of a long stretch are made a chunk at a time, as that bounds memory
                    raw, maps = text[start:stop], []
                    for a in range(0, len(raw), CHUNK):
                        b = min(len(raw), a + CHUNK)
                        few = self.counter.maps_of(raw, np.append(np.arange(a, b, MAPPED), b), starts_in(raw, a, b))
                        maps.append(self.counter.scan(raw, few))
                    out[i] += self.counter.scan(raw, maps).total
                else:
                    own.append(i)
                    group.append(text[start:stop])
                    held += stop - start
                    if held >= CHUNK:
                        work()
                        held = 0
        if group:
            work()
        return out

    def ids(self, text: bytes) -> Iterator[bytes]:
        """Packed ids (little-endian, 32 bits) of a text, as the transducer emits them."""
        for start, stop, special in self.stretches(text):
            if special is not None:
                yield special.to_bytes(4, "little")
            else:
                yield from self.transducer.read(text, start, stop)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        return [b"".join(self.ids(t)) for t in texts]

    def decode(self, ids: bytes | None, block: int = 1 << 16) -> str:
        """The text of packed ids, decoded block by block."""
        machine, ids = Decoder(self.vocabulary), ids or b""
        return "".join([*(machine.feed(ids[i : i + block]) for i in range(0, len(ids), block)), machine.end()])


@lru_cache(maxsize=2)
def tokenizer(path: str, share: float = 1.0) -> Tokenizer:
    """One for each worker process and vocabulary."""
    made = Tokenizer(path, share)
    gc.freeze()  # what stays needn't be traversed again
    return made
