"""Operator 10: personal data replaced by keyed surrogates.

Detected are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment cards
(whose check digit is right), social security numbers, quoted secrets, and names after a
title or a phrase that introduces one, in Latin, Cyrillic and Greek script, with hyphens
and apostrophes before a capital; a full name so found is found without a title too
anywhere in its text. Each entity has a normal form; its
surrogate is drawn from a keyed hash of kind and normal form, so all mentions in all
texts get the same one, also with other separators or, but for secrets, other case; given
and family names are drawn each for itself. Surrogates keep the kind's format: digits
stay digits, letters letters of the same script and case, a secret's signs signs, names
the script, their hyphens and their gender; addresses lie in reserved ranges, cards pass
the check. A given name's gender is that of its titles in the whole corpus, none where
they differ or tell none, so a person has one surrogate under any title.

All distinct entities then meet in aggregations and joins: a surrogate that two entities
drew (given and family names together), or that is itself an entity of the corpus, is
drawn anew for all but the least of them, until none is left. From attempt WIDE on the range of draws grows by a character
with each attempt, so it outgrows any corpus and the rounds end. A round reads and writes
only what was drawn anew, and looks it up among the rest; only what was drawn anew is
joined back to its texts; all other surrogates are worked out where the text is.

The key comes from the caller or the session's setting spark.ordwell.pii.key; without
either one is drawn for the run and forgotten, so nobody can work surrogates back.

Null texts stay null, texts without entities as they are. Texts and secrets may be very
long: patterns are bounded or can't be retried, so the search is linear. Rows with the
same id and text get the same result; other columns pass through, whatever their names;
an empty table gives none. A quoted value of blanks alone is no secret.
"""

from __future__ import annotations

import re
import secrets
from hashlib import blake2b
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwell.llm.common import forget, fresh, settle, table

KEY = "spark.ordwell.pii.key"
ENTITY = "struct<kind: string, norm: string>"
WIDE = 8  # from this attempt on surrogates grow, from twice as many on fixed formats do too

EMAIL = re.compile(r"[\w%+\-][\w.%+\-]{0,63}@[^\W_](?:[^\W_]|-){0,62}(?:\.(?:[^\W_]|-){1,63}){0,4}\.[^\W\d_]{2,24}")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = re.compile(rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
PHONE = re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .\-]\d{2,8}){2,5}(?!\d)|(?<![\d.\-+])(?:1[.\-])?\d{3}([.\-])\d{3}\1\d{4}(?![.\-]?\d)|(?<![\w.\-+])[2-9]\d{9}(?![.\-]?\d|\w)")
SSN = re.compile(r"(?<![\w.\-+])\d{3}-\d{2}-\d{4}(?![.\-]?\d|\w)")
CARD = re.compile(r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)")
SECRET = re.compile(r"""\b(?:token|secret|password|passwd|api[_\-]?key)\b\s{0,3}[=:]\s{0,3}(?:"([^"\n]{6,})"|'([^'\n]{6,})')""", re.IGNORECASE)
MALE = ("Mr", "Mister", "Herr", "Señor", "Monsieur", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Госпожа", "Κυρία")
EITHER = ("Dr", "Doctor", "Prof", "Professor", "My name is", "my name is", "Name:")
NAMED = r"[^\W\d_a-z](?:[^\W\d_]|['’\-](?=[^\W\d_a-z])){1,40}"
NAME = re.compile(rf"\b({'|'.join(sorted((*MALE, *FEMALE, *EITHER), key=len, reverse=True))})\.? ({NAMED})(?: ({NAMED}))?")
PAIR = re.compile(rf"(?<![\w'’\-])(?=({NAMED}) ({NAMED})(?![^\W\d_]))")
JOINS = re.compile("(['’-])")
SIGNS = "!#$%&*+-=?@^_~"
#: Letters that stand for a script's letters, by its first and last code point.
SCRIPTS = {"latin": ("A", "\u024f", "abcdefghijklmnopqrstuvwxyz"), "greek": ("\u0370", "\u03ff", "αβγδεζηθικλμνξοπρστυφχψω"), "cyrillic": ("\u0400", "\u04ff", "абвгдежзийклмнопрстуфхцчшщыэюя")}
SYLLABLES = {
    "latin": (["bel", "cor", "dan", "fer", "gal", "har", "jon", "kel", "lor", "mar", "nor", "per", "ros", "sel", "tam", "vin"], {"m": ["o", "us", "in"], "f": ["a", "ia", "elle"], "": ["son", "er", "ford"]}),
    "cyrillic": (["бел", "вор", "гал", "дан", "жар", "зор", "кал", "лад", "мир", "нов", "рат", "сел", "тар", "фед", "хор", "яр"], {"m": ["ин", "ей", "слав"], "f": ["а", "ина", "слава"], "": ["енко", "чук", "юк"]}),
    "greek": (["αλ", "βασ", "γερ", "δημ", "ελ", "ζαν", "καλ", "λαμ", "μαν", "νικ", "παρ", "ροδ", "σπυρ", "τασ", "φαν", "χαρ"], {"m": ["ος", "ης", "ων"], "f": ["α", "η", "ω"], "": ["ιδης", "ακης", "ου"]}),
}


def key_of(spark: SparkSession, key: str | None) -> str:
    """The given key, the session's, or a new one."""
    return key or spark.conf.get(KEY, None) or secrets.token_hex(32)


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1], 1)) % 10 == 0


def script_of(letter: str) -> str:
    return next((name for name, (a, z, _) in SCRIPTS.items() if a <= letter <= z), "latin")


def ipv6(text: str) -> str | None:
    """The address's normal form, if it is one that names at least two groups."""
    if sum(map(bool, text.split(":"))) < 2:
        return None
    try:
        return IPv6Address(text).exploded
    except AddressValueError:
        return None


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of all entities, in order, none overlapping; earlier patterns come first."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if '"' in text or "'" in text:
        for m in SECRET.finditer(text):
            k = 1 if m[1] is not None else 2
            if m[k].strip():
                found.append((m.start(k), m.end(k), "secret", m[k]))
    if re.search(r"\d", text):
        found += [(m.start(), m.end(), "phone", re.sub(r"\D", "", m[0])) for m in PHONE.finditer(text)]
        found += [(m.start(), m.end(), "ipv4", m[0]) for m in IPV4.finditer(text)]
        for m in CARD.finditer(text):
            if luhn(digits := re.sub(r"\D", "", m[0])):
                found.append((m.start(), m.end(), "card", digits))
    if ":" in text:
        found += [(m.start(), m.end(), "ipv6", own) for m in IPV6.finditer(text) if (own := ipv6(m[0]))]
    if "-" in text:
        found += [(m.start(), m.end(), "ssn", re.sub(r"\D", "", m[0])) for m in SSN.finditer(text)]
    full: set[tuple[str, str]] = set()
    for m in NAME.finditer(text):
        parts = [k for k in (2, 3) if m[k] and m[k][0].isupper()]
        if 2 not in parts:
            continue
        gender = "m" if m[1] in MALE else "f" if m[1] in FEMALE else "n"
        if 3 in parts:
            found.append((m.start(2), m.end(2), f"given_{gender}", m[2].lower()))
            full.add((m[2].lower(), m[3].lower()))
        found.append((m.start(parts[-1]), m.end(parts[-1]), "family", m[parts[-1]].lower()))
    for m in PAIR.finditer(text) if full else ():  # mentions without a title; those with one come first
        if (m[1].lower(), m[2].lower()) in full:
            found += [(m.start(1), m.end(1), "given_n", m[1].lower()), (m.start(2), m.end(2), "family", m[2].lower())]
    out: list[tuple[int, int, str, str]] = []
    for rank, e in sorted(enumerate(found), key=lambda x: (x[1][0], x[0])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def kind_class(kind: str) -> str:
    """Kinds whose surrogates must differ from each other's: all names are one class."""
    return "name" if kind == "family" or kind.startswith("given") else kind


def agreed(kinds: set[str]) -> str:
    """The kind of a given name from its mentions' kinds: a gender where all titles that tell one tell the same."""
    told = kinds - {"given_n"}
    return told.pop() if len(told) == 1 else "given_n"


def mentioned(found: list[tuple[int, int, str, str]]) -> dict[tuple[str, str], str]:
    """The kind of each entity of a text, by (kind without gender, normal form)."""
    kinds: dict[tuple[str, str], set[str]] = {}
    for _, _, kind, norm in found:
        kinds.setdefault((kind.partition("_")[0], norm), set()).add(kind)
    return {own: agreed(k) if own[0] == "given" else own[0] for own, k in kinds.items()}


class Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: str, *parts: object):
        raw = key.encode()
        self.key = raw if len(raw) <= 64 else blake2b(raw).digest()
        self.parts, self.block, self.bytes = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += blake2b(self.parts + self.block.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.block += 1
        x, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
        return x % n

    def any(self, letters: str) -> str:
        return letters[self.below(len(letters))]

    def digits(self, n: int) -> str:
        return "".join(self.any("0123456789") for _ in range(n))

    def like(self, text: str, letters: str | None = None, signs: str = "") -> str:
        """Digits for digits, letters of the same script and case for letters; signs, where given, for signs."""
        out = []
        for c in text:
            if c.isdigit():
                c = self.any("0123456789")
            elif c.isalpha():
                new = self.any(letters or SCRIPTS[script_of(c)][2])
                c = new.upper() if c.isupper() else new
            elif signs and not c.isspace():
                c = self.any(signs)
            out.append(c)
        return "".join(out)


def surrogate(kind: str, norm: str, attempt: int, key: str) -> str:
    """The normal form of the surrogate that an entity draws at an attempt."""
    s = Stream(key, kind, norm, attempt)
    more, most = max(0, attempt - WIDE + 1), max(0, attempt - 2 * WIDE + 1)
    if kind == "email":
        local, _, domain = norm.partition("@")
        *sub, _, top = domain.split(".")
        return f"{s.like(local)}{s.digits(more)}@{'.'.join([*map(s.like, sub), 'example', top if top in ('com', 'net', 'org') else 'org'])}"
    if kind == "phone":
        if len(norm) >= 10:
            head, rest = norm[:-10], s.any("23456789") + s.digits(9)
            return head + rest[:3] + (rest[3:6] if more else "555") + rest[6:] + s.digits(most)
        return s.digits(len(norm) + most)
    if kind == "ssn":
        return "9" + s.digits(8 + most)  # numbers that begin so aren't given out
    if kind == "ipv6" or kind == "ipv4" and most:
        return "2001:0db8:" + ":".join("".join(s.any("0123456789abcdef") for _ in range(4)) for _ in range(6))
    if kind == "ipv4":
        return f"{240 + s.below(15) if more else 10}.{s.below(256)}.{s.below(256)}.{s.below(256)}"
    if kind == "card":
        body = norm[0] + s.digits(min(17, len(norm) - 2 + most))
        return next(body + str(d) for d in range(10) if luhn(f"{body}{d}"))
    if kind == "secret":
        return s.like(norm, "abcdef" if re.fullmatch("[0-9a-fA-F]+", norm) else None, SIGNS) + s.digits(more)
    first, ends = SYLLABLES[script_of(norm[0])]
    gender = kind.partition("_")[2]
    letters, last = SCRIPTS[script_of(norm[0])][2], [x for g in ("m", "f") for x in ends[g]] if gender == "n" else ends[gender]
    part = lambda x: s.any(letters) if len(x) == 1 else "".join(s.any(first) for _ in range(2 + attempt // 4)) + s.any(last)
    return "".join(x if JOINS.fullmatch(x) else part(x) for x in JOINS.split(norm))


def render(original: str, kind: str, drawn: str) -> str:
    """The surrogate in the form of the mention: its separators, or its case."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(drawn)
        return "".join(next(digits, "") if c.isdigit() else c for c in original) + "".join(digits)
    if kind == "secret" or ":" in drawn:
        return drawn
    if original.isupper():
        return drawn.upper()
    if kind_class(kind) == "name":
        return "".join(x.capitalize() for x in JOINS.split(drawn))
    return drawn


def replace(text: str, anew: dict[tuple[str, str], tuple[str, int]], key: str) -> tuple[str, int]:
    """The text with surrogates, and the number of mentions. anew: kind and attempt by (kind without gender, normal form), where the text alone tells others."""
    out, at, found = [], 0, detect(text)
    kinds = mentioned(found)
    for start, end, kind, norm in found:
        own = (kind.partition("_")[0], norm)
        kind, attempt = anew.get(own) or (kinds[own], 0)
        drawn = surrogate(kind, norm, attempt, key)
        out += [text[at:start], render(text[start:end], kind, drawn)]
        at = end
    return "".join([*out, text[at:]]), len(found)


def entities(text: Column) -> Column:
    """The distinct (kind, norm) of a text; a given name has the gender that the text tells."""

    @F.arrow_udf(f"array<{ENTITY}>")
    def find(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "norm": n} for (_, n), k in sorted(mentioned(detect(t)).items())] if t else [] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("norm", pa.string())])))

    return find(text)


def draws(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    @F.arrow_udf("string")
    def draw(kinds: pa.Array, norms: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([surrogate(k, n, a, key) for k, n, a in zip(kinds.to_pylist(), norms.to_pylist(), attempts.to_pylist(), strict=True)], pa.string())

    return draw(kind, norm, attempt)


def class_of(kind: Column) -> Column:
    """kind_class of a column."""
    return F.when((kind == "family") | kind.startswith("given"), "name").otherwise(kind)


def drawn_anew(spark: SparkSession, every: DataFrame, key: str, first=None) -> tuple[DataFrame, list[DataFrame]]:
    """(kind, norm, attempt) of the distinct entities that need another surrogate than their first, and what was settled for it."""
    draw, own = first or draws, ["class", "drawn"]
    kind, norm = F.col("kind"), F.col("norm")
    drawn = lambda df, attempt: df.select("kind", "norm", class_of(kind).alias("class"), attempt.alias("attempt"), draw(kind, norm, attempt, key).alias("drawn"))
    pending = settle(spark, drawn(every, F.lit(0)))
    kept, settled = None, [pending]
    while True:
        groups = pending.groupBy(*own).agg(F.count("*").alias("n"), F.min(F.struct("norm", "kind")).alias("keeper"))
        bad = [
            pending.join(groups.where("n > 1"), own).where(F.struct("norm", "kind") != F.col("keeper")),
            pending.join(every.select(class_of(kind).alias("class"), norm.alias("drawn")), own, "left_semi"),
        ]
        if kept is not None:
            bad.append(pending.join(kept.select(*own), own, "left_semi"))
        again = bad[0].select("kind", "norm", "attempt")
        for b in bad[1:]:
            again = again.union(b.select("kind", "norm", "attempt"))
        again = settle(spark, again.distinct())
        settled.append(again)
        rest = pending.join(again.select("kind", "norm"), ["kind", "norm"], "left_anti")
        kept = rest if kept is None else kept.union(rest)
        if again.isEmpty():
            return kept.where("attempt > 0").select("kind", "norm", "attempt"), settled
        pending = settle(spark, drawn(again, F.col("attempt") + 1))
        settled.append(pending)


def pseudonymise(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str | None = None, mentions: str | None = None, first=None) -> DataFrame:
    """df with surrogates in column text. key: see above; mentions: name of a column for their number."""
    key = key_of(spark, key)
    own = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    found = settle(spark, df.select(own.alias("key"), F.explode(entities(F.col(text))).alias("e")).select("key", "e.*"))
    base = F.split_part("kind", F.lit("_"), F.lit(1))
    told = F.array_remove(F.collect_set("kind"), "given_n")  # of a name, at most two are left
    seen = settle(spark, found.groupBy(base.alias("base"), "norm").agg(told.alias("told"), F.count_distinct("kind").alias("n")))
    kind = F.when((F.col("base") == "given") & (F.size("told") != 1), "given_n").otherwise(F.col("told")[0])
    every = settle(spark, seen.select(kind.alias("kind"), "norm", "base", "n"))
    anew, settled = drawn_anew(spark, every.select("kind", "norm"), key, first)
    other_than_told = every.join(anew, ["kind", "norm"], "left").where("n > 1 or attempt is not null")
    other_than_told = other_than_told.select("base", "norm", "kind", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    by_text = settle(spark, found.select("key", base.alias("base"), "norm").join(other_than_told, ["base", "norm"]).groupBy("key").agg(F.collect_set(F.struct("kind", "norm", "attempt")).alias("anew")))
    forget(spark, found, seen, every, *settled)
    k, other, a, r = fresh(df, "text_key", "other_key", "anew", "replaced")
    joined = df.withColumn(k, own).join(by_text.select(F.col("key").alias(other), F.col("anew").alias(a)), F.col(k) == F.col(other), "left")

    @F.arrow_udf("struct<text: string, n: long>")
    def put(texts: pa.Array, drawn: pa.Array) -> pa.Array:
        rows = [(None, 0) if t is None else replace(t, {(x["kind"].partition("_")[0], x["norm"]): (x["kind"], x["attempt"]) for x in d or ()}, key) for t, d in zip(texts.to_pylist(), drawn.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64())], ["text", "n"])

    out = joined.withColumn(r, put(F.col(text), F.col(a)))
    held = [c for c in df.columns if mentions is None or c.lower() != mentions.lower()]
    return out.select(*(F.col(f"{r}.text").alias(c) if c == text else F.col(c) for c in held), *([F.col(f"{r}.n").alias(mentions)] if mentions else []))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data, and the number of mentions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(spark, docs, mentions="n_entities").select("doc_id", "n_entities", F.sha2("text", 256).alias("text_sha256"), "text")


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
