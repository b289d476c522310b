"""Operator 3: language identification by language-bitmask n-gram filters.

A Bloom filter whose slots are bitmasks of languages (a bit-sliced filter: one slice
for each language) returns at once all languages that have an n-gram: the AND of the
n-gram's slots. For a text the bits are counted for each language; a language whose
slice is filled to a share p answers p^k of all n-grams falsely, so h hits among n
n-grams stand for (h - n p^k) / (1 - p^k). The language with most of them is it.

The filter is learned from a bounded sample of labelled rows (`per_language` rows each,
or all there are, chosen by a hash of their id); an n-gram belongs to a language if it makes
up at least `share` of that language's n-grams in the sample. So at most 1/share
n-grams of a language are fetched, however large the sample's texts.

Null and empty texts and texts without a letter are `und` with score 0. Without labelled
rows (an empty table, say) all texts are. Ties go to the first language by name. Null ids
aren't held out and aren't learned from. There may be any number of languages; what the
driver and a worker hold grows with them, not with the rows. Texts may have any length:
they are worked on in pieces, which changes no n-gram, as each piece begins with the last
characters of the one before. Repeated rows get a row each; a column named like the
result is replaced by it, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwell.llm.bpe import LETTER, kinds
from ordwell.llm.common import release, table

UNKNOWN = "und"
N = 4
HASHES = 2
SHARE = 2e-5
PER_LANGUAGE = 1500
WORD = 64  # languages in a mask
PIECE = 1 << 18
#: A text is rejected where fewer of its n-grams are known in its language.
LEAST_SCORE = 0.2
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def codes_of(text: str, piece: int | None = None) -> Iterator[np.ndarray]:
    """The characters that n-grams are made of, in pieces that overlap by N - 1.

    Letters are lower-cased; all else counts as one blank, also before and after a text.
    """
    low, piece = f" {text.lower()} ", piece or PIECE
    held = np.empty(0, np.uint64)
    for a in range(0, len(low), piece):
        codes = np.frombuffer(low[a : a + piece].encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(kinds()[codes] == LETTER, codes, 32)
        keep = np.empty(len(codes), bool)
        keep[0] = codes[0] != 32 or not len(held) or held[-1] != 32
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = np.append(held, codes[keep].astype(np.uint64))
        yield codes
        held = codes[max(0, len(codes) - N + 1) :]


def grams(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of pieces laid end to end; where each piece's own begin and end among them."""
    if not pieces:
        return np.empty(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate(pieces)
    stops = np.cumsum([len(p) for p in pieces])
    size = max(0, len(codes) - N + 1)
    h = np.zeros(size, np.uint64)
    for k in range(N):
        h += codes[k : k + size] * MULTIPLIERS[k]
    h ^= h >> np.uint64(31)
    h *= MULTIPLIERS[1]
    h ^= h >> np.uint64(29)
    starts = np.minimum(np.append(0, stops[:-1]), size)
    return h, starts, np.maximum(starts, stops - N + 1)


class Filters:
    """Bit-sliced Bloom filters; a mask is one word for up to 64 languages, more words for more."""

    def __init__(self, languages: list[str], known: list[np.ndarray]):
        self.languages = languages
        total = sum(map(len, known))
        self.bits = max(10, int(np.ceil(np.log2(max(1, total) * 8))))
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if np.iinfo(t).bits >= len(languages)), np.uint64)
        self.slots = np.zeros((max(1, -(-len(languages) // WORD)), 1 << self.bits), kind)
        for i, own in enumerate(known):
            for slot in self.at(own):
                np.bitwise_or.at(self.slots[i // WORD], slot, kind(1 << i % WORD))
        fill = np.array([np.count_nonzero(self.slots[i // WORD] & kind(1 << i % WORD)) for i in range(len(languages))]) / (1 << self.bits)
        self.false = fill**HASHES

    def at(self, h: np.ndarray) -> list[np.ndarray]:
        return [((h * MULTIPLIERS[k + 1]) >> np.uint64(64 - self.bits)).astype(np.int64) for k in range(HASHES)]

    def masks(self, h: np.ndarray) -> np.ndarray:
        """All languages that have each n-gram, as bits of the words of its column."""
        first, *rest = self.at(h)
        out = self.slots[:, first]
        for slot in rest:
            out &= self.slots[:, slot]
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """n-grams, then hits of each language, for each text; long texts in pieces."""
        out = np.zeros((len(texts), 1 + len(self.languages)), np.int64)
        queue: list[np.ndarray] = []
        own: list[int] = []

        def work():
            h, starts, ends = grams(queue)
            masks, one = self.masks(h), self.slots.dtype.type(1)
            np.add.at(out[:, 0], own, ends - starts)
            for k in range(len(self.languages)):
                scan = np.append(0, np.cumsum((masks[k // WORD] >> self.slots.dtype.type(k % WORD)) & one, dtype=np.int64))
                np.add.at(out[:, k + 1], own, scan[ends] - scan[starts])
            queue.clear()
            own.clear()

        held = 0
        for i, text in enumerate(texts):
            for codes in codes_of(text):
                queue.append(codes)
                own.append(i)
                held += len(codes)
                if held >= PIECE:
                    work()
                    held = 0
        if queue:
            work()
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (known share of the n-grams, corrected, 0 to 1) of each text."""
        letters = [any(map(str.isalpha, t or "")) for t in texts]
        counted = self.counts([t if t and ok else "" for t, ok in zip(texts, letters, strict=True)])
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        n = counted[:, :1]
        true = (counted[:, 1:] - n * self.false) / (1 - self.false)
        best = true.argmax(axis=1)
        score = np.clip(true[np.arange(len(texts)), best] / np.maximum(1, n[:, 0]), 0, 1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters, strict=True)], [s if ok else 0.0 for s, ok in zip(score.tolist(), letters, strict=True)]


def sample(df: DataFrame, doc_id: str, lang: str, per_language: int, text: str = "text") -> DataFrame:
    """per_language rows of each language, or all it has: those with the smallest hashes of their id.

    A pass over two columns counts buckets of hashes. Each bucket that is more than what is still
    to be taken is split by a finer hash of id and text; rows that no bit tells apart are the same.
    """
    fine = F.xxhash64(F.lit(1), F.col(doc_id), F.col(text))
    digits = [F.pmod(F.xxhash64(doc_id), F.lit(1024)), *(F.shiftrightunsigned(fine, k).bitwiseAND(F.lit(1023)) for k in range(0, 64, 10))]
    inside, taken = F.lit(True), F.lit(False)
    need: dict = {}
    for digit in digits:
        rows = df.where(inside).groupBy(F.col(lang).alias("l"), digit.alias("b")).count().orderBy("l", "b").collect()  # languages x 1024
        ends: dict = {}
        for r in rows:
            left = need.setdefault(r.l, per_language)
            if r.l in ends:
                continue
            if r["count"] <= left:
                need[r.l] = left - r["count"]
            else:
                ends[r.l] = r.b
        if not ends:
            return df.where(taken | inside)
        end = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ends.items() for x in pair)), F.col(lang)), F.lit(1024))
        over = [x for x in ends if need[x]]
        taken = taken | (inside & (digit < end))
        if not over:
            return df.where(taken)
        inside = inside & (digit == end) & F.col(lang).isin(over)
    return reduce(DataFrame.unionByName, (df.where(inside & (F.col(lang) == x)).limit(need[x]) for x in over), df.where(taken))


def learn(spark: SparkSession, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, share: float = SHARE) -> Filters:
    """Filters from labelled rows; only text and lang are learned from."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    few = sample(rows, doc_id, lang, per_language, text).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def groups(texts):
        """Pieces of the texts, about PIECE characters together."""
        out, held = [], 0
        for t in texts:
            for codes in codes_of(t):
                out.append(codes)
                held += len(codes)
                if held >= PIECE:
                    yield out
                    out, held = [], 0
        if out:
            yield out

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for own in sorted(set(langs)):
                chosen = [t for t, x in zip(texts, langs, strict=True) if x == own]
                for few in groups(chosen):
                    h, starts, ends = grams(few)
                    inside = np.zeros(len(h) + 1, np.int32)
                    np.add.at(inside, starts, 1)
                    np.add.at(inside, ends, -1)
                    gram, n = np.unique(h[np.cumsum(inside)[:-1] > 0], return_counts=True)
                    release()
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = few.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(total), "lang").where(F.col("n") >= F.greatest(F.lit(2.0), share * F.col("total")))  # total: a row for each language
    found: dict[str, list[int]] = {}
    for r in frequent.select("lang", "gram").toLocalIterator():
        found.setdefault(r.lang, []).append(r.gram)
    languages = sorted(found)
    return Filters(languages, [np.sort(np.array(found[x], np.int64)).view(np.uint64) for x in languages])


def predict(text: Column, filters: Filters) -> Column:
    """Struct (lang, score) of text."""
    packed = (filters.languages, filters.bits, filters.slots, filters.false)

    @F.arrow_udf("struct<lang: string, score: double>")
    def decide(texts: pa.Array) -> pa.Array:
        lang, score = unpacked(packed).decide(texts.to_pylist())
        release()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return decide(text)


def unpacked(packed: tuple) -> Filters:
    f = Filters.__new__(Filters)
    f.languages, f.bits, f.slots, f.false = packed
    return f


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", to: str = "predicted") -> DataFrame:
    """docs with a struct column to (lang, score), learned from their own rows that aren't held out."""
    filters = learn(spark, docs.where(~held_out(F.col(doc_id))), doc_id, text, lang)
    return docs.withColumn(to, predict(F.col(text), filters))


def accepted(predicted: Column, least: float = LEAST_SCORE) -> Column:
    """The text has a known language."""
    return (predicted["lang"] != UNKNOWN) & (predicted["score"] >= least)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(spark, docs).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("predicted.lang").alias("lang_pred"),
        F.col("predicted.score").alias("score"),
    )


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
