"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram of letters is bound into
one vector: the letters' vectors, each rotated by its place, multiplied entry by
entry. A document is the sum of its n-grams' vectors, a language's prototype that of
its documents, and a document takes the language whose prototype has the largest cosine.

Prototypes are sums, so tasks bundle what they read and emit one vector a
language; Spark adds them up entry by entry. Identification is one map without a
shuffle. It holds the prototypes of a block of languages at a time (16 MB for
2,048 languages), and more languages take more blocks in the same pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

UNKNOWN = "und"
#: Characters of a text that are worked on at a time, and n-grams whose vectors a worker keeps.
PIECE, HELD = 1 << 20, 1 << 14
#: Prototypes that one step of identification holds.
BLOCK = 2048


def held_out(doc_id: Column) -> Column:
    """Rows that no profile may learn from: the checksum of their id leaves two when divided by four. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Letters:
    """Code points as lower-case letters, 0 for all else; entries are worked out when they first occur."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                low = chr(code).lower()
                self.table[code] = (ord(low) if len(low) == 1 else code) if chr(code).isalpha() else 0
            out = self.table[codes]
        return out


def grams(text: str, letters: Letters, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, how often) of each piece of a text; an n-gram is n code points in one number. What lies between words is one mark, also before the first and behind the last."""
    before = np.zeros(1, np.int32)
    for at in range(0, len(text), PIECE):
        codes = letters(text[at : at + PIECE])
        codes = np.concatenate([before, codes, np.zeros(int(at + PIECE >= len(text)), np.int32)])
        keep = codes != 0
        keep[0] = True
        keep[1:] |= codes[:-1] != 0
        codes = codes[keep].astype(np.int64)
        if len(codes) >= n:
            keys = codes[: len(codes) - n + 1].copy()
            for k in range(1, n):
                keys = keys << 21 | codes[k : len(codes) - n + 1 + k]
            yield np.unique(keys, return_counts=True)
        before = codes[max(len(codes) - n + 1, 0) :].astype(np.int32)


class Space:
    """Vectors of letters and of the n-grams bound from them."""

    def __init__(self, dim: int, n: int, seed: int) -> None:
        self.dim, self.n, self.seed = dim, n, seed
        self.letter: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.rows = np.empty((HELD, dim), np.int8)

    def letter_vector(self, code: int) -> np.ndarray:
        """+1 and -1 from the random bits that belong to a letter."""
        if code not in self.letter:
            bits = np.random.PCG64([self.seed, code]).random_raw(self.dim // 64).view(np.uint8)
            self.letter[code] = 2 * np.unpackbits(bits).astype(np.int8) - 1
        return self.letter[code]

    def bound(self, keys: list[int]) -> np.ndarray:
        """Vectors of n-grams: the k-th letter from the end is rotated by k places."""
        out = np.ones((len(keys), self.dim), np.int8)
        for k in range(self.n):
            out *= np.roll(np.stack([self.letter_vector(key >> 21 * k & 0x1FFFFF) for key in keys]), k, axis=1)
        return out

    def places(self, keys: list[int]) -> list[int]:
        """Rows that hold the vectors of at most HELD n-grams; all are forgotten when there is no room."""
        missing = [k for k in keys if k not in self.place]
        if len(self.place) + len(missing) > HELD:
            self.place, missing = {}, keys
        at = len(self.place)
        for start in range(0, len(missing), 1024):
            some = missing[start : start + 1024]
            self.rows[at + start : at + start + len(some)] = self.bound(some)
        self.place.update(zip(missing, range(at, at + len(missing)), strict=True))
        return [self.place[k] for k in keys]

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors, each as often as it occurs. Whole numbers, exact."""
        out = np.zeros(self.dim)
        for start in range(0, len(keys), 2048):
            some, often = keys[start : start + 2048], counts[start : start + 2048]
            kind = np.float32 if often.sum() < 1 << 24 else np.float64
            out += often.astype(kind) @ self.rows[self.places(some.tolist())].astype(kind)
        return out


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = 2048, n: int = 3, seed: int = 11) -> DataFrame:
    """(lang, profile): the prototype of each language, of unit length, from all documents that have one and are not held out.

    Null ids, null texts and null languages teach nothing; a language whose texts
    have no letter has no profile; repeated rows count each time; other columns are not read. An empty table gives no profile.
    """
    known = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("id"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, space = Letters(), Space(dim, n, seed)
        waiting: dict[str, list] = {}
        size: dict[str, int] = {}
        sums: dict[str, np.ndarray] = {}

        def told(lang: str) -> None:
            found, size[lang] = waiting.pop(lang), 0
            keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([c for _, c in found])).astype(np.int64)
            sums[lang] = sums.get(lang, 0) + space.bundle(keys, counts)

        def out() -> pa.RecordBatch:
            for lang in list(waiting):
                told(lang)
            made = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype(np.int64) for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "entries"])
            sums.clear()
            size.clear()
            return made

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for pair in grams(text.as_py(), letters, n):
                    waiting.setdefault(lang, []).append(pair)
                    size[lang] = size.get(lang, 0) + len(pair[0])
                    if size[lang] > 1 << 18:
                        told(lang)
                if len(waiting) + len(sums) > 256:
                    yield out()
        yield out()

    parts = known.mapInArrow(run, "lang string, entries array<long>")
    entries = parts.select("lang", F.posexplode("entries").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").cast("double").alias("x"))
    whole = entries.groupBy("lang").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("length"), F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("x"))
    return cut_lineage(whole.where("length > 0").select("lang", F.transform("x", lambda x: x / F.col("length")).alias("profile")))


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the language of the largest cosine, ties to the smaller name, and that cosine, not below 0.

    ``und`` and 0 for a null text, one without a letter, and where no profile was learned. Repeated rows and null
    ids each return their row; other columns are not read; an empty table returns
    none. Texts of any length are read in pieces. n and seed are those of the profiles.
    """
    names = sorted(r.lang for r in profiles.select("lang").collect())
    ids = F.col(f"`{id_col}`").cast("long").alias("doc_id")
    out = docs.select(ids, F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"))
    for at in range(0, len(names), block):
        some = names[at : at + block]
        found = {r.lang: r.profile for r in profiles.where(F.col("lang").isin(some)).collect()}
        held = docs.sparkSession.sparkContext.broadcast((some, np.array([found[x] for x in some], np.float32)))  # at most block rows
        out = compared(out, held, n, seed)
    return out.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), "score")


def compared(rows: DataFrame, held, n: int, seed: int) -> DataFrame:
    """rows (doc_id, text, lang_pred, score) with the better of what they have and what the held prototypes offer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = held.value
        letters, space = Letters(), Space(prototypes.shape[1], n, seed)
        for batch in batches:
            langs, scores = [], []
            for text, lang, score in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                lang, score, vector, any_letter = lang.as_py(), score.as_py(), np.zeros(space.dim), False
                for keys, counts in grams(text.as_py() or "", letters, n):
                    any_letter |= bool((keys != 0).any())
                    vector += space.bundle(keys, counts)
                if any_letter:
                    cosine = prototypes @ (vector / (np.sqrt(vector @ vector) or 1.0)).astype(np.float32)
                    best = int(cosine.argmax())
                    value = min(max(float(cosine[best]), 0.0), 1.0)
                    lang, score = (names[best], value) if lang is None or value > score else (lang, score)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "text", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, text string, lang_pred string, score double")
