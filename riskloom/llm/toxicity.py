"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding lower-cases, strips marks and zero-width characters, and maps look-alike
letters, digits and symbols onto one letter each, so that respelt words
meet their lexicon entry. Entries are whole words or word beginnings with the
log-odds by which they speak for the label, learned from a bounded sample of
labelled documents; exception phrases, given or learned, cancel the entries inside
them. A document's score is a logistic function of its matched weight, as such
and per word. The lexicon is of bounded size, and scoring is one map without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, takewhile

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, id_and_text, map_texts

#: Letters that look like others, and the digits and symbols written in their place; l counts as i, as 1 stands for either.
LOOK_ALIKES = dict(zip("аеорсухіѕјкмтвнԁɡαορντικευı" + "0134578l" + "@$!|", "aeopcyxisjkmtbhdgaopvtikeui" + "oieastbi" + "asii", strict=True))
IN_WORD = re.compile(r"(?<=\w)[@$!|](?=[\w@$!|]*\w)|(?<!\S)[@$](?=\w)")
ZERO_WIDTH = set("­​‌‍⁠﻿")


class Fold(dict):
    """Table for str.translate that works out a character when it first occurs."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char in ZERO_WIDTH or unicodedata.combining(char):
            out = ""
        else:
            bare = "".join(c for c in unicodedata.normalize("NFKD", char).lower() if not unicodedata.combining(c))
            out = "".join(LOOK_ALIKES.get(c, c) if c.isalnum() else " " for c in bare)
        self[code] = out
        return out


def fold(text: str, table: Fold) -> list[str]:
    """The words of a text in their folded spelling."""
    return IN_WORD.sub(lambda m: LOOK_ALIKES[m[0]], text).translate(table).split()


@dataclass
class Lexicon:
    """weights: entry to log-odds; an entry that ends in a space is a whole word, others are word beginnings. exceptions: phrases of folded words. curve: constant, and the factors of the two measures of a document."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(f" {term}", (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase), None))
        found.make_automaton()
        return found


def hits(automaton: ahocorasick.Automaton, line: str) -> dict[int, float]:
    """Weight of each word that an entry matches, by its place in the line; the heaviest entry counts, and none inside an exception. Time follows the line and its matches."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(line):
        start = end - length + (weight is not None)
        if weight is None:
            spared.append((start, end - 1))
        elif best.get(start, 0.0) < weight:
            best[start] = weight
    if not spared:
        return best
    spared.sort()
    firsts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
    return {k: w for k, w in best.items() if not (n := bisect_right(firsts, k)) or reach[n - 1] < k}


def measures(automaton: ahocorasick.Automaton, words: Sequence[str]) -> tuple[float, float]:
    """Matched weight of a document, and that per 100 words, both damped by a logarithm."""
    weight = sum(hits(automaton, f" {' '.join(words)} ").values()) if len(automaton) else 0.0
    return float(np.log1p(weight)), float(np.log1p(100 * weight / (len(words) + 50)))


def entries(words: Sequence[str], shortest: int = 4, longest: int = 9) -> set[str]:
    """What may become an entry: words, and word beginnings of some lengths."""
    every = set(words)
    return {f"{w} " for w in every if len(w) > 2} | {w[:k] for w in every for k in range(shortest, min(longest, len(w) - 1) + 1)}


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: the checksum of their id divides by five. False for a null id, which no label can have."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int, seed: int) -> DataFrame:
    """(words, label) of about train_rows labelled documents that are not held out, all if there are fewer; chosen by a hash of the id."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("label_id")))
    known = known.groupBy("label_id").agg(F.max("label").alias("label"))
    share = min(1.0, train_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(seed), "label_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = id_and_text(docs, id_col, text_col)
    sample = texts.join(F.broadcast(chosen), texts.doc_id == chosen.label_id).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Fold()
        for batch in batches:
            folded = [" ".join(fold(t or "", table)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folded, pa.string())], names=["label", "words"])

    return cut_lineage(sample.mapInArrow(run, "label int, words string"))


def counted(sample: DataFrame, of) -> DataFrame:
    """(term, bad, good): documents of either label that hold what of() gives for a document's words; summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = of()
        for batch in batches:
            bad, good = Counter(), Counter()
            for label, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (bad if label else good).update(made(words.split(" ") if words else []))
            terms = list(bad | good)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([bad[t] for t in terms], pa.int64()), pa.array([good[t] for t in terms], pa.int64())], names=["term", "bad", "good"])

    return sample.mapInArrow(run, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def specific(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Entries without the word beginnings that owe nine tenths of their documents to one longer entry."""
    terms = sorted(found)
    kept = {}
    for k, term in enumerate(terms):
        longer = takewhile(lambda x, start=term: x.startswith(start), terms[k + 1 :])
        if not any(10 * found[x][1] >= 9 * found[term][1] for x in longer):
            kept[term] = found[term][0]
    return kept


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 20_000, min_documents: int = 4, exceptions: Sequence[str] = (), seed: int = 5) -> Lexicon:
    """A lexicon from at most about train_rows labelled documents, held-out rows apart.

    Entries occur in min_documents documents with the label, and their log-odds
    stay above 1.5 less two standard errors; their number is bounded by that of
    the words of train_rows documents. Exceptions: those given, folded, and pairs of neighbouring words
    around an entry that occur in min_documents documents, four in five of them
    without the label.
    """
    sample = labelled(docs, labels, id_col, text_col, label_col, train_rows, seed)
    n_bad, n_good = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    if not n_bad or not n_good:
        return Lexicon()
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    low = odds - 2 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    ranked = counted(sample, lambda: entries).where(F.col("bad") >= min_documents).select("term", "bad", odds.alias("odds"), low.alias("low")).where("low > 1.5")
    weights = specific({r.term: (r.odds, r.bad) for r in ranked.collect()})
    table = Fold()
    given = tuple(" ".join(fold(x, table)) for x in exceptions)
    lexicon = Lexicon(weights, given)

    def around():
        automaton = lexicon.automaton()

        def pairs(words: Sequence[str]) -> set[str]:
            line, found = f" {' '.join(words)} ", set()
            for start in hits(automaton, line) if weights else ():
                end = line.find(" ", start)
                before, behind = line.rfind(" ", 0, start - 1), line.find(" ", end + 1)
                found |= {line[before + 1 : end]} if before >= 0 else set()
                found |= {line[start:behind]} if behind >= 0 else set()
            return found

        return pairs

    spared = counted(sample, around).where((F.col("good") >= min_documents) & (F.col("good") >= 4 * F.col("bad")))
    learned = [r.term for r in spared.orderBy("term").collect()]
    lexicon = Lexicon(weights, (*given, *learned))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [measures(automaton, w.split(" ") if w else []) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], pa.float64()) for k in (0, 1))], names=["label", "a", "b"])

    rows = sample.mapInArrow(measured, "label int, a double, b double").toPandas()  # bounded by train_rows
    return Lexicon(weights, lexicon.exceptions, logistic(rows[["a", "b"]].to_numpy(), rows["label"].to_numpy()))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float, float]:
    """Constant and factors of a logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row: score in 0 to 1, predicted 1 from 0.5 up.

    Null and empty texts score as a text without a match does. Repeated rows and
    null ids each return their row; other columns are not read; an empty table returns none.
    """

    def row(state: tuple[Fold, ahocorasick.Automaton], text: str) -> tuple[float, int]:
        a, b = measures(state[1], fold(text, state[0]))
        score = float(1 / (1 + np.exp(-(lexicon.curve[0] + lexicon.curve[1] * a + lexicon.curve[2] * b))))
        return score, int(score >= 0.5)

    return map_texts(id_and_text(docs, id_col, text_col), row, "score double, predicted int", [pa.float64(), pa.int32()], lambda: (Fold(), lexicon.automaton()))
