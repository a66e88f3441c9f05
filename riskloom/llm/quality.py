"""Quality rules as a short-circuit cascade.

Facts about a text are computed when a rule first asks for them, and rules share
facts. Each task runs all rules on the first texts it sees and times every fact;
that sample gives each rule's cost, which is that of the facts no earlier rule has
made, and its selectivity, which is the share it rejects of what earlier rules left.
The cascade is ordered by rejections per cost, and from then on a text stops at the
first rule that rejects it and never pays for what follows. The order cannot
change a verdict, since a text is kept only if no rule rejects it. One map, no
shuffle, and no pass over the corpus but the one that decides.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_SPACE, id_and_text

SYMBOLS = b"#*$%&|<>"


class Facts:
    """Counts of one text, each made when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WORD_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that the text has at least twice, its first occurrence included."""
        n, known = self.n_words, {}
        if n < 4:
            return 0
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, n)
        m = len(known)
        pairs = ids[:-1] * m + ids[1:]
        if m >= 1 << 21:  # three numbers no longer fit into one
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        if not again.any():
            return 0
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return int(covered.sum())

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def upper(self) -> int:
        return sum(map(str.isupper, self.text))

#: Each rule says whether it rejects the text. BASE: what a text must meet in any case.
RULES: dict[str, Callable[[Facts], bool]] = {
    "few_words": lambda x: x.n_words < 50,
    "repeated_words": lambda x: 100 * x.n_repeat_words > 50 * x.n_words,
    "symbols": lambda x: 10 * x.n_symbols > 2 * x.n_words,
    "word_length": lambda x: not 2 * x.n_words <= x.word_chars <= 15 * x.n_words,
    "duplicate_lines": lambda x: x.n_dup_lines >= 3 and 10 * x.n_dup_lines > 3 * len(x.lines),
    "capitals": lambda x: 2 * x.upper > x.letters,
    "letters": lambda x: 2 * x.letters < x.word_chars,
    "no_words": lambda x: not x.n_words,
}
BASE = ("few_words", "repeated_words")
#: The rules for texts of any length: short ones are kept if nothing else is wrong with them.
ANY_LENGTH = ("no_words", *(r for r in RULES if r not in ("few_words", "no_words")))
#: What the contract's counts are, and what each rule and each fact is made of; facts stand behind those they need.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NEEDS: dict[str, tuple[str, ...]] = {
    "few_words": ("n_words",),
    "repeated_words": ("n_repeat_words", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "duplicate_lines": ("n_dup_lines", "lines"),
    "capitals": ("upper", "letters"),
    "letters": ("letters", "word_chars"),
    "no_words": ("n_words",),
}
MADE_OF: dict[str, tuple[str, ...]] = {
    "data": (),
    "words": ("data",),
    "n_words": ("words",),
    "word_chars": (),
    "n_symbols": ("data",),
    "lines": ("data",),
    "n_dup_lines": ("lines",),
    "n_repeat_words": ("words", "n_words"),
    "letters": (),
    "upper": (),
}


def closure(facts: Sequence[str]) -> set[str]:
    """These facts and all they are made of."""
    return set(facts).union(*(closure(MADE_OF[f]) for f in facts)) if facts else set()


class Cascade:
    """Rules in the order that a sample of ``sample_rows`` texts suggests; until it is complete every rule runs on every text.

    made: facts that every text has anyway, which cost a rule nothing.
    """

    def __init__(self, rules: Sequence[str], made: Sequence[str] = (), sample_rows: int = 256):
        self.order, self.made, self.sample_rows, self.seen = list(rules), closure(made), sample_rows, 0
        self.spent, self.rejected = dict.fromkeys(MADE_OF, 0), []

    def rejects(self, facts: Facts) -> bool:
        if self.seen >= self.sample_rows:
            return any(RULES[r](facts) for r in self.order)
        self.seen += 1
        for name in MADE_OF:
            began = time.thread_time_ns()
            getattr(facts, name)
            self.spent[name] += time.thread_time_ns() - began
        self.rejected.append([RULES[r](facts) for r in self.order])
        found = any(self.rejected[-1])
        if self.seen == self.sample_rows:
            self.order = self.ordered()
        return found

    def ordered(self) -> list[str]:
        """Greedily, the rule that rejects most of what is left for what it still has to make; rules that reject nothing come last, the cheapest first."""
        left, made, names, out = np.array(self.rejected, bool), set(self.made), list(self.order), []
        rules = list(names)
        while rules:
            cost = {r: 1 + sum(self.spent[f] for f in closure(NEEDS[r]) - made) for r in rules}
            best = max(rules, key=lambda r: (left[:, names.index(r)].sum() / cost[r], -cost[r]))
            out.append(best)
            rules.remove(best)
            made |= closure(NEEDS[best])
            left = left[~left[:, names.index(best)]]
        return out


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[str] = tuple(RULES), sample_rows: int = 256) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    The five counts are made for every text, so they cost a rule nothing; texts
    that fail the base meet no further rule. Null text: no words, so it fails
    the base. Repeated rows and null ids each return their row; other columns
    are not read; an empty table returns none. sample_rows: texts of a task by
    which it orders its rules.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade([r for r in rules if r not in BASE], COUNTS, sample_rows)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                facts = Facts(text.as_py())
                counts = [getattr(facts, c) for c in COUNTS]
                base = any(RULES[r](facts) for r in BASE)
                rows.append((*counts, base, not base and not cascade.rejects(facts)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            arrays = [pa.array(c, pa.int64() if k < 5 else pa.bool_()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *COUNTS, "base_failed", "kept"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean")


def quality_filter(docs: DataFrame, text_col: str = "text", rules: Sequence[str] = tuple(RULES), sample_rows: int = 256) -> DataFrame:
    """The rows that none of the rules rejects, all columns as they were.

    Null and empty texts have no words. Repeated rows each have their verdict;
    an empty table returns none.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules, sample_rows=sample_rows)
        for batch in batches:
            yield batch.filter(pa.array([not cascade.rejects(Facts(text.as_py())) for text in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
