"""Conversation repair: the cheapest edits that give system?, then user and assistant in turn.

Conversations are dealt by their id and sorted by turn within tasks; a generator
walks the sorted rows and carries the state of the one it is in from batch to batch. The state is
that of a shortest path over four grammar states: after no row, the system's, a
user's, or an assistant's. Each grammar state has its cost, the place of its edits in
ASCII order among the four, and a running digest of what it would leave. A row adds
two bytes: what kind of row it is and, two bits a grammar state, where each
came from. They go to a temporary file once there are many, so a task's memory does not follow its
longest conversation; only the edit letters that are returned do, a byte each.
Whether a row repeats an earlier one is found by a sort within the same tasks.

One conversation is one task's stream, however long: turns depend on all before them.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE

# Grammar states, edit costs and letters.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
RULES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1

#: Bytes or rows of a conversation that stay in memory.
HELD_BYTES, HELD_ROWS = 1 << 20, 8 << 20
LARGEST = 2**63 - 1


def moves(initial: str, fault: str) -> dict[int, dict[int, tuple[int, str]]]:
    """{to: {from: (cost, letters)}}: the cheapest way over one row between two grammar states, the ASCII-least of equals. Letters: insertions, then what becomes of the row."""
    out: dict[int, dict[int, tuple[int, str]]] = {}
    for origin, inserts in product(range(4), range(3)):
        at = origin
        for _ in range(inserts):
            at = INSERTED[at]
        ways = [(DELETE, "D", at)]
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED * (fault == "truncated")
            ways += [(extra, "K", RULES[initial][at])] if at in RULES[initial] else []
            ways += [(REROLE + extra, "R", INSERTED[at])]  # a turn that may follow is the one that may be inserted
        for cost, letter, to in ways:
            way = (cost + INSERT * inserts, "I" * inserts + letter)
            out.setdefault(to, {})[origin] = min(way, out.get(to, {}).get(origin, way))
    return out


KINDS = [(initial, fault) for initial in RULES for fault in ("", "truncated", "blank")]
MOVES = [moves(*kind) for kind in KINDS]
KIND = {kind: k for k, kind in enumerate(KINDS)}


class Trail:
    """Bytes, two a row, read backwards at the end; beyond HELD_BYTES in a temporary file that goes with the task."""

    def __init__(self) -> None:
        self.tail, self.file = bytearray(), None

    def add(self, kind: int, origins: int) -> None:
        self.tail += bytes((kind, origins))
        if len(self.tail) >= HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.tail)
            self.tail.clear()

    def backwards(self) -> Iterator[tuple[int, int]]:
        def parts() -> Iterator[bytes]:
            yield self.tail
            for at in reversed(range(self.file.tell() // HELD_BYTES if self.file else 0)):
                self.file.seek(at * HELD_BYTES)
                yield self.file.read(HELD_BYTES)

        for part in parts():
            for k in range(len(part) - 2, -1, -2):
                yield part[k], part[k + 1]


class Conversation:
    """The state of one conversation whose rows come in order."""

    def __init__(self, name: str | None) -> None:
        self.name, self.trail = name, Trail()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.last: str | None = None
        self.least = self.most = None
        self.turns = 0
        #: {grammar state: (cost, place in ASCII order, digest so far, whether it has a line)}
        self.states = {START: (0, 0, hashlib.sha256(), False)}

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        bare = text.rstrip(WORD_SPACE)
        fault = "blank" if not bare else "duplicate" if again else "" if bare[-1] in ".!?" else "truncated"
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.last is not None:
            self.counts["illegal"] += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.step(KIND[initial if initial in RULES else "", "blank" if fault == "duplicate" else fault], role, text)

    def step(self, kind: int, role: str, text: str) -> None:
        chosen, origins = [], 0
        for to, ways in MOVES[kind].items():
            known = [(self.states[q][0] + cost, self.states[q][1], letters, q) for q, (cost, letters) in ways.items() if q in self.states]
            if known:
                cost, place, letters, q = min(known)
                chosen.append((place, letters, to, cost, q))
                origins |= q << 2 * to
        states = {}
        for place, (_, letters, to, cost, q) in enumerate(sorted(chosen)):
            _, _, digest, some = self.states[q]
            lines = self.lines(q, letters, role, text)
            if lines:
                digest = digest.copy()
                digest.update((("\n" if some else "") + "\n".join(f"{r}:{t}" for r, t in lines)).encode("utf-8", "surrogatepass"))
            states[to] = (cost, place, digest, some or bool(lines))
        self.states = states
        self.trail.add(kind, origins)

    @staticmethod
    def lines(at: int, letters: str, role: str, text: str) -> list[tuple[str, str]]:
        """(role, text) of what letters leave, from a grammar state on."""
        out = []
        for letter in letters:
            if letter == "D":
                continue
            at = RULES[role[:1]][at] if letter == "K" else INSERTED[at]
            out.append((role if letter == "K" else NAMES[at], "" if letter == "I" else text))
        return out

    def finish(self) -> tuple[dict, str]:
        """(report, audit)."""
        ends = []
        for q, (cost, place, digest, some) in self.states.items():
            inserts = "" if q in FINAL else "I" if q == USER else "II"
            ends.append((cost + INSERT * len(inserts), place, inserts, q, digest, some))
        cost, _, letters, q, digest, some = min(ends, key=lambda e: e[:3])
        if added := self.lines(q, letters, "", ""):
            digest = digest.copy()
            digest.update((("\n" if some else "") + "\n".join(f"{r}:{t}" for r, t in added)).encode())
        audit = bytearray(letters[::-1].encode())
        for kind, origins in self.trail.backwards():
            origin = origins >> 2 * q & 3
            audit += MOVES[kind][q][origin][1][::-1].encode()
            q = origin
        audit.reverse()
        gaps = min(self.most - self.least + 1 - self.turns, LARGEST) if self.turns else 0
        return {"conv": self.name, "gaps": gaps, **self.counts, "cost": cost, "repaired_sha256": digest.hexdigest()}, audit.decode()


def in_order(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone_col: str | None) -> DataFrame:
    """(conv, has_turn, turn, role, text, again, gone), dealt by conversation and sorted by turn, role and text within; null turns first. again: an earlier row has the same role and text."""
    gone = F.coalesce(F.col(f"`{gone_col}`"), F.lit(False)) if gone_col else F.lit(False)
    turn = F.col(f"`{turn_col}`").cast("long")
    rows = turns.select(F.col(f"`{conv_col}`").cast("string").alias("conv"), turn.isNotNull().alias("has_turn"), F.coalesce(turn, F.lit(0)).alias("turn"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))], gone.alias("gone"))
    dealt = rows.repartition("conv")
    earlier = Window.partitionBy("conv", "gone", "role", "text").orderBy("has_turn", "turn")
    return dealt.withColumn("again", F.row_number().over(earlier) > 1).sortWithinPartitions("conv", "has_turn", "turn", "role", "text")


def walked(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows of sorted batches one by one."""
    for part in parts:
        yield from zip(*(part[c] for c in ("conv", "has_turn", "turn", "role", "text", "again", "gone")), strict=True)


def named(made: DataFrame, turns: DataFrame, conv_col: str) -> DataFrame:
    """made with the conversation's id in its own type and name."""
    kind = turns.select(F.col(f"`{conv_col}`").alias("x")).schema["x"].dataType
    return made.select(F.col("conv").cast(kind).alias(conv_col), *[c for c in made.columns if c != "conv"])


REPORT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_reports(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    audit: the letters of the cheapest edits in order (Keep, Rerole, Delete,
    Insert), the ASCII-least of equals; repaired_sha256: of the repaired
    ``role:text`` lines. Rows where gone_col is true only name their conversation, which has
    zeros, an empty audit and the digest of nothing if it has no others. A null id is one
    conversation, a null turn comes first, a null role or text is one space;
    repeated rows are duplicates; other columns are not read; an empty table returns no row.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made = None, []

        def told() -> None:
            report, audit = now.finish()
            made.append(report | {"audit": audit})

        for conv, has_turn, turn, role, text, again, gone in walked(parts):
            if now is None or conv != now.name:
                if now:
                    told()
                now = Conversation(conv)
            if not gone:
                now.add(turn if has_turn else None, role, text, again)
            if len(made) >= 1000:
                yield pd.DataFrame(made)[REPORT]
                made = []
        if now:
            told()
        yield pd.DataFrame(made, columns=REPORT)

    kinds = ", ".join(f"{c} {'string' if c in ('conv', 'audit', 'repaired_sha256') else 'long'}" for c in REPORT)
    return named(in_order(turns, conv_col, turn_col, role_col, text_col, gone_col).mapInPandas(run, kinds), turns, conv_col)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """(conv_col, position, edit, role, text): the turns that repair leaves, from 0, each with its edit's letter. Edge cases as in repair_reports; a conversation left empty has no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, None

        def told() -> Iterator[pd.DataFrame]:
            _, audit = now.finish()
            rows.seek(0)
            out, at, position = [], START, 0
            for letter in audit:
                role, text = ("", "") if letter == "I" else pickle.load(rows)
                for line in Conversation.lines(at, letter, role, text):
                    at = INSERTED[at] if letter != "K" else RULES[role[:1]][at]
                    out.append((now.name, position, letter, *line))
                    position += 1
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=["conv", "position", "edit", "role", "text"])
                    out = []
            rows.close()
            yield pd.DataFrame(out, columns=["conv", "position", "edit", "role", "text"])

        for conv, has_turn, turn, role, text, again, gone in walked(parts):
            if now is None or conv != now.name:
                if now:
                    yield from told()
                now, rows = Conversation(conv), tempfile.SpooledTemporaryFile(HELD_ROWS)
            if not gone:
                now.add(turn if has_turn else None, role, text, again)
                pickle.dump((role, text), rows)
        if now:
            yield from told()

    return named(in_order(turns, conv_col, turn_col, role_col, text_col, gone_col).mapInPandas(run, "conv string, position long, edit string, role string, text string"), turns, conv_col)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows with faults by the checksum of their id and turn, modulo 20: 0 is gone, 1 loses its text, 2 its full stops, 3 stands twice, 4 is a user's. Nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    rows = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    whole = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(copies).alias("copy"))
    return whole.drop("copy")
