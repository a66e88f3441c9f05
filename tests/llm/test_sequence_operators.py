"""Language profiles, periodic runs and conversation repair against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest

from riskloom.llm import turns as T
from riskloom.llm.languages import Letters, Space, grams, identify, learn_profiles
from riskloom.llm.queries import QUERIES
from riskloom.llm.runs import Positions, find_runs, kept_words, periodic_runs, run_digest

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, conv string, runs int, score string"


def rows_of(table, folder):
    return duckdb.sql(f"select * from '{folder}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with inner names."""
    texts = [None, "", " \n\t ", "123 #!", "die und der", "the and of", "la " * 30_000, "同じ 言葉", "die und der"]
    rows = [(k, t, None if k == 5 else "de" if k in (4, 8) else "es", "x", 1, "y") for k, t in enumerate(texts)] + [(None, "die und der", "de", None, None, None), (8, "die und der", "de", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


# Language profiles
def plain_vector(text, space):
    """Letter by letter, without shared n-grams or pieces."""
    marked = re.sub(r" +", " ", f" {''.join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else ' ' for c in text)} ")
    codes = [0 if c == " " else ord(c) for c in marked]
    out = np.zeros(space.dim)
    for k in range(len(codes) - 2):
        a, b, c = (space.letter_vector(x).astype(int) for x in codes[k : k + 3])
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_bundles_are_sums_of_bound_letters(monkeypatch):
    space, letters = Space(256, 3, 1), Letters()
    for piece in (7, 1 << 20):
        monkeypatch.setattr("riskloom.llm.languages.PIECE", piece)
        for text in ("The cat, the CAT!  sat", "Über-größe 12 Ünicode", "a", "x1", "日本語 テキスト", "İstanbul ΣΑΣ ſt"):
            found = sum((space.bundle(*pair) for pair in grams(text, letters, 3)), np.zeros(256))
            assert (found == plain_vector(text, space)).all(), (piece, text)


def test_vectors_are_made_again_when_there_is_no_room(monkeypatch):
    monkeypatch.setattr("riskloom.llm.languages.HELD", 2048)
    space, rng = Space(64, 3, 1), np.random.default_rng(0)
    keys = np.unique(rng.integers(97, 123, (6000, 3)) @ np.array([1 << 42, 1 << 21, 1]))
    want = space.bound(keys.tolist()).sum(axis=0)
    assert (space.bundle(keys, np.ones(len(keys), np.int64)) == want).all()


def test_language_query(spark, small):
    truth = {d: (t, lang) for d, t, lang, *_ in rows_of("documents", small)}
    found = QUERIES["op11_language_id"](spark, small).collect()
    space, sums = Space(2048, 3, 11), {}
    vectors = {d: plain_vector(t[:4000], space) for d, (t, _) in truth.items() if len(t) <= 4000}
    whole = {d: sum((space.bundle(*p) for p in grams(t, Letters(), 3)), np.zeros(2048)) for d, (t, _) in truth.items()}
    assert all((vectors[d] == whole[d]).all() for d in vectors)
    for d, v in whole.items():
        if zlib.crc32(str(d).encode()) % 4 != 2:
            sums[truth[d][1]] = sums.get(truth[d][1], 0) + v
    assert len(found) == len(truth) and {r.doc_id for r in found} == set(truth)
    right = held = 0
    for r in found:
        cosine = {k: v @ whole[r.doc_id] / np.linalg.norm(v) / np.linalg.norm(whole[r.doc_id]) for k, v in sums.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.lang_pred == best and abs(r.score - cosine[best]) < 1e-5
        held, right = held + r.held_out, right + (r.held_out and best == truth[r.doc_id][1])
    assert right >= 0.97 * held > 20


def test_language_edges(spark, odd):
    profiles = learn_profiles(odd, dim=512)
    assert {r.lang for r in profiles.collect()} <= {"de", "es"}
    for block in (1, 2048):
        found = [tuple(r) for r in identify(odd, profiles, block=block).collect()]
        assert len(found) == 11
        assert {p for d, p, s in found if d in (0, 1, 2, 3)} == {"und"} and {s for d, p, s in found if d in (0, 1, 2, 3)} == {0.0}
        assert {p for d, p, _ in found if d in (4, 8, None)} == {"de"} and {p for d, p, _ in found if d == 6} == {"es"}
        assert all(0 <= s <= 1 for *_, s in found)
    empty = spark.createDataFrame([], DOCS)
    assert identify(empty, profiles).count() == 0
    assert {r.lang_pred for r in identify(odd, learn_profiles(empty)).collect()} == {"und"}


# Periodic runs
def plain_runs(w, min_length=6, min_exponent=4):
    """Every stretch of every period, the smallest period of a stretch."""
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and (length := i + q - start) >= max(min_length, min_exponent * q):
                found.setdefault((start, length), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_are_those_of_all_periods():
    rng = random.Random(5)
    for _ in range(4000):
        n = rng.randint(0, 60)
        w = [rng.choice("abcdef"[: rng.choice([1, 2, 3])]) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            w[rng.randrange(n)] = rng.choice("abz")
        for bounds in ((6, 4), (2, 2), (5, 3)):
            assert find_runs(w, *bounds) == plain_runs(w, *bounds), w


def test_ordered_positions():
    rng, held = random.Random(1), Positions(50_000)
    want = [50_000]
    for x in rng.sample(range(50_000), 9_000):
        left, right = held.add(x)
        assert left == max((y for y in want if y < x), default=None) if len(want) < 300 else True
        assert right == min((y for y in want if y > x), default=None) if len(want) < 300 else True
        want.append(x)
    assert list(held) == sorted(want) and len(held.parts) > 5


def test_long_runs_take_linear_steps():
    assert find_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    assert find_runs([str(k % 9_999) for k in range(100_000)]) == [(0, 100_000, 9_999)]


def test_run_query(spark, small):
    found = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, small).collect()}
    docs = rows_of("documents", small)
    assert len(found) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    seen = 0
    for doc, text, *_ in docs:
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w) if n < 3000 else find_runs(w)
        seen += bool(runs)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        r = found[doc]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in dropped))
    assert seen > 5


def test_run_edges(spark, odd):
    found = periodic_runs(odd)
    told = found.collect()
    assert len(told) == 11 and {len(r.runs) for r in told if r.doc_id != 6} == {0}
    assert [tuple(x) for r in told if r.doc_id == 6 for x in r.runs] == [(0, 30_000, 1)]
    assert [r.collapsed for r in told if r.doc_id in (0, 1, 2, 6)] == ["", "", "", "la"]
    assert run_digest(found).where("start is null and length is null and period is null and exponent_milli is null").count() == 10
    assert periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    assert kept_words(8, [(0, 6, 1), (1, 7, 3)]).tolist() == [True] + [False] * 7


# Conversation repair
NEXT, TOLD = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}


def plain_repair(rows):
    """(cost, audit, lines) of the cheapest edits by trying all of them, whole strings compared."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        faults.append("B" if not bare else "D" if (role, text) in seen else "T" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def go(cost, letter, line, *then):
            if rest := best(*then):
                found.append((cost + rest[0], letter + rest[1], ((line,) if line else ()) + rest[2]))

        if inserted < 3:
            go(2, "I", TOLD[NEXT[state]] + ":", i, NEXT[state], inserted + 1)
        if i < len(rows):
            (role, text), extra = rows[i], int(faults[i] == "T")
            go(3, "D", None, i + 1, state, 0)
            if faults[i] not in ("B", "D"):
                for initial, states, to in (("s", (0,), 1), ("u", (0, 1, 3), 2), ("a", (2,), 3)):
                    if role[:1] == initial and state in states:
                        go(extra, "K", f"{role}:{text}", i + 1, to, 0)
                go(2 + extra, "R", f"{TOLD[NEXT[state]]}:{text}", i + 1, NEXT[state], 0)
        return min(found, key=lambda f: f[:2]) if found else None

    return best(0, 0, 0), faults


def report_of(turns):
    """The contract's columns for (turn, role, text) rows in order."""
    (cost, audit, lines), faults = plain_repair(tuple((r, t) for _, r, t in turns))
    numbers = [t for t, *_ in turns if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *(faults.count(k) for k in "BDT"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def ordered(turns):
    return sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))


@pytest.mark.parametrize("held", [8, 1 << 20])
def test_repair_is_the_cheapest(monkeypatch, held):
    monkeypatch.setattr(T, "HELD_BYTES", held)
    rng = random.Random(3)
    for _ in range(3000):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", " "]), rng.choice(["x.", "y!", "z", "w?", "", "  ", "q", "p. "])) for _ in range(rng.randint(0, 9))]
        made, seen = T.Conversation("1"), set()
        for turn, row in enumerate(rows):
            made.add(turn, *row, row in seen)
            seen.add(row)
        report, audit = made.finish()
        (cost, letters, lines), _ = plain_repair(tuple(rows))
        assert (report["cost"], audit, report["repaired_sha256"]) == (cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repair_query(spark, small):
    whole = {}
    for conv, turn, role, text in rows_of("conversations", small):
        fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (turn, "user" if fault == 4 else role, text)
        whole.setdefault(conv, []).extend([row] * {0: 0, 3: 2}.get(fault, 1))
    found = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, small).collect()}
    assert found == {c: report_of(ordered(t)) for c, t in whole.items()}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = "conv_id long, turn long, role string, text string, gone boolean, conv string, again int"


def test_repair_edges(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 2, 5, 2**62]), rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "a.", "b", "c! "]), False, "x", 1) for _ in range(25)]
    rows += [(7, 3, "user", "x.", True, None, None), (8, -(2**63), "user", "x.", None, None, None), (8, 2**63 - 1, "assistant", "y." * 300_000, False, None, None)]
    df = spark.createDataFrame(rows, TURNS)
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in T.repair_reports(df, gone_col="gone").collect()}
    kept = {}
    for conv, turn, role, text, gone, *_ in rows:
        kept.setdefault(conv, []).extend([] if gone else [(turn, role if role is not None else " ", text if text is not None else " ")])
    want = {c: report_of(ordered(t)) for c, t in kept.items()}
    want[8] = (2**63 - 1, *want[8][1:])
    assert found == want and found[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    left = {}
    for r in T.repaired_turns(df, gone_col="gone").orderBy("conv_id", "position").collect():
        left.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(left.get(c, [])).encode()).hexdigest() for c in want} == {c: v[-1] for c, v in want.items()}
    empty = spark.createDataFrame([], TURNS)
    assert T.repair_reports(empty).count() == 0 and T.repaired_turns(empty).count() == 0


def test_repair_shuffles_once(spark, small, tmp_path):
    plan = QUERIES["op13_conversation_repair"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
