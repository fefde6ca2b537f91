"""Conversation repair against exhaustive search, its own pieces, weak hashes and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

import checks
import edge
from tidewheel.llm import conversations as cv, mending_queries

LETTERS = "uasx"


def exhaustive(symbols: list[int]) -> tuple[int, str]:
    """All audits with at most two insertions at a place, judged by the pattern alone."""
    best = None
    gaps = [""] + ["I", "II"]
    options = [["D"] if s & cv.MUST_GO else ["K", "R", "D"] for s in symbols]
    for edits in itertools.product(*options):
        for inserts in itertools.product(gaps, repeat=len(symbols) + 1):
            audit = inserts[0] + "".join(e + i for e, i in zip(edits, inserts[1:]))
            cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[x] for x in audit)
            cost += sum(bool(s & cv.TRUNCATED) for s, e in zip(symbols, edits) if e != "D")
            if (best is None or (cost, audit) < best) and fits(audit, symbols):
                best = cost, audit
    return best


def fits(audit: str, symbols: list[int]) -> bool:
    """Whether free letters (inserted, reroled: u or a) and kept ones can read (s?(ua)+)?."""
    rows = iter(symbols)
    out = []
    for edit in audit:
        symbol = None if edit == "I" else next(rows)
        if edit in "IR":
            out.append("ua")
        elif edit == "K":
            out.append(LETTERS[symbol & 3])
    return any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in (itertools.product(*out) if len(out) < 9 else ()))


def best_of(symbols: list[int], cuts: list[int], audits=None) -> tuple[int, str]:
    pieces, at = [], 0
    for number, size in enumerate(cuts):
        part = symbols[at : at + size]
        at += size
        pieces.append([
            (start, end, cost, audit)
            for start in (range(4) if number else (0,))
            for end, (cost, audit) in cv.ways(part, start, number == 0, audits and audits()).items()
        ])
    return cv.joined(pieces)


def random_symbols(rng: random.Random, count: int) -> list[int]:
    return [rng.choice([0, 1, 0, 1, 2, 3]) + rng.choice([0, 0, 0, cv.MUST_GO, cv.TRUNCATED]) for _ in range(count)]


def test_every_short_conversation():
    kinds = [0, 1, 2, 3, 0 + cv.MUST_GO, 0 + cv.TRUNCATED, 1 + cv.TRUNCATED, 2 + cv.TRUNCATED]
    for count in (1, 2):
        for symbols in itertools.product(kinds, repeat=count):
            assert best_of(list(symbols), [count]) == exhaustive(list(symbols)), symbols
    rng = random.Random(1)
    for _ in range(60):
        symbols = random_symbols(rng, 3)
        assert best_of(symbols, [3]) == exhaustive(symbols), symbols


def test_pieces_give_the_whole():
    rng = random.Random(2)
    for _ in range(150):
        symbols = random_symbols(rng, rng.randint(2, 40))
        whole = best_of(symbols, [len(symbols)])
        cuts, left = [], len(symbols)
        while left:
            cuts.append(rng.randint(1, min(left, 7)))
            left -= cuts[-1]
        assert best_of(symbols, cuts) == whole


def test_colliding_hashes_do_no_harm():
    rng = random.Random(3)
    for _ in range(100):
        symbols = random_symbols(rng, rng.randint(2, 60))
        weak = best_of(symbols, [len(symbols)], lambda: cv.Audits(base=1, prime=2))
        assert weak == best_of(symbols, [len(symbols)])


def test_audit_comparison_equals_strings():
    rng = random.Random(4)
    audits, texts = cv.Audits(), {0: ""}
    for _ in range(400):
        parent = rng.choice(list(texts))
        letter = rng.choice("DIKR")
        texts[audits.add(parent, letter)] = texts[parent] + letter
    for node, text in texts.items():
        assert audits.text(node) == text
    for _ in range(4000):
        a, b = rng.choice(list(texts)), rng.choice(list(texts))
        x, y = texts[a] + "D", texts[b] + "K"
        if not x.startswith(y) and not y.startswith(x):
            assert audits.less(a, "D", b, "K") == (x < y)


def plain_audit(symbols: list[int]) -> tuple[int, str]:
    """The same programme with whole strings as states."""
    def closed(live):
        for _ in range(2):
            for state, (cost, audit) in list(live.items()):
                then = cv.NEXT[state][1]
                live[then] = min(live.get(then, (1 << 60, "")), (cost + 2, audit + "I"))
        return live

    live = closed({0: (0, "")})
    for s in symbols:
        new = {}
        for state, (cost, audit) in live.items():
            moves = [(state, 3, "D")]
            if not s & cv.MUST_GO:
                follower, then = cv.NEXT[state]
                moves.append((then, 2 + bool(s & cv.TRUNCATED), "R"))
                if s & 3 == follower or (s & 3 == 2 and state == 0):
                    moves.append((1 if s & 3 == 2 else then, bool(s & cv.TRUNCATED), "K"))
            for then, more, letter in moves:
                new[then] = min(new.get(then, (1 << 60, "")), (cost + more, audit + letter))
        live = closed(new)
    return min(live[s] for s in (0, 3) if s in live)


def test_long_conversation_with_few_node_comparisons():
    rng = random.Random(6)
    symbols = random_symbols(rng, 3000)
    assert best_of(symbols, [3000]) == plain_audit(symbols)
    assert best_of([0] * 2000, [700, 700, 600]) == plain_audit([0] * 2000)


AWKWARD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello"), (1, 2, "user", None), (1, 3, None, "What?"), (1, 3, "user", "Tie!"),
    (1, 3, "user", "Tie!"), (1, None, "system", "Late."), (1, None, "system", "Early."),
    (None, 1, "user", "No id."), (None, None, None, None), (None, 2, "assistant", "Yes "),
    (2, 5, "", "Nobody."), (2, 9, "agent", "Odd."), (2, 7, "User", "Big."), (2, 8, "sage", "x" * 20_000 + "."),
    (3, 1, "user", " \t\n\v\f\r"), (3, 2, "assistant", " "), (3, 3, "assistant", "...\u0085"),
    (4, None, "user", "Only nulls."), (4, None, "assistant", "Yes."),
    *[(5, t, "user", f"Turn {t % 7}.") for t in range(60)],
    *[(c, 0, "user", "One.") for c in range(100, 140)],
]
SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    from pyspark.sql import functions as F

    names = ["conv", "pos", "copy", "said", "letter", "fault", "audit", "piece", "first", "of", "at", "n", "sha256", "draw"]
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(f"own {c}").alias(c) for c in names])


def twin(rows):
    con = duckdb.connect()
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    conversations = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "turn", "role", "text"])  # noqa: F841
    con.execute("CREATE TABLE conversations AS SELECT * FROM conversations")
    return con


@pytest.mark.parametrize("rows", [AWKWARD, []], ids=["awkward", "empty"])
def test_twin_on_awkward_rows(spark, rows):
    assert checks.compare(cv.damage_report(frame(spark, rows)), twin(rows), mending_queries.OP13_SQL) == []


def test_conversation_without_rows_after_damage(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = cv.damage_report(frame(spark, [(gone, 0, "user", "Lost.")])).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversations_are_cut(spark):
    """One conversation holds most rows; pieces of 16 rows give what whole ones give."""
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "", "Why?", f"T{t}."])) for t in range(700)]
    rows += [(c, t, "user" if t % 2 else "system", f"{c}.") for c in range(20) for t in range(3) if c != 7]
    plain = cv.plain_rows(frame(spark, rows))
    assert edge.rows_of(cv.report(plain, segment=16)) == edge.rows_of(cv.report(plain))


def test_repaired_turns_alternate(spark):
    rows = cv.ordered(cv.damaged(cv.plain_rows(frame(spark, AWKWARD))))
    turns: dict = {}
    for r in cv.repaired(rows, cv.audited(cv.marked(rows))).orderBy("conv", "at").collect():
        turns.setdefault(r["conv"], []).append(r["role"][:1])
    assert turns and all(re.fullmatch("s?(ua)+", "".join(t)) for t in turns.values())
