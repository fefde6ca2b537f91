"""Conversation structure repair: the cheapest edits that make the roles alternate.

A conversation is well formed when the first letters of its roles read ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turn.  Edits are Keep (free), Rerole to
user or assistant, Delete, and Insert of an empty user or assistant turn; a kept or reroled
turn that is cut off costs extra.  Of the cheapest ways the one whose audit, the initials of
its edits in order, is least in ASCII order is taken.  The steps:

1.  Rows become one byte each: letter class of the role, and the row's first fault.  Faults
    and positions are found by Spark (counts, numbered rows); no text takes part later.
2.  A dynamic programme runs over the four states of the pattern.  Its states do not hold
    audits but nodes: an edit and a link to the node before it, so that prefixes are shared.
    Each node has its ancestors at the powers of two and a rolling hash of its audit.  Ties
    are settled by the longest common prefix of two audits, found by lifting both nodes while
    the hashes of their ancestors differ; equal hashes are checked letter by letter.
3.  A conversation longer than ``SEGMENT`` rows is cut.  Every piece gives the best audit from
    each state to each state, and the pieces are joined by the same programme.  Thus no task
    holds more than a piece's rows, and then one byte of audit per row and pair of states.
4.  The audit is laid before the rows of its conversation in one sorted stream, which yields
    the repaired turns; the stream keeps one batch at a time.

Defined cases: null ids, roles and texts count as one space; rows of a null conversation are
one conversation.  Turns are taken in order, nulls first; rows of one turn by role, then by a
hash of the text, so equal rows may change places.  A role that is empty or begins with
another letter can only be reroled or deleted.  An empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewheel.llm.tables import partitions, stored
from tidewheel.operators.ordering import number_rows

SEGMENT = 8192
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
SPACES = " \t\n\v\f\r"
USER, ASSISTANT, SYSTEM, OTHER = range(4)
CLASSES = "uas"
MUST_GO, TRUNCATED = 4, 8
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ENDS = (START, AFTER_ASSISTANT)
# Per state: the letter class that may follow besides a system turn, and the state it leads to.
NEXT = {s: (ASSISTANT, AFTER_ASSISTANT) if s == AFTER_USER else (USER, AFTER_USER) for s in range(4)}
ROLES = {USER: "user", ASSISTANT: "assistant"}

_PRIME = (1 << 61) - 1
_BASE = 1_000_003_579

PIECES = "conv long, piece long, illegal long, first string, last string, ways array<struct<start:int,end:int,cost:long,audit:string>>"
AUDITS = "conv long, illegal long, cost long, audit string"
TURNS = "conv long, at long, role string, text string, edit string"


# --- the programme -------------------------------------------------------------------


class Audits:
    """A forest of shared audit prefixes.  Node 0 is the empty audit."""

    def __init__(self, base: int = _BASE, prime: int = _PRIME):
        self.base, self.prime = base, prime
        self.letters, self.depths, self.hashes, self.ups = [""], [0], [0], [()]

    def add(self, parent: int, letter: str) -> int:
        ups = [parent]
        while len(self.ups[ups[-1]]) >= len(ups):
            ups.append(self.ups[ups[-1]][len(ups) - 1])
        self.letters.append(letter)
        self.depths.append(self.depths[parent] + 1)
        self.hashes.append((self.hashes[parent] * self.base + ord(letter)) % self.prime)
        self.ups.append(tuple(ups))
        return len(self.letters) - 1

    def at_depth(self, node: int, depth: int) -> int:
        """The ancestor of ``node`` whose audit has ``depth`` letters."""
        left = self.depths[node] - depth
        while left:
            step = left.bit_length() - 1
            node = self.ups[node][step]
            left -= 1 << step
        return node

    def common(self, a: int, b: int) -> tuple[int, int]:
        """The ancestors of both nodes where their audits stop being equal."""
        depth = min(self.depths[a], self.depths[b])
        a, b = self.at_depth(a, depth), self.at_depth(b, depth)
        top_a, top_b = a, b
        for step in reversed(range(len(self.ups[a]))):
            if step < len(self.ups[a]) and self.hashes[self.ups[a][step]] != self.hashes[self.ups[b][step]]:
                a, b = self.ups[a][step], self.ups[b][step]
        if self.hashes[a] != self.hashes[b]:
            a, b = self.ups[a][0], self.ups[b][0]
        if not self._same(a, b):
            return self._plain(top_a, top_b)
        return a, b

    def _same(self, a: int, b: int) -> bool:
        """Whether two audits of one length are equal, letter by letter down to a shared node."""
        while a != b:
            if self.letters[a] != self.letters[b]:
                return False
            a, b = self.ups[a][0], self.ups[b][0]
        return True

    def _plain(self, a: int, b: int) -> tuple[int, int]:
        """``common`` without hashes, for two nodes of one depth: the last difference seen going up."""
        at = a, b
        while a != b:
            differ = self.letters[a] != self.letters[b]
            a, b = self.ups[a][0], self.ups[b][0]
            if differ:
                at = a, b
        return at

    def less(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether audit a followed by letter x comes before audit b followed by y.

        Both stand for the same rows at the same cost, so neither begins the other.
        """
        if a == b:
            return x < y
        end_a, end_b = self.common(a, b)
        depth = self.depths[end_a]
        return self._letter(a, depth, x) < self._letter(b, depth, y)

    def _letter(self, node: int, depth: int, more: str) -> str:
        return self.letters[self.at_depth(node, depth + 1)] if depth < self.depths[node] else more

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.ups[node][0]
        return "".join(reversed(out))


def _better(audits: Audits, found: dict, state: int, cost: int, node: int, letter: str) -> None:
    """Keep the least (cost, audit) that leads to ``state``."""
    old = found.get(state)
    if old is None or cost < old[0] or cost == old[0] and audits.less(node, letter, old[1], old[2]):
        found[state] = (cost, node, letter)


def _inserted(audits: Audits, live: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """``live`` with turns inserted where that gives a cheaper or smaller audit: two at most,
    as a third would lead back."""
    for _ in range(2):
        found = {s: (cost, node, "") for s, (cost, node) in live.items()}
        for state, (cost, node) in live.items():
            _better(audits, found, NEXT[state][1], cost + INSERT, node, "I")
        live = {s: (cost, audits.add(node, letter) if letter else node) for s, (cost, node, letter) in found.items()}
    return live


def ways(symbols: list[int], start: int = START, opening: bool = True, audits: Audits | None = None) -> dict[int, tuple[int, str]]:
    """Per end state the least cost and audit over one piece, begun in state ``start``.

    Turns may be inserted behind each row, and before the first one if it is the ``opening``.
    """
    audits = audits or Audits()
    live = {start: (0, 0)}
    if opening:
        live = _inserted(audits, live)
    for symbol in symbols:
        letter_class, goes, cut = symbol & 3, symbol & MUST_GO, CUT_OFF if symbol & TRUNCATED else 0
        found: dict[int, tuple[int, int, str]] = {}
        for state, (cost, node) in live.items():
            _better(audits, found, state, cost + DELETE, node, "D")
            if goes:
                continue
            follower, then = NEXT[state]
            if letter_class == follower:
                _better(audits, found, then, cost + KEEP + cut, node, "K")
            elif letter_class == SYSTEM and state == START:
                _better(audits, found, AFTER_SYSTEM, cost + KEEP + cut, node, "K")
            _better(audits, found, then, cost + REROLE + cut, node, "R")
        live = _inserted(audits, {s: (cost, audits.add(node, letter)) for s, (cost, node, letter) in found.items()})
    return {s: (cost, audits.text(node)) for s, (cost, node) in live.items()}


def joined(pieces: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """The cheapest, then least, audit over consecutive pieces of (start, end, cost, audit)."""
    live: dict[int, tuple[int, tuple]] = {START: (0, ())}
    for piece in pieces:
        found: dict[int, tuple[int, tuple]] = {}
        for start, end, cost, audit in piece:
            if start in live:
                before, chain = live[start]
                new = before + cost, (chain, audit)
                old = found.get(end)
                if old is None or new[0] < old[0] or new[0] == old[0] and _chain_less(new[1], old[1]):
                    found[end] = new
        live = found
    best = None
    for state in ENDS:
        if state in live and (best is None or live[state][0] < best[0] or live[state][0] == best[0] and _chain_less(live[state][1], best[1])):
            best = live[state]
    return best[0], "".join(_tail(best[1], ()))


def _tail(chain: tuple, stop: tuple) -> list[str]:
    out = []
    while chain is not stop and chain:
        out.append(chain[1])
        chain = chain[0]
    return out[::-1]


def _chain_less(a: tuple, b: tuple) -> bool:
    """Compare two chains of as many pieces behind the last chain they share."""
    top_a, top_b = a, b
    while top_a is not top_b and top_a:
        top_a, top_b = top_a[0], top_b[0]
    return "".join(_tail(a, top_a)) < "".join(_tail(b, top_b))


class Replay:
    """Walks along an audit, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _next(self) -> str:
        self.at += 1
        return self.audit[self.at - 1]

    def row(self, role: str) -> tuple[str, str]:
        """The edit of the next row and the role it has afterwards."""
        edit = self._next()
        follower, then = NEXT[self.state]
        if edit == "K" and self.state == START and role[:1] == CLASSES[SYSTEM]:
            self.state = AFTER_SYSTEM
        elif edit != "D":
            self.state = then
        return edit, ROLES[follower] if edit == "R" else role

    def inserted(self) -> Iterator[str]:
        """The roles of the turns inserted here."""
        while self.audit.startswith("I", self.at):
            self.at += 1
            follower, self.state = NEXT[self.state]
            yield ROLES[follower]


# --- Spark ---------------------------------------------------------------------------


def or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def plain_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) without null roles and texts."""
    return rows.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), or_space(role).alias("role"), or_space(text).alias("text")
    )


def ordered(rows: DataFrame) -> DataFrame:
    """``plain_rows`` with what settles their order: ``said``, a hash of role and text, and ``copy``."""
    copy = F.col("copy") if "copy" in rows.columns else F.lit(0)
    said = F.unhex(F.md5(F.concat(F.col("role"), F.lit("\n"), F.col("text"))))
    return rows.select("conv", "turn", "role", "text", said.alias("said"), copy.cast("int").alias("copy"))


ORDER = ["turn", "role", "said", "copy"]


def marked(rows: DataFrame) -> DataFrame:
    """Per row of ``ordered``: conv, turn, its position from 1, its letter and its first fault
    (blank, duplicate, truncated or null).  Without texts, and written once."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    narrow = stored(
        rows.select(
            "conv", "turn", "role", "said", "copy",
            F.substring("role", 1, 1).alias("letter"),
            (bare == "").alias("blank"),
            (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        ),
        "turns",
    )
    numbered = stored(number_rows(narrow, ["conv"], ORDER, "pos").drop("role", "copy"), "numbered")
    firsts = stored(
        numbered.groupBy("conv", "said").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("conv").alias("of"), F.col("said").alias("what"), "first"),
        "firsts",
    )
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return stored(
        numbered.join(firsts, numbered["conv"].eqNullSafe(firsts["of"]) & (numbered["said"] == firsts["what"]), "left")
        .select("conv", "turn", "pos", "letter", fault.alias("fault")),
        "faults",
    )


def audited(faults: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, illegal, cost, audit) per conversation of ``marked`` rows."""
    letter_class = F.lit(OTHER)
    for number, letter in enumerate(CLASSES):
        letter_class = F.when(F.col("letter") == letter, F.lit(number)).otherwise(letter_class)
    flags = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    pieces = (
        faults.select("conv", "pos", (letter_class + flags).cast("int").alias("symbol"), F.floor((F.col("pos") - 1) / segment).alias("piece"))
        # A few bytes of input stand for much work, so the number of tasks is given here.
        .repartition(partitions(faults), "conv", "piece")
        .groupBy("conv", "piece")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("rows"))
        .select("conv", "piece", F.col("rows.symbol").alias("symbols"))
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, piece, symbols in zip(*[c.to_pylist() for c in batch.columns]):
                found = [
                    {"start": start, "end": end, "cost": cost, "audit": audit}
                    for start in (range(4) if piece else (START,))
                    for end, (cost, audit) in ways(symbols, start, piece == 0).items()
                ]
                letters = [(CLASSES + "?")[s & 3] for s in symbols]
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
                out.append({"conv": conv, "piece": piece, "illegal": illegal, "first": letters[0], "last": letters[-1], "ways": found})
            yield pa.RecordBatch.from_pylist(out, schema=_PIECES)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, parts in zip(*[c.to_pylist() for c in batch.columns]):
                seams = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
                cost, audit = joined([[tuple(w.values()) for w in p["ways"]] for p in parts])
                out.append({"conv": conv, "illegal": seams + sum(p["illegal"] for p in parts), "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(out, schema=_AUDITS)

    return (
        pieces.mapInArrow(solve, PIECES)
        .groupBy("conv")
        .agg(F.sort_array(F.collect_list(F.struct("piece", "illegal", "first", "last", "ways"))).alias("parts"))
        .mapInArrow(assemble, AUDITS)
    )


_WAY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_PIECES = pa.schema(
    [("conv", pa.int64()), ("piece", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("ways", pa.list_(_WAY))]
)
_AUDITS = pa.schema([("conv", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_TURNS = pa.schema([("conv", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, at, role, text, edit) of each turn after repair, ``at`` from 0.

    ``rows`` are ``ordered`` ones, ``audits`` those of ``audited``.  The turns of a conversation
    lie together and in order in one partition of the result.
    """
    head = audits.select("conv", F.lit(False).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.lit(b"").alias("said"), F.lit(0).alias("copy"), F.col("audit").alias("text"))
    body = rows.select("conv", F.lit(True).alias("row"), "turn", "role", "said", "copy", "text")
    stream = (
        head.union(body)
        .repartition(partitions(rows), "conv")
        .sortWithinPartitions("conv", "row", *ORDER)
        .select("conv", "row", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, at = Replay(""), 0
        for batch in batches:
            out = []
            for conv, is_row, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                turns = []
                if is_row:
                    edit, role = replay.row(role)
                    if edit != "D":
                        turns.append((role, text, edit))
                else:
                    replay, at = Replay(text), 0
                turns.extend((role, "", "I") for role in replay.inserted())
                for role, text, edit in turns:
                    out.append({"conv": conv, "at": at, "role": role, "text": text, "edit": edit})
                    at += 1
            yield pa.RecordBatch.from_pylist(out, schema=_TURNS)

    return stream.mapInArrow(run, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """(conv, n, sha256) of the ``role:text`` lines of ``repaired`` turns, read as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, lines = None, None, 0
        for batch in batches:
            done = []
            for conv, at, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if at == 0:
                    if digest is not None:
                        done.append((now, lines, digest.hexdigest()))
                    now, digest, lines = conv, hashlib.sha256(), 0
                digest.update((b"\n" if lines else b"") + f"{role}:{text}".encode())
                lines += 1
            yield _digest_rows(done)
        if digest is not None:
            yield _digest_rows([(now, lines, digest.hexdigest())])

    return turns.select("conv", "at", "role", "text").mapInArrow(run, "conv long, n long, sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "n", "sha256"])


def report(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``plain_rows``: gaps, faults, cost, audit and digest."""
    rows = ordered(rows)
    faults = marked(rows)
    audits = stored(audited(faults, segment), "audits")
    turns = F.col("turn")
    counts = faults.groupBy("conv").agg(
        F.coalesce(F.max(turns) - F.min(turns) + 1 - F.count_distinct(turns), F.lit(0)).alias("gaps"),
        *[F.count_if(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    parts = [counts, audits, digests(repaired(rows, audits)).select("conv", "sha256")]
    whole = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return whole.groupBy("conv").agg(*[F.max(c).alias(c) for c in whole.columns if c != "conv"])


# --- the query's damage ----------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """``plain_rows`` of conversations after one of five faults, drawn by crc32 of ``conv:turn``."""
    draw = F.crc32(F.concat(or_space("conv"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(draw == 4, "user").otherwise(F.col("role"))
    copies = F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(draw != 0).select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def damage_report(conversations: DataFrame) -> DataFrame:
    """Damage, then repair; one row per conversation of the input, also for those left without rows."""
    rows = plain_rows(conversations)
    every = rows.select("conv").distinct()
    found = report(damaged(rows)).withColumnRenamed("conv", "of")
    nothing = hashlib.sha256(b"").hexdigest()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv").eqNullSafe(F.col("of")), "left").select(
        F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
