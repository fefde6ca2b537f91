"""Secrets in texts: rules, and a character network over every candidate and its surroundings.

1.  Rules find spans of three kinds (an assignment to a telling name, an access key, a long
    hexadecimal run).  Further runs of key characters that hold a digit are candidates of the
    kind ``other``.  Each finding keeps the characters before and behind it.
2.  A convolutional network in numpy reads a finding's characters, marked as before, inside or
    behind, with filters of several widths and the largest response of each over the whole
    finding, however long.  It is trained on labelled findings; in the query the rules label
    them.  Each also trains without its surroundings, so that a value counts by itself.
3.  A candidate that no rule took need not be harmless.  So two networks, each trained on half
    of the unlabelled candidates, judge the other half; those that look like secrets leave the
    training rows before the last network is trained.
4.  Scores are calibrated (a logistic fit) on findings that the weights never saw.  The
    threshold of a kind is the largest that still finds ``RECALL`` of its labelled secrets
    there, lowered half way to the bulk of the harmless findings; ``other`` and kinds with
    few findings use that of all.
5.  Spans of rules always stay; candidates from the threshold on are added.

Texts are scanned once, one row in, one row out; the rest works on the findings alone, whose
table is written in between.  All distinct findings, of any length, train and calibrate.  They
are dealt by hash into shards of about ``SHARD_FINDINGS``; in each pass every shard is learnt
by a task from the same weights, and the next pass begins with the mean of theirs.  The sums of
the means, of the logistic fit and of the ranks are Spark aggregates; sums are decimal, so that
neither tasks nor their order change a result.

Defined cases: a null text is empty.  Rows with equal or null ids are scanned each by itself.
Offsets are code points.  Without labelled findings of both classes no span is added.  An
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewheel.llm.tables import stored, text_or_empty
from tidewheel.operators.ordering import running

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
OTHER = re.compile("[A-Za-z0-9+/_=-]{12,}")
DIGIT = re.compile("[0-9]")
MIN_VALUE, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "other")

CONTEXT = 24
SHARD_FINDINGS = 4_000
SHARD_CHARS = 4 << 20
MIN_FINDINGS = 10
RECALL = 0.98
HOLD = 4
SEED = 5
NEWTON = 50
EPOCHS = 4
BATCH = 64
RATE = 0.1
DECAY = 1e-4
FIRST_SQUARE = 1e-4
DIM = 8
WIDTHS = (2, 3, 5)
FILTERS = 12
BLOCK_CHARS = 1 << 16

SYMBOLS = 129  # ASCII and one for all others
PAD = 3 * SYMBOLS
GAP = max(WIDTHS) - 1

FINDING = "struct<kind:int,start:long,stop:long,before:string,value:string,behind:string>"


# --- candidates ----------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, stop, value start, value stop) of the rules, by start, then kind."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_VALUE:
                found.append((0, m.start(), m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        found.extend((1, m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS)
    found.extend((2, m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text))
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """The spans of the rules and the further candidates, which touch none of them."""
    found = base_spans(text)
    taken = sorted((s[1], s[2]) for s in found)
    reach, more, at = 0, [], 0
    for m in OTHER.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start() and DIGIT.search(text, m.start(), m.end()):
            more.append((3, m.start(), m.end(), m.start(), m.end()))
    return sorted(found + more, key=lambda s: (s[1], s[0]))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT) -> DataFrame:
    """(doc_id, found) per row: all candidates of the whole text with their surroundings."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [
                    {"kind": kind, "start": start, "stop": stop, "before": text[max(0, a - context) : a], "value": text[a:b], "behind": text[b : b + context]}
                    for kind, start, stop, a, b in candidates(text)
                ]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_FINDING))], ["doc_id", "found"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, found array<{FINDING}>"
    )


_FINDING = pa.struct(
    [("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("before", pa.string()), ("value", pa.string()), ("behind", pa.string())]
)


# --- the network -----------------------------------------------------------------------


def encoded(rows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of (before, value, behind) texts one after another, and their lengths.

    A symbol tells a character and the part that it is in.
    """
    flat = "".join(part for row in rows for part in row)
    codes = np.minimum(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32), SYMBOLS - 1).astype(np.int32)
    sizes = np.array([len(part) for row in rows for part in row], np.int64)
    return codes + np.repeat(np.tile(np.arange(3, dtype=np.int32) * SYMBOLS, len(rows)), sizes), sizes.reshape(-1, 3).sum(axis=1)


def pieces(lengths: np.ndarray, size: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Groups of (row, first, last of window starts, last of symbols), of about ``size`` symbols.

    A long row becomes several pieces, each reading on into the next as far as a filter does.
    """
    group, held, at = [], 0, 0
    for row, length in enumerate(lengths.tolist()):
        for first in range(at, at + length, size):
            last = min(first + size, at + length)
            group.append((row, first, last, min(last + GAP, at + length)))
            held += last - first
            if held >= size:
                yield group
                group, held = [], 0
        at += length
    if group:
        yield group


@dataclass
class Net:
    """Embeddings of symbols (the last row, for places behind a finding, is zero), filters, output."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[int, float] = field(default_factory=dict)

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """Response of every filter to the window that begins at each symbol."""
        padded = np.concatenate([ids, np.full(GAP, PAD, np.int32)])
        parts = []
        for width, bank, bias in zip(WIDTHS, self.filters, self.biases):
            z = np.broadcast_to(bias, (len(ids), FILTERS)).copy()
            for j in range(width):
                z += (self.table @ bank[j])[padded[j : j + len(ids)]]
            parts.append(z)
        return np.concatenate(parts, axis=1)

    def pooled(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Largest response of each filter over each whole finding; that to nothing if empty."""
        best = np.broadcast_to(np.concatenate(self.biases), (len(lengths), len(self.out))).astype(np.float32).copy()
        fresh = np.ones(len(lengths), bool)
        gap = np.full(GAP, PAD, np.int32)
        for group in pieces(lengths, BLOCK_CHARS):
            ids = np.concatenate([x for _, first, _, end in group for x in (symbols[first:end], gap)])
            z = self.responses(ids)
            at = 0
            for row, first, last, end in group:
                top = z[at : at + last - first].max(axis=0)
                best[row] = top if fresh[row] else np.maximum(best[row], top)
                fresh[row] = False
                at += end - first + GAP
        return best

    def logits(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        """The sum of each row is its own, so that it does not depend on the rows beside it."""
        return (np.maximum(self.pooled(*encoded(rows)), 0).astype(np.float64) * self.out).sum(axis=1) + self.offset if rows else np.zeros(0)

    def scores(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        """Calibrated chance of each finding to be a secret."""
        return _sigmoid(self.scale[0] * self.logits(rows) + self.scale[1])

    def threshold(self, kind: int) -> float:
        return self.thresholds.get(kind, self.thresholds[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fresh(rate: float, rng: np.random.Generator) -> Net:
    table = rng.normal(0, 0.3, (PAD + 1, DIM)).astype(np.float32)
    table[PAD] = 0
    return Net(
        table,
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        float(np.log(rate / (1 - rate))),
    )


def learned(rows: list[tuple[str, str, str]], labels: np.ndarray, seed: int = SEED) -> Net:
    """A network fitted to the rows, each with and without its surroundings."""
    share = _share(float(np.mean(labels)))
    net, squares = _fresh(share, np.random.default_rng(seed)), {}
    for epoch in range(EPOCHS):
        one_pass(net, squares, rows, labels, share, epoch, seed)
    return net


def _share(share: float) -> float:
    return float(np.clip(share, 0.01, 0.99))


def one_pass(net: Net, squares: dict, rows: list[tuple[str, str, str]], labels: np.ndarray, share: float, epoch: int, seed: int = SEED) -> None:
    """One pass over the rows, each with and without its surroundings, in the order of the pass.

    ``share`` is the share of secrets in all findings, not only in these.
    """
    rng = np.random.default_rng(seed)
    _fresh(share, rng)
    rows = rows + [("", value, "") for _, value, _ in rows]
    labels = np.concatenate([labels, labels]).astype(np.float32)
    symbols, lengths = encoded(rows)
    ends = np.cumsum(lengths)
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    order = np.arange(len(rows))
    for _ in range(epoch + 1):
        rng.shuffle(order)
    for at in range(0, len(order), BATCH):
        chosen = order[at : at + BATCH]
        _step(net, [symbols[ends[i] - lengths[i] : ends[i]] for i in chosen], labels[chosen], weight[chosen], squares, RATE / (1 + epoch))


def _winners(net: Net, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter to each text, and the place of the first window with it.

    ``ids`` are read in blocks, so only one block's responses are held.
    """
    wins = np.zeros((len(starts), len(net.out)), np.int64)
    best = np.full(wins.shape, -np.inf, np.float32)
    each = np.arange(len(net.out))
    for at in range(0, len(ids), BLOCK_CHARS):
        z = net.responses(ids[at : at + BLOCK_CHARS + GAP])[:BLOCK_CHARS]
        for row in range(int(np.searchsorted(ends, at, "right")), int(np.searchsorted(starts, at + len(z), "left"))):
            first = max(int(starts[row]) - at, 0)
            part = z[first : int(ends[row]) - at]
            place = part.argmax(axis=0)
            top = part[place, each]
            better = top > best[row]
            best[row, better], wins[row, better] = top[better], at + first + place[better]
    return best, wins


def _step(net: Net, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, squares: dict, rate: float) -> None:
    """One step of gradient descent (Adagrad); the gradient runs through the windows that won."""
    gap = np.full(GAP, PAD, np.int32)
    ids = np.concatenate([x for t in texts for x in (t, gap)])
    starts = np.cumsum([0, *[len(t) + GAP for t in texts]])[:-1]
    response, wins = _winners(net, ids, starts, starts + [max(len(t), 1) for t in texts])
    hidden = np.maximum(response, 0)
    error = ((_sigmoid(hidden @ net.out + net.offset) - labels) * weight / len(labels)).astype(np.float32)
    back = error[:, None] * net.out * (response > 0)
    padded = np.concatenate([ids, gap])
    rows, grads, banks = [], [], []
    for n, (width, bank) in enumerate(zip(WIDTHS, net.filters)):
        part = back[:, n * FILTERS : (n + 1) * FILTERS]
        grad = np.zeros_like(bank)
        for j in range(width):
            seen = padded[wins[:, n * FILTERS : (n + 1) * FILTERS] + j]
            grad[j] = np.einsum("df,dfe->ef", part, net.table[seen])
            rows.append(seen.ravel())
            grads.append((part[:, :, None] * bank[j].T[None]).reshape(-1, DIM))
        banks.append((grad + DECAY * bank, part.sum(axis=0)))
    out = hidden.T @ error + DECAY * net.out
    sums = np.zeros_like(net.table)
    np.add.at(sums, np.concatenate(rows), np.concatenate(grads))
    sums[PAD] = 0
    for n, (grad, bias) in enumerate(banks):
        _adagrad(squares, ("filter", n), net.filters[n], grad, rate)
        _adagrad(squares, ("bias", n), net.biases[n], bias, rate)
    _adagrad(squares, "out", net.out, out, rate)
    _adagrad(squares, "table", net.table, sums, rate)
    net.offset -= rate * float(error.sum())


def _weights(net: Net) -> dict:
    """The arrays that Adagrad moves, by its names for them."""
    parts = {("filter", n): v for n, v in enumerate(net.filters)} | {("bias", n): v for n, v in enumerate(net.biases)}
    return parts | {"out": net.out, "table": net.table}


def _adagrad(squares: dict, name, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
    square = squares.setdefault(name, np.full(value.shape, FIRST_SQUARE, np.float32))
    square += grad**2
    value -= rate * grad / np.sqrt(square)


def recall_threshold(positives: np.ndarray, recall: float) -> float:
    """The largest threshold that at least a share ``recall`` of the scores reaches."""
    if len(positives) == 0:
        return np.inf
    least = np.sort(positives)[: len(positives) - int(np.ceil(recall * len(positives) - 1e-9)) + 1]
    return float(least[-1])


# --- Spark ---------------------------------------------------------------------------


def fit(found: DataFrame, shard_findings: int = SHARD_FINDINGS) -> Net | None:
    """The network of all distinct ``findings``, labelled by the rules; None with too few.

    Findings of no rule count as harmless unless they look like secrets to a network that has
    not seen them.  Every ``HOLD``-th finding of a shard only calibrates.
    """
    rows = sharded(found, shard_findings)
    if rows is None:
        return None
    held = F.col("position") % HOLD == HOLD - 1
    half = F.floor(F.col("position") / HOLD) % 2
    unknown = F.col("kind") == 3
    n = rows.agg(
        F.count_if(~held & ~unknown).alias("secret"), F.count_if(held & ~unknown).alias("check"),
        *[F.count_if(~held & unknown & (half == s)).alias(f"learn_{s}") for s in (0, 1)],
        *[F.count_if(unknown & (half != s)).alias(f"judge_{s}") for s in (0, 1)],
    ).first()
    sides = [s for s in (0, 1) if n[f"learn_{s}"] and n[f"judge_{s}"]]

    def of_side(side: int) -> Callable:
        return lambda part: ~part.held & (~part.unknown | (part.half == side))

    judges = averaged(rows, {s: (of_side(s), _share(n["secret"] / (n["secret"] + n[f"learn_{s}"]))) for s in sides})
    limits = _limits(rows, judges)

    def doubtful(part: Part) -> np.ndarray:
        out = np.zeros(len(part.rows), bool)
        for side, net in judges.items():
            asked = np.flatnonzero(part.unknown & (part.half != side))
            out[asked] = net.logits([("", part.rows[i][1], "") for i in asked]) >= limits[side]
        return out

    harmless = n["learn_0"] + n["learn_1"] - _total(rows, lambda part: int((doubtful(part) & ~part.held).sum()))
    if not harmless or not n["check"]:
        return None
    share = _share(n["secret"] / (n["secret"] + harmless))
    net = averaged(rows, {0: (lambda part: ~part.held & ~doubtful(part), share)})[0]

    def checked(part: Part) -> Iterator[pa.RecordBatch]:
        # Thresholds hold for values seen with and without their surroundings.
        at = np.flatnonzero(part.held & ~doubtful(part))
        both = [part.rows[i] for i in at] + [("", part.rows[i][1], "") for i in at]
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(part.kinds[at], 2), pa.int32()), pa.array(net.logits(both), pa.float64())], ["kind", "x"])

    calibrate(net, stored(_each_shard(rows, checked, "kind int, x double"), "checked"))
    return net


def sharded(found: DataFrame, shard_findings: int = SHARD_FINDINGS) -> DataFrame | None:
    """(shard, position, kind, before, value, behind): all distinct findings, those of a shard in
    one task and in order; None with too few of either label."""
    each = stored(
        found.select(F.explode("found").alias("f"))
        .select("f.kind", "f.before", "f.value", "f.behind")
        .distinct()
        .withColumn("place", F.xxhash64("kind", "before", "value", "behind")),
        "distinct",
    )
    n = each.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("kind") < 3).alias("secret"),
        F.sum(F.length("before") + F.length("value") + F.length("behind")).alias("chars"),
    ).first()
    if min(n["secret"], n["all"] - n["secret"]) < MIN_FINDINGS:
        return None
    count = max(-(-n["all"] // shard_findings), -(-n["chars"] // SHARD_CHARS))
    files = min(count, 8 * each.sparkSession.sparkContext.defaultParallelism)
    row = F.struct("place", "before", "value", "behind", "kind")
    # A shard is one row, which no reader splits.
    shards = each.groupBy(F.pmod("place", F.lit(count)).alias("shard")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kept = stored(shards.repartitionById(files, F.pmod("shard", F.lit(files)).cast("int")), "shards")
    return kept.select("shard", F.posexplode("rows").alias("position", "r")).select("shard", "position", "r.kind", "r.before", "r.value", "r.behind")


class Part:
    """The findings of a shard, and the part that each plays in training."""

    def __init__(self, kinds: list[int], rows: list[tuple[str, str, str]]):
        at = np.arange(len(rows))
        self.kinds, self.rows = np.array(kinds), rows
        self.held, self.half = at % HOLD == HOLD - 1, at // HOLD % 2
        self.unknown = self.kinds == 3


def _each_shard(rows: DataFrame, work: Callable[[Part], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` returns for each shard of ``sharded`` findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds, held = None, [], []
        for batch in batches:
            shards = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                if held and shards[first] != now:
                    yield from work(Part(kinds, held))
                    kinds, held = [], []
                now, part = shards[first], batch.slice(first, last - first)
                kinds += part.column("kind").to_pylist()
                held += zip(*[part.column(c).to_pylist() for c in ("before", "value", "behind")])
        if held:
            yield from work(Part(kinds, held))

    return rows.mapInArrow(run, schema)


def _total(rows: DataFrame, count: Callable[[Part], int]) -> int:
    def work(part: Part) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([count(part)], pa.int64())], ["n"])

    return _each_shard(rows, work, "n long").agg(F.sum("n")).first()[0] or 0


def averaged(rows: DataFrame, wanted: dict[int, tuple[Callable[[Part], np.ndarray], float]]) -> dict[int, Net]:
    """Networks, each fitted to the findings that its function chooses, of which a share are secrets.

    In a pass every shard goes on from the same weights; the next pass begins with the mean of
    what the shards return, weighted by their findings.  With one shard this is ``learned``.
    """
    state = {}
    for name, (_, share) in wanted.items():
        net = _fresh(share, np.random.default_rng(SEED))
        state[name] = net, {k: np.full(v.shape, FIRST_SQUARE, np.float32) for k, v in _weights(net).items()}
    for epoch in range(EPOCHS if wanted else 0):

        def work(part: Part) -> Iterator[pa.RecordBatch]:
            for name, (choose, share) in wanted.items():
                chosen = np.flatnonzero(choose(part))
                if len(chosen):
                    net, squares = copy.deepcopy(state[name])
                    one_pass(net, squares, [part.rows[i] for i in chosen], ~part.unknown[chosen], share, epoch)
                    x = np.concatenate([*[v.ravel() for v in (*_weights(net).values(), *squares.values())], [net.offset, 1.0]]).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), name, np.int32)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x * len(chosen))], ["net", "place", "x"])

        sums = _each_shard(rows, work, "net int, place int, x double").groupBy("net", "place").agg(F.sum(_exact(F.col("x"))).cast("double").alias("x"))
        found = sums.toPandas().sort_values(["net", "place"])  # as many rows as weights
        for name in wanted:
            x = found.loc[found["net"] == name, "x"].to_numpy()
            x, (net, squares), at = x / x[-1], state[name], 0
            for v in (*_weights(net).values(), *squares.values()):
                v[...] = x[at : at + v.size].reshape(v.shape)
                at += v.size
            net.offset = float(x[at])
    return {name: net for name, (net, _) in state.items()}


def _exact(x: Column) -> Column:
    """As a decimal, whose sum does not depend on the order."""
    return x.cast("decimal(38,12)")


def _limits(rows: DataFrame, judges: dict[int, Net]) -> dict[int, float]:
    """Per judge the largest threshold of enough recall over the held secrets without surroundings."""

    def work(part: Part) -> Iterator[pa.RecordBatch]:
        bare = [("", part.rows[i][1], "") for i in np.flatnonzero(part.held & ~part.unknown)]
        for side, net in judges.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bare), side, np.int32)), pa.array(net.logits(bare), pa.float64())], ["key", "x"])

    if not judges:
        return {}
    found = at_ranks(_each_shard(rows, work, "key int, x double"), _recall_rank(RECALL), _recall_rank(RECALL))
    return {side: found[side][1] if side in found else np.inf for side in judges}


def _recall_rank(recall: float) -> Column:
    """The rank, from 0, of ``recall_threshold`` among all scores of a key."""
    return F.col("all") - F.ceil(F.lit(recall) * F.col("all") - 1e-9)


def at_ranks(scores: DataFrame, low: Column, high: Column) -> dict[int, tuple[int, float, float]]:
    """Per key of (key, x) the number of rows, and the values at two ranks, counted from 0; the
    ranks are columns of ``key`` and the number ``all``."""
    counted = stored(scores.groupBy("key", "x").agg(F.count(F.lit(1)).alias("n")), "counted")
    ranked = running(counted, ["key"], ["x"], {"upto": F.col("n")}, {"all": "upto"})
    picked = ranked.groupBy("key").agg(F.max("all").alias("all"), *[F.min(F.when(F.col("upto") > rank, F.col("x"))).alias(name) for name, rank in (("low", low), ("high", high))])
    return {r["key"]: (r["all"], r["low"], r["high"]) for r in picked.collect()}


def calibrate(net: Net, checked: DataFrame, recall: float = RECALL) -> None:
    """Set the scale of the scores and, per kind, the largest threshold of enough recall, from the
    stored (kind, x) of findings and their logits."""
    positive = F.col("kind") < 3
    n = checked.agg(F.count_if(positive).alias("secret"), F.count_if(~positive).alias("harmless")).first()
    smooth = F.when(positive, (n["secret"] + 1) / (n["secret"] + 2)).otherwise(1 / (n["harmless"] + 2))
    a, b = 1.0, 0.0
    for _ in range(NEWTON):
        z = F.least(F.greatest(F.lit(float(a)) * F.col("x") + F.lit(float(b)), F.lit(-30.0)), F.lit(30.0))
        terms = checked.select("x", (1 / (1 + F.exp(-z))).alias("p"), smooth.alias("y")).select("x", (F.col("p") - F.col("y")).alias("g"), (F.col("p") * (1 - F.col("p")) + 1e-6).alias("w"))
        x, g, w = F.col("x"), F.col("g"), F.col("w")
        t = [float(v) for v in terms.agg(*[F.sum(_exact(e)) for e in (g * x, g, w * x * x, w * x, w)]).first()]
        step = np.linalg.solve(np.array([[t[2], t[3]], [t[3], t[4]]]) + 1e-6 * np.eye(2), np.array(t[:2]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    net.scale = (max(float(a), 1e-3), float(b))
    # The bulk of the harmless findings lies below a rank of its own, between two findings.
    every, bulk = -1, -2
    keys = F.when(positive, F.array(F.lit(every), F.col("kind"))).otherwise(F.array(F.lit(bulk)))
    rank, is_bulk = (F.col("all") - 1) * F.lit(recall), F.col("key") == bulk
    low = F.when(is_bulk, F.floor(rank)).otherwise(_recall_rank(recall))
    found = at_ranks(checked.select(F.explode(keys).alias("key"), "x"), low, F.when(is_bulk, F.ceil(rank)).otherwise(low))
    score = lambda x: float(_sigmoid(net.scale[0] * x + net.scale[1]))
    most = 0.0
    if bulk in found:
        many, below, above = found[bulk]
        most = score(below) + (score(above) - score(below)) * ((many - 1) * recall % 1)
    limits = {key: score(x) for key, (many, x, _) in found.items() if key == every or key >= 0 and many >= MIN_FINDINGS}
    net.thresholds = {-1: np.inf, **{key: lowered(limit, most) for key, limit in limits.items()}}


def lowered(threshold: float, bulk: float) -> float:
    """Half way down to the score that a share of the harmless findings does not exceed, if that
    is below; recall can only grow.  (Their largest score may be that of an unlabelled secret.)"""
    return (threshold + bulk) / 2 if bulk < threshold else threshold


SCORED = "struct<kind:string,start:long,stop:long,value:string,score:double,kept:boolean>"


def judged(found: DataFrame, net: Net | None) -> DataFrame:
    """(doc_id, spans) per row: every candidate with its score and whether it is kept."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            flat = [f for row in lists for f in row]
            scores = net.scores([(f["before"], f["value"], f["behind"]) for f in flat]) if net else [float(f["kind"] < 3) for f in flat]
            out, at = [], 0
            for row in lists:
                out.append([
                    {"kind": KINDS[f["kind"]], "start": f["start"], "stop": f["stop"], "value": f["value"], "score": float(s),
                     "kept": f["kind"] < 3 or (net is not None and s >= net.threshold(f["kind"]))}
                    for f, s in zip(row, scores[at : at + len(row)])
                ])
                at += len(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_SCORED))], ["doc_id", "spans"])

    return found.mapInArrow(run, f"doc_id {kind}, spans array<{SCORED}>")


_SCORED = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()), ("score", pa.float64()), ("kept", pa.bool_())]
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of each row of ``docs``, with a network trained on its own findings."""
    found = stored(findings(docs, id_col, text_col), "findings")
    return judged(found, fit(found))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the rules' spans, a digest of them, and all kept spans as text."""
    spans = scan(docs, id_col, text_col)
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base, kept = (_said(F.filter("spans", test)) for test in (lambda s: s["kind"] != KINDS[3], lambda s: s["kept"]))
    return spans.select(F.col("doc_id").alias(id_col), *counts, F.sha2(base, 256).alias("base_sha256"), kept.alias("spans"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
