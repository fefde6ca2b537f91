"""A convolutional text classifier in numpy, for toxicity.

Words enter by hashed embeddings, one for the word and one for its first bytes, so that
unseen endings of a known stem count.  Filters of several widths slide over the text, each
keeps its largest response over the whole text, and a logistic unit weighs them.  Training
is plain gradient descent (Adagrad) on a bounded sample of labelled rows; scoring streams
over all rows with the trained arrays, whose size is bounded by the sample.

The score depends on the text alone.  ``thresholds`` are calibrated by language on a part
of the training rows that the weights never saw; a language with few such rows shares the
threshold of all.

Defined cases: a null or empty text has the score of a text without words.  Rows whose
label, id or text is null do not train.  Equal texts get equal scores.  Without any
training row of both classes every score is the base rate (0 without rows).  An empty table
gives an empty result; other columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tidewheel.llm.tables import free_name
from tidewheel.llm.words import blocks, words_in

BUCKETS = 1 << 22
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIX = 5
TRAIN_ROWS = 8_000
TRAIN_BYTES = 48 << 20
MIN_DOCS = 3
MIN_SCORE = 2.0
EPOCHS = 4
BATCH = 32
TRAIN_BLOCK = 1 << 18
RATE = 0.08
DECAY = 1e-4
HOLD = 5
MIN_CALIBRATION = 60


def buckets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and prefix buckets of a batch of texts, and the number of words per text."""
    words = words_in(column, prefix=PREFIX)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (
        (words.hashes >> shift).astype(np.int32),
        (words.prefixes >> shift).astype(np.int32) + np.int32(BUCKETS),
        words.counts,
    )


@dataclass
class Net:
    """Embeddings (row 0 is for unknown words and stays zero), filters and output weights."""

    keys: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    offset: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    base: float | None = None

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        if len(self.keys) == 0:
            return np.zeros(len(buckets), np.int32)
        if not hasattr(self, "_index"):
            self._index = np.zeros(2 * BUCKETS, np.int32)
            self._index[self.keys] = np.arange(1, len(self.keys) + 1)
        return self._index[buckets]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_index"}

    def pooled(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, places: bool = False):
        """Largest response per text and filter.  Behind a text stand empty places.

        Windows without a known word all respond with the bias, so only the others are
        computed.  With ``places`` also returns the window behind each maximum, -1 for bias.
        """
        known = np.flatnonzero((first > 0) | (second > 0))
        ends = np.cumsum(counts)
        owner = np.searchsorted(ends, known, "right")
        best, wins = [], []
        for width, bank, bias in zip(WIDTHS, self.filters, self.biases):
            start = (known[:, None] - np.arange(width)).ravel()
            text = np.repeat(owner, width)
            inside = start >= (ends - counts)[text]
            start, at = np.unique(start[inside], return_index=True)
            text = text[inside][at]
            z = np.broadcast_to(bias, (len(start), FILTERS)).copy()
            for j in range(width):
                z += self._inputs(first, second, start + j, ends[text]) @ bank[j]
            top = np.broadcast_to(bias, (len(counts), FILTERS)).copy()
            if len(start):
                bounds = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                largest = np.maximum.reduceat(z, bounds, axis=0)
                top[text[bounds]] = np.maximum(top[text[bounds]], largest)
            if places:
                win = np.full((len(counts), FILTERS), -1)
                for lo, hi in zip(bounds, np.r_[bounds[1:], len(start)]) if len(start) else ():
                    peak = z[lo:hi].argmax(axis=0)
                    win[text[lo]] = np.where(z[lo:hi].max(axis=0) > bias, start[lo + peak], -1)
                wins.append(win)
            best.append(top)
        response = np.concatenate(best, axis=1)
        return (np.maximum(response, 0), response, wins) if places else np.maximum(response, 0)

    def _inputs(self, first: np.ndarray, second: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Input vectors at places ``at``; zero from the text's end on."""
        inside = at < end
        at = np.where(inside, at, 0)
        return (self.table[first[at]] + self.table[second[at]]) * inside[..., None]

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.base is not None:
            return np.full(len(column), self.base)
        out = np.zeros(len(column))
        for start, stop in blocks(column):
            a, b, counts = buckets_of(column.slice(start, stop - start))
            out[start:stop] = _sigmoid(self.pooled(self.rows(a), self.rows(b), counts) @ self.out + self.offset)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str] | pa.Array, labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Net:
    """Fit the net; every ``HOLD``-th row only calibrates the thresholds."""
    labels = np.asarray(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        return Net(np.zeros(0, np.int32), np.zeros((1, DIM)), [], [], np.zeros(0), 0.0, base=float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    held = rng.permutation(len(labels)) % HOLD == HOLD - 1
    keys, odds = _vocabulary(column, labels, ~held)
    net = _fresh(keys, odds, labels[~held].mean(), rng)
    rows_a, rows_b, counts = _rows_of(net, column)
    ends = np.cumsum(counts)
    spans = list(zip(ends - counts, ends))
    squares: dict = {}
    learn = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            _step(net, learn[at : at + BATCH], rows_a, rows_b, spans, labels, squares, RATE / (1 + epoch))
    check = np.flatnonzero(held)
    if len(check):
        scores = net.scores(column.take(pa.array(check)))
        net.thresholds = calibrated(scores, labels[check], [langs[i] for i in check])
    else:
        net.thresholds = {None: 0.5}
    net.__dict__.pop("_index", None)  # each worker makes its own
    return net


def _rows_of(net: Net, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of all words and prefixes, and the number of words per text."""
    parts = []
    for start, stop in blocks(column, TRAIN_BLOCK):
        a, b, counts = buckets_of(column.slice(start, stop - start))
        parts.append((net.rows(a), net.rows(b), counts))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _vocabulary(column: pa.Array, labels: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets seen in enough training texts whose share of toxic ones stands out, and their
    smoothed log-odds.  All other words have the zero vector."""
    all_seen, all_toxic = np.zeros(2 * BUCKETS, np.int32), np.zeros(2 * BUCKETS, np.int32)
    for start, stop in blocks(column, TRAIN_BLOCK):
        a, b, counts = buckets_of(column.slice(start, stop - start))
        doc = np.repeat(np.arange(start, stop), counts)
        for part in (a, b):
            pair = np.unique(part.astype(np.int64) * len(labels) + doc)
            bucket, of = pair // len(labels), pair % len(labels)
            bucket, of = bucket[used[of]], of[used[of]]
            np.add.at(all_seen, bucket, 1)
            np.add.at(all_toxic, bucket[labels[of] > 0], 1)
    keys = np.flatnonzero(all_seen)
    seen, toxic = all_seen[keys], all_toxic[keys]
    rate = labels[used].mean()
    odds = np.log((toxic + 2 * rate) / (seen - toxic + 2 * (1 - rate))) - np.log(rate / (1 - rate))
    stands_out = np.abs(toxic - rate * seen) / np.sqrt(rate * seen + 1) >= MIN_SCORE
    chosen = (seen >= MIN_DOCS) & stands_out
    return keys[chosen].astype(np.int32), odds[chosen]


def _fresh(keys: np.ndarray, odds: np.ndarray, rate: float, rng: np.random.Generator) -> Net:
    table = np.zeros((len(keys) + 1, DIM), np.float32)
    table[1:] = rng.normal(0, 0.02, (len(keys), DIM))
    table[1:, 0] = odds / 4
    filters, biases = [], []
    for width in WIDTHS:
        bank = rng.normal(0, 0.3, (width, DIM, FILTERS)).astype(np.float32)
        bank[:, 0, :] = np.abs(bank[:, 0, :])
        filters.append(bank)
        biases.append(np.full(FILTERS, -0.1, np.float32))
    out = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
    return Net(keys, table, filters, biases, out, float(np.log(rate / (1 - rate))) - 1.0)


def _step(net, chosen, rows_a, rows_b, spans, labels, squares, rate) -> None:
    counts = np.array([spans[i][1] - spans[i][0] for i in chosen])
    a = np.concatenate([rows_a[spans[i][0] : spans[i][1]] for i in chosen])
    b = np.concatenate([rows_b[spans[i][0] : spans[i][1]] for i in chosen])
    hidden, response, wins = net.pooled(a, b, counts, places=True)
    error = (_sigmoid(hidden @ net.out + net.offset) - labels[chosen]) / len(chosen)
    back = error[:, None] * net.out * (response > 0)
    grad_out = hidden.T @ error + DECAY * net.out
    end = np.cumsum(counts)[:, None]
    touched_rows, touched_grads = [np.zeros(0, np.int64)], [np.zeros((0, DIM), np.float32)]
    for n, (width, bank) in enumerate(zip(WIDTHS, net.filters)):
        part = back[:, n * FILTERS : (n + 1) * FILTERS].astype(np.float32)
        grad = np.zeros_like(bank)
        for j in range(width) if len(a) else ():
            at = np.where(wins[n] >= 0, wins[n] + j, len(a))
            grad[j] = np.einsum("df,dfe->ef", part, net._inputs(a, b, at, end))
            flow = part[:, :, None] * bank[j].T[None]
            inside = at < end
            for rows in (a, b):
                touched_rows.append(rows[at[inside]])
                touched_grads.append(flow[inside])
        _adagrad(squares, ("filter", n), bank, grad + DECAY * bank, rate)
        _adagrad(squares, ("bias", n), net.biases[n], part.sum(axis=0), rate)
    _adagrad(squares, "out", net.out, grad_out.astype(np.float32), rate)
    net.offset -= rate * float(error.sum())
    rows, place = np.unique(np.concatenate(touched_rows), return_inverse=True)
    sums = np.zeros((len(rows), DIM), np.float32)
    np.add.at(sums, place, np.concatenate(touched_grads))
    known = rows > 0
    rows, sums = rows[known], sums[known]
    square = squares.setdefault("table", np.full(net.table.shape, 1e-4, np.float32))
    square[rows] += sums**2
    net.table[rows] -= rate * sums / np.sqrt(square[rows])


def _adagrad(squares: dict, name, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
    square = squares.setdefault(name, np.full(value.shape, 1e-3, np.float32))
    square += grad**2
    value -= rate * grad / np.sqrt(square)


def calibrated(scores: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> dict[str | None, float]:
    """Per language the threshold of the best F1; ``None`` stands for all languages."""
    found = {None: _best_threshold(scores, labels)}
    langs = np.array([x or "" for x in langs])
    for lang in sorted(set(langs) - {""}):
        own = langs == lang
        if own.sum() >= MIN_CALIBRATION and 0 < labels[own].sum() < own.sum():
            found[str(lang)] = _best_threshold(scores[own], labels[own])
    return found


def _best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Half way between the two neighbouring scores where F1 is greatest; 0.5 without positives."""
    if labels.sum() == 0:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(labels) + 1) + labels.sum())
    last = np.append(scores[order][1:] < scores[order][:-1], True)
    best = int(np.argmax(np.where(last, f1, -1)))
    below = scores[order][best + 1] if best + 1 < len(scores) else 0.0
    return float(np.clip((scores[order][best] + below) / 2, 0.05, 0.95))


# --- Spark ---------------------------------------------------------------------------


def held_out(id_col: str = "doc_id"):
    """Rows that never train."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Net:
    """Train on at most ``rows`` labelled documents, drawn by a hash of the id.

    Of rows that share an id the text with the smallest hash trains, once.  The ids, sizes and
    hashes of the drawn documents are collected first; in their order as many train as fit in
    ``max_bytes``.  Only these ids are broadcast, and only their texts reach the driver.
    """
    sample = (
        labels.where(F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
        .withColumn("_turn", F.row_number().over(W.orderBy(F.xxhash64("_id"), "_id")))
    )
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), lang.alias("_lang"))
    texts = texts.where(F.col("_text").isNotNull()).withColumn("_hash", F.xxhash64("_text"))
    one = F.struct("_hash", F.octet_length("_text").cast("long").alias("bytes"))
    drawn = texts.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min(F.struct("_turn", "_label")).alias("t"), F.min(one).alias("o"))
    chosen, held = [], 0
    for r in sorted(drawn.collect(), key=lambda r: r["t"]["_turn"]):
        if held + r["o"]["bytes"] <= max_bytes:
            chosen.append((r["_id"], r["t"]["_label"], r["o"]["_hash"]))
            held += r["o"]["bytes"]
    kind = texts.schema["_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(chosen, f"_id {kind}, _label int, _hash long")
    found = (
        texts.join(F.broadcast(wanted), ["_id", "_hash"])
        .groupBy("_id", "_label", "_hash")
        .agg(F.min(F.struct("_lang", "_text")).alias("_row"))
        .select("_id", "_label", "_row._lang", "_row._text")
        .toArrow()
        .sort_by([("_id", "ascending")])
    )
    return train(found["_text"].combine_chunks(), np.array(found["_label"].to_pylist(), float), found["_lang"].to_pylist())


def scored(docs: DataFrame, net: Net, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``docs`` (or its columns ``keep``) with a score column, replacing one of that name."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(net.scores(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], score], [*kept, name])

    return docs.select(F.col(text_col).cast("string").alias(free_name(docs, "scored_text")), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def clean(docs: DataFrame, net: Net, lang_col: str = "lang") -> DataFrame:
    """The rows below their language's threshold, columns as they were."""
    fallback = F.lit(net.thresholds.get(None, 0.5))
    limit = fallback
    for lang, value in net.thresholds.items():
        if lang is not None and lang_col in docs.columns:
            limit = F.when(F.col(lang_col) == lang, F.lit(value)).otherwise(limit)
    score = free_name(docs, "toxicity")
    return scored(docs, net, name=score).where(F.col(score) < limit).select(*[F.col(f"`{c}`") for c in docs.columns])
