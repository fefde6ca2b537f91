"""Homomorphic multiset hash of a document's paragraphs.

A paragraph is a line that is not empty.  It hashes to a wide vector of two parts:
``EXACT`` lanes of 64 bits from BLAKE2b over its bytes, and ``LIKE`` lanes of 32 bits in
which every run of ``RUN`` words adds +1 or -1 to one lane.  A document's fingerprint is the
sum of its paragraphs' vectors, modulo 2^64 and 2^32.  So it does not depend on their
order, and a paragraph is inserted or deleted by adding or subtracting its vector.

Equal exact lanes mean equal multisets of paragraphs.  The like lanes are a count sketch:
products of two fingerprints estimate how many word runs the documents share, with a
standard error of about 1 / sqrt(LIKE).  A text has fewer than 2^30 words, so none of its
lanes wraps.

Defined cases: a null text counts as empty; a text without paragraphs has the zero vector.
Ids are followed in descending order, nulls last; rows with equal ids follow each other by
a hash of their texts.  A single document is its own successor.  An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewheel.llm.tables import count_not_above, free_name, partitions, text_or_empty
from tidewheel.llm.words import Words, blocks, raw_bytes

EXACT = 8
LIKE = 256
RUN = 3
SLICES_PER_TASK = 4

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Exact lanes (uint64) and like lanes (int32) of several texts."""
    data, offsets = raw_bytes(pa.array(texts, pa.large_string()))
    exact = np.zeros((len(texts), EXACT), np.uint64)
    breaks = np.flatnonzero(data == 10) + 1
    edges = np.unique(np.concatenate([offsets, breaks]))
    if len(edges) < 2:
        return exact, np.zeros((len(texts), LIKE), np.int32)
    owner = np.searchsorted(offsets, edges[:-1], "right") - 1
    raw = data.tobytes()
    hashed, whose = [], []
    for start, stop, text in zip(edges[:-1].tolist(), edges[1:].tolist(), owner.tolist()):
        if raw[stop - 1] == 10:
            stop -= 1
        if stop > start:
            hashed.append(hashlib.blake2b(raw[start:stop], digest_size=8 * EXACT).digest())
            whose.append(text)
    if hashed:
        lanes = np.frombuffer(b"".join(hashed), "<u8").reshape(-1, EXACT)
        whose = np.array(whose)
        first = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
        exact[whose[first]] = np.add.reduceat(lanes, first, axis=0)
    runs, many = Words(data, edges).shingles(RUN)
    lane = np.repeat(owner, many) * LIKE + (runs & np.uint64(LIKE - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((runs >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
    like = np.bincount(lane, sign, len(texts) * LIKE).reshape(len(texts), LIKE)
    return exact, like.astype(np.int64).astype(np.int32)


def encode(exact: np.ndarray, like: np.ndarray) -> str:
    return base64.b64encode(exact.astype("<u8").tobytes() + like.astype("<i4").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * EXACT], "<u8").copy(), np.frombuffer(raw[8 * EXACT :], "<i4").copy()


def fingerprint(paragraphs: Iterable[str]) -> str:
    exact, like = vectors(["\n".join(paragraphs)])
    return encode(exact[0], like[0])


def insert(known: str, paragraph: str) -> str:
    """The fingerprint after a paragraph came in, from the old fingerprint alone."""
    (exact, like), (more, runs) = decode(known), vectors([paragraph])
    return encode(exact + more[0], like + runs[0])


def delete(known: str, paragraph: str) -> str:
    (exact, like), (less, runs) = decode(known), vectors([paragraph])
    return encode(exact - less[0], like - runs[0])


def likeness(exact_a, like_a, exact_b, like_b) -> np.ndarray:
    """0 to 1 per row: twice the estimated shared runs over the runs of both; 1 if equal."""
    a, b = like_a.astype(np.float64), like_b.astype(np.float64)
    both = (a * a).sum(axis=1) + (b * b).sum(axis=1)
    shared = 2 * (a * b).sum(axis=1)
    out = np.divide(shared, both, out=np.zeros(len(a)), where=both > 0)
    return np.where((exact_a == exact_b).all(axis=1), 1.0, np.clip(out, 0.0, 1.0))


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first characters of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


# --- Spark ---------------------------------------------------------------------------


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, slice, ahead) rows, sorted in each task so that every document is followed
    by its successor in descending order of ids.

    Ids are cut at quantiles into slices; the first document of the next slice is dealt to
    a slice too, marked ``ahead``.  Texts are shuffled once, and the driver sees one id per
    slice.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    slices = SLICES_PER_TASK * partitions(docs)
    points = [i / slices for i in range(1, slices)]
    cuts = rows.agg(F.percentile_approx("id", points, 20 * slices).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))
    place = count_not_above(F.from_json(F.lit(json.dumps(cuts)), "array<bigint>"), len(cuts), F.col("id"))
    rows = rows.select("*", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(place).alias("home"))
    tie = F.xxhash64("text")
    firsts = rows.groupBy("home").agg(F.max(F.struct("id", tie.alias("tie"))).alias("first")).collect()
    order = sorted((r["home"] for r in firsts), reverse=True)
    before = {home: order[i - 1] for i, home in enumerate(order)}
    known = {r["home"]: r["first"] for r in firsts}
    heads = json.dumps(
        [{"id": known[h]["id"], "tie": known[h]["tie"], "to": before[h]} if h in known else None for h in range(-1, len(cuts) + 1)]
    )
    head = F.get(F.from_json(F.lit(heads), "array<struct<id: bigint, tie: bigint, to: int>>"), F.col("home") + 1)
    is_head = F.col("id").eqNullSafe(head["id"]) & (tie == head["tie"])
    own = F.struct(F.col("home").alias("slice"), F.lit(False).alias("ahead"))
    copy = F.struct(head["to"].alias("slice"), F.lit(True).alias("ahead"))
    return (
        rows.select("id", "text", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("to"))
        .select("id", "text", "to.slice", "to.ahead")
        .repartition("slice")
        .withColumn("tie", F.xxhash64("text"))
        .sortWithinPartitions("slice", "ahead", F.col("id").desc_nulls_last(), F.col("tie").desc())
        .select("id", "text", "slice", "ahead")
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(id, text, text of the next document), in lists of bounded size."""
    pending = None
    for batch in batches:
        for start, stop in blocks(batch.column(1)):
            part = batch.slice(start, stop - start)
            out = []
            for doc, text, home, ahead in zip(*(part.column(c).to_pylist() for c in range(4))):
                if pending is not None and pending[2] == home:
                    out.append((pending[0], pending[1], text))
                pending = None if ahead else (doc, text, home)
            if out:
                yield out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pairs in _pairs(batches):
        changed = [edited(text, following) for _, text, following in pairs]
        at: dict[int, int] = {}
        distinct: list[str] = []
        for _, text, following in pairs:
            for one in (text, following):
                if at.setdefault(id(one), len(distinct)) == len(distinct):
                    distinct.append(one)
        own = [at[id(text)] for _, text, _ in pairs]
        nxt = [at[id(following)] for _, _, following in pairs]
        exact, like = vectors(distinct)
        new_exact, new_like = vectors(changed)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([p[0] for p in pairs], pa.int64()),
                "n_chars": pa.array([len(p[1]) for p in pairs], pa.int64()),
                "edited_sha256": [hashlib.sha256(c.encode()).hexdigest() for c in changed],
                "fingerprint": [encode(exact[i], like[i]) for i in own],
                "edited_fingerprint": [encode(e, k) for e, k in zip(new_exact, new_like)],
                "near_edited": likeness(exact[own], like[own], new_exact, new_like),
                "near_next": likeness(exact[own], like[own], exact[nxt], like[nxt]),
            }
        )


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint column, replacing one of that name."""
    kept = [c for c in docs.columns if c != name]
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            for start, stop in blocks(batch.column(0)):
                out += [encode(e, k) for e, k in zip(*vectors(batch.column(0).slice(start, stop - start).to_pylist()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], [*kept, name])

    return docs.select(text_or_empty(text_col).alias(free_name(docs, "hashed_text")), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def compared_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the fingerprints of its text and its edited text, and their likeness."""
    return followed(docs, id_col, text_col).mapInArrow(_compare, RESULT)
