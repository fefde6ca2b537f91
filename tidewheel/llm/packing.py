"""Packing along a space-filling curve.

Every document is tokenised and its ids hashed to a vector; a fixed random projection takes
the vector to ``AXES`` dimensions, each cut into ``2 ** BITS`` intervals of about equal
mass, and the cell's place on the Hilbert curve is the document's key.  A range sort by
(key, id) puts similar documents next to each other, and each task packs its stretch of the
curve: sequences are filled to ``SIZE`` ids without gaps, documents are cut where a sequence
ends.  What is left at the end of a stretch is cut into sequences whose lengths are powers
of two, so nothing is padded at all.

Tokens are written to the shared folder once, and shuffled once by the sort.  A third of
all documents under one key is spread over tasks, since the id is part of the sort.

Defined cases: a null text counts as empty and gives the end token alone.  A document
without ids has key 0.  Repeated rows are packed as often as they occur.  Null ids sort
first within a key.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewheel.llm.encoders import word_encoder
from tidewheel.llm.tables import stored, text_or_empty
from tidewheel.llm.words import blocks, mix, seeds

SIZE = 4096
END = 2
HASHED = 256
AXES = 4
BITS = 8

TOKENS = "doc_id long, key long, n long, width int, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# --- the curve -----------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits per axis.

    Works on all rows at once: reflections and exchanges of the axes are undone from the
    highest bit down, a Gray code pass follows, and the axes' bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (np.int64(1) << bit) - 1
        for axis in range(axes):
            on = (x[axis] >> bit) & 1 == 1
            swap = (x[0] ^ x[axis]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if axis:
                x[axis] = np.where(on, x[axis], x[axis] ^ swap)
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (np.int64(1) << bit) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = (key << 1) | ((x[axis] >> bit) & 1)
    return key


def _directions() -> np.ndarray:
    """Fixed projection with independent normal entries, from hashed uniform numbers."""
    u = (seeds(2 * HASHED * AXES, 11).astype(np.float64) / 2.0**64).reshape(2, HASHED, AXES)
    return np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])


_DIRECTIONS = _directions()


def document_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given by their token ids."""
    counts = np.array([len(i) for i in ids])
    if counts.sum() == 0:
        return np.zeros(len(ids), np.int64)
    hashed = mix(np.concatenate(ids).astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(ids)), counts)
    lane = owner * HASHED + (hashed & np.uint64(HASHED - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((hashed >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    vectors = np.bincount(lane, sign, len(ids) * HASHED).reshape(len(ids), HASHED)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    points = vectors / np.where(norms > 0, norms, 1) @ _DIRECTIONS
    mass = 1 / (1 + np.exp(-1.702 * points))
    cells = np.minimum((mass * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return np.where(counts > 0, hilbert_keys(cells, BITS), 0)


# --- packing -------------------------------------------------------------------------


class Packer:
    """Fills sequences of ``size`` ids from documents in order; ``rest`` closes the stretch."""

    def __init__(self, first_sequence: int, size: int = SIZE):
        self.size, self.sequence, self.filled = size, first_sequence, 0
        self.open: list[tuple] = []

    def _take(self, out: list, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            out.append((doc, start, len(ids), crc, total, self.sequence, offset, ids))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        """Pieces of the sequences that this document completes."""
        out: list[tuple] = []
        start = 0
        while start < len(ids):
            part = ids[start : start + self.size - self.filled]
            self.open.append((doc, start, part, len(ids)))
            self.filled += len(part)
            start += len(part)
            if self.filled == self.size:
                self._take(out, self.open)
                self.open, self.filled = [], 0
        return out

    def rest(self) -> list[tuple]:
        """The open sequence, cut into lengths that are powers of two, longest first."""
        out: list[tuple] = []
        left = self.open
        while left:
            room = 1 << (sum(len(p[2]) for p in left).bit_length() - 1)
            now, later = [], []
            for doc, start, ids, total in left:
                here = min(room, len(ids))
                room -= here
                if here:
                    now.append((doc, start, ids[:here], total))
                if here < len(ids):
                    later.append((doc, start + here, ids[here:], total))
            self._take(out, now)
            left = later
        self.open, self.filled = [], 0
        return out


# --- Spark ---------------------------------------------------------------------------


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n, width, ids) per row, stored: ids with the end token, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        end = np.array([END], encoder.dtype).tobytes()
        for batch in batches:
            for start, stop in blocks(batch.column(1)):
                part = batch.slice(start, stop - start)
                raw = encoder.ids(part.column(1).to_pylist())
                ids = [np.frombuffer(r, encoder.dtype) for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(document_keys(ids)),
                        pa.array([len(i) + 1 for i in ids], pa.int64()),
                        pa.array([encoder.dtype.itemsize] * len(ids), pa.int32()),
                        pa.array([r + end for r in raw], pa.binary()),
                    ],
                    ["doc_id", "key", "n", "width", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return stored(rows.mapInArrow(run, TOKENS), "tokens")


def pack(tokens: DataFrame, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of the packed sequences; ``with_ids`` adds each piece's ids as 32-bit integers."""
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*pieces))
        if with_ids:
            columns[7] = [i.astype("<u4").tobytes() for i in columns[7]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 32, size)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out: list[tuple] = []
                part = batch.slice(start, 1000)
                for doc, width, ids in zip(*(part.column(c) for c in range(3))):
                    out += packer.add(doc.as_py(), np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}"))
                if out:
                    yield batch_of(out)
        if out := packer.rest():
            yield batch_of(out)

    order = ["key", "doc_id", F.xxhash64("ids")]
    return (
        tokens.repartitionByRange("key", "doc_id")
        .sortWithinPartitions(*order)
        .select("doc_id", "width", "ids")
        .mapInArrow(run, schema)
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, **columns) -> DataFrame:
    return pack(tokenised(docs, tokenizer_path, **columns), size)
