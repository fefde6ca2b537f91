"""Token sequences in training order, as binary shards with a fixed stride.

Documents are tokenised in scan order into one stream per task and cut into sequences of
``SIZE`` ids.  Sequences are numbered without gaps, and a keyed Feistel permutation of the
numbers (walking on while the image lies beyond the last number) gives every sequence its
slot in the training order.  Nothing but the key and the count decides the order, so it can
be computed for any number on any machine, forwards and backwards.

Slots are range-partitioned in consecutive ranges of ``PER_SHARD``; a task writes each of its
ranges as one file of records of equal length: the number of ids, then the ids, padded.  Record
``s`` lies at byte ``(s mod PER_SHARD) * stride`` of shard ``s div PER_SHARD``, so a reader that
stopped at a slot goes on there with one seek and then reads on.

A folder holds one order for good: what it was made from (``order.json``: key, sizes, tokenizer
and an order-free digest of the documents), the numbered sequences, and the shards.  A run on
a folder made from anything else raises.  A run that was broken off is taken up where it
stopped: the sequences are kept once they are complete, so their numbers stay whatever the
next scan's tasks are, and a shard has its name only from the moment it is complete, so each
one that has been finished stays, also if the job that wrote it failed later.

Ids are written to the folder once and shuffled once, compressed per sequence.  Defined cases: a null or
empty text gives the end token alone.  Repeated rows and null ids are written like others.
An empty table gives no shard and no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewheel.llm.encoders import file_digest, word_encoder
from tidewheel.llm.files import Sink, open_input
from tidewheel.llm.tables import fresh_path, partitions, stored, text_or_empty
from tidewheel.llm.words import blocks, mix
from tidewheel.sources import files

SIZE = 2048
END = 2
PER_SHARD = 2048
ROUNDS = 6
KEY = 20_240_601
HEAD = 4
LEVEL = 3

SEQUENCES = (
    "part int, nth long, n_tokens int, width int, ids_crc32 long, "
    "doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, ids binary"
)
WRITTEN = "shard long, path string, records long"
READ = "slot long, shard long, byte_offset long, n_tokens int, read_crc32 long"


# --- the permutation -----------------------------------------------------------------


def _round(half: np.ndarray, key: int, turn: int, bits: int) -> np.ndarray:
    salt = mix(np.array([key * 1_000_003 + turn], np.uint64))[0]
    return mix(half + salt) & np.uint64((1 << bits) - 1)


def _once(x: np.ndarray, left_bits: int, right_bits: int, key: int, back: bool) -> np.ndarray:
    """Alternating Feistel rounds on left and right parts of the number."""
    right_mask = np.uint64((1 << right_bits) - 1)
    left, right = x >> np.uint64(right_bits), x & right_mask
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if turn % 2 == 0:
            left = left ^ _round(right, key, turn, left_bits)
        else:
            right = right ^ _round(left, key, turn, right_bits)
    return (left << np.uint64(right_bits)) | right


def permuted(numbers: np.ndarray, count: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slot of each number in ``range(count)``; with ``back`` the number of each slot."""
    x = np.asarray(numbers).astype(np.uint64)
    if count <= 1:
        return x.astype(np.int64)
    bits = max(2, (count - 1).bit_length())
    left_bits = bits // 2
    x = _once(x, left_bits, bits - left_bits, key, back)
    while (beyond := x >= np.uint64(count)).any():
        x[beyond] = _once(x[beyond], left_bits, bits - left_bits, key, back)
    return x.astype(np.int64)


def squeezed(ids: bytes) -> bytes:
    """A sequence's ids as they travel; Spark's own codec for shuffles gains little on them."""
    return pa.Codec("zstd", LEVEL).compress(ids, asbytes=True)


def restored(data: bytes, n_tokens: int, width: int) -> bytes:
    return pa.Codec("zstd").decompress(data, n_tokens * width, asbytes=True)


# --- sequences -----------------------------------------------------------------------


def sequences(docs: DataFrame, tokenizer_path: str, folder: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of ``size`` ids per task (the last one shorter) with their places in the
    documents, kept in ``folder``; those of a complete earlier run are taken as they are."""
    spark, kept = docs.sparkSession, f"{folder}/sequences"
    if files.exists(spark, f"{kept}/_SUCCESS"):
        return spark.read.schema(SEQUENCES).parquet(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        width = encoder.dtype.itemsize
        end = np.array([END], encoder.dtype).tobytes()
        held, spans, nth = [], [], 0
        free = size

        def closed() -> tuple:
            ids = b"".join(held)
            crc = zlib.crc32(np.frombuffer(ids, encoder.dtype).astype("<u4").tobytes())
            return (part, nth, len(ids) // width, width, crc, *map(list, zip(*spans)), squeezed(ids))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            names = ["part", "nth", "n_tokens", "width", "ids_crc32", "doc_ids", "starts", "lengths", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for a, b in blocks(batch.column(1)):
                rows = batch.slice(a, b - a)
                out = []
                for doc, raw in zip(rows.column(0).to_pylist(), encoder.ids(rows.column(1).to_pylist())):
                    raw += end
                    total, at = len(raw) // width, 0
                    while at < total:
                        take = min(free, total - at)
                        held.append(raw[at * width : (at + take) * width])
                        spans.append((doc, at, take))
                        at, free = at + take, free - take
                        if free == 0:
                            out.append(closed())
                            held, spans, nth, free = [], [], nth + 1, size
                if out:
                    yield batch_of(out)
        if held:
            yield batch_of([closed()])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows.mapInArrow(run, SEQUENCES).write.mode("overwrite").option("compression", "zstd").parquet(kept)
    return spark.read.schema(SEQUENCES).parquet(kept)


def slotted(rows: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """Add ``slot`` to stored sequences; also the number of sequences.

    Numbers are a task's first number plus the place in the task; the table of first numbers
    has one row per task of the tokenising scan.
    """
    parts = stored(rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "parts")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = stored(parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")), "firsts")
    count = parts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    @F.pandas_udf("long")
    def slot(number):
        import pandas as pd

        return pd.Series(permuted(number.to_numpy(), count, key))

    return rows.join(firsts, "part").withColumn("slot", slot(F.col("first") + F.col("nth"))).drop("first"), count


# --- shards --------------------------------------------------------------------------


def stride(size: int, width: int) -> int:
    return HEAD + size * width


def written_shards(spark, folder: str, size: int, width: int, per_shard: int = PER_SHARD) -> DataFrame:
    """(shard, path, records) of the complete shards of a folder, from its listing."""
    if not files.exists(spark, f"{folder}/shards"):
        return spark.createDataFrame([], WRITTEN)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(f"{folder}/shards")
    number = F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long")
    return found.select(number.alias("shard"), "path", (F.col("length") / stride(size, width)).cast("long").alias("records"))


def write_shards(rows: DataFrame, folder: str, count: int, width: int, size: int = SIZE, per_shard: int = PER_SHARD,
                 tasks: int | None = None) -> DataFrame:
    """Write those of the ``count`` slotted sequences whose shard is not there yet; all shards."""
    spark = rows.sparkSession
    if count == 0:
        return spark.createDataFrame([], WRITTEN)
    whole = -(-count // per_shard)
    done = stored(written_shards(spark, folder, size, width, per_shard).select(F.col("shard").alias("done")), "done")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, shard, records = None, None, 0

        def finished() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "records": pa.array([records], pa.int64())})

        for batch in batches:
            for to, n, ids in zip(*(batch.column(c) for c in range(3))):
                if to.as_py() != shard:
                    if sink is not None:
                        yield finished()
                    shard, records = to.as_py(), 0
                    sink = Sink(f"{folder}/shards/shard-{shard:09d}.bin")
                record = n.as_py().to_bytes(HEAD, "little") + restored(ids.as_py(), n.as_py(), width)
                sink.write(record.ljust(stride(size, width), b"\0"))
                records += 1
        if sink is not None:
            yield finished()

    shard = F.floor(F.col("slot") / per_shard).cast("long")
    dealt = (
        rows.select(shard.alias("shard"), "slot", "n_tokens", "ids")
        .join(done, F.col("shard") == F.col("done"), "left_anti")
        .repartitionByRange(min(tasks or partitions(rows), whole), "shard")
        .sortWithinPartitions("shard", "slot")
        .select("shard", "n_tokens", "ids")
    )
    stored(dealt.mapInArrow(run, "shard long, records long"), "made")
    return stored(written_shards(spark, folder, size, width, per_shard), "written")


def read_from(path: str, first: int, size: int, width: int) -> Iterator[np.ndarray]:
    """The records of one shard from its ``first`` on, one after another."""
    with open_input(path) as source:
        source.seek(first * stride(size, width))
        while record := source.read(stride(size, width)):
            n = int.from_bytes(record[:HEAD], "little")
            yield np.frombuffer(record, f"<u{width}", n, HEAD)


def read_shards(shards: DataFrame, width: int, size: int = SIZE, per_shard: int = PER_SHARD) -> DataFrame:
    """One row per record of the shards, read back in order, with the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for place, ids in enumerate(read_from(path, 0, size, width)):
                    out.append((shard * per_shard + place, shard, place * stride(size, width), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["slot", "shard", "byte_offset", "n_tokens", "read_crc32"]
                )

    # A shard is a short row that stands for a large file, so the number of tasks is given.
    return shards.select("shard", "path").repartition(partitions(shards), "shard").mapInArrow(run, READ)


def order_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Number and order-free digest of the documents, by id and text."""
    row = [F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col), F.lit(salt)).cast("decimal(38,0)") for salt in (1, 2)]
    found = docs.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(r), F.lit(0)).cast("string").alias(f"s{i}") for i, r in enumerate(row)]).first()
    return {"documents": found["n"], "digest": f"{found['s0']}:{found['s1']}"}


def claimed(spark, folder: str, order: Mapping) -> None:
    """Make the folder one of this order, or check that it is; raises if it holds another."""
    path = f"{folder}/order.json"
    found = files.read_json(spark, path, None)
    if found is None:
        files.write_json(spark, path, dict(order))
    elif found != dict(order):
        differ = sorted(k for k in {*found, *order} if found.get(k) != order.get(k))
        raise ValueError(f"{folder} holds an order made from other {', '.join(differ)}; use a new folder")


def training_order(docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: int = KEY,
                   size: int = SIZE, per_shard: int = PER_SHARD) -> DataFrame:
    """Write all documents as shards in training order and read them back.

    One row per sequence: slot, shard, byte_offset, n_tokens, ids_crc32 (of the ids read back,
    as little-endian unsigned 32-bit integers), intact (equal to the sum taken before the
    shuffle), and the documents it consists of with their first id and number of ids.
    """
    spark = docs.sparkSession
    if folder is None:
        folder = fresh_path(spark, "shards")
    else:
        order = {"key": key, "size": size, "per_shard": per_shard, "tokenizer": file_digest(tokenizer_path)}
        claimed(spark, folder, {**order, **order_digest(docs)})
    width = word_encoder(tokenizer_path).dtype.itemsize
    rows, count = slotted(sequences(docs, tokenizer_path, folder, size), key)
    shards = write_shards(rows, folder, count, width, size, per_shard)
    read = stored(read_shards(shards, width, size, per_shard), "read")
    return (
        rows.select("slot", F.col("ids_crc32").alias("wrote_crc32"), "doc_ids", "starts", "lengths")
        .join(read, "slot")
        .select("slot", "shard", "byte_offset", "n_tokens", F.col("read_crc32").alias("ids_crc32"),
                (F.col("wrote_crc32") == F.col("read_crc32")).alias("intact"), "doc_ids", "starts", "lengths")
    )
