import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import edge
from tidewheel.llm import encoders, packing, shards

PATH = encoders.default_path("word_bpe_49k.json")


def token_ids(text):
    raw = encoders._library(PATH).encode(text or "", add_special_tokens=False).ids
    return np.array([*raw, 2], "<u4")


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_similar_documents_are_near_on_the_curve():
    rng = np.random.default_rng(0)
    topics = [rng.integers(0, 40_000, 300) for _ in range(40)]
    docs = [np.concatenate([t[:290], rng.integers(0, 40_000, 10)]) for t in topics for _ in range(5)]
    order = np.argsort(packing.document_keys(docs), kind="stable") // 5
    assert (order[1:] == order[:-1]).mean() > 0.3  # at random: 0.02


def test_encoder_equals_library():
    odd = ["", " ", "ΑΣ Σ ΟΔΟΣ", "don't DON'T 'S it's'", "<|endoftext|> a", "a<|startoftext|>b", "x\x1cy\x0bz\tq", "ﬁ Ǆ İ ı",
           "½ ² ٣", "日本語 🙂🙂a", "a​b  c", "A" * 3000 + "1" * 50, "́a b́ é", "ª º µ × ÷ ÿ ß ẞ", "\r\n a\rb", edge.LONG]
    encoder = encoders.word_encoder(PATH)
    assert [np.frombuffer(r, encoder.dtype).tolist() for r in encoder.ids(odd)] == [token_ids(t)[:-1].tolist() for t in odd]


def test_encoder_equals_library_on_awkward_texts(monkeypatch):
    """100 000 random texts, with a cache that overflows again and again."""
    monkeypatch.setattr(encoders, "CACHE_ENTRIES", 500)
    draw = random.Random(1)
    bits = [*"abcXYZ012 \n\t'.,-!éÉßÿÀ×÷ü日🙂ΑΣſKİ ́\r_", "'s", "'ll", "don't", "the ", "naïve ", "<|endoftext|>", "</w>", "Ωhm", "ÄÖÜ"]
    encoder = encoders.WordEncoder(PATH)
    for _ in range(100):
        texts = ["".join(draw.choices(bits, k=draw.randint(0, 14))) for _ in range(1000)]
        found = encoder.library.encode_batch_fast(texts, add_special_tokens=False)
        assert encoder.ids(texts) == [np.array(e.ids, encoder.dtype).tobytes() for e in found]


def check_pieces(rows, texts):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids, at = token_ids(text), 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.SIZE or (at < packing.SIZE and at & (at - 1) == 0)


def test_pack(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_pieces(packing.pack_documents(docs, PATH).collect(), texts)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = packing.pack_documents(edge.clashing(edge_docs), PATH).collect()
    unique = {r[0]: r[1] for r in edge.ROWS if r[0] not in (None, 2)}
    check_pieces([r for r in rows if r.doc_id in unique] and rows, {})
    for doc, text in unique.items():
        own = [r for r in rows if r.doc_id == doc]
        assert sum(r.length for r in own) == len(token_ids(text))
    assert sum(r.length for r in rows if r.doc_id == 2) == 2 * len(token_ids(edge.ROWS[1][1]))
    assert packing.pack_documents(no_docs, PATH).collect() == []


def test_piece_ids(spark, edge_docs):
    tokens = packing.tokenised(edge_docs, PATH)
    for r in packing.pack(tokens, 64, with_ids=True).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


# --- training order ------------------------------------------------------------------


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(count):
    slots = shards.permuted(np.arange(count), count)
    assert sorted(slots) == list(range(count))
    assert (shards.permuted(slots, count, back=True) == np.arange(count)).all()
    if count > 60:
        assert (slots != shards.permuted(np.arange(count), count, key=1)).any()
        assert np.abs(np.corrcoef(slots, np.arange(count))[0, 1]) < 0.3


def test_training_order(spark, edge_docs, no_docs):
    rows = shards.training_order(edge.clashing(edge_docs), PATH).collect()
    assert all(r.intact for r in rows) and sorted(r.slot for r in rows) == list(range(len(rows)))
    spans = defaultdict(list)
    for r in rows:
        assert sum(r.lengths) == r.n_tokens
        for doc, start, length in zip(r.doc_ids, r.starts, r.lengths):
            spans[doc].append((start, length))
    for doc, text in [(r[0], r[1]) for r in edge.ROWS if r[0] not in (None, 2)]:
        at = 0
        for start, length in sorted(spans[doc]):
            assert start == at
            at += length
        assert at == len(token_ids(text))
    assert shards.training_order(no_docs, PATH).collect() == []


def pieces_of(folder, rows):
    """The ids of each document, put together from the records that its pieces lie in."""
    found = defaultdict(dict)
    for r in rows:
        ids = next(shards.read_from(f"{folder}/shards/shard-{r.shard:09d}.bin", r.byte_offset // shards.stride(64, 2), 64, 2))
        assert len(ids) == r.n_tokens and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        at = 0
        for doc, start, length in zip(r.doc_ids, r.starts, r.lengths):
            found[doc][start] = ids[at : at + length].tolist()
            at += length
    return {doc: [x for start in sorted(parts) for x in parts[start]] for doc, parts in found.items()}


@pytest.mark.parametrize("awkward", [True, False])
def test_ids_and_slots(spark, folder, edge_docs, awkward):
    from tidewheel.llm.tables import fresh_path

    docs = edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"]) if awkward else spark.read.parquet(f"{folder}/documents.parquet")
    out = fresh_path(spark, "order-test")
    rows = shards.training_order(docs, PATH, out, 5, 64, 30).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert pieces_of(out, rows) == {doc: token_ids(text).tolist() for doc, text in texts.items()}
    kept = spark.read.parquet(f"{out}/sequences").collect()
    number = {(r.part, r.nth): i for i, r in enumerate(sorted(kept, key=lambda r: (r.part, r.nth)))}
    slots = shards.permuted(np.arange(len(kept)), len(kept), 5)
    want = {int(slots[number[r.part, r.nth]]): (list(r.doc_ids), list(r.starts)) for r in kept}
    assert {r.slot: (list(r.doc_ids), list(r.starts)) for r in rows} == want
    assert all(r.shard == r.slot // 30 and r.byte_offset == r.slot % 30 * shards.stride(64, 2) for r in rows)


def test_folder_of_another_order(spark, folder, edge_docs):
    from tidewheel.llm.tables import fresh_path

    out = fresh_path(spark, "order-test")
    docs = edge_docs.where("length(text) < 1000")
    first = edge.rows_of(shards.training_order(docs, PATH, out, 5, 64, 30))
    again = docs.repartition(5)  # other tasks, the same documents
    assert edge.rows_of(shards.training_order(again, PATH, out, 5, 64, 30)) == first
    for other in ((docs.limit(3), 5, 64, 30), (docs.union(docs.limit(1)), 5, 64, 30), (docs, 6, 64, 30), (docs, 5, 32, 30), (docs, 5, 64, 31)):
        with pytest.raises(ValueError, match="use a new folder"):
            shards.training_order(other[0], PATH, out, *other[1:])
    assert edge.rows_of(shards.training_order(docs, PATH, out, 5, 64, 30)) == first


def test_run_broken_off_in_the_middle(spark, edge_docs):
    """One sequence cannot be read, so the job dies in its third shard; the next run goes on."""
    import os

    from pyspark.sql import functions as F
    from tidewheel.llm.tables import fresh_path

    out = fresh_path(spark, "order-test")
    rows, count = shards.slotted(shards.sequences(edge_docs, PATH, out, 128))
    broken = rows.withColumn("ids", F.when(F.col("slot") == 50, F.lit(b"broken")).otherwise(F.col("ids")))
    with pytest.raises(Exception):
        shards.write_shards(broken, out, count, 2, 128, 20, tasks=1)
    place = out.removeprefix("file://")
    before = {n: os.stat(f"{place}/shards/{n}").st_mtime_ns for n in sorted(os.listdir(f"{place}/shards")) if n.endswith(".bin") and not n.startswith(".")}
    assert list(before) == ["shard-000000000.bin", "shard-000000001.bin"]
    written = {r.shard: (r.records, r.path) for r in shards.write_shards(rows, out, count, 2, 128, 20).collect()}
    assert sum(n for n, _ in written.values()) == count and sorted(written) == list(range(-(-count // 20)))
    assert all(os.stat(f"{place}/shards/{n}").st_mtime_ns == t for n, t in before.items())
    third = [ids.tolist() for ids in shards.read_from(written[1][1], 3, 128, 2)]
    want = {r.slot: np.frombuffer(shards.restored(r.ids, r.n_tokens, 2), "<u2").tolist() for r in rows.where("slot >= 23 and slot < 40").collect()}
    assert third == [want[s] for s in range(23, 40)]
    read = shards.read_shards(spark.createDataFrame([(k, v[1]) for k, v in written.items()], "shard long, path string"), 2, 128, 20)
    wrote = {r.slot: r.ids_crc32 for r in rows.collect()}
    assert {r.slot: r.read_crc32 for r in read.collect()} == wrote
