import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

import edge
from tidewheel.llm import near, tables, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    found = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(found) < 5:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def brute(rows, threshold=0.8):
    sets = [shingles(r[1]) for r in rows]
    first, size, texts = {}, defaultdict(int), {}
    for (doc, *_), s in zip(rows, sets):
        size[s] += 1
        if doc is not None:
            first[s] = min(first.get(s, doc), doc)
    classes = [s for s in size if s in first and s]
    linked = defaultdict(set)
    for i, a in enumerate(classes):
        for b in classes[:i]:
            if len(a & b) >= threshold * len(a | b) - 1e-9:
                linked[a].add(b)
                linked[b].add(a)
    group = {}
    for s in classes:
        seen, todo = {s}, [s]
        while todo:
            for other in linked[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        group[s] = min(first[x] for x in seen)
    return sorted(
        (
            (doc, first.get(s), size[s], group.get(s, first.get(s)), len(linked[s]), sum(size[x] for x in linked[s]) + size[s] - 1)
            for (doc, *_), s in zip(rows, sets)
        ),
        key=repr,
    )


def got(df):
    return edge.rows_of(df.select("doc_id", "text_id", "n_copies", "class_id", "n_text_links", "n_links"))


def near_rows(count=260):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], [draw.choices(vocabulary, k=60) for _ in range(12)]
    for i in range(count):
        words_ = list(base[0] if i % 3 == 0 else draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
            words_[draw.randrange(60)] = draw.choice(vocabulary)
        rows.append((i, " ".join(words_), "en", "a"))
    return rows


def test_links_equal_brute_force(spark):
    rows = near_rows()
    assert got(near.near_duplicates(edge.documents(spark, rows))) == brute(rows)


def test_tiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_ROWS", 20)
    rows = near_rows()
    assert got(near.near_duplicates(edge.documents(spark, rows))) == brute(rows)


def test_blocks_without_members(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_BYTES", 256)
    draw = random.Random(5)
    rows = []
    for group in range(8):
        base = [f"g{group}w{draw.randrange(500)}" for _ in range(80)]
        rows += [(10 * group + i, " ".join([*base, *["end", "mark"][:i]]), "en", "a") for i in range(2 + group % 2)]
    assert got(near.near_duplicates(edge.documents(spark, rows))) == brute(rows)


def test_ids_with_two_texts(spark):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    texts = {"A": a, "A'": [*a, "end"], "B": b, "B'": [*b, "end"], "C": [*a[:30], *b[:30]]}
    rows = [(i, " ".join(texts[t]), "en", "a") for i, t in [(0, "B'"), (1, "B"), (1, "A"), (5, "A'"), (1, "C"), (7, "C")]]
    assert got(near.near_duplicates(edge.documents(spark, rows))) == brute(rows)
    left = sorted((r.doc_id, r.text) for r in near.keep_one(edge.documents(spark, rows)).collect())
    assert left == sorted((rows[i][0], rows[i][1]) for i in (0, 2, 4))


def test_texts_without_words(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(["***", "----", "...", " ***\n", "", None, " \t"])]
    assert sorted(r.doc_id for r in near.keep_one(edge.documents(spark, rows)).collect()) == [0, 1, 2, 4]


def test_small_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near.near_duplicates(docs)) == brute(rows)


def test_edge_rows(spark, edge_docs, no_docs):
    docs = edge.clashing(edge_docs)
    assert got(near.near_duplicates(docs)) == brute(edge.ROWS)
    assert near.near_duplicates(no_docs).collect() == []
    left = near.keep_one(docs)
    assert left.columns == docs.columns
    beaten = {r[0] for r in brute(edge.ROWS) if r[0] is not None and r[0] != r[3]}
    assert sorted(repr(r.doc_id) for r in left.collect()) == sorted(repr(r[0]) for r in edge.ROWS if r[0] not in beaten)
    assert near.keep_one(no_docs).collect() == []


def some_pair(rng, similarity, size=400):
    common = int(2 * size * similarity / (1 + similarity))
    parts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (common, size - common, size - common)]
    return [np.unique(np.concatenate([parts[0], x])) for x in parts[1:]]


def test_labels_meet_and_sketches_tell_similarity():
    rng = np.random.default_rng(1)
    met, told = 0, []
    for _ in range(60):
        pair = some_pair(rng, 0.8)
        labels = near.label_bytes(np.concatenate(pair), np.array([0, len(pair[0])]))
        told.append(near.likeness((labels[0] == labels[1]).mean()))
        trees = (labels[0] == labels[1]).reshape(near.TREES, near.DEPTH)
        met += bool(trees[:, : near.SHORTEST].all(axis=1).any())
    assert met == 60 and abs(np.mean(told) - 0.8) < 0.01
    assert sum(x >= near.least_likeness(0.8) for x in told) == 60
    assert near.least_likeness(0.8) > 0.7 and near.found_in(near.SHORTEST, 0.8) > 0.9998


def test_prefix_is_shortened_until_it_finds_the_links(spark):
    """Pairs at 0.8 to 0.84 of long texts: whole labels find some, the shortened ones all."""
    draw = random.Random(11)
    rows = []
    for i in range(150):
        words_ = [f"p{i}w{draw.randrange(10**6)}" for _ in range(400)]
        other = list(words_)
        for at in range(8):
            other[at * 45 + 7] = "other"
        rows += [(2 * i, " ".join(words_), "en", "a"), (2 * i + 1, " ".join(other), "en", "a")]
    found = got(near.near_duplicates(edge.documents(spark, rows)))
    want = brute(rows)
    links = sum(r[4] for r in want)
    assert links == 300 and sum(r[4] for r in found) >= 0.995 * links


def test_texts_of_one_template_are_not_compared(spark):
    """Two thirds of each text are shared by all: many trie nodes, no link, no group."""
    draw = random.Random(13)
    shared = [f"s{i}" for i in range(400)]
    rows = [(i, " ".join([*shared, *[f"r{draw.randrange(10**7)}" for _ in range(200)]]), "en", "a") for i in range(300)]
    rows += [(900 + i, rows[i][1] + " end", "en", "a") for i in range(9)]
    docs = edge.documents(spark, rows)
    signed = tables.stored(near.signatures(docs.select(*near._marked("doc_id", "text"))))
    classes = tables.stored(near._classes(signed))
    grouped = near._candidates(classes, 0.8, near.TREES, near.RECALL)
    assert sorted(r["count"] for r in grouped.groupBy("component").count().collect()) == [2] * 9
    assert got(near.near_duplicates(docs)) == brute(rows)


def test_tiles_within_a_crowded_trie_node(spark, monkeypatch):
    """Pairs of near copies inside one template, none of them like the smallest of its node."""
    monkeypatch.setattr(near, "SKETCH_ROWS", 8)
    draw = random.Random(17)
    shared = [f"s{i}" for i in range(300)]
    rows = []
    for i in range(60):
        own = [f"r{draw.randrange(10**7)}" for _ in range(100)]
        rows += [(2 * i, " ".join([*shared, *own]), "en", "a"), (2 * i + 1, " ".join([*shared, *own, "end"]), "en", "a")]
    assert got(near.near_duplicates(edge.documents(spark, rows))) == brute(rows)


def test_bitmap_of_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows, keys = spark.range(20_000), tables.stored(spark.range(0, 20_000, 37))
    for limit in (tables.MAX_BITS, 1 << 15):
        monkeypatch.setattr(tables, "MAX_BITS", limit)
        bits = tables.key_bits(keys, F.xxhash64("id"))
        held = {r.id for r in tables.may_hold(rows, F.xxhash64("id"), bits).collect()}
        rest = {r.id for r in tables.may_hold(rows, F.xxhash64("id"), bits, hold=False).collect()}
        assert held >= set(range(0, 20_000, 37)) and not held & rest and len(held) + len(rest) == 20_000 and len(held) < 1200
    empty = tables.key_bits(tables.stored(spark.range(0)), F.xxhash64("id"))
    assert tables.may_hold(rows, F.xxhash64("id"), empty).count() == 0


def test_intersections():
    rng = np.random.default_rng(0)
    for n, universe in ((60, 60), (200, 4000)):
        sets = [np.unique(rng.integers(0, universe, rng.integers(1, 80)).astype(np.uint64)) for _ in range(n)]
        found = near.intersections(sets)
        assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(i))


def test_components(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in root if any(x in e and e[0] != e[1] for e in edges))
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    assert edge.rows_of(tables.components(df, "a", "b")) == sorted(want, key=repr)


def test_words():
    texts = ["", None, "Añb c-D", "x" * 200 + " y", "!!", "a b c d e f"]
    found = words.words_in(pa.array(texts))
    want = [WORD.findall("".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    assert found.counts.tolist() == [len(w) for w in want]
    names = dict(zip([x for w in want for x in w], found.hashes.tolist()))
    assert [names[x] for w in want for x in w] == found.hashes.tolist() and len(set(names.values())) == len(names)
    assert found.shingles(5)[1].tolist() == [0, 0, 1, 1, 0, 2]
