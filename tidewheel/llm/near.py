"""Near-duplicate join: word shingles, MinHash LSH forest, exact verification.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles
reaches the threshold.  The steps:

1.  Documents with equal shingle sets are copies; the smallest id stands for them ("class"
    inside this module).  All further steps see these, so copies are never compared.
2.  Every class has a label of ``DEPTH`` MinHash values, one byte each, for each of ``TREES``
    trees.  Classes whose labels begin alike are in one node of the tree's trie.  Matching
    begins with whole labels; the matched prefix is then shortened by ``STEP`` bytes at a time.  At each
    depth a class is tied to the smallest class of each of its nodes: one row per class and
    tree, however large the node.
3.  All labels of a class together are a sketch of its set: the share of equal bytes tells the
    similarity of two classes up to a known error.  A tie counts only if the sketches reach
    the threshold less ``SLACK`` standard errors, so texts that merely share a template are
    not tied.  The prefix is shortened until that brings next to no class a first tie: of the
    classes whose best tie is close to the threshold, where prefixes find least, at most
    1 - ``RECALL`` are new.  What shorter prefixes would add is less than that again.
4.  Classes that share a node with others, but not their sketch with the node's smallest, are
    compared by sketch with all classes of the node, in tiles.
5.  The members of a connected group meet in tiles of bounded size.  A tile intersects all
    its shingle sets by a sparse product in numpy and keeps the pairs that reach the
    threshold: it returns one row per class, with the number of its links and the smallest
    class tied to it there, never a row per pair.  Large groups are cut into blocks, and
    each pair of blocks is a tile.  Only the texts of members travel: a bitmap of bounded size
    tells nearly all others apart during the scan.
6.  Verified ties are connected to groups of near duplicates, the ``class_id`` of the result.

The tiles of a group compare all its classes, so no link within a group is lost to the
trees; two classes are missed only if they meet in no tree nor through any others.

Defined cases: words are runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased.  A text of one to four words has one shingle, all its words.  Texts without
words are copies if they are equal but for white space at the ends (null counts as empty);
they link to no others.  Repeated rows are copies.
Rows that share an id but not a text are told apart by a hash of the text, so each has the
links of its own class.  A class whose ids are all null is not compared with others.  An empty table gives
an empty result; other columns are ignored, or carried through by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewheel.llm.tables import components, key_bits, may_hold, stored, text_or_empty
from tidewheel.llm.words import blocks, mix, seeds, words_in

WIDTH = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 10
SHORTEST = 6
STEP = 2
RECALL = 0.995
SLACK = 4.0
CLOSE = 0.1
BLOCK_ROWS = 256
BLOCK_BYTES = 4 << 20
COLUMNS = 4096
CHUNK = 512

SKETCH_ROWS = 512

SIGNED = "doc_id long, mark long, class binary, n_shingles long, label binary"
TILED = "node long, label long, links long, copies long"
LIKE = "node long, root long, likeness double"


def found_in(depth: int, similarity: np.ndarray | float, trees: int = TREES):
    """Chance that a pair of the given similarity shares a prefix in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


# --- signatures ----------------------------------------------------------------------


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    return (seeds(count, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds(count, 22) >> np.uint64(32)).astype(np.uint32)


def label_bytes(shingles: np.ndarray, bounds: np.ndarray, trees: int = TREES) -> np.ndarray:
    """Per text one byte of each of ``trees`` * ``DEPTH`` MinHash values.

    ``bounds`` are the starts of the texts' shingles; no text is empty here.
    """
    factor, offset = _factors(trees * DEPTH)
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full((len(bounds), len(factor)), np.iinfo(np.uint32).max, np.uint32)
    owner = np.searchsorted(bounds, np.arange(len(small)), "right") - 1
    for at in range(0, len(small), CHUNK):
        part = small[at : at + CHUNK]
        own = owner[at : at + CHUNK]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        values = part[:, None] * factor + offset
        least[own[first]] = np.minimum(least[own[first]], np.minimum.reduceat(values, first, axis=0))
    return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def _signed(column: pa.Array, width: int, trees: int) -> tuple[list, np.ndarray, list]:
    """Class digest, number of shingles and label of each text."""
    runs, many = words_in(column).shingles(width)
    ends = np.cumsum(many)
    sets = [np.unique(runs[e - m : e]) for e, m in zip(ends, many)]
    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    for i in np.flatnonzero(many == 0):
        bare = (column[int(i)].as_py() or "").strip(" \t\n\v\f\r").encode()
        digests[i] = hashlib.blake2b(bare, digest_size=16, person=b"no words").digest()
    sizes = np.array([len(s) for s in sets], np.int64)
    labels: list = [b""] * len(sets)
    full = np.flatnonzero(sizes)
    if len(full):
        bounds = np.cumsum(sizes[full]) - sizes[full]
        rows = label_bytes(np.concatenate([sets[i] for i in full]), bounds, trees)
        for i, row in zip(full, rows):
            labels[i] = row.tobytes()
    return digests, sizes, labels


def signatures(docs: DataFrame, width: int = WIDTH, trees: int = TREES) -> DataFrame:
    """(doc_id, mark, class, n_shingles, label) per row of (doc_id, text, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in blocks(batch.column(1)):
                part = batch.slice(start, stop - start)
                digests, sizes, labels = _signed(part.column(1), width, trees)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(digests, pa.binary()), pa.array(sizes), pa.array(labels, pa.binary())],
                    ["doc_id", "mark", "class", "n_shingles", "label"],
                )

    return docs.mapInArrow(run, SIGNED)


# --- sketches ------------------------------------------------------------------------


def likeness(equal: np.ndarray) -> np.ndarray:
    """Similarity told by a share of equal label bytes; unequal values share a byte by chance."""
    return (equal - 1 / 256) / (1 - 1 / 256)


def least_likeness(threshold: float, trees: int = TREES) -> float:
    """The likeness that pairs at the threshold reach but for ``SLACK`` standard errors."""
    return threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / (trees * DEPTH)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def compared(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, root, likeness) of (node, root) rows."""
    one = labels.select("node", F.col("label").alias("own"))
    other = labels.select(F.col("node").alias("root"), F.col("label").alias("its"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_matrix(batch.column(2)) == _matrix(batch.column(3))).mean(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(likeness(equal))], ["node", "root", "likeness"])

    return pairs.join(one, "node").join(other, "root").select("node", "root", "own", "its").mapInArrow(run, LIKE)


# --- verification --------------------------------------------------------------------


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted unique arrays.

    Shingles that only one set has are left out.  Rare ones add one to each of their pairs;
    frequent ones are columns of a 0/1 matrix, whose product with itself is summed over
    slices of columns.
    """
    n = len(sets)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    owner, starts = owner[order], np.cumsum(seen) - seen
    out = np.zeros(n * n, np.float64)
    rare = (seen > 1) & (seen * 10 < n)
    for count in np.unique(seen[rare]):
        first = starts[rare & (seen == count)]
        for at in range(0, len(first), max(1, (1 << 20) // (count * count))):
            members = owner[first[at : at + max(1, (1 << 20) // (count * count)), None] + np.arange(count)]
            pairs = members[:, :, None] * n + members[:, None, :]
            out += np.bincount(pairs.ravel(), minlength=n * n)
    frequent = np.flatnonzero((seen > 1) & ~rare)
    for at in range(0, len(frequent), COLUMNS):
        chosen = frequent[at : at + COLUMNS]
        matrix = np.zeros((n, len(chosen)), np.float32)
        places = np.arange(seen[chosen].sum()) - np.repeat(np.cumsum(seen[chosen]) - seen[chosen], seen[chosen])
        matrix[owner[np.repeat(starts[chosen], seen[chosen]) + places], np.repeat(np.arange(len(chosen)), seen[chosen])] = 1
        out += (matrix @ matrix.T).ravel()
    return out.reshape(n, n).astype(np.int64)


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index connected to each index of a symmetric boolean matrix."""
    n = len(adjacent)
    label = np.arange(n)
    reach = adjacent | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(nodes: np.ndarray, copies: np.ndarray, texts: list[str], home: np.ndarray, across: bool, threshold: float, width: int) -> pd.DataFrame:
    """Links inside one tile.  ``home`` is the block of each row; in a tile of two blocks
    (``across``) only pairs across them count, as each block has a tile of its own.  A block
    may be empty, so the rows alone do not tell how many blocks a tile has."""
    column = pa.array(texts, pa.large_string())
    runs, many = words_in(column).shingles(width)
    ends = np.cumsum(many)
    order = np.argsort(nodes, kind="stable")
    sets = [np.unique(runs[ends[i] - many[i] : ends[i]]) for i in order]
    nodes, copies, home = nodes[order], copies[order], home[order]
    shared = intersections(sets)
    sizes = np.array([len(s) for s in sets])
    union = sizes[:, None] + sizes[None, :] - shared
    similar = shared / np.maximum(union, 1)
    linked = similar >= threshold - 1e-12
    np.fill_diagonal(linked, False)
    if across:
        linked &= home[:, None] != home[None, :]
    return pd.DataFrame(
        {
            "node": nodes,
            "label": nodes[_labels(linked)],
            "links": linked.sum(axis=1),
            "copies": (linked * copies[None, :]).sum(axis=1),
        }
    )


# --- the join ------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    width: int = WIDTH, trees: int = TREES, recall: float = RECALL,
) -> DataFrame:
    """One row per document: id, class_id (smallest id of its connected near duplicates),
    text_id (smallest id of equal shingle sets), n_copies (documents with that set),
    n_text_links (other shingle sets at the threshold) and n_links (other documents at the
threshold, copies included)."""
    told = _told(docs, id_col, text_col, threshold, width, trees, recall)
    return told.drop("mark", "best").withColumnRenamed("doc_id", id_col)


def _marked(id_col: str, text_col: str) -> list[Column]:
    """Id, text and a hash of the text: rows are known by id and hash, as ids may repeat."""
    text = text_or_empty(text_col)
    return [F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark")]


def _told(docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int, trees: int, recall: float) -> DataFrame:
    """The result with the id still named doc_id, each row's ``mark``, and ``best``: id and
    mark of the row that stands for its group."""
    rows = docs.select(*_marked(id_col, text_col))
    signed = stored(signatures(rows, width, trees), "signed")
    classes = stored(_classes(signed), "classes")
    grouped = _candidates(classes, threshold, trees, recall)
    tiled = stored(_tiles(rows, classes, grouped, threshold, width), "tiles")
    links = tiled.groupBy("node").agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
    groups = components(tiled.select("node", "label"), "node", "label")
    bests = groups.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("best"))
    named = groups.join(stored(bests, "bests"), "component").select("node", "best")
    told = stored(
        classes.join(links, "node", "left")
        .join(named, "node", "left")
        .withColumn("best", F.coalesce("best", "first"))
        .select(
            "class",
            F.col("best.doc_id").alias("class_id"),
            F.col("first.doc_id").alias("text_id"),
            F.col("class_size").alias("n_copies"),
            F.coalesce("links", F.lit(0)).alias("n_text_links"),
            (F.coalesce("copies", F.lit(0)) + F.col("class_size") - 1).alias("n_links"),
            "best",
        ),
        "told",
    )
    return signed.select("doc_id", "mark", "class").join(told, "class").drop("class")


def _classes(signed: DataFrame) -> DataFrame:
    """Classes, numbered: ``first`` is the id and mark of the row that stands for one, but ids
    may repeat, so everything from here on goes by ``node``."""
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))
    return (
        signed.groupBy("class")
        .agg(
            F.min(row).alias("first"), F.count(F.lit(1)).alias("class_size"),
            F.max("n_shingles").alias("n_shingles"), F.any_value("label").alias("label"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )


def _prefix(depth: int) -> Column:
    return F.substring("leaf", 1, depth).alias("prefix")


def _crowded(classes: DataFrame, trees: int) -> DataFrame:
    """(node, tree, leaf) of the leaves that share their ``SHORTEST`` prefix with another."""
    leaf = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("label"), t * DEPTH + 1, F.lit(DEPTH)))
    leaves = classes.where("n_shingles > 0 and first is not null").select("node", F.posexplode(leaf).alias("tree", "leaf"))
    place = F.xxhash64("tree", F.substring("leaf", 1, SHORTEST))
    many = stored(leaves.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place"), "crowded")
    return stored(may_hold(leaves, place, key_bits(many, F.col("place"))), "leaves")


def _candidates(classes: DataFrame, threshold: float, trees: int, recall: float) -> DataFrame:
    """(node, component) of the classes tied by prefix and sketch, directly or through others."""
    leaves = _crowded(classes, trees)
    met = stored(leaves.select("node").distinct(), "met")
    labels = stored(may_hold(classes.select("node", "label"), F.xxhash64("node"), key_bits(met, F.xxhash64("node"))), "labels")
    least = least_likeness(threshold, trees)
    ties, tied = None, 0
    for depth in range(DEPTH, SHORTEST - 1, -STEP):
        found = _members(leaves, depth).where("node <> root").select("node", "root").distinct()
        if ties is not None:
            found = found.join(ties.select("node", "root"), ["node", "root"], "left_anti")
        new = stored(compared(found, labels), "ties")
        ties = new if ties is None else ties.union(new)
        best = ties.groupBy("node").agg(F.max("likeness").alias("likeness"))
        before, tied = tied, best.where(F.col("likeness").between(least, threshold + CLOSE)).count()
        if depth < DEPTH and tied - before <= (1 - recall) * tied:
            break
    good = ties.where(F.col("likeness") >= least).select("node", "root")
    more = _within(leaves, labels, ties, depth, least)
    return components(good if more is None else good.union(more), "node", "root")


def _members(leaves: DataFrame, depth: int) -> DataFrame:
    """(tree, prefix, node, root, n) of the trie nodes of one depth that hold several classes:
    ``root`` is the smallest of the ``n`` classes."""
    at = leaves.select("tree", _prefix(depth), "node")
    nodes = at.groupBy("tree", "prefix").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A class has one leaf a tree, so no node holds more than a share 1 / trees of the rows.
    return at.join(nodes, ["tree", "prefix"])


def _within(leaves: DataFrame, labels: DataFrame, ties: DataFrame, depth: int, least: float) -> DataFrame | None:
    """Further (node, root) ties inside trie nodes, of the classes unlike the node's smallest.

    These meet all classes of the node in tiles of two blocks, of which one at least holds only
    such classes.  Trie nodes with the same classes, from several trees, are compared once.
    None if there are no such classes.
    """
    if ties.where(F.col("likeness") < least).isEmpty():
        return None
    odd = ties.where(F.col("likeness") < least).select("node", "root", F.lit(True).alias("odd"))
    members = stored(
        _members(leaves, depth).where("n > 2").join(odd, ["node", "root"], "left").select("tree", "prefix", "node", F.coalesce("odd", F.lit(False)).alias("odd")),
        "within",
    )
    sets = members.groupBy("tree", "prefix").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("n_odd"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    once = sets.where("n_odd > 0").groupBy("n", "n_odd", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("at"))
    blocks_of = lambda c: F.ceil(c / SKETCH_ROWS).cast("int")
    chosen = stored(once.select("at.*", blocks_of(F.col("n_odd")).alias("odds"), blocks_of(F.col("n") - F.col("n_odd")).alias("others")), "chosen")
    if chosen.isEmpty():
        return None
    home = F.when(F.col("odd"), F.pmod(F.xxhash64("node"), F.col("odds"))).otherwise(F.col("odds") + F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    partners = F.when(F.col("odd"), F.sequence(F.lit(0), F.col("odds") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("odds") - 1))
    tiles = (
        members.join(chosen, ["tree", "prefix"])
        .join(labels, "node")
        .select("tree", "prefix", "node", "label", home.alias("home"), F.explode(partners).alias("other"))
        .select("tree", "prefix", F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b"), "home", "node", "label")
    )

    def work(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        nodes = tile["node"].to_numpy()
        sketch = np.frombuffer(b"".join(tile["label"]), np.uint8).reshape(len(nodes), -1)
        asked = np.flatnonzero(tile["home"].to_numpy() == key[2])
        linked = np.zeros((len(nodes), len(nodes)), bool)
        for at in range(0, len(asked), 64):
            some = asked[at : at + 64]
            linked[some] = likeness((sketch[some, None] == sketch[None]).mean(axis=2)) >= least
        label = nodes[_labels(linked | linked.T)]
        return pd.DataFrame({"node": nodes, "root": label})[nodes != label]

    return tiles.groupBy("tree", "prefix", "a", "b").applyInPandas(work, "node long, root long")


def _tiles(rows: DataFrame, classes: DataFrame, grouped: DataFrame, threshold: float, width: int) -> DataFrame:
    members = grouped.join(classes.select("node", "first.doc_id", "first.mark", "class_size", "n_shingles"), "node")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    cuts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    placed = stored(members.join(stored(sizes.select("component", cuts.alias("cuts")), "sizes"), "component"), "members")
    row = F.xxhash64("doc_id", "mark")
    home = F.pmod(row, F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    with_text = (
        may_hold(rows, row, key_bits(placed, row))
        .join(placed, ["doc_id", "mark"])
        .select("component", "node", "class_size", "text", home.alias("home"), "cuts")
        .select("*", other.alias("other"))
        .select("component", F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b"), "home", "node", "class_size", "text")
    )

    def work(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        across = key[1] != key[2]
        if across and tile["home"].nunique() < 2:
            return pd.DataFrame({c.split()[0]: [] for c in TILED.split(", ")})
        tile = tile.drop_duplicates("node")
        return verify(
            tile["node"].to_numpy(), tile["class_size"].to_numpy(), tile["text"].tolist(), tile["home"].to_numpy(),
            across, threshold, width,
        )

    return with_text.groupBy("component", "a", "b").applyInPandas(work, TILED)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
             width: int = WIDTH, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near duplicates: those with its
    smallest id, and of different texts under that id the one with the smallest hash.  Rows
    without an id stay."""
    told = _told(docs, id_col, text_col, threshold, width, trees, recall)
    here = F.struct("doc_id", "mark")
    beaten = told.where(F.col("doc_id").isNotNull() & (here != F.col("best"))).select("doc_id", "mark").distinct()
    gone = stored(beaten.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")), "beaten")
    own_id, _, own_mark = _marked(id_col, text_col)
    bits = key_bits(gone, F.xxhash64("gone_id", "gone_mark"))
    own = F.xxhash64(own_id, own_mark)
    doubted = may_hold(docs, own, bits)
    match = (own_id == gone["gone_id"]) & (own_mark == gone["gone_mark"])
    return may_hold(docs, own, bits, hold=False).union(doubted.join(gone, match, "left_anti"))
