import hashlib
import random
import string
from collections import defaultdict

import edge
from pyspark.sql import functions as F
from tidewheel.llm import exact

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, largest):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        stays = True
        for doc in ids:
            kept = doc == keep and stays
            stays = stays and not kept
            out.append((doc, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edge_rows(spark, edge_docs):
    for keep in ("smallest", "largest"):
        got = exact.content_groups(edge.clashing(edge_docs), keep=keep)
        assert edge.rows_of(got) == brute(edge.ROWS, keep == "largest")


def test_empty(no_docs):
    assert exact.content_groups(no_docs).collect() == []
    assert exact.drop_copies(no_docs).collect() == []


def test_hot_text_over_many_slices(spark):
    draw = random.Random(5)
    rows = [(i, "Same Text" if i % 3 else f"text {draw.randrange(400)}", "en", "a") for i in range(3000)]
    rows += [(i, "same" + "x" * 300 + str(i % 2), "en", "a") for i in range(3000, 3600)]
    docs = edge.documents(spark, rows)
    assert edge.rows_of(exact.content_groups(docs, keep="largest")) == brute(rows, True)
    runs = exact._runs(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), "largest")
    assert runs.where("_norm = 'same text'").select("_slice").distinct().count() > 3


def test_drop_copies_keeps_columns(spark, edge_docs):
    docs = edge.clashing(edge_docs)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    kept = sorted(repr(r[0]) for r in brute(edge.ROWS, False) if r[3])
    assert sorted(repr(r.doc_id) for r in left.collect()) == kept
    texts = {(r[0], r[1]) for r in edge.ROWS}
    assert all((r.doc_id, r.text) in texts and r["_norm"] == "own _norm" for r in left.collect())


def test_drop_copies_over_slices(spark):
    rows = [(i, "Same Text" if i % 2 else f"text {i}", "en", "a") for i in range(2000)]
    left = exact.drop_copies(edge.documents(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == sorted([1, *range(0, 2000, 2)])
