"""Mixing, token counts, fingerprints, licenses, toxicity."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import edge
from tidewheel.llm import encoders, fingerprint, licenses, mixing, tokens, toxicity
from tidewheel.llm.tables import fresh_path


# --- mixing --------------------------------------------------------------------------


def reshared(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight; cut at the cap and share the excess anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not above:
            return target
        full |= above


def test_targets_and_totals(spark):
    rows = [(i, "w " * (1 + i % 7), "en", ["a", "b", "c", "d", None][0 if i % 2 else i % 5]) for i in range(4000)]
    docs = edge.documents(spark, rows)
    mixed = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    want, taken = reshared(sizes), defaultdict(int)
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and r.copies <= 3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 7 for s in sizes)
    assert edge.rows_of(mixing.mix(docs.repartition(7))) == edge.rows_of(mixing.mix(docs))


def test_unequal_chances(spark):
    rows = [(i, "w w w", "en", ["a", "b"][i % 2]) for i in range(8000)]
    liked = F.when(F.col("doc_id") % 3 == 0, F.lit(3.0)).otherwise(F.lit(1.0))
    mixed = mixing.mix(edge.documents(spark, rows), preference=liked).collect()
    rate = lambda keep: np.mean([r.taken / r.size for r in mixed if r.source == "b" and keep(r.doc_id % 3 == 0)])
    assert rate(lambda x: x) / rate(lambda x: not x) == pytest.approx(3, rel=0.1)
    assert abs(sum(r.taken for r in mixed if r.source == "b") - mixed[0].target) <= 12_000


def test_border_is_refined(spark, monkeypatch):
    """With few intervals the border's part holds several rows; the choice stays that of one sort."""
    rows = [(i, "w " * (1 + i % 5), "en", ["a", "b", "c", "d"][i % 7 % 4]) for i in range(3000)]
    docs = edge.documents(spark, rows)
    want = edge.rows_of(mixing.mix(docs))
    for bins in (1, 2, 16):
        monkeypatch.setattr(mixing, "BINS", bins)
        assert edge.rows_of(mixing.mix(docs)) == want


def test_repeated_keeps_columns(spark, edge_docs, no_docs):
    docs = edge.clashing(edge_docs)
    left = mixing.repeated(docs)
    assert left.columns == docs.columns
    sums = mixing.mix(edge_docs).agg(F.sum("copies")).first()[0]
    assert left.count() == sums
    assert mixing.repeated(no_docs).collect() == []


# --- token counts --------------------------------------------------------------------


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts(spark, edge_docs, no_docs, name):
    path = encoders.default_path(name)
    library = encoders._library(path)
    count = (lambda t: len(library.encode(t))) if name.endswith(".model") else (lambda t: len(library.encode(t, add_special_tokens=False).ids))
    want = [(d, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for d, t, *_ in edge.ROWS]
    assert edge.rows_of(tokens.count_tokens(edge.clashing(edge_docs), path)) == sorted(want, key=repr)
    assert tokens.count_tokens(no_docs, path).collect() == []


def test_cache_is_used_and_grows(spark):
    path, cache = encoders.default_path("piece_bpe_32k.model"), fresh_path(spark, "cache-test")
    rows = [(i, f"text number {i % 4}", "en", "a") for i in range(10)]
    size = lambda: spark.read.schema(tokens.CACHE).parquet(cache).count()
    first = edge.rows_of(tokens.count_tokens(edge.documents(spark, rows), path, cache))
    assert size() == 4
    assert edge.rows_of(tokens.count_tokens(edge.documents(spark, rows), path, cache)) == first and size() == 4
    tokens.count_tokens(edge.documents(spark, [*rows, (11, "a new one", "en", "a")]), path, cache).collect()
    assert size() == 5
    tokens.count_tokens(edge.documents(spark, rows), encoders.default_path("byte_bpe_50k.json"), cache).collect()
    assert size() == 9  # another tokenizer meets none of the old counts


# --- fingerprints --------------------------------------------------------------------


def test_insert_and_delete():
    lines = ["first line here", "second line there", "", "third, the longest of them all"]
    whole = fingerprint.fingerprint(lines)
    assert fingerprint.fingerprint(lines[::-1]) == whole
    without = fingerprint.delete(whole, lines[1])
    assert without == fingerprint.fingerprint([lines[0], lines[3]])
    assert fingerprint.insert(without, lines[1]) == whole
    assert fingerprint.fingerprint([lines[0], lines[0]]) != fingerprint.fingerprint([lines[0]])


def _successors(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    return {r[0]: (r[1] or "", rows[(i + 1) % len(rows)][1] or "") for i, r in enumerate(rows)}


@pytest.mark.parametrize("which", ["tables", "edge"])
def test_successors_and_edits(spark, folder, which):
    if which == "tables":
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
    else:
        rows = list({r[0]: r for r in edge.ROWS if r[0] is not None}.values())
        docs = edge.clashing(edge.documents(spark, rows))
    found = {r.doc_id: r for r in fingerprint.compared_with_edits(docs).collect()}
    assert found.keys() == {r[0] for r in rows}
    for doc, (text, following) in _successors(rows).items():
        cut = len(text) // 3
        changed, r = text[: len(text) - cut] + following[:cut], found[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == fingerprint.fingerprint([text])
        assert r.edited_fingerprint == fingerprint.fingerprint([changed])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    if which == "tables":
        assert np.median([r.near_edited for r in found.values()]) > 0.5 > 0.2 > np.median([r.near_next for r in found.values()])


def test_followers_of_awkward_rows(spark, edge_docs, no_docs):
    assert fingerprint.compared_with_edits(edge_docs).count() == len(edge.ROWS)
    assert fingerprint.compared_with_edits(no_docs).collect() == []
    single = fingerprint.compared_with_edits(edge.documents(spark, [(1, "abc def", "en", "a")])).first()
    assert single.near_next == 1.0
    again = fingerprint.fingerprints(edge.clashing(edge_docs))
    assert sorted(again.columns) == sorted(edge.clashing(edge_docs).columns)


def _overlap(a, b):
    """Twice the product of the run counts over the squares of both, counted exactly."""
    runs = [defaultdict(int), defaultdict(int)]
    for text, seen in zip((a, b), runs):
        for line in text.split("\n"):
            words = line.split()
            for i in range(len(words) - 2):
                seen[tuple(words[i : i + 3])] += 1
    first, second = runs
    both = sum(n * n for n in first.values()) + sum(n * n for n in second.values())
    return 2 * sum(n * second[run] for run, n in first.items()) / both


def test_likeness_of_long_repeated_texts(spark):
    other = " ".join(f"other{i}" for i in range(40_000))
    rows = [(6, "again " * 45_000), (5, other), (4, "word " * 100_000), (3, other), (2, "one line of words\n" * 100_000), (1, other)]
    found = fingerprint.compared_with_edits(edge.documents(spark, [(*r, "en", "a") for r in rows])).collect()
    texts = _successors(rows)
    for r in found:
        if r.doc_id % 2 == 0:
            text, following = texts[r.doc_id]
            changed = fingerprint.edited(text, following)
            assert abs(r.near_edited - _overlap(text, changed)) < 0.02 and _overlap(text, changed) > 0.85
            assert abs(r.near_next - _overlap(text, following)) < 0.02
    lines = ["one line of words"] * 100_000
    whole = fingerprint.fingerprint(lines)
    assert fingerprint.insert(fingerprint.fingerprint(lines[1:]), lines[0]) == whole


# --- licenses ------------------------------------------------------------------------


def test_changed_notice_is_found(spark):
    notice = dict((label, text) for label, text in licenses.NOTICES)["bsd"]
    words = notice.split()
    changed = " ".join([*words[:6], "all", *words[6:12], *words[13:]])
    texts = [
        "intro " + changed + " outro", "redistribution and use of the source", f"Foo. {notice.title()}!",
        "MIT-License, mit licensed; the MIT\nLICENSE", "general public license general public license",
    ]
    rows = {r.doc_id: r for r in licenses.scan(edge.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert rows[0].labels == "bsd" and 0.8 <= rows[0].score < 1
    assert rows[1].labels == "" and rows[1].score < 0.5
    assert rows[2].labels == "bsd" and rows[2].score == 1.0
    assert (rows[3].n_base, rows[3].first_word, rows[3].last_word, rows[3].base_labels) == (2, 0, 5, "mit")
    assert (rows[4].n_base, rows[4].first_word, rows[4].last_word) == (2, 0, 3)


def test_repeated_rows_and_null_ids(spark, edge_docs):
    rows = licenses.scan(edge.clashing(edge_docs)).collect()
    assert len(rows) == len(edge.ROWS)
    assert [r.labels for r in rows if r.doc_id == 11] == ["apache,gpl,mit"]


# --- toxicity ------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, net, keep=["doc_id", "lang"]).join(labels, "doc_id").where(toxicity.held_out()).collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows]) == 1
    assert (score[toxic] >= 0.3).mean() > 0.8 and (score[~toxic] >= 0.3).mean() < 0.02
    left = {r.doc_id for r in toxicity.clean(docs, net).select("doc_id").collect()}
    assert np.mean([r.doc_id in left for r, t in zip(rows, toxic) if not t]) > 0.98


def test_training_never_sees_held_out_rows(spark):
    ids = [i for i in range(60)]
    rows = [(i, "vile filth" if zlib.crc32(str(i).encode()) % 4 == 2 else f"fine day {i % 9}", "en", "a") for i in ids]
    labels = spark.createDataFrame([(i, int(rows[i][1] == "vile filth")) for i in ids], "doc_id long, toxic int")
    net = toxicity.fit(edge.documents(spark, rows), labels)
    assert net.base == 0.0  # only one class is left


def test_awkward_rows_and_labels(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (6, None), (None, 1), (7, 0), (9, 1), (10, 0)], "doc_id long, toxic int")
    net = toxicity.fit(edge_docs, labels)
    rows = toxicity.scored(edge.clashing(edge_docs), net).collect()
    assert len(rows) == len(edge.ROWS) and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1
    assert toxicity.clean(edge.clashing(edge_docs), net).columns == edge.clashing(edge_docs).columns
    assert toxicity.fit(no_docs, labels).base == 0.0
    assert toxicity.scored(no_docs, net).collect() == []


def test_training_sample_is_bounded(spark, monkeypatch):
    """One id with thousands of rows trains once; texts beyond the byte budget do not train."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, langs: seen.append((texts.to_pylist(), labels.tolist())))
    rows = [(1, f"copy {i}", "en", "a") for i in range(3000)] + [(i, "x" * 100, "en", "a") for i in range(2, 60)] + [(3, "y" * 10**6, "en", "a")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    docs = edge.documents(spark, rows)
    toxicity.fit(docs, labels, rows=20)
    toxicity.fit(docs, labels, rows=20, max_bytes=550)
    toxicity.fit(docs.repartition(5), labels, rows=20, max_bytes=550)
    assert len(seen[0][0]) <= 20 and sum(t.startswith("copy") for t in seen[0][0]) <= 1
    assert sum(len(t) for t in seen[1][0]) <= 550 and len(seen[1][0]) >= 5 and seen[1] == seen[2]


def naive_score(net, text):
    """The forward pass with loops over words, filters and places."""
    words = toxicity.buckets_of(pa.array([text]))
    known = {int(k): i + 1 for i, k in enumerate(net.keys)}
    inputs = [net.table[known.get(int(a), 0)] + net.table[known.get(int(b), 0)] for a, b in zip(words[0], words[1])]
    total = net.offset
    for n, (width, bank, bias) in enumerate(zip(toxicity.WIDTHS, net.filters, net.biases)):
        for f in range(toxicity.FILTERS):
            best = float(bias[f])
            for i in range(len(inputs)):
                best = max(best, float(bias[f]) + sum(float(inputs[i + j] @ bank[j][:, f]) for j in range(width) if i + j < len(inputs)))
            total += max(best, 0.0) * float(net.out[n * toxicity.FILTERS + f])
    return 1 / (1 + np.exp(-total))


def test_scores_on_the_tables_equal_a_naive_forward_pass(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit(docs, labels)
    short = docs.where("length(text) < 1500 or text is null")
    rows = toxicity.scored(short, net, keep=["doc_id", "text"]).collect()
    assert len(rows) > 50
    for r in rows:
        assert r.score == pytest.approx(naive_score(net, r.text or ""), abs=1e-5)


def test_thresholds_by_language():
    scores = np.array([0.9] * 40 + [0.6] * 40 + [0.4] * 40 + [0.1] * 40)
    labels = np.array([1] * 40 + [0] * 40 + [1] * 40 + [0] * 40)
    langs = ["en"] * 80 + ["de"] * 80
    found = toxicity.calibrated(scores, labels, langs)
    assert found["en"] == pytest.approx(0.75) and found["de"] == pytest.approx(0.25)


def test_gradient():
    """One step on one text changes the loss the way finite differences say."""
    rng = np.random.default_rng(0)
    net = toxicity._fresh(np.arange(1, 9, dtype=np.int32), rng.normal(0, 2, 8), 0.5, rng)
    net.biases = [b + 0.5 for b in net.biases]
    a, b, counts = np.array([1, 2, 3, 0, 4]), np.array([5, 0, 6, 0, 7]), np.array([5])
    loss = lambda: float(-np.log(toxicity._sigmoid(net.pooled(a, b, counts) @ net.out + net.offset))[0])
    before = loss()
    toxicity._step(net, np.array([0]), a, b, [(0, 5)], np.array([1.0]), {}, 0.001)
    assert loss() < before


def test_equal_texts_equal_scores():
    net = toxicity.train(["bad vile word"] * 40 + ["good kind word"] * 40, np.array([1] * 40 + [0] * 40), ["en"] * 80)
    scores = net.scores(pa.array(["bad vile word", None, "", "good kind word", "bad vile word"]))
    assert scores[0] == scores[4] > 0.5 > scores[3] and scores[1] == scores[2]
