"""Spelling variants against brute force and SQL, on awkward rows and skewed words."""

import random

import duckdb
import pyarrow as pa
import pytest

import checks
import edge
from tidewheel.llm import mending_queries, spelling

WORDS = [
    (1, "abcdef abcdef abcdef abcdef abcdef " * 6 + "abcdeg " * 5 + "abcdf " * 9 + "Xabcdef " * 5, "en", "a"),
    (2, "ÀBCDÉF àbcdéf " * 6 + "× ÷×÷×÷× " * 5 + "don't stop-gap naïveté42naïveté " * 5, "fr", None),
    (2, "ÀBCDÉF àbcdéf " * 6 + "× ÷×÷×÷× " * 5 + "don't stop-gap naïveté42naïveté " * 5, "fr", None),
    (3, " ".join("q" * k for k in range(1, 40)) * 5, "en", "a"),
    (None, "abcdefg " * 5, None, None),
]


def one_edit(a: str, b: str) -> bool:
    """By trying all edits."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words: dict[str, int], ratio: int = spelling.RATIO) -> list[tuple]:
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= ratio * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


def found(spark, words: dict[str, int]) -> list[tuple]:
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return edge.rows_of(spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n"))


def test_brute_force_on_crowded_words(spark):
    """Few letters, so that halves are shared by many words and edits meet everywhere."""
    rng = random.Random(5)
    words = {"".join(rng.choices("abé", k=rng.randint(6, 8))): rng.randint(5, 4000) for _ in range(700)}
    assert found(spark, words) == brute(words)


def test_chain_of_forms_and_ties(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "zzzzzz": 10, "zzzzzy": 50, "zzzzzx": 50}
    rows = found(spark, words)
    assert rows == brute(words)
    assert {r[0]: r[2] for r in rows}["aaaaaa"] == "aabbbb"
    assert {r[0]: r[1] for r in rows}["zzzzzz"] == "zzzzzx"


def test_words_of_one_chunk(spark):
    """A third of all words share their first half: each near pair still once."""
    words = {f"prefix{a}{b}{c}xyz": 5 + 30 * (a == b) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdef"}
    assert found(spark, words) == brute(words)


def test_counts_on_awkward_texts(spark):
    docs = edge.clashing(edge.documents(spark, WORDS + edge.ROWS))
    counted: dict[str, int] = {}
    for doc, text, _, _ in WORDS + edge.ROWS:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in lowered).split(" "):
            if run:
                word = spelling.mistyped("" if doc is None else str(doc), run)
                counted[word] = counted.get(word, 0) + 1
    want = {w: n for w, n in counted.items() if len(w) >= 6 and n >= 5}
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, change=spelling.mistyped).collect()}
    assert got == want


def test_slices_do_not_cut_words(monkeypatch):
    text = " ".join("word" * (i % 9 + 1) for i in range(300))
    whole = list(spelling.runs_of(text))
    monkeypatch.setattr(spelling, "SLICE", 7)
    assert list(spelling.runs_of(text)) == whole == text.split()


def test_counts_held_back_are_sent(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 2)
    docs = edge.documents(spark, WORDS)
    some = {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}
    monkeypatch.undo()
    assert some == {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} and some["abcdef"] == 30


@pytest.mark.parametrize("rows", [WORDS + edge.ROWS, []], ids=["edge", "empty"])
def test_twin_on_awkward_rows(spark, rows):
    con = duckdb.connect()
    columns = list(zip(*rows)) if rows else [[], []]
    documents = pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["doc_id", "text"])  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    docs = edge.clashing(edge.documents(spark, rows))
    got = spelling.variants(spelling.word_counts(docs, change=spelling.mistyped))
    assert checks.compare(got, con, mending_queries.OP11_SQL) == []
