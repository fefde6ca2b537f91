"""Spelling variants: words one edit apart, and the common word each rare one leads to.

Two words are near if inserting, deleting or replacing one code point turns one into the
other.  They are found by asymmetric q-chunks:

1.  One word, say of L code points, contributes two disjoint chunks: its first L // 2 code
    points and the rest.  A single edit touches at most one of the two.
2.  The other word contributes its positional grams of the lengths that chunks of words with
    one code point less, as many, or one more have.  The intact chunk is among them, at its
    own place or shifted by one, as the lengths tell; grams at other places meet no chunk
    and are not sent.
3.  Chunks and grams are joined on (L, which chunk, characters), and each pair that meets is
    verified by its edit distance inside the join, so only near pairs leave it.  A pair is
    unordered, the smaller word giving the chunks; one that meets in both chunks counts in
    the first.

Joins and counts are Spark's, so a frequent chunk is a skewed join key that AQE splits.
``forms`` picks the near word of largest n; ``roots`` follows forms to the last by pointer
doubling, in a number of rounds that grows with the logarithm of the longest chain (a form
has at least ``RATIO`` times the word's n, so chains are short).

Defined cases: words are runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z is lower-cased.
Null texts have no words; a null id reads as an empty one.  Repeated rows count again.  An empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewheel.llm.tables import stored, text_or_empty

RUN = re.compile("[a-zÀ-ÿ]+")
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
TYPO_EVERY = 199
HELD_WORDS = 200_000
SLICE = 1 << 20


# --- words ---------------------------------------------------------------------------


def runs_of(text: str) -> Iterator[str]:
    """The runs of a text, in slices of bounded size that end between runs."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    at = 0
    while at < len(text):
        stop = at + SLICE
        while stop < len(text) and RUN.match(text, stop):
            stop += 1
        yield from RUN.findall(text, at, stop)
        at = stop


def mistyped(doc: str, run: str) -> str:
    """``run`` without one code point, in one of ``TYPO_EVERY`` (document, run) pairs."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % TYPO_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[str, str], str] | None = None,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of enough code points and occurrences.

    ``change`` is applied to each (id, run).  Each task sends sums of what it has counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(runs_of(text))
                for word, n in own.items():
                    if change is not None:
                        word = change(doc, word)
                    if len(word) >= min_length:
                        held[word] += n
                        if len(held) >= HELD_WORDS:
                            yield _counted(held)
                            held = Counter()
        yield _counted(held)

    narrow = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), text_or_empty(text_col).alias("text"))
    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


# --- the join ------------------------------------------------------------------------


def _cut(word: str, start: Column, length: Column) -> Column:
    return F.substring(F.col(word), start, length)


def chunks(words: DataFrame) -> DataFrame:
    """(size, part, gram, word, n): two disjoint chunks per word."""
    size = F.length("word")
    half = (size / 2).cast("int")
    both = F.array(
        F.struct(F.lit(0).alias("part"), _cut("word", F.lit(1), half).alias("gram")),
        F.struct(F.lit(1).alias("part"), _cut("word", half + 1, size - half).alias("gram")),
    )
    return words.select("word", "n", size.alias("size"), F.explode(both).alias("c")).select("size", "c.part", "c.gram", "word", "n")


def grams(words: DataFrame) -> DataFrame:
    """(size, part, gram, other, other_n): the grams that chunks of words of ``size`` can meet.

    The first chunk is met at place 0, the second at its own place plus the difference of
    the lengths, which is the shift of all that lies behind the edit.
    """
    size = F.length("word")
    found = []
    for more in (-1, 0, 1):
        whole = size + more
        half = (whole / 2).cast("int")
        found.append(F.struct(whole.alias("size"), F.lit(0).alias("part"), _cut("word", F.lit(1), half).alias("gram")))
        found.append(F.struct(whole.alias("size"), F.lit(1).alias("part"), _cut("word", half - more + 1, whole - half).alias("gram")))
    return words.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.explode(F.array(*found)).alias("g")).select(
        "g.size", "g.part", "g.gram", "other", "other_n"
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all near pairs of distinct words, each once, word < other.

    ``words`` is read twice, so it should be a stored table.
    """
    left, right = chunks(words).alias("l"), grams(words).alias("r")
    half = (F.col("l.size") / 2).cast("int")
    begins_alike = _cut("word", F.lit(1), half) == _cut("other", F.lit(1), half)
    same = (F.col("l.size") == F.col("r.size")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.gram") == F.col("r.gram"))
    once = (F.col("word") < F.col("other")) & ((F.col("l.part") == 0) | ~begins_alike)
    one_edit = F.levenshtein("word", "other", 1) == 1
    return left.join(right, same & once & one_edit).select("word", "n", "other", "other_n")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) per word."""
    pairs = near_pairs(words)
    sides = F.array(
        F.struct(F.col("word"), F.col("n"), F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near"))))
    # Every word once more by itself, so that words without near ones stay, without a join.
    found = pairs.select(F.explode(sides).alias("s")).select("s.*").union(alone)
    found = found.groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    leads = -F.col("best.less") >= ratio * F.col("n")
    return found.select("word", "n", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last word reached from form to form."""
    links = stored(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        links = stored(
            links.join(onward, F.col("root") == F.col("via"), "left")
            .select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")),
            "roots",
        )
        moved = links.where("moved").limit(1).count()
        links = links.drop("moved")
        if not moved:
            return links


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of (word, n)."""
    found = stored(forms(stored(words, "words"), ratio), "forms")
    last = roots(found).select(F.col("word").alias("of"), "root")
    return found.join(last, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
