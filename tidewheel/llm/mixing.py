"""Mix sources to target weights by Pareto order sampling.

Each source gets a target number of words.  A document's expected number of copies is the
target over the source's size, tilted by an optional preference.  Its whole part is
certain.  For the rest, every document draws ``u`` from a hash of its id and is ranked by
the odds of the draw over its inclusion odds, ``(u / (1-u)) / (p / (1-p))``; documents are
taken in that order until the source's remaining words are reached, to within half of the
document at the border.  Reruns draw the same numbers.

No task sorts a whole source: the ranks fall into ``BINS`` equal intervals, per-source sums
of the intervals find the one that holds the border, sums of its ``BINS`` parts find the part,
and only that one's rows are sorted: a source of 1e11 documents has some 6000 there.  Other
texts are never shuffled here.  One row per source is the largest table that a window spans.

Defined cases: a null text has size 0, and rows of size 0 take nothing.  A null source is a
source of its own, after all others.  Equal ids draw the same number, and identical rows
are interchangeable.  An empty table gives an empty result.  All columns are carried
through unless the result has a column of that name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewheel.llm.tables import stored

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BINS = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space characters."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(parts, "")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """Add ``target`` to (source, source_size), one row per source.

    Sources in code-point order, null last, get the weights in turn and share the words of
    all sources; what exceeds ``cap`` times a source's size is shared anew by weight among
    the others.  In order of ``cap * size / weight`` the capped sources come first, so one
    pass finds the level: all words less the caps so far, over the weights that are left.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("*", weight.alias("_w"))
    rows = rows.select("*", (F.lit(float(cap)) * F.col("source_size") / F.col("_w")).alias("_full"))
    before = W.orderBy("_full", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy("_full", F.col("source").isNull(), "source").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.select("*", (left.cast("double") / F.sum("_w").over(onward)).alias("_level"))
    level = F.min(F.when(F.col("_full") > F.col("_level"), F.struct("_full", "_level"))).over(everything)["_level"]
    capped = F.lit(float(cap)) * F.col("source_size")
    return rows.select("source", "source_size", F.coalesce(F.least(capped, level * F.col("_w")), capped).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    preference: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    cap: int = MAX_COPIES,
    seed: str = SEED,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies (0 to ``cap``) and taken (words).

    ``preference`` (positive, 1 by default) tilts the inclusion chances within a source.
    ``carry`` names the columns to keep (all by default).
    """
    size = word_count(F.col("text")) if size is None else size
    liking = F.lit(1.0) if preference is None else preference.cast("double")
    carry = docs.columns if carry is None else list(carry)
    rows = docs.select(
        F.struct(*carry).alias("_row"), F.col(id_col).alias("_id"),
        F.coalesce(source_col, F.lit("")).alias("_source"), F.col(source_col).isNull().alias("_none"),
        size.alias("size"), liking.alias("_g"),
    )
    narrow = stored(rows.select("_id", "_source", "_none", "size", "_g"), "sizes")
    plan = _plan(narrow, weights, cap, seed)
    placed = _ranked(rows, plan, cap, seed)
    clear = placed.where("_bin <> _border or _fine <> _fine_border").withColumn(
        "_more", (F.struct("_bin", "_fine") < F.struct(F.col("_border").alias("_bin"), F.col("_fine_border").alias("_fine"))).cast("int")
    )
    line = W.partitionBy("_source", "_none").orderBy("_z", "_id", "size")
    words = F.sum("size").over(line.rowsBetween(W.unboundedPreceding, -1))
    half_way = F.coalesce(words, F.lit(0)) + F.col("size") / 2.0
    edge = placed.where("_bin = _border and _fine = _fine_border").withColumn("_more", (half_way < F.col("_rest")).cast("int"))
    copies = F.col("_sure") + F.col("_more")
    added = {
        "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"),
        "copies": copies.cast("int"), "taken": (copies * F.col("size")).cast("long"),
    }
    kept = [F.col(f"_row.`{c}`") for c in carry if c not in added]
    return clear.unionByName(edge).select(*kept, *[e.alias(n) for n, e in added.items()])


def _plan(narrow: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    """Per source: target, rate, the border interval of ranks, the border part of that interval,
    and the words still wanted inside it.  The part holds about 1 / ``BINS`` ** 2 of a source."""
    sums = narrow.groupBy("_source", "_none").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_g")).alias("_liked")
    )
    sized = stored(sums.withColumn("source", F.when(~F.col("_none"), F.col("_source"))), "sources")
    aims = targets(sized.select("source", "source_size"), weights, cap)
    first = stored(
        aims.select(
            F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"),
            "source_size", "target",
        ).join(sized.select("_source", "_none", "_liked"), ["_source", "_none"])
        .withColumn("_rate", F.when(F.col("_liked") > 0, F.col("target") / F.col("_liked")).otherwise(F.lit(0.0))),
        "rates",
    )
    ranked = _ranked(narrow, first, cap, seed)
    bins = ranked.groupBy("_source", "_none", "_bin").agg(
        F.sum("size").alias("_words"), F.sum(F.col("size") * F.col("_sure")).alias("_certain"),
        F.max("target").alias("_target"),
    )
    every = W.partitionBy("_source", "_none")
    upto = every.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = bins.select(
        "_source", "_none", "_bin",
        (F.col("_target") - F.sum("_certain").over(every)).alias("_want"),
        F.sum(F.when(F.col("_bin") < BINS, F.col("_words")).otherwise(F.lit(0))).over(upto).alias("_upto"),
        F.when(F.col("_bin") < BINS, F.col("_words")).otherwise(F.lit(0)).alias("_words"),
    )
    border = (
        summed.where("_bin < %d and _want > 0 and _upto >= _want" % BINS)
        .groupBy("_source", "_none")
        .agg(F.min(F.struct("_bin", (F.col("_want") - (F.col("_upto") - F.col("_words"))).alias("_rest"), "_want")).alias("b"))
    )
    wanting = summed.groupBy("_source", "_none").agg(F.max("_want").alias("_want"))
    found = wanting.join(border.select("_source", "_none", "b"), ["_source", "_none"], "left").select(
        "_source", "_none",
        F.coalesce("b._bin", F.when(F.col("_want") > 0, F.lit(BINS)).otherwise(F.lit(-1))).alias("_border"),
        F.coalesce("b._rest", F.lit(0.0)).alias("_rest"),
    )
    coarse = stored(first.join(found, ["_source", "_none"]), "borders")
    fine = (
        _ranked(narrow, coarse.withColumn("_fine_border", F.lit(0)), cap, seed).where(f"_bin = _border and _border < {BINS}")
        .groupBy("_source", "_none", "_fine").agg(F.sum("size").alias("_words"), F.max("_rest").alias("_rest"))
    )
    before = every.orderBy("_fine").rowsBetween(W.unboundedPreceding, -1)
    cut = (
        fine.select("_source", "_none", "_fine", "_words", "_rest", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
        .where("_before + _words >= _rest")
        .groupBy("_source", "_none").agg(F.min(F.struct("_fine", (F.col("_rest") - F.col("_before")).alias("left"))).alias("f"))
    )
    return stored(
        coarse.join(cut, ["_source", "_none"], "left").select(
            *[c for c in coarse.columns if c != "_rest"],
            F.coalesce("f._fine", F.when(F.col("_border") == BINS, -1).otherwise(BINS)).alias("_fine_border"), F.coalesce("f.left", F.lit(0.0)).alias("_rest"),
        ),
        "parts",
    )


def _ranked(rows: DataFrame, plan: DataFrame, cap: int, seed: str) -> DataFrame:
    """Certain copies, rank ``_z`` in [0, 1), its interval and the part of that; what cannot be
    included is in interval ``BINS``."""
    joined = rows.join(plan, ["_source", "_none"])
    expected = F.least(F.lit(float(cap)), F.col("_rate") * F.col("_g"))
    sure = F.floor(expected)
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null")))), 1, 12)
    draw = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(2**48)
    chance = F.col("_p")
    odds = (F.col("_u") / (1 - F.col("_u"))) / (chance / (1 - chance))
    interval = F.floor(F.col("_z") * float(BINS)).cast("int")
    return (
        joined.select("*", sure.cast("int").alias("_sure"), (expected - sure).alias("_p"), draw.alias("_u"))
        .select("*", F.when(chance > 0, odds / (1 + odds)).otherwise(F.lit(1.0)).alias("_z"))
        .select("*", F.when(chance > 0, F.least(interval, F.lit(BINS - 1))).otherwise(F.lit(BINS)).alias("_bin"))
        .select("*", F.least(F.floor((F.col("_z") * float(BINS) - F.col("_bin")) * float(BINS)).cast("int"), F.lit(BINS - 1)).alias("_fine"))
    )


def repeated(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it has copies."""
    slim = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    mixed = mix(slim, id_col="id", carry=["_doc"], **options)
    return (
        mixed.where("copies > 0")
        .select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
        .select(*[F.col(f"_doc.`{c}`") for c in docs.columns])
    )
