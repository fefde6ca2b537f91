"""Text, list and field expressions for item metadata."""

from __future__ import annotations

import ast
import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The characters that count as white space.
SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Line labels of the item text, in output order.
TEXT_LABELS = {
    "title": "Title: ",
    "original_title": "Original title: ",
    "genres_list": "Genres: ",
    "tagline": "Tagline: ",
    "overview": "Overview: ",
    "keywords_list": "Keywords: ",
    "top_user_tags": "User tags: ",
    "original_language": "Original language: ",
    "spoken_languages_list": "Spoken languages: ",
    "production_countries_list": "Production countries: ",
    "production_companies_list": "Production companies: ",
    "adult": "Adult: ",
    "release_year": "Release year: ",
}

LIST_FIELDS = {
    "genres_list",
    "keywords_list",
    "top_user_tags",
    "spoken_languages_list",
    "production_countries_list",
    "production_companies_list",
}

# Share of each field in the item vector.
FIELD_WEIGHTS = {
    "overview": 0.25,
    "keywords_list": 0.20,
    "genres_list": 0.30,
    "top_user_tags": 0.10,
    "tagline": 0.05,
    "title": 0.04,
    "original_title": 0.02,
    "production_companies_list": 0.015,
    "production_countries_list": 0.01,
    "spoken_languages_list": 0.01,
    "original_language": 0.003,
    "adult": 0.001,
    "release_year": 0.05,
}

NO_GENRES = "(no genres listed)"


def whole_number(text: Column) -> Column:
    """A long from text: written as an integer it stays exact, else it is read as a double and
    truncated; NULL where it is no number or does not fit."""
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x) -> Column:
    """White-space runs become one blank, ends trimmed, NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(_col(x).cast("string"), F.lit("")), SPACE + "+", " "))


def clean(x) -> Column:
    """``collapse`` after NUL characters and ``<...>`` tags became blanks."""
    text = _col(x).cast("string")
    bare = F.regexp_replace(F.translate(collapse(text), "\x00", " "), "<[^>]+>", " ")
    # most strings hold neither, and need only the first step
    marked = F.contains(text, F.lit("<")) | F.contains(text, F.lit("\x00"))
    return F.when(marked, collapse(bare)).otherwise(collapse(text))


def distinct_ignoring_case(items, cleaned: bool = False) -> Column:
    """Cleaned non-empty strings; of case variants the first spelling stays, in order.

    Variants are found by sorting on the lower-case form, so long lists stay cheap.
    """
    tidy = _col(items) if cleaned else F.transform(_col(items), clean)
    keyed = F.transform(tidy, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
    # the one-element list gives the sorted entries a name inside the filter
    firsts = F.transform(
        F.array(F.sort_array(F.filter(keyed, lambda e: e["x"] != ""))),
        lambda run: F.filter(
            run, lambda e, i: (i == 0) | (F.get(run, i - 1)["k"] != e["k"])
        ),
    )[0]
    in_order = F.sort_array(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    kept = F.transform(in_order, lambda e: e["x"])
    return F.coalesce(kept, F.array().cast("array<string>"))


def as_list(x, kind: str = "array") -> Column:
    """A clean list: NULL gives [], a scalar gives [x], list items are cleaned."""
    items = _col(x) if kind == "array" else F.array(_col(x).cast("string"))
    tidy = F.filter(F.transform(items, clean), lambda i: i != "")
    return F.coalesce(tidy, F.array().cast("array<string>"))


def genres(x) -> Column:
    text = clean(x)
    none = (text == "") | (text == NO_GENRES)
    empty = F.array().cast("array<string>")
    return F.when(none, empty).otherwise(distinct_ignoring_case(F.split(text, r"\|")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_items(texts: pd.Series) -> pd.Series:
    """Items of a Python literal list or dict; NULL where the text is none."""

    def items(text):
        if text is None:
            return None
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        value = [value] if isinstance(value, dict) else value
        if not isinstance(value, list):
            return None
        return [json.dumps(v) if isinstance(v, dict) else str(v) for v in value]

    return texts.map(items)


def with_jsonish_lists(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add lists of names read from text; ``columns`` maps new names to text columns.

    The text may be a JSON list or object, a Python literal of that shape, pipe or comma
    separated, or a single value.  Objects give their name, else english_name, else
    iso_639_1.  Only text that opens like a list and is no JSON goes through Python.
    """
    parsed, literal = {}, {}
    for out, source in columns.items():
        text = F.trim(F.col(source))
        wrapped = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
        strict = F.from_json(
            F.when(_opens(text), wrapped), "array<string>", {"allowSingleQuotes": "false"}
        )
        parsed[f"_json_{out}"] = F.when(F.size(strict) >= 0, strict)
        rest = F.when(_opens(text) & F.col(f"_json_{out}").isNull(), text)
        literal[f"_literal_{out}"] = _literal_items(rest)
    df = df.withColumns(parsed).withColumns(literal)
    lists = {
        out: _names(F.trim(F.col(source)), F.coalesce(f"_json_{out}", f"_literal_{out}"))
        for out, source in columns.items()
    }
    return df.withColumns(lists).drop(*parsed, *literal)


def _opens(text: Column) -> Column:
    return text.startswith("[") | text.startswith("{")


def _names(text: Column, found: Column) -> Column:
    def name(item: Column) -> Column:
        field = lambda key: F.nullif(F.get_json_object(item, f"$.{key}"), F.lit(""))
        return F.when(
            item.startswith("{"), F.coalesce(field("name"), field("english_name"), field("iso_639_1"))
        ).otherwise(F.coalesce(item, F.lit("None")))

    names = F.filter(F.transform(found, name), lambda n: n.isNotNull())
    pieces = (
        F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>"))
        .when(found.isNotNull(), names)
        .when(text.contains("|"), F.split(text, r"\|"))
        .when(text.contains(","), F.split(text, ","))
        .otherwise(F.array(text))
    )
    return distinct_ignoring_case(pieces)


def yes_no(x) -> Column:
    text = F.lower(F.trim(_col(x).cast("string")))
    return (
        F.when(text.isin("true", "1", "yes"), F.lit("Yes"))
        .when(text.isin("false", "0", "no"), F.lit("No"))
        .otherwise(F.lit(""))
    )


def yes_no_int(x) -> Column:
    n = _col(x)
    return F.when(n.isNull(), F.lit("")).when(n != 0, F.lit("Yes")).otherwise(F.lit("No"))


def release_year(date, title) -> Column:
    """First four digits of the date, else (YYYY) that ends the title, else ''."""
    year = F.regexp_extract(clean(date), r"^([0-9]{4})", 1)
    return F.coalesce(
        F.nullif(year, F.lit("")), F.regexp_extract(clean(title), r"\(([0-9]{4})\)\s*$", 1)
    )


def item_text(max_overview: int | None = None, cleaned: bool = False) -> Column:
    """The labelled lines of an item, empty ones left out, joined by newlines.

    ``cleaned`` says that the fields went through cleaning before.
    """
    tidy = F.col if cleaned else clean
    lines = []
    for field, label in TEXT_LABELS.items():
        if field in LIST_FIELDS:
            value = F.array_join(F.col(field) if cleaned else as_list(field), ", ")
        elif field == "adult":
            value = F.col(field) if cleaned else yes_no(field)
        elif field == "overview":
            value = tidy(field) if max_overview is None else F.trim(F.substring(tidy(field), 1, max_overview))
        else:
            value = tidy(field)
        shown = value != ""
        if field == "original_title":
            shown = shown & (F.lower(value) != F.lower(tidy("title")))
        lines.append(F.when(shown, F.concat(F.lit(label), value)))
    return F.concat_ws("\n", *lines)


def field_text(field: str) -> Column:
    """Labelled text of one field for the encoder, '' when there is nothing to say."""
    if field in LIST_FIELDS:
        tidy = F.filter(F.transform(F.col(field), collapse), lambda x: x != "")
        value = F.coalesce(F.array_join(tidy, ", "), F.lit(""))
    else:
        value = collapse(field)
    return F.when(value != "", F.concat(F.lit(TEXT_LABELS[field]), value)).otherwise(F.lit(""))


def enough_content(cleaned: bool = False) -> Column:
    """A title and at least one of genres, overview, tagline, keywords, user tags."""
    tidy = F.col if cleaned else clean
    items = F.col if cleaned else as_list
    lists = [F.size(items(f)) > 0 for f in ("genres_list", "keywords_list", "top_user_tags")]
    texts = [tidy(f) != "" for f in ("overview", "tagline")]
    signal = lists[0] | lists[1] | lists[2] | texts[0] | texts[1]
    return (tidy("title") != "") & signal


def user_from_name(name) -> Column:
    """Id from ``user_123`` or ``123``; NULL for anything else."""
    text = F.trim(_col(name))
    digits = F.when(text.startswith("user_"), F.replace(text, F.lit("user_"), F.lit(""))).otherwise(text)
    return digits.try_cast("long")
