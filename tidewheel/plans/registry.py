"""All queries by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from tidewheel.plans import check_queries, event_queries, rating_queries, source_queries, stream_queries, text_queries

GROUPS = (
    rating_queries.QUERIES,
    event_queries.QUERIES,
    text_queries.QUERIES,
    stream_queries.QUERIES,
    check_queries.QUERIES,
    source_queries.QUERIES,
)


def _all() -> dict:
    merged: dict = {}
    for group in GROUPS:
        twice = merged.keys() & group.keys()
        if twice:
            raise ValueError(f"query names used twice: {sorted(twice)}")
        merged.update(group)
    return merged


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
