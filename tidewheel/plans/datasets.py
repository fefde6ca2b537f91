"""Whole jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidewheel.operators import profiles, samples, splits, timeline
from tidewheel.session import cut_lineage


def base_tables(ratings: DataFrame, items: DataFrame, version: str = "v1", **cut_options) -> dict[str, DataFrame]:
    """The four tables of a profile build.

    The numbered and cut histories are written once, narrow, and all four tables read
    them from there.
    """
    cut = cut_lineage(timeline.bootstrap_cut(ratings, **cut_options))
    boot = timeline.base_events(cut)
    return {
        "base_user_events": boot,
        "remaining_user_events": timeline.remaining_events(cut),
        "base_users": timeline.user_stats(cut),
        "base_user_profiles": profiles.base_user_profiles(boot, items, version),
    }


def offline_inputs(ratings: DataFrame, items: DataFrame, version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """Remaining events, and the fused user vectors as a written table."""
    base = base_tables(ratings, items, version)
    return base["remaining_user_events"], cut_lineage(profiles.fused_users(base["base_user_profiles"]))


def offline_samples(ratings: DataFrame, items: DataFrame, version: str = "v1") -> DataFrame:
    """Ratings to samples: cut, decay, profiles, fusion, join with the remaining events."""
    remaining, users = offline_inputs(ratings, items, version)
    return samples.offline_samples(remaining, users, items)


def offline_dataset(
    ratings: DataFrame, items: DataFrame, jitter: str = "blake2b", strategy: str = "by_position"
) -> DataFrame:
    """Labelled and split training rows; ``strategy`` is ``by_position`` or ``per_user``.

    Rows are numbered and split while they are narrow; the vectors are joined last, so
    no vector goes through a window.
    """
    remaining, users = offline_inputs(ratings, items)
    narrow = samples.matched(remaining, users, items)
    placed = split(narrow, strategy, lambda df: splits.label_offline(df, jitter))
    return samples.attach_vectors(placed, users, items)


def split(found: DataFrame, strategy: str, label: Callable[[DataFrame], DataFrame]) -> DataFrame:
    found = cut_lineage(found)  # read for its ranges or hot users, and again for its rows
    rating = "rating" if "rating" in found.columns else "label"
    if strategy == "per_user":
        placed = splits.split_per_user(found, order=("timestamp", "movie_id", rating))
    elif strategy == "by_position":
        placed = splits.split_by_position(found, order=("user_id", "timestamp", "movie_id", rating))
    else:
        raise ValueError(f"unknown split strategy: {strategy}")
    return label(placed)


def online_dataset(
    events: DataFrame, versions: DataFrame, items: DataFrame, threshold: float = 0.8, cap: float = 600.0
) -> DataFrame:
    """Watch events to labelled and split rows, in event order; vectors are joined last."""
    narrow = cut_lineage(samples.online_matched(events, versions, items, threshold))
    placed = splits.label_online(splits.split_by_position(narrow, order=("event_id",)), cap)
    return samples.attach_online_vectors(placed, versions, items)
