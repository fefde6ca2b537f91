"""Training labels: jittered sigmoid of ratings, log-scaled watch time."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

MAX_U64 = float(2**64 - 1)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _pair_key(user, item) -> Column:
    return F.concat(_col(user).cast("string"), F.lit(":"), _col(item).cast("string"))


def _spread(share: Column, amplitude: float) -> Column:
    if not 0 < amplitude < 0.5:
        raise ValueError("jitter amplitude must lie between 0 and 0.5")
    return share * F.lit(2.0 * amplitude) - F.lit(amplitude)


def md5_share(user, item) -> Column:
    """The last 8 bytes of md5("user:item"), little-endian, as a share of 2^64 - 1."""
    digest = F.md5(_pair_key(user, item))
    reversed_bytes = F.concat(*[F.substring(digest, 31 - 2 * i, 2) for i in range(8)])
    return F.conv(reversed_bytes, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(MAX_U64)


def md5_jitter(user, item, amplitude: float = 0.1) -> Column:
    return _spread(md5_share(user, item), amplitude)


@F.pandas_udf(T.DoubleType())
def _blake2b_share(keys: pd.Series) -> pd.Series:
    def share(key):
        if key is None:
            return None
        digest = hashlib.blake2b(key.encode("utf-8"), digest_size=8).digest()
        return int.from_bytes(digest, "big") / MAX_U64

    return keys.map(share)


def blake2b_jitter(user, item, amplitude: float = 0.1) -> Column:
    """8-byte blake2b of "user:item", big-endian, spread over ±amplitude."""
    return _spread(_blake2b_share(_pair_key(user, item)), amplitude)


def offline_label(rating, jitter, k: float = 5.0, centre: float = 0.5) -> Column:
    moved = jittered_rating(rating, jitter)
    scaled = (moved - F.lit(0.5)) / F.lit(4.5)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-k) * (scaled - F.lit(centre))))


def jittered_rating(rating, jitter) -> Column:
    moved = _col(rating).cast("double") + _col(jitter)
    return F.least(F.lit(5.0), F.greatest(F.lit(0.5), moved))


def online_label(seconds, cap: float = 600.0) -> Column:
    kept = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), _col(seconds).cast("double")))
    return F.least(F.lit(1.0), F.log1p(kept) / F.log1p(F.lit(float(cap))))


def label_source(columns) -> str:
    """The raw rating column: ``rating`` where present, else ``label``."""
    for name in ("rating", "label"):
        if name in columns:
            return name
    raise ValueError("neither rating nor label is present")
