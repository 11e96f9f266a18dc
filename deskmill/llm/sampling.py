"""A bounded sample without gathering more than the sample anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE = 1 << 30


def bounded_sample(frame: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """At most ``size`` rows, picked by a hash of the key; all rows if they are no more than that.

    The share to be taken follows from a count, so each task passes on its share only. It is set a little low, by five standard
    deviations, so that the closing limit has nothing to cut.
    """
    rows = frame.count()
    if rows <= size:
        return frame
    share = max(1.0, size - 5 * size ** 0.5) / rows
    return frame.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(RANGE)) < int(share * RANGE) + 1).limit(size)
