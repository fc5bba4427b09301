"""Joins of a large table, whose keys may be hot, to a table with one row per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sketch tracks this many keys for each that can be hot, so that it sees them all.
_TRACKED_PER_HOT = 5
_SLICES = 4  # for each partition a key would fill, so that they spread evenly
_MOST_TRACKED = 1_000_000  # what the sketch allows


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_hashes(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Hashes of the keys that would fill a shuffle partition of their own: ``hot``, ``slices``.

    A key is hot if it holds more rows than an average partition, so there are no more of
    them than partitions; it gets a few slices for each partition it would fill.
    Reads the key columns of ``df`` once, so take it from a scan or a stored table, not
    from the end of a long chain.
    """
    most = _partitions(df)
    tracked = min(_MOST_TRACKED, max(1024, most * _TRACKED_PER_HOT))
    top = df.select(F.xxhash64(*on).alias("k")).agg(
        F.expr(f"approx_top_k(k, {min(most, tracked)}, {tracked})").alias("top"), F.count("*").alias("n")
    )
    found = top.select("n", F.inline("top"))
    filled = F.col("count") * most
    return found.where(filled > F.col("n")).select(
        F.col("item").alias("hot"), F.least(F.lit(most), F.ceil(filled / F.col("n")) * _SLICES).cast("int").alias("slices")
    )


def settled(hot: DataFrame) -> DataFrame:
    """The same hashes, one per shuffle partition at most, as a constant for several jobs."""
    return hot.sparkSession.createDataFrame(hot.collect(), "hot bigint, slices int")


def _marked(df: DataFrame, on: Sequence[str], hot: DataFrame, slice_of: Callable[[Column], Column]) -> DataFrame:
    marks = F.broadcast(hot.select(F.col("hot").alias("_hot"), F.col("slices").alias("_slices")))
    joined = df.join(marks, F.xxhash64(*on) == F.col("_hot"), "left")
    return joined.withColumn("_slice", slice_of(F.coalesce("_slices", F.lit(1)))).drop("_hot", "_slices")


def sliced(df: DataFrame, on: Sequence[str], hot: DataFrame | None, spread: Sequence[str]) -> DataFrame:
    """Add ``_slice``: rows of a hot key are dealt over its slices by a hash of ``spread``."""
    if hot is None:
        return df.withColumn("_slice", F.lit(0))
    return _marked(df, on, hot, lambda slices: F.pmod(F.xxhash64(*spread), slices).cast("int"))


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    hot: DataFrame | None = None,
    spread: Sequence[str] = ("row_id",),
    collapse: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Join ``fact`` to ``lookup``, which has one row per key.

    ``collapse`` makes it so where it is not yet: a function of a table and its key columns,
    such as a ``distinct`` or an aggregation.

    Only the fact side can be skewed then. Adaptive execution splits it, as long as the
    lookup is a plain table; it leaves joins alone whose lookup is aggregated by the key,
    as the aggregate's shuffle serves the join. With ``hot`` (see ``hot_hashes``) the split
    is in the plan itself: rows of a hot key are dealt over its slices by a hash of
    ``spread``, and only the matching lookup rows are repeated per slice, before they are
    collapsed, so that one shuffle serves both. The sketch merely says which keys to slice;
    the result is the same for any answer it gives.
    """
    on = list(on)
    if hot is None:
        return fact.join(collapse(lookup, on) if collapse else lookup, on, how)
    repeated = _marked(lookup, on, hot, lambda slices: F.explode(F.sequence(F.lit(0), slices - 1)))
    keys = [*on, "_slice"]
    return sliced(fact, on, hot, spread).join(collapse(repeated, keys) if collapse else repeated, keys, how).drop("_slice")
