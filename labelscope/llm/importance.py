"""Drawing the documents most like a target collection, by importance resampling.

Documents and target are bags of hashed runs of words. The log ratio of a bucket's share in the
target to its share in the corpus is the bucket's gain; a document weighs the sum of its gains,
taken from one array, and a Gumbel term keyed by its id makes the top of the scores a draw
without replacement.

The top is cut by a weighted median of medians: each partition gives the median of the keys that
are left in it, the median of those, weighted by what is left, is the pivot, and counting the keys
before it discards a quarter of the rest at least. The driver sees one key a partition and round
until the exact key of the last winner is found; winners are then sorted by range, and only they.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import Batches, by_slices, stored

BUCKETS = 10_000
_CACHED = 500_000  # words a task remembers the buckets of
_LONGEST_CACHED = 64

# Words are made of digits, letters and bytes beyond ASCII; capitals count as small letters.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class Buckets(dict):
    """The bucket of a feature, looked up or hashed."""

    def __init__(self, count: int) -> None:
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        bucket = crc32(feature) % self.count
        if len(feature) <= _LONGEST_CACHED and len(self) < _CACHED:
            self[feature] = bucket
        return bucket


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_LETTERS).split()


def features_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by a space."""
    if longest == 1:
        return words
    return [b" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def _texts(docs: DataFrame, text_col: str) -> Column:
    return F.col(text_col).cast("string").cast("binary").alias("text")


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over the whole table; one row a bucket and task is shuffled."""

    def count(batches: Batches) -> Batches:
        of, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                found = features_of(words_of(data.as_py()), longest)
                total += np.bincount(np.fromiter(map(of.__getitem__, found), np.int64, len(found)), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    def count_whole(batches: Batches) -> Batches:
        # Short texts are counted together: an array operation a text would cost more than its words.
        def joined() -> Batches:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    texts = batch.column(0).slice(start, 256).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(t for t in texts if t)], pa.binary())], ["text"])

        yield from count(joined() if longest == 1 else batches)

    rows = docs.select(_texts(docs, text_col)).mapInArrow(count_whole, "bucket bigint, n bigint")
    totals = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket
        totals[bucket] = n
    return totals


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the buckets' smoothed shares, rounded down."""
    size = len(corpus)
    of_corpus, of_target = int(corpus.sum()) + size, int(target.sum()) + size
    ratios = [float((t + 1) * of_corpus) / float((s + 1) * of_target) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], np.int64)


def weights(
    docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1
) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight`` of every row; no words weigh 0."""

    def weigh() -> object:
        of = Buckets(len(gain))

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            split = [words_of(data) for data in batch.column(1).to_pylist()]
            parts = [features_of(words, longest) for words in split]
            sizes = np.array([len(p) for p in parts], np.int64)
            each = gain[np.fromiter((of[f] for p in parts for f in p), np.int64, int(sizes.sum()))]
            sums = np.append(0, np.cumsum(each))
            stops = np.cumsum(sizes)
            words = np.array([len(w) for w in split], np.int64)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(sizes), pa.array(sums[stops] - sums[stops - sizes])],
                ["id", "n_words", "n_features", "weight"],
            )

        return by_slices(convert, "text", 8 << 20)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), _texts(docs, text_col))
    return rows.mapInArrow(weigh(), f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_value: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate keyed by the id, rounded down; a null id is the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_value.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


# --- the cut --------------------------------------------------------------------------------
# Keys are (less, id, n_features), least first and null ids last: less is the negated score.

_KEY = ["less", "id", "n_features"]


def _same(column: str, value: object) -> Column:
    return F.col(column).eqNullSafe(F.lit(value))


def _before(key: tuple) -> Column:
    less, name, features = key
    by_id = F.col("id").isNotNull() if name is None else F.coalesce(F.col("id") < F.lit(name), F.lit(False))
    by_features = _same("id", name) & (F.col("n_features") < features)
    return (F.col("less") < less) | ((F.col("less") == less) & (by_id | by_features))


def _at(key: tuple) -> Column:
    return _same("less", key[0]) & _same("id", key[1]) & _same("n_features", key[2])


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([(name, "ascending") for name in _KEY])  # nulls go last


def _median(batches: Batches) -> Batches:
    parts = [batch for batch in batches if batch.num_rows]
    if parts:
        table = _sorted(pa.Table.from_batches(parts))
        middle = table.slice((table.num_rows - 1) // 2, 1).append_column("n", pa.array([table.num_rows], pa.int64()))
        yield from middle.to_batches()


def last_winner(keys: DataFrame, winners: int, few: int = 4096) -> tuple:
    """The key at place ``winners`` (from 1) of ``keys``, a stored table with at least that many rows.

    Each round reads the keys twice: for the partitions' medians, and to count around the pivot.
    At ``few`` keys left the rest is sorted at once.
    """
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields)
    left = keys
    while True:
        medians = left.mapInArrow(_median, f"{kind}, n bigint").collect()  # a row a partition
        total = sum(m.n for m in medians)
        if total <= few:
            rows = pa.Table.from_pylist([r.asDict() for r in left.collect()])
            return tuple(_sorted(rows).slice(winners - 1, 1).to_pylist()[0][name] for name in _KEY)
        order = _sorted(pa.Table.from_pylist([m.asDict() for m in medians])).to_pylist()
        reached, pivot = 0, None
        for row in order:
            reached += row["n"]
            if 2 * reached >= total:
                pivot = tuple(row[name] for name in _KEY)
                break
        less, same = left.agg(F.count_if(_before(pivot)), F.count_if(_at(pivot))).first()
        if winners <= less:
            left = left.where(_before(pivot))
        elif winners <= less + same:
            return pivot
        else:
            left, winners = left.where(~_before(pivot) & ~_at(pivot)), winners - less - same


def draw(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = 10,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
) -> DataFrame:
    """``id_col``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``.

    Of the N rows of at least ``least_words`` words, ``percent`` per cent (rounded down) with the
    highest scores have a rank, from 1; equal scores go by the smaller id, a null id last, then by
    fewer features; rows equal in all that are repeated rows, of which any may win. Null, empty and
    wordless texts have no features, weigh 0 and get a score, but no rank unless ``least_words`` is 0;
    texts count whole; other columns are left behind; an empty table gives none.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    weighed = weights(docs, gain, id_col, text_col, longest)
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "importance")
    entered = F.col("n_words") >= least_words
    winners = scored.where(entered).count() * percent // 100
    columns = ["id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("bigint").alias("rank")
    if not winners:
        return scored.select(*columns, unranked).withColumnRenamed("id", id_col)
    keyed = scored.withColumn("less", -F.col("score"))
    last = last_winner(keyed.where(entered).select(*_KEY), winners)
    wins = entered & (_before(last) | _at(last))
    order = ["less", F.col("id").asc_nulls_last(), "n_features"]
    top = keyed.where(wins).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(top.withColumn("place", F.monotonically_increasing_id()), "winners")
    part = F.shiftright("place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # a row a partition
    before = np.cumsum([0] + [n for _, n in sizes])[:-1].tolist()
    offsets = docs.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=True)], "part bigint, ahead bigint")
    rank = F.col("ahead") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    ranked = ranked.select(*columns, F.when(rank <= winners, rank).alias("rank"))
    rest = keyed.where(~F.coalesce(wins, F.lit(False))).select(*columns, unranked)
    return rest.unionByName(ranked).withColumnRenamed("id", id_col)
