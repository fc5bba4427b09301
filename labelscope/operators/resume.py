"""Picking up where an earlier run ended.

A row that could not be read, or whose ``Unknown`` is asked for again, is scored once more
with the next attempt number. Results keep every attempt; the latest one of a row counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.domain import BOX, UNKNOWN
from labelscope.operators.joins import lookup_join

PERSON_KEY = ("image_path", *BOX)
# A scored row: of repeated annotations of one person each has its own result.
ROW_KEY = ("model_key", "context", "row_id", *PERSON_KEY)
NEEDS = "array<struct<model_key:string,attempt:int>>"


def _final(stored: DataFrame, retry_unknown: bool) -> Column:
    """Whether a result needs no other attempt."""
    final = F.lit(True)
    if "error" in stored.columns:  # a file that could not be read may be readable now
        final = ~F.coalesce(F.startswith("error", F.lit("read: ")), F.lit(False))
    return final & (F.col("predicted_label") != UNKNOWN) if retry_unknown else final


def _done(stored: DataFrame, key: Sequence[str], retry_unknown: bool) -> DataFrame:
    return stored.where(_final(stored, retry_unknown)).select(*key)


def _distinct(done: DataFrame, keys: list[str]) -> DataFrame:
    # Copies of a key collapse map-side, so a hot stored key is one row per task.
    return done.select(*keys).distinct()


def remaining(
    rows: DataFrame,
    stored: DataFrame,
    key: Sequence[str] = PERSON_KEY,
    retry_unknown: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Rows without a stored result; a null key never counts as done.

    The default key is the person (image and box). ``key=['image_path']`` treats an
    image as done once any person in it is. ``stored`` is one model and context. Rows
    whose image could not be read (``error`` begins with "read: ") are not done.
    """
    return lookup_join(rows, _done(stored, key, retry_unknown), key, "left_anti", hot, collapse=_distinct)


def outstanding(
    rows: DataFrame,
    stored: DataFrame | None,
    models: Sequence[str],
    retry_unknown: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Rows some model has not scored, with the models and attempt numbers they need.

    ``needs`` has model_key and attempt, in the order of ``models``. ``stored`` holds the
    results of one context; a person is looked up once for all models,
    by one aggregate a model that copies of a person collapse into map-side.
    """
    if stored is None:
        first = F.array(*[F.struct(F.lit(m).alias("model_key"), F.lit(1).alias("attempt")) for m in models])
        return rows.withColumn("needs", first.cast(NEEDS))
    # A missing side is a value like any other here, or its rows would be scored by every run.
    person = {f"_{c}": F.coalesce(F.col(c), F.lit("") if c == "image_path" else F.lit(-(1 << 63))) for c in PERSON_KEY}
    told = stored.withColumns(person).select(
        *person, "model_key", _final(stored, retry_unknown).alias("_final"), F.col("attempt").alias("_attempt")
    )

    def per_person(done: DataFrame, keys: list[str]) -> DataFrame:
        of = [F.col("model_key") == m for m in models]
        return done.groupBy(*keys).agg(
            *[F.max(F.when(mine, F.col("_final"))).alias(f"_done{i}") for i, mine in enumerate(of)],
            *[F.max(F.when(mine, F.col("_attempt"))).alias(f"_tried{i}") for i, mine in enumerate(of)],
        )

    seen = lookup_join(rows.withColumns(person), told, list(person), "left", hot, collapse=per_person)
    need = [
        F.when(
            ~F.coalesce(f"_done{i}", F.lit(False)),
            F.struct(F.lit(m).alias("model_key"), (F.coalesce(f"_tried{i}", F.lit(0)) + 1).cast("int").alias("attempt")),
        )
        for i, m in enumerate(models)
    ]
    needs = F.filter(F.array(*need), lambda n: n.isNotNull()).cast(NEEDS)
    return seen.select(*rows.columns, needs.alias("needs")).where(F.size("needs") > 0)


def latest_attempts(results: DataFrame) -> DataFrame:
    """Each scored row with its last attempt only.

    Just the rows of second and later attempts are grouped and looked up: as ``attempt`` is a
    partition of the store, a store without any is not joined to anything.
    """
    again = results.where("attempt > 1")
    newest = again.groupBy(*[F.col(c).alias(f"_{c}") for c in ROW_KEY]).agg(F.max("attempt").alias("_newest"))
    # A row_id or a side may be null: such rows are looked up too.
    same = F.lit(True)
    for name in ROW_KEY:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    joined = results.join(newest, same, "left")
    return joined.where("_newest IS NULL OR attempt = _newest").select(*results.columns)


def resume_audit(
    rows: DataFrame,
    stored: DataFrame,
    key: Sequence[str] = PERSON_KEY,
    retry_unknown: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """One row: stored results and rows left to score."""
    done = stored.agg(F.count("*").alias("stored_rows"))
    left = remaining(rows, stored, key, retry_unknown, hot).agg(F.count("*").alias("remaining_rows"))
    return left.select(done.scalar().alias("stored_rows"), "remaining_rows")


def merged_results(stored: DataFrame, new: DataFrame, key: Sequence[str] = ("row_id", *PERSON_KEY)) -> DataFrame:
    """Stored rows and new rows; a new one replaces the stored one of its key.

    Key columns that either side lacks do not count; columns of one side only are kept.
    """
    both = [c for c in key if c in stored.columns and c in new.columns]
    if both:
        again = new.select(*[F.col(c).alias(f"_{c}") for c in both]).distinct()
        same = F.lit(True)
        for name in both:
            same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
        stored = stored.join(again, same, "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)
