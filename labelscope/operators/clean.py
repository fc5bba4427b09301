"""Cleaning raw annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from labelscope.domain import BOX, CLASSES
from labelscope.functions.boxes import whole_number
from labelscope.functions.paths import resolve_path, with_image_key
from labelscope.functions.text import as_text, strip
from labelscope.operators.joins import hot_hashes, lookup_join

_LABEL_HEADERS = {"label", "emotion", "category", "discrete_label"}


def _target(header: str) -> str:
    name = header.strip().lower().replace(" ", "_")
    if "image" in name and "path" in name:
        return "image_path"
    if name in _LABEL_HEADERS:
        return "label"
    return f"bbox_{name}" if f"bbox_{name}" in BOX else name


def standard_columns(df: DataFrame) -> DataFrame:
    """Rename loosely named columns to the annotation schema."""
    names = [_target(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"several columns stand for {twice}: {df.columns}")
    absent = [c for c in ("image_path", "label") if c not in names]
    if absent:
        raise ValueError(f"no column stands for {absent}: {df.columns}")
    return df.toDF(*names)


def _prepared(raw: DataFrame, root: str) -> DataFrame:
    return (
        raw.withColumn("image_path", resolve_path(F.col("image_path"), root))
        .withColumn("label", strip(as_text(F.col("label"))))
        .transform(with_image_key)
    )


def resolved_paths(raw: DataFrame, root: str = "") -> DataFrame:
    """Full path of every annotation, before any row is dropped."""
    return raw.select(resolve_path(F.col("image_path"), root).alias("image_path"))


def _files(images: DataFrame) -> DataFrame:
    return with_image_key(images.where(F.col("image_path").isNotNull()).select("image_path")).select("image_key")


def hot_images(raw: DataFrame, root: str = "") -> DataFrame:
    """Hot image files of an annotation table, for the joins on image_path; only paths are read."""
    return hot_hashes(with_image_key(resolved_paths(raw, root)), ["image_key"])


def clean_annotations(
    raw: DataFrame,
    images: DataFrame,
    root: str = "",
    missing_box: str = "raise",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Rows with a listed image and a known label, box coordinates as bigint.

    ``raw`` has the annotation schema and ``row_id``; ``images`` lists each existing
    file once in ``image_path``. Box columns that are absent become 0. With
    ``missing_box='quarantine'`` unreadable coordinates become null, and the crop
    step reports those rows as invalid boxes. ``image_path`` stays as it is spelled;
    ``image_key`` is added, the canonical path by which images are found from here on.
    """
    known = _prepared(raw, root).where(F.col("label").isin(CLASSES))
    kept = lookup_join(known, _files(images), ["image_key"], "left_semi", hot)
    return _boxed(raw, kept, missing_box)


def cleaned_and_counted(
    raw: DataFrame,
    images: DataFrame,
    counts: Observation,
    root: str = "",
    missing_box: str = "raise",
    hot: DataFrame | None = None,
) -> DataFrame:
    """``clean_annotations``, with the counts of ``load_audit`` observed by the job that uses the rows.

    ``counts`` has raw_rows, missing_images, unknown_labels and usable_rows once a job over the
    whole result is done.
    """
    flags = _flagged(raw, images, root, hot)
    seen = flags.observe(counts, *_load_counts())
    return _boxed(raw, seen.where("_found AND _known"), missing_box)


def _flagged(raw: DataFrame, images: DataFrame, root: str, hot: DataFrame | None) -> DataFrame:
    listed = _files(images).distinct().withColumn("_found", F.lit(True))
    return lookup_join(_prepared(raw, root), listed, ["image_key"], hot=hot).withColumns({
        "_found": F.col("_found").isNotNull(), "_known": F.coalesce(F.col("label").isin(CLASSES), F.lit(False)),
    })


def _load_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(~F.col("_found")).alias("missing_images"),
        F.count_if(F.col("_found") & ~F.col("_known")).alias("unknown_labels"),
        F.count_if(F.col("_found") & F.col("_known")).alias("usable_rows"),
    ]


def _boxed(raw: DataFrame, kept: DataFrame, missing_box: str) -> DataFrame:
    boxed = kept.withColumns({
        name: whole_number(name, missing_box) if name in raw.columns else F.expr("0L")
        for name in BOX
    })
    return boxed.select(*raw.columns, *[c for c in BOX if c not in raw.columns], "image_key")


def load_audit(
    raw: DataFrame,
    images: DataFrame,
    root: str = "",
    sample: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """One row of counts: raw, missing image, unknown label, usable, subset."""
    check_sample_size(sample)
    counted = _flagged(raw, images, root, hot).agg(*_load_counts())
    subset = F.col("usable_rows") if sample is None else F.least("usable_rows", F.lit(sample))
    return counted.withColumn("subset_rows", subset)


def check_sample_size(n: int | None) -> None:
    if n is not None and n < 0:
        raise ValueError("sample size must not be negative")
