"""The three jobs: score full images, score crops, compare.

Each step ends in a table in the workspace, a folder every executor can reach, so
a lost executor or a restarted driver repeats only the step it interrupted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from labelscope.domain import FACE, FULL, SAMPLE_SEED, runs, select_models
from labelscope.functions.paths import qualified
from labelscope.functions.pixels import decode_image
from labelscope.operators import clean, compare, crop, metrics, resume, sample
from labelscope.operators.joins import hot_hashes, settled
from labelscope.operators.score import Images, Predictor, answered, score, score_models
from labelscope.sources import stores
from labelscope.sources.annotations import read_annotations
from labelscope.sources.images import FileImages, StoredImages, existing_images, manifest, read_images

Factories = Mapping[str, Callable[[], Predictor]]


@dataclass(frozen=True)
class Workspace:
    """Where the tables of one study live."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"


def _name(batch: str | None) -> str:
    return batch or uuid.uuid4().hex


def prepare(
    spark: SparkSession,
    work: Workspace,
    csv: str,
    image_root: str,
    sample_size: int | None = None,
    seed: int = SAMPLE_SEED,
    listing: bool = False,
    missing_box: str = "raise",
    multi_line: bool | None = None,
) -> DataFrame:
    """Ingest, clean and sample the annotations; returns the stored table.

    Tasks ask for each annotated file; ``listing=True`` lists the image folder in tasks
    instead, which suits folders with few other files. ``multi_line`` says whether quoted fields of
    the CSV span lines; by default the file is read once more to see. What the clean rows were
    left of is counted by the job that writes them, and stored as ``load_audit``.
    """
    image_root = qualified(spark, image_root)
    read_annotations(spark, csv, multi_line).write.mode("overwrite").parquet(work.path("raw"))
    raw = spark.read.parquet(work.path("raw"))
    files = (
        manifest(spark, image_root, work.path("manifest"))
        if listing
        else existing_images(clean.resolved_paths(raw, image_root))
    )
    counts = Observation("load")
    kept = clean.cleaned_and_counted(
        raw, files, counts, image_root, missing_box, settled(clean.hot_images(raw, image_root))
    )
    if sample_size is not None:  # the sample may take several passes over clean rows
        kept.write.mode("overwrite").parquet(work.path("clean"))
        kept = sample.sample_rows(spark.read.parquet(work.path("clean")), sample_size, seed)
    kept.write.mode("overwrite").parquet(work.path("annotations"))
    seen = counts.get
    seen["subset_rows"] = seen["usable_rows"] if sample_size is None else min(seen["usable_rows"], sample_size)
    _counted(spark, seen, work.path("load_audit"))
    return spark.read.parquet(work.path("annotations"))


def _counted(spark: SparkSession, counts: dict[str, int], path: str) -> None:
    schema = ", ".join(f"{name} bigint" for name in counts)
    spark.createDataFrame([tuple(counts.values())], schema).coalesce(1).write.mode("overwrite").parquet(path)


def _score_runs(
    spark: SparkSession,
    work: Workspace,
    rows: DataFrame,
    images: DataFrame | Images,
    factories: Factories,
    model: str,
    context: str,
    key: list[str],
    batch: str,
    tasks: int | None,
    csv: bool = False,
) -> DataFrame:
    keys = select_models(model)
    hot = settled(hot_hashes(rows, ["image_key"] if key == ["image_path"] else key))
    person = list(resume.PERSON_KEY)
    hot_boxes = hot if key == person else settled(hot_hashes(rows, person))
    path = work.path("results")
    stored = stores.read_results(spark, path, context=context, without_batch=batch)
    # Stored first: whether anything is left and what to score are asked of the same table.
    resume.outstanding(rows, stored, keys, hot=hot_boxes).write.mode("overwrite").parquet(work.path("outstanding"))
    left = spark.read.parquet(work.path("outstanding"))
    if stored is None or not left.isEmpty():  # else done: no image is opened
        if isinstance(images, DataFrame):
            run = _scored_apart(left, images, factories, keys, context, key, tasks, hot)
        else:
            run = score_models(left, images, factories, context, key, tasks, hot)
        stores.write_results(run.withColumn("context", F.lit(context)), path, batch)
        empty = run.limit(0)
    results = stores.read_results(spark, path, context=context)
    if results is None:  # nothing to score so far, which still has metrics
        results = empty.withColumn("context", F.lit(context)).withColumn("batch", F.lit("run-"))
    _measure(spark, results, runs(spark, keys, (context,)), work, batch)
    if csv:
        stores.write_results_csv(results.where(F.col("model_key").isin(keys)), work.path("results_csv"))
    return results


def _scored_apart(
    left: DataFrame, images: DataFrame, factories: Factories, keys: list[str], context: str, key: list[str],
    tasks: int | None, hot: DataFrame | None,
) -> DataFrame:
    """Rows scored from a table of pixels, which each model takes anew."""
    made = []
    for name in keys:
        mine = left.withColumn("_need", F.get(F.filter("needs", lambda n: n["model_key"] == name), F.lit(0)))  # noqa: B023
        mine = mine.where("_need IS NOT NULL").select("*", "_need.attempt").drop("needs", "_need")
        made.append(score(mine, images, factories[name], context, key, tasks, hot=hot).withColumn("model_key", F.lit(name)))
    return reduce(DataFrame.unionByName, made)


def _measure(spark: SparkSession, results: DataFrame, requested: DataFrame, work: Workspace, batch: str) -> None:
    """Reports of the requested runs from the counts kept for each batch of results.

    Only batches without counts, and the one just written, are read and counted. Counts add up,
    also where rows were scored again: an attempt that another replaces has no parsed answer.
    """
    stores.write_batch_cells(spark, work.path("cells"), results, requested, batch)
    cells = stores.read_cells(spark, work.path("cells"), requested)
    stores.write_report(metrics.confusion(cells), work.path("confusion"))
    stores.write_report(metrics.class_report(cells), work.path("report"))
    stores.write_report(metrics.run_notes(cells), work.path("notes"))
    stores.write_metrics(metrics.metrics(cells), work.path("metrics"))


def run_full(
    spark: SparkSession,
    work: Workspace,
    image_root: str,
    factories: Factories,
    model: str = "all",
    batch: str | None = None,
    tasks: int | None = None,
    encoded: bool = False,
    decode: Callable[[bytes], Any] = decode_image,
    listing: bool = False,
    csv: bool = False,
) -> DataFrame:
    """Score whole images, going on from stored results; returns all of them.

    All models are asked in one pass: each image that any of them needs is opened once, by the task
    that scores it. Predictors get what ``decode`` makes of the file, or with ``encoded=True`` its
    bytes. With ``listing=True`` Spark's image source lists the folder and decodes it all, for
    sites without a Python decoder. With ``csv=True`` the results of the models named are written as
    CSV too, a folder per model and context. Rows are stored under ``batch``, a new name by default. Naming
    the batch of a run that failed replaces what that run has stored.
    """
    rows = spark.read.parquet(work.path("annotations"))
    images = read_images(spark, qualified(spark, image_root)) if listing else FileImages(None if encoded else decode)
    return _score_runs(
        spark, work, rows, images, factories, model, FULL, ["image_path"], _name(batch), tasks, csv
    )


def cut(
    spark: SparkSession,
    work: Workspace,
    image_root: str,
    crop_root: str,
    batch: str | None = None,
    decode: Callable[[bytes], Any] = decode_image,
    listing: bool = False,
) -> DataFrame:
    """Cut boxes not cut before, once for all models; returns annotations with outcomes.

    Images are opened by the tasks that cut them; ``listing=True`` as in ``run_full``.
    """
    batch = _name(batch)
    rows = spark.read.parquet(work.path("annotations"))
    done = stores.read_crops(spark, work.path("crops"), without_batch=batch)
    hot = settled(hot_hashes(rows, ["image_key"]))
    if listing:
        cuts = crop.cut_crops(rows, read_images(spark, qualified(spark, image_root)), crop_root, done, hot)
    else:
        cuts = crop.cut_opened(rows, FileImages(decode), crop_root, done, hot)
    stores.write_crops(cuts, work.path("crops"), batch)
    outcomes = stores.read_outcomes(spark, work.path("crops"), batch)
    counts = Observation("crops")
    outcome = crop.counted_outcomes(crop.with_crops(rows, outcomes, settled(hot_hashes(rows, crop.CROP_KEY))), counts)
    outcome.write.mode("overwrite").parquet(work.path("cropped"))
    _counted(spark, counts.get, work.path("crop_audit"))
    cropped = spark.read.parquet(work.path("cropped"))
    stores.write_csv(crop.crop_failures(cropped), work.path("crop_failures"))
    return cropped


def run_face(
    spark: SparkSession,
    work: Workspace,
    image_root: str,
    crop_root: str,
    factories: Factories,
    model: str = "all",
    batch: str | None = None,
    tasks: int | None = None,
    decode: Callable[[bytes], Any] = decode_image,
    listing: bool = False,
    csv: bool = False,
) -> DataFrame:
    """Cut and score crops, going on from stored results; returns all of them.

    Crops are looked up by where they are stored; the tasks that score them read their pixels.
    ``csv`` as in ``run_full``.
    """
    batch = _name(batch)
    usable = crop.usable_crops(cut(spark, work, image_root, crop_root, batch, decode, listing))
    places = stores.crop_places(spark, work.path("crops"))
    pictures = StoredImages(places if places is not None else usable.selectExpr(*crop.CROP_KEY, "'' AS file", "0L AS at"))
    return _score_runs(
        spark, work, usable, pictures, factories, model, FACE, crop.CROP_KEY, batch, tasks, csv
    )


def _kept(df: DataFrame, work: Workspace, name: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """Store a table of the analysis and read it back."""
    path = work.path(f"analysis/{name}")
    df.write.mode("overwrite").partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_analysis(spark: SparkSession, work: Workspace) -> dict[str, DataFrame]:
    """All comparison tables over what the two scoring jobs have stored, stored in turn.

    Pairs are made once and stored by kind, so that helped and hurt rows and the counts
    come from their own part of the store.
    """
    measured = stores.read_metrics(spark, work.path("metrics"))
    if measured is None or measured.where(F.col("context") == FULL).isEmpty():
        raise ValueError("no full-image results yet; run the full-image job first")
    results = stores.read_results(spark, work.path("results"))
    matrix = stores.read_confusion(spark, work.path("confusion"), measured)
    hot_persons = settled(hot_hashes(results, ["model_key", *resume.PERSON_KEY]))
    pairs = _kept(compare.with_kind(compare.context_pairs(results, hot_persons)), work, "pairs", ("kind",))
    hot_images = settled(hot_hashes(results, ["model_key", "image_path"]))
    by_image = _kept(compare.pairs_by_image(results, hot_images), work, "pairs_by_image")
    stores.write_comparison(measured, work.path("comparison"))
    tables = {
        "f1_compare": compare.f1_compare(measured),
        "recall_compare": compare.recall_compare(metrics.class_recall(matrix)),
        "confusion_rates": metrics.confusion_rates(matrix),
        "context_helped": compare.context_helped(pairs.where("kind = 'helped'")),
        "context_hurt": compare.context_hurt(pairs.where("kind = 'hurt'")),
        "context_cases": compare.context_cases(pairs),
        "context_helped_by_image": compare.cases_by_image(results, by_image, helped=True),
        "context_hurt_by_image": compare.cases_by_image(results, by_image, helped=False),
        "context_cases_by_image": compare.context_cases_by_image(by_image),
        "sample_per_label": sample.first_per_label(results),
        "answered": answered(results),
    }
    kept = {name: _kept(table, work, name) for name, table in tables.items()}
    return {"comparison": compare.comparison(measured)} | kept
