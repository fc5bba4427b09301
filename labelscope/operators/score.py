"""Batch scoring through a pluggable predictor."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.domain import UNKNOWN
from labelscope.functions.paths import with_image_key
from labelscope.functions.pixels import NoCodec
from labelscope.functions.text import prompt_for, with_parsed_label
from labelscope.operators.joins import lookup_join


_BY_FILE = ("image_path",)


class Predictor(ABC):
    """Answers one prompt about one image.

    Tasks build it from a picklable factory, call ``load`` once, then ``predict``
    per image. An exception from ``predict`` spoils that row only.
    """

    def load(self) -> None:
        """Open whatever the predictor needs; runs once per task."""

    @abstractmethod
    def predict(self, image: Any, prompt: str) -> str | None:
        """Raw text answer."""


def answered(results: DataFrame) -> DataFrame:
    """Rows with an answer; a null prediction is not ``Unknown`` and stays."""
    return results.where(~F.col("predicted_label").eqNullSafe(UNKNOWN))


def with_status(
    rows: DataFrame,
    images: DataFrame,
    key: Sequence[str] = ("image_path",),
    hot: DataFrame | None = None,
) -> DataFrame:
    """Flag rows whose image can be opened; the others get no answer and Unknown.

    A key of image_path only means the file, however it is spelled.
    """
    kept = rows.columns
    if tuple(key) == _BY_FILE:
        rows, images, key = with_image_key(rows), with_image_key(images), ["image_key"]
    found = images.select(*key).withColumn("_hit", F.lit(True))
    return lookup_join(rows, found, key, hot=hot).select(*kept, F.col("_hit").isNotNull().alias("scorable"))


def _answers(
    factory: Callable[[], Predictor], prompt: str, keep: list[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = None
        for batch in batches:
            if predictor is None:
                predictor = factory()
                predictor.load()
            texts, errors = [], []
            for image, failed in zip(batch["image"], batch["read_error"].to_pylist(), strict=True):
                text, error = None, failed
                try:
                    if failed is not None:
                        raise OSError(failed)
                    text = predictor.predict(image.as_py(), prompt)
                    if not (text is None or isinstance(text, str)):
                        error, text = f"an answer of type {type(text).__name__}", None
                except Exception as failure:  # one bad row must not end the job
                    error = str(failure) or type(failure).__name__
                texts.append(text)
                errors.append(error)
            kept = batch.select(keep)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                [*kept.schema.names, "raw_output", "error"],
            )

    return run


def score(
    rows: DataFrame,
    images: DataFrame | Callable[[DataFrame], DataFrame],
    factory: Callable[[], Predictor],
    context: str,
    key: Sequence[str] = ("image_path",),
    tasks: int | None = None,
    once_per_image: bool = True,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add raw_output, predicted_label and error to every row.

    ``images`` has one row per readable image: the ``key`` columns and ``image``,
    whatever the predictor takes. It can also be a function from distinct keys to such
    rows, like ``fetch_images``, which saves shuffling the images. A row without an
    image never reaches the predictor.

    Requests are sent at temperature 0, so an image is asked about once and the
    answer is shared by its rows; pass ``once_per_image=False`` for a predictor that
    must see every row. ``tasks`` bounds how many predictors work at a time.

    A key of image_path only means the file, however a row or the images spell it. Images
    may come with ``read_error``: such a row is not asked about and gets that error.
    """
    rows = rows.drop("raw_output", "predicted_label", "error")
    kept, fetched, fetch = rows.columns, callable(images), images
    if tuple(key) == _BY_FILE:
        rows, key = with_image_key(rows), ["image_key"]
        if fetched:
            fetch = lambda keys: images(keys.toDF("image_path")).withColumnRenamed("image_path", "image_key")
        else:
            images = with_image_key(images)
    keys = rows.select(*key).distinct()
    if fetched:
        images = fetch(keys.repartition(tasks) if tasks else keys)
    failed = F.col("read_error") if "read_error" in images.columns else F.lit(None).cast("string")
    pictures = images.select(*key, "image", failed.alias("read_error"))
    if once_per_image:
        keep = list(key)
        asked = pictures if fetched else keys.join(pictures, keep)
    else:
        keep = ["row_id"]
        asked = lookup_join(rows.select("row_id", *key), pictures, key, "inner", hot)
    asked = asked.select(*keep, "image", "read_error")
    if tasks and not (fetched and once_per_image):
        asked = asked.repartition(tasks)
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    answers = asked.mapInArrow(
        _answers(factory, prompt_for(context), keep),
        ", ".join([*fields, "raw_output string", "error string"]),
    )
    # Never a broadcast: answers may take longer to come than a broadcast may wait.
    answers = answers.hint("merge")
    answered_rows = lookup_join(rows, answers, keep, hot=hot if once_per_image else None)
    return with_parsed_label(answered_rows.select(*kept, "raw_output", "error"))


# --- several models in one pass ---------------------------------------------------


class Images(Protocol):
    """Where a task gets images from, one at a time."""

    def placed(self, keys: DataFrame, tasks: int | None = None) -> DataFrame:
        """The keys that have an image, with the columns ``reader`` needs, dealt over tasks."""

    def reader(self) -> Callable[[dict], Any]:
        """In a task: a function from a placed row to its image, or None."""


_ANSWER = "struct<model_key:string,raw_output:string,error:string>"
_ARROW_ANSWERS = pa.list_(pa.struct([(name, pa.string()) for name in ("model_key", "raw_output", "error")]))


def _answer(predictor: Predictor, image: Any, prompt: str) -> tuple[str | None, str | None]:
    try:
        text = predictor.predict(image, prompt)
    except Exception as failure:  # one bad row must not end the job
        return None, str(failure) or type(failure).__name__
    if text is None or isinstance(text, str):
        return text, None
    return None, f"an answer of type {type(text).__name__}"


def _asked_once(
    factories: Mapping[str, Callable[[], Predictor]], images: Images, prompt: str, keep: list[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictors: dict[str, Predictor] = {}
        image_of = images.reader()
        for batch in batches:
            answers = []
            for row in batch.drop_columns(["_models"]).to_pylist() if batch.num_rows else []:
                try:
                    image, failed = image_of(row), None
                except NoCodec:
                    raise
                except OSError as failure:  # throttled, forbidden: worth another run
                    image, failed = None, f"read: {failure or type(failure).__name__}"
                except Exception as failure:
                    image, failed = None, f"decode: {failure or type(failure).__name__}"
                told = []
                for name in batch["_models"][len(answers)].as_py():
                    text, error = None, failed
                    if image is not None:
                        if name not in predictors:
                            predictors[name] = factories[name]()
                            predictors[name].load()
                        text, error = _answer(predictors[name], image, prompt)
                    told.append({"model_key": name, "raw_output": text, "error": error})
                answers.append(told)
            kept = batch.select(keep)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(answers, _ARROW_ANSWERS)], [*keep, "_answers"])

    return run


def score_models(
    rows: DataFrame,
    images: Images,
    factories: Mapping[str, Callable[[], Predictor]],
    context: str,
    key: Sequence[str] = ("image_path",),
    tasks: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Scored rows of all models that ``needs`` names, in one pass over the images.

    ``needs`` (see ``outstanding``) says which models a row is for. Each image is opened once, in the
    task that asks about it, and shown to every model some row of it needs; pixels are never part
    of a row that is joined or shuffled. Per row and model the result has ``model_key``, ``attempt``,
    ``raw_output``, ``predicted_label`` and ``error``. A row whose image is not there has neither
    answer nor error; read errors begin with "read: ", undecodable files with "decode: ".
    """
    rows = rows.drop("raw_output", "predicted_label", "error", "model_key", "attempt")
    kept = [c for c in rows.columns if c != "needs"]
    if tuple(key) == _BY_FILE:
        rows, key = with_image_key(rows), ["image_key"]
    wanted = rows.select(*key, F.explode("needs.model_key").alias("_model"))
    keys = wanted.groupBy(*key).agg(F.sort_array(F.collect_set("_model")).alias("_models"))
    asked = images.placed(keys, tasks)
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key]
    answers = asked.mapInArrow(
        _asked_once(factories, images, prompt_for(context), list(key)), ", ".join([*fields, f"_answers array<{_ANSWER}>"])
    )
    # Never a broadcast: answers may take longer to come than a broadcast may wait.
    joined = lookup_join(rows, answers.hint("merge"), key, hot=hot)
    each = joined.select(*kept, "_answers", F.inline("needs").alias("model_key", "attempt"))
    told = F.filter("_answers", lambda a: a["model_key"] == F.col("model_key"))
    with_answer = each.withColumn("_told", F.get(told, F.lit(0)))
    return with_parsed_label(with_answer.select(*kept, "model_key", "attempt", "_told.raw_output", "_told.error"))
