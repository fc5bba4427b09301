"""Annotations, images and answers derived from the event and embedding tables.

The given tables hold no images. Every event becomes one annotation by integer
arithmetic, so the same frames can be written in any SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.domain import CLASSES, FACE, FULL
from labelscope.functions.text import with_parsed_label
from labelscope.operators.clean import clean_annotations
from labelscope.operators.crop import crop_plan
from labelscope.operators.score import Predictor

ROOT, CROP_ROOT = "/data", "/crops"
EVENTS = "event_id bigint, user_id bigint, event_type string, props string"

# model, context and the shift of its answers; one model has no face run.
RUNS = [("qwen", FULL, 3), ("qwen", FACE, 6), ("llava", FULL, 7), ("llava", FACE, 10), ("internvl", FULL, 11)]


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "vec_id bigint, embedding array<float>, label int"
    return spark.read.schema(schema).parquet(f"{sf_dir}/embeddings.parquet")


_NAMES = "array(" + ", ".join(f"'{c}'" for c in CLASSES) + ")"
_SUFFIX = "CASE WHEN no % 5 = 0 THEN '' WHEN no % 7 = 0 THEN '.tar.PNG' ELSE '.jpg' END"
_LISTED = f"concat('{ROOT}/img/', no, {_SUFFIX}) AS image_path"


def _class_at(number: str) -> str:
    return f"element_at({_NAMES}, cast(({number}) % 26 + 1 AS int))"


def _numbered(events: DataFrame) -> DataFrame:
    """Events with the number of the image they belong to, three events each."""
    return events.withColumn("no", F.expr("event_id - event_id % 3"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"))


def raw_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_annotations(spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"))


def as_annotations(events: DataFrame) -> DataFrame:
    """One loosely formatted annotation per event; some point at files never listed."""
    x1, y1 = "(event_id * 7 + user_id) % 420 - 40", "(event_id * 5 + user_id) % 300 - 30"
    name = _class_at("event_id")
    return _numbered(events).selectExpr(
        "event_id AS row_id",
        f"""concat(if(event_id % 17 = 0, '  ', ''), if(no % 37 = 1, 'lost/', 'img/'), no, {_SUFFIX})
            AS image_path""",
        f"""CASE WHEN event_id % 29 = 0 THEN 'Boredom'
            WHEN event_id % 31 = 0 THEN concat('\t', {name}, '\u00a0') ELSE {name} END AS label""",
        f"cast({x1} AS double) + 0.5D AS bbox_x1",
        f"cast({y1} AS double) AS bbox_y1",
        f"cast({x1} + (event_id * 13) % 200 - 10 AS double) AS bbox_x2",
        f"cast({y1} + (event_id * 11) % 150 - 5 AS double) AS bbox_y2",
        "event_type",
    )


def spelled(raw: DataFrame) -> DataFrame:
    """Annotations some of which spell the path of their file in a roundabout way."""
    other = """CASE row_id % 7 WHEN 1 THEN concat('./', trim(image_path)) WHEN 2 THEN concat('skip/../', trim(image_path))
        WHEN 3 THEN replace(trim(image_path), '/', '//') ELSE image_path END"""
    return raw.withColumn("image_path", F.expr(other))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of image files with their sizes."""
    return _events(spark, sf_dir).select("no").distinct().selectExpr(
        _LISTED, "cast(320 + 80 * (no % 5) AS int) AS width", "cast(240 + 60 * (no % 4) AS int) AS height"
    )


def image_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text per image in place of its pixels: the props of all its events, in event order."""
    told = F.sort_array(F.collect_list(F.struct("event_id", "props")))  # three events an image
    whole = F.array_join(F.transform(told, lambda e: e["props"]), "")
    return _events(spark, sf_dir).groupBy("no").agg(whole.alias("image")).selectExpr(_LISTED, "image")


class RampImages:
    """Pixels of an image file at its listed size: byte i is (i + number) mod 256.

    The files do not exist; a task makes the pixels of an image when it opens it.
    """

    def placed(self, keys: DataFrame, tasks: int | None = None) -> DataFrame:
        return keys.repartition(tasks) if tasks else keys

    def reader(self) -> Callable[[dict], dict]:
        ramp = memoryview(bytes(range(256)) * 4000)  # longer than any image; pixels are views of it

        def image(row: dict) -> dict:
            no = int(row["image_key"].rsplit("/", 1)[1].split(".")[0])
            width, height = 320 + 80 * (no % 5), 240 + 60 * (no % 4)
            start = no % 256
            return {
                "height": height, "width": width, "nChannels": 3, "mode": 16,
                "data": ramp[start:start + height * width * 3],
            }

        return image


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_annotations(raw_annotations(spark, sf_dir), images(spark, sf_dir), ROOT)


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_plan(annotations(spark, sf_dir), images(spark, sf_dir), CROP_ROOT)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers of every run: full for each annotation, face for each usable crop."""
    runs = ", ".join(
        f"named_struct('model_key', '{m}', 'context', '{c}', 'shift', {s})" for m, c, s in RUNS
    )
    right, other = _class_at("row_id"), _class_at("row_id * 7 + 3")
    scored = f"inline(filter(array({runs}), r -> r.context = '{FULL}' OR NOT crop_failed))"
    raw = f"""CASE (row_id * 7 + shift) % 10
        WHEN 0 THEN {right}
        WHEN 1 THEN concat(lower({right}), '.')
        WHEN 2 THEN concat('The person shows ', upper({right}), ' clearly.')
        WHEN 3 THEN {other}
        WHEN 4 THEN concat('Not ', {other}, ' but ', {right})
        WHEN 5 THEN 'I cannot tell'
        WHEN 6 THEN NULL
        WHEN 7 THEN concat(' ..', {other}, '.. ')
        WHEN 8 THEN {right}
        ELSE '' END AS raw_output"""
    return crops(spark, sf_dir).selectExpr("*", scored).selectExpr("*", raw).drop("shift")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parsed_label(answers(spark, sf_dir))


class PropsPredictor(Predictor):
    """Answers from the number in an image's text; refuses some images."""

    def load(self) -> None:
        self.names = CLASSES

    def predict(self, image: str, prompt: str) -> str | None:
        number = int("".join(ch for ch in image if ch.isdigit()))
        if number % 13 == 0:
            raise ValueError(f"cannot look at {number}")
        shift = 1 if prompt.startswith("Full") else 5
        return f" {self.names[(number + shift) % 26].lower()}. "


class FirstByte(Predictor):
    """Answers from the first byte of an image's pixels."""

    def __init__(self, shift: int = 0) -> None:
        self.shift = shift

    def load(self) -> None:
        self.names = CLASSES

    def predict(self, image: dict, prompt: str) -> str:
        return f"I see {self.names[(image['data'][0] + self.shift) % 26]}"


class PropsImages:
    """The texts of ``image_contents`` looked up in a table, some of them unreadable at first.

    ``failing`` is a remainder of the image's number by 11, -1 for none.
    """

    def __init__(self, contents: DataFrame, failing: int = -1) -> None:
        self.contents, self.failing = contents, failing

    def placed(self, keys: DataFrame, tasks: int | None = None) -> DataFrame:
        return keys.join(self.contents.withColumnRenamed("image_path", "image_key"), "image_key")

    def reader(self) -> Callable[[dict], str]:
        failing = self.failing

        def image(row: dict) -> str:
            if int(row["image_key"].rsplit("/", 1)[1].split(".")[0]) % 11 == failing:
                raise OSError("throttled")
            return row["image"]

        return image

    def __getstate__(self) -> dict:
        return {"failing": self.failing, "contents": None}  # tasks only read
