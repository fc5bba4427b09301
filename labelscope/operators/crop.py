"""Cropping annotated boxes: the plan, the cache, the pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from labelscope.domain import BOX, INVALID_BOX, UNREADABLE
from labelscope.functions.boxes import clamped, crop_fail_reason, valid_box
from labelscope.functions.paths import crop_name, join_path, with_image_key
from labelscope.functions.pixels import NoCodec
from labelscope.operators.joins import lookup_join, sliced

if TYPE_CHECKING:
    from labelscope.operators.score import Images

# A crop is told apart by its image and full box. The file name holds only 48
# bits of their hash, too few to tell billions of boxes apart.
CROP_KEY = ["image_path", *BOX]
PIXELS = "struct<height:int,width:int,nChannels:int,mode:int,data:binary>"
_BGR_MODE = 16  # CV_8UC3, three bytes per pixel


def _crop_path(crop_root: str) -> Column:
    return join_path(crop_root, crop_name())


def crop_plan(
    annotations: DataFrame,
    images: DataFrame,
    crop_root: str = "",
    cached: DataFrame | None = None,
    hot: DataFrame | None = None,
    hot_boxes: DataFrame | None = None,
) -> DataFrame:
    """Add cropped_path, crop_failed, crop_fail_reason from image sizes alone.

    ``images`` has one row per image_path with width and height. ``cached`` holds
    boxes cut before: they succeed without a look at the image. ``hot`` has hot hashes of
    image_key, ``hot_boxes`` of the image and box.
    """
    sized = _sized(annotations, images, hot)
    if cached is None:
        sized = sized.withColumn("_cached", F.lit(False))
    else:
        sized = with_cache_flag(sized, cached, "_cached", hot_boxes)
    reason = crop_fail_reason("width", "height", "_cached")
    return (
        sized.withColumn("crop_fail_reason", reason)
        .withColumn("crop_failed", F.col("crop_fail_reason").isNotNull())
        .withColumn("cropped_path", F.when(~F.col("crop_failed"), _crop_path(crop_root)))
        .drop("width", "height", "_cached")
    )


def _sized(rows: DataFrame, images: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Add the width and height of each row's image, however its path is spelled."""
    sizes = with_image_key(images).select("image_key", "width", "height")
    sized = lookup_join(with_image_key(rows), sizes, ["image_key"], hot=hot)
    return sized if "image_key" in rows.columns else sized.drop("image_key")


def with_cache_flag(
    annotations: DataFrame, cached: DataFrame, name: str = "cached", hot: DataFrame | None = None
) -> DataFrame:
    """Flag boxes that are already in the crop store."""
    return (
        lookup_join(annotations, cached.select(*CROP_KEY), CROP_KEY, hot=hot, collapse=_hits)
        .withColumn(name, F.col("_hit").isNotNull())
        .drop("_hit")
    )


def _hits(done: DataFrame, keys: list[str]) -> DataFrame:
    return done.select(*keys).distinct().withColumn("_hit", F.lit(True))


def cut_regions(plan: DataFrame, images: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Add the region of each box that lies inside its image."""
    sides = zip(("cut_x1", "cut_y1", "cut_x2", "cut_y2"), clamped("width", "height"), strict=True)
    return (
        _sized(plan, images, hot)
        .withColumns({name: F.expr(side) for name, side in sides})
        .drop("width", "height")
    )


def usable_crops(plan: DataFrame) -> DataFrame:
    return plan.where(~F.col("crop_failed"))


def crop_failures(plan: DataFrame) -> DataFrame:
    return plan.where("crop_failed").select("image_path", "label", "crop_fail_reason", *BOX)


def crop_audit(plan: DataFrame) -> DataFrame:
    """Counts of good and failed crops, by reason; clamp messages count as one."""
    return plan.groupBy(_outcome().alias("outcome")).agg(F.count("*").alias("n_rows"))


def _outcome() -> Column:
    return F.when(F.startswith("crop_fail_reason", F.lit("Bbox clamped")), "clamped_empty").otherwise(
        F.coalesce("crop_fail_reason", F.lit("ok"))
    )


def counted_outcomes(plan: DataFrame, counts: Observation) -> DataFrame:
    """``plan`` as it is; ``counts`` has its audit once a job over all of it is done.

    Reasons that begin alike are one outcome: ``read`` stands for every failed read.
    """
    known = {"ok": "ok", "invalid_bbox": INVALID_BOX, "clamped_empty": "clamped_empty", "unreadable": UNREADABLE}
    each = [F.count_if(_outcome() == value).alias(name) for name, value in known.items()]
    return plan.observe(counts, *each, F.count_if(F.startswith(_outcome(), F.lit("read: "))).alias("read"))


# --- pixels ------------------------------------------------------------------


def bgr_array(image: dict) -> np.ndarray:
    """Pixels of an image row as height x width x 3, blue first; alpha is dropped."""
    pixels = np.frombuffer(image["data"], dtype=np.uint8)
    pixels = pixels.reshape(image["height"], image["width"], image["nChannels"])
    return np.repeat(pixels, 3, axis=2) if image["nChannels"] == 1 else pixels[:, :, :3]


def rgb_array(image: dict) -> np.ndarray:
    return bgr_array(image)[:, :, ::-1]


def _cut(image: dict, box: list[int]) -> dict:
    x1, y1, x2, y2 = box
    part = np.ascontiguousarray(bgr_array(image)[y1:y2, x1:x2])
    return {
        "height": y2 - y1, "width": x2 - x1, "nChannels": 3, "mode": _BGR_MODE,
        "data": part.tobytes(),
    }


_PIXELS_ARROW = pa.struct([
    ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()),
    ("data", pa.binary()),
])


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts, reasons = [], []
        # One image at a time: only the cut parts of a batch are held together.
        for image, box, known in zip(batch["image"], batch["cut"], batch["crop_fail_reason"], strict=True):
            part, reason = None, known.as_py()
            if reason is None:
                try:
                    part = _cut(image.as_py(), box.as_py())
                except Exception as error:  # one bad image must not end the job
                    reason = str(error) or type(error).__name__
            cuts.append(part)
            reasons.append(reason)
        kept = batch.select([*CROP_KEY, "cropped_path"])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(reasons, pa.string()), pa.array(cuts, _PIXELS_ARROW)],
            [*kept.schema.names, "crop_fail_reason", "image"],
        )


_CUT_SCHEMA = (
    "image_path string, bbox_x1 bigint, bbox_y1 bigint, bbox_x2 bigint, bbox_y2 bigint, "
    f"cropped_path string, crop_fail_reason string, image {PIXELS}"
)
_CUT_BYTES = 4 * 2**20  # pixels handed on at once


def _opened(image_of: Callable[[dict], Any], key: str) -> tuple[dict | None, str | None]:
    """An image and why there is none."""
    try:
        image = image_of({"image_key": key})
    except NoCodec:
        raise
    except OSError as failure:  # tried again by the next run, as all failed crops are
        return None, f"read: {failure or type(failure).__name__}"
    except Exception:  # one bad image must not end the job
        return None, UNREADABLE
    return image, None if image is not None else UNREADABLE


def _inside(image: dict, box: list[int]) -> tuple[list[int], str | None]:
    """The box cut to the image, and why nothing is left of it."""
    part = [max(0, box[0]), max(0, box[1]), min(image["width"], box[2]), min(image["height"], box[3])]
    empty = part[2] <= part[0] or part[3] <= part[1]
    return part, f"Bbox clamped to empty region ({part[0]},{part[1]},{part[2]},{part[3]})" if empty else None


def _part(image: dict, box: list[int]) -> np.ndarray:
    """A copy of the bytes ``_cut`` gives, without a whole image in other channels on the way."""
    pixels = np.frombuffer(image["data"], dtype=np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    part = pixels[box[1]:box[3], box[0]:box[2]]
    return np.repeat(part, 3, axis=2).ravel() if image["nChannels"] == 1 else part[:, :, :3].flatten()


def _pixel_rows(parts: list[np.ndarray | None], boxes: list[list[int]]) -> pa.StructArray:
    """Image structs of the parts; a missing one is null."""
    offsets = np.cumsum([0, *[0 if p is None else len(p) for p in parts]], dtype=np.int32)
    held = np.concatenate([np.zeros(0, np.uint8), *[p for p in parts if p is not None]])
    data = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    sides = np.array([(0, 0) if p is None else (b[3] - b[1], b[2] - b[0]) for p, b in zip(parts, boxes, strict=True)], np.int32)
    height, width = sides.reshape(-1, 2).T
    same = [np.full(len(parts), value, np.int32) for value in (3, _BGR_MODE)]
    columns = [*[pa.array(np.ascontiguousarray(c)) for c in (height, width, *same)], data]
    return pa.StructArray.from_arrays(columns, fields=list(_PIXELS_ARROW), mask=pa.array([p is None for p in parts], pa.bool_()))


def _cut_runs(images: Images) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow: boxes sorted by image to crops; an image is opened once for a run of its boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image_of, key, image, missing = images.reader(), None, None, None
        for batch in batches:
            parts, regions, reasons, size, first = [], [], [], 0, 0
            kept = batch.select([*CROP_KEY, "cropped_path"])
            boxes = zip(*(batch[c].to_pylist() for c in BOX), strict=True)
            for n, (of, box) in enumerate(zip(batch["image_key"].to_pylist(), boxes, strict=True), 1):
                if of != key:
                    key, (image, missing) = of, _opened(image_of, of)
                region, reason = (None, missing) if missing else _inside(image, list(box))
                parts.append(None if reason else _part(image, region))
                regions.append(region)
                reasons.append(reason)
                size += 0 if reason else len(parts[-1])
                if size >= _CUT_BYTES or n == batch.num_rows:
                    rows = kept.slice(first, n - first)
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(reasons, pa.string()), _pixel_rows(parts, regions)],
                        [*rows.schema.names, "crop_fail_reason", "image"],
                    )
                    parts, regions, reasons, size, first = [], [], [], 0, n

    return run


def cut_opened(
    annotations: DataFrame,
    images: Images,
    crop_root: str = "",
    cached: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Pixels of every distinct box not cut yet, one row per box, from images opened in the task.

    Boxes are shuffled, not pixels: they are dealt by image (a hot image over slices, by the box)
    and sorted by it, so a task opens an image once for all its boxes there and holds no other.
    Rows that cannot be cut carry a reason and no pixels. ``hot`` has hot hashes of image_key.
    """
    boxes = with_image_key(annotations).select(*CROP_KEY, "image_key").where(valid_box()).distinct()
    if cached is not None:
        boxes = lookup_join(boxes, cached.select(*CROP_KEY).distinct(), CROP_KEY, "left_anti")
    dealt = sliced(boxes, ["image_key"], hot, CROP_KEY).repartition("image_key", "_slice")
    runs = dealt.sortWithinPartitions("image_key", *BOX).withColumn("cropped_path", _crop_path(crop_root))
    return runs.select(*CROP_KEY, "image_key", "cropped_path").mapInArrow(_cut_runs(images), _CUT_SCHEMA)


def cut_crops(
    annotations: DataFrame,
    images: DataFrame,
    crop_root: str = "",
    cached: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Pixels of every distinct box not cut yet, one row per box, from a table of pixels.

    ``images`` comes from ``read_images``. Its pixels are shuffled to the boxes; ``cut_opened`` does
    without. Rows that cannot be cut carry a reason
    and no pixels. Repeated boxes collapse before any pixel moves, and the pixels of
    an image go to Python only for boxes that pass the column checks.
    """
    boxes = annotations.select(*CROP_KEY).where(valid_box()).distinct()
    if cached is not None:
        boxes = lookup_join(boxes, cached.select(*CROP_KEY).distinct(), CROP_KEY, "left_anti")
    pictures = with_image_key(images).select("image_key", "image")
    joined = lookup_join(with_image_key(boxes), pictures, ["image_key"], hot=hot, spread=CROP_KEY)
    size = ("image.width", "image.height")
    ready = (
        joined.withColumn("crop_fail_reason", crop_fail_reason(*size))
        .withColumn("cropped_path", _crop_path(crop_root))
        .withColumn("cut", F.array(*[F.expr(side) for side in clamped(*size)]))
        .withColumn("image", F.when(F.col("crop_fail_reason").isNull(), F.col("image")))
    )
    return ready.select(*CROP_KEY, "cropped_path", "crop_fail_reason", "cut", "image").mapInArrow(
        _cut_batches, _CUT_SCHEMA
    )


def _per_box(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    return outcomes.groupBy(*keys).agg(
        F.max("cropped_path").alias("_path"),
        F.bool_and(F.col("crop_fail_reason").isNotNull()).alias("_failed"),
        F.max("crop_fail_reason").alias("_why"),
    )


def with_crops(annotations: DataFrame, cuts: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Add the outcome of ``cut_crops`` (stored or fresh) to every annotation."""
    outcomes = cuts.select(*CROP_KEY, "cropped_path", "crop_fail_reason")
    reason = F.when(~valid_box(), INVALID_BOX).when(
        F.coalesce("_failed", F.lit(True)), F.coalesce("_why", F.lit("not cut"))
    )
    return (
        lookup_join(annotations, outcomes, CROP_KEY, hot=hot, collapse=_per_box)
        .withColumn("crop_fail_reason", reason)
        .withColumn("crop_failed", F.col("crop_fail_reason").isNotNull())
        .withColumn("cropped_path", F.when(~F.col("crop_failed"), F.col("_path")))
        .drop("_path", "_failed", "_why")
    )
