"""The jobs end to end, with files, and the stream."""

import json
from functools import partial
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.domain import CLASSES, FULL
from labelscope.operators.crop import rgb_array
from labelscope.operators.score import Predictor, score
from labelscope.plans import tasks
from labelscope.sources import stores
from labelscope.sources.images import fetch_images
from labelscope.streaming.incremental import checkpoint_folder, score_stream
from tests.png import png


class RedMeans(Predictor):
    """Names the class at the mean red value of the picture."""

    def __init__(self, shift=0):
        self.shift = shift

    def predict(self, image, prompt):
        red = int(np.mean(rgb_array(image)[:, :, 0])) + self.shift
        return f"It is {CLASSES[red % 26].lower()}."


class Sizes(Predictor):
    """Takes encoded files; names the class at the length of the file."""

    def predict(self, image, prompt):
        assert isinstance(image, bytes)
        return CLASSES[len(image) % 26]


FACTORIES = {"qwen": RedMeans, "llava": partial(RedMeans, 1), "internvl": partial(RedMeans, 0)}


@pytest.fixture
def study(tmp_path):
    images = tmp_path / "images"
    images.mkdir()
    for red in range(6):
        (images / f"i{red}.png").write_bytes(png(8, 8, lambda x, y, r=red: (r, 0, 0)))
    (images / "broken.png").write_bytes(b"nothing")
    lines = ["Image Path,Emotion,x1,y1,x2,y2"]
    for red in range(6):
        lines.append(f"i{red}.png,{CLASSES[red]},0,0,4,4")
        lines.append(f"i{red}.png,{CLASSES[red]},3,3,{3 if red == 2 else 9},9")
    lines += ["broken.png,Fear,0,0,2,2", "none.png,Fear,0,0,2,2", "i0.png,Glee,0,0,2,2"]
    csv = tmp_path / "annotations.csv"
    csv.write_text("\n".join(lines) + "\n")
    return tasks.Workspace(str(tmp_path / "work")), str(csv), str(images)


@pytest.mark.parametrize("listing", [True, False])
def test_full_face_and_analysis(spark, study, listing):
    work, csv, images = study
    rows = tasks.prepare(spark, work, csv, images, listing=listing)
    assert rows.count() == 13

    with pytest.raises(ValueError, match="full-image"):
        tasks.run_analysis(spark, work)

    full = tasks.run_full(spark, work, images, FACTORIES, batch="one")
    assert full.count() == 3 * 13 and full.where("predicted_label = 'Unknown'").count() == 3
    # A second run has nothing left to do; naming the batch again repeats it in place.
    assert tasks.run_full(spark, work, images, FACTORIES).count() == 3 * 13
    assert tasks.run_full(spark, work, images, FACTORIES, "qwen", batch="one").count() == 3 * 13

    face = tasks.run_face(spark, work, images, "/crops", FACTORIES, "qwen")
    assert face.count() == 11 and {r.predicted_label for r in face.collect()} == set(CLASSES[:6])
    assert tasks.run_face(spark, work, images, "/crops", FACTORIES, "qwen").count() == 11
    failures = spark.read.option("header", "true").csv(work.path("crop_failures"))
    assert {r.crop_fail_reason for r in failures.collect()} == {"invalid_bbox", "image cannot be read"}

    frames = tasks.run_analysis(spark, work)
    table = [(r.Model, r.Task, r.Accuracy) for r in frames["comparison"].collect()]
    assert [t[1:] for t in table] == [
        ("Full Image", 1.0), ("Face Only", 1.0), ("Full Image", 0.0), ("Full Image", 1.0)
    ]
    csv_rows = spark.read.option("header", "true").csv(work.path("comparison")).collect()
    assert [(r.Model, r.Task, float(r.Accuracy)) for r in csv_rows] == table
    assert frames["context_cases"].collect()[0].n_pairs == 11
    by_image = frames["context_cases_by_image"].collect()[0]
    # Images 0, 1, 3, 4, 5 have two persons with crops, image 2 has two with one crop.
    assert (by_image.n_pairs, by_image.n_helped, by_image.n_hurt) == (22, 0, 0)
    assert frames["context_helped_by_image"].isEmpty() and frames["context_hurt_by_image"].isEmpty()
    assert [r.label for r in frames["sample_per_label"].collect()] == CLASSES[:6]
    assert frames["recall_compare"].count() == 3 * 26
    assert frames["confusion_rates"].count() == 4 * 676

    saved = [json.loads(line) for line in spark.read.text(work.path("metrics")).toPandas()["value"]]
    assert all(len(m) == 7 for m in saved) and len(saved) == 4
    assert spark.read.parquet(work.path("report")).count() == 4 * 29
    crops = stores.read_crops(spark, work.path("crops"))
    assert crops.count() == crops.select("cropped_path").distinct().count() == 11


def test_results_as_csv(spark, study):
    work, csv, images = study
    tasks.prepare(spark, work, csv, images)
    for models in ("qwen", "llava", "qwen"):  # the last has nothing to score
        tasks.run_full(spark, work, images, FACTORIES, models, csv=True)
    tasks.run_face(spark, work, images, "/crops", FACTORIES, "qwen", csv=True)
    rows = spark.read.option("header", "true").csv(work.path("results_csv")).collect()
    stored = stores.read_results(spark, work.path("results")).collect()
    told = lambda r: (r.model_key, r.context, int(r.row_id), r.predicted_label, r.raw_output)
    assert sorted(map(told, rows), key=repr) == sorted(map(told, stored), key=repr) and len(rows) == 13 + 13 + 11


@pytest.mark.parametrize("scheme", ["", "file://", "file:"])
def test_any_spelling_finds_the_image(spark, study, scheme):
    """Roundabout paths and a root with a scheme give what plain spelling gives."""
    work, csv, images = study
    text = Path(csv).read_text()
    for plain, other in (("i0.png", "./i0.png"), ("i1.png", "../images/i1.png"), ("i2.png", ".//i2.png"), ("i3.png", f"{images}//i3.png")):
        text = text.replace(f"\n{plain}", f"\n{other}")
    Path(csv).write_text(text)
    root = scheme + images
    assert tasks.prepare(spark, work, csv, root).count() == 13
    full = tasks.run_full(spark, work, root, FACTORIES, "qwen")
    assert full.where("predicted_label = label").count() == 12
    face = tasks.run_face(spark, work, root, "/crops", FACTORIES, "qwen")
    assert face.count() == face.where("predicted_label = label").count() == 11
    frames = tasks.run_analysis(spark, work)
    assert spark.read.parquet(work.path("analysis/context_cases")).first().n_pairs == 11
    assert frames["answered"].count() == 12 + 11


def test_empty_study(spark, study, tmp_path):
    _, _, images = study
    work = tasks.Workspace(str(tmp_path / "empty"))
    csv = tmp_path / "empty.csv"
    csv.write_text("image_path,label,x1,y1,x2,y2\n")
    assert tasks.prepare(spark, work, str(csv), images).count() == 0
    assert tasks.run_full(spark, work, images, FACTORIES, "qwen").count() == 0
    row = stores.read_metrics(spark, work.path("metrics")).first()
    assert (row.model_key, row.context, row.accuracy, row.f1_weighted) == ("qwen", FULL, 0.0, 0.0)


@pytest.mark.parametrize("once", [True, False])
def test_encoded_images(spark, study, once):
    work, csv, images = study
    rows = tasks.prepare(spark, work, csv, images)
    full = tasks.run_full(spark, work, images, {"qwen": Sizes}, "qwen", encoded=True, tasks=2)
    want = {p.name: CLASSES[len(p.read_bytes()) % 26] for p in Path(images).iterdir()}
    got = {(r.row_id, r.predicted_label) for r in full.collect()}
    assert got == {(r.row_id, want[Path(r.image_path).name]) for r in rows.collect()}
    direct = score(rows, fetch_images, Sizes, FULL, once_per_image=once, tasks=3)
    assert {(r.row_id, r.predicted_label) for r in direct.collect()} == got


def test_sampled_study(spark, study):
    work, csv, images = study
    assert tasks.prepare(spark, work, csv, images, sample_size=5).count() == 5
    assert tasks.prepare(spark, work, csv, images, sample_size=50).count() == 13


def test_unmeasured_matrix_reads_as_zeros(spark, tmp_path):
    runs = spark.createDataFrame([("qwen", FULL)], "model_key string, context string")
    matrix = stores.read_confusion(spark, str(tmp_path / "none"), runs)
    assert matrix.count() == 676 and matrix.agg({"n": "sum"}).first()[0] == 0


def test_stream_scores_each_file_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    rows = spark.range(30).selectExpr(
        "id AS row_id", "concat('i', id) AS image_path", "'Fear' AS label",
        "0L AS bbox_x1", "0L AS bbox_y1", "1L AS bbox_x2", "1L AS bbox_y2",
    )
    images = rows.selectExpr("image_path", "named_struct('height', 1, 'width', 1, 'nChannels', 3, 'mode', 16,"
                             " 'data', unhex('000005')) AS image")

    def run():
        query = score_stream(
            spark, source, "row_id long, image_path string, label string, bbox_x1 long, bbox_y1 long, bbox_x2 long, bbox_y2 long",
            lambda batch: score(batch, images, RedMeans, FULL), store, "qwen", FULL,
            checkpoint=str(tmp_path / "progress"), files_per_batch=1,
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return stores.read_results(spark, store, "qwen", FULL)

    rows.where("row_id < 10").coalesce(1).write.mode("append").parquet(source)
    assert run().count() == 10
    assert run().count() == 10  # nothing new
    rows.where("row_id >= 8 AND row_id < 20").coalesce(1).write.mode("append").parquet(source)
    rows.where("row_id >= 18").coalesce(1).write.mode("append").parquet(source)
    out = run()
    assert out.count() == out.select("row_id").distinct().count() == 30
    assert {r.predicted_label for r in out.collect()} == {CLASSES[5]}
    # A batch that runs again replaces what it wrote.
    batch = out.where("row_id = 0").first()["batch"]
    stores.write_results(out.where(F.col("batch") == batch).drop("batch"), store, batch.removeprefix("run-"))
    assert stores.read_results(spark, store).count() == 30


def test_streams_share_a_store(spark, tmp_path):
    """Two sources, and a new checkpoint whose source has lost its files, keep all rows."""
    store = str(tmp_path / "store")
    schema = "row_id long, image_path string, label string, bbox_x1 long, bbox_y1 long, bbox_x2 long, bbox_y2 long"

    def run(first, source, progress):
        rows = spark.range(first, first + 10).selectExpr(
            "id AS row_id", "concat('i', id) AS image_path", "'Fear' AS label",
            "0L AS bbox_x1", "0L AS bbox_y1", "1L AS bbox_x2", "1L AS bbox_y2",
        )
        rows.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / source))
        images = rows.selectExpr("image_path", "named_struct('height', 1, 'width', 1, 'nChannels', 3, 'mode', 16,"
                                 " 'data', unhex('000005')) AS image")
        query = score_stream(
            spark, str(tmp_path / source), schema, lambda batch: score(batch, images, RedMeans, FULL), store, "qwen", FULL,
            checkpoint=str(tmp_path / progress),
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return stores.read_results(spark, store).count()

    assert run(0, "a", "pa") == 10
    assert run(10, "b", "pb") == 20
    assert run(20, "a", "pc") == 30


def test_a_stream_reads_again_what_it_could_not_read(spark, tmp_path):
    store, schema = str(tmp_path / "store"), "row_id long, image_path string, label string, bbox_x1 long, bbox_y1 long, bbox_x2 long, bbox_y2 long"
    for name, failing in (("a", "image_path IN ('i1', 'i2')"), ("b", "image_path = 'i2'"), ("c", "false")):
        rows = spark.range(4).selectExpr(
            "id AS row_id", "concat('i', id) AS image_path", "'Fear' AS label", "0L AS bbox_x1", "0L AS bbox_y1", "1L AS bbox_x2", "1L AS bbox_y2",
        )
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        pixels = "named_struct('height', 1, 'width', 1, 'nChannels', 3, 'mode', 16, 'data', unhex('000005'))"
        images = rows.selectExpr("image_path", f"if({failing}, NULL, {pixels}) AS image", f"if({failing}, 'read: throttled', NULL) AS read_error")
        query = score_stream(
            spark, str(tmp_path / name), schema, lambda batch, images=images: score(batch, images, RedMeans, FULL), store, "qwen", FULL,
            checkpoint=str(tmp_path / f"progress-{name}"),
        )
        query.awaitTermination(120)
        assert query.exception() is None
    rows = stores.read_results(spark, store, "qwen", FULL).collect()
    assert sorted((r.row_id, r.attempt, r.predicted_label) for r in rows) == [(0, 1, CLASSES[5]), (1, 2, CLASSES[5]), (2, 3, CLASSES[5]), (3, 1, CLASSES[5])]


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_folder(spark, "x") == spark.conf.get("spark.checkpoint.dir") + "/x"
