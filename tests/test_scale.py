"""Lists, samples, listings and counts that must not end in one task."""

import random
from pathlib import Path

import pytest
from pyspark.sql import Observation

from labelscope.domain import CLASSES, NO_ANSWERS
from labelscope.operators import clean, compare, crop, metrics, sample
from labelscope.plans import fixtures as fx
from labelscope.plans import tasks
from labelscope.sources.images import list_images, manifest
from tests.png import png
from tests.test_jobs import FACTORIES, study  # noqa: F401


@pytest.mark.parametrize("ids", [
    lambda rng, i: i, lambda rng, i: rng.randrange(10**15), lambda rng, i: rng.choice([5, 6, 10**12]), lambda rng, i: -i * i,
])
def test_long_lists_by_ranges(spark, ids, monkeypatch):
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", ids(rng, i), f"i{i}", "x") for i in range(4000)]
    table = spark.createDataFrame(rows, "model_key string, row_id long, image_path string, other string").repartition(5).cache()
    for ranges, few, n in ((7, 50, 900), (4096, 10, 1300), (16, 1, 5000), (3, 10_000, 40)):
        monkeypatch.setattr(compare, "_RANGES", ranges)
        got = compare._first_by_ranges(table, n, ["row_id", "image_path"], few)
        want = []
        for m in "ab":
            mine = sorted((r for r in rows if r[0] == m), key=lambda r: (r[1], r[2]))[:n]
            want += [(*r, k) for k, r in enumerate(mine, 1)]
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert compare._first_by_ranges(table.limit(0), 2000, ["row_id", "image_path"]).collect() == []
    table.unpersist()


def test_no_task_ranks_a_model(spark, tmp_path):
    """20,000 of 60,000 rows a model: every sorted group is a range of a few thousand rows."""
    path = str(tmp_path / "pairs")
    spark.range(120_000).selectExpr(
        "id AS row_id", "'i' AS image_path", "if(id % 2 = 0, 'a', 'b') AS model_key", "'Fear' AS label",
        "'Fear' AS predicted_label_full", "'Anger' AS predicted_label_face",
    ).write.parquet(path)
    helped = compare.context_helped(spark.read.parquet(path), 20_000)
    plan = helped._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(model_key" not in plan.replace("hashpartitioning(model_key#", "(", 0) or "_low" in plan
    rows = helped.select("model_key", "row_id", "rank").collect()
    assert len(rows) == 40_000 and all(r.row_id == 2 * (r["rank"] - 1) + (r.model_key == "b") for r in rows)


@pytest.mark.parametrize("copies", [1, 40])
def test_large_samples_by_bracket(spark, copies):
    rows = spark.range(6000).selectExpr(f"id div {copies} AS row_id", "id AS n").cache()
    order = [r.row_id for r in rows.withColumn("d", sample._draw(42)).orderBy("d", "row_id").collect()]
    for n in (31, 400, 2500, 5999, 6000, 9000):
        got = sample.sample_rows(rows, n, in_one_task=30)
        assert sorted(r.row_id for r in got.collect()) == sorted(order[:n])
    rows.unpersist()


def test_a_large_sample_takes_two_counts(spark, monkeypatch):
    rows = spark.range(50_000).withColumnRenamed("id", "row_id").cache()
    rows.count()
    jobs, real = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: jobs.append(1) or real(self))
    got = sample.sample_rows(rows, 20_000, in_one_task=1000)
    assert len(jobs) == 1  # and the count of all rows
    assert got.count() == 20_000


def test_manifest_is_the_listing(spark, tmp_path):
    root = tmp_path / "images"
    for folder in ("", "a", "a/b c", "a/b c/ü+", "empty", "x/y"):
        (root / folder).mkdir(parents=True, exist_ok=True)
    for k, name in enumerate(("1.png", "a/2.png", "a/b c/3 %20.png", "a/b c/ü+/4.png", "x/y/5.png")):
        (root / name).write_bytes(b"x" * (k + 1))
    listed = {tuple(r) for r in list_images(spark, str(root)).collect()}
    made = manifest(spark, str(root), str(tmp_path / "m"))
    assert made.columns == ["image_path", "length"]
    assert {tuple(r) for r in made.collect()} == listed and len(listed) == 5
    assert manifest(spark, str(root / "empty"), str(tmp_path / "e")).count() == 0
    assert {Path(r.image_path).name for r in manifest(spark, f"file://{root}/x", str(tmp_path / "u")).collect()} == {"5.png"}


def test_counts_come_from_the_writing_job(spark, sf_dir, tmp_path):
    raw, images = fx.raw_annotations(spark, sf_dir), fx.images(spark, sf_dir)
    counts = Observation("load")
    rows = clean.cleaned_and_counted(raw, images, counts, fx.ROOT)
    rows.write.parquet(str(tmp_path / "rows"))
    want = clean.load_audit(raw, images, fx.ROOT).first().asDict()
    assert counts.get == {k: v for k, v in want.items() if k != "subset_rows"}
    plain = clean.clean_annotations(raw, images, fx.ROOT)
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "rows")).collect())) == sorted(map(repr, plain.collect()))
    outcomes = Observation("crops")
    crop.counted_outcomes(fx.crops(spark, sf_dir), outcomes).write.format("noop").mode("overwrite").save()
    audit = {r.outcome: r.n_rows for r in crop.crop_audit(fx.crops(spark, sf_dir)).collect()}
    assert {k: v for k, v in outcomes.get.items() if v} == audit


def test_jobs_store_their_counts(spark, study):  # noqa: F811
    work, csv, images = study
    tasks.prepare(spark, work, csv, images, sample_size=5)
    first = spark.read.parquet(work.path("load_audit")).first().asDict()
    assert first == {"raw_rows": 15, "missing_images": 1, "unknown_labels": 1, "usable_rows": 13, "subset_rows": 5}
    tasks.prepare(spark, work, csv, images, multi_line=False)
    tasks.run_face(spark, work, images, "/crops", FACTORIES, "qwen")
    audit = spark.read.parquet(work.path("crop_audit")).first().asDict()
    assert audit == {"ok": 11, "invalid_bbox": 1, "clamped_empty": 0, "unreadable": 1, "read": 0}
    notes = {r.context: (r.answered, r.correct, r.note) for r in spark.read.parquet(work.path("notes")).collect()}
    assert notes == {"face": (11, 11, None)}


def test_a_run_without_answers_is_flagged(spark):
    schema = "model_key string, context string, label string, predicted_label string"
    rows = spark.createDataFrame([("qwen", "full", "Fear", "Unknown"), ("llava", "full", CLASSES[0], CLASSES[0]), ("llava", "full", "Fear", "Pain")], schema)
    asked = spark.createDataFrame([(m, "full") for m in ("qwen", "llava", "internvl")], "model_key string, context string")
    notes = {r.model_key: (r.answered, r.correct, r.note) for r in metrics.run_notes(metrics.answer_cells(rows, asked)).collect()}
    assert notes == {"qwen": (0, 0, NO_ANSWERS), "llava": (2, 1, None), "internvl": (0, 0, NO_ANSWERS)}


def test_one_bad_pixel_file_is_counted_as_unreadable(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(png(4, 4, lambda x, y: (1, 2, 3)))
    rows = spark.createDataFrame([(0, f"{tmp_path}/i.png", 0, 0, 2, 2)], "row_id long, image_path string, bbox_x1 long, bbox_y1 long, bbox_x2 long, bbox_y2 long")
    cuts = rows.selectExpr("image_path", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "'p' AS cropped_path", "'read: throttled' AS crop_fail_reason")
    counts = Observation("one")
    crop.counted_outcomes(crop.with_crops(rows, cuts), counts).collect()
    assert counts.get["read"] == 1 and sum(counts.get.values()) == 1
