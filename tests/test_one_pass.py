"""Images opened by tasks: how often, for whom, and what becomes of failures."""

import re
import struct
import zlib
from functools import partial
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.domain import CLASSES, FACE, FULL
from labelscope.functions.paths import join_path, store_of
from labelscope.functions.pixels import NoCodec, decode_image
from labelscope.operators import compare, crop, resume
from labelscope.operators.joins import hot_hashes
from labelscope.operators.score import score_models
from labelscope.plans import fixtures as fx
from labelscope.plans import tasks
from labelscope.plans.queries import queries
from labelscope.sources import images as sources
from labelscope.sources import stores
from labelscope.sources.images import FileImages, StoredImages, planned_images, read_images
from tests.png import _chunk, gradient, png
from tests.test_jobs import RedMeans

ROWS = "row_id long, image_path string, label string, bbox_x1 long, bbox_y1 long, bbox_x2 long, bbox_y2 long"


class Counted(FileImages):
    """Writes a line for every image it opens; fails for names found in a file."""

    def __init__(self, log, decode=decode_image):
        super().__init__(decode)
        self.log = str(log)

    def reader(self):
        open_image, log = super().reader(), self.log

        def image(row):
            path = next(iter(row.values()))
            with open(log, "a") as lines:
                lines.write(path + "\n")
            failing = Path(f"{log}.failing")
            if failing.exists() and any(name and name in path for name in failing.read_text().split("\n")):
                raise OSError("throttled")
            return open_image(row)

        return image


@pytest.fixture
def study(tmp_path, monkeypatch):
    """A prepared study of six images, two persons each, whose jobs count the images they open."""
    folder = tmp_path / "images"
    folder.mkdir()
    for red in range(6):
        (folder / f"i{red}.png").write_bytes(png(8, 8, lambda x, y, r=red: (r, 0, 0)))
    (folder / "broken.png").write_bytes(b"nothing")
    lines = ["image_path,label,x1,y1,x2,y2"]
    for red in range(6):
        lines += [f"i{red}.png,{CLASSES[red]},0,0,4,4", f"./i{red}.png,{CLASSES[red]},3,3,9,9"]
    lines.append("broken.png,Fear,0,0,2,2")
    csv, log = tmp_path / "annotations.csv", tmp_path / "opened"
    csv.write_text("\n".join(lines) + "\n")
    log.write_text("")
    monkeypatch.setattr(tasks, "FileImages", partial(Counted, log))
    return tasks.Workspace(str(tmp_path / "work")), str(csv), str(folder), log


FACTORIES = {"qwen": RedMeans, "llava": partial(RedMeans, 1), "internvl": partial(RedMeans, 2)}


def opened(log):
    names = [Path(p).name for p in log.read_text().split()]
    log.write_text("")
    return sorted(names)


EVERY = sorted([f"i{i}.png" for i in range(6)] + ["broken.png"])


def test_three_models_open_each_image_once(spark, study):
    work, csv, images, log = study
    tasks.prepare(spark, work, csv, images)
    assert tasks.run_full(spark, work, images, FACTORIES, "llava").count() == 13
    assert opened(log) == EVERY
    full = tasks.run_full(spark, work, images, FACTORIES)
    assert opened(log) == EVERY
    assert full.count() == 3 * 13 and full.select("model_key", "row_id").distinct().count() == 3 * 13
    for shift, name in enumerate(FACTORIES):
        right = full.where(F.col("model_key") == name).where("label <> 'Fear'").collect()
        assert [CLASSES[(CLASSES.index(r.label) + shift) % 26] for r in right] == [r.predicted_label for r in right]
    assert {r.error.split(":")[0] for r in full.where("error IS NOT NULL").collect()} == {"decode"}
    assert tasks.run_full(spark, work, images, FACTORIES).count() == 3 * 13 and opened(log) == []
    # Boxes of one image are cut from one opening; the crops are scored where they lie.
    face = tasks.run_face(spark, work, images, "/crops", FACTORIES)
    assert opened(log) == EVERY
    assert face.count() == 3 * 12
    assert face.where("model_key = 'qwen' AND predicted_label = label").count() == 12
    assert tasks.run_face(spark, work, images, "/crops", FACTORIES).count() == 3 * 12
    assert opened(log) == ["broken.png"]


def test_a_failed_read_tried_again_counts_once(spark, study):
    """The first run cannot read two images; pairs, metrics and audits see one row a person after the second."""
    work, csv, images, log = study
    rows = tasks.prepare(spark, work, csv, images)
    Path(f"{log}.failing").write_text("i1.png\ni4.png")
    full = tasks.run_full(spark, work, images, FACTORIES, "qwen")
    assert full.where("error LIKE 'read: %'").count() == 4 and full.count() == 13
    before = stores.read_metrics(spark, work.path("metrics")).first()
    Path(f"{log}.failing").write_text("i4.png")
    assert opened(log) == EVERY
    again = tasks.run_full(spark, work, images, FACTORIES, "qwen")
    assert opened(log) == ["i1.png", "i4.png"]
    assert again.count() == 13 and again.where("error LIKE 'read: %'").count() == 2
    assert again.where("attempt = 2").count() == 4
    Path(f"{log}.failing").write_text("")
    full = tasks.run_full(spark, work, images, FACTORIES, "qwen")
    assert full.count() == full.select("row_id").distinct().count() == 13
    assert {r.attempt for r in full.where("image_path LIKE '%i4.png'").collect()} == {3}
    assert full.where("predicted_label = label").count() == 12
    path = work.path("results")
    assert stores.read_results(spark, path, all_attempts=True).count() == 13 + 4 + 2
    face = tasks.run_face(spark, work, images, "/crops", FACTORIES, "qwen")
    results = stores.read_results(spark, path)
    pairs = compare.context_pairs(results)
    assert pairs.count() == 12 and compare.context_cases(pairs).first()[1:] == (12, 0, 0)
    assert tuple(resume.resume_audit(rows, full).first()) == (13, 0)
    assert face.count() == 12
    # Counts added up by batch are those of the latest attempts.
    after = stores.read_metrics(spark, work.path("metrics")).where("context = 'full'").first()
    assert (before.accuracy, after.accuracy) == (1.0, 1.0) and after.f1_macro == pytest.approx(6 / 26, abs=1e-4)
    want = sorted((r.row_id, r.context, r.attempt, r.predicted_label) for r in results.collect())
    assert stores.compact_results(spark, path) == 6
    assert stores.compact_results(spark, path) == 0
    for every in (True, False):
        left = stores.read_results(spark, path, all_attempts=every).collect()
        assert sorted((r.row_id, r.context, r.attempt, r.predicted_label) for r in left) == want


def test_each_batch_is_counted_once(spark, study, monkeypatch):
    work, csv, images, _ = study
    tasks.prepare(spark, work, csv, images)
    tasks.run_full(spark, work, images, FACTORIES, "qwen", batch="one")
    counted = []
    real = stores.answer_cells
    monkeypatch.setattr(stores, "answer_cells", lambda r, *a, **k: counted.append(r) or real(r, *a, **k))
    tasks.run_full(spark, work, images, FACTORIES, "llava", batch="two")
    assert {r.batch for r in counted[0].select("batch").collect()} == {"run-two"}
    first = {r.model_key: r.asDict() for r in stores.read_metrics(spark, work.path("metrics")).collect()}
    tasks.run_full(spark, work, images, FACTORIES, batch="two")  # again, and one model more
    again = {r.model_key: r.asDict() for r in stores.read_metrics(spark, work.path("metrics")).collect()}
    assert set(again) == set(FACTORIES) and all(again[m] == first[m] for m in first)


def test_needs_differ_per_model(spark):
    rows = spark.createDataFrame(
        [(0, "a", "Fear", 0, 0, 1, 1), (1, "a", "Fear", 0, 0, 1, 1), (2, "b", "Fear", 0, 0, 1, 1), (3, None, "Fear", None, 0, 1, 1)], ROWS
    )
    stored = spark.createDataFrame(
        [("qwen", "a", 0, "Fear", None, 1), ("llava", "a", 0, "Unknown", "read: no", 1), ("llava", "a", 0, "Unknown", "read: no", 2),
         ("qwen", "b", 0, "Unknown", None, 1), ("llava", None, None, "Fear", None, 1)],
        "model_key string, image_path string, bbox_x1 long, predicted_label string, error string, attempt int",
    ).selectExpr("*", "0L AS bbox_y1", "1L AS bbox_x2", "1L AS bbox_y2")

    def needs(**kw):
        return {r.row_id: [tuple(n) for n in r.needs] for r in resume.outstanding(rows, stored, ["qwen", "llava"], **kw).collect()}

    want = {0: [("llava", 3)], 1: [("llava", 3)], 2: [("llava", 1)], 3: [("qwen", 1)]}
    for hot in (None, hot_hashes(rows, list(resume.PERSON_KEY))):
        assert needs(hot=hot) == want
        assert needs(retry_unknown=True, hot=hot) == want | {2: [("qwen", 2), ("llava", 1)]}
    first = resume.outstanding(rows, None, ["qwen"]).collect()
    assert [[tuple(n) for n in r.needs] for r in first] == [[("qwen", 1)]] * 4


def exchanged(df):
    """Columns of every row exchange of the plan, other than broadcasts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    formatted = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    nodes = re.findall(r"^\(\d+\) (?:Exchange|ShuffleQueryStage).*?\nInput \[\d+\]: \[(.*?)\]$", formatted, re.M | re.S)
    assert nodes, plan
    return nodes


def test_no_pixels_are_exchanged(spark, sf_dir, tmp_path):
    boxes = fx.annotations(spark, sf_dir)
    cuts = crop.cut_opened(boxes, fx.RampImages(), hot=hot_hashes(boxes, ["image_key"]))
    assert not any(re.search(r"\bimage#|data", n) for n in exchanged(cuts))
    stores.write_crops(cuts.limit(20), str(tmp_path), "one")
    rows = resume.outstanding(boxes, None, ["qwen"])
    scored = score_models(rows, StoredImages(stores.crop_places(spark, str(tmp_path))), {"qwen": fx.FirstByte}, FACE, crop.CROP_KEY)
    assert not any(re.search(r"\bimage#|data", n) for n in exchanged(scored))
    full = score_models(rows, fx.RampImages(), {"qwen": fx.FirstByte}, FULL)
    assert not any(re.search(r"\bimage#|data", n) for n in exchanged(full))


def test_a_hot_image_is_opened_once_a_slice(spark, tmp_path):
    path = str(tmp_path / "hot.png")
    Path(path).write_bytes(png(5, 4, gradient))
    log = tmp_path / "opened"
    log.write_text("")
    rows = spark.range(400).selectExpr(
        "id AS row_id", f"'{path}' AS image_path", "'Fear' AS label", "id % 4 AS bbox_x1", "0L AS bbox_y1", "5 + id AS bbox_x2", "4L AS bbox_y2"
    )
    hot = hot_hashes(rows, ["image_path"]).collect()
    cuts = crop.cut_opened(rows, Counted(log), hot=spark.createDataFrame(hot, "hot bigint, slices int")).collect()
    assert len(cuts) == 400 and all(c.crop_fail_reason is None for c in cuts)
    assert 1 <= len(opened(log)) <= hot[0].slices and hot[0].slices > 1


def test_cut_runs_agree_with_cuts_from_a_table(spark, tmp_path):
    for name, size in (("a", (5, 4)), ("b", (9, 3))):
        (tmp_path / f"{name}.png").write_bytes(png(*size, gradient))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nno")
    boxes = [(-3, -3, 2, 2), (1, 1, 9, 9), (4, 0, 5, 1), (7, 0, 20, 2), (30, 30, 40, 40), (2, 2, 2, 3)]
    rows = spark.createDataFrame(
        [(i, f"{tmp_path}/{name}.png", "Fear", *box) for name in ("a", "b", "broken", "none") for i, box in enumerate(boxes)], ROWS
    )
    plain = crop.cut_crops(rows, read_images(spark, str(tmp_path)), "/crops")
    runs = crop.cut_opened(rows, FileImages(), "/crops")
    as_rows = lambda df: sorted(map(repr, df.collect()))
    assert as_rows(runs) == as_rows(plain) and runs.count() == 20


def test_stored_images_over_row_groups(spark, tmp_path):
    table = spark.range(300).selectExpr("id AS k", "cast(concat('image ', id) AS binary) AS image")
    table.repartition(3).write.option("parquet.block.size", 1).option("parquet.page.row.count.limit", 10).parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    places = stored.select("k", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    for wanted in ("k % 7 = 3", "true", "k = 299"):
        placed = StoredImages(places).placed(spark.range(300).where(wanted.replace("k", "id")).withColumnRenamed("id", "k")).collect()
        read = StoredImages(places).reader()
        ordered = sorted(placed, key=lambda r: (r.file, r.at))
        assert [read(r.asDict()) for r in ordered] == [f"image {r.k}".encode() for r in ordered]


# --- sources ------------------------------------------------------------------------


def test_planned_images(spark, tmp_path):
    (tmp_path / "images").mkdir()
    for name in ("a b", "ü+1"):
        (tmp_path / "images" / f"{name}.png").write_bytes(png(5, 4, gradient))
    (tmp_path / "images" / "broken.png").write_bytes(b"nothing")
    names = [f"{tmp_path}/images/{n}.png" for n in ("a b", "ü+1", "broken", "none")] + [None, f"{tmp_path}/images"]
    spark.createDataFrame([(n,) for n in names] * 5, "image_path string").repartition(3).write.parquet(f"{tmp_path}/keys")
    got = planned_images(spark, f"{tmp_path}/keys", rows=4)
    assert got.rdd.getNumPartitions() >= 8
    rows = got.collect()
    assert len(rows) == 30
    for r in rows:
        name = Path(r.image_path).stem if r.image_path else None
        if name in ("a b", "ü+1"):
            assert (r.image.width, r.image.height, r.read_error) == (5, 4, None)
            assert tuple(crop.rgb_array(r.image.asDict())[2, 3]) == gradient(3, 2)
        elif name == "broken":
            assert r.image is None and r.read_error.startswith("decode: ")
        else:
            assert r.image is None and r.read_error is None
    raw = planned_images(spark, f"{tmp_path}/keys", decode=None).where("image IS NOT NULL").collect()
    assert len(raw) == 15 and {bytes(r.image) for r in raw} == {p.read_bytes() for p in (tmp_path / "images").iterdir()}
    spark.createDataFrame([], "image_path string").write.parquet(f"{tmp_path}/none")
    assert planned_images(spark, f"{tmp_path}/none").count() == 0


def test_planned_scan_lists_no_images(monkeypatch, spark, tmp_path):
    spark.createDataFrame([("/nowhere/x.png",)], "image_path string").write.parquet(f"{tmp_path}/keys")
    asked = []
    real = sources._Files.locate
    monkeypatch.setattr(sources._Files, "locate", lambda self, p: asked.append(p) or real(self, p))
    reader = sources._PlannedReader({"path": f"{tmp_path}/keys", "rows": "2"}, None)
    parts = reader.partitions()
    assert len(parts) == 1 and asked == [f"{tmp_path}/keys"]


def filtered(width, height, pixel, channels):
    """A PNG whose rows take the filters in turn."""
    lines, above = b"", [0] * (width * channels)
    for y in range(height):
        line = [v for x in range(width) for v in pixel(x, y)]
        kind, out = y % 5, []
        for i, v in enumerate(line):
            a = line[i - channels] if i >= channels else 0
            b, c = above[i], above[i - channels] if i >= channels else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - [0, a, b, (a + b) // 2, nearest][kind]) % 256)
        lines += bytes([kind, *out])
        above = line
    header = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_decoder_agrees_with_sparks(spark, tmp_path, channels):
    rng = np.random.default_rng(channels)
    values = rng.integers(0, 256, (11, 7, channels))
    content = filtered(7, 11, lambda x, y: values[y, x].tolist(), channels)
    (tmp_path / "x.png").write_bytes(content)
    mine = crop.bgr_array(decode_image(content))
    spark_made = crop.bgr_array(read_images(spark, str(tmp_path)).first().image.asDict())
    assert (mine == spark_made).all()


def test_codecs_that_are_missing_end_the_job():
    for content in (b"\xff\xd8\xff\xe0 a photo", b"GIF89a", b"BM"):
        with pytest.raises((NoCodec, ValueError)):
            decode_image(content)
    for content in (b"", b"text", b"\x89PNG\r\n\x1a\n", png(4, 3, gradient)[:60]):
        with pytest.raises(ValueError, match="."):
            decode_image(content)


def test_absolute_paths_lie_in_the_roots_store(spark):
    table = spark.createDataFrame([("/data/x.png",), ("a/x.png",), ("s3://b/x.png",)], "p string")

    def joined(root):
        return [r[0] for r in table.select(join_path(root, F.col("p"))).collect()]

    assert joined("hdfs://nn:8020/images") == ["hdfs://nn:8020/data/x.png", "hdfs://nn:8020/images/a/x.png", "s3://b/x.png"]
    assert joined("/images")[:2] == ["/data/x.png", "/images/a/x.png"]
    assert joined("file:/images")[:2] == ["/data/x.png", "file:/images/a/x.png"]
    assert (store_of("hdfs://nn:8020/x"), store_of("/x"), store_of("file:///x"), store_of("")) == ("hdfs://nn:8020", "", "", "")


def test_pixel_queries_are_at_full_size(spark, sf_dir):
    widest = queries()["cut_pixels"](spark, sf_dir).agg(F.max("width"), F.max("height")).first()
    assert widest[0] > 150 and widest[1] > 100
