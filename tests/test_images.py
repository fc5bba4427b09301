"""Image files, pixels and crops."""

import numpy as np
import pytest

from labelscope.operators import crop
from labelscope.operators.joins import hot_hashes
from labelscope.sources.images import (
    existing_images, fetch_images, image_sizes, list_images, read_images,
)
from tests.png import gradient, png

ROWS = "row_id long, image_path string, label string, bbox_x1 long, bbox_y1 long, bbox_x2 long, bbox_y2 long"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    (root / "sub").mkdir()
    (root / "solid.png").write_bytes(png(4, 3, lambda x, y: (200, 100, 50)))
    (root / "sub" / "a+b %20ü.png").write_bytes(png(5, 4, gradient))
    (root / "grey.png").write_bytes(png(6, 6, lambda x, y: (7 * x + y,), colour_type=0))
    (root / "alpha.png").write_bytes(png(3, 3, lambda x, y: (x, y, 9, 128), colour_type=6))
    (root / "broken.png").write_bytes(b"\x89PNG not really")
    return root


def files(folder):
    return {str(p) for p in folder.rglob("*") if p.is_file()}


def test_listing_and_asking_agree(spark, folder):
    listed = {r.image_path for r in list_images(spark, str(folder)).collect()}
    assert listed == files(folder)
    asked = spark.createDataFrame(
        [(p,) for p in [*listed, str(folder), "/nowhere", None, f"{folder}/sub/../solid.png"]], "image_path string"
    )
    assert {r.image_path for r in existing_images(asked).collect()} == listed | {f"{folder}/sub/../solid.png"}
    by_uri = spark.createDataFrame([(f"file://{folder}/solid.png",), (f"file://{folder}/no.png",)], "image_path string")
    assert existing_images(by_uri).count() == 1


def test_contents_are_read_in_tasks(spark, folder):
    asked = spark.createDataFrame(
        [(p,) for p in [*files(folder), "/nowhere", None, str(folder), f"file://{folder}/solid.png"]], "image_path string"
    )
    got = {r.image_path: bytes(r.image) for r in fetch_images(asked).collect()}
    assert set(got) == files(folder) | {f"file://{folder}/solid.png"}
    assert got[f"{folder}/solid.png"] == (folder / "solid.png").read_bytes()


def test_contents_come_in_bounded_batches(folder):
    import pyarrow as pa

    from labelscope.sources import images

    names = sorted(files(folder))
    batch = pa.RecordBatch.from_arrays([pa.array(names)], ["image_path"])
    old, images._CONTENT_BYTES = images._CONTENT_BYTES, 1
    try:
        out = list(images._contents(iter([batch])))
    finally:
        images._CONTENT_BYTES = old
    assert [b.num_rows for b in out] == [1] * len(names) + [0]
    assert [p for b in out for p in b.column(0).to_pylist()] == names


def test_failed_reads_are_not_missing_files(folder, monkeypatch):
    import pyarrow as pa

    from labelscope.sources import images

    def content(self, path):
        if "grey" in path:
            raise OSError("slow down")
        return None if "none" in path else b"x"

    monkeypatch.setattr(images._Files, "content", content)
    names = ["a.png", "grey.png", "none.png"]
    out = pa.Table.from_batches(images._contents(iter([pa.RecordBatch.from_arrays([pa.array(names)], ["image_path"])])))
    assert out.to_pylist() == [
        {"image_path": "a.png", "image": b"x", "read_error": None},
        {"image_path": "grey.png", "image": None, "read_error": "read: slow down"},
    ]


def test_listing_reads_no_contents(spark, folder):
    plan = list_images(spark, str(folder))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan or "content" not in plan.split("Physical")[1]


def test_pixels(spark, folder):
    images = {r.image_path.rsplit("/", 1)[1]: r.image for r in read_images(spark, str(folder)).collect()}
    assert set(images) == {"solid.png", "a+b %20ü.png", "grey.png", "alpha.png"}
    rgb = {name: crop.rgb_array(i.asDict()) for name, i in images.items()}
    assert rgb["solid.png"].shape == (3, 4, 3) and (rgb["solid.png"] == [200, 100, 50]).all()
    assert tuple(rgb["a+b %20ü.png"][2, 3]) == gradient(3, 2)
    assert tuple(rgb["grey.png"][1, 5]) == (36, 36, 36)
    assert tuple(rgb["alpha.png"][2, 1]) == (1, 2, 9)


def test_crops_end_to_end(spark, folder):
    odd, solid = f"{folder}/sub/a+b %20ü.png", f"{folder}/solid.png"
    rows = spark.createDataFrame(
        [
            (0, odd, "Fear", 1, 1, 4, 3), (1, odd, "Fear", -5, -5, 100, 100), (2, odd, "Fear", 1, 1, 4, 3),
            (3, solid, "Peace", 2, 2, 2, 3), (4, solid, "Peace", 50, 50, 60, 60),
            (5, f"{folder}/broken.png", "Peace", 0, 0, 2, 2), (6, f"{folder}/grey.png", "Peace", 0, 0, 2, 2),
        ],
        ROWS,
    )
    images = read_images(spark, str(folder))
    hot = hot_hashes(rows, ["image_path"])
    cuts = crop.cut_crops(rows, images, "/crops", hot=hot).cache()
    assert cuts.count() == 5  # row 2 repeats row 0, row 3 has no valid box
    pixels = {(r.image_path, r.bbox_x1): r.image for r in cuts.collect() if r.image}
    part = crop.rgb_array(pixels[odd, 1].asDict())
    want = np.array([[gradient(x, y) for x in range(1, 4)] for y in range(1, 3)])
    assert (part == want).all()
    assert crop.rgb_array(pixels[odd, -5].asDict()).shape == (4, 5, 3)

    plan = {r.row_id: r for r in crop.with_crops(rows, cuts).collect()}
    assert [plan[i].crop_failed for i in range(7)] == [False, False, False, True, True, True, False]
    assert plan[0].cropped_path == plan[2].cropped_path and plan[0].cropped_path.startswith("/crops/crop_")
    assert plan[3].crop_fail_reason == "invalid_bbox" and plan[3].cropped_path is None
    assert plan[4].crop_fail_reason == "Bbox clamped to empty region (50,50,4,3)"
    assert plan[5].crop_fail_reason == "image cannot be read"
    by_size = {r.row_id: r for r in crop.crop_plan(rows, image_sizes(images), "/crops", hot=hot).collect()}
    same = ("cropped_path", "crop_failed", "crop_fail_reason")
    assert all(plan[i][c] == by_size[i][c] for i in plan for c in same)

    done = cuts.where("crop_fail_reason IS NULL")
    again = crop.cut_crops(rows, images, "/crops", done)
    assert again.count() == 2 and again.where("crop_fail_reason IS NULL").count() == 0
    # A box cut before succeeds although its image has gone.
    gone = crop.crop_plan(rows, image_sizes(images).limit(0), "/crops", done)
    assert {r.row_id for r in crop.usable_crops(gone).collect()} == {0, 1, 2, 6}
    assert crop.crop_failures(gone).columns[:3] == ["image_path", "label", "crop_fail_reason"]


def test_null_box_is_invalid(spark, folder):
    rows = spark.createDataFrame([(0, f"{folder}/solid.png", "Fear", None, 0, 1, 1)], ROWS)
    plan = crop.crop_plan(rows, image_sizes(read_images(spark, str(folder)))).first()
    assert plan.crop_fail_reason == "invalid_bbox"
