"""Reading, cleaning and sampling."""

import pytest
from pyspark.sql import functions as F

from labelscope.operators import clean, sample
from labelscope.operators.clean import clean_annotations, load_audit, standard_columns
from labelscope.operators.sample import first_per_label, sample_rows
from labelscope.sources.annotations import read_annotations

COLUMNS = "row_id long, image_path string, label string, bbox_x1 string, bbox_y1 string, bbox_x2 string, bbox_y2 string"


def test_csv_reads_quotes_newlines_and_missing_tokens(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text(
        'Image Path, Label ,X1,Y1,X2,Y2,Note\n'
        '"q ""x"".jpg",Fear,1,2,3,4,"two\nlines"\n'
        'NA,null,,#N/A,5,6,plain\n'
    )
    rows = read_annotations(spark, str(file)).orderBy("row_id").collect()
    assert [c for c in rows[0].asDict()] == [
        "image_path", "label", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "note", "row_id"
    ]
    assert rows[0].image_path == 'q "x".jpg' and rows[0].note == "two\nlines"
    assert tuple(rows[1])[:6] == (None, None, None, None, "5", "6")


def test_csv_without_spanning_fields_is_split(spark, tmp_path):
    file = tmp_path / "b.csv"
    file.write_text("image_path,emotion\n" + "".join(f'"i{n}.jpg",Fear\n' for n in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = read_annotations(spark, str(file))
        assert rows.rdd.getNumPartitions() > 1
        ordered = [r.image_path for r in rows.orderBy("row_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ordered == [f"i{n}.jpg" for n in range(20000)]


def test_missing_csv_names_the_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        read_annotations(spark, str(tmp_path / "nowhere.csv"))


def test_headers(spark):
    def renamed(*names):
        return standard_columns(spark.createDataFrame([tuple("a" for _ in names)], list(names))).columns

    assert renamed("My Image_Path ", " Label ", "X1", "bbox_y2", "Some Thing") == [
        "image_path", "label", "bbox_x1", "bbox_y2", "some_thing"
    ]
    assert renamed("path of image", "discrete_label") == ["image_path", "label"]
    with pytest.raises(ValueError, match="image_path"):
        renamed("image_path", "image file path", "label")
    with pytest.raises(ValueError, match="label"):
        renamed("image_path", "title")


RAW = [
    (0, " a.jpg", "Fear", "12.7", "-12.7", "3", "4"),
    (1, "./a.jpg", " Peace\t", "1", "2", "3", "4"),
    (2, "/abs/b.jpg", "Anger", "1", "2", "3", "4"),
    (3, "missing.jpg", "Anger", None, "2", "3", "4"),
    (4, "a.jpg", "anger", None, "2", "3", "4"),
    (5, None, "Fear", "1", "2", "3", "4"),
    (6, "a.jpg", None, "1", "2", "3", "4"),
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(RAW, COLUMNS)


@pytest.fixture
def listed(spark):
    return spark.createDataFrame([("/root/a.jpg",), ("/abs/b.jpg",)], "image_path string")


def test_clean_and_audit(raw, listed):
    kept = {r.row_id: r for r in clean_annotations(raw, listed, "/root").collect()}
    assert sorted(kept) == [0, 1, 2]
    assert (kept[0].bbox_x1, kept[0].bbox_y1) == (12, -12) and kept[1].label == "Peace"
    assert kept[1].image_path == "/root/./a.jpg" and kept[2].image_path == "/abs/b.jpg"
    assert tuple(load_audit(raw, listed, "/root", sample=2).first()) == (7, 2, 2, 3, 2)


def test_hot_slicing_changes_nothing(spark, listed):
    # A third of the rows name one image.
    rows = spark.range(3000).selectExpr(
        "id AS row_id",
        "CASE WHEN id % 3 = 0 THEN 'a.jpg' WHEN id % 3 = 1 THEN '/abs/b.jpg' ELSE concat('x', id) END AS image_path",
        "'Fear' AS label",
    )
    hot = clean.hot_images(rows, "/root")
    assert hot.count() >= 2
    for how in (None, hot):
        kept = clean_annotations(rows, listed, "/root", hot=how)
        assert kept.count() == kept.select("row_id").distinct().count() == 2000
    sliced = clean.lookup_join(
        rows.withColumn("image_key", F.expr("if(image_path LIKE '/%', image_path, '/root/' || image_path)")),
        listed.withColumnRenamed("image_path", "image_key"), ["image_key"], "left_anti", hot,
    )
    assert sliced.count() == 1000


def test_absent_and_missing_boxes(spark, raw, listed):
    bare = clean_annotations(raw.select("row_id", "image_path", "label"), listed, "/root")
    assert {tuple(r)[3:7] for r in bare.collect()} == {(0, 0, 0, 0)}
    holes = raw.withColumn("bbox_x2", F.expr("if(row_id = 1, null, if(row_id = 0, 'x', bbox_x2))"))
    with pytest.raises(Exception, match="bbox_x2|CAST_INVALID_INPUT"):
        clean_annotations(holes, listed, "/root").collect()
    kept = clean_annotations(holes, listed, "/root", missing_box="quarantine")
    assert {r.row_id: r.bbox_x2 for r in kept.collect()} == {0: None, 1: None, 2: 3}


def test_sample_size_and_repeatability(spark):
    rows = spark.range(1000).withColumnRenamed("id", "row_id")
    some = {r.row_id for r in sample_rows(rows, 100).collect()}
    assert len(some) == 100
    assert some == {r.row_id for r in sample_rows(rows.repartition(7), 100).collect()}
    assert some != {r.row_id for r in sample_rows(rows, 100, seed=1).collect()}
    assert sample_rows(rows, 0).count() == 0
    assert sample_rows(rows, 5000).count() == sample_rows(rows, None).count() == 1000
    with pytest.raises(ValueError):
        sample_rows(rows, -1)


@pytest.mark.parametrize("n", [0, 1, 7, 99, 4999, 5000, 6000])
def test_large_samples_are_cut_at_the_same_rows(spark, monkeypatch, n):
    rows = spark.range(5000).withColumnRenamed("id", "row_id").cache()
    plain = {r.row_id for r in sample_rows(rows, n).collect()}
    monkeypatch.setattr(sample, "_CELLS", 3)
    cut = [r.row_id for r in sample_rows(rows, n, in_one_task=-1 if n == 0 else 0).collect()]
    assert len(cut) == len(plain) and set(cut) == plain


def test_first_per_label_takes_first_model_with_faces(spark):
    rows = spark.createDataFrame(
        [
            (5, "p5", "c5", "Fear", "llava", "face"), (3, "p3", "c3", "Fear", "llava", "face"),
            (9, "p9", "c9", "Doubt/Confusion", "llava", "face"), (1, "p1", "c1", "Fear", "internvl", "face"),
            (0, "p0", "c0", "Fear", "qwen", "full"),
        ],
        "row_id long, image_path string, cropped_path string, label string, model_key string, context string",
    )
    got = [(r.idx, r.label, r.file_label, r.row_id) for r in first_per_label(rows).collect()]
    assert got == [(9, "Doubt/Confusion", "Doubt_Confusion", 9), (15, "Fear", "Fear", 3)]


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    """Files of 5, 50,000 and 500 rows, split at various places."""
    n = 0
    for name, rows in (("a.csv", 5), ("b.csv", 50_000), ("c.csv", 500)):
        lines = [f"img/{i}.jpg,Fear,{i}" for i in range(n, n + rows)]
        (tmp_path / name).write_text("image_path,label,n\n" + "\n".join(lines) + "\n")
        n += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_annotations(spark, str(tmp_path)).selectExpr("count(*)", "count_if(row_id = cast(n AS bigint))").first()
            assert tuple(got) == (n, n)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
