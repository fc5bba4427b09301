"""Scoring, resuming and measuring."""

import pytest
from pyspark.sql import functions as F

from labelscope.domain import CLASSES, METRICS, runs
from labelscope.operators import compare, metrics, resume, score
from labelscope.operators.joins import hot_hashes

ROWS = "row_id long, image_path string, bbox_x1 long, bbox_y1 long, bbox_x2 long, bbox_y2 long"


class Shouting(score.Predictor):
    """Answers with its image; refuses some."""

    def load(self):
        self.loaded = True

    def predict(self, image, prompt):
        if image == "bad":
            raise RuntimeError("cannot look")
        return f"{image}!" if self.loaded and prompt.startswith("Cropped") else None


class NeverLoads(score.Predictor):
    def load(self):
        raise RuntimeError("service is away")

    def predict(self, image, prompt):
        return None


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [(0, "a", 0, 0, 1, 1), (1, "a", 0, 0, 2, 2), (2, "b", 0, 0, 1, 1), (3, "gone", 0, 0, 1, 1), (4, None, 0, 0, 1, 1)],
        ROWS,
    )


@pytest.fixture
def images(spark):
    return spark.createDataFrame([("a", "joy and fear"), ("b", "bad"), ("c", "x")], "image_path string, image string")


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("slices", [True, False])
def test_every_row_is_scored_once(rows, images, once, slices):
    hot = hot_hashes(rows, ["image_path"]) if slices else None
    out = score.score(rows, images, Shouting, "face", tasks=2, once_per_image=once, hot=hot)
    got = {r.row_id: (r.raw_output, r.predicted_label, r.error) for r in out.collect()}
    assert got == {
        0: ("joy and fear!", "Fear", None), 1: ("joy and fear!", "Fear", None),
        2: (None, "Unknown", "cannot look"), 3: (None, "Unknown", None), 4: (None, "Unknown", None),
    }
    assert out.columns[: len(rows.columns)] == rows.columns or set(rows.columns) < set(out.columns)
    status = {r.row_id: r.scorable for r in score.with_status(rows, images, hot=hot).collect()}
    assert status == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_null_answer_is_unknown(rows, images):
    out = score.score(rows, images, Shouting, "full").where("row_id = 0").first()
    assert (out.raw_output, out.predicted_label, out.error) == (None, "Unknown", None)


def test_failing_load_fails_the_job(rows, images):
    with pytest.raises(Exception, match="service is away"):
        score.score(rows, images, NeverLoads, "full").collect()


def test_answered_keeps_null(spark):
    rows = spark.createDataFrame([("Fear",), ("Unknown",), (None,)], "predicted_label string")
    assert [r[0] for r in score.answered(rows).collect()] == ["Fear", None]


@pytest.mark.parametrize("slices", [True, False])
def test_remaining(spark, rows, slices):
    def ids(**kw):
        if slices:
            kw["hot"] = hot_hashes(rows, list(kw.get("key", resume.PERSON_KEY)))
        return sorted(r.row_id for r in resume.remaining(rows, stored, **kw).collect())

    stored = spark.createDataFrame(
        [("a", 0, 0, 1, 1, "Fear"), ("a", 0, 0, 1, 1, "Fear"), ("b", 0, 0, 1, 1, "Unknown"), (None, 0, 0, 1, 1, "Fear")],
        ROWS.replace("row_id long, ", "") + ", predicted_label string",
    )
    assert ids() == [1, 3, 4]
    assert ids(key=["image_path"]) == [3, 4]
    assert ids(retry_unknown=True) == [1, 2, 3, 4]
    assert tuple(resume.resume_audit(rows, stored).first()) == (4, 3)
    stored = stored.limit(0)
    assert ids() == [0, 1, 2, 3, 4]
    both = resume.merged_results(stored, rows)
    assert both.count() == 5 and "predicted_label" in both.columns


def results(spark, pairs, model="qwen", context="full"):
    data = [(i, model, context, t, p) for i, (t, p) in enumerate(pairs)]
    return spark.createDataFrame(
        data, "row_id long, model_key string, context string, label string, predicted_label string"
    )


def measured(frame, requested=None):
    return metrics.metrics(metrics.answer_cells(frame, requested)).first()


def by_definition(pairs):
    """Metrics as their definitions read, over the fixed class list."""
    pairs = [(t, p) for t, p in pairs if p != "Unknown"]
    rows = []
    for c in CLASSES:
        hits = sum(t == p == c for t, p in pairs)
        said, true = sum(p == c for _, p in pairs), sum(t == c for t, _ in pairs)
        rows.append((hits / said if said else 0, hits / true if true else 0, 2 * hits / (said + true) if said + true else 0, true))
    total = sum(r[3] for r in rows)
    macro = [sum(r[i] for r in rows) / len(rows) for i in range(3)]
    weighted = [sum(r[i] * r[3] for r in rows) / total for i in range(3)]
    return [sum(t == p for t, p in pairs) / len(pairs), *macro, *weighted]


def test_metrics_by_definition(spark):
    import random

    rng = random.Random(3)
    pairs = [(rng.choice(CLASSES[:9]), rng.choice([*CLASSES[4:14], "Unknown"])) for _ in range(700)]
    row = measured(results(spark, pairs))
    assert [row[m] for m in METRICS] == pytest.approx(by_definition(pairs), abs=5.1e-5)
    matrix = metrics.confusion(metrics.answer_cells(results(spark, pairs))).collect()
    assert len(matrix) == 676 and sum(r.n for r in matrix) == sum(p != "Unknown" for _, p in pairs)
    assert row.recall_weighted == row.accuracy


def test_perfect_wrong_and_tie(spark):
    perfect = measured(results(spark, [(c, c) for c in CLASSES]))
    assert [perfect[m] for m in METRICS] == [1.0] * 7
    wrong = measured(results(spark, [("Fear", "Pain"), ("Pain", "Fear")]))
    assert [wrong[m] for m in METRICS] == [0.0] * 7
    tie = measured(results(spark, [("Fear", "Fear")] + [("Fear", "Pain")] * 31))
    assert tie.accuracy == 0.0312  # 1/32 to the even side


def test_empty_runs_are_zero(spark):
    frame = results(spark, [("Fear", "Unknown")])
    cells = metrics.answer_cells(frame, runs(spark, ["qwen", "llava"], ("full",)))
    rows = metrics.metrics(cells).collect()
    assert len(rows) == 2 and all(r[m] == 0.0 for r in rows for m in METRICS)
    assert metrics.confusion(cells).agg({"n": "sum"}).first()[0] == 0
    assert metrics.confusion(cells).count() == 2 * 676
    none = metrics.answer_cells(frame.limit(0), runs(spark, ["qwen"], ("full",)))
    assert [metrics.metrics(none).first()[m] for m in METRICS] == [0.0] * 7


def test_rows_outside_the_domain_count_in_accuracy_only(spark):
    row = measured(results(spark, [("Fear", "Fear"), ("Odd", "Odd"), ("Fear", "Odd"), ("Odd", None)]))
    assert row.accuracy == 0.5 and row.recall_macro == round(0.5 / 26, 4)
    cells = metrics.answer_cells(results(spark, [("Odd", "Fear"), ("Fear", "Odd")]))
    assert metrics.confusion(cells).agg({"n": "sum"}).first()[0] == 0


def test_results_do_not_depend_on_partitioning(spark):
    pairs = [(CLASSES[i * 7 % 26], CLASSES[i * i % 26]) for i in range(500)]
    frame = results(spark, pairs)
    assert measured(frame) == measured(frame.repartition(13))


# --- full against face -------------------------------------------------------


def brute_pairs(full, face, helped):
    return [
        (f[0], c[0]) for f in full for c in face
        if f[1] == c[1] and ((f[3] == f[2] and c[3] != f[2]) if helped else (f[3] != f[2] and c[3] == f[2]))
    ]


@pytest.mark.parametrize("slices", [True, False])
def test_image_pairs_against_brute_force_on_a_hot_image(spark, slices):
    import random

    rng = random.Random(11)
    some = [*CLASSES[:4], "Unknown"]

    def side(context):
        # One image holds a third of the rows.
        return [
            (i, "hot" if i % 3 == 0 else f"i{i % 20}", CLASSES[i % 4], rng.choice(some), context)
            for i in range(240)
        ]

    full, face = side("full"), side("face")[::2]
    frame = spark.createDataFrame(
        [("qwen", *r, f"c{r[0]}", r[0] // 2, 0, 9999, 1) for r in full + face],
        "model_key string, row_id long, image_path string, label string, predicted_label string, context string, cropped_path string,"
        " bbox_x1 long, bbox_y1 long, bbox_x2 long, bbox_y2 long",
    )
    hot = hot_hashes(frame, ["model_key", "image_path"]) if slices else None
    pairs = compare.pairs_by_image(frame, hot)
    counts = compare.context_cases_by_image(pairs).first()
    everything = [(f, c) for f in full for c in face if f[1] == c[1]]
    helped, hurt = (brute_pairs(full, face, h) for h in (True, False))
    assert (counts.n_pairs, counts.n_helped, counts.n_hurt) == (len(everything), len(helped), len(hurt))
    for is_helped, want in ((True, helped), (False, hurt)):
        got = compare.cases_by_image(frame, pairs, is_helped, n=40).orderBy("rank").collect()
        assert [(r.row_id, r.face_row_id) for r in got] == sorted(want)[:40]

    # Persons: two rows share a box, and share the first face answer if it is one image.
    person_hot = hot_hashes(frame, ["model_key", *resume.PERSON_KEY]) if slices else None
    one_to_one = compare.context_pairs(frame, person_hot)
    first = {}
    for c in face:
        first.setdefault((c[1], c[0] // 2), c)
    paired = [(f, first[f[1], f[0] // 2]) for f in full if (f[1], f[0] // 2) in first]
    assert one_to_one.count() == len(paired) >= len(face)
    top = compare.context_helped(one_to_one, n=5).orderBy("rank").collect()
    assert [r.row_id for r in top] == [f[0] for f, c in paired if f[3] == f[2] != c[3]][:5]
    plan = compare.context_helped(one_to_one)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # each task passes on six rows per model at most


def test_comparison_order_and_absent_runs(spark):
    cells = metrics.answer_cells(
        results(spark, [("Fear", "Fear")], "internvl")
        .unionByName(results(spark, [("Fear", "Fear")], "qwen", "face"))
        .unionByName(results(spark, [("Fear", "Pain")], "qwen"))
        .unionByName(results(spark, [("Fear", "Pain")], "stranger"))
    )
    table = metrics.metrics(cells)
    assert [(r.ord, r.Task, r.Accuracy) for r in compare.comparison(table).collect()] == [
        (0, "Full Image", 0.0), (0, "Face Only", 1.0), (2, "Full Image", 1.0)
    ]
    f1 = [(r.model_key, r.f1_full, r.f1_face) for r in compare.f1_compare(table).collect()]
    assert f1 == [("qwen", 0.0, 0.0385), ("internvl", 0.0385, 0.0)]
    recall = compare.recall_compare(metrics.class_recall(metrics.confusion(cells))).where("cls = 'Fear'").collect()
    assert [(r.model_key, r.recall_full, r.recall_face) for r in recall] == [("qwen", 0.0, 1.0), ("internvl", 1.0, 0.0)]


class Odd(score.Predictor):
    """Answers some images with numbers."""

    def predict(self, image, prompt):
        return 7 if image == "two" else "Fear"


def test_wrong_answers_and_read_errors_spoil_their_row_only(spark):
    rows = spark.range(4).selectExpr("id AS row_id", "concat('i', id) AS image_path")
    images = spark.createDataFrame(
        [("i0", "one", None), ("./i1", "two", None), ("i2", None, "read: slow down")], "image_path string, image string, read_error string"
    )
    got = {r.row_id: (r.predicted_label, r.error) for r in score.score(rows, images, Odd, "full").collect()}
    assert got == {
        0: ("Fear", None), 1: ("Unknown", "an answer of type int"), 2: ("Unknown", "read: slow down"), 3: ("Unknown", None)
    }
    stored = spark.createDataFrame([("i0", None), ("i2", "read: slow down")], "image_path string, error string")
    left = resume.remaining(rows, stored.withColumn("predicted_label", F.lit("Fear")), ["image_path"])
    assert {r.row_id for r in left.collect()} == {1, 2, 3}


def test_first_rows_for_any_n(spark):
    """No ranking over all rows of a model, however long the list."""
    pairs = spark.range(5000).selectExpr(
        "id AS row_id", "'i' AS image_path", "if(id % 2 = 0, 'a', 'b') AS model_key", "'Fear' AS label",
        "if(id % 10 = 0, 'Anger', 'Fear') AS predicted_label_full", "'Anger' AS predicted_label_face",
    )
    for n in (6, 2000):
        helped = compare.context_helped(pairs, n)
        want = {(m, i) for m, rest in (("a", 0), ("b", 1)) for i in [i for i in range(rest, 5000, 2) if i % 10][:n]}
        assert {(r.model_key, r.row_id) for r in helped.collect()} == want
        plan = helped._jdf.queryExecution().executedPlan().toString()
        # A window sees slices of a model, or counted ranges of its rows.
        assert "hashpartitioning(model_key" in plan and "_slice" in plan if n == 6 else "_low" in plan
