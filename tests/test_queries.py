"""Every registered query against its DuckDB statement."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_file
from labelscope.plans import oracles
from labelscope.plans import queries as registered
from tests.compare import connect, duck_rows, spark_rows

QUERIES, ORACLES = registered.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_file.queries()) >= set(QUERIES)
    assert set(entry_file.oracle_sql()) >= set(ORACLES)


def test_entry_works_without_the_training_data_operators(tmp_path):
    """The folder and the pipeline may be taken away; all else stays."""
    root = Path(entry_file.__file__).parent
    shutil.copytree(root / "labelscope", tmp_path / "labelscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.split() == [str(len(QUERIES))] * 2


@pytest.mark.parametrize("module", ["zstandard", "xxhash", "corpus_pipeline"])
def test_entry_works_without_what_the_operators_need(module):
    """A module that is not there takes the training-data queries away, and nothing else."""
    code = f"import sys; sys.modules['{module}'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()))"
    root = Path(entry_file.__file__).parent
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.split() == [str(len(QUERIES))] * 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(name, spark, duck, sf_dir):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    expected_columns, expected = duck_rows(duck, ORACLES[name])
    assert columns == expected_columns
    assert len(rows) == len(expected) > 0
    for got, want in zip(rows, expected, strict=True):
        assert got == pytest.approx(want, rel=1e-9) if all(
            isinstance(v, (int, float)) for v in want
        ) else got == want


def test_entry_has_rows(spark):
    assert entry_file.entry(spark).count() == 5


# Counts worked out beforehand for the derived annotations, per scale factor.
COUNTS = {
    "sf0.001": (938, {"ok": 839, "invalid_bbox": 87, "clamped_empty": 12}, 658, 280),
    "sf0.01": (9394, {"ok": 8016, "invalid_bbox": 881, "clamped_empty": 497}, 6577, 2817),
}


def test_derived_counts(spark, sf_dir):
    rows, crops, parsed, unknown = COUNTS[sf_dir.rstrip("/").rsplit("/", 1)[-1]]
    assert QUERIES["clean_annotations"](spark, sf_dir).count() == rows
    assert {r.outcome: r.n_rows for r in QUERIES["crop_audit"](spark, sf_dir).collect()} == crops
    answers = QUERIES["parse_labels"](spark, sf_dir).where("model_key = 'qwen' AND context = 'full'")
    assert answers.where("predicted_label <> 'Unknown'").count() == parsed
    assert answers.where("predicted_label = 'Unknown'").count() == unknown
