"""Functions that run in tasks must not need the package on the executor."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from labelscope.operators import crop, score
from labelscope.plans.fixtures import PropsPredictor
from labelscope.sources import images

LOAD = "import sys, pickle; print(pickle.load(sys.stdin.buffer)); assert 'labelscope' not in sys.modules"


@pytest.mark.parametrize(
    "function",
    [crop._cut_batches, score._answers(PropsPredictor, "prompt", ["a"]), images._contents, images._only_files],
)
def test_function_loads_without_the_package(function, tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", LOAD], input=cloudpickle.dumps(function), cwd=tmp_path,
        env={"PATH": "/usr/bin:/bin"}, capture_output=True, check=False, timeout=120,
    )
    assert done.returncode == 0, done.stderr.decode()
