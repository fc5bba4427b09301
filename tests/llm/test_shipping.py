"""What runs in tasks must not need the package on the executor."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from labelscope.llm import bpe, common, importance, langid, periodic, simhash, suffix_dedup, urls, warc

LOAD = "import sys, pickle; print(pickle.load(sys.stdin.buffer)); assert 'labelscope' not in sys.modules"


@pytest.mark.parametrize("thing", [
    bpe.Codec, common.by_slices(len, "text"), langid._Summer, langid.Model, simhash.fingerprint, simhash._runs_to_links(3, 8),
    importance.Buckets, importance._median, periodic.find_runs, suffix_dedup.Block, suffix_dedup._answer(2), urls.Index, urls.HOST_RULES, warc._Archives, warc.frames, warc.parse, warc.record,
])
def test_loads_without_the_package(thing, tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", LOAD], input=cloudpickle.dumps(thing), cwd=tmp_path,
        env={"PATH": "/usr/bin:/bin"}, capture_output=True, check=False, timeout=120,
    )
    assert done.returncode == 0, done.stderr.decode()
