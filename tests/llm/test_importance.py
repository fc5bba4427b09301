import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelscope.llm import importance
from labelscope.llm.queries import queries
from tests.llm.helpers import docs, edge_rows


def features(text, longest=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(words), [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows, straight from the definition."""
    bucket = lambda f: crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    of_s, of_t = sum(s.values()), sum(t.values())
    scored = []
    for doc_id, text in rows:
        n_words, found = features(text, longest)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (of_s + buckets) / ((s[b] + 1) * (of_t + buckets))))
            for b in map(bucket, found)
        )
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append([doc_id, len(found), weight, score, None, n_words])
    entered = [r for r in scored if r[5] >= least]
    entered.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(entered[: len(entered) * percent // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in scored), key=repr)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_against_brute_force(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = [tuple(r) for r in read("documents").select("doc_id", "text").collect()]
    want = brute(rows, [r.text for r in read("benchmark").collect()])
    assert plain(queries()["op12_importance"](spark, sf_dir).collect()) == want
    assert sum(r[4] is not None for r in want) > 10


@pytest.mark.parametrize("settings", [{"longest": 2}, {"buckets": 7, "percent": 100}, {"least": 0, "percent": 50}, {"percent": 0}])
def test_settings(spark, settings):
    rows = [*edge_rows(), *[(i, f"word{i % 7} and more words " * (i % 11)) for i in range(10, 90)]]
    names = {"least": "least_words"}
    target = docs(spark, [(1, "and MORE words"), (2, None)])
    got = importance.draw(docs(spark, rows), target, **{names.get(k, k): v for k, v in settings.items()})
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert plain(got.collect()) == brute(rows, ["and MORE words", None], **settings)


@pytest.mark.parametrize("few", [1, 40])
def test_cut_is_exact(spark, few):
    rng = np.random.default_rng(8)
    for spread in (3, 10**9):  # many ties, none
        rows = [(int(a), None if b == 0 else int(b), int(c)) for a, b, c in zip(
            rng.integers(-spread, spread, 900), rng.integers(0, 40, 900), rng.integers(0, 3, 900), strict=True)]
        order = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
        keys = spark.createDataFrame(rows, "less bigint, id bigint, n_features bigint").repartition(7, F.col("id") % 5).cache()
        for winners in (1, 2, 333, 899, 900):
            assert importance.last_winner(keys, winners, few) == order[winners - 1]
        keys.unpersist()


def test_a_round_discards_a_quarter(spark):
    """The pivot has at least a quarter of the keys on either side, whatever the partitions hold."""
    parts = [np.arange(5000), np.arange(100, 110), np.repeat(7, 900), np.arange(-4000, 0)]
    medians = []
    for part in parts:
        batch = pa.RecordBatch.from_arrays([pa.array(part), pa.array(part), pa.array(part)], ["less", "id", "n_features"])
        medians += [r for b in importance._median(iter([batch])) for r in b.to_pylist()]
    total, reached = sum(m["n"] for m in medians), 0
    for row in sorted(medians, key=lambda m: m["less"]):
        reached += row["n"]
        if 2 * reached >= total:
            break
    every = np.concatenate(parts)
    assert min((every <= row["less"]).sum(), (every >= row["less"]).sum()) >= total // 4


def test_empty(spark):
    assert importance.draw(docs(spark, []), docs(spark, [])).collect() == []
    got = importance.draw(docs(spark, [(1, "a " * 30)] * 10), docs(spark, []), percent=50).collect()
    assert sorted(str(r["rank"]) for r in got) == ["1", "2", "3", "4", "5"] + ["None"] * 5
