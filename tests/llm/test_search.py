import random

from pyspark.sql import functions as F

from labelscope.llm import hamming_search


def brute(rows, k, wanted):
    rows = sorted({(i, c) for i, c in rows if i is not None and c is not None})
    out = []
    for q, code in rows:
        if wanted(q):
            near = sorted((((code ^ c) % 2**64).bit_count(), i) for i, c in rows if i != q)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def run(spark, rows, k):
    table = spark.createDataFrame(rows, "id bigint, code bigint").selectExpr("*", "1 AS query", "2 AS segment", "'x' AS ids")
    return sorted(tuple(r) for r in hamming_search.top_k(table, F.col("id") % 5 == 0, k).collect())


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) - 2**63 for _ in range(6)]
    rows = [(i, rng.choice(base) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))) for i in range(150)]
    rows += [(i, base[0]) for i in range(150, 180)]  # one code of many rows: ties
    rows += [(200, rng.getrandbits(62))]  # far from everything
    rows += [rows[0], (None, 5), (205, None)]
    assert run(spark, rows, 4) == brute(rows, 4, lambda q: q % 5 == 0)


def test_few_rows(spark):
    assert run(spark, [(5, 1), (6, 3)], 10) == [(5, 1, 6, 1)]
    assert run(spark, [(5, 1)], 10) == []
    assert run(spark, [], 10) == []


def test_sign_code(spark):
    rows = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0, 2.0, None]), (3, None), (4, [])], "id int, v array<double>")
    got = {r.id: r.c for r in rows.select("id", hamming_search.sign_code(F.col("v")).alias("c")).collect()}
    assert got == {1: -1, 2: 2, 3: None, 4: 0}
