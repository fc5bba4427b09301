import hashlib
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelscope.llm import mixing
from labelscope.llm.queries import queries
from tests.llm.helpers import docs, edge_rows


def test_targets_by_hand():
    # 150 % of 160 is 240; a weighs 5, b 2, null 1. a is capped at 20, the rest goes 2:1.
    got = mixing.targets({"b": 100, None: 50, "a": 10})
    assert list(got) == ["a", "b", None]
    assert got == pytest.approx({"a": 20.0, "b": 220 * 2 / 3, None: 220 / 3})
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0}) == {"a": 0.0}


def _cheapest(capacity, members, quota, repeats):
    """Most words at least cost, by trying all flows."""
    arcs = [(p, s) for p, m in enumerate(members) for s in m]
    best = (0, 0)
    for sent in itertools.product(*[range(repeats * capacity[p] + 1) for p, _ in arcs]):
        by_p, by_s = Counter(), Counter()
        for (p, s), w in zip(arcs, sent, strict=True):
            by_p[p] += w
            by_s[s] += w
        if all(by_s[s] <= q for s, q in enumerate(quota)) and all(by_p[p] <= repeats * c for p, c in enumerate(capacity)):
            cost = sum(max(0, by_p[p] - use * c) for p, c in enumerate(capacity) for use in range(1, repeats))
            best = min(best, (-sum(sent), cost))
    return -best[0], best[1]


def test_flow_is_largest_and_cheapest():
    rng = random.Random(2)
    for _ in range(25):
        capacity = [rng.randint(0, 3) for _ in range(3)]
        members = [rng.choice([[0], [1], [0, 1]]) for _ in range(3)]
        quota = [rng.randint(0, 6), rng.randint(0, 6)]
        flow = mixing.min_cost_flow(capacity, members, quota, 2)
        total = sum(flow.sent.values())
        cost = sum(max(0, flow.of_pattern(p) - c) for p, c in enumerate(capacity))
        assert (total, cost) == _cheapest(capacity, members, quota, 2)
        for s, q in enumerate(quota):
            assert sum(w for (_, t), w in flow.sent.items() if t == s) <= q


def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in queries()["op6_mixing"](spark, sf_dir).collect()}
    again = {r.doc_id: r for r in queries()["op6_mixing"](spark, sf_dir).collect()}
    assert rows == again
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in texts:
        n = len([w for w in (r.text or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
        assert rows[r.doc_id].size == n
        assert rows[r.doc_id].taken in (0, n, 2 * n)
        sizes[r.source] += n
        taken[r.source] += rows[r.doc_id].taken
        largest[r.source] = max(largest[r.source], n)
    wanted = mixing.targets(sizes)
    for r in texts:
        assert rows[r.doc_id].target == pytest.approx(wanted[r.source])
        assert rows[r.doc_id].source_size == sizes[r.source]
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in wanted)
    # Few documents a source here: whole ones come within a word of every target that they can reach.
    assert all(abs(taken[s] - wanted[s]) <= 0.01 * wanted[s] + 1 for s in wanted)


def test_exact_fill():
    rng = random.Random(7)
    for _ in range(300):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(0, 8))]
        room = rng.randint(0, 40)
        taken = mixing.exact_fill(sizes, room)
        sums = [sum(itertools.compress(sizes, pick)) for pick in itertools.product([0, 1], repeat=len(sizes))]
        assert sum(itertools.compress(sizes, taken)) == min(sums, key=lambda x: (abs(x - room), x))
    assert mixing.exact_fill([3, 3, 3], 6) == [True, True, False]


def test_both_ways_agree_on_targets(spark, sf_dir, monkeypatch):
    """Patterns filled exactly and by first fit: exact ones miss less, first fit never exceeds what was sent."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = []
    for few in (0, 128):
        monkeypatch.setattr(mixing, "FEW_PLACES", few)
        got, plan = mixing.mix(table, F.array("source"))
        taken = {r.s: r.n for r in got.groupBy(F.col("members")[0].alias("s")).agg(F.sum(F.col("uses") * F.col("size")).alias("n")).collect()}
        short.append({r.source: r.sent - taken[r.source] for r in plan.sources.collect()})
    assert all(abs(short[1][s]) <= short[0][s] for s in short[0])


def test_mix_is_first_fit(spark, monkeypatch):
    """One very long document early in the order, and ids with several rows."""
    rng = random.Random(4)
    monkeypatch.setattr(mixing, "FEW_PLACES", 0)
    rows = [(i, rng.choice([1, 2, 3, 5, 8, 40, 90]), "ab"[i % 2]) for i in range(160)]
    rows += [(i, rng.choice([4, 30]), "ab"[i % 2]) for i in range(0, 160, 9)]
    order = lambda i: int(hashlib.md5(f"17_{i}".encode()).hexdigest()[:15], 16)
    rows += [(next(i for i in range(1000, 9000) if order(i) < 1 << 50), 1500, "a")]
    table = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id int, text string, source string")
    got, plan = mixing.mix(table, F.array("source"), share=0.9)
    sent = {r.source: r.sent for r in plan.sources.collect()}
    want, rounds = {}, 0
    for s in "ab":
        places, total = Counter(), sum(n for _, n, x in rows if x == s)
        for i, n, x in rows:
            places[i] += n * (x == s)
        full, gap = divmod(sent[s], total)
        for i in sorted((i for i in places if places[i]), key=order):
            fits = places[i] <= gap
            want[i] = full + fits
            rounds += not fits
            gap -= places[i] * fits
        taken = sum(r.uses * r.size for r in got.collect() if r.members == [s])
        assert taken == sent[s] - gap and (s == "b" or gap < 10)
    assert rounds and {r.id: r.uses for r in got.collect()} == want


def test_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 5), ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", None]) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id int, text string, sources array<string>")
    used, plan = mixing.mix(table, F.col("sources"))
    got = used.collect()
    total = sum(r.uses * r.size for r in got)
    targets = {r.source: r.target for r in plan.sources.collect()}
    sent = {r.source: r.sent for r in plan.sources.collect()}
    assert set(targets) == {"a", "b", None} and all(sent[s] <= round(targets[s]) for s in sent)
    assert abs(total - sum(sent.values())) <= 3 * 5
    assert all(0 <= r.uses <= 2 for r in got)


def test_partitioning_does_not_matter(spark):
    rows = [(i, "w " * (1 + i % 7), ["a"] if i % 3 else ["b"]) for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id int, text string, sources array<string>")
    one = {r.id: r.uses for r in mixing.mix(table.coalesce(1), F.col("sources"))[0].collect()}
    assert one == {r.id: r.uses for r in mixing.mix(table.repartition(7, "doc_id"), F.col("sources"))[0].collect()}


def test_edges(spark):
    table = docs(spark, [(i, t, None, None if i == 1 else "s") for i, t in edge_rows()])
    used, plan = mixing.mix(table, F.array("source"))
    assert all((r.uses == 0) for r in used.collect() if r.size == 0)
    assert used.count() == len(edge_rows())
    assert {r.source for r in plan.sources.collect()} == {"s", None}
    again = mixing.repeated(table, F.array("source"))
    assert again.columns == table.columns
    assert again.count() == used.agg(F.sum("uses")).first()[0]
    assert mixing.mix(docs(spark, []), F.array("source"))[0].collect() == []
    assert mixing.repeated(docs(spark, []), F.array("source")).collect() == []
