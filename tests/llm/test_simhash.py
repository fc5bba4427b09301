import random
import re

import numpy as np
import xxhash

from labelscope.llm import simhash
from labelscope.llm.queries import queries
from tests.llm.helpers import docs, edge_rows


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=3):
    """Least index reachable of every fingerprint, by comparing all pairs."""
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius)[0]:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_query_against_brute_force(spark, sf_dir):
    texts = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    fps = [fingerprint(t) for _, t in texts]
    want = {(texts[i][0], f"{fps[i]:016x}", texts[c][0]) for i, c in enumerate(components(fps))}
    assert {tuple(r) for r in queries()["op4_simhash"](spark, sf_dir).collect()} == want


def test_edges(spark):
    rows = edge_rows()
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()), key=repr)
    fps = [fingerprint(t) for _, t in rows]
    least = {}
    for i, c in enumerate(components(fps)):
        least[c] = min((x for x in (least.get(c), rows[i][0]) if x is not None), default=None)
    want = sorted(((rows[i][0], fps[i], least[c]) for i, c in enumerate(components(fps))), key=repr)
    assert got == want
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def _nodes(rng):
    """Scattered fingerprints, a dense ball of many, and a long chain of small steps."""
    centre = rng.getrandbits(64)
    ball = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)}
    chain, at = [], rng.getrandbits(64)
    for _ in range(30):
        at ^= sum(1 << b for b in rng.sample(range(64), 3))
        chain.append(at)
    return sorted({*ball, *chain, *(rng.getrandbits(64) for _ in range(300))})


def test_links_join_what_all_pairs_join(spark):
    for seed, cell in ((1, 2048), (2, 40)):  # the second cuts cells into slices
        fps = _nodes(random.Random(seed))
        table = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp bigint")
        links = [tuple(r) for r in simhash.links(table, cell=cell).collect()]
        assert all(((a ^ b) % 2**64).bit_count() <= 64 and a > b for a, b in links)
        place = {f - 2**64 if f >> 63 else f: i for i, f in enumerate(fps)}
        want = components(fps)
        found = {r.src: r.dst for r in simhash.components(simhash.links(table, cell=cell)).collect()}
        groups = {}
        for f, i in place.items():
            groups.setdefault(found.get(f, f), set()).add(i)
        expected = {}
        for i, c in enumerate(want):
            expected.setdefault(c, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 200, dtype=np.uint64)
    near = fps ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64)) ^ np.uint64(3)
    both = np.concatenate([fps, near])
    table = simhash.distance_table(both, simhash.pivots())
    i, j = simhash.verified(both, table, np.arange(200), np.arange(200, 400), 3)
    assert len(i) == 200
