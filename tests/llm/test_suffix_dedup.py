import hashlib
import random

import numpy as np
import pytest

from labelscope.llm import suffix_dedup
from labelscope.llm.queries import queries
from tests.llm.helpers import docs, edge_rows


def removed(texts, length):
    """Covered bytes of each text, by looking every string up."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    covers = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                cover[i:i + length] = True
        covers.append(cover)
    return covers


def n_runs(cover):
    return int(np.count_nonzero(np.diff(cover.astype(np.int8), prepend=0) == 1))


def check(spark, rows, **settings):
    texts = [(t or "").encode() for _, t in rows]
    covers = removed(texts, settings.get("length", 400))
    want = sorted(
        (repr(i), len(t), n_runs(c), bytes(np.frombuffer(t, np.uint8)[~c])) for (i, _), t, c in zip(rows, texts, covers, strict=True)
    )
    got = suffix_dedup.without_repeats(docs(spark, rows), **settings)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    rows = got.collect()
    assert sorted((repr(r.doc_id), r.n_bytes, len(r.spans), bytes(r.kept)) for r in rows) == want
    for r in rows:
        assert sum(s.stop - s.start for s in r.spans) == r.n_bytes - len(r.kept)
    return covers


@pytest.mark.parametrize(("length", "block"), [(20, 300), (23, 1 << 20), (60, 700), (64, 100)])
def test_random_texts(spark, length, block):
    """Passages at all offsets, shorter, as long and longer than the limit, next to and in each other."""
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [word(n) for n in (length - 2, length - 1, length, length + 1, length + 7, 2 * length, 5 * length)]
    rows = []
    for i in range(120):
        parts = [word(rng.randrange(3 * length))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p)) if rng.random() < 0.3 else 0
            parts += [p[cut:], word(rng.choice([0, 0, 1, 9, length]))]
        rows.append((i, "".join(parts)))
    rows += [(200, "ab" * 3 * length), (201, "z" * (length + 1)), (202, "z" * length), (203, "q" * length), (204, rows[5][1])]
    covers = check(spark, rows, length=length, block_bytes=block, bucket_keys=500)
    assert any(c.any() and not c.all() for c in covers)


def test_one_passage_everywhere(spark):
    """A third of the rows share a passage, a third are one text."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared, whole = word(450), word(900)
    rows = [(i, word(rng.randrange(300)) + shared + word(rng.randrange(300)) if i % 3 == 0 else whole if i % 3 == 1 else word(600)) for i in range(240)]
    check(spark, rows, block_bytes=4000, bucket_keys=3000)


def test_edges(spark):
    rows = [*edge_rows(), (9, "x" * 399), (10, "y" * 400), (11, "end" + "w" * 401)]
    check(spark, rows)
    assert suffix_dedup.without_repeats(docs(spark, [])).collect() == []
    assert [bytes(r.kept) for r in suffix_dedup.without_repeats(docs(spark, [(1, "short")])).collect()] == [b"short"]
    with pytest.raises(ValueError, match="20 bytes"):
        suffix_dedup.repeated_spans(docs(spark, []), length=10)


def test_anchors_agree_wherever_a_string_stands():
    rng = np.random.default_rng(3)
    string = rng.integers(0, 4, 40, np.uint8)
    keys = []
    for _ in range(20):
        data = np.concatenate([rng.integers(0, 4, rng.integers(0, 90), np.uint8), string, rng.integers(0, 4, rng.integers(0, 90), np.uint8)])
        at = len(data) - np.arange(len(data))
        keys.append(set(suffix_dedup.anchors(data, at, 40)[1].tolist()))
    assert set.intersection(*keys)


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    covers = dict(zip(texts, removed(list(texts.values()), 400), strict=True))
    rows = queries()["op11_suffixes"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text, cover = texts[r.doc_id], covers[r.doc_id]
        kept = bytes(np.frombuffer(text, np.uint8)[~cover])
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), int(cover.sum()), n_runs(cover))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert sum(r.n_removed > 0 for r in rows) > 5
