import math
import random
import re
from collections import Counter

import pytest
import regex

from labelscope.llm import quality
from labelscope.llm.queries import queries
from tests.llm.helpers import docs, edge_rows
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_against_brute_force(spark, sf_dir):
    rows = {r.doc_id: r for r in queries()["op2_quality"](spark, sf_dir).collect()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r in texts:
        assert tuple(rows[r.doc_id][c] for c in COLUMNS) == base(r.text)
        assert not (rows[r.doc_id].kept and rows[r.doc_id].base_failed)


def test_good_texts_are_kept_and_junk_goes(spark, sf_dir):
    rows = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [rows[r.doc_id] for r in labels if r.quality == 1]
    assert all(r.kept for r in good if not r.base_failed)
    assert any(not r.kept and not r.base_failed for r in rows.values())


def test_invented_words_go_and_good_texts_stay(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest has too few texts of some languages for their spread
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(4, 8)))
    invented = [(10**9 + i, " ".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n)), "en", None, None) for i, n in enumerate((20, 200))]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in quality.judge(table.unionByName(spark.createDataFrame(invented, table.schema))).collect()}
    for i, *_ in invented:
        assert not rows[i].base_failed and rows[i].class_distance <= quality.MAX_CLASS_DISTANCE and not rows[i].kept
    good = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()]
    assert good and all(rows[i].kept for i in good if not rows[i].base_failed)


def test_edges(spark):
    rows = edge_rows() + [(10, "a b c d e f\n" * 3), (11, "l1\n\nl1\n l1\n \n")]
    got = quality.judge(docs(spark, rows)).collect()
    want = sorted(((i, *base(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in got), key=repr) == want
    assert quality.judge(docs(spark, [])).collect() == []


@pytest.mark.parametrize("p, q", [([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.2, 0.8], [0.6, 0.4])])
def test_distance(spark, p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    want = math.sqrt((kl(p) + kl(q)) / 2)
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality.jensen_shannon(F.col("p"), F.col("q")).alias("d"))
    assert row.first().d == pytest.approx(want, abs=1e-12)


def quantile(values, p):
    """The least value with a share of at least ``p`` at or below it."""
    values = sorted(values)
    return values[max(0, math.ceil(p * len(values)) - 1)]


def shares(counts):
    total = sum(counts)
    return [c / total if total else 0.0 for c in counts]


def distance(p, q):
    terms = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True))
    return math.sqrt(max(0.0, terms / 2))


def histograms(text):
    rest, counts = regex.sub(r"[\x20\x09-\x0D]+", "", text), []
    for pattern in quality.CLASSES:
        new = regex.sub(f"(?:{pattern})+", "", rest)
        counts.append(len(rest) - len(new))
        rest = new
    words = WORDS.findall(text)
    known = quality.vocabulary_of(quality.LANGUAGES)
    met = Counter(w.lower() for w in words if w.lower() in known and w in (w.lower(), w.lower().capitalize(), w.upper()))
    return [*counts, len(rest)], [met[w] for w in known], len(words)


def test_distances_and_verdicts_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    told = {r.doc_id: (r.lang, base(r.text), *histograms(r.text or "")) for r in table}
    refs = []
    for lang in quality.LANGUAGES:
        mine = [x for x in told.values() if x[0] == lang and not x[1][5] and x[4] >= quality.MIN_COMMON]
        classes = [sum(c) / len(mine) for c in zip(*(shares(x[2]) for x in mine), strict=True)]
        common = [sum(c) / len(mine) for c in zip(*(shares(x[3]) for x in mine), strict=True)]
        part = [sum(x[3]) / x[4] for x in mine]
        far = [distance(shares(x[3]), common) * math.sqrt(min(quality.MOST_COUNTED, sum(x[3]))) for x in mine if sum(x[3])]
        mid = quantile(part, 0.5)
        off = [(s - mid) * math.sqrt(x[4]) for s, x in zip(part, mine, strict=True)]
        spread = lambda v: (quantile(v, 0.75) - quantile(v, 0.25)) / 1.349
        middle = quantile(far, 0.5)
        refs.append((classes, common, mid, max(spread(off), math.sqrt(mid * (1 - mid))), middle + quality.MAX_SPREADS * max(spread(far), middle / 10)))
    rows = {r.doc_id: r for r in queries()["op2_quality"](spark, sf_dir).collect()}
    for doc_id, (_, counted, classes, common, n) in told.items():
        row, part = rows[doc_id], sum(common) / n if n else 0
        class_far = min(distance(shares(classes), r[0]) for r in refs) if sum(classes) >= quality.MIN_CHARS else None
        common_far = min(distance(shares(common), r[1]) for r in refs) if n >= quality.MIN_COMMON and part > 0 else None
        assert row.class_distance == (class_far if class_far is None else pytest.approx(class_far, abs=1e-9))
        assert row.common_distance == (common_far if common_far is None else pytest.approx(common_far, abs=1e-9))
        scaled = None if common_far is None else common_far * math.sqrt(min(quality.MOST_COUNTED, sum(common)))
        like = any(abs(part - r[2]) * math.sqrt(n) <= quality.MAX_SPREADS * r[3] and (scaled is None or scaled <= r[4]) for r in refs)
        odd = n >= quality.MIN_COMMON and not like
        assert row.kept == (not counted[5] and not odd and not (class_far is not None and class_far > quality.MAX_CLASS_DISTANCE)), doc_id
    assert any(r.class_distance is not None and not r.kept for r in rows.values())
