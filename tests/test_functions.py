"""Column builders on hand-made rows."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from labelscope.domain import CLASSES, select_models
from labelscope.functions.boxes import target_size
from labelscope.functions.paths import crop_name, extension, path_key, resolve_path
from labelscope.functions.text import (
    base64_line, file_safe, prompt_for, prompt_text, request_payload, strip, with_parsed_label,
)

PARSED = [
    (None, "Unknown"), ("", "Unknown"), ("  ", "Unknown"), ("Happiness", "Happiness"),
    ("happiness.", "Happiness"), (" ..Fear.. ", "Fear"), ("Fear .", "Fear"),
    ("sadness, not anger", "Anger"), ("unhappiness", "Happiness"), ("Displeasure", "Pleasure"),
    ("doubt / confusion", "Unknown"), ("DOUBT/CONFUSION", "Doubt/Confusion"), ("happy", "Unknown"),
    ("\tPeace\n", "Peace"), ("disengagement and fear", "Engagement"), ("...", "Unknown"),
]


def parsed(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_output string")
    return [r.predicted_label for r in with_parsed_label(rows).orderBy("i").collect()]


def test_parse_edge_rows(spark):
    assert parsed(spark, [t for t, _ in PARSED]) == [want for _, want in PARSED]


def by_rule(raw):
    """The parsing rule as it is stated: exact match first, then containment in order."""
    if not raw:
        return "Unknown"
    text = raw.strip().strip(".").lower()
    exact = [c for c in CLASSES if c.lower() == text]
    inside = [c for c in CLASSES if c.lower() in text]
    return (exact + inside + ["Unknown"])[0]


def test_parse_agrees_with_rule_on_random_texts(spark):
    rng = random.Random(7)
    pieces = [*CLASSES, *[c.lower() for c in CLASSES], ".", " ", " ", "un", "İ", "K", ", not ", "y", "?"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 5))) for _ in range(3000)]
    assert parsed(spark, texts) == [by_rule(t) for t in texts]


def test_no_class_contains_another():
    names = [c.lower() for c in CLASSES]
    assert not [(a, b) for a in names for b in names if a != b and a in b]
    assert not [n for n in names if n != n.strip() or "." in n]


def test_strip_is_python_strip(spark):
    blanks = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = ["".join([b, "a", b, "b", b]) for b in blanks] + ["x\n\n", "\n", "", " a \n "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in rows.select("i", strip(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [t.strip() for t in texts]


def test_prompts_and_payload(spark):
    row = spark.range(1).select(
        prompt_text(F.lit("full")).alias("full"), prompt_text(F.lit("other")).alias("other"),
        base64_line(F.lit(bytes(range(200)))).alias("b"),
        request_payload(F.lit("p"), F.lit("i")).alias("payload"), file_safe(F.lit("a/b")).alias("safe"),
    ).first()
    assert row.full == prompt_for("full") and row.other == prompt_for("face")
    assert row.full.startswith("Full scene image with person and background.\nClassify")
    assert ", ".join(CLASSES) in row.other and "\n" not in row.b and len(row.b) == 268
    assert row.payload == (
        '{"model":"llava-phi3","prompt":"p","images":["i"],"stream":false,'
        '"options":{"temperature":0,"num_predict":20}}'
    )
    assert row.safe == "a_b"


PATHS = [
    "a.jpg", "a", ".jpg", "a.", "a..b", "..b", "x.y/c", "x/.a.b", "a.b.c", "/r/im.JPEG", "...a.b",
    "x/..", "d.e/.f", "line\nbreak.png",
]


def test_extension_and_crop_name(spark):
    rows = spark.createDataFrame([(p, -1, 2, 30, 4) for p in PATHS], "p string, a long, b long, c long, d long")
    got = rows.select("p", extension("p").alias("e"), crop_name("p", list("abcd")).alias("n")).collect()
    for r in got:
        ext = os.path.splitext(r.p)[1] or ".jpg"
        assert r.e == ext
        assert r.n == f"crop_{hashlib.md5(f'{r.p}_-1_2_30_4'.encode()).hexdigest()[:12]}{ext}"


def test_resolve_and_path_key(spark):
    names = [" a.jpg\n", "/abs/b.jpg", "./a//b.jpg", "x/../y.jpg", "../../../z", None, "..", "a..b/.c"]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    full = rows.select(resolve_path(F.col("p"), "/root").alias("q"))
    got = full.select("q", path_key("q").alias("k")).collect()
    for name, r in zip(names, got, strict=True):
        joined = os.path.join("/root", str("nan" if name is None else name).strip())
        assert (r.q, r.k) == (joined, os.path.normpath(joined))


def test_target_size_matches_float_arithmetic(spark):
    rows = spark.range(1, 4000).selectExpr("id AS w", "id * 7919 % 3000 + 1 AS h")
    for r in rows.select("w", "h", *[c.alias(n) for c, n in zip(target_size("w", "h"), "ab", strict=True)]).collect():
        scale = 512 / max(r.w, r.h)
        want = (int(r.w * scale), int(r.h * scale)) if max(r.w, r.h) > 512 else (r.w, r.h)
        assert (r.a, r.b) == want


def test_select_models():
    assert select_models() == ["qwen", "llava", "internvl"] and select_models("llava") == ["llava"]
    with pytest.raises(ValueError, match="qwen"):
        select_models("nobody")
