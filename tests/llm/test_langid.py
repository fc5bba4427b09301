import zlib

import numpy as np
import pytest

from labelscope.llm import langid
from labelscope.llm.queries import queries
from tests.llm.helpers import docs, edge_rows


def test_query_held_out_accuracy(spark, sf_dir):
    rows = queries()["op8_langid"](spark, sf_dir).collect()
    again = queries()["op8_langid"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sum(r.accepted for r in held) >= 0.97 * len(held)


def test_only_the_text_counts(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(langid.training_sample(table.where(~langid.held_out(table.doc_id))))
    moved = table.selectExpr("doc_id + 1000000 AS doc_id", "text", "'xx' AS lang", "null AS source")
    one = {r.doc_id + 1_000_000: (r.lang_pred, r.score) for r in langid.predict(table, model).collect()}
    assert one == {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(moved, model).collect()}


def test_sample_is_bounded(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample = langid.training_sample(table, rows=10, chars=1000)
    per = [sum(lang == x for x, _ in sample) for lang in {x for x, _ in sample}]
    assert max(per) <= 10 and all(len(t) <= 1000 for _, t in sample)
    assert sample == langid.training_sample(table.repartition(5), rows=10, chars=1000)


def test_edges(spark):
    texts = [("en", "the house and the garden"), ("de", "das haus und der garten"), ("fr", "la maison et le jardin")]
    model = langid.train([(lang, t) for lang, t in texts for _ in range(20)])
    rows = edge_rows() + [(30, "123 !!! *** ½ Ⅷ²"), (31, "das haus und der garten")]
    got = sorted(((r.doc_id, r.lang_pred, r.accepted) for r in langid.predict(docs(spark, rows), model).collect()), key=repr)
    assert [g[0] for g in got] == [i for i, _ in sorted(rows, key=repr)] or len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    assert all(by[i] == ("und", False) for i in (1, 2, 3, 30))
    assert by[31] == ("de", True)
    nothing = langid.identify(docs(spark, [(1, "text"), (2, "more")]))
    assert {tuple(r) for r in nothing.collect()} == {(1, "und", 0.0, False), (2, "und", 0.0, False)}
    assert langid.identify(docs(spark, [])).collect() == []


def test_prediction_is_a_mean_of_embeddings(spark, sf_dir):
    """Every row against the plain mean over all its features."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(langid.training_sample(table), steps=60)
    got = {r.doc_id: r for r in langid.predict(table, model).collect()}
    for r in table.select("doc_id", "text").collect():
        features = [f for w in langid.words_of(r.text) for f in langid.word_features(w)]
        row = got[r.doc_id]
        if not features:
            assert (row.lang_pred, row.score, row.accepted) == ("und", 0.0, False)
            continue
        logits = (model.weights[features].mean(axis=0) + model.bias) / model.temperature
        chances = np.exp(logits - logits.max())
        chances /= chances.sum()
        assert row.lang_pred == model.languages[int(chances.argmax())]
        assert row.score == pytest.approx(chances.max(), abs=1e-9)
        assert row.accepted == (row.score >= model.threshold)


def test_languages_of_long_texts_are_learned(spark):
    """All texts of one language are longer than a window; those of the other are short."""
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(3, 9)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [(i, text("abcdefgh", 5000), "xx", None) for i in range(25)] + [(100 + i, text("mnopqrst", 30), "yy", None) for i in range(60)]
    table = docs(spark, rows)
    sample = langid.training_sample(table, chars=2000)
    assert {lang for lang, _ in sample} == {"xx", "yy"} and max(len(t) for _, t in sample) <= 2000
    starts = {t[:20] for lang, t in sample if lang == "xx"}
    assert not starts & {t[:20] for _, t, *_ in rows}  # windows, not beginnings
    found = langid.predict(table, langid.train(sample, steps=80)).collect()
    assert {r.doc_id < 100: r.lang_pred for r in found} == {True: "xx", False: "yy"}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    rows = [(i, "some text here", f"l{i}", None) for i in range(4)]
    with pytest.raises(ValueError, match="more than 3"):
        langid.training_sample(docs(spark, rows))
    assert len(langid.training_sample(docs(spark, rows[:3]))) == 3


def test_every_word_of_a_sampled_text_is_learned():
    text = " ".join(["filler"] * 5000 + ["zyzzyva"])
    examples = langid._examples([("xx", text)], {"xx": 0}, np.random.default_rng(1))
    whole = dict(zip(examples[0][1].tolist(), examples[0][2].tolist(), strict=True))
    assert set(langid.word_features("zyzzyva")) <= set(whole)
    assert sum(whole.values()) == 5000 * len(langid.word_features("filler")) + len(langid.word_features("zyzzyva"))


def test_kept_columns_may_have_the_results_names(spark):
    table = docs(spark, [(1, "some words", "en", None), (2, "12", "en", None)]).withColumnRenamed("source", "score")
    model = langid.train([("en", "some words here")] * 5, steps=5)
    with pytest.raises(ValueError, match="score"):
        langid.predict(table, model, keep=("score",))
    got = langid.predict(table, model, keep=("score",), found_as=("a", "b", "c"))
    assert got.columns == ["doc_id", "score", "a", "b", "c"] and got.count() == 2
