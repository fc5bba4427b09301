"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word's features are itself and its letter n-grams, hashed into ``BUCKETS`` rows of an
embedding table. A text is the mean embedding of all its features; a linear layer and a
softmax turn it into probabilities. Both tables are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled rows (``SAMPLE_ROWS`` per
language, drawn by a seeded hash, of longer texts a drawn window of ``SAMPLE_CHARS``, and
``SAMPLE_TOTAL`` characters in all; everything else runs over all rows). Part of the sample is held back to fit a temperature, so that the score is a
calibrated probability, and the score below which a text is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import astuple, dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import by_slices

BUCKETS = 1 << 15
DIMENSIONS = 16
SAMPLE_ROWS = 400
SAMPLE_CHARS = 20_000
SAMPLE_TOTAL = 100_000_000
MAX_LANGUAGES = 200
UNKNOWN = "und"
_CACHED_WORDS = 100_000  # per task; beyond, only words met again since then are kept
_LONGEST = 40  # letters of one feature source; longer words are cut into pieces
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Buckets of the word and its 2- to 4-grams, with its ends marked."""
    marked = f"<{word}>"
    grams = [marked[i:i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in [marked, *grams]]


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower case; runs of over ``_LONGEST`` letters in pieces."""
    words = _LETTERS.findall((text or "").lower())
    if text and not text.isascii():  # the pattern also takes numbers that are not digits
        words = [w for w in words if w.isalpha() or any(map(str.isalpha, w))]
    if any(len(w) > _LONGEST for w in words):
        words = [w[i:i + _LONGEST] for w in words for i in range(0, len(w), _LONGEST)]
    return words


@dataclass
class Model:
    """``weights``: logits each bucket adds; the embedding times the linear layer."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# --- training ---------------------------------------------------------------------


def training_sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS,
) -> list[tuple[str, str]]:
    """At most ``rows`` (language, text) pairs per language, in a fixed order.

    Rows are counted per language first, without reading texts; then only about the
    rows wanted are read whole. Of a text of over ``chars`` characters a window is taken, at a
    place drawn by the same hash, so a language of long texts is learned like any other. With many
    languages the windows are smaller: no more than ``SAMPLE_TOTAL`` characters reach the driver.
    More than ``MAX_LANGUAGES`` labels are an error.
    """
    draw = F.xxhash64(F.lit("language sample"), F.col(id_col).cast("string"))
    lang = F.col(lang_col).cast("string")
    counted = {r["lang"]: r["n"] for r in docs.where(lang.isNotNull()).groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counted:
        return []
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chars = max(1, min(chars, SAMPLE_TOTAL // (rows * len(counted))))
    share = F.lit(0.0)
    for name, n in counted.items():
        share = F.when(lang == name, min(1.0, (2.0 * rows + 50) / n)).otherwise(share)
    unit = (draw.bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31)))
    text = F.col(text_col).cast("string")
    usable = docs.where((unit < share) & text.rlike(r"\p{L}"))
    start = F.when(F.length(text) > chars, F.pmod(draw, F.length(text) - chars + 1)).otherwise(0) + 1
    window = F.substring(text, start.cast("int"), F.lit(chars))
    drawn = usable.select(lang.alias("lang"), window.alias("text"), draw.alias("draw")).where(F.col("text").rlike(r"\p{L}"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text")))
    kept = ranked.where(F.col("rank") <= rows).select("lang", "rank", "text").collect()
    return [(r["lang"], r["text"]) for r in sorted(kept)]


def _examples(sample: list[tuple[str, str]], index: dict[str, int], rng: np.random.Generator):
    """Every text whole, and pieces of 1 to 60 words, so that short texts are learned too.

    Features are counted, so a long text is no longer than the words it is made of.
    """
    out = []
    for lang, text in sample:
        words = words_of(text)
        for size in (len(words), *rng.integers(1, 60, 5)):
            start = int(rng.integers(0, max(1, len(words) - size + 1)))
            part = Counter(words[start:start + int(size)])
            features = Counter()
            for word, times in part.items():
                for feature in word_features(word):
                    features[feature] += times
            if features:
                out.append((index[lang], np.array(list(features)), np.array(list(features.values()), float)))
    return out


def train(sample: list[tuple[str, str]], steps: int = 500, batch: int = 64, rate: float = 12.0, seed: int = 7) -> Model:
    """Fit the model; every fifth sampled text is held back for calibration."""
    languages = sorted({lang for lang, _ in sample})
    index, k = {lang: i for i, lang in enumerate(languages)}, len(languages)
    if not k:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    held = [x for i, x in enumerate(sample) if i % 5 == 4]
    examples = _examples([x for i, x in enumerate(sample) if i % 5 != 4], index, rng)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, k)), np.zeros(k)
    epochs = -(-steps // max(1, -(-len(examples) // batch)))
    steps, step = epochs * -(-len(examples) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), batch):
            chosen = [examples[i] for i in order[at:at + batch]]
            sizes = np.array([len(f) for _, f, _ in chosen])
            rows, features = np.repeat(np.arange(len(chosen)), sizes), np.concatenate([f for _, f, _ in chosen])
            share = np.concatenate([n / n.sum() for _, _, n in chosen])[:, None]
            mean = np.add.reduceat(embed[features] * share, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(chosen)), [y for y, _, _ in chosen]] -= 1
            error *= rate * (1 - step / steps) / len(chosen)
            step += 1
            pull = (error @ layer.T)[rows] * share
            layer -= 0.1 * mean.T @ error
            bias -= 0.1 * error.sum(axis=0)
            # One update a bucket: sum the pulls of equal features first.
            by, where = np.unique(features, return_inverse=True)
            total = np.stack([np.bincount(where, weights=pull[:, d], minlength=len(by)) for d in range(DIMENSIONS)], axis=1)
            embed[by] -= total * 10
    model = Model(languages, embed @ layer, bias, 1.0, 0.0)
    return _calibrated(model, held, index)


def _calibrated(model: Model, held: list[tuple[str, str]], index: dict[str, int]) -> Model:
    """Temperature of the least log loss; a threshold that rejects 1 in 1000 right answers at most.

    Held-back texts count whole and as pieces of 20 words. The threshold is never above a
    half: a text that one language is likelier than not to own is accepted.
    """
    parts, truth = [], []
    for lang, text in held:
        words = words_of(text)
        for part in (words, words[:20], words[-20:]):
            parts.append(part)
            truth.append(index[lang])
    if not parts:
        return model
    predictor = _Summer(model)
    logits, truth = predictor.logits(parts), np.array(truth)
    at = np.arange(len(truth))
    losses = {t: -np.log(np.maximum(_softmax(logits / t)[at, truth], 1e-12)).mean() for t in np.geomspace(0.05, 20, 60)}
    model.temperature = float(min(losses, key=losses.get))
    scores = model.scores(logits)
    right = scores.argmax(axis=1) == truth
    model.threshold = float(min(0.5, np.quantile(scores[at, truth][right], 0.001))) if right.any() else 0.0
    return model


# --- prediction -------------------------------------------------------------------


class _Summer:
    """Adds up what the words of texts contribute; keeps words seen before."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.at, self.sums = {}, np.zeros((1024, len(model.languages) + 1))
        self.older, self.older_sums = {}, self.sums[:0]

    def _learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.older]
        rows = np.zeros((len(words), self.sums.shape[1]))
        if known := [w for w in words if w in self.older]:
            rows[len(new):] = self.older_sums[[self.older[w] for w in known]]
        if new:
            features = [word_features(w) for w in new]
            sizes = np.array([len(f) for f in features])
            flat = np.fromiter(chain.from_iterable(features), np.int64, int(sizes.sum()))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rows[:len(new), :-1] = np.add.reduceat(self.model.weights[flat], starts, axis=0)
            rows[:len(new), -1] = sizes
        at = len(self.at)
        while at + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[at:at + len(words)] = rows
        self.at.update(zip([*new, *known], range(at, at + len(words)), strict=True))

    def total(self, words: list[str]) -> np.ndarray:
        if len(self.at) > _CACHED_WORDS:
            self.older, self.older_sums = self.at, self.sums
            self.at, self.sums = {}, np.zeros((1024, self.sums.shape[1]))
        missing = sorted(set(words).difference(self.at))
        for i in range(0, len(missing), 4096):
            self._learn(missing[i:i + 4096])
        out = np.zeros(self.sums.shape[1])
        for i in range(0, len(words), 1 << 16):
            rows = np.fromiter(map(self.at.__getitem__, words[i:i + (1 << 16)]), np.int64)
            out += self.sums[rows].sum(axis=0)
        return out

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        totals = np.stack([self.total(words) for words in texts])
        return self.model.logits(totals[:, :-1], totals[:, -1])


FOUND = ("lang_pred", "score", "accepted")


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
    found_as: tuple[str, str, str] = FOUND,
) -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and ``accepted`` of every row, and the columns in ``keep``.

    ``found_as`` names the three columns otherwise, where kept ones have their names.

    A null text, one without a letter, or any text when nothing was learned is ``und`` with
    score 0, not accepted. Otherwise ``lang_pred`` is the likeliest language, the first by
    name of equals, ``score`` its calibrated probability, and ``accepted`` whether that
    reaches the model's threshold. Whole texts are read, whatever their length; repeated
    rows are repeated, null ids stay, an empty table gives none. Only the text is looked at.
    """
    # BUCKETS x MAX_LANGUAGES at most; plain values, so that executors need no package to load them.
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))
    if clash := sorted({id_col, *keep} & set(found_as)):
        raise ValueError(f"kept columns and results are both named {clash}; pass found_as")
    names = ["id", *keep, *found_as]
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    # Kept as it is, the text need not be sent a second time.
    shared_text = text_col in keep and docs.schema[text_col].dataType.simpleString() == "string"
    text = [] if shared_text else [F.col(text_col).cast("string").alias("_text")]
    rows = docs.select(F.col(id_col).alias("_id"), *kept, *text)
    at, n_kept = (1 + keep.index(text_col) if shared_text else 1 + len(keep)), 1 + len(keep)

    def run(batches):
        model = Model(*shared.value)
        summer = _Summer(model)

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [words_of(t) for t in batch.column(at).to_pylist()]
            found = np.array([bool(w) and bool(model.languages) for w in words])
            langs, best = [UNKNOWN] * len(words), np.zeros(len(words))
            if found.any():
                scores = model.scores(summer.logits([w for w in words if w]))
                best[found] = scores.max(axis=1)
                for i, k in zip(np.nonzero(found)[0], scores.argmax(axis=1), strict=True):
                    langs[i] = model.languages[k]
            accepted = found & (best >= model.threshold)
            return pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(langs), pa.array(best), pa.array(accepted)], out)

        out = [*batch_names, "lang_pred", "score", "accepted"]
        yield from by_slices(convert, "text", 8 << 20)(batches)

    batch_names = rows.columns[:n_kept]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n_kept])
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean").toDF(id_col, *names[1:])


def held_out(id_col: Column) -> Column:
    """Rows never learned from: a quarter, by the CRC-32 of the id's text."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (),
    found_as: tuple[str, str, str] = FOUND,
) -> DataFrame:
    """``predict`` with a model fitted on the labelled rows of ``docs`` that are not held out."""
    sample = training_sample(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    return predict(docs, train(sample), id_col, text_col, keep, found_as)
