"""Quality rules: counts per text, and divergence of its histograms from language references.

A text is compared with every language by two Jensen-Shannon distances (square root of
the divergence in bits, 0 to 1): one between its character classes and the language's, one
between its frequencies among common words and the language's; and by the share of its
words that are common. References are the mean distributions of the corpus's own
documents of that language, over all of them. The nearest language counts. Share and
common distance vary more in short texts, so both are judged on the scale of the square
root of the words counted, by ``MAX_SPREADS`` spreads (from the quartiles, which junk hardly
moves) around the language's median. Texts too short to have a histogram are not judged by it.

DataFrame functions only; texts are read once, their histograms are stored, and only one
row per language of ``LANGUAGES`` is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import WORD, stored

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words inside repeated windows
MIN_CHARS = 200  # least text for the distance of character classes
MIN_COMMON = 50  # least words for the distance of common words
MAX_CLASS_DISTANCE = 0.30
MAX_SPREADS = 4  # from the median of a language, of common-word share and distance
MOST_COUNTED = 100  # common words a text is taken to have at most, where its distance is scaled

# The commonest function words of each language.
LANGUAGES: Mapping[str, Sequence[str]] = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "his", "are"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"),
}
_BLANK = r"[\x20\x09-\x0D]"
# Character classes in the order of the histogram; what is left is the last one.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]", r"[\p{L}\p{M}]")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that the text has twice or more.

    Windows are compared by 64-bit hashes. Sorting (hash, place) pairs brings equal ones
    together; the places of repeated ones, in order, each cover ``width`` words less what
    the one before covers.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[words[i + k] for k in range(width)])
    )

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        places = _let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: ((j > 0) & same(s, x, F.greatest(j - 1, F.lit(0)))) | same(s, x, j + 1)), lambda x: x["i"])))
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda s, p: F.struct((s["n"] + F.least(F.lit(width), p - s["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step)["n"]

    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)
    return F.when(F.size(words) > width, _let(hashes, some)).otherwise(0).cast("bigint")


def _classes(text: Column) -> Column:
    """Counts of non-blank characters by class: what each removal takes away."""

    def step(rest: Column, left: Sequence[str], counts: list[Column]) -> Column:
        if not left:
            return F.array(*counts, F.length(rest).cast("double"))
        return _let(F.regexp_replace(rest, f"(?:{left[0]})+", ""), lambda new: step(
            new, left[1:], [*counts, (F.length(rest) - F.length(new)).cast("double")]))

    return _let(F.regexp_replace(text, f"{_BLANK}+", ""), lambda t: step(t, CLASSES, []))


def _common(words: Column, vocabulary: Sequence[str]) -> Column:
    """How often each word of ``vocabulary`` occurs, in any case; and all other words.

    Each common word becomes one letter, so that counting is a matter of string lengths.
    """
    forms = sorted({f for w in vocabulary for f in (w, w.capitalize(), w.upper())})
    letters = "".join(chr(0x4E00 + i) for i in range(len(vocabulary)))
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = F.filter(words, lambda w: w.isin(forms))
    coded = F.array_join(F.transform(found, lambda w: F.substr(F.lit(letters), F.array_position(known, F.lower(w)).cast("int"), F.lit(1))), "")
    counts = lambda s: [(F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))).cast("double") for c in letters]
    return _let(coded, lambda s: F.array(*counts(s), (F.size(words) - F.length(s)).cast("double")))


def _shares(counts: Column) -> Column:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return _let(total(counts), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two distributions of one length: 0 for equal ones, 1 for disjoint ones."""
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def vocabulary_of(languages: Mapping[str, Sequence[str]]) -> list[str]:
    return sorted({w for words in languages.values() for w in words})


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: Mapping[str, Sequence[str]] = LANGUAGES) -> DataFrame:
    """Stored: id, lang, the base counts, base_failed, and both histograms of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(f"[^{_BLANK[1:-1]}]"))
    classes = _classes(F.col("text"))
    counted = rows.select(
        "id", "lang", F.size("words").cast("bigint").alias("n_words"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        classes.alias("classes"), _common(F.col("words"), vocabulary_of(languages)).alias("common"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return stored(counted.withColumns({
        "word_chars": F.aggregate("classes", F.lit(0.0), lambda a, x: a + x).cast("bigint"), "base_failed": failed,
    }), "quality")


def references(counted: DataFrame, languages: Mapping[str, Sequence[str]] = LANGUAGES) -> DataFrame:
    """One row per language that has documents: mean shares of classes and of common words.

    Over all documents of the language that are long enough and pass the base rules.
    Averages are worked out per class or word, so nothing is gathered.
    """
    usable = counted.where(F.col("lang").isin(list(languages)) & ~F.col("base_failed") & (F.col("n_words") >= MIN_COMMON))
    means = None
    for name in ("classes", "common"):
        n = len(CLASSES) + 1 if name == "classes" else len(vocabulary_of(languages))
        counts = F.col(name) if name == "classes" else _among(name)
        shares = usable.select("lang", _shares(counts).alias("shares"))
        mean = shares.groupBy("lang").agg(*[F.avg(F.col("shares")[i]).alias(f"m{i}") for i in range(n)])
        mean = mean.select("lang", F.array(*[f"m{i}" for i in range(n)]).alias(f"mean_{name}"))
        means = mean if means is None else means.join(mean, "lang")
    return means.join(_spreads(usable, means), "lang")


def _share(common: Column, n_words: Column) -> Column:
    return 1 - F.element_at(common, -1) / n_words


def _scaled(distance: Column, common: Column, n_words: Column) -> Column:
    """Distance by the square root of the common words counted: alike in short and long texts."""
    return distance * F.sqrt(F.least(F.lit(float(MOST_COUNTED)), n_words - F.element_at(common, -1)))


def _spreads(usable: DataFrame, means: DataFrame) -> DataFrame:
    """Per language median and spread of share and scaled distance; a share spreads by chance at least."""
    share = _share(F.col("common"), F.col("n_words"))
    rows = usable.join(F.broadcast(means.select("lang", "mean_common")), "lang").select(
        "lang", "n_words", share.alias("share"),
        _scaled(jensen_shannon(_shares(_among("common")), F.col("mean_common")), F.col("common"), F.col("n_words")).alias("far"),
    )
    mid = rows.groupBy("lang").agg(F.percentile_approx("share", 0.5).alias("share_mid"))  # a row a language
    off = (F.col("share") - F.col("share_mid")) * F.sqrt("n_words")
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75])
    spread = lambda q: (q[2] - q[0]) / 1.349
    chance = F.sqrt(F.col("share_mid") * (1 - F.col("share_mid")))
    found = rows.join(F.broadcast(mid), "lang").groupBy("lang", "share_mid").agg(
        quartiles(off).alias("off"), quartiles(F.when(F.col("share") > 0, F.col("far"))).alias("far"))
    return found.select(
        "lang", "share_mid", F.greatest(spread(F.col("off")), chance).alias("share_spread"),
        (F.col("far")[1] + MAX_SPREADS * F.greatest(spread(F.col("far")), F.col("far")[1] / 10)).alias("far_most"),
    )


def _among(name: str) -> Column:
    """Counts of the common words, without all other words."""
    return F.slice(name, 1, F.size(name) - 1)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: Mapping[str, Sequence[str]] = LANGUAGES) -> DataFrame:
    """Counts, base_failed, class_distance, common_distance and kept of every row.

    A null text counts as empty: no words, so it fails the base rules. A text under
    ``MIN_CHARS`` characters or ``MIN_COMMON`` words has a null distance, as has any where no
    language has a reference, and is not rejected for it. A text without any common word has
    a null common_distance and is judged by its share. ``lang`` serves the references only:
    rows where it is null are judged like all others. Whole texts, repeated rows kept, null
    ids kept, an empty table gives none; other columns are left behind.
    """
    counted = features(docs, id_col, text_col, lang_col, languages)
    near = lambda name: F.transform("refs", lambda r: jensen_shannon(F.col("shares"), r[f"mean_{name}"]))
    refs = references(counted, languages).agg(
        F.collect_list(F.struct("mean_classes", "mean_common", "share_mid", "share_spread", "far_most")).alias("refs"))  # one per language
    rows = counted.crossJoin(F.broadcast(refs))  # a single row
    share = _share(F.col("common"), F.col("n_words"))
    for name, guard, out in (
        ("classes", F.col("word_chars") >= MIN_CHARS, "class_distance"), ("common", (F.col("n_words") >= MIN_COMMON) & (share > 0), "common_distance"),
    ):
        counts = F.col(name) if name == "classes" else _among(name)
        rows = rows.withColumn("shares", _shares(counts)).withColumn(out, F.when(guard, F.array_min(near(name))))
    usual = lambda r: F.abs(share - r["share_mid"]) * F.sqrt("n_words") <= MAX_SPREADS * r["share_spread"]
    far = _scaled(F.col("common_distance"), F.col("common"), F.col("n_words"))
    like = lambda r: usual(r) & F.coalesce(far <= r["far_most"], F.lit(True))
    odd = (F.col("n_words") >= MIN_COMMON) & (F.size("refs") > 0) & ~F.exists("refs", like)
    apart = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | odd
    return rows.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "common_distance", (~F.col("base_failed") & ~F.coalesce(apart, F.lit(False))).alias("kept"),
    )
