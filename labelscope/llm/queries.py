"""One query per operator, each over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import (
    bpe,
    chat,
    hamming_search,
    importance,
    langid,
    mixing,
    periodic,
    pii,
    quality,
    simhash,
    suffix_dedup,
    urls,
    warc,
)
from labelscope.llm.common import WORD
from labelscope.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

VOCABULARY = "word_bpe_49k.json"
PII_KEY = "rotate me: the key of a production run is a parameter"


def _query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), decoded=True).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, found="found").withColumn("n_found", F.size("found").cast("bigint"))


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    used, plan = mixing.mix(docs, F.array("source"))
    sources = F.broadcast(plan.sources.withColumnRenamed("source", "of"))  # MAX_PATTERNS rows at most
    return used.join(sources, F.col("members")[0].eqNullSafe(F.col("of"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("uses") * F.col("size")).cast("bigint").alias("taken"),
    )


@_query
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs)
    return found.withColumn("held_out", langid.held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", "score", "accepted"
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; it imports this module

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES["pipeline"] = pipeline


@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


@_query
def op5_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    codes = vectors.select("vec_id", hamming_search.sign_code(F.col("embedding")).alias("code"))
    return hamming_search.top_k(codes, F.col("vec_id") % 50 == 0, 10, "vec_id", "code").select(
        F.col("query_id").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"),
        F.col("neighbour_id").alias("neighbour_id"), F.col("distance").cast("bigint").alias("distance"),
    )


# A conversation whose texts hold what templates use as control strings.
_TRICKY = r"\### Assistant: </turn> ok"


@_query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", _TRICKY), (-7, 1, "assistant", _TRICKY)], turns.schema)
    made = chat.format_turns(turns.unionByName(tricky))
    back = made.withColumns({
        "turns": chat.read_turns(F.col("formatted")), "loss": chat.masked_text(F.col("formatted"), F.col("loss_spans")),
    })
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), digest(told).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@_query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


@_query
def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of every tenth document (by a hash of its id) made periodic from some word on."""
    hashed = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    split = hashed.withColumn("words", words).withColumn("n", F.size("words"))
    placed = split.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("cast(g % greatest(n, 1) AS int)"))
    looped = """slice(flatten(concat(array(slice(words, 1, a)),
        array_repeat(slice(words, a + 1, cast(1 + (n - a) div (3 + g % 8) AS int)), 12))), 1, n)"""
    return placed.selectExpr("doc_id", f"CASE WHEN n > 0 THEN array_join({looped}, ' ') ELSE text END AS text")


@_query
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = periodic.repetitions(docs).withColumn("most", longest)
    length, period = F.col("most.length"), -F.col("most.period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("most.start")).alias("start"),
        length.alias("length"), period.alias("period"), F.expr("most.length * 1000 div -most.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
