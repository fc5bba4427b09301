"""From raw documents to token ids: identify, deduplicate, pseudonymise, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of the stages
writes it as Parquet and reads it back as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import bpe, langid, mixing, pii, queries, simhash
from labelscope.llm.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those rejected go. Columns unchanged.

    The document's own ``lang`` stays as it is: the prediction only decides who stays. Null, empty
    and letterless texts are rejected; repeated rows and rows without an id are judged by their
    text; columns may have any names; an empty table gives none.
    """
    taken, found = set(docs.columns), langid.FOUND
    while taken & set(found):
        found = tuple(f"{name}_" for name in found)
    judged = langid.identify(docs, keep=tuple(c for c in docs.columns if c != "doc_id"), found_as=found)
    return judged.where(found[2]).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; see ``simhash.deduplicated`` for which.

    Null and blank texts are duplicates of each other. Rows of one id with different texts are judged
    apart; rows without an id stay; an empty table gives none.
    """
    return simhash.deduplicated(docs)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; ``n_chars`` follows.

    Every row stays, repeated ones and those without an id too. A null text stays null, with a null
    ``n_chars``; an empty one stays empty; texts count whole; an empty table gives none.
    """
    made = pii.pseudonymise(docs, queries.PII_KEY)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document not taken goes, one taken twice comes twice.

    Null and wordless texts are never taken; rows of one id share a place in the order; a null source
    is a source; an empty table gives none.
    """
    return mixing.repeated(docs, F.array("source"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of what they decode to.

    Every row stays; null and empty texts have no ids; an empty table gives none.
    """
    encoded = bpe.encode(docs, public_tokenizers.path(queries.VOCABULARY), decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("pii", pii_pseudonyms),
    ("mixing", mix_sources),
    ("bpe", bpe_tokens),
]

# Hashing, training and encoding are not expressible; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each ends in a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
