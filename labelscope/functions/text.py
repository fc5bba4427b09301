"""Text columns: stripping, prompts, answer parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.domain import (
    CLASSES, FULL, PROMPT_FACE, PROMPT_FULL, PROMPT_REST, REQUEST_MODEL,
    REQUEST_TEMPERATURE, REQUEST_TOKENS, UNKNOWN,
)

# Every character Python's str.strip() takes for blank, where Spark's trim() takes
# the space character only: Unicode white space and the separators \x1c to \x1f.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def as_text(value: Column) -> Column:
    """Value as text, a missing one as ``nan``."""
    return F.coalesce(value.cast("string"), F.lit("nan"))


def parse_label(lowered: str) -> Column:
    """First class, in class order, whose name occurs in a lower-cased answer.

    No class name occurs inside another one, so an answer that equals a class
    once blanks and dots are stripped contains that class and no other: the
    containment test alone decides both cases.
    """
    tests = " ".join(f"WHEN contains({lowered}, '{c.lower()}') THEN '{c}'" for c in CLASSES)
    return F.expr(f"CASE {tests} ELSE '{UNKNOWN}' END")


def with_parsed_label(df: DataFrame, raw: str = "raw_output", out: str = "predicted_label") -> DataFrame:
    """Add the parsed label.

    The lower-cased answer comes out of a generator, which keeps later filters on
    the label from being rewritten into 26 evaluations of ``lower``.
    """
    lowered = df.select("*", F.explode(F.array(F.lower(raw))).alias("_lowered"))
    return lowered.withColumn(out, parse_label("_lowered")).drop("_lowered")


def prompt_text(context: Column) -> Column:
    """Prompt for a context; every context but ``full`` is a crop."""
    return F.when(context == FULL, PROMPT_FULL + PROMPT_REST).otherwise(PROMPT_FACE + PROMPT_REST)


def prompt_for(context: str) -> str:
    return (PROMPT_FULL if context == FULL else PROMPT_FACE) + PROMPT_REST


def base64_line(content: Column) -> Column:
    """Base64 on one line; Spark breaks it every 76 characters."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def request_payload(prompt: Column, image_base64: Column) -> Column:
    """JSON request record for an external scoring service."""
    return F.to_json(
        F.struct(
            F.lit(REQUEST_MODEL).alias("model"),
            prompt.alias("prompt"),
            F.array(image_base64).alias("images"),
            F.lit(False).alias("stream"),
            F.struct(
                F.lit(REQUEST_TEMPERATURE).alias("temperature"),
                F.lit(REQUEST_TOKENS).alias("num_predict"),
            ).alias("options"),
        )
    )


def file_safe(label: Column) -> Column:
    return F.replace(label, F.lit("/"), F.lit("_"))
