"""Small tables for edge cases."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    """Rows of (doc_id, text) or longer, with more columns whose names operators use themselves."""
    full = [(*r, None, None, None)[:5] for r in rows]
    table = spark.createDataFrame(full, DOCS)
    for name in ("id", "fp", "words", "size", "members", "ids", "value", "uses", "found_", "score_"):
        table = table.selectExpr("*", f"'clash' AS `{name}`")
    return table


def edge_rows():
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x" * 200_000), (6, "The cat sat on the mat. " * 9000),
        (7, "same text here twice"), (7, "same text here twice"), (None, "no id at all"), (8, "Straße ΑΣ 日本 👍"),
    ]
