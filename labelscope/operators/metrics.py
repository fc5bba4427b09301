"""Confusion counts and the metrics drawn from them.

``answer_cells`` aggregates the results once, to at most a few hundred cells per
(model, context); everything else is drawn from those cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.domain import CLASSES, METRICS, NO_ANSWERS, RUN, UNKNOWN, class_array, class_index

_SIZE = len(CLASSES)


def _ratio(part: str, whole: str) -> Column:
    """Quotient as double, 0 over an empty base."""
    return F.expr(f"CASE WHEN ({whole}) = 0 THEN 0D ELSE cast({part} AS double) / ({whole}) END")


_CELLS = "array<struct<t:int,p:int,same:boolean,n:bigint>>"


def _no_cells() -> Column:
    return F.array().cast(_CELLS)


def added_cells(cells: DataFrame, requested: DataFrame) -> DataFrame:
    """One row per requested run from several with counts, such as one per batch."""
    each = cells.select(*RUN, F.inline("cells")).groupBy(*RUN, "t", "p", "same").agg(F.sum("n").alias("n"))
    per_run = each.groupBy(*RUN).agg(F.collect_list(F.struct("t", "p", "same", "n")).alias("cells"))
    return requested.select(*RUN).distinct().join(per_run, RUN, "left").withColumn("cells", F.coalesce("cells", _no_cells()))


def answer_cells(
    results: DataFrame,
    requested: DataFrame | None = None,
    by: Sequence[str] = (),
    groups: Sequence[str] = (),
) -> DataFrame:
    """One row per (model, context) with its answered pairs counted.

    With ``by`` there is a row per run and value of that column, and if runs are requested, for
    each of them and each of ``groups``.

    ``cells`` is an array of (t, p, same, n): class positions of label and
    prediction (-1 outside the domain), whether they are equal, and the count. Its
    length is bounded by the class domain. Runs without any answered row, and runs
    named in ``requested`` without any row at all, have an empty array.
    """
    # Unknown is grouped like any other answer so that its runs stay visible.
    run = [*RUN, *by]
    pairs = results.groupBy(
        *run,
        class_index(F.col("label")).alias("t"),
        class_index(F.col("predicted_label")).alias("p"),
        F.expr(f"predicted_label <=> '{UNKNOWN}'").alias("unknown"),
        F.expr("coalesce(label = predicted_label, false)").alias("same"),
    ).agg(F.count("*").alias("n"))
    cell = F.expr("CASE WHEN NOT unknown THEN struct(t, p, same, n) END")
    per_run = pairs.groupBy(*run).agg(F.collect_list(cell).alias("cells"))
    if requested is None:
        return per_run
    wanted = requested.select(*RUN).distinct()
    for column in by:
        wanted = wanted.withColumn(column, F.explode(F.array(*[F.lit(g) for g in groups])))
    return wanted.join(per_run, run, "left").withColumn("cells", F.coalesce("cells", _no_cells()))


def _total(condition: str) -> Column:
    """Rows in the cells for which ``condition`` on ``c`` holds."""
    return F.expr(f"aggregate(filter(cells, c -> {condition}), 0L, (sum, c) -> sum + c.n)")


def _positions() -> Column:
    return F.expr(f"explode(sequence(0, {_SIZE - 1}))")


def confusion(cells: DataFrame) -> DataFrame:
    """Dense matrix in long form: label position, prediction position, count."""
    return (
        cells.select("*", _positions().alias("true_idx"))
        .withColumn("cells", F.expr("filter(cells, c -> c.t = true_idx)"))
        .select("*", _positions().alias("pred_idx"))
        .select(*RUN, "true_idx", "pred_idx", _total("c.p = pred_idx").alias("n"))
    )


def confusion_rates(matrix: DataFrame) -> DataFrame:
    """Matrix divided by its row sums; an empty row stays zero."""
    # A row has 26 cells, so gathering it is bounded.
    rows = matrix.groupBy(*RUN, "true_idx").agg(
        F.sum("n").alias("row_n"), F.collect_list(F.struct("pred_idx", "n")).alias("cells")
    )
    return rows.select(*RUN, "true_idx", "row_n", F.inline("cells")).select(
        *RUN, "true_idx", "pred_idx", _ratio("n", "row_n").alias("rate")
    )


def class_scores(cells: DataFrame) -> DataFrame:
    """One row per (model, context, class): counts, precision, recall, F1.

    ``answered`` and ``correct`` repeat the totals of the run, which also count
    rows outside the class domain.
    """
    counted = cells.select(
        "*", _total("true").alias("answered"), _total("c.same").alias("correct")
    ).select(
        *RUN, "answered", "correct", "cells", _positions().alias("idx")
    ).select(
        *RUN, "answered", "correct", "idx",
        _total("c.t = idx").alias("support"),
        _total("c.p = idx").alias("predicted"),
        _total("c.t = idx AND c.p = idx").alias("hits"),
    )
    return counted.select(
        "*",
        F.element_at(class_array(), F.col("idx") + 1).alias("cls"),
        _ratio("hits", "predicted").alias("precision"),
        _ratio("hits", "support").alias("recall"),
        _ratio("2 * hits", "support + predicted").alias("f1"),
    )


def _averages() -> dict[str, Column]:
    means: dict[str, Column] = {"accuracy": _ratio("max(correct)", "max(answered)")}
    for name in ("precision", "recall", "f1"):
        means[f"{name}_macro"] = F.expr(f"avg({name})")
        means[f"{name}_weighted"] = _ratio(f"sum({name} * support)", "sum(support)")
    return means


def metrics(cells: DataFrame) -> DataFrame:
    """The seven metrics of every (model, context), to four places, half to even.

    Macro values average all classes, absent ones included; a ratio without a base
    is 0, so a run without answered rows has seven zeros.
    """
    means = _averages()
    return class_scores(cells).groupBy(*RUN).agg(
        *[F.bround(means[name], 4).alias(name) for name in METRICS]
    )


def class_report(cells: DataFrame) -> DataFrame:
    """Per-class rows, then accuracy, macro average, weighted average; two places."""
    # One aggregation per run gathers its 26 class rows and all averages.
    runs = class_scores(cells).groupBy(*RUN).agg(
        F.expr("collect_list(struct(idx, cls, precision, recall, f1, support))").alias("classes"),
        F.sum("support").alias("total"),
        *[column.alias(name) for name, column in _averages().items()],
    )
    def summary(position: int, name: str, p: str, r: str, f1: str) -> str:
        return f"""named_struct('idx', {position}, 'cls', '{name}', 'precision', {p},
            'recall', {r}, 'f1', {f1}, 'support', total)"""

    summaries = [summary(_SIZE, "accuracy", "cast(null AS double)", "cast(null AS double)", "accuracy")]
    for i, kind in enumerate(("macro", "weighted"), start=1):
        means = (f"{m}_{kind}" for m in ("precision", "recall", "f1"))
        summaries.append(summary(_SIZE + i, f"{kind} avg", *means))
    rows = F.expr(f"concat(classes, array({', '.join(summaries)}))")
    names = ("position", "name", "precision", "recall", "f1", "support")
    return runs.select(*RUN, F.inline(rows).alias(*names)).select(
        *RUN, "position", "name",
        *[F.bround(c, 2).alias(c) for c in ("precision", "recall", "f1")],
        "support",
    )


def run_notes(cells: DataFrame) -> DataFrame:
    """Answered and correct rows of every run, and a note on runs without any answer.

    Such a run has zeros in all reports; the note tells them from zeros that were measured.
    """
    return cells.select(*RUN, _total("true").alias("answered"), _total("c.same").alias("correct")).withColumn(
        "note", F.when(F.col("answered") == 0, NO_ANSWERS)
    )


def class_recall(matrix: DataFrame) -> DataFrame:
    """Diagonal over row sum of a stored matrix, per (model, context, class)."""
    return matrix.groupBy(*RUN, F.col("true_idx").alias("idx")).agg(
        _ratio("sum(if(true_idx = pred_idx, n, 0L))", "sum(n)").alias("recall")
    )


def filled_matrix(stored: DataFrame, runs: DataFrame) -> DataFrame:
    """Stored matrix of each run, with zeros for cells and runs it lacks."""
    grid = (
        runs.select(*RUN).distinct()
        .select(*RUN, _positions().alias("true_idx"))
        .select("*", _positions().alias("pred_idx"))
    )
    cells = [*RUN, "true_idx", "pred_idx"]
    return grid.join(stored.select(*cells, "n"), cells, "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )
