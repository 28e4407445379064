"""Ordered text from rows, without trusting collect order and without hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPAN = 512


def joined(order: list[str], line: str, sep: str) -> Column:
    """Aggregate: lines of a small group in a given order.  For groups whose size is
    bounded by construction (the chunks of one query)."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    return F.array_join(F.transform(rows, lambda r: r["_line"]), sep)


def ordered_text(df: DataFrame, keys: list[str], order: str, line: str, sep: str, out: str) -> DataFrame:
    """One text per key from any number of lines, ``order`` a whole number per line.

    Spans of SPAN consecutive positions are joined first, wherever their rows lie, so a
    key that owns a large share of the rows is still assembled by many tasks; only the
    finished spans meet in the last step.
    """
    span = df.withColumn("_span", F.floor(F.col(order) / SPAN))
    pieces = span.groupBy(*keys, "_span").agg(joined([order], line, sep).alias("_piece"))
    return pieces.groupBy(*keys).agg(joined(["_span"], "_piece", sep).alias(out))


def text_digest(
    df: DataFrame, keys: list[str], order: list[str], line: str, sep: str, limit: int, shortest: int
) -> DataFrame:
    """(keys, n_items, n_chars, prefix) of the text the lines of a key would form.

    n_chars is the exact full length; prefix is exactly its first ``limit`` characters.
    Counting is a plain aggregate.  As no line is shorter than ``shortest``, the prefix
    needs no more than a known number of first lines, which the group limit below picks
    inside the map tasks.
    """
    joint = len(sep)
    totals = df.groupBy(*keys).agg(
        F.count("*").alias("n_items"),
        (F.sum(F.length(line)) + joint * (F.count("*") - 1)).alias("n_chars"),
    )
    head_rows = limit // (shortest + joint) + 2
    first = Window.partitionBy(*keys).orderBy(*order)
    heads = (
        df.select(*keys, *order, line)
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= head_rows)
        .groupBy(*keys)
        .agg(F.substring(joined(["_n"], line, sep), 1, limit).alias("prefix"))
    )
    return totals.join(heads, keys)
