"""Regular-expression matches with code-point positions, as column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

FOUND = "array<struct<start:int,end:int,value:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def before(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` has made of ``zero`` before each item.  Items are run through in blocks
    of about the root of their number, so that arrays that grow stay short."""

    def states(block: Column, first: Column, to: Callable[[Column, Column], Column]) -> Column:
        run = F.struct(first.alias("now"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(block, run, lambda s, x: F.struct(to(s["now"], x).alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all")))["all"]

    def blocks(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(xs) - 1, width), lambda at: F.slice(xs, at + 1, width))

    def run(bs: Column) -> Column:
        firsts = states(bs, zero, lambda now, block: F.aggregate(block, now, step))
        return F.flatten(F.zip_with(bs, firsts, lambda block, first: states(block, first, step)))

    return bound(items, lambda xs: F.when(F.size(xs) > 0, bound(blocks(xs), run)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, value), ends exclusive.
    Lengths of the pieces between matches give the positions."""
    gaps = F.split(text, pattern, -1)

    def placed(pairs: Column) -> Column:
        starts = before(pairs, F.lit(0), lambda at, p: at + F.char_length(p["gap"]) + F.char_length(p["value"]))

        def place(pair: Column, at: Column) -> Column:
            start = at + F.char_length(pair["gap"])
            return F.struct(start.alias("start"), (start + F.char_length(pair["value"])).alias("end"), pair["value"].alias("value"))

        return F.zip_with(pairs, starts, place)

    # the last gap has no match behind it
    pairs = lambda values: F.arrays_zip(F.slice(gaps, F.lit(1), F.size(values)).alias("gap"), values.alias("value"))
    found = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: bound(pairs(values), placed))
    return F.coalesce(found, F.array()).cast(FOUND)


def matches_where(condition: Column, text: Column, pattern: str) -> Column:
    """No search where the cheap condition says that there is no match."""
    return F.when(condition, matches(text, pattern)).otherwise(F.array().cast(FOUND))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def code_points(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] from the text's UTF-32 bytes, so that the cost is that of the piece."""
    return F.decode(F.substring(text, start * 4 + 1, (end - start) * 4), "UTF-32")
