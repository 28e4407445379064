"""Traces, stage latency, request metrics and event history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.text import six


def trace(events: DataFrame, wanted: str | DataFrame) -> DataFrame:
    """Events of one request, or of every request in a table of trace ids; the rows of a
    trace lie together in arrival order."""
    if isinstance(wanted, DataFrame):
        events = events.join(wanted.select("trace_id").distinct(), "trace_id", "left_semi")
    else:
        events = events.where(F.col("trace_id") == wanted)
    return in_arrival_order(events)


def in_arrival_order(events: DataFrame) -> DataFrame:
    """Order holds within a trace, so traces are dealt by hash: no sort of the whole log."""
    return events.repartition("trace_id").sortWithinPartitions("trace_id", "timestamp", "seq")


def timeline(events: DataFrame) -> DataFrame:
    """Everything but metrics, in arrival order per trace."""
    return in_arrival_order(events.where("event_type <> 'metric'"))


BINS = 64


def binned(counts: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Adds _bin to rows of distinct values _v: how many of the group's splitters lie below."""
    cuts = F.percentile_approx("_v", [i / bins for i in range(1, bins)], 10_000)
    splitters = counts.groupBy(*keys).agg(F.array_distinct(cuts).alias("_cuts"))
    same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    both = counts.alias("c").join(splitters.alias("s"), same).select("c.*", "_cuts")
    below = F.size(F.filter("_cuts", lambda cut: cut < F.col("_v")))
    return both.withColumn("_bin", below).drop("_cuts")


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], bins: int = BINS
) -> DataFrame:
    """Exact discrete quantiles per key: the least value whose share of rows reaches q.

    Built-in exact percentiles keep every distinct value of a group in one task.  Here
    values are counted, the counts are summed per bin, and only the bins that hold a
    wanted rank are opened.  A sketch of each group's distinct values puts about as many
    of them in every bin, however close they lie; counts decide, so the answer does not
    depend on the sketch.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    counts = binned(counts, keys, bins)
    sums = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in_bin"))
    up_to = Window.partitionBy(*keys).orderBy("_bin")
    all_rows = Window.partitionBy(*keys)
    placed = sums.withColumns(
        {
            "_before": F.sum("_in_bin").over(up_to) - F.col("_in_bin"),
            "_total": F.sum("_in_bin").over(all_rows),
        }
    )
    ranks = {name: F.ceil(F.col("_total") * F.lit(q)) for name, q in quantiles.items()}
    holds = [
        (F.col("_before") < r) & (r <= F.col("_before") + F.col("_in_bin")) for r in ranks.values()
    ]
    opened = placed.where(reduce(lambda a, b: a | b, holds)).drop("_in_bin")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    values = counts.alias("c").join(
        opened.alias("o"), reduce(lambda a, b: a & b, [*same, F.col("c._bin") == F.col("o._bin")])
    ).select(*[F.col(f"c.{k}").alias(k) for k in keys], "c._bin", "_v", "_n", "_before", "_total")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    ranked = values.withColumn("_cum", F.col("_before") + F.sum("_n").over(inside))
    return ranked.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_cum") >= r, F.col("_v"))).alias(name) for name, r in ranks.items()]
    )


def with_durations(events: DataFrame, span_seconds: int = 60) -> DataFrame:
    """Closing events with their duration; where it is absent, the time since the latest
    start of the same stage in the trace.

    The latest start is looked up inside a span of time and, failing that, taken over
    from earlier spans, so no task sorts all events of one trace.
    """
    keys = ["trace_id", "stage"]
    start = F.when(F.col("event_type") == "stage_start", F.col("timestamp"))
    cut = events.where("event_type in ('stage_start', 'stage_end', 'failure')").withColumn(
        "_span", F.floor(F.unix_micros("timestamp") / (span_seconds * 1_000_000))
    )
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, "_span")
        .agg(F.max(start).alias("_latest"))
        .select(*keys, "_span", F.max("_latest").over(earlier).alias("_carried"))
    )
    inside = Window.partitionBy(*keys, "_span").orderBy("timestamp", "seq")
    rows = (
        cut.withColumn("_inside", F.max(start).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .where("event_type <> 'stage_start'")
        .join(carried, [*keys, "_span"], "left")
    )
    started = F.coalesce("_inside", "_carried")
    paired = (F.unix_micros("timestamp") - F.unix_micros(started)) / 1000.0
    return rows.withColumn("duration_ms", F.coalesce("duration_ms", paired)).select(*events.columns)


def stage_latency(events: DataFrame) -> DataFrame:
    """Closing events per stage: count, failures, failure rate, mean and quantiles."""
    closed = with_durations(events)
    failed = F.col("event_type") == "failure"
    totals = closed.groupBy("stage").agg(
        F.count("*").alias("runs"),
        F.count_if(failed).alias("failures"),
        six(F.avg(failed.cast("int"))).alias("failure_rate"),
        six(F.avg("duration_ms")).alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
    )
    spread = exact_quantiles(closed, ["stage"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return totals.join(spread, "stage", "left")


def stage_flags() -> list[Column]:
    def seen(kind: str) -> Column:
        return F.max((F.col("event_type") == kind).cast("int")).alias(kind)

    return [seen("failure"), seen("stage_end"), seen("stage_start")]


def stage_status_of_flags() -> Column:
    return (
        F.when(F.col("failure") == 1, "failed")
        .when(F.col("stage_end") == 1, "done")
        .when(F.col("stage_start") == 1, "active")
        .otherwise("pending")
    )


def stage_status(events: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """Status of every listed stage in every trace; a stage without events is pending."""
    stages = stages or V.TRACE_STAGES
    seen = events.where(F.col("stage").isin(stages)).groupBy("trace_id", "stage").agg(*stage_flags())
    # every trace gets a row per listed stage from a constant array, not from a join
    listed = F.explode(F.array(*[F.lit(s) for s in stages]))
    wanted = events.select("trace_id").distinct().withColumn("stage", listed)
    full = wanted.join(seen, ["trace_id", "stage"], "left")
    return full.select("trace_id", "stage", stage_status_of_flags().alias("status"))


def token_usage(calls: DataFrame) -> DataFrame:
    """calls(trace_id, stage, model, prompt_tokens, completion_tokens) summed per trace,
    kind of call and model."""
    return calls.groupBy("trace_id", "stage", "model").agg(
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )


def request_metrics(requests: DataFrame) -> DataFrame:
    """requests(path, method, status_code, duration_ms) per path and method."""
    errors = F.col("status_code") >= 400
    totals = requests.groupBy("path", "method").agg(
        F.count("*").alias("requests"),
        F.count_if(errors).alias("errors"),
        six(F.avg(errors.cast("int"))).alias("error_share"),
        six(F.avg("duration_ms")).alias("avg_ms"),
    )
    spread = exact_quantiles(requests, ["path", "method"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return totals.join(spread, ["path", "method"], "left")


def event_history(events: DataFrame) -> DataFrame:
    return events.groupBy("name").agg(
        F.count("*").alias("events"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")
    )
