"""Request limits per identity.

requests(request_id, identity, at_us, seq): at_us is the time in whole microseconds and
seq the arrival order among equal times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..session import shared_dir, ship_package

MICROS = 1_000_000
SEGMENT = 200_000  # requests of one identity decided in one task


def running_total(df: DataFrame, keys: list[str], at: str, amount: str, out: str, span: int = MICROS) -> DataFrame:
    """Running sum of ``amount`` in the order of the whole number ``at``, unique per key.

    Two levels: inside spans of ``span`` positions and over the span totals.  A key that
    owns most rows is summed by as many tasks as it has spans; a span holds at most
    ``span`` rows because positions are unique.
    """
    cut = df.withColumn("_span", F.floor(F.col(at) / span))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_span")
        .agg(F.sum(amount).alias("_sum"))
        .select(*keys, "_span", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_span").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_inside", F.sum(amount).over(inside))
        .join(offsets, [*keys, "_span"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_span", "_inside", "_offset")
    )


def window_counts(requests: DataFrame, window_us: int) -> DataFrame:
    """(identity, at_us, n_now, in_window): requests at that time, and in the window that
    ends there.  Each request enters at its time and leaves just after the window."""
    moments = requests.groupBy("identity", "at_us").agg(F.count("*").alias("n"))

    def step(at: Column, change: Column, now: Column) -> Column:
        return F.struct(at.alias("at_us"), change.alias("change"), now.alias("n_now"))

    n, at = F.col("n"), F.col("at_us")
    both = F.array(step(at, n, n), step(at + window_us + 1, -n, F.lit(0).cast("long")))
    steps = (
        moments.select("identity", F.explode(both).alias("s"))
        .groupBy("identity", "s.at_us")
        .agg(F.sum("s.change").alias("change"), F.sum("s.n_now").alias("n_now"))
    )
    return (
        running_total(steps, ["identity"], "at_us", "change", "in_window")
        .where("n_now > 0")
        .select("identity", "at_us", "n_now", "in_window")
    )


def sliding_counts(requests: DataFrame, window_seconds: float = V.RATE_WINDOW_SECONDS) -> DataFrame:
    """Requests of the identity in the window ending at each request, itself included."""
    counts = window_counts(requests, int(window_seconds * MICROS)).select("identity", "at_us", "in_window")
    return requests.join(counts, ["identity", "at_us"])


def with_bursts(requests: DataFrame, window_seconds: float, limit: int) -> DataFrame:
    """Adds burst, the number of pauses longer than the window before the request;
    contended, whether the burst ever has more than ``limit`` requests in one window; and
    segment, the stretch of time in the burst: one, or about SEGMENT requests each."""
    counts = window_counts(requests, int(window_seconds * MICROS)).withColumn(
        "_starts", (F.col("in_window") == F.col("n_now")).cast("long")
    )
    numbered = running_total(counts, ["identity"], "at_us", "_starts", "burst").select(
        "identity", "at_us", "burst", "in_window", "n_now"
    )
    busy = numbered.groupBy("identity", "burst").agg(
        (F.max("in_window") > limit).alias("contended"),
        F.ceil(F.sum("n_now") / SEGMENT).alias("segments"),
        F.min("at_us").alias("_first"),
        (F.max("at_us") + 1).alias("_end"),
    )
    moments = numbered.join(busy, ["identity", "burst"])
    stretch = F.floor((F.col("at_us") - F.col("_first")) / (F.col("_end") - F.col("_first")) * F.col("segments"))
    moments = moments.select("identity", "at_us", "burst", "contended", "segments", stretch.alias("segment"))
    return requests.join(moments, ["identity", "at_us"])


class Limiter:
    """The sequential rule: forget admissions older than the window, refuse when the
    limit is reached; a refused request leaves no mark."""

    def __init__(self, limit: int, window_us: int, admitted=()):
        self.limit, self.window_us, self.admitted = limit, window_us, deque(admitted)

    def decide(self, at_us: int) -> bool:
        while self.admitted and self.admitted[0] < at_us - self.window_us:
            self.admitted.popleft()
        if len(self.admitted) >= self.limit:
            return False
        self.admitted.append(at_us)
        return True


PLACE = ["identity", "burst", "segment"]


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["at_us", "seq"], kind="stable")


def admit(
    requests: DataFrame, limit: int = V.RATE_LIMIT, window_seconds: float = V.RATE_WINDOW_SECONDS
) -> DataFrame:
    """Adds ``admitted``.

    A pause longer than the window empties the limiter, so the bursts between pauses are
    independent.  A burst that never exceeds the limit is admitted as it is.  Contended
    bursts follow the sequential rule: their rows stream through it in time order, with the
    admitted times of one window as the only state held.  A burst of more than SEGMENT
    requests is many segments, each a task's, that start with the admissions that the one
    before leaves (see ``settled_starts``).
    """
    ship_package(requests.sparkSession)
    window_us = int(window_seconds * MICROS)
    columns = requests.columns
    spark, path = requests.sparkSession, shared_dir(requests.sparkSession, "bursts")
    with_bursts(requests, window_seconds, limit).write.parquet(path)
    rows = spark.read.parquet(path)
    calm = rows.where("not contended").select(*columns, F.lit(True).alias("admitted"))
    short = rows.where("contended and segments = 1").select(*columns, "burst")
    long = rows.where("contended and segments > 1").select(*columns, "burst", "segment")
    schema = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes) + ", admitted boolean"

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limiter = None, None
        for pdf in batches:
            verdicts = []
            for who, burst, at in zip(pdf["identity"], pdf["burst"], pdf["at_us"].tolist()):
                if (who, burst) != current:
                    current, limiter = (who, burst), Limiter(limit, window_us)
                verdicts.append(limiter.decide(at))
            yield pdf[columns].assign(admitted=verdicts)

    def decide(key, own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        own = in_order(own)
        limiter = Limiter(limit, window_us, start["start"].iloc[0] if len(start) else ())
        return own[columns].assign(admitted=[limiter.decide(at) for at in own["at_us"].tolist()])

    ordered = short.repartition("identity", "burst").sortWithinPartitions("identity", "burst", "at_us", "seq")
    decided = calm.unionByName(ordered.mapInPandas(stream, schema))
    if long.isEmpty():
        return decided
    starts = settled_starts(long, limit, window_us)
    own = long.toDF(*long.columns).groupBy(*PLACE).cogroup(starts.groupBy(*PLACE)).applyInPandas(decide, schema)
    return decided.unionByName(own)


def settled_starts(contended: DataFrame, limit: int, window_us: int) -> DataFrame:
    """(identity, burst, segment, start) of segments that do not start empty: the admitted
    times still inside the window when the segment begins.

    All segments are first run from an empty limiter at once.  One whose predecessor then
    leaves another state than it was given is run again from that state, if the
    predecessor itself stands; and so on until every segment was given what its predecessor
    leaves.  Where an identity falls below its limit for a while the two agree of
    themselves, so repairs end there and go on at many places at once; an identity that
    never does is repaired segment by segment.
    """
    spark = contended.sparkSession
    rows = contended.select(*PLACE, "at_us", "seq")

    def left(key, own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        given = list(start["start"].iloc[0]) if len(start) else []
        limiter, first = Limiter(limit, window_us, given), int(own["at_us"].min()) if len(own) else 0
        for at in in_order(own)["at_us"].tolist():
            limiter.decide(at)
        return pd.DataFrame([[*key, first, given, list(limiter.admitted)]], columns=[*PLACE, "first_at", "start", "left"])[: len(own)]

    def run(which: DataFrame, starts: DataFrame) -> DataFrame:
        kinds = dict(contended.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in PLACE) + ", first_at long, start array<long>, left array<long>"
        which = which.toDF(*which.columns)  # both come from the same rows
        return which.groupBy(*PLACE).cogroup(starts.groupBy(*PLACE)).applyInPandas(left, schema)

    def kept(df: DataFrame) -> DataFrame:
        path = shared_dir(spark, "segments")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    none = rows.select(*PLACE).limit(0).withColumn("start", F.array().cast("array<long>"))
    done = kept(run(rows, none))
    while True:
        order = Window.partitionBy("identity", "burst").orderBy("segment")
        asked = F.filter(F.coalesce(F.lag("left").over(order), F.array().cast("array<long>")), lambda t: t >= F.col("first_at") - window_us)
        state = done.withColumn("asked", asked).withColumn("wrong", F.col("asked") != F.col("start"))
        state = state.withColumn("now", F.col("wrong") & ~F.coalesce(F.lag("wrong").over(order), F.lit(False)))
        again = kept(state.where("now").select(*PLACE, F.col("asked").alias("start")))
        if again.isEmpty():
            return done.where(F.size("start") > 0).select(*PLACE, "start")
        redone = run(rows.join(again.select(*PLACE), PLACE, "left_semi"), again)
        done = kept(done.join(again.select(*PLACE), PLACE, "left_anti").unionByName(redone))


def limit_audit(decided: DataFrame) -> DataFrame:
    """One audit event per refused request."""
    at: Column = F.timestamp_micros("at_us")
    return decided.where("not admitted").select(
        at.alias("timestamp"),
        F.lit("rate_limit_exceeded").alias("event_type"),
        F.to_json(F.struct("identity")).alias("details"),
    )
