"""Operators over groups, one of which holds a third of all rows, against brute force."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from probanda.operators import assembly, limits, sessions, telemetry
from probanda.operators.limits import Limiter


def key_of(rng):
    return "hot" if rng.random() < 0.34 else f"k{rng.randrange(12)}"


def test_ordered_text_and_digest(spark):
    rng = random.Random(5)
    lines = defaultdict(list)
    for i in range(3000):
        lines[key_of(rng)].append((i, f"l{i}" + "x" * rng.randrange(6)))
    rows = [(k, i, t) for k, xs in lines.items() for i, t in xs]
    df = spark.createDataFrame(rows, "k string, n long, line string").repartition(8)
    whole = {k: "\n".join(t for _, t in xs) for k, xs in lines.items()}
    got = {r["k"]: r["text"] for r in assembly.ordered_text(df, ["k"], "n", "line", "\n", "text").collect()}
    assert got == whole
    for r in assembly.text_digest(df, ["k"], ["n"], "line", "\n", 500, 2).collect():
        assert (r["n_items"], r["n_chars"], r["prefix"]) == (len(lines[r["k"]]), len(whole[r["k"]]), whole[r["k"]][:500])


def test_running_total(spark):
    rng = random.Random(6)
    seen = {(key_of(rng), rng.randrange(100000)): rng.randrange(-3, 9) for _ in range(3000)}
    df = spark.createDataFrame([(k, at, v) for (k, at), v in seen.items()], "k string, at long, v long")
    got = {(r["k"], r["at"]): r["total"] for r in limits.running_total(df, ["k"], "at", "v", "total", span=700).collect()}
    sums, wanted = defaultdict(int), {}
    for (k, at), v in sorted(seen.items()):
        sums[k] += v
        wanted[k, at] = sums[k]
    assert got == wanted


def request_rows(seed=9, n=2500, spread=4_000_000):
    rng = random.Random(seed)
    return [(i, key_of(rng), rng.randrange(spread) // 500 * 500, i) for i in range(n)]


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, identity string, at_us long, seq long").repartition(8)


@pytest.mark.parametrize("limit,window_us", [(1, 2000), (3, 2000), (60, 50_000), (5, 1_000_000)])
def test_admission_and_counts(spark, limit, window_us):
    rows = request_rows()
    decided = limits.admit(requests(spark, rows), limit, window_us / 1e6)
    got = {r["request_id"]: r["admitted"] for r in decided.collect()}
    rules, wanted, times, counts = {}, {}, defaultdict(list), {}
    for rid, who, at, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        wanted[rid] = rules.setdefault(who, Limiter(limit, window_us)).decide(at)
        times[who].append(at)
    assert got == wanted
    for rid, who, at, _ in rows:
        counts[rid] = sum(at - window_us <= t <= at for t in times[who])
    found = limits.sliding_counts(requests(spark, rows), window_us / 1e6).collect()
    assert {r["request_id"]: r["in_window"] for r in found} == counts


@pytest.mark.parametrize("limit,window_us,step", [(3, 2000, 300), (5, 9000, 900), (60, 50_000, 200)])
def test_one_identity_always_over_its_limit(spark, monkeypatch, limit, window_us, step):
    """It never pauses: one burst, decided in many segments; others beside it, and a lull
    below the limit in the middle."""
    monkeypatch.setattr(limits, "SEGMENT", 200)
    rng, at, rows = random.Random(step), 0, []
    for i in range(3000):
        at += rng.randrange(step) if i // 500 != 3 else window_us // limit + rng.randrange(step)
        rows.append((i, "busy", at, i))
    rows += [(i, f"k{i % 7}", rng.randrange(at), i) for i in range(3000, 3600)]
    given = requests(spark, rows)
    segments = limits.with_bursts(given, window_us / 1e6, limit).where("identity = 'busy' and contended")
    assert segments.select("burst", "segment").distinct().count() >= 10
    assert segments.groupBy("burst", "segment").count().agg({"count": "max"}).first()[0] <= 1000
    got = {r["request_id"]: r["admitted"] for r in limits.admit(given, limit, window_us / 1e6).collect()}
    rules, wanted = {}, {}
    for rid, who, t, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        wanted[rid] = rules.setdefault(who, Limiter(limit, window_us)).decide(t)
    assert got == wanted and 0 < sum(not v for v in wanted.values()) < len(wanted)


def test_limiter_golden():
    rule = Limiter(2, 60)
    # exactly one window old still counts; a refused request leaves no mark
    assert [rule.decide(t) for t in (0, 10, 60, 61, 70, 71)] == [True, True, False, True, False, True]


def test_previous_turns(spark):
    rng = random.Random(4)
    turns = {(key_of(rng), rng.randrange(4000)) for _ in range(2000)}
    df = spark.createDataFrame([(s, t, f"r{t % 2}", f"{s}{t}") for s, t in turns], "session_id string, turn long, role string, content string")
    got = {(r["session_id"], r["turn"]): r["previous_content"] for r in sessions.previous_turns(df, span=50).collect()}
    wanted, last = {}, {}
    for s, t in sorted(turns):
        wanted[s, t] = last.get(s)
        last[s] = f"{s}{t}"
    assert got == wanted


def test_exact_quantiles(spark):
    rng = random.Random(8)
    values = defaultdict(list)
    for _ in range(3000):
        values[key_of(rng)].append(rng.choice([1.5, rng.uniform(-5, 300), 7.0]))
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = telemetry.exact_quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}, bins=9).collect()
    for r in got:
        vs = sorted(values[r["k"]])
        for name, q in {"p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}.items():
            at = next(i for i in range(len(vs)) if i + 1 >= q * len(vs))
            assert r[name] == vs[at], (r["k"], name)


def test_quantiles_of_values_that_lie_close(spark):
    """100,000 distinct values between 0 and 1, one of them a third of all rows: no bin
    holds many of the distinct ones, and the answer is exact."""
    n = 100_000
    df = spark.range(150_000).selectExpr("'k' as k", f"case when id < {n} then id / {n}D else 0.25D end as v")
    counts = df.groupBy("k", F.col("v").alias("_v")).agg(F.count("*").alias("_n"))
    sizes = [r["count"] for r in telemetry.binned(counts, ["k"], 64).groupBy("_bin").count().collect()]
    assert len(sizes) >= 32 and max(sizes) <= 4 * n // 64
    values = sorted([i / n for i in range(n)] + [0.25] * 50_000)
    got = telemetry.exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    assert [(r["p50"], r["p95"]) for r in got] == [(values[74_999], values[142_499])]


def test_durations_are_paired_across_spans(spark):
    rng = random.Random(2)
    base, rows = datetime(2024, 1, 1), []
    for i in range(1500):
        rows.append((key_of(rng), i, rng.choice("ab"), rng.choice(["stage_start", "stage_end", "failure", "metric"]),
                     base + timedelta(seconds=i * 0.7), float(i) if i % 5 == 0 else None, None))
    df = spark.createDataFrame(rows, "trace_id string, seq long, stage string, event_type string, timestamp timestamp, duration_ms double, metadata string")
    got = {r["seq"]: r["duration_ms"] for r in telemetry.with_durations(df, span_seconds=10).collect()}
    started, wanted = {}, {}
    for trace, seq, stage, kind, at, ms, _ in rows:
        if kind == "stage_start":
            started[trace, stage] = at
        elif kind != "metric":
            paired = started.get((trace, stage))
            wanted[seq] = ms if ms is not None else (at - paired) / timedelta(milliseconds=1) if paired else None
    assert set(got) == set(wanted)
    assert all((got[k] is None) == (w is None) and (w is None or abs(got[k] - w) < 1e-6) for k, w in wanted.items())


def test_session_summary_golden(spark):
    questions = spark.createDataFrame([("q1", "s", "a"), ("q2", "t", "b")], "id string, session_id string, text string").withColumn("created_at", F.current_timestamp())
    answers = spark.createDataFrame(
        [("a1", "q1", "text", 0.5, '[{"document_id":"d","title":"T","source_type":"local","url":null,"concept_id":"c"}]')],
        "id string, question_id string, text string, confidence double, sources string",
    )
    got = {r["session_id"]: r[1:] for r in sessions.session_summaries(questions, answers).collect()}
    assert got == {"s": (1, 1, 1, 1), "t": (1, 0, 0, 0)}
