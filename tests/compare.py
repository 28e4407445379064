"""Run registered queries against their SQL twins and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SQL_SECONDS: list[float] = []
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e6 else f"{v + 0.0:.6f}"
    return str(v)


def difference(df, con, sql: str) -> str | None:
    """None when both agree in columns, types and rows, else what differs."""
    began = time.time()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    theirs = cursor.fetchall()
    SQL_SECONDS.append(time.time() - began)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    for name, kind in df.dtypes:
        wanted = TYPES.get(kind, kind)
        if kinds[name] != wanted:
            return f"type of {name}: {kind} vs {kinds[name]}"
    order = sorted(names)
    ours = sorted([tuple(_cell(r[c]) for c in order) for r in df.collect()])
    at = [names.index(c) for c in order]
    theirs = sorted([tuple(_cell(r[i]) for i in at) for r in theirs])
    if ours == theirs:
        return None if ours else "both sides are empty"
    text = f"rows {len(ours)} vs {len(theirs)}; columns {order}"
    mine, other = set(ours) - set(theirs), set(theirs) - set(ours)
    for label, rows in (("spark only", mine), ("sql only", other)):
        text += f"\n   {label} ({len(rows)}): " + " / ".join(str(r)[:400] for r in sorted(rows)[:2])
    return text


def main(argv: list[str]) -> int:
    from probanda import build_session
    import probanda.catalog as C

    sf_dir = f"/root/testdata/{argv[0]}"
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, entry in C.REGISTRY.items():
        if argv[1:] and not any(a in name for a in argv[1:]):
            continue
        began = time.time()
        SQL_SECONDS.clear()
        try:
            df = entry.run(spark, sf_dir)
            if entry.sql is None:
                problem, kind = (None if df.count() else "empty"), "rows"
            else:
                problem, kind = difference(df, con, entry.sql), "sql"
        except Exception as exc:
            problem, kind = f"{type(exc).__name__}: {str(exc)[:900]}", "error"
        spark.catalog.clearCache()
        print(f"{'ok ' if problem is None else 'BAD'} {name} [{kind}] {time.time() - began:.1f}s, sql {sum(SQL_SECONDS):.1f}s" + (f"\n   {problem}" if problem else ""), flush=True)
        bad += problem is not None
    print(f"{bad} differing", flush=True)
    return bad


if __name__ == "__main__":
    main(sys.argv[1:])
