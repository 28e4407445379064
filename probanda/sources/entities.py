"""Entity-table operators: lookups, latest rows, upserts and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V, schemas


def lookup(table: DataFrame, ids: DataFrame | list[str], key: str = "id") -> DataFrame:
    """Rows by id: a pushed-down filter for a literal list, a semi join for a table."""
    if isinstance(ids, DataFrame):
        return table.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    return table.where(F.col(key).isin(ids))


def latest(
    table: DataFrame,
    limit: int = V.LATEST_LIMIT,
    project_id: str | None = None,
    time: str = "created_at",
    key: str = "id",
) -> DataFrame:
    """Newest rows first, the id breaking ties; plans as TakeOrderedAndProject."""
    if project_id is not None:
        table = table.where(F.col("project_id") == project_id)
    return table.orderBy(F.col(time).desc(), F.col(key)).limit(limit)


def current_settings(log: DataFrame) -> DataFrame:
    """Last write per key, from an append-only log with an arrival number."""
    newest = F.max_by(F.struct("value", "updated_at"), F.struct("updated_at", "seq"))
    return log.groupBy("key").agg(newest.alias("last")).select("key", "last.value", "last.updated_at")


def duplicate_keys(table: DataFrame, name: str, key: list[str]) -> DataFrame:
    counts = table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return counts.agg(
        F.lit(name).alias("table_name"),
        F.lit("duplicate_key").alias("problem"),
        F.lit(",".join(key)).alias("columns"),
        F.count("*").alias("bad_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("bad_rows"),
    )


def orphans(child: DataFrame, name: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a parent.  Keys are counted before the join, so a key that
    holds a large share of the child rows crosses the shuffle once per map task."""
    wanted = (
        child.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("fk"))
        .agg(F.count("*").alias("n"))
    )
    lost = wanted.join(parent.select(F.col(key).alias("fk")), "fk", "left_anti")
    return lost.agg(
        F.lit(name).alias("table_name"),
        F.lit("orphan").alias("problem"),
        F.lit(column).alias("columns"),
        F.count("*").alias("bad_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("bad_rows"),
    )


def integrity_report(
    tables: dict[str, DataFrame],
    keys: dict[str, list[str]],
    references: list[tuple[str, str, str, str]],
) -> DataFrame:
    """One row per key and per reference (child, column, parent, parent key)."""
    parts = [duplicate_keys(tables[t], t, k) for t, k in keys.items()]
    parts += [orphans(tables[c], c, col, tables[p], k) for c, col, p, k in references]
    return reduce(DataFrame.unionByName, parts)


def entity_integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """The integrity report of entity tables by name: ids that repeat, and every declared
    reference whose two tables are given."""
    declared = [(c, col, p, "id") for c, col, p in schemas.REFERENCES if c in tables and p in tables and col in tables[c].columns]
    return integrity_report(tables, {name: ["id"] for name in tables}, declared)


def allowed_value_report(table: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    bad: Column = ~F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return table.where(bad).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the entity table in order, cast, with its defaults filled in."""
    out = []
    for field in schemas.struct_of(table):
        known = field.name in df.columns
        value = (F.col(field.name) if known else F.lit(None)).cast(field.dataType)
        default = schemas.DEFAULTS.get(table, {}).get(field.name)
        out.append((value if default is None else F.coalesce(value, F.lit(default))).alias(field.name))
    return df.select(*out)


def null_report(df: DataFrame, table: str) -> DataFrame:
    """Nulls in the required columns of an entity table, one row per column."""
    required = [f.name for f in schemas.struct_of(table) if not f.nullable]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in required]))
    return counts.select(F.lit(table).alias("table_name"), pairs.alias("p")).select("table_name", "p.*")
