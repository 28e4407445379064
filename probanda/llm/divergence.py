"""How far the sources of a language differ, and by which terms; the terms that stand out
are found by dominance skybands.

The value of a term in a group grows with its count there and falls with its count in the
language, and equal values rank by UTF-8 order.  A term with at least as high a group
count, at most as high a language count and an earlier place in UTF-8 order therefore
ranks before another: it dominates it.  Terms dominated by k others are not among the
first k.  Every partition keeps its terms dominated by fewer than k (its skyband), skybands
are merged in slots and then whole, and only what is left is ranked by exact values.

Pairs of sources are summed in cells: about TERMS terms by two tiles of TILE sources, one
dense product of int64 per cell; a term that a source lacks counts there with its share of
nothing.  Shares are computed in decimals, values stay below 2^63 (a square of at most
10^18), so all arithmetic is exact.

Cases: null text, lang and source are empty strings; groups without terms have their pairs,
with value 0 where the language keeps no term; texts of any length are read in slices; a
repeated row is a document of its own; ties go by UTF-8 order; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ship, stored
from .phrases import windows

LEAST = 10  # documents of a language with a kept term
BEST = 10  # terms listed for a group
TERMS, TILE = 1024, 128
CHUNK = 256
HELD = 300_000  # entries that a task holds before it hands them on
SLOTS = 16

#: A-Z lower-cased, ASCII letters and all bytes beyond ASCII kept, the rest blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""

    def rows(held: dict):
        for (lang, source), (counts, documents) in held.items():
            if counts:
                terms = pa.array(counts.keys(), pa.binary()).view(pa.string())
                each = [pa.array([lang] * len(counts)), pa.array([source] * len(counts)), terms, pa.array(counts.values(), pa.int64()), pa.array([documents[t] for t in counts], pa.int64())]
                yield pa.RecordBatch.from_arrays(each, ["lang", "source", "term", "n", "docs"])

    def task(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                counts, documents = held.setdefault(group, (Counter(), Counter()))
                before, own = len(counts), set()
                for window in windows((batch.column(2)[i].as_py() or b"").translate(_BYTES)):
                    terms = window.split()
                    counts.update(terms)
                    own.update(terms)
                documents.update(own)
                size += len(counts) - before + 1
                if size >= HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    parts = docs.mapInArrow(task, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) of long columns, exactly."""
    return F.expr(f"1 + (1000000000BD * cast({count} + 2 as decimal(20,0))) div cast({total} + 2 * {kept} as decimal(20,0))")


def value(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of long columns."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def skyband(rows: pa.Table, k: int) -> pa.Table:
    """The rows (term, n, total) dominated by fewer than k others."""
    if rows.num_rows <= k:
        return rows
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("n", "descending"), ("total", "ascending"), ("term", "ascending")]))
    place = np.empty(rows.num_rows, np.int64)
    place[pc.sort_indices(rows, sort_keys=[("term", "ascending")]).to_numpy()] = np.arange(rows.num_rows)
    n, total = rows["n"].to_numpy(), rows["total"].to_numpy()
    kept = np.zeros(0, np.int64)
    for start in range(0, rows.num_rows, CHUNK):  # dominators come earlier in this order
        own = np.arange(start, min(start + CHUNK, rows.num_rows))
        by = np.concatenate([kept, own])
        over = (n[by] >= n[own][:, None]) & (total[by] <= total[own][:, None]) & (place[by] < place[own][:, None])
        kept = np.concatenate([kept, own[over.sum(1) < k]])
    return rows.take(pa.array(kept))


def leading_terms(rows: DataFrame, k: int) -> DataFrame:
    """rows(lang, source, term, n, total): those that can be among a group's first k."""
    schema = "lang string, source string, term string, n long, total long"
    names = ["lang", "source", "term", "n", "total"]

    def partition(batches):
        held: dict[tuple, pa.Table] = {}
        size = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for group, frame in table.select(["lang", "source"]).append_column("at", pa.array(np.arange(len(table)))).to_pandas().groupby(["lang", "source"]):
                part = table.take(pa.array(frame["at"].to_numpy()))
                old = held.get(group)
                held[group] = skyband(part if old is None else pa.concat_tables([old, part]), k)
                size += len(held[group]) - (0 if old is None else len(old))
            if size >= HELD:
                yield from (b for t in held.values() for b in t.select(names).to_batches())
                held, size = {}, 0
        yield from (b for t in held.values() for b in t.select(names).to_batches())

    def merge(table: pa.Table) -> pa.Table:
        return skyband(table.select(names), k)

    local = rows.select(*names).mapInArrow(partition, schema)
    slotted = local.withColumn("slot", F.pmod(F.xxhash64("term"), F.lit(SLOTS))).groupBy("lang", "source", "slot").applyInArrow(merge, schema)
    return slotted.groupBy("lang", "source").applyInArrow(merge, schema)


def pair_sums(kept: DataFrame, facts: DataFrame) -> DataFrame:
    """lang, i, j, value of all ordered pairs of the numbered sources of a language."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int")
    facts = facts.select("lang", "source", "i", "own", "v", "tiles", blocks.alias("blocks"), F.floor(F.col("i") / TILE).cast("int").alias("tile"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    cell = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
    left = kept.join(facts, ["lang", "source"]).select("lang", block.alias("block"), "tile", "tiles", "term", "i", share("n", "own", "v").alias("p"))
    left = cell(left).select("lang", "block", "a", "b", "term", "i", "p")
    sizes = kept.select("lang", "term").distinct().join(facts.select("lang", "blocks").distinct(), "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("terms"))
    right = facts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sizes, ["lang", "block"], "left")
    nothing = F.when(F.col("v") > 0, share("0", "own", "v")).otherwise(1)
    right = cell(right).select("lang", "block", "a", "b", "tile", "i", nothing.alias("p"), F.coalesce("terms", F.lit(0)).alias("terms"))
    keys = ["lang", "block", "a", "b"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both come from facts
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell_sums, "lang string, i int, j int, value long")
    return parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def cell_sums(key: tuple, terms: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """The sums of one cell: sources of tile a against those of tile b."""
    lang, _, a, b = key
    sources = sources.sort_values("i")
    number, nothing, tile = sources["i"].to_numpy(), sources["p"].to_numpy(np.int64), sources["tile"].to_numpy()
    left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
    sums = np.zeros((len(left), len(right)), np.int64)

    def add(p: np.ndarray, times: int = 1) -> None:
        for x, s in enumerate(left):
            q, own = p[:, right], p[:, s : s + 1]
            sums[x] += times * ((own - q) ** 2 // (own + q)).sum(0)

    which, names = pd.factorize(terms["term"])
    order = np.argsort(which, kind="stable")
    which, at, p = which[order], np.searchsorted(number, terms["i"].to_numpy()[order]), terms["p"].to_numpy(np.int64)[order]
    for start in range(0, len(names), CHUNK):
        lo, hi = np.searchsorted(which, [start, start + CHUNK])
        dense = np.tile(nothing, (min(CHUNK, len(names) - start), 1))
        dense[which[lo:hi] - start, at[lo:hi]] = p[lo:hi]
        add(dense)
    if len(sources):
        add(nothing[None, :], int(sources["terms"].iloc[0]) - len(names))
    i, j = np.repeat(number[left], len(right)), np.tile(number[right], len(left))
    out = pd.DataFrame({"lang": lang, "i": i, "j": j, "value": sums.ravel()})
    out = out[out["i"] != out["j"]]
    return out if a == b else pd.concat([out, out.rename(columns={"i": "j", "j": "i"})])


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of the language (``pair``)
    and the group's ``best`` terms (``term``)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = ship(docs).select(name(lang).alias("lang"), name(source).alias("source"), F.col(text).cast("binary").alias("text"))
    counts = stored(term_counts(docs), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = stored(counts.drop("docs").join(terms, ["lang", "term"]), "kept-terms")
    facts = stored(group_facts(docs, kept), "group-facts")
    pairs = pair_sums(kept, facts)
    names = facts.select("lang", F.col("i"), "source").join(facts.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), "lang")
    pairs = pairs.join(names, ["lang", "i", "j"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    p, q = share("n", "own", "v"), share("total", "whole", "v")
    sums = facts.select("lang", "source", "own", "whole", "v")
    above = kept.join(sums, ["lang", "source"]).where(p > q)
    first = leading_terms(above, best).join(sums, ["lang", "source"])
    first = first.withColumns({"p": p, "q": q}).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)


def group_facts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Each (lang, source): number i in its language, tiles of the language, occurrences of
    kept terms in the group (own) and the language (whole), kept terms (v)."""
    groups = docs.select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    whole = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("whole"), F.count("*").alias("v"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("i")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    facts = groups.select("lang", "source", number).join(sizes, "lang").join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    return facts.na.fill(0, ["own", "whole", "v"])


def report(docs: DataFrame) -> DataFrame:
    return divergences(docs)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
terms AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, sum(total)::HUGEINT AS whole, count(*)::HUGEINT AS v FROM terms GROUP BY lang),
own AS (SELECT lang, source, sum(n)::HUGEINT AS own FROM counts JOIN terms USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(o.own, 0) + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (t.total + 2)) // (l.whole + 2 * l.v) AS q
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN terms t USING (lang) JOIN langs l USING (lang)
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
),
pairs AS (
  SELECT g.lang, g.source, g.item, coalesce(s.value, 0)::BIGINT AS value
  FROM (SELECT a.lang, a.source, b.source AS item FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source) g
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) s USING (lang, source, item)
),
above AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM above
) WHERE rank <= 10
"""
