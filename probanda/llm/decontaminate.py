"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of the benchmark items.  Per window length m, a shift table over
blocks of two words says how far the search may jump; blocks that end a pattern have shift
zero and lead to a bucket of patterns, split by first word, which direct comparison
confirms.  The patterns travel in blocks of at most BLOCK_WINDOWS, each block one pass
inside the same scan; documents are never shuffled.

Cases: null and empty texts have no words and no hits; an item without words gives no
window; an item without id marks words but is not named; repeated items count once;
repeated documents are searched alike; empty tables on either side give no hits; columns
named like the outputs are replaced.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship, stored, with_columns, without

WINDOW = 10
BLOCK_WINDOWS = 200_000  # window–item rows of one broadcast, about 60 MB in a task

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPAN = T.ArrayType(T.StructType().add("start", T.IntegerType(), False).add("end", T.IntegerType(), False), False)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split()


class WuManber:
    """Search tables for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            suffix = pattern[length - self.block :]
            self.buckets.setdefault(suffix, {}).setdefault(pattern[0], []).append((list(pattern), items))

    def search(self, words: list[bytes]):
        """(start, items) of every occurrence."""
        m, block, default = self.length, self.block, self.default
        shift, buckets, n, i = self.shift.get, self.buckets, len(words), self.length
        while i <= n:
            key = tuple(words[i - block : i])
            jump = shift(key, default)
            if jump:
                i += jump
                continue
            for pattern, items in buckets[key].get(words[i - m], ()):
                if words[i - m : i] == pattern:
                    yield i - m, items
            i += 1


def tables(rows: list[tuple[str, str | None]]) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for window, item in rows:
        pattern = tuple(window.encode().split(b" "))
        items = by_length.setdefault(len(pattern), {}).setdefault(pattern, set())
        if item is not None:
            items.add(item)
    return [WuManber(m, {p: sorted(i) for p, i in group.items()}) for m, group in sorted(by_length.items())]


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, item): every run of ``size`` words of an item, or all of a shorter one."""
    source = ship(benchmark).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))

    def task(batches):
        for batch in batches:
            found, items = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(content or "")
                for i in range(max(1, len(w) - size + 1) if w else 0):
                    found.append(b" ".join(w[i : i + size]).decode())
                    items.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(items, pa.string())], ["window", "item"])

    return source.mapInArrow(task, "window string, item string").distinct()


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, hit_spans (merged word ranges of occurrences), n_hit and items (sorted
    ids of the items whose windows occur)."""
    patterns = stored(windows(benchmark), "benchmark-windows")
    n_blocks = max(1, math.ceil(patterns.count() / BLOCK_WINDOWS))
    block = F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks))
    outputs = ["n_words", "hit_spans", "n_hit", "items"]
    kept = [c for c in without(docs, *outputs).columns if keep is None or c in keep]
    out = docs
    for k in range(n_blocks):
        rows = [(r.window, r.item) for r in patterns.where(block == k).collect()]
        last = k == n_blocks - 1
        out = search_pass(out, rows, text, f"__block{k}", kept + [f"__block{b}" for b in range(k)] + ([] if last and text not in kept else [text]))
    found = [F.col(f"__block{k}") for k in range(n_blocks)]
    n_words = found[0]["n_words"]
    if n_blocks == 1:
        spans, items = found[0]["spans"], found[0]["items"]
    else:
        spans = union_spans(F.array_sort(F.flatten(F.array(*[f["spans"] for f in found]))))
        items = F.array_sort(F.array_distinct(F.flatten(F.array(*[f["items"] for f in found]))))
    out = out.withColumn("__spans", spans)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(*kept, n_words.alias("n_words"), F.col("__spans").alias("hit_spans"), n_hit.alias("n_hit"), items.alias("items"))


def union_spans(spans):
    """Merge sorted ranges that touch or overlap."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda a: F.element_at(a, -1)

    def add(done, s):
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))),
        )
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, empty, add)


def search_pass(docs: DataFrame, rows: list, text: str, name: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tables(rows))
    kind = T.StructType().add("n_words", T.LongType(), False).add("spans", SPAN, False).add("items", T.ArrayType(T.StringType(), False), False)
    arrow = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def run(texts: list[str]) -> list[pa.Array]:
        out = []
        for t in texts:
            words = words_of(t)
            spans, items = [], set()
            for search in shared.value:
                for start, names in search.search(words):
                    spans.append((start, start + search.length))
                    items.update(names)
            out.append({"n_words": len(words), "spans": merged(spans), "items": sorted(items)})
        return [pa.array(out, arrow)]

    return with_columns(docs, T.StructType().add(name, kind), text, run, keep)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    names = docs.columns
    renamed = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    found = find(renamed, benchmark, f"c{[n.lower() for n in names].index(text)}")
    return found.where("n_hit = 0").select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document, by the digest columns."""
    found = find(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _words(text: str) -> str:
    upper = "".join(map(chr, range(65, 91)))
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text")} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM items WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item, len(w[i:i + {WINDOW - 1}]) AS m, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM starts),
docs AS (SELECT doc_id, {_words("text")} AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
ahead AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS next FROM placed),
met AS (
  SELECT a.doc_id, a.i, p.m, p.item FROM (
    SELECT doc_id, i, m, array_to_string(next[1:m], ' ') AS k FROM ahead JOIN (SELECT DISTINCT m FROM patterns) ON len(next) >= m) a
  JOIN patterns p USING (m, k)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS place FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""
