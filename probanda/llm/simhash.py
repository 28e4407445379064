"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits.  Two fingerprints at distance 2 or less either
differ in at most one bit of the high segment, or agree in the low one.  So one table per
segment is probed with the Hamming ball of radius 1 around the high segment and of radius
0 around the low one; matches are verified on all 64 bits inside the join.

Equal fingerprints are one entry.  A table value that more than HOT_BUCKET fingerprints
share would pair them all; fingerprints that probe such a value meet instead at the points
of their full radius-1 balls, where at most 65 of them, all of them links, can meet.

Cases: null, empty and white-space texts have fingerprint zero and link like any other;
fewer words than a shingle make one shingle; repeated rows share a component; an empty
table gives an empty table; a null doc_id is never the smallest of a component that has
another, and stays null where all are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import stored, text_or_empty, with_columns
from .graph import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
HOT_BUCKET = 64
AT_ONCE = 100_000  # shingles of one text held at once

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, size: int = SHINGLE) -> int:
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for start in range(0, n, AT_ONCE):
        window = words[start : start + min(AT_ONCE, n - start) + size - 1]
        shifted = [window[k:] for k in range(min(size, len(window)))]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*shifted)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += np.add.reduce(bits, axis=0, dtype=np.int64)
    value = sum(1 << int(k) for k in np.flatnonzero(2 * count > n))
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``fingerprint`` as a signed long."""

    def run(texts: list[str]) -> list[pa.Array]:
        return [pa.array([fingerprint(t) for t in texts], pa.int64())]

    return with_columns(docs, T.StructType().add("fingerprint", T.LongType()), text, run, keep)


def ball(value: Column, bits: range) -> Column:
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in bits])


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints at distance 1 or 2, but that a hot
    bucket's members may be linked through one another instead of pair by pair."""
    high = F.shiftrightunsigned("f", 32)
    low = F.col("f").bitwiseAND(F.lit(0xFFFFFFFF))
    f = prints.select(F.col("fingerprint").alias("f"))
    entries = f.select("f", F.posexplode(F.array(high, low)).alias("segment", "value"))
    hot = stored(entries.groupBy("segment", "value").count().where(F.col("count") > HOT_BUCKET).select("segment", "value"), "hot-buckets")
    probes = f.select("f", F.explode(ball(high, range(32))).alias("value")).withColumn("segment", F.lit(0)).unionByName(
        f.select("f", low.alias("value")).withColumn("segment", F.lit(1))
    )
    table = entries.join(hot, ["segment", "value"], "left_anti").select("segment", "value", F.col("f").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    asked = probes.withColumnRenamed("f", "a")
    same = (asked["segment"] == table["segment"]) & (asked["value"] == table["value"])
    # the low segment finds a pair from either side, the high one too: ordered once
    found = asked.join(table, same & (F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = probes.join(hot, ["segment", "value"], "left_semi").select("f").distinct()
    points = crowded.select("f", F.explode(ball(F.col("f"), range(64))).alias("point"))
    meeting = points.groupBy("point").agg(F.min("f").alias("a"), F.collect_list("f").alias("members")).where(F.size("members") > 1)
    met = meeting.select("a", F.explode("members").alias("b")).where("a <> b")
    return found.union(met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash, fingerprint (signed long), component_id and representative (a
    struct that orders documents: known ids first, then id, then text hash) of every row."""
    rows = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text_or_empty(text)).alias("text_hash"))
    own = stored(fingerprints(rows, "text", ["doc_id", "text_hash"]), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "fingerprint")
    first = stored(own.groupBy("fingerprint").agg(F.min(order).alias("first")), "distinct-fingerprints")
    roots = components(links(first))
    placed = first.join(roots, first["fingerprint"] == roots["id"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    best = placed.groupBy("root").agg(F.min("first").alias("representative"))
    classes = placed.join(best, "root").select("fingerprint", "representative")
    return own.join(classes, "fingerprint").select("doc_id", "text_hash", "fingerprint", F.col("representative.doc_id").alias("component_id"), "representative")


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each component, by smallest doc_id: its own columns, whole."""
    chosen = near_duplicates(docs, text).where("doc_id <=> representative.doc_id AND text_hash = representative.text_hash AND fingerprint = representative.fingerprint")
    # plain keys, so that one exchange of the texts serves repeated rows and the choice
    nameless, known = F.col("doc_id").isNull().alias("__nameless"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("__known")
    keys = ["__nameless", "__known", "__text_hash"]
    chosen = chosen.select(nameless, known, F.col("text_hash").alias("__text_hash")).distinct()
    rows = docs.select("*", nameless, known, F.xxhash64(text_or_empty(text)).alias("__text_hash"))
    return rows.dropDuplicates(keys).join(chosen, keys, "left_semi").drop(*keys)


def report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
