"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte trigrams (square root of their share, weighted by rarity) and four
measures of form: adjacent repeated words, capitals, symbols and digits.  The space is the
leading right singular subspace of at most SAMPLE labelled documents; those documents'
vectors travel as a broadcast of bounded size, and every document is compared with all of
them in blocked matrix products.  The labels of the NEIGHBOURS nearest vote by cosine.

Labels of documents whose crc32(doc_id) mod 3 is 1 are never read.  Labels, lang, source
and doc_id are no inputs of a score.

Cases: null and empty texts (and any text without a neighbour of positive cosine) score the
share of label 1 in the sample; without any usable label every score is 0.5; several labels
of one id are averaged; null labels or ids are not learnt from; an empty table gives an
empty table; columns named like the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship, with_columns, without

BITS = 12  # 2^12 hashed trigrams
SAMPLE = 4096  # labelled documents learnt from: the least by hash of doc_id
DIMENSIONS = 64
NEIGHBOURS = 15
FORM_WEIGHT = 0.5
BLOCK = 512  # documents of one matrix product
SLICE = 1 << 20  # bytes of a text hashed at once

WIDTH = (1 << BITS) + 4
_CAPITAL = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_SYMBOL = np.array([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ",."])


def raw_terms(text: str) -> np.ndarray:
    """Counts of hashed trigrams as square roots of shares, then the measures of form."""
    data = text.encode("utf-8", "replace")
    out = np.zeros(WIDTH, np.float32)
    if not data.strip():
        return out
    letters = np.frombuffer(data, np.uint8)
    counts, seen = np.zeros(1 << BITS, np.int64), np.zeros(256, np.int64)
    for start in range(0, len(letters), SLICE):
        x = letters[start : start + SLICE + 2].astype(np.uint32)
        seen += np.bincount(letters[start : start + SLICE], minlength=256)
        if len(x) >= 3:
            hashed = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
            counts += np.bincount(hashed, minlength=1 << BITS)
    words = data.split()
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    out[: 1 << BITS] = np.sqrt(counts / max(1, counts.sum()))
    n = len(letters)
    out[1 << BITS :] = np.sqrt([repeats / len(words), seen[_CAPITAL].sum() / n, seen[_SYMBOL].sum() / n, seen[_DIGIT].sum() / n])
    return out


def weighted(raw: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    rows = raw[:, : 1 << BITS] * rarity
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return np.hstack([rows, FORM_WEIGHT * raw[:, 1 << BITS :]])


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def leading(rows: np.ndarray, k: int) -> np.ndarray:
    """Leading right singular vectors by block power iteration from a fixed start."""
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((rows.shape[1], min(k + 16, rows.shape[1]))))[0].astype(np.float32)
    for _ in range(8):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :k].astype(np.float32)


class Model:
    """The space, the labelled vectors in it and their labels; about 3 MB at most."""

    def __init__(self, raw: np.ndarray, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        if len(labels):
            seen = (raw[:, : 1 << BITS] > 0).sum(0)
            self.rarity = (np.log((1 + len(labels)) / (1 + seen)) + 0.3).astype(np.float32)
            rows = weighted(raw, self.rarity)
            self.space = leading(rows, DIMENSIONS)
            self.vectors = unit(rows @ self.space)

    def scores(self, raw: np.ndarray) -> np.ndarray:
        out = np.full(len(raw), self.prior)
        if not len(self.labels):
            return out
        rows = unit(weighted(raw, self.rarity) @ self.space)
        cosine = rows @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64)
        total = weight.sum(1)
        voted = (total > 1e-9) & raw.any(1)
        out[voted] = (weight * self.labels[near]).sum(1)[voted] / total[voted]
        return np.clip(out, 0, 1)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from at most SAMPLE labelled documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.avg(label).alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(SAMPLE)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(*order, F.xxhash64("text")).limit(SAMPLE)
    schema = T.StructType().add("label", T.DoubleType()).add("terms", T.BinaryType())

    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                terms = [raw_terms(t or "").astype(np.float16).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.binary())], schema.names)

    rows = ship(sample).select("label", "text").mapInArrow(task, schema).toPandas()
    raw = np.array([np.frombuffer(b, np.float16) for b in rows["terms"]], np.float32).reshape(-1, WIDTH)
    return Model(raw, rows["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: better) and ``predicted`` (1 if score >= 0.5)."""
    shared = ship(docs).sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> list[pa.Array]:
        found = [shared.value.scores(np.array([raw_terms(t) for t in texts[i : i + BLOCK]])) for i in range(0, len(texts), BLOCK)]
        values = np.concatenate(found)
        return [pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32), pa.int32())]

    return with_columns(docs, T.StructType().add("score", T.DoubleType()).add("predicted", T.IntegerType()), text, run, keep)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents predicted good, with their own columns."""
    names = docs.columns
    renamed = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    scored = score(renamed, fit(docs, labels), f"c{[n.lower() for n in names].index(text)}")
    return scored.where("predicted = 1").select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(without(docs, "score", "predicted").select("doc_id", "text"), fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
