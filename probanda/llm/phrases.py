"""Phrase collocations by set-oriented relational mining (SETM).

The occurrence relation of length k has a row (position, group) for every occurrence of a
phrase of k words, sorted by position; a group is a phrase.  It is written in blocks of
about BLOCK words of one language.  Positions run through the pieces of a block and leave
one number out between pieces, so neighbours in a relation are neighbours in a piece.  For
the next length a block is semi-joined with the frequent groups and merge-joined with
itself by adjacent position; groups are counted in the block, then over all blocks.  Both
parts of a frequent phrase are frequent, so this meets every one.

Most groups are rare, so a first count goes by hashes: sums of the blocks' counts by hash
are never below the count of a phrase, and groups whose hash has too few are left out
before their text is made, written or shuffled.  The hashes that remain reach the blocks as
a Bloom filter of at most MOST_BITS bits.  What either lets through wrongly costs work and
is dropped by the count of whole phrases that follows; no result is estimated.  A piece that
goes on beyond a block leaves its last words to the next one, which joins with them but does
not count what lies within them.

Cases: null text is empty and gives nothing; null lang is ``und``; empty and white-space
texts have no words; texts of any length are read in slices; repeated rows count each time;
ties go by score, frequency, then phrase in UTF-8 order; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import SMALL_GROUPS
from .common import ship, small_batches, stored

LONGEST = 4  # words of a phrase
LEAST = 30  # occurrences of a phrase
CONTAINED = 80  # per cent of a phrase's occurrences inside a longer one that drop it
BEST = 2000  # phrases listed for a language
SCALE = 2_000_000
BLOCK = 1 << 19  # words of a block
BUFFERED = 1 << 21  # words held by a task over all languages
SLICE = 1 << 20  # bytes of text split at once
MOST_BITS = 1 << 27  # of the filter: 16 MB
BITS_EACH, PROBES = 12, 3
PIECE = 1 << 20  # hashes meant to be summed in one task

RELATION = "lang string, carry int, at binary, of binary, groups array<struct<phrase:string,n:bigint>>, hashes binary, ends binary"
#: A-Z lower-cased, everything that ends a piece a line feed.
_BYTES = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = (b" ", b"\t", b"\n")


class Words:
    """Words of one block in the making."""

    def __init__(self, carried: list[bytes] = ()):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.lengths, self.carry = array("i"), array("i", [len(carried)]), len(carried)
        self.ids.extend(map(self.number.__getitem__, carried))

    def add(self, window: bytes, goes_on: bool) -> None:
        for k, piece in enumerate(window.split(b"\n")):
            words = piece.split()
            self.ids.extend(map(self.number.__getitem__, words))
            if goes_on and not k:
                self.lengths[-1] += len(words)
            else:
                self.lengths.append(len(words))

    def row(self, lang: str) -> pa.RecordBatch:
        lengths = np.frombuffer(self.lengths, np.int32)
        at = np.arange(len(self.ids), dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        seed, digest = xxhash.xxh64_intdigest(lang.encode()), xxhash.xxh64_intdigest
        hashes = np.array([digest(w, seed) for w in self.number], np.uint64)
        return relation(lang, Occurrences(self.carry, 1, at, np.frombuffer(self.ids, np.int32), hashes, hashes), list(self.number))

    def last(self) -> list[bytes]:
        """The end of the open piece that later phrases can begin with."""
        names = list(self.number)
        own = min(LONGEST - 1, self.lengths[-1])
        return [names[i] for i in self.ids[len(self.ids) - own :]]


@dataclass
class Occurrences:
    """A block of a relation: position and group of each row, hash of each group and of its
    last word."""

    carry: int
    size: int
    at: np.ndarray
    of: np.ndarray
    hashes: np.ndarray
    ends: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int, size: int) -> "Occurrences":
        carry, steps, of, hashes, ends = (batch.column(c)[i] for c in ("carry", "at", "of", "hashes", "ends"))
        at = np.cumsum(np.frombuffer(steps.as_buffer(), np.int32), dtype=np.int32)
        return cls(carry.as_py(), size, at, np.frombuffer(of.as_buffer(), np.int32), np.frombuffer(hashes.as_buffer(), np.uint64), np.frombuffer(ends.as_buffer(), np.uint64))

    def counts(self) -> np.ndarray:
        """Occurrences of each group, without those that end within the carried words."""
        return np.bincount(self.of[self.at + self.size > self.carry], minlength=len(self.hashes))

    def semi_join(self, kept: np.ndarray) -> "Occurrences":
        """The rows of kept groups; groups keep their numbers."""
        alive = kept[self.of] if len(kept) else np.zeros(0, bool)
        return replace(self, at=self.at[alive], of=self.of[alive])

    def merge_join(self) -> tuple["Occurrences", np.ndarray, np.ndarray]:
        """The relation of one word more, and the two groups that each of its groups joins."""
        first = np.flatnonzero(self.at[1:] == self.at[:-1] + 1)
        n = max(1, len(self.hashes))
        both, of = np.unique(self.of[first].astype(np.int64) * n + self.of[first + 1], return_inverse=True)
        left, right = both // n, both % n
        hashes = self.hashes[left] * _FACTOR + self.ends[right]
        return Occurrences(self.carry, self.size + 1, self.at[first], of, hashes, self.ends[right]), left, right


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, PROBES + 1, dtype=np.uint64) * _FACTOR


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes evenly."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def relation(lang: str, rows: Occurrences, names: list[bytes]) -> pa.RecordBatch:
    phrases = pa.array(names, pa.binary()).view(pa.string())
    each = pa.StructArray.from_arrays([phrases, pa.array(rows.counts(), pa.int64())], ["phrase", "n"])
    groups = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), each)
    steps = np.diff(rows.at, prepend=np.int32(0)).astype(np.int32)
    blobs = [pa.array([x.tobytes()]) for x in (steps, rows.of.astype(np.int32))] + [groups] + [pa.array([x.tobytes()]) for x in (rows.hashes, rows.ends)]
    return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([rows.carry], pa.int32()), *blobs], ["lang", "carry", "at", "of", "groups", "hashes", "ends"])


def windows(text: bytes) -> Iterator[bytes]:
    """Slices of a text that end between words."""
    start = 0
    while start < len(text):
        end = start + SLICE
        if end < len(text):
            cut = max(text.rfind(b, start, end) for b in _BLANK)
            if cut < 0:
                later = [c for b in _BLANK if (c := text.find(b, end)) >= 0]
                cut = min(later) if later else len(text)
            end = cut + 1
        yield text[start:end]
        start = end


def occurrences(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The relation of length 1."""

    def task(batches):
        open_: dict[str, Words] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, name in enumerate(langs):
                goes_on = False
                for window in windows((batch.column(1)[i].as_py() or b"").translate(_BYTES)):
                    block = open_.get(name) or open_.setdefault(name, Words())
                    block.add(window, goes_on)
                    goes_on = not window.endswith(b"\n")
                    if len(block.ids) >= BLOCK:
                        yield block.row(name)
                        open_[name] = Words(block.last() if goes_on else [])
                if sum(len(b.ids) for b in open_.values()) >= BUFFERED:
                    yield from (b.row(k) for k, b in open_.items())
                    open_ = {}
        yield from (b.row(k) for k, b in open_.items())

    rows = ship(docs).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(task, RELATION)


@dataclass
class Filter:
    """Bloom filter of the hashes that occur often enough."""

    pieces: int
    bits: int
    words: np.ndarray

    def spots(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for step in _STEPS:
            yield mixed(keys + step) & np.uint64(self.bits - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for spot in self.spots(keys_of(hashes, self.pieces)):
            found &= (self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return found

    @classmethod
    def of(cls, keys: DataFrame, pieces: int) -> "Filter":
        """keys(key): the hashes as ``keys_of`` has them."""
        bits, wanted = 1 << 16, keys.count()
        while bits < min(MOST_BITS, BITS_EACH * wanted):
            bits *= 2
        empty = cls(pieces, bits, np.zeros(bits >> 6, np.uint64))

        def task(batches):
            for batch in batches:
                for spot in empty.spots(batch.column(0).to_numpy().view(np.uint64)):
                    one = np.uint64(1) << (spot & np.uint64(63))
                    yield pa.RecordBatch.from_arrays([pa.array((spot >> np.uint64(6)).view(np.int64)), pa.array(one.view(np.int64))], ["word", "bit"])

        rows = keys.mapInArrow(task, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        empty.words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return empty


def keys_of(hashes: np.ndarray, pieces: int) -> np.ndarray:
    """The number of the piece (a power of two of them) and 32 bits of a hash."""
    return mixed(hashes) >> np.uint64(33 - pieces.bit_length())


def common_hashes(blocks: DataFrame, size: int, pieces: int, least: int, alive: Filter | None = None) -> Filter:
    """Filter of the hashes of phrases of ``size`` words that occur ``least`` times.  From
    the relation of that size, or of one word less (``alive``: semi-joined before)."""
    shared = blocks.sparkSession.sparkContext.broadcast(alive)

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = Occurrences.read(batch, i, max(1, size - 1))
                if size > 1:
                    rows = (rows if shared.value is None else rows.semi_join(shared.value.has(rows.hashes))).merge_join()[0]
                n = rows.counts()
                keys, n = keys_of(rows.hashes, pieces)[n > 0], n[n > 0].astype(np.uint32)
                order = np.argsort(keys)
                keys, n = keys[order], n[order]
                piece, first = np.unique((keys >> np.uint64(32)).astype(np.int32), return_index=True)
                cuts = pa.py_buffer((4 * np.append(first, len(keys))).astype(np.int32))
                blob = lambda x: pa.Array.from_buffers(pa.binary(), len(piece), [None, cuts, pa.py_buffer(x)])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(piece), blob(keys.astype(np.uint32)), blob(n)], ["piece", "low", "n"])

    def summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, n = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint32) for c in ("low", "n"))
        low, where = np.unique(low, return_inverse=True)
        often = low[np.bincount(where, n) >= least].astype(np.int64)
        return pa.table({"key": (key[0].as_py() << 32) + often})

    parts = blocks.select("carry", "at", "of", "hashes", "ends").mapInArrow(task, "piece int, low binary, n binary")
    return Filter.of(stored(parts.groupBy("piece").applyInArrow(summed, "key long"), f"common-{size}"), pieces)


def longer(blocks: DataFrame, size: int, common: Filter, alive: Filter | None) -> DataFrame:
    """The relation of phrases of ``size`` words from that of one word less: the groups that
    ``common`` lets through."""
    shared = blocks.sparkSession.sparkContext.broadcast((common, alive))

    def task(batches):
        common, alive = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                old = Occurrences.read(batch, i, size - 1)
                rows, left, right = (old if alive is None else old.semi_join(alive.has(old.hashes))).merge_join()
                kept = common.has(rows.hashes)
                if kept.any():
                    number = np.cumsum(kept) - 1
                    rows = rows.semi_join(kept)
                    rows = replace(rows, of=number[rows.of], hashes=rows.hashes[kept], ends=rows.ends[kept])
                    names = batch.column("groups")[i].values.field(0).view(pa.binary()).to_pylist()
                    joined = [names[a] + b" " + names[b].rpartition(b" ")[2] for a, b in zip(left[kept].tolist(), right[kept].tolist())]
                    yield relation(batch.column("lang")[i].as_py(), rows, joined)

    return blocks.mapInArrow(task, RELATION)


def counted(blocks: DataFrame) -> DataFrame:
    """lang, phrase, f of the groups of a relation."""
    each = blocks.select("lang", F.inline("groups")).where("n > 0")
    return each.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, size) of all phrases of up to LONGEST words with f >= least, and
    (lang, n) with all occurrences of words.  Blocks are large rows: few are held at once."""
    with small_batches(docs.sparkSession):
        return _frequent_phrases(docs, text, lang, least)


def _frequent_phrases(docs: DataFrame, text: str, lang: str, least: int) -> tuple[DataFrame, DataFrame]:
    blocks = stored(occurrences(docs, text, lang), "phrases-1", **_WRITE)
    words = F.aggregate("groups", F.lit(0).cast("long"), lambda a, g: a + g["n"])
    totals = stored(blocks.select("lang", words.alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    pieces = 16
    while pieces < (totals.agg(F.sum("n")).first()[0] or 0) / PIECE:
        pieces *= 2
    found = often(blocks, 1, least)
    alive = common_hashes(blocks, 1, pieces, least)
    for size in range(2, LONGEST + 1):
        common = common_hashes(blocks, size, pieces, least, alive)
        blocks = stored(longer(blocks, size, common, alive), f"phrases-{size}", **_WRITE)
        found, alive = found.union(often(blocks, size, least)), None  # those blocks hold common groups alone
    return found, totals


def often(blocks: DataFrame, size: int, least: int) -> DataFrame:
    return stored(counted(blocks).where(F.col("f") >= least).withColumn("size", F.lit(size)), f"frequent-{size}")


#: Blocks are large rows: a row group has one or few of them, so that a reader's batch is small.
_WRITE = {"compression": "zstd", **SMALL_GROUPS}


def part(words: Column, start, count) -> Column:
    return F.array_join(F.slice(words, start, count), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest cut, the first among equal ones."""
    words = F.split("phrase", " ")
    cuts = frequent.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.col("w"), F.lit(1), F.col("cut")).alias("first"), part(F.col("w"), F.col("cut") + 1, F.size("w")).alias("rest"))
    first = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))")
    each = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).withColumn("score", score)
    lowest = each.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def independent(candidates: DataFrame, frequent: DataFrame, share: int = CONTAINED) -> DataFrame:
    """Candidates of which no longer one has ``share`` per cent of their occurrences."""
    spans = "flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), s -> array_join(slice(w, s, k), ' '))))"
    inner = frequent.where("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("w")).select("lang", "f", F.explode(F.expr(spans)).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = candidates.join(most, ["lang", "phrase"], "left")
    inside = F.lit(100).cast("decimal(10,0)") * F.coalesce("most", F.lit(0)).cast("decimal(20,0)")
    return kept.where(inside < F.lit(share).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)")).drop("most")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, best: int = BEST) -> DataFrame:
    """Each lang's best phrases: lang, rank, phrase, a, l, r, n, score."""
    frequent, totals = frequent_phrases(docs, text, lang, least)
    kept = independent(scored(frequent), frequent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame) -> DataFrame:
    return collocations(docs)


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, d, p, words FROM (
    SELECT lang, d, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (
      SELECT lang, row_number() OVER () AS d,
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
      FROM documents)),
    LATERAL (SELECT regexp_extract_all(piece, '[^\x20\x09]+') AS words)
),
counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(words[s : s + size - 1], ' ') AS phrase
    FROM pieces, unnest([1, 2, 3, 4]) AS z(size), LATERAL (SELECT unnest(generate_series(1, len(words) - size + 1)) AS s)
  ) GROUP BY ALL
),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
frequent AS (SELECT * FROM counts WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, size - 1)) AS cut FROM frequent WHERE size > 1) c
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 :], ' ')
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[s : s + k - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT *, string_split(phrase, ' ') AS w FROM frequent WHERE size > 2), unnest([2, 3]) AS z(k), LATERAL (SELECT unnest(generate_series(1, size - k + 1)) AS s)
  WHERE k < size GROUP BY ALL
),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM scored s LEFT JOIN inner_ i USING (lang, phrase) WHERE 100::HUGEINT * coalesce(most, 0) < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
