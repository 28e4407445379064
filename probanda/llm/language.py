"""Language-model scores: context-tree weighting over bytes, and a word-unigram base.

Each byte is eight binary decisions (its bits from the top, given the bits before), each
predicted in the contexts of the last 0 to ORDER bytes.  A node is one decision in one
context; its two counts give a Krichevsky-Trofimov estimate, and weights computed from the
leaves up mix the estimates of all depths.  Counts are Spark aggregations; the subtrees
below two bytes of context, each of bounded size, are grouped tasks.  A text is followed by
an end byte; contexts at its start are filled with a start byte.

Scoring looks every (context, byte) up in tables that travel in blocks of at most
BLOCK_NODES nodes, or one pair of last bytes, each block one pass inside the same scan.
The base score needs the counts of a text's words: the FREQUENT words travel as a table of
bounded size, the others are joined.

Learnt from: all documents whose crc32(doc_id) mod 10 is not 0.

Cases: null and empty texts are one end token and one end byte; with nothing to learn from
every decision is even; a null id is not held out; repeated rows are scored (and counted)
each; an empty table gives an empty table; columns named like the outputs are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import parts, ship, stored, with_columns, without

ORDER = 3
BLOCK_NODES = 2_000_000
FREQUENT = 100_000  # words whose counts travel with the tasks
SLICE = 1 << 20  # characters whose grams are in memory at once
FLUSH = 150_000  # distinct words counted in a task before they are passed on
START, END = 0xFF, 0xFE  # never bytes of UTF-8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(text: str) -> list[bytes]:
    """Lower-cased words, then the end token, which is empty."""
    return [*text.encode("utf-8", "replace").translate(_LOWER).split(), b""]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over all given documents."""

    def task(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for _, texts in parts(batch, text, SLICE):
                for t in texts:
                    counts.update(tokens(t))
                if len(counts) >= FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select(text).mapInArrow(task, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all (context, byte) of the texts, and where each text's keys begin.  In a
    key the last byte read is lowest, then the oldest of the context up to the newest."""
    data = bytearray()
    for t in texts:
        data += bytes([START]) * order + t.encode("utf-8", "replace") + bytes([END])
    raw = np.frombuffer(bytes(data), np.uint8).astype(np.uint64)
    n = len(raw) - order
    keys = raw[order:].copy()
    for back in range(1, order + 1):
        keys |= raw[order - back : order - back + n] << np.uint64(8 * (order - back + 1))
    real = raw[order:] != START
    lengths = [len(t.encode("utf-8", "replace")) + 1 for t in texts]
    return keys[real], np.concatenate([[0], np.cumsum(lengths)[:-1]])


def gram_counts(docs: DataFrame, order: int, text: str = "text") -> DataFrame:
    """(gram, n): occurrences of every context and byte."""

    def merge(kept: list) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in kept])).astype(np.int64)

    def task(batches):
        kept: list = []
        for batch in batches:
            for _, texts in parts(batch, text, SLICE):
                kept.append(np.unique(grams(texts, order)[0], return_counts=True))
                if len(kept) == 32:
                    kept = [merge(kept)]
        if kept:
            keys, n = merge(kept)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

    return docs.select(text).mapInArrow(task, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    values, where = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in values.tolist()])[where] if len(x) else np.zeros(0)


class Level:
    """The nodes of one depth: keys (context << 8 | prefix), counts, the log of their
    Krichevsky-Trofimov probability (pe), of the mixture from here on (pw), and the weight
    of stopping here.  ``below``: summed pw of the nodes one deeper; None at the last depth."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        self.one = (n1 + 0.5) / (n0 + n1 + 1)
        self.pe = log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - 2 * math.lgamma(0.5) - log_gamma(n0 + n1 + 1)
        self.pw = self.pe if below is None else np.logaddexp(self.pe, below) - math.log(2)
        self.weight = np.ones(len(keys)) if below is None else np.exp(self.pe - self.pw - math.log(2))

    def up(self) -> Level:
        """One byte of context less."""
        keys, self.above = np.unique(self.keys >> 16 << 8 | self.keys & 255, return_inverse=True)
        return Level(keys, *(np.bincount(self.above, x, len(keys)) for x in (self.n0, self.n1, self.pw)))

    def mix(self, mixed, rest) -> None:
        """Given the share of estimates above each node and the weight left for it."""
        self.mixed, self.rest = mixed + rest * self.weight * self.one, rest * (1 - self.weight)

    def alone(self) -> np.ndarray:
        """Probability of bit 1 where no deeper node is known."""
        return self.mixed + self.rest / 2


def leaves(keys: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The deepest level of some grams; which leaf each of their eight decisions is, and its bit."""
    byte, context = keys & 255, keys >> 8
    steps = [(context << 8 | byte >> (k + 1) | 1 << (7 - k), byte >> k & 1) for k in range(7, -1, -1)]
    nodes, which = np.unique(np.concatenate([s for s, _ in steps]), return_inverse=True)
    bits = np.concatenate([bit for _, bit in steps])
    times = np.tile(n, 8)
    counts = [np.bincount(which, times * (bits == b), len(nodes)) for b in (0, 1)]
    return Level(nodes, counts[0], counts[1], None), which.reshape(8, -1), bits.reshape(8, -1)


def subtree(keys: np.ndarray, n: np.ndarray, order: int):
    """The levels order, order - 1 … 2 of grams that share the last two bytes."""
    leaf, which, bits = leaves(keys, n)
    levels = [leaf]
    for _ in range(order - 2):
        levels.append(levels[-1].up())
    return levels, which, bits


def tree(counted: DataFrame, order: int) -> DataFrame:
    """(key, value, depth): for grams (depth -1) the log10 probability of the byte, for nodes
    the probability of bit 1 where no deeper node is known.

    Subtrees below two bytes of context are one group each, of at most 256^(order - 1)
    grams.  The at most 256 x 255 nodes above them come to the driver, whose mixtures go
    back as a table of that size."""
    pair = F.shiftright("gram", 8 * (order - 1)).alias("pair")

    def tops(group: pd.DataFrame) -> pd.DataFrame:
        level = subtree(group["gram"].to_numpy(), group["n"].to_numpy(), order)[0][-1]
        return pd.DataFrame({"top": level.keys >> 16 << 8 | level.keys & 255, "n0": level.n0, "n1": level.n1, "pw": level.pw})

    first = counted.groupBy(pair).applyInPandas(tops, "top long, n0 double, n1 double, pw double")
    first = first.groupBy("top").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("pw")).orderBy("top").toPandas()
    level1 = Level(first["top"].to_numpy(np.int64), *(first[c].to_numpy() for c in ("n0", "n1", "pw")))
    level0 = level1.up()
    level0.mix(0.0, 1.0)
    level1.mix(level0.mixed[level1.above], level0.rest[level1.above])
    spark = counted.sparkSession
    shared = spark.sparkContext.broadcast((level1.keys, level1.mixed, level1.rest))

    def values(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["gram"].to_numpy()
        levels, which, bits = subtree(keys, group["n"].to_numpy(), order)
        known, mixed, rest = shared.value
        at = np.searchsorted(known, levels[-1].keys >> 16 << 8 | levels[-1].keys & 255)
        mixed, rest = mixed[at], rest[at]
        out = []
        for depth, level in enumerate(reversed(levels), 2):
            level.mix(mixed, rest)
            out.append(pd.DataFrame({"key": level.keys, "value": level.alone(), "depth": depth}))
            if depth < order:
                deeper = levels[order - depth - 1].above
                mixed, rest = level.mixed[deeper], level.rest[deeper]
        one = levels[0].mixed[which]
        out.append(pd.DataFrame({"key": keys, "value": np.log10(np.where(bits == 1, one, 1 - one)).sum(0), "depth": -1}))
        return pd.concat(out)

    above = [(int(k), float(v), depth) for depth, level in ((0, level0), (1, level1)) for k, v in zip(level.keys, level.alone())]
    below = counted.groupBy(pair).applyInPandas(values, "key long, value double, depth int")
    return stored(below.union(spark.createDataFrame(above, "key long, value double, depth int")), "lm-tree")


class Tables:
    """One block of the model: a hash table of grams and a sorted table of nodes."""

    def __init__(self, rows: pa.Table, order: int, owned: np.ndarray | None):
        self.order, self.owned = order, owned  # owned: by the last two bytes, or None for all
        keys, values, depth = (rows[c].to_numpy() for c in ("key", "value", "depth"))
        node_keys, node_p = (keys + (depth.astype(np.int64) << 48))[depth >= 0], values[depth >= 0]
        keys, logp = keys[depth < 0], values[depth < 0]
        bits = max(10, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.logp = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            here = self.keys[at] == keys
            self.logp[at[here]] = logp[here]
            keys, logp, at = keys[~here], logp[~here], (at[~here] + 1) & (len(self.keys) - 1)
        ascending = np.argsort(node_keys)
        self.node_keys, self.node_p = node_keys[ascending], node_p[ascending]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram; zero where another block owns it."""
        keys = keys.astype(np.int64)
        out, at = np.zeros(len(keys)), self.slot(keys)
        held = self.keys[at]
        found = held == keys
        out[found] = self.logp[at[found]]
        todo = np.flatnonzero(~found)
        if self.owned is not None:
            todo = todo[self.owned[keys[todo] >> (8 * (self.order - 1))]]
        at, held = at[todo], held[todo]
        while True:
            more = (held != -1) & (held != keys[todo])
            if not more.any():
                break
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            held = self.keys[at]
        seen = held != -1
        out[todo[seen]] = self.logp[at[seen]]
        fresh = todo[~seen]
        if len(fresh):
            values, where = np.unique(keys[fresh], return_inverse=True)
            out[fresh] = self.unseen(values)[where]
        return out

    def unseen(self, keys: np.ndarray) -> np.ndarray:
        """From the deepest node known for each decision; none at all is an even chance."""
        total, byte, context = np.zeros(len(keys)), keys & 255, keys >> 8
        for k in range(7, -1, -1):
            prefix, bit = byte >> (k + 1) | 1 << (7 - k), byte >> k & 1
            p = np.full(len(keys), 0.5)
            for depth in range(self.order + 1):
                key = (depth << 48) + (context >> (8 * (self.order - depth)) << 8) + prefix
                at = np.minimum(np.searchsorted(self.node_keys, key), max(0, len(self.node_keys) - 1))
                known = self.node_keys[at] == key if len(self.node_keys) else np.zeros(len(key), bool)
                p[known] = self.node_p[at[known]]
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total


def blocks(model: DataFrame, order: int):
    """The model in Tables of bounded size, split by the last two bytes of the context."""
    if model.count() <= BLOCK_NODES:
        yield Tables(model.toArrow(), order, None)
        return
    # a gram's key is a node's key with the byte in place of the prefix
    last = F.when(F.col("depth") < 0, F.shiftright("key", 8 * (order - 1))).when(F.col("depth") >= 2, F.expr("shiftright(key, 8 * (depth - 1))")).cast("int")
    sizes = model.groupBy(last.alias("last")).count().where("last IS NOT NULL").orderBy("last").collect()  # 65,536 rows at most
    groups, load = [[]], 0
    for r in sizes:
        if groups[-1] and load + r["count"] > BLOCK_NODES:
            groups.append([])
            load = 0
        groups[-1].append(r["last"])
        load += r["count"]
    taken = np.zeros(1 << 16, bool)
    for i, group in enumerate(groups):
        owned = np.zeros(1 << 16, bool)
        owned[group] = True
        taken |= owned
        if i == len(groups) - 1:
            owned |= ~taken  # contexts nobody has seen
        # the groups are ranges, as the sizes came in order
        yield Tables(model.where(last.isNull() | last.between(group[0], group[-1])).toArrow(), order, owned)


Step = tuple[T.StructType, Callable[[list[str]], list[pa.Array]]]


def model_steps(docs: DataFrame, training: DataFrame, text: str, order: int) -> list[Step]:
    """One step per block of the model, each a column of partial sums.  Without anything to
    learn from the model is one empty block."""
    counted = stored(gram_counts(training, order, text), "lm-counts")
    if counted.isEmpty():
        tables = [Tables(pa.table({"key": pa.array([], pa.int64()), "value": pa.array([], pa.float64()), "depth": pa.array([], pa.int32())}), order, None)]
    else:
        tables = blocks(tree(counted, order), order)
    return [model_step(docs.sparkSession, t, f"__lm{k}") for k, t in enumerate(tables)]


def model_step(spark: SparkSession, tables: Tables, name: str) -> Step:
    shared = spark.sparkContext.broadcast(tables)

    def run(texts: list[str]) -> list[pa.Array]:
        keys, starts = grams(texts, shared.value.order)
        return [pa.array(np.add.reduceat(shared.value.scores(keys), starts), pa.float64())]

    return T.StructType().add(name, T.DoubleType()), run


def frequent_words(counts: DataFrame) -> tuple[dict[bytes, int], int]:
    """At most FREQUENT words with the largest counts, and the count from which on all are in."""
    level = F.floor(F.log2("n") * 8)
    least, seen = None, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        seen += r["words"]
        if seen > FREQUENT:
            break
        least = r["n"]
    if least is None:
        return {}, 1 << 62
    rows = counts.where(F.col("n") >= least).toArrow()
    return dict(zip(rows["token"].to_pylist(), rows["n"].to_pylist())), least


def base_step(spark: SparkSession, words: dict[bytes, int]) -> Step:
    """What the frequent words give, and the other words with their numbers."""
    shared = spark.sparkContext.broadcast({w: math.log10(n + 0.1) for w, n in words.items()})
    schema = T.StructType().add("n_tokens", T.LongType()).add("known_here", T.LongType()).add("sum_here", T.DoubleType())
    schema = schema.add("rare", T.ArrayType(T.BinaryType())).add("times", T.ArrayType(T.IntegerType()))

    def run(texts: list[str]) -> list[pa.Array]:
        value = shared.value
        n_tokens, known, total, rare, times = [], [], [], [], []
        for t in texts:
            own = tokens(t)
            logs = [x for x in map(value.get, own) if x is not None]
            n_tokens.append(len(own))
            known.append(len(logs))
            total.append(math.fsum(logs))
            others = Counter(w for w in own if w not in value) if len(logs) < len(own) else {}
            rare.append(list(others.keys()))
            times.append(list(others.values()))
        return [pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(total, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))]

    return schema, run


OUTPUTS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def score(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """Adds held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte;
    the text itself is dropped from the result."""
    docs = ship(without(docs, *OUTPUTS))
    kept = [c for c in docs.columns if c != text]
    training = docs.where(~held_out()).select(text)
    counts = stored(word_counts(training, text), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    words, least = frequent_words(counts)
    rows = docs.withColumn("__bytes", F.coalesce(F.octet_length(text), F.lit(0)))
    model, (base_schema, base_run) = model_steps(docs, training, text, order), base_step(docs.sparkSession, words)
    for schema, run in model[:-1]:
        rows = with_columns(rows, schema, text, run, at_once=SLICE)
    schema, run = model[-1]  # the last block and the words in one pass
    rows = with_columns(
        rows, T.StructType([*schema, *base_schema]), text, lambda texts: run(texts) + base_run(texts), [c for c in rows.columns if c != text], SLICE
    )
    parts_of_model = [F.col(schema.names[0]) for schema, _ in model]
    rows = rows.withColumn("lm_score", sum(parts_of_model[1:], parts_of_model[0])).withColumn("__row", F.monotonically_increasing_id())
    rows = stored(rows, "word-scores")
    pairs = rows.select("__row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("__row", F.col("w.rare").alias("token"), F.col("w.times").alias("times"))
    met = pairs.join(counts.where(F.col("n") < least), "token", "left").groupBy("__row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("sum_there"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_there"),
    )
    unit = math.log10(sums["n"] + 0.1 * (sums["v"] + 1))
    both = rows.drop("rare", "times").join(met, "__row", "left")
    return both.select(
        *kept, held_out().alias("held_out"), "n_tokens",
        (F.col("known_here") + F.coalesce("known_there", F.lit(0))).alias("n_known"),
        F.lit(sums["n"]).cast("long").alias("train_tokens"),
        (F.col("sum_here") + F.coalesce("sum_there", F.lit(0.0)) - F.col("n_tokens") * unit).alias("base_score"),
        F.col("lm_score").alias("score"),
        (F.col("lm_score") * (-math.log2(10)) / (F.col("__bytes") + 1)).alias("bits_per_byte"),
    )


def report(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"))
