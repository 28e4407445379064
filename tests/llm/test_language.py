import math
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import awkward, empty

from probanda.llm import language
from probanda.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    out = lower(text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w] + [None]


def out_of_training(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


class BruteTree:
    """Context-tree weighting by the definition: counts of every decision in every context."""

    def __init__(self, texts, order):
        self.order, self.n = order, defaultdict(lambda: [0, 0])
        for t in texts:
            for ctx, byte in self.steps(t):
                for k in range(8):
                    prefix, bit = (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1
                    for d in range(order + 1):
                        self.n[ctx[order - d :], prefix][bit] += 1
        self.children = defaultdict(set)
        for ctx, prefix in list(self.n):
            if ctx:
                self.children[ctx[1:], prefix].add(ctx)
        self.memo = {}

    def steps(self, text):
        data = bytes([255]) * self.order + (text or "").encode() + bytes([254])
        return [(data[i - self.order : i], data[i]) for i in range(self.order, len(data))]

    def pe(self, node):
        a, b = self.n[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def pw(self, ctx, prefix):
        if (ctx, prefix) not in self.memo:
            pe = self.pe((ctx, prefix))
            if len(ctx) < self.order:
                below = sum(self.pw(c, prefix) for c in self.children[ctx, prefix])
                top = max(pe, below)
                pe = top + math.log(math.exp(pe - top) + math.exp(below - top)) - math.log(2)
            self.memo[ctx, prefix] = pe
        return self.memo[ctx, prefix]

    def one(self, ctx, prefix, d):
        node = (ctx[self.order - d :], prefix)
        if node not in self.n:
            return 0.5
        a, b = self.n[node]
        kt = (b + 0.5) / (a + b + 1)
        if d == self.order:
            return kt
        w = math.exp(self.pe(node) - math.log(2) - self.pw(*node))
        return w * kt + (1 - w) * self.one(ctx, prefix, d + 1)

    def score(self, text):
        total = 0.0
        for ctx, byte in self.steps(text):
            for k in range(8):
                p = self.one(ctx, (1 << k) | byte >> (8 - k), 0)
                total += math.log10(p if byte >> (7 - k) & 1 else 1 - p)
        return total


def brute(rows, order):
    train = [t for i, t in rows if not out_of_training(i)]
    counts = Counter(w for t in train for w in words(t))
    n, v = sum(counts.values()), len(counts)
    tree = BruteTree(train, order)
    out = []
    for i, t in rows:
        own = words(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((i, out_of_training(i), len(own), sum(counts[w] > 0 for w in own), n, base, tree.score(t)))
    return out


def same(got, want):
    got = sorted(got, key=str)
    want = sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def rows_of(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]


@pytest.mark.parametrize("frequent, nodes", [(200_000, 2_000_000), (5, 500)])
def test_small_table_equals_brute_force(spark, monkeypatch, frequent, nodes):
    """Also with most words joined and the model in many blocks."""
    monkeypatch.setattr(language, "FREQUENT", frequent)
    monkeypatch.setattr(language, "BLOCK_NODES", nodes)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 400").limit(25)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (20, ""), (7, "Ünïcödé 🙂")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    same(rows_of(language.report(table)), brute(rows, language.ORDER))


def test_query_base_scores_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op6_language"](spark, SF).collect()
    train = [t for i, t in rows if not out_of_training(i)]
    counts = Counter(w for t in train for w in words(t))
    n, v = sum(counts.values()), len(counts)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        own = words(t)
        assert (by[i].n_tokens, by[i].n_known, by[i].train_tokens, by[i].held_out) == (len(own), sum(counts[w] > 0 for w in own), n, out_of_training(i))
        assert by[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
    held = [r for r in got if r.held_out]
    assert held and sum(r.bits_per_byte for r in held) / len(held) < 4


def test_awkward_rows(spark):
    docs = awkward(spark).where("length(text) IS NULL OR length(text) < 1000")
    out = language.score(docs)
    assert set(docs.columns) - {"text"} <= set(out.columns)
    assert len(out.collect()) == 9
    assert language.report(empty(spark)).collect() == []
    held = next(i for i in range(100) if out_of_training(i))
    only = spark.createDataFrame([(held, "ab"), (held, None)], "doc_id long, text string")
    got = sorted(rows_of(language.report(only)), key=str)
    assert [g[2:5] for g in got] == [(1, 0, 0), (2, 0, 0)] and all(g[6] == pytest.approx(8 * math.log10(0.5) * (1 if g[2] == 1 else 3)) for g in got)
