import random

import xxhash
from helpers import awkward, documents, empty

from probanda.llm import simhash
from probanda.llm.queries import QUERIES


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    w = [x for x in lowered.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: [(id, fingerprint)] → {id: smallest id reachable}"""
    values = sorted({f for _, f in prints})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        least[find(f)] = min(i, least.get(find(f), i))
    return {i: least[find(f)] for i, f in prints}


def test_query_equals_brute_force(spark):
    prints = [(i, brute_print(t)) for i, t in documents(spark)]
    classes = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (f"{f:016x}", classes[i]) for i, f in prints}


def check_prints(spark, values):
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    from probanda.llm.graph import components

    roots = {r.id: r.root for r in components(found).collect()}
    classes = brute_components(list(zip(signed, values)))
    groups = {}
    for s in signed:
        groups.setdefault(classes[s], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_links_near_segment_borders(spark):
    random.seed(1)
    base = [random.getrandbits(64) for _ in range(60)]
    near = [b ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for b in base for _ in range(5)]
    far = [b ^ (0b111 << random.randrange(61)) for b in base]
    check_prints(spark, sorted({*base, *near, *far}))


def test_hot_bucket(spark):
    """Hundreds of fingerprints that share one segment, some of them chained."""
    random.seed(2)
    values = {(7 << 32) | random.getrandbits(12) for _ in range(700)} | {(random.getrandbits(10) << 32) | 9 for _ in range(300)}
    assert len(values) > 5 * simhash.HOT_BUCKET
    check_prints(spark, sorted(values))


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = simhash.report(docs.drop("fingerprint")).collect()
    assert len(rows) == 10
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert by[1, zero] == by[2, zero] == by[3, zero] == by[None, zero] == 1
    alpha = next(f for i, f in by if i == 5)
    assert by[5, alpha] == by[6, alpha] == by[None, alpha] == 5
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7]
    assert simhash.report(empty(spark)).collect() == []
    nameless = spark.createDataFrame([(None, "one two three four")] * 3, "doc_id long, text string")
    assert simhash.dedup(nameless).count() == 1
